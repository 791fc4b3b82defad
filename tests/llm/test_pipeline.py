"""The pipeline on the smallest tables: stages, columns, and the whole run against its own stages."""

from __future__ import annotations

import itertools
import random
import re
from collections import defaultdict

import pytest

import __spark_entry__
import corpus_pipeline
from strandline.llm import near_copies, preference
from tests.compare import check, duck

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_run_agrees(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    sizes = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / str(k))
        stage(spark, docs, FOLDER).write.parquet(out)
        docs = spark.read.parquet(out)
        sizes.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] >= sizes[4] > 0
    order = ["doc_id", "start"]
    plain = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    again = corpus_pipeline.run(spark, FOLDER)
    assert again.select(plain).orderBy(order).collect() == docs.select(plain).orderBy(order).collect()


def test_stages_take_empty_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0


def test_registered(spark):
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_preference_oracle(spark):
    folder = "/root/testdata/sf0.01"
    bad, rows, _, _ = check(spark, duck(folder), folder, "op6", __spark_entry__.queries()["op6_preference_format"], preference.ORACLE)
    assert bad is None and rows


def shingle_sets(texts):
    """Sets of five-word shingles, the whole sequence if it is shorter."""
    lower = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    return [{tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set() for w in lower]


@pytest.mark.parametrize("all_pairs", [64, 2])
def test_near_copies_are_verified_and_found(spark, all_pairs):
    """Links at 0.8 of five-word Jaccard against brute force: pairs below it stay apart, of those above hardly one is missed."""
    rng = random.Random(3)
    texts = []
    for n in (30, 60, 120, 200, 400):
        for base in range(12):
            words = [f"b{rng.randrange(9000)}" for _ in range(n)]
            texts.append(" ".join(words))
            for edits in (1, max(1, n // 60), max(1, n // 45), n // 30, n // 15):
                edited = list(words)
                for at in rng.sample(range(n), edits):
                    edited[at] = f"e{rng.randrange(9000)}"
                texts.append(" ".join(edited))
    texts += [texts[0], texts[0].upper(), None, "", "two words", "Two  words"]
    sets = shingle_sets(texts)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    good = 0
    for x, y in itertools.combinations(range(len(texts)), 2):
        if sets[x] == sets[y] or len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
            root[find(y)] = find(x)
            good += 1
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = defaultdict(set)
    for r in near_copies.near_copies(docs, all_pairs=all_pairs).collect():
        got[r.root].add(r["_doc"])
    want = defaultdict(set)
    for x in range(len(texts)):
        want[find(x)].add(x)
    assert all(len({find(x) for x in members}) == 1 for members in got.values())  # nothing is joined below 0.8
    pairs = sum(len(m) * (len(m) - 1) // 2 for m in want.values())
    assert sum(len(m) * (len(m) - 1) // 2 for m in got.values()) >= 0.98 * pairs and good > 200
    assert near_copies.keep_one(docs).count() == len(got)
    assert near_copies.keep_one(docs.limit(0)).count() == 0


def test_near_copies_have_simhash_links(spark):
    """A near copy within three bits of a fingerprint that shares no MinHash key: found by SimHash, verified like any other."""
    rng = random.Random(3422)
    words = [f"b{rng.randrange(9000)}" for _ in range(60)]
    copies = []
    for _ in range(3):
        edited = list(words)
        edited[rng.randrange(10, 50)] = f"e{rng.randrange(9000)}"
        copies.append(" ".join(edited))
    one, two = shingle_sets([" ".join(words), copies[2]])
    assert len(one & two) >= 0.8 * len(one | two)
    docs = spark.createDataFrame([(0, " ".join(words)), (1, copies[2])], "doc_id long, text string")
    assert [r.doc_id for r in near_copies.keep_one(docs).collect()] == [0]
