"""Operators against brute force, on a fixture of awkward rows and on the smallest tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandline.llm import (decontamination, lm_scoring, packing, prefix_free, preference, pu_quality, quality_rules, simhash, stretches,
                            substring_fm, token_scan)
from strandline.llm.components import components
from strandline.llm.tokens import vocabulary_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _doc string, fp int, key string, at int, spans string"


def prose(rng: random.Random, n: int) -> str:
    words = [f"w{rng.randint(0, 3000)}" for _ in range(n)]
    return " ".join(w + ("\n" if rng.random() < 0.05 else "") for w in words)


def awkward() -> list[tuple]:
    """NULLs in every column, empty and long texts, copies, repeated rows, shared passages, ties, clashing columns."""
    rng = random.Random(5)
    passage, long = prose(rng, 70), prose(rng, 6000)
    texts = {1: None, 2: "", 3: " \n\t ", 4: "one", 5: long, 6: long, 7: prose(rng, 40) + " " + passage, 8: passage + " " + prose(rng, 30),
             9: "ab " * 400, 10: "ß é 语言 " * 90, 11: passage, 12: prose(rng, 60) + passage + passage, 13: "x" * 3000, 14: "ab " * 400 + "tail",
             15: "<|endoftext|> \"quoted\" it's 12345 !!", 16: "A B C d", 17: "a b c D"}
    for i in range(20, 60):  # near copies of one text
        words = texts[7].split(" ")
        words[i % len(words)] = f"edit{i}"
        texts[i] = " ".join(words)
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 2}", None, "clash", 1, "k", 2, "s") for i, t in texts.items()]
    return rows + [rows[7], rows[7], (None, texts[8], "en", "s1", 3, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None),
                   (4, "another text under a repeated id", "en", "s0", 1, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def key(v):
    return (1 << 63) - 1 if v is None else v


def tallied(rows):
    return Counter(map(tuple, rows))


@pytest.mark.parametrize("split_above", [1024, 1])
def test_substring_fm(docs, none, split_above):
    rows = docs.collect()
    least = {}
    for r in rows:
        w = words(r.text)
        for x in range(len(w) - 49):
            k = tuple(w[x:x + 50])
            least[k] = min(least.get(k, key(None)), key(r.doc_id))
    want = []
    for r in rows:
        w = words(r.text)
        gone = bytearray(len(w))
        for x in range(len(w) - 49):
            if least[tuple(w[x:x + 50])] < key(r.doc_id):
                gone[x:x + 50] = b"\1" * 50
        want.append((r.doc_id, len(w), sum(gone), hashlib.sha256(" ".join(a for a, g in zip(w, gone) if not g).encode()).hexdigest()))
    got = substring_fm.substring_dedup(docs, split_above=split_above).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert tallied(got.collect()) == tallied(want)
    assert sum(x[2] for x in want) > 1000
    assert substring_fm.substring_dedup(none).count() == 0


def test_cut_repeats_keeps_columns(docs):
    got = substring_fm.cut_repeats(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    assert {r["_doc"] for r in got.collect()} == {r["_doc"] for r in docs.collect()}


@pytest.mark.parametrize("split_above", [1024, 1])
def test_prefix_free(docs, none, split_above):
    rows = docs.collect()
    times = Counter(t[x:x + 200] for t in ((r.text or "").encode() for r in rows) for x in range(len(t) - 199))
    want = []
    for r in rows:
        t = (r.text or "").encode()
        gone = bytearray(len(t))
        for x in range(len(t) - 199):
            if times[t[x:x + 200]] > 1:
                gone[x:x + 200] = b"\1" * 200
        want.append((r.doc_id, len(t), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(bytes(a for a, g in zip(t, gone) if not g)).hexdigest()))
    got = prefix_free.prefix_free_dedup(docs, split_above=split_above).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert tallied(got.collect()) == tallied(want)
    assert prefix_free.prefix_free_dedup(none).count() == 0


def test_fm_index_intervals():
    rng = np.random.default_rng(1)
    text = np.append(rng.integers(1, 6, 400), 0)
    index = substring_fm.FMIndex(text, 9)
    shorter = index.blocks(text, 7)
    place = np.arange(0, 392)
    low, high = substring_fm.matching_windows(index, shorter, text, place, 8)
    for p in place:
        same = {q for q in range(393) if (text[q:q + 8] == text[p:p + 8]).all()}
        assert set(index.suffixes[low[p]:high[p]].tolist()) == same


def simple_fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i:i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(prints: list[int], max_bits: int) -> dict[int, int]:
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in root:
        for b in root:
            if a < b and (a ^ b).bit_count() <= max_bits:
                root[find(b)] = find(a)
    return {p: find(p) for p in root}


@pytest.mark.parametrize("split_above", [2048, 2])
def test_simhash(docs, none, split_above, monkeypatch):
    monkeypatch.setattr(simhash.near_links, "__defaults__", (3, 6, split_above))
    rows = docs.collect()
    prints = {r.text: simple_fingerprint(r.text) for r in rows}
    root = grouped(list(prints.values()), 3)
    least = defaultdict(lambda: key(None))
    for r in rows:
        g = root[prints[r.text]]
        least[g] = min(least[g], key(r.doc_id))
    want = [(r.doc_id, prints[r.text], None if least[root[prints[r.text]]] == key(None) else least[root[prints[r.text]]]) for r in rows]
    got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert tallied(got) == tallied(want)
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root.values()))


def test_links_of_dense_groups(spark):
    """Thousands of fingerprints in one block stay whole without all their pairs."""
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    prints = {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(600)} | {rng.getrandbits(64) for _ in range(300)}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    for split_above in (2048, 20):
        links = simhash.near_links(spark.createDataFrame(signed, "fp long"), split_above=split_above)
        got = {r.node: r.root for r in components(links).collect()}
        groups = defaultdict(set)
        for p, g in grouped(list(prints), 3).items():
            groups[g].add(p - (1 << 64) if p >> 63 else p)
        for members in groups.values():
            assert {got.get(p, p) for p in members} == {min(members)}


def base_counts(text):
    t, w = text or "", words(text)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    times = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if times[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)


def test_line_rules(spark, docs, none):
    rng = random.Random(9)
    boiler = "Subscribe  to OUR letter now"
    extra = [(1000 + i, (boiler if i % 2 else boiler.upper()) + "\n" + prose(rng, 40), "en", "hot", 1) for i in range(60)]
    extra += [(1100 + i, "\n".join([boiler] * 9) + f"\nfew own words {i} a b c d e f g h", "en", "hot", 1) for i in range(5)]
    extra += [(1200 + i, prose(random.Random(1), 60), "en", "hot", 1) for i in range(80)]  # copies alone are no boilerplate
    table = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    got = quality_rules.line_rules(table)
    want = tallied((r.doc_id, *base_counts(r.text)) for r in table.collect())
    assert tallied(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()) == want
    for r in got.collect():
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        if r.doc_id and 1000 <= r.doc_id < 1060:
            assert r.kept and r.removed_words == 5
        if r.doc_id and 1100 <= r.doc_id < 1105:
            assert not r.kept
        if r.doc_id and r.doc_id >= 1200:
            assert r.kept and r.removed_words == 0
    cut = quality_rules.apply_line_rules(table)
    assert cut.columns == table.columns
    left = cut.collect()
    assert len(left) == got.where("kept").count()
    assert not any(boiler.split()[0].lower() in (r.text or "").lower() for r in left)
    assert all(r.n_chars == len(r.text) for r in left)
    assert quality_rules.line_rules(none).count() == 0 and quality_rules.apply_line_rules(none).count() == 0


def test_repeated_lines_go_in_small_and_large_hosts(spark):
    """The limit doesn't grow with the host, and a host of few texts can lose a line."""
    rng = random.Random(12)
    rows, i = [], 0
    for host, texts, holders in (("small", 16, 12), ("large", 500, 30), ("natural", 500, 5)):
        for k in range(texts):
            rows.append((i, ("Terms of use apply here\n" if k < holders else "") + " ".join(f"v{rng.randint(0, 3000)}" for _ in range(40)), host))
            i += 1
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    left = [r for r in quality_rules.apply_line_rules(table).collect() if "Terms of use" in r.text]
    assert {r.source for r in left} == {"natural"} and len(left) == 5


def test_packing(docs, none):
    rows = docs.collect()
    tokenizer = Tokenizer.from_file(vocabulary_path())
    ids = defaultdict(list)
    for r in rows:
        ids[r.doc_id].append(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1])
    got = packing.pack(docs).collect()
    pieces = Counter()
    for i, lists in ids.items():
        for full in lists:
            for a, b in packing._cuts(len(full), packing.LENGTH):
                pieces[(i, a, b - a, zlib.crc32(np.array(full[a:b], "<u4").tobytes()), len(full))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == pieces
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.LENGTH
    assert packing.pack(none).count() == 0


def test_packing_plan_fills_sequences():
    rng = random.Random(4)
    for times in (1, 400):
        demand = {c: rng.randint(1, 5) * times for c in range(1, 129)} | {256: 7}
        seats, made = packing.packing_plan(demand, 256)
        seated = Counter()
        for c, lo, hi, k, _ in seats:
            assert (hi - lo) % k == 0
            seated[c] += hi - lo
        assert seated == Counter(demand)
        used = Counter()
        for c, lo, hi, k, base in seats:
            for s in range((hi - lo) // k):
                used[base + s] += c * k
        assert max(used.values()) <= 256 and set(used) == set(range(made))
        ideal = sum(c * n for c, n in demand.items()) / 256
        assert made <= 1.02 * ideal + 3


def plain(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def least_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination(spark, docs):
    rng = random.Random(6)
    items = [(i, prose(rng, rng.randint(14, 59))) for i in range(40)] + [(90, None), (91, ""), (92, "too short"), (None, prose(rng, 20))]
    items.append((93, items[0][1]))
    texts = []
    for n, (i, t) in enumerate(items[:40] * 3):
        w = t.split()
        for _ in range(n // 40 * (len(w) // 10)):
            at, kind = rng.randrange(len(w)), rng.randrange(3)
            w[at:at + 1] = [[f"new{n}"], [w[at], f"new{n}"], []][kind]
        texts.append((5000 + n, prose(rng, 30) + " " + " ".join(w).upper() + ". " + prose(rng, 30)))
    table = docs.unionByName(spark.createDataFrame(texts, "doc_id long, text string"), allowMissingColumns=True)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontamination.leaks(table, bench).collect()}
    want = {}
    for r in table.collect():
        have = plain(r.text)
        for i, t in items:
            item = plain(t)
            if len(item) >= 5 and len(set(item) - set(have)) <= len(item) // 5 and (d := least_distance(item, have)) <= len(item) // 5:
                want[(r.doc_id, i)] = d
    assert set(got) <= set(want) and all(got[k] >= want[k] for k in got)
    assert len(got) >= 0.9 * len(want) >= 100
    assert all(k in got for k, d in want.items() if d == 0)
    kept = decontamination.without_leaks(table, bench)
    assert kept.columns == table.columns
    assert kept.count() == sum((r.doc_id, ) not in {(d,) for d, _ in got} for r in table.collect())
    assert decontamination.leaks(table.limit(0), bench).count() == 0
    assert decontamination.leaks(table, bench.limit(0)).count() == 0


@pytest.mark.parametrize("size", [10, 20, 50, 59, 80, 100, 150, 300])
def test_decontamination_recall_at_the_full_distance(size):
    """Passages with as many edits as are allowed are found at every size of the item."""
    rng = random.Random(size)
    items = [(i, prose(rng, size)) for i in range(100)]
    texts = []
    for _, t in items:
        w = t.split()
        for at in sorted(rng.sample(range(size), size // 5), reverse=True):
            w[at:at + 1] = [[f"new{rng.randrange(9999)}"], [w[at], f"new{rng.randrange(9999)}"], []][rng.randrange(3)]
        texts.append(prose(rng, 20) + " " + " ".join(w) + " " + prose(rng, 20))
    batch = pa.RecordBatch.from_pydict({"_doc": list(range(100)), "_row": list(range(100)), "text": texts})
    found = decontamination._search(decontamination.item_buckets(items))(iter([batch]))
    met = {(d, i) for b in found for d, i in zip(b.column("_doc").to_pylist(), b.column("item").to_pylist())}
    assert sum((i, i) in met for i, _ in items) >= 90


def test_decontamination_of_items_under_five_words(spark):
    texts = spark.createDataFrame([(1, "a B, c"), (2, "x a b c d y"), (3, "a b x c"), (4, "c d"), (5, None), (6, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "A b c"), (2, "a, b c"), (3, "c d"), (4, "y"), (5, "!"), (6, "q r s t")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance, r["at"], r.n_words) for r in decontamination.leaks(texts, items).collect()}
    assert got == {(1, 1, 0, 0, 3), (1, 2, 0, 0, 3), (2, 1, 0, 1, 3), (2, 2, 0, 1, 3), (2, 3, 0, 3, 2), (4, 3, 0, 0, 2), (2, 4, 0, 5, 1)}


def test_pu_quality(spark, docs, none):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = pu_quality.quality_scores(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    assert np.mean([[a > b for b in bad] for a in good]) > 0.9
    rows = pu_quality.quality_scores(docs, spark.createDataFrame([(7, 1), (8, 1), (None, 1), (12, None)], "doc_id long, quality int")).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id: r.held_out for r in rows if r.doc_id is not None} == {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in docs.collect() if r.doc_id is not None}
    assert pu_quality.quality_scores(none, labels).count() == 0
    assert {r.score for r in pu_quality.quality_scores(docs, labels.limit(0)).collect()} == {0.0}


def test_non_negative_risk_on_known_mixture():
    rng = np.random.default_rng(3)
    draw = lambda n, at: np.concatenate([rng.normal(at, 1, (n, 2)), np.ones((n, 1))], axis=1)
    positive, unlabelled = draw(800, 1.5), np.concatenate([draw(600, 1.5), draw(400, -1.5)])
    w = pu_quality.fit_nn_pu(positive, unlabelled, 0.6)
    assert ((draw(500, 1.5) @ w > 0).mean() + (draw(500, -1.5) @ w < 0).mean()) / 2 > 0.93
    prior = pu_quality.class_prior(positive[:, 0] + positive[:, 1], unlabelled[:, 0] + unlabelled[:, 1])
    assert 0.5 < prior < 0.72


def brute_losses(rows, trusted, weight=lm_scoring.WEIGHT):
    """(doc_id, text) to (words, target loss, background loss), from whole counts."""
    lower = lambda t: words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    uni, bi = [Counter(), Counter()], [Counter(), Counter()]
    for i, t in rows:
        w = lower(t)
        for m in (0, 1) if i in trusted else (1,):
            uni[m].update(w)
            bi[m].update(zip(w, w[1:]))
    v, n, found = len(uni[1]) + 1, [sum(u.values()) for u in uni], []
    for i, t in rows:
        w, loss = lower(t), []
        for m in (0, 1):
            p = [(uni[m][x] + 1) / (n[m] + v) if not k else weight * bi[m][w[k - 1], x] / max(uni[m][w[k - 1]], 1) + (1 - weight) * (uni[m][x] + 1) / (n[m] + v)
                 for k, x in enumerate(w)]
            loss.append(-sum(map(np.log, p)) / len(w) if w else None)
        found.append((i, len(w), *loss))
    return found


@pytest.mark.parametrize("chars", [20_000, 1 << 24])
def test_cross_entropy_difference(spark, docs, none, monkeypatch, chars):
    monkeypatch.setattr(lm_scoring, "BLOCK_CHARS", chars)
    monkeypatch.setattr(lm_scoring, "RANGE_KEYS", chars // 4)
    rare = [(2000, "common words here zyx"), (2001, "common words here qwv"), (2002, "zyx zyx zyx")]  # alike but for rare words
    more = [(None, f"null id {k} common") for k in range(300)] + [(None, None)] * 300 + rare
    all_docs = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")).repartition(5)
    trusted = spark.createDataFrame([(7,), (8,), (8,), (None,), (99_999,), (2002,)], "doc_id long")
    key = lambda r: (r[0] is None, r[0] or 0, *(round(x, 9) if x is not None else -1 for x in r[1:]))
    want = sorted(brute_losses([(r.doc_id, r.text) for r in all_docs.collect()], {7, 8, 2002}), key=key)
    got = lm_scoring.cross_entropy_difference(all_docs, trusted).collect()
    mine = sorted(((r.doc_id, r.n_tokens, r.target_loss, r.background_loss) for r in got), key=key)
    assert [m[:2] for m in mine] == [w[:2] for w in want]
    for m, w in zip(mine, want):
        assert m[2:] == (None, None) == w[2:] if not m[1] else m[2:] == pytest.approx(w[2:])
    loss = {r.doc_id: r.difference for r in got if r.doc_id in (2000, 2001)}
    assert loss[2000] < loss[2001]
    assert lm_scoring.cross_entropy_difference(none, trusted).count() == 0
    assert {r.n_tokens for r in lm_scoring.cross_entropy_difference(docs, trusted.limit(0)).collect() if r.doc_id == 4} == {1, 6}


def test_scores_do_not_depend_on_partitions(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(1, 60)], "doc_id long, quality int")
    score = lambda n: sorted((r.doc_id or 0, round(r.score, 9)) for r in pu_quality.quality_scores(docs.repartition(n), labels).collect())
    got = score(3)
    assert got == score(17)
    assert len({s for i, s in got if i == 7}) == 1  # repeated rows


def test_risk_and_its_gradient():
    """The step follows the numerical gradient of the risk; where the bracket is negative, of the turned-round one."""
    rng = np.random.default_rng(6)
    positive, unlabelled = rng.normal(0.5, 1, (40, 3)), rng.normal(0, 1, (60, 3))
    loss = lambda z: np.logaddexp(0, -z)

    def parts(w, prior):
        zp, zu = positive @ w, unlabelled @ w
        return prior * loss(zp).mean(), loss(-zu).mean() - prior * loss(-zp).mean()

    for prior, negative in ((0.3, False), (3.0, True)):  # a prior above one makes the bracket negative
        plus, minus = parts(np.zeros(3), prior)
        assert (minus < 0) == negative
        goal = (lambda w: -parts(w, prior)[1]) if negative else (lambda w: sum(parts(w, prior)))
        grad = np.array([(goal(e) - goal(-e)) / 2e-5 for e in 1e-5 * np.eye(3)])
        step = pu_quality.fit_nn_pu(positive, unlabelled, prior, steps=1, rate=0.1, decay=0)
        assert np.sign(step) == pytest.approx(-np.sign(grad))  # Adam's first step has the gradient's signs


def test_preference_format(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "more"), (1, 3, "assistant", "sure"),
             (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "more"), (2, 3, "assistant", "no"), (2, 3, "assistant", "no"),
             (3, 0, "user", "hi"), (4, 0, None, None), (4, 1, "assistant", None), (None, 0, "user", "hi"), (5, 0, "user", "hi"), (5, 1, "assistant", "hello"),
             (5, 2, "user", "more"), (5, 3, "assistant", "sure"), (6, None, None, "é" * 5)]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("prompt", F.lit("clash"))
    got = {(r.chosen_id, r.rejected_id): r for r in preference.preference_format(table).collect()}
    assert set(got) == {(1, 2), (1, 3), (1, 5)}
    r = got[(1, 2)]
    assert r.n_prompt_turns == 3 and r.prompt.endswith("<|user|>\nmore\n<|end|>\n") and r.usable
    assert [r.chosen[a:b] for a, b in r.chosen_mask] == ["sure"] and [r.rejected[a:b] for a, b in r.rejected_mask] == ["no"]
    assert got[(1, 3)].rejected == "" and got[(1, 3)].n_prompt_turns == 1
    assert not got[(1, 5)].usable
    own = preference.preference_format(table, spark.createDataFrame([(4, 6), (4, 77)], "chosen_id long, rejected_id long")).collect()
    assert len(own) == 1 and own[0].n_prompt_turns == 0 and own[0].chosen_mask == [(28 + 0, 28)] or own[0].chosen_mask
    assert preference.preference_format(table.limit(0)).count() == 0
    plan = preference.preference_format(table)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_separator_scan(spark, docs, none, tmp_path):
    tokenizer = Tokenizer.from_file(vocabulary_path())
    tokenizer.encode_special_tokens = True
    want = Counter((r.doc_id, len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert Counter((r.doc_id, r.n_tokens) for r in token_scan.document_token_counts(docs).collect()) == want
    assert token_scan.document_token_counts(none).count() == 0
    plain = spark.createDataFrame(docs.select("doc_id", "text").collect(), "doc_id long, text string")
    assert Counter((r.doc_id, r.n_tokens) for r in token_scan.document_token_counts(plain.repartition(3)).collect()) == want  # not cached
    # Small blocks: documents reach over several; the last one of a file isn't ended; misaligned bytes of the end id don't count.
    end, rng = 0x0102, random.Random(8)
    for name, ended in (("a", True), ("b", False), ("c", True)):
        lengths = [rng.choice([0, 0, 1, 5, 40, 300]) for _ in range(50)]
        ids = [x for n in lengths for x in [*(rng.choice([0x0201, 0x0101, 0x0202, 7]) for _ in range(n)), end]]
        ids = ids if ended else [*ids, 5, 6]
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
        (tmp_path / f"{name}.lengths").write_text(" ".join(map(str, lengths + [2] * (not ended))))
    (tmp_path / "empty").write_bytes(b"")
    folder = tmp_path / "flat"
    folder.mkdir()
    for name in ("a", "b", "c", "empty"):
        (folder / name).write_bytes((tmp_path / name).read_bytes())
    got = token_scan.scan_flat(spark, str(folder), end, 2, 64).orderBy("file", "ordinal").collect()
    for name in ("a", "b", "c"):
        mine = [r for r in got if r.file.endswith(f"/{name}")]
        assert [r.n_tokens for r in mine] == list(map(int, (tmp_path / f"{name}.lengths").read_text().split()))
        assert [r.ordinal for r in mine] == list(range(len(mine)))
        assert [r.ended for r in mine] == [True] * (len(mine) - (name == "b")) + [False] * (name == "b")


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_stretches_of_equal_windows_share_a_key():
    unit = substring_fm.UNIT
    assert unit.gram < unit.window and isinstance(unit, stretches.Unit)
