"""Split reads on circular exons: all that seeds allow, and reads without a seed go before they are widened."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandline.operators import kmers as K, placement as P


def _seeds(seq):
    two = seq + seq
    return Counter(two[p:p + 6] + two[p + 6 + g:p + 12 + g] for p in range(len(seq) + 30) for g in range(13, 17) if p + 12 + g <= len(two))


@pytest.mark.parametrize("most", [0, 1, 2])
def test_split_reads_against_brute_force(spark, most):
    rng = random.Random(most)
    exons = {f"e{i}": "".join(rng.choice("acgt") for _ in range(45 + i)) for i in range(3)}
    exons["e3"] = exons["e0"][:40] + exons["e1"][:20]
    seeds = {e: _seeds(s) for e, s in exons.items()}
    texts = []
    for _ in range(150):
        own = list(seeds[rng.choice(list(exons))])
        read = list(rng.choice(own) + rng.choice(own))
        for _ in range(rng.randint(0, 3)):
            read[rng.randrange(24)] = rng.choice("acgtACGTn")
        texts.append("".join(read) + rng.choice(["", "", "ttt"]))
    texts += ["acg", "", "acgt" * 5 + "acg.", "n" * 24, None]
    reads = spark.createDataFrame(list(enumerate(texts)), "read_id long, bases string")
    differ = lambda a, b: sum(x != y for x, y in zip(a, b))
    want = {}
    for i, text in enumerate(texts):
        if text is None or "." in text:
            continue
        low, n = text.lower(), 0
        for found in seeds.values() if len(low) >= 24 else ():
            a, b = ([(differ(low[h:h + 12], k), c) for k, c in found.items()] for h in (0, 12))
            n += sum(c * d for x, c in a if x <= most for y, d in b if x + y <= most)
        want[i] = n
    got = {r.read_id: r.n_pairs for r in P.place_split_reads(reads, spark.createDataFrame(list(exons.items()), "exon string, seq string"), most).collect()}
    assert got == want and len(set(want.values())) > 2


def test_codes_near_seeds(spark):
    keys = spark.createDataFrame([(0,), (0b11 << 22 | 5,)], "_key long")
    codes = spark.createDataFrame([(0,), (2,), (0b0101,), (0b11 << 22,), (0b11 << 22 | 4,), (0b11 << 22 | 6,), (0xffffff,), (None,)], "c long")
    kept = lambda most: {r.c for r in codes.where(K.code_test(keys, 12, most)(F.col("c"))).collect()}
    assert kept(0) == {0} and kept(1) == {0, 2, 5, 0b11 << 22, 0b11 << 22 | 4, 0b11 << 22 | 6}


def test_reads_are_made_twice_at_most(spark):
    runs = spark.sparkContext.accumulator(0)

    def made(x):
        runs.add(1)
        return "acgtacgtacgaacgatcgatcga" if x else "gattacagattacagattacagat"
    exons = spark.createDataFrame([("e", "".join(random.Random(7).choice("acgt") for _ in range(90)))], "exon string, seq string")
    reads = spark.range(60).select(F.col("id").alias("read_id"), F.udf(made, "string").asNondeterministic()(F.col("id") % 2).alias("bases"))
    assert {r["class"] for r in P.place_split_reads(reads, exons, 1).collect()} == {"0"}
    assert runs.value <= 2 * 60
