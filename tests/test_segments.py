"""Segmentation in rounds against the same rule on plain lists."""

import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from strandline.operators import cnv as B

BINS = "chr string, bin long, normal long, tumor long"


def plain(data, lam=1):
    penalty = lam * math.log(max(sum(n + t for *_, n, t in data), 2))
    part = lambda x, both: x * math.log(x / both) if x else 0.0
    fit = lambda s: part(s[2], s[2] + s[3]) + part(s[3], s[2] + s[3])
    join = lambda a, b: (a[0], b[1], a[2] + b[2], a[3] + b[3])
    out, rounds = [], 0
    for chrom in {d[0] for d in data}:
        seg, n = sorted((b, b, x, y) for c, b, x, y in data if c == chrom), 0
        while True:
            keys = [(round(2 * (fit(a) + fit(b) - fit(join(a, b))) - penalty, 9), zlib.crc32(f"{chrom}:{a[0]}".encode()), a[0]) for a, b in zip(seg, seg[1:])]
            best = {i for i, k in enumerate(keys) if k[0] < 0 and (i == 0 or k < keys[i - 1]) and (i + 1 == len(keys) or k < keys[i + 1])}
            if not best:
                break
            seg = [join(seg[i], seg[i + 1]) if i in best else seg[i] for i in range(len(seg)) if i - 1 not in best]
            n += 1
        out += [(chrom, *s) for s in seg]
        rounds = max(rounds, n)
    return sorted(out), rounds


def segments(spark, data, **knobs):
    return sorted(map(tuple, B.cnv_segment(spark.createDataFrame(data, BINS), **knobs).collect()))


def sample(seed, sizes):
    rnd, data = random.Random(seed), []
    for chrom, n in sizes.items():
        level = 1.0
        for b in range(n):
            level = rnd.choice([0.5, 1, 3]) if rnd.random() < 0.05 else level
            if rnd.random() < 0.8:
                data.append((chrom, b * 3, rnd.randrange(30), int(rnd.randrange(30) * level)))
    return data


@pytest.mark.parametrize("width", [1, 5, 40, 1 << 16])
def test_rounds_match_the_rule_at_any_slice(spark, width):
    data = sample(3, {"chr1": 150, "chr2": 20, "chr3": 1})
    assert segments(spark, data, width=width) == plain(data)[0]


def test_equal_counts_take_few_rounds(spark):
    data = [("chr1", b, 20, 20) for b in range(700)] + [("chr1", b, 20, 90) for b in range(700, 1000)]
    want, rounds = plain(data)
    assert want == [("chr1", 0, 699, 14000, 14000), ("chr1", 700, 999, 6000, 27000)]
    assert rounds < 30 and segments(spark, data, width=128) == want


def test_empty_bins_and_rows_without_a_place(spark):
    data = [("chr1", 0, 0, 0), ("chr1", 1, 0, 0), ("chr1", 2, 5, 5), (None, 1, 4, 4), ("chr2", None, 4, 4)]
    assert segments(spark, data) == [("chr1", 0, 2, 5, 5)]
    assert segments(spark, []) == []


def test_a_long_chromosome_is_spread(spark):
    bins = spark.range(200_000).select(F.lit("chr1").alias("chr"), F.col("id").alias("bin"), (20 + F.col("id") % 3).alias("normal"),
                                       F.when(F.col("id") < 120_000, 20).otherwise(60).cast("long").alias("tumor"))
    seg = bins.select("chr", F.col("bin").alias("first_bin"), F.col("bin").alias("last_bin"), "normal", "tumor")
    beside = B._beside(seg, 5_000)
    assert beside.where("_s.first_bin <> 0 and (_b1 is null or _b1.first_bin <> _s.first_bin - 1)").isEmpty()
    assert beside.where("_s.first_bin > 1 and (_b2 is null or _b2.first_bin <> _s.first_bin - 2)").isEmpty()
    assert beside.where("_s.first_bin < 199998 and (_a2 is null or _a2.first_bin <> _s.first_bin + 2)").isEmpty()
    plan = beside._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "FlatMapGroupsInPandas" not in plan
