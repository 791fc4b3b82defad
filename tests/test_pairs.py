"""Pairs: each row is moved about once, in one join; results as by brute force."""

import random
from collections import Counter

from pyspark.sql import functions as F

from strandline.operators import intervals as I, variants as V


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_overlaps_come_from_one_join(spark):
    rnd = random.Random(11)
    schema = "chr string, start_pos long, end_pos long, id long"
    span = lambda most: (s := rnd.randint(-50, 4000), s + rnd.randint(-3, most))
    some = lambda n, most: [(rnd.choice(["c", "d", None]), *span(most), i) for i in range(n)]
    odd = [("c", None, 5, 900), ("c", 5, None, 901), ("c", 100, 99, 902), ("c", -40, 4000, 903), ("c", 0, 0, 904), ("c", 0, 0, 905)]
    # Short spans only; spans over many bins, gathered in nodes; every row of the second kind in one table.
    for a, b, size in ((some(80, 30), some(80, 200), 1024), (some(80, 30) + odd, some(80, 300) + odd, 4), (some(60, 3000) + odd, some(60, 2) + odd, 1), (some(60, 2) + odd, some(60, 3000) + odd, 1)):
        df = I.interval_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), bin_size=size).select("id", "id_r")
        want = Counter((x[3], y[3]) for x in a for y in b if None not in x and None not in y and x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2])
        assert Counter((r.id, r.id_r) for r in df.collect()) == want
        assert "Union" not in _plan(df)


def test_a_span_is_moved_about_once(spark):
    rows = spark.range(2000).select(F.lit("c").alias("chr"), (F.col("id") * 7).alias("start_pos"), (F.col("id") * 7 + 35).alias("end_pos"), "id")
    wide = rows.where("id % 10 = 0").withColumn("end_pos", F.col("start_pos") + 255)
    left = I._placed(rows, "start_pos", "end_pos", 256, None)
    assert left.where("_home").count() == 2000 and left.count() < 2400
    # What is at home on a higher level is only there for spans that reach it.
    assert I._placed(rows, "start_pos", "end_pos", 1, [0, 1]).where("_home").count() == 4000
    assert I.interval_join(rows, wide).count() == I.interval_join(rows, wide, bin_size=1).count()


def _pairs(rows, most, every):
    """(probe, ord_a, ord_b, correct) by brute force. Rows: probe, part, chr, pos0, pos1, ord, refchr, refpos0, refpos1."""
    found = []
    for a in rows:
        for b in rows:
            if None in (*a[:5], *b[:5]) or a[0] != b[0] or a[2] != b[2] or (a[3] < a[4]) != (b[3] < b[4]) or a[1] == b[1]:
                continue
            if (b[3], b[5]) > (a[3], a[5]) and min(b[3:5]) - max(a[3:5]) <= most:
                c, p, q = b[6:]
                if None not in (c, p, q):
                    ok = c == b[2] and ((p == a[4] and q == b[3] - 1) or (p == a[3] and q == b[4] - 1))
                else:
                    ok = c in (None, b[2]) and (p is None or p in (a[4] + 1, a[3] + 1))
                found.append((a[0], ok, (b[2], b[3], b[5], a[3], a[5])))
    first = {p: min(x for q, ok, x in found if q == p and ok) for p in {q for q, ok, _ in found if ok}}
    return sorted((p, x[4], x[2], int(ok and (every or first[p] == x))) for p, ok, x in found)


def test_probe_pairs_by_brute_force(spark):
    rnd = random.Random(17)
    schema = "probe string, part string, chr string, pos0 long, pos1 long, ord long, refchr string, refpos0 long, refpos1 long"
    for parts, most, n in (("AB", 300, 150), ("ABC", 40, 120), ("AB", 3000, 60), ("A", 300, 20)):
        rows = []
        for i in range(n):
            at, long = rnd.randint(1, 60) * 20, rnd.choice([24, 24, 5, 60])
            ends = (at, at + long) if rnd.random() < 0.5 else (at + long, at)
            probe = f"p{rnd.randint(0, 5)}"
            key = {"p0": (None, None, None), "p1": ("c1", None, None), "p2": (None, at - 40 + 25, None)}.get(probe, ("c1", rnd.randint(1, 60) * 20, rnd.choice([None, ends[0] - 1, ends[1] - 1])))
            rows.append((probe, rnd.choice(parts), f"c{rnd.randint(0, 1)}", *ends, i, *key))
        # What has no probe, part, chr or place pairs with nothing; names are compared one by one.
        rows += [(None, "A", "c1", 20, 44, 900, None, None, None), (None, "B", "c1", 40, 64, 901, None, None, None), ("p0", None, "c1", 40, 64, 902, None, None, None),
                 ("p0", "A", None, 40, 64, 903, None, None, None), ("p0", "B", None, 60, 84, 904, None, None, None), ("p0", "A", "c1", None, 64, 905, None, None, None),
                 ("p|c", "A", "d", 20, 44, 906, None, None, None), ("p", "B", "c|d", 40, 64, 907, None, None, None)]
        hits = spark.createDataFrame(rows, schema).withColumns({"identity": F.lit(90), "length": F.lit(25), "mismatches": F.lit(0)})
        for every in (False, True):
            got = V.probe_pairs(hits, most, all_correct=every)
            want = _pairs(rows, most, every)
            assert sorted((r.probe, r.ord_a, r.ord_b, r.correct) for r in got.collect()) == want
        counts = {r.probe: (r.hit_correct, r.hit_incorrect) for r in V.probe_pair_stats(hits, got).collect()}
        assert counts == {p: (sum(w[3] for w in want if w[0] == p), sum(1 - w[3] for w in want if w[0] == p)) for p in {r[0] for r in rows}}


def test_pairs_of_probes_are_made_once(spark):
    hits = spark.range(400).select(F.concat(F.lit("p"), F.col("id") % 3).alias("probe"), F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("part"), F.lit("c").alias("chr"),
                                   (F.col("id") * 5).alias("pos0"), (F.col("id") * 5 + 24).alias("pos1"), F.col("id").alias("ord"), F.lit(None).cast("string").alias("refchr"),
                                   F.lit(None).cast("long").alias("refpos0"), F.lit(None).cast("long").alias("refpos1"), F.lit(90).alias("identity"), F.lit(25).alias("length"), F.lit(0).alias("mismatches"))
    plan = _plan(V.probe_pairs(hits, 300))
    # One join makes the pairs; the answer key and the first pair come from small tables.
    assert "Union" not in plan and plan.count("Join Inner") + plan.count("Join LeftOuter") <= 3 and "refchr" not in plan.split("Join")[0]


def test_a_pair_is_counted_from_one_column(spark):
    rows = [("p", "AB"[i % 2], "c", i * 5, i * 5 + 24, i, None, None, None) for i in range(40)] + [("q", "A", "c", 5, 29, 99, None, None, None)]
    hits = spark.createDataFrame(rows, "probe string, part string, chr string, pos0 long, pos1 long, ord long, refchr string, refpos0 long, refpos1 long")
    hits = hits.withColumns({"identity": F.lit(90), "length": F.lit(25), "mismatches": F.lit(0)})
    stats = V.probe_pair_stats(hits, V.probe_pairs(hits, 60))
    n = len(_pairs(rows, 60, False))
    assert sorted(tuple(r) for r in stats.collect()) == [("p", 1, n - 1), ("q", 0, 0)]
    # Wrong pairs are the rest, and all that a pair's verdict needs is NULL but at one hit of a probe.
    assert "(1 - correct" not in _plan(stats) and "_asked" in _plan(stats)
