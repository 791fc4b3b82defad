"""What is moved: rows, not pairs or variants of rows; results as by brute force."""

import random

from pyspark.sql import Window as W, functions as F

from strandline.operators import intervals as I, reads as R, variants as V
from strandline.scale import running_sums


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bins_fit_the_spans(spark):
    rnd = random.Random(3)
    make = lambda n, most: [("c", s := rnd.randint(0, 3000), s + rnd.randint(0, most), i) for i in range(n)]
    schema = "chr string, start_pos long, end_pos long, id long"
    a, b = make(60, 30) + [("c", 0, 2900, 60), ("c", 9, 8, 61)], make(60, 300)
    df = I.interval_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema))
    want = {(x[3], y[3]) for x in a for y in b if x[1] <= y[2] and y[1] <= x[2] and x[1] <= x[2]}
    got = [(r.id, r.id_r) for r in df.select("id", "id_r").collect()]
    assert set(got) == want and len(got) == len(want)
    assert "/ 1024.0" not in _plan(df)


def test_pairs_of_probes_are_neither_joined_again_nor_sorted(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(200):
        at = rnd.randint(1, 60) * 20
        up = rnd.random() < 0.5
        rows.append((f"p{i % 3}", rnd.choice("AB"), f"c{rnd.randint(0, 1)}", at if up else at + 24, at + 24 if up else at, i, rnd.choice([None, "c1"]), rnd.choice([None, at + 25]), None))
    hits = spark.createDataFrame(rows, "probe string, part string, chr string, pos0 long, pos1 long, ord long, refchr string, refpos0 long, refpos1 long")
    hits = hits.withColumns({"identity": F.lit(90), "length": F.lit(25), "mismatches": F.lit(0)})
    got = V.probe_pairs(hits, 300)
    found = []
    for a in rows:
        for b in rows:
            lo, hi = (min(b[3], b[4]), max(a[3], a[4]))
            if a[0] == b[0] and a[2] == b[2] and (a[3] < a[4]) == (b[3] < b[4]) and a[1] != b[1] and (b[3], b[5]) > (a[3], a[5]) and lo - hi <= 300:
                ok = (b[6] is None or b[6] == b[2]) and (b[7] is None or b[7] in (a[4] + 1, a[3] + 1))
                found.append((b[0], ok, (b[2], b[3], b[5], a[3], a[5])))
    first = {p: min(x[2] for x in found if x[0] == p and x[1]) for p in {x[0] for x in found if x[1]}}
    want = sorted((p, x[4], x[2], int(ok and first[p] == x)) for p, ok, x in found)
    assert sorted((r.probe, r.ord_a, r.ord_b, r.correct) for r in got.collect()) == want
    assert "min(struct" not in _plan(got)
