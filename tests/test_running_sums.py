import random

from pyspark.sql import Window as W, functions as F

from strandline.operators import jobs as J
from strandline.scale import running_sums


def test_sums_of_small_large_and_null_keys(spark):
    rnd = random.Random(1)
    orders = rnd.sample(range(1, 10_000_000), 600)
    rows = [(rnd.choice([1, 1, 1, 2, None]), o, rnd.randint(0, 5), rnd.randint(0, 9)) for o in orders]
    df = spark.createDataFrame(rows, "k int, o long, a int, b int")
    along = W.partitionBy("k").orderBy("o")
    want = df.withColumns({"x": F.sum("a").over(along), "y": F.sum("b").over(along)})
    for whole in (1 << 16, 100):
        got = running_sums(df, "o", {"x": F.col("a"), "y": F.col("b")}, ("k",), 1 << 12, whole)
        key = lambda r: (str(r[0]), *r[1:])
        assert sorted(map(tuple, got.select(want.columns).collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_log_rows_move_once(spark):
    log = spark.createDataFrame([(1, i, "2024-01-01_00:00:00 7 8  node n1 - 2 slots") for i in range(5)], "job long, line_no long, line string")
    plan = J.freeze_segments(log)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1
