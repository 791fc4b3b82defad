from pyspark.sql import functions as F

from strandline.operators import reads as R
from strandline.plans import registry
from strandline.plans.catalog import QUERIES, Tables

registry.load()


def test_packed_variants_are_those_of_the_rows(spark):
    mers = spark.createDataFrame([("acg",), ("TTt",), ("anc",), ("nna",), ("aNN",), ("gg-",), (None,)], "mer string")
    rows = R.substitute_variants(mers, 3).select("mer", "variant", "err")
    packed = R.substitute_variants(mers, 3, packed=True).select("mer", F.explode("variant").alias("variant"), "err")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, packed.collect()))


def test_variants_are_not_moved(spark):
    plan = QUERIES["substitute_variants"](Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Expand" not in plan
