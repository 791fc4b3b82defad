"""Placements that a count, a join or a sort reads twice are made once; reads without a hit go before they are widened."""

from pyspark.sql import functions as F

from strandline.operators import kmers as K, sorting as O
from strandline.plans import registry
from strandline.plans.catalog import QUERIES, Tables

registry.load()
FOLDER = "/root/testdata/sf0.001"


def test_reads_without_a_hit_are_not_widened(spark):
    ref = spark.createDataFrame([("r", 0, "acgtacgtacgt"), ("r", 1, "cgtacgtacgtt"), ("r", 2, "nnnnacgtacgt")], "chr string, pos long, kmer string")
    mers = {"ACGTacgtacgt": 0, "acgtacgtacga": 1, "cgtacttacgtt": 1, "acgtacgtncgt": 1, "ggggggggcccc": 2, "acgtaaaaacgt": 2, "acgtacgt": None, None: None}
    reads = spark.createDataFrame(list(enumerate(mers)), "id long, mer string")
    index = K.KmerIndex(ref, 12)
    for most in (0, 1):
        kept = {r.mer for r in index.near(reads, most, "mer").collect()}
        far = {m for m, n in mers.items() if n is not None and n > most and "n" not in m}
        assert not kept & far and kept >= {m for m in mers if m and m not in far}
        want = K.widened(reads, 12, most).join(index.rows, "_key").select("id", "pos", "err")
        assert sorted(map(tuple, index.hits(reads, most).select("id", "pos", "err").collect())) == sorted(map(tuple, want.collect()))


def test_placements_are_counted_and_joined_from_one_run(spark):
    runs = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def made(x):
        runs.add(1)
        return x
    placements = spark.range(40).select("id", made(F.col("id") % 13).alias("sample"))
    got = O.max_placements(placements, 3).collect()
    assert {r["sample"] for r in got} == set(range(1, 13)) and all(r.places == 3 for r in got)
    assert runs.value == 40


def _plan(spark, name):
    return QUERIES[name](Tables(spark, FOLDER))._jdf.queryExecution().optimizedPlan().toString()


def test_sorted_rows_are_made_once(spark):
    for name in ("two_letter_placement", "exon_placement_report"):
        plan = _plan(spark, name)
        assert ("Sort" in plan or "Repartition" in plan) and "Join" not in plan, name
