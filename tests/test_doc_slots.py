"""Documents are numbered, and calls and regions laid on them, without a window or a loop over all documents."""

import os

import pytest
from pyspark.sql import functions as F

from strandline.plans import registry
from strandline.plans.catalog import Tables

registry.load()
FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("view", ["doc_calls", "doc_regions"])
def test_rows_are_laid_on_documents_by_an_equality_join(spark, view):
    df = getattr(Tables(spark, FOLDER), view)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Window" not in plan


def test_slots_follow_the_ids(spark):
    t = Tables(spark, FOLDER)
    t._seen["documents"] = spark.createDataFrame(
        [(7, "gat", "en", "s", 3), (None, "acgt", "en", "s", 4), (1 << 40, "ac", "en", "s", 2), (9, "..", "en", "s", 2), (-3, "a", "en", "s", 1)],
        "doc_id long, text string, lang string, source string, n_chars long")
    assert t.doc_slots.orderBy("slot").collect() == [(None, 4, 0), (-3, 1, 1), (7, 3, 2), (1 << 40, 2, 3)]


def test_no_documents_give_no_calls(spark):
    t = Tables(spark, FOLDER)
    t._seen["documents"] = t.documents.where(F.lit(False))
    assert t.doc_calls.isEmpty() and t.doc_regions.isEmpty()


def test_chunks_hold_the_whole_sequence(spark):
    t = Tables(spark, FOLDER)
    whole = t.ref_chunks.groupBy("chr").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "seq"))), lambda x: x["seq"]), "").alias("all"))
    assert whole.join(t.seqs, F.col("chr") == F.concat(F.lit("d"), "doc_id")).where("all <> seq").isEmpty()
    assert whole.count() == t.seqs.where("length(seq) > 0").count()
    assert t.ref_chunks.where("length(seq) > 1000").isEmpty()


def test_only_rows_of_the_lookup_that_are_asked_for_carry_letters(spark):
    from strandline.operators.reads import reference_translate
    lookup = spark.createDataFrame([("a", "c1", 10, "acn"), ("b", "c1", 20, "acgt"), ("x", "c1", 1, "a")], "name string, chr string, start_pos long, seq string")
    rows = spark.createDataFrame([("a", 0, 1), ("a", 2, 2), ("b", 3, 3), ("y", 0, 4), (None, 0, 5)], "ref string, pos long, ord int")
    out = reference_translate(rows, out_zero=0, lookup=lookup, mask=True)
    assert sorted(map(tuple, out.collect())) == [("c1", 8, 1), ("c1", 21, 3)]
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()
