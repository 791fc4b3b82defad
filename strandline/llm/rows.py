"""Row keys that survive repeated and NULL ids, and tables written to the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import new_path
from .arrays import small_batches

# Stands for a NULL doc_id: after every real id, so that it is never the origin of a copy.
NO_ID = (1 << 63) - 1
KEY = ["_doc", "_row"]


def keyed(docs: DataFrame) -> DataFrame:
    """`_doc` (doc_id, NULL as NO_ID), `_row` (hash of the text) and `text`; `_all` holds the row as it came.

    Rows that agree in both keys have the same text, so results joined back by
    the keys fit each of them. Further columns, whatever their names, are only in `_all`.
    """
    small_batches(docs.sparkSession)
    names = [f"`{c}`" for c in docs.columns]
    return docs.select(F.struct(*names).alias("_all"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_doc"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("_row"), "text")


def unpacked(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of `docs` out of `_all`, some of them changed."""
    return rows.select(*[changed.get(c, F.col("_all").getField(c)).alias(c) for c in docs.columns])


def doc_id() -> Column:
    return F.when(F.col("_doc") != NO_ID, F.col("_doc")).alias("doc_id")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and go on from the files: computed once, readable by every executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")
