"""Streaming forms of the two operators whose input is a log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.text import sum_kv

HOUR = 3600


def running_totals(lines: DataFrame, line: str = "line") -> DataFrame:
    """Running totals by key of a stream of `key=N` lines (state: one row per key)."""
    return sum_kv(lines, line)


def hourly_usage(jobs: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Node-seconds per clock hour of a stream of finished jobs.

    Hours older than the watermark (`lateness` behind the newest hour seen) are
    final and leave the state; jobs reaching further back lose those hours. In
    `update` mode every hour is written, the newest with what is known so far;
    `append` mode writes final hours only.
    """
    s = F.unix_timestamp("starttime")
    j = jobs.where("elapsed_s > 0 and nodes > 0").select(s.alias("_s"), (s + F.col("elapsed_s")).alias("_e"), "nodes")
    h = j.withColumn("_h", F.explode(F.sequence(F.floor(F.col("_s") / HOUR), F.floor((F.col("_e") - 1) / HOUR))))
    used = (F.least("_e", (F.col("_h") + 1) * HOUR) - F.greatest("_s", F.col("_h") * HOUR)) * F.col("nodes")
    rows = h.select(F.timestamp_seconds(F.col("_h") * HOUR).alias("at"), used.alias("_u")).withWatermark("at", lateness)
    return rows.groupBy(F.window("at", "1 hour").alias("w")).agg(F.sum("_u").alias("node_seconds")).select(F.col("w.start").alias("hour"), "node_seconds")


def run_available(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there and stop. `append` writes parquet; `update` rewrites each batch's rows under `batch=N`."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", target).start()
    else:
        query = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{target}/batch={n}")).start()
    query.awaitTermination()
    return query


def latest_totals(df: DataFrame, key: str = "key") -> DataFrame:
    """Newest value per key of the batches written in `update` mode."""
    return df.groupBy(key).agg(F.max_by("total", "batch").alias("total"))
