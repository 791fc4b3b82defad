"""Token counts of documents in flat token files without an index.

A file is nothing but token ids of one width; every document ends with the
end-of-document id. Files are cut into blocks; each block is searched for the
end id with one vector comparison, and reports its end positions and its last
one. A prefix scan over the blocks of a file (number of ends before, last end
before) stitches documents that reach over blocks.

Defined results: a document of no tokens counts 0. Tokens behind the last end
id are a document that is marked as not ended. Empty files give no row. Texts
are NULL-safe: NULL is a document of no tokens. Repeated rows are documents of
their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..session import new_path
from .arrays import small_batches
from .rows import written
from .tokens import encoder, vocabulary_path

END_OF_TEXT = 49407  # <|endoftext|> of the default vocabulary; in texts its string is ordinary text
WIDTH = 2  # bytes of an id
BLOCK_BYTES = 1 << 20
# A file holds at most so many documents.
DOCS_PER_FILE = 2_000


def write_flat(docs: DataFrame, folder: str, path: str | None = None, end: int = END_OF_TEXT, width: int = WIDTH) -> None:
    """Token files of `docs`, one or more per partition, documents in the order of their partition.

    Spark's text writer puts raw bytes and a separator; the separator is the end id.
    """
    small_batches(docs.sparkSession)
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 50):
                ids = encoder(path, True).encode_all(batch.column("text").slice(lo, 50).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([np.frombuffer(b, "<u4").astype(f"<u{width}").tobytes() for b in ids], pa.binary())], names=["value"])

    tokens = docs.select("text").mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    tokens.write.option("encoding", "ISO-8859-1").option("lineSep", end.to_bytes(width, "little").decode("latin-1")).option(
        "maxRecordsPerFile", DOCS_PER_FILE).text(folder)


def _ends(end: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.flatnonzero(np.frombuffer(b.as_buffer(), f"<u{width}") == end) for b in batch.column("bytes")]
            offsets = np.cumsum([0] + [len(x) for x in found])
            base = batch.column("base").to_numpy()
            ends = np.concatenate([x + b for x, b in zip(found, base)]) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("base"), batch.column("tokens"),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ends, pa.int64()))], names=["file", "base", "tokens", "ends"])
    return run


def scan_flat(spark: SparkSession, folder: str, end: int = END_OF_TEXT, width: int = WIDTH, block: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: `file`, `ordinal` (in its file, from 0), `start` (tokens before), `n_tokens`, `ended`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where("length > 0")
    cut = files.select(F.col("path").alias("file"), "content", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / block))).alias("b"))
    blocks = cut.select("file", (F.col("b") * (block // width)).alias("base"),
                        F.expr(f"substring(content, cast(b * {block} + 1 as int), {block})").alias("bytes"))
    blocks = blocks.withColumn("tokens", F.floor(F.length("bytes") / width).cast("long"))
    ends = blocks.select("file", "base", "tokens", "bytes").mapInArrow(_ends(end, width), "file string, base long, tokens long, ends array<long>")
    before = W.partitionBy("file").orderBy("base").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("file")
    scanned = (ends.withColumn("docs_before", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)))
               .withColumn("end_before", F.coalesce(F.max(F.array_max("ends")).over(before), F.lit(-1).cast("long")))
               .withColumn("size", F.sum("tokens").over(whole)).withColumn("last", F.coalesce(F.max(F.array_max("ends")).over(whole), F.lit(-1).cast("long")))
               .withColumn("docs", F.sum(F.size("ends")).over(whole)))
    docs = (scanned.select("file", "docs_before", F.posexplode("ends").alias("i", "end"), F.col("end_before"), F.col("ends"))
            .withColumn("start", F.when(F.col("i") > 0, F.expr("ends[i - 1]")).otherwise(F.col("end_before")) + 1)
            .select("file", (F.col("docs_before") + F.col("i")).alias("ordinal"), "start", (F.col("end") - F.col("start")).alias("n_tokens"), F.lit(True).alias("ended")))
    open_end = (scanned.where((F.col("base") == 0) & (F.col("last") + 1 < F.col("size")))
                .select("file", F.col("docs").alias("ordinal"), (F.col("last") + 1).alias("start"), (F.col("size") - F.col("last") - 1).alias("n_tokens"), F.lit(False)))
    return docs.union(open_end)


def document_token_counts(docs: DataFrame, in_files: bool = False) -> DataFrame:
    """`doc_id`, `n_tokens`, `file_part`, `start` of every document, counted from flat files written of `docs`.

    The files know no ids: a document is found by its partition, which names
    the file, and its place in it, so ids and texts are read twice. Rows that
    come out of a shuffle may lie elsewhere the second time: `docs` is written
    to the shared folder first, unless `in_files` says that it is a plain scan of
    files, which gives the same partitions again. A document without a place in
    the files, or the reverse, is an error.
    """
    if not in_files:
        docs = written(docs.select("doc_id", "text"), "scan-documents")
    spark = docs.sparkSession
    folder = new_path(spark, "flat-tokens")
    write_flat(docs, folder)
    number = F.regexp_extract("file", r"part-(\d+)-[^/]*$", 1).cast("int")
    chunk = F.coalesce(F.nullif(F.regexp_extract("file", r"-c(\d+)\.txt$", 1), F.lit("")).cast("long"), F.lit(0).cast("long"))
    counted = scan_flat(spark, folder).select(number.alias("part"), (chunk * DOCS_PER_FILE + F.col("ordinal")).alias("place"), "n_tokens", "start")
    row = F.monotonically_increasing_id()
    ids = docs.select("doc_id").select("doc_id", F.shiftright(row, 33).cast("int").alias("part"), row.bitwiseAND(F.lit((1 << 33) - 1)).alias("place"),
                                       F.lit(True).alias("known"))
    joined = ids.join(counted, ["part", "place"], "full")
    missing = F.raise_error(F.lit("documents and token files don't match")).cast("long")
    return joined.select("doc_id", F.when(F.col("known") & F.col("n_tokens").isNotNull(), F.col("n_tokens")).otherwise(missing).alias("n_tokens"),
                         F.col("part").alias("file_part"), "start")
