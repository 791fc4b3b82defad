"""Reading and writing datasets of text files."""

from __future__ import annotations

import gzip
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import BooleanType, IntegralType

from ..scale import lookup


def read_files(spark: SparkSession, path: str, pattern: str | None = None, gunzip: bool = True) -> DataFrame:
    """(stream, file, line) of all text files under `path`; `.gz` is decompressed while reading.

    `pattern` selects file names (`*.fastq`); a stream is the folder below
    `path`. With `gunzip=False` the raw bytes come as (stream, file, content).
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    meta = F.col("_metadata.file_path")
    stream = F.regexp_extract(meta, "([^/]*)/[^/]*$", 1).alias("stream")
    name = F.regexp_extract(meta, "([^/]*)$", 1).alias("file")
    if not gunzip:
        return reader.format("binaryFile").load(path).select(stream, name, "content")
    return reader.text(path).select(stream, name, F.col("value").alias("line"))


def numbered_text(spark: SparkSession, path: str, pattern: str | None = None, separator: str | None = None) -> DataFrame:
    """(file, line_no, line): text with 1-based line numbers, without gathering a file in one task.

    With `separator` a line ends there and not at line ends. Inside a split lines are numbered as they are read; each split is then
    shifted by the lines of the earlier splits of its file (one row per split).
    """
    def scan():
        reader = spark.read.option("recursiveFileLookup", "true")
        if pattern:
            reader = reader.option("pathGlobFilter", pattern)
        return reader.text(path, lineSep=separator).select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))

    lines = scan()
    splits = lines.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    shift = splits.select("file", "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    # One row per split, counted, so that lines are not moved to meet them.
    shift, _ = lookup(shift, "splits")
    return lines.join(shift, ["file", "_block"]).select("file", (F.col("_id") + F.col("_shift")).alias("line_no"), "line")


def write_files(df: DataFrame, path: str, line: str = "line", codec: str | None = None, lines_per_file: int = 0, by: str | tuple[str, ...] = ()) -> None:
    """Text output in files of at most `lines_per_file` lines, compressed by any text codec of Spark, one folder per value of the `by` columns."""
    keys = [by] if isinstance(by, str) else list(by)
    writer = df.select(*keys, F.col(line)).write.option("maxRecordsPerFile", lines_per_file)
    if codec:
        writer = writer.option("compression", codec)
    if keys:
        writer = writer.partitionBy(*keys)
    writer.text(path)


def recompress(spark: SparkSession, source: str, target: str, codec: str | None = "gzip") -> None:
    """Rewrite a dataset with `codec` (None decompresses), one folder per input stream and file.

    Files that are in the wanted form already come along as they are.
    """
    write_files(read_files(spark, source), target, codec=codec, by=("stream", "file"))


def disk_files(spark: SparkSession, path: str, pattern: str | None = None, uncompress: bool = False) -> DataFrame:
    """(file, content, bytes) of each file as it lies on disk, or after gunzip (names ending in .gz)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    raw = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).select(F.col("path").alias("file"), "content")
    if not uncompress:
        return raw.withColumn("bytes", F.length("content"))

    def gunzip(batches):
        for batch in batches:
            names = batch.column("file").to_pylist()
            content = [gzip.decompress(c) if n.endswith(".gz") else c for n, c in zip(names, batch.column("content").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(content, pa.binary())], names=["file", "content"])

    return raw.mapInArrow(gunzip, "file string, content binary").withColumn("bytes", F.length("content"))


def disk_checksums(spark: SparkSession, path: str, algo: str = "md5", pattern: str | None = None, uncompress: bool = False) -> DataFrame:
    """(file, checksum, bytes) of the files of a folder, raw or after gunzip."""
    from ..operators.text import file_checksums
    return file_checksums(disk_files(spark, path, pattern, uncompress).withColumn("file", F.struct("file", "bytes")), algo).select("file.*", "checksum")


def copy_dataset(spark: SparkSession, source: str, target: str, fmt: str = "text") -> None:
    """The same data written elsewhere."""
    spark.read.format(fmt).load(source).write.format(fmt).save(target)


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(checksum, file) of a `md5  name` list."""
    form = r"^([0-9a-f]+)\s+(.*)$"
    return spark.read.text(path).where(F.col("value").rlike(form)).select(
        F.regexp_extract("value", form, 1).alias("checksum"), F.regexp_extract("value", form, 2).alias("file"))


def filter_files(df: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema) -> DataFrame:
    """Any line-wise function over Arrow batches of (file, line) rows."""
    return df.mapInPandas(fn, schema)


def per_file(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema, name: str = "%F", lines: int = 100_000) -> DataFrame:
    """A function over consecutive pieces of each file, at most `lines` rows at a time, in line order.

    `df` has file, line_no and the data. The result's file is `name` with %F
    replaced by the input name, %N by the piece number and %% by %.

    Pieces come to Python in batches of many and are cut apart there, because handing over each by itself takes longer than most functions.
    """
    pieces = df.withColumn("_piece", F.floor((F.col("line_no") - 1) / lines))
    columns = pieces.columns
    # Numbers and flags that may be NULL travel filled, with a mark: a NULL in one piece must not change the type of the others in its batch.
    fills = {f.name: 0 if isinstance(f.dataType, IntegralType) else False for f in pieces.schema if f.nullable and isinstance(f.dataType, (IntegralType, BooleanType))}
    marks = {n: f"_null{i}" for i, n in enumerate(fills)}

    def label(piece: pd.DataFrame) -> str:
        signs = {"%%": "%", "%F": str(piece["file"].iloc[0]), "%N": str(int(piece["_piece"].iloc[0]))}
        out, rest = "", name
        while rest:
            head = rest[:2]
            out, rest = (out + signs[head], rest[2:]) if head in signs else (out + rest[0], rest[1:])
        return out

    def results(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """The function's results over the whole pieces in `rows`, joined as long as their columns have the same types."""
        starts = [*np.flatnonzero(rows["_first"]), len(rows)]
        empty = {n: rows[m].to_numpy() for n, m in marks.items() if rows[m].any()}
        rows = rows[columns]
        alike, outs, names = None, [], []
        joined = lambda: pd.concat(outs, ignore_index=True).assign(file=np.repeat(np.array(names, object), [len(o) for o in outs]))
        for lo, hi in zip(starts, starts[1:]):
            piece = rows.iloc[lo:hi].set_axis(pd.RangeIndex(hi - lo))
            for n, at in empty.items():
                if at[lo:hi].any():
                    values = piece[n].to_numpy().astype(float if fills[n] is not False else object)
                    values[at[lo:hi]] = None
                    piece = piece.assign(**{n: values})
            out = fn(piece)
            kind = tuple(out.columns), tuple(out.dtypes)
            if outs and kind != alike:
                yield joined()
                outs, names = [], []
            alike = kind
            outs.append(out)
            names.append(label(piece))
        yield joined()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []  # the last piece, which the next batch may go on with
        for batch in batches:
            starts = np.flatnonzero(batch["_first"])
            if len(starts):
                whole = pd.concat([*held, batch.iloc[:starts[-1]]], ignore_index=True)
                held, batch = [], batch.iloc[starts[-1]:]
                if len(whole):
                    yield from results(whole)
            held.append(batch)
        if held:
            yield from results(pd.concat(held, ignore_index=True))

    first = F.row_number().over(W.partitionBy("file", "_piece").orderBy("line_no")) == 1
    rows = pieces.withColumn("_first", first).sortWithinPartitions("file", "_piece", "line_no")
    filled = {n: F.coalesce(F.col(f"`{n}`"), F.lit(v).cast(pieces.schema[n].dataType)) for n, v in fills.items()}
    return rows.withColumns({m: F.col(f"`{n}`").isNull() for n, m in marks.items()} | filled).mapInPandas(run, schema)


def pipe_lines(df: DataFrame, command: str, line: str = "line") -> DataFrame:
    """Lines through an executable, one process per partition."""
    spark = df.sparkSession
    piped = df.select(F.col(line).cast("string")).rdd.map(lambda r: r[0] or "").pipe(command, checkCode=True)
    return spark.createDataFrame(piped.map(lambda s: (s,)), "line string")
