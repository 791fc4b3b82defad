"""Sorts, merges and routing. Every total order is a range-partitioned sort that
spills; order keys end in a unique column so that a repeated key still spreads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.seq import revcomp
from ..session import stored


def sort_by_position(df: DataFrame, bucket: int = 1_000_000, chr: str = "chr", pos: str = "start_pos",
                     then: tuple[str, ...] = ()) -> DataFrame:
    """Rows with their tile (`pos div bucket`), globally sorted by chr, pos and `then`.

    Write with `partitionBy(chr, bucket)` for one folder per tile.
    """
    return df.withColumn("bucket", F.floor(F.col(pos) / bucket)).orderBy(chr, pos, *then)


def merge_sorted(*slices: DataFrame, order: tuple[str, ...] = ("chr", "start_pos", "read_id")) -> DataFrame:
    """One sorted table out of several."""
    out = slices[0]
    for s in slices[1:]:
        out = out.unionByName(s)
    return out.orderBy(*order)


def sort_by_id_then_pos(df: DataFrame, id: str, pos: str, then: tuple[str, ...] = (), buckets: int | None = None) -> DataFrame:
    """Range-partitioned by id and position, sorted inside partitions (a total order over all)."""
    keys = [id, pos, *then]
    ranged = df.repartitionByRange(buckets, *keys) if buckets else df.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)


def merge_streams(dfs: list[DataFrame], number: str, then: tuple[str, ...] = ()) -> DataFrame:
    """k-way merge on the leading number."""
    return merge_sorted(*dfs, order=(number, *then))


def numbered(ordered: DataFrame, out: str) -> DataFrame:
    """1-based place of each row of a sorted table: a count of its own partition's rows, after those of the partitions before."""
    rows = ordered.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_part")) - F.col("_n")).alias("_before"))
    return (rows.join(before, "_part").withColumn(out, F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + 1)
            .drop("_id", "_part", "_before"))


def sort_keep_header(lines: DataFrame, line: str = "line", number: str = "line_no") -> DataFrame:
    """The leading `#` lines in their own order (by `number`), then all other lines sorted."""
    body = lines.where(~F.col(line).startswith("#")).agg(F.min(number)).scalar()
    head = F.coalesce(F.col(number) < body, F.lit(True))
    return (lines.withColumn("_head", F.when(head, F.col(number)))
            .orderBy(F.col("_head").asc_nulls_last(), line).drop("_head"))


def printable_lines(df: DataFrame, text: str = "text", width: int = 100) -> DataFrame:
    """Text with non-printing letters replaced by `~`, cut into lines of at most `width` - 1 letters."""
    clean = F.regexp_replace(text, r"[^ -~]", "~")
    pieces = F.filter(F.regexp_extract_all(clean, F.lit("(.{1,%d})" % (width - 1)), F.lit(1)), lambda s: s != "")
    return df.select(F.explode(pieces).alias("line"))


def sort_bench(df: DataFrame, text: str = "text", width: int = 100) -> DataFrame:
    """Globally sorted printable lines, one row per distinct line and its copies.

    Equal lines are counted before the sort's shuffle, so copies of one line
    never crowd a range.
    """
    return (printable_lines(df, text, width).groupBy("line").agg(F.count(F.lit(1)).alias("copies")).orderBy("line"))


def partition_by_prefix(reads: DataFrame, mer: str = "mer", letters: int = 4, id: str = "read_id") -> DataFrame:
    """Both strands of each mer with the bin (prefix) they are routed to.

    Bins are uneven by nature, so rows are spread by (bin, id) and each bin may
    take several partitions; a written table is partitioned by `bin`.
    """
    both = reads.select(id, F.posexplode(F.array(F.col(mer), revcomp(mer))).alias("strand", mer))
    return both.withColumn("bin", F.substring(mer, 1, letters))


def split_by_key(df: DataFrame, path: str, key: str, fmt: str = "parquet", rows_per_file: int = 5_000_000) -> None:
    """One output folder per key value, each in files of bounded size."""
    df.write.partitionBy(key).option("maxRecordsPerFile", rows_per_file).format(fmt).mode("errorifexists").save(path)


def skip_oversized(df: DataFrame, query: str = "query", max_rows: int = 10_000) -> DataFrame:
    """All rows of the queries with at most `max_rows` rows.

    The oversized queries are few by construction (rows / max_rows), so they
    are the anti-join side.
    """
    big = df.groupBy(query).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_rows).select(query)
    return df.join(big, query, "left_anti")


def max_placements(df: DataFrame, limit: int, read: str = "sample") -> DataFrame:
    """Placements of reads that have at most `limit`, with their count in front. Placements are written once: they are counted and joined."""
    df = stored(df, "placements")
    counts = df.groupBy(read).agg(F.count(F.lit(1)).alias("places"))
    return df.join(counts.where(F.col("places") <= limit), read).select("places", *df.columns)


def renumber(dfs: list[DataFrame], id: str = "sample") -> DataFrame:
    """Union of batches whose read ids start at 0 each, shifted to stay unique."""
    out, shift = None, None
    for df in dfs:
        part = df if shift is None else df.withColumn(id, F.col(id) + shift)
        size = df.agg(F.coalesce(F.max(id) + 1, F.lit(0)).alias("m")).scalar()
        shift = size if shift is None else shift + size
        out = part if out is None else out.unionByName(part)
    return out


def first_n_per_query(df: DataFrame, n: int, query: str = "query", order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """At most `n` rows per query; Spark keeps the first n per task before shuffling."""
    rank = F.row_number().over(W.partitionBy(query).orderBy(*order))
    return df.withColumn("_rn", rank).where(F.col("_rn") <= n).drop("_rn")


def progress_by_group(df: DataFrame, expected: int = 23, chr: str = "chr", order: str = "ord") -> DataFrame:
    """Percent done when each chromosome first appears, in order of appearance."""
    first = df.groupBy(chr).agg(F.min(order).alias("_first"))
    rank = F.row_number().over(W.orderBy("_first", chr))
    return first.select(chr, F.floor(100 * (rank - 1) / expected).alias("percent"))


def range_filter(df: DataFrame, key: str, lo: str, hi: str) -> DataFrame:
    """Keys between two bounds in string order, both included."""
    return df.where(F.col(key).cast("string").between(lo, hi))


def window_filter(df: DataFrame, bucket: int, size: int = 1_000_000, compat: bool = False, pos: str = "pos") -> DataFrame:
    """Rows of one tile [bucket*size, (bucket+1)*size); `compat` leaves exact multiples out."""
    lo, hi = bucket * size, (bucket + 1) * size
    p = F.col(pos)
    return df.where(((p > lo) if compat else (p >= lo)) & (p < hi))
