"""Line-oriented operators: grep, key=value totals, tags, splitting, sizes, checksums."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..scale import running_sum


def grep(df: DataFrame, pattern: str, invert: bool = False, line: str = "line", file: str | None = None) -> DataFrame:
    """Lines matching a regular expression; a `file` column loses its `.gz`."""
    hit = F.col(line).rlike(pattern)
    out = df.where(~hit if invert else hit)
    return out.withColumn(file, F.regexp_replace(file, r"\.gz$", "")) if file else out


def tag_counts(df: DataFrame, tag: str, text: str = "text", file: str = "file") -> DataFrame:
    """Per file and value: occurrences of `<tag>value</tag>` on one line."""
    pairs = F.regexp_extract_all(text, F.lit(r"<(?:%s)>([^<>\n]*)</(?:%s)>" % (tag, tag)), F.lit(1))
    return (df.select(file, F.explode(pairs).alias("value")).groupBy(file, "value")
            .agg(F.count(F.lit(1)).alias("n")))


def text_lengths(df: DataFrame, text: str = "text", file: str = "file") -> DataFrame:
    return df.groupBy(file).agg(F.sum(F.length(text)).alias("length"))


def _kv(line: Column):
    return (F.regexp_extract(line, r"^(?:(.*?)=)?([0-9]+)$", 1),
            F.regexp_extract(line, r"^(?:(.*?)=)?([0-9]+)$", 2))


def sum_kv(df: DataFrame, line: str = "line") -> DataFrame:
    """Totals by key of `key=N` (or bare `N`, key '') lines; `#` lines are skipped."""
    key, value = _kv(F.col(line))
    return (df.where(~F.col(line).startswith("#")).select(key.alias("key"), value.alias("v")).where("v <> ''")
            .groupBy("key").agg(F.sum(F.col("v").cast("long")).alias("total")))


def ignored_lines(df: DataFrame, line: str = "line") -> DataFrame:
    """How many lines `sum_kv` could not read."""
    return df.where(~F.col(line).startswith("#") & (_kv(F.col(line))[1] == "")).agg(
        F.count(F.lit(1)).alias("ignored"))


def pivot_stats(df: DataFrame, names: list[str], compat: bool = False, line: str = "line") -> DataFrame:
    """Table index x name from tab-separated `name_0012=5` items, missing cells 0.

    Every index up to the largest gets a row; `compat` leaves the last one out.
    """
    item = F.explode(F.split(line, "\t")).alias("item")
    form = r"^(.*?)_0*([0-9]+)=([0-9]+)"
    cells = (df.select(item).where(F.col("item").rlike(form))
             .select(F.regexp_extract("item", form, 1).alias("name"),
                     F.regexp_extract("item", form, 2).cast("long").alias("idx"),
                     F.regexp_extract("item", form, 3).cast("long").alias("v")))
    table = cells.groupBy("idx").pivot("name", names).agg(F.sum("v"))
    top = cells.agg(F.max("idx").alias("m"))
    dense = top.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - (1 if compat else 0))).alias("idx"))
    return dense.join(table, "idx", "left").select("idx", *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names])


def sum_counts(parts: DataFrame) -> DataFrame:
    """Totals per (kind, key) over counts files; header rows (key NULL) give each kind's grand total."""
    return parts.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def split_text(lines: DataFrame, n: int = 1000) -> DataFrame:
    """Cut files of numbered lines into pieces `first-last.txt` of `n` lines."""
    piece = F.floor((F.col("line_no") - 1) / n)
    return (lines.groupBy("file", piece.alias("piece"))
            .agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"),
                 F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))),
                                          lambda s: s["line"]), "\n").alias("text"))
            .select("file", F.concat("first", F.lit("-"), "last", F.lit(".txt")).alias("name"),
                    (F.col("last") - F.col("first") + 1).alias("n_lines"), "text"))


def numbered_lines(df: DataFrame, file: str, text: str) -> DataFrame:
    """(file, line_no, line) of whole texts."""
    return df.select(F.col(file).alias("file"), F.posexplode(F.split(text, "\n")).alias("p", "line")).select(
        "file", (F.col("p") + 1).alias("line_no"), "line")


def concat_streams(dfs: list[DataFrame], skip_headers: bool = False, line: str = "line") -> DataFrame:
    """All inputs one after the other; `part` keeps the order, headers `#…` may be dropped."""
    out = None
    for i, df in enumerate(dfs):
        part = df.withColumn("part", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out.where(~F.col(line).startswith("#")) if skip_headers else out


def expand_ranges(df: DataFrame, text: str = "text") -> DataFrame:
    """`name 7-10` to one row per frame (a single number is a range of one)."""
    a, b = F.regexp_extract(text, r"^(\S+)\s+([0-9]+)(?:-([0-9]+))?$", 2), F.regexp_extract(
        text, r"^(\S+)\s+([0-9]+)(?:-([0-9]+))?$", 3)
    lo = a.try_cast("long")
    hi = F.when(b == "", lo).otherwise(b.try_cast("long"))
    return df.where(a != "").select(
        F.regexp_extract(text, r"^(\S+)", 1).alias("dataset"), F.explode(F.sequence(lo, hi)).alias("frame"))


def count_nodes(col) -> Column:
    """Nodes named by `n[1-3,7],m` (7 is one, 1-3 three, m one); a bare number is itself."""
    c = F.col(col) if isinstance(col, str) else col
    inside = F.regexp_extract_all(c, F.lit(r"\[([-0-9,]+)\]"), F.lit(1))
    items = F.flatten(F.transform(inside, lambda s: F.split(s, ",")))
    width = F.transform(items, lambda s: F.when(
        s.contains("-"), F.split(s, "-")[1].cast("long") - F.split(s, "-")[0].cast("long") + 1).otherwise(1))
    plain = F.size(F.filter(F.split(F.regexp_replace(c, r"[^,\[]*\[[-0-9,]+\]", ""), ","), lambda s: s != ""))
    total = F.aggregate(width, F.lit(0).cast("long"), lambda a, x: a + x) + plain
    return F.when(c.rlike("^[0-9]+$"), c.try_cast("long")).otherwise(total)


def file_checksums(df: DataFrame, algo: str = "md5", content: str = "content", file: str = "file") -> DataFrame:
    """Checksum of each file's content (md5, sha1, sha224, sha256, sha384, sha512)."""
    c = F.col(content)
    value = {"md5": F.md5, "sha1": F.sha1}.get(algo) or (lambda x: F.sha2(x, int(algo[3:])))
    return df.select(file, value(c).alias("checksum"))


def checksum_of_checksums(df: DataFrame, group: str, order: str, checksum: str = "checksum") -> DataFrame:
    """md5 of the joined checksums of each group in order, and of all groups' (`group` NULL).

    A cell holds one checksum per file, not the files; `checksum_tree` is for lists too long for that. One task reads the
    groups' texts for the checksum of all; there they are bytes, half as long, where they are hex digits, and hashed in a stream.
    """
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, checksum))), lambda s: s[checksum]), "")
    texts = df.groupBy(group).agg(joined.alias("_text"))
    digits = F.col("_text").rlike("^([0-9a-f]{2})*+\\z")

    def digest(batches):
        done = hashlib.md5()
        for batch in batches:
            for packed, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                done.update(content.hex().encode() if packed else content)
        yield pa.RecordBatch.from_pydict({"checksum": [done.hexdigest()]})

    rows = texts.select(group, digits.alias("_packed"), F.when(digits, F.unhex("_text")).otherwise(F.encode("_text", "UTF-8")).alias("_content"))
    total = rows.repartition(1).sortWithinPartitions(group).select("_packed", "_content").mapInArrow(digest, "checksum string")
    # Without rows there may be no task: then it is the checksum of nothing.
    total = total.agg(F.coalesce(F.max("checksum"), F.md5(F.lit(""))).alias("checksum"))
    return texts.select(group, F.md5("_text").alias("checksum")).unionByName(total.select(F.lit(None).cast(df.schema[group].dataType).alias(group), "checksum"))


def checksum_tree(df: DataFrame, group: str, order: str, checksum: str = "checksum", slice_rows: int = 4096) -> DataFrame:
    """Like `checksum_of_checksums`, but a hash of hashes: each slice of the order column is hashed, then the slices of a group, then the groups.

    Another value than the flat one, for groups of any size.
    """
    def fold(d, by, key, value):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda s: s[value]), "")
        return d.groupBy(*by).agg(F.md5(joined).alias("h"))

    inner = fold(df.withColumn("_slice", F.floor(F.col(order) / slice_rows)), [group, "_slice"], order, checksum)
    per_group = fold(inner, [group], "_slice", "h").select(group, F.col("h").alias("checksum"))
    spread = per_group.withColumn("_bucket", F.substring(F.md5(F.col(group).cast("string")), 1, 3))
    total = fold(fold(spread, ["_bucket"], group, "checksum"), [], "_bucket", "h")
    return per_group.unionByName(total.select(F.lit(None).cast(df.schema[group].dataType).alias(group), F.col("h").alias("checksum")))


def compare_checksums(got: DataFrame, want: DataFrame) -> DataFrame:
    """missing / extra / changed files against a published list."""
    j = got.select("file", F.col("checksum").alias("got")).join(
        want.select("file", F.col("checksum").alias("want")), "file", "full")
    status = (F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "extra")
              .when(F.col("got") != F.col("want"), "changed"))
    return j.withColumn("status", status).where("status is not null")


def file_sizes(df: DataFrame, text: str = "text", file: str = "file") -> DataFrame:
    """Bytes and lines of each file's (decompressed) text."""
    return df.groupBy(file).agg(F.sum(F.octet_length(text)).alias("bytes"),
                                F.sum(F.size(F.split(text, "\n"))).alias("lines"))


def slice_bytes(df: DataFrame, start: int, end: int, content: str = "content") -> DataFrame:
    """Bytes start..end-1 (0-based) of each file."""
    return df.withColumn(content, F.substring(F.col(content), start + 1, end - start))


def restack(files: DataFrame) -> DataFrame:
    """Cycle-major image files to frame order: one row per (frame, cycle, file).

    Scan images (`SC`) of cycles without a number are four to a frame.
    """
    form = r"(?i)^(SC|WL)_([0-9]{4})\.(?:tif|raw)(?:\.g?z)?$"
    number = F.regexp_extract("filename", form, 2)
    good = files.where(number != "").withColumn("image", number.cast("int")).withColumn(
        "kind", F.upper(F.regexp_extract("filename", form, 1)))
    by_scan = (F.col("kind") == "SC") & ~F.col("cycle").rlike("^[0-9]+$")
    frame = F.when(by_scan, 1 + F.floor((F.col("image") - 1) / 4)).otherwise(F.col("image"))
    return good.select(frame.cast("long").alias("frame"), "cycle", F.concat("cycle", F.lit(","), "filename").alias("member"))


def batch(df: DataFrame, size: int, order: str = "ord", min_length: int | None = None,
          max_batches: int | None = None, length: str = "n_bases") -> DataFrame:
    """Consecutive batches of `size` reads, 1-based.

    With `min_length` only reads at least that long count, and short reads
    before the first long one are dropped.
    """
    counts = F.lit(1) if min_length is None else (F.col(length) >= min_length).cast("long")
    run = running_sum(df, order, counts, "_n")
    # A short read stays with the batch of the long read before it.
    out = run.where("_n > 0").withColumn("batch", F.floor((F.col("_n") - 1) / size) + 1).drop("_n")
    return out.where(F.col("batch") <= max_batches) if max_batches else out
