"""Manifests, block replicas and storage audits as tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, LongType

from ..functions.seq import let
from ..scale import carry_last, running_sums
from ..session import stored
from ..sources.files import numbered_text

BLOCK = 1 << 26
# Fixed value: checksum of empty content.
EMPTY = "d41d8cd98f00b204e9800998ecf8427e"
_BLOCK = r"^[0-9a-f]{32}([-+].*)?$"
_FILE = r"^([0-9]+):([0-9]+):(.*)$"


def manifest_tokens(lines: DataFrame) -> DataFrame:
    """(manifest, stream, i, token) of manifest lines `./stream block… pos:size:file…`."""
    parts = F.split("line", " ")
    return lines.select("manifest", F.get(parts, F.lit(0)).alias("stream"), F.posexplode(F.slice(parts, 2, F.size(parts))).alias("i", "token"))


def read_manifest_tokens(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(manifest, stream, i, token) of the manifest files under `path`, as `manifest_tokens` gives them; `manifest` is the file.

    Files are read token by token, cut at blanks, so a stream of any number of blocks never is one row: a line end inside
    a token marks that the next stream begins, and the mark is carried forward in slices.
    """
    parts = F.split("line", "\n")
    # The first token of a file names a stream; else what stands before a line end belongs to the stream before.
    starts = (F.col("line_no") == 1) | (F.size(parts) > 1)
    t = numbered_text(spark, path, pattern, separator=" ").select(
        "file", "line_no", F.get(parts, F.lit(0)).alias("token"),
        F.when(starts, F.struct(F.col("line_no").alias("at"), F.element_at(parts, -1).alias("stream"))).alias("_mark"))
    return (carry_last(t, ["file"], "line_no", "_mark", "_of").where("_of is not null")
            .select(F.col("file").alias("manifest"), F.col("_of.stream").alias("stream"), (F.col("line_no") - F.col("_of.at") - 1).alias("i"), "token"))


def locator_size(token) -> Column:
    """Bytes named by a block locator: `+n`, or `-n` short of a full block; NULL when unknown."""
    plus = F.regexp_extract(token, r"^[0-9a-f]{32}[^+]*\+([0-9]+)", 1).try_cast("long")
    minus = F.regexp_extract(token, r"^[0-9a-f]{32}-([0-9]+)", 1).try_cast("long")
    return F.coalesce(plus, BLOCK - minus)


@F.arrow_udf(ArrayType(LongType()))
def _before_each(sizes: pa.Array) -> pa.Array:
    """The sum of the numbers before each one of its array."""
    at = sizes.offsets.to_numpy().astype("int64") - sizes.offsets[0].as_py()
    total = np.concatenate([[0], np.cumsum(sizes.flatten().to_numpy(zero_copy_only=False))]).astype("int64")
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(total[:-1] - np.repeat(total[at[:-1]], np.diff(at))))


def _hints(token) -> Column:
    return F.regexp_replace(token, r"^[0-9a-f]{32}([-+][0-9]+)?", "").alias("hints")


def parse_manifests(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, blocks) of manifest lines, see `parse_manifest_tokens`. A line has all blocks of its stream, so no block is moved."""
    parts = F.split("line", " ")
    tokens = F.coalesce(F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"))
    found = F.filter(F.transform(tokens, lambda x, i: F.struct(i.alias("i"), x.alias("token"))), lambda z: z["token"].rlike(_BLOCK))
    sized = F.transform(found, lambda z: F.struct(z["i"].alias("i"), z["token"].alias("token"), locator_size(z["token"]).alias("size")))
    rows = lines.select("manifest", F.get(parts, F.lit(0)).alias("stream"), sized.alias("_b"))
    rows = rows.withColumn("_first", _before_each(F.transform("_b", lambda z: F.coalesce(z["size"], F.lit(0).cast("long")))))
    each = rows.select("manifest", "stream", F.inline(F.arrays_zip("_b", "_first")))
    blocks = each.select("manifest", "stream", "_b.i", F.left("_b.token", F.lit(32)).alias("md5"), "_b.size", _hints(F.col("_b.token")), F.col("_first").alias("first"))
    return parse_manifest_tokens(manifest_tokens(lines), blocks)


def parse_manifest_tokens(t: DataFrame, blocks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, blocks) of manifests by token.

    files: manifest, stream, file, pos, size. blocks: manifest, stream, i, md5,
    size, hints, first (offset in the stream). Offsets are running sums in
    slices, so a stream of any length spreads.
    """
    files = t.where(F.col("token").rlike(_FILE)).select(
        "manifest", "stream", F.regexp_extract("token", _FILE, 3).alias("file"), F.regexp_extract("token", _FILE, 1).cast("long").alias("pos"),
        F.regexp_extract("token", _FILE, 2).cast("long").alias("size"))
    if blocks is not None:
        return files, blocks
    # Tokens that were cut from files are moved to get here, so blocks are written once; only streams of more than 65,536 tokens are cut into slices.
    b = stored(t.where(F.col("token").rlike(_BLOCK)).select(
        "manifest", "stream", "i", F.left("token", F.lit(32)).alias("md5"), locator_size(F.col("token")).alias("size"), _hints(F.col("token"))), "manifest-blocks")
    run = running_sums(b, "i", {"_end": F.coalesce("size", F.lit(0))}, ("manifest", "stream"), 1 << 16, counted=True)
    return files, run.withColumn("first", F.col("_end") - F.coalesce("size", F.lit(0))).drop("_end")


def file_block_ranges(files: DataFrame, blocks: DataFrame, bin_size: int = BLOCK) -> DataFrame:
    """Blocks behind each file and the byte range used of each.

    Files and blocks meet once, in bins of a few blocks, and a pair counts in the bin it begins in. A file is in at most 2^16 bins.
    """
    f = files.where("size > 0").select(*[F.col(c).alias(f"_{c}") for c in ("manifest", "stream")], "file", "pos", F.col("size").alias("_size"))
    b = blocks.where("size > 0").select("manifest", "stream", "i", "md5", "first", "size")
    longest, mean = f.agg(F.max("_size")).first()[0], b.agg(F.avg("size")).first()[0]
    width = max(min(bin_size, 4 << max(int(mean or 1), 1).bit_length() - 1), (longest or 0) >> 16)
    bins = lambda first, size: F.explode(F.sequence(F.floor(F.col(first) / width), F.floor((F.col(first) + F.col(size) - 1) / width)))
    f, b = f.withColumn("_f", bins("pos", "_size")), b.withColumn("_b", bins("first", "size"))
    lo, hi = F.greatest("pos", "first"), F.least(F.col("pos") + F.col("_size"), F.col("first") + F.col("size"))
    met = f.join(b, F.col("_manifest").eqNullSafe(F.col("manifest")) & F.col("_stream").eqNullSafe(F.col("stream"))
                 & (F.col("_f") == F.col("_b")) & (lo < hi) & (F.floor(lo / width) == F.col("_b")))
    return met.select("manifest", "stream", "file", "i", "md5", (lo - F.col("first")).alias("offset"), (hi - lo).alias("length"))


def list_files(files: DataFrame, sizes: bool = False) -> DataFrame:
    """Paths, with sizes in KiB rounded up."""
    path = F.concat("stream", F.lit("/"), "file").alias("path")
    return files.select("manifest", path, *([F.ceil(F.col("size") / 1024).alias("kib")] if sizes else []))


def expected_copies(locator) -> Column:
    """Copies a locator's `+K` hint asks for: two hex digits are a bit mask, one digit a number, bare 2, none 1."""
    two = F.regexp_extract(locator, r"\+K([0-9a-f]{2})", 1)
    one = F.regexp_extract(locator, r"\+K([0-9a-f])", 1)
    n = (F.when(two != "", F.bit_count(F.conv(two, 16, 10).cast("long"))).when(one != "", F.coalesce(one.try_cast("int"), F.lit(0)))
         .when(F.col(locator).contains("+K") if isinstance(locator, str) else locator.contains("+K"), 2).otherwise(0))
    return F.when(n == 0, 1).otherwise(n)


def replication_audit(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Per block: copies wanted (the largest mention) and found, status, wasted bytes, size mismatch.

    `expected` has locator rows, `found` (block, node, size). Both sides are
    reduced to one row per block before they meet.
    """
    want = expected.select(F.regexp_extract("locator", "^([0-9a-f]{32})", 1).alias("block"), expected_copies("locator").alias("w")).groupBy("block").agg(F.max("w").alias("want"))
    got = found.select("block", "node", "size").groupBy("block", "node").agg(F.max("size").alias("size"), F.min("size").alias("_lo")).groupBy("block").agg(
        F.count(F.lit(1)).alias("got"), F.max("size").alias("size"), (F.max("size") != F.min("_lo")).cast("int").alias("size_mismatch"))
    j = want.join(got, "block", "full").where(F.col("block") != EMPTY)
    w, g = F.col("want"), F.coalesce("got", F.lit(0))
    status = (F.when(w.isNull(), "garbage").when(g == 0, "missing").when(g > w, "too_many").when(g < w, "too_few").otherwise("ok"))
    wasted = F.when(w.isNull(), g * F.col("size")).when(g > w, (g - w) * F.col("size")).otherwise(0)
    return j.select("block", F.coalesce("want", F.lit(0)).alias("want"), g.alias("got"), status.alias("status"), wasted.alias("wasted_bytes"),
                    F.coalesce("size_mismatch", F.lit(0)).alias("size_mismatch"))


def placement_order(hash_col, nodes: list[str], down: tuple[str, ...] = ()) -> Column:
    """Array of nodes in the order they are tried for a block.

    Pick i takes the 8-hex-digit slice i of the hash (slices 4-7 straddle the
    first four) modulo the nodes left. Down nodes drop out afterwards.
    """
    h = F.col(hash_col) if isinstance(hash_col, str) else hash_col
    cut8 = [F.substring(h, 1 + 8 * i, 8) for i in range(4)]
    cut8 += [F.concat(F.substring(h, 1 + (8 * i - 4) % 32, 4), F.substring(h, 1 + (8 * i) % 32, 4)) for i in range(4, 8)]
    numbers = F.array(*[F.conv(s, 16, 10).cast("long") for s in cut8])
    names = F.array(*[F.lit(n) for n in nodes])
    empty = F.array().cast("array<string>")

    def pick(acc, i):
        at = (F.get(acc["bits"], i % 8) % F.size(acc["left"])).cast("int")
        return let(F.struct(acc.alias("a"), at.alias("p")), lambda s: F.struct(
            s["a"]["bits"].alias("bits"),
            F.concat(F.slice(s["a"]["left"], F.lit(1), s["p"]), F.slice(s["a"]["left"], s["p"] + 2, F.lit(len(nodes)))).alias("left"),
            F.concat(s["a"]["out"], F.array(F.get(s["a"]["left"], s["p"]))).alias("out")))

    order = F.aggregate(F.sequence(F.lit(0), F.lit(len(nodes) - 1)),
                        F.struct(numbers.alias("bits"), names.alias("left"), empty.alias("out")), pick, lambda acc: acc["out"])
    return F.array_except(order, F.array(*[F.lit(d) for d in down])) if down else order


def rebalance_plan(replicas: DataFrame, nodes: list[str], n: int = 2, beyond: int | None = None) -> DataFrame:
    """keep / copy / delete per (block, node) in probe order.

    The first `n` copies met stay, later ones are deleted, and gaps before the
    n-th copy are filled. With `beyond` only blocks with a copy past that probe
    position are touched. A block's copies reduce to a set of node names first.
    """
    held = replicas.groupBy("block").agg(F.collect_set("node").alias("_held"))
    rows = held.withColumn("_order", placement_order("block", nodes))
    if beyond is not None:
        rows = rows.where(F.exists(F.slice("_order", beyond + 1, len(nodes)), lambda x: F.array_contains("_held", x)))

    def step(acc, x):
        here = F.array_contains(F.col("_held"), x)
        would = ~here & (acc["found"] + acc["copy"] < n)
        found = acc["found"] + here.cast("int")
        action = F.when(here & (found > n), "delete").when(here, "keep").when(would, "copy")
        return F.struct(found.alias("found"), (acc["copy"] + would.cast("int")).alias("copy"), F.concat(acc["out"], F.array(
            F.struct(x.alias("node"), (F.size(acc["out"]) + 1).alias("probe"), action.alias("action")))).alias("out"))

    start = F.struct(F.lit(0).alias("found"), F.lit(0).alias("copy"), F.array().cast("array<struct<node:string,probe:int,action:string>>").alias("out"))
    return rows.select("block", F.explode(F.aggregate("_order", start, step, lambda acc: acc["out"])).alias("r")).select("block", "r.*").where("action is not null")


def manifest_stats(lines: DataFrame) -> DataFrame:
    """Distinct blocks and bytes, those in long-term store (`+K`), average size, unknown sizes, manifests and their bytes."""
    t = manifest_tokens(lines).where(F.col("token").rlike(_BLOCK))
    # Copies of a block's locator reduce before the shuffle.
    per = t.groupBy(F.left("token", F.lit(32)).alias("md5")).agg(
        F.max(locator_size(F.col("token"))).alias("size"), F.max(F.col("token").contains("+K").cast("int")).alias("kept"))
    b = per.agg(F.count(F.lit(1)).alias("blocks"), F.sum("size").alias("bytes"), F.sum("kept").alias("kept_blocks"),
                F.sum(F.when(F.col("kept") == 1, F.col("size"))).alias("kept_bytes"), F.count_if(F.col("size").isNull()).alias("unknown_sizes"))
    m = lines.groupBy("manifest").agg(F.sum(F.octet_length("line") + 1).alias("n"))
    return b.select("*", F.floor(F.col("bytes") / F.col("blocks")).alias("average"),
                    m.agg(F.count(F.lit(1)).alias("c")).scalar().alias("manifests"), m.agg(F.sum("n").alias("s")).scalar().alias("manifest_bytes"))


def classify_blocks(blocks: DataFrame, prefix: str = "") -> DataFrame:
    """Blocks (md5, content) as M (manifest), U (other content), ? (unreadable), and D for each block a manifest names.

    Only rows whose checksum starts with `prefix` are returned; D rows are distinct.
    """
    text = F.col("content")
    manifest = text.rlike(r"^\.(/\S*)? [0-9a-f]{32}")
    kind = F.when(text.isNull(), "?").when(manifest, "M").otherwise("U")
    own = blocks.select("md5", kind.alias("kind"))
    named = blocks.where(manifest).select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r" ([0-9a-f]{32})"), F.lit(1)))).alias("md5"), F.lit("D").alias("kind")).distinct()
    return own.unionByName(named).where(F.col("md5").startswith(prefix))


def verify_blocks(wanted: DataFrame, inventory: DataFrame) -> DataFrame:
    """Wanted blocks that are absent or whose content has another checksum."""
    have = inventory.select("md5", (F.md5("content") == F.col("md5")).cast("int").alias("good")).groupBy("md5").agg(F.max("good").alias("good"))
    j = wanted.select("md5").distinct().join(have, "md5", "left")
    return j.withColumn("status", F.when(F.col("good").isNull(), "absent").when(F.col("good") == 0, "damaged")).where("status is not null").select("md5", "status")


def disk_usage(df: DataFrame) -> DataFrame:
    """Used, available and lost bytes and percent per node and for the cluster (`node` NULL)."""
    g = df.rollup("node").agg(*[F.sum(c).alias(c) for c in ("used", "avail", "lost")])
    return g.withColumn("percent", F.round(100 * F.col("used") / (F.col("used") + F.col("avail") + F.col("lost")), 2))


def dataset_usage(files: DataFrame) -> DataFrame:
    """Files and bytes per dataset and sub-directory, with subtotals and a grand total."""
    return files.rollup("dataset", "subdir").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def _fastq(lines, records: int):
    """Whether the first `records` groups of four lines are reads: name, letters, separator, qualities."""
    def role(i):
        line = F.get(lines, i)
        solid = (F.length(line) > 1) & ~line.rlike("\\s")
        letters = (F.length(line) > 0) & (F.translate(F.lower(line), "abcdefghijklmnopqrstuvwxyz", "") == "")
        return (F.when(i % 4 == 0, solid & line.startswith("@")).when(i % 4 == 1, letters)
                .when(i % 4 == 2, line.startswith("+")).otherwise((F.length(line) > 0) & ~line.rlike("\\s")))
    return (F.size(lines) > 4 * records) & F.forall(F.sequence(F.lit(0), F.lit(4 * records - 1)), role)


def _low_qualities(lines, records: int):
    """Whether no quality of the first `records` reads, or of all whole ones, is above `I`."""
    whole = F.least(F.lit(records), F.floor((F.size(lines) - 1) / 4).cast("int"))
    top = lambda i: F.array_max(F.transform(F.split(F.get(lines, 4 * i + 3), ""), F.ascii))
    return (whole > 0) & F.forall(F.sequence(F.lit(0), F.greatest(whole - 1, F.lit(0))), lambda i: F.coalesce(top(i), F.lit(0)) <= 73)


def _snp_line(line):
    """`chr start end`, with or without a name, a number and a strand."""
    f = F.split(F.trim(line), "\\s")
    at = lambda i: F.get(f, F.lit(i))
    number = lambda i: at(i).try_cast("long").isNotNull()
    place = at(0).startswith("chr") & number(1) & number(2)
    return place & ((F.size(f) == 3) | ((F.size(f) == 6) & at(3).startswith("rs") & number(4) & at(5).isin("+", "-")))


def detect_format(files: DataFrame, content: str = "content") -> DataFrame:
    """Format of each file by the lines of its first 20 KiB, with the scan or map id found in it."""
    head = files.withColumn("_h", F.left(content, F.lit(20480))).withColumn("_l", F.split("_h", "\n"))
    h, lines = F.col("_h"), F.col("_l")
    words = F.split(F.get(lines, F.lit(0)), " ")
    first = [F.get(words, F.lit(i)) for i in range(3)]
    manifest = (((first[0] == ".") | first[0].startswith("./")) & (F.translate(F.left(first[1], F.lit(32)), "0123456789abcdef", "") == "")
                & (F.length(first[1]) >= 32) & F.left(first[2], F.lit(1)).isin(list("0123456789abcdef")))
    up_to = lambda n, test: (F.size(lines) > n) & F.forall(F.slice(lines, 1, n), test)
    genome = up_to(4, lambda x: (x.startswith(">") & (F.length(x) > 1)) | (
        (F.length(x) > 0) & (F.translate(F.lower(x), "abcdefghijklmnopqrstuvwxyz-*", "") == "")))
    # Header texts of the vendors' files.
    scan = r"(?s)^Mapping Analysis\r?\n\tSNP ID\tTSC ID\tdbSNP RS ID\tChromosome\tChromosomal Location\t.*\t[0-9]+[SN]_(\S+).*\r?\n[0-9]+\tSNP"
    chip = r"(?s)^#CHP File=[^\n]*\\([^\n]+)\.chp\r?\n.*\nAFFX-"
    table = "#%netaffx-annotation-tabular-format-version=1.0"
    info = lambda k: F.substring_index(F.trim(F.get(F.filter("_l", lambda x: x.startswith(f"#%{k}=")), F.lit(0))), "=", -1)
    name = (F.when(manifest, "manifest").when(_fastq(lines, 4), F.when(_low_qualities(lines, 40), "sanger fastq").otherwise("solexa fastq"))
            .when(genome, "fasta genome").when(h.rlike(scan) | h.rlike(chip), "array scan").when(up_to(10, _snp_line), "snplist")
            .when(F.exists(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: x.startswith(table)), "array map").otherwise("unknown"))
    build = F.coalesce(info("genome-version-ncbi"), info("genome-version"))
    comment = (F.when(F.col("format") == "array scan", F.coalesce(F.nullif(F.regexp_extract("_h", scan, 1), F.lit("")), F.regexp_extract("_h", chip, 1)))
               .when(F.col("format") == "array map", F.concat_ws(" ", info("netaffx-annotation-date"), info("netaffx-annotation-netaffx-build"), build)))
    return head.withColumn("format", F.coalesce(name, F.lit("unknown"))).withColumn("comment", comment).drop("_h", "_l", content)
