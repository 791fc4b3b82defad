"""Readers and writers of sequencing and annotation formats.

Every `parse_*` works on a DataFrame of lines; `read_*` adds the file scan.
FASTQ and FASTA files are read by `records.py`, without a shuffle; their
`parse_*` are for lines that are in a table already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..scale import running_sum
from .files import numbered_text
from .records import head_lines, read_fasta, read_fastq  # noqa: F401

# -- sequences ------------------------------------------------------------------------


def parse_fastq(lines: DataFrame) -> DataFrame:
    """(file, record, name, bases, quals) of four-line records from (file, line_no, line)."""
    record = F.floor((F.col("line_no") - 1) / 4)
    part = (F.col("line_no") - 1) % 4
    pick = lambda i: F.max(F.when(part == i, F.col("line")))
    rows = lines.groupBy("file", record.alias("record")).agg(pick(0).alias("_t"), pick(1).alias("bases"), pick(3).alias("quals"))
    return rows.where(F.col("_t").startswith("@")).select("file", "record", F.substr("_t", F.lit(2)).alias("name"), "bases", "quals")


def fastq_lines(reads: DataFrame) -> DataFrame:
    """Four lines per read; NULL is an empty line."""
    cell = lambda c: F.coalesce(c, F.lit(""))
    return reads.select(F.concat_ws("\n", F.concat(F.lit("@"), cell("name")), cell("bases"), F.lit("+"), cell("quals")).alias("line"))


def parse_fasta(lines: DataFrame, chunk: int = 1_000_000, width: int = 1 << 16) -> DataFrame:
    """(file, record, name, pos, seq): sequences in chunks of at most `chunk` letters with 0-based offsets.

    Runs of N, M or R are gaps: they advance the position and give no row.
    Record numbers and offsets are running sums over line slices, so one long
    chromosome spreads over many tasks and no row holds more than a chunk.
    """
    head = F.col("line").startswith(">")
    text = F.regexp_replace("line", r"\s", "")
    r = running_sum(lines, "line_no", head.cast("long"), "record", width, keys=("file",)).where("record > 0")
    names = r.where(head).select("file", "record", F.regexp_extract("line", r"^>\s*(\S*)", 1).alias("name"), F.col("line_no").alias("_head"))
    body = r.where(~head).withColumn("line", text).where("line <> ''")
    run = running_sum(body.drop("_head"), "line_no", F.length("line").cast("long"), "_end", width, keys=("file", "record"))
    run = run.withColumn("_pos", F.col("_end") - F.length("line"))
    cut = run.withColumn("_c", F.explode(F.sequence(F.floor(F.col("_pos") / chunk), F.floor((F.col("_end") - 1) / chunk))))
    lo = F.greatest(F.col("_c") * chunk, F.col("_pos"))
    piece = F.substr("line", (lo - F.col("_pos") + 1).cast("int"), (F.least((F.col("_c") + 1) * chunk, F.col("_end")) - lo).cast("int"))
    joined = cut.groupBy("file", "record", "_c").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_pos", piece.alias("s")))), lambda x: x["s"]), "").alias("_seq"))
    runs = F.regexp_extract_all("_seq", F.lit("([^NMRnmr]+|[NMRnmr]+)"), F.lit(1))
    placed = joined.withColumn("_runs", runs).withColumn("_r", F.explode(F.transform("_runs", lambda s, i: F.struct(
        s.alias("seq"), F.aggregate(F.slice("_runs", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("at")))))
    kept = placed.where(~F.col("_r.seq").rlike("^[NMRnmr]"))
    return kept.join(names.drop("_head"), ["file", "record"]).select(
        "file", "record", "name", (F.col("_c") * chunk + F.col("_r.at")).alias("pos"), F.col("_r.seq").alias("seq"))


# -- alignments -------------------------------------------------------------------------

_SAM = (("name", "string"), ("flag", "int"), ("chr", "string"), ("pos", "long"), ("mapq", "int"), ("cigar", "string"),
        ("mate_chr", "string"), ("mate_pos", "long"), ("insert", "long"), ("bases", "string"), ("quals", "string"))


def parse_sam(lines: DataFrame) -> DataFrame:
    """The eleven SAM columns, a map of the optional tags, and the tags RG, CS, CQ as columns."""
    f = F.split("line", "\t")
    rows = lines.where(~F.col("line").startswith("@")).withColumn("_f", f)
    tags = F.transform(F.slice("_f", 12, F.size("_f")), lambda x: F.struct(F.substring(x, 1, 2).alias("k"), F.substr(x, F.lit(6)).alias("v")))
    cols = [F.get("_f", F.lit(i)).try_cast(t).alias(n) for i, (n, t) in enumerate(_SAM)]
    out = rows.select(*[c for c in lines.columns if c != "line"], *cols, _last_wins(F.when(F.size("_f") > 11, tags)).alias("tags"))
    return out.withColumns({n: F.element_at("tags", n.upper()) for n in ("rg", "cs", "cq")})


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    return parse_sam(spark.read.text(path).withColumnRenamed("value", "line"))


def _last_wins(entries: Column) -> Column:
    """Map of (k, v) entries; a repeated key keeps its last value."""
    kept = F.filter(F.transform(entries, lambda e, i: F.struct(e["k"].alias("k"), e["v"].alias("v"), F.exists(
        F.slice(entries, i + 2, F.size(entries)), lambda o: o["k"] == e["k"]).alias("later"))), lambda e: ~e["later"])
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["k"], e["v"])))


# -- annotation ---------------------------------------------------------------------------

_GFF = (("chr", "string"), ("source", "string"), ("feature", "string"), ("start_pos", "long"), ("end_pos", "long"), ("score", "string"),
        ("strand", "string"), ("frame", "string"), ("attributes", "string"))


def parse_gff(lines: DataFrame) -> DataFrame:
    """The nine GFF columns and the attributes (`k v;k v` or `k=v`) as a map."""
    f = F.split("line", "\t", 9)
    rows = lines.where(~F.col("line").startswith("#") & (F.col("line") != "")).withColumn("_f", f)
    out = rows.select(*[c for c in lines.columns if c != "line"], *[F.get("_f", F.lit(i)).try_cast(t).alias(n) for i, (n, t) in enumerate(_GFF)])
    items = F.filter(F.transform(F.split("attributes", ";"), lambda s: F.trim(s)), lambda s: s != "")
    entries = F.transform(items, lambda s: F.struct(F.regexp_extract(s, r"^([^\s=]+)", 1).alias("k"),
                                                   F.regexp_replace(F.regexp_extract(s, r"^[^\s=]+[\s=]*(.*)$", 1), '^"|"$', "").alias("v")))
    return out.withColumn("attrs", _last_wins(entries))


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    return parse_gff(spark.read.text(path).withColumnRenamed("value", "line"))


def gff_lines(df: DataFrame) -> DataFrame:
    """Tab-separated lines, `.` for missing values."""
    cols = [F.coalesce(F.col(n).cast("string"), F.lit(".")) if n in df.columns else F.lit("+" if n == "strand" else ".") for n, _ in _GFF]
    return df.select(F.concat_ws("\t", *cols).alias("line"))


def write_gff(df: DataFrame, path: str) -> None:
    gff_lines(df).write.text(path)


_BED = "chr string, start0 long, end0 long, name string"


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(chr, start0, end0, name): 0-based half-open."""
    return spark.read.schema(_BED).option("sep", "\t").option("comment", "#").csv(path)


def write_bed(df: DataFrame, path: str) -> None:
    df.select("chr", "start0", "end0", "name").write.option("sep", "\t").csv(path)


# -- tabular hits -------------------------------------------------------------------------

_HITS = ("query string, hit string, identity double, length long, mismatches long, gaps long, qstart long, qend long, hstart long, "
         "hend long, evalue double, bits double, qseq string, hseq string, qlength long")


def read_hits(spark: SparkSession, path: str, min_identity: float = 0, min_length: int = 0, max_mismatches: int | None = None) -> DataFrame:
    """Tabular alignment hits (15 columns), filtered; `strand` is - where the hit's ends are flipped."""
    h = spark.read.schema(_HITS).option("sep", "\t").option("comment", "#").csv(path)
    h = h.where((F.col("identity") >= min_identity) & (F.col("length") >= min_length))
    if max_mismatches is not None:
        h = h.where(F.col("mismatches") <= max_mismatches)
    return h.withColumn("strand", F.when(F.col("hstart") > F.col("hend"), "-").otherwise("+"))


# -- genotyping arrays ----------------------------------------------------------------------


def parse_sections(lines: DataFrame, width: int = 1 << 16) -> DataFrame:
    """Lines under their `[Section]` title: (file, section, line_no, line) without the titles."""
    title = F.col("line").rlike(r"^\[[^\]]*\]")
    n = running_sum(lines, "line_no", title.cast("long"), "_s", width, keys=("file",))
    names = n.where(title).select("file", "_s", F.regexp_extract("line", r"^\[([^\]]*)\]", 1).alias("section"))
    return n.where(~title).join(names, ["file", "_s"]).select("file", "section", "line_no", "line")


def read_array_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Variants of a genotyping array manifest's Assay section, columns found by their titles."""
    rows = parse_sections(numbered_text(spark, path)).where("section = 'Assay'")
    first = rows.agg(F.min_by("line", "line_no")).first()[0]
    titles = (first or "").strip().split(",")
    wanted = {"Name": "name", "GenomeBuild": "build", "Chr": "chr", "MapInfo": "pos", "SourceStrand": "strand", "TopGenomicSeq": "topseq"}
    f = F.split("line", ",")
    cols = [F.get(f, F.lit(titles.index(t))).alias(n) if t in titles else F.lit(None).cast("string").alias(n) for t, n in wanted.items()]
    return rows.where(F.col("line") != first).select(*cols, F.col("line_no").alias("ord")).withColumn("pos", F.col("pos").try_cast("long"))


def read_genotype_csv(spark: SparkSession, path: str) -> DataFrame:
    """Quoted annotation CSV with `#` comment lines and a title row."""
    return spark.read.option("header", "true").option("comment", "#").option("quote", '"').csv(path)


# -- self-described tables --------------------------------------------------------------------

# Column types of the header lines.
_FIELD_TYPES = {
    "uint4": T.ByteType(), "int4": T.ByteType(), "int8": T.ByteType(), "uint8": T.ShortType(), "int32": T.IntegerType(),
    "uint32": T.LongType(), "int64": T.LongType(), "uint64": T.DecimalType(20, 0), "sfloat": T.FloatType(), "dfloat": T.DoubleType(),
    "sym": T.StringType(), "nil": T.StringType(),
}


def table_schema(header: list[str], mers: tuple[str, ...] | None = None) -> T.StructType:
    """Schema of `# field "name" "type"` lines. 64-bit columns named mer… (or in `mers`) hold letters and stay text."""
    fields = []
    for text in header:
        parts = text.split('"')
        if text.startswith("# field") and len(parts) >= 4:
            name, kind = parts[1], parts[3]
            letters = name in mers if mers is not None else name.startswith("mer")
            fields.append(T.StructField(name, T.StringType() if kind == "uint64" and letters else _FIELD_TYPES[kind]))
    return T.StructType(fields)


def read_table(spark: SparkSession, path: str, mers: tuple[str, ...] | None = None) -> DataFrame:
    """Space-separated table whose header (`#: …`, `# field …`, `#.`) declares its columns.

    Only the lines at the top of the files are looked at for it, and only they
    reach the driver; rows are read once, with the declared schema.
    """
    # One row per column of the table.
    head = head_lines(spark, path).where(F.col("line").startswith("# field ")).groupBy("line").agg(F.min("line_no").alias("n"))
    order = {r["line"]: r["n"] for r in head.collect()}
    schema = table_schema(sorted(order, key=order.get), mers)
    return spark.read.schema(schema).option("sep", " ").option("comment", "#").option("quote", '"').option("nullValue", ".").csv(path)


_NAMES = {T.ByteType: "int8", T.ShortType: "uint8", T.IntegerType: "int32", T.LongType: "int64", T.FloatType: "sfloat",
          T.DoubleType: "dfloat", T.DecimalType: "uint64", T.StringType: "sym"}


def write_table(df: DataFrame, path: str, first_line: str) -> None:
    """The same kind of table: header lines in the first file, rows after it. NULL is written as `.`.

    `first_line` is the format line (`#: name-version/text`) the readers of the table expect.
    """
    spark = df.sparkSession
    strange = [f.name for f in df.schema.fields if type(f.dataType) not in _NAMES]
    if strange:
        raise ValueError(f"no type name for columns {strange}")
    fields = [f'# field "{f.name}" "{"uint64" if f.name.startswith("mer") else _NAMES[type(f.dataType)]}"' for f in df.schema.fields]
    header = spark.createDataFrame([("\n".join([first_line, *fields, "#."]),)], "line string").coalesce(1)
    cells = [F.when(F.lit(isinstance(f.dataType, T.StringType) and not f.name.startswith("mer")), F.concat(F.lit('"'), F.col(f.name), F.lit('"')))
             .otherwise(F.col(f.name).cast("string")) for f in df.schema.fields]
    header.union(df.select(F.concat_ws(" ", *[F.coalesce(c, F.lit(".")) for c in cells]).alias("line"))).write.text(path)
