"""Round trips through the file formats, and the streaming forms. Files go to the session's shared folder."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import sorting as O
from ..session import new_path
from ..sources import files as L, formats as X, numbered as N
from ..streaming import totals as S
from .catalog import query
from .views import add_view


def _written(t, df, name, writer=None):
    path = new_path(t.spark, name)
    (writer or (lambda d, p: d.write.text(p)))(df, path)
    return path


@query("read_files", "select lang as stream, count(*) as n, cast(sum(length(line)) as bigint) as chars from (select lang, unnest(str_split(replace(text, chr(13), ' '), chr(10))) as line from documents) group by 1")
def _(t):
    lines = t.documents.select("lang", F.explode(F.split(F.replace("text", F.lit("\r"), F.lit(" ")), "\n")).alias("line"))
    path = _written(t, lines, "files", lambda d, p: L.write_files(d, p, codec="gzip", lines_per_file=500, by="lang"))
    back = L.read_files(t.spark, path).withColumn("stream", F.regexp_extract("stream", "=(.*)$", 1))
    return back.groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("chars"))


@query("recompress", "select count(*) as n, count(distinct line) as lines from (select unnest(str_split(replace(text, chr(13), ' '), chr(10))) as line from documents)")
def _(t):
    lines = t.documents.select("lang", F.explode(F.split(F.replace("text", F.lit("\r"), F.lit(" ")), "\n")).alias("line"))
    # A dataset of plain and of compressed files.
    mixed = _written(t, lines.where("lang <> 'en'").select("line"), "mixed", L.write_files)
    lines.where("lang = 'en'").select("line").write.mode("append").option("compression", "gzip").text(mixed)
    second = new_path(t.spark, "gz")
    L.recompress(t.spark, mixed, second)
    back = L.read_files(t.spark, second, pattern="*.gz")
    return back.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("line").alias("lines"))


@query("disk_checksums", "select item_id, md5(concat(text, chr(10))) as checksum, octet_length(encode(concat(text, chr(10)))) as bytes from benchmark")
def _(t):
    path = _written(t, t.benchmark.select("item_id", F.col("text").alias("line")), "items", lambda d, p: L.write_files(d, p, codec="gzip", by="item_id"))
    found = L.disk_checksums(t.spark, path, pattern="*.gz", uncompress=True)
    return found.select(F.regexp_extract("file", "item_id=([0-9]+)", 1).cast("long").alias("item_id"), "checksum", "bytes")


@query("numbered_text", "select count(*) as n, max(n) as top, cast(sum(n) as bigint) as total from (select row_number() over (order by item_id) as n from benchmark, unnest(str_split(replace(text, chr(13), ' '), chr(10))))")
def _(t):
    lines = t.benchmark.select(F.explode(F.split(F.replace("text", F.lit("\r"), F.lit(" ")), "\n")).alias("line"))
    path = _written(t, lines.coalesce(1), "numbered")
    return L.numbered_text(t.spark, path).agg(F.count(F.lit(1)).alias("n"), F.max("line_no").alias("top"), F.sum("line_no").alias("total"))


@query("write_numbered", """
with l as (select row_number() over (order by o_orderkey) - 1 as r, concat(o_orderkey, ' ', o_custkey, ' ', o_orderpriority) as line from orders)
select printf('%04d/items-%04d.txt.gz', r // 500 // 4, r // 500) as file, count(*) as n, min_by(line, r) as first, max_by(line, r) as last,
md5(concat(string_agg(line, chr(10) order by r), chr(10))) as content from l group by r // 500""")
def _(t):
    rows = t.orders.select(F.col("o_orderkey").alias("ord"), F.concat_ws(" ", "o_orderkey", "o_custkey", "o_orderpriority").alias("line"))
    path = new_path(t.spark, "items")
    N.write_numbered(rows, path, "ord", 500, "items-{}.txt", files_per_folder=4, codec="gzip")
    body = F.decode("content", "utf-8")
    lines = F.split(F.rtrim(body, F.lit("\n")), "\n")
    # A file is 500 short lines.
    return L.disk_files(t.spark, path, "*.gz", uncompress=True).select(
        F.regexp_extract("file", "([0-9]+/[^/]+)$", 1).alias("file"), F.size(lines).cast("long").alias("n"), F.element_at(lines, 1).alias("first"),
        F.element_at(lines, -1).alias("last"), F.md5("content").alias("content"))


@query("read_fastq", "select name, bases, quals from $reads")
def _(t):
    path = _written(t, X.fastq_lines(t.reads), "fastq")
    return X.read_fastq(t.spark, path).select("name", "bases", "quals")


# FASTA with 60-letter lines and gaps where `ca` repeats.
add_view("gapped", "select doc_id, replace(seq, 'caca', 'NNMR') as seq from <seqs> where length(seq) > 0")


@query("read_fasta", """
with p as (select doc_id, seq, unnest(range(cast(ceil(length(seq) / 500) as bigint))) as c from $gapped),
x as (select doc_id, c, unnest(regexp_extract_all(substr(seq, c * 500 + 1, 500), '([^NMR]+|[NMR]+)')) as s, unnest(range(len(regexp_extract_all(substr(seq, c * 500 + 1, 500), '([^NMR]+|[NMR]+)')))) as i from p),
y as (select *, c * 500 + sum(length(s)) over (partition by doc_id, c order by i) - length(s) as pos from x)
select concat('d', doc_id) as name, cast(pos as bigint) as pos, s as seq from y where not regexp_matches(s, '^[NMR]')""")
def _(t):
    lines = t.gapped.select(F.concat(F.lit(">d"), F.col("doc_id").cast("string"), F.lit(" text\n"),
                                     F.regexp_replace("seq", "(.{60})(?=.)", "$1\n")).alias("line"))
    return X.read_fasta(t.spark, _written(t, lines, "fasta"), chunk=500).select("name", "pos", "seq")


@query("read_sam", "select name, flag, 'chr1' as chr, ord as pos, bases, quals, rg, cs, cq from $sam_rows")
def _(t):
    tag = lambda n, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{n}:Z:"), c))
    lines = t.sam_rows.select(F.concat_ws("\t", "name", F.col("flag").cast("string"), F.lit("chr1"), F.col("ord").cast("string"), F.lit("0"), F.lit("36M"),
                                          F.lit("*"), F.lit("0"), F.lit("0"), "bases", "quals", tag("RG", "rg"), tag("CS", "cs"), tag("CQ", "cq")).alias("line"))
    return X.read_sam(t.spark, _written(t, lines, "sam")).select("name", "flag", "chr", "pos", "bases", "quals", "rg", "cs", "cq")


@query("read_gff", "select chr, start_pos, end_pos, strand, name as alleles, concat('r', region_id) as id from $regions")
def _(t):
    rows = t.regions.withColumn("attributes", F.concat(F.lit("alleles x;alleles "), "name", F.lit(' ; ID "r'), F.col("region_id").cast("string"), F.lit('"')))
    path = _written(t, rows.withColumn("feature", F.lit("SNP")), "gff", X.write_gff)
    return X.read_gff(t.spark, path).select("chr", "start_pos", "end_pos", "strand", F.element_at("attrs", "alleles").alias("alleles"), F.element_at("attrs", "ID").alias("id"))


@query("read_bed", "select chr, start_pos - 1 as start0, end_pos as end0, name from $regions")
def _(t):
    path = _written(t, t.regions.selectExpr("chr", "start_pos - 1 as start0", "end_pos as end0", "name"), "bed", X.write_bed)
    return X.read_bed(t.spark, path)


@query("read_hits", """
select probe as query, case when mismatches = 1 then '-' else '+' end as strand, count(*) as n from $probe_hits where mismatches <= 1 group by 1, 2""")
def _(t):
    flip = F.col("mismatches") == 1
    rows = t.probe_hits.select("probe", "chr", F.lit(99.5), F.lit(60), "mismatches", F.lit(0), "qstart", "qend", F.when(flip, F.col("hend")).otherwise(F.col("hstart")),
                               F.when(flip, F.col("hstart")).otherwise(F.col("hend")), F.lit(0.001), F.lit(80.0), "qseq", "hseq", "qlength")
    path = _written(t, rows, "hits", lambda d, p: d.write.option("sep", "\t").csv(p))
    return X.read_hits(t.spark, path, 90, 50, 1).groupBy("query", "strand").agg(F.count(F.lit(1)).alias("n"))


@query("read_array_manifest", "select name, build, chr, pos, strand, topseq from $array_manifest")
def _(t):
    rows = t.array_manifest.select(F.concat_ws(",", F.lit("x"), "name", "strand", "topseq", "chr", F.col("pos").cast("string"), "build").alias("line"))
    top = t.spark.createDataFrame([("[Heading]\nDate,1\n[Assay]\nIlmnID,Name,SourceStrand,TopGenomicSeq,Chr,MapInfo,GenomeBuild",)], "line string")
    tail = t.spark.createDataFrame([("[Controls]\na,b,c",)], "line string")
    path = _written(t, top.union(rows).union(tail).coalesce(1), "array")
    return X.read_array_manifest(t.spark, path).drop("ord")


@query("read_genotype_csv", "select cast(p_partkey as varchar) as id, p_name as name from part")
def _(t):
    path = _written(t, t.part.selectExpr("cast(p_partkey as string) as id", "p_name as name"), "csv", lambda d, p: d.write.option("header", "true").option("quoteAll", "true").csv(p))
    return X.read_genotype_csv(t.spark, path)


@query("read_table", "select read_id, arm0 as mer0, arm1 as mer1, length(arm0) as n, concat('s ', read_id) as label from $arms")
def _(t):
    rows = t.arms.select("read_id", F.col("arm0").alias("mer0"), F.col("arm1").alias("mer1"), F.length("arm0").alias("n"), F.concat(F.lit("s "), F.col("read_id").cast("string")).alias("label"))
    path = _written(t, rows, "table", lambda d, p: X.write_table(d, p, "#: table-0.1/text"))
    return X.read_table(t.spark, path)


@query("read_checksums", "select md5(text) as checksum, concat('doc ', doc_id) as file from documents")
def _(t):
    path = _written(t, t.documents.select(F.concat(F.md5("text"), F.lit("  doc "), F.col("doc_id").cast("string"))), "sums")
    return L.read_checksums(t.spark, path)


@query("copy_dataset", "select doc_id, n_chars from documents")
def _(t):
    first = _written(t, t.documents.select("doc_id", "n_chars"), "one", lambda d, p: d.write.parquet(p))
    second = new_path(t.spark, "two")
    L.copy_dataset(t.spark, first, second, "parquet")
    return t.spark.read.parquet(second)


@query("split_by_key", "select sample, count(*) as n, cast(sum(pos) as bigint) as total from $calls group by 1")
def _(t):
    path = new_path(t.spark, "bykey")
    O.split_by_key(t.calls, path, "sample", rows_per_file=5000)
    return t.spark.read.parquet(path).groupBy("sample").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("total"))


def _dots(batches):
    for pdf in batches:
        yield pd.DataFrame({"file": pdf["file"], "line": pdf["line"].str.replace(".", "|", regex=False)})


@query("filter_files", "select file, replace(line, '.', '|') as line from $doc_lines")
def _(t):
    return L.filter_files(t.doc_lines.select("file", "line"), _dots, "file bigint, line string")


def _count(pdf):
    return pd.DataFrame({"file": [""], "lines": [len(pdf)], "first": [int(pdf["line_no"].iloc[0])]})


@query("per_file", "select concat('out-', file, '-', (line_no - 1) // 20) as file, count(*) as \"lines\", min(line_no) as \"first\" from $doc_lines group by file, (line_no - 1) // 20")
def _(t):
    return L.per_file(t.doc_lines, _count, "file string, lines bigint, first bigint", name="out-%F-%N", lines=20)


@query("pipe_lines", "select line, count(*) as n from (select replace(replace(replace(source, 'e', 'E'), chr(9), ' '), chr(10), ' ') as line from documents) group by 1")
def _(t):
    return L.pipe_lines(t.documents.select(F.col("source").alias("line")), "tr e E").groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query("stream_sum_kv", """
select coalesce(regexp_extract(line, '^(.*?)=([0-9]+)$', 1), '') as key, cast(sum(cast(regexp_extract(line, '^(.*?)=([0-9]+)$', 2) as bigint)) as bigint) as total
from $stats_lines where regexp_matches(line, '^(.*?)=([0-9]+)$') group by 1""")
def _(t):
    stream = (t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
              .where("value is not null").selectExpr("concat(event_type, '=', cast(cast(floor(value) as bigint) as string)) as line"))
    target, state = new_path(t.spark, "totals"), new_path(t.spark, "state")
    S.run_available(S.running_totals(stream), target, state, mode="update")
    return S.latest_totals(t.spark.read.parquet(target))


@query("stream_node_seconds", """
with j as (select epoch(starttime)::bigint as s, epoch(starttime)::bigint + elapsed_s as e, nodes from $jobs),
h as (select *, unnest(range(s // 3600, (e - 1) // 3600 + 1)) as h from j),
a as (select h, cast(sum((least(e, (h + 1) * 3600) - greatest(s, h * 3600)) * nodes) as bigint) as node_seconds from h group by 1)
select make_timestamp(h * 3600000000) as hour, node_seconds from a""")
def _(t):
    stream = (t.spark.readStream.schema(t.orders.schema).option("pathGlobFilter", "orders.parquet").parquet(t.folder)
              .selectExpr("o_orderdate as starttime", "60 + (o_orderkey * 131) % 20000 as elapsed_s", "1 + o_custkey % 8 as nodes"))
    target, state = new_path(t.spark, "hours"), new_path(t.spark, "state")
    S.run_available(S.hourly_usage(stream), target, state, mode="update")
    return t.spark.read.parquet(target).groupBy("hour").agg(F.max_by("node_seconds", "batch").alias("node_seconds"))
