"""Line, file, checksum and sorting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sorting as O, text as X
from .catalog import query
from .views import add_view

add_view("doc_lines",
         "select doc_id as file, p + 1 as line_no, line from (select doc_id, posexplode(split(text, '\\n')) as (p, line) from <documents>)",
         "select doc_id as file, line_no, line from (select doc_id, unnest(str_split(text, chr(10))) as line, "
         "unnest(range(1, len(str_split(text, chr(10))) + 1)) as line_no from <documents>)")
# Cells `flag_000N=quantity`, two to a line.
add_view("indexed_stats", """
select concat(l_returnflag, '_00', cast(l_linenumber as varchar(4)), '=', cast(cast(l_quantity as bigint) as varchar(20)), '	',
  l_linestatus, '_', cast(l_suppkey % 12 as varchar(4)), '=', cast(l_partkey as varchar(20))) as line from <lineitem>""")


@query("grep", "select doc_id, regexp_replace(concat(source, '.txt.gz'), '\\.gz$', '') as file from documents where regexp_matches(text, 'the [a-z]+ion')")
def _(t):
    docs = t.documents.select("doc_id", "text", F.concat("source", F.lit(".txt.gz")).alias("file"))
    return X.grep(docs, "the [a-z]+ion", line="text", file="file").select("doc_id", "file")


@query("grep_invert", "select doc_id from documents where not regexp_matches(text, '(?i)license')")
def _(t):
    return X.grep(t.documents, "(?i)license", invert=True, line="text").select("doc_id")


@query("tag_counts", """
select page_id, value, count(*) as n from (select page_id,
  unnest(regexp_extract_all(html, '<(?:b|a|h1|li|p|td)>([^<>\\n]*)</(?:b|a|h1|li|p|td)>', 1)) as value,
  unnest(regexp_extract_all(html, '<(b|a|h1|li|p|td)>[^<>\\n]*</(?:b|a|h1|li|p|td)>', 1)) as o,
  unnest(regexp_extract_all(html, '<(?:b|a|h1|li|p|td)>[^<>\\n]*</(b|a|h1|li|p|td)>', 1)) as c from pages)
where o = 'h1' and c = 'h1' group by 1, 2""")
def _(t):
    return X.tag_counts(t.pages, "h1", text="html", file="page_id")


@query("text_lengths", "select source, cast(sum(length(text)) as bigint) as length from documents group by 1")
def _(t):
    return X.text_lengths(t.documents, file="source")


@query("sum_kv", """
select coalesce(regexp_extract(line, '^(.*?)=([0-9]+)$', 1), '') as key, cast(sum(cast(regexp_extract(line, '^(.*?)=([0-9]+)$', 2) as bigint)) as bigint) as total
from $stats_lines where regexp_matches(line, '^(.*?)=([0-9]+)$') group by 1""")
def _(t):
    return X.sum_kv(t.stats_lines)


@query("ignored_lines", "select count(*) as ignored from $stats_lines where not regexp_matches(line, '^(.*?)=([0-9]+)$')")
def _(t):
    return X.ignored_lines(t.stats_lines)


_CELLS = """
with c as (select l_returnflag as name, cast(l_linenumber as bigint) as idx, cast(l_quantity as bigint) as v from lineitem
  union all select l_linestatus, l_suppkey % 12, l_partkey from lineitem),
d as (select unnest(range((select max(idx) from c) + {last})) as idx)
select d.idx, """ + ", ".join(f"cast(coalesce(sum(v) filter (name = '{n}'), 0) as bigint) as {n}" for n in "AFNOR") + """
from d left join c on c.idx = d.idx group by d.idx"""


@query("pivot_stats", _CELLS.format(last=1))
def _(t):
    return X.pivot_stats(t.indexed_stats, list("AFNOR"))


@query("pivot_stats_compat", _CELLS.format(last=0))
def _(t):
    return X.pivot_stats(t.indexed_stats, list("AFNOR"), compat=True)


@query("sum_counts", """
select l_returnflag as kind, cast(l_partkey % 100 as varchar) as key, cast(sum(l_quantity) as bigint) as n from lineitem group by 1, 2
union all select l_returnflag, null, count(*) from lineitem group by 1""")
def _(t):
    parts = t.sql("""select l_returnflag as kind, cast(l_partkey % 100 as string) as key, cast(l_quantity as bigint) as n from {lineitem}
                     union all select l_returnflag, null, 1L from {lineitem}""")
    return X.sum_counts(parts)


@query("split_text", """
select file, concat(min(line_no), '-', max(line_no), '.txt') as name, max(line_no) - min(line_no) + 1 as n_lines,
  string_agg(line, chr(10) order by line_no) as text from $doc_lines group by file, (line_no - 1) // 10""")
def _(t):
    return X.split_text(X.numbered_lines(t.documents, "doc_id", "text"), 10)


@query("concat_streams", """
select text as line, 0 as part from documents where not starts_with(text, '#')
union all select text, 1 from conversations where not starts_with(text, '#')
union all select text, 2 from benchmark where not starts_with(text, '#')""")
def _(t):
    return X.concat_streams([d.select(F.col("text").alias("line")) for d in (t.documents, t.conversations, t.benchmark)],
                            skip_headers=True)


add_view("range_text", """
select concat('set', cast(id % 10 as varchar(4)), ' ', cast(nodes as varchar(4)),
  case when id % 3 = 0 then '' else concat('-', cast(nodes + id % 5 as varchar(4))) end) as text, id from <jobs>""")
add_view("node_lists", """
select id, case when id % 4 = 0 then cast(nodes as varchar(4)) when id % 4 = 1 then concat('m', cast(nodes as varchar(4)), ',k2')
  else concat('n[', cast(nodes as varchar(4)), '-', cast(nodes + id % 5 as varchar(4)), ',20],m', cast(nodes as varchar(4))) end as node_list from <jobs>""")


@query("expand_ranges", """
select concat('set', id % 10) as dataset, unnest(range(nodes, case when id % 3 = 0 then nodes else nodes + id % 5 end + 1)) as frame from $jobs""")
def _(t):
    return X.expand_ranges(t.range_text)


@query("count_nodes", "select id, case when id % 4 = 0 then nodes when id % 4 = 1 then 2 else id % 5 + 3 end as n from $jobs")
def _(t):
    return t.node_lists.select("id", X.count_nodes("node_list").alias("n"))


@query("file_checksums", "select doc_id, md5(text) as checksum from documents")
def _(t):
    return X.file_checksums(t.documents, content="text", file="doc_id")


@query("file_checksums_sha256", "select page_id, sha256(html) as checksum from pages")
def _(t):
    return X.file_checksums(t.pages, "sha256", content="html", file="page_id")


@query("checksum_of_checksums", """
select o_custkey as grp, md5(string_agg(md5(cast(o_orderkey as varchar)), '' order by o_orderkey)) as checksum from orders group by 1
union all select null, md5(string_agg(md5(cast(o_orderkey as varchar)), '' order by o_custkey, o_orderkey)) from orders""")
def _(t):
    sums = t.sql("select o_custkey as grp, o_orderkey as ord, md5(cast(o_orderkey as string)) as checksum from {orders}")
    return X.checksum_of_checksums(sums, "grp", "ord")


@query("checksum_tree", """
with s as (select o_custkey as grp, o_orderkey // 4096 as slice, md5(string_agg(md5(cast(o_orderkey as varchar)), '' order by o_orderkey)) as h
    from orders group by 1, 2),
g as (select grp, md5(string_agg(h, '' order by slice)) as h from s group by 1),
b as (select substr(md5(cast(grp as varchar)), 1, 3) as b, md5(string_agg(h, '' order by grp)) as h from g group by 1)
select grp, h as checksum from g union all select null, md5(string_agg(h, '' order by b)) from b""")
def _(t):
    sums = t.sql("select o_custkey as grp, o_orderkey as ord, md5(cast(o_orderkey as string)) as checksum from {orders}")
    return X.checksum_tree(sums, "grp", "ord")


@query("compare_checksums", """
with g as (select doc_id as file, md5(text) as got from documents where lang <> 'en'),
w as (select doc_id as file, case when n_chars % 5 = 0 then 'x' else md5(text) end as want from documents where n_chars % 7 <> 0),
j as (select coalesce(g.file, w.file) as file, got, want from g full join w on g.file = w.file)
select *, case when got is null then 'missing' when want is null then 'extra' else 'changed' end as status from j
where got is null or want is null or got <> want""")
def _(t):
    got = X.file_checksums(t.documents.where("lang <> 'en'"), content="text", file="doc_id").withColumnRenamed("doc_id", "file")
    want = t.sql("""select doc_id as file, case when n_chars % 5 = 0 then 'x' else md5(text) end as checksum
                    from {documents} where n_chars % 7 <> 0""")
    return X.compare_checksums(got, want)


@query("file_sizes", """
select source, cast(sum(strlen(text)) as bigint) as bytes, cast(sum(len(str_split(text, chr(10)))) as bigint) as lines
from documents group by 1""")
def _(t):
    return X.file_sizes(t.documents, file="source")


@query("slice_bytes", "select doc_id, md5(substr(seq, 11, 500)) as piece from $seqs")
def _(t):
    cut = X.slice_bytes(t.seqs.select("doc_id", F.col("seq").cast("binary").alias("content")), 10, 510)
    return cut.select("doc_id", F.md5("content").alias("piece"))


add_view("image_files", """
select concat(case when l_linenumber % 3 = 0 then 'WL_' else 'SC_' end, substr(concat('000', cast(1 + l_orderkey % 900 as varchar(20))),
    length(cast(1 + l_orderkey % 900 as varchar(20))), 4), case when l_suppkey % 2 = 0 then '.raw.gz' when l_suppkey % 5 = 1 then '.txt' else '.tif' end) as filename,
  case when l_partkey % 4 = 0 then 'WL1' else cast(l_partkey % 4 as varchar(4)) end as cycle, 1 + l_orderkey % 900 as img from <lineitem>""")


@query("restack", """
select case when starts_with(filename, 'SC') and cycle = 'WL1' then 1 + (img - 1) // 4 else img end as frame, cycle,
  concat(cycle, ',', filename) as member from $image_files where not contains(filename, '.txt')""")
def _(t):
    return X.restack(t.image_files)


add_view("sized_reads", "select doc_id as ord, doc_id, length(seq) as n_bases from <seqs>")


@query("batch", "select doc_id, ord, n_bases, (row_number() over (order by ord) - 1) // 25 + 1 as batch from $sized_reads")
def _(t):
    return X.batch(t.sized_reads, 25)


@query("batch_long_reads", """
with r as (select *, sum(cast(n_bases >= 400 as int)) over (order by ord) as n from $sized_reads)
select doc_id, ord, n_bases, cast((n - 1) // 10 + 1 as bigint) as batch from r where n > 0 and (n - 1) // 10 + 1 <= 20""")
def _(t):
    return X.batch(t.sized_reads, 10, min_length=400, max_batches=20)


@query("sort_by_position", "select *, start_pos // 1000 as bucket from $alignments")
def _(t):
    return O.sort_by_position(t.alignments, 1000, then=("read_id",))


@query("merge_sorted", "select * from $alignments")
def _(t):
    a = t.alignments
    return O.merge_sorted(a.where("is_tumor = 0"), a.where("is_tumor = 1"))


@query("sort_by_id_then_pos", "select * from $alignments")
def _(t):
    return O.sort_by_id_then_pos(t.alignments, "chr", "start_pos", then=("read_id",))


@query("merge_streams", "select conv_id, turn, text from conversations union all select doc_id, 0, text from documents")
def _(t):
    docs = t.documents.select(F.col("doc_id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), "text")
    return O.merge_streams([t.conversations.select("conv_id", "turn", "text"), docs], "conv_id", then=("turn",))


@query("sort_keep_header", """
with l as (select line, doc_id * 100000 + pos as line_no from (select doc_id, unnest(str_split(text, chr(10))) as line, unnest(range(len(str_split(text, chr(10))))) as pos from documents)),
h as (select case when line_no < 300000 then concat('# ', line) else line end as line, line_no from l),
m as (select *, line_no < (select min(line_no) from h where not starts_with(line, '#')) as head from h)
select line, row_number() over (order by case when head then line_no end nulls last, line) as place from m""")
def _(t):
    # The first lines become a header.
    lines = t.sql("select doc_id * 100000 + pos as line_no, line from (select doc_id, posexplode(split(text, '\n')) as (pos, line) from {documents})")
    lines = lines.withColumn("line", F.when(F.col("line_no") < 300_000, F.concat(F.lit("# "), "line")).otherwise(F.col("line")))
    return O.numbered(O.sort_keep_header(lines).select("line"), "place")


@query("sort_bench", """
select line, count(*) as copies from (select unnest(regexp_extract_all(regexp_replace(text, '[^ -~]', '~', 'g'), '.{1,99}')) as line
from documents) where line <> '' group by 1""")
def _(t):
    return O.sort_bench(t.documents)


@query("skip_oversized", """
select o_custkey, o_orderkey from orders where o_custkey in (select o_custkey from orders group by 1 having count(*) <= 9)""")
def _(t):
    return O.skip_oversized(t.orders.select("o_custkey", "o_orderkey"), "o_custkey", 9)


@query("first_n_per_query", """
select l_partkey, ord from (select l_partkey, l_orderkey * 8 + l_linenumber as ord,
  row_number() over (partition by l_partkey order by l_orderkey * 8 + l_linenumber) as rn from lineitem) where rn <= 3""")
def _(t):
    hits = t.lineitem.selectExpr("l_partkey", "l_orderkey * 8 + l_linenumber as ord")
    return O.first_n_per_query(hits, 3, "l_partkey")


@query("progress_by_group", """
select chr, 100 * (row_number() over (order by f, chr) - 1) // 23 as percent from (select chr, min(ord) as f from $calls group by 1)""")
def _(t):
    return O.progress_by_group(t.calls)


@query("range_filter", "select o_orderkey from orders where cast(o_orderkey as varchar) between '12' and '25'")
def _(t):
    return O.range_filter(t.orders.select("o_orderkey"), "o_orderkey", "12", "25")


@query("window_filter", "select * from $calls where pos >= 1000 and pos < 2000")
def _(t):
    return O.window_filter(t.calls, 1, 1000)


@query("window_filter_compat", "select * from $calls where pos > 1000 and pos < 2000")
def _(t):
    return O.window_filter(t.calls, 1, 1000, compat=True)
