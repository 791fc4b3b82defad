"""Job, storage and imaging queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import imaging as M, jobs as J, recovery as V, storage as S
from ..session import new_path, stored
from ..sources.files import write_files
from .catalog import query
from .views import add_view


@query("node_seconds_hourly", """
with j as (select epoch(starttime)::bigint as s, epoch(starttime)::bigint + elapsed_s as e, nodes from $jobs),
h as (select *, unnest(range(s // 3600, (e - 1) // 3600 + 1)) as h from j)
select make_timestamp(h * 3600000000) as hour, cast(sum((least(e, (h + 1) * 3600) - greatest(s, h * 3600)) * nodes) as bigint) as node_seconds from h group by 1""")
def _(t):
    return J.node_seconds_hourly(t.jobs)


@query("usage_summary", """
select min(starttime) as first_start, max(starttime + to_seconds(elapsed_s)) as last_finish, max(epoch(starttime)::bigint + elapsed_s) - min(epoch(starttime)::bigint) as seconds,
  cast(sum(nodes * elapsed_s) as bigint) as node_seconds from $jobs""")
def _(t):
    return J.usage_summary(t.jobs)


add_view("job_log", """
select l_orderkey as job, l_linenumber * 1000 + l_partkey % 1000 as k, l_suppkey, l_partkey, l_linenumber,
  (l_linenumber * 1000000 + l_partkey) * 1000 + l_suppkey % 1000 as line_no,
  concat('2024-01-0', cast(l_linenumber as varchar(2)), '_0', cast(l_suppkey % 10 as varchar(2)), ':00:00 ',
    case l_partkey % 4 when 0 then concat('7 8  node n', cast(l_suppkey as varchar(20)), ' - ', cast(1 + l_partkey % 5 as varchar(4)), ' slots')
      when 1 then concat('7 8 9 success in ', cast(l_partkey as varchar(20)), ' seconds') when 2 then concat('7 8 9 failure in ', cast(l_suppkey as varchar(20)), ' seconds')
      else concat('7 8  frozento key is K', cast(l_partkey as varchar(20))) end) as line from <lineitem>""")
_LOG = """f as (select job, line_no, 1704067200 + (l_linenumber - 1) * 86400 + (l_suppkey % 10) * 3600 as t, case when l_partkey % 4 = 1 then l_partkey else 0 end as success,
  case when l_partkey % 4 = 2 then l_suppkey else 0 end as failure, case when l_partkey % 4 = 0 then 1 + l_partkey % 5 else 0 end as slots,
  case when l_partkey % 4 = 3 then concat('K', l_partkey) end as frozen from $job_log)"""


@query("job_stats", f"""with {_LOG}, s as (select job, cast(sum(slots) as bigint) as slots, cast(sum(success) as bigint) as success, cast(sum(failure) as bigint) as failure from f group by 1),
j as (select id, elapsed_s, elapsed_s * nodes as node_seconds, slots, s.success, failure, slots * elapsed_s as slot_seconds, slots * elapsed_s - failure - s.success as idle from $jobs left join s on job = id)
select *, case when slot_seconds > 0 then round(100.0 * failure / slot_seconds, 2) end as failure_percent, case when slot_seconds > 0 then round(100.0 * success / slot_seconds, 2) end as success_percent,
  case when slot_seconds > 0 then round(100.0 * idle / slot_seconds, 2) end as idle_percent from j""")
def _(t):
    return J.job_stats(t.jobs, t.job_log)


@query("freeze_segments", f"""with {_LOG}, r as (select *, sum(slots) over w as sl, sum(success) over w as su, sum(failure) over w as fa, first_value(t) over w as st from f window w as (partition by job order by line_no))
select job, line_no, frozen, t - st as elapsed, cast(sl as bigint) as slots, cast(sl * (t - st) as bigint) as slot_seconds, cast(su as bigint) as success_seconds, cast(fa as bigint) as failure_seconds,
  cast(sl * (t - st) - fa - su as bigint) as idle_seconds from r where frozen is not null""")
def _(t):
    return J.freeze_segments(t.job_log)


@query("lineage_up", """
with recursive e as (select a.id as src, b.id as dst from $jobs a join $jobs b on a.inputkey = b.outputkey and b.id < a.id),
l as (select id, 0 as depth from $jobs where func = 'fn3' union select e.dst, depth + 1 from l join e on e.src = l.id)
select id, min(depth) as depth from l group by 1""")
def _(t):
    return J.lineage(t.jobs, t.jobs.where("func = 'fn3'"), "up")


@query("lineage_down", """
with recursive e as (select b.id as src, a.id as dst from $jobs a join $jobs b on a.inputkey = b.outputkey and b.id <> a.id),
l as (select id, 0 as depth from $jobs where id in (3, 4) union select e.dst, depth + 1 from l join e on e.src = l.id)
select id, min(depth) as depth from l group by 1""")
def _(t):
    return J.lineage(t.jobs, t.jobs.where("id in (3, 4)"), "down")


@query("recovery_plan", """
with recursive b as (select outputkey as key, id from $jobs where func in ('fn1', 'fn2', 'fn5', 'fn7')),
mk as (select o.key, m.inputkey as needs, m.id as job from $jobs m join b o on o.key = m.outputkey where m.success = 1),
r as (select key, job, 0 as level from mk where needs not in (select key from b) union all
  select mk.key, mk.job, r.level + 1 from r join mk on mk.needs = r.key and mk.key <> r.key)
select b.key, r.job, r.level from b left join r on r.key = b.key""")
def _(t):
    return J.recovery_plan(t.jobs, t.jobs.where("func in ('fn1', 'fn2', 'fn5', 'fn7')").select(F.col("outputkey").alias("key")))


# Every fourth job was run again later under another id, reading its input by a knob.
add_view("rerun_jobs", """
select id, inputkey, outputkey, knobs, success from <jobs>
union all select id + 1000000000, 'none', outputkey, concat('REF=', inputkey), success from <jobs> where id % 4 = 0""")


@query("fewest_jobs", """
with recursive b as (select distinct outputkey as key from $jobs where func in ('fn1', 'fn2', 'fn5', 'fn7')),
mk as (select m.outputkey as key, m.inputkey as needs, min(m.id) as job from $jobs m join b on b.key = m.outputkey where m.success = 1 group by 1, 2),
r as (select key, job, 0 as level from mk where needs not in (select key from b) union all
  select mk.key, mk.job, r.level + 1 from r join mk on mk.needs = r.key and mk.key <> r.key),
w as (select distinct outputkey as key from $jobs where func in ('fn2', 'fn7')),
u as (select key from w where key in (select key from r) union select mk.needs from u join mk on mk.key = u.key where mk.needs in (select key from b))
select r.key, r.level, r.job, true as fewest from r where key in (select key from u)
union all select key, null, null, null from w where key not in (select key from r)""")
def _(t):
    lost = lambda *names: t.rerun_jobs.join(t.jobs.where(F.col("func").isin(*names)).select("outputkey").distinct(), "outputkey", "left_semi").select(
        F.col("outputkey").alias("key")).distinct()
    return V.fewest_jobs(t.rerun_jobs, lost("fn1", "fn2", "fn5", "fn7"), lost("fn2", "fn7"))


add_view("job_specs", """
select o_orderkey as spec, concat('fn', cast(o_custkey % 12 as varchar(4))) as func, concat(md5(cast(cast(floor(o_orderkey / 2) as bigint) as varchar(20))), '+123+K@x') as inputkey,
  concat('K=', cast(o_custkey % 3 as varchar(4))) as knobs, 0 as min_rev, 1 + o_orderkey % 4 as max_rev from <orders>""")


@query("reusable_job", """
with f as (select s.spec, j.id, coalesce(j.success, 0) as done, j.outputkey, row_number() over (partition by s.spec order by coalesce(j.success, 0) desc, j.id desc) as rn
  from $job_specs s join $jobs j on j.func = s.func and j.knobs = s.knobs and j.inputkey = substr(s.inputkey, 1, 32) and j.revision between min_rev and max_rev and (j.success = 1 or j.success is null))
select spec, id as job, done, outputkey from f where rn = 1""")
def _(t):
    return J.reusable_job(t.jobs, t.job_specs)


@query("spec_hash", "select id, md5(concat(func, chr(10), inputkey, chr(10), knobs)) as spec_hash from $jobs")
def _(t):
    return t.jobs.select("id", J.spec_hash("func", F.col("inputkey"), "knobs").alias("spec_hash"))


@query("job_search", "select id, func, outputkey from $jobs where func = 'fn4' and success = 1 and nodes = 5")
def _(t):
    return J.job_search(t.jobs, ["id", "func", "outputkey"], func="fn4", success=1, nodes=5)


@query("job_layout", """
with j as (select id, epoch(starttime)::bigint as s, epoch(starttime)::bigint + elapsed_s as e, id % 30 as bottom, nodes from $jobs),
g as (select min(s) as lo, max(e) as hi, max(bottom + nodes) as top from j)
select id, round(1000.0 * (s - lo) / (hi - lo), 4) as x0, round(1000.0 * (e - lo) / (hi - lo), 4) as x1, round(100.0 * bottom / top, 4) as y0, round(100.0 * (bottom + nodes) / top, 4) as y1 from j, g""")
def _(t):
    return J.job_layout(t.jobs.withColumn("bottom", F.col("id") % 30))


_CONC = """e as (select epoch(starttime)::bigint as t, nodes as d from $jobs union all select epoch(starttime)::bigint + elapsed_s, -nodes from $jobs),
m as (select t, sum(d) as d from e group by 1), c as (select make_timestamp(t * 1000000) as t, cast(sum(d) over (order by m.t) as bigint) as nodes_in_use from m)"""


@query("concurrency", f"with {_CONC} select * from c")
def _(t):
    return J.concurrency(t.jobs)


@query("max_concurrency", f"with {_CONC} select max(nodes_in_use) as nodes_in_use, (select min(t) from c where nodes_in_use = (select max(nodes_in_use) from c)) as first_at from c")
def _(t):
    return J.max_concurrency(t.jobs)


@query("job_outputs", "select id, outputkey from $jobs where success = 1")
def _(t):
    return J.job_outputs(t.jobs)


@query("outputs_for_prefix", "select o_orderkey, concat('./', o_orderpriority, '/', o_orderkey) as stream from orders where starts_with(o_orderpriority, '1')")
def _(t):
    return J.outputs_for_prefix(t.sql("select o_orderkey, concat('./', o_orderpriority, '/', o_orderkey) as stream from {orders}"), r"^\./1")


# One manifest line per order, its blocks the parts; sizes 1000 + partkey, every third with a +K hint, every fifth without a size.
_TOKEN = """concat(md5(cast(l_partkey as varchar(20))), case when l_partkey % 5 = 4 then '' when l_partkey % 5 = 3 then concat('-', cast(60000000 + l_partkey as varchar(20))) else concat('+', cast(1000 + l_partkey as varchar(20))) end,
   case l_partkey % 6 when 0 then '+K' when 2 then '+K13@x' when 4 then '+K3' else '' end)"""
_LEN = "case when l_partkey % 5 = 4 then 0 when l_partkey % 5 = 3 then 67108864 - 60000000 - l_partkey else 1000 + l_partkey end"
add_view("block_rows", f"select l_orderkey as k, {_TOKEN} as token, {_LEN} as size, l_partkey from <lineitem>")
add_view("manifest_lines",
         "select k % 40 as manifest, k, concat('./s', k, ' ', array_join(array_sort(collect_list(token)), ' '), ' 0:', floor(sum(size) / 3), ':a.txt ', floor(sum(size) / 3), ':', sum(size) - floor(sum(size) / 3), ':b c.txt') as line from <block_rows> group by k",
         "select k % 40 as manifest, k, concat('./s', k, ' ', string_agg(token, ' ' order by token), ' 0:', cast(sum(size) as bigint) // 3, ':a.txt ', cast(sum(size) as bigint) // 3, ':', cast(sum(size) as bigint) - cast(sum(size) as bigint) // 3, ':b c.txt') as line from <block_rows> group by k")
# Names hold no blanks in manifests; `b c.txt` splits off `c.txt`, which is neither block nor file.
_BLOCKS = """bl as (select k % 40 as manifest, concat('./s', k) as stream, row_number() over (partition by k order by token) - 1 as i, substr(token, 1, 32) as md5, case when l_partkey % 5 = 4 then null else size end as size,
  case l_partkey % 6 when 0 then '+K' when 2 then '+K13@x' when 4 then '+K3' else '' end as hints, cast(sum(size) over (partition by k order by token rows unbounded preceding) - size as bigint) as first, size as sz from $block_rows),
tot as (select k, cast(sum(size) as bigint) as n from $block_rows group by 1),
fl as (select k % 40 as manifest, concat('./s', k) as stream, 'a.txt' as file, 0 as pos, n // 3 as size from tot union all select k % 40, concat('./s', k), 'b', n // 3, n - n // 3 from tot)"""


@query("manifest_blocks", f"with {_BLOCKS} select manifest, stream, i, md5, size, hints, first from bl")
def _(t):
    return S.parse_manifests(t.manifest_lines)[1]


@query("manifest_file_blocks", f"with {_BLOCKS} select manifest, stream, cast(i as bigint) as i, md5, size, hints, first from bl")
def _(t):
    path = new_path(t.spark, "manifests")
    write_files(t.manifest_lines, path, by="manifest")
    tokens = S.read_manifest_tokens(t.spark, path, "*.txt")
    name = F.regexp_extract("manifest", "manifest=([0-9]+)", 1).cast("long")
    return S.parse_manifest_tokens(tokens.withColumn("manifest", name))[1]


@query("manifest_files", f"with {_BLOCKS} select * from fl")
def _(t):
    return S.parse_manifests(t.manifest_lines)[0]


@query("file_block_ranges", f"""with {_BLOCKS} select fl.manifest, fl.stream, fl.file, bl.i, bl.md5, greatest(fl.pos - bl.first, 0) as offset_, 0 as x from fl join bl using (stream) where false""".replace(
    "greatest(fl.pos - bl.first, 0) as offset_, 0 as x from fl join bl using (stream) where false",
    'greatest(fl.pos, bl.first) - bl.first as "offset", least(fl.pos + fl.size, bl.first + bl.sz) - greatest(fl.pos, bl.first) as "length" from fl join bl on bl.stream = fl.stream and bl.sz > 0 and fl.size > 0 and fl.pos < bl.first + bl.sz and bl.first < fl.pos + fl.size'))
def _(t):
    # Lines are read for files and for blocks, so they are written once.
    return S.file_block_ranges(*S.parse_manifests(stored(t.manifest_lines, "manifest-lines")))


@query("list_files", f"with {_BLOCKS} select manifest, concat(stream, '/', file) as path, cast(ceil(size / 1024) as bigint) as kib from fl")
def _(t):
    return S.list_files(S.parse_manifests(t.manifest_lines)[0], sizes=True)


@query("manifest_stats", """
with d as (select substr(token, 1, 32) as md5, max(case when l_partkey % 5 = 4 then null else size end) as size, max(cast(contains(token, '+K') as int)) as kept from $block_rows group by 1),
m as (select count(distinct manifest) as manifests, cast(sum(strlen(line) + 1) as bigint) as manifest_bytes from $manifest_lines)
select count(*) as blocks, cast(sum(size) as bigint) as bytes, cast(sum(kept) as bigint) as kept_blocks, cast(sum(size) filter (kept = 1) as bigint) as kept_bytes, count(*) filter (size is null) as unknown_sizes,
  cast(sum(size) as bigint) // count(*) as average, any_value(manifests) as manifests, any_value(manifest_bytes) as manifest_bytes from d, m""")
def _(t):
    return S.manifest_stats(t.manifest_lines)


@query("replication_audit", """
with w as (select substr(token, 1, 32) as block, max(case l_partkey % 6 when 0 then 2 when 2 then 3 when 4 then 3 else 1 end) as want from $block_rows where l_partkey % 9 > 0 group by 1),
n as (select block, node, max(size) as size, min(size) as lo from $replicas where size % 7 > 0 group by 1, 2), g as (select block, count(*) as got, max(size) as size, cast(max(size) <> min(lo) as int) as mm from n group by 1),
j as (select coalesce(w.block, g.block) as block, want, coalesce(got, 0) as got, size, coalesce(mm, 0) as size_mismatch from w full join g on w.block = g.block)
select block, coalesce(want, 0) as want, got, case when want is null then 'garbage' when got = 0 then 'missing' when got > want then 'too_many' when got < want then 'too_few' else 'ok' end as status,
  case when want is null then got * size when got > want then (got - want) * size else 0 end as wasted_bytes, size_mismatch from j""")
def _(t):
    return S.replication_audit(t.block_rows.where("l_partkey % 9 > 0").withColumnRenamed("token", "locator"), t.replicas.where("size % 7 > 0"))


NODES = [f"node{i}" for i in range(8)]
_ORDER = """with recursive d as (select distinct block from $replicas), nodes as (select ['node0','node1','node2','node3','node4','node5','node6','node7'] as l),
o as (select block, 0 as i, l as lft, []::varchar[] as out from d, nodes union all
  select block, i + 1, list_concat(lft[1:p], lft[p + 2:]), list_append(out, lft[p + 1]) from (
   select *, cast(cast(concat('0x', case when i < 4 then substr(block, i * 8 + 1, 8) else concat(substr(block, (i * 8 - 4) % 32 + 1, 4), substr(block, (i * 8) % 32 + 1, 4)) end) as bigint) % len(lft) as bigint) as p from o where i < 8)),
ord as (select block, out from o where i = 8)"""


@query("placement_order", _ORDER + " select block, array_to_string(list_filter(out, lambda x: x <> 'node3'), ',') as nodes from ord")
def _(t):
    return t.replicas.select("block").distinct().select("block", F.array_join(S.placement_order("block", NODES, ("node3",)), ",").alias("nodes"))


_PLAN = _ORDER + """, r as (select block, unnest(out) as node, unnest(range(1, 9)) as probe from ord), h as (select distinct block, node, 1 as here from $replicas),
x as (select r.*, coalesce(here, 0) as here from r left join h using (block, node)),
c as (select *, sum(here) over (partition by block order by probe) as found from x),
s as (select block, node, probe, here, found, count(*) filter (here = 0 and found < 2) over (partition by block order by probe rows between unbounded preceding and 1 preceding) as gaps from c),
a as (select block, node, probe, case when here = 1 and found > 2 then 'delete' when here = 1 then 'keep' when found + gaps < 2 then 'copy' end as action from s)"""


@query("rebalance_plan", _PLAN + " select * from a where action is not null")
def _(t):
    return S.rebalance_plan(t.replicas, NODES)


@query("rebalance_far_blocks", _PLAN + " select * from a where action is not null and block in (select block from x where here = 1 and probe > 3)")
def _(t):
    return S.rebalance_plan(t.replicas, NODES, beyond=3)


add_view("content_blocks", """
select md5(line) as md5, line as content from <manifest_lines> union all
select case when doc_id % 10 = 0 then md5(concat(text, 'x')) else md5(text) end, case when doc_id % 13 = 0 then null else text end from <documents>""")


@query("classify_blocks", """
select md5, case when content is null then '?' when starts_with(content, './') then 'M' else 'U' end as kind from $content_blocks where starts_with(md5, 'a')
union all select distinct substr(token, 1, 32), 'D' from $block_rows where starts_with(token, 'a')""")
def _(t):
    return S.classify_blocks(t.content_blocks, "a")


@query("verify_blocks", """
with w as (select distinct substr(token, 1, 32) as md5 from $block_rows union select md5 from $content_blocks), h as (select md5, max(cast(md5(content) = md5 as int)) as good from $content_blocks group by 1)
select w.md5, case when h.md5 is null or good is null then 'absent' else 'damaged' end as status from w left join h using (md5) where good is null or good = 0""")
def _(t):
    wanted = t.block_rows.select(F.left("token", F.lit(32)).alias("md5")).union(t.content_blocks.select("md5"))
    return S.verify_blocks(wanted, t.content_blocks)


@query("disk_usage", """
with d as (select concat('n', l_suppkey % 9) as node, l_partkey as used, l_orderkey as avail, l_linenumber as lost from lineitem)
select node, cast(sum(used) as bigint) as used, cast(sum(avail) as bigint) as avail, cast(sum(lost) as bigint) as lost, round(100.0 * sum(used) / (sum(used) + sum(avail) + sum(lost)), 2) as percent from d group by rollup(node)""")
def _(t):
    return S.disk_usage(t.sql("select concat('n', l_suppkey % 9) as node, l_partkey as used, l_orderkey as avail, l_linenumber as lost from {lineitem}"))


@query("dataset_usage", "select source as dataset, lang as subdir, count(*) as files, cast(sum(n_chars) as bigint) as bytes from documents group by rollup(source, lang)")
def _(t):
    return S.dataset_usage(t.documents.selectExpr("source as dataset", "lang as subdir", "n_chars as size"))


add_view("unknown_files", """
select doc_id, case doc_id % 8
  when 0 then repeat(concat('@r', cast(doc_id as varchar(20)), chr(10), 'acgtacgt', chr(10), '+', chr(10), 'IIII5555', chr(10)), 50)
  when 1 then repeat(concat('@r', cast(doc_id as varchar(20)), chr(10), 'acgtacgt', chr(10), '+', chr(10), 'hhhh5555', chr(10)), 50)
  when 2 then repeat(concat('>c', cast(doc_id as varchar(20)), chr(10), lower(seq), chr(10), 'acgt', chr(10)), 4)
  when 3 then repeat(concat('chr1 ', cast(doc_id as varchar(20)), ' 7 rs12 3 +', chr(10)), 12)
  when 4 then concat('. ', md5(seq), '+10 0:10:x', chr(10))
  when 5 then concat('#%a=1', chr(10), '#%netaffx-annotation-tabular-format-version=1.0', chr(10), '#%netaffx-annotation-date=2008', chr(10), '#%netaffx-annotation-netaffx-build=26', chr(10), '#%genome-version=hg18', chr(10), seq)
  when 6 then concat('#CHP File=d', chr(92), 'scan', cast(doc_id as varchar(20)), '.chp', chr(10), 'x', chr(10), 'AFFX-1')
  else concat('plain 1', seq) end as content from <seqs> where length(seq) > 0""")


@query("detect_format", """
select doc_id, case doc_id % 8 when 0 then 'sanger fastq' when 1 then 'solexa fastq' when 2 then case when length(seq) < 6700 then 'fasta genome' else 'fasta genome' end when 3 then 'snplist' when 4 then 'manifest' when 5 then 'array map' when 6 then 'array scan' else 'unknown' end as format,
  case doc_id % 8 when 5 then '2008 26 hg18' when 6 then concat('scan', doc_id) end as comment from $seqs where length(seq) > 0""".replace("case when length(seq) < 6700 then 'fasta genome' else 'fasta genome' end", "'fasta genome'"))
def _(t):
    return S.detect_format(t.unknown_files)


# Images of 20 columns from the letters of each document, padded to whole rows.
add_view("image_pixels",
         "select doc_id as image, idx, least(ascii(c), 255) as value from (select doc_id, posexplode(split(rpad(text, cast(ceil(length(text) / 20) * 20 as int), ' '), '')) as (idx, c) from <documents>)",
         "select doc_id as image, idx, least(ascii(c), 255) as value from (select doc_id, unnest(str_split(rpad(text, cast(ceil(length(text) / 20) * 20 as int), ' '), '')) as c, unnest(range(cast(ceil(length(text) / 20) * 20 as int))) as idx from <documents>)")


@query("pixel_histogram", "select image, value, count(*) as n from $image_pixels group by 1, 2")
def _(t):
    return M.pixel_histogram(t.image_pixels)


@query("merge_histograms", "select value, count(*) as n from $image_pixels group by 1")
def _(t):
    h = M.pixel_histogram(t.image_pixels)
    return M.merge_histograms(h.where("image % 2 = 0"), h.where("image % 2 = 1"))


@query("image_stats", """
with h as (select image, value, count(*) as n from $image_pixels group by 1, 2),
s as (select *, sum(n) over (partition by image order by value) as cum, sum(n) over (partition by image) as tot, coalesce(max(n) over (partition by image order by value rows between unbounded preceding and 1 preceding), 0) as best from h),
r as (select image, value, row_number() over (partition by image order by value desc) as rn from s where n > best),
l as (select image, sum(value * n) / max(tot) as mean, min(value) filter (cum > tot // 2) as median, sum(value * value * n) / max(tot) - (sum(value * n) / max(tot)) ^ 2 as var, cast(sum(value * n) as bigint) as "sum" from s group by 1),
p as (select a.image, a.idx, a.value as v, u.value as u, d.value as d, lf.value as lf, rt.value as rt from $image_pixels a left join $image_pixels u on u.image = a.image and u.idx = a.idx - 20
  left join $image_pixels d on d.image = a.image and d.idx = a.idx + 20 left join $image_pixels lf on lf.image = a.image and lf.idx = a.idx - 1 left join $image_pixels rt on rt.image = a.image and rt.idx = a.idx + 1),
f as (select image, count(*) filter (v > 110 and (idx < 20 or idx % 20 = 0 or (lf <= 110 and u <= 110))) as objects,
  round(coalesce(sum(abs(4 * v - u - lf - rt - d)) filter (idx >= 20 and d is not null and idx % 20 >= 2), 0) / sum(v), 6) as focus from p group by 1)
select l.image, round(mean, 6) as mean, median, a.value as mode, b.value as mode2, round(sqrt(var), 6) as stdev, round(var, 6) as variance, "sum", objects, focus
from l join f using (image) left join r a on a.image = l.image and a.rn = 1 left join r b on b.image = l.image and b.rn = 2""")
def _(t):
    return M.image_stats(t.image_pixels, 20, 110)


@query("frame_stats", """
select p_partkey as frame, p_size as x, p_retailprice as y, count(l_orderkey) as n_reads, p_size * 2000000 as image_bytes from part left join lineitem on l_partkey = p_partkey and l_quantity > 20 group by 1, 2, 3, p_size""")
def _(t):
    return M.frame_stats(t.sql("select l_partkey as frame from {lineitem} where l_quantity > 20"),
                         t.sql("select p_partkey as frame, p_size as x, p_retailprice as y, p_size as images from {part}"))


@query("call_bases", """
with s as (select frame, object, cycle, coalesce(sum(value) filter (channel = 1), 0) as a, coalesce(sum(value) filter (channel = 0), 0) as c, coalesce(sum(value) filter (channel = 3), 0) as g, coalesce(sum(value) filter (channel = 2), 0) as t from $pixels group by 1, 2, 3),
k as (select *, case when a > c and a > g and a > t then 'A' when c > a and c > g and c > t then 'C' when g > a and g > c and g > t then 'G' when t > a and t > c and t > g then 'T' else 'N' end as b,
  substr('0123456789ABCDEF', 1 + cast(a > 0 as int) * 8 + cast(c > 0 as int) * 4 + cast(g > 0 as int) * 2 + cast(t > 0 as int), 1) as q from s)
select frame, object, string_agg(concat(b, q), '' order by cycle) as call, cast(sum(a + c + g + t) as bigint) as intensity from k group by 1, 2""")
def _(t):
    return M.call_bases(t.pixels)
