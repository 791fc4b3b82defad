"""Mismatch run, consensus and coverage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import consensus as N, kmers as K, runs as U
from .catalog import query
from .placement_queries import CHUNK, _SIDES, _placed, _ref
from .views import add_view

# Whole documents aligned to an edited copy of themselves; documents of a source repeat as queries.
add_view("aligned", """
select concat('q', cast(case when doc_id % 7 = 0 then doc_id - 1 else doc_id end as varchar(20))) as query, concat('chr', cast(doc_id % 22 as varchar(4))) as chr,
  case when doc_id % 2 = 0 then 'P' else 'M' end as strand, doc_id * 100 as pos_r, 10 + doc_id % 5 as pos_q, source as file,
  case when doc_id % 13 <> 0 then seq end as bp_r,
  case when doc_id % 13 <> 0 then replace(replace(replace(seq, 'gatc', 'ggtc'), 'ttaca', 'ttgca'), 'cctg', 'cctc') end as bp_q from <seqs> where length(seq) > 0""")


def _runs(m, n):
    w = 1 + 2 * m
    return f"""
cnt as (select query, count(bp_q) as c, count(*) as a from $aligned group by 1),
uni as (select al.* from $aligned al join cnt using (query) where c = 1 and bp_q is not null and length(bp_q) > {2 * m}),
pos as (select *, unnest(range({m}, length(bp_q) - {m})) as i from uni),
mm as (select query, chr, strand, pos_r, pos_q, file, i, concat(substr(bp_r, i - {m} + 1, {w}), '}}', substr(bp_q, i - {m} + 1, {w})) as edit from pos
   where substr(bp_r, i + 1, 1) <> substr(bp_q, i + 1, 1)),
lagged as (select *, case when edit = lag(edit) over (partition by query order by i) then 0 else 1 end as st from mm),
isl as (select *, sum(st) over (partition by query order by i) as g from lagged),
runs as (select query, chr, strand, pos_r, pos_q, file, edit, cast(count(*) as int) as n, cast(max(i) - min(i) as int) as span, string_agg(cast(i as varchar), ' ' order by i) as positions
   from isl group by query, chr, strand, pos_r, pos_q, file, g, edit having count(*) >= {n})"""


@query("mismatch_runs", f"with {_runs(1, 2)} select query, chr, strand, pos_r, pos_q, edit, n, span, positions from runs")
def _(t):
    return U.mismatch_runs(t.aligned, 1, 2)


@query("run_summary", f"""with {_runs(1, 2)} select (select count(distinct query) from runs) as unique_hits,
 (select count(*) from cnt where c = 1) - (select count(distinct query) from runs) as unique_misses,
 (select count(*) from cnt where c > 1) as redundant_hits, (select count(*) from cnt where c = 0) as empty_hits""")
def _(t):
    return U.run_summary(t.aligned, 1, 2)


_R0 = _runs(0, 1).strip()
_R1 = _runs(1, 1).replace("cnt", "cnt1").replace("uni ", "uni1 ").replace("from uni)", "from uni1)").replace("pos as (select *, unnest", "pos1 as (select *, unnest").replace(
    "from pos\n", "from pos1\n").replace("mm as", "mm1 as").replace("from mm)", "from mm1)").replace("lagged", "lagged1").replace("isl", "isl1").replace("runs as", "runs1 as")
_GRID = f"""{_R0}, {_R1.strip()},
r as (select query, file, 0 as m, edit as motif, n as len, concat(substr(edit, 1, 1), substr(edit, 3, 1)) as edit from runs
  union all select query, file, 1, edit, n, concat(substr(edit, 2, 1), substr(edit, 6, 1)) from runs1),
grid as (select query, file, m, motif, edit, unnest(range(1, least(len, 5) + 1)) as n from r)"""


def _grid(t):
    return U.edit_grid(t.aligned, (0, 1), (1, 5), keep=("file",))


@query("edit_grid", f"with {_GRID} select * from grid")
def _(t):
    return _grid(t)


_SUMS = f"""{_GRID}, k as (select file, m, n, 'edit' as kind, edit as key from grid union all select file, m, n, 'motif', motif from grid),
f as (select file, m, n, kind, key, count(*) as runs from k group by 1, 2, 3, 4, 5)"""


@query("edit_motif_sums", f"with {_SUMS} select * from f union all select null, m, n, kind, key, cast(sum(runs) as bigint) from f group by 2, 3, 4, 5")
def _(t):
    return U.edit_motif_sums(_grid(t))


@query("percent_of_total", f"""with {_GRID}, s as (select m, n, edit, count(*) as runs from grid where m = 1 group by 1, 2, 3),
t as (select m, n, sum(runs) as total from s group by 1, 2)
select t.m, t.n, """ + ", ".join(f"round(100.0 * coalesce(max(runs) filter (edit = '{e}'), 0) / max(total), 2) as {e}" if e != "at" else
                                  "round(100.0 * coalesce(max(runs) filter (edit = 'at'), 0) / max(total), 2) as \"at\"" for e in U.EDITS) + """
from t join s on s.m = t.m and s.n = t.n group by t.m, t.n""")
def _(t):
    sums = _grid(t).groupBy("m", "n", "edit").agg(F.count(F.lit(1)).alias("runs"))
    return U.percent_of_total(sums, 1)


@query("crosstab", f"""with {_GRID} select edit, """ + ", ".join(
    f"count(*) filter (file = '{c}') as \"{c}\"" for c in ("web", "code", "books", "news")) + " from grid where m = 1 and n = 2 group by edit")
def _(t):
    return U.crosstab(_grid(t).where("m = 1 and n = 2"), "edit", "file", ["web", "code", "books", "news"])


@query("stratified_examples", """
with c as (select o_orderstatus as s, count(*) as c from orders group by 1), w as (select s, cast(floor(0.5 + 50.0 * c / (select sum(c) from c)) as bigint) as want from c)
select o_orderkey, o_orderstatus from (select o_orderkey, o_orderstatus, row_number() over (partition by o_orderstatus order by o_orderkey) as rn from orders) join w on s = o_orderstatus where rn <= want""")
def _(t):
    return U.stratified_examples(t.orders.select("o_orderkey", "o_orderstatus"), 50, "o_orderstatus", ("o_orderkey",))


@query("stratified_examples_floor", """
with c as (select o_orderpriority as s, count(*) as c from orders group by 1), w as (select s, cast(floor(least(77, (select sum(c) from c)) * c / (select sum(c) from c)) as bigint) as want from c)
select o_orderkey, o_orderpriority from (select o_orderkey, o_orderpriority, row_number() over (partition by o_orderpriority order by o_orderkey) as rn from orders) join w on s = o_orderpriority where rn <= want""")
def _(t):
    return U.stratified_examples(t.orders.select("o_orderkey", "o_orderpriority"), 77, "o_orderpriority", ("o_orderkey",), "floor")


@query("run_gap_filter", f"""with {_runs(1, 2)}, g as (select *, list_transform(str_split(positions, ' '), lambda x: cast(x as int)) as p from runs),
d as (select *, list_median(list_transform(range(2, len(p) + 1), lambda k: p[k] - p[k - 1])) as median_gap from g)
select query, edit, n, span, positions, median_gap from d where median_gap >= 5 and span >= 20""")
def _(t):
    return U.run_gap_filter(U.mismatch_runs(t.aligned, 1, 2), 5, 20).select("query", "edit", "n", "span", "positions", "median_gap")


@query("runs_to_bed", f"""with {_runs(1, 2)}, x as (select *, cast(unnest(str_split(positions, ' ')) as int) as p from runs where span >= 100),
c as (select *, case when strand = 'P' then pos_r + p else pos_r - p end as ctr from x)
select query, chr, ctr - 2 as start0, ctr + 1 as end0, concat_ws('|', edit, pos_q + p, strand, span) as name from c""")
def _(t):
    return U.runs_to_bed(U.mismatch_runs(t.aligned, 1, 2))


@query("runs_to_bed_wide", f"""with {_runs(2, 1)}, x as (select *, cast(unnest(str_split(positions, ' ')) as int) as p from runs),
c as (select *, case when strand = 'P' then pos_r + p else pos_r - p end as ctr from x)
select query, chr, ctr - 3 as start0, ctr + 2 as end0, concat_ws('|', edit, pos_q + p, strand, span) as name from c""")
def _(t):
    return U.runs_to_bed(U.mismatch_runs(t.aligned, 2, 1), flank=2, min_span=0)


@query("snap_to_grid", """
with recursive b as (select min(l_extendedprice) as lx, max(l_extendedprice) as hx, min(l_quantity) as ly, max(l_quantity) as hy from lineitem),
vx as (select distinct l_extendedprice as v from lineitem), vy as (select distinct l_quantity as v from lineitem),
ax as (select lx as a, (hx - lx) / 20 / 2 as st from b union all select (select min(v) from vx where v > a + st), st from ax where exists (select 1 from vx where v > a + st)),
ay as (select ly as a, (hy - ly) / 10 / 2 as st from b union all select (select min(v) from vy where v > a + st), st from ay where exists (select 1 from vy where v > a + st))
select l_orderkey, l_extendedprice as x, l_quantity as y, (select max(a) from ax where a <= l_extendedprice) as grid_x, (select max(a) from ay where a <= l_quantity) as grid_y from lineitem""")
def _(t):
    return U.snap_to_grid(t.lineitem.selectExpr("l_orderkey", "l_extendedprice as x", "l_quantity as y"), 20, 10)


@query("cluster_edits")
def _(t):
    return U.cluster_edits(t.aligned.where("bp_q is not null"), 0.01, 2)


@query("tail_probability", """
with a as (select l_orderkey, l_linenumber, (1 + l_suppkey % 19) / 20.0 as p, 5 + l_partkey % 40 as n, 1 + l_linenumber % 5 as k from lineitem),
b as (select *, case when n > 20 and p < 0.05 then 1 else 0 end as poi from a)
select l_orderkey, l_linenumber, n, k, round(greatest(1 - case when poi = 1 then list_sum(list_transform(range(0, k), lambda i: exp(-n * p) * pow(n * p, i) / gamma(i + 1)))
  else list_sum(list_transform(range(0, k), lambda i: round(gamma(n + 1) / gamma(i + 1) / gamma(n - i + 1), 0) * pow(p, i) * pow(1 - p, n - i))) end, 0) + 1e-9, 6) as probability from b""")
def _(t):
    a = t.sql("select l_orderkey, l_linenumber, (1 + l_suppkey % 19) / 20.0D as p, 5 + l_partkey % 40 as n, 1 + l_linenumber % 5 as k from {lineitem}")
    return U.cluster_probability(a, "p", "n", "k").withColumn("probability", F.round(F.col("probability") + 1e-9, 6)).drop("p")


add_view("exon_calls", """
select concat('e', cast(l_partkey % 50 as varchar(4))) as exon, l_orderkey % 400 as pos, substr('ACGTN', cast(1 + l_suppkey % 5 as int), 1) as base,
  cast(l_quantity as bigint) as qual, (l_orderkey * 8 + l_linenumber) * 1000000 + (l_partkey * 101 + l_suppkey) % 1000000 as ord from <lineitem>""")


@query("consensus_by_quality", """
with r as (select *, row_number() over (partition by exon, pos order by qual, ord) as rn, instr('XACMGRSVTWYHKDBN', base) - 1 as m from $exon_calls)
select exon, pos, substr('XACMGRSVTWYHKDBN', cast(coalesce(bit_or(m) filter (rn > 1), 0) + 1 as bigint), 1) as call,
  cast(coalesce(sum(qual) filter (rn > 1 and m = 1), 0) as bigint) as q_a, cast(coalesce(sum(qual) filter (rn > 1 and m = 2), 0) as bigint) as q_c,
  cast(coalesce(sum(qual) filter (rn > 1 and m = 4), 0) as bigint) as q_g, cast(coalesce(sum(qual) filter (rn > 1 and m = 8), 0) as bigint) as q_t from r group by 1, 2""")
def _(t):
    return N.consensus_by_quality(t.exon_calls)


_VOTES = f"""{_SIDES}, pm as (select p.chr, p.pos0 as p, s.mer0 as mer from placed p join sides s using (sample, side) union all
   select p.chr, p.pos1, s.mer1 from placed p join sides s using (sample, side)),
bs as (select chr, p, mer, unnest(range(12)) as i from pm),
votes as (select bs.chr, p + i as pos, least(count(*) filter (substr(mer, i + 1, 1) = 'a'), 255) as a, least(count(*) filter (substr(mer, i + 1, 1) = 'c'), 255) as c,
  least(count(*) filter (substr(mer, i + 1, 1) = 'g'), 255) as g, least(count(*) filter (substr(mer, i + 1, 1) = 't'), 255) as t from bs group by 1, 2),
full_votes as (select v.*, case substr(r.seq, v.pos + 1, 1) when 'a' then 1 when 'c' then 2 when 'g' then 4 else 8 end as ref_mask from votes v join $refs r on r.ref = v.chr)"""


def _votes(t):
    reads, placed = _placed(t)
    return N.consensus_votes(placed.join(reads, ["sample", "side"]), _ref(t), CHUNK)


@query("consensus_votes", f"with {_VOTES} select * from full_votes")
def _(t):
    return _votes(t)


@query("consensus_stats", f"""with {_VOTES} select count(*) as total, count(*) filter (a + c + g + t > 0) as covered,
 count(*) filter ((a = 0 or ref_mask = 1) and (c = 0 or ref_mask = 2) and (g = 0 or ref_mask = 4) and (t = 0 or ref_mask = 8)) as undisputed,
 count(*) filter ((a > 2 and ref_mask <> 1) or (c > 2 and ref_mask <> 2) or (g > 2 and ref_mask <> 4) or (t > 2 and ref_mask <> 8)) as call_snp from full_votes""")
def _(t):
    return N.consensus_stats(_votes(t))


_DEPTH = """ex as (select chr, unnest(range(start_pos, end_pos + 1)) as pos from $alignments), depth as (select chr, pos, count(*) as depth from ex group by 1, 2)"""


@query("depth_of_coverage", f"with {_DEPTH} select * from depth")
def _(t):
    return N.depth_of_coverage(t.alignments)


@query("coverage_survival", f"""with {_DEPTH}, h as (select depth, count(*) as n from depth group by 1), d as (select unnest(range((select max(depth) from h) + 1)) as depth),
s as (select d.depth, case when d.depth = 0 then 3000000 else cast(sum(coalesce(n, 0)) over (order by d.depth desc) as bigint) end as loci from d left join h using (depth))
select depth, loci, round(100.0 * loci / 3000000, 6) as percent from s""")
def _(t):
    return N.coverage_survival(N.depth_of_coverage(t.alignments), 3_000_000)


@query("quality_bins", """
with h as (select least(l_partkey, 1000) as qual, count(*) as total, count(*) filter (l_suppkey % 4 <> l_orderkey % 4) as mm from lineitem group by 1)
select q as qual, coalesce(total, 0) as total, coalesce(mm, 0) as mm from (select unnest(range(1001)) as q) left join h on h.qual = q""")
def _(t):
    rows = t.sql("select l_partkey as qual, l_suppkey % 4 as base, l_orderkey % 4 as ref_base from {lineitem}")
    return N.quality_bins(rows)
