"""Queries over the ready-made compositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import recipes as Z
from .calls_queries import _INREG
from .catalog import query
from .placement_queries import _ANNOT
from .runs_queries import _SUMS

from ..operators import runs as U

_RECALL = f"""
probes as (select p.* from $masked p where sample in ('S0', 'S1') and {_INREG.replace('+ 5', '').replace('- 5', '')}),
reads as (select * from $alignments a where exists (select 1 from probes p where p.chr = a.chr and p.pos between a.start_pos and a.end_pos)),
seqc as (select * from $masked where sample in ('S2', 'S3')),
hit as (select s.chr, s.pos, a.start_pos, upper(substr(a.bases, s.pos - a.start_pos + 1, 1)) as base from (select distinct chr, pos from seqc) s join reads a on a.chr = s.chr and s.pos between a.start_pos and a.end_pos),
b as (select chr, pos, base, count(*) as n, count(distinct start_pos) as sites from hit group by 1, 2, 3),
s as (select chr, pos, cast(sum(n) as bigint) as coverage, max(sites) filter (base = 'A') as a, max(sites) filter (base = 'C') as c, max(sites) filter (base = 'G') as g, max(sites) filter (base = 'T') as t from b group by 1, 2),
rec as (select m.sample, m.chr, m.pos, m.ref, m.ord, case when mask not in (0, 15) and call <> ref and (qual < 20 or coalesce(coverage, 0) < 2
    or (mask & 1 > 0 and ref <> 'A' and coalesce(a, 0) < 2) or (mask & 2 > 0 and ref <> 'C' and coalesce(c, 0) < 2)
    or (mask & 4 > 0 and ref <> 'G' and coalesce(g, 0) < 2) or (mask & 8 > 0 and ref <> 'T' and coalesce(t, 0) < 2)) then 'N' else call end as call
  from seqc m left join s on s.chr = m.chr and s.pos = m.pos)"""


def _report(t):
    c = t.calls
    return Z.concordance_report(c.where("sample in ('S0', 'S1')"), c.where("sample in ('S2', 'S3')"), t.alignments, t.some_regions,
                                t.regions.withColumnRenamed("start_pos", "pos"), min_coverage=2)


@query("concordance_report", f"""with {_RECALL},
x as (select *, row_number() over (partition by sample, chr, pos order by ord, mask) as rn from probes),
y as (select *, instr('XACMGRSVTWYHKDBN', call) - 1 as mask, row_number() over (partition by sample, chr, pos order by ord, instr('XACMGRSVTWYHKDBN', call)) as rn from rec),
p as (select x.sample as x_list, y.sample as y_list, x.mask in (0, 15) as nx, y.mask in (0, 15) as ny, x.mask = y.mask as eq from x join y on x.chr = y.chr and x.pos = y.pos and x.rn = y.rn),
q as (select y_list, x_list, count(*) filter (not nx and not ny and eq) as yes, count(*) filter (not nx and not ny and not eq) as no,
  count(*) filter (nx and not ny) as nocall_x, count(*) filter (ny and not nx) as nocall_y from p group by 1, 2),
r as (select *, case when yes + no > 0 then round(100.0 * yes / (yes + no), 4) end as score from q)
select *, cast(coalesce(score, 0) > 0.9 * max(coalesce(score, 0)) over (partition by y_list) as int) as starred from r""")
def _(t):
    return _report(t)["matrix"]


@query("concordance_report_counts", f"""with {_RECALL}, pop as (select distinct chr, pos from rec where call not in ('N', 'X') and call <> ref),
k as (select c.sample, case when p.chr is null then 'n' else 'y' end as in_list, case when call in ('N', 'X') then 'noc' when call = ref then 'ref' when call in ('A','C','G','T') then 'hom' else 'het' end as k
  from rec c left join pop p on p.chr = c.chr and p.pos = c.pos)
select sample, in_list, count(*) filter (k = 'het') as het, count(*) filter (k = 'hom') as hom, count(*) filter (k = 'ref') as ref, count(*) filter (k = 'noc') as noc,
  count(*) filter (k <> 'noc') as called, count(*) as total from k group by 1, 2""")
def _(t):
    return _report(t)["counts"]


@query("edit_motif_report", f"""with {_SUMS}, s as (select m, n, key as edit, sum(runs) as runs from f where kind = 'edit' group by 1, 2, 3), t as (select m, n, sum(runs) as total from s group by 1, 2)
select t.m, t.n, """ + ", ".join(f"round(100.0 * coalesce(max(runs) filter (edit = '{e}'), 0) / max(total), 2) as \"{e}\"" for e in U.EDITS) + " from t join s on s.m = t.m and s.n = t.n group by t.m, t.n")
def _(t):
    return Z.edit_motif_report(t.aligned)["percent"]


@query("cnv_analysis")
def _(t):
    a = t.alignments
    return Z.cnv_analysis(a.where("is_tumor = 0"), a.where("is_tumor = 1"), mult=1.5)


@query("evidence_report")
def _(t):
    v = t.variant_rows.selectExpr("variant_id", "gene", "amino_acid_change", "dbsnp", "impact", "num", "chromosome as chr",
                                  "case when l_suppkey % 11 = 0 then 'chr1' else chromosome end as part_chr")
    return Z.evidence_report(v, t.latest_rows, t.freq_rows)


@query("exon_placement_report", f"""with {_ANNOT},
fw as (select exon, read_id, "offset", ((case when substr(exon, 2) in ('1','3','5','7','9','11') then length - pos - 1 else pos end) % length + length) % length as pos,
  upper(case when substr(exon, 2) in ('1','3','5','7','9','11') then translate(base, 'acgt', 'tgca') else base end) as b from annot),
r as (select *, row_number() over (partition by exon, pos order by read_id, "offset") as rn, instr('XACMGRSVTWYHKDBN', b) - 1 as m from fw)
select exon, pos, substr('XACMGRSVTWYHKDBN', cast(coalesce(bit_or(m) filter (rn > 1), 0) + 1 as bigint), 1) as call, count(*) filter (rn > 1 and m = 1) as q_a, count(*) filter (rn > 1 and m = 2) as q_c,
  count(*) filter (rn > 1 and m = 4) as q_g, count(*) filter (rn > 1 and m = 8) as q_t from r group by 1, 2""")
def _(t):
    exons = t.sql("select ref as exon, seq, case when ref in ('r1', 'r3', 'r5', 'r7', 'r9', 'r11') then 'R' else 'F' end as strand from {refs}")
    return Z.exon_placement_report(t.exon_reads, exons)


@query("repeat_readmap_ratio", """
with h as (select length(bases) as len, count(*) as n from $reads where grp = 1 or (grp = 2 and read_id % 50 <> 7) group by 1), c as (select len, len * sum(n) over (order by len desc) as bases from h), best as (select arg_max(len, (bases, len)) as l from c),
ok as (select read_id % 50 as key, grp from $reads, best where length(bases) >= l), tm as (select key, count(*) as n from ok where grp = 1 group by 1), nm as (select key, count(*) as n from ok where grp = 2 and key <> 7 group by 1),
rp as (select p_partkey % 40 as key, string_agg(distinct p_brand, '|' order by p_brand) as a from part group by 1)
select coalesce(a, 'NA') as annotation, tm.key, tm.n as tumor, coalesce(nm.n, 0) as normal from tm left join nm using (key) left join rp using (key)""")
def _(t):
    r = t.reads.select((F.col("read_id") % 50).alias("key"), "grp", "flag", "bases", "quals")
    part = lambda cond: r.where(cond).drop("grp")
    return Z.repeat_readmap_ratio(part("grp = 1"), part("grp = 2 and key <> 7"), t.sql("select p_partkey % 40 as key, p_brand as value from {part}"))
