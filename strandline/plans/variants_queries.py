"""Variant dialect, array call, evidence and copy number queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cnv as B, evidence as E, variants as V
from .catalog import query
from .views import add_view

ORD = "(l_orderkey * 8 + l_linenumber) * 1000000 + (l_partkey * 101 + l_suppkey) % 1000000"
CHR = "concat('chr', cast(1 + l_partkey % 22 as varchar(4)))"
LETTER = "substr('ACGTRYKMSWNX', cast(1 + l_orderkey % 12 as int), 1)"
BASE = "substr('ACGT', cast(1 + l_partkey % 4 as int), 1)"
SHAPES = ("'*/-AC'", "'-A/-AC'", "'+T/+T'", "'+GG/*'", "'-CA/-CA'", "'-CAC/-C'", "'+GA/-TT'", "'-AC/-G'", "'x/*'")


def pick(values, by="l_suppkey"):
    return f"case {by} % {len(values)} " + " ".join(f"when {i} then {v}" for i, v in enumerate(values)) + " end"


add_view("consensus_rows", f"""
select {CHR} as chr, 1 + l_orderkey % 100000 as pos, case when l_linenumber % 2 = 0 then '*' else {BASE} end as ref,
  case when l_linenumber % 2 = 0 then {pick(SHAPES)} else {LETTER} end as call, l_suppkey % 9 as shape,
  200 + cast(l_quantity as bigint) * 10 as consq, 400 + cast(l_quantity as bigint) * 5 as snpq, l_partkey % 60 as depth,
  1 as d1, 2 as d2, 3 as d3, 4 as d4, 5 as d5, {ORD} as ord from <lineitem>""")
EXPAND = "case call when 'A' then 'A' when 'C' then 'C' when 'G' then 'G' when 'T' then 'T' when 'R' then 'A/G' when 'Y' then 'C/T' when 'K' then 'G/T' when 'M' then 'A/C' when 'S' then 'C/G' when 'W' then 'A/T' else 'A/C/G/T' end"


@query("snp2gff", f"""
with x as (select *, case when ref <> '*' then {EXPAND} else {pick(["'AC/-'", "'C/-'", "'T'", "'GG/-'", "'-'", "'-/CA'", "'GA/-'", "'-'", "'-'"], 'shape')} end as bp,
  case when ref <> '*' then ref else {pick(["'AC'", "'AC'", "'-'", "'-'", "'CA'", "'CAC'", "'TT'", "'AC'", "'-'"], 'shape')} end as r,
  case when ref <> '*' then pos else pos + {pick(["1", "1", "-1", "-1", "1", "2", "1", "1", "-1"], 'shape')} end as e,
  case when ref <> '*' then null when shape = 7 then 'indel-ref-error' when shape = 8 then 'indel-format-error' end as error from $consensus_rows),
y as (select *, case when ref <> '*' then 'SNP' else 'INDEL' end as f from x where bp <> 'A/C/G/T')
select chr, 'bam' as source, f as feature, pos as start_pos, e as end_pos, '.' as score,
  concat('alleles ', bp, ';ref_allele ', r, ';read_depth ', depth, ';consq ', consq, ';snpq ', snpq, case when f = 'INDEL' then ';call_depth 1,3,2,4,N,5' else '' end) as attributes, error
from y where f <> 'INDEL' or (consq >= 300 and snpq >= 500)""".replace("'AC/-'", "'AC/-'"))
def _(t):
    return V.snp2gff(t.consensus_rows)


PILE = ("'*/-AC'", "'-g/*'", "'*/+T'", "'+ga/*'", "'+CC/+CC'", "'-TA/-TA'", "'+A/-C'")
add_view("pileup_rows", f"""
select {CHR} as chr, 1 + l_orderkey % 100000 as pos, case when l_linenumber % 2 = 0 then '*' else {BASE} end as ref,
  case when l_linenumber % 2 = 0 then {pick(PILE)} else {LETTER} end as alleles, l_suppkey % 7 as shape, cast(cast(l_quantity as bigint) as varchar(9)) as score from <lineitem>""")


@query("pileup2gff", f"""
select chr, 'pileup' as source, case when ref <> '*' then 'SNP' when shape = 6 then null else 'INDEL' end as feature, pos as start_pos,
  case when ref <> '*' then pos else pos + {pick(["1", "0", "-1", "-1", "-1", "1", "null"], 'shape')} end as end_pos, score,
  case when ref <> '*' then concat('alleles ', case when alleles = 'X' then 'N' when alleles = 'N' then 'A/C/G/T' else {EXPAND.replace('case call', 'case alleles')} end, ';ref_allele ', ref, ';orig ', ref, ' ', alleles)
  when shape = 6 then null else concat('alleles ', {pick(["'-/AC'", "'-/g'", "'T/-'", "'ga/-'", "'CC'", "'-'", "''"], 'shape')}, ';ref_allele ',
   {pick(["'AC'", "'g'", "'-'", "'-'", "'-'", "'TA'", "''"], 'shape')}, ';orig * ', alleles) end as attributes from $pileup_rows""")
def _(t):
    return V.pileup2gff(t.pileup_rows)


add_view("sam_snps", f"""
select case when l_suppkey % 10 = 0 then 'NT_0123' else cast(1 + l_partkey % 24 as varchar(4)) end as chr, l_orderkey as pos, {BASE} as ref, {LETTER} as call,
  cast(l_quantity as bigint) as qual, l_suppkey as depth, l_partkey % 24 as c from <lineitem>""")


@query("sam_snp2gff", f"""
select case c when 22 then 'chrX' when 23 then 'chrY' else concat('chr', chr) end as chr, '.' as source, 'SNP' as feature, pos as start_pos, pos as end_pos, qual as score,
  concat('alleles ', {EXPAND}, ';ref_allele ', ref, ';read_depth ', depth) as attributes from $sam_snps where qual >= 20 and chr <> 'NT_0123' and call not in ('N', 'X')""")
def _(t):
    return V.sam_snp2gff(t.sam_snps)


_AB = "substr('ACGT', cast(1 + l_partkey % 4 as int), 1)", "substr('ACGT', cast(1 + l_suppkey % 4 as int), 1)"
add_view("quake_lines", f"""
select concat('0', cast(1 + l_partkey % 24 as varchar(4)), '_00', cast(1 + l_orderkey as varchar(20)), ' ', {_AB[0]}, {_AB[1]}, ' ', cast(cast(l_quantity as bigint) as varchar(9)), '.5') as line,
  l_partkey, l_suppkey, l_orderkey, l_quantity from <lineitem>""")


@query("quake2gff", f"""
select case l_partkey % 24 when 22 then 'chrX' when 23 then 'chrY' else concat('chr', 1 + l_partkey % 24) end as chr, '.' as source, 'SNP' as feature,
  1 + l_orderkey as start_pos, 1 + l_orderkey as end_pos, concat(cast(l_quantity as bigint), '.5') as score,
  concat('alleles ', {_AB[0]}, case when l_partkey % 4 = l_suppkey % 4 then '' else concat('/', {_AB[1]}) end) as attributes from $quake_lines where cast(l_quantity as bigint) + 0.5 >= 10""")
def _(t):
    return V.quake2gff(t.quake_lines, 10)


add_view("snp_rows", f"""
select case when l_suppkey % 7 = 0 then 'chrUn' else {CHR} end as chr, l_orderkey as pos, case when l_linenumber = 5 then 'N' else {_AB[0]} end as ref, concat({_AB[0]}, case when l_linenumber = 3 then '/' else '' end, {_AB[1]}) as call,
  case when l_orderkey % 3 = 0 then concat('dbsnp rs', cast(l_partkey as varchar(20)), ' x') else 'none' end as extra, l_partkey, l_suppkey, l_orderkey from <lineitem>""")


@query("snplist2gff", f"""
select chr, '.' as source, 'SNP' as feature, pos as start_pos, pos as end_pos, '.' as score,
  concat('alleles ', {_AB[0]}, case when l_partkey % 4 = l_suppkey % 4 then '' else concat('/', {_AB[1]}) end, case when ref <> 'N' then concat('; ref_allele ', ref) else '' end,
    case when l_orderkey % 3 = 0 then concat('; dbsnp: rs', l_partkey) else '' end) as attributes
from $snp_rows where chr <> 'chrUn' and not (l_partkey % 4 = l_suppkey % 4 and ref = {_AB[0]})""")
def _(t):
    return V.snplist2gff(t.snp_rows)


add_view("named_bed", f"select {CHR} as chr, l_orderkey as start0, l_orderkey + 1 as end0, concat({BASE}, '>', {LETTER}) as name, {LETTER} as call, {BASE} as ref from <lineitem>")


@query("bed2gff", f"select chr, 'maq' as source, 'SNP' as feature, end0 as start_pos, end0 as end_pos, '.' as score, concat('alleles ', {EXPAND}, ';ref_allele ', ref) as attributes from $named_bed")
def _(t):
    return V.bed2gff(t.named_bed)


add_view("scans", "select concat(case when l_suppkey % 2 = 0 then 'AFFX-' else 'SNP_A-' end, cast(l_partkey as varchar(20))) as probe, concat(substr('ABAN', cast(1 + l_orderkey % 4 as int), 1), substr('AB', cast(1 + l_suppkey % 2 as int), 1)) as ab, l_partkey, l_orderkey, l_suppkey from <lineitem>")
add_view("probe_ref", """
select concat('SNP_A-', cast(p_partkey * 2 as varchar(20))) as probe, concat('chr', cast(1 + p_partkey % 22 as varchar(4))) as chr, p_size * 100 as pos,
  concat(substr('ACGT', cast(1 + p_partkey % 4 as int), 1), substr('ACGT', cast(1 + p_size % 4 as int), 1)) as alleles, p_partkey as ord from <part>
union all select concat('SNP_A-', cast(p_partkey * 2 as varchar(20))), 'chrX', 7, 'AC', p_partkey - 1 from <part> where p_size % 5 = 0""")
_MJ = """with r as (select * from (select *, row_number() over (partition by probe order by ord) as rn from $probe_ref) where rn = 1),
j as (select s.*, concat('SNP_A-', s.l_partkey) as id, r.chr, r.pos, r.alleles from $scans s left join r on r.probe = concat('SNP_A-', s.l_partkey))"""


@query("merge_join_calls", _MJ + """
select chr, pos, substr(alleles, 1, 1) as ref_base, concat(case substr(ab, 1, 1) when 'A' then substr(alleles, 1, 1) when 'B' then substr(alleles, 2, 1) else 'N' end,
  case substr(ab, 2, 1) when 'A' then substr(alleles, 1, 1) else substr(alleles, 2, 1) end) as call, id as probe from j where chr is not null""")
def _(t):
    return V.merge_join_calls(t.scans.select("probe", "ab"), t.probe_ref)[0]


@query("merge_join_counts", _MJ + " select count(chr) as found, count(*) filter (chr is null) as not_found from j")
def _(t):
    return V.merge_join_calls(t.scans.select("probe", "ab"), t.probe_ref)[1]


# Array variants per part: kinds by p_partkey % 3 (plain, deletion, insertion).
add_view("array_manifest", """
select concat('v', cast(p_partkey as varchar(20)), case p_partkey % 3 when 1 then '-DELETION' when 2 then '-INSERTION' else '' end) as name,
  case when p_size % 11 = 0 then '37' else '36' end as build, case when p_size % 13 = 0 then 'MT' when p_size % 17 = 0 then 'XY' else cast(1 + p_partkey % 22 as varchar(4)) end as chr,
  p_size * 1000 as pos, case when p_size % 2 = 0 then 'TOP' else 'BOT' end as strand, case p_partkey % 3 when 0 then 'AC[A/G]TT' else 'AC[-/GAT]TT' end as topseq, p_partkey as ord, p_partkey, p_size from <part>""")
add_view("array_calls", """
select concat('v', cast(l_partkey as varchar(20)), case l_partkey % 3 when 1 then '-DELETION' when 2 then '-INSERTION' else '' end) as name,
  case when l_suppkey % 19 = 0 then '-' when l_partkey % 3 = 0 then substr('ACGI', cast(1 + l_suppkey % 4 as int), 1) else substr('ID', cast(1 + l_suppkey % 2 as int), 1) end as allele_a,
  case when l_partkey % 3 = 0 then substr('ACGT', cast(1 + l_orderkey % 4 as int), 1) else substr('ID', cast(1 + l_orderkey % 2 as int), 1) end as allele_b from <lineitem>""")


@query("array_calls_to_gff", """
with m as (select *, case when chr = 'XY' then 'X' else chr end as c, case when strand = 'TOP' then 'PLUS' else 'MINUS' end as s,
  case p_partkey % 3 when 0 then 'A/G' else 'GAT' end as k, p_partkey % 3 as kind from $array_manifest where chr <> 'MT'),
j as (select a.allele_a, a.allele_b, m.*, case when allele_a = allele_b then allele_a else concat(allele_a, '/', allele_b) end as al from $array_calls a join m using (name)
  where build = '36' and allele_a <> '-' and allele_b <> '-'),
f as (select * from j where not (kind = 1 and al = 'I') and not (kind = 2 and al = 'D') and (kind > 0 or not contains(al, 'I'))),
g as (select *, case when kind = 0 then case when s = 'MINUS' then reverse(translate(al, 'ACGT', 'TGCA')) else al end else replace(replace(al, 'D', '-'), 'I', 'GAT') end as tx,
  concat(';beadchip ', name, ':', build, ':', c, ':', pos, ':', s, ':', k, '--', allele_a, '/', allele_b) as tag,
  case kind when 1 then pos + 2 when 2 then pos - 1 else pos end as e from f)
select concat('chr', c) as chr, 'beadchip' as source, case when kind > 0 then 'INDEL' else 'SNP' end as feature, pos as start_pos, e as end_pos, '.' as score, concat('alleles ', tx, tag) as attributes from g
union all select concat('chr', c), 'beadchip', 'REF', pos, e, '.', concat('alleles ', k, tag) from g where kind > 0 and allele_a <> allele_b""")
def _(t):
    return V.array_calls_to_gff(t.array_calls, t.array_manifest)


add_view("arm_hits", f"""
select concat('p', cast(l_orderkey % 3000 as varchar(20))) as probe, case when l_linenumber % 2 = 0 then 'A' else 'B' end as part, concat('chr', cast(l_partkey % 2 as varchar(4))) as chr,
  case when l_suppkey % 2 = 0 then 100 + (l_partkey * 13) % 5000 else 125 + (l_partkey * 13) % 5000 end as pos0,
  case when l_suppkey % 2 = 0 then 124 + (l_partkey * 13) % 5000 else 101 + (l_partkey * 13) % 5000 end as pos1,
  80 + l_quantity % 20 as identity, 20 + l_linenumber as length, l_suppkey % 5 as mismatches, {ORD} as ord,
  case when l_orderkey % 3000 % 3 > 0 then 'chr1' end as refchr, case when l_orderkey % 3000 % 3 = 2 then 125 + l_orderkey % 50 end as refpos0,
  cast(null as bigint) as refpos1 from <lineitem>""")
_PAIRS = """h as (select *, least(pos0, pos1) as lo, greatest(pos0, pos1) as hi from $arm_hits where identity >= 82 and length >= 21 and mismatches <= 3),
j as (select b.probe, b.chr, a.ord as ord_a, b.ord as ord_b, least(a.lo, b.lo) as start_pos, greatest(a.hi, b.hi) as end_pos, b.lo - a.hi - 1 as "interval", a.pos0 as ap, b.pos0 as bp,
  coalesce(b.refchr = b.chr, true) and coalesce(b.refpos0 in (a.pos1 + 1, a.pos0 + 1), true) as ok
  from h a join h b on a.probe = b.probe and a.chr = b.chr and (a.pos0 < a.pos1) = (b.pos0 < b.pos1) and a.part <> b.part and (b.pos0, b.ord) > (a.pos0, a.ord) and b.lo - a.hi <= 1000),
pairs as (select probe, chr, ord_a, ord_b, start_pos, end_pos, "interval", cast(ok and row_number() over (partition by probe, ok order by chr, bp, ord_b, ap, ord_a) = 1 as int) as correct from j)"""


@query("probe_pairs", f"with {_PAIRS} select * from pairs")
def _(t):
    return V.probe_pairs(t.arm_hits, 1000, 82, 21, 3)


@query("probe_pair_stats", f"""with {_PAIRS}, s as (select probe, sum(correct) as a, sum(1 - correct) as b from pairs group by 1)
select d.probe, cast(coalesce(a, 0) as bigint) as hit_correct, cast(coalesce(b, 0) as bigint) as hit_incorrect from (select distinct probe from $arm_hits) d left join s using (probe)""")
def _(t):
    return V.probe_pair_stats(t.arm_hits, V.probe_pairs(t.arm_hits, 1000, 82, 21, 3))


add_view("variant_rows", f"""
select {ORD} as variant_id, concat('G', cast(l_partkey % 50 as varchar(4))) as gene,
  case when l_linenumber % 4 = 0 then null when l_suppkey % 5 = 0 then concat('R', cast(l_suppkey % 40 as varchar(4)), '*') else concat('A', cast(l_suppkey % 40 as varchar(4)), 'T') end as amino_acid_change,
  concat('rs', cast(l_orderkey % 500 as varchar(20)), ',rs', cast(l_partkey % 700 as varchar(20))) as dbsnp, 'old' as impact, 1 as num, l_partkey, l_suppkey, l_orderkey, {CHR} as chromosome from <lineitem>""")
add_view("latest_rows", """
select concat('G', cast(o_custkey % 50 as varchar(4))) as gene, case when o_orderkey % 3 = 0 then null when o_orderkey % 40 % 5 = 0 then concat('R', cast(o_orderkey % 40 as varchar(4)), 'X') else concat('A', cast(o_orderkey % 40 as varchar(4)), 'T') end as aa_change_short,
  case when o_custkey % 2 = 0 then concat('rs', cast(o_custkey % 700 as varchar(20))) end as dbsnp_id, o_orderkey as ord, case when o_orderkey % 4 > 0 then o_orderpriority end as impact,
  o_custkey as overall_frequency_n, case when o_orderkey % 2 = 0 then 'insufficiently evaluated pathogenic' else 'benign' end as qualified_impact,
  case when o_orderkey % 5 = 0 then 3 end as qualityscore_severity from <orders>""")


@query("evidence_refresh", """
with a as (select * from (select *, row_number() over (partition by gene, aa_change_short order by ord desc) as rn from $latest_rows where aa_change_short is not null) where rn = 1),
r as (select * from (select *, row_number() over (partition by dbsnp_id order by ord desc) as rn from $latest_rows where dbsnp_id is not null) where rn = 1),
j as (select v.*, coalesce(a.ord, r1.ord, r2.ord) as o from $variant_rows v left join a on a.gene = v.gene and a.aa_change_short = replace(v.amino_acid_change, '*', 'X')
  left join r r1 on r1.dbsnp_id = concat('rs', v.l_orderkey % 500) left join r r2 on r2.dbsnp_id = concat('rs', v.l_partkey % 700))
select variant_id, j.gene, amino_acid_change, dbsnp, coalesce(l.impact, j.impact) as impact, coalesce(l.overall_frequency_n, j.num) as num,
  case when o is null then 'N' else 'Y' end as refreshed, l.qualified_impact, case when o is not null then not contains(l.qualified_impact, 'insufficiently') end as suff_eval,
  case when o is not null then concat('-,-,-,-,', coalesce(cast(l.qualityscore_severity as varchar), '-'), ',-,-') end as quality_scores,
  case when o is not null then concat('----', coalesce(cast(l.qualityscore_severity as varchar), '-'), '--') end as variant_quality
from j left join $latest_rows l on l.ord = j.o""")
def _(t):
    v = t.variant_rows.select("variant_id", "gene", "amino_acid_change", "dbsnp", "impact", "num")
    return E.evidence_refresh(v, t.latest_rows)


add_view("freq_rows", """
select concat(cast(1 + p_partkey % 22 as varchar(4)), ':', cast(p_partkey * 10 as varchar(20))) as place, case when p_size % 3 = 0 then 'none' else concat('rs', cast(p_partkey as varchar(20))) end as dbsnp,
  concat('A=', cast(p_size as varchar(4)), '/C=', cast(3 + p_partkey % 9 as varchar(4)), case when p_size % 4 = 0 then '/G=5' else '' end) as alleles, concat('G', cast(p_partkey % 50 as varchar(4))) as gene,
  case p_size % 5 when 0 then 'intron' when 1 then 'coding-synonymous' else 'missense' end as function,
  case when p_size % 2 = 0 then 'THR,ALA' else 'STOP,GLN,ALA' end as aa, concat(cast(p_partkey % 40 as varchar(4)), '/300') as aapos, concat('EA:', cast(p_size as varchar(4))) as detail,
  p_partkey as ord, p_partkey, p_size from <part>""")
_FREQ = """base as (select *, p_size + 3 + p_partkey % 9 + case when p_size % 4 = 0 then 5 else 0 end as total,
   case when p_size % 5 > 1 then case when p_size % 2 = 0 then [concat(gene, ' A', p_partkey % 40, 'T')] else [concat(gene, ' A', p_partkey % 40, 'X'), concat(gene, ' A', p_partkey % 40, 'Q')] end
     when dbsnp <> 'none' then [dbsnp] else {other} end as names from $freq_rows),
al as (select *, unnest(case when p_size % 4 = 0 then [0, 1, 2] else [0, 1] end) as i from base where names is not null),
freqs as (select ord, i as _i, names[i + 1] as name, concat('chr', 1 + p_partkey % 22) as chr, p_partkey * 10 as pos, ['A', 'C', 'G'][i + 1] as allele,
  round([p_size, 3 + p_partkey % 9, 5][i + 1] / total, 9) as freq, detail from al)"""


@query("allele_frequencies", f"with {_FREQ.format(other='[concat(chr(98), 37, chr(58), place)]')} select * from freqs".replace("concat(chr(98), 37, chr(58), place)", "concat('b37:', place)"))
def _(t):
    return E.allele_frequencies(t.freq_rows, build="b37")


@query("allele_freq_join", f"""with {_FREQ.format(other='null')}, best as (select * from (select name, freq, detail, row_number() over (partition by name order by ord desc, _i desc) as rn from freqs where name is not null) where rn = 1)
select v.variant_id, v.gene, v.amino_acid_change, b.freq as esp_freq, b.detail as esp_detail from $variant_rows v left join best b on b.name = concat(v.gene, ' ', v.amino_acid_change) and v.amino_acid_change is not null""")
def _(t):
    return E.allele_freq_join(t.variant_rows.select("variant_id", "gene", "amino_acid_change"), t.freq_rows)


@query("annotate_counts", """
with tm as (select l_partkey % 900 as key, count(*) as n from lineitem where l_suppkey % 2 = 0 group by 1), nm as (select l_partkey % 1100 as key, count(*) as n from lineitem where l_suppkey % 3 = 0 and l_quantity < 10 group by 1),
rp as (select p_partkey % 500 as key, string_agg(distinct p_brand, '|' order by p_brand) as a from part group by 1)
select coalesce(a, 'NA') as annotation, tm.key, tm.n as tumor, coalesce(nm.n, 0) as normal from tm left join nm using (key) left join rp using (key)""")
def _(t):
    tm = t.sql("select l_partkey % 900 as key, count(*) as n from {lineitem} where l_suppkey % 2 = 0 group by 1")
    nm = t.sql("select l_partkey % 1100 as key, count(*) as n from {lineitem} where l_suppkey % 3 = 0 and l_quantity < 10 group by 1")
    return E.annotate_counts(tm, nm, t.sql("select p_partkey % 500 as key, p_brand as value from {part}"))


@query("pair_samples", """
select o_custkey as name, count(*) filter (o_orderkey % 2 = 0) as normal_n, count(*) filter (o_orderkey % 2 = 1) as tumor_n from orders group by 1 having normal_n > 0 and tumor_n > 0""")
def _(t):
    side = lambda k: t.sql("select o_custkey as name, count(*) as n from {orders} where o_orderkey % 2 = " + str(k) + " group by 1")
    n, m = side(0), side(1)
    return E.pair_samples(n.join(m, "name", "left_semi"), m.join(n, "name", "left_semi"))


@query("evidence_by_chromosome", "select sample, chr, pos, ord from $calls where ord % 22 = cast(substr(chr, 4) as bigint) % 22")
def _(t):
    return E.evidence_by_chromosome(t.calls.selectExpr("sample", "chr", "pos", "ord", "concat('chr', case when ord % 22 = 0 then 22 else ord % 22 end) as part_chr"))


# Metadata documents: one per order, mostly of one chromosome.
add_view("metadata_lines", """
select o_orderkey as ord, concat(chr(123), '"chromosomes":["c', cast(o_custkey % 300 as varchar(4)), '"', case when o_orderkey % 4 = 0 then concat(',"c', cast(o_custkey % 300 + 1 as varchar(4)), '"') else '' end,
  '],"match_num":', cast(o_custkey as varchar(9)), ',"ref_all_num":', cast(o_custkey + 10 as varchar(9)), ',"build":"', case when o_custkey % 2 = 0 then 'b36' else 'b37' end, '","extra":', chr(123), '"a":1', chr(125), chr(125)) as json,
  o_custkey as k, o_orderkey % 4 = 0 as two from <orders>""")


# The scan in order: the next input is the first one later on without a chromosome that was seen (at most 301 of them).
@query("merge_metadata", """
with recursive m as (select ord, k, k % 300 as a, case when two then k % 300 + 1 else k % 300 end as b from $metadata_lines),
r as (select ord, k, a, b, [a, b] as seen from m where ord = (select min(ord) from m)
  union all select s.ord, s.k, s.a, s.b, list_concat(seen, [s.a, s.b]) from (
    select min_by(struct_pack(ord := m.ord, k := m.k, a := m.a, b := m.b), m.ord) as s, any_value(r.seen) as seen
    from r join m on m.ord > r.ord and not list_contains(r.seen, m.a) and not list_contains(r.seen, m.b) having count(*) > 0))
select 'chromosomes' as key, 'array' as kind, ord, 0 as i, concat('c', a) as value from r
union all select 'chromosomes', 'array', ord, 1, concat('c', b) from r where b <> a
union all select 'match_num', 'number', null, 0, cast(sum(k) as varchar) from r union all select 'ref_all_num', 'number', null, 0, cast(sum(k + 10) as varchar) from r
union all select 'build', 'string', min(ord), 0, case when k % 2 = 0 then 'b36' else 'b37' end from r group by k % 2
union all select 'called_frac_all', 'ratio', null, 0, cast(round(sum(k) / sum(k + 10), 6) as varchar) from r""")
def _(t):
    return E.merge_metadata(t.metadata_lines.select("ord", "json"))


@query("merge_metadata_single", """
with k as (select ord, k from (select *, row_number() over (partition by k % 300 order by ord) as rn from $metadata_lines where not two) where rn = 1)
select 'chromosomes' as key, 'array' as kind, ord, 0 as i, concat('c', k % 300) as value from k
union all select 'match_num', 'number', null, 0, cast(sum(k) as varchar) from k union all select 'ref_all_num', 'number', null, 0, cast(sum(k + 10) as varchar) from k
union all select 'build', 'string', min(ord), 0, case when k % 2 = 0 then 'b36' else 'b37' end from k group by k % 2
union all select 'called_frac_all', 'ratio', null, 0, cast(round(sum(k) / sum(k + 10), 6) as varchar) from k""")
def _(t):
    return E.merge_metadata(t.metadata_lines.where("not two").select("ord", "json"))


@query("chromosome_metadata", "select concat('c', k % 300) as chr, max(ord) as ord, arg_max(json, ord) as json from $metadata_lines where not two group by 1")
def _(t):
    return E.chromosome_metadata(t.metadata_lines.select("ord", "json"))


_BINS = """b as (select chr, start_pos // 100 as bin, count(*) filter (is_tumor = 0) as normal, count(*) filter (is_tumor = 1) as tumor from $alignments group by 1, 2)"""


def _bins(t):
    a = t.alignments
    return B.cnv_bins(a.where("is_tumor = 0"), a.where("is_tumor = 1"))


@query("cnv_bins", f"with {_BINS} select * from b")
def _(t):
    return _bins(t)


@query("cnv_outliers", """
with p as (select chr, start_pos as pos, count(*) as n from $alignments group by 1, 2),
q as (select *, quantile_cont(n, 0.95) over (partition by chr order by pos range between 100 preceding and 100 following) as l from p)
select chr, pos, n from q where n <= 1.2 * l""")
def _(t):
    p = t.sql("select chr, start_pos as pos, count(*) as n from {alignments} group by 1, 2")
    return B.cnv_outliers(p, mult=1.2)


@query("cnv_segment")
def _(t):
    return B.cnv_segment(_bins(t))


@query("cnv_report", f"""with {_BINS}, w as (select chr, bin // 20 as s, min(bin) as first_bin, max(bin) as last_bin, sum(normal) as normal, sum(tumor) as tumor from b group by 1, 2),
r as (select *, log2(((tumor + 0.5) / (normal + 0.5)) / ((select sum(tumor) from w) / (select sum(normal) from w))) as r from w),
j as (select *, coalesce(cast(abs(r - lag(r) over (partition by chr order by first_bin)) >= 0.2 as int), 1) as j from r),
i as (select *, sum(j) over (partition by chr order by first_bin) as g from j)
select chr, min(first_bin) as first_bin, max(last_bin) as last_bin, cast(sum(normal) as bigint) as normal, cast(sum(tumor) as bigint) as tumor,
  round(log2(((sum(tumor) + 0.5) / (sum(normal) + 0.5)) / ((select sum(tumor) from w) / (select sum(normal) from w))), 5) as log2_ratio from i group by chr, g""")
def _(t):
    b = _bins(t).groupBy("chr", F.floor(F.col("bin") / 20).alias("s")).agg(
        F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"), F.sum("normal").alias("normal"), F.sum("tumor").alias("tumor"))
    return B.cnv_report(b.drop("s"))


add_view("lab_stats", """
select l_suppkey as row_no, sum(l_linenumber) as con, sum(case when l_returnflag = 'R' then 1 else 0 end) as dis, sum(case when l_returnflag = 'A' then 2 else 0 end) as nocall,
  count(*) as het_n, count(*) * 2 as het_y from <lineitem> group by 1""")


@query("align_by_rownum", """
select s.l_suppkey as row_no, s.n as sales_n, s.q as sales_q, p.s_acctbal as account_s_acctbal from (select l_suppkey, count(*) as n, sum(l_quantity) as q from lineitem group by 1) s
full join supplier p on p.s_suppkey = s.l_suppkey""".replace("s.l_suppkey as row_no", "coalesce(s.l_suppkey, p.s_suppkey) as row_no"))
def _(t):
    return E.align_by_rownum({
        "sales": t.sql("select l_suppkey as row_no, count(*) as n, sum(l_quantity) as q from {lineitem} group by 1"),
        "account": t.sql("select s_suppkey as row_no, s_acctbal from {supplier}")})


@query("summary_table", """
with r as (select *, case when con + dis > 0 then 100.0 * con / (con + dis) else 0 end as accuracy, case when con + dis + nocall > 0 then 100.0 * (con + dis) / (con + dis + nocall) else 0 end as coverage from $lab_stats),
m as (select *, 0.0675 * coverage as mb, case when coverage > 0 then het_n * 30 / (0.0675 * coverage) else 0 end as het_n_mb, case when coverage > 0 then het_y * 30 / (0.0675 * coverage) else 0 end as het_y_mb from r)
select row_no, """ + ", ".join(f"round(sum({c}), 2) as {c}" for c in ("con", "dis", "nocall", "het_n", "het_y", "accuracy", "coverage", "mb", "het_n_mb", "het_y_mb")) + " from m group by rollup(row_no)")
def _(t):
    return E.summary_table(t.lab_stats)
