"""Call list and interval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import iupac
from ..operators import calls as C, intervals as I
from ..scale import running_sum, settle
from ..session import stored
from .catalog import query
from .views import _spark, add_view

_MASK = "instr('XACMGRSVTWYHKDBN', {}) - 1"
# `ord` of the derived calls steps by a million per line.
WIDTH = 1 << 40
CALLMASK = _MASK.format("call")

add_view("masked", f"select *, cast({CALLMASK} as int) as mask from <calls>")
add_view("call_lines", """
select sample, ord, case when ord % 3 = 0 then concat(chr, '	', cast(pos as varchar(20)), '	', ref, '	', call)
  when ord % 3 = 1 then concat(chr, '	.	SNP	', cast(pos as varchar(20)), '	', cast(pos as varchar(20)),
                               '	.	+	.	alleles ', ref, '/', substr('ACGT', cast(1 + qual % 4 as int), 1),
                               ';db dbsnp:rs', cast(pos as varchar(20)), ',rs', cast(pos + 7 as varchar(20)))
  else concat('rs', cast(pos as varchar(20)), '	x	', ref, '	', substr('ACGT', cast(1 + qual % 4 as int), 1)) end as line
from <calls>""")
_BITS = "case {} when 'A' then 1 when 'C' then 2 when 'G' then 4 when 'T' then 8 end"
_R, _B = _BITS.format("ref"), _BITS.format("substr('ACGT', cast(1 + qual % 4 as int), 1)")


@query("call_reader", f"""
select sample, chr, pos, cast({CALLMASK} as int) as mask from $calls where ord % 3 = 0
union all select sample, chr, pos, ({_R}) | ({_B}) from $calls where ord % 3 = 1""")
def _(t):
    return C.call_reader(t.call_lines.drop("ord"))


@query("call_reader_rsid", f"""
select sample, chr, pos, cast({CALLMASK} as int) as mask from $calls where ord % 3 = 0
union all select sample, 'rs', unnest([pos, pos + 7]), ({_R}) | ({_B}) from $calls where ord % 3 = 1
union all select sample, 'rs', pos, ({_R}) | ({_B}) from $calls where ord % 3 = 2""")
def _(t):
    return C.call_reader(t.call_lines.drop("ord"), rsid_only=True)


@query("iupac_codes", f"""
select call, cast({CALLMASK} as int) as mask,
  concat_ws('/', case when ({CALLMASK}) & 1 > 0 then 'A' end, case when ({CALLMASK}) & 2 > 0 then 'C' end,
    case when ({CALLMASK}) & 4 > 0 then 'G' end, case when ({CALLMASK}) & 8 > 0 then 'T' end) as bases,
  call as letter,
  bit_or(case ref when 'A' then 1 when 'C' then 2 when 'G' then 4 else 8 end | ({CALLMASK})) as with_ref,
  count(*) as n from $calls group by call""")
def _(t):
    m = iupac.mask("call")
    return (t.calls.groupBy("call").agg(
        F.bit_or(iupac.mask(F.concat("call", "ref"))).alias("with_ref"), F.count(F.lit(1)).alias("n"))
        .select("call", m.alias("mask"), iupac.expand_letter("call").alias("bases"), iupac.letter(m).alias("letter"),
                "with_ref", "n"))


@query("call_class", f"""
select sample, case when call in ('N', 'X') then 'nocall' when bit_count({CALLMASK}) = 1 then 'hom' else 'het' end as class,
  count(*) as n from $calls group by 1, 2""")
def _(t):
    return t.calls.groupBy("sample", iupac.call_class("call").alias("class")).agg(F.count(F.lit(1)).alias("n"))


_PAIRS = """
with r as (select *, row_number() over (partition by sample, chr, pos order by ord, mask) as rn from $masked),
p as (select x.sample as x_list, y.sample as y_list, x.chr, x.pos, x.rn, x.mask as x_mask, y.mask as y_mask,
  case when x.mask in (0, 15) and y.mask in (0, 15) then 'nocall_both' when x.mask in (0, 15) then 'nocall_x'
       when y.mask in (0, 15) then 'nocall_y' when x.mask = y.mask then 'yes' else 'no' end as verdict
  from r x join r y on x.chr = y.chr and x.pos = y.pos and x.rn = y.rn)
"""


@query("concordance_pairs", _PAIRS + "select * from p")
def _(t):
    return C.concordance_pairs(t.masked, t.masked, WIDTH)


@query("concordance_matrix", _PAIRS + """, s as (
  select y_list, x_list, count(*) filter (verdict = 'yes') as yes, count(*) filter (verdict = 'no') as no,
    count(*) filter (verdict = 'nocall_x') as nocall_x, count(*) filter (verdict = 'nocall_y') as nocall_y
  from p group by 1, 2), q as (select *, case when yes + no > 0 then round(100.0 * yes / (yes + no), 4) end as score from s)
select *, cast(coalesce(score, 0) > 0.9 * max(coalesce(score, 0)) over (partition by y_list) as int) as starred from q""")
def _(t):
    return C.concordance_matrix(t.masked, t.masked, WIDTH)


@query("genotype_filter", """
with h as (select * from $masked where sample = 'S0' and bit_count(mask) > 1 and mask <> 15)
select h.* from h where exists (select 1 from $masked o where o.sample = 'S1' and o.chr = h.chr and o.pos = h.pos
     and o.mask not in (0, 15) and o.mask <> h.mask)
  and exists (select 1 from $masked o where o.sample = 'S2' and o.chr = h.chr and o.pos = h.pos)""")
def _(t):
    m = t.masked
    lists = {s: m.where(F.col("sample") == s) for s in ("S1", "S2")}
    return C.genotype_filter(m.where("sample = 'S0'"), [("het",), ("disagree", "S1"), ("isin", "S2")], lists)


@query("genotype_filter_agree", """
select h.* from $masked h where h.sample = 'S0' and h.mask not in (0, 15)
  and exists (select 1 from $masked o where o.sample = 'S1' and o.chr = h.chr and o.pos = h.pos and o.mask = h.mask)
  and exists (select 1 from $masked o where o.sample = 'S2' and o.chr = h.chr and o.pos = h.pos and o.mask not in (0, 15))""")
def _(t):
    m = t.masked
    lists = {s: m.where(F.col("sample") == s) for s in ("S1", "S2")}
    return C.genotype_filter(m.where("sample = 'S0'"), [("call",), ("agree", "S1"), ("call", "S2")], lists)


_POP = """select distinct chr, pos from $calls where call not in ('N', 'X') and call <> ref"""


@query("population_snps", _POP)
def _(t):
    return C.population_snps(t.calls)


@query("population_restrict", f"select * from $calls where sample = 'S3' and (chr, pos) in (select (chr, pos) from ({_POP} and sample = 'S0'))")
def _(t):
    return C.population_restrict(t.calls.where("sample = 'S3'"), C.population_snps(t.calls.where("sample = 'S0'")))


@query("call_stats", f"""
with p as ({_POP} and sample = 'S0'), k as (
  select c.sample, case when p.chr is null then 'n' else 'y' end as in_list,
    case when call in ('N', 'X') then 'noc' when call = ref then 'ref' when call in ('A','C','G','T') then 'hom' else 'het' end as k
  from $calls c left join p on p.chr = c.chr and p.pos = c.pos)
select sample, in_list, count(*) filter (k = 'het') as het, count(*) filter (k = 'hom') as hom,
  count(*) filter (k = 'ref') as ref, count(*) filter (k = 'noc') as noc, count(*) filter (k <> 'noc') as called,
  count(*) as total from k group by 1, 2""")
def _(t):
    return C.call_stats(t.calls, C.population_snps(t.calls.where("sample = 'S0'")))


_PILE = """
with site as (select distinct chr, pos from $calls),
hit as (select s.chr, s.pos, a.start_pos, upper(substr(a.bases, s.pos - a.start_pos + 1, 1)) as base,
     ascii(substr(a.quals, s.pos - a.start_pos + 1, 1)) - 33 as q
  from site s join $alignments a on a.chr = s.chr and s.pos between a.start_pos and a.end_pos)
"""


@query("pileup_join", _PILE + """
select chr, pos, base, count(*) as n_reads, cast(sum(q) as bigint) as qual_sum, count(distinct start_pos) as n_starts
from hit group by 1, 2, 3""")
def _(t):
    return I.pileup_join(t.calls, t.alignments)


@query("skeptic_recall", _PILE + """, b as (
  select chr, pos, base, count(*) as n, count(distinct start_pos) as sites from hit group by 1, 2, 3),
s as (select chr, pos, cast(sum(n) as bigint) as coverage, max(sites) filter (base = 'A') as a, max(sites) filter (base = 'C') as c,
  max(sites) filter (base = 'G') as g, max(sites) filter (base = 'T') as t from b group by 1, 2)
select m.sample, m.chr, m.pos, m.ref, m.call, m.qual, m.ord, coalesce(coverage, 0) as coverage,
  case when mask not in (0, 15) and call <> ref and (qual < 20 or coalesce(coverage, 0) < 3
    or (mask & 1 > 0 and ref <> 'A' and coalesce(a, 0) < 2) or (mask & 2 > 0 and ref <> 'C' and coalesce(c, 0) < 2)
    or (mask & 4 > 0 and ref <> 'G' and coalesce(g, 0) < 2) or (mask & 8 > 0 and ref <> 'T' and coalesce(t, 0) < 2))
  then 'N' else call end as recall
from $masked m left join s on s.chr = m.chr and s.pos = m.pos""")
def _(t):
    return C.skeptic_recall(t.calls, t.alignments, min_coverage=3)


@query("collapse_calls", """
select chr, pos, concat('alleles ', string_agg(call, '/' order by ord desc, call desc, ref desc), '; ref_allele ',
  arg_min(ref, (ord, call, ref))) as attributes from $calls group by chr, pos""")
def _(t):
    return C.collapse_calls(t.calls)


@query("site_union", "select distinct chr, pos from $calls union select distinct chr, start_pos from $regions")
def _(t):
    return C.site_union(t.calls, t.regions.withColumnRenamed("start_pos", "pos"))


_COVERS = "exists (select 1 from p where p.chr = a.chr and p.pos between a.start_pos and a.end_pos)"


@query("interval_semi", f"""
with p as (select chr, pos from $calls where call = 'N')
select * from $alignments a where {_COVERS}""")
def _(t):
    return I.interval_semi(t.alignments, t.calls.where("call = 'N'"))


@query("interval_anti", f"""
with p as (select chr, pos from $calls where call = 'N')
select * from $regions a where not {_COVERS}""")
def _(t):
    return I.interval_semi(t.regions, t.calls.where("call = 'N'"), invert=True)


add_view("point_rows", """
select chr, pos, case when qual % 2 = 0 then pos + 1 end as second, 3 + qual % 3 as n_cols, ord, call from <calls>""")


@query("reference_points", """
with s as (select chr, case when second = pos + 1 then pos + 1 else pos end as pos, second, n_cols, ord, call from $point_rows)
select chr, pos, second, n_cols, ord, call from (select *, row_number() over (partition by chr, pos
  order by n_cols desc, second desc nulls last, ord desc, call desc) as rn from s) where rn = 1""")
def _(t):
    return I.reference_points(t.point_rows)


add_view("probes", """
select sample, chr, pos, ref as allele_a, substr(call, 1, 1) as allele_b,
  case when qual % 2 = 0 then '-' else '+' end as strand, ord as probe_id from <calls>""")
add_view("some_regions", """
select chr, start_pos, case when region_id % 400 = 0 then 0 else end_pos end as end_pos from <regions>""")
_INREG = """exists (select 1 from $some_regions r where r.chr = p.chr and (r.end_pos = 0
  or p.pos between r.start_pos + 5 and r.end_pos - 5))"""


@query("point_in_region", f"""
select p.*, case when strand = '-' then concat(translate(allele_a, 'ACGTMRKY', 'TGCAKYMR'), translate(allele_b, 'ACGTMRKY', 'TGCAKYMR'))
  else concat(allele_a, allele_b) end as alleles from $probes p where {_INREG}""")
def _(t):
    return I.point_in_region(t.probes, t.some_regions, margin=5)


@query("regions_restrict", """
select * from $calls c where exists (select 1 from $regions r where r.chr = c.chr
  and c.pos between r.start_pos - 10 and r.end_pos + 10)""")
def _(t):
    return I.regions_restrict(t.calls, t.regions, padding=10)


@query("interval_join", """
select a.*, r.name as name_r, r.start_pos as start_pos_r, r.end_pos as end_pos_r, r.region_id as region_id_r, r.strand as strand_r
from $alignments a join $regions r on r.chr = a.chr and a.start_pos <= r.end_pos and r.start_pos <= a.end_pos""")
def _(t):
    return I.interval_join(t.alignments, t.regions)


@query("nearest_lookup", """
select c.sample, c.chr, c.pos, c.ord, m.name from $calls c
left join (select chr, start_pos as pos, min(name) as name from $regions group by 1, 2) m on m.chr = c.chr and m.pos = c.pos""")
def _(t):
    return I.nearest_lookup(t.calls.select("sample", "chr", "pos", "ord"), t.regions.withColumnRenamed("start_pos", "pos"))


@query("snplist_to_bed", """
select c.chr, c.pos - 1 as start0, c.pos as end0, coalesce(m.name, '.') as name from $calls c
left join (select chr, start_pos as pos, min(name) as name from $regions group by 1, 2) m on m.chr = c.chr and m.pos = c.pos""")
def _(t):
    named = I.nearest_lookup(t.calls.select("chr", "pos"), t.regions.withColumnRenamed("start_pos", "pos"))
    return I.snplist_to_bed(named)


# Reference sequence of each document cut into 1000-base chunks; calls addressed to documents.
add_view("ref_chunks",
         # Cut by one pass over the text, like the reads.
         """select concat('d', cast(doc_id as string)) as chr, cast(i as bigint) as chunk_no, piece as seq
            from (select doc_id, posexplode(regexp_extract_all(seq, '.{{1,1000}}', 0)) as (i, piece) from <seqs>)""",
         """select concat('d', doc_id) as chr, i as chunk_no, substr(seq, cast(1 + 1000 * i as bigint), 1000) as seq from (
            select doc_id, seq, unnest(range(cast(floor((length(seq) - 1) / 1000) as bigint) + 1)) as i from <seqs> where length(seq) > 0)""")
# Calls and regions fall anywhere on any document's sequence.
_ON_DOCS = "(select *, row_number() over (order by doc_id) - 1 as slot, count(*) over () as slots, length(seq) as letters from <seqs> where length(seq) > 0)"
_DOC_CALLS = """
select concat('d', cast(doc_id as varchar(20))) as chr, 1 + (l_orderkey * 7919 + l_linenumber * 104729) % letters as pos,
  substr('ACGT', cast(1 + l_suppkey % 4 as int), 1) as call, l_orderkey * 8 + l_linenumber as ord
from <lineitem> join {} on slot = (l_partkey * 31 + l_orderkey) % {}"""
_DOC_REGIONS = """
select concat('d', cast(doc_id as varchar(20))) as chr, 1 + (p_partkey * 7919) % letters as start_pos,
  (p_partkey * 7919) % letters + 10 * p_size as end_pos, p_name as name, case when p_size % 2 = 0 then '+' else '-' end as strand,
  p_partkey as region_id from <part> join {} on slot = (p_partkey * 37) % {}"""


def _doc_slots(t):
    """(doc_id, letters, slot): documents with a sequence, numbered from 0 by id; NULL ids come first."""
    letters = t.sql("select doc_id, length(seq) as letters, coalesce(doc_id, -9223372036854775808) as _by from {seqs}")
    # Written, so that the texts are read once for all that numbering needs.
    numbered = running_sum(stored(settle(letters, "letters").where("letters > 0"), "doc-letters"), "_by", F.lit(1), "slot", 1 << 16)
    return stored(numbered.select("doc_id", "letters", (F.col("slot") - 1).alias("slot")), "doc-slots")


def _on_doc_slots(sql):
    """The view over numbered documents: their number is known before the join, so that it is one by equality."""
    def view(t):
        found = t.doc_slots
        return t.sql(_spark(sql.format("<doc_slots>", max(found.count(), 1))))
    return view


add_view("doc_slots", _doc_slots, _ON_DOCS)
add_view("doc_calls", _on_doc_slots(_DOC_CALLS), _DOC_CALLS.format(_ON_DOCS, "slots"))
add_view("doc_regions", _on_doc_slots(_DOC_REGIONS), _DOC_REGIONS.format(_ON_DOCS, "slots"))


@query("attach_ref_base", """
select c.chr, c.pos, c.call, c.ord, upper(substr(s.seq, c.pos, 1)) as ref_allele from $doc_calls c
join $seqs s on c.chr = concat('d', s.doc_id) where substr(s.seq, c.pos, 1) <> '' and c.call <> upper(substr(s.seq, c.pos, 1))""")
def _(t):
    return I.attach_ref_base(t.doc_calls, t.ref_chunks, 1000)


@query("context_slice", """
with x as (select r.*, substr(s.seq, greatest(start_pos - 1 - 8, 0) + 1, end_pos + 8 - greatest(start_pos - 1 - 8, 0)) as f
  from $doc_regions r join $seqs s on r.chr = concat('d', s.doc_id)
  where length(s.seq) > 0 and cast(floor((length(seq) - 1) / 1000) as bigint) >= cast(floor(greatest(start_pos - 1 - 8, 0) / 1000) as bigint))
select chr, start_pos, end_pos, name, strand, region_id,
  case when strand = '-' then reverse(translate(f, 'acgt', 'tgca')) else f end as seq,
  concat(name, '=', chr, '@', start_pos, '-', end_pos) as title from x""")
def _(t):
    return I.context_slice(t.doc_regions, t.ref_chunks, 1000, context=8)


@query("context_fasta", """
with x as (select r.*, substr(s.seq, greatest(start_pos - 1, 0) + 1, end_pos - greatest(start_pos - 1, 0)) as f from $doc_regions r join $seqs s on r.chr = concat('d', s.doc_id)
  where length(s.seq) > 0 and cast(floor((length(seq) - 1) / 1000) as bigint) >= cast(floor((start_pos - 1) / 1000) as bigint)),
y as (select region_id, concat('nn', case when strand = '-' then reverse(translate(f, 'acgt', 'tgca')) else f end, 'n') as q, concat(name, '=', chr, '@', start_pos, '-', end_pos) as title from x)
select region_id, concat('>', title, chr(10), regexp_replace(regexp_replace(q, '(.{50})', '\\1' || chr(10), 'g'), chr(10) || '$', ''), chr(10)) as fasta from y""")
def _(t):
    cut = I.context_slice(t.doc_regions, t.ref_chunks, 1000)
    return cut.select("region_id", I.wrap_fasta(F.col("title"), I.pad_to_query(F.col("seq"), F.lit(2), F.lit(1))).alias("fasta"))
