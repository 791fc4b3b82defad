"""Read selection, conversion and k-mer statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import seq as S
from ..operators import reads as R, sorting as O
from .catalog import query
from .views import add_view

_RC = "reverse(translate({}, 'acgtnACGTN', 'tgcanTGCAN'))"


def rc(e):
    return _RC.format(e)


@query("select_reads", """
with r as (select read_id, replace(bases, 'aaa', 'nnn') as bases, case when read_id % 3 = 0 then upper(bases) else bases end as copy from $reads)
select * from r where not regexp_matches(bases, '(?i)[^acgt]') and not regexp_matches(copy, '^[a-z ]*$')""")
def _(t):
    r = t.sql("""select read_id, replace(bases, 'aaa', 'nnn') as bases, case when read_id % 3 = 0 then upper(bases) else bases end as copy from {reads}""")
    return R.select_reads(r, skip_degenerates=True, skip_no_snps=True)


@query("quality_trim", """
select read_id, flag, case when flag & 16 <> 0 then right(bases, 30) else left(bases, 30) end as bases,
  case when flag & 16 <> 0 then right(quals, 30) else left(quals, 30) end as quals from $reads where length(bases) >= 30""")
def _(t):
    return R.quality_trim(t.reads.select("read_id", "flag", "bases", "quals"), 30)


@query("split_mates", """
select name || '/1' as name, left(bases, 18) as bases, left(quals, 18) as quals from $reads
union all select name || '/2', substr(bases, 19), substr(quals, 19) from $reads""")
def _(t):
    return R.split_mates(t.reads, 18)


@query("revcomp", f"select read_id, {rc('bases')} as rc from $reads")
def _(t):
    return t.reads.select("read_id", S.revcomp("bases").alias("rc"))


# Two 16-letter arms at every fourth letter of a read: all its letters are in one arm or more.
_ARM_ROWS = "select read_id * 2 + i as read_id, substr(bases, cast(1 + 4 * i as int), 16) as arm0, substr(bases, cast(17 + 4 * i as int), 16) as arm1 from (select *, {} as i from {} where length(bases) >= 32)"
_SPARK_STARTS = "explode(sequence(0L, cast(floor((length(bases) - 32) / 4) as bigint)))"
_DUCK_STARTS = "unnest(range(cast(floor((length(bases) - 32) / 4) as bigint) + 1))"
add_view("arms", _ARM_ROWS.format(_SPARK_STARTS, "<reads>"), _ARM_ROWS.format(_DUCK_STARTS, "<reads>"))


@query("both_strands", f"select read_id, 0 as side, arm0, arm1 from $arms union all select read_id, 1, {rc('arm1')}, {rc('arm0')} from $arms")
def _(t):
    return R.both_strands(t.arms, ["arm0", "arm1"])


add_view("color_reads", """
select read_id, concat('T', translate(bases, 'acgt', '0123'), case when read_id % 7 = 0 then '.1' else '2' end) as colors from <reads>
where length(bases) >= 6""")
add_view("color_quals", """
select read_id, concat(cast(read_id % 40 as varchar(4)), ' 12 ', cast(read_id % 31 as varchar(4))) as qual_numbers from <reads> where read_id % 5 <> 0""")
_DECODED = """
with recursive c as (select read_id, colors, [case when x in ('.','4','5','6','N') then 0 else cast(x as int) end for x in str_split(substr(colors, 2), '')] as d from $color_reads),
e as (select read_id, colors, unnest(d) as x, unnest(range(len(d))) as i from c),
p as (select read_id, i, bit_xor(x) over (partition by read_id order by i) as b from e),
dec as (select read_id, string_agg(substr('ACGT', cast(xor(3, cast(b as int)) + 1 as bigint), 1), '' order by i) as bases from p group by 1)
"""


@query("colorspace_decode", _DECODED + """
select c.read_id, c.colors, bases, concat(chr(cast(33 + c.read_id % 40 as int)), '-', chr(cast(33 + c.read_id % 31 as int))) as quals
from $color_reads c join dec on dec.read_id = c.read_id where c.read_id % 5 <> 0""")
def _(t):
    return R.colorspace_decode(t.color_reads, t.color_quals)


add_view("color_mapped", """
select concat(cast(read_id as varchar(20)), case when read_id % 4 = 0 then '' else concat(',', cast(1 + read_id % 25 as varchar(4)), '_',
  case when read_id % 3 = 0 then '-' else '' end, cast(50 + read_id % 1000 as varchar(20))) end) as title, read_id, colors from <color_reads>""")


@query("mapped_colorspace_to_sam", _DECODED + """
, m as (select m.*, dec.bases as b, read_id % 4 <> 0 as mapped, read_id % 3 = 0 as rev, 1 + read_id % 25 as c, 50 + read_id % 1000 as p
  from $color_mapped m join dec using (read_id))
select title as qname, case when not mapped then 4 when rev then 16 else 0 end as flag,
  case when not mapped then '*' when c = 23 then 'chrX' when c = 24 then 'chrY' when c = 25 then 'chrM' else concat('chr', c) end as rname,
  case when not mapped then 0 when rev then 3 - length(colors) + p else p + 1 end as pos, 0 as mapq,
  case when mapped then concat(length(b), 'M') else '*' end as cigar,
  case when mapped and rev then reverse(translate(b, 'ACGT', 'TGCA')) else b end as bases, repeat('I', length(b)) as quals from m""")
def _(t):
    return R.mapped_colorspace_to_sam(t.color_mapped)


@query("chr_rename", """
select o_orderkey, case when k = 23 then 'chrX' when k = 24 then 'chrY' when k = 25 then 'NT_25' else concat('chr', k) end as chr
from (select o_orderkey, 1 + o_custkey % 25 as k from orders)""")
def _(t):
    k = t.sql("select o_orderkey, case when 1 + o_custkey % 25 = 25 then 'NT_25' else cast(1 + o_custkey % 25 as string) end as k from {orders}")
    return k.select("o_orderkey", R.chr_rename("k").alias("chr"))


add_view("sam_rows", """
select read_id as ord, concat('q', cast(cast(floor(read_id / 2) as bigint) as varchar(20))) as name,
  case read_id % 6 when 0 then 65 when 1 then 129 when 2 then 1 when 3 then 1 when 4 then 0 else 81 end as flag, rg,
  bases, quals, case when read_id % 3 > 0 then concat('T', translate(bases, 'acgt', '0123'), '.') end as cs,
  case when read_id % 4 > 0 then quals end as cq from <reads>""")


@query("sam_to_fastq", f"""
with x as (select ord, name, case when flag & 16 <> 0 then {rc('bases')} else bases end as b,
  case when flag & 16 <> 0 then reverse(quals) else quals end as q from $sam_rows where rg = 'rg1')
select ord, concat('@', name, chr(10), b, chr(10), '+', chr(10), q, chr(10)) as fastq from x""")
def _(t):
    return R.sam_to_fastq(t.sam_rows, read_group="rg1").select("ord", "fastq")


@query("sam_to_fastq_colorspace", """
select ord, concat('@', name, chr(10), upper(bases), 'N', chr(10), '+', chr(10), cq, chr(10)) as fastq from $sam_rows where cs is not null and cq is not null""")
def _(t):
    return R.sam_to_fastq(t.sam_rows, color_space=True).select("ord", "fastq")


_MATES = """
with s as (select * from $sam_rows), f as (select name, min(ord) as o from s where flag & 1 <> 0 and flag & 64 <> 0 group by 1),
g as (select name, min(ord) as o from s where flag & 1 <> 0 and flag & 64 = 0 and flag & 128 <> 0 group by 1),
u as (select name, min(ord) as a, max(ord) as b from s where flag & 1 <> 0 and flag & 192 = 0 group by 1)
"""


@query("pair_mates", _MATES + """
select ord, 0 as grp from s where flag & 1 = 0
union all select f.o, 1 from f join g using (name) union all select g.o, 2 from f join g using (name)
union all select u.a, 1 from u left join f using (name) left join g using (name) where f.o is null and g.o is null and a <> b
union all select u.b, 2 from u left join f using (name) left join g using (name) where f.o is null and g.o is null and a <> b""")
def _(t):
    return R.pair_mates(t.sam_rows.select("ord", "name", "flag")).select("ord", "grp")


@query("orphan_counts", _MATES + """
select (select count(*) from f left join g using (name) where g.o is null) as orphans_1,
       (select count(*) from g left join f using (name) where f.o is null) as orphans_2""")
def _(t):
    return R.orphan_counts(t.sam_rows)


add_view("exon_rows", """
select concat(name, '=', chr, '@', cast(start_pos as varchar(20)), '-', cast(end_pos as varchar(20))) as ref, region_id % 50 as pos, region_id,
  chr as c0, start_pos as s0 from <regions>""")


@query("reference_translate", "select c0 as chr, pos + s0 - 1 + 1 - 0 as pos, region_id, c0, s0 from $exon_rows")
def _(t):
    return R.reference_translate(t.exon_rows, in_zero=0)


@query("reference_translate_lookup", """
select r.chr, c.pos % 40 + r.start_pos - 1 + 0 - 1 as pos, c.ord from $doc_calls c
join $doc_regions r on r.region_id = c.ord % 3000 join $seqs s on concat('d', s.doc_id) = r.chr
where substr(replace(s.seq, 'aa', 'nn'), c.pos % 40 + 1, 1) not in ('n', 'x')""")
def _(t):
    lookup = t.sql("""select cast(r.region_id as string) as name, r.chr, r.start_pos, replace(s.seq, 'aa', 'nn') as seq
                      from {doc_regions} r join {seqs} s on concat('d', s.doc_id) = r.chr""")
    rows = t.sql("select cast(ord % 3000 as string) as ref, pos % 40 as pos, ord from {doc_calls}")
    return R.reference_translate(rows, out_zero=0, lookup=lookup, mask=True)


add_view("base_rows", """
select l_orderkey * 8 + l_linenumber as ord, 20 + l_partkey % 30 as length, case when l_suppkey % 2 = 0 then 'F' else 'R' end as strand,
  l_orderkey % 60 as pos, substr('ACGT', cast(1 + l_orderkey % 4 as int), 1) as base, substr('ACGT', cast(1 + l_suppkey % 4 as int), 1) as ref_base from <lineitem>""")


@query("forward_strand", """
with p as (select *, case when strand = 'R' then length - pos - 1 else pos end as q from $base_rows)
select ord, length, strand, ((q % length) + length) % length as pos, case when strand = 'R' then translate(base, 'ACGT', 'TGCA') else base end as base,
 case when strand = 'R' then translate(ref_base, 'ACGT', 'TGCA') else ref_base end as ref_base from p""")
def _(t):
    return R.forward_strand(t.base_rows)


# Sequences with some bases made ambiguous.
add_view("noisy", "select read_id, replace(replace(bases, 'gag', 'gng'), 'taa', 'rra') as bases from <reads>")
_FILL = """
with e as (select read_id, unnest(str_split(bases, '')) as b, unnest(range(len(str_split(bases, '')))) as i from $noisy),
g as (select read_id, i, case when b in ('a','c','g','t') then b end as b from e),
f as (select read_id, i, coalesce(last_value(b ignore nulls) over (partition by read_id order by i),
   first_value(b ignore nulls) over (partition by read_id order by i rows between current row and unbounded following)) as b from g),
s as (select read_id, string_agg(b, '' order by i) as filled from f group by 1)
"""


@query("fill_ambiguous", _FILL + "select n.read_id, n.bases, s.filled from $noisy n join s using (read_id)")
def _(t):
    return R.fill_ambiguous_runs(t.noisy, "bases")


@query("sequence_encode", """
with w as (select doc_id, unnest(range(length(seq) - 7)) as o, seq from $seqs where length(seq) >= 8),
k as (select doc_id, o, translate(substr(seq, o + 1, 8), 'acgt', '0123') as d from w)
select doc_id, o as offset, """ + " + ".join(f"cast(substr(d, {i + 1}, 1) as bigint) * {4 ** (7 - i)}" for i in range(8)) + " as code from k")
def _(t):
    return R.sequence_encode(t.seqs)


@query("sequence_decode", """
select doc_id, o as offset, substr(seq, o + 1, 8) as kmer from (select doc_id, seq, unnest(range(length(seq) - 7)) as o from $seqs where length(seq) >= 8)""")
def _(t):
    return R.sequence_decode(R.sequence_encode(t.seqs)).drop("code")


_RESOLVE = """case when length(translate({0}, 'acgt', '')) = 0 then [{0}]
  when length(translate({0}, 'acgt', '')) = 1 then [regexp_replace({0}, '[^acgt]', x) for x in ['a','c','g','t']] else [] end"""


add_view("noisy_arms", _ARM_ROWS.format(_SPARK_STARTS, "<noisy>"), _ARM_ROWS.format(_DUCK_STARTS, "<noisy>"))


@query("expand_degenerate", f"""
with n as (select * from $noisy_arms),
a as (select read_id, unnest({_RESOLVE.format('arm0')}) as arm0, arm1 from n)
select read_id, arm0, unnest({_RESOLVE.format('arm1')}) as arm1 from a""")
def _(t):
    return R.expand_degenerate(t.noisy_arms)


# All 12-mers of a read side by side, its last one ending with the read; the same in pieces of 7 (seeds) and 6 letters.
_PIECES = "select read_id, substr(bases, cast(1 + greatest(least({k} * i, length(bases) - {k}), 0) as int), {k}) as {name} from (select *, {each} as i from <reads>)"


def _pieces(view, name, k):
    add_view(view, _PIECES.format(k=k, name=name, each=f"explode(sequence(0L, cast(floor((length(bases) - 1) / {k}) as bigint)))"),
             _PIECES.format(k=k, name=name, each=f"unnest(range(cast(floor((length(bases) - 1) / {k}) as bigint) + 1))"))


_pieces("mers12", "mer", 12)
_pieces("mers7", "seed", 7)
_pieces("mers6", "gap_seq", 6)


# Per mer and changed position: the variants are many, their count and ends are few.
@query("substitute_variants", """
with m as (select mer from $mers12 where length(mer) = 12), v as (select mer, i, unnest(['a','c','g','t']) as b from (select *, unnest(range(12)) as i from m)),
x as (select mer, mer as variant, -1 as err from m union all select mer, concat(left(mer, i), b, substr(mer, i + 2)), i from v where substr(mer, i + 1, 1) <> b)
select mer, err, count(*) as n, count(distinct variant) as variants, min(variant) as low, max(variant) as high from x group by 1, 2""")
def _(t):
    # Equal mers are counted first; the variants of a mer's position stay in one row and are never moved.
    mers = t.mers12.where("length(mer) = 12").groupBy("mer").agg(F.count(F.lit(1)).alias("times"))
    return R.substitute_variants(mers, 12, packed=True).select(
        "mer", "err", (F.col("times") * F.size("variant")).alias("n"), F.size(F.array_distinct("variant")).cast("long").alias("variants"),
        F.array_min("variant").alias("low"), F.array_max("variant").alias("high"))


@query("two_letter_gap", """
select * from $mers6 where cast(contains(gap_seq, 'a') as int) + cast(contains(gap_seq, 'c') as int) + cast(contains(gap_seq, 'g') as int)
 + cast(contains(gap_seq, 't') as int) <= 2""")
def _(t):
    return R.two_letter_gap(t.mers6)


@query("fasta_to_fastq", "select length(bases) as n_bases, concat('@', name, chr(10), bases, chr(10), '+', name, chr(10), repeat('I', length(bases)), chr(10)) as fastq from $reads")
def _(t):
    return R.fasta_to_fastq(t.reads, "name")


@query("read_length_hist", "select length(bases) as length, rg, count(*) as n from $reads group by 1, 2")
def _(t):
    return R.read_length_hist(t.reads, "rg")


@query("best_read_length", """
with h as (select cast(o_custkey % 120 as bigint) as len, case when o_custkey % 3 = 0 then '' else '_1' end as sfx, count(*) as n from orders group by 1, 2),
p as (select len, max(n) as n from (select len, n from h where sfx = '' union all select 2 * len, n from h where sfx = '_1') group by 1),
c as (select len, len * sum(n) over (order by len desc) as bases from p)
select cast(arg_max(len, (bases, len)) as bigint) as best_length, cast(max(bases) as bigint) as bases from c""")
def _(t):
    return R.best_read_length(t.sql("""
      select length, suffix, count(*) as n from (
        select o_custkey % 120 as length, explode(case when o_custkey % 3 = 0 then array('') else array('_1', '_2') end) as suffix from {orders})
      group by 1, 2"""))


@query("kmer_counts", """
select source, kmer, count(*) as n from (select source, substr(seq, unnest(range(1, length(seq) - 4)), 6) as kmer from $seqs where length(seq) >= 6)
group by 1, 2""")
def _(t):
    return R.kmer_counts(t.seqs, 6, group="source")


@query("dinucleotide_counts", """
select kmer, count(*) as n from (select substr(seq, unnest(range(1, length(seq))), 2) as kmer from $seqs where length(seq) >= 2) group by 1""")
def _(t):
    return R.kmer_counts(t.seqs, 2)


@query("kmer_coincidence", f"""
select mer, least(count(*), 3) as n, greatest(count(*) - 3, 0) as overflow from (select unnest([arm0, arm1, {rc('arm0')}, {rc('arm1')}]) as mer from $arms) group by 1""")
def _(t):
    return R.kmer_coincidence(t.arms, cap=3)


add_view("seeds", "select read_id, seed from <mers7> union all select doc_id, '' from <documents>")


@query("seed_index", """
select * from $seeds where seed <> '' and seed in (select seed from $seeds group by 1 having count(*) < 12)""")
def _(t):
    return R.seed_index(t.seeds, limit=12)


@query("seed_stats", """
with c as (select seed, count(*) as n from $seeds group by 1)
select cast(coalesce(sum(n) filter (seed <> '' and n < 12), 0) as bigint) as kept, cast(coalesce(sum(n) filter (seed <> '' and n >= 12), 0) as bigint) as skipped,
  cast(coalesce(sum(n) filter (seed = ''), 0) as bigint) as empty from c""")
def _(t):
    return R.seed_stats(t.seeds, limit=12)


@query("seed_occupancy", "select reads, count(*) as seeds from (select seed, count(*) as reads from $seeds group by 1) group by 1")
def _(t):
    return R.seed_occupancy(t.seeds)


@query("read_stats", "select file, count(*) // 4 as reads from $doc_lines group by 1")
def _(t):
    return R.read_stats(t.doc_lines)


@query("placed_stats", "select count(distinct chr) as reads, count(*) as placements from $alignments")
def _(t):
    return R.placed_stats(t.alignments, "chr")


@query("short_probe_table", f"""
with b as (select read_id, 0 as side, bases as s from $reads union all select read_id, 1, {rc('bases')} from $reads)
select read_id, side, substr(s, 1, 12) as mer0, substr(s, 13, 12) as mer1 from b where length(s) >= 24""")
def _(t):
    return R.short_probe_table(t.reads, 12, 2, "bases", "read_id")


@query("partition_by_prefix", f"""
select read_id, 0 as strand, mer, substr(mer, 1, 4) as bin from $mers12
union all select read_id, 1, {rc('mer')}, substr({rc('mer')}, 1, 4) from $mers12""")
def _(t):
    return O.partition_by_prefix(t.mers12)


add_view("probe_hits", """
select case when l_suppkey % 9 = 0 then 'chr1_random' else concat('chr', cast(1 + l_partkey % 22 as varchar(4))) end as chr,
  concat('p', cast(l_partkey as varchar(20))) as probe, 1 + l_linenumber % 2 as qstart, 60 as qend, 60 as qlength, l_suppkey % 3 as mismatches,
  repeat(substr('acgt', cast(1 + l_orderkey % 4 as int), 1), 60) as qseq, concat(repeat(substr('acgt', cast(1 + l_orderkey % 4 as int), 1), 58), 'ac') as hseq,
  l_orderkey as hstart, l_orderkey + 59 as hend from <lineitem>""")
_EXACT = "not contains(chr, '_') and qstart = 1 and mismatches = 0"


@query("exact_hits", f"""
select chr, hstart, hend, probe, concat('>', probe, '=', chr, '@', hstart, '-', hend, chr(10), substr(hseq, 1, 50), chr(10), substr(hseq, 51), chr(10)) as fasta
from $probe_hits where {_EXACT}""")
def _(t):
    return R.exact_hits(t.probe_hits)


@query("exact_hit_stats", f"""
with p as (select probe, count(*) filter (contains(chr, '_')) as a, count(*) filter (not contains(chr, '_') and not (qstart = 1 and mismatches = 0)) as b,
  count(*) filter ({_EXACT}) as c from $probe_hits group by 1)
select cast(sum(a) as bigint) as skip_non_chr, cast(sum(b) as bigint) as skip_non_exact, count(*) filter (c = 1) as placed_once, count(*) filter (c > 1) as placed_more from p""")
def _(t):
    return R.exact_hit_stats(t.probe_hits)


@query("sql_functions", f"""
select source, kmer, {rc('kmer')} as rc, count(*) as n from (select source, substr(bases, unnest(range(1, length(bases) - 6)), 8) as kmer from (select file as source, bases from $reads where length(bases) >= 8)) group by 1, 2""")
def _(t):
    from ..functions.sql import register
    register(t.spark)
    return t.sql("""select r.file as source, k.kmer, revcomp(k.kmer) as rc, count(*) as n from {reads} r, lateral kmers(r.bases, 8) k group by 1, 2, 3""")
