"""k-mer and read placement queries. Reads come from the documents, the reference from the benchmark passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kmers as K, placement as P
from .catalog import query
from .reads_queries import rc
from .views import add_view

CHUNK = 100


def _duck_kmers(view: str, k: int, name: str = "ref", seq: str = "seq") -> str:
    return (f"select {name}, p as pos, substr({seq}, p + 1, {k}) as kmer from (select {name}, {seq}, "
            f"unnest(range(length({seq}) - {k - 1})) as p from {view} where length({seq}) >= {k})")


def _ref(t):
    return K.chunk_sequences(t.refs.withColumnRenamed("ref", "chr"), CHUNK)


def _ref_kmers(t, k, ahead=0):
    return K.all_kmers(_ref(t), k, CHUNK, ahead)


# Two 12-mers 6 letters apart, at every sixth letter of a read: all its letters are in one pair or more.
add_view("pairs", """
select read_id * 2 + i as sample, substr(bases, cast(1 + 6 * i as int), 12) as mer0, substr(bases, cast(19 + 6 * i as int), 12) as mer1
from (select *, explode(sequence(0L, cast(floor((length(bases) - 30) / 6) as bigint))) as i from <reads> where length(bases) >= 30)""",
         """
select read_id * 2 + i as sample, substr(bases, cast(1 + 6 * i as int), 12) as mer0, substr(bases, cast(19 + 6 * i as int), 12) as mer1
from (select *, unnest(range(cast(floor((length(bases) - 30) / 6) as bigint) + 1)) as i from $reads where length(bases) >= 30)""".replace("$reads", "<reads>"))
_VARIANTS = """
(select {id}, mer, mer as variant, -1 as err from {src}
 union all select {id}, mer, concat(left(mer, i), b, substr(mer, i + 2)), i from
   (select *, unnest(['a','c','g','t']) as b from (select *, unnest(range(12)) as i from {src})) where substr(mer, i + 1, 1) <> b)"""


@query("all_kmers", _duck_kmers("$refs", 12, "ref") .replace("select ref,", "select ref as chr,", 1))
def _(t):
    return _ref_kmers(t, 12)


_GAPPED = """
select ref as chr, p * 2 + g - 3 as pos, concat(substr(seq, p + 1, 6), substr(seq, p + 7 + g, 6)) as kmer from (
  select ref, seq, p, unnest([3, 4]) as g from (select ref, seq, unnest(range(length(seq) - 14)) as p from $refs where length(seq) >= 15))
where p + 12 + g <= length(seq)"""


@query("all_gapped_kmers", _GAPPED)
def _(t):
    return K.all_gapped_kmers(_ref(t), 12, 3, 4, 6, CHUNK)


@query("kmer_join", f"""
with m as (select sample, mer0 as mer from $pairs), v as {_VARIANTS.format(id='sample', src='m')}, k as ({_duck_kmers('$refs', 12)})
select sample, mer, k.ref as chr, k.pos, v.err from v join k on k.kmer = v.variant""")
def _(t):
    return K.kmer_join(t.pairs.select("sample", F.col("mer0").alias("mer")), _ref_kmers(t, 12), 12)


@query("kmer_members", f"with k as ({_duck_kmers('$refs', 12)}) select ref as chr, pos, kmer from k where kmer in (select mer0 from $pairs)")
def _(t):
    return K.kmer_members(_ref_kmers(t, 12), t.pairs.select(F.col("mer0").alias("kmer"))).select("chr", "pos", "kmer")


_SIDES = f"""
sides as (select sample, 0 as side, mer0, mer1 from $pairs union all select sample, 1, {rc('mer1')}, {rc('mer0')} from $pairs),
m as (select sample, side, 0 as j, mer0 as mer from sides union all select sample, side, 1, mer1 from sides),
v as {_VARIANTS.format(id='sample, side, j', src='m')},
k as ({_duck_kmers('$refs', 12)}),
hits as (select sample, side, j, ref as chr, pos, err from v join k on kmer = variant),
placed as (select a.sample, a.side, a.chr, a.pos as pos0, b.pos as pos1 from hits a join hits b on a.sample = b.sample and a.side = b.side
  and a.chr = b.chr and a.j = 0 and b.j = 1 and b.pos - a.pos between 12 + 2 and 12 + 10)"""


def _placed(t, **kw):
    from ..operators.reads import both_strands
    reads = both_strands(t.pairs.select("sample", "mer0", "mer1"), ["mer0", "mer1"])
    return reads, P.place_gapped(reads, _ref_kmers(t, 12, 22), 12, [(2, 10)], **kw)


@query("place_gapped", f"with {_SIDES} select * from placed")
def _(t):
    return _placed(t)[1]


@query("place_gapped_first", f"with {_SIDES} select sample, side, chr, min(pos0) as pos0, pos1 from placed group by sample, side, chr, pos1")
def _(t):
    return _placed(t, all_matches=False)[1]


@query("place_gapped_capped", f"""
with {_SIDES} select sample, side, chr, pos0, pos1 from (select *, row_number() over (partition by sample, side order by chr, pos0, pos1) as rn from placed) where rn <= 2""")
def _(t):
    return _placed(t, max_out=2)[1]


def _mm(a, b):
    return " + ".join(f"cast(substr({a}, {i}, 1) <> substr({b}, {i}, 1) as int)" for i in range(1, 13))


def _first(a, b):
    return "case " + " ".join(f"when substr({a}, {i}, 1) <> substr({b}, {i}, 1) then {i - 1}" for i in range(1, 13)) + " else -1 end"


_REPORT = f"""{_SIDES}, rep as (
  select p.*, s.mer0, s.mer1, substr(r.seq, pos0 + 1, 12) as mer0ref, substr(r.seq, pos1 + 1, 12) as mer1ref,
    substr(r.seq, pos0 + 13, pos1 - pos0 - 12) as gap_seq from placed p join sides s using (sample, side) join $refs r on r.ref = p.chr),
report as (select *, {_first('mer0', 'mer0ref')} as snppos0, {_first('mer1', 'mer1ref')} as snppos1,
   {_mm('mer0', 'mer0ref')} as mm0, {_mm('mer1', 'mer1ref')} as mm1 from rep)"""


def _report(t):
    reads, placed = _placed(t)
    return P.place_report(placed, reads, _ref(t), CHUNK, 12, reach=34)


@query("place_report", f"with {_REPORT} select *, mm0 + mm1 as snps from report")
def _(t):
    return _report(t)


@query("two_letter_placement", f"""
with {_REPORT} select sample, side, chr, pos0, pos1, gap_seq from report
where cast(contains(gap_seq, 'a') as int) + cast(contains(gap_seq, 'c') as int) + cast(contains(gap_seq, 'g') as int) + cast(contains(gap_seq, 't') as int) <= 2""")
def _(t):
    from .recipes import two_letter_placement
    return two_letter_placement(t.pairs.select("sample", "mer0", "mer1"), _ref_kmers(t, 12, 22), _ref(t), CHUNK, 12, (2, 10)).select(
        "sample", "side", "chr", "pos0", "pos1", "gap_seq")


# Reads cut from the reference itself, with their origin; every third has one changed letter.
add_view("known_reads", """
select item_id * 1000000000 + i as sample, 0 as aside, ref as aref, 5 * i as apos0, 5 * i + 18 as apos1,
  substr(seq, cast(5 * i + 1 as int), 12) as mer0,
  case when i % 3 = 0 then concat(translate(substr(seq, cast(5 * i + 19 as int), 1), 'acgt', 'cgta'), substr(seq, cast(5 * i + 20 as int), 11)) else substr(seq, cast(5 * i + 19 as int), 12) end as mer1
from (select *, explode(sequence(0L, cast(floor((length(seq) - 30) / 5) as bigint))) as i from <refs> where length(seq) >= 30)""",
         """
select item_id * 1000000000 + i as sample, 0 as aside, ref as aref, 5 * i as apos0, 5 * i + 18 as apos1,
  substr(seq, cast(5 * i + 1 as int), 12) as mer0,
  case when i % 3 = 0 then concat(translate(substr(seq, cast(5 * i + 19 as int), 1), 'acgt', 'cgta'), substr(seq, cast(5 * i + 20 as int), 11)) else substr(seq, cast(5 * i + 19 as int), 12) end as mer1
from (select *, unnest(range(cast(floor((length(seq) - 30) / 5) as bigint) + 1)) as i from <refs> where length(seq) >= 30)""")
_CHECKED = _REPORT.replace("$pairs", "$known_reads") + """, checked as (
  select r.*, cast(k.aref = r.chr and k.aside = r.side and k.apos0 = r.pos0 and k.apos1 = r.pos1 as int) as correct,
    cast(snppos0 <> -1 as int) + cast(snppos1 <> -1 as int) as snps from report r join $known_reads k using (sample)),
stats as (select sample, count(*) filter (correct = 1) as correct, count(*) filter (snps = 0) as snps0, count(*) as total,
  count(*) filter (snps <= 1) as snps1, count(*) filter (correct = 1 and snps = 0) as answer0, count(*) filter (correct = 1 and snps <= 1) as answer1
  from checked group by 1)"""


def _checked(t):
    from .recipes import placement_accuracy
    return placement_accuracy(t.known_reads, _ref_kmers(t, 12, 22), _ref(t), CHUNK, 12, (2, 10))


@query("check_answer_key", f"with {_CHECKED} select sample, side, snps, chr, pos0, pos1, correct from checked")
def _(t):
    return _checked(t)[0].select("sample", "side", "snps", "chr", "pos0", "pos1", "correct")


@query("placement_read_stats", f"with {_CHECKED} select * from stats")
def _(t):
    return _checked(t)[1]


@query("placement_summary", f"""with {_CHECKED}, kept as (select * from stats where total < 8)
select (select count(*) from stats) as reads, (select count(*) from stats where total >= 8) as omitted,
  cast(coalesce(sum(snps0), 0) as bigint) as placements_0, cast(coalesce(sum(snps1), 0) as bigint) as placements_1, cast(coalesce(sum(total), 0) as bigint) as placements_any,
  count(*) filter (snps0 > 0) as reads_0, count(*) filter (snps1 > 0) as reads_1, count(*) filter (total > 0) as reads_any,
  count(*) filter (correct > 0) as reads_correct, count(*) filter (total = 1) as "unique",
  count(*) filter (total = 1 and correct > 0 and snps0 > 0) as unique_correct_0, count(*) filter (total = 1 and correct > 0 and snps1 > 0) as unique_correct_1,
  count(*) filter (total = 1 and correct > 0) as unique_correct, count(*) filter (total = 1 and snps0 > answer0) as unique_wrong_0,
  count(*) filter (total = 1 and snps1 > answer1) as unique_wrong_1, count(*) filter (total = 1 and correct = 0) as unique_wrong from kept""")
def _(t):
    return P.placement_summary(_checked(t)[1], 8)


@query("placement_histogram", f"""with {_CHECKED}, l as (select 'reads' as kind, total as n from stats union all select 'snps1', snps1 from stats union all select 'exact', snps0 from stats)
select cast(floor(log2(n)) as bigint) as p, count(*) filter (kind = 'reads') as reads, count(*) filter (kind = 'snps1') as snps1, count(*) filter (kind = 'exact') as exact
from l where n > 0 group by 1""")
def _(t):
    return P.placement_histogram(_checked(t)[1])


@query("reads_with_placements", f"""with {_SIDES}, g as (select * from placed where pos1 - pos0 - 12 between 4 and 8), n as (select sample, count(*) as n from g group by 1)
select p.sample, g.side, g.chr, g.pos0, g.pos1, coalesce(n.n, 0) as n, case when n.n is null then 'NO_MATCH' else 'PLACED' end as status
from $pairs p left join g on g.sample = p.sample left join n on n.sample = p.sample""")
def _(t):
    return P.reads_with_placements(t.pairs.select("sample"), _placed(t)[1], gap=(4, 8))


_MARK = "concat({})".format(", ".join(
    f"case when substr(a, {i}, 1) = substr(b, {i}, 1) then substr(a, {i}, 1) else upper(substr(a, {i}, 1)) end" for i in range(1, 25)))


@query("placed_with_mismatches", f"""with {_REPORT}, x as (select sample, side, chr, pos0, pos1, concat(mer0, mer1) as a, concat(mer0ref, mer1ref) as b from report),
y as (select *, {_MARK} as marked from x), z as (select *, length(regexp_replace(marked, '[^acgt]', '', 'g')) as n_equal from y),
kept as (select *, 24 - n_equal as n_diff from z where 24 - n_equal <= 1)
select sample, side, chr, pos0, pos1, marked, n_equal, n_diff, count(*) over (partition by sample) as n from kept""")
def _(t):
    rep = _report(t).select("sample", "side", "chr", "pos0", "pos1", F.concat("mer0", "mer1").alias("read_seq"),
                            F.concat("mer0ref", "mer1ref").alias("ref_seq"))
    return P.placed_with_mismatches(rep, max_snps=1).drop("read_seq", "ref_seq")


@query("max_placements", f"""with {_SIDES}, n as (select sample, count(*) as places from placed group by 1)
select n.places, placed.* from placed join n using (sample) where n.places <= 2""")
def _(t):
    from ..operators.sorting import max_placements
    return max_placements(_placed(t)[1], 2)


@query("renumber", """
select doc_id as sample, n_chars from documents union all select item_id + (select max(doc_id) + 1 from documents), length(text) from benchmark
union all select conv_id + (select max(doc_id) + 1 from documents) + (select max(item_id) + 1 from benchmark), length(text) from conversations""")
def _(t):
    from ..operators.sorting import renumber
    return renumber([t.documents.selectExpr("doc_id as sample", "n_chars"), t.benchmark.selectExpr("item_id as sample", "cast(length(text) as bigint) as n_chars"),
                     t.conversations.selectExpr("conv_id as sample", "cast(length(text) as bigint) as n_chars")])


# Two 8-mers 4 letters apart, at every eighth letter of a read.
add_view("pairs8", """
select read_id * 4 + i as sample, substr(bases, cast(1 + 8 * i as int), 8) as mer0, substr(bases, cast(13 + 8 * i as int), 8) as mer1
from (select *, explode(sequence(0L, cast(floor((length(bases) - 20) / 8) as bigint))) as i from <reads> where length(bases) >= 20)""",
         """
select read_id * 4 + i as sample, substr(bases, cast(1 + 8 * i as int), 8) as mer0, substr(bases, cast(13 + 8 * i as int), 8) as mer1
from (select *, unnest(range(cast(floor((length(bases) - 20) / 8) as bigint) + 1)) as i from <reads> where length(bases) >= 20)""")
_CAND = f"""k as ({_duck_kmers('$refs', 8)}), h as (select ref as chr, pos, kmer from k where kmer in (select mer0 from $pairs8)),
c as (select a.chr, a.pos as pos0, b.pos as pos1, a.kmer as mer0, b.kmer as mer1, b.pos - a.pos - 8 as gap, substr(r.seq, a.pos + 9, b.pos - a.pos - 8) as gap_seq
  from h a join h b on a.chr = b.chr and b.pos - a.pos - 8 between 2 and 10 join $refs r on r.ref = a.chr),
cands as (select * from c where cast(contains(gap_seq, 'a') as int) + cast(contains(gap_seq, 'c') as int) + cast(contains(gap_seq, 'g') as int) + cast(contains(gap_seq, 't') as int) <= 2)"""


def _cands(t):
    hits = K.kmer_members(_ref_kmers(t, 8), t.pairs8.select(F.col("mer0").alias("kmer"))).withColumn("err", F.lit(-1))
    return K.candidate_pairs(hits, _ref(t), CHUNK, 8, 2, 10)


@query("candidate_pairs", f"with {_CAND} select *, -1 as err0, -1 as err1 from cands")
def _(t):
    return _cands(t)


@query("verify_candidates", f"with {_CAND} select cands.*, -1 as err0, -1 as err1, p.sample from cands join $pairs8 p using (mer0, mer1)")
def _(t):
    return K.verify_candidates(_cands(t), t.pairs8)


# 24-letter reads on circular exons (the benchmark passages).
add_view("short_reads", """
select inline(case when length(bases) >= 36 then array(a, b) when length(bases) >= 34 then array(a) end) from (select bases,
  named_struct('read_id', read_id * 2, 'bases', case when read_id % 11 = 0 then concat('.', substr(bases, 2, 23)) else
    concat(substr(bases, 1, 6), substr(bases, 21, 6), substr(bases, 7, 6), substr(bases, 27, 6)) end) as a,
  named_struct('read_id', read_id * 2 + 1, 'bases', substr(bases, 13, 24)) as b from <reads>)""",
         """
select read_id * 2 as read_id, case when read_id % 11 = 0 then concat('.', substr(bases, 2, 23)) else
  concat(substr(bases, 1, 6), substr(bases, 21, 6), substr(bases, 7, 6), substr(bases, 27, 6)) end as bases from <reads> where length(bases) >= 34
union all select read_id * 2 + 1, substr(bases, 13, 24) from <reads> where length(bases) >= 36""")
add_view("exon_reads", """
select sample as read_id, concat(substr(concat(seq, seq), cast(apos0 + 1 as int), 6), substr(concat(seq, seq), cast(apos0 + 21 as int), 5), 'a', substr(concat(seq, seq), cast(apos0 + 41 as int), 6),
  substr(concat(seq, seq), cast(apos0 + 60 as int), 6)) as bases from <known_reads> join <refs> on ref = aref where length(seq) >= 70
union all select -1 - read_id, bases from <short_reads>""")


def _split_oracle(m):
    return f"""
seeds as (select ref as exon, concat(substr(s2, p + 1, 6), substr(s2, p + 7 + g, 6)) as key, count(*) as n from (
   select ref, s2, len, p, unnest([13,14,15,16]) as g from (select ref, concat(seq, seq) as s2, length(seq) as len, unnest(range(length(seq) + 30)) as p from $refs where length(seq) > 0))
   where p + 12 + g <= 2 * len group by 1, 2),
good as (select * from $exon_reads where not contains(bases, '.')),
m as (select read_id, 0 as h, substr(bases, 1, 12) as mer from good union all select read_id, 1, substr(bases, 13, 12) from good),
v as {_VARIANTS.format(id='read_id, h', src='m')},
hit as (select read_id, h, exon, variant, cast(err >= 0 as int) as mm, n from v join seeds on key = variant),
both_ as (select a.read_id, a.exon, a.mm + b.mm as mm, concat(a.variant, b.variant) as placed, a.n * b.n as n from hit a join hit b
   on a.read_id = b.read_id and a.exon = b.exon and a.h = 0 and b.h = 1 and a.mm + b.mm <= {m}),
per as (select read_id, cast(sum(n) as bigint) as n_pairs, min(exon) as exon, min(placed) as placed, min(mm) as mm from both_ group by 1),
cls as (select g.read_id, g.bases, case when n_pairs is null then '0' when n_pairs = 1 then 'U' else 'N' end as class, coalesce(n_pairs, 0) as n_pairs,
  case when n_pairs = 1 then exon end as exon, case when n_pairs = 1 then placed end as placed, case when n_pairs = 1 then mm end as mm
  from good g left join per using (read_id))"""


def _exons(t):
    return t.refs.select(F.col("ref").alias("exon"), "seq")


@query("place_split_reads", f"with {_split_oracle(1)} select * from cls")
def _(t):
    return P.place_split_reads(t.exon_reads, _exons(t), 1)


@query("placement_class_stats", f"""with {_split_oracle(1)} select count(*) as total, count(*) filter (class <> '0') as placed, count(*) filter (class = 'U') as "unique",
count(*) filter (class = 'U' and mm = 0) as mm0, count(*) filter (class = 'U' and mm = 1) as mm1, count(*) filter (class = 'U' and mm = 2) as mm2 from cls""")
def _(t):
    return P.placement_class_stats(P.place_split_reads(t.exon_reads, _exons(t), 1))


_ANNOT = f"""{_split_oracle(1)},
u as (select c.*, concat(r.seq, r.seq) as two, length(r.seq) as length from cls c join $refs r on r.ref = c.exon where class = 'U'),
p as (select *, instr(two, substr(placed, 1, 6)) - 1 as p0, instr(two, substr(placed, 13, 6)) - 1 as p2 from u),
q as (select *, instr(substr(two, p0 + 20), substr(placed, 7, 6)) as r1, instr(substr(two, p2 + 20), substr(placed, 19, 6)) as r3 from p),
f as (select *, p0 + 18 + r1 as p1, p2 + 18 + r3 as p3 from q where p0 >= 0 and p2 >= 0 and r1 > 0 and r3 > 0),
ok as (select * from f where p1 - p0 - 6 <= 16 and p3 - p2 - 6 <= 16),
x as (select *, unnest(range(24)) as o from ok),
annot as (select read_id, exon, length, case o // 6 when 0 then p0 when 1 then p1 when 2 then p2 else p3 end + o % 6 as pos,
  substr(bases, o + 1, 1) as base, substr(placed, o + 1, 1) as ref_base, case when substr(bases, o + 1, 1) = substr(placed, o + 1, 1) then 'M' else 'S' end as ms, o as "offset" from x)"""


@query("annotate_bases", f"with {_ANNOT} select * from annot")
def _(t):
    return P.annotate_bases(P.place_split_reads(t.exon_reads, _exons(t), 1), _exons(t))


# Called bases with read ids along short exons: up to 24 bases a read.
add_view("called_bases", """
select concat('e', cast(l_partkey % 50 as varchar(4))) as chr, l_orderkey as read_id, 100 + (l_orderkey % 40) + 3 * l_linenumber as pos,
  min(substr('ACGT', cast(1 + l_suppkey % 4 as int), 1)) as base, min(cast(l_quantity as bigint) * 10) as qual,
  case when l_orderkey % 2 = 0 then 'F' else 'R' end as strand from <lineitem> group by 1, 2, 3, 6""")


@query("dig_alignments", """
with tg as (select distinct chr, pos from $called_bases where base = 'T' and qual > 400),
h as (select distinct b.chr, b.pos as target, b.read_id from $called_bases b join tg using (chr, pos)),
n as (select b.*, h.target from $called_bases b join h on h.chr = b.chr and h.read_id = b.read_id where abs(b.pos - h.target) <= 29),
g as (select chr, target, read_id, min(pos) as first_pos, max(pos) as last_pos, min(strand) as s from n group by 1, 2, 3),
x as (select g.*, unnest(range(first_pos, last_pos + 1)) as p from g)
select x.chr, x.target, x.read_id, first_pos, case when s = 'F' then '+' else '-' end as strand, last_pos - first_pos + 1 as length,
  string_agg(coalesce(n.base, 'n'), '' order by p) as bases, string_agg(coalesce(chr(cast(33 + n.qual // 10 as int)), '.'), '' order by p) as quals
from x left join n on n.chr = x.chr and n.target = x.target and n.read_id = x.read_id and n.pos = x.p group by 1, 2, 3, 4, 5, 6""")
def _(t):
    b = t.called_bases
    return P.dig_alignments(b, b.where("base = 'T' and qual > 400").select("chr", "pos"))


# Four 8-mers of documents against all other text: reference is every document's sequence.
add_view("four_mers", """
select sample as read_id, substr(mer0, 1, 8) as mer0, substr(seq, cast(apos0 + 10 as int), 8) as mer1, substr(seq, cast(apos0 + 61 as int), 8) as mer2,
  case when sample % 2 = 0 then substr(seq, cast(apos0 + 70 as int), 8) else 'acgtacgt' end as mer3 from <known_reads> join <refs> on ref = aref where length(seq) >= apos0 + 80""")


def _dist(m, e):
    return " + ".join(f"cast(substr({m}, {i}, 1) <> substr({e}, {i}, 1) as int)" for i in range(1, 9))


def _mark8(m, e):
    return "concat({})".format(", ".join(f"case when substr({m}, {i}, 1) = substr({e}, {i}, 1) or substr({e}, {i}, 1) = '' then substr({m}, {i}, 1) else upper(substr({m}, {i}, 1)) end" for i in range(1, 9)))


@query("place_four_mers", f"""
with s as (select f.*, r.ref as chr, r.seq, unnest(range(length(r.seq) - 7)) as p from $four_mers f join $refs r on contains(r.seq, f.mer0)),
a as (select *, unnest([9, 10]) as w from s where substr(seq, p + 1, 8) = mer0),
pl as (select * from a where substr(seq, p + w + 1, 8) = mer1),
x as (select *, unnest(range(40, 120)) as o from pl),
h2 as (select * from x where substr(seq, p + o + 1, 8) = mer2), h3 as (select * from x where substr(seq, p + o + 1, 8) = mer3),
ex as (select h2.read_id, h2.chr, h2.p as pos0, h2.w as wobble, 'exact' as kind, h2.p + h2.o as pos2, h3.p + h3.o as pos3, '' as marked from h2 join h3
  on h2.read_id = h3.read_id and h2.chr = h3.chr and h2.p = h3.p and h2.w = h3.w and h3.o - h2.o in (9, 10)),
l2 as (select h2.*, case when {_dist('mer3', 'substr(seq, p + o + 11, 8)')} < {_dist('mer3', 'substr(seq, p + o + 10, 8)')} then 10 else 9 end as d from h2
  where not exists (select 1 from h3 where h2.read_id = h3.read_id and h2.chr = h3.chr and h2.p = h3.p and h2.w = h3.w and h3.o - h2.o in (9, 10))),
l3 as (select h3.*, case when {_dist('mer2', 'substr(seq, p + o - 8, 8)')} < {_dist('mer2', 'substr(seq, p + o - 9, 8)')} then 9 else 10 end as d from h3
  where not exists (select 1 from h2 where h2.read_id = h3.read_id and h2.chr = h3.chr and h2.p = h3.p and h2.w = h3.w and h3.o - h2.o in (9, 10)))
select * from ex
union all select read_id, chr, p, w, 'mer2', p + o, p + o + d, {_mark8('mer3', 'substr(seq, p + o + d + 1, 8)')} from l2
union all select read_id, chr, p, w, 'mer3', p + o - d, p + o, {_mark8('mer2', 'substr(seq, p + o - d + 1, 8)')} from l3""")
def _(t):
    return P.place_four_mers(t.four_mers, _ref(t), CHUNK, window=(40, 120))


add_view("marked_mers", """
select concat('chr', cast(l_suppkey % 3 as varchar(4))) as chr, l_orderkey % 700 as pos, l_partkey as read_id,
  case l_linenumber % 4 when 0 then 'acgTacga' when 1 then 'acgAacga' when 2 then 'aCgaacgG' else 'Gcgaacga' end as marked from <lineitem>""")


@query("vote_pileup", """
with s as (select chr, pos + case l when 0 then 3 when 1 then 3 else 0 end as pos, read_id, case l when 0 then 8 when 1 then 1 else 4 end as m
  from (select concat('chr', l_suppkey % 3) as chr, l_orderkey % 700 as pos, l_partkey as read_id, l_linenumber % 4 as l from lineitem) where l <> 2),
r as (select chr, pos, read_id, bit_or(m) as m from s group by 1, 2, 3),
v as (select chr, pos, count(*) filter (m = 1) as a, count(*) filter (m = 2) as c, count(*) filter (m = 4) as g, count(*) filter (m = 8) as t, count(*) as n_reads from r group by 1, 2),
o as (select *, list_reverse_sort([a, c, g, t]) as l from v)
select chr, pos, a, c, g, t, n_reads, round(l[1] / (1 + l[2] + l[3]), 6) as ratio from o where round(l[1] / (1 + l[2] + l[3]), 6) >= 0.8""")
def _(t):
    return P.vote_pileup(t.marked_mers, 0.8)


add_view("doc_reads", """
select distinct read_id, concat('d', cast(doc_id as varchar(20))) as chr, start_pos, translate(bases, 'x', 'a') as bases, repeat('5', length(bases)) as quals from (
  select l_orderkey * 8 + l_linenumber as read_id, doc_id, 1 + l_partkey % 400 as start_pos,
    case when l_linenumber = 1 then reverse(substr(seq, cast(1 + l_partkey % 400 as int), 40)) else replace(substr(seq, cast(1 + l_partkey % 400 as int), 40), 'aca', 'aga') end as bases
  from <lineitem> join <seqs> on doc_id = l_suppkey * 3 + l_linenumber where length(seq) >= 500)""")


@query("mismatch_scan", """
with r as (select a.*, lower(substr(concat('  ', s.seq), start_pos, length(bases) + 4)) as f from $doc_reads a join $seqs s on a.chr = concat('d', s.doc_id) where start_pos >= 2),
r2 as (select *, case when start_pos = 2 then concat(' ', substr(f, 2)) else f end as ref from r),
x as (select *, concat(substr(ref, 1, 2), bases) as sq, unnest(range(2, 42)) as i from r2),
d as (select * from x where i < length(sq) and substr(sq, i + 1, 1) <> substr(ref, i + 1, 1)),
n as (select read_id, bases, start_pos, chr, count(*) as n from d group by 1, 2, 3, 4)
select d.read_id, d.chr, 'mismatch' as type, d.start_pos + i - 2 as pos, ascii('5') - 33 as qual,
  concat(substr(ref, i - 1, 5), ' ', substr(sq, i - 1, 5)) as context from d join n using (read_id, bases, start_pos, chr) where n <= 20
union all select n.read_id, n.chr, 'over-mismatch', n.start_pos, null, null from n where n > 20""")
def _(t):
    chunks = K.chunk_sequences(t.seqs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chr"), "seq"), 1000, margin=60)
    return P.mismatch_scan(t.doc_reads, chunks, 1000)


add_view("flagged", "select *, case when read_id % 3 = 0 then '0' when read_id % 3 = 1 then '5' else '800000001' end as bitmap from <alignments>")


@query("alignments_to_gff", """
select chr, 'placed-read' as type, start_pos, start_pos + 35 as end_pos, mapq as score, strand,
  concat('R ', read_id, strand, ' ; Q illumina "', quals, '"', case when bitmap = '0' then concat(' ; S "', bases, '"')
    when bitmap = '5' then concat(' ; M ', substr(bases, 36, 1), substr(bases, 34, 1), ' 35,33')
    else concat(' ; M ', substr(bases, 36, 1), substr(bases, 1, 1), ' 35,0') end) as attributes, start_pos // 1000000 as bucket
from $flagged where flag = 18""")
def _(t):
    return P.alignments_to_gff(t.flagged)
