"""Read placement on a reference and the tables derived from placements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import iupac, seq as S
from ..scale import lookup, settle
from ..session import stored
from .kmers import KmerIndex, code_differences, code_test, explode_kmers, glued, mer_codes, pairs_within, reference_slice, widened


def place_gapped(reads: DataFrame, ref_kmers: DataFrame, k: int, gaps: list[tuple[int, int]], snps: int = 1,
                 all_matches: bool = True, max_out: int | None = None, id: str = "sample") -> DataFrame:
    """Positions pos0..posM where every read mer matches the reference with at
    most one substitution and k+gmin <= pos[i+1]-pos[i] <= k+gmax.

    `reads` has `id` (with `side`, if there, one row each) and mer0..merM. The
    first mer's hits come from an equi-join on the k-mer, the others chain by
    position; `ref_kmers` of `all_kmers(..., ahead=)` need no lookup for that.
    """
    n = len(gaps) + 1
    keys = [id] + (["side"] if "side" in reads.columns else [])
    # Only the first mer is widened. The letters behind a hit come with it, if the index has enough of them: the positions the gap
    # allows are compared in the row. Else they are looked up by position; a gap with more positions than a mer has neighbours takes
    # the mer's own hits instead.
    reach = sum(hi + k for _, hi in gaps)
    has = "ahead" in ref_kmers.columns and ref_kmers.schema["ahead"].metadata.get("letters", 0) >= reach
    index = KmerIndex(ref_kmers if has else ref_kmers.select("chr", "pos", "kmer"), k)
    # Every mer must have a hit, so reads go by all of them before the first is widened.
    reads = index.near(reads, snps, *[f"mer{i}" for i in range(1, n)])

    def at(i, *more):
        return index.hits(reads.select(*keys, F.col(f"mer{i}").alias("mer"), *more), snps).drop("mer", "err").withColumnRenamed("pos", f"pos{i}")

    def coded(i):
        return [*mer_codes(f"mer{i}", f"_c{i}", f"_a{i}"), (F.length(f"mer{i}") == k).alias(f"_ok{i}")]

    if has:
        out = at(0, *[c for i in range(1, n) for c in coded(i)])
        for i, (lo, hi) in enumerate(gaps):
            skip = F.col(f"pos{i}") - F.col("pos0")
            out = out.withColumn("_g", F.explode(F.sequence(F.lit(lo), F.lit(hi)))).withColumn(f"pos{i + 1}", F.col(f"pos{i}") + k + F.col("_g"))
            there = F.substr("ahead", (skip + F.col("_g") + 1).cast("int"), F.lit(k))
            near = F.bit_count(code_differences(S.kmer_code(there), F.col(f"_c{i + 1}"), F.col(f"_a{i + 1}"), k)) <= min(snps, 1)
            out = out.where(F.col(f"_ok{i + 1}") & (F.length(there) == k) & near).drop("_g")
    else:
        out = at(0)
        places = ref_kmers.select("chr", "pos", "kmer")
        for i, (lo, hi) in enumerate(gaps):
            here, there = f"pos{i}", f"pos{i + 1}"
            if hi - lo > 3 * k:
                out = pairs_within(out, at(i + 1), keys + ["chr"], here, there, k + lo, k + hi)
                continue
            mer = reads.select(*keys, F.lower(f"mer{i + 1}").alias("_mer"))
            ahead = (out.join(mer, keys).withColumn("pos", F.explode(F.sequence(F.col(here) + k + lo, F.col(here) + k + hi)))
                     .join(places, ["chr", "pos"]).where(S.mismatches("_mer", "kmer") <= min(snps, 1)))
            out = ahead.withColumnRenamed("pos", there).drop("_mer", "kmer")
    cols = [f"pos{i}" for i in range(n)]
    if not all_matches:
        out = (out.groupBy(*keys, "chr", cols[-1]).agg(F.min(F.struct(*cols)).alias("_first"))
               .select(*keys, "chr", "_first.*"))
    if max_out:
        rank = F.row_number().over(W.partitionBy(*keys).orderBy("chr", *cols))
        out = out.withColumn("_rn", rank).where(F.col("_rn") <= max_out).drop("_rn")
    return out.select(*keys, "chr", *cols)


def place_report(placements: DataFrame, reads: DataFrame, chunks: DataFrame, chunk: int, k: int, n_mers: int = 2,
                 gap_letters: int = 32, id: str = "sample", reach: int | None = None) -> DataFrame:
    """Placements with read mers, reference mers, gap contents, mismatch positions and count.

    With `reach`, the most letters from the first mer's start to the last one's end, all comes from one reference slice per placement.
    """
    keys = [id] + (["side"] if "side" in placements.columns and "side" in reads.columns else [])
    out = placements.join(reads, keys)
    last = F.col(f"pos{n_mers - 1}")
    if reach:
        out = reference_slice(out, chunks, chunk, F.col("pos0"), last - F.col("pos0") + k, "_all", most=reach)

    def cut(out, at, size, name):
        if not reach:
            return reference_slice(out, chunks, chunk, at, size, name)
        return out.withColumn(name, F.substr("_all", (at - F.col("pos0") + 1).cast("int"), size.cast("int")))

    for i in range(n_mers):
        out = cut(out, F.col(f"pos{i}"), F.lit(k), f"mer{i}ref")
        out = out.withColumn(f"snppos{i}", S.first_mismatch(f"mer{i}", f"mer{i}ref"))
        out = out.withColumn(f"mm{i}", S.mismatches(f"mer{i}", f"mer{i}ref"))
    if n_mers > 1:
        size = F.least(F.col("pos1") - F.col("pos0") - k, F.lit(gap_letters))
        out = cut(out, F.col("pos0") + k, size, "gap_seq")
    return out.drop("_all").withColumn("snps", sum((F.col(f"mm{i}") for i in range(n_mers)), F.lit(0)))


def decode_small_gap(code, gap_min: int, gap_max: int):
    """(position, gap size) of a gapped position code."""
    return F.floor(code / (1 + gap_max - gap_min)), gap_min + code % (1 + gap_max - gap_min)


def check_answer_key(df: DataFrame, n_mers: int = 2) -> DataFrame:
    """`correct`: placed on the known reference, side and positions; `snps`: mers with a mismatch."""
    ok = (F.col("aref") == F.col("chr")) & (F.col("aside") == F.col("side"))
    for i in range(n_mers):
        ok = ok & (F.col(f"apos{i}") == F.col(f"pos{i}"))
    snps = sum(((F.col(f"snppos{i}") != -1).cast("int") for i in range(n_mers)), F.lit(0))
    return df.withColumns({"correct": ok.cast("int"), "snps": snps})


def placement_read_stats(checked: DataFrame, id: str = "sample") -> DataFrame:
    """Per read: correct, exact, total, at most one mismatch, and the correct ones of the last two kinds."""
    c, s = F.col("correct") == 1, F.col("snps")
    return checked.groupBy(id).agg(
        F.count_if(c).alias("correct"), F.count_if(s == 0).alias("snps0"), F.count(F.lit(1)).alias("total"),
        F.count_if(s <= 1).alias("snps1"), F.count_if(c & (s == 0)).alias("answer0"), F.count_if(c & (s <= 1)).alias("answer1"))


def placement_summary(stats: DataFrame, max_out: int = 0) -> DataFrame:
    """Sixteen totals over per-read statistics; reads at or over `max_out` are only counted as omitted."""
    full = (F.col("total") >= max_out) if max_out > 0 else F.lit(False)
    rest = ~full
    n = lambda cond: F.count_if(rest & cond)
    one, right = F.col("total") == 1, F.col("correct") > 0
    add = lambda c: F.coalesce(F.sum(F.when(rest, F.col(c))), F.lit(0))
    return stats.agg(
        F.count(F.lit(1)).alias("reads"), F.count_if(full).alias("omitted"),
        add("snps0").alias("placements_0"), add("snps1").alias("placements_1"), add("total").alias("placements_any"),
        n(F.col("snps0") > 0).alias("reads_0"), n(F.col("snps1") > 0).alias("reads_1"), n(F.col("total") > 0).alias("reads_any"),
        n(right).alias("reads_correct"), n(one).alias("unique"), n(one & right & (F.col("snps0") > 0)).alias("unique_correct_0"),
        n(one & right & (F.col("snps1") > 0)).alias("unique_correct_1"), n(one & right).alias("unique_correct"),
        n(one & (F.col("snps0") > F.col("answer0"))).alias("unique_wrong_0"),
        n(one & (F.col("snps1") > F.col("answer1"))).alias("unique_wrong_1"), n(one & ~right).alias("unique_wrong"))


def placement_histogram(stats: DataFrame, max_out: int = 0) -> DataFrame:
    """Reads by floor(log2(placements)), for all, <= 1 mismatch and exact placements."""
    kept = stats.where(F.col("total") < max_out) if max_out > 0 else stats
    kinds = F.array(*[F.struct(F.lit(n).alias("kind"), F.col(c).alias("n"))
                      for n, c in (("reads", "total"), ("snps1", "snps1"), ("exact", "snps0"))])
    long = kept.select(F.explode(kinds).alias("x")).where("x.n > 0").select(
        (F.length(F.bin("x.n")) - 1).alias("p"), F.col("x.kind").alias("kind"))
    return long.groupBy("p").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("reads", "snps1", "exact")])


def placement_class_stats(placed: DataFrame) -> DataFrame:
    """total, placed (not class 0), unique (class U) and unique by mismatch count."""
    return placed.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("class") != "0").alias("placed"),
        F.count_if(F.col("class") == "U").alias("unique"),
        *[F.count_if((F.col("class") == "U") & (F.col("mm") == i)).alias(f"mm{i}") for i in range(3)])


def reads_with_placements(reads: DataFrame, placements: DataFrame, id: str = "sample", gap: tuple[int, int] | None = None,
                          k: int = 12, snps: bool = False) -> DataFrame:
    """Every read with all its placements and their number; NO_MATCH when none.

    `gap` keeps placements whose gap between the two mers lies in the bounds.
    """
    kept = placements
    if gap:
        size = F.col("pos1") - F.col("pos0") - k
        kept = kept.where((size >= gap[0]) & (size <= gap[1]))
    counts = kept.groupBy(id).agg(F.count(F.lit(1)).alias("n"))
    counted = kept.join(counts, id)
    return reads.join(counted, id, "left").withColumns({
        "n": F.coalesce("n", F.lit(0)), "status": F.when(F.col("n").isNull(), "NO_MATCH").otherwise("PLACED")})


def placed_with_mismatches(report: DataFrame, max_snps: int | None = None, mer_size: int = 12, id: str = "sample") -> DataFrame:
    """Read letters marked against the reference; kept up to `max_snps` differences (default 1 + length div mer size)."""
    marked = report.withColumn("marked", S.mark_differences("read_seq", "ref_seq"))
    eq = F.length(F.regexp_replace("marked", "[^acgt]", ""))
    counted = marked.withColumns({"n_equal": eq, "n_diff": F.length("marked") - eq})
    limit = F.lit(max_snps) if max_snps is not None else 1 + F.floor(F.length("marked") / mer_size)
    kept = counted.where(F.col("n_diff") <= limit)
    return kept.join(kept.groupBy(id).agg(F.count(F.lit(1)).alias("n")), id)


# -- split reads on circular exons -------------------------------------------------

def exon_seeds(exons: DataFrame, part: int = 6, gap: tuple[int, int] = (13, 16)) -> DataFrame:
    """(exon, key, n): 12-letter seeds of the circular exon, two parts 13-16 letters apart, with multiplicity."""
    reach = 2 * part + gap[1]
    tripled = exons.where(F.length("seq") > 0).select(
        "exon", F.length("seq").alias("_len"), F.upper(F.concat("seq", "seq")).alias("_round"))
    w = explode_kmers(tripled, reach, "_round", ("exon", "_len"), shorter=gap[1] - gap[0]).where(F.col("pos") < F.col("_len") + 30)
    g = w.withColumn("g", F.explode(F.sequence(F.lit(gap[0]), F.lit(gap[1])))).where(F.length("kmer") >= 2 * part + F.col("g"))
    key = F.concat(F.left("kmer", F.lit(part)), F.substr("kmer", F.col("g") + part + 1, F.lit(part)))
    return g.select("exon", key.alias("key")).groupBy("exon", "key").agg(F.count(F.lit(1)).alias("n"))


def place_split_reads(reads: DataFrame, exons: DataFrame, max_mm: int = 1) -> DataFrame:
    """Class of each 24-letter read: U placed once, N more often, 0 nowhere.

    Both 12-letter halves must seed the same exon with at most `max_mm` (<= 2)
    substitutions in total. U rows carry the exon and the read as placed.
    Reads containing `.` are skipped. An ambiguous letter counts as a
    substitution; over one in an exon there is no seed.
    """
    half = 12
    low = F.lower("key")
    seeds = exon_seeds(exons).where(F.translate(low, "acgt", "") == "").select("exon", S.kmer_code("key").alias("_key"), "n")
    by_key, _ = lookup(seeds, "exon-seeds")
    # With at most max_mm changes one of max_mm + 1 parts of a half is unchanged: inside a known exon, seeds are found by a part.
    n_parts = max_mm + 1
    size = 2 * (half // n_parts)
    part = lambda code, j: F.shiftright(code, size * (n_parts - 1 - j)).bitwiseAND(F.lit((1 << size) - 1)) + (j << 24)
    by_part, _ = lookup(by_key.select("exon", F.explode(F.array(*[part(F.col("_key"), j) for j in range(n_parts)])).alias("_part"), "_key", "n"), "exon-parts")
    good = reads.where(~F.col("bases").contains("."))
    # Bit tables of the seeds and of their neighbours sort out most reads before a half is widened or joined. An ambiguous letter counts as `a`
    # there, which is at most one substitution off where it may be read as another letter. What is left is written once, for both directions.
    near = [code_test(by_key.select("_key"), half, mm) for mm in range(min(max_mm, 1) + 1)]
    digits = F.translate(F.lower(F.left("bases", F.lit(2 * half))), "acgt", "0123")
    digits = F.when(digits.rlike("[^0-3]"), F.regexp_replace(digits, "[^0-3]", "0")).otherwise(digits)
    coded = settle(good.where(F.length("bases") >= 2 * half).select("read_id", "bases", F.conv(digits, 4, 10).cast("long").alias("_code")), "read_id", "bases", "_code")
    code0, code1 = F.shiftright("_code", 2 * half), F.col("_code").bitwiseAND(F.lit((1 << 2 * half) - 1))
    either = near[max_mm // 2](code0) & (near[1](code1) if max_mm == 1 else near[0](code1) if not max_mm else F.lit(True))
    if max_mm:
        either = either | (near[0](code1) & (near[1](code0) if max_mm == 1 else F.lit(True)))
    seeded = stored(coded.where(either).select("read_id", "bases"), "seeded-reads")
    # Both halves travel with the read, so nothing is shuffled before the placements are counted.
    mers = seeded.select("read_id", *[F.lower(F.substr("bases", F.lit(1 + half * i), F.lit(half))).alias(f"mer{i}") for i in (0, 1)])
    halves = mers.where(f"length(mer0) = {half} and length(mer1) = {half}").select("*", *[c for i in (0, 1) for c in mer_codes(f"mer{i}", f"c{i}", f"a{i}")])

    def placed(no: int, first: int, least: int) -> DataFrame:
        """Hits of one half with up to `first` (<= 1) substitutions, then the other half, with `least` or more, inside the exons found."""
        hits = widened(halves, half, first, f"mer{no}").withColumn(f"mm{no}", (F.col("err") >= 0).cast("int")).join(by_key, "_key")
        hits = hits.select("read_id", "exon", F.col("_key").alias(f"key{no}"), f"mm{no}", F.col("n").alias(f"n{no}"),
                           F.col(f"c{1 - no}").alias("_c"), F.col(f"a{1 - no}").alias("_a"))
        tried = hits.withColumn("_part", F.explode(F.array(*[part(F.col("_c"), j) for j in range(n_parts)]))).join(by_part, ["exon", "_part"])
        differs = code_differences(F.col("_c"), F.col("_key"), F.col("_a"), half)
        changed = lambda j: differs.bitwiseAND(F.lit(((1 << size) - 1) << size * (n_parts - 1 - j))) != 0
        # A seed counts where its first unchanged part found it.
        own = F.lit(False)
        for j in range(n_parts):
            hit = (F.shiftright("_part", 24) == j) & ~changed(j)
            for earlier in range(j):
                hit = hit & changed(earlier)
            own = own | hit
        mm = F.bit_count(differs)
        kept = tried.where(own & (mm >= least) & (mm + F.col(f"mm{no}") <= max_mm)).withColumn(f"mm{1 - no}", mm)
        return kept.withColumnsRenamed({"_key": f"key{1 - no}", "n": f"n{1 - no}"}).select("read_id", "exon", "key0", "key1", "mm0", "mm1", "n0", "n1")

    # In all at most max_mm: the first half has no more than half of them, or the second has none.
    both = placed(0, max_mm // 2, 0)
    if max_mm:
        both = both.unionByName(placed(1, 0, max_mm))
    per = both.groupBy("read_id").agg(
        F.sum(F.col("n0") * F.col("n1")).alias("n_pairs"),
        F.min(F.struct((F.col("mm0") + F.col("mm1")).alias("mm"), "exon", "key0", "key1")).alias("_b"))
    # Reads are moved only if many of them are placed.
    per, _ = lookup(per, "placed-reads")
    unique = F.col("n_pairs") == 1
    text = F.concat(S.kmer_text(F.col("_b.key0"), half), S.kmer_text(F.col("_b.key1"), half))
    return good.join(per, "read_id", "left").select(
        *good.columns, F.when(F.col("n_pairs").isNull(), "0").when(unique, "U").otherwise("N").alias("class"),
        F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), F.when(unique, F.col("_b.exon")).alias("exon"),
        F.when(unique, text).alias("placed"), F.when(unique, F.col("_b.mm")).alias("mm"))


def annotate_bases(placed: DataFrame, exons: DataFrame) -> DataFrame:
    """Unique placements to 24 rows: exon position, called base, reference base, M/S and read offset.

    The four parts are looked up in the doubled exon, the second of each half
    at least 13 letters after the first; more than 16 apart drops the read.
    """
    u = placed.where("class = 'U'").join(exons.select("exon", F.lower("seq").alias("_s")), "exon")
    two = F.concat("_s", "_s")
    part = lambda i: F.substr("placed", F.lit(1 + 6 * i), F.lit(6))
    starts = u.withColumn("_two", two)
    for half in (0, 1):
        a, b = f"_p{2 * half}", f"_p{2 * half + 1}"
        starts = starts.withColumn(a, F.instr("_two", part(2 * half)) - 1)
        starts = starts.withColumn("_tail", F.substr("_two", (F.col(a) + 6 + 13 + 1).cast("int")))
        rel = F.instr("_tail", part(2 * half + 1)) - 1
        starts = starts.withColumn(b, F.when((F.col(a) >= 0) & (rel >= 0), F.col(a) + 6 + 13 + rel).otherwise(-1))
    ok = starts.where(" and ".join(f"_p{i} >= 0" for i in range(4)) + " and _p1 - _p0 - 6 <= 16 and _p3 - _p2 - 6 <= 16")
    rows = ok.withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(23))))
    p = F.element_at(F.array(*[F.col(f"_p{i}") for i in range(4)]), F.floor(F.col("offset") / 6).cast("int") + 1)
    base = F.lower(F.substr("bases", F.col("offset") + 1, F.lit(1)))
    ref = F.substr("placed", F.col("offset") + 1, F.lit(1))
    return rows.select("read_id", "exon", F.length("_s").alias("length"), (p + F.col("offset") % 6).cast("long").alias("pos"),
                       base.alias("base"), ref.alias("ref_base"), F.when(base == ref, "M").otherwise("S").alias("ms"), "offset")


def dig_alignments(bases: DataFrame, targets: DataFrame, reach: int = 29) -> DataFrame:
    """For every target position the reads covering it, re-assembled within `reach` bases.

    Bases a read lacks are `n`, their quality `.`; quality is chr(33 + q/10).
    """
    hit = bases.join(targets.distinct(), ["chr", "pos"], "left_semi").select("chr", F.col("pos").alias("target"), "read_id").distinct()
    near = bases.join(hit, ["chr", "read_id"]).where(F.abs(F.col("pos") - F.col("target")) <= reach)
    # A read called twice at a position keeps one of the calls.
    per_pos = near.groupBy("chr", "target", "read_id", "pos").agg(F.min("strand").alias("strand"), F.max(F.struct("base", "qual")).alias("_b"))
    g = per_pos.groupBy("chr", "target", "read_id").agg(
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.min("strand").alias("strand"),
        F.map_from_entries(F.array_agg(F.struct("pos", "_b"))).alias("_m"))
    span = F.sequence("first_pos", "last_pos")
    fill = lambda f, d: F.array_join(F.transform(span, lambda p: F.coalesce(f(F.col("_m")[p]), F.lit(d))), "")
    return g.select("chr", "target", "read_id", "first_pos", F.when(F.col("strand") == "F", "+").otherwise("-").alias("strand"),
                    (F.col("last_pos") - F.col("first_pos") + 1).alias("length"),
                    fill(lambda r: r["base"], "n").alias("bases"),
                    fill(lambda r: F.chr((33 + F.floor(r["qual"] / 10)).cast("int")), ".").alias("quals"))


# -- four-mer reads ------------------------------------------------------------------

def place_four_mers(reads: DataFrame, chunks: DataFrame, chunk: int, k: int = 8, wobble: tuple[int, ...] = (9, 10),
                    window: tuple[int, int] = (750, 1256)) -> DataFrame:
    """Reads of four mers: the first pair at a reference position, the second in the window after it.

    `exact` rows have both mers of the second pair 9-10 apart; `mer2`/`mer3`
    rows have one of them, the other marked against the reference at the better
    of its two distances. All placements are returned.
    """
    lo, hi = window
    reach = hi + wobble[-1] + k
    w = explode_kmers(glued(chunks, chunk, wobble[-1] + k), wobble[-1] + k, "seq", ("chr", "chunk_no"), shorter=wobble[-1] - wobble[0]).where(F.col("pos") < chunk)
    g = w.withColumn("w", F.explode(F.array(*[F.lit(x) for x in wobble]))).where(F.length("kmer") >= F.col("w") + k)
    first = g.select("chr", (F.col("chunk_no") * chunk + F.col("pos")).alias("pos0"), "w",
                     F.left("kmer", F.lit(k)).alias("mer0"), F.substr("kmer", F.col("w") + 1, F.lit(k)).alias("mer1"))
    placed = reads.join(first, ["mer0", "mer1"])
    seen = reference_slice(placed, chunks, chunk, F.col("pos0"), F.lit(reach), "_win", most=reach).withColumn("_b", F.encode("_win", "US-ASCII"))

    def found(m):
        return F.filter(F.sequence(F.lit(lo), F.lit(hi - 1)), lambda p: F.substring(F.col("_b"), p + 1, F.lit(k)) == F.encode(m, "US-ASCII"))

    both = seen.withColumns({"_p2": found("mer2"), "_p3": found("mer3")})
    pair = F.flatten(F.transform("_p2", lambda a: F.transform(
        F.filter("_p3", lambda b: (b - a).isin(*wobble)), lambda b: F.struct(
            F.lit("exact").alias("kind"), a.alias("pos2"), b.alias("pos3"), F.lit("").alias("marked")))))
    text = lambda at: F.substring(F.col("_b"), at + 1, F.lit(k)).cast("string")

    def lone(kind, ps, others, mer, sign):
        """Positions of one mer without partner; the other marked at the closer distance, ties at the first."""
        free = F.filter(ps, lambda a: ~F.exists(others, lambda b: ((b - a) if sign > 0 else (a - b)).isin(*wobble)))

        def row(a):
            d = wobble if sign > 0 else wobble[::-1]
            near, far = [a + sign * x for x in d]
            use = F.when(S.mismatches(F.col(mer), text(far)) < S.mismatches(F.col(mer), text(near)), far).otherwise(near)
            p2, p3 = (a, use) if sign > 0 else (use, a)
            return F.struct(F.lit(kind).alias("kind"), p2.alias("pos2"), p3.alias("pos3"),
                            S.mark_differences(F.col(mer), text(use)).alias("marked"))
        return F.transform(free, row)

    rows = F.concat(pair, lone("mer2", F.col("_p2"), F.col("_p3"), "mer3", 1), lone("mer3", F.col("_p3"), F.col("_p2"), "mer2", -1))
    return (both.select("read_id", "chr", "pos0", F.col("w").alias("wobble"), F.explode(rows).alias("r"))
            .select("read_id", "chr", "pos0", "wobble", "r.kind", (F.col("pos0") + F.col("r.pos2")).alias("pos2"),
                    (F.col("pos0") + F.col("r.pos3")).alias("pos3"), "r.marked"))


def vote_pileup(marked: DataFrame, cutoff: float) -> DataFrame:
    """Votes per position from mers with exactly one marked (differing) base.

    A read voting for two bases at a position does not vote. Kept when
    top / (1 + second + third) reaches `cutoff`.
    """
    single = marked.where(F.length(F.regexp_replace("marked", "[^ACGT]", "")) == 1)
    base = F.regexp_replace("marked", "[^ACGT]", "")
    at = F.col("pos") + F.length(F.regexp_extract("marked", "^([acgt]*)", 1))
    per_read = single.select("chr", at.alias("pos"), "read_id", iupac.mask(base).alias("m")).groupBy(
        "chr", "pos", "read_id").agg(F.bit_or("m").alias("m"))
    votes = per_read.groupBy("chr", "pos").agg(
        *[F.count_if(F.col("m") == bit).alias(b.lower()) for b, bit in iupac.BASE_BITS.items()],
        F.count(F.lit(1)).alias("n_reads"))
    order = F.sort_array(F.array("a", "c", "g", "t"), False)
    ratio = F.element_at(order, 1) / (1 + F.element_at(order, 2) + F.element_at(order, 3))
    return votes.withColumn("ratio", F.round(ratio, 6)).where(F.col("ratio") >= cutoff)


# -- mismatches of alignments ----------------------------------------------------------

def mismatch_scan(alignments: DataFrame, chunks: DataFrame, chunk: int, limit: int = 20) -> DataFrame:
    """Per read the positions differing from the reference with their quality and 5-base contexts.

    More than `limit` differences give one `over-mismatch` row; reads starting
    before 2 are skipped. A read may be as long as a chunk less 4.
    """
    usable = alignments.where(F.col("start_pos") >= 2)
    n = F.length("bases")
    # Two reference letters before the read, so that every context is whole on the left.
    lo = F.col("start_pos") - 3
    ref = reference_slice(usable, chunks, chunk, F.greatest(lo, F.lit(0)), n + 4, "_ref")
    ref = ref.withColumn("_ref", F.when(lo < 0, F.concat(F.lit(" "), "_ref")).otherwise(F.col("_ref")))
    ref = ref.withColumn("_seq", F.concat(F.left("_ref", F.lit(2)), F.lower("bases")))
    diffs = F.filter(F.transform(F.arrays_zip(F.split("_seq", "").alias("a"), F.split("_ref", "").alias("b")),
                                 lambda z, i: F.when(z["a"] != z["b"], i)), lambda i: i.isNotNull())
    found = ref.withColumn("_d", diffs)
    many = F.size("_d") > limit
    row = lambda d: F.struct(
        F.lit("mismatch").alias("type"), (F.col("start_pos") + d - 2).cast("long").alias("pos"),
        F.greatest(F.ascii(F.substr("quals", d - 1, F.lit(1))) - 33, F.lit(0)).alias("qual"),
        F.concat(F.substr("_ref", d - 1, F.lit(5)), F.lit(" "), F.substr("_seq", d - 1, F.lit(5))).alias("context"))
    over = F.array(F.struct(F.lit("over-mismatch").alias("type"), F.col("start_pos").cast("long").alias("pos"),
                            F.lit(None).cast("int").alias("qual"), F.lit(None).cast("string").alias("context")))
    return found.select("read_id", "chr", F.explode(F.when(many, over).otherwise(F.transform("_d", row))).alias("r")).select("read_id", "chr", "r.*")


def alignments_to_gff(df: DataFrame, flag: int = 18, bucket: int = 1_000_000) -> DataFrame:
    """Proper pairs as annotation rows; attributes hold the sequence, or the bases flagged in the mismatch bitmap.

    The bitmap's lowest bit is the read's last base; it is read as hex text.
    """
    kept = df.where(F.col("flag") == flag)
    n = F.length("bases")
    nibbles = F.lpad(F.lower("bitmap"), 32, "0")
    # Bit p (0 = lowest) sits in hex digit 32 - p div 4.
    is_set = lambda p: F.getbit(F.conv(F.substr(nibbles, (32 - F.floor(p / 4)).cast("int"), F.lit(1)), 16, 10).cast("long"), (p % 4).cast("int")) == 1
    at = F.filter(F.sequence(n - 1, F.lit(0), F.lit(-1)), lambda i: is_set(n - 1 - i))
    letters = F.array_join(F.transform(at, lambda i: F.substr("bases", i + 1, F.lit(1))), "")
    head = F.concat(F.lit("R "), F.col("read_id").cast("string"), "strand", F.lit(' ; Q illumina "'),
                    F.regexp_replace("quals", '"', '\\\\\\\\"'), F.lit('"'))
    tail = F.when(F.col("bitmap").isNotNull() & (F.col("bitmap") != "0"),
                  F.concat(F.lit(" ; M "), letters, F.lit(" "), F.array_join(at.cast("array<string>"), ","))).otherwise(
        F.concat(F.lit(' ; S "'), "bases", F.lit('"')))
    return kept.select("chr", F.lit("placed-read").alias("type"), "start_pos", (F.col("start_pos") + n - 1).alias("end_pos"),
                       F.col("mapq").alias("score"), "strand", F.concat(head, tail).alias("attributes"),
                       F.floor(F.col("start_pos") / bucket).alias("bucket"))
