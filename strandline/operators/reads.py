"""Reads: selection, trimming, strands, conversion between formats, k-mer statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import seq as S
from .kmers import explode_kmers, neighbours


def select_reads(df: DataFrame, skip_degenerates: bool = False, skip_no_snps: bool = False,
                 bases: str = "bases", copy: str = "copy") -> DataFrame:
    """Drop reads with a letter outside acgt; drop reads whose reference copy has no marked (upper-case) letter."""
    out = df
    if skip_degenerates:
        out = out.where(~F.col(bases).rlike("(?i)[^acgt]"))
    if skip_no_snps:
        out = out.where(~F.col(copy).rlike("^[a-z ]*$"))
    return out


def quality_trim(reads: DataFrame, length: int | Column) -> DataFrame:
    """Truncate bases and qualities; reads with flag 0x10 keep the right end, shorter reads go."""
    length = length if isinstance(length, Column) else F.lit(length)
    reversed_ = F.col("flag").bitwiseAND(16) != 0
    cut = lambda c: F.when(reversed_, F.right(c, length)).otherwise(F.left(c, length))
    return reads.where(F.length("bases") >= length).withColumns({"bases": cut(F.col("bases")), "quals": cut(F.col("quals"))})


def split_mates(reads: DataFrame, at: int) -> DataFrame:
    """Each read as two: the left `at` bases (`/1`) and the rest (`/2`)."""
    rest = lambda c: F.substr(F.col(c), F.lit(at + 1))
    left = F.struct(F.concat("name", F.lit("/1")).alias("name"), F.left("bases", F.lit(at)).alias("bases"),
                    F.left("quals", F.lit(at)).alias("quals"))
    right = F.struct(F.concat("name", F.lit("/2")).alias("name"), rest("bases").alias("bases"), rest("quals").alias("quals"))
    return reads.select(F.explode(F.array(left, right)).alias("r")).select("r.*")


def both_strands(df: DataFrame, mer_cols: list[str], only_rc: bool = False) -> DataFrame:
    """Each row and its twin: mers reverse-complemented and in reverse column order (`side` 0/1)."""
    others = [c for c in df.columns if c not in mer_cols]
    fwd = F.struct(F.lit(0).alias("side"), *[F.col(c) for c in mer_cols])
    rev = F.struct(F.lit(1).alias("side"),
                   *[S.revcomp(c).alias(name) for c, name in zip(reversed(mer_cols), mer_cols)])
    sides = F.array(rev) if only_rc else F.array(fwd, rev)
    return df.select(*others, F.explode(sides).alias("_s")).select(*others, "_s.*")


def colorspace_decode(reads: DataFrame, quals: DataFrame | None = None) -> DataFrame:
    """Colour reads to bases; qualities joined by id (or all `I`).

    Reads with odd letters are dropped; a read without its quality row is dropped too.
    """
    ok = reads.where(F.col("colors").rlike("(?i)^[ACGTN][NACGT0-6.]*$"))
    out = ok.withColumn("bases", S.colorspace_bases("colors"))
    if quals is None:
        return out.withColumn("quals", F.repeat(F.lit("I"), F.length("bases")))
    return out.join(quals.select("read_id", S.phred_text("qual_numbers").alias("quals")), "read_id")


def mapped_colorspace_to_sam(df: DataFrame) -> DataFrame:
    """SAM rows of colour reads whose title ends in `,chr_position` (negative: reverse strand)."""
    chr_ = F.regexp_extract("title", r",([0-9]+)_(-?[0-9]+)", 1)
    pos = F.regexp_extract("title", r",([0-9]+)_(-?[0-9]+)", 2).try_cast("long")
    bases = S.colorspace_bases("colors")
    mapped, rev = chr_ != "", pos < 0
    # Numbers of the chromosomes with letter names.
    name = F.when(chr_ == "23", "chrX").when(chr_ == "24", "chrY").when(chr_ == "25", "chrM").otherwise(F.concat(F.lit("chr"), chr_))
    return df.select(
        F.col("title").alias("qname"),
        F.when(~mapped, 4).when(rev, 16).otherwise(0).alias("flag"),
        F.when(mapped, name).otherwise("*").alias("rname"),
        F.when(~mapped, 0).when(rev, 3 - F.length("colors") - pos).otherwise(pos + 1).alias("pos"),
        F.lit(0).alias("mapq"),
        F.when(mapped, F.concat(F.length(bases), F.lit("M"))).otherwise("*").alias("cigar"),
        F.when(mapped & rev, S.revcomp(bases)).otherwise(bases).alias("bases"),
        F.repeat(F.lit("I"), F.length(bases)).alias("quals"))


def chr_rename(col) -> Column:
    """Bare names to `chrN`; 23 and 24 are X and Y."""
    c = F.col(col) if isinstance(col, str) else col
    bare = F.when(c == "23", "X").when(c == "24", "Y").otherwise(c)
    return F.when(bare.rlike("^([0-9]+|X|Y|M)$"), F.concat(F.lit("chr"), bare)).otherwise(bare)


def sam_to_fastq(sam: DataFrame, color_space: bool = False, read_group: str | None = None) -> DataFrame:
    """FASTQ text per SAM row; flag 0x10 rows return to read orientation.

    In colour space the tags CS and CQ are used and rows lacking one are dropped.
    """
    if read_group is not None:
        sam = sam.where(F.col("rg") == read_group)
    if color_space:
        sam = sam.where("cs is not null and cq is not null")
        bases = F.regexp_replace(F.translate(F.substr("cs", F.lit(2)), "0123", "ACGT"), "[^ACGT]", "N")
        quals = F.col("cq")
    else:
        rev = F.col("flag").bitwiseAND(16) != 0
        bases = F.when(rev, S.revcomp("bases")).otherwise(F.col("bases"))
        quals = F.when(rev, F.reverse("quals")).otherwise(F.col("quals"))
    out = sam.withColumns({"bases": bases, "quals": quals})
    return out.withColumn("fastq", F.concat(F.lit("@"), "name", F.lit("\n"), "bases", F.lit("\n+\n"), "quals", F.lit("\n")))


def pair_mates(sam: DataFrame, order: str = "ord") -> DataFrame:
    """Mates by name with their group: 0 single, 1 first, 2 second; orphans are dropped.

    Groups come from partial aggregates per name. When a name occurs more than
    once per group the first row by `order` is taken.
    """
    paired = F.col("flag").bitwiseAND(1) != 0
    single = sam.where(~paired).withColumn("grp", F.lit(0))
    first, second = F.col("flag").bitwiseAND(64) != 0, F.col("flag").bitwiseAND(128) != 0
    row = F.struct(*[F.col(c) for c in sam.columns])
    known = first | second
    g = (sam.where(paired).groupBy("name").agg(
        F.min_by(F.when(first, row), F.when(first, F.col(order))).alias("r1"),
        F.min_by(F.when(second & ~first, row), F.when(second & ~first, F.col(order))).alias("r2"),
        F.min_by(F.when(~known, row), F.when(~known, F.col(order))).alias("u1"),
        F.max_by(F.when(~known, row), F.when(~known, F.col(order))).alias("u2")))
    unordered = F.col("r1").isNull() & F.col("r2").isNull() & (F.col(f"u1.{order}") != F.col(f"u2.{order}"))
    both = g.select(F.when(F.col("r1").isNotNull() & F.col("r2").isNotNull(), F.array("r1", "r2"))
                    .when(unordered, F.array("u1", "u2")).alias("pair")).where("pair is not null")
    mates = both.select(F.posexplode("pair").alias("_i", "m")).select("m.*", (F.col("_i") + 1).alias("grp"))
    return single.unionByName(mates)


def orphan_counts(sam: DataFrame) -> DataFrame:
    """Number of names seen only as first, and only as second, of a pair."""
    paired = sam.where(F.col("flag").bitwiseAND(1) != 0)
    g = paired.groupBy("name").agg(F.bit_or(F.col("flag").bitwiseAND(64 | 128)).alias("b"))
    return g.agg(F.count_if(F.col("b") == 64).alias("orphans_1"), F.count_if(F.col("b") == 128).alias("orphans_2"))


def reference_translate(df: DataFrame, in_zero: int = 1, out_zero: int = 1, ref_zero: int = 1,
                        lookup: DataFrame | None = None, mask: bool = False) -> DataFrame:
    """Coordinates within `name=chr@start-end` to chromosome coordinates.

    The three switches give the number of the first base (0 or 1) of the input
    positions, output positions and reference starts. With `lookup` (name, chr,
    start_pos, seq) names are looked up, and `mask` drops rows on an n or x.
    """
    if lookup is None:
        form = r"=(\S+)@([0-9]+)-([0-9]+)$"
        chr_, start = F.regexp_extract("ref", form, 1), F.regexp_extract("ref", form, 2).try_cast("long")
        found = df.where(F.col("ref").rlike(form))
    else:
        # Only rows of the lookup that are asked for carry their letters on.
        asked = df.select(F.col("ref").alias("name")).distinct()
        found = df.join(lookup.join(asked, "name", "left_semi").select(F.col("name").alias("ref"), F.col("chr").alias("_chr"),
                                      F.col("start_pos").alias("_start"), F.col("seq").alias("_seq")), "ref")
        chr_, start = F.col("_chr"), F.col("_start")
        if mask:
            found = found.where(~F.lower(F.substr("_seq", (F.col("pos") + 1).cast("int"), F.lit(1))).isin("n", "x"))
    out = found.withColumn("chr", chr_).withColumn("pos", F.col("pos") + start - ref_zero + out_zero - in_zero)
    return out.select("chr", "pos", *[c for c in df.columns if c not in ("ref", "pos", "chr")])


def forward_strand(df: DataFrame) -> DataFrame:
    """Rows on strand R to forward coordinates and bases; coordinates modulo the exon length."""
    rev = F.col("strand") == "R"
    comp = lambda c: F.when(rev, F.translate(F.upper(c), "ACGT", "TGCA")).otherwise(F.col(c))
    pos = F.when(rev, F.col("length") - F.col("pos") - 1).otherwise(F.col("pos"))
    return df.withColumns({"pos": F.pmod(pos, F.col("length")), "base": comp("base"), "ref_base": comp("ref_base")})


def expand_degenerate(reads: DataFrame, arm0: str = "arm0", arm1: str = "arm1") -> DataFrame:
    """Cross product of both arms' readings; an arm with two or more ambiguous letters yields none."""
    return (reads.withColumn(arm0, F.explode(S.resolutions(arm0)))
            .withColumn(arm1, F.explode(S.resolutions(arm1))))


def substitute_variants(mers: DataFrame, k: int, mer: str = "mer", packed: bool = False) -> DataFrame:
    """Every mer with its one-substitution neighbours and error position (-1: unchanged); `packed`: an array per position."""
    return neighbours(mers, k, mer, packed=packed)


def two_letter_gap(df: DataFrame, gap: str = "gap_seq", letters: int = 2) -> DataFrame:
    """Rows whose gap uses at most `letters` distinct bases."""
    g = F.upper(gap)
    used = sum(((F.instr(g, b) > 0).cast("int") for b in "ACGT"), F.lit(0))
    return df.where(used <= letters)


def fasta_to_fastq(records: DataFrame, title: str = "title", bases: str = "bases") -> DataFrame:
    """FASTQ text with constant quality, per record, and the record's length group."""
    n = F.length(bases)
    return records.select(n.alias("n_bases"), F.concat(
        F.lit("@"), F.col(title), F.lit("\n"), F.col(bases), F.lit("\n+"), F.col(title), F.lit("\n"),
        F.repeat(F.lit("I"), n), F.lit("\n")).alias("fastq"))


def sequence_encode(df: DataFrame, k: int = 8, seq: str = "seq", id: str = "doc_id") -> DataFrame:
    """2-bit code of the k letters at every offset, ambiguous runs filled first."""
    # Letters become digits once, not once per k-mer they are in.
    filled = df.select(id, F.translate(S.fill_ambiguous(seq), "acgt", "0123").alias("_filled"))
    return explode_kmers(filled, k, "_filled", (id,)).select(
        id, F.col("pos").cast("int").alias("offset"), F.conv("kmer", 4, 10).cast("long").alias("code"))


def sequence_decode(df: DataFrame, k: int = 8, code: str = "code") -> DataFrame:
    """Codes back to letters."""
    return df.withColumn("kmer", S.kmer_text(code, k))


def fill_ambiguous_runs(df: DataFrame, seq: str = "seq") -> DataFrame:
    return df.withColumn("filled", S.fill_ambiguous(seq))


def read_length_hist(reads: DataFrame, suffix: str | None = None) -> DataFrame:
    """Reads per length (and mate suffix)."""
    keys = [F.length("bases").alias("length")] + ([F.col(suffix)] if suffix else [])
    return reads.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def best_read_length(hist: DataFrame) -> DataFrame:
    """The length L with most bases L x (reads of at least L); ties give the larger L.

    `hist` has length, suffix ('' single, '_1', '_2') and n. Paired lengths
    count double and only where both mates have equally many reads.
    """
    wide = hist.groupBy("length").agg(
        F.sum(F.when(F.col("suffix") == "", F.col("n"))).alias("single"),
        F.sum(F.when(F.col("suffix") == "_1", F.col("n"))).alias("first"),
        F.sum(F.when(F.col("suffix") == "_2", F.col("n"))).alias("second"))
    single = wide.where("single is not null").select(F.col("length").cast("long").alias("len"), F.col("single").alias("n"))
    paired = wide.where("first = second").select((F.col("length") * 2).cast("long").alias("len"), F.col("first").alias("n"))
    # One length may arise both ways: the later reading replaces the count in
    # the reference's table without a defined order; the larger count is used.
    by_len = single.unionByName(paired).groupBy("len").agg(F.max("n").alias("n"))
    at_least = F.sum("n").over(W.orderBy(F.desc("len")))
    return by_len.withColumn("bases", F.col("len") * at_least).agg(
        F.max_by("len", F.struct("bases", "len")).alias("best_length"), F.max("bases").alias("bases"))


def kmer_counts(seqs: DataFrame, k: int, group: str | None = None, seq: str = "seq") -> DataFrame:
    """k-mer frequencies over cleaned sequences, counted before the shuffle."""
    keys = ([group] if group else []) + ["kmer"]
    return (explode_kmers(seqs, k, seq, (group,) if group else ())
            .groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))


def kmer_coincidence(arms: DataFrame, cap: int = 255, cols: tuple[str, ...] = ("arm0", "arm1")) -> DataFrame:
    """Occurrences of each arm and its reverse complement, saturating at `cap`, and what exceeded it."""
    # A mer and its reverse complement occur equally often: only the lesser of the two is counted.
    each = arms.select(F.explode(F.array(*[F.least(F.col(c), S.revcomp(c)) for c in cols])).alias("_one")).groupBy("_one").agg(F.count(F.lit(1)).alias("_n"))
    both = each.select("_one", S.revcomp("_one").alias("_two"), "_n")
    own, other = [F.struct(F.col(c).alias("mer"), F.col("_n")) for c in ("_one", "_two")]
    twice = F.array(F.struct(F.col("_one").alias("mer"), (2 * F.col("_n")).alias("_n")))
    return (both.select(F.inline(F.when(F.col("_one").eqNullSafe(F.col("_two")), twice).otherwise(F.array(own, other))))
            .select("mer", F.least("_n", F.lit(cap)).alias("n"), F.greatest(F.col("_n") - cap, F.lit(0)).alias("overflow")))


def seed_index(reads: DataFrame, seed: str = "seed", limit: int = 100) -> DataFrame:
    """Reads whose seed occurs fewer than `limit` times."""
    full = reads.groupBy(seed).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= limit).select(seed)
    return reads.where(F.col(seed) != "").join(full, seed, "left_anti")


def seed_stats(reads: DataFrame, seed: str = "seed", limit: int = 100) -> DataFrame:
    """Reads kept, skipped for a crowded seed, and without a seed."""
    g = reads.groupBy(seed).agg(F.count(F.lit(1)).alias("n"))
    has = F.col(seed) != ""
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return g.agg(total(has & (F.col("n") < limit)).alias("kept"), total(has & (F.col("n") >= limit)).alias("skipped"),
                 total(~has).alias("empty"))


def seed_occupancy(index: DataFrame, seed: str = "seed") -> DataFrame:
    """How many seeds hold n reads."""
    return (index.groupBy(seed).agg(F.count(F.lit(1)).alias("reads")).groupBy("reads")
            .agg(F.count(F.lit(1)).alias("seeds")))


def read_stats(lines: DataFrame, group: str = "file") -> DataFrame:
    """Reads per input from its line count (four lines a read)."""
    return lines.groupBy(group).agg(F.floor(F.count(F.lit(1)) / 4).alias("reads"))


def placed_stats(placements: DataFrame, read: str = "read_id") -> DataFrame:
    """Distinct reads placed and all placements."""
    return placements.groupBy(read).agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("reads"), F.sum("n").alias("placements"))


def short_probe_table(probes: DataFrame, mer: int, count: int, seq: str = "seq", id: str = "probe_id") -> DataFrame:
    """Probes and their reverse complements cut into `count` mers of fixed size (side 0/1)."""
    cut = lambda s: [F.substr(s, F.lit(1 + i * mer), F.lit(mer)).alias(f"mer{i}") for i in range(count)]
    both = probes.select(id, F.posexplode(F.array(F.lower(F.col(seq)), S.revcomp(F.lower(F.col(seq))))).alias("side", "_s"))
    return both.where(F.length("_s") >= mer * count).select(id, "side", *cut(F.col("_s")))


def exact_hits(hits: DataFrame) -> DataFrame:
    """Full-length, mismatch-free hits on regular chromosomes, as BED columns and FASTA text."""
    good = hits.where(~F.col("chr").contains("_") & (F.col("qstart") == 1) & (F.col("qend") == F.col("qlength"))
                      & (F.col("mismatches") == 0) & (F.length("qseq") == F.col("qlength")))
    body = F.regexp_replace("hseq", "(.{1,50})", "$1\n")
    return good.select("chr", "hstart", "hend", "probe", F.concat(
        F.lit(">"), "probe", F.lit("="), "chr", F.lit("@"), "hstart", F.lit("-"), "hend", F.lit("\n"), body).alias("fasta"))


def exact_hit_stats(hits: DataFrame) -> DataFrame:
    """Skipped hits by reason; probes placed once and more than once."""
    other = F.col("chr").contains("_")
    exact = ((F.col("qstart") == 1) & (F.col("qend") == F.col("qlength")) & (F.col("mismatches") == 0)
             & (F.length("qseq") == F.col("qlength")))
    per = hits.groupBy("probe").agg(F.count_if(other).alias("a"), F.count_if(~other & ~exact).alias("b"),
                                    F.count_if(~other & exact).alias("c"))
    return per.agg(F.sum("a").alias("skip_non_chr"), F.sum("b").alias("skip_non_exact"),
                   F.count_if(F.col("c") == 1).alias("placed_once"), F.count_if(F.col("c") > 1).alias("placed_more"))
