"""k-mers of sequences, seed joins and candidate pairs on a reference.

References come as chunks (chr, chunk_no, seq) of fixed size, so no row holds a
whole chromosome. Joins are equi-joins on the k-mer's code; AQE splits the
partitions of low-complexity k-mers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import seq as S
from ..scale import carry_last, lookup
from ..session import stored

PIECE = 1024


def explode_kmers(df: DataFrame, k: int, seq: str = "seq", keep: tuple[str, ...] = ("doc_id",), shorter: int = 0) -> DataFrame:
    """(keep…, pos, kmer): every k-long window with its 0-based position.

    A sequence is first cut into pieces overlapping by k-1, so the position
    list built per row stays small however long the sequence is; windows are
    taken on bytes, where a slice does not rescan the text. With `shorter`
    windows may be up to that many letters short at the end of the sequence.
    """
    least = k - shorter
    b = df.where(F.length(seq) >= least).select(*keep, F.encode(seq, "US-ASCII").alias("_b"))
    pieces = b.select(*keep, "_b", F.explode(
        F.sequence(F.lit(0).cast("long"), F.floor((F.length("_b") - least) / PIECE))).alias("_c"))
    cut = pieces.select(*keep, "_c", F.substring("_b", (F.col("_c") * PIECE + 1).cast("int"), F.lit(PIECE + k - 1)).alias("_b"),
                        (F.length("_b") - least - F.col("_c") * PIECE).alias("_last"))
    at = cut.select(*keep, "_c", "_b", F.explode(F.sequence(
        F.lit(0).cast("long"), F.least(F.col("_last"), F.lit(PIECE - 1)))).alias("_i"))
    return at.select(*keep, (F.col("_c") * PIECE + F.col("_i")).alias("pos"),
                     F.substring("_b", (F.col("_i") + 1).cast("int"), F.lit(k)).cast("string").alias("kmer"))


def chunk_sequences(df: DataFrame, chunk: int, chr: str = "chr", seq: str = "seq", margin: int = 0) -> DataFrame:
    """Whole sequences to chunk rows (chr, chunk_no, seq), each with `margin` letters of what follows."""
    b = df.where(F.length(seq) > 0).select(F.col(chr).alias("chr"), F.encode(seq, "US-ASCII").alias("_b"))
    return (b.select("chr", "_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.length("_b") - 1) / chunk))).alias("chunk_no"))
            .select("chr", "chunk_no", F.substring("_b", (F.col("chunk_no") * chunk + 1).cast("int"), F.lit(chunk + margin)).cast("string").alias("seq")))


def glued(chunks: DataFrame, chunk: int, margin: int) -> DataFrame:
    """Chunks followed by up to `margin` letters of the chunks after them, as far as these follow on without a hole."""
    near = -(-margin // chunk)
    parts = (chunks.select("chr", "chunk_no", F.left("seq", F.lit(chunk)).alias("_part"), F.explode(F.sequence(F.lit(0), F.lit(near))).alias("_j"))
             .groupBy("chr", (F.col("chunk_no") - F.col("_j")).alias("chunk_no")).agg(F.array_sort(F.collect_list(F.struct("_j", "_part"))).alias("_parts")))
    # A part counts only if the letters before it are all there.
    text = F.aggregate("_parts", F.lit(""), lambda done, x: F.when(F.length(done) == x["_j"] * chunk, F.concat(done, x["_part"])).otherwise(done))
    return parts.select("chr", "chunk_no", F.left(text, F.lit(chunk + margin)).alias("seq")).where("seq <> ''")


def reference_slice(df: DataFrame, chunks: DataFrame, chunk: int, at, length, out: str, chr: str = "chr", most: int | None = None) -> DataFrame:
    """Reference letters [at, at + length) (0-based) of each row, shorter only at the end of a sequence or before an absent chunk.

    Every chunk is glued to as many followers first as slices of up to `most`
    letters (a chunk, if not given) may reach, so a slice needs one lookup and no
    margin. A longer slice and a start below 0 are errors; a row whose start lies in no chunk is left out.
    """
    most = most or chunk
    c = glued(chunks, chunk, most).select(F.col("chr").alias("_rchr"), F.col("chunk_no").alias("_no"), F.col("seq").alias("_seq"))
    start = F.when(at >= 0, at).otherwise(F.raise_error(F.lit("a slice starts before the reference")).cast("long"))
    a = df.withColumn("_at", start)
    size = F.when(length <= most, length.cast("int")).otherwise(F.raise_error(F.lit("a slice is longer than a chunk of the reference")).cast("int"))
    return (a.join(c, (F.col(chr) == F.col("_rchr")) & (F.floor(F.col("_at") / chunk) == F.col("_no")))
            .withColumn(out, F.substr("_seq", (F.col("_at") % chunk + 1).cast("int"), size))
            .drop("_rchr", "_no", "_seq", "_at"))


def fill_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks with each run of ambiguous letters replaced by the base before it, over chunk ends; a leading run by the first base."""
    low = chunks.withColumn("seq", F.lower("seq"))
    base = lambda form: F.nullif(F.regexp_extract("seq", form, 1), F.lit(""))
    edges = low.select("chr", "chunk_no", base("^[^acgt]*([acgt])").alias("_first"), base("([acgt])[^acgt]*$").alias("_last"))
    # Only chunks before the first base of all look ahead.
    lead = edges.groupBy("chr").agg(F.min_by("_first", F.when(F.col("_first").isNotNull(), F.col("chunk_no"))).alias("_lead"))
    carried = (carry_last(edges, ["chr"], "chunk_no", "_last", "_carry").join(lead, "chr")
               .select("chr", "chunk_no", F.coalesce("_carry", "_lead").alias("_carry")))
    return low.join(carried, ["chr", "chunk_no"]).select("chr", "chunk_no", F.when(F.col("_carry").isNull(), F.col("seq")).otherwise(
        F.substr(S.fill_ambiguous(F.concat("_carry", "seq")), F.lit(2))).alias("seq"))


def all_kmers(chunks: DataFrame, k: int, chunk: int, ahead: int = 0) -> DataFrame:
    """(chr, pos, kmer) of a chunked reference, windows crossing chunk ends included; the same at every chunk size.

    With `ahead` each row also has up to so many letters that follow the k-mer,
    so that what lies behind a hit needs no further lookup.
    """
    filled = glued(fill_chunks(chunks), chunk, k - 1 + ahead)
    at = (explode_kmers(filled, k + ahead, "seq", ("chr", "chunk_no"), shorter=ahead).where(F.col("pos") < chunk)
          .withColumn("pos", F.col("chunk_no") * chunk + F.col("pos")))
    if not ahead:
        return at.select("chr", "pos", "kmer")
    return at.select("chr", "pos", F.left("kmer", F.lit(k)).alias("kmer"), F.substr("kmer", F.lit(k + 1)).alias("ahead", metadata={"letters": ahead}))


def gapped_from_windows(windows: DataFrame, k: int, gap_min: int, gap_max: int, gap_pos: int) -> DataFrame:
    """k-mers skipping g letters at offset `gap_pos`, with position code pos * (1+gap_max-gap_min) + (g-gap_min).

    `windows` holds windows of k + gap_max letters, shorter ones at the end.
    """
    g = windows.withColumn("g", F.explode(F.sequence(F.lit(gap_min), F.lit(gap_max)))).where(
        F.length("kmer") >= k + F.col("g"))
    joined = F.concat(F.left("kmer", F.lit(gap_pos)), F.substr("kmer", F.col("g") + gap_pos + 1, F.lit(k - gap_pos)))
    return g.select("chr", (F.col("pos") * (1 + gap_max - gap_min) + F.col("g") - gap_min).alias("pos"), joined.alias("kmer"))


def all_gapped_kmers(seqs: DataFrame, k: int, gap_min: int, gap_max: int, gap_pos: int, chunk: int | None = None) -> DataFrame:
    """Gapped k-mers of a reference, those at the very end included; the same at every chunk size.

    With `chunk`, `seqs` holds chunks (chr, chunk_no, seq) of so many letters, so no row holds a chromosome: a chunk
    gets the k + gap_max - 1 letters behind it, as far as these follow on without a hole. Without it, `seqs` holds
    whole sequences (chr, seq), which are cut first. Ambiguous letters are filled as in `all_kmers`.
    """
    if chunk is None:
        chunk = PIECE
        seqs = chunk_sequences(seqs, chunk)
    filled = glued(fill_chunks(seqs), chunk, k + gap_max - 1)
    w = (explode_kmers(filled, k + gap_max, "seq", ("chr", "chunk_no"), shorter=gap_max - gap_min).where(F.col("pos") < chunk)
         .withColumn("pos", F.col("chunk_no") * chunk + F.col("pos")))
    return gapped_from_windows(w, k, gap_min, gap_max, gap_pos)


def neighbours(df: DataFrame, k: int, mer: str = "mer", variant: str = "variant", err: str = "err", packed: bool = False) -> DataFrame:
    """Every row with all strings at most one substitution from its mer.

    `err` is the 0-based changed position, -1 for the mer itself. A mer with one
    ambiguous letter gives its four resolutions, with more it gives no row. The
    variants are numbered and spelled by plain column expressions, which stay in
    generated code; this is the widest fan-out of the placement queries. With
    `packed` a row holds the array of all variants of one changed position.
    """
    low = df.withColumn("_m", F.lower(mer)).withColumn("_n", F.length(F.translate("_m", "acgt", "")))
    # 0 is the mer itself, 1 + 3i + s moves letter i by s + 1; 3k + 1.. resolve.
    number = (F.when(F.col("_n") == 0, F.sequence(F.lit(0), F.lit(3 * k)))
              .when(F.col("_n") == 1, F.sequence(F.lit(3 * k + 1), F.lit(3 * k + 4))))
    spot = F.length(F.regexp_extract("_m", "^([acgt]*)", 1))
    low = low.withColumn("_spot", F.when(F.col("_n") == 1, spot))
    if packed:
        # -1 is the mer itself.
        places = (F.when(F.col("_n") == 0, F.sequence(F.lit(-1), F.lit(k - 1))).when(F.col("_n") == 1, F.array("_spot")))
        each = low.withColumn(err, F.explode(places))
        head, tail = F.substr("_m", F.lit(1), F.greatest(F.col(err), F.lit(0))), F.substr("_m", F.col(err) + 2)
        spelled = F.transform(F.array(*[F.lit(b) for b in "acgt"]), lambda b: F.concat(head, b, tail))
        unlike = F.filter(spelled, lambda v: v != F.col("_m"))
        return each.withColumn(variant, F.when(F.col(err) == -1, F.array("_m")).when(F.col("_n") == 1, spelled).otherwise(unlike)).drop("_m", "_n", "_spot")
    each = low.withColumn("_v", F.explode(number))
    resolving = F.col("_v") > 3 * k
    at = F.when(F.col("_v") == 0, -1).when(resolving, F.col("_spot")).otherwise(F.floor((F.col("_v") - 1) / 3).cast("int"))
    each = each.withColumn(err, at)
    old = F.instr(F.lit("acgt"), F.substr("_m", F.col(err) + 1, F.lit(1))) - 1
    letter = F.when(resolving, F.col("_v") - (3 * k + 1)).otherwise((old + (F.col("_v") - 1) % 3 + 1) % 4)
    spelled = F.concat(F.substr("_m", F.lit(1), F.col(err)), F.substr(F.lit("acgt"), letter + 1, F.lit(1)), F.substr("_m", F.col(err) + 2))
    return each.withColumn(variant, F.when(F.col("_v") == 0, F.col("_m")).otherwise(spelled)).drop("_m", "_n", "_spot", "_v")


# Most bits of a seed filter; 2k bits make it exact.
FILTER_BITS = 28
# Bits of the filter by text before a small index.
TEXT_BITS = 26


def _bit_table(slots: DataFrame, words: int) -> DataFrame:
    """One row with the array `t` of `words` longs that have the bit of every long `slot` set."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("slot") % 64).cast("int"))
    set_bits = slots.select(F.shiftright("slot", 6).alias("w"), one.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    every = slots.sparkSession.range(words).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b"))
    return (set_bits.union(every).groupBy("w").agg(F.bit_or("b").alias("b")).agg(F.sort_array(F.collect_list(F.struct("w", "b"))).alias("t"))
            .select(F.transform("t", lambda x: x["b"]).alias("t")))


class KmerIndex:
    """A reference's k-mers under their 2-bit codes (k <= 31), written once.

    A small index is broadcast; a bit table by the hashes of its mers and of
    their neighbours sorts out most mers without a hit before they are widened.
    Of a large one a bit table of the keys is made, so that only keys that the
    reference may have are shuffled. Either table is an aggregate of fixed size.
    """

    def __init__(self, ref_kmers: DataFrame, k: int):
        if k > 31:
            raise ValueError("k-mer codes have at most 31 letters")
        self.k = k
        low = F.lower("kmer")
        rows = ref_kmers.where((F.length("kmer") == k) & (F.translate(low, "acgt", "") == "")).withColumn("_key", S.kmer_code(low)).drop("kmer")
        self.rows, self.small = lookup(rows, "kmer-index")
        self._texts: dict[int, DataFrame] = {}

    def _slot(self, key):
        bits = min(FILTER_BITS, 2 * self.k)
        return key if bits == 2 * self.k else F.pmod(F.xxhash64(key), F.lit(1 << bits))

    def may_have(self, key):
        """Whether the bit of a key is set."""
        words = 1 << (min(FILTER_BITS, 2 * self.k) - min(6, 2 * self.k))
        table = _bit_table(self.rows.select(self._slot(F.col("_key")).alias("slot")), words).scalar()
        at = self._slot(key)
        return F.getbit(F.get(table, F.shiftright(at, 6).cast("int")), (at % 64).cast("int")) == 1

    def near(self, reads: DataFrame, max_mm: int, *mers: str) -> DataFrame:
        """Reads without those that have a mer of `mers` more than `max_mm` (<= 1) substitutions from every indexed one.

        A hash may keep others too. All reads stay if the index is large, and mers with ambiguous letters or of another length do.
        """
        if not self.small:
            return reads
        slot = lambda text: F.xxhash64(text).bitwiseAND(F.lit((1 << TEXT_BITS) - 1))
        if max_mm not in self._texts:
            keys = self.rows.select("_key").distinct()
            if max_mm:
                changes = F.array(F.lit(0).cast("long"), *[F.lit(c << 2 * i).cast("long") for i in range(self.k) for c in (1, 2, 3)])
                keys = keys.select("_key", F.explode(changes).alias("_c")).select(F.col("_key").bitwiseXOR(F.col("_c")).alias("_key")).distinct()
            table = _bit_table(keys.select(slot(S.kmer_text("_key", self.k)).alias("slot")), 1 << TEXT_BITS - 6)
            self._texts[max_mm] = stored(table, "kmer-bits")
        table = self._texts[max_mm].scalar()
        for mer in mers:
            at = slot(F.lower(mer))
            has = F.getbit(F.get(table, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1
            reads = reads.where(has | (F.translate(mer, "acgtACGT", "") != "") | (F.length(mer) != self.k))
        return reads

    def hits(self, reads: DataFrame, max_mm: int = 1, mer: str = "mer") -> DataFrame:
        """(read columns…, chr, pos…, err) for reads whose `mer` is at most `max_mm` (<= 1) substitutions from an indexed one."""
        if self.small:
            return widened(self.near(reads, max_mm, mer), self.k, max_mm, mer).join(self.rows, "_key").drop("_key")
        # Distinct mers are widened and filtered, the reads come back to them by the mer.
        keys = widened(reads.select(mer).distinct(), self.k, max_mm, mer)
        return reads.join(keys.where(self.may_have(F.col("_key"))).join(self.rows, "_key").drop("_key"), mer)


def code_test(keys: DataFrame, k: int, max_mm: int):
    """A test for columns of codes: whether a code is at most `max_mm` (<= 1) substitutions from one in `_key`. One bit for each code there is (k <= 13)."""
    if max_mm:
        changes = F.array(F.lit(0).cast("long"), *[F.lit(c << 2 * i).cast("long") for i in range(k) for c in (1, 2, 3)])
        keys = keys.distinct().select("_key", F.explode(changes).alias("_c")).select(F.col("_key").bitwiseXOR(F.col("_c")).alias("_key"))
    table = stored(_bit_table(keys.select(F.col("_key").alias("slot")), 1 << 2 * k - 6), "code-bits").scalar()
    return lambda code: F.getbit(F.get(table, F.shiftright(code, 6).cast("int")), code.bitwiseAND(F.lit(63)).cast("int")) == 1


def widened(reads: DataFrame, k: int, max_mm: int = 1, mer: str = "mer") -> DataFrame:
    """Reads with the codes `_key` of all mers at most `max_mm` (<= 1) substitutions away and `err`, the changed position or -1.

    A mer with one ambiguous letter gives its four resolutions, with more it gives no row; so `neighbours`, in whole numbers.
    """
    low = F.lower(mer)
    digits = F.translate(low, "acgt", "0123")
    base = (reads.where(F.length(mer) == k).withColumn("_n", F.length(F.translate(low, "acgt", "")))
            .withColumn("_code", F.conv(F.regexp_replace(digits, "[^0-3]", "0"), 4, 10).cast("long")))
    if not max_mm:
        return base.where("_n = 0").withColumnRenamed("_code", "_key").withColumn("err", F.lit(-1)).drop("_n")
    # 0 is the mer itself, 1 + 3i + s changes letter i, 3k + 1.. resolve.
    number = (F.when(F.col("_n") == 0, F.sequence(F.lit(0), F.lit(3 * k))).when(F.col("_n") == 1, F.sequence(F.lit(3 * k + 1), F.lit(3 * k + 4))))
    spot = F.when(F.col("_n") == 1, F.length(F.regexp_extract(low, "^([acgt]*)", 1)))
    each = base.withColumn("_spot", spot).withColumn("_v", F.explode(number))
    v, resolving = F.col("_v"), F.col("_v") > 3 * k
    err = F.when(v == 0, -1).when(resolving, F.col("_spot")).otherwise(F.floor((v - 1) / 3).cast("int"))
    change = F.when(v == 0, 0).when(resolving, v - (3 * k + 1)).otherwise((v - 1) % 3 + 1).cast("long")
    at = F.when(v == 0, 0).otherwise(2 * (k - 1 - F.when(resolving, F.col("_spot")).otherwise(F.floor((v - 1) / 3).cast("int"))))
    return each.withColumns({"err": err, "_key": F.col("_code").bitwiseXOR(F.call_function("shiftleft", change, at.cast("int")))}).drop("_n", "_code", "_spot", "_v")


def mer_codes(mer: str, code: str, ambiguous: str) -> list:
    """The 2-bit code of a mer, ambiguous letters as 0, and a mask with a bit for each of them."""
    digits = F.translate(F.lower(mer), "acgt", "0123")
    number = lambda text: F.conv(text, 4, 10).cast("long")
    return [number(F.regexp_replace(digits, "[^0-3]", "0")).alias(code),
            number(F.regexp_replace(F.translate(digits, "123", "000"), "[^0]", "1")).alias(ambiguous)]


def code_differences(code, other, ambiguous, k: int):
    """A bit for each letter in which two codes differ; letters of `ambiguous` always do."""
    x = code.bitwiseXOR(other)
    return x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(int("01" * k, 2))).bitwiseOR(ambiguous)


def kmer_join(reads: DataFrame, ref_kmers: DataFrame, k: int, max_mm: int = 1, mer: str = "mer") -> DataFrame:
    """Reference hits of each read seed: (read columns…, chr, pos, err), err -1 for exact.

    The neighbours (1 + 3k keys per seed) are made on the read side, so the reference is moved once, unexpanded.
    """
    return KmerIndex(ref_kmers.select("chr", "pos", "kmer"), k).hits(reads, max_mm, mer)


def kmer_members(df: DataFrame, mers: DataFrame, mer: str = "kmer") -> DataFrame:
    """Rows whose k-mer occurs in `mers`."""
    return df.join(mers.select(mer).distinct(), mer, "left_semi")


def pairs_within(left: DataFrame, right: DataFrame, keys: list[str], left_pos: str, right_pos: str, lo: int, hi: int) -> DataFrame:
    """Pairs with equal keys and lo <= right_pos - left_pos <= hi.

    Positions are binned by the width of the allowed range: a left row looks
    into one or two bins instead of meeting every row of its key.
    """
    width = max(hi - lo + 1, 64)
    l = left.withColumn("_bin", F.explode(F.sequence(
        F.floor((F.col(left_pos) + lo) / width), F.floor((F.col(left_pos) + hi) / width))))
    r = right.withColumn("_bin", F.floor(F.col(right_pos) / width))
    gap = F.col(right_pos) - F.col(left_pos)
    return l.join(r, keys + ["_bin"]).where((gap >= lo) & (gap <= hi)).drop("_bin")


def candidate_pairs(mers: DataFrame, chunks: DataFrame, chunk: int, k: int, gap_lo: int, gap_hi: int, max_letters: int = 2) -> DataFrame:
    """Hit mers `gap_lo`..`gap_hi` letters apart whose gap uses at most `max_letters` bases.
    """
    a = mers.select("chr", F.col("pos").alias("pos0"), F.col("kmer").alias("mer0"), F.col("err").alias("err0"))
    b = mers.select("chr", F.col("pos").alias("pos1"), F.col("kmer").alias("mer1"), F.col("err").alias("err1"))
    pairs = pairs_within(a, b, ["chr"], "pos0", "pos1", k + gap_lo, k + gap_hi).withColumn("gap", F.col("pos1") - F.col("pos0") - k)
    sliced = reference_slice(pairs, chunks, chunk, F.col("pos0") + k, F.col("gap"), "gap_seq")
    letters = sum(((F.instr(F.col("gap_seq"), b_) > 0).cast("int") for b_ in "acgt"), F.lit(0))
    return sliced.where(letters <= max_letters)


def verify_candidates(cands: DataFrame, reads: DataFrame) -> DataFrame:
    """Candidates whose two mers equal a read's, with the read's id."""
    return cands.join(reads.select("sample", "mer0", "mer1"), ["mer0", "mer1"])
