"""Interval and point-in-region joins.

Spark plans a bare range predicate as a nested loop. Coordinates are cut into
bins instead and joined by equality on (chr, bin). The looked-up side is packed
to one row per bin, holding at most `bin_size` distinct positions whatever the
number of input rows, so a hot bin makes no pair blow-up and AQE may split the
other side freely. All intervals are 1-based closed unless stated.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..scale import lookup

BIN = 1024


def _col(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _bin(col, size: int) -> Column:
    return F.floor(_col(col) / size)


def points_by_bin(points: DataFrame, chr: str = "chr", pos: str = "pos", bin_size: int = BIN) -> DataFrame:
    """(chr, bin, ps): sorted distinct positions of each non-empty bin."""
    return (points.where(F.col(pos).isNotNull())
            .groupBy(F.col(chr).alias("_chr"), _bin(pos, bin_size).alias("_bin"))
            .agg(F.array_sort(F.collect_set(F.col(pos).cast("long"))).alias("ps")))


def next_point_index(points: DataFrame, chr: str = "chr", pos: str = "pos", bin_size: int = BIN) -> DataFrame:
    """`points_by_bin` made dense: every bin up to the last also knows the first position after it."""
    packed = points_by_bin(points, chr, pos, bin_size)
    along = W.partitionBy("_chr").orderBy("_bin")
    linked = packed.select(
        "_chr", "_bin", "ps",
        F.lead("_bin").over(along).alias("_nextbin"), F.lead(F.element_at("ps", 1)).over(along).alias("nxt"),
        F.row_number().over(along).alias("_i"))
    gaps = linked.where("_nextbin > _bin + 1").select(
        "_chr", F.explode(F.sequence(F.col("_bin") + 1, F.col("_nextbin") - 1)).alias("_bin"), "nxt")
    head = linked.where("_i = 1 and _bin > 0").select(
        "_chr", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_bin") - 1)).alias("_bin"),
        F.element_at("ps", 1).alias("nxt"))
    empty = gaps.unionByName(head).withColumn("ps", F.array().cast("array<bigint>"))
    return linked.select("_chr", "_bin", "ps", "nxt").unionByName(empty)


def interval_semi(df: DataFrame, points: DataFrame, invert: bool = False, chr: str = "chr",
                  start: str = "start_pos", end: str = "end_pos", pos: str = "pos",
                  bin_size: int = BIN) -> DataFrame:
    """Rows whose [start, end] covers at least one point (or none, with `invert`).

    An interval covers a point iff the first point at or after its start is not
    past its end: one lookup per row, whatever the interval's length.
    """
    index = next_point_index(points, pos=pos, bin_size=bin_size)
    s, e = F.col(start), F.col(end)
    first = F.coalesce(F.array_min(F.filter("ps", lambda p: p >= s)), F.col("nxt"))
    on = (F.col(chr) == F.col("_chr")) & (_bin(start, bin_size) == F.col("_bin")) & (first <= e)
    return df.join(index, on, "left_anti" if invert else "left_semi")


def reference_points(rows: DataFrame, n_cols: str = "n_cols") -> DataFrame:
    """One row per (chr, pos), the one with most columns; BED rows (start + 1 = end) shifted to 1-based.

    `rows` has chr, pos, second (the next numeric column or NULL) and `n_cols`.
    """
    from ..scale import first_row
    shifted = rows.withColumn("pos", F.when(F.col("second") == F.col("pos") + 1, F.col("pos") + 1)
                              .otherwise(F.col("pos")))
    order = [F.col(n_cols)] + [F.col(c) for c in shifted.columns if c not in ("chr", "pos", n_cols)]
    return first_row(shifted, ["chr", "pos"], order, last=True)


def region_index(regions: DataFrame, chr: str = "chr", start: str = "start_pos", end: str = "end_pos",
                 bin_size: int = BIN) -> DataFrame:
    """(chr, bin, spans): union of all regions inside each bin as at most `bin_size` (lo, hi) spans."""
    cut = (regions.where(F.col(start) <= F.col(end))
           .select(F.col(chr).alias("_chr"), F.col(start).alias("_s"), F.col(end).alias("_e"),
                   F.explode(F.sequence(_bin(start, bin_size), _bin(end, bin_size))).alias("_bin")))
    clipped = cut.groupBy("_chr", "_bin", F.greatest("_s", F.col("_bin") * bin_size).alias("lo")).agg(
        F.max(F.least("_e", F.col("_bin") * bin_size + (bin_size - 1))).alias("hi"))
    return clipped.groupBy("_chr", "_bin").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def in_regions(points: DataFrame, regions: DataFrame, margin: int = 0, padding: int = 0, invert: bool = False,
               chr: str = "chr", pos: str = "pos", bin_size: int = BIN) -> DataFrame:
    """Points inside any region shrunk by `margin` (or grown by `padding`) at both ends.

    `end_pos = 0` stands for the whole chromosome; regions that shrink to
    nothing are skipped.
    """
    sized = regions.select(
        "chr", (F.col("start_pos") + margin - padding).alias("start_pos"),
        (F.col("end_pos") - margin + padding).alias("end_pos"), (F.col("end_pos") == 0).alias("_whole"))
    sized = sized.withColumn("start_pos", F.greatest(F.col("start_pos"), F.lit(0)))
    index = region_index(sized.where("not _whole"), bin_size=bin_size)
    whole = sized.where("_whole").select(F.col("chr").alias("_wchr")).distinct()
    p = F.col(pos)
    inside = F.coalesce(F.exists("spans", lambda r: (r["lo"] <= p) & (r["hi"] >= p)), F.lit(False))
    joined = (points.join(index, (F.col(chr) == F.col("_chr")) & (_bin(pos, bin_size) == F.col("_bin")), "left")
              .join(whole, F.col(chr) == F.col("_wchr"), "left"))
    keep = inside | F.col("_wchr").isNotNull()
    return joined.where(~keep if invert else keep).select(*points.columns)


# Bins are gathered by FAN into nodes, these again: a span is cut into few nodes however long it is.
FAN = 64
LEVELS = 4


def _span_nodes(lo: Column, hi: Column) -> Column:
    """(level, node) that together cover the bins lo..hi once, the largest nodes that fit."""
    low = [F.ceil(lo / FAN ** i) for i in range(LEVELS + 1)]
    top = [F.floor((hi + 1) / FAN ** i) for i in range(LEVELS + 1)]
    none = F.array().cast("array<bigint>")
    numbers = lambda x, y: F.when(x < y, F.sequence(x.cast("long"), (y - 1).cast("long"))).otherwise(none)
    level = lambda i: lambda n: F.struct(F.lit(i).alias("_level"), n.alias("_node"))
    parts = []
    for i in range(LEVELS):
        inner = F.when(low[i + 1] < top[i + 1], F.concat(numbers(low[i], low[i + 1] * FAN), numbers(top[i + 1] * FAN, top[i])))
        nodes = numbers(low[i], top[i]) if i == LEVELS - 1 else inner.otherwise(numbers(low[i], top[i]))
        parts.append(F.transform(nodes, level(i)))
    return F.concat(*parts)


def _placed(rows: DataFrame, start, end, bin_size: int, homes: list[int] | None) -> DataFrame:
    """A row for each node of a span: its first bin is its home, nodes over its further bins are not.

    `homes` are the levels that the other side's nodes reach; None if neither side goes beyond single bins.
    """
    rows = rows.where(_col(start).isNotNull() & _col(end).isNotNull())
    first, last = _bin(start, bin_size), _bin(end, bin_size)
    if homes is None:
        return rows.select("*", F.lit(0).alias("_level"), F.explode(F.sequence(first, F.greatest(first, last))).alias("_node")).withColumn("_home", F.col("_node") == first)
    own = F.array(*[F.struct(F.lit(i).alias("_level"), F.floor(first / FAN ** i).alias("_node"), F.lit(True).alias("_home")) for i in homes])
    further = F.transform(_span_nodes(first + 1, last), lambda n: F.struct(n["_level"].alias("_level"), n["_node"].alias("_node"), F.lit(False).alias("_home")))
    return rows.select("*", F.inline(F.when(first < last, F.concat(own, further)).otherwise(own)))


def span_sizes(rows: DataFrame, start, end) -> tuple[int, float]:
    """The longest span and the mean length."""
    size = _col(end) - _col(start) + 1
    longest, mean = rows.where(_col(start) <= _col(end)).agg(F.max(size), F.avg(size)).first()
    return int(longest or 1), float(mean or 1)


def meet(left: DataFrame, right: DataFrame, keys, left_span, right_span, bin_size: int = BIN, sizes=None, how: str = "inner", also: Column | None = None) -> DataFrame:
    """`left` joined with the rows of `right` whose span overlaps, under the condition `also`; column names must differ. `sizes`: of both, if known.

    The later start of two spans lies in both, so a pair meets in the bin of that start, where one row is at home. A row
    is moved once for its home and once for each further node, in one join; rows of `left` stay together with all they meet.
    Bins are about as wide as the spans of the wider side are on average: fewer nodes a row, and not many more candidates than pairs.
    """
    (ls, le), (rs, re_) = left_span, right_span
    (far_l, mean_l), (far_r, mean_r) = sizes or (span_sizes(left, ls, le), span_sizes(right, rs, re_))
    bin_size = min(bin_size, 1 << (math.ceil(max(mean_l, mean_r, 1)) - 1).bit_length())
    levels = lambda far: [i for i in range(LEVELS) if i == 0 or FAN ** i <= (far - 1) // bin_size + 2]
    flat = levels(far_l) == levels(far_r) == [0]
    l = _placed(left, ls, le, bin_size, None if flat else levels(far_r))  # noqa: E741
    r = _placed(right, rs, re_, bin_size, None if flat else levels(far_l)).withColumnsRenamed({"_level": "_l", "_node": "_n", "_home": "_h"})
    same = F.col("_node") == F.col("_n")
    for a, b in keys:
        same = (F.col(a) == F.col(b)) & same
    once = F.col("_home") | F.col("_h")
    if not flat:
        same = same & (F.col("_level") == F.col("_l"))
        once = once & ((F.col("_home") != F.col("_h")) | (F.col("_level") == 0))
    on = same & (_col(ls) <= _col(re_)) & (_col(rs) <= _col(le)) & once
    return l.join(r, on if also is None else on & also, how).drop("_level", "_node", "_home", "_l", "_n", "_h")


def interval_join(left: DataFrame, right: DataFrame, bin_size: int = BIN, chr: str = "chr",
                  left_span=("start_pos", "end_pos"), right_span=("start_pos", "end_pos"),
                  suffix: str = "_r") -> DataFrame:
    """Pairs of overlapping rows, each once.

    Right columns get `suffix`. The pairs are the result, so their number is the
    overlap count; AQE splits hot nodes on either side.
    """
    r = right.select(*[F.col(c).alias(c + suffix) for c in right.columns])
    columns = [*left.columns, *(c for c in r.columns if c != chr + suffix)]
    return meet(left, r, [(chr, chr + suffix)], left_span, tuple(c + suffix for c in right_span), bin_size).select(*columns)


def point_in_region(points: DataFrame, regions: DataFrame, margin: int = 0) -> DataFrame:
    """Array probes inside the regions, with alleles of minus-strand probes reverse-complemented."""
    from ..functions.seq import revcomp
    kept = in_regions(points, regions, margin)
    minus = F.col("strand") == "-"
    return kept.withColumn("alleles", F.when(
        minus, F.concat(revcomp("allele_a"), revcomp("allele_b"))).otherwise(F.concat("allele_a", "allele_b")))


def regions_restrict(df: DataFrame, bed: DataFrame, padding: int = 0) -> DataFrame:
    """Rows whose position lies in the padded intervals."""
    return in_regions(df, bed, padding=padding)


def nearest_lookup(df: DataFrame, snps: DataFrame) -> DataFrame:
    """Attach the name of the reference row at the same (chr, pos); smallest name if several."""
    names = snps.groupBy("chr", "pos").agg(F.min("name").alias("name"))
    return df.join(names, ["chr", "pos"], "left")


def snplist_to_bed(df: DataFrame) -> DataFrame:
    """BED rows of a named position list."""
    return df.select("chr", (F.col("pos") - 1).alias("start0"), F.col("pos").alias("end0"),
                     F.coalesce("name", F.lit(".")).alias("name"))


def pileup_columns(calls: DataFrame, alignments: DataFrame, bin_size: int = BIN) -> DataFrame:
    """(chr, pos, base, start): reads over each called position, with count and quality sum.

    Counts are combined before the shuffle per (position, base, read start), so
    a deep position costs at most read length x letters rows.
    """
    index, _ = lookup(points_by_bin(calls, bin_size=bin_size), "called-positions")
    spread = (alignments
              .withColumn("_b", F.explode(F.sequence(_bin("start_pos", bin_size), _bin("end_pos", bin_size))))
              .join(index, (F.col("chr") == F.col("_chr")) & (F.col("_b") == F.col("_bin"))))
    s, e = F.col("start_pos"), F.col("end_pos")
    hits = spread.withColumn("pos", F.explode(F.filter("ps", lambda p: (p >= s) & (p <= e))))
    offset = F.col("pos") - F.col("start_pos") + 1
    return (hits.select("chr", "pos", "start_pos",
                        F.upper(F.substr("bases", offset, F.lit(1))).alias("base"),
                        (F.ascii(F.substr("quals", offset, F.lit(1))) - 33).alias("q"))
            .groupBy("chr", "pos", "base", "start_pos")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("qsum")))


def pileup_join(calls: DataFrame, alignments: DataFrame, bin_size: int = BIN) -> DataFrame:
    """Per called position and base: reads, quality sum and distinct read starts."""
    return (pileup_columns(calls, alignments, bin_size).groupBy("chr", "pos", "base")
            .agg(F.sum("n").alias("n_reads"), F.sum("qsum").alias("qual_sum"), F.count(F.lit(1)).alias("n_starts")))


def attach_ref_base(df: DataFrame, ref_chunks: DataFrame, chunk: int, only_different: bool = True,
                    allele: str = "call") -> DataFrame:
    """Reference base at a 1-based position from fixed-size reference chunks (chr, chunk_no, seq)."""
    chunks = ref_chunks.select(F.col("chr").alias("_rchr"), F.col("chunk_no").alias("_no"), F.col("seq").alias("_seq"))
    at = F.col("pos") - 1
    joined = df.join(chunks, (F.col("chr") == F.col("_rchr")) & (F.floor(at / chunk) == F.col("_no")))
    out = joined.withColumn("ref_allele", F.upper(F.substr("_seq", at % chunk + 1, F.lit(1))))
    out = out.where(F.col("ref_allele") != "").drop("_rchr", "_no", "_seq")
    return out.where(F.upper(F.col(allele)) != F.col("ref_allele")) if only_different else out


def context_slice(regions: DataFrame, ref_chunks: DataFrame, chunk: int, context: int = 0) -> DataFrame:
    """Sequence of each interval and `context` bases around it, clamped to the reference start.

    `ref_chunks` is (chr, chunk_no, seq). A region pulls only the chunks it
    touches; pieces are glued in chunk order.
    """
    from ..functions.seq import revcomp
    lo = F.greatest(F.col("start_pos") - 1 - context, F.lit(0))
    hi = F.col("end_pos") + context
    chunks = ref_chunks.select(F.col("chr").alias("_rchr"), F.col("chunk_no").alias("_no"), F.col("seq").alias("_seq"))
    # Equal regions stay apart by a row id.
    want = (regions.withColumn("_rid", F.monotonically_increasing_id()).withColumn("_lo", lo).withColumn("_hi", hi)
            .withColumn("_want", F.explode(F.sequence(F.floor(F.col("_lo") / chunk), F.floor((F.col("_hi") - 1) / chunk)))))
    first = F.greatest(F.col("_lo") - F.col("_want") * chunk, F.lit(0))
    last = F.least(F.col("_hi") - F.col("_want") * chunk, F.lit(chunk))
    pieces = (want.join(chunks, (F.col("chr") == F.col("_rchr")) & (F.col("_want") == F.col("_no")))
              .withColumn("_piece", F.substr("_seq", (first + 1).cast("int"), (last - first).cast("int"))))
    glued = pieces.groupBy("_rid", *regions.columns).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_want", "_piece"))), lambda s: s["_piece"]), "").alias("seq")).drop("_rid")
    return (glued.withColumn("seq", F.when(F.col("strand") == "-", revcomp("seq")).otherwise(F.col("seq")))
            .withColumn("title", F.concat(F.col("name"), F.lit("="), F.col("chr"), F.lit("@"),
                                          F.col("start_pos"), F.lit("-"), F.col("end_pos"))))


def wrap_fasta(title, seq, width: int = 50) -> Column:
    """FASTA text of a record with lines of `width` letters."""
    return F.concat(F.lit(">"), title, F.lit("\n"),
                    F.regexp_replace(seq, "(.{%d})(?=.)" % width, "$1\n"), F.lit("\n"))


def pad_to_query(seq, before, after) -> Column:
    """Hit text filled with `n` to the query's full length."""
    return F.concat(F.repeat(F.lit("n"), before), seq, F.repeat(F.lit("n"), after))
