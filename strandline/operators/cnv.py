"""Copy number: read counts in bins, outliers, segmentation, report."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..scale import settle
from ..session import stored


def cnv_bins(normal: DataFrame, tumor: DataFrame, bin: int = 100, read_length: int | None = None) -> DataFrame:
    """Read starts of both samples per (chr, bin), counted before the shuffle."""
    def count(df, name):
        kept = df if read_length is None else df.where(F.length("bases") == read_length)
        return kept.groupBy("chr", F.floor(F.col("start_pos") / bin).alias("bin")).agg(F.count(F.lit(1)).alias(name))
    return count(normal, "normal").join(count(tumor, "tumor"), ["chr", "bin"], "full").na.fill(0, ["normal", "tumor"])


def cnv_outliers(positions: DataFrame, q: float = 0.95, window: int = 200, mult: float = 5, tile: int = 20_000) -> DataFrame:
    """Positions (chr, pos, n) whose count is at most `mult` times the local quantile.

    The quantile is over positions within window/2 on the same chromosome.
    Rows are windowed per tile with a halo of half a window from its
    neighbours, so a long chromosome splits into many tasks.
    """
    half = window // 2
    own = F.floor(F.col("pos") / tile)
    tiles = F.array_distinct(F.array(own, F.floor((F.col("pos") - half) / tile), F.floor((F.col("pos") + half) / tile)))
    spread = positions.withColumn("_own", own).withColumn("_t", F.explode(tiles))
    near = W.partitionBy("chr", "_t").orderBy("pos").rangeBetween(-half, half)
    scored = spread.withColumn("local", F.percentile("n", q).over(near)).where(F.col("_own") == F.col("_t"))
    return scored.where(F.col("n") <= mult * F.col("local")).select("chr", "pos", "n")


# Bins of a slice: neighbours are looked up inside slices, and over their ends from one row per slice.
BINS = 1 << 16


def _fit(tumor: Column, normal: Column) -> Column:
    """Log likelihood of the counts under their own share."""
    part = lambda x: F.when(x > 0, x * F.ln(x / (tumor + normal))).otherwise(0.0)
    return part(tumor) + part(normal)


def _beside(segments: DataFrame, width: int) -> DataFrame:
    """Segments with the two before and the two after each on its chromosome: structs `_b2 _b1 _s _a1 _a2`.

    A slice's own window gives those inside it. For the others a table of the
    first and last two segments of each slice (one row per slice that has any)
    is shifted by one and by two slices.
    """
    own = F.struct("first_bin", "last_bin", "normal", "tumor")
    rows = segments.select("chr", F.floor(F.col("first_bin") / width).alias("_slice"), own.alias("_s"))
    inside = W.partitionBy("chr", "_slice").orderBy("_s")
    placed = rows.withColumns({"_n": F.count(F.lit(1)).over(W.partitionBy("chr", "_slice")), "_i": F.row_number().over(inside),
                               **{f"_b{k}": F.lag("_s", k).over(inside) for k in (1, 2)}, **{f"_a{k}": F.lead("_s", k).over(inside) for k in (1, 2)}})
    at = lambda i: F.max(F.when(F.col("_i") == i, F.col("_s")))
    ends = placed.where("_i <= 2 or _i > _n - 2").groupBy("chr", "_slice").agg(
        F.array_compact(F.array(at(1), at(2))).alias("_head"),
        F.array_compact(F.array(at(F.col("_n")), at(F.col("_n") - 1))).alias("_tail"))
    along = W.partitionBy("chr").orderBy("_slice")
    near = lambda shift, c: F.concat(*[F.coalesce(shift(c, k).over(along), F.array().cast(ends.schema[c].dataType)) for k in (1, 2)])
    around = ends.select("chr", "_slice", near(F.lag, "_tail").alias("_before"), near(F.lead, "_head").alias("_after"))
    out = placed.join(around, ["chr", "_slice"])
    left, right = F.col("_i") - 1, F.col("_n") - F.col("_i")
    far = lambda k: {f"_b{k}": F.coalesce(f"_b{k}", F.when(left < k, F.get("_before", (k - 1 - left).cast("int")))),
                     f"_a{k}": F.coalesce(f"_a{k}", F.when(right < k, F.get("_after", (k - 1 - right).cast("int"))))}
    return out.withColumns(far(1) | far(2)).select("chr", "_b2", "_b1", "_s", "_a1", "_a2")


def _round(segments: DataFrame, penalty: float, width: int) -> DataFrame:
    """Each pair of neighbours that beats both pairs it overlaps becomes one segment."""
    def pair(a, b):
        a, b = F.col(a), F.col(b)
        apart = _fit(a["tumor"], a["normal"]) + _fit(b["tumor"], b["normal"])
        gain = F.round(2 * (apart - _fit(a["tumor"] + b["tumor"], a["normal"] + b["normal"])) - penalty, 9)
        # Equal gains are taken in an order that does not run along the chromosome.
        tie = F.crc32(F.concat_ws(":", "chr", a["first_bin"].cast("string")).cast("binary"))
        return F.when(a.isNotNull() & b.isNotNull(), F.struct(gain.alias("gain"), tie.alias("tie"), a["first_bin"].alias("at")))

    places = ("_b2", "_b1", "_s", "_a1", "_a2")
    gains = settle(_beside(segments, width).withColumns({f"_g{i}": pair(*places[i:i + 2]) for i in range(4)}), *[f"_g{i}" for i in range(4)])
    best = lambda i: F.coalesce((F.col(f"_g{i}.gain") < 0) & (F.col(f"_g{i - 1}").isNull() | (F.col(f"_g{i}") < F.col(f"_g{i - 1}")))
                                & (F.col(f"_g{i + 1}").isNull() | (F.col(f"_g{i}") < F.col(f"_g{i + 1}"))), F.lit(False))
    s, a = F.col("_s"), F.col("_a1")
    one = F.when(best(2), F.struct(s["first_bin"].alias("first_bin"), a["last_bin"].alias("last_bin"), (s["normal"] + a["normal"]).alias("normal"),
                                   (s["tumor"] + a["tumor"]).alias("tumor"))).otherwise(s)
    return gains.where(~best(1)).select("chr", one.alias("_s")).select("chr", "_s.*")


def merge_segments(segments: DataFrame, reads: int, lam: float = 1, width: int = BINS) -> DataFrame:
    """Merge neighbouring segments of a chromosome while the Bayesian information criterion drops.

    In each round every pair whose drop is larger than those of the two pairs
    it shares a segment with is merged, on all chromosomes at once; equal drops
    are ordered by a hash. Rounds go on until no pair gains. A round is written
    to the shared folder, so that a lost executor costs one round at most. The
    number of rounds follows the logarithm of the segments where drops vary,
    and the longest run of steadily falling drops at worst.

    Segments of one chromosome must not overlap; rows without a chromosome or
    a first bin are left out. The result does not depend on `width`.
    """
    penalty = lam * log(max(reads, 2))
    now = stored(segments.where("chr is not null and first_bin is not null").select(
        "chr", *[F.col(c).cast("long").alias(c) for c in ("first_bin", "last_bin", "normal", "tumor")]), "segments")
    before, left = -1, now.count()
    while left != before:
        now = stored(_round(now, penalty, width), "segments")
        before, left = left, now.count()
    return now


def cnv_segment(bins: DataFrame, lam: float = 1, width: int = BINS) -> DataFrame:
    """Segments of equal tumor share from (chr, bin, normal, tumor)."""
    reads = bins.agg(F.sum(F.col("normal") + F.col("tumor"))).first()[0] or 0
    start = bins.select("chr", F.col("bin").alias("first_bin"), F.col("bin").alias("last_bin"), "normal", "tumor")
    return merge_segments(start, reads, lam, width)


def cnv_report(segments: DataFrame, min_diff: float = 0.2) -> DataFrame:
    """log2 ratio per segment on chr1-22 and X, neighbours closer than `min_diff` joined.

    Ratios are relative to the library sizes.
    """
    kept = segments.where(F.col("chr").rlike("^chr([1-9]|1[0-9]|2[0-2]|X)$"))
    total = lambda c: kept.agg(F.sum(c).alias("s")).scalar()
    # Half a read on both sides keeps empty bins finite.
    ratio = lambda t, n: F.log2(((t + 0.5) / (n + 0.5)) / (F.col("_t") / F.col("_n")))
    s = kept.withColumns({"_n": total("normal"), "_t": total("tumor")}).withColumn("_r", ratio(F.col("tumor"), F.col("normal")))
    along = W.partitionBy("chr").orderBy("first_bin")
    jump = F.coalesce((F.abs(F.col("_r") - F.lag("_r").over(along)) >= min_diff).cast("int"), F.lit(1))
    marked = s.withColumn("_j", jump).withColumn("_island", F.sum("_j").over(along.rowsBetween(W.unboundedPreceding, 0)))
    out = marked.groupBy("chr", "_island", "_n", "_t").agg(F.min("first_bin").alias("first_bin"), F.max("last_bin").alias("last_bin"),
                                                           F.sum("normal").alias("normal"), F.sum("tumor").alias("tumor"))
    return out.select("chr", "first_bin", "last_bin", "normal", "tumor", F.round(ratio(F.col("tumor"), F.col("normal")), 5).alias("log2_ratio"))
