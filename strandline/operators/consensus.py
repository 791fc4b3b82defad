"""Consensus calls and coverage statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import iupac, seq as S
from .kmers import reference_slice


def consensus_by_quality(rows: DataFrame, keys: tuple[str, ...] = ("exon", "pos")) -> DataFrame:
    """Per position: quality sum per base and the OR of bases, leaving out the single lowest-quality row.

    `rows` has the keys, base, qual and ord (file order, which settles ties).
    A position with one row calls X with zero sums. Rows combine map-side to
    one per (position, base set), so a deep position never meets in one place.
    """
    by_base = rows.withColumn("_m", iupac.mask("base")).groupBy(*keys, "_m").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("qual").alias("_q"), F.min(F.struct("qual", "ord")).alias("_low"))
    g = by_base.groupBy(*keys).agg(
        F.collect_list(F.struct("_m", "_n", "_q")).alias("_sets"),
        F.min_by(F.struct("_m", F.col("_low.qual").alias("_q")), "_low").alias("_drop"))
    left = F.filter("_sets", lambda s: s["_n"] > F.when(s["_m"] == F.col("_drop._m"), 1).otherwise(0))
    call = F.aggregate(left, F.lit(0), lambda a, s: a.bitwiseOR(s["_m"]))

    def total(bit):
        return F.aggregate(F.filter("_sets", lambda s: s["_m"] == bit), F.lit(0).cast("long"), lambda a, s: a + s["_q"]) - F.when(
            F.col("_drop._m") == bit, F.col("_drop._q")).otherwise(0)

    return g.select(*keys, iupac.letter(call).alias("call"),
                    *[total(bit).cast("long").alias(f"q_{b.lower()}") for b, bit in iupac.BASE_BITS.items()])


def consensus_votes(placed: DataFrame, chunks: DataFrame, chunk: int, n_mers: int = 2, cap: int = 255) -> DataFrame:
    """Votes for A, C, G, T per reference position from placed mers, capped, with the reference mask.

    An ambiguous letter votes for each of its bases.
    """
    mers = F.array(*[F.struct(F.col(f"pos{i}").alias("p"), F.col(f"mer{i}").alias("mer")) for i in range(n_mers)])
    # Equal mers at a position are counted first, then split into letters.
    counted = placed.select("chr", F.inline(mers)).groupBy("chr", "p", "mer").agg(F.count(F.lit(1)).alias("c"))
    letters = (counted.select("chr", "p", "c", F.posexplode(F.split("mer", "")).alias("i", "base"))
               .select("chr", (F.col("p") + F.col("i")).alias("pos"), "c", iupac.mask("base").alias("m")))
    total = lambda bit: F.coalesce(F.sum(F.when(F.col("m").bitwiseAND(bit) != 0, F.col("c"))), F.lit(0))
    votes = letters.groupBy("chr", "pos").agg(*[F.least(total(bit), F.lit(cap)).alias(b.lower()) for b, bit in iupac.BASE_BITS.items()])
    with_ref = reference_slice(votes, chunks, chunk, F.col("pos"), F.lit(1), "_base")
    return with_ref.withColumn("ref_mask", iupac.mask("_base")).drop("_base")


def consensus_stats(votes: DataFrame) -> DataFrame:
    """total, covered, undisputed (no vote off the reference) and call_snp (an off-reference base with more than 2 votes)."""
    cols = list(zip("acgt", (1, 2, 4, 8)))
    guess = sum((F.when(F.col(c) > 0, bit).otherwise(0) for c, bit in cols), F.lit(0))
    off = F.lit(False)
    for c, bit in cols:
        off = off | ((F.col(c) > 2) & (F.col("ref_mask").bitwiseAND(bit) == 0))
    return votes.agg(F.count(F.lit(1)).alias("total"), F.count_if(guess != 0).alias("covered"),
                     F.count_if(guess.bitwiseAND(F.bitwise_not("ref_mask")) == 0).alias("undisputed"),
                     F.count_if(off).alias("call_snp"))


def coverage_survival(depths: DataFrame, total: int, depth: str = "depth") -> DataFrame:
    """Loci and percent covered at least i times for i = 0..max; zero-depth loci are total minus observed."""
    hist = depths.where(F.col(depth) >= 1).groupBy(F.col(depth).cast("long").alias("depth")).agg(F.count(F.lit(1)).alias("n"))
    span = hist.agg(F.max("depth").alias("m")).select(F.explode(F.sequence(F.lit(0).cast("long"), "m")).alias("depth"))
    # One row per depth value: the running sum is over the histogram only.
    at_least = F.sum(F.coalesce("n", F.lit(0))).over(W.orderBy(F.desc("depth")))
    loci = F.when(F.col("depth") == 0, F.lit(total)).otherwise(at_least)
    return span.join(hist, "depth", "left").withColumn("loci", loci.cast("long")).select(
        "depth", "loci", F.round(100.0 * F.col("loci") / total, 6).alias("percent"))


def quality_bins(rows: DataFrame, top: int = 1000) -> DataFrame:
    """Per quality 0..top (clamped): bases in total and mismatching the reference."""
    hist = rows.groupBy(F.least(F.col("qual"), F.lit(top)).cast("long").alias("qual")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("base") != F.col("ref_base")).alias("mm"))
    bins = rows.sparkSession.range(top + 1).withColumnRenamed("id", "qual")
    return bins.join(hist, "qual", "left").select("qual", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "mm")])


def depth_of_coverage(alignments: DataFrame, tile: int = 4096) -> DataFrame:
    """(chr, pos, depth) of every covered position.

    Starts and ends are counted per position before the shuffle; running sums
    are taken per tile and shifted by the tiles before it.
    """
    edges = alignments.select("chr", F.explode(F.array(
        F.struct(F.col("start_pos").alias("pos"), F.lit(1).alias("d")),
        F.struct((F.col("end_pos") + 1).alias("pos"), F.lit(-1).alias("d")))).alias("e")).groupBy("chr", "e.pos").agg(
        F.sum("e.d").alias("d")).withColumn("_t", F.floor(F.col("pos") / tile))
    inside = W.partitionBy("chr", "_t").orderBy("pos")
    before = W.partitionBy("chr").orderBy("_t").rowsBetween(W.unboundedPreceding, -1)
    tiles = edges.groupBy("chr", "_t").agg(F.sum("d").alias("_s")).select(
        "chr", "_t", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"),
        F.lead("_t").over(W.partitionBy("chr").orderBy("_t")).alias("_next"))
    run = edges.join(tiles, ["chr", "_t"]).withColumn("depth", F.sum("d").over(inside) + F.col("_base"))
    first_next = edges.groupBy("chr", F.col("_t").alias("_next")).agg(F.min("pos").alias("_np"))
    run = run.join(first_next, ["chr", "_next"], "left").withColumn(
        "_stop", F.coalesce(F.lead("pos").over(inside), F.col("_np")))
    return run.where("depth > 0 and _stop is not null").select(
        "chr", F.explode(F.sequence("pos", F.col("_stop") - 1)).alias("pos"), "depth")
