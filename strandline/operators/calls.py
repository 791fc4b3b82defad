"""Genotype call lists: reading, comparing, filtering, counting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import iupac
from ..scale import SLICE, rank_in_group
from ..session import stored
from .intervals import pileup_columns


def call_reader(lines: DataFrame, rsid_only: bool = False, line: str = "line") -> DataFrame:
    """(list, chr, pos, mask) from tab-separated call rows of three shapes.

    Position lists (chr, pos, one-letter ref, call), annotation rows whose
    interval is one base with `alleles a` or `a/b`, and, with `rsid_only`,
    array rows `rsN … a b`; that mode keys every row by its rs numbers.
    """
    f = F.split(F.col(line), "\t", 9)
    at = lambda i: F.get(f, F.lit(i))
    keep = [c for c in lines.columns if c != line]
    parsed = lines.select(*keep, *[at(i).alias(f"f{i}") for i in range(5)], at(8).alias("f8"))
    is_list = F.coalesce(F.col("f1").rlike("^[0-9]+$") & F.col("f2").rlike("^.$"), F.lit(False))
    alleles = F.upper(F.regexp_extract("f8", r"(?i)alleles ([A-Z/]+)\b", 1))
    is_note = F.coalesce(~is_list & F.col("f3").rlike("^[0-9]+$") & (F.col("f4").try_cast("long") == F.col("f3").try_cast("long"))
                         & alleles.rlike("^[A-Z](/[A-Z])?$"), F.lit(False))
    letters = F.regexp_replace(alleles, "/", "")
    rs = F.regexp_extract_all("f8", F.lit(r"[:,]rs([0-9]+)"), F.lit(1))
    is_array = F.coalesce(~is_list & F.col("f2").rlike("^[ACGT]$") & F.col("f3").rlike("^[ACGT]$")
                          & F.col("f0").rlike("^rs[0-9]+"), F.lit(False))
    row = lambda c, p, m: F.struct(c.alias("chr"), p.cast("long").alias("pos"), m.alias("mask"))
    none = F.array().cast("array<struct<chr:string,pos:bigint,mask:int>>")
    listed = F.array(row(F.col("f0"), F.col("f1"), iupac.mask("f3")))
    noted = F.array(row(F.col("f0"), F.col("f3"), iupac.mask(letters)))
    by_rs = F.transform(rs, lambda r: row(F.lit("rs"), r, iupac.mask(letters)))
    arrays = F.array(row(F.lit("rs"), F.regexp_extract("f0", "^rs([0-9]+)", 1), iupac.mask(F.concat("f2", "f3"))))
    if rsid_only:
        rows = F.when(is_list, listed).when(is_note, by_rs).when(is_array, arrays).otherwise(none)
    else:
        rows = F.when(is_list, listed).when(is_note, noted).otherwise(none)
    return parsed.select(*keep, F.explode(rows).alias("r")).select(*keep, "r.*")


def _ranked(calls: DataFrame, who: str, width: int) -> DataFrame:
    return (rank_in_group(calls.select("sample", "chr", "pos", "mask", "ord"), ["sample", "chr", "pos"], "ord", ties=("mask",), width=width)
            .select(F.col("sample").alias(f"{who}_list"), "chr", "pos", "rn", F.col("mask").alias(f"{who}_mask")))


def concordance_pairs(x: DataFrame, y: DataFrame, width: int = SLICE) -> DataFrame:
    """Pair two sets of call lists position by position and classify every pair.

    Repeated positions of a list pair one-to-one in order, so the join key is
    (chr, pos, occurrence) and a position repeated millions of times spreads.
    `width` is the span of `ord` that holds about a million rows.
    """
    pairs = _ranked(x, "x", width).join(_ranked(y, "y", width), ["chr", "pos", "rn"])
    no_x, no_y = F.col("x_mask").isin(0, 15), F.col("y_mask").isin(0, 15)
    return pairs.withColumn("verdict", F.when(no_x & no_y, "nocall_both").when(no_x, "nocall_x").when(no_y, "nocall_y")
                            .when(F.col("x_mask") == F.col("y_mask"), "yes").otherwise("no"))


# Bits of a mask, and one more plane for a mask that is NULL: called, but equal to none.
_PLANES = 4


def _packed(calls: DataFrame, width: int) -> DataFrame:
    """One row per (list, chr, block of 64 positions, occurrence): bit sets of the positions held, called, odd, and of each mask bit."""
    r = _ranked(calls, "_", width).withColumnsRenamed({"__list": "list", "__mask": "mask"})
    spot, mask = F.expr("shiftleft(1L, cast(pmod(pos, 64) as int))"), F.col("mask")
    bits = lambda test, name: F.coalesce(F.bit_or(F.when(test, F.col("_spot"))), F.lit(0).cast("long")).alias(name)
    return (r.withColumn("_spot", spot).groupBy("list", "chr", F.floor(F.col("pos") / 64).alias("_block"), "rn")
            .agg(F.bit_or("_spot").alias("held"), bits(F.coalesce(~mask.isin(0, 15), F.lit(True)), "called"), bits(mask.isNull(), "odd"),
                 *[bits(F.getbit(mask, F.lit(i)) == 1, f"b{i}") for i in range(_PLANES)]))


def pair_counts(x: DataFrame, y: DataFrame, width: int = SLICE) -> DataFrame:
    """Verdicts of `concordance_pairs` counted per (y list, x list), for pairs of lists that share a position.

    Positions are packed 64 to a row before lists meet, so the join has one row
    per pair of lists and block, and a block's verdicts are counted by bit
    operations. Lists compared among themselves are packed once and written.
    Masks are 0 to 15; a NULL mask is a call that equals none.
    """
    if x.sameSemantics(y):
        px = py = stored(_packed(x, width), "packed-calls")
    else:
        px, py = _packed(x, width), _packed(y, width)
    keys = ["chr", "_block", "rn"]
    named = lambda p, who: p.select(*keys, *[F.col(c).alias(f"{who}_{c}") for c in p.columns if c not in keys])
    both = named(px, "x").join(named(py, "y"), keys)
    col = lambda name: (F.col(f"x_{name}"), F.col(f"y_{name}"))
    (xh, yh), (xc, yc), (xo, yo) = col("held"), col("called"), col("odd")
    differ = xo.bitwiseOR(yo)
    for i in range(_PLANES):
        a, b = col(f"b{i}")
        differ = differ.bitwiseOR(a.bitwiseXOR(b))
    called = xc.bitwiseAND(yc)
    count = lambda bits, name: F.sum(F.bit_count(bits)).alias(name)
    return (both.where(xh.bitwiseAND(yh) != 0).groupBy("y_list", "x_list")
            .agg(count(called.bitwiseAND(F.bitwise_not(differ)), "yes"), count(called.bitwiseAND(differ), "no"),
                 count(yc.bitwiseAND(xh).bitwiseAND(F.bitwise_not(xc)), "nocall_x"),
                 count(xc.bitwiseAND(yh).bitwiseAND(F.bitwise_not(yc)), "nocall_y")))


def concordance_matrix(x: DataFrame, y: DataFrame, width: int = SLICE) -> DataFrame:
    """Score of every (y list, x list): 100 yes/(yes+no), starred above 0.9 of the row's best."""
    per_pair = pair_counts(x, y, width)
    scored = per_pair.withColumn("score", F.when(
        F.col("yes") + F.col("no") > 0, F.round(100.0 * F.col("yes") / (F.col("yes") + F.col("no")), 4)))
    best = F.max(F.coalesce("score", F.lit(0.0))).over(W.partitionBy("y_list"))
    return scored.withColumn("starred", (F.coalesce("score", F.lit(0.0)) > 0.9 * best).cast("int"))


def genotype_filter(calls: DataFrame, steps: list[tuple], lists: dict[str, DataFrame] | None = None) -> DataFrame:
    """Apply list filters in order.

    A step is (`het|hom|call|nocall`,) on the call itself, or
    (`isin|agree|disagree|het|hom|call|nocall`, list name) on the named list at
    the same position. `agree` needs equal called masks, `disagree` different ones.
    """
    out = calls
    for kind, *which in steps:
        if which:
            other = (lists[which[0]].select("chr", "pos", F.col("mask").alias("_m"),
                                            iupac.call_class(iupac.letter("mask")).alias("_class")).distinct())
        called = lambda c: ~F.col(c).isin(0, 15)
        own = iupac.call_class(iupac.letter("mask"))
        if kind == "isin":
            out = out.join(other.select("chr", "pos").distinct(), ["chr", "pos"], "left_semi")
        elif kind in ("agree", "disagree"):
            same = F.col("l.mask") == F.col("o._m")
            on = ((F.col("l.chr") == F.col("o.chr")) & (F.col("l.pos") == F.col("o.pos"))
                  & (same if kind == "agree" else ~same))
            out = (out.where(called("mask")).alias("l")
                   .join(other.where(called("_m")).alias("o"), on, "left_semi"))
        elif which:
            match = {"call": F.col("_class") != "nocall"}.get(kind, F.col("_class") == kind)
            out = out.join(other.where(match).select("chr", "pos").distinct(), ["chr", "pos"], "left_semi")
        elif kind == "call":
            out = out.where(own != "nocall")
        else:
            out = out.where(own == kind)
    return out


def population_snps(calls: DataFrame) -> DataFrame:
    """Sorted distinct positions where someone differs from a known reference base."""
    return (calls.where(F.col("ref").rlike("^[ACGTacgt]$") & ~iupac.is_nocall("call")
                        & (iupac.mask("call") != iupac.mask("ref")))
            .select("chr", "pos").distinct().orderBy("chr", "pos"))


def population_restrict(df: DataFrame, snps: DataFrame) -> DataFrame:
    return df.join(snps, ["chr", "pos"], "left_semi")


def call_stats(calls: DataFrame, snps: DataFrame) -> DataFrame:
    """Per list and membership of the position list: het, hom, ref, no-call, called, total."""
    flagged = calls.join(snps.select("chr", "pos", F.lit("y").alias("in_list")).distinct(), ["chr", "pos"], "left")
    kind = F.when(iupac.is_nocall("call"), "noc").when(iupac.mask("call") == iupac.mask("ref"), "ref").when(
        F.bit_count(iupac.mask("call")) == 1, "hom").otherwise("het")
    return (flagged.withColumn("_k", kind).groupBy("sample", F.coalesce("in_list", F.lit("n")).alias("in_list"))
            .agg(*[F.count_if(F.col("_k") == k).alias(k) for k in ("het", "hom", "ref", "noc")],
                 F.count_if(F.col("_k") != "noc").alias("called"), F.count(F.lit(1)).alias("total")))


def skeptic_recall(calls: DataFrame, reads: DataFrame, min_qual: int = 20, min_coverage: int = 10,
                   min_sites: int = 2) -> DataFrame:
    """Turn weak differences into no-calls (`N`).

    A call stays when its quality and coverage suffice and every called
    non-reference base has at least `min_sites` distinct read starts.
    """
    per_base = pileup_columns(calls, reads).groupBy("chr", "pos", "base").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("sites"))
    support = per_base.groupBy("chr", "pos").agg(
        F.sum("n").alias("coverage"),
        *[F.sum(F.when(F.col("base") == b, F.col("sites"))).alias(f"sites_{b}") for b in iupac.BASE_BITS])
    m, r = iupac.mask("call"), iupac.mask("ref")
    weak = [(m.bitwiseAND(bit) != 0) & (r.bitwiseAND(bit) == 0) & (F.coalesce(f"sites_{b}", F.lit(0)) < min_sites)
            for b, bit in iupac.BASE_BITS.items()]
    snp = ~m.isin(0, 15) & (m != r)
    doubt = (F.col("qual") < min_qual) | (F.coalesce("coverage", F.lit(0)) < min_coverage)
    for w in weak:
        doubt = doubt | w
    return (calls.join(support, ["chr", "pos"], "left")
            .withColumn("recall", F.when(snp & doubt, "N").otherwise(F.col("call")))
            .withColumn("coverage", F.coalesce("coverage", F.lit(0)))
            .drop(*[f"sites_{b}" for b in iupac.BASE_BITS]))


def collapse_calls(df: DataFrame, order: str = "ord") -> DataFrame:
    """One annotation row per position with all its alleles joined, latest first, and the first row's reference."""
    rank = F.struct(order, "call", "ref")
    return (df.groupBy("chr", "pos").agg(F.min(rank).alias("first"), F.sort_array(F.collect_list(rank), False).alias("c"))
            .select("chr", "pos", F.concat(F.lit("alleles "), F.array_join(F.transform("c", lambda s: s["call"]), "/"),
                                           F.lit("; ref_allele "), F.col("first.ref")).alias("attributes")))


def site_union(*lists: DataFrame) -> DataFrame:
    """Distinct sorted positions over all inputs."""
    out = lists[0].select("chr", "pos")
    for other in lists[1:]:
        out = out.unionByName(other.select("chr", "pos"))
    return out.distinct().orderBy("chr", "pos")
