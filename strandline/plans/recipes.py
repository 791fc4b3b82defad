"""Ready-made compositions of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import iupac
from ..operators import (calls as C, cnv as B, consensus as N, evidence as E, intervals as I, placement as P, reads as R,
                         runs as U, sorting as O)
from ..session import stored


def two_letter_placement(reads: DataFrame, ref_kmers: DataFrame, chunks: DataFrame, chunk: int, k: int, gap: tuple[int, int]) -> DataFrame:
    """Both strands, gapped placement, report, two-letter gap filter, sorted by read. The rows are written first: a sort reads its input twice."""
    both = R.both_strands(reads, ["mer0", "mer1"])
    placed = P.place_gapped(both, ref_kmers, k, [gap])
    report = P.place_report(placed, both, chunks, chunk, k, reach=2 * k + gap[1])
    return stored(R.two_letter_gap(report), "two-letter").orderBy("sample", "chr", "pos0", "pos1", "side")


def placement_accuracy(reads: DataFrame, ref_kmers: DataFrame, chunks: DataFrame, chunk: int, k: int,
                       gap: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Reads of known origin: (checked placements, per-read statistics)."""
    key = reads.select("sample", *[c for c in reads.columns if c.startswith("a")])
    both = R.both_strands(reads.select("sample", "mer0", "mer1"), ["mer0", "mer1"])
    report = P.place_report(P.place_gapped(both, ref_kmers, k, [gap]), both, chunks, chunk, k, reach=2 * k + gap[1])
    checked = P.check_answer_key(report.drop("snps").join(key, "sample"))
    return checked, P.placement_read_stats(checked)


def concordance_report(array_calls: DataFrame, seq_calls: DataFrame, alignments: DataFrame, regions: DataFrame, snps: DataFrame,
                       **recall) -> dict[str, DataFrame]:
    """Array calls inside the regions against re-called sequence calls: matrix, named sites, call counts.

    Call tables have sample, chr, pos, ref, call, qual, ord; `snps` names positions.
    """
    probes = I.in_regions(array_calls, regions).withColumn("mask", iupac.mask("call"))
    reads = I.interval_semi(alignments, probes)
    recalled = C.skeptic_recall(seq_calls, reads, **recall).drop("call", "coverage").withColumnRenamed("recall", "call").withColumn("mask", iupac.mask("call"))
    return {"matrix": C.concordance_matrix(probes, recalled),
            "sites": I.snplist_to_bed(I.nearest_lookup(C.site_union(probes, recalled), snps)),
            "counts": C.call_stats(recalled, C.population_snps(recalled))}


def edit_motif_report(alignments: DataFrame, m_range=(0, 1), n_range=(1, 5), examples: int = 1000) -> dict[str, DataFrame]:
    """Runs of every (m, n), their sums, examples in proportion, percentages. `alignments` carry `file`."""
    grid = U.edit_grid(alignments, m_range, n_range, keep=("file",))
    sums = U.edit_motif_sums(grid)
    overall = sums.where("file is null and kind = 'edit'").withColumnRenamed("key", "edit")
    return {"sums": sums, "percent": U.percent_of_total(overall),
            "examples": U.stratified_examples(grid.where(f"m = {m_range[1]} and n = {n_range[0]}"), examples, "edit", ("query", "motif"))}


def cnv_analysis(normal: DataFrame, tumor: DataFrame, bin: int = 100, lam: float = 1, min_diff: float = 0.2, mult: float = 5) -> DataFrame:
    """Outlier positions removed from both samples, bins, segments, and the report."""
    def clean(reads):
        counts = reads.groupBy("chr", F.col("start_pos").alias("pos")).agg(F.count(F.lit(1)).alias("n"))
        good = B.cnv_outliers(counts, mult=mult)
        return reads.join(good.select("chr", F.col("pos").alias("start_pos")), ["chr", "start_pos"], "left_semi")
    return B.cnv_report(B.cnv_segment(B.cnv_bins(clean(normal), clean(tumor), bin), lam), min_diff)


def evidence_report(parts: DataFrame, latest: DataFrame, freq: DataFrame, build: str | None = None) -> DataFrame:
    """Per-chromosome variants recombined, refreshed from the newest annotation, with population frequencies."""
    merged = E.evidence_by_chromosome(parts)
    return E.allele_freq_join(E.evidence_refresh(merged, latest), freq, build)


def exon_placement_report(reads: DataFrame, exons: DataFrame, max_mm: int = 1) -> DataFrame:
    """Placed split reads as bases on the exons, and the consensus of every position.

    `exons` has exon, seq and strand; qualities are constant. The bases are
    written first: a sort by ranges reads its input twice.
    """
    placed = P.place_split_reads(reads, exons, max_mm)
    bases = P.annotate_bases(placed, exons).join(exons.select("exon", "strand"), "exon")
    forward = R.forward_strand(bases.withColumns({"base": F.upper("base"), "ref_base": F.upper("ref_base")}))
    rows = O.sort_by_id_then_pos(stored(forward, "exon-bases"), "exon", "pos", then=("read_id", "offset"))
    return N.consensus_by_quality(rows.withColumns({"qual": F.lit(1), "ord": F.struct("read_id", "offset")}))


def repeat_readmap_ratio(tumor: DataFrame, normal: DataFrame, repeats: DataFrame) -> DataFrame:
    """Reads trimmed to the best length, counted per repeat key, joined with the normal sample and annotations.

    Reads have key, flag, bases, quals.
    """
    both = tumor.unionByName(normal)
    best = R.best_read_length(R.read_length_hist(both).withColumn("suffix", F.lit(""))).select("best_length").scalar().cast("int")

    def counts(reads):
        return R.quality_trim(reads, best).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return E.annotate_counts(counts(tumor), counts(normal), repeats)
