"""Mismatch runs along alignments, their statistics, and grid snapping.

An alignment is one row holding both aligned strings, so runs are found inside
the row with array functions and need no shuffle.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.prob import tail_probability
from ..functions.seq import let
from ..scale import settle
from ..session import stored

# The twelve edits in report order.
EDITS = ("ac", "ag", "at", "ca", "cg", "ct", "ga", "gc", "gt", "ta", "tc", "tg")


def _pair():
    """Both aligned strings as bytes: a slice at any offset costs the same, text slices rescan from the start."""
    return F.struct(F.encode("bp_q", "US-ASCII").alias("q"), F.encode("bp_r", "US-ASCII").alias("r"))


def _bytes(s, i, k: int):
    return F.substring(s, i + 1, F.lit(k))


# Letters that are compared at once; only pieces that differ are looked at letter by letter.
_PIECE = 32


def _differing(z, lo: int, hi):
    """Positions lo..hi at which both strings of `_pair` have different bytes, in order."""
    q, r = z["q"], z["r"]
    pieces = F.filter(F.sequence(F.lit(0), F.floor((F.length(q) - 1) / _PIECE).cast("int")), lambda c: _bytes(q, c * _PIECE, _PIECE) != _bytes(r, c * _PIECE, _PIECE))
    letters = lambda c: F.filter(F.sequence(c * _PIECE, c * _PIECE + (_PIECE - 1)), lambda i: (i >= lo) & (i <= hi) & (_bytes(q, i, 1) != _bytes(r, i, 1)))
    return F.flatten(F.transform(pieces, letters))


def _islands(edits):
    """Array of (i, edit) to runs of equal consecutive edits."""
    def runs(e):
        starts = F.filter(F.sequence(F.lit(1), F.size(e)), lambda j: (j == 1) | (e[j - 1]["edit"] != e[j - 2]["edit"]))

        def cut_out(s):
            ends = F.concat(F.slice(s, 2, F.size(s)), F.array(F.size(e) + 1))
            return F.zip_with(s, ends, lambda a, b: F.struct(
                e[a - 1]["edit"].alias("edit"), (b - a).alias("n"),
                F.transform(F.slice(e, a, b - a), lambda x: x["i"]).alias("positions")))
        return let(starts, cut_out)

    return let(edits, lambda e: F.when(F.size(e) > 0, runs(e)))


def alignment_runs(alignments: DataFrame, m: int, n: int) -> DataFrame:
    """Uniquely aligned queries with their runs of at least `n` equal edits (array `runs`), and every query's status.

    An edit is the reference and query text within `m` letters of a mismatch;
    only another mismatch breaks a run.
    """
    rest = [c for c in alignments.columns if c != "query"]
    # Names alone are shuffled to find the repeated ones; only their rows are brought together.
    repeated = alignments.groupBy(F.col("query").alias("_q")).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("_q")
    same = F.col("query").eqNullSafe(F.col("_q"))
    alone = alignments.join(repeated, same, "left_anti").select("query", F.col("bp_q").isNotNull().cast("long").alias("_n"), *rest)
    groups = alignments.join(repeated, same, "left_semi").groupBy("query").agg(
        F.count("bp_q").alias("_n"), F.min_by(F.struct(*rest), F.col("bp_q").isNull()).alias("_a")).select("query", "_n", "_a.*")
    one = alone.unionByName(groups)
    width = 1 + 2 * m

    def edits(z):
        q, r = z["q"], z["r"]
        hit = _differing(z, m, F.length(q) - m - 1)
        text = lambda s, i: _bytes(s, i - m, width).cast("string")
        return F.when(F.length(q) > 2 * m, F.transform(hit, lambda i: F.struct(
            i.alias("i"), F.concat(text(r, i), F.lit("}"), text(q, i)).alias("edit"))))

    found = let(_pair(), edits)
    usable = (F.col("_n") == 1) & (F.length("bp_q") == F.length("bp_r"))
    runs = one.withColumn("runs", F.when(usable, F.filter(
        F.coalesce(_islands(found), F.array().cast("array<struct<edit:string,n:int,positions:array<int>>>")),
        lambda x: x["n"] >= n)))
    runs = settle(runs, "runs")
    status = (F.when(F.col("_n") == 0, "EMPTY").when(F.col("_n") > 1, "REDUNDANT")
              .when((F.size("runs") > 0) | F.lit(n == 0), "HIT").otherwise("UNIQUE"))
    return runs.withColumn("status", status).drop("_n")


def mismatch_runs(alignments: DataFrame, m: int, n: int) -> DataFrame:
    """One row per run: edit, length, span (last - first position) and positions."""
    r = alignment_runs(alignments, m, n).where("status = 'HIT'")
    return r.select("query", "chr", "strand", "pos_r", "pos_q", F.explode("runs").alias("x")).select(
        "query", "chr", "strand", "pos_r", "pos_q", "x.edit", F.col("x.n").alias("n"),
        (F.element_at("x.positions", -1) - F.element_at("x.positions", 1)).alias("span"),
        F.array_join(F.col("x.positions").cast("array<string>"), " ").alias("positions"))


def run_summary(alignments: DataFrame, m: int, n: int) -> DataFrame:
    """Counts of queries by status."""
    s = alignment_runs(alignments, m, n)
    name = {"HIT": "unique_hits", "UNIQUE": "unique_misses", "REDUNDANT": "redundant_hits", "EMPTY": "empty_hits"}
    return s.agg(*[F.count_if(F.col("status") == k).alias(v) for k, v in name.items()])


def edit_grid(alignments: DataFrame, m_range: tuple[int, int], n_range: tuple[int, int], keep: tuple[str, ...] = ()) -> DataFrame:
    """Runs for every (m, n): rows (m, n, motif, edit) per run and n it satisfies.

    Runs are found once per m; each run then counts for all n up to its length.
    """
    out = None
    for m in range(m_range[0], m_range[1] + 1):
        # min(1, n) keeps all runs; the grid below filters by length.
        r = alignment_runs(alignments, m, max(1, n_range[0])).where("status = 'HIT'")
        one = r.select("query", *keep, F.explode("runs").alias("x")).select(
            "query", *keep, F.lit(m).alias("m"), F.col("x.edit").alias("motif"), F.size("x.positions").alias("_len"),
            F.concat(F.substring("x.edit", m + 1, 1), F.substring("x.edit", 3 * m + 3, 1)).alias("edit"))
        out = one if out is None else out.unionByName(one)
    spread = F.sequence(F.lit(n_range[0]), F.least("_len", F.lit(n_range[1])))
    return out.where(F.col("_len") >= n_range[0]).withColumn("n", F.explode(spread)).drop("_len")


def edit_motif_sums(grid: DataFrame, file: str = "file") -> DataFrame:
    """Counts by (m, n, edit) and (m, n, motif), per file and overall (`file` NULL)."""
    kinds = F.explode(F.array(F.struct(F.lit("edit").alias("kind"), F.col("edit").alias("key")),
                              F.struct(F.lit("motif").alias("kind"), F.col("motif").alias("key"))))
    per_file = grid.select(file, "m", "n", kinds.alias("k")).groupBy(file, "m", "n", "k.kind", "k.key").agg(
        F.count(F.lit(1)).alias("runs"))
    overall = per_file.groupBy("m", "n", "kind", "key").agg(F.sum("runs").alias("runs"))
    return per_file.unionByName(overall.select(F.lit(None).cast(grid.schema[file].dataType).alias(file), "m", "n", "kind", "key", "runs"))


def percent_of_total(sums: DataFrame, m: int | None = None) -> DataFrame:
    """Each of the twelve edits as percent of its row's total, two decimals. `sums` has m, n, edit, runs."""
    s = sums if m is None else sums.where(F.col("m") == m)
    wide = s.groupBy("m", "n").pivot("edit", list(EDITS)).agg(F.sum("runs"))
    total = sum((F.coalesce(e, F.lit(0)) for e in EDITS), F.lit(0))
    return wide.select("m", "n", *[F.when(total > 0, F.round(100.0 * F.coalesce(e, F.lit(0)) / total, 2)).otherwise(0.0).alias(e) for e in EDITS])


def crosstab(df: DataFrame, row: str, col: str, columns: list[str], where=None) -> DataFrame:
    """Counts of `row` x `col` values, missing cells 0."""
    kept = df if where is None else df.where(where)
    wide = kept.groupBy(row).pivot(col, columns).count()
    return wide.select(row, *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in columns])


def stratified_examples(df: DataFrame, total: int, stratum: str, order: tuple[str, ...], rounding: str = "half") -> DataFrame:
    """First rows of every stratum in proportion to its size.

    `half`: int(0.5 + total * c / sum). `floor`: int(min(total, sum) * c / sum).
    No stratum keeps more than `total` rows, so each task drops the rest before
    the shuffle.
    """
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_c"))
    whole = sizes.agg(F.sum("_c").alias("s")).select(F.col("s")).scalar()
    want = (F.floor(0.5 + total * F.col("_c") / whole) if rounding == "half"
            else F.floor(F.least(F.lit(total), whole) * F.col("_c") / whole))
    wanted = sizes.select(stratum, want.alias("_want"))
    rank = F.row_number().over(W.partitionBy(stratum).orderBy(*order))
    head = df.withColumn("_rn", rank).where(F.col("_rn") <= total)
    return head.join(wanted, stratum).where(F.col("_rn") <= F.col("_want")).drop("_rn", "_want")


def run_gap_filter(runs: DataFrame, n: float, m: int) -> DataFrame:
    """Runs whose median gap between positions is at least `n` and whose span is at least `m`."""
    p = F.split("positions", " ").cast("array<int>")
    gaps = let(p, lambda a: F.array_sort(F.zip_with(F.slice(a, 2, F.size(a)), F.slice(a, 1, F.size(a) - 1), lambda x, y: x - y)))

    def median(g):
        k = F.size(g)
        mid = F.floor(k / 2).cast("int")
        return F.when(k == 0, None).when(k % 2 == 1, g[mid].cast("double")).otherwise((g[mid] + g[mid - 1]) / 2)

    return runs.withColumn("median_gap", let(gaps, median)).where((F.col("median_gap") >= n) & (F.col("span") >= m))


def runs_to_bed(runs: DataFrame, flank: int = 1, min_span: int = 100) -> DataFrame:
    """One BED row per run position, `flank` bases to each side, strand-aware; the name carries edit, offset and strand.

    With a `quals` column (integers) the qualities around the position are added.
    """
    rows = runs.where(F.col("span") >= min_span).withColumn("p", F.explode(F.split("positions", " ").cast("array<int>")))
    plus = F.col("strand") == "P"
    centre = F.when(plus, F.col("pos_r") + F.col("p")).otherwise(F.col("pos_r") - F.col("p"))
    q = ([F.array_join(F.slice(F.col("quals"), F.greatest(F.col("pos_q") + F.col("p"), F.lit(1)), 3).cast("array<string>"), "|")]
         if "quals" in runs.columns else [])
    return rows.select("query", "chr", (centre - flank - 1).alias("start0"), (centre + flank).alias("end0"), F.concat_ws(
        "|", "edit", (F.col("pos_q") + F.col("p")).cast("string"), *q, "strand", F.col("span").cast("string")).alias("name"))


# Bins an axis is cut into, per grid cell, when lines are looked for, and the least number for a range that is looked into again.
_BINS_PER_CELL = 1024
_LEAST_BINS = 256


def _by_halving(v, starts: list, leaves: list):
    """The leaf of the last start that is not above `v`; for smaller values and NULL the first leaf."""
    if len(leaves) == 1:
        return leaves[0]
    half = len(leaves) // 2
    return F.when(v >= F.lit(starts[half]), _by_halving(v, starts[half:], leaves[half:])).otherwise(_by_halving(v, starts[:half], leaves[:half]))


def _bounds(lo, hi, step, groups: list, exact: dict) -> list:
    """(least, most) of each line, as far as the least and greatest values of disjoint `groups` tell; `exact` has the next line of some known ones.

    The next line never falls as the line before it grows, so the ends of a line's range bound the next one.
    """
    tops = [top for _, top in groups]
    found = [(lo, lo)]
    while True:
        least, most = found[-1]
        if least == most and least in exact:
            if exact[least] is None:
                return found
            found.append((exact[least],) * 2)
            continue
        if not hi > least + step:
            return found
        first, top = groups[bisect_right(tops, least + step)]
        start = first if first > least + step else least + step
        if hi > most + step:
            first, top = groups[bisect_right(tops, most + step)]
            found.append((start, first if first > most + step else top))
        else:  # there is no such line if the one before is at its end
            found.append((start, hi))


def grid_lines(values: DataFrame, axis: str, lo, hi, cells: int) -> list:
    """Anchors of one axis from `lo` on, each the first value more than half a cell beyond the last one.

    Values are counted into bins, which bound every line by the least and
    greatest values of a bin. The ranges that are left are cut into bins again until each holds
    one value. A round is one pass with partial aggregates of a size that the grid fixes, and settles one line at least.
    """
    step = (hi - lo) / cells / 2
    if not 0 < step < float("inf"):
        return [lo]
    v = F.col(axis)
    ranges, settled, exact, last = [(lo, hi)], [], {}, lo
    while True:
        bins = max(_LEAST_BINS, _BINS_PER_CELL * cells // len(ranges))

        # Numbers of ranges are literals, and their ends are looked up: a method with an expression for each range is too long to be compiled.
        placed = settle(values.select(axis, _by_halving(v, [r[0] for r in ranges], [F.lit(i) for i in range(len(ranges))]).alias("_range")), "_range")
        least, most, width = (F.get(F.array(*[F.lit(x) for x in xs]), F.col("_range")) for xs in (*zip(*ranges), [float(b - a) for a, b in ranges]))
        number = F.greatest(F.floor((v - least).cast("double") / width * bins), F.lit(0).cast("long"))
        number = F.when((v >= least) & (v <= most), F.col("_range") * (bins + 1) + F.least(number, F.lit(bins).cast("long")))
        after = F.min(F.when(v > F.lit(last) + F.lit(step), v))
        rows = placed.groupBy(number.alias("_bin")).agg(F.min(v).alias("lo"), F.max(v).alias("hi"), after.alias("after")).collect()  # as many as bins
        exact[last] = min((r["after"] for r in rows if r["after"] is not None), default=None)
        groups = sorted([(r["lo"], r["hi"]) for r in rows if r["_bin"] is not None] + settled)
        found = _bounds(lo, hi, step, groups, exact)
        wide = [r for r in found if r[0] != r[1]]
        if not wide:
            return [r[0] for r in found]
        last = found[found.index(wide[0]) - 1][0]
        ranges = []
        for a, b in sorted(wide):
            if ranges and a <= ranges[-1][1]:
                ranges[-1] = ranges[-1][0], max(b, ranges[-1][1])
            else:
                ranges.append((a, b))
        settled = [r for r in found if r[0] == r[1] and not any(a <= r[0] <= b for a, b in ranges)]


def snap_to_grid(points: DataFrame, w: int, h: int) -> DataFrame:
    """Grid line of each point: a new line starts at the first value more than span / (2 cells) past the line's anchor.

    Lines are at most 2 x cells + 1 per axis; values are never gathered in one place.
    """
    values = stored(points.select("x", "y"), "grid-values")
    spans = values.agg(*[f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = points
    for axis, cells in (("x", w), ("y", h)):
        lo, hi = spans[f"lo{axis}"], spans[f"hi{axis}"]
        anchors = grid_lines(values.select(axis).where(F.col(axis).isNotNull()), axis, lo, hi, cells) if lo is not None else [None]
        out = out.withColumn(f"grid_{axis}", F.when(F.col(axis) >= F.lit(anchors[0]), _by_halving(F.col(axis), anchors, [F.lit(a) for a in anchors])))
    return out


# -- clusters of one edit type -------------------------------------------------------

# Edits that count as real, then the controls.
CLUSTERED = (("ag", 0), ("tc", 0), ("ga", 1), ("ct", 1))


def _mismatches(z):
    """(i, edit) of the letters that differ, gap columns left out; i is the address in the reference, where gaps take no place."""
    q, r = z["q"], z["r"]
    gap = F.encode(F.lit("-"), "US-ASCII")
    at = lambda s, i: _bytes(s, i, 1)
    differ = F.filter(_differing(z, 0, F.length(q) - 1), lambda i: (at(q, i) != gap) & (at(r, i) != gap))
    spots = F.when(F.locate("-", F.col("bp_r")) > 0, F.filter(F.sequence(F.lit(0), F.length(q) - 1), lambda i: at(r, i) == gap)).otherwise(F.array().cast("array<int>"))
    return let(spots, lambda gaps: F.transform(differ, lambda i: F.struct(
        (i - F.size(F.filter(gaps, lambda g: g < i))).alias("i"), F.lower(F.concat(at(q, i).cast("string"), at(r, i).cast("string"))).alias("edit"))))


def _clusters(pos, p, pvalue: float, least: int):
    """Clusters of one island of equal edits.

    From each member the widest stretch inside the island is taken whose tail
    probability is below `pvalue`. A cluster is a union of overlapping
    stretches; its probability is that of the stretch it starts with.
    """
    chance = lambda i, j: tail_probability(p, pos[j] - pos[i] + 1, j - i + 1)
    every = F.sequence(F.lit(0), F.size(pos) - 1)
    last = F.size(pos) - 1
    # The widest stretch is tried first, the others only until one is found; ends that an earlier stretch reaches add nothing.
    widest = lambda i, top: F.when(F.greatest(i + least - 1, top + 1) <= last, F.aggregate(
        F.sequence(last, F.greatest(i + least - 1, top + 1), F.lit(-1)), F.lit(None).cast("int"),
        lambda got, j: F.when(got.isNull() & (chance(i, j) < pvalue), j).otherwise(got)))
    empty = F.struct(F.array().cast("array<int>").alias("reach"), F.lit(-1).alias("top"))
    reach = F.aggregate(every, empty, lambda acc, i: let(F.struct(acc.alias("a"), widest(i, acc["top"]).alias("j")), lambda x: F.struct(
        F.concat(x["a"]["reach"], F.array(x["j"])).alias("reach"), F.greatest(x["a"]["top"], x["j"]).alias("top"))), lambda acc: acc["reach"])

    def found(reach):
        starts = F.filter(every, lambda i: reach[i].isNotNull() & (F.coalesce(F.array_max(F.slice(reach, F.lit(1), i)), F.lit(-1)) < i))
        inside = F.filter(every, lambda x: F.array_max(F.slice(reach, F.lit(1), x + 1)) >= x)
        return F.struct(F.size(starts).alias("n"), F.transform(inside, lambda x: pos[x]).alias("members"),
                        F.aggregate(starts, F.lit(1.0), lambda a, i: a * chance(i, reach[i])).alias("probability"))

    return let(reach, found)


def cluster_edits(alignments: DataFrame, pvalue: float, min_size: int) -> DataFrame:
    """Clusters of A>G / T>C (real) and G>A / C>T (control) edits along each alignment.

    A cluster holds at least `min_size` edits of one kind and no other mismatch
    between them, so it lies in one island of equal edits. All is found inside
    the alignment's row; positions are addresses in the reference string.
    """
    rows = alignments.where("length(bp_q) > 0 and length(bp_q) = length(bp_r)").select("query", F.length("bp_q").alias("len"), let(_pair(), _mismatches).alias("mm"))
    rows = settle(rows, "mm").where(F.size("mm") >= min_size).withColumn("islands", _islands(F.col("mm")))
    # Only edits with an island that is large enough go on.
    kinds = F.filter(F.array(*[F.struct(F.lit(e).alias("edit"), F.lit(c).alias("control")) for e, c in CLUSTERED]), lambda k: F.exists(
        "islands", lambda x: (x["edit"] == k["edit"]) & (x["n"] >= min_size)))
    each = settle(rows, "islands").select("query", "len", "mm", "islands", F.inline(kinds))
    count = lambda keep: F.size(F.filter("mm", keep))
    other = count(lambda m: m["edit"].isin([e for e, _ in CLUSTERED]) & (m["edit"] != F.col("edit")))
    own = F.filter("islands", lambda x: (x["edit"] == F.col("edit")) & (x["n"] >= min_size))
    each = (each.withColumn("p", other / (3 * F.col("len"))).withColumn("n_edits", count(lambda m: m["edit"] == F.col("edit")))
            .withColumn("found", F.transform(own, lambda x: _clusters(x["positions"], F.col("p"), pvalue, min_size))))
    each = settle(each, "found").withColumn("members", F.flatten("found.members")).withColumn(
        "n_clusters", F.aggregate("found.n", F.lit(0), lambda a, n: a + n)).where("n_clusters > 0")
    return each.select("query", "edit", "control", F.aggregate("found.probability", F.lit(1.0), lambda a, x: a * x).alias("total_probability"),
                       "n_clusters", F.size("members").alias("n_members"), F.array_join(F.col("members").cast("array<string>"), " ").alias("positions"),
                       "n_edits", F.size("mm").alias("n_mismatches"))


def cluster_probability(df: DataFrame, p: str, n: str, k: str) -> DataFrame:
    return df.withColumn("probability", tail_probability(p, n, k))
