"""Cutting-stock packing: documents into sequences of at most 2048 tokens.

Documents are tokenized once. Each becomes whole sequences and a rest of at
most half a sequence (or a half and such a rest). A histogram of the pieces'
lengths (classes of GRID tokens, at most 2048 / GRID numbers, whatever the
input) goes to the driver. There a linear program over patterns (how many
pieces of each class share a sequence) is solved by column generation: a
knapsack recursion prices new patterns with the duals. The patterns' numbers
are rounded down, what is left over is packed by decreasing size, and the
slots of each class are handed to its documents by rank, as a join.

Defined results: NULL and empty text is one token (the end id). Repeated rows
are packed each. NULL ids are kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .rows import doc_id, keyed, written
from .tokens import END, encoder, vocabulary_path

LENGTH = 2048
GRID = 8
# Rows of one class that are ranked in one task.
SLICE_ROWS = 50_000
# The program ends within this share of its optimum (the best price bounds it from below), or after so many simplex steps.
GAP = 0.001
MAX_STEPS = 3000
SMOOTHING = 0.5


def _cuts(n: int, length: int) -> Iterator[tuple[int, int]]:
    """Full sequences, then the rest; a rest over half a sequence is cut at the half, because longer ones leave gaps that few others fit."""
    at = 0
    while n - at > length // 2:
        size = length if n - at >= length else length // 2
        yield at, at + size
        at += size
    if at < n:
        yield at, n


def _pieces(path: str, length: int, end: int):
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, start, size, crc, total = [], [], [], [], []
            for lo in range(0, batch.num_rows, 50):
                texts = batch.column("text").slice(lo, 50).to_pylist()
                for i, ids in enumerate(encoder(path).encode_all(texts)):
                    ids += tail
                    n = len(ids) // 4
                    for at, stop in _cuts(n, length):
                        part = ids[4 * at:4 * stop]
                        rows.append(lo + i)
                        start.append(at)
                        size.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        total.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_doc").take(pa.array(rows, pa.int32())), batch.column("_row").take(pa.array(rows, pa.int32()))]
                + [pa.array(x, pa.int64()) for x in (start, size, crc, total)],
                names=["_doc", "_row", "start", "length", "ids_crc32", "doc_tokens"])
    return run


def token_pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """`_doc`, `_row`, `start`, `length`, `ids_crc32`, `doc_tokens`: each document's pieces."""
    return keyed(docs).select("_doc", "_row", "text").mapInArrow(
        _pieces(path or vocabulary_path(), length, end),
        "_doc long, _row long, start long, length long, ids_crc32 long, doc_tokens long")


def _price(sizes: np.ndarray, duals: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: unbounded knapsack over class sizes, which ascend."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), "right").tolist()
    for room in range(int(sizes[0]), capacity + 1):
        values = duals[:fits[room]] + best[room - sizes[:fits[room]]]
        top = int(values.argmax())
        best[room], choice[room] = values[top], top
        if best[room - 1] >= values[top]:
            best[room], choice[room] = best[room - 1], -1
    pattern, room = np.zeros(len(sizes)), capacity
    while room >= sizes[0]:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[choice[room]] += 1
            room -= int(sizes[choice[room]])
    return float(best[capacity]), pattern


def cutting_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, steps: int = MAX_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Basic patterns (one per row) and their fractional numbers: least total number that covers `demand`."""
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    number = inverse @ demand
    # Duals are priced halfway to the best ones so far; a length's share of a sequence is feasible, and close, to begin with.
    centre, bound = sizes / capacity, float(demand @ sizes) / capacity
    for step in range(steps):
        duals = inverse.sum(0)
        if number.sum() <= bound * (1 + GAP):
            break
        for weight in (SMOOTHING, 0.0):
            mixed = weight * centre + (1 - weight) * duals
            value, pattern = _price(sizes, mixed, capacity)
            if float(demand @ mixed) / value > bound:
                centre, bound = mixed / value, float(demand @ mixed) / value
            if duals @ pattern > 1 + 1e-9:
                break
        else:
            break
        used = np.flatnonzero(pattern)
        change = (inverse[:, used] * pattern[used]).sum(1)
        ratio = np.where(change > 1e-9, number / np.where(change > 1e-9, change, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = pattern
        # Rounding errors of the updates cost a little fill at most: patterns are whole numbers, and seats are counted against the demand.
        pivot = inverse[out] / change[out]
        inverse -= change[:, None] * pivot
        inverse[out] = pivot
        moved = ratio[out]
        number = np.maximum(number - moved * change, 0)
        number[out] = moved
    return basis.T, number


def packing_plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (class, first rank, end rank, slots a sequence, first sequence) that seat every rank of every class; number of sequences."""
    if not histogram:
        return [], 0
    sizes = np.array(sorted(histogram))
    demand = np.array([histogram[s] for s in sizes.tolist()], float)
    patterns, number = cutting_patterns(sizes, demand, capacity)
    left, seats, made = demand.astype(np.int64), [], 0
    used = np.zeros(len(sizes), np.int64)

    def seat(pattern: np.ndarray, times: int) -> None:
        nonlocal made
        for c in np.flatnonzero(pattern).tolist():
            k = int(pattern[c])
            seats.append((int(sizes[c]), int(used[c]), int(used[c]) + k * times, k, made))
            used[c] += k * times
            left[c] -= k * times
        made += times

    patterns, whole = np.rint(patterns).astype(np.int64), np.floor(number + 1e-6).astype(np.int64)
    nearest = np.argsort(whole - number, kind="stable")
    for p, times in [*enumerate(whole.tolist()), *((p, 1) for p in nearest.tolist())]:
        on = patterns[p] > 0
        times = min(times, int((left[on] // patterns[p][on]).min()))
        if times > 0:
            seat(patterns[p], times)
    # What rounding leaves: decreasing size, as many equal sequences at once as there are.
    while left.any():
        pattern, room = np.zeros(len(sizes), np.int64), capacity
        for c in np.flatnonzero(left)[::-1].tolist():
            k = min(int(left[c]), room // int(sizes[c]))
            pattern[c] = k
            room -= k * int(sizes[c])
        on = pattern > 0
        seat(pattern, int((left[on] // pattern[on]).min()))
    return seats, made


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, grid: int = GRID, end: int = END) -> DataFrame:
    """One row per piece: `doc_id`, `start`, `length`, `ids_crc32`, `doc_tokens`, `sequence_id`, `offset`."""
    spark = docs.sparkSession
    pieces = written(token_pieces(docs, path, length, end).withColumn("class", F.ceil(F.col("length") / grid).cast("int")), "pieces")
    histogram = {r["class"]: r["count"] for r in pieces.groupBy("class").count().collect()}  # length / grid rows at most
    seats, _ = packing_plan(histogram, -(-length // grid))
    plan = spark.createDataFrame(seats, "c int, lo long, hi long, slots long, base long")
    # Rank in a class: a row number inside a slice, after the rows of the slices before.
    slices = 1 + sum(histogram.values()) // SLICE_ROWS
    sliced = pieces.withColumn("slice", F.pmod(F.xxhash64("_doc", "_row", "start"), F.lit(slices)))
    before = (sliced.groupBy("class", "slice").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("before", F.sum("n").over(W.partitionBy("class").orderBy("slice")) - F.col("n")).drop("n"))
    ranked = (sliced.withColumn("rank", F.row_number().over(W.partitionBy("class", "slice").orderBy("_doc", "_row", "start")) - 1)
              .join(before, ["class", "slice"]).withColumn("rank", F.col("rank") + F.col("before")))
    # The plan has a bounded number of rows: patterns and left-over sequences by their classes.
    seated = ranked.join(F.broadcast(plan), (F.col("class") == F.col("c")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    seated = seated.withColumn("sequence_id", F.col("base") + F.floor((F.col("rank") - F.col("lo")) / F.col("slots")))
    inside = W.partitionBy("sequence_id").orderBy(F.desc("class"), "rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    return seated.withColumn("offset", F.sum("length").over(inside) - F.col("length")).select(
        doc_id(), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
