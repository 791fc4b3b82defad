"""SimHash near-duplicates: 64-bit fingerprints, pigeonhole blocks, verified Hamming distance, components.

Defined results: a text without words has fingerprint zero and links like any
other; with fewer words than a shingle, the whole sequence is the shingle.
NULL text is empty. Equal fingerprints are one node, so copies are never
paired; repeated rows each get their row. Documents with NULL ids take part,
and name a component only if all its ids are NULL.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from .arrays import split_words, text_chunks
from .components import components
from .quality_rules import LOWER
from .rows import KEY, NO_ID, doc_id, keyed, unpacked, written

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
# Blocks a fingerprint is cut into; links agree on all but MAX_BITS of them.
BLOCKS = 6
# Groups with more fingerprints than this are split by finer blocks.
SPLIT_ABOVE = 2048
FINE_BLOCKS = 16


def bits(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Majority bit of each row's hashes; `rows` is sorted."""
    out = np.zeros(n, np.uint64)
    present, first, count = np.unique(rows, return_index=True, return_counts=True)
    step = 1 << 17
    for bit in range(8):
        ones = np.zeros((len(present), 8), np.int64)
        for lo in range(0, len(hashes), step):
            part = hashes[lo:lo + step]
            planes = np.unpackbits(((part >> np.uint64(8 * bit)) & np.uint64(255)).astype(np.uint8)[:, None], axis=1, bitorder="little")
            a, b = np.searchsorted(first, lo, "right") - 1, np.searchsorted(first, lo + len(part))
            cuts = np.maximum(first[a:b] - lo, 0)
            ones[a:b] += np.add.reduceat(planes, cuts, axis=0, dtype=np.int64)
        most = np.packbits(2 * ones > count[:, None], axis=1, bitorder="little")[:, 0].astype(np.uint64)
        out[present] |= most << np.uint64(8 * bit)
    return out


def _fingerprint_rows(data: np.ndarray, bounds: np.ndarray, shingle: int) -> np.ndarray:
    starts, ends, first = split_words(data, bounds)
    rows = len(bounds) - 1
    if not len(starts):
        return np.zeros(rows, np.uint64)
    lower = LOWER[data]
    # Words joined by one space: a shingle is one slice of the result.
    length = ends - starts + 1
    at = np.cumsum(length) - length
    flat = np.full(int(length.sum()), 32, np.uint8)
    inside = np.arange(int((length - 1).sum())) + np.repeat(np.arange(len(starts)), length - 1)
    source = np.arange(len(inside)) + np.repeat(starts - (np.cumsum(length - 1) - (length - 1)), length - 1)
    flat[inside] = lower[source]
    counts = np.diff(first)
    shingles = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    row = np.repeat(np.arange(rows), shingles)
    begin = np.arange(int(shingles.sum())) + np.repeat(first[:-1] - (np.cumsum(shingles) - shingles), shingles)
    stop = np.minimum(begin + shingle, first[1:][row]) - 1
    text, digest = flat.tobytes(), xxh64_intdigest
    left, right = at[begin].tolist(), (at[stop] + length[stop] - 1).tolist()
    hashes = np.fromiter((digest(text[a:b], SEED) for a, b in zip(left, right)), np.uint64, len(left))
    return bits(hashes, row, rows)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """`_doc`, `_row` and the long `fp` of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in text_chunks(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("_doc"), part.column("_row"), pa.array(
                    _fingerprint_rows(data, bounds, shingle).view(np.int64))], names=[*KEY, "fp"])
    return keyed(docs).select(*KEY, "text").mapInArrow(run, "_doc long, _row long, fp long")


def _masks(blocks: int, max_bits: int) -> list[int]:
    """One mask for each choice of blocks that a link may agree on."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(parts[i] for i in kept) for kept in combinations(range(blocks), blocks - max_bits)]


def _block_keys(fps: DataFrame, masks: list[int], *carry: str) -> DataFrame:
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("block")) for i, m in enumerate(signed)])
    return fps.select("fp", *carry, F.inline(keys))


def _forest(max_bits: int):
    """Verified links inside each block of a task: a spanning forest of each block, not all its pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close(final: bool):
            nonlocal held
            if not held:
                return None
            table = pa.Table.from_batches(held)
            group = np.stack([table.column(c).to_numpy() for c in ("kk", "k", "outer", "block")])
            fp = table.column("fp").to_numpy().view(np.uint64)
            new = np.flatnonzero(np.concatenate([[True], (group[:, 1:] != group[:, :-1]).any(0), [True]]))
            stop = len(new) - 1 if final else len(new) - 2
            pairs = [_links(fp[new[i]:new[i + 1]], max_bits) for i in range(stop) if new[i + 1] - new[i] > 1]
            held = [] if final else table.slice(new[stop]).combine_chunks().to_batches()
            pairs = [p for p in pairs if len(p)]
            if not pairs:
                return None
            pairs = np.concatenate(pairs).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                out = close(False)
                if out is not None:
                    yield out
        out = close(True)
        if out is not None:
            yield out
    return run


def _links(fp: np.ndarray, max_bits: int) -> np.ndarray:
    """Links (x, y) of a spanning forest of the graph of near fingerprints."""
    n = len(fp)
    if n == 2:
        return fp[None, :] if np.bitwise_count(fp[0] ^ fp[1]) <= max_bits else np.empty((0, 2), np.uint64)
    todo, links = np.ones(n, bool), []
    for seed in range(n):
        if not todo[seed]:
            continue
        todo[seed], front = False, [seed]
        while front:
            x = front.pop()
            left = np.flatnonzero(todo)
            near = left[np.bitwise_count(fp[left] ^ fp[x]) <= max_bits]
            todo[near] = False
            front.extend(near.tolist())
            links.extend((x, y) for y in near.tolist())
    return fp[np.array(links, np.int64).reshape(-1, 2)]


def near_links(fps: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """Links (a, b) between distinct long `fp` at most `max_bits` apart that keep every component whole.

    A block shared by more than `split_above` fingerprints is cut again by
    finer blocks, which leave 3 * 4 free bits: no group then holds more than
    2^12 fingerprints, whatever the input.
    """
    keys = _block_keys(fps, _masks(blocks, max_bits))
    sizes = keys.groupBy("k", "block").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = written(keys.join(sizes, ["k", "block"]), "blocks")
    small = groups.where(F.col("n") <= split_above).select(
        F.lit(0).alias("kk"), "k", F.lit(0).cast("long").alias("outer"), "block", "fp")
    fine = (groups.where(F.col("n") > split_above).select("fp", F.col("k").alias("kk"), F.col("block").alias("outer")))
    fine = _block_keys(fine, _masks(FINE_BLOCKS, max_bits), "kk", "outer").select("kk", "k", "outer", "block", "fp")
    order = ["kk", "k", "outer", "block"]
    parts = [part.repartition(*order).sortWithinPartitions(*order).mapInArrow(_forest(max_bits), "a long, b long")
             for part in (small, fine.withColumn("kk", F.col("kk") + 1))]
    return parts[0].union(parts[1])


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """`_doc`, `_row`, `doc_id`, `fp`, `root` (least fingerprint of the component) and `component_id` (least id reachable) of every document."""
    prints = written(fingerprints(docs, shingle), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("_doc").alias("least")), "nodes")
    roots = components(near_links(nodes.select("fp"), max_bits))
    rooted = (nodes.join(roots, nodes["fp"] == roots["node"], "left")
              .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(ids, "root").select("fp", "root", "component")
    return prints.join(named, "fp").select(
        *KEY, doc_id(), "fp", "root", F.when(F.col("component") != NO_ID, F.col("component")).alias("component_id"))


def keep_one(docs: DataFrame, **knobs) -> DataFrame:
    """The document with the least id of each component; of rows that share that id, the one with the least text hash."""
    first = (near_duplicates(docs, **knobs).groupBy("root").agg(F.min(F.struct(*KEY)).alias("one"))
             .select(F.col("one._doc").alias("_d"), F.col("one._row").alias("_r")))
    kept = keyed(docs).join(first, (F.col("_doc") == F.col("_d")) & (F.col("_row") == F.col("_r")))
    return unpacked(kept.dropDuplicates(KEY), docs)
