"""Near copies for the pipeline: pairs of texts whose sets of five-word shingles have a Jaccard similarity of SIMILARITY at least.

Candidates come from two sources. The first is SimHash, as in `simhash.py`: a
64-bit fingerprint of the shingles, blocks, and a spanning forest of the
fingerprints at most MAX_BITS bits apart; texts of one fingerprint are
candidates with the least of them. Few pairs near SIMILARITY are so close, so
BANDS keys of ROWS minima of the shingles (MinHash) add the others: a pair at
similarity s shares a key with probability 1 - (1 - s^ROWS)^BANDS, 0.99 at 0.8.
Every candidate is verified by the exact similarity of the two sets before it
becomes a link; components are those of the verified links.

Texts with equal sets are one node. In a key's group of up to ALL_PAIRS nodes
all pairs are candidates. In a larger one each node first meets the SEEDS
nodes that most others meet; nodes that are then outside the group's largest
component meet all nodes of other components. Pairs left out are already
connected, so the components are those of all pairs.

Defined results: words are in lower case. With fewer words than a shingle, the
whole sequence is the shingle. NULL, empty and blank texts are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrays import Rolling, mix, signed, split_words, text_chunks, word_hashes
from .components import components
from .quality_rules import LOWER
from .rows import KEY, keyed, unpacked, written
from .simhash import bits, near_links

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS = 12
ROWS = 5
# Nodes of a group of which all pairs are candidates.
ALL_PAIRS = 64
SEEDS = 3
_U = np.uint64
_MULTIPLIERS = np.random.default_rng(77).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * _U(2) + _U(1)


def _shingles(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row in order, and the rows' offsets in them."""
    starts, ends, first = split_words(data, bounds)
    rolling = Rolling(word_hashes(LOWER[data], starts, ends))
    counts = np.diff(first)
    many = np.where(counts > 0, np.maximum(counts - SHINGLE_WORDS + 1, 1), 0)
    row = np.repeat(np.arange(len(counts)), many)
    begin = np.arange(int(many.sum())) + np.repeat(first[:-1] - (np.cumsum(many) - many), many)
    hashes = rolling.slices(begin, np.minimum(begin + SHINGLE_WORDS, first[1:][row]))
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(counts)))])


def _nodes(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hash of each row's set; zero if it is empty."""
    return np.where(np.diff(offsets) > 0, Rolling(hashes).slices(offsets[:-1], offsets[1:]), _U(0))


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, bounds in text_chunks(batch.column("text")):
            hashes, offsets = _shingles(data, bounds)
            size = np.diff(offsets)
            some = np.flatnonzero(size > 0)
            keys = np.zeros((hi - lo, BANDS), np.uint64)
            for i, m in enumerate(_MULTIPLIERS if len(some) else ()):
                least = np.minimum.reduceat(mix(hashes * m), offsets[:-1][some])
                keys[some, i // ROWS] = mix(keys[some, i // ROWS] * _U(31) + least)
            part = batch.slice(lo, hi - lo)
            fp = bits(mix(hashes), np.repeat(np.arange(hi - lo), size), hi - lo).view(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * BANDS), pa.array(signed(keys.ravel())))
            yield pa.RecordBatch.from_arrays([part.column("_doc"), part.column("_row"), pa.array(signed(_nodes(hashes, offsets))),
                                              pa.array(size.astype(np.int64)), pa.array(fp), bands], names=[*KEY, "node", "size", "fp", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, bounds in text_chunks(batch.column("text")):
            hashes, offsets = _shingles(data, bounds)
            sets = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(signed(hashes)))
            yield pa.RecordBatch.from_arrays([pa.array(signed(_nodes(hashes, offsets))), sets], names=["node", "set"])


def _pairs(left: DataFrame, right: DataFrame, similarity: float) -> DataFrame:
    """Distinct (a, b) of nodes that share a key and whose sizes allow the similarity."""
    x, y = (side.select("band", "key", *[F.col(c).alias(f"{c}_{n}") for c in side.columns if c not in ("band", "key")])
            for side, n in ((left, "x"), (right, "y")))
    close = F.least("size_x", "size_y") >= F.lit(similarity) * F.greatest("size_x", "size_y")
    met = x.join(y, ["band", "key"]).where(close & (F.col("node_x") != F.col("node_y")))
    if "comp" in left.columns:
        met = met.where("comp_x <> comp_y")
    return met.select(F.greatest("node_x", "node_y").alias("a"), F.least("node_x", "node_y").alias("b")).distinct()


def _simhash_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b) of nodes whose fingerprints are linked, and of each node with the least one of its fingerprint."""
    prints = written(nodes.groupBy("fp").agg(F.min("node").alias("least")), "fingerprints")
    one, two = (prints.select(F.col("fp").alias(n), F.col("least").alias(f"least_{n}")) for n in "ab")
    apart = near_links(prints.select("fp")).distinct().join(one, "a").join(two, "b").select("least_a", "least_b")
    equal = nodes.join(prints, "fp").where("node <> least").select("node", "least")
    return apart.union(equal).toDF("x", "y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    one, two = (sets.select(F.col("node").alias(n), F.col("set").alias(f"set_{n}")) for n in "ab")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return (pairs.join(one, "a").join(two, "b")
            .where(shared >= F.lit(similarity) * (F.size("set_a") + F.size("set_b") - shared)).select("a", "b"))


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, all_pairs: int = ALL_PAIRS) -> DataFrame:
    """`_doc`, `_row`, `node` (hash of the set) and `root` (least node of the component) of every document."""
    texts = keyed(docs).select(*KEY, "text")
    prints = written(texts.mapInArrow(_prints, "_doc long, _row long, node long, size long, fp long, bands array<long>"), "prints")
    nodes = prints.where("size > 0").groupBy("node").agg(F.min("size").alias("size"), F.min("fp").alias("fp"), F.min("bands").alias("bands"), F.min(F.struct(*KEY)).alias("one"))
    nodes = written(nodes, "nodes")
    keys = nodes.select("node", "size", F.posexplode("bands").alias("band", "key"))
    counts = keys.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = written(keys.join(counts, ["band", "key"]), "groups")
    met = groups.groupBy("node").agg(F.sum("n").alias("met"))
    small = groups.where(F.col("n") <= all_pairs).select("band", "key", "node", "size")
    large = groups.where(F.col("n") > all_pairs).select("band", "key", "node", "size")
    central = _central(large, met)
    pairs = written(_simhash_pairs(nodes).union(_pairs(small, small, similarity)).union(
        _pairs(central, large, similarity)).distinct(), "pairs")
    held = groups.select("node").union(pairs.select("a")).union(pairs.select("b")).distinct()
    speak = nodes.join(held, "node").select(F.col("one._doc").alias("_d"), F.col("one._row").alias("_r"))
    members = texts.join(speak, (F.col("_doc") == F.col("_d")) & (F.col("_row") == F.col("_r"))).select("text")
    sets = written(members.mapInArrow(_sets, "node long, set array<long>").dropDuplicates(["node"]), "sets")
    links = written(_verified(pairs, sets, similarity), "verified")
    roots = components(links)
    if large.limit(1).count():
        # Nodes of large groups that the seeds left outside the group's largest component.
        placed = written(large.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root"), "placed")
        sizes = placed.groupBy("band", "key", "comp").agg(F.count(F.lit(1)).alias("n"))
        most = sizes.groupBy("band", "key").agg(F.max_by("comp", F.struct("n", "comp")).alias("most"))
        outside = placed.join(most, ["band", "key"]).where("comp <> most").drop("most")
        links = links.union(_verified(written(_pairs(outside, placed, similarity), "pairs"), sets, similarity))
        roots = components(links)
    return prints.select(*KEY, "node").join(roots, "node", "left").select(*KEY, "node", F.coalesce("root", "node").alias("root"))


def _central(large: DataFrame, met: DataFrame) -> DataFrame:
    """The SEEDS nodes of each group that meet most others, found by one aggregate each."""
    ranked = written(large.join(met, "node"), "ranked")
    out, left = None, ranked
    for _ in range(SEEDS):
        best = left.groupBy("band", "key").agg(F.max(F.struct("met", "node", "size")).alias("best"))
        best = written(best.select("band", "key", F.col("best.node").alias("node"), F.col("best.size").alias("size")), "seeds")
        out = best if out is None else out.union(best)
        left = left.join(best.select("band", "key", "node"), ["band", "key", "node"], "left_anti")
    return out


def keep_one(docs: DataFrame, **knobs) -> DataFrame:
    """The document with the least id of each component; of rows that share that id, the one with the least text hash."""
    first = (near_copies(docs, **knobs).groupBy("root").agg(F.min(F.struct(*KEY)).alias("one"))
             .select(F.col("one._doc").alias("_d"), F.col("one._row").alias("_r")))
    kept = keyed(docs).join(first, (F.col("_doc") == F.col("_d")) & (F.col("_row") == F.col("_r")))
    return unpacked(kept.dropDuplicates(KEY), docs)
