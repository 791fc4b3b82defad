"""Cross-entropy difference: target and background bigram models over one vocabulary.

The vocabulary is every word (lower case) of all documents. Both models
interpolate bigrams with add-one unigrams, with the same weight: p(w|v) =
WEIGHT * c(v,w) / c(v) + (1 - WEIGHT) * (c(w) + 1) / (n + V + 1). The target model
counts the documents labelled as trusted, the background model counts all; no
count of either is left out.

What the models gather grows with the corpus and is never broadcast. Documents
are dealt into blocks by id and text; a block sends its distinct words and
bigrams once, as 64-bit keys with its own counts, these are summed by key, and
sums that differ from the block's own counts go back to it. A block then scores
its documents alone. Texts move once. Only three totals reach the driver.

Keys travel packed: a row has a block's keys of one range of keys, sorted, as
differences laid out byte by byte, so that their zero bytes compress away.

Defined results: the first word of a text is scored by unigrams. NULL and
empty texts have no words and NULL losses. Repeated rows count as often as they
come and get equal scores. Without a trusted document the target is add-one.
Rows with NULL ids are never trusted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrays import mix, signed, split_words, text_chunks, word_hashes
from .quality_rules import LOWER
from .rows import doc_id, keyed, written

WEIGHT = 0.7
# Characters of text in one block.
BLOCK_CHARS = 20 << 20
# Keys in one range, at most about so many where every word and bigram is new.
RANGE_KEYS = 1 << 21


def _hashes(column: pa.Array):
    for lo, hi, data, bounds in text_chunks(column):
        starts, ends, first = split_words(data, bounds)
        yield lo, hi, word_hashes(LOWER[data], starts, ends), first


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with their summed count rows."""
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.concatenate(counts, axis=1)
    return key, np.stack([np.bincount(inverse, c, len(key)).astype(np.int64) for c in count])


def _count_words(batches):
    """Words as keys with partial counts (`doc` is NULL), and the number of words of each document."""
    def counted(keys, counts):
        key, count = _merge(keys, counts)
        return pa.RecordBatch.from_arrays([pa.nulls(len(key), pa.int64()), pa.array(signed(key)), pa.array(count[0])], names=["doc", "word", "n"])

    keys, counts, held = [], [], 0
    for batch in batches:
        for lo, hi, h, first in _hashes(batch.column("text")):
            u, c = np.unique(h, return_counts=True)
            keys.append(u)
            counts.append(c[None, :])
            held += len(u)
            yield pa.RecordBatch.from_arrays([batch.column("_doc").slice(lo, hi - lo), pa.nulls(hi - lo, pa.int64()), pa.array(np.diff(first))], names=["doc", "word", "n"])
            if held > 1 << 21:
                yield counted(keys, counts)
                keys, counts, held = [], [], 0
    if held:
        yield counted(keys, counts)


def _keys(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the bigrams, rows of the words, and the places of words that have one before them."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(row[1:] == row[:-1]) + 1
    return mix(h[at - 1] * np.uint64(0x9E3779B97F4A7C15) + mix(h[at])), row, at


def _trusted(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The documents of a block, and which of them are trusted. Trusted ids come as rows of their own."""
    mark = table.column("mark").to_numpy()
    docs = table.filter(pa.array(~mark))
    return docs, np.isin(docs.column("_doc").to_numpy(), table.column("_doc").to_numpy()[mark])


def _planes(x: np.ndarray, width: int) -> bytes:
    return x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def _unplanes(b, width: int) -> np.ndarray:
    return np.frombuffer(b, np.uint8).reshape(width, -1).T.copy().view(f"<u{width}")[:, 0]


def _packed(key: np.ndarray, *counts: np.ndarray) -> list[bytes]:
    """Ascending keys as differences, and their counts."""
    return [_planes(np.diff(key, prepend=np.uint64(0)), 8), *(_planes(c, 8) for c in counts)]


def _unpacked(rows: pa.Table, names: tuple[str, str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys and counts of all rows, and the number of keys of each."""
    keys = [np.cumsum(_unplanes(b.as_buffer(), 8), dtype=np.uint64) for b in rows.column("keys")]
    counts = [[_unplanes(b.as_buffer(), 8).astype(np.int64) for b in rows.column(c)] for c in names]
    join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
    return join(keys, np.uint64), join(counts[0], np.int64), join(counts[1], np.int64), np.array([len(k) for k in keys], np.int64)


def _block_counts(docs: pa.Table, trusted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words and bigrams of a block with their counts in all and in trusted documents."""
    keys, counts, held, base = [], [], 0, 0
    for batch in docs.to_batches():
        for lo, hi, h, first in _hashes(batch.column("text")):
            pair, row, at = _keys(h, first)
            good = trusted[base + lo:base + hi][row]
            u, inverse = np.unique(np.concatenate([pair, h]), return_inverse=True)
            keys.append(u)
            counts.append(np.stack([np.bincount(inverse, minlength=len(u)), np.bincount(inverse, np.concatenate([good[at], good]), len(u)).astype(np.int64)]))
            held += len(u)
            if held > 1 << 20:
                key, count = _merge(keys, counts)
                keys, counts, held = [key], [count], 0
        base += batch.num_rows
    return _merge(keys, counts) if keys else (np.empty(0, np.uint64), np.empty((2, 0), np.int64))


def _ask(ranges: int):
    width = np.uint64(min((1 << 64) - 1, (1 << 64) // ranges + 1))

    def run(table: pa.Table) -> pa.Table:
        key, count = _block_counts(*_trusted(table))
        part, first = np.unique(key // width, return_index=True)
        rows = [_packed(key[lo:hi], count[0, lo:hi], count[1, lo:hi]) for lo, hi in zip(first, np.append(first[1:], len(key)))]
        column = lambda i: pa.array([r[i] for r in rows], pa.binary())
        block = table.column("block")[0].as_py()
        return pa.table({"part": part.astype(np.int64), "block": np.full(len(part), block, np.int32), "keys": column(0), "n": column(1), "t": column(2)})
    return run


def _sum(table: pa.Table) -> pa.Table:
    """For each block of a range of keys, the keys that other blocks have too, and their whole counts."""
    key, n, t, sizes = _unpacked(table, ("n", "t"))
    u, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    whole = [np.bincount(inverse, c, len(u)).astype(np.int64) for c in (n, t)]
    out, at = {"block": [], "keys": [], "n": [], "t": []}, 0
    for block, size in zip(table.column("block").to_pylist(), sizes):
        mine = inverse[at:at + size]
        mine = mine[times[mine] > 1]
        at += size
        if len(mine):
            for name, v in zip(out, (block, *_packed(u[mine], whole[0][mine], whole[1][mine]))):
                out[name].append(v)
    return pa.table({"block": pa.array(out["block"], pa.int32()), **{c: pa.array(out[c], pa.binary()) for c in ("keys", "n", "t")}})


def _score_block(totals: tuple[int, int], size: int, weight: float):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs, trusted = _trusted(docs)
        key, count = _block_counts(docs, trusted)
        shared, n, t, _ = _unpacked(answers, ("n", "t"))
        at = np.searchsorted(key, shared)
        count[0][at], count[1][at] = n, t
        seen = (count[1], count[0])
        words, losses = [], [[], []]
        for batch in docs.to_batches():
            for lo, hi, h, first in _hashes(batch.column("text")):
                pair, row, at = _keys(h, first)
                single, double = np.searchsorted(key, h), np.searchsorted(key, pair)
                words.append(np.diff(first))
                for m in range(2):
                    own = seen[m][single]
                    alone = (own + 1) / (totals[m] + size)
                    p = alone.copy()
                    p[at] = weight * seen[m][double] / np.maximum(own[at - 1], 1) + (1 - weight) * alone[at]
                    losses[m].append(np.bincount(row, -np.log(p), hi - lo))
        n = np.concatenate(words) if words else np.empty(0, np.int64)
        mean = [np.concatenate(x) / np.maximum(n, 1) if x else np.empty(0) for x in losses]
        return pa.table({"_doc": docs.column("_doc"), "n_tokens": pa.array(n, pa.int64()),
                         "target_loss": pa.array(mean[0], mask=n == 0), "background_loss": pa.array(mean[1], mask=n == 0)})
    return run


def cross_entropy_difference(docs: DataFrame, trusted: DataFrame, weight: float = WEIGHT) -> DataFrame:
    """`doc_id`, `n_tokens`, `target_loss`, `background_loss`, `difference` (target less background, per token) of every document.

    `trusted`: ids (`doc_id`) of the documents of the target model.
    """
    rows = keyed(docs).select("_doc", "_row", "text")
    ids = trusted.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("_doc")).distinct()
    counted = written(rows.select("_doc", "text").mapInArrow(_count_words, "doc long, word long, n long"), "words")
    in_target = counted.where("doc is not null").join(ids.withColumnRenamed("_doc", "doc"), "doc", "left_semi").agg(F.sum("n")).first()[0] or 0
    all_words = counted.where("doc is null").groupBy("word").agg(F.sum("n").alias("n")).agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")).first()
    # Rows without text need no block.
    some = rows.where("text <> ''")
    bare = rows.where("text is null or text = ''").select("_doc", F.lit(0).cast("long").alias("n_tokens"), *[F.lit(None).cast("double").alias(c) for c in ("target_loss", "background_loss")])
    chars = some.agg(F.sum(F.length("text"))).first()[0] or 0
    placed = some.withColumn("block", F.pmod(F.xxhash64("_doc", "_row"), F.lit(1 + chars // BLOCK_CHARS)).cast("int")).drop("_row")
    # Trusted ids travel as rows beside the texts, to each block that has such a document, so that texts move once.
    marks = placed.select("_doc", "block").distinct().join(ids, "_doc", "left_semi").select("_doc", F.lit(None).cast("string").alias("text"), "block")
    dealt = placed.withColumn("mark", F.lit(False)).unionByName(marks.withColumn("mark", F.lit(True)))
    n_words = all_words.n or 0
    asked = dealt.groupBy("block").applyInArrow(_ask(1 + 2 * n_words // RANGE_KEYS), "part long, block int, keys binary, n binary, t binary")
    answers = asked.groupBy("part").applyInArrow(_sum, "block int, keys binary, n binary, t binary")
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _score_block((in_target, n_words), all_words.v + 1, weight), "_doc long, n_tokens long, target_loss double, background_loss double")
    return scored.union(bare).select(doc_id(), "n_tokens", "target_loss", "background_loss", (F.col("target_loss") - F.col("background_loss")).alias("difference"))
