"""Substring dedup over words: matching statistics on a compressed FM-index of each shard.

A shard's index is the Burrows-Wheeler transform of its text, held as a
wavelet matrix (one packed bit vector with block counts for each bit of a
symbol). Documents' stretches are streamed through it by backward search, all
side by side; a window that matches over the whole threshold is an interval of
the index, and it is removed if the least document of that interval comes
before its own. How stretches reach their shard is told in `stretches`.

Defined results: NULL text has no words, texts shorter than a window lose
none. A document with NULL id counts as later than all others. Rows that
repeat an id never remove each other's words.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .rows import doc_id, unpacked
from .stretches import Unit, ranks_to_depth, without_repeats

WINDOW_WORDS = 50
UNIT = Unit(words=True, window=WINDOW_WORDS, gram=25, shard=1 << 19, other_document=True)
_U = np.uint64


class WaveletMatrix:
    """Rank of any symbol in any prefix, from packed bit vectors."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        n = len(symbols)
        for level in range(bits - 1, -1, -1):
            bit = ((symbols >> level) & 1).astype(bool)
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            bytes_ = np.packbits(bit, bitorder="little")
            packed[:len(bytes_)] = bytes_
            words = packed.view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]).astype(np.int32)
            self.levels.append((level, words, before, n - int(bit.sum())))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def follow(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where prefixes of length `at` end among the sorted copies of `symbol`."""
        for level, words, before, zeros in self.levels:
            block = at >> 6
            ones = before[block] + np.bitwise_count(words[block] & ((_U(1) << (at & 63).astype(np.uint64)) - _U(1)))
            at = np.where((symbol >> level) & 1, zeros + ones, at - ones)
        return at


class FMIndex:
    """Backward search for patterns of up to `depth` symbols."""

    def __init__(self, text: np.ndarray, depth: int):
        rank = ranks_to_depth(text, depth)
        self.suffixes = np.argsort(rank, kind="stable")
        symbols = text[self.suffixes - 1]
        alphabet = int(text.max()) + 1
        self.matrix = WaveletMatrix(symbols, max(1, (alphabet - 1).bit_length()))
        every = np.arange(alphabet)
        counts = np.bincount(text, minlength=alphabet)
        # First suffix of each symbol, less where its copies begin in the matrix.
        self.base = np.cumsum(counts) - counts - self.matrix.follow(every, np.zeros(alphabet, np.int64))
        self.size = len(text)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with `symbol` put in front."""
        ends = self.matrix.follow(np.concatenate([symbol, symbol]), np.concatenate([low, high])) + np.tile(self.base[symbol], 2)
        return ends[:len(symbol)], ends[len(symbol):]

    def blocks(self, text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the interval of each suffix's first `depth` symbols."""
        rank = ranks_to_depth(text, depth)[self.suffixes]
        edge = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]]))
        which = np.cumsum(np.concatenate([[False], rank[1:] != rank[:-1]]))
        return edge[which], np.append(edge[1:], len(rank))[which]


def matching_windows(index: FMIndex, shorter: tuple[np.ndarray, np.ndarray], text: np.ndarray, place: np.ndarray, window: int):
    """Interval of each window in the index; empty where it doesn't occur.

    Windows stand in order. Each stretch is streamed backwards: from a window's
    interval, the last symbol is given up (`shorter`: intervals of window - 1
    symbols) and the symbol before is put in front. Where a match breaks, the
    next window is searched from its end.
    """
    low, high = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    fresh = np.append(place[1:] != place[:-1] + 1, True)  # the last window of each stretch
    last = np.flatnonzero(fresh)
    length = np.diff(np.append(-1, last))

    def search(which: np.ndarray) -> None:
        a, b = np.zeros(len(which), np.int64), np.full(len(which), index.size)
        for k in range(window - 1, -1, -1):
            a, b = index.extend(text[place[which] + k], a, b)
        low[which], high[which] = a, b

    search(last)
    for back in range(1, int(length.max()) if len(length) else 0):
        now = last[length > back] - back
        live = high[now + 1] > low[now + 1]
        if not live.all():
            search(now[~live])
            now = now[live]
        a, b = shorter[0][low[now + 1]], shorter[1][low[now + 1]]
        low[now], high[now] = index.extend(text[place[now]], a, b)
    return low, high


def _repeats(text: np.ndarray, place: np.ndarray, first: np.ndarray, unit: Unit) -> np.ndarray:
    """Windows that also start in a document before their own."""
    index = FMIndex(text, unit.window + 1)
    low, high = matching_windows(index, index.blocks(text, unit.window - 1), text, place, unit.window)
    # Documents in index order; an interval of the threshold's length starts where a block does.
    holder = np.full(len(text), np.iinfo(np.int64).max)
    holder[place] = first
    starts = np.unique(low)
    least = np.minimum.reduceat(holder[index.suffixes], starts)
    return (high > low) & (least[np.searchsorted(starts, low)] < first)


def substring_dedup(docs: DataFrame, unit: Unit = UNIT, **knobs) -> DataFrame:
    """`doc_id`, `n_words`, `n_removed`, `kept_sha256` (kept words, joined by a space), `kept` (the text left), `_all`."""
    return without_repeats(docs, unit, _repeats, **knobs).select(
        doc_id(), F.col("size").alias("n_words"), "n_removed", "kept_sha256", F.col("kept").cast("string").alias("kept"), "_all")


def cut_repeats(docs: DataFrame, **knobs) -> DataFrame:
    """The documents without the repeated words; `n_chars`, if there, follows the text."""
    changed = {"text": F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("_all.text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_all.n_chars"))
    return unpacked(substring_dedup(docs, **knobs), docs, **changed)
