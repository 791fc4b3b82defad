"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit distance.

Texts are words in lower case without ASCII punctuation. A document holds an
item if some stretch of its words is within an edit distance of a fifth of the
item's words (insertions, deletions, substitutions of words).

A window of an item's size is embedded by a random walk that copies the word
under its pointer at every step and moves on by a coin that depends on step
and word (Chakraborty, Goldenberg, Koucky): close strings stay in step, so few
of the copied words differ. Each repetition samples a few steps as a key and
windows and items meet on equal keys. How often a walk at the full distance
meets falls with the size, so each bucket of sizes gets as many repetitions as
bring RECALL on made-up items of its largest size with edits at its full
distance; where MOST_REPETITIONS would not do, with fewer samples a key.
Met pairs are verified by a banded edit distance. Before walking,
windows are left out only if they cannot match: they start with a word of the
first words of no item, or hold more words unknown to all items of that size
than the distance allows.

Items are taken in blocks of bounded size, each a stated query set against all
documents. Defined results: NULL and empty texts hold nothing; items with
fewer than MIN_ITEM_WORDS words allow no edit and are looked up by the hash of
their words; items without words match nothing; equal items all match.
Repeated rows of a document give one row per item.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrays import Rolling, mix, split_words, text_chunks, word_hashes
from .quality_rules import LOWER
from .rows import KEY, doc_id, keyed, unpacked

SHARE = 0.2
MIN_ITEM_WORDS = 5
# Share of made-up items that a bucket's walks must meet, at the full distance.
RECALL = 0.97
TRIALS = 400
SAMPLES = 4
MOST_REPETITIONS = 96
# Words of the items of one block.
BLOCK_WORDS = 1 << 20
_TABLE = 1 << 20
_U = np.uint64

PLAIN = np.zeros(256, bool)
PLAIN[128:] = True
for first, last in (b"09", b"AZ", b"az"):
    PLAIN[first:last + 1] = True


def _hashed(column: pa.Array):
    """Word hashes and row offsets for slices of a text column."""
    for lo, hi, data, bounds in text_chunks(column):
        starts, ends, first = split_words(data, bounds, PLAIN)
        yield lo, hi, word_hashes(LOWER[data], starts, ends), first


def walk(seed: int, repetition: int, samples: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Coins of every step and the sampled steps of one repetition."""
    rng = np.random.default_rng([seed, repetition])
    steps = max(samples, 2 * least)
    coins = rng.integers(1, 1 << 63, steps, dtype=np.uint64) * _U(2) + _U(1)
    return coins, np.sort(rng.choice(steps, min(samples, steps), replace=False))


def embedded(words, start, stop, coins, sampled, sets=None):
    """Keys after each sampled step. With `sets`, only starts whose keys stay among them go on; gives (which, key)."""
    at, key, which, keys = start.copy(), np.zeros(len(start), np.uint64), np.arange(len(start)), []
    for step in range(int(sampled[-1]) + 1):
        word = np.where(at < stop, words[np.minimum(at, len(words) - 1)], _U(0))
        found = int(np.searchsorted(sampled, step))
        if found < len(sampled) and sampled[found] == step:
            key = mix(key + word * _U(0x9E3779B97F4A7C15) + _U(step))
            keys.append(key)
            if sets is not None:
                place = np.minimum(np.searchsorted(sets[found], key), len(sets[found]) - 1)
                stay = sets[found][place] == key
                at, key, which, stop, word = at[stay], key[stay], which[stay], stop[stay], word[stay]
                if not len(which):
                    break
        at = at + ((word * coins[step]) >> _U(63)).astype(np.int64)
    return keys if sets is None else (which, key)


class Exact:
    """Items of one size that allows no edit."""

    def __init__(self, words: np.ndarray, start: np.ndarray, size: int, item: np.ndarray):
        self.size, self.item, self.limit = size, item, np.zeros(len(item), np.int64)
        keys = Rolling(words).slices(start, start + size)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def candidates(self, words: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, index of the item) of stretches equal to an item."""
        start = np.arange(len(words))
        start = start[start + self.size <= stop]
        key = Rolling(words).slices(start, start + self.size)
        lo, hi = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        return _matched(start, self.order, lo, hi)

    def verified(self, words: np.ndarray, start: np.ndarray, item: np.ndarray, stop: np.ndarray):
        return np.zeros(len(start), np.int64), np.full(len(start), self.size)


def _matched(start: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """(start, index of the item) for each start and each place lo to hi of the ordered items."""
    many = hi - lo
    return np.stack([np.repeat(start, many), order[np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]])


class Bucket:
    """Items of similar size, with their keys for every repetition."""

    def __init__(self, words: np.ndarray, start: np.ndarray, size: np.ndarray, item: np.ndarray, share: float, seed: int,
                 repetitions: int, samples: int, low: int):
        self.words, self.start, self.size, self.item = words, start, size, item
        self.limit = np.floor(share * size + 1e-9).astype(np.int64)
        self.most = int(self.limit.max())
        self.least = int((size - self.limit).min())
        walks = [walk(seed, r, samples, low - int(share * low + 1e-9)) for r in range(repetitions)]
        self.coins, self.samples = [c for c, _ in walks], [x for _, x in walks]
        self.known, self.heads = np.zeros(_TABLE, bool), np.zeros(_TABLE, bool)
        for a, n, d in zip(start.tolist(), size.tolist(), self.limit.tolist()):
            self.known[words[a:a + n] & _U(_TABLE - 1)] = True
            self.heads[words[a:a + d + 1] & _U(_TABLE - 1)] = True
        stop = start + size
        self.keys = [embedded(words, start, stop, self.coins[r], self.samples[r]) for r in range(repetitions)]
        self.order = [np.argsort(k[-1], kind="stable") for k in self.keys]
        self.sets = [[np.unique(k) for k in keys] for keys in self.keys]

    def candidates(self, words: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, index of the item) of windows that meet an item in some repetition. `stop`: end of each word's row."""
        slot = words & _U(_TABLE - 1)
        unknown = np.concatenate([[0], np.cumsum(~self.known[slot])])
        start = np.flatnonzero(self.heads[slot])
        start = start[start + self.least <= stop[start]]
        start = start[unknown[start + self.least] - unknown[start] <= self.most]
        pairs = []
        for r in range(len(self.keys)):
            if not len(start):
                break
            which, key = embedded(words, start, stop[start], self.coins[r], self.samples[r], self.sets[r])
            ranked = self.keys[r][-1][self.order[r]]
            lo, hi = np.searchsorted(ranked, key, "left"), np.searchsorted(ranked, key, "right")
            pairs.append(_matched(start[which], self.order[r], lo, hi))
        pairs = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.empty((2, 0), np.int64)
        return pairs[0], pairs[1]

    def verified(self, words: np.ndarray, start: np.ndarray, item: np.ndarray, stop: np.ndarray):
        """Least edit distance of each item to the stretches that begin at `start`, and the length of the best one."""
        d, n = self.most, self.size[item]
        far = np.int64(1 << 30)
        shift = np.arange(-d, d + 1)
        row = np.where(shift >= 0, shift, far)[None, :].repeat(len(start), 0)  # row 0: words of the stretch inserted
        row = np.where(start[:, None] + shift[None, :] <= stop[:, None], row, far)
        best, length = np.full(len(start), far), np.zeros(len(start), np.int64)
        for i in range(1, int(n.max()) + 1 if len(n) else 0):
            item_word = self.words[np.minimum(self.start[item] + i - 1, len(self.words) - 1)]
            j = i + shift[None, :]  # words of the stretch used
            place = start[:, None] + j - 1
            usable = (j >= 0) & (place < stop[:, None])
            same = usable & (j >= 1) & (words[np.clip(place, 0, len(words) - 1)] == item_word[:, None])
            new = np.where(j >= 1, row + ~same, far)
            new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
            for k in range(1, 2 * d + 1):
                new[:, k] = np.minimum(new[:, k], new[:, k - 1] + 1)
            row = np.where(usable, np.minimum(new, far), far)
            done = n == i
            if done.any():
                k = row[done].argmin(1)
                best[done], length[done] = row[done, k], i + shift[k]
        return best, length


def edited(rng: np.random.Generator, words: np.ndarray, edits: int) -> np.ndarray:
    """`words` after so many substitutions, insertions and deletions at different words."""
    kind = np.full(len(words), -1)
    kind[rng.choice(len(words), edits, replace=False)] = rng.integers(0, 3, edits)
    new = rng.integers(1, 1 << 63, len(words), dtype=np.uint64)
    both = np.stack([np.where(kind == 0, new, words), new], axis=1)
    return both[np.stack([kind != 2, kind == 1], axis=1)]


@lru_cache(maxsize=256)
def plan(low: int, high: int, share: float, samples: int, seed: int) -> tuple[int, int]:
    """(repetitions, samples) that meet RECALL of made-up items of `high` words edited at their full distance.

    A bucket of the same seed, sizes and samples walks the same way in its first repetitions.
    """
    rng = np.random.default_rng(seed)
    limit = int(share * high + 1e-9)
    items = rng.integers(1, 1 << 63, (TRIALS, high), dtype=np.uint64)
    least = low - int(share * low + 1e-9)
    texts = [edited(rng, words, limit) for words in items]
    tails = [rng.integers(1, 1 << 63, high, dtype=np.uint64) for _ in texts]
    first = np.cumsum([0] + [len(t) + high for t in texts])
    words = np.concatenate([x for pair in zip(texts, tails) for x in pair])
    size = np.full(TRIALS, high)
    for n in range(min(samples, 2 * least), 0, -1):
        most = MOST_REPETITIONS if n > 1 else 16 * MOST_REPETITIONS
        met = np.zeros(TRIALS, bool)
        for r in range(most):
            coins, sampled = walk(seed, r, n, least)
            item_keys = embedded(items.ravel(), np.arange(TRIALS) * high, (np.arange(TRIALS) + 1) * high, coins, sampled)[-1]
            text_keys = embedded(words, first[:-1], first[1:], coins, sampled)[-1]
            met |= item_keys == text_keys
            if met.mean() >= RECALL:
                return r + 1, n
    return most, n


def item_buckets(items: list[tuple[int, str]], share: float = SHARE, repetitions: int | None = None, samples: int = SAMPLES,
                 min_words: int = MIN_ITEM_WORDS, seed: int = 11) -> list[Bucket | Exact]:
    """Buckets of one block of items; sizes in a bucket differ by a fifth at most. Stated `repetitions` are taken as they are."""
    ids = np.array([i for i, _ in items], np.int64)
    parts = [(lo, words, first) for lo, _, words, first in _hashed(pa.array([t for _, t in items], pa.string()))]
    if not parts:
        return []
    words = np.concatenate([w for _, w, _ in parts])
    base = np.cumsum([0] + [len(w) for _, w, _ in parts])
    start = np.concatenate([f[:-1] + b for (_, _, f), b in zip(parts, base)])
    size = np.concatenate([np.diff(f) for _, _, f in parts])
    out, low = [], min_words
    for n in range(1, min_words):
        mine = np.flatnonzero(size == n)
        if len(mine):
            out.append(Exact(words, start[mine], n, ids[mine]))
    while len(size) and low <= size.max():
        high = max(low + 1, int(low * 1.2))
        mine = np.flatnonzero((size >= low) & (size < high))
        if len(mine):
            walks, keyed_by = (repetitions, samples) if repetitions else plan(low, high - 1, share, samples, seed + low)
            out.append(Bucket(words, start[mine], size[mine], ids[mine], share, seed + low, walks, keyed_by, low))
        low = high
    return out


def _search(buckets: list[Bucket]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for lo, hi, words, first in _hashed(batch.column("text")):
                row = np.repeat(np.arange(hi - lo), np.diff(first))
                stop = first[1:][row]
                for bucket in buckets:
                    start, item = bucket.candidates(words, stop)
                    for a in range(0, len(start), 4096):
                        s, x = start[a:a + 4096], item[a:a + 4096]
                        distance, length = bucket.verified(words, s, x, stop[s])
                        ok = distance <= bucket.limit[x]
                        s, x = s[ok], x[ok]
                        found.append(np.stack([row[s] + lo, bucket.item[x], distance[ok], s - first[:-1][row[s]], length[ok]]))
            if not found:
                continue
            found = np.concatenate(found, axis=1)
            order = np.lexsort((found[3], found[2], found[1], found[0]))
            found = found[:, order]
            found = found[:, np.append(True, (np.diff(found[0]) != 0) | (np.diff(found[1]) != 0))[:found.shape[1]]]
            if found.shape[1]:
                row = pa.array(found[0])
                yield pa.RecordBatch.from_arrays([batch.column("_doc").take(row), batch.column("_row").take(row)]
                                                 + [pa.array(x) for x in found[1:]], names=[*KEY, "item", "distance", "at", "n"])
    return run


def leaks(docs: DataFrame, items: DataFrame, **knobs) -> DataFrame:
    """`_doc`, `_row`, `doc_id`, `item_id`, `distance`, `at`, `n_words`: the closest stretch of each document to each item it holds."""
    texts = (items.where(F.col("text").isNotNull()).groupBy("text").agg(F.min("item_id").alias("item"))
             .withColumn("size", F.length("text")))
    # Equal items are searched once, by the least of their ids (a NULL id by its text's hash), and named apart at the end.
    texts = texts.withColumn("item", F.xxhash64("text"))
    blocks = 1 + (texts.agg(F.sum("size")).first()[0] or 0) // (6 * BLOCK_WORDS)
    rows, parts = keyed(docs).select(*KEY, "text"), []
    for block in range(blocks):
        mine = texts.where(F.pmod("item", F.lit(blocks)) == block).select("item", "text")
        buckets = item_buckets([(r[0], r[1]) for r in mine.collect()], **knobs)  # at most about BLOCK_WORDS words
        parts.append(rows.mapInArrow(_search(buckets), "_doc long, _row long, item long, distance long, at long, n long"))
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    named = items.select(F.col("item_id"), F.xxhash64("text").alias("item"))
    return (found.dropDuplicates([*KEY, "item"]).join(named, "item")
            .select(*KEY, doc_id(), "item_id", "distance", "at", F.col("n").alias("n_words")))


def without_leaks(docs: DataFrame, items: DataFrame, **knobs) -> DataFrame:
    """The documents that hold no item."""
    held = leaks(docs, items, **knobs).select(F.col("_doc").alias("_d"), F.col("_row").alias("_r")).distinct()
    return unpacked(keyed(docs).join(held, (F.col("_doc") == F.col("_d")) & (F.col("_row") == F.col("_r")), "left_anti"), docs)
