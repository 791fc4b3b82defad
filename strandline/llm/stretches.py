"""Repeated windows of a corpus, from runs of windows that share their least gram.

Shared by the two exact substring operators. Every window of `window` codes
(words or bytes) belongs to the run of its least gram, so equal windows meet
under one key wherever they stand, and a run is sent as a key, a hash and a
place, never as text. Most keys occur once and are dropped by one aggregate.
Runs with the same key and hash are one class, resolved by its count or first
document. Only keys with several different runs need their codes: one run of
each class is cut out of its document and dealt to a shard by key, where the
caller's index finds equal windows. A key with very many classes is not put
into one shard: its windows are counted one by one by hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrays import BYTE_CODES, Rolling, covered, owned_windows, signed, split_words, text_chunks, word_hashes
from .rows import KEY, keyed, written

# Classes of one key that an index shard takes; further ones are resolved window by window.
SPLIT_ABOVE = 1024


@dataclass(frozen=True)
class Unit:
    """What a window is made of, and how large."""
    words: bool
    window: int
    gram: int
    shard: int  # codes of a shard
    other_document: bool  # a repeat counts only if it starts in a document with a smaller id

    def codes(self, data: np.ndarray, bounds: np.ndarray):
        """Codes, row offsets in codes, and the codes' places in the bytes."""
        if not self.words:
            return BYTE_CODES[data], bounds, None
        starts, ends, first = split_words(data, bounds)
        return word_hashes(data, starts, ends), first, (starts, ends)


def _runs(unit: Unit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in text_chunks(batch.column("text")):
                codes, first, _ = unit.codes(data, bounds)
                row, at, n, key, seg = owned_windows(Rolling(codes), first, unit.window, unit.gram)
                row = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_doc").take(row), batch.column("_row").take(row), pa.array(signed(key)), pa.array(signed(seg)),
                     pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], names=[*KEY, "key", "seg", "at", "n"])
    return run


def _cut_out(unit: Unit):
    """Codes of the wanted runs; of the runs of hot keys, the hash of each window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("wanted")
            fields = {c: wanted.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("at", "n", "key", "seg", "weight", "hot")}
            offsets = np.asarray(wanted.offsets) - wanted.offsets[0].as_py()
            for lo, hi, data, bounds in text_chunks(batch.column("text")):
                codes, first, _ = unit.codes(data, bounds)
                mine = slice(offsets[lo], offsets[hi])
                at, n, key, seg, weight, hot = (fields[c][mine] for c in ("at", "n", "key", "seg", "weight", "hot"))
                at = at + np.repeat(first[:-1], np.diff(offsets[lo:hi + 1]))
                hot = hot.astype(bool)
                raw = codes if unit.words else data
                content = [raw[a:b].tobytes() for a, b in zip(at[~hot].tolist(), (at + n + unit.window - 1)[~hot].tolist())]
                many = np.repeat(np.flatnonzero(hot), n[hot])
                begin = np.cumsum(n[hot]) - n[hot]
                off = np.arange(len(many)) - np.repeat(begin, n[hot])
                if len(many):
                    place = at[many] + off
                    content += [None] * len(many)
                    window = signed(Rolling(codes).slices(place, place + unit.window))
                else:
                    window = np.empty(0, np.int64)
                pick = np.concatenate([np.flatnonzero(~hot), many])
                none = np.zeros(int((~hot).sum()), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[pick]), pa.array(seg[pick]), pa.array(weight[pick]), pa.array(hot[pick]),
                     pa.array(np.concatenate([none, off]).astype(np.int32)), pa.array(np.concatenate([none, window])),
                     pa.array(content, pa.binary())], names=["key", "seg", "weight", "hot", "off", "hash", "content"])
    return run


def ranks_to_depth(codes: np.ndarray, depth: int) -> np.ndarray:
    """Rank of every suffix by its first `depth` codes, by prefix doubling. Suffixes of equal rank agree that far."""
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    reach = 1
    while reach < depth:
        step = min(reach, depth - reach)
        after = np.zeros_like(rank)
        after[:len(rank) - step] = rank[step:] + 1
        rank = np.unique(rank * (int(rank.max()) + 2) + after, return_inverse=True)[1].astype(np.int64)
        reach += step
    return rank


def flagged_runs(flags: np.ndarray, segment: np.ndarray, off: np.ndarray):
    """(segment, first offset, length) of the runs of flagged windows; windows lie in order."""
    hit = np.flatnonzero(flags)
    if not len(hit):
        return hit, hit, hit
    new = np.flatnonzero(np.append(True, (np.diff(hit) > 1) | (segment[hit][1:] != segment[hit][:-1])))
    return segment[hit][new], off[hit][new], np.diff(np.append(new, len(hit)))


def _shard(unit: Unit, index: Callable):
    def run(table: pa.Table) -> pa.Table:
        content = table.column("content").combine_chunks()
        if isinstance(content, pa.ChunkedArray):
            content = pa.concat_arrays(content.chunks)
        _, _, data, bounds = next(text_chunks(content, 1 << 62))
        width = 8 if unit.words else 1
        codes = data.view(np.uint64) if unit.words else data
        bounds = bounds // width
        weight = table.column("weight").to_numpy()
        count = np.diff(bounds) - unit.window + 1
        segment = np.repeat(np.arange(len(count)), count)
        off = np.arange(len(segment)) - np.repeat(np.cumsum(count) - count, count)
        # One separator behind each segment; no window reaches over it.
        spread = np.arange(len(codes)) + np.repeat(np.arange(len(count)), np.diff(bounds))
        names = np.unique(codes, return_inverse=True)[1] + 1
        text = np.zeros(len(codes) + len(count), np.int64)
        text[spread] = names
        place = off + np.repeat(bounds[:-1] + np.arange(len(count)), count)
        owner, first, length = flagged_runs(index(text, place, weight[segment], unit), segment, off)
        return pa.table({"key": table.column("key").to_numpy()[owner], "seg": table.column("seg").to_numpy()[owner],
                         "off": first.astype(np.int32), "n": length.astype(np.int32)})
    return run


def repeated_spans(docs: DataFrame, unit: Unit, index: Callable, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """`_doc`, `_row`, `at`, `n`: runs of windows (first window, number) that are repeats.

    `index(text, place, weight, unit)` gets a shard's codes with separators,
    the places of all its windows and each window's weight (first document, or
    occurrences), and flags the windows that are repeats.
    """
    rows = keyed(docs).select(*KEY, "text")
    runs = written(rows.mapInArrow(_runs(unit), "_doc long, _row long, key long, seg long, at int, n int"), "runs")
    per_key = runs.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("_doc").alias("lo"), F.max("_doc").alias("hi"))
    # Written, so that the join behind it has a shuffle on either side and a hot key is split.
    again = written(per_key.where("lo < hi" if unit.other_document else "c > 1").select("key"), "repeated-keys")
    runs = written(runs.join(again, "key"), "repeated-runs")
    weight = F.min("_doc") if unit.other_document else F.count(F.lit(1))
    classes = written(runs.groupBy("key", "seg").agg(weight.alias("weight"), F.min(F.struct(*KEY, "at", "n")).alias("one")), "classes")
    settled = F.col("_doc") > F.col("weight") if unit.other_document else F.col("weight") > 1
    marked = runs.join(classes.select("key", "seg", "weight"), ["key", "seg"]).withColumn("settled", settled)
    # Keys with several classes: one run of each is looked up.
    variants = classes.groupBy("key").agg(F.count(F.lit(1)).alias("v")).where("v > 1")
    several = classes.join(variants, "key")
    wanted = several.select("one.*", "key", "seg", "weight", (F.col("v") > split_above).alias("hot"))
    wanted = wanted.groupBy(*KEY).agg(F.collect_list(F.struct("at", "n", "key", "seg", "weight", "hot")).alias("wanted"))
    cut = (rows.join(wanted, KEY).dropDuplicates(KEY).select("text", "wanted")
           .mapInArrow(_cut_out(unit), "key long, seg long, weight long, hot boolean, off int, hash long, content binary"))
    cut = written(cut, "cut-runs")
    size = cut.where("not hot").agg(F.sum(F.length("content"))).first()[0] or 0
    shards = 1 + size // (8 if unit.words else 1) // unit.shard
    found = (cut.where("not hot").select("key", "seg", "weight", "content", F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"))
             .groupBy("shard").applyInArrow(_shard(unit, index), "key long, seg long, off int, n int"))
    hot = cut.where("hot").select("key", "seg", "weight", "off", "hash")
    total = F.min("weight") if unit.other_document else F.sum("weight")
    totals = written(hot.groupBy("key", "hash").agg(total.alias("total")), "window-totals")
    found_hot = (hot.join(totals, ["key", "hash"]).where(F.col("total") < F.col("weight") if unit.other_document else F.col("total") > 1)
                 .select("key", "seg", "off", F.lit(1).alias("n")))
    found = found.union(found_hot).select("key", "seg", F.col("off").alias("off"), F.col("n").alias("m"))
    open_runs = runs.join(found, ["key", "seg"])
    if unit.other_document:
        open_runs = open_runs.join(classes.select("key", "seg", "weight"), ["key", "seg"]).where(F.col("_doc") == F.col("weight"))
    return (marked.where("settled").select(*KEY, "at", "n")
            .union(open_runs.select(*KEY, F.col("at") + F.col("off"), F.col("m"))))


def _removed(unit: Unit, data, bounds, spans_at, spans_n, offsets, lo, hi):
    """Per row of a chunk: mask over all codes, row offsets in codes, places of words."""
    if unit.words:
        starts, ends, first = split_words(data, bounds)
    else:
        starts = ends = None
        first = bounds
    mine = slice(offsets[lo], offsets[hi])
    at = spans_at[mine] + np.repeat(first[:-1], np.diff(offsets[lo:hi + 1]))
    return covered(int(first[-1]), at, at + spans_n[mine] + unit.window - 1), first, starts, ends


def _digest(unit: Unit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans")
            fields = spans.flatten()
            s_at, s_n = (fields.field(c).to_numpy(zero_copy_only=False) for c in ("at", "n"))
            offsets = np.asarray(spans.offsets) - spans.offsets[0].as_py()
            size, removed, pieces, digest, kept = [], [], [], [], []
            for lo, hi, data, bounds in text_chunks(batch.column("text")):
                gone, first, starts, ends = _removed(unit, data, bounds, s_at, s_n, offsets, lo, hi)
                for i in range(hi - lo):
                    a, b = int(first[i]), int(first[i + 1])
                    mask = gone[a:b]
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]])))
                    whole = data[bounds[i]:bounds[i + 1]]
                    if unit.words:
                        text = whole.tobytes()
                        left, right = (starts[a:b] - bounds[i])[~mask], (ends[a:b] - bounds[i])[~mask]
                        flat = b" ".join([text[x:y] for x, y in zip(left.tolist(), right.tolist())])
                        # The text itself loses each removed run up to the next kept word.
                        cuts = np.append(starts[a:b] - bounds[i], len(whole))[edges] if len(edges) else edges
                        stay = np.ones(len(whole), bool)
                        for x, y in cuts.reshape(-1, 2).tolist():
                            stay[x:y] = False
                        text = whole[stay].tobytes() if len(edges) else text
                    else:
                        text = flat = whole[~mask].tobytes()
                    size.append(b - a)
                    removed.append(int(mask.sum()))
                    pieces.append(len(edges) // 2)
                    digest.append(hashlib.sha256(flat).hexdigest())
                    kept.append(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_all"), batch.column("_doc"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(pieces, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary())],
                names=["_all", "_doc", "size", "n_removed", "n_spans", "kept_sha256", "kept"])
    return run


def without_repeats(docs: DataFrame, unit: Unit, index: Callable, **knobs) -> DataFrame:
    """Every document with its size in codes, what is removed and what is kept (`kept`, bytes)."""
    spans = (repeated_spans(docs, unit, index, **knobs).groupBy(*KEY)
             .agg(F.collect_set(F.struct("at", "n")).alias("spans")).withColumnsRenamed({"_doc": "_d", "_row": "_r"}))
    rows = keyed(docs).join(spans, (F.col("_doc") == F.col("_d")) & (F.col("_row") == F.col("_r")), "left")
    rows = rows.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<at:int,n:int>>")))
    few = rows.select("_all", "_doc", "text", "spans")
    schema = few.select("_all", "_doc").schema
    for name, kind in (("size", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string"), ("kept", "binary")):
        schema = schema.add(name, kind)
    return few.mapInArrow(_digest(unit), schema)
