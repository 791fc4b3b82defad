"""Quality rules: per-document counts, and lines repeated across the documents of a host.

Lines are normalised (words in lower case, single spaces), hashed, and counted
by distinct texts per host (`source`). A line above the limit of its host is
boilerplate and is removed; a document that keeps too little is rejected.

Defined results: NULL or empty text has no words, fails the word minimum and
is rejected. A NULL source is a host of its own. Repeated rows and exact
copies count once per host, so copies alone never make a line boilerplate.
Extra columns pass through. Documents are never sampled; the limit is a number
of texts, alike at every size of a host.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrays import BYTE_CODES, Rolling, covered, signed, split_words, text_chunks, word_hashes
from .rows import KEY, doc_id, keyed, unpacked, written

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8
# A line is boilerplate in more than this many texts of its host, however large the host is; a share of them may raise the limit.
MAX_LINE_SHARE = 0.0
MIN_LINE_TEXTS = 9
# A document is depleted if it keeps less than this share of its words.
MIN_KEPT_SHARE = 0.30

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_COUNTS = "_doc long, _row long, _host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_SCHEMA = _COUNTS + ", lines array<long>, line_words array<int>"


def _per_row(index: np.ndarray, rows: int, weights=None) -> np.ndarray:
    return np.bincount(index, weights, rows).astype(np.int64)


def _lines(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of every \\n-separated line."""
    breaks = np.flatnonzero(data == 10)
    rows = np.arange(len(bounds) - 1)
    row = np.concatenate([rows, np.searchsorted(bounds, breaks, "right") - 1])
    start = np.concatenate([bounds[:-1], breaks + 1])
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    end = np.append(start[1:] - 1, bounds[-1])
    last = np.append(row[1:] != row[:-1], True)
    end[last] = bounds[1:][row[last]]
    return row, start, end


def _line_words(data, bounds, starts, ends):
    """Lines that hold a word: row, start, end, first word, end word, normalised hash."""
    row, start, end = _lines(data, bounds)
    first, stop = np.searchsorted(starts, start), np.searchsorted(starts, end)
    has = stop > first
    row, start, end, first, stop = row[has], start[has], end[has], first[has], stop[has]
    hashes = Rolling(word_hashes(LOWER[data], starts, ends)).slices(first, stop)
    return row, start, end, first, stop, hashes


def _count_rows(data: np.ndarray, bounds: np.ndarray):
    rows = len(bounds) - 1
    starts, ends, first = split_words(data, bounds)
    n_words = np.diff(first)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    word_row = np.repeat(np.arange(rows), n_words)
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
    row, start, end, word, stop, line_hash = _line_words(data, bounds, starts, ends)
    raw = Rolling(BYTE_CODES[data]).slices(start, end) + row.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)
    n_lines = _per_row(row, rows)
    order = np.argsort(raw, kind="stable")
    again = order[1:][raw[order][1:] == raw[order][:-1]]
    dup = _per_row(row[again], rows)
    # Windows found twice or more in one row.
    grams = Rolling(word_hashes(data, starts, ends)).grams(REPEAT_WINDOW)
    at = np.flatnonzero(word_row[REPEAT_WINDOW - 1:] == word_row[:len(grams)]) if len(grams) else np.empty(0, np.int64)
    keys = grams[at] + word_row[at].astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = at[np.unique(np.concatenate([order[1:][same], order[:-1][same]]))] if len(order) else at
    repeat = _per_row(word_row[covered(len(starts), twice, twice + REPEAT_WINDOW)], rows)
    counts = (n_words, _per_row(word_row, rows, chars[ends] - chars[starts]), symbols[bounds[1:]] - symbols[bounds[:-1]], dup, repeat)
    return counts, np.concatenate([[0], np.cumsum(n_lines)]), line_hash, stop - word


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, bounds in text_chunks(batch.column("text")):
            counts, offsets, lines, words = _count_rows(data, bounds)
            offsets = pa.array(offsets, pa.int32())
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in ("_doc", "_row", "_host")] + [pa.array(c, pa.int64()) for c in counts]
                + [pa.ListArray.from_arrays(offsets, pa.array(signed(lines))),
                   pa.ListArray.from_arrays(offsets, pa.array(words.astype(np.int32)))],
                names=["_doc", "_row", "_host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words"])


def _hosted(docs: DataFrame, host: str) -> DataFrame:
    name = F.col("_all").getField(host) if host in docs.columns else F.lit(None)
    return keyed(docs).withColumn("_host", name.cast("string"))


def line_rules(docs: DataFrame, host: str = "source", max_share: float = MAX_LINE_SHARE, min_texts: int = MIN_LINE_TEXTS,
               min_kept_share: float = MIN_KEPT_SHARE, min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """One row per document: `_doc`, `_row`, the counts, `base_failed`, `bad_lines` (hashes to remove), `kept`."""
    rows = _hosted(docs, host)
    counts = written(rows.select(*KEY, "_host", "text").mapInArrow(_count, _SCHEMA), "line-counts")
    # One document of each distinct text of a host speaks for its copies.
    texts = counts.groupBy("_host", "_row").agg(F.min("lines").alias("lines"))
    limits = texts.groupBy("_host").agg(F.greatest(F.count(F.lit(1)) * max_share, F.lit(float(min_texts))).alias("limit"))
    frequent = (texts.select("_host", F.explode(F.array_distinct("lines")).alias("line"))
                .groupBy("_host", "line").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") > min_texts))
    bad = (frequent.join(limits, frequent["_host"].eqNullSafe(limits["_host"])).where(F.col("texts") > F.col("limit"))
           .select(frequent["_host"].alias("bad_host"), F.col("line").alias("bad_line")))
    hit = (counts.select(*KEY, "_host", F.explode(F.array_distinct("lines")).alias("line"))
           .join(bad, F.col("_host").eqNullSafe(F.col("bad_host")) & (F.col("line") == F.col("bad_line")))
           .groupBy(*KEY, "_host").agg(F.collect_set("line").alias("bad_lines")))
    hit = hit.withColumnsRenamed({"_doc": "d", "_row": "r", "_host": "h"})
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    gone = F.aggregate(F.arrays_zip("lines", "line_words"), F.lit(0).cast("long"), lambda total, x: F.when(
        F.array_contains("bad_lines", x["lines"]), total + x["line_words"]).otherwise(total))
    return (counts.join(hit, (F.col("_doc") == F.col("d")) & (F.col("_row") == F.col("r")) & F.col("_host").eqNullSafe(F.col("h")), "left")
            .withColumn("base_failed", failed)
            .withColumn("removed_words", F.when(F.col("bad_lines").isNull(), F.lit(0).cast("long")).otherwise(gone))
            .withColumn("kept", ~failed & (F.col("n_words") - F.col("removed_words") >= min_kept_share * F.col("n_words")))
            .select(doc_id(), *KEY, "_host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                    "removed_words", "bad_lines"))


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the lines of `_bad` out of `text`."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        bad = batch.column("_bad").to_pylist()
        for lo, hi, data, bounds in text_chunks(batch.column("text")):
            if not any(bad[lo:hi]):
                continue
            starts, ends, _ = split_words(data, bounds)
            row, start, end, _, _, hashes = _line_words(data, bounds, starts, ends)
            hashes = signed(hashes)
            for i in range(lo, hi):
                if bad[i]:
                    mine = slice(*np.searchsorted(row, [i - lo, i - lo + 1]))
                    drop = np.isin(hashes[mine], np.array(bad[i], np.int64))
                    gone = {int(s - bounds[i - lo]) for s in start[mine][drop]}
                    kept, where = [], 0
                    for line in texts[i].encode().split(b"\n"):
                        if where not in gone:
                            kept.append(line)
                        where += len(line) + 1
                    texts[i] = b"\n".join(kept).decode()
        yield pa.RecordBatch.from_arrays([batch.column("_all"), pa.array(texts, pa.string())], names=["_all", "text"])


def apply_line_rules(docs: DataFrame, **rules) -> DataFrame:
    """The documents that are kept, without their boilerplate lines; `n_chars`, if there, follows the text."""
    verdict = (line_rules(docs, **rules).where("kept")
               .select(F.col("_doc").alias("_d"), F.col("_row").alias("_r"), F.col("_host").alias("_h"), F.col("bad_lines").alias("_bad"))
               .dropDuplicates(["_d", "_r", "_h"]))
    rows = _hosted(docs, rules.get("host", "source"))
    kept = rows.join(verdict, (F.col("_doc") == F.col("_d")) & (F.col("_row") == F.col("_r")) & F.col("_host").eqNullSafe(F.col("_h")))
    kept = kept.select("_all", "text", "_bad")
    cut = kept.mapInArrow(_without, kept.drop("_bad").schema)
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return unpacked(cut, docs, **changed)
