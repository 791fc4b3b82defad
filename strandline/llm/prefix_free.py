"""Exact byte-level dedup by prefix-free parsing.

A rolling hash runs over every text; the trigger of a 200-byte window is the
position of its least hash. Triggers cut a text into phrases: a phrase is the
run of windows with one trigger, with the bytes that its last window needs, so
neighbours overlap by less than a window and each window lies in one phrase.
The parse is the texts as sequences of phrases; the dictionary holds each
distinct phrase once, with its number of occurrences in the parse.

Two equal windows have the same trigger, so the corpus order is made trigger
by trigger: the suffix array of a shard of the dictionary (cut at the window's
depth) puts equal windows side by side, and the parse gives each of them its
occurrences. A window is a repeat if its place in that order has two or more.
A phrase that occurs twice needs no suffix array: all its windows repeat.

Defined results: NULL text is empty and loses nothing. Repeated rows repeat
each other. Cuts may fall inside a character; what is kept is bytes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .rows import doc_id
from .stretches import Unit, ranks_to_depth, without_repeats

WINDOW_BYTES = 200
UNIT = Unit(words=False, window=WINDOW_BYTES, gram=64, shard=1 << 21, other_document=False)


def _repeats(text: np.ndarray, place: np.ndarray, occurrences: np.ndarray, unit: Unit) -> np.ndarray:
    """Windows with two or more occurrences among the suffixes that agree over a whole window."""
    rank = ranks_to_depth(text, unit.window)[place]
    return np.bincount(rank, occurrences)[rank] > 1


def prefix_free_dedup(docs: DataFrame, unit: Unit = UNIT, **knobs) -> DataFrame:
    """`doc_id`, `n_bytes`, `n_removed`, `n_spans`, `kept_sha256`, `kept` (bytes), `_all`."""
    return without_repeats(docs, unit, _repeats, **knobs).select(
        doc_id(), F.col("size").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256", "kept", "_all")
