"""Quality classifier from positive and unlabelled documents (non-negative PU learning).

Trusted positives and unlabelled web text are each a bounded sample, SAMPLE_ROWS
documents by hash of the id; everything else covers all rows. A linear model
minimises the non-negative unbiased risk (Kiryo et al. 2017) with logistic
loss: prior * R+(P) + max(0, R-(U) - prior * R-(P)). Where the part in the
brackets falls below zero, its gradient is turned round. The class prior is the
least ratio of unlabelled to positive documents above a score, on documents
that the first fit has not seen (Garg et al. 2021).

Features come from the text alone: frequencies of byte pairs in 512 hashed
bins, and counts of words, lines, symbols, capitals and repetitions.

Defined results: NULL and empty texts have zero features and get a score like
any other. Rows with NULL ids are never held out and never labelled. Repeated
rows get equal scores. The order and partitions of the rows change nothing.
Without a positive every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .arrays import text_chunks
from .quality_rules import _count_rows
from .rows import doc_id, keyed

# Bound on the rows that the model is fitted on: so many positives, so many unlabelled documents.
SAMPLE_ROWS = 8_000
THRESHOLD = 0.7
STEPS = 400
BINS = 512


def _features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    rows = len(bounds) - 1
    counts, lines, _, _ = _count_rows(data, bounds)
    words, chars, symbols, dup, repeat = (np.asarray(c, float) for c in counts)
    size = np.diff(bounds).astype(float)
    row = np.repeat(np.arange(rows), np.diff(bounds))
    pair = (data[:-1].astype(np.int64) * 257 + data[1:].astype(np.int64) * 31) % BINS
    inside = row[:-1] == row[1:]
    bins = np.bincount(row[:-1][inside] * BINS + pair[inside], minlength=rows * BINS).reshape(rows, BINS)

    def share(lo: int, hi: int) -> np.ndarray:
        return np.bincount(row, (data >= lo) & (data <= hi), rows) / np.maximum(size, 1)

    n_lines = np.diff(lines).astype(float)
    plain = np.stack([np.log1p(words), np.log1p(n_lines), chars / np.maximum(words, 1), symbols / np.maximum(words, 1), dup / np.maximum(n_lines, 1),
                      repeat / np.maximum(words, 1), share(65, 90), share(48, 57), share(33, 47), share(128, 255), share(10, 10),
                      np.sqrt(symbols / np.maximum(words, 1)), np.sqrt(repeat / np.maximum(words, 1)), np.sqrt(dup / np.maximum(n_lines, 1)),
                      (words < 20).astype(float), (words == 0).astype(float)], axis=1)
    return np.concatenate([plain, np.sqrt(bins / np.maximum(size, 1)[:, None])], axis=1).astype(np.float32)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, bounds in text_chunks(batch.column("text")):
            part, x = batch.slice(lo, hi - lo), _features(data, bounds)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "row", "half", "positive", "unlabelled")), flat],
                                             names=["id", "row", "half", "positive", "unlabelled", "x"])


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _dot(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.einsum("ij,j->i", x, w)


def fit_nn_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, rate: float = 0.1, decay: float = 1e-4) -> np.ndarray:
    """Weights (the last is the intercept) of least non-negative risk, by Adam on the whole sample."""
    w = np.zeros(positive.shape[1])
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        zp, zu = _dot(positive, w), _dot(unlabelled, w)
        up_p, up_u = _sigmoid(zp), _sigmoid(zu)
        risk_negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        grad_positive = prior * np.einsum("ij,i->j", positive, up_p - 1) / len(positive)
        grad_negative = (np.einsum("ij,i->j", unlabelled, up_u) / len(unlabelled)
                         - prior * np.einsum("ij,i->j", positive, up_p) / len(positive))
        grad = grad_positive + grad_negative if risk_negative >= 0 else -grad_negative
        grad = grad + decay * w
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad ** 2
        w = w - rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)
    return w


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled: scores of documents that the scorer has not seen."""
    cuts = np.quantile(positive, np.linspace(0.02, 0.9, 45))
    above_p = np.array([(positive >= c).mean() for c in cuts])
    above_u = np.array([(unlabelled >= c).mean() for c in cuts])
    slack = np.sqrt(np.log(200) / 2) * (1 / np.sqrt(len(unlabelled)) + 1 / np.sqrt(len(positive)))
    best = int(((above_u + slack) / above_p).argmin())
    return float(np.clip(above_u[best] / above_p[best], 0.02, 0.98))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> dict | None:
    """Mean, scale, weights and prior, from documents outside the held-out fold."""
    spread = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << 20))
    trusted = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("p")).distinct()
    known, total = trusted.count(), docs.where(F.col("doc_id").isNotNull() & ~held_out()).count()
    if not known or not total:
        return None
    part = lambda n: int((1 << 20) * min(1.0, rows / n))
    # About `rows` ids: bounded, so it may be broadcast.
    trusted = F.broadcast(trusted.where(F.pmod(F.xxhash64("p"), F.lit(1 << 20)) < part(known)))
    base = docs.where(F.col("doc_id").isNotNull() & ~held_out()).withColumn("u", F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(7)), F.lit(1 << 20)) < part(total))
    marked = (base.join(trusted, F.col("doc_id").cast("long") == F.col("p"), "left").where(F.col("p").isNotNull() | F.col("u"))
              .select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"), F.col("p").isNotNull().alias("positive"),
                      F.col("u").alias("unlabelled"), "text").withColumn("half", F.pmod(F.xxhash64("id", F.lit(11)), F.lit(2)) == 0))
    found = marked.mapInArrow(_feature_rows, "id long, row long, half boolean, positive boolean, unlabelled boolean, x array<float>").toArrow()
    if not found.num_rows:
        return None
    found = found.sort_by([("id", "ascending"), ("row", "ascending")])  # the order and partitions of the rows change nothing
    x = found.column("x").combine_chunks()
    x = (pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x).flatten().to_numpy().reshape(found.num_rows, -1).astype(np.float64)
    p, u = found.column("positive").to_numpy(), found.column("unlabelled").to_numpy()
    if not p.any():
        return None
    u = u if u.any() else ~u
    mean, scale = x[u].mean(0), x[u].std(0) + 1e-3
    x = np.concatenate([np.clip((x - mean) / scale, -8, 8) / np.sqrt(x.shape[1]), np.ones((len(x), 1))], axis=1)
    half = found.column("half").to_numpy()
    # Either half tells the prior by a fit on the other one.
    priors = []
    for seen in (half, ~half):
        if all(part.any() for part in (p & seen, u & seen, p & ~seen, u & ~seen)):
            first = fit_nn_pu(x[p & seen], x[u & seen], 0.5, STEPS // 2)
            priors.append(class_prior(_dot(x[p & ~seen], first), _dot(x[u & ~seen], first)))
    prior = float(np.mean(priors)) if priors else 0.5
    return {"mean": mean, "scale": scale, "weights": fit_nn_pu(x[p], x[u], prior), "prior": prior}


def _score(model: dict | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in text_chunks(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                if model is None:
                    score = np.zeros(hi - lo)
                else:
                    x = np.clip((_features(data, bounds) - model["mean"]) / model["scale"], -8, 8) / np.sqrt(len(model["mean"]))
                    score = _sigmoid(_dot(x, model["weights"][:-1]) + model["weights"][-1])
                yield pa.RecordBatch.from_arrays([part.column("_doc"), pa.array(score)], names=["_doc", "score"])
    return run


def quality_scores(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """`doc_id`, `held_out`, `score`, `predicted` for every document."""
    scored = keyed(docs).select("_doc", "text").mapInArrow(_score(train(docs, labels, rows)), "_doc long, score double")
    return scored.select(doc_id(), "score").select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
