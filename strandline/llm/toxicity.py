"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features are densities of word lists, nearness of listed words to second-person
words, rates of capitals and punctuation, and of disguises (digits or symbols
for letters, stretched letters, single letters in a row). Words are compared
after folding: lower case, look-alike characters as letters, other characters
and doubled letters left out; a listed word that only folding shows is counted as disguised.

Beside the fixed lists there is a learned one: words and word stems whose
presence is tied to the label. The labelled sample has three folds; a model
takes its words from one, its trees from the next, and tells the third its log
odds, on which the calibration is fitted; a score is the calibrated mean of the
log odds of three such models. Words are counted by an aggregate; the driver
gets at most LEARNED words a fold, and the features of the sample.

The sample holds about SAMPLE_ROWS labelled documents of either class (by hash
of the id, weighted back to their share), a documented bound. Scores cover all rows and move none.

Defined results: NULL and empty texts have zero features and get a score like
any other. Rows with NULL ids are never held out and never labelled; an id with
several labels is toxic if one says so. Repeated rows get equal scores. The
order and partitions of the rows change nothing. Where no fold can make a model, every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .arrays import signed, split_words, text_chunks, word_hashes
from .rows import doc_id, keyed

SAMPLE_ROWS = 8_000
LEARNED = 256
THRESHOLD = 0.7
FOLDS = 3
TREES, DEPTH, RATE, BINS = 60, 3, 0.15, 32
# Bytes of the word stems that may be learned like words.
STEMS = (4, 5, 6, 7, 8)
NEAR = 5
FAR = 50

INSULTS = ("idiot moron stupid dumb loser fool clown imbecile jerk scum trash garbage worthless pathetic disgusting vermin coward liar freak creep "
           "idiote imbécile crétin connard dummkopf trottel arschloch estúpido imbécil tonto cabrón").split()
THREATS = "kill die hurt destroy beat burn murder shoot stab hang attack rape".split()
PROFANITY = "damn hell crap shit fuck fucking bitch bastard ass asshole piss bullshit merde putain scheisse mierda puta".split()
SECOND_PERSON = ("you your yours yourself u ur du dich dir dein deine euch euer tu toi te ton tes vous votre vos tú ti tus usted ustedes vosotros").split()

_FOLD = np.zeros(256, np.uint8)
_FOLD[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A"):ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)
_LETTER = _FOLD > 0
# Look-alikes of letters.
for _c, _as in zip("013457@$", "oieastas"):
    _FOLD[ord(_c)] = ord(_as)


def _letters(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, double: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of `codes` (0: not a letter) without doubled ones, and each word's start and end among them."""
    keep = codes > 0
    if not double and len(codes) > 1:
        keep[1:] &= (codes[1:] != codes[:-1]) | (codes[1:] >= 128)
    before = np.concatenate([[0], np.cumsum(keep)])
    return codes[keep], before[starts], before[ends]


def _hashed(letters: np.ndarray, lo: np.ndarray, hi: np.ndarray, full: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lo), np.uint64)
    out[full] = word_hashes(letters, lo[full], hi[full])
    return out


def fold_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word after folding; 0 where no letter is left."""
    letters, lo, hi = _letters(_FOLD[data], starts, ends, double=False)
    return _hashed(letters, lo, hi, hi > lo)


def fold_stems(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Folded words, then the stems of longer words: their first bytes, told apart from words of that length."""
    letters, lo, hi = _letters(_FOLD[data], starts, ends, double=False)
    stems = [np.where(hi - lo > n, _hashed(letters, lo, np.minimum(hi, lo + n), hi - lo > n) ^ np.uint64(n), np.uint64(0)) for n in STEMS]
    return [_hashed(letters, lo, hi, hi > lo), *stems]


def plain_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    letters, lo, hi = _letters(np.where(_LETTER[data], _FOLD[data], 0).astype(np.uint8), starts, ends, double=True)
    return _hashed(letters, lo, hi, hi > lo)


def _listed(words: list[str], hashes) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = split_words(data, np.array([0, len(data)]))
    return np.unique(hashes(data, starts, ends))


_LISTS = [INSULTS, THREATS, PROFANITY]
_FOLDED = [_listed(w, fold_words) for w in _LISTS]
_PLAIN = [_listed(w, plain_words) for w in _LISTS]
_YOU = _listed(SECOND_PERSON, plain_words)


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _distance(hits: np.ndarray, anchors: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Words from each hit to the next anchor of its document, FAR at most."""
    best = np.full(len(hits), FAR)
    if len(hits) and len(anchors):
        i = np.searchsorted(anchors, hits)
        for j in (np.clip(i - 1, 0, len(anchors) - 1), np.clip(i, 0, len(anchors) - 1)):
            best = np.where(row[anchors[j]] == row[hits], np.minimum(best, np.abs(anchors[j] - hits)), best)
    return best


def features(data: np.ndarray, bounds: np.ndarray, learned: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """One row of common features per document, then LEARNED_FEATURES for each learned list (sorted folded words and their weights)."""
    n = len(bounds) - 1
    starts, ends, first = split_words(data, bounds)
    row = np.repeat(np.arange(n), np.diff(first))
    words = np.maximum(np.diff(first), 1).astype(float)
    size = np.maximum(np.diff(bounds), 1).astype(float)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    stems, plain = fold_stems(data, starts, ends), plain_words(data, starts, ends)
    folded = stems[0]
    per_word = lambda mask, weight=None: np.bincount(row[mask], None if weight is None else weight[mask], n)
    per_byte = lambda mask: np.bincount(owner[mask], minlength=n)

    bad, masked = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    columns = [np.log1p(np.diff(first))]
    for f, p in zip(_FOLDED, _PLAIN):
        shown, seen = _member(plain, p), _member(folded, f)
        bad |= shown | seen
        masked |= seen & ~shown
        columns += [per_word(shown | seen) / words, np.log1p(per_word(shown | seen))]
    columns += [per_word(masked) / words, np.log1p(per_word(masked))]

    you = np.flatnonzero(_member(plain, _YOU))
    columns.append(np.bincount(row[you], minlength=n) / words)

    def near(hit: np.ndarray) -> list[np.ndarray]:
        at = np.flatnonzero(hit)
        gap = _distance(at, you, row)
        least = np.full(n, FAR)
        np.minimum.at(least, row[at], gap)
        return [1 / (1.0 + least) * (least < FAR), np.bincount(row[at[gap <= NEAR]], minlength=n) / words]

    columns += near(bad)
    upper = (data >= 65) & (data <= 90)
    letters = np.maximum(per_byte(_LETTER[data]), 1)
    caps = np.concatenate([[0], np.cumsum(upper)])
    letter_sum = np.concatenate([[0], np.cumsum(_LETTER[data])])
    n_caps, n_letters = caps[ends] - caps[starts], letter_sum[ends] - letter_sum[starts]
    columns += [per_byte(upper) / letters, per_word((n_caps == n_letters) & (n_letters > 1)) / words]
    for sign in b"!?*":
        columns.append(per_byte(data == sign) / size)
    shout = (data[1:] == 33) & (data[:-1] == 33) if len(data) else np.zeros(0, bool)
    columns.append(np.bincount(owner[1:][shout], minlength=n) / size)
    # A look-alike or a symbol between two letters of a word.
    odd = np.zeros(len(data), bool)
    if len(data) > 2:
        mid = data[1:-1]
        odd[1:-1] = _LETTER[data[:-2]] & _LETTER[data[2:]] & ~_LETTER[mid] & (mid > 32) & (mid != 39) & (mid != 45)
    columns.append(per_byte(odd) / words)
    stretch = np.zeros(len(data), bool)
    if len(data) > 2:
        fold = _FOLD[data]
        stretch[2:] = (fold[2:] == fold[1:-1]) & (fold[2:] == fold[:-2]) & _LETTER[data[2:]] & (data[2:] < 128)
    columns.append(per_byte(stretch) / words)
    alone = n_letters == 1
    run = np.zeros(len(starts), bool)
    run[2:] = alone[2:] & alone[1:-1] & alone[:-2] & (row[2:] == row[:-2])
    columns.append(per_word(run) / words)
    for known, weight in learned:
        value = np.zeros(len(starts))
        for h in stems if len(known) else ():
            found = _member(h, known)
            value[found] = np.maximum(value[found], weight[np.searchsorted(known, h[found])])
        hit = value > 0
        most = np.zeros(n)
        np.maximum.at(most, row[hit], value[hit])
        columns += [per_word(hit) / words, np.log1p(per_word(hit)), per_word(hit, value) / words, most, *near(hit)]
    return np.stack(columns, axis=1).astype(np.float32)


LEARNED_FEATURES = 6


# Trees: arrays of features, cuts and leaf values of complete binary trees.

def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> dict:
    """Newton boosting of the logistic loss on features cut at quantiles."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
    # Rare features are zero at most quantiles: some cuts among their other values.
    cuts = [np.unique(np.concatenate([c, [0], np.quantile(v[v > 0], [0.1, 0.25, 0.5, 0.75, 0.9]) if (v := x[:, j]).max() > 0 else []])) for j, c in enumerate(cuts)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    width = max(len(c) for c in cuts) + 1
    allowed = np.zeros((m, width), bool)
    for j, c in enumerate(cuts):
        allowed[j, :len(c)] = True
    share = float((weight * y).sum() / weight.sum())
    base = np.log(share / (1 - share))
    margin, out = np.full(n, base), []
    offset = np.arange(m) * width
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, cut = np.zeros(2 ** depth - 1, np.int64), np.full(2 ** depth - 1, np.inf)
        for level in range(depth):
            here = 2 ** level
            key = (node[:, None] * m * width + offset + binned).ravel()
            shape = (here, m, width)
            gs = np.bincount(key, np.repeat(g, m), here * m * width).reshape(shape).cumsum(2)
            hs = np.bincount(key, np.repeat(h, m), here * m * width).reshape(shape).cumsum(2)
            gt, ht = gs[:, :1, -1:], hs[:, :1, -1:]
            gain = gs ** 2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt ** 2 / (ht + 1)
            gain = np.where(allowed & (hs > 1e-3) & (ht - hs > 1e-3), gain, -1).reshape(here, -1)
            best = gain.argmax(1)
            split = gain[np.arange(here), best] > 1e-6
            j, b = best // width, best % width
            at = here - 1 + np.arange(here)
            feature[at] = np.where(split, j, 0)
            cut[at] = [cuts[f][c] if s else np.inf for f, c, s in zip(j, b, split)]
            node = node * 2 + (x[np.arange(n), feature[here - 1 + node]] > cut[here - 1 + node])
        gl, hl = np.bincount(node, g, 2 ** depth), np.bincount(node, h, 2 ** depth)
        leaf = -rate * gl / (hl + 1)
        margin = margin + leaf[node]
        out.append((feature, cut, leaf))
    return {"base": base, "depth": depth, "trees": out}


def margins(model: dict, x: np.ndarray) -> np.ndarray:
    rows, total = np.arange(len(x)), np.full(len(x), model["base"])
    for feature, cut, leaf in model["trees"]:
        node = np.zeros(len(x), np.int64)
        for level in range(model["depth"]):
            at = 2 ** level - 1 + node
            node = node * 2 + (x[rows, feature[at]] > cut[at])
        total = total + leaf[node]
    return total


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the least-squares monotone curve: equal scores are pooled first, then neighbours that fall."""
    order = np.argsort(score, kind="stable")
    s, first = np.unique(score[order], return_index=True)
    w = np.add.reduceat(weight[order], first)
    v = np.add.reduceat((weight * y)[order], first) / w
    blocks: list[list[float]] = []  # mean, weight, lowest score, highest score
    for value, mass, at in zip(v, w, s):
        blocks.append([value, mass, at, at])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            value, mass, _, high = blocks.pop()
            last = blocks[-1]
            last[0] = (last[0] * last[1] + value * mass) / (last[1] + mass)
            last[1] += mass
            last[3] = high
    knots = np.array([[b[2], b[0]] for b in blocks] + [[b[3], b[0]] for b in blocks])
    knots = knots[np.lexsort((knots[:, 1], knots[:, 0]))]
    return knots[:, 0], knots[:, 1]


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct folded words and stems of each document, counted by fold and class within a batch."""
    for batch in batches:
        for lo, hi, data, bounds in text_chunks(batch.column("text")):
            part = batch.slice(lo, hi - lo)
            kind = part.column("fold").to_numpy() * 2 + part.column("toxic").to_numpy()
            starts, ends, first = split_words(data, bounds)
            stems = fold_stems(data, starts, ends)
            word = np.concatenate(stems)
            row = np.tile(np.repeat(np.arange(hi - lo), np.diff(first)), len(stems))
            order = np.lexsort((word, row))
            word, row = word[order], row[order]
            new = np.r_[True, (word[1:] != word[:-1]) | (row[1:] != row[:-1])][:len(word)] & (word > 0)
            word, group = word[new], kind[row[new]]
            order = np.lexsort((word, group))
            word, group = word[order], group[order]
            at = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (group[1:] != group[:-1])][:len(word)])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(group[at] // 2), pa.array(group[at] % 2), pa.array(signed(word[at])),
                                                  pa.array(np.diff(np.append(at, len(word))))], names=["fold", "toxic", "word", "n"])


def _learned(sample: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each fold the words most surely tied to the label (at most LEARNED) and their log odds."""
    sizes = {(r.fold, r.toxic): r.n for r in sample.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    counted = sample.mapInArrow(_presence, "fold long, toxic long, word long, n long").groupBy("fold", "word").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b"))
    total = lambda t: F.element_at(F.create_map(*[F.lit(v) for f in range(FOLDS) for v in (f, sizes.get((f, t), 0))]), F.col("fold").cast("int"))
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(a / (total(1) + 1)) - F.log(b / (total(0) + 1))
    sure = counted.where("a > 2").withColumn("odds", odds).withColumn("low", odds - 2 * F.sqrt(1 / a + 1 / b)).where("low > 0.7")
    best = sure.withColumn("k", F.row_number().over(W.partitionBy("fold").orderBy(F.desc("low"), "word"))).where(F.col("k") <= LEARNED).collect()
    found = []
    for f in range(FOLDS):
        pairs = sorted((r.word & (1 << 64) - 1, r.odds) for r in best if r.fold == f)
        found.append((np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], float)))
    return found


def _sample_rows(learned):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in text_chunks(batch.column("text")):
                part, x = batch.slice(lo, hi - lo), features(data, bounds, learned)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "row", "fold", "toxic")), flat], names=["id", "row", "fold", "toxic", "x"])
    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int) -> tuple[DataFrame, dict]:
    """`id`, `row`, `fold`, `toxic`, `text` of about `rows` documents of either class outside the held-out fold, and each class's sampled share."""
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
             .groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.max("toxic") == 1).cast("long").alias("toxic")))
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {t: min(1.0, rows / n) for t, n in sizes.items()}
    spread = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    taken = known.where((F.col("toxic") == 1) & (spread < int(share.get(1, 0) * (1 << 20))) | (F.col("toxic") == 0) & (spread < int(share.get(0, 0) * (1 << 20))))
    # About twice `rows` ids: bounded, so they may be broadcast.
    sample = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(taken), "id")
    return sample.select("id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"), F.pmod(F.xxhash64("id", F.lit(13)), F.lit(FOLDS)).cast("long").alias("fold"), "toxic", "text"), share


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> dict:
    """Three models with their word lists."""
    sample, share = labelled_sample(docs, labels, rows)
    if not share.get(1) or not share.get(0):
        return {"learned": [], "models": []}
    learned = _learned(sample)
    found = sample.mapInArrow(_sample_rows(learned), "id long, row long, fold long, toxic long, x array<float>").toArrow()
    if not found.num_rows:
        return {"learned": [], "models": []}
    found = found.sort_by([("id", "ascending"), ("row", "ascending")])
    x = np.concatenate([c.flatten().to_numpy() for c in found.column("x").chunks]).reshape(found.num_rows, -1)
    fold, y = found.column("fold").to_numpy(), found.column("toxic").to_numpy().astype(float)
    weight = np.where(y == 1, 1 / share[1], 1 / share[0])
    weight = weight / weight.mean()
    common = x.shape[1] - FOLDS * LEARNED_FEATURES
    models, seen = [], []
    for j in range(FOLDS):
        use = np.r_[np.arange(common), common + j * LEARNED_FEATURES + np.arange(LEARNED_FEATURES)]
        grow, check = fold == (j + 1) % FOLDS, fold == (j + 2) % FOLDS
        if all(0 < y[part].sum() < part.sum() for part in (grow, check)):
            trees = boost(x[grow][:, use], y[grow], weight[grow])
            models.append((use, trees))
            seen.append((margins(trees, x[check][:, use]), y[check], weight[check]))
    return {"learned": learned, "models": models, "knots": isotonic(*map(np.concatenate, zip(*seen))) if seen else None}


def score_rows(model: dict, x: np.ndarray) -> np.ndarray:
    if not model["models"]:
        return np.zeros(len(x))
    return np.interp(np.mean([margins(trees, x[:, use]) for use, trees in model["models"]], axis=0), *model["knots"])


def _score(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, bounds in text_chunks(batch.column("text")):
                score = score_rows(model, features(data, bounds, model["learned"]))
                yield pa.RecordBatch.from_arrays([batch.slice(lo, hi - lo).column("_doc"), pa.array(score)], names=["_doc", "score"])
    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """`doc_id`, `held_out`, `score`, `predicted` for every document."""
    base = keyed(docs).select("_doc", "text")
    scored = base.mapInArrow(_score(train(docs, labels, rows)), "_doc long, score double")
    return scored.select(doc_id(), "score").select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
