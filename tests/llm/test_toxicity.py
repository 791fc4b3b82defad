"""Toxicity: features by hand, trees and calibration against plain versions, accuracy on documents held out."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from strandline.llm import toxicity as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, _doc string, id int, fold int, toxic string"
LABELS = "doc_id long, quality int, toxic int, text string"
CLASH = ("en", "s", 1, 0.5, "d", 2, 3, "t")


def texts(n: int, seed: int = 4) -> tuple[list, list]:
    """Plain prose; a fifth is toxic by listed words, by words that no list has, or by disguised words."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [f"wort{rng.randint(0, 400)}" + rng.choice(["", "", ",", "."]) for _ in range(rng.randint(5, 120))]
        toxic = rng.random() < 0.2
        if toxic:
            kind = rng.choice([["you", "idiot"], ["blorgish"], ["ST*UPID", "l0ser!!"], ["grumbax" + rng.choice("abcdefgh")]])
            for _ in range(3):
                words.insert(rng.randint(0, len(words)), rng.choice(kind))
        docs.append((i, " ".join(words)))
        labels.append((i, 0, int(toxic), "clash"))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = texts(1500)
    extra = [(None, "you idiot idiot"), (None, None), (5000, None), (5001, ""), (5002, " \n "), (5003, "word " * 60_000), (5004, "you idiot " * 30_000),
             (5005, "same text here"), (5005, "same text here"), (5006, docs[7][1])]
    more = [(None, 0, 1, None), (5000, 1, None, None), (5001, 0, 0, None), (5004, 0, 0, None), (5004, 0, 1, None), (9999, 0, 1, None), (3, 0, labels[3][2], "again")]
    return (spark.createDataFrame([d + CLASH for d in docs + extra], DOCS), spark.createDataFrame(labels + more, LABELS), dict(docs), {r[0]: r[2] for r in labels})


def test_scores(tables):
    docs, labels, known, toxic = tables
    rows = T.toxicity_scores(docs.repartition(7), labels).collect()
    assert len(rows) == docs.count() and rows[0].__fields__ == ["doc_id", "held_out", "score", "predicted"]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in toxic]
    right = [r.predicted == toxic[r.doc_id] for r in held]
    assert len(held) > 400 and np.mean(right) > 0.97
    by = {r.doc_id: r.score for r in rows}
    assert by[5006] == by[7] and len({r.score for r in rows if r.doc_id == 5005}) == 1
    assert len({by[5000], by[5001], by[5002]}) == 1 and by[5004] > 0.5 > by[5003]


def test_partitions_change_nothing(tables):
    docs, labels, _, _ = tables
    score = lambda d: sorted((r.doc_id or -1, round(r.score, 12)) for r in T.toxicity_scores(d, labels).collect())
    assert score(docs.repartition(3)) == score(docs.repartition(17))


def test_held_out_labels_are_not_read(spark, tables):
    docs, labels, _, _ = tables
    turned = labels.selectExpr("doc_id", "1 - quality as quality",
                               "if(doc_id is not null and crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - toxic, toxic) as toxic", "text")
    score = lambda ls: sorted((r.doc_id or -1, r.score) for r in T.toxicity_scores(docs, ls).collect())
    assert score(turned) == score(labels)


def test_empty_tables(spark, tables):
    docs, labels, _, _ = tables
    none, no_labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert T.toxicity_scores(none, labels).count() == 0
    assert {r.score for r in T.toxicity_scores(docs.limit(20), no_labels).collect()} == {0.0}
    assert {r.score for r in T.toxicity_scores(docs.limit(20), labels.where("toxic = 0")).collect()} == {0.0}


def test_features_by_hand():
    text = ["You absolute idiot!! I-D-I-O-T", "", "a ST*UPID l0ser", "l o s e r sooooo NICE"]
    data = np.frombuffer("".join(text).encode(), np.uint8)
    bounds = np.cumsum([0] + [len(t) for t in text])
    x = T.features(data, bounds, [])
    name = {n: i for i, n in enumerate(["words", "insults", "ln_insults", "threats", "ln_threats", "profane", "ln_profane", "masked", "ln_masked", "you",
                                        "nearness", "near_hits", "caps", "caps_words", "bang", "ask", "star", "shout", "odd", "stretch", "alone"])}
    assert x.shape == (4, len(name)) and not x[1].any()
    get = lambda row, n: float(x[row, name[n]])
    assert get(0, "insults") == pytest.approx(2 / 4) and get(0, "masked") == 0 and get(0, "you") == pytest.approx(1 / 4)
    assert get(0, "nearness") == pytest.approx(1 / 3) and get(0, "near_hits") == pytest.approx(2 / 4)
    assert get(2, "insults") == pytest.approx(2 / 3) and get(2, "masked") == pytest.approx(1 / 3)  # a star is left out of both forms, a digit of one
    assert get(2, "odd") == pytest.approx(2 / 3) and get(2, "star") == pytest.approx(1 / 15)
    assert get(3, "alone") == pytest.approx(3 / 7) and get(3, "stretch") == pytest.approx(3 / 7) and get(3, "caps_words") == pytest.approx(1 / 7)


def test_isotonic_is_the_least_squares_curve():
    rng = np.random.default_rng(1)
    s = np.round(rng.random(60), 1)
    y, w = (rng.random(60) < s).astype(float), rng.random(60) + 0.1
    knots = T.isotonic(s, y, w)
    got = np.interp(np.unique(s), *knots)
    values = np.unique(s)
    mass = np.array([w[s == v].sum() for v in values])
    mean = np.array([(w * y)[s == v].sum() for v in values]) / mass
    # Largest lower average over all intervals around each point.
    want = [max(min((mean[a:b + 1] * mass[a:b + 1]).sum() / mass[a:b + 1].sum() for b in range(i, len(values))) for a in range(i + 1)) for i in range(len(values))]
    assert got == pytest.approx(want) and (np.diff(got) >= -1e-12).all()


def test_trees_follow_their_cuts_and_first_split_is_the_best():
    rng = np.random.default_rng(2)
    x = rng.random((400, 3)).astype(np.float32)
    y = ((x[:, 1] > 0.5) ^ (x[:, 2] > 0.8)).astype(float)
    w = np.ones(400)
    model = T.boost(x, y, w, trees=20)

    def walk(row):
        total = model["base"]
        for feature, cut, leaf in model["trees"]:
            node = 0
            for _ in range(model["depth"]):
                node = 2 * node + 1 + int(row[feature[node]] > cut[node])
            total += leaf[node - (2 ** model["depth"] - 1)]
        return total

    got = T.margins(model, x)
    assert got == pytest.approx([walk(r) for r in x])
    assert ((got > 0) == (y > 0)).mean() > 0.95
    p = y.mean()
    gain = lambda m: sum(((p - y)[k].sum()) ** 2 / (p * (1 - p) * k.sum() + 1) for k in (m, ~m))
    feature, cut, _ = model["trees"][0]
    best = max(gain(x[:, j] <= c) for j in range(3) for c in np.quantile(x[:, j], np.linspace(0, 1, T.BINS + 1)[1:-1]).astype(np.float32))
    assert gain(x[:, feature[0]] <= cut[0]) >= 0.98 * best
