"""Pieces of files come to Python many at a time, and a function sees each as if it came alone."""

import random

import pandas as pd
import pytest

from strandline.sources import files as L


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pieces_over_batches(spark, small_batches):
    rng = random.Random(5)
    big = (1 << 53) + 1
    rows = [(f"f{f}", i, big + i if f % 2 or rng.random() < 0.8 else None, f == 3 or None if rng.random() < 0.3 else False, "x" * i)
            for f, n in enumerate((1, 6, 7, 8, 50, 13, 24)) for i in range(1, n + 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "file string, line_no long, v long, b boolean, line string").repartition(3)

    def look(piece):
        return pd.DataFrame({"file": [""], "index": [str(list(piece.index))], "lines": [",".join(map(str, piece["line_no"]))], "kind": [f"{piece['v'].dtype} {piece['b'].dtype}"],
                             "v": [str(list(piece["v"]))], "b": [str(list(piece["b"]))], "columns": [" ".join(piece.columns)], "text": ["".join(piece["line"])]})
    for lines in (1, 3, 10, 100):
        got = L.per_file(df, look, "file string, index string, lines string, kind string, v string, b string, columns string, text string", "%F%%%N", lines)
        want = []
        for f in sorted({r[0] for r in rows}):
            own = sorted(r for r in rows if r[0] == f)
            for p in range(0, len(own), lines):
                part = own[p:p + lines]
                v, b = [r[2] for r in part], [r[3] for r in part]
                if None in v:
                    v = [float("nan") if x is None else float(x) for x in v]
                want.append((f"{f}%{p // lines}", str(list(range(len(part)))), ",".join(str(r[1]) for r in part),
                             f"{'float64' if None in [r[2] for r in part] else 'int64'} {'object' if None in b else 'bool'}", str(v), str(b), "file line_no v b line _piece", "".join(r[4] for r in part)))
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_results_of_different_types_and_sizes(spark, small_batches):
    df = spark.createDataFrame([("a", i) for i in range(1, 41)], "file string, line_no long")
    big = (1 << 53) + 1

    def some(piece):
        first = int(piece["line_no"].iloc[0])
        return pd.DataFrame({"n": [big, None] if first % 4 == 1 else [big] * (first % 3), "file": "x"}, columns=["n", "file"])
    got = sorted((r.file, r.n) for r in L.per_file(df, some, "file string, n long", "%N", 1).where("n % 2 = 1").collect())
    assert got == sorted((str(i - 1), big) for i in range(1, 41) if i % 4 != 1 for _ in range(i % 3))


def test_pieces_are_not_handed_over_one_by_one(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "file string, line_no long")
    plan = L.per_file(df, lambda p: p[["file"]], "file string")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan
    assert L.per_file(df.where("file = 'b'"), lambda p: p[["file"]], "file string").collect() == []
