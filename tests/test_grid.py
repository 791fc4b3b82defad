"""Grid lines of all kinds of values; points are made once for the lines and once for the result."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from strandline.operators import runs as U

RNG = random.Random(11)
VALUES = {
    "dense": [RNG.randint(0, 10 ** 7) / 100 for _ in range(3000)],
    "clustered": [50 + 2.0 ** -RNG.randint(0, 60) * RNG.random() for _ in range(500)] + [0.0, 100.0, -1e-300, 3e-300],
    "one bin": [1 + i * 2.0 ** -50 for i in range(300)] + [1e9],
    "regular": [i / 10 for i in range(400)],
    "negative": [-abs(RNG.gauss(0, 1e6)) for _ in range(500)] + [None, 0.0, -0.0],
    "one": [3.5, 3.5],
}


def _lines(values, cells):
    dense = sorted({v for v in values if v is not None})
    step, lines = (dense[-1] - dense[0]) / cells / 2, dense[:1]
    for v in dense:
        if v > lines[-1] + step:
            lines.append(v)
    return lines


def _check(df, values, cells):
    lines = _lines(values, cells)
    got = sorted((r.x, r.grid_x) for r in U.snap_to_grid(df, cells, 3).where("x is not null").collect())
    assert got == sorted((v, max(a for a in lines if a <= v)) for v in values if v is not None)


@pytest.mark.parametrize("kind", VALUES)
@pytest.mark.parametrize("cells", [1, 20, 90])
def test_lines_of_doubles(spark, monkeypatch, kind, cells):
    values = VALUES[kind]
    df = spark.createDataFrame([(v, float(i % 7)) for i, v in enumerate(values)], "x double, y double").repartition(3)
    _check(df, values, cells)
    # Few bins need more rounds.
    monkeypatch.setattr(U, "_BINS_PER_CELL", 1)
    monkeypatch.setattr(U, "_LEAST_BINS", 2)
    if kind != "dense" or cells < 90:
        _check(df, values, cells)


@pytest.mark.parametrize("kind, make", [("long", lambda i: RNG.randint(-10 ** 9, 10 ** 9)), ("int", lambda i: RNG.randint(0, 60)), ("decimal(15,2)", lambda i: Decimal(RNG.randint(0, 10 ** 6)) / 100)])
def test_lines_of_other_numbers(spark, kind, make):
    values = [make(i) for i in range(600)]
    _check(spark.createDataFrame([(v, 0.0) for v in values], f"x {kind}, y double"), values, 16)


def test_no_lines(spark):
    df = spark.createDataFrame([(None, 1.0), (None, float("nan"))], "x double, y double")
    assert {(r.grid_x, r.grid_y) for r in U.snap_to_grid(df, 3, 3).collect()} == {(None, 1.0)}
    df = spark.createDataFrame([(1.0, 1.0), (float("inf"), float("-inf"))], "x double, y double")
    assert sorted((r.grid_x, r.grid_y) for r in U.snap_to_grid(df, 3, 3).collect()) == [(1.0, float("-inf"))] * 2


def test_points_are_made_twice_at_most(spark):
    runs = spark.sparkContext.accumulator(0)

    def made(x):
        runs.add(1)
        return x * x * 0.37
    points = spark.range(50).select(F.udf(made, "double").asNondeterministic()("id").alias("x"), F.col("id").cast("double").alias("y"))
    assert U.snap_to_grid(points, 5, 5).collect()
    assert runs.value <= 2 * 50
