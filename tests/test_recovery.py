"""Fewest jobs: fixtures and brute force over all sets of jobs."""

import itertools
import random

from strandline.operators import recovery as V

JOBS = "id long, inputkey string, outputkey string, knobs string, success int"


def frames(spark, jobs, broken, wanted):
    keys = lambda ks: spark.createDataFrame([(k,) for k in ks], "key string")
    return spark.createDataFrame(jobs, JOBS), keys(broken), keys(wanted)


def test_shortest_chains_are_not_the_fewest_jobs(spark):
    # Each of x, y, z has a maker of its own one step away (2 jobs each); the longer way through s is shared.
    jobs = [(1, "a1", "x", None, 1), (2, "a2", "y", None, 1), (3, "a3", "z", None, 1), (4, "ok", "a1", None, 1), (5, "ok", "a2", None, 1), (6, "ok", "a3", None, 1),
            (7, "s", "x,y,z", "", 1), (8, "r", "s", "", 1), (9, "ok", "r", "", 1)]
    broken = ["x", "y", "z", "a1", "a2", "a3", "s", "r"]
    args = frames(spark, jobs, broken, ["x", "y", "z"])
    got = {r.key: (r.level, r.job, r.fewest) for r in V.fewest_jobs(*args).collect()}
    assert got == {"r": (0, 9, True), "s": (1, 8, True), "x": (2, 7, True), "y": (2, 7, True), "z": (2, 7, True)}
    by_cost = V.fewest_jobs(*args, bits=0).collect()
    assert {r.job for r in by_cost} == {1, 2, 3, 4, 5, 6} and not any(r.fewest for r in by_cost)


def test_knobs_hints_cycles_and_orphans(spark):
    h = "a" * 32
    jobs = [(1, "ok", "p", f"REF={h},x", 1), (2, "ok", h + "+K@x", None, 1), (3, "q", "t", None, 1), (4, "t", "q", None, 1), (5, "ok", "f", "", 0), (6, None, "n", None, 1)]
    got = [tuple(r) for r in V.fewest_jobs(*frames(spark, jobs, ["p", h, "t", "q", "f", "n", None], ["p", "t", "f", "n", "alive", None])).collect()]
    assert got == [(h, 0, 2, True), ("n", 0, 6, True), ("p", 1, 1, True), ("f", None, None, None), ("t", None, None, None)]


def test_empty_tables(spark):
    for jobs, broken in (([], ["x"]), ([(1, "ok", "x", "", 1)], [])):
        got = V.fewest_jobs(*frames(spark, jobs, broken, broken)).collect()
        assert [tuple(r) for r in got] == [(k, None, None, None) for k in broken]


def test_fewest_jobs_match_brute_force(spark):
    rng = random.Random(5)
    jobs, broken, wanted, want = [], [], [], {}
    for g in range(12):  # independent small graphs, one call
        keys = [f"g{g}k{i}" for i in range(6)]
        own = [(100 * g + j, ",".join(rng.sample(keys, rng.randint(0, 2)) + ["ok"]), ",".join(rng.sample(keys, rng.randint(1, 2))), "", 1) for j in range(9)]
        goals = rng.sample(keys, 2)

        def have(some):
            got, grown = set(), True
            while grown:
                more = {k for j in some if set(j[1].split(",")) - {"ok"} <= got for k in j[2].split(",")} - got
                grown, got = bool(more), got | more
            return got
        able = [k for k in goals if k in have(own)]
        want[g] = next(n for n in range(10) for some in itertools.combinations(own, n) if set(able) <= have(some))
        jobs, broken, wanted = jobs + own, broken + keys, wanted + goals
    got = V.fewest_jobs(*frames(spark, jobs, broken, wanted)).collect()
    count = {g: len({r.job for r in got if r.job is not None and r.job // 100 == g}) for g in want}
    assert count == want and len(set(want.values())) > 2
    assert all(r.fewest for r in got if r.job is not None)
