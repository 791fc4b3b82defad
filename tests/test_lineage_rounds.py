import random

import pytest

from strandline.operators import jobs as J


@pytest.mark.parametrize("direction", ["up", "down"])
def test_rounds_write_only_what_is_new(spark, monkeypatch, direction):
    def rewritten(*_):
        raise AssertionError("a round's tables are written again whole")
    monkeypatch.setattr(J, "cut", rewritten)
    rnd = random.Random(11)
    rows = [(i, f"{max(i - rnd.choice([1, 1, 3]), 0):032x}" if i % 7 else None, f"{i if i % 5 else i - 1:032x}", f"K={rnd.randint(0, 12):032x}" if i % 6 == 0 else "K=0") for i in range(1, 13)]
    jobs = spark.createDataFrame(rows, "id long, inputkey string, outputkey string, knobs string")
    start = [12] if direction == "up" else [1]
    depth, level = dict.fromkeys(start, 0), set(start)
    while level:
        reached = set()
        for a in rows:
            for b in rows:
                if direction == "up":
                    hit = a[0] in level and a[1] == b[2] and a[1] is not None and b[0] < a[0]
                else:
                    hit = a[0] in level and (a[2] == b[1] or a[2] == b[3][2:])
                if hit and b[0] not in depth:
                    reached.add(b[0])
        depth.update({i: max(depth.values()) + 1 for i in reached})
        level = reached
    got = J.lineage(jobs, spark.createDataFrame([(i,) for i in start], "id long"), direction).collect()
    assert sorted((r.id, r.depth) for r in got) == sorted(depth.items())
