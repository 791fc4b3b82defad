"""The fewest jobs to run again so that lost keys exist: an AND/OR graph of jobs (all needs) and keys (any maker)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut
from .jobs import stripped_key

# A component is searched if the makers of its keys combine in at most 2^SEARCH_BITS ways and it has at most SEARCH_ROWS edges.
SEARCH_BITS = 16
SEARCH_ROWS = 10_000


def _keys(col) -> Column:
    return F.filter(F.split(stripped_key(F.coalesce(col, F.lit(""))), ","), lambda k: k != "")


def _edges(jobs: DataFrame, broken: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(job, key) of successful jobs and the broken keys they make; (job, key) and the broken keys these need."""
    ran = jobs.where("success = 1")
    lost = broken.select("key").where("key is not null").distinct()
    named = F.regexp_extract_all(F.coalesce("knobs", F.lit("")), F.lit(r"\b([0-9a-f]{32})\b"), F.lit(1)) if "knobs" in jobs.columns else F.array().cast("array<string>")
    each = lambda keys: ran.select(F.col("id").alias("job"), F.explode(F.array_distinct(keys)).alias("key"))
    makes = cut(each(_keys(F.col("outputkey"))).join(lost, "key", "left_semi").select("job", "key"))
    needs = each(F.concat(_keys(F.col("inputkey")), named)).join(lost, "key", "left_semi").select("job", "key")
    return makes, cut(needs.join(makes.select("job").distinct(), "job", "left_semi"))


def _costs(makes: DataFrame, needs: DataFrame) -> DataFrame:
    """(key, cost, job): each makeable key's least cost and the job that gives it; a job costs one and what its needs cost.

    Jobs shared by several needs count for each, so this is a bound from above. Rounds end with the longest chain.
    """
    jobs = makes.select("job").distinct()
    known = None
    while True:
        if known is None:
            cost = jobs.join(needs, "job", "left_anti").select("job", F.lit(1.0).alias("cost"))
        else:
            cost = (jobs.join(needs, "job", "left").join(known.select("key", "cost"), "key", "left").groupBy("job")
                    .agg(F.sum("cost").alias("cost"), F.count_if(F.col("key").isNotNull() & F.col("cost").isNull()).alias("_open"))
                    .where("_open = 0").select("job", (F.coalesce("cost", F.lit(0.0)) + 1).alias("cost")))
        best = (cost.join(makes, "job").groupBy("key").agg(F.min(F.struct("cost", "job")).alias("_b"))
                .select("key", F.col("_b.cost").alias("cost"), F.col("_b.job").alias("job")))
        best = cut(best)
        if best.isEmpty() or (known is not None and best.exceptAll(known).isEmpty()):
            return best
        known = best


def _reached(keys: DataFrame, makes: DataFrame, needs: DataFrame) -> DataFrame:
    """(key, job): the makers behind `keys`, the makers of what these need, and so on."""
    seen, newest = None, cut(keys)
    while not newest.isEmpty():
        seen = newest if seen is None else cut(seen.unionByName(newest))
        step = makes.join(newest, "key", "left_semi").select("job").distinct()
        newest = cut(needs.join(step, "job", "left_semi").select("key").distinct().join(seen, "key", "left_anti"))
    return makes.limit(0) if seen is None else cut(makes.join(seen, "key", "left_semi").select("job", "key"))


def _labelled(edges: DataFrame) -> DataFrame:
    """(key, label): the least key of its component, where `edges` (job, key) join keys."""
    labels = cut(edges.select("key", F.col("key").alias("label")).distinct())
    while True:
        hub = edges.join(labels, "key").groupBy("job").agg(F.min("label").alias("label"))
        after = cut(edges.join(hub, "job").groupBy("key").agg(F.min("label").alias("label")))
        if after.exceptAll(labels).isEmpty():
            return after
        labels = after


def _closure(jobs, makes, needs) -> dict:
    """Keys that `jobs` make from nothing, each with the first of them that can; needs come before what is made of them."""
    made, left = {}, set(jobs)
    while ready := sorted(j for j in left if needs.get(j, set()) <= made.keys()):
        left.difference_update(ready)
        for j in ready:
            for key in makes[j]:
                made.setdefault(key, j)
    return made


def _search(rows: pd.DataFrame) -> pd.DataFrame:
    """One component: the assignment of makers to needed keys with the fewest jobs; ties go to the first in order of keys and ids."""
    makes, needs, makers, wanted = {}, {}, {}, set()
    for kind, job, key in sorted(zip(rows["kind"], rows["job"], rows["key"])):
        if kind == 0:
            wanted.add(key)
        elif kind == 1:
            makes.setdefault(job, set()).add(key)
            makers.setdefault(key, []).append(job)
        else:
            needs.setdefault(job, set()).add(key)
    best: dict = {}
    fewest = len(makes) + 1

    def follow(chosen: dict, todo: set) -> None:
        nonlocal best, fewest
        chosen, todo = dict(chosen), set(todo)
        ambiguous = set()
        while todo:  # keys with one maker need no branch, so chains of any length need no recursion
            key = todo.pop()
            if key in chosen:
                continue
            if len(makers[key]) > 1:
                ambiguous.add(key)
                continue
            chosen[key] = makers[key][0]
            todo |= needs.get(chosen[key], set())
        used = set(chosen.values())
        if len(used) >= fewest:
            return
        if not ambiguous:
            # Makers chosen key by key may wait for each other; the order in which they can run gives each key its maker.
            order = _closure(used, makes, needs)
            if wanted <= order.keys():
                best, todo = {}, set(wanted)
                while todo:
                    key = todo.pop()
                    best[key] = order[key]
                    todo |= needs.get(order[key], set()) - best.keys()
                fewest = len(set(best.values()))
            return
        key = min(ambiguous)
        for job in sorted(makers[key], key=lambda j: (j not in used, j)):
            follow(chosen | {key: job}, (ambiguous - {key}) | needs.get(job, set()))

    follow({}, wanted)
    return pd.DataFrame({"key": list(best), "job": list(best.values())}, columns=["key", "job"])


def fewest_jobs(jobs: DataFrame, broken: DataFrame, wanted: DataFrame | None = None, bits: int = SEARCH_BITS, most_rows: int = SEARCH_ROWS) -> DataFrame:
    """Jobs to run again so that the `wanted` keys exist: (key, level, job, fewest), keys that none can make last, with NULLs.

    `jobs` has id, inputkey, outputkey, success and may have knobs. Keys are joined by commas, hints of block locators
    do not count; 32 hex digits in knobs are inputs too. `broken` holds the keys that do not exist, `wanted` those to be
    had again (all broken ones, if not given; others exist already and are left out). A job runs once however many of
    its keys are used. Level 0 needs no other job; each key is named with the job that makes it.

    Finding the fewest is a covering problem. Costs are propagated over the whole graph; then the part behind the wanted
    keys falls into components, each of which is searched as a whole if its makers combine in at most 2^`bits` ways
    and it has at most `most_rows` edges (`fewest` true). A larger component takes each key's cheapest maker by cost, which counts
    shared jobs more than once (`fewest` false), and stays distributed.
    """
    makes, needs = _edges(jobs, broken)
    want = wanted if wanted is None else wanted.join(broken.select("key").distinct(), "key", "left_semi")
    want = cut((broken if want is None else want).select("key").where("key is not null").distinct())
    cost = _costs(makes, needs)
    # Jobs that can run at all: none of their needs is beyond making.
    never = needs.join(cost, "key", "left_anti").select("job").distinct()
    makes, needs = cut(makes.join(never, "job", "left_anti")), cut(needs.join(never, "job", "left_anti"))
    goals = want.join(cost, "key", "left_semi")
    made = _reached(goals, makes, needs)
    used = cut(needs.join(made.select("job").distinct(), "job", "left_semi"))
    label = _labelled(made.unionByName(used))

    # A hot component is counted from partial sums, never gathered.
    ways = made.groupBy("key").agg(F.log2(F.count(F.lit(1))).alias("_bits"), F.count(F.lit(1)).alias("_n"))
    size = (label.join(ways, "key").join(used.groupBy("key").agg(F.count(F.lit(1)).alias("_u")), "key", "left")
            .groupBy("label").agg(F.sum("_bits").alias("_bits"), F.sum(F.col("_n") + F.coalesce("_u", F.lit(0))).alias("_n")))
    label = cut(label.join(size.select("label", ((F.col("_bits") <= bits) & (F.col("_n") <= most_rows)).alias("fewest")), "label"))
    kind = lambda df, k: df.select(F.lit(k).alias("kind"), F.col("job") if "job" in df.columns else F.lit(None).cast("long").alias("job"), "key")
    parts = (kind(goals.withColumn("job", F.lit(-1).cast("long")), 0).unionByName(kind(made.withColumn("job", F.col("job").cast("long")), 1))
             .unionByName(kind(used.withColumn("job", F.col("job").cast("long")), 2)).join(label.where("fewest").drop("fewest"), "key"))
    found = parts.groupBy("label").applyInPandas(_search, "key string, job long").withColumn("fewest", F.lit(True))
    big = label.where("not fewest").select("key")
    cheap = cost.join(big, "key", "left_semi").select(F.col("job").cast("long").alias("job"), "key")
    cheap = _reached(goals.join(big, "key", "left_semi"), cheap, needs).select("key", "job").withColumn("fewest", F.lit(False))
    left = cut(found.unionByName(cheap))

    plan, level = None, 0
    while True:
        waits = needs.join(left.select("key"), "key", "left_semi").select("job").distinct()
        ready = cut(left.join(waits, "job", "left_anti").withColumn("level", F.lit(level)))
        if ready.isEmpty():
            break
        plan = ready if plan is None else plan.unionByName(ready)
        left = cut(left.join(ready, "key", "left_anti"))
        level += 1
    orphans = want.join(cost, "key", "left_anti").select("key", F.lit(None).cast("int").alias("level"), F.lit(None).cast("long").alias("job"), F.lit(None).cast("boolean").alias("fewest"))
    rows = orphans if plan is None else plan.select("key", "level", "job", "fewest").unionByName(orphans)
    return rows.orderBy(F.col("level").asc_nulls_last(), "job", "key")
