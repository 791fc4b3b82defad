"""Job tables: utilisation, statistics, lineage, reuse, recovery, concurrency."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..scale import BROADCAST_ROWS, running_sum, running_sums
from ..session import cut, stored

HOUR = 3600


def _start(col="starttime") -> Column:
    return F.unix_timestamp(col)


def node_seconds_hourly(jobs: DataFrame) -> DataFrame:
    """Node-seconds per clock hour: each job's nodes spread over the hours it overlaps.

    `jobs` has starttime, elapsed_s and nodes.
    """
    j = jobs.where("starttime is not null and elapsed_s > 0 and nodes > 0").select(
        _start().alias("_s"), (_start() + F.col("elapsed_s")).alias("_e"), "nodes")
    h = j.withColumn("_h", F.explode(F.sequence(F.floor(F.col("_s") / HOUR), F.floor((F.col("_e") - 1) / HOUR))))
    used = F.least("_e", (F.col("_h") + 1) * HOUR) - F.greatest("_s", F.col("_h") * HOUR)
    return h.groupBy(F.timestamp_seconds(F.col("_h") * HOUR).alias("hour")).agg(F.sum(used * F.col("nodes")).alias("node_seconds"))


def usage_summary(jobs: DataFrame) -> DataFrame:
    """First start, last finish, the seconds between, and total node-seconds."""
    j = jobs.where("starttime is not null and elapsed_s is not null")
    first, last = F.min(_start()), F.max(_start() + F.col("elapsed_s"))
    return j.agg(F.timestamp_seconds(first).alias("first_start"), F.timestamp_seconds(last).alias("last_finish"),
                 (last - first).alias("seconds"), F.sum(F.when(F.col("nodes") > 0, F.col("nodes") * F.col("elapsed_s"))).alias("node_seconds"))


def _log_fields(log: DataFrame) -> DataFrame:
    line = F.col("line")
    outcome = r"^\S+ \d+ \d+ \d+ (success|failure) in (\d+) seconds"
    kind = F.regexp_extract(line, outcome, 1)
    secs = F.regexp_extract(line, outcome, 2).try_cast("long")
    slots = F.regexp_extract(line, r"^\S+ \d+ \d+  node \S+ - (\d+) slots", 1).try_cast("long")
    stamp = F.try_to_timestamp(F.replace(F.regexp_extract(line, r"^(\S+) ", 1), F.lit("_"), F.lit(" ")))
    return log.select("job", "line_no", F.unix_timestamp(stamp).alias("t"),
                      F.when(kind == "success", secs).otherwise(0).alias("success"), F.when(kind == "failure", secs).otherwise(0).alias("failure"),
                      F.coalesce(slots, F.lit(0)).alias("slots"),
                      F.nullif(F.regexp_extract(line, r"^\S+ \d+ \d+  frozento ?key is (\S+)", 1), F.lit("")).alias("frozen"))


def job_stats(jobs: DataFrame, log: DataFrame) -> DataFrame:
    """Elapsed, node-seconds and slot-seconds of each job, split into success, failure and idle with percentages.

    `log` has job, line_no and line. Lines combine map-side per job.
    """
    sums = _log_fields(log).groupBy("job").agg(*[F.sum(c).alias(c) for c in ("slots", "success", "failure")])
    j = jobs.select("id", "elapsed_s", (F.col("elapsed_s") * F.col("nodes")).alias("node_seconds")).join(
        sums, F.col("id") == F.col("job"), "left").drop("job")
    j = j.withColumn("slot_seconds", F.col("slots") * F.col("elapsed_s")).withColumn("idle", F.col("slot_seconds") - F.col("failure") - F.col("success"))
    share = lambda c: F.when(F.col("slot_seconds") > 0, F.round(100 * F.col(c) / F.col("slot_seconds"), 2))
    return j.withColumns({f"{c}_percent": share(c) for c in ("failure", "success", "idle")})


def freeze_segments(log: DataFrame, width: int = 1 << 16) -> DataFrame:
    """State at each freeze line of a job: slot-seconds since the log began, split as in `job_stats`."""
    f = _log_fields(log)
    begin = f.groupBy("job").agg(F.min_by("t", "line_no").alias("start"))
    run = running_sums(f, "line_no", {f"_{c}": F.col(c) for c in ("slots", "success", "failure")}, ("job",), width)
    s = run.where("frozen is not null").join(begin, "job")
    elapsed = F.col("t") - F.col("start")
    return s.select("job", "line_no", "frozen", elapsed.alias("elapsed"), F.col("_slots").alias("slots"), (F.col("_slots") * elapsed).alias("slot_seconds"),
                    F.col("_success").alias("success_seconds"), F.col("_failure").alias("failure_seconds"),
                    (F.col("_slots") * elapsed - F.col("_failure") - F.col("_success")).alias("idle_seconds"))


def lineage(jobs: DataFrame, roots: DataFrame, direction: str = "up") -> DataFrame:
    """Jobs reachable from `roots` (id) with their least distance.

    `up`: the jobs that made a job's input, smaller ids only. `down`: the jobs
    that used its output as input or named it in a knob. Each round reduces the
    newest jobs to the keys they lead to and looks those up, so a key with many
    makers and many users never meets itself pairwise. Rounds end at the graph's
    depth. A round moves and writes only what is new in it: up to BROADCAST_ROWS
    rows are broadcast, the job table is read where it lies, with keys as 128-bit hashes.
    """
    if direction == "up":
        leads, found = jobs.select("id", F.col("inputkey").alias("key")), jobs.select("id", F.col("outputkey").alias("key"))
    else:
        named = F.regexp_extract_all("knobs", F.lit("([0-9a-f]{32})"), F.lit(1))
        leads, found = jobs.select("id", F.col("outputkey").alias("key")), jobs.select("id", F.explode(F.array_union(F.array("inputkey"), named)).alias("key"))
    hashed = lambda d: d.where("key is not null").select("id", F.xxhash64("key").alias("_h0"), F.xxhash64(F.lit(1), "key").alias("_h1"))
    leads, found = stored(hashed(leads), "leads"), stored(hashed(found), "found")

    def small(df, name):
        table = stored(df, name)
        n = table.count()
        return (F.broadcast(table) if n <= BROADCAST_ROWS else table), n, table

    newest, n, table = small(roots.select("id").distinct(), "newest")
    # Found jobs by round; parts no larger than twice the next are put together, so few parts hold all.
    parts, depth = [(table.withColumn("depth", F.lit(0)), n)], 0
    while n:
        depth += 1
        # The largest newest id of a key decides which makers are smaller than some user.
        keys, _, _ = small(leads.join(newest.select("id"), "id", "left_semi").groupBy("_h0", "_h1").agg(F.max("id").alias("_top")), "keys")
        step = found.join(keys, ["_h0", "_h1"])
        if direction == "up":
            step = step.where("id < _top")
        step, _, plain = small(step.select("id").distinct(), "step")
        seen = _all(parts).select("id").join(step, "id", "left_semi")
        newest, n, table = small(plain.join(seen, "id", "left_anti"), "newest")
        parts.append((table.withColumn("depth", F.lit(depth)), n))
        while len(parts) > 1 and parts[-2][1] <= 2 * parts[-1][1]:
            last = parts[-2:]
            parts[-2:] = [(stored(_all(last), "seen"), sum(m for _, m in last))]
    return _all(parts)


def _all(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    return reduce(DataFrame.unionByName, [d for d, _ in parts])


def recovery_plan(jobs: DataFrame, broken: DataFrame) -> DataFrame:
    """Jobs to run again so that the broken keys exist: (key, level, job); level NULL and last when none can make it.

    A key is made by the smallest successful job whose input exists or was made
    on an earlier level, so every key gets the shortest chain.
    """
    makers = cut(jobs.where("success = 1").join(broken.select(F.col("key").alias("outputkey")), "outputkey", "left_semi").select(
        F.col("outputkey").alias("key"), F.col("inputkey").alias("needs"), F.col("id").alias("job")))
    missing, plan, level = cut(broken.select("key").distinct()), None, 0
    while True:
        ready = (makers.join(missing, "key", "left_semi").join(missing.select(F.col("key").alias("needs")), "needs", "left_anti")
                 .groupBy("key").agg(F.min("job").alias("job")).withColumn("level", F.lit(level)))
        ready = cut(ready)
        if ready.isEmpty():
            break
        plan = ready if plan is None else plan.unionByName(ready)
        missing = cut(missing.join(ready, "key", "left_anti"))
        level += 1
    orphans = missing.select("key", F.lit(None).cast("long").alias("job"), F.lit(None).cast("int").alias("level"))
    return orphans if plan is None else plan.select("key", "job", "level").unionByName(orphans)


def stripped_key(col) -> Column:
    """Block locators without their hints."""
    return F.regexp_replace(col, r"\+[^,]*", "")


def spec_hash(func, inputkey, knobs) -> Column:
    return F.md5(F.concat_ws("\n", func, stripped_key(inputkey), knobs))


def reusable_job(jobs: DataFrame, specs: DataFrame) -> DataFrame:
    """For each spec (spec, func, inputkey, knobs, min_rev, max_rev) the latest successful job like it, else the latest running one."""
    done = F.coalesce("success", F.lit(0)).alias("done")
    # Equal jobs reduce to the best of each revision before they meet the specs.
    j = (jobs.where("success = 1 or success is null").groupBy(spec_hash("func", F.col("inputkey"), "knobs").alias("_h"), "revision")
         .agg(F.max(F.struct(done, "id", "outputkey")).alias("_j")))
    s = specs.withColumn("_h", spec_hash("func", F.col("inputkey"), "knobs"))
    fit = s.join(j, "_h").where("revision between min_rev and max_rev")
    best = fit.groupBy("spec").agg(F.max("_j").alias("_b"))
    return best.select("spec", F.col("_b.id").alias("job"), F.col("_b.done").alias("done"), F.col("_b.outputkey").alias("outputkey"))


def job_search(jobs: DataFrame, columns: list[str] | None = None, **fields) -> DataFrame:
    """Jobs whose fields equal the given values."""
    out = jobs
    for name, value in fields.items():
        out = out.where(F.col(name) == value)
    return out.select(*(columns or jobs.columns))


def job_layout(jobs: DataFrame, width: float = 1000, height: float = 100) -> DataFrame:
    """Rectangles time x nodes scaled to the given size; `jobs` has each job's `bottom`."""
    s = _start()
    e = s + F.col("elapsed_s")
    low = jobs.agg(F.min(s).alias("v")).scalar()
    high = jobs.agg(F.max(e).alias("v")).scalar()
    top = jobs.agg(F.max(F.col("bottom") + F.col("nodes")).alias("v")).scalar()
    x = lambda t: F.round(width * (t - low) / (high - low), 4)
    y = lambda n: F.round(height * n / top, 4)
    return jobs.select("id", x(s).alias("x0"), x(e).alias("x1"), y(F.col("bottom")).alias("y0"), y(F.col("bottom") + F.col("nodes")).alias("y1"))


def concurrency(jobs: DataFrame, width: int = 30 * 24 * HOUR) -> DataFrame:
    """Nodes in use from each moment something starts or finishes; a job counts while start <= t < finish."""
    s = _start()
    edges = jobs.select(F.explode(F.array(F.struct(s.alias("t"), F.col("nodes").cast("long").alias("d")),
                                          F.struct((s + F.col("elapsed_s")).alias("t"), (-F.col("nodes")).cast("long").alias("d")))).alias("e"))
    moments = edges.groupBy("e.t").agg(F.sum("e.d").alias("d"))
    return running_sum(moments, "t", F.col("d"), "nodes_in_use", width).select(F.timestamp_seconds("t").alias("t"), "nodes_in_use")


def max_concurrency(jobs: DataFrame) -> DataFrame:
    c = concurrency(jobs)
    return c.agg(F.max("nodes_in_use").alias("nodes_in_use"), F.min_by("t", F.struct(-F.col("nodes_in_use"), "t")).alias("first_at"))


def job_outputs(jobs: DataFrame) -> DataFrame:
    """Output keys of the successful jobs."""
    return jobs.where("success = 1").select("id", "outputkey")


def outputs_for_prefix(outputs: DataFrame, pattern: str, stream: str = "stream") -> DataFrame:
    """Output streams whose name matches."""
    return outputs.where(F.col(stream).rlike(pattern))
