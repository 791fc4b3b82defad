"""Building blocks that keep a hot key, position or file from landing in one task.

A window over a key puts every row of that key in one task. The helpers below
give the same values from partial aggregates, or from windows whose partitions
are bounded by a slice of a unique integer order column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .session import stored

# A lookup table of at most so many (narrow) rows is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 1 << 20
# Order values per slice. Suits row numbers; sparser order columns want a proportionally larger width.
SLICE = 1 << 20


def _cols(names):
    return [F.col(n) if isinstance(n, str) else n for n in names]


def settle(df: DataFrame, *names: str) -> DataFrame:
    """Compute the named columns here, once per row.

    A later filter on a derived column is otherwise pushed below it with the
    whole expression copied in, per use. Filters do not move past a generator.
    """
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, F.inline(F.array(F.struct(*names))))


# Slices are gathered by FAN into nodes, these again, and so on: enough levels for any 64-bit order.
FAN = 4096
LEVELS = 4


def _before(totals: DataFrame, keys: list[str]) -> DataFrame:
    """`_base`: the total `_t` of all earlier slices of (keys, `_slice`), where there is any.

    That is, on every level, the total of the nodes before the slice's own one
    under the same parent. However sparse the order is, no window holds more
    than FAN nodes.
    """
    nodes = F.inline(F.array(*[F.struct(F.lit(i).alias("_level"), F.floor(F.col("_slice") / FAN ** i).alias("_node")) for i in range(LEVELS + 1)]))
    parent = F.when(F.col("_level") < LEVELS, F.floor(F.col("_node") / FAN)).otherwise(F.lit(0))
    earlier = W.partitionBy(*keys, "_level", parent).orderBy("_node").rowsBetween(W.unboundedPreceding, -1)
    sums = totals.select(*keys, "_t", nodes).groupBy(*keys, "_level", "_node").agg(F.sum("_t").alias("_t"))
    shift = sums.withColumn("_earlier", F.sum("_t").over(earlier)).where("_earlier <> 0").drop("_t")
    return (totals.select(*keys, "_slice", nodes).join(shift, [*keys, "_level", "_node"])
            .groupBy(*keys, "_slice").agg(F.sum("_earlier").alias("_base")))


def running_sum(df: DataFrame, order: str, value: Column, out: str, width: int = SLICE,
                keys: tuple[str, ...] = ()) -> DataFrame:
    """Inclusive running total of `value` along the integer column `order`.

    Rows are cut into slices of `width` order values. Totals run inside each
    slice; the slices' own totals (one row per slice) are accumulated apart, in
    groups, and added back, so no task sees more than one slice of rows.
    """
    keys = list(keys)
    # One shuffle by slice serves the window, the totals and the join back.
    sliced = (df.withColumn("_slice", F.floor(F.col(order) / width)).withColumn("_v", value)
              .repartition(*keys, "_slice"))
    inside = W.partitionBy(*keys, "_slice").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    base = _before(sliced.groupBy(*keys, "_slice").agg(F.sum("_v").alias("_t")), keys)
    return (sliced.withColumn("_in", F.sum("_v").over(inside))
            .join(base, keys + ["_slice"], "left")
            .withColumn(out, F.col("_in") + F.coalesce("_base", F.lit(0)))
            .drop("_slice", "_v", "_in", "_base"))


def running_sums(df: DataFrame, order: str, values: dict[str, Column], keys: tuple[str, ...], width: int = SLICE, whole: int = 1 << 16,
                 counted: bool = False) -> DataFrame:
    """Inclusive running totals of several values along the integer column `order`, per key, with one shuffle of the rows.

    A key of up to `whole` rows is one slice. Only larger keys are cut into
    slices of `width` order values, as in `running_sum`. Where the order counts
    a key's rows from 0 (`counted`; some may be missing), it tells the larger keys without a count.
    """
    keys = list(keys)
    same = lambda d, e: [d[k].eqNullSafe(e[f"_{k}"]) for k in keys]
    count = df.where(F.col(order) >= whole).groupBy(*keys).agg(F.max(order).alias("_c")) if counted else df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    large = count.where(F.col("_c") >= whole + (not counted)).select(*[F.col(k).alias(f"_{k}") for k in keys], F.lit(True).alias("_large"))
    large, _ = lookup(large, "large-keys")
    cut = F.when(F.col("_large"), F.floor(F.col(order) / width))
    some = not large.isEmpty()
    joined = df.join(large, same(df, large), "left").drop(*[f"_{k}" for k in keys])
    # A struct joins by equality also where a key is NULL.
    by = ["_k"] if some else keys
    sliced = (joined.withColumn("_slice", F.coalesce(cut, F.lit(0).cast("long"))).withColumns({f"_v_{out}": v for out, v in values.items()})
              .withColumns({"_k": F.struct(*keys)} if some else {}).repartition(*by, "_slice"))
    inside = W.partitionBy(*by, "_slice").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    out = sliced.withColumns({n: F.sum(f"_v_{n}").over(inside) for n in values})
    if some:
        totals = sliced.where("_large").groupBy("_k", "_slice")
        for n in values:
            base = _before(totals.agg(F.sum(f"_v_{n}").alias("_t")), by)
            out = out.join(base, ["_k", "_slice"], "left").withColumn(n, F.col(n) + F.coalesce("_base", F.lit(0))).drop("_base")
    return out.drop("_slice", "_large", "_k", *[f"_v_{n}" for n in values])


def rank_in_group(df: DataFrame, keys: list[str], order: str, out: str = "rn",
                  ties: tuple[str, ...] = (), width: int = SLICE) -> DataFrame:
    """1-based row number within `keys` along the integer column `order`.

    Numbers rows per (key, slice of `order`) and shifts each slice by the rows
    of the same key in earlier slices. Keys living in one slice need no shift
    and are left out of the join side.
    """
    # One shuffle by (key, slice) serves the window, the counts and the join back.
    sliced = df.withColumn("_slice", F.floor(F.col(order) / width)).repartition(*keys, "_slice")
    inside = W.partitionBy(*keys, "_slice").orderBy(order, *ties)
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    shift = (sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_c"))
             .withColumn("_shift", F.sum("_c").over(before))
             .where("_shift is not null").drop("_c"))
    return (sliced.withColumn("_r", F.row_number().over(inside))
            .join(shift, keys + ["_slice"], "left")
            .withColumn(out, F.col("_r") + F.coalesce("_shift", F.lit(0)))
            .drop("_slice", "_r", "_shift"))


def carry_last(df: DataFrame, keys: list[str], order: str, value: str, out: str, fan: int = FAN) -> DataFrame:
    """`out`: the last `value` that is not NULL in earlier rows of `keys` along the integer column `order`.

    Rows look back inside slices of `fan` order values; each slice is reduced to its last value, and slices look back
    over slices. Neither window holds more than `fan` rows while the order stays below `fan` squared.
    """
    before = lambda *by: W.partitionBy(*keys, *by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)
    sliced = df.withColumn("_slice", F.floor(F.col(order) / fan))
    latest = F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order)))
    base = (sliced.groupBy(*keys, "_slice").agg(latest.alias("_t"))
            .select(*keys, "_slice", F.last("_t", True).over(before("_slice")).alias("_base")))
    return (sliced.withColumn("_in", F.last(value, True).over(before("_slice", order))).join(base, [*keys, "_slice"])
            .withColumn(out, F.coalesce("_in", "_base")).drop("_slice", "_in", "_base"))


def lookup(df: DataFrame, name: str) -> tuple[DataFrame, bool]:
    """The table written once, marked for broadcast if it was counted small, and whether it was.

    Joining a wide side with an aggregate of unknown size would move the wide
    side before anything is known; a written table's rows are counted from its footers.
    """
    table = stored(df, name)
    small = table.count() <= BROADCAST_ROWS
    return (F.broadcast(table) if small else table), small


def first_row(df: DataFrame, keys: list[str], order, last: bool = False) -> DataFrame:
    """One row per key: the one with the smallest (or largest) `order`.

    `min_by`/`max_by` on a struct of the remaining columns combine map-side.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    by = F.struct(*_cols(order)) if isinstance(order, (list, tuple)) else F.col(order)
    return (df.groupBy(*keys).agg(pick(F.struct(*[F.col(f"`{c}`") for c in rest]), by).alias("_row"))
            .select(*keys, "_row.*"))
