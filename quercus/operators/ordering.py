"""Order-dependent operators that stay distributed.

A window over one group runs in one task. Every function here first asks how large the largest
group is; groups above ``hot_rows`` go through a range-partitioned sort whose partitions are
numbered by offsets, so a group that holds a third of the table is still spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quercus.session import settle

HOT_ROWS = 5_000_000

#: Hot groups that are told apart by a broadcast of their keys; where there are more, all rows are sorted by range.
HOT_KEYS = 10_000

#: Rows of one task where each is about to become several and to be held in hash tables.
TASK_ROWS = 200_000


def _sort(key) -> Column:
    return F.col(key) if isinstance(key, str) else key


def as_scalar(one_row: DataFrame) -> Column:
    """A one-row table as a struct column: one scalar subquery, however many fields are read."""
    return one_row.select(F.struct(*one_row.columns)).scalar()


def by_key(df: DataFrame, key: str, least: int = 1) -> DataFrame:
    """Rows spread by a unique key over spark.sql.shuffle.partitions tasks, or over ``least`` if these are more.

    The number is given, so that small rows which are about to grow are not packed into few tasks.
    """
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), least), key)


def by_group(df: DataFrame, keys: Sequence[str], rows: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """Rows dealt by their group over as many tasks as leave each about ``task_rows`` of the ``rows``.

    What is grouped by the same keys afterwards stays where it is, so the memory of its tasks does not grow with the table.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // task_rows)), *keys)


def hot_groups(df: DataFrame, keys: Sequence[str], hot_rows: int) -> DataFrame:
    """Keys of the groups above ``hot_rows``; at most total/hot_rows of them."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows).drop("_n")


def _sorted_slices(df: DataFrame, sort_keys: list[Column]) -> DataFrame:
    """Range-partitioned, sorted rows with ``_slice`` (partition) and ``_local`` (place in it).

    The rows are written once: slice borders come from a sample, so the passes that follow must all
    see the same borders.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    ranged = df.repartitionByRange(n, *sort_keys).sortWithinPartitions(*sort_keys)
    # monotonically_increasing_id keeps the row's place inside its partition in the low 33 bits
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return settle(ranged.withColumns({"_slice": F.spark_partition_id(), "_local": place}), "slices")


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence,
    weight: Column | None = None,
    name: str = "running",
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Sum of ``weight`` (1 by default: the row number) up to each row inside its group.

    ``order`` must be unique inside a group. Small groups use an ordinary window; hot groups use
    sorted slices plus the totals of the slices before, which is one row per (group, slice).
    ``hot_rows=None`` leaves the size question out; it is for groups with a known bound.
    """
    keys = list(keys)
    order = [_sort(o) for o in order]
    weight = F.lit(1) if weight is None else weight
    weight = weight.cast("bigint")
    plain = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)

    hot = None if hot_rows is None else hot_groups(df, keys, hot_rows)
    found = [] if hot is None else hot.limit(HOT_KEYS + 1).collect()
    if not found:
        return df.withColumn(name, F.sum(weight).over(plain))
    if len(found) > HOT_KEYS:
        return _running_in_slices(df, keys, order, weight, name)

    hot = df.sparkSession.createDataFrame(found, hot.schema)
    same = reduce(lambda a, b: a & b, [F.col(f"_l.{k}").eqNullSafe(F.col(f"_h.{k}")) for k in keys])
    small = df.alias("_l").join(F.broadcast(hot).alias("_h"), same, "left_anti")
    large = df.alias("_l").join(F.broadcast(hot).alias("_h"), same, "left_semi")
    counted = _running_in_slices(large, keys, order, weight, name)
    return small.withColumn(name, F.sum(weight).over(plain)).select(counted.columns).unionByName(counted)


def _running_in_slices(df: DataFrame, keys: list[str], order: list[Column], weight: Column, name: str) -> DataFrame:
    """The sum up to each row for groups of any size. A group that goes on over a border is the last of one slice
    and the first of the next, so only these two groups of a slice are added up beforehand."""
    sliced = _sorted_slices(df, [F.col(k) for k in keys] + order)
    group = F.struct(*keys)
    ends = sliced.groupBy("_slice").agg(F.min_by(group, "_local").alias("_first"), F.max_by(group, "_local").alias("_last"))
    at_end = sliced.join(F.broadcast(ends), "_slice").filter(group.eqNullSafe(F.col("_first")) | group.eqNullSafe(F.col("_last")))
    per_slice = at_end.groupBy("_slice", *keys).agg(F.sum(weight).alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select("_slice", *keys, F.sum("_total").over(before).alias("_offset")).filter(F.col("_offset").isNotNull())
    inner = Window.partitionBy("_slice", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = sliced.withColumn("_inner", F.sum(weight).over(inner))
    match = reduce(
        lambda a, b: a & b,
        [F.col(f"_s.{k}").eqNullSafe(F.col(f"_o.{k}")) for k in ["_slice", *keys]],
    )
    running = F.col("_inner") + F.coalesce(F.col("_offset"), F.lit(0))
    return (
        placed.alias("_s")
        .join(F.broadcast(offsets).alias("_o"), match, "left")
        .select(*[F.col(f"_s.{c}") for c in df.columns], running.alias(name))
    )


def rank_within(
    df: DataFrame, keys: Sequence[str], order: Sequence, name: str = "rank", hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Row number (from 1) inside each group, in an order that is unique inside the group."""
    return running_total(df, keys, order, None, name, hot_rows)


def global_position(df: DataFrame, order: Sequence, name: str = "position") -> DataFrame:
    """Row number (from 0) over the whole table without a single-task sort."""
    sliced = _sorted_slices(df, [_sort(o) for o in order])
    sizes = sliced.groupBy("_slice").agg(F.count(F.lit(1)).alias("_total"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    offsets = sizes.select("_slice", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    return (
        sliced.join(F.broadcast(offsets), "_slice")
        .withColumn(name, F.col("_local") + F.col("_offset"))
        .drop("_slice", "_local", "_offset")
    )


def value_frequencies(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per (group, distinct value) with its count; nulls are left out."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def quantiles_by(
    frequencies: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Exact quantiles with linear interpolation, per group of a table of frequencies.

    The quantile at p lies between the values at places floor and ceil of p*(n-1). Only distinct
    values are ordered, and a hot group is ordered in slices.
    """
    by = list(keys) or ["_all"]
    base = frequencies if keys else frequencies.withColumn("_all", F.lit(1))
    running = running_total(base, by, [value], F.col("n"), "_upto", hot_rows)
    if keys:
        placed = running.join(base.groupBy(*by).agg(F.sum("n").alias("_n")), by)
    else:
        placed = running.withColumn("_n", as_scalar(base.agg(F.sum("n").alias("_n")))["_n"])
    parts = []
    for name, p in probs.items():
        place = F.lit(float(p)) * (F.col("_n") - 1)
        for edge, at in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            parts.append(F.min(F.when(F.col("_upto") > at, F.col(value))).cast("double").alias(f"_{edge}_{name}"))
    picked = placed.groupBy(*by, "_n").agg(*parts)
    outputs = []
    for name, p in probs.items():
        place = F.lit(float(p)) * (F.col("_n") - 1)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        outputs.append((low + (high - low) * (place - F.floor(place))).alias(name))
    return picked.select(*keys, *outputs)
