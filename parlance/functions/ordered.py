"""Order-dependent columns per key that stay bounded when one key holds much of the data.

A window over ``partitionBy(key)`` puts a whole key into one task. So the rows per key are counted
first (a map-side combined count over the key column alone). Mostly no key has more than
``max_rows`` rows, and plain windows follow. Otherwise the rows of such keys are range-partitioned
by key and order, every run of ``max_rows`` rows of a range is a slot, and the rows are written once with their slot number.
Windows then run per (key, slot), and a small table with one row per key and slot carries the state
from slot to slot.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import work_dir

MAX_ROWS = 2_000_000
MAX_SHIPPED = 100_000
MAX_RANGES = 200
SLOT = "_slot"


@dataclass(frozen=True)
class Keyed:
    """Rows with the keys that windows may partition by. ``split`` says that some key has slots;
    then ``df`` has ``_slot``: -1 for an ordinary key, else a number that grows with the order."""

    df: DataFrame
    keys: list[str]
    split: bool = False

    @property
    def parts(self) -> list[str]:
        return [*self.keys, SLOT] if self.split else self.keys

    def window(self, *order: str | Column):
        return W.partitionBy(*self.parts).orderBy(*order)

    def rows(self) -> DataFrame:
        return self.df.drop(SLOT)

    def select(self, df: DataFrame) -> Keyed:
        """The same keys over changed rows."""
        return replace(self, df=df)


def keyed(df: DataFrame, keys: list[str], order: list[str], max_rows: int = MAX_ROWS) -> Keyed:
    """Finds the keys with more than ``max_rows`` rows (this runs a job) and cuts them into slots."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_rows)
    # Bounded: no more than total rows / max_rows keys can pass the filter.
    found = counts.collect()
    if not found:
        return Keyed(df, keys)
    spark = df.sparkSession
    hot = spark.createDataFrame(found, counts.schema).drop("_n")
    # Shipped while there are few; beyond that the planner shuffles both sides.
    hot = F.broadcast(hot) if len(found) <= MAX_SHIPPED else hot
    rows = sum(r["_n"] for r in found)
    # Ranges follow the data, so they are even whatever the keys and times look like. A sorted range is cut by row number, so
    # short slots do not need a task each.
    ranges = min(-(-rows // max_rows), max(MAX_RANGES, -(-rows // MAX_ROWS)))
    ranged = (joined(df, hot, keys, "left_semi").repartitionByRange(ranges, *keys, *order).sortWithinPartitions(*keys, *order)
              .withColumn(SLOT, F.monotonically_increasing_id())  # the range's number above the row's number in it
              .withColumn(SLOT, F.col(SLOT) - _row_in_range() + F.floor(_row_in_range() / max_rows)))
    rest = joined(df, hot, keys, "left_anti").withColumn(SLOT, F.lit(-1).cast("long"))
    # Written once: the slot numbers are settled by that, whatever is run again later.
    path = work_dir(spark, "slots")
    ranged.unionByName(rest).write.parquet(path)
    return Keyed(spark.read.parquet(path), keys, True)


def _row_in_range() -> Column:
    return F.pmod(F.col(SLOT), F.lit(1 << 33))


def joined(df: DataFrame, other: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join on keys that may be null; null equals null."""
    renamed = other.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return df.join(renamed, on, how).drop(*[f"_of_{k}" for k in keys])


def with_history(rows: Keyed, order: list[str], n: int, item: Column, name: str) -> Keyed:
    """Adds the array of ``item`` over the up to ``n`` rows before this one, oldest first."""
    boxed = F.struct(item.alias("v"))
    if n == 1:
        local = F.array_compact(F.array(F.lag(boxed).over(rows.window(*order))))
    else:
        local = F.collect_list(boxed).over(rows.window(*order).rowsBetween(-n, -1))

    def unboxed(items: Column) -> Column:
        return F.transform(items, lambda x: x["v"])

    if not rows.split:
        return rows.select(rows.df.withColumn(name, unboxed(local)))

    newest = rows.window(*[F.col(c).desc() for c in order])
    tails = (
        rows.df.filter(F.col(SLOT) >= 0)
        .select(*rows.parts, F.row_number().over(newest).alias("_r"), boxed.alias("_item"))
        .filter(F.col("_r") <= n)
        .groupBy(*rows.parts)
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("_r")).alias("r"), F.col("_item").alias("i")))).alias("_tail"))
    )
    before = W.partitionBy(*rows.keys).orderBy(SLOT).rowsBetween(-n, -1)
    carry = tails.select(*rows.parts, F.flatten(F.collect_list(F.col("_tail.i")).over(before)).alias("_carry"))
    carried = joined(rows.df.withColumn("_local", local), carry, rows.parts, "left")
    history = F.when(F.col("_carry").isNull(), F.col("_local")).otherwise(F.concat("_carry", "_local"))
    recent = F.slice(history, F.greatest(F.size(history) - n, F.lit(0)) + 1, F.lit(n))
    return rows.select(carried.withColumn(name, unboxed(recent)).drop("_local", "_carry"))


def with_running(rows: Keyed, order: list[str], values: dict[str, tuple[str, Column]]) -> Keyed:
    """Adds running aggregates up to and including this row: ``{name: ("sum" | "max", value)}``.

    A running row number is the running sum of 1.
    """
    merge = {"sum": F.sum, "max": F.max}
    window = rows.window(*order).rowsBetween(W.unboundedPreceding, 0)
    local = {name: merge[how](value).over(window) for name, (how, value) in values.items()}
    if not rows.split:
        return rows.select(rows.df.withColumns(local))

    totals = rows.df.filter(F.col(SLOT) >= 0).groupBy(*rows.parts).agg(
        *[merge[how](value).alias(name) for name, (how, value) in values.items()])
    before = W.partitionBy(*rows.keys).orderBy(SLOT).rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(*rows.parts, *[
        merge[how](name).over(before).alias(f"_carry_{name}") for name, (how, _) in values.items()])
    carried = joined(rows.df.withColumns(local), carry, rows.parts, "left")
    merged = {
        name: (F.coalesce(name, F.lit(0)) + F.coalesce(f"_carry_{name}", F.lit(0)) if how == "sum"
               else F.greatest(name, f"_carry_{name}"))
        for name, (how, _) in values.items()}
    return rows.select(carried.withColumns(merged).drop(*[f"_carry_{name}" for name in values]))
