"""Anchors that occur more than once, the first step of both substring operators.

Every long enough window of a text holds an anchor, the item with the least hash in it, and equal windows
hold equal anchors. So windows can only repeat around anchors that do, and the corpus-wide
bookkeeping is done for anchors: about one row for every few dozen bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import settle, staged


def repeated(found: DataFrame) -> DataFrame:
    """For rows (_key, gs) the same with only those anchors that occur in another key too.

    Counts are summed before the shuffle; where many texts share an anchor the join splits them. One
    text's anchors make one row. Keys must not be null.
    """
    found = staged(found, "anchors")
    rows = found.select("_key", F.explode("gs").alias("g"))
    again = rows.groupBy("g").agg(F.min("_key").alias("lo"), F.max("_key").alias("hi")).filter("lo < hi")
    again = staged(again.select("g"), "anchors-again")
    distinct = found.select("_key", F.explode(F.array_distinct("gs")).alias("g"))
    out = staged(distinct.join(again, "g", "left_semi").groupBy("_key").agg(F.collect_set("g").alias("gs")), "anchors-kept")
    settle(found, again)
    return out


def repeated_counted(found: DataFrame, wide: int) -> DataFrame:
    """As ``repeated`` within keys too, with the anchors that occur more than ``wide`` times apart: (_key, gs, wide)."""
    found = staged(found, "anchors")
    again = staged(found.select(F.explode("gs").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                   .select("g", (F.col("n") > wide).alias("hot")), "anchors-again")
    distinct = found.select("_key", F.explode(F.array_distinct("gs")).alias("g"))
    own = distinct.join(again, "g").groupBy("_key").agg(
        F.collect_list(F.when(~F.col("hot"), F.col("g"))).alias("gs"), F.collect_list(F.when(F.col("hot"), F.col("g"))).alias("wide"))
    out = staged(own, "anchors-kept")
    settle(found, again)
    return out
