"""Which documents of a snapshot differ from the snapshot before: a digest tree of two levels at rest.

``leaves/v=<n>/slot=<s>`` holds the digests of the documents of one slot, ``roots/v=<n>`` one row per slot with the
sum of its digests and the number of the version whose leaves hold it. Slots with equal sums are not read any
further, and a version writes only the slots that changed. The roots are written last and count only with
their ``_SUCCESS`` marker, so a job that died half-way is simply done again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SLOTS = 1024
_SUMS = ("low", "high")
_LEAF = "doc_id string, low decimal(38,0), high decimal(38,0)"
_ROOT = "slot int, low decimal(38,0), high decimal(38,0), version int"


def document_digests(docs: DataFrame, method: str = "", slots: int = SLOTS) -> DataFrame:
    """``slot, doc_id, low, high``: one row per document id, from title, address and text.

    Sums of two 60-bit parts of a hash do not depend on the order of rows, so rows that repeat an id count as a
    multiset. A null differs from an empty text. Rows without an id are left out. ``method`` names how vectors are
    made; another name changes all digests.
    """
    content = F.sha2(F.concat(F.lit(f"{method}\n"), F.to_json(F.struct("doc_title", "source_uri", "raw_text"))), 256)
    part = lambda at: F.conv(F.substring("_hash", at, 15), 16, 10).cast("decimal(19,0)")
    return (docs.filter(F.col("doc_id").isNotNull()).select("doc_id", content.alias("_hash"))
            .groupBy("doc_id").agg(*_summed(part(1), part(16)))
            .withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(slots)).cast("int")))


def _summed(low: Column, high: Column) -> list[Column]:
    return [F.sum(part).cast("decimal(38,0)").alias(name) for name, part in zip(_SUMS, (low, high))]


def _versions(spark: SparkSession, folder: str, complete: bool) -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path
    root = path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(int(p.getName().removeprefix("v=")) for p in found
                  if p.getName().startswith("v=") and (not complete or fs.exists(path(p, "_SUCCESS"))))


def stored_roots(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete roots; empty without any."""
    known = _versions(spark, f"{path}/roots", True)
    return spark.read.schema(_ROOT).parquet(f"{path}/roots/v={known[-1]}") if known else spark.createDataFrame([], _ROOT)


def roots_of(digests: DataFrame) -> DataFrame:
    """One row per slot. A document's id counts too, so texts that change places are a change."""
    named = F.xxhash64("doc_id", *_SUMS).cast("decimal(38,0)")
    return digests.groupBy("slot").agg(*_summed(named, F.col("high")))


def differing_slots(digests: DataFrame, path: str) -> list[tuple[int, int | None]]:
    """``(slot, version of its stored leaves)`` where the sums differ; at most one for each slot, whatever the input."""
    old = stored_roots(digests.sparkSession, path)
    new = roots_of(digests)
    both = new.alias("n").join(old.alias("o"), F.col("n.slot") == F.col("o.slot"), "full")
    same = F.lit(True)
    for name in _SUMS:
        same = same & F.col(f"n.{name}").eqNullSafe(F.col(f"o.{name}"))
    rows = both.filter(~same).select(F.coalesce("n.slot", "o.slot").alias("slot"), "o.version").collect()
    return [(r["slot"], r["version"]) for r in rows]


def changed_documents(digests: DataFrame, path: str, differing: list[tuple[int, int | None]]) -> DataFrame:
    """``doc_id, change`` (added, changed, removed), reading only the leaves of the differing slots."""
    spark = digests.sparkSession
    folders = [f"{path}/leaves/v={version}/slot={slot}" for slot, version in differing if version is not None]
    old = spark.read.schema(_LEAF).parquet(*folders) if folders else spark.createDataFrame([], _LEAF)
    new = digests.filter(F.col("slot").isin([slot for slot, _ in differing]))
    both = new.alias("n").join(old.alias("o"), F.col("n.doc_id") == F.col("o.doc_id"), "full")
    change = (F.when(F.col("o.doc_id").isNull(), "added").when(F.col("n.doc_id").isNull(), "removed")
              .when((F.col("n.low") != F.col("o.low")) | (F.col("n.high") != F.col("o.high")), "changed"))
    return both.select(F.coalesce("n.doc_id", "o.doc_id").alias("doc_id"), change.alias("change")).filter(
        F.col("change").isNotNull())


def store_digests(digests: DataFrame, path: str, differing: list[tuple[int, int | None]]) -> None:
    """Writes the leaves of the differing slots, then the roots of all."""
    spark = digests.sparkSession
    version = max(_versions(spark, f"{path}/leaves", False) + _versions(spark, f"{path}/roots", False), default=0) + 1
    slots = [slot for slot, _ in differing]
    digests.filter(F.col("slot").isin(slots)).repartition("slot").write.partitionBy("slot").parquet(
        f"{path}/leaves/v={version}")
    kept = stored_roots(spark, path).filter(~F.col("slot").isin(slots))
    fresh = roots_of(digests.filter(F.col("slot").isin(slots))).withColumn("version", F.lit(version))
    kept.unionByName(fresh).coalesce(1).write.parquet(f"{path}/roots/v={version}")
