"""Exact duplicates as a stateful stream, with DataFrame operations only.

Every text becomes a digest, its row's identifier and a locator of its content. These short rows
run as a stream through an aggregation without a watermark, so the state of a digest is never
dropped; the store behind it is RocksDB, on disk. For each digest the state keeps the largest
identifier, the locator of that row, and how many rows there were. A digest seen twice is a hit:
the whole texts of such rows are grouped by their full bytes, so rows count as equal only if their
texts are. Digests that two different texts share are told apart by those bytes.

Scale: rows are summed per digest and per text before each shuffle, so a text that a third of the
rows share makes one row per task. Joins on a digest have one row per digest on one side; Spark
splits the other side where it is skewed. Texts are shuffled only once, for the comparison.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..session import work_dir
from .common import boxed, staged

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fold_case(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def digest_state(rows: DataFrame, files_per_batch: int = 256) -> DataFrame:
    """Streams ``rows`` (_digest, _key, _locator; read from files) through the keyed state and gives
    the state as it stands after the last batch: _digest, _keep, _locator, _n."""
    spark = rows.sparkSession
    # A session of its own: the state store is set without touching the caller's settings.
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    # Reserving space ahead would take megabytes for every partition of the state.
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    folder = work_dir(spark, "digest-state")
    source = work_dir(spark, "digests")
    rows.write.parquet(source)
    state = (own.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
             .groupBy("_digest").agg(F.max("_key").alias("_keep"), F.max_by("_locator", "_key").alias("_locator"),
                                     F.count(F.lit(1)).alias("_n")))

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/changes/batch={batch}")

    stream = (state.writeStream.outputMode("update").foreachBatch(keep)
              .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    stream.awaitTermination()
    schema = spark.createDataFrame([], rows.schema).select(
        "_digest", F.col("_key").alias("_keep"), "_locator", F.lit(0).cast("long").alias("_n")).schema
    if not own.streams.active and stream.lastProgress is None:  # no file had a row
        return spark.createDataFrame([], schema)
    changes = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/changes")
    # The count of a digest only grows, so its largest is its newest.
    newest = changes.groupBy("_digest").agg(F.max(F.struct("_n", "_keep", "_locator")).alias("_s"))
    return newest.select("_digest", "_s._keep", "_s._locator", "_s._n")


def mark_copies(docs: DataFrame, text: str = "text", key: str = "doc_id",
                digest: Callable[[Column], Column] = sha256, files_per_batch: int = 256) -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256, keep_locator.

    Texts are equal if their bytes are after lower-casing A-Z; null is the empty text. The row with
    the largest key stays (a null key is the smallest). Rows that repeat a key and a text count in
    ``group_size`` and are marked alike. Empty tables give no rows; other columns are not read.
    """
    norm = fold_case(F.col(text))
    rows = staged(docs.select(F.col(key).alias("_key"), norm.alias("_t"), F.input_file_name().alias("_locator")).select(
        "_key", digest(F.col("_t")).alias("_digest"), sha256(F.col("_t")).alias("_sha"), "_locator"), "copies")
    state = staged(digest_state(rows.select("_digest", "_key", "_locator"), files_per_batch), "copies-state")

    hits = state.filter(F.col("_n") > 1)
    hit_keys = rows.join(hits, "_digest", "left_semi").select(F.col("_key").alias("_hit"))
    texts = (docs.select(F.col(key).alias("_key"), F.col(text).alias("_t"))
             .join(hit_keys.hint("shuffle_hash"), F.col("_key").eqNullSafe(F.col("_hit")), "left_semi")
             .select("_key", fold_case(F.col("_t")).alias("_t")).select("_key", "_t", digest(F.col("_t")).alias("_digest")))
    classes = texts.groupBy("_digest", "_t").agg(F.max("_key").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    checked = staged(classes.groupBy("_digest").agg(
        F.count(F.lit(1)).alias("_texts"), F.max("_keep").alias("_keep"), F.max("_n").alias("_n")), "copies-checked")

    def result(marked: DataFrame) -> DataFrame:
        return marked.select(
            F.col("_key").alias(key), F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"),
            F.col("_key").eqNullSafe(F.col("_keep")).alias("kept"), F.col("_sha").alias("text_sha256"),
            F.col("_locator").alias("keep_locator"))

    agreed = checked.join(state.select("_digest", "_locator"), "_digest", "left").filter("_texts = 1").drop("_texts")
    shared = checked.filter(F.col("_texts") > 1).select("_digest")
    alone = F.col("_found").isNull()
    one = rows.join(agreed.select("_digest", F.col("_keep").alias("_k"), F.col("_n").alias("_m"),
                                  F.col("_locator").alias("_l"), F.lit(True).alias("_found")), "_digest", "left")
    one = one.select("_digest", "_key", "_sha", F.when(alone, F.col("_key")).otherwise(F.col("_k")).alias("_keep"),
                     F.when(alone, F.lit(1)).otherwise(F.col("_m")).cast("long").alias("_n"),
                     F.when(alone, F.col("_locator")).otherwise(F.col("_l")).alias("_locator"))
    if shared.isEmpty():
        return result(one)
    clash = texts.join(shared, "_digest", "left_semi").select("_key", "_t", sha256(F.col("_t")).alias("_sha"))
    apart = clash.groupBy("_t").agg(F.max("_key").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    # The locator of a digest's state says nothing about one of several texts.
    two = clash.join(apart, "_t").withColumn("_locator", F.lit(None).cast("string"))
    return result(one.join(shared, "_digest", "left_anti")).unionByName(result(two))


def drop_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", files_per_batch: int = 256) -> DataFrame:
    """``docs`` with one row of each group of equal texts; all columns stay as they were. Of rows that
    repeat key and text one stays too."""
    marks = mark_copies(docs, text, key, files_per_batch=files_per_batch).filter("kept")
    kept = staged(marks.groupBy(F.col(key).alias("_k"), F.col("text_sha256").alias("_s")).agg(
        F.count(F.lit(1)).alias("_rows")), "copies-kept")
    rows = boxed(docs, _key=F.col(key), _own=sha256(fold_case(F.col(text))))

    def those(wanted: DataFrame) -> DataFrame:
        same = F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_own") == F.col("_s"))
        return rows.join(wanted.hint("shuffle_hash"), same, "left_semi")

    single = those(kept.filter("_rows = 1")).select("_row.*")
    repeated = kept.filter("_rows > 1")
    if repeated.isEmpty():
        return single
    return single.unionByName(those(repeated).dropDuplicates(["_key", "_own"]).select("_row.*"))
