"""Ids seen at any time before: an exact table of them behind mergeable Bloom filters.

A watermark forgets an id, this does not. The filter of an id is one block of 32 768 bits (a ``bitmap`` of the built-in
aggregates), picked by a hash; four more hashes pick bits in it. Only ids whose bits are all set are
looked up in the table, so the answer is exact and a batch of new ids reads filters alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.inbox import has_mid

BITS = 32_768  # of a bitmap_construct_agg bitmap
HASHES = 4
MERGE_EVERY = 16


def _block(id: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(id), F.lit(blocks)).cast("int")


def _places(id: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(id, F.lit(i)), F.lit(BITS)) for i in range(1, HASHES + 1)]


def filters_of(ids: DataFrame, blocks: int) -> DataFrame:
    """Rows (block, bits): the filters of the column ``mid``. Bits are set on the map side."""
    places = ids.select(_block(F.col("mid"), blocks).alias("block"), F.explode(F.array(*_places(F.col("mid")))).alias("place"))
    return places.groupBy("block").agg(F.bitmap_construct_agg("place").alias("bits"))


def merge_filters(filters: DataFrame) -> DataFrame:
    """One filter per block from any number of them."""
    return filters.groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))


def maybe_seen(rows: DataFrame, filters: DataFrame, blocks: int) -> DataFrame:
    """``rows`` with a column ``asked``: false where ``mid`` is certainly in none of the filters (block, bits)."""
    def is_set(place: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.floor(byte / F.pow(F.lit(2), place % 8)) % 2 == 1

    every = reduce(Column.__and__, [is_set(p) for p in _places(F.col("mid"))])
    named = filters.select(F.col("block").alias("_block"), F.col("bits").alias("_bits"))
    joined = rows.join(named, _block(F.col("mid"), blocks) == F.col("_block"), "left")
    return joined.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce(every, F.lit(False)).alias("asked"))


def _batches(spark: SparkSession, path: str, schema: str, first: int, end: int) -> DataFrame:
    """The rows of the batches from ``first`` to before ``end``; none if nothing was written yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).filter(
        (F.col("batch") >= first) & (F.col("batch") < end))


def dedup_batch(batch: DataFrame, batch_id: int, path: str, blocks: int = 4096, parts: int = 64) -> None:
    """Writes the messages of a batch whose ``mid`` is new, and all without one, under ``path``/messages, and remembers the ids.

    Of a new id's messages in one batch the first by time and id stays. A repeated batch reads only what earlier ones left and
    replaces its own folders. ``blocks`` (4 KB each) fixes the filters' size for good: some 3 000 ids for each keep
    lookups of new ids near 1 %; more ids cost lookups and never answers. The table of ids lies in ``parts`` folders by a hash,
    and only the folders of asked ids are read.
    """
    spark, columns = batch.sparkSession, batch.columns
    box = F.struct(*[F.col(f"`{c}`") for c in columns])
    # Summed before the shuffle, so a hot id sends one row from each task.
    firsts = batch.filter(has_mid()).groupBy("mid").agg(F.min_by(box, F.struct("received_at", "message_id")).alias("_row"))
    last_merge = max(0, batch_id - 1) // MERGE_EVERY * MERGE_EVERY
    old = _batches(spark, f"{path}/filters", "block int, bits binary, batch int", last_merge, batch_id).select("block", "bits")
    probed = maybe_seen(firsts, merge_filters(old), blocks).withColumn("part", F.pmod(F.hash("mid"), F.lit(parts)))
    # Written once: the batch is read once, and what follows sees one and the same set of rows.
    probed.write.mode("overwrite").parquet(f"{path}/probed")
    probed = spark.read.schema(probed.schema).parquet(f"{path}/probed")
    asked = probed.filter("asked")
    wanted = [r["part"] for r in asked.select("part").distinct().collect()]  # no more than ``parts``
    known = _batches(spark, f"{path}/ids", "mid string, asked boolean, part int, batch int", 0, batch_id).filter(F.col("part").isin(wanted))
    new = probed.filter(~F.col("asked")).unionByName(asked.join(known.select("part", "mid"), ["part", "mid"], "left_anti").select(*probed.columns))
    fresh = new.select("mid", "asked", "part")
    fresh.write.mode("overwrite").partitionBy("part").parquet(f"{path}/ids/batch={batch_id}")
    written = spark.read.schema("mid string, asked boolean, part int").parquet(f"{path}/ids/batch={batch_id}")
    made = filters_of(written, blocks)
    if batch_id % MERGE_EVERY == 0:
        made = merge_filters(made.unionByName(old))
    made.write.mode("overwrite").parquet(f"{path}/filters/batch={batch_id}")
    out = new.select(*[F.col("_row").getField(c).alias(c) for c in columns]).unionByName(batch.filter(~has_mid()))
    out.write.mode("overwrite").parquet(f"{path}/messages/batch={batch_id}")


def dedup_into(messages: DataFrame, path: str, checkpoint: str, blocks: int = 4096, parts: int = 64,
               available_now: bool = True) -> StreamingQuery:
    """Keeps the messages of a stream under ``path``, each platform id once however long ago it came first."""
    writer = messages.writeStream.foreachBatch(lambda batch, n: dedup_batch(batch, n, path, blocks, parts)).option(
        "checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """The messages kept so far."""
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/messages")
