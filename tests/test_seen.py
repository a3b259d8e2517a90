import datetime as dt
import random

from pyspark.sql import functions as F

from parlance.operators import inbox
from parlance.streaming import seen

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "message_id string, mid string, received_at timestamp, batch string"


def messages(spark, rows):
    return spark.createDataFrame([(f"m{n}", mid, T0 + dt.timedelta(days=day), "clash") for n, mid, day in rows], SCHEMA)


def kept(spark, path):
    rows = seen.read_messages(spark, path)
    assert rows.columns == ["message_id", "mid", "received_at", "batch"]
    return sorted(r["message_id"] for r in rows.collect())


def test_filters_have_no_false_negative_and_merge(spark):
    ids = spark.range(3000).select(F.concat(F.lit("é"), "id").alias("mid"))
    halves = [seen.filters_of(ids.filter(F.crc32(F.col("mid").cast("binary")) % 2 == i), 4) for i in (0, 1)]
    merged = seen.merge_filters(halves[0].unionByName(halves[1]))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, seen.filters_of(ids, 4).collect()))
    asked = seen.maybe_seen(ids.unionByName(spark.range(3000).select(F.concat(F.lit("n"), "id").alias("mid"))), merged, 4)
    counts = {r[0]: r[1] for r in asked.groupBy(F.startswith("mid", F.lit("é")).alias("old")).agg(F.sum(F.col("asked").cast("int"))).collect()}
    assert counts[True] == 3000 and counts[False] < 60


def test_an_id_is_never_forgotten(spark, tmp_path):
    rnd = random.Random(7)
    path, seen_ids, want = str(tmp_path / "seen"), set(), []
    for batch in range(18):  # past the merge of filters at 16; days lie between the batches
        rows = [(batch * 100 + i, rnd.choice([None, "", "hot", *(f"id{rnd.randrange(60)}" for _ in range(6))]), batch * 30 + i)
                for i in range(12)]
        for n, mid, _ in rows:
            if not mid or mid not in seen_ids:
                want.append(f"m{n}")
                seen_ids.add(mid)
        for _ in range(2 if batch in (5, 16) else 1):  # two batches come again
            seen.dedup_batch(messages(spark, rows), batch, path, blocks=2, parts=3)
    assert kept(spark, path) == sorted(want)


def test_full_filters_cost_lookups_and_no_answers(spark, tmp_path):
    path = str(tmp_path / "seen")
    first = [(i, f"a{i}", 0) for i in range(200)]
    seen.dedup_batch(messages(spark, first), 0, path, blocks=1, parts=2)
    full = spark.createDataFrame([(0, bytes([255]) * (seen.BITS // 8))], "block int, bits binary")
    full.write.mode("overwrite").parquet(f"{path}/filters/batch=0")
    seen.dedup_batch(messages(spark, [(500 + i, f"a{i}" if i < 50 else f"b{i}", 400) for i in range(80)]), 1, path, blocks=1, parts=2)
    assert len(kept(spark, path)) == 230
    assert spark.read.parquet(f"{path}/ids/batch=1").filter("asked").count() == 30


def test_a_stream_of_several_batches_and_empty_ones(spark, tmp_path):
    source, path, cp = str(tmp_path / "in"), str(tmp_path / "seen"), str(tmp_path / "cp")
    parts = [messages(spark, [(1, "x", 0), (2, None, 0), (3, "x", 0)]), messages(spark, []), messages(spark, [(4, "x", 90), (5, "y", 90)])]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(source)
        seen.dedup_into(spark.readStream.schema(part.schema).parquet(source), path, cp).awaitTermination()
    assert kept(spark, path) == ["m1", "m2", "m5"]
    whole = parts[0].unionByName(parts[2])
    assert kept(spark, path) == sorted(r["message_id"] for r in inbox.dedup_messages(whole).collect())
