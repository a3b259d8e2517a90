import datetime as dt
import random

from parlance.operators import crm
from parlance.streaming import crm_changes

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = ("user_id string, ts timestamp, event_id long, size string, fabric string, language string, location string, "
          "stage string, tags array<string>, notes string")


def events(spark, rows):
    return spark.createDataFrame([(u, None if day is None else T0 + dt.timedelta(days=day), n, size, None, None, None, stage, None, None)
                                  for u, day, n, size, stage in rows], SCHEMA)


def listed(df):
    return sorted(map(str, df.select("kind", "value", "customers").collect()))


def test_stats_equal_the_fold_after_every_batch(spark, tmp_path):
    rnd = random.Random(4)
    source, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    so_far = None
    for batch in range(4):
        rows = [(rnd.choice(["hot", *(f"u{i}" for i in range(6)), None]), rnd.choice([0, 1, 2, 3, 40]), batch * 100 + n,
                 rnd.choice([None, "", "M", "XL"]), rnd.choice([None, "", "Support", "Ready to Order"])) for n in range(0 if batch == 2 else 25)]
        part = events(spark, rows)
        part.repartition(2).write.mode("append").parquet(source)
        crm_changes.stats_into(spark.readStream.schema(SCHEMA).parquet(source), out, cp).awaitTermination()
        so_far = part if so_far is None else so_far.unionByName(part)
        assert listed(crm_changes.read_stats(spark, out)) == listed(crm.customer_stats(crm.fold_customers(so_far)))


def test_changes_of_one_customer(spark, tmp_path):
    source, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for rows in ([("u", 5, 1, "M", None)], [("u", 9, 2, "L", "Support")], [("u", 1, 3, "S", "Ready to Order")]):
        events(spark, rows).coalesce(1).write.mode("append").parquet(source)
        crm_changes.stats_into(spark.readStream.schema(SCHEMA).parquet(source), out, cp).awaitTermination()
    made = [sorted((r["kind"], r["value"], r["change"]) for r in spark.read.schema("kind string, value string, change long").parquet(
        f"{out}/batch={n}").collect()) for n in range(2)]
    assert made[1] == [("size", "L", 1), ("size", "M", -1), ("stage", crm.DEFAULT_STAGE, -1), ("stage", "Support", 1)]
    assert listed(crm_changes.read_stats(spark, out)) == sorted(map(str, crm.customer_stats(
        crm.fold_customers(events(spark, [("u", 9, 2, "L", "Support")]))).select("kind", "value", "customers").collect()))
