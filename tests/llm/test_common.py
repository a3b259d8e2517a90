import glob
import os

from pyspark.sql import functions as F

from parlance.llm.common import settle, staged

NAME = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def test_staged_is_written_once_and_leaves_the_session_as_it_was(spark):
    before = spark.conf.get(NAME)
    grouped = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    got = staged(grouped, "counted")
    assert {r["k"]: r["count"] for r in got.collect()} == {k: 100 for k in range(10)}
    assert spark.conf.get(NAME) == before
    assert grouped.count() == 10  # the plan that was staged still runs by itself


def test_settle_removes_staged_tables_only(spark, tmp_path):
    mine = str(tmp_path / "parlance" / "kept")
    spark.range(5).write.parquet(mine)
    made = staged(spark.range(7), "gone")
    folder = made.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    settle(made, spark.read.parquet(mine))
    assert not os.path.exists(folder)
    assert glob.glob(f"{mine}/*.parquet")
