"""The physical plans that matter at scale."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from parlance import session
from parlance.operators import crm, inbox, memory, prep, retrieval, signals
from parlance.plans import inputs as I
from parlance.sources import webhooks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return plan(df).count("Exchange hashpartitioning")


@pytest.fixture
def events(spark):
    return I.event_turns(spark, SMALL)


def test_lifecycle_is_one_shuffle_without_hot_keys(events):
    p = memory.session_lifecycle(events)
    assert exchanges(p) == 1 and "Join" not in plan(p)


def test_language_is_one_shuffle_without_hot_keys(events):
    p = signals.detect_language(events)
    assert exchanges(p) == 1 and "Join" not in plan(p)


@pytest.mark.parametrize("make", [
    memory.context_window, memory.session_history, lambda t: memory.latest_by_key(t, "session_id", ["ts"])])
def test_ranks_are_cut_before_the_shuffle(events, make):
    p = plan(make(events))
    assert "WindowGroupLimit" in p.split("Exchange")[1] and "Partial" in p


def test_dedup_is_cut_before_the_shuffle(spark):
    p = inbox.dedup_messages(I.event_messages(spark, SMALL))
    assert exchanges(p) == 1 and "row_number(), 1, Partial" in plan(p)


def test_folds_are_combined_before_the_shuffle(spark):
    p = crm.fold_customers(I.profile_events(spark, SMALL))
    assert exchanges(p) == 1 and "partial_max" in plan(p) and "partial_collect_set" in plan(p)


def test_stats_are_one_pass(spark):
    stats = crm.customer_stats(crm.fold_customers(I.profile_events(spark, SMALL)))
    assert plan(stats).count("FileScan") == 1


def test_payloads_are_parsed_once_without_a_shuffle(spark):
    df = spark.createDataFrame([("{}",)], "body string")
    p = plan(webhooks.flatten_payloads(df))
    assert p.count("Generate") == 1 and "Exchange" not in p


def test_search_shuffles_hits_only(spark):
    chunks = I.chunks(spark, SMALL)
    hits = retrieval.lexical_topk(chunks, I.benchmark_queries(spark, SMALL))
    p = plan(hits)
    above = p[:p.index("MapInArrow")]
    assert above.count("Exchange") == 1 and "WindowGroupLimit" in above and "Join" not in p


def test_columns_and_filters_reach_the_scan(spark):
    turns = spark.read.parquet(f"{SMALL}/conversations.parquet").select(
        F.col("conv_id").alias("user_id"), "role", F.col("conv_id").alias("session_id"),
        F.col("turn").alias("turn_id"), F.col("text").alias("content"))
    p = plan(memory.turns_per_user(memory.user_turns(turns)))
    assert "EqualTo(role,user)" in p and "text" not in p.split("ReadSchema")[1]


def test_embedding_is_skipped_when_not_asked_for(spark):
    assert "Python" not in plan(prep.documents_to_points(I.documents(spark, SMALL)).select("point_id"))


class FakeSession:
    """The two things that ``work_dir`` asks of a session."""

    def __init__(self, master, folder=None):
        self.sparkContext = type("Context", (), {"master": master})()
        self.conf = type("Conf", (), {"get": lambda _, key, default=None: folder or default})()


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError):
        session.work_dir(FakeSession("yarn"), "x")


def test_the_folder_that_the_cluster_names_is_used():
    assert session.work_dir(FakeSession("yarn", "hdfs://shared/"), "x").startswith("hdfs://shared/parlance/x-")


def test_a_laptop_gets_one_folder():
    a, b = (session.work_dir(FakeSession("local[2]"), "x") for _ in range(2))
    assert a != b and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0]


def test_folder_import_writes_its_folder_in_several_tasks(spark, monkeypatch):
    import glob
    from collections import Counter

    from parlance.plans import documents
    made = {}

    def kept(session_, label):
        made[label] = session.work_dir(session_, label)
        return made[label]

    monkeypatch.setattr(documents, "work_dir", kept)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        documents.folder_import(spark, SMALL)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    names = Counter(f.rsplit("/", 1)[1] for f in glob.glob(f"{made['folder'].removeprefix('file:')}/texts/item_id=*/part-*"))
    # More than one task, and still folders with files of one name.
    assert len(names) > 1 and max(names.values()) > 1
