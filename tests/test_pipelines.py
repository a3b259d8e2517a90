import datetime as dt
import json

from pyspark.sql import functions as F

from parlance.operators import crm, memory, prep
from parlance.plans import pipelines as P
from parlance.sources import files, vector_table as V

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def docs(spark, **texts):
    return files.inline_documents(spark, [
        {"doc_id": k, "doc_title": k.upper(), "source_uri": f"file://{k}", "raw_text": t} for k, t in texts.items()])


def test_ingest_counts_what_is_stored_and_exports(spark, tmp_path):
    index, out = str(tmp_path / "index"), str(tmp_path / "out")
    assert P.ingest(docs(spark, a="one two three", b="four"), index, 2, 1, export_path=out) == 4
    assert V.read_index(spark, index).count() == spark.read.json(out).count() == 4


def test_sync_drops_chunks_that_are_no_more(spark, tmp_path):
    index = str(tmp_path / "index")
    P.ingest(docs(spark, a="w " * 600, b="keep"), index)
    P.sync_documents(docs(spark, a="short"), index)
    assert {r.chunk_id for r in V.read_index(spark, index).collect()} == {"a_chk_0", "b_chk_0"}
    P.sync_documents(docs(spark, c="only"), index, recreate=True)
    assert {r.chunk_id for r in V.read_index(spark, index).collect()} == {"c_chk_0"}


def test_folder_and_facts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("delivery takes two days")
    (tmp_path / "in" / "b.csv").write_text("name,price\nTop,399\n")
    index = str(tmp_path / "index")
    assert P.import_folder(spark, str(tmp_path / "in"), index, "*.md") == 1
    assert P.import_folder(spark, str(tmp_path / "in"), index) == 2
    facts = spark.createDataFrame([("F", "Fee", "is 50")], "doc_id string, title string, content string")
    assert P.add_facts(facts, index) == 1
    assert {r.content for r in V.read_index(spark, index).collect()} == {
        "delivery takes two days", "name: Top | price: 399", "Fee: is 50"}


def test_importing_again_replaces_a_file(spark, tmp_path):
    (tmp_path / "in").mkdir()
    note, index = tmp_path / "in" / "note.md", str(tmp_path / "index")
    note.write_text("word " * 1200)
    P.import_folder(spark, str(tmp_path / "in"), index)
    assert V.read_index(spark, index).count() == 3
    note.write_text("short")
    P.import_folder(spark, str(tmp_path / "in"), index)
    assert [r.content for r in V.read_index(spark, index).collect()] == ["short"]


def test_answers(spark, tmp_path):
    index = str(tmp_path / "index")
    P.ingest(docs(spark, a="delivery takes two days", b="cotton tops cost more"), index)
    turns = spark.createDataFrame([("t1", "s", "u", "user", "cotton please", T0)],
                                  "turn_id string, session_id string, user_id string, role string, content string, ts timestamp")
    questions = spark.createDataFrame([("q1", "s", "u", "how long is delivery"), ("q2", "s", "u", "hello")],
                                      "query_id string, session_id string, user_id string, query string")
    got = {r.query_id: r for r in P.prepare_answers(
        questions, turns, memory.consolidate_profiles(turns), V.read_index(spark, index), 1).collect()}
    assert got["q1"].intent == "RAG_QUERY" and got["q1"].citations[0].doc_id == "a"
    assert "[Source 1] Document ID: a" in got["q1"].prompt and "User: cotton please" in got["q1"].prompt
    assert got["q2"].intent == "CHIT_CHAT" and got["q2"].citations is None and "[Source" not in got["q2"].prompt


def test_inbound(spark):
    def body(mid, text):
        return json.dumps({"object": "instagram", "entry": [{"messaging": [
            {"sender": {"id": "S"}, "message": {"mid": mid, "text": text}}]}]})

    df = spark.createDataFrame([(body("1", "size L cotton top price?"), T0), (body("1", "size L cotton top price?"), T0),
                                (body("2", "I will buy, ship to Kochi"), T0 + dt.timedelta(1))], "body string, received_at timestamp")
    queued, events = P.process_inbound(df)
    assert queued.count() == 2
    r = crm.fold_customers(events).first()
    assert (r.preferred_size, r.preferred_fabric, r.location, r.stage, r.total_turns) == ("L", None, "Kochi", "Ready to Order", 2)
    assert "Fabric:Cotton" in r.tags


def test_equal_messages_without_an_id_all_stay(spark):
    said = {"from": "91", "text": {"body": "ok"}}
    body = json.dumps({"object": "whatsapp_business_account", "entry": [{"changes": [{"value": {"messages": [said, said]}}]}]})
    df = spark.createDataFrame([(body, T0), (body, T0)], "body string, received_at timestamp")
    ids = lambda: sorted(r.message_id for r in P.process_inbound(df)[0].collect())
    assert len(set(ids())) == 4 and ids() == ids()


def test_consolidation_run(spark):
    turns = spark.createDataFrame([("t1", "s", "u", "user", "cotton please", T0)],
                                  "turn_id string, session_id string, user_id string, role string, content string, ts timestamp")
    none = spark.createDataFrame([], "user_id string, profile_summary string, key_topics array<string>, interaction_count int, last_updated timestamp")
    now = F.lit("2024-02-01").cast("timestamp")
    first = P.consolidate(turns, none, now)
    again = P.consolidate(turns, first, now).first()
    assert (again.interaction_count, again.key_topics) == (2, ["cotton", "please"])


def test_ingest_has_no_shuffle(spark):
    plan = prep.documents_to_points(docs(spark, a="x"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_only_facts_that_win_are_embedded(spark, tmp_path):
    # Before, every row got its vector first, and all vectors were shuffled and sorted.
    from parlance.plans import pipelines
    from parlance.sources import vector_table
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<float>")
    def counted(text):
        seen.add(1)
        return [float(len(text)), 1.0]

    facts = spark.createDataFrame([(f"d{i % 5}", "T", f"text {i:03d}") for i in range(100)], "doc_id string, title string, content string")
    pipelines.add_facts(facts, str(tmp_path / "i"), counted)
    assert seen.value == 5
    got = {(r.doc_id, r.content) for r in vector_table.read_index(spark, str(tmp_path / "i")).collect()}
    assert got == {(f"d{i % 5}", f"T: text {i:03d}") for i in range(95, 100)}
