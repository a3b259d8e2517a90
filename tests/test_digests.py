from pyspark.sql import functions as F

from parlance.functions.vectors import hash_embedder
from parlance.plans import pipelines as P
from parlance.sources import digests as D, vector_table as V

SCHEMA = "doc_id string, doc_title string, source_uri string, raw_text string"


def docs(spark, **texts):
    return spark.createDataFrame([(k, k, f"file://{k}", t) for k, t in texts.items()], SCHEMA)


def strict(column):
    """Fails when a text that has not changed reaches it."""
    return F.when(column.contains("same"), F.raise_error(F.lit("embedded again"))).otherwise(hash_embedder()(column))


def test_only_changed_documents_are_embedded(spark, tmp_path):
    index, known = str(tmp_path / "index"), str(tmp_path / "digests")
    same = {f"s{i}": f"same {i}" for i in range(40)}
    assert P.sync_snapshot(docs(spark, **same, a="one", b="two", c=None), index, known) == {"added": 43}
    assert P.sync_snapshot(docs(spark, **same, a="one", b="two", c=None), index, known, strict) == {}
    later = docs(spark, **same, a="uno", c="", d="four")
    assert P.sync_snapshot(later, index, known, strict) == {"added": 1, "changed": 2, "removed": 1}
    stored = {r.doc_id: r.content for r in V.read_index(spark, index).collect()}
    assert stored == {**same, "a": "uno", "d": "four"}
    assert P.sync_snapshot(later.limit(0), index, known) == {"removed": 43}
    assert V.read_index(spark, index).count() == 0


def test_texts_that_change_places_and_another_method_are_changes(spark, tmp_path):
    index, known = str(tmp_path / "index"), str(tmp_path / "digests")
    assert P.sync_snapshot(docs(spark, a="x", b="y"), index, known) == {"added": 2}
    assert P.sync_snapshot(docs(spark, a="y", b="x"), index, known) == {"changed": 2}
    assert P.sync_snapshot(docs(spark, a="y", b="x"), index, known, method="other") == {"changed": 2}


def test_a_job_that_died_before_its_roots_is_done_again(spark, tmp_path):
    known = str(tmp_path / "digests")
    first = D.document_digests(docs(spark, a="x"))
    D.store_digests(first, known, D.differing_slots(first, known))
    second = D.document_digests(docs(spark, a="y"))
    differing = D.differing_slots(second, known)
    second.write.partitionBy("slot").parquet(f"{known}/leaves/v=2")
    assert D.differing_slots(second, known) == differing
    D.store_digests(second, known, differing)
    assert D.differing_slots(second, known) == []


def test_repeated_rows_and_missing_ids(spark):
    rows = [("a", "t", "u", "x"), ("a", "t", "u", "y"), (None, "t", "u", "z")]
    one, two = (D.document_digests(spark.createDataFrame(r, SCHEMA)).collect() for r in (rows, rows[::-1]))
    assert one == two and len(one) == 1
    assert D.document_digests(spark.createDataFrame(rows[:1], SCHEMA)).collect() != one
