import os

import duckdb
import pytest

import corpus_pipeline
from conftest import SMALL
from parlance.llm import language, leaks, pieces
from parlance.llm.common import documents
from test_near import restated

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


def test_stages_equal_plain_restatements(spark):
    docs = documents(spark, SMALL)
    model = language.fit(docs)
    rows, by_language = {}, language.encoders(model)
    for r in docs.collect():
        name, score = language.classify(model, r["text"] or "", by_language)
        if name != "und" and score >= 0.4:
            rows[r["doc_id"]] = r
    newest = {}
    for i, r in rows.items():
        key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or "")
        newest[key] = max(newest.get(key, i), i)
    rows = {i: rows[i] for i in newest.values()}
    kept = {i for i, _, _, first in restated([(i, r["text"]) for i, r in rows.items()], 5) if first}
    items = [bytes(t, "utf-8").lower() for (t,) in duckdb.sql(f"SELECT text FROM '{SMALL}/benchmark.parquet'").fetchall()]
    squeezed = lambda t: t.encode().lower().replace(b"\n", b" ")
    leaked = {i for i in kept if any(squeezed(p.decode()) in squeezed(rows[i]["text"]) for p in items)}
    vocab = pieces.read_vocabulary(corpus_pipeline.VOCABULARY)

    out = corpus_pipeline.run(spark, SMALL)
    found = {r["doc_id"]: r for r in pieces.decode(out, vocab).collect()}
    # Every exact passage is caught; what goes besides is within the edit budget.
    assert set(found) <= kept - leaked
    for i in kept - leaked - set(found):
        assert not leaks.find(docs.filter(f"doc_id = {i}"), spark.read.parquet(f"{SMALL}/benchmark.parquet")).isEmpty()
    assert all(r["lossless"] and r["text"] == rows[i]["text"] and r["lang"] == rows[i]["lang"] for i, r in found.items())


def test_stages_take_empty_tables_and_more_columns(spark):
    docs = documents(spark, SMALL).selectExpr("*", "doc_id AS _key", "text AS kept", "1 AS n", "lang AS _row")
    for some in (docs.limit(0), docs.limit(40)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, some, SMALL)
            assert out.columns == docs.columns and out.count() <= some.count()
        assert corpus_pipeline.STAGES[-1][1](spark, some, SMALL).count() == some.count()
