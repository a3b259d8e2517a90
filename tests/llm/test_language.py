import pytest

from conftest import SMALL
from parlance.llm import language
from parlance.llm.common import held_out

SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(SMALL.replace("0.001", "0.01") + "/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return language.fit(docs)


def test_held_out_accuracy(docs, model):
    joined = language.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter(held_out()).collect()
    assert len(joined) > 150
    assert sum(r["lang"] == r["lang_pred"] for r in joined) >= 0.97 * len(joined)
    assert all(0 <= r["score"] <= 1 for r in joined)


def test_only_the_text_counts(spark, docs, model):
    texts = [r["text"] for r in docs.limit(20).collect()]
    one = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], SCHEMA)
    two = spark.createDataFrame([(i + 1000, t, None) for i, t in enumerate(texts)], SCHEMA)
    pick = lambda df: [r["lang_pred"] for r in language.predict(df, model).orderBy("doc_id").collect()]
    assert pick(one) == pick(two)


def test_texts_without_letters(spark, model):
    rows = [(1, None, None), (2, "", None), (3, "12 --- !", None), (None, "\n", None)]
    out = language.predict(spark.createDataFrame(rows, SCHEMA), model).collect()
    assert [(r["lang_pred"], r["score"], r["rejected"]) for r in out] == [("und", 0.0, True)] * 4


def test_letters_outside_ascii_count(spark, model):
    out = language.predict(spark.createDataFrame([(1, "é ü", None)], SCHEMA), model).collect()
    assert out[0]["lang_pred"] in model.dictionaries


def test_learns_from_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    model = language.fit(empty)
    assert model.dictionaries == {}
    assert language.predict(empty, model).collect() == []
    rows = spark.createDataFrame([(1, "words", None)], SCHEMA)
    assert [r["lang_pred"] for r in language.predict(rows, language.fit(rows)).collect()] == ["und"]


def test_held_out_rows_are_not_learned(spark):
    rows = spark.createDataFrame([(i, f"lang{i % 2} only words {i}", "secret" if out else "known") for i in range(40)
                                  for out in [__import__("zlib").crc32(str(i).encode()) % 4 == 2]], SCHEMA)
    assert set(language.fit(rows).dictionaries) == {"known"}


def test_long_text_and_rejection(spark, docs, model):
    by = {r["lang"]: r["text"] for r in docs.filter("n_chars > 800").limit(60).collect()}
    long = spark.createDataFrame([(i, t * 200, k) for i, (k, t) in enumerate(sorted(by.items()))], SCHEMA)
    assert all(r["lang"] == r["lang_pred"] for r in language.predict(long, model).join(long, "doc_id").collect())
    kept = language.keep_identified(long.unionByName(spark.createDataFrame([(99, "", "en")], SCHEMA)), model)
    assert kept.columns == long.columns and kept.filter("doc_id = 99").isEmpty() and kept.count() == len(by)
