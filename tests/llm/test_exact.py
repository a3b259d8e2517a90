import hashlib
import random

from pyspark.sql import functions as F

from parlance.llm import exact

SCHEMA = "doc_id long, text string, lang string"


def plain(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def expected(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(plain(t), []).append(i)
    out = []
    for i, t, *_ in rows:
        own = groups[plain(t)]
        keep = max((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), i == keep, hashlib.sha256(plain(t).encode()).hexdigest()))
    return sorted(out, key=str)


def marked(df):
    names = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def some_rows(n=200):
    rnd = random.Random(3)
    return [(i, rnd.choice([None, "", "A b", "a B", "É", "é", "x\ty", f"text {rnd.randint(0, 40)}", "long " * 3000]), "en") for i in range(n)]


def test_marks_equal_a_plain_restatement(spark):
    rows = some_rows() + [(None, "A b", "en"), (7, "twice", "en"), (7, "twice", "en")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert marked(exact.mark_copies(df, files_per_batch=1)) == expected(rows)


def test_state_is_carried_between_batches(spark):
    rows = spark.createDataFrame([("d", 5, "f1"), ("d", 9, "f2"), ("e", 1, "f1")], "_digest string, _key long, _locator string")
    state = exact.digest_state(rows.repartition(3, "_key"), files_per_batch=1)
    assert {tuple(r) for r in state.select("_digest", "_keep", "_locator", "_n").collect()} == {("d", 9, "f2", 2), ("e", 1, "f1", 1)}


def test_texts_that_share_a_digest_stay_apart(spark):
    rows = some_rows(60)
    df = spark.createDataFrame(rows, SCHEMA)
    weak = exact.mark_copies(df, digest=lambda t: F.length(t).cast("string"))
    assert marked(weak) == expected(rows)


def test_drop_keeps_one_row_and_all_columns(spark):
    rows = [(1, "Same", "a", "k"), (2, "same", "b", "k"), (2, "same", "b", "k"), (3, None, "c", "k"), (4, "", "d", "k"), (2, "other", "e", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key string, _own string")
    out = exact.drop_copies(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"], r["text"], r["_key"]) for r in out.collect()) == [(2, "other", "e"), (2, "same", "b"), (4, "", "d")]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact.mark_copies(df).collect() == []
    assert exact.drop_copies(df).collect() == []


def test_main_path_has_no_python(spark):
    df = spark.createDataFrame(some_rows(20), SCHEMA)
    plan = exact.mark_copies(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
