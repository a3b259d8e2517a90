import random
import re

import pytest

from conftest import SMALL
from parlance.llm import privacy

# The patterns as they are given.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        doubled = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    spans = [(m.start(), list(PATTERNS).index(k), m.end(), k) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m.group())]
    return [(a, b, k) for a, _, b, k in sorted(spans)]


def test_base_spans_on_random_texts():
    rnd = random.Random(5)
    for _ in range(20_000):
        text = "".join(rnd.choice("0123456789..@+ -()ab%é") for _ in range(rnd.randint(0, 60)))
        assert privacy.base_spans(text) == plain(text)


def test_examples():
    text = "é a.b+c@x-y.example.org, 10.0.0.255 and 256.1.1.1, 4111 1111 1111 1111, +49 (30) 123-4567"
    assert [text[a:b] for a, b, _ in privacy.base_spans(text)] == [
        "a.b+c@x-y.example.org", "10.0.0.255", "4111 1111 1111 1111", "+49 (30) 123-4567"]


@pytest.mark.parametrize("text", ["1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" * 50_000, "@" * 100_000, "0 " * 50_000])
def test_long_texts_take_linear_time(text):
    privacy.scan_text(text)


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.read.parquet(SMALL + "/documents.parquet")
    model = privacy.fit(docs, least_spans=1, precision=0.5)
    return docs, model, privacy.find(docs, model)


def test_base_spans_stay_and_spans_are_ordered(found):
    docs, _, out = found
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = out.collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = [tuple(s) for s in r["base"]]
        spans = [tuple(s) for s in r["spans"]]
        assert base == plain(texts[r["doc_id"]]) and set(base) <= set(spans)
        assert spans == sorted(spans, key=lambda s: (s[0], privacy.KINDS.index(s[2])))
        assert [r[f"n_{k}"] for k in privacy.KINDS] == [sum(s[2] == k for s in base) for k in privacy.KINDS]
        extra = [s for s in spans if s not in base]
        assert all(a[1] <= b[0] or b[1] <= a[0] for a in extra for b in spans if a != b)


def test_accepted_proposals_join_the_base_spans(spark, found):
    _, model, _ = found
    loose = privacy.SpanModel(model.trees, {k: 0.0 for k in privacy.KINDS})
    docs = spark.createDataFrame([(1, "call 030 1234567 or 4111 1111 1111 1112"), (2, None), (2, ""), (None, "x")], "doc_id long, text string")
    rows = privacy.find(docs, loose).collect()
    assert len(rows) == 4
    assert [len(r["spans"]) for r in rows if r["doc_id"] == 1] == [2] and all(not r["base"] for r in rows)


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    model = privacy.fit(empty)
    assert model.thresholds == {} and privacy.find(empty, model).collect() == []


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co now", "k"), (2, None, "k")], "doc_id long, text string, _k string")
    found = privacy.find(docs, privacy.SpanModel(None, {}))
    out = privacy.redact(docs, found)
    assert out.columns == docs.columns
    assert sorted(tuple(r) for r in out.collect()) == [(1, "mail [EMAIL] now", "k"), (2, None, "k")]


def test_written_out_address_is_added_at_fitted_thresholds(spark):
    rows = []
    for i in range(900):
        rows += [f"mail to user{i}@site{i % 50}.org today", f"the session root{i}@node{i} is open"]
        if i % 3 == 0:
            rows.append(f"9 please write to bob{i} (at) corp{i % 50}.com today")
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    model = privacy.fit(docs)
    assert "email" in model.thresholds
    new = spark.createDataFrame([(1, "please write to ann (at) example.com today"), (2, "the session ann@node is open")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in privacy.find(new, model).collect()}
    assert not out[1]["base"] and [s["kind"] for s in out[1]["spans"]] == ["email"] and not out[2]["spans"]


def test_made_forms_are_positives_and_plausible_ones_no_negatives():
    text = "mail a@b.co, host 10.0.0.1, card 4111 1111 1111 1111, call +49 30 1234567"
    made = [x for x in privacy.lessons(text) if x["free"] and x["y"] == 1]
    assert {x["kind"] for x in made} == set(privacy.KINDS)
    assert privacy.lessons("write a (at) b.co or 10[.]0[.]0[.]1") == []
    assert [x["y"] for x in privacy.lessons("see 999[.]0[.]0[.]1 x") if x["kind"] == "ip"] == [0.0]


def test_every_text_counts_however_many_there_are(spark):
    # Few spans among more than twenty thousand texts: enough of them to set a threshold, unless some are passed over.
    rows = ["chapter 9"] * 45_000
    rows += [text for i in range(150) for text in (f"mail to user{i}@site{i % 50}.org today", f"the session root{i}@node{i} is open")]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    model = privacy.fit(docs)
    assert "email" in model.thresholds
    new = spark.createDataFrame([(1, "please mail to ann (at) example.com today"), (2, "the session ann@node is open")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in privacy.find(new, model).collect()}
    assert [s["kind"] for s in out[1]["spans"]] == ["email"] and not out[2]["spans"]
