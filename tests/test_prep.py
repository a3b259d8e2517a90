import math
import re
import uuid

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from parlance.functions.text import SPACE, strip, word_tokens
from parlance.functions.vectors import _slot_and_sign, cosine
from parlance.operators import prep
from parlance.schemas import CHUNK
from parlance.sources.files import inline_documents


def docs(spark, texts):
    return inline_documents(spark, [
        {"doc_id": f"d{i}", "doc_title": f"T{i}", "source_uri": f"u{i}", "raw_text": t} for i, t in enumerate(texts)])


def chunks_by_hand(text, size, overlap):
    words = (text or "").split()
    return [" ".join(words[i:i + size]) for i in range(0, len(words), size - overlap)]


def test_white_space_is_the_unicode_set(spark):
    chars = [chr(i) for i in range(0x10000) if not 0xD800 <= i <= 0xDFFF]
    rows = spark.createDataFrame([(c,) for c in chars], "c string").filter(F.col("c").rlike(f"(?U)^{SPACE}$")).collect()
    assert {r.c for r in rows} == {c for c in chars if c.isspace()}


def test_word_tokens_match_python(spark):
    text = "Ça va_bien, 3XL! नमस्ते i'm ചുരിദാർ"
    got = spark.createDataFrame([(text,)], "t string").select(word_tokens(F.col("t"))).first()[0]
    assert got == re.findall(r"\w+", text.lower())


def test_chunks_of_512_words(spark):
    got = prep.chunk_documents(docs(spark, [" ".join(["w"] * 512)])).orderBy("chunk_index").collect()
    assert [r.token_count for r in got] == [512, 50]
    assert [r.chunk_id for r in got] == ["d0_chk_0", "d0_chk_1"]


def test_chunk_schema_and_small_documents(spark):
    out = prep.chunk_documents(docs(spark, ["one two three " * 40, "x", None, " \t\n　"]), 50, 10)
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in CHUNK]
    rows = out.collect()
    assert {r.doc_id for r in rows} == {"d0", "d1"}
    assert all(r.content and r.token_count > 0 for r in rows)


@pytest.mark.parametrize("size,overlap", [(50, 50), (10, 20), (0, 0), (5, -1)])
def test_endless_chunking_is_refused(spark, size, overlap):
    with pytest.raises(ValueError):
        prep.chunk_documents(docs(spark, ["a b"]), size, overlap)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t ", max_size=80), min_size=1, max_size=4),
       st.integers(2, 7), st.integers(0, 1))
def test_chunks_match_a_plain_restatement(spark, texts, size, overlap):
    got = {}
    for r in prep.chunk_documents(docs(spark, texts), size, overlap).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r.content)
    want = {f"d{i}": chunks_by_hand(t, size, overlap) for i, t in enumerate(texts)}
    assert got == {k: v for k, v in want.items() if v}


PARAGRAPHS = [
    ("a", 0, "intro", False), ("a", 1, "1. First", False), ("a", 2, "x", False), ("a", 3, "y", False),
    ("a", 4, "2. Empty", False), ("a", 5, "Styled", True), ("a", 6, "z", False), ("b", 0, "3 no dot near", False)]


@pytest.mark.parametrize("max_rows", [1000, 2])
def test_sections(spark, max_rows):
    paragraphs = spark.createDataFrame(PARAGRAPHS, "doc_id string, pos int, text string, is_heading boolean")
    got = prep.section_documents(paragraphs, "Base", max_rows).orderBy("doc_id").collect()
    assert [(r.doc_id, r.doc_title, r.raw_text) for r in got] == [
        ("a_SEC_1", "Base", "intro"), ("a_SEC_2", "1. First", "x y"), ("a_SEC_3", "Styled", "z"),
        ("b_SEC_1", "Base", "3 no dot near")]


def test_feature_hashing_matches_a_plain_restatement(spark):
    texts = ["red cotton red", "", "Ünïcode wörds 12"]
    df = spark.createDataFrame([(t,) for t in texts], "content string")
    from parlance.functions.vectors import hash_embedder
    got = [r.embedding for r in prep.embed(df, embedder=hash_embedder(16)).collect()]
    for text, vector in zip(texts, got):
        want = [0.0] * 16
        for token in re.findall(r"\w+", text.lower()):
            slot, sign = _slot_and_sign(token, 16)
            want[slot] += sign
        norm = math.sqrt(sum(x * x for x in want))
        assert vector == pytest.approx([x / norm if norm else 0.0 for x in want], abs=1e-6)


def test_embedding_is_the_same_in_every_partition(spark):
    df = spark.createDataFrame([("same text",)] * 8, "content string").repartition(4)
    assert len({tuple(r.embedding) for r in prep.embed(df).collect()}) == 1


def test_a_callers_embedder_is_used(spark):
    df = spark.createDataFrame([("abc",)], "content string")
    assert prep.embed(df, embedder=lambda c: F.array(F.length(c).cast("float"))).first().embedding == [3.0]


def test_point_ids_are_rfc_uuids(spark):
    df = spark.createDataFrame([("d_chk_0",), ("Ж_chk_1",)], "chunk_id string")
    for r in prep.with_point_id(df).collect():
        assert r.point_id == str(uuid.uuid5(uuid.NAMESPACE_DNS, r.chunk_id))


def test_facts(spark):
    facts = spark.createDataFrame([("F1", "Fee", "is fifty"), ("F2", "Fee", "Fee is fifty")],
                                  "doc_id string, title string, content string")
    got = {r.chunk_id: (r.content, r.token_count) for r in prep.facts_to_chunks(facts).collect()}
    assert got == {"F1_chk_0": ("Fee: is fifty", 2), "F2_chk_0": ("Fee is fifty", 3)}


def test_cosine_edges(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), ([1.0, 1.0], [1.0, 0.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    got = [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([1.0, 0.0, 0.0, math.sqrt(0.5)])


def test_strip(spark):
    df = spark.createDataFrame([("  a b\x1c",)], "t string")
    assert df.select(strip(F.col("t"))).first()[0] == "a b"


def test_embedding_a_large_batch_takes_little_beside_the_vectors():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from parlance.functions.vectors import hashed_vectors
    words = np.array([f"w{i}" for i in range(50)])
    lists = [words[np.arange(i, i + 100) % 50].tolist() for i in range(4000)]
    tokens = pa.array(lists)
    tracemalloc.start()
    made = hashed_vectors(tokens, 64, {})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * made.nbytes
    some = [0, 255, 256, 257, 3999]
    assert np.array_equal(made[some], np.concatenate([hashed_vectors(pa.array([lists[i]]), 64, {}) for i in some]))


def test_a_task_remembers_few_tokens_of_a_large_vocabulary():
    import numpy as np
    import pyarrow as pa

    from parlance.functions import vectors as V
    known = {}
    for part in range(3):  # 120 000 words that come once each, then one list longer than a slice
        tokens = pa.array([[f"w{part}-{i}-{j}" for j in range(400)] for i in range(100)] + [["again"] * (V.SLICE_TOKENS + 1)])
        made = V.hashed_vectors(tokens, 16, known)
        assert len(known) <= V.KNOWN_TOKENS + V.SLICE_TOKENS
        some = [0, 81, 82, 99, 100]
        assert np.array_equal(made[some], np.concatenate([V.hashed_vectors(tokens.slice(i, 1), 16, {}) for i in some]))


def test_vectors_are_handed_on_by_slices():
    import pyarrow as pa

    from parlance.functions import vectors as V
    batches = [pa.array([["a", "b"]] * 700, pa.list_(pa.string())), pa.array([], pa.list_(pa.string())), pa.array([[], ["c"]], pa.list_(pa.string()))]
    made = list(V.hashed_lists(iter(batches), 8))
    assert max(map(len, made)) == V.SLICE_ROWS and sum(map(len, made)) == 702
    assert made[-1].to_pylist() == V.hashed_vectors(batches[2], 8, {}).tolist()
