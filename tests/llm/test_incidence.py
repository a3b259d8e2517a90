"""Token links against plain loops over byte ranges."""

import bisect
import functools
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from conftest import SMALL
from parlance.llm import incidence as I

A = I.byte_level("/opt/tokenizers/byte_bpe_50k.json")
B = I.sentence_pieces("/opt/tokenizers/piece_bpe_32k.model")


@functools.cache
def plain_models():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")


def token_bytes(side, i):
    t = (A, B)[side]
    return t.flat[t.starts[i]:t.starts[i] + t.sizes[i]].tobytes()


def by_hand(texts):
    """Per text n_a, n_b, n_groups, n_links, n_shared, groups, n_best, count_sum."""
    first, second = plain_models()
    rows = []
    for text in texts:
        if not text:
            rows.append(([], [], [], []))
            continue
        sides = [first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)]
        if any(b"".join(token_bytes(s, i) for i in ids) != (" " + text).encode() for s, ids in enumerate(sides)):
            rows.append(([], [], [], []))
            continue
        spans = []
        for s, ids in enumerate(sides):
            at, mine = 0, []
            for i in ids:
                mine.append((at, at + len(token_bytes(s, i)), i))
                at = mine[-1][1]
            spans.append(mine)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        owner = [[t for t, (lo, hi, _) in enumerate(mine) for _ in range(lo, hi)] for mine in spans]
        links = [(sides[0][x], sides[1][y]) for x, y in sorted(set(zip(*owner)))]
        groups = [[[], []] for _ in cuts]
        for s, mine in enumerate(spans):
            for _, hi, i in mine:
                groups[bisect.bisect_left(cuts, hi)][s].append(i)
        rows.append((*sides, links, groups))
    n = Counter(p for _, _, links, _ in rows for p in set(links))
    most = defaultdict(int)
    for (i, _), c in n.items():
        most[i] = max(most[i], c)
    return [(len(a), len(b), len(groups), len(links), sum(len(x) * len(y) for x, y in groups),
             ";".join("|".join(",".join(map(str, x)) for x in g) for g in groups),
             sum(n[p] == most[p[0]] for p in links), sum(n[p] for p in links)) for a, b, links, groups in rows]


FIELDS = ["n_a", "n_b", "n_groups", "n_links", "n_shared", "groups", "n_best", "count_sum"]


def run(spark, texts, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [tuple(r[c] for c in FIELDS) for r in I.link_tokens(docs, A, B, **more).orderBy("doc_id").collect()]


TEXTS = ["The quick brown fox", "The quick brown fox", None, "", " ", "naïve café – 你好世界 🙂🙃", "a▁b", "<|endoftext|> <s> </s> <unk>", "x\x00y",
         "tokens\r\n\n\tand   spaces   ", "é" * 50, "0123456789" * 30, "<0x41> <0xZZ>", "ſtraße ǅ", "Ａ full width", "a" * 3000]


def test_equals_plain_loops(spark):
    want = by_hand(TEXTS)
    assert run(spark, TEXTS) == want
    assert sum(w[0] > 0 for w in want) >= 11 and want[6][0] == 0


@pytest.mark.parametrize("head", [0, 7])
def test_pairs_beyond_the_head_are_joined(spark, head):
    assert run(spark, TEXTS, head=head) == by_hand(TEXTS)


def test_given_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id")
    texts = [r["text"] for r in docs.select("text").collect()]
    made = [tuple(r[c] for c in FIELDS) for r in I.link_tokens(docs, A, B, head=100).orderBy("doc_id").collect()]
    assert made == by_hand(texts)


def test_long_text_crosses_no_slice(spark):
    texts = ["one two three " * 100_000, "one two"]
    made = run(spark, texts)
    assert made[0][0] == len(plain_models()[0].encode(" " + texts[0], add_special_tokens=False).ids) and made[1] == by_hand(["one two", texts[1]])[1][:7] + (made[1][7],)


def test_no_rows_null_keys_extra_columns(spark):
    schema = "doc_id long, text string, n_a int, _row string, _pairs string"
    assert I.link_tokens(spark.createDataFrame([], schema), A, B).collect() == []
    made = I.link_tokens(spark.createDataFrame([(None, "a b", 1, "r", "p"), (None, "a b", 2, "r", "p")], schema), A, B, keep=["doc_id", "_row"])
    assert made.columns == ["doc_id", "_row", "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups", "n_best", "count_sum"]
    rows = made.collect()
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0]["count_sum"] == 2 * rows[0]["n_links"]
    with pytest.raises(ValueError):
        I.align_documents(made, A, B, text="groups", keep=["n_a"])


def test_two_byte_ranges_and_all_bytes():
    every = "".join(map(chr, range(1, 256)))
    data = (" " + every).encode()
    found = I.align([" " + every], np.frombuffer(data, np.uint8), np.array([0, len(data)]), A, B)
    assert found.counts[0][0] > 0 and found.overlap.data.sum() == len(data)
    assert np.array_equal(found.shared_sizes(), np.diff(found.shared().starts))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(st.characters(codec="utf-8"), max_size=20), st.sampled_from([A.flat[a:a + n].tobytes().decode("utf8", "ignore")
       for a, n in zip(A.starts[::37], A.sizes[::37])])), max_size=12).map("".join))
def test_ids_by_rank_are_those_of_the_json_form(text):
    assert A.kind == "ranks" and A.encode([text])[0].tolist() == plain_models()[0].encode(text, add_special_tokens=False).ids


def test_another_form_goes_by_its_library(tmp_path):
    import json
    form = json.load(open("/opt/tokenizers/byte_bpe_50k.json"))
    form["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "lower.json").write_text(json.dumps(form))
    lower = I.byte_level(str(tmp_path / "lower.json"))
    assert lower.kind == "json" and lower.encode([" The"])[0].tolist() == A.encode([" the"])[0].tolist()


matrices = st.integers(1, 6).flatmap(lambda k: st.tuples(
    st.lists(st.lists(st.integers(0, 3), min_size=k, max_size=k), min_size=1, max_size=6),
    st.integers(1, 5).flatmap(lambda w: st.lists(st.lists(st.integers(0, 3), min_size=w, max_size=w), min_size=k, max_size=k))))


def csr(rows):
    m = np.array(rows)
    if m.max() <= 1:
        return I.Csr(np.concatenate([[0], np.cumsum(m.sum(1))]), np.nonzero(m)[1], m.shape[1])
    at = np.nonzero(m)
    return I.Csr(np.concatenate([[0], np.cumsum((m != 0).sum(1))]), at[1], m.shape[1], m[at])


def dense(c):
    out = np.zeros((c.height, c.width), int)
    out[np.repeat(np.arange(c.height), np.diff(c.starts)), c.columns] = 1 if c.data is None else c.data
    return out


@settings(max_examples=200, deadline=None)
@given(matrices, st.sampled_from([1, 5, 1000]))
def test_products(pair, most):
    left, right = csr(pair[0]), csr(pair[1])
    made = I.multiply(left, right, most)
    assert np.array_equal(dense(made), np.array(pair[0]) @ np.array(pair[1]))
    assert len(made.columns) == np.count_nonzero(dense(made)) and np.array_equal(dense(right.transposed()), np.array(pair[1]).T)
