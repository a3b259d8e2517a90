import random
import re

import pytest

from parlance.llm import repeats

SCHEMA = "doc_id long, text string, _key string"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def restated(rows, k):
    first = {}
    for i, t, *_ in rows:
        w = words_of(t)
        for s in range(len(w) - k + 1) if i is not None else ():
            x = tuple(w[s:s + k])
            first[x] = min(first.get(x, i), i)
    out = []
    for i, t, *_ in rows:
        w = words_of(t)
        gone = set()
        for s in range(len(w) - k + 1) if i is not None else ():
            if first[tuple(w[s:s + k])] < i:
                gone |= set(range(s, s + k))
        out.append((i, len(w), len(gone), " ".join(x for n, x in enumerate(w) if n not in gone)))
    return sorted(out, key=str)


def got(spark, rows, k, m):
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA).repartition(3)
    out = repeats.remove_repeats(df, window=k, anchor=m, keep=["doc_id", "_key"])
    assert out.columns == ["doc_id", "_key", "n_words", "n_removed", "kept_text"]
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in out.collect()), key=str)


def family(rnd, vocabulary, copies, length):
    """Copies of a text with words changed, cut out, put in and moved."""
    base = [rnd.choice(vocabulary) for _ in range(length)]
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(rnd.randint(0, 4)):
            a = rnd.randrange(len(w))
            w[a:a + rnd.randint(0, 2)] = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 3))]
        if rnd.random() < 0.3:
            a = rnd.randrange(len(w))
            w = w[a:] + w[:a]
        out.append(rnd.choice([" ", "\n", "  \t"]).join(w))
    return out


@pytest.mark.parametrize("k, m, size", [(13, 5, 400), (4, 2, 6), (5, 5, 12), (3, 1, 3)])
def test_random_families_equal_brute_force(spark, k, m, size):
    rnd = random.Random(k)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(size)]
    texts = [t for n in (1, 3, 8, 25) for t in family(rnd, vocabulary, n, rnd.choice([k, 20, 60]))]
    texts += [None, "", " \n", "one", " ".join(["the"] * 40), " ".join(["the"] * 30), texts[-1], texts[-1] + "\x0b" + texts[0]]
    rnd.shuffle(texts)
    rows = list(enumerate(texts)) + [(None, texts[0]), (None, texts[0])]
    assert got(spark, rows, k, m) == restated(rows, k)


def test_repeated_rows_are_treated_alike(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(20)) for c in "ab")
    rows = [(1, a), (1, a), (2, f"{b} {a}"), (2, f"{b} {a}")]
    out = got(spark, rows, 13, 5)
    assert [(r[0], r[2]) for r in out] == [(1, 0), (1, 0), (2, 20), (2, 20)]


def test_empty_table(spark):
    assert got(spark, [], 13, 5) == []
    with pytest.raises(ValueError):
        got(spark, [], 3, 4)


def test_long_texts_and_spans(spark):
    rnd = random.Random(8)
    shared = " ".join(f"x{rnd.randrange(10**6)}" for _ in range(60_000))
    rows = [(1, shared), (2, "new " + shared + " end")]
    spans = repeats.repeated_spans(spark.createDataFrame([(i, t, "") for i, t in rows], SCHEMA)).collect()
    # One span: source and target advance together all the way.
    assert [(r["doc_id"], r["lo"], r["hi"], r["src"], r["src_lo"]) for r in spans] == [(2, 1, 60_001, 1, 0)]
