import random
import re

import numpy as np
import pytest

from parlance.llm import graph, near

SCHEMA = "doc_id long, text string, _row string"


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def restated(rows, size, percent=80):
    sets = {i: shingles(t, size) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return [(i, len(sets[i]), root(i), root(i) == i) for i in ids]


def got(df, **settings):
    return [tuple(r) for r in near.components_of(df, **settings).orderBy("doc_id").collect()]


def family(rnd, copies, length, most):
    base = [f"w{rnd.randrange(10**5)}" for _ in range(length)]
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(rnd.randint(0, most)):
            w[rnd.randrange(length)] = f"v{rnd.randrange(10**5)}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(6)
    texts = [t for copies, length, most in ((60, 150, 20), (40, 80, 5), (10, 30, 3), (30, 300, 40)) for t in family(rnd, copies, length, most)]
    texts += [None, "", " ", "one two", "One  TWO", "one two three", "one", texts[0], texts[0].upper()]
    rnd.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("size", [4, 5])
def test_equals_brute_force(spark, rows, size):
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA)
    assert got(df, size=size) == restated(rows, size)


def test_small_blocks_and_shuffled_sets_change_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 3)
    monkeypatch.setattr(near, "BROADCAST_KEYS", -1)
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA)
    assert got(df, size=4) == restated(rows, 4)


def test_null_keys_repeats_and_empty_tables(spark):
    text = "a b c d e f g"
    df = spark.createDataFrame([(None, text, ""), (3, text, ""), (3, text, ""), (5, text, ""), (6, "x", "")], SCHEMA)
    out = sorted((tuple(r) for r in near.components_of(df).collect()), key=str)
    assert out == sorted([(None, 3, None, True), (3, 3, 3, True), (3, 3, 3, True), (5, 3, 3, False), (6, 1, 6, True)], key=str)
    kept = near.keep_one(df)
    assert kept.columns == df.columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == [3, 3, 6, None]
    assert got(df.limit(0)) == []


def test_registers_merge_and_estimates_are_close():
    rnd = np.random.default_rng(1)
    for j in (0.3, 0.6, 0.8, 0.95):
        n, trials, found = 400, 60, []
        for _ in range(trials):
            both = int(round(2 * n * j / (1 + j)))
            pool = rnd.integers(0, 1 << 63, 2 * n - both).astype(np.uint64)
            a, b = np.unique(pool[:n]), np.unique(pool[n - both:])
            ra, rb, rab = near.sketches([a, b, np.unique(pool)])
            assert np.array_equal(np.maximum(ra, rb), rab)
            found.append(near.similarity(np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()]), np.array([len(a)]), np.array([len(b)]))[0])
        assert abs(np.mean(found) - j) < 0.03 and np.std(found) < 0.08


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 150)] + [(7, 7)]
    out = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 150)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []
