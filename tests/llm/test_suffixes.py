import random

import numpy as np
import pytest

from parlance.llm import suffixes
from parlance.llm.suffixes import LENGTH


def restated(rows):
    seen, out = set(), []
    for i, t in sorted(((i, t) for i, t in rows if i is not None), key=lambda r: r[0]):
        body = (t or "").encode()
        gone = np.zeros(len(body), bool)
        for s in range(len(body) - LENGTH + 1):
            x = body[s:s + LENGTH]
            if x in seen:
                gone[s:s + LENGTH] = True
            seen.add(x)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((i, len(body), int(gone.sum()), spans, bytes(np.frombuffer(body, np.uint8)[~gone])))
    return out


def got(spark, rows, **settings):
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, starts string").repartition(3)
    out = suffixes.remove_repeats(df, keep=["doc_id", "starts"], **settings).filter("doc_id IS NOT NULL").orderBy("doc_id").collect()
    return [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in out]


@pytest.fixture(scope="module")
def family():
    rnd = random.Random(11)
    line = "".join(rnd.choice("abcdef é") for _ in range(60))
    base = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(900))
    texts = [None, "", "short", "a" * 500, "a" * 350, "ab" * 200, "\x00" * 260, base, base + base[:400], base[::-1]]
    for _ in range(30):
        t = base
        for _ in range(rnd.randint(0, 4)):
            a = rnd.randrange(len(t))
            t = t[:a] + rnd.choice(["", "X", "yy", line]) + t[a + rnd.randint(0, 30):]
        texts.append(t)
    for n in range(20):
        own = ["".join(rnd.choice("qrstuvw ") for _ in range(rnd.randint(20, 150))) for _ in range(2)]
        texts.append(own[0] + line + ("" if n % 3 else line) + own[1])
    rnd.shuffle(texts)
    return list(enumerate(texts))


def test_equals_brute_force(spark, family):
    assert got(spark, family + [(None, family[0][1])]) == restated(family)


def test_many_partitions_and_frequent_anchors_change_nothing(spark, family):
    assert got(spark, family, entries=20) == restated(family)
    assert got(spark, family, wide=3) == restated(family)
    assert got(spark, family, wide=0, entries=50) == restated(family)


def test_repeated_rows_and_empty_tables(spark):
    rnd = random.Random(1)
    text = "".join(rnd.choice("abcdefgh") for _ in range(300))
    assert [r[2] for r in got(spark, [(1, text), (1, text), (2, text), (2, text)])] == [0, 0, 300, 300]
    assert got(spark, []) == [] and got(spark, [(1, None)]) == [(1, 0, 0, 0, b"")]


def test_merge_keeps_order_and_shared_prefixes():
    rnd = np.random.default_rng(3)
    for runs in (1, 2, 3, 5, 8):
        parts = []
        for _ in range(runs):
            rows = rnd.integers(0, 2, (rnd.integers(0, 40), 12)).astype(np.uint8)
            rows = rows[np.lexsort(rows.T[::-1])]
            parts.append((rows, suffixes.common_prefixes(rows)))
        which, row, lcp = suffixes.merge(parts)
        merged = np.array([parts[w][0][r] for w, r in zip(which, row)]).reshape(-1, 12)
        everything = sorted(bytes(r) for p, _ in parts for r in p)
        assert [bytes(r) for r in merged] == everything
        assert np.array_equal(lcp, suffixes.common_prefixes(merged))


def test_runs_survive_front_coding():
    rnd = np.random.default_rng(5)
    n = 200
    entries = suffixes.Entries(
        rnd.integers(97, 99, (n, LENGTH)).astype(np.uint8), rnd.integers(97, 99, (n, LENGTH - suffixes.GRAM)).astype(np.uint8),
        np.full(n, LENGTH, np.uint8), np.full(n, 3, np.uint8), np.arange(n), np.arange(n, dtype=np.int32))
    whole, *_ = suffixes.collapse(entries)
    back, lcp = suffixes.decode_run(suffixes.encode_run(whole))
    assert np.array_equal(back.rows(), whole.rows()) and np.array_equal(back.key, whole.key)
    assert np.array_equal(lcp, suffixes.common_prefixes(whole.right))


def test_every_string_holds_an_anchor():
    rnd = random.Random(2)
    texts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 400))) for _ in range(20)] + [b"a" * 300]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    _, at, _ = suffixes.anchor_places(data, offsets)
    for a, b in zip(offsets, offsets[1:]):
        for s in range(a, b - LENGTH + 1):
            assert ((at >= s) & (at + suffixes.GRAM <= s + LENGTH)).any()


def test_ranges_of_starts_are_united():
    rnd = np.random.default_rng(5)
    for n in (0, 1, 40):
        key, lo = rnd.integers(0, 4, n), rnd.integers(0, 60, n)
        hi = lo + rnd.integers(0, 9, n)
        places = {(k, x) for k, a, b in zip(key, lo, hi) for x in range(a, b + 1)}
        made = list(zip(*suffixes.united(key, lo, hi)))
        listed = [(k, x) for k, a, b in made for x in range(a, b + 1)]
        assert len(listed) == len(set(listed)) and set(listed) == places
        assert not any((k, b + 1) in places for k, _, b in made)


def test_ranges_are_cut_behind_a_frequent_beginning(spark):
    """Suffixes that all begin with the same 16 bytes are dealt over several partitions."""
    rnd = random.Random(3)
    tails = ["".join(rnd.choice("abcdefgh") for _ in range(90)) for _ in range(60)]
    rows = [(i, (" " * 16 + tails[i % 60]) * 2) for i in range(150)]
    assert got(spark, rows, entries=50) == restated(rows)
    df = spark.createDataFrame(rows, "_key long, _t string")
    gs = suffixes.anchors.repeated_counted(suffixes._anchors(df), suffixes.WIDE)
    cuts = suffixes._splitters(df.join(gs, "_key"), 150, 10_000, 40)
    assert len({c[:8] for c in cuts}) < len(cuts)
