"""Rule counts against plain Python and SQL, the forest against a plain walk, verdicts on labelled rows."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from parlance.llm import anomalies as Q
from parlance.llm.common import held_out, view

MIDDLE = SMALL.replace("sf0.001", "sf0.1")
SPACE = "[\x20\x09-\x0d]+"


def by_hand(text):
    text = text or ""
    words = [w for w in re.split(SPACE, text) if w]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    n, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if n[w] > 1:
            covered |= set(range(i, i + 8))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))


def random_texts(n, seed):
    rng = random.Random(seed)
    pool = ["a", "bb", "é", "你好", "x#", "|", "<>", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "end.", "🙂", "\xa0"]
    block = " ".join("r%d" % i for i in range(9))
    texts = ["".join(rng.choice(pool) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(30))) for _ in range(n)]
    texts += [f"{block} x {block}", f"{block}\n{block}\n", f"{block} {block} {block}", "a b c d e f g h a b c d e f g h a", "", None, "\n", " \n \n", "same\nsame\nsame \nsame"]
    rng.shuffle(texts)
    return texts


def test_counts_of_random_texts():
    texts = random_texts(1500, 3)
    counts, statistics = Q.measure(*view(pa.array([t or "" for t in texts])))
    assert [tuple(c) for c in counts.tolist()] == [by_hand(t) for t in texts]
    assert np.isfinite(statistics).all() and statistics.shape == (len(texts), len(Q.STATISTICS))


def test_a_text_measures_the_same_alone():
    texts = [t or "" for t in random_texts(60, 4)]
    _, together = Q.measure(*view(pa.array(texts)))
    alone = np.vstack([Q.measure(*view(pa.array([t])))[1] for t in texts])
    assert np.array_equal(together, alone)


def test_base_columns_equal_sql(spark):
    rows = Q.measured(spark.read.parquet(f"{SMALL}/documents.parquet")).drop("statistics")
    sql = f"""
    WITH w AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'),
            lambda x: x <> '') AS ws FROM '{SMALL}/documents.parquet'),
    k AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS s, ws FROM w WHERE len(ws) >= 8),
    g AS (SELECT doc_id, s, array_to_string(ws[s:s + 7], ' ') AS x FROM k),
    r AS (SELECT DISTINCT doc_id, s + unnest(range(0, 8)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS n FROM g) WHERE n > 1),
    l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w),
    d AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1)
    SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(d.n, 0) AS n_dup_lines,
        (SELECT count(*) FROM r WHERE r.doc_id = w.doc_id) AS n_repeat_words,
        len(ws) < 20 OR 100 * (SELECT count(*) FROM r WHERE r.doc_id = w.doc_id) > 30 * len(ws) AS base_failed
    FROM w LEFT JOIN d USING (doc_id)"""
    assert sorted(map(tuple, rows.collect())) == sorted(duckdb.sql(sql).fetchall())


def walked(forest, row):
    paths = []
    for root in forest.roots:
        node = root
        while forest.children[node][0] != node:
            node = forest.children[node][int(row[forest.feature[node]] > forest.cut[node])]
        paths.append(forest.path[node])
    return 2 ** (-np.mean(paths) / forest.expected)


def test_scores_are_path_lengths():
    rng = np.random.default_rng(2)
    rows = np.vstack([rng.normal(0, 1, (400, 3)), [[9, 9, 9]], np.zeros((50, 3))])
    forest = Q.Forest.grown(rows[rng.permutation(len(rows))], 32)
    scores = forest.scores(rows)
    assert np.allclose(scores, [walked(forest, r) for r in rows]) and scores.argmax() == 400
    assert len(forest.roots) == -(-len(rows) // 32)


@pytest.mark.parametrize("rows", [np.zeros((0, 2)), np.zeros((1, 2)), np.ones((100, 2))])
def test_forests_without_splits(rows):
    scores = Q.Forest.grown(rows, 16).scores(np.array([[0.0, 5.0], [1.0, 1.0]]))
    assert scores[0] == scores[1]


def test_expected_path_of_small_trees():
    # A tree of three rows: mean depth (1 + 2 + 2) / 3; the formula takes the logarithm for the harmonic number.
    assert Q.expected_path(np.array([0, 1, 2])).tolist() == [0, 0, 1] and abs(Q.expected_path(np.array([256]))[0] - 10.24) < 0.01


def test_labelled_rows(spark):
    docs, labels = spark.read.parquet(f"{MIDDLE}/documents.parquet"), spark.read.parquet(f"{MIDDLE}/labels.parquet")
    rows = Q.judge(docs, labels).join(labels, "doc_id").filter(held_out())
    good, bad = [rows.filter((F.col("quality") == q) & ~F.col("base_failed")).agg(
        F.avg(F.col("kept").cast("int")), F.count(F.lit(1))).first() for q in (1, 0)]
    assert good[1] > 500 and bad[1] > 40
    assert good[0] > 0.99 and bad[0] < 0.1


def test_no_rows_no_labels_nulls_repeats_extra_columns(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    schema = "doc_id long, text string, score double, statistics string, _row int"
    assert Q.judge(spark.createDataFrame([], schema), labels).collect() == []
    text = "word " * 10 + " ".join(f"w{i}." for i in range(30))
    made = Q.judge(spark.createDataFrame([(None, text, 1.0, "s", 1), (1, text, 2.0, "s", 1), (1, text, 2.0, "s", 1), (2, None, None, None, None)], schema), labels)
    assert made.columns == ["doc_id", *Q.COUNTS, "base_failed", "score", "kept"]
    rows = made.collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["kept"]) for r in rows) == [(0, 40, True), (1, 40, True), (1, 40, True), (2, 0, False)]
    with pytest.raises(ValueError):
        Q.measured(made, text="kept", keep=["doc_id", "score"])


def test_labels_with_nulls_and_both_classes(spark):
    scored = spark.createDataFrame([(i, i / 100, False) for i in range(100)], "doc_id long, score double, base_failed boolean")
    labels = spark.createDataFrame([(i, 0 if i >= 90 else 1) for i in range(100)] + [(None, 1), (5, None), (95, 1), (95, 0)], "doc_id long, quality int")
    cut = Q.threshold_of(scored, labels)
    assert 0.89 < cut <= 0.92
    kept = {r["doc_id"] for r in Q.verdicts(scored, cut).filter("kept").collect()}
    assert kept >= set(range(89)) and not kept & set(range(93, 100))


def test_a_very_long_text(spark):
    rows = Q.measured(spark.createDataFrame([(1, "abc. " * 600_000), (2, "x y")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["n_words"] for r in rows] == [600_000, 2] and rows[0]["n_repeat_words"] == 600_000
