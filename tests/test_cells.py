"""Cells against the scan of all vectors."""

import numpy as np
import pytest

from parlance.operators import cells as C, retrieval as R


def table(spark, vectors, name, prefix):
    return spark.createDataFrame([(f"{prefix}{i:04d}", None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)],
                                 f"{name} string, embedding array<float>")


def clustered(rng, n, dims=16, clusters=12, width=0.03):
    middle = rng.normal(size=(clusters, dims))
    return middle[rng.integers(0, clusters, n)] + rng.normal(size=(n, dims)) * width


def rows(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 7)) for r in df.collect())


def both(spark, tmp_path, vectors, asked, k=5, cells=None):
    index, queries = table(spark, vectors, "chunk_id", "c").cache(), table(spark, asked, "query_id", "q").cache()
    C.build_cells(index, str(tmp_path / "i"), cells)
    return rows(C.cells_topk(queries, str(tmp_path / "i"), k)), index, queries


def test_equals_the_scan_and_reads_few_cells(spark, tmp_path):
    rng = np.random.default_rng(3)
    vectors = clustered(rng, 1500)
    made, index, queries = both(spark, tmp_path, vectors, vectors[::100] + rng.normal(size=(15, 16)) * 0.01)
    assert made == rows(R.dense_topk(index, queries, 5))
    reads = C.cell_reads(queries, str(tmp_path / "i"), 5).collect()
    assert len(reads) == 15 and np.mean([r["share"] for r in reads]) < 0.3


def test_spread_directions_are_still_exact(spark, tmp_path):
    rng = np.random.default_rng(4)
    made, index, queries = both(spark, tmp_path, rng.normal(size=(300, 24)), rng.normal(size=(10, 24)), k=7, cells=9)
    assert made == rows(R.dense_topk(index, queries, 7))


def test_ties_zero_null_and_other_lengths(spark, tmp_path):
    rng = np.random.default_rng(5)
    base = clustered(rng, 60, 4, 3)
    vectors = [*base, *[base[0]] * 20, None, [], [0] * 4, [1, 2], [0, 0], *rng.normal(size=(5, 3))]
    asked = [base[0], -base[0], [0] * 4, [1, 2], [1, 2, 3], [1] * 7, []]
    made, index, queries = both(spark, tmp_path, vectors, asked, k=8)
    known = index.selectExpr("chunk_id", "coalesce(embedding, array()) AS embedding")
    assert made == rows(R.dense_topk(known, queries, 8))


@pytest.mark.parametrize("part_rows,most_queries", [(7, 2)])
def test_large_cells_and_many_queries_are_split(spark, tmp_path, monkeypatch, part_rows, most_queries):
    monkeypatch.setattr(C, "PART_ROWS", part_rows)
    monkeypatch.setattr(C, "MOST_QUERIES", most_queries)
    rng = np.random.default_rng(6)
    vectors = clustered(rng, 120, 8, 2)
    made, index, queries = both(spark, tmp_path, vectors, vectors[:9], k=4, cells=2)
    assert made == rows(R.dense_topk(index, queries, 4))


def test_fewer_vectors_than_k_and_none(spark, tmp_path):
    made, index, queries = both(spark, tmp_path, [[1, 0], [0, 1]], [[1, 1]], k=5)
    assert made == rows(R.dense_topk(index, queries, 5)) and len(made) == 2
    C.build_cells(index.limit(0), str(tmp_path / "empty"))
    assert C.cells_topk(queries, str(tmp_path / "empty"), 5).collect() == []


def test_bounds_hold():
    rng = np.random.default_rng(7)
    import pyarrow as pa
    vectors, asked = clustered(rng, 400, 6, 5, 0.3), rng.normal(size=(50, 6))
    units, q = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (vectors, asked))
    centres = C._fitted(units, 12)
    who = (units @ centres.T).argmax(1)
    cells = [{"cell": c, "dimensions": 6, "least": (units @ centres[c])[who == c].min(), "n": int((who == c).sum()), "centre": centres[c]}
             for c in range(12) if (who == c).any()]
    bounds = C._bounds(cells, pa.array(asked.tolist(), pa.list_(pa.float64())))
    for i, c in enumerate(cells):
        assert (bounds[:, i] + 1e-12 >= (q @ units[who == c["cell"]].T).max(1)).all()
