"""Clustering against plain arithmetic on Python integers."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from hypothesis.extra import numpy as hnp

from parlance.llm import centroids as C

SCHEMA = "vec_id long, embedding array<float>"


def by_hand(rows, k=8, rounds=10, dims=4):
    """rows: (vec_id, components as floats that Spark holds)."""
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [v for _, v in first]

    def far(v, c):
        return sum((x - y) ** 2 for x, y in zip(v, c))

    def assign():
        return [min((far(v, c), j) for j, c in enumerate(centres))[::-1] for _, v in kept]

    for _ in range(rounds):
        at = assign() if centres else []
        for j in range(len(centres)):
            mine = [v for (_, v), (c, _) in zip(kept, at) if c == j]
            if mine:
                centres[j] = [sum(x) // len(mine) for x in zip(*mine)]
    at = assign() if centres else []
    total = {j: sum(d for c, d in at if c == j) for j in range(len(centres))}
    return sorted((i, c, d, total[c], sum(total.values()), tuple(centres[c])) for (i, _), (c, d) in zip(kept, at))


def run(spark, rows, **more):
    made = C.cluster(spark.createDataFrame(rows, SCHEMA), dimensions=4, **more).collect()
    return sorted((r["vec_id"], r["cluster"], r["distance"], int(r["cluster_inertia"]), int(r["inertia"]), tuple(r["centroid"])) for r in made)


def floats(*values):
    return [None if v is None else float(np.float32(v)) for v in values]


def test_equals_plain_rounds_with_ties_and_repeats(spark):
    rng = np.random.default_rng(5)
    rows = [(i, floats(*rng.integers(-3, 4, 4) / 8)) for i in range(200)]
    rows += rows[:40] + [(1000 + i, rows[3][1]) for i in range(50)]
    assert run(spark, rows) == by_hand(rows)


def test_unusable_vectors_are_left_out(spark):
    rows = [(1, None), (2, []), (3, floats(1, 2, 3)), (4, floats(1, 2, 3, None)), (5, floats(1, 2, 3, math.nan)),
            (6, floats(1, 2, -math.inf, 4)), (7, floats(1, 2, 3, 4, 5)), (8, floats(0.1, -0.1, 0, 1)), (9, floats(0, 0, 0, 0))]
    assert run(spark, rows) == by_hand(rows) and len(run(spark, rows)) == 2


def test_few_and_no_vectors(spark):
    assert run(spark, []) == []
    rows = [(i, floats(i, 0, 0, 1)) for i in range(3)]
    assert run(spark, rows) == by_hand(rows)


def test_one_vector_many_times_leaves_centroids_empty(spark):
    rows = [(i, floats(1, 1, 1, 1)) for i in range(30)] + [(99, floats(2, 1, 1, 1))]
    assert run(spark, rows) == by_hand(rows)


def test_large_sums_do_not_overflow(spark):
    rows = [(i, floats(16000 * (-1) ** i, 16000, -16000, i)) for i in range(20)]
    assert run(spark, rows, k=2) == by_hand(rows, k=2)


def test_a_component_beyond_the_bound_is_an_error(spark):
    with pytest.raises(Exception, match="a component over"):
        run(spark, [(1, floats(1e9, 0, 0, 0))])


def test_extra_columns_and_null_keys(spark):
    rows = spark.createDataFrame([(None, floats(1, 0, 0, 0), "a", 1), (2, floats(0, 1, 0, 0), "b", 2)],
                                 "vec_id long, embedding array<float>, cluster string, _v int")
    made = C.cluster(rows, dimensions=4, k=1)
    assert made.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    assert {r["vec_id"] for r in made.collect()} == {None, 2}
    with pytest.raises(ValueError):
        C.cluster(rows, dimensions=4, keep=["vec_id", "cluster"])


@settings(max_examples=200, deadline=None)
@given(hnp.arrays(np.int64, st.tuples(st.integers(1, 30), st.just(3)), elements=st.integers(-6, 6)),
       hnp.arrays(np.int64, st.tuples(st.integers(1, 12), st.just(3)), elements=st.integers(-6, 6)), st.sampled_from([1, 1000, 1 << 21]))
def test_search_is_exact(vectors, values, scale):
    vectors, values = vectors * scale, values * scale
    far = ((vectors[:, None] - values[None]) ** 2).sum(2)
    who, distance, _ = C.nearest(vectors, C.Centroids.of(values))
    assert np.array_equal(who, far.argmin(1)) and np.array_equal(distance, far.min(1))


def test_bounds_reject_most_centroids():
    rng = np.random.default_rng(1)
    values = rng.integers(-50, 50, (400, 1)) * 20 + rng.integers(-30, 30, (400, 64)) * rng.integers(1, 8, (400, 1))
    vectors = values[rng.integers(0, 400, 2000)] + rng.integers(-3, 4, (2000, 64))
    who, distance, computed = C.nearest(vectors, C.Centroids.of(values))
    far = np.array([((values - v) ** 2).sum(1).min() for v in vectors])
    assert np.array_equal(distance, far) and computed < 0.05 * 2000 * 400
