"""Centroid clustering whose nearest-centroid search goes outward from equal means.

Centroids are sorted by the sum of their components, which orders them by mean. A vector starts at the centroids
next to its own sum and goes on in both directions. With S the sum of components, Q = d * sum(x * x) - S * S (d * d times the
variance) and D the squared distance to a centroid c,

    d * D >= (Sx - Sc)^2                                      equal average
    d * D >= (Sx - Sc)^2 + (sqrt(Qx) - sqrt(Qc))^2            equal average and variance

so a direction ends at the first centroid whose first bound is over d times the best distance so far, and a
centroid whose second bound is over it is passed by. What is left is compared by exact integer
distances, so rejection never changes a result. All vectors of a batch take their steps together.

Every round is one pass over the stored vectors. A task adds its vectors up by centroid, so that a few rows
for each centroid are shuffled however the vectors are spread over the clusters; the centroids themselves are
bounded (``MOST_VALUES``) and travel with the job.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import staged

# Components beyond this would not fit a 64-bit distance over LONGEST components.
LARGEST = 1 << 24
LONGEST = 1 << 12
MOST_VALUES = 1 << 22
_ROWS = 4096


@dataclass(frozen=True)
class Centroids:
    """Integer centroids with what the search needs: their order by sum, the sums in it, and sqrt(Q)."""

    values: np.ndarray
    order: np.ndarray
    sums: np.ndarray
    spread: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> Centroids:
        sums = values.sum(1)
        order = np.lexsort((np.arange(len(values)), sums))
        return cls(values[order], order, sums[order], np.sqrt(_scaled_variance(values[order], sums[order])))


def _scaled_variance(values: np.ndarray, sums: np.ndarray) -> np.ndarray:
    exact = values.shape[1] * np.einsum("ij,ij->i", values.astype(float), values.astype(float)) - sums.astype(float) ** 2
    return np.maximum(exact, 0.0)


def nearest(vectors: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray, int]:
    """The number of each vector's nearest centroid (the smaller number of equally near ones), the squared
    distance, and how many distances were computed."""
    n, d = vectors.shape
    k = len(centroids.values)
    sums = vectors.sum(1)
    spread = np.sqrt(_scaled_variance(vectors, sums))
    best = np.full(n, np.iinfo(np.int64).max)
    who = np.full(n, k, np.int64)
    # Bounds are compared as doubles with some room for rounding, so a bound can only be too low.
    limit = np.full(n, np.inf)
    computed = 0

    def visit(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Looks at one centroid for each of the rows; returns the rows that this direction goes on for."""
        nonlocal computed
        mean = (sums[rows] - centroids.sums[at]).astype(float) ** 2
        on = mean * (1 - 1e-12) <= limit[rows]
        rows, at, mean = rows[on], at[on], mean[on]
        other = centroids.spread[at]
        # sqrt(Q) of nearly constant vectors loses half of its digits, so the room grows with sqrt(Q)'s own error.
        apart = np.maximum(np.abs(spread[rows] - other) - 1e-6 * (spread[rows] + other + np.abs(sums[rows]) + np.abs(centroids.sums[at])), 0)
        near = (mean + apart ** 2) * (1 - 1e-12) <= limit[rows]
        some, there = rows[near], at[near]
        gap = vectors[some] - centroids.values[there]
        distance = np.einsum("ij,ij->i", gap, gap)
        computed += len(some)
        number = centroids.order[there]
        better = (distance < best[some]) | ((distance == best[some]) & (number < who[some]))
        won = some[better]
        best[won], who[won] = distance[better], number[better]
        limit[won] = float(d) * distance[better]
        return rows

    up = np.searchsorted(centroids.sums, sums, "left")
    down = up - 1
    rising = np.flatnonzero(up < k)
    falling = np.flatnonzero(down >= 0)
    step = 0
    while len(rising) or len(falling):
        rising = visit(rising, up[rising] + step)
        rising = rising[up[rising] + step + 1 < k]
        falling = visit(falling, down[falling] - step)
        falling = falling[down[falling] - step - 1 >= 0]
        step += 1
    return who, best, computed


def whole_vectors(dimensions: int, vector: str = "embedding", scale: int = 1024) -> Column:
    """``vector`` as integers floor(scale * x) if it has exactly ``dimensions`` components, all finite; else null."""
    x = F.col(vector).cast("array<double>")
    usable = (F.size(x) == dimensions) & F.forall(x, lambda v: F.coalesce(
        v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    floored = F.transform(x, lambda v: F.when(F.abs(v) * scale < LARGEST, F.floor(v * scale).cast("int")).otherwise(
        F.raise_error(F.concat(F.lit(f"a component over {LARGEST // scale}: "), v.cast("string"))).cast("int")))
    return F.when(usable, floored)


def _matrix(batch: pa.RecordBatch, dimensions: int) -> np.ndarray:
    return batch.column("_v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)


def _sums(vectors: DataFrame, values: np.ndarray, floors: bool) -> dict[int, list[int]]:
    """Per non-empty centroid its rows, its sum of distances, and with ``floors`` the sums of components."""
    k, d = values.shape
    wide = 3 + (d if floors else 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = Centroids.of(values)
        total = np.zeros((k, wide), np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS):
                mine = _matrix(batch.slice(lo, _ROWS), d)
                who, distance, _ = nearest(mine, centroids)
                # A distance goes in two halves, so that no sum of a task can overflow.
                added = np.column_stack([np.ones_like(who), distance >> 32, distance & 0xFFFFFFFF, *([mine] if floors else [])])
                order = np.argsort(who, kind="stable")
                first = np.flatnonzero(np.diff(who[order], prepend=-1))
                total[who[order][first]] += np.add.reduceat(added[order], first)
        found = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(found, wide)), pa.array(np.tile(np.arange(wide), len(found))), pa.array(total[found].ravel())],
            ["c", "i", "x"])

    parts = vectors.select("_v").mapInArrow(run, "c long, i long, x long")
    sums: dict[int, list[int]] = {}
    # No more rows than values in all centroids, which are bounded.
    for r in parts.groupBy("c", "i").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("x")).collect():
        sums.setdefault(r["c"], [0] * wide)[r["i"]] = int(r["x"])
    return {c: [n, (high << 32) + low, *rest] for c, (n, high, low, *rest) in sums.items()}


def seeds(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The ``k`` vectors whose sha256 of ``salt`` and key comes first, in that order; of one key's, the smaller vectors."""
    digest = F.sha2(F.concat(F.lit(salt), F.col("_k").cast("string")), 256)
    # An ordered limit keeps k rows in each task and on the driver.
    first = vectors.select("_v", digest.alias("_h")).orderBy(F.col("_h").asc_nulls_last(), "_v").limit(k).collect()
    return np.array([r["_v"] for r in first], np.int64)


def cluster(rows: DataFrame, k: int = 8, rounds: int = 10, dimensions: int = 64, scale: int = 1024, salt: str = "3:",
            key: str = "vec_id", vector: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: the key) of all usable vectors, and cluster, distance, cluster_inertia, inertia, centroid.

    Vectors need exactly ``dimensions`` components, none null or non-finite; other rows are left out. Components become
    floor(scale * x); one beyond 16 million is an error, since distances are 64-bit integers. Centroids start as ``seeds``; every
    round assigns all vectors (ties: the smaller number) and moves each centroid to the floor of its vectors' mean; one without
    vectors stays. Then all are assigned once more. Fewer vectors than ``k`` make fewer centroids, none make an empty result.
    Repeated rows count as often as they come; a row without a key becomes a seed only if there are too few others. Extra
    columns of any name do no harm; those in ``keep`` must not be named like the new ones.
    """
    keep = [key] if keep is None else keep
    new = ["cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    if clash := set(keep) & set(new):
        raise ValueError(f"the rows already have {sorted(clash)}")
    if not 0 < dimensions <= LONGEST or k < 1 or k * dimensions > MOST_VALUES:
        raise ValueError(f"no more than {LONGEST} components and {MOST_VALUES} values in all centroids")
    vectors = rows.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), F.col(key).alias("_k"),
                          whole_vectors(dimensions, vector, scale).alias("_v")).filter(F.col("_v").isNotNull())
    vectors = staged(vectors, "vectors")
    made = vectors.select(
        "_row", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).cast("decimal(38,0)").alias("cluster_inertia"),
        F.lit(0).cast("decimal(38,0)").alias("inertia"), F.array(F.lit(0).cast("long")).alias("centroid"))
    values = seeds(vectors, k, salt)
    if len(values):
        for _ in range(rounds):
            moved = values.copy()
            for c, (n, _, *totals) in _sums(vectors, values, True).items():
                moved[c] = [t // n for t in totals]
            if np.array_equal(moved, values):
                break  # further rounds would change nothing
            values = moved
        made = _assigned(vectors, values, {c: far for c, (_, far) in _sums(vectors, values, False).items()}, made.schema)
    return made.select(*[F.col("_row").getField(c).alias(c) for c in keep], *new)


def _assigned(vectors: DataFrame, values: np.ndarray, inertia: dict[int, int], schema) -> DataFrame:
    """Each vector with its centroid, distance, and the sums of distances of its cluster and of all."""
    k, d = values.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = Centroids.of(values)
        kind = pa.decimal128(38, 0)
        each = pa.array([Decimal(inertia.get(i, 0)) for i in range(k)], kind)
        every = pa.array([Decimal(sum(inertia.values()))], kind)
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS):
                part = batch.slice(lo, _ROWS)
                who, distance, _ = nearest(_matrix(part, d), centroids)
                ends = pa.array(np.arange(len(who) + 1, dtype=np.int32) * d)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_row"), pa.array(who.astype(np.int32)), pa.array(distance), each.take(pa.array(who)),
                     every.take(pa.array(np.zeros(len(who), np.int64))), pa.ListArray.from_arrays(ends, pa.array(values[who].ravel()))],
                    schema.names)

    return vectors.select("_row", "_v").mapInArrow(run, schema)


def digest(centroid: Column) -> Column:
    """sha256 of the components as decimal integers joined by commas."""
    return F.sha2(F.array_join(centroid.cast("array<string>"), ","), 256)
