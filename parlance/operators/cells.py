"""Exact dense retrieval that reads only the cells of an index that can hold a hit.

``build_cells`` deals vectors to cells: centres are fitted on a bounded sample of directions, every vector goes to the centre
with the largest cosine, and a cell knows the smallest cosine among its members, its radius as an angle. A query at angle a to
a centre has no member of that cell nearer than a - radius, so cos(max(0, a - radius)) bounds its scores there. The first
round scores each query's nearest cells that hold ``k`` vectors, which gives a score that the result cannot fall below; the second
round scores the other cells whose bound reaches it. Cells are folders, so the others are not read.

Large cells are split into parts and many queries of one cell into blocks, so that no task gets more than ``PART_ROWS`` vectors
against ``MOST_QUERIES`` queries. How much is pruned depends on the vectors: tight clusters leave a few cells, directions
spread evenly in many dimensions leave nearly all (``cell_reads`` tells).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..session import work_dir
from .retrieval import _array, _dense_scores, _matrix, _unit

MOST_CELLS = 1024
SAMPLE_VALUES = 1 << 22  # of the sample that centres are fitted on
PART_ROWS = 4096
MOST_QUERIES = 4096
_ROOM = 1e-8  # scores are rounded to nine places
FLAT = -1  # the cell of vectors without a direction


def _directions(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and unit vectors by length, without null, empty and zero vectors."""
    out = {}
    known = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
    for d, (rows, values) in _matrix(vectors.take(pa.array(known))).items() if len(known) else ():
        some = np.flatnonzero((values != 0).any(1)) if d else np.zeros(0, int)
        if len(some):
            out[d] = known[rows[some]], _unit(values[some])
    return out


def _fitted(sample: np.ndarray, count: int, rounds: int = 4, seed: int = 1) -> np.ndarray:
    """Centres of a sample of directions: a few rounds of means, each made a direction again."""
    centres = sample[np.random.default_rng(seed).permutation(len(sample))[:count]]
    for _ in range(rounds):
        who = (sample @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, who, sample)
        norms = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norms > 1e-12, total / np.maximum(norms, 1e-12), centres)
    return centres


def build_cells(index: DataFrame, path: str, cells: int | None = None) -> None:
    """Writes ``index`` (chunk_id, embedding) as cells under ``path``, which must be new.

    ``cells`` is by default the square root of the number of vectors, ``MOST_CELLS`` at most. The sample for the centres is
    taken by a hash of the id and holds ``SAMPLE_VALUES`` numbers; every vector is stored and measured.
    """
    spark = index.sparkSession
    rows = index.select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding"))
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    wanted = min(MOST_CELLS, cells or max(1, int(np.sqrt(sizes["n"]))))
    most = max(wanted, SAMPLE_VALUES // max(1, sizes["d"] or 1))
    sample = rows.orderBy(F.xxhash64("chunk_id")).limit(min(most, 64 * wanted)).select("embedding").toArrow()
    centres = {d: _fitted(units, wanted) for d, (_, units) in _directions(_array(sample["embedding"])).items()} if sample.num_rows else {}
    first = np.cumsum([0, *[len(c) for c in centres.values()]])
    number = {d: int(first[i]) for i, d in enumerate(centres)}
    schema = "chunk_id string, embedding array<double>, cell int, cosine double, dimensions int"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, cosine, length = np.full(batch.num_rows, FLAT), np.zeros(batch.num_rows), np.zeros(batch.num_rows, int)
            for d, (at, units) in _directions(batch.column("embedding")).items():
                length[at] = d
                if d in centres:
                    dots = units @ centres[d].T
                    cell[at], cosine[at] = number[d] + dots.argmax(1), dots.max(1)
                else:  # a length that the sample has not: one cell as wide as can be
                    cell[at], cosine[at] = first[-1] + d, -1.0
            yield pa.RecordBatch.from_arrays(
                [batch.column("chunk_id"), batch.column("embedding"), *[pa.array(x, t) for x, t in (
                    (cell, pa.int32()), (cosine, pa.float64()), (length, pa.int32()))]],
                ["chunk_id", "embedding", "cell", "cosine", "dimensions"])

    dealt = rows.mapInArrow(deal, schema)
    spread = F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, min(64, sizes["n"] // PART_ROWS))))
    dealt.repartition("cell", spread).write.partitionBy("cell").parquet(f"{path}/vectors")
    table = spark.read.schema(schema).parquet(f"{path}/vectors").groupBy("cell").agg(
        F.max("dimensions").alias("dimensions"), F.min("cosine").alias("least"), F.count(F.lit(1)).alias("n")).collect()
    middle = {number[d] + i: c.tolist() for d, found in centres.items() for i, c in enumerate(found)}
    spark.createDataFrame([(r["cell"], r["dimensions"], r["least"], r["n"], middle.get(r["cell"])) for r in table],
                          "cell int, dimensions int, least double, n long, centre array<double>").coalesce(1).write.parquet(f"{path}/cells")


def _cells(spark: SparkSession, path: str) -> list:
    # No more rows than cells.
    return spark.read.parquet(f"{path}/cells").orderBy("cell").collect()


def _bounds(cells: list, vectors: pa.Array) -> np.ndarray:
    """For each vector and cell the largest score possible there; 0 where the cell is flat, the lengths differ or the vector has no direction."""
    out = np.zeros((len(vectors), len(cells)))
    for d, (rows, units) in _directions(vectors).items():
        mine = [i for i, c in enumerate(cells) if c["cell"] != FLAT and c["dimensions"] == d]
        fitted = [i for i in mine if cells[i]["centre"] is not None]
        out[np.ix_(rows, mine)] = 1.0
        if fitted:
            angle = np.arccos(np.clip(units @ np.array([cells[i]["centre"] for i in fitted]).T, -1, 1))
            radius = np.arccos(np.clip([cells[i]["least"] for i in fitted], -1, 1))
            out[np.ix_(rows, fitted)] = np.cos(np.maximum(angle - radius - 1e-7, 0))
    return out


def _first_cells(bounds: np.ndarray, cells: list, k: int) -> np.ndarray:
    """Marks for each query the cells of the largest bounds that together hold ``k`` vectors."""
    order = np.argsort(-bounds, axis=1, kind="stable")
    held = np.cumsum(np.array([c["n"] for c in cells])[order], axis=1)
    chosen = np.zeros(bounds.shape, bool)
    np.put_along_axis(chosen, order, held - np.take_along_axis(np.array([c["n"] for c in cells])[None, :].repeat(len(bounds), 0), order, 1) < k, 1)
    return chosen


_ASKED = "query_id string, embedding array<double>, cell int"


def _wanted(asked: DataFrame, cells: list, k: int, second: bool) -> DataFrame:
    """A row for each query and cell to score: in the first round the nearest cells, in the second those others whose bound reaches ``least``."""
    numbers = np.array([c["cell"] for c in cells], np.int32)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                bounds = _bounds(cells, part.column("embedding"))
                chosen = _first_cells(bounds, cells, k)
                if second:
                    least = part.column("least").fill_null(-np.inf).to_numpy(zero_copy_only=False)
                    chosen = ~chosen & (bounds + _ROOM >= least[:, None])
                row, cell = np.nonzero(chosen)
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([taken.column("query_id"), taken.column("embedding"), pa.array(numbers[cell])],
                                                 ["query_id", "embedding", "cell"])

    return asked.mapInArrow(choose, _ASKED)


def _top(hits: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _scored(wanted: DataFrame, path: str, cells: list, k: int) -> DataFrame:
    """The best ``k`` of every query in each part of a wanted cell."""
    spark = wanted.sparkSession
    asked_of = {r["cell"]: r["count"] for r in wanted.groupBy("cell").count().collect()}
    parts = {c["cell"]: -(-c["n"] // PART_ROWS) for c in cells if c["cell"] in asked_of}
    blocks = {c: -(-n // MOST_QUERIES) for c, n in asked_of.items()}
    # One row for each cell.
    split = F.broadcast(spark.createDataFrame([(c, parts[c], blocks[c]) for c in parts], "cell int, _parts long, _blocks long"))
    vectors = spark.read.schema("chunk_id string, embedding array<double>, cell int").parquet(f"{path}/vectors")
    vectors = vectors.filter(F.col("cell").isin(list(parts))).join(split, "cell").select(
        "cell", F.pmod(F.xxhash64("chunk_id"), "_parts").alias("part"), F.explode(F.sequence(F.lit(1).cast("long"), "_blocks")).alias("block"),
        "chunk_id", "embedding")
    queries = wanted.join(split, "cell").select(
        "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("part"),
        (F.pmod(F.xxhash64("query_id"), "_blocks") + 1).alias("block"), "query_id", "embedding")

    def score(mine: pa.Table, asked: pa.Table) -> pa.Table:
        if not mine.num_rows or not asked.num_rows:
            return pa.table({"query_id": pa.array([], pa.string()), "chunk_id": pa.array([], pa.string()), "score": pa.array([], pa.float64())})
        mine = mine.sort_by("chunk_id")
        empty = pa.array([[]], pa.list_(pa.float64()))
        scores = _dense_scores(*[_array(t["embedding"]).fill_null(empty[0]) for t in (mine, asked)])
        best = np.argsort(-scores, axis=0, kind="stable")[:k]  # equal scores stay in the order of ids
        col = np.tile(np.arange(asked.num_rows), len(best))
        return pa.table({"query_id": _array(asked["query_id"]).take(pa.array(col)), "chunk_id": _array(mine["chunk_id"]).take(pa.array(best.ravel())),
                         "score": scores[best.ravel(), col]})

    keys = ["cell", "part", "block"]
    return vectors.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(score, "query_id string, chunk_id string, score double")


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _rounds(queries: DataFrame, path: str, k: int) -> tuple[list, list[DataFrame], DataFrame | None]:
    """The cells, what each round wants, and the hits of both."""
    spark = queries.sparkSession
    cells = _cells(spark, path)
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    if not cells:
        return cells, [], None
    asked = _stored(asked, "asked")
    first = _stored(_wanted(asked, cells, k, False), "first-cells")
    hits = _stored(_scored(first, path, cells, k), "first-hits")
    least = _top(hits, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    second = _stored(_wanted(asked.join(least, "query_id", "left"), cells, k, True), "second-cells")
    return cells, [first, second], hits.unionByName(_scored(second, path, cells, k))


def cells_topk(queries: DataFrame, path: str, k: int = 5) -> DataFrame:
    """``query_id, chunk_id, score, rank``: the best ``k`` vectors per query by cosine, as ``retrieval.dense_topk``, from cells.

    Query ids are unique. Ties go by chunk id; null and zero vectors, and those of another length, score 0.
    """
    _, _, hits = _rounds(queries, path, k)
    if hits is None:
        return queries.sparkSession.createDataFrame([], "query_id string, chunk_id string, score double, rank int")
    return _top(hits, k)


def cell_reads(queries: DataFrame, path: str, k: int = 5) -> DataFrame:
    """``query_id, vectors, share``: how many vectors are scored for each query, and their share of all."""
    cells, rounds, _ = _rounds(queries, path, k)
    sizes = F.broadcast(queries.sparkSession.createDataFrame([(c["cell"], c["n"]) for c in cells], "cell int, n long"))
    return rounds[0].unionByName(rounds[1]).join(sizes, "cell").groupBy("query_id").agg(
        F.sum("n").alias("vectors"), (F.sum("n") / float(sum(c["n"] for c in cells))).alias("share"))
