"""The chunk index at rest: parquet folders under one path.

``v=<n>`` holds a whole index, ``d=<n>`` a change to what came before: points that were added or
replaced, and ids that were deleted. A reader takes the newest ``v`` and the ``d`` folders after it,
so a change writes only itself. ``compact_index`` writes a whole index again when the caller wants it, and
``vacuum`` removes the folders that no reader needs any more.
Only folders with a ``_SUCCESS`` marker count, so a job that dies half-way leaves the old state in
force, and no writer touches a folder that exists.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from ..schemas import VECTOR_POINT

_CHANGE = "d"
_DELETED = "_deleted"
_LENGTH = "_length-"


def _folders(spark: SparkSession, path: str) -> list[tuple[str, int, bool]]:
    """``(kind, number, complete)`` by number. Lists one folder on the driver; reads no data."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = []
    for status in fs.listStatus(root):
        kind, _, number = status.getPath().getName().partition("=")
        if kind in ("v", "d") and number.isdigit():
            found.append((kind, int(number), fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS"))))
    return sorted(found, key=lambda f: f[1])


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete whole versions, oldest first."""
    return [n for kind, n, complete in _folders(spark, path) if kind == "v" and complete]


def _state(spark: SparkSession, path: str) -> tuple[int | None, list[int]]:
    """The newest complete whole version, and the complete changes after it, oldest first. One listing."""
    folders = [(kind, n) for kind, n, complete in _folders(spark, path) if complete]
    newest = max((n for kind, n in folders if kind == "v"), default=None)
    return newest, [n for kind, n in folders if kind == "d" and n > (newest or 0)]


def _write(df: DataFrame, path: str, kind: str) -> str:
    taken = [n for _, n, _ in _folders(df.sparkSession, path)]
    target = f"{path}/{kind}={max(taken, default=0) + 1}"
    df.write.mode("errorifexists").parquet(target)
    return target


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index as it stands; empty if there is none. All changes are one scan, however many there are."""
    whole, changes = _state(spark, path)
    base = spark.read.parquet(f"{path}/v={whole}") if whole is not None else spark.createDataFrame([], VECTOR_POINT)
    if not changes:
        return base
    # All changes have one schema, so none of their files is opened for it. The folder's number comes as a column.
    schema = T.StructType([*base.schema.fields, T.StructField(_DELETED, T.BooleanType()), T.StructField(_CHANGE, T.LongType())])
    changed = spark.read.schema(schema).option("basePath", path).parquet(*[f"{path}/{_CHANGE}={n}" for n in changes])
    latest = _last_by_id(changed, [_CHANGE])
    # The planner knows the size of the change files and sends small ones to the stored side, which
    # is then read without a shuffle.
    kept = base.join(changed.select("point_id"), "point_id", "left_anti").select(*base.columns)
    return kept.unionByName(latest.filter(~F.col(_DELETED)).select(*base.columns))


def _last_by_id(points: DataFrame, order: list[str]) -> DataFrame:
    newest = W.partitionBy("point_id").orderBy(*[F.col(c).desc() for c in order])
    return points.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") == 1).drop("_r")


def refresh_index(points: DataFrame, path: str) -> int:
    """Replaces the whole index; returns the number of rows now stored."""
    return _finished(points.sparkSession, _write(points, path, "v"), None)


def _change(change: DataFrame, path: str) -> int:
    spark = change.sparkSession
    dimensions = _dimensions(spark, path)
    return _finished(spark, _write(_checked(change, dimensions), path, "d"), dimensions)


def _finished(spark: SparkSession, folder: str, dimensions: int | None) -> int:
    """Rows of a folder just written; leaves an empty file there that names the vector length, so that the next change
    need not look for it in the index."""
    size = spark.read.parquet(folder).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    known = size["d"] if (size["d"] or 0) > 0 else dimensions
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{_LENGTH}{known or 0}")
    place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True).close()
    return size["n"]


def _dimensions(spark: SparkSession, path: str) -> int | None:
    """The vector length of the stored points, as the newest folder names it; None without points. Where a writer died before it
    named it, the first stored vector tells."""
    whole, changes = _state(spark, path)
    if whole is None and not changes:
        return None
    newest = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{_CHANGE}={changes[-1]}" if changes else f"{path}/v={whole}")
    for status in newest.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(newest):
        name = status.getPath().getName()
        if name.startswith(_LENGTH):
            return int(name.removeprefix(_LENGTH)) or None
    first = read_index(spark, path).filter(F.size("embedding") > 0).select(F.size("embedding")).first()
    return first[0] if first else None


def _checked(points: DataFrame, dimensions: int | None) -> DataFrame:
    """The same points; writing one with a vector of another length is an error."""
    if dimensions is None:
        return points
    wrong = F.concat(F.lit(f"the index has vectors of length {dimensions}, not "), F.size("embedding"))
    vector = F.when(F.size("embedding") != dimensions, F.raise_error(wrong)).otherwise(F.col("embedding"))
    return points.withColumn("embedding", vector)


def _points(chunks: DataFrame, to_points: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    return (to_points(chunks) if to_points else chunks).withColumn(_DELETED, F.lit(False))


def upsert_points(points: DataFrame, path: str, to_points: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Adds points and replaces those with the same id; creates the index if missing. Returns the
    number of points written.

    Within one batch the last chunk by (doc_id, chunk_index, content) of an id wins. With ``to_points`` the rows are
    chunks with a point id, and it makes points of those that win: vectors, often many times a chunk's bytes, are neither sorted nor shuffled.
    """
    latest = _last_by_id(points, ["doc_id", "chunk_index", "content"])
    return _change(_points(latest, to_points), path)


def _tombstones(ids: DataFrame) -> DataFrame:
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in VECTOR_POINT.fields if f.name != "point_id"]
    return ids.select("point_id", *nulls, F.lit(True).alias(_DELETED))


def delete_points(spark: SparkSession, path: str, ids: DataFrame) -> int:
    """Drops the points whose ids are listed in ``ids.point_id``; returns the number of ids."""
    return _change(_tombstones(ids.select("point_id").distinct()), path)


def replace_documents(points: DataFrame, doc_ids: DataFrame, path: str,
                      to_points: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Upserts the points of the listed documents and drops what else these documents had. ``to_points`` is as for ``upsert_points``."""
    latest = _points(_last_by_id(points, ["chunk_index", "content"]), to_points)
    before = read_index(points.sparkSession, path).select("point_id", "doc_id").join(
        doc_ids.select("doc_id"), "doc_id", "left_semi")
    gone = before.join(points.select("point_id"), "point_id", "left_anti")
    return _change(latest.unionByName(_tombstones(gone)), path)


def compact_index(spark: SparkSession, path: str) -> int:
    """Writes the index as it stands as one whole version."""
    return refresh_index(read_index(spark, path), path)


def vacuum(spark: SparkSession, path: str) -> int:
    """Removes all folders before the newest whole version; returns their number. Readers that began before must
    have ended."""
    whole = versions(spark, path)
    old = [f"{path}/{kind}={n}" for kind, n, _ in _folders(spark, path) if whole and n < whole[-1]]
    for folder in old:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return len(old)


def clear_index(spark: SparkSession, path: str) -> int:
    """An empty version with the same schema."""
    return refresh_index(emptied(read_index(spark, path)), path)


def emptied(index: DataFrame) -> DataFrame:
    return index.filter(F.lit(False))


def export_index(index: DataFrame, path: str) -> None:
    """All points as JSON lines ``{id, payload, vector}``, without a cap on their number."""
    export_rows(index).write.mode("overwrite").json(path)


def export_rows(index: DataFrame) -> DataFrame:
    payload = [c for c in index.columns if c not in ("point_id", "embedding")]
    return index.select(F.col("point_id").alias("id"), F.struct(*payload).alias("payload"),
                        F.col("embedding").alias("vector"))


def index_stats(index: DataFrame) -> DataFrame:
    """Points, points with a vector, and the vector length."""
    return index.agg(F.count(F.lit(1)).alias("points"), F.count("embedding").alias("vectors"),
                     F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dimensions"))


def list_points(index: DataFrame, limit: int | None = 50) -> DataFrame:
    """Ids, titles and a 90-character preview, in id order."""
    content = F.coalesce("content", F.lit(""))
    preview = F.when(F.length(content) > 90, F.concat(F.substring(content, 1, 90), F.lit("..."))).otherwise(content)
    rows = index.select("point_id", F.coalesce("doc_title", F.lit("N/A")).alias("doc_title"),
                        F.coalesce("chunk_id", F.lit("N/A")).alias("chunk_id"),
                        F.coalesce("source_uri", F.lit("N/A")).alias("source_uri"), preview.alias("preview"))
    return rows if limit is None else rows.orderBy("point_id").limit(limit)
