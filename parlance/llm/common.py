"""What the operators of this folder share: staged tables and vectorised views of text batches."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import work_dir

SLICE_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is executed inside removes its shuffle files as soon as it has ended. A later step reads what was written, so
    nothing needs them; a lost executor during the step finds them as ever."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def staged(df: DataFrame, label: str, **options: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: settled, and without its lineage."""
    path = work_dir(df.sparkSession, label)
    with _shuffles_removed(df.sparkSession):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def boxed(docs: DataFrame, **more: Column) -> DataFrame:
    """The rows of ``docs`` as one column ``_row`` beside ``more``, so that no name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[v.alias(k) for k, v in more.items()])


def settle(*done: DataFrame) -> None:
    """Removes staged tables that nothing reads any more; only folders that ``staged`` made."""
    for df in done:
        spark = df.sparkSession
        base = urlparse(work_dir(spark, "x").rsplit("/", 1)[0]).path
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if posixpath.dirname(urlparse(path).path) == base:
                place = spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def held_out(key: str = "doc_id") -> Column:
    """True for the quarter of the rows that no model may learn from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def plain(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column with nulls as empty texts."""
    return batch.column(name).fill_null("")


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with about ``most`` bytes of text each, so that the arrays
    made for every byte stay small. A longer text is a slice of its own."""
    if not batch.num_rows:
        return
    ends = np.cumsum(np.diff(view(plain(batch, text))[1]))
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and where each text begins (one more at the end)."""
    if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], kind)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, kind)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets.astype(np.int64) - int(offsets[0])


# Bytes between words: space, and tab to carriage return.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = ~SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end, and the index of each text's first word (one more at the end).
    ``inside`` tells of each byte value whether it belongs to a word."""
    ink = np.zeros(len(data) + 2, bool)
    ink[1:-1] = inside[data]
    edge = np.zeros(len(data) + 1, bool)  # a text ends here whatever comes next
    edge[offsets] = True
    starts = np.flatnonzero(ink[1:-1] & (~ink[:-2] | edge[:-1]))
    ends = np.flatnonzero(ink[1:-1] & (~ink[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_RNG = np.random.default_rng(20240229)
_TABLE = _RNG.integers(0, 1 << 64, 256, np.uint64, endpoint=False)
_SECOND = _RNG.integers(0, 1 << 64, 256, np.uint64, endpoint=False)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, kept between calls up to a slice's length."""
    if len(_POWERS[0]) >= n:
        return _POWERS[0][:n], _POWERS[1][:n]
    made = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        out = np.ones(max(n, SLICE_BYTES + 1), np.uint64)
        out[1:] = base
        made.append(np.multiply.accumulate(out))
    if len(made[0]) <= 4 * SLICE_BYTES:
        _POWERS[:] = made
    return made[0][:n], made[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def item_span_hashes(items: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of items, from one running sum over all items."""
    up, down = _powers(len(items) + 1)
    total = np.zeros(len(items) + 1, np.uint64)
    np.cumsum(items * up[:-1], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """A 64-bit hash of each span of bytes; the ``second`` one is independent of the first."""
    return item_span_hashes((_SECOND if second else _TABLE)[data], starts, ends)


def sliding_least(items: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbouring items."""
    if len(items) < width:
        return items[:0]
    out, have = items, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:len(out) - step], out[step:])
        have += step
    return out


def run_hashes(items: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` neighbouring items; order counts. Runs may cross texts: mask them."""
    size = len(items) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(size, np.uint64)
    for j in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + items[j:j + size]
    return mix(out)
