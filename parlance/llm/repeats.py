"""Repeated word windows by De Bruijn compaction.

Nodes are the runs of k - 1 words and edges the windows of k words. Consecutive edges that share their
anchor (the run of ``ANCHOR`` words with the least hash in each of them) form a path, so paths are cut alike in every
text. Equal paths are found by a join on a 128-bit hash of all their words, and their smallest
occurrence is their source. Where two different paths pass through one anchor the graph may branch: the
edges of those paths are joined one by one, each to its own first source. Paths and edges with a source
in a smaller document are joined into long spans as long as source and target advance together. At last
the words at the source's coordinates are read and compared by digest with those of the target, and only spans that agree
are removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import anchors
from .common import item_span_hashes, mix, plain, run_hashes, settle, slices, sliding_least, span_hashes, staged, view, words

WINDOW, ANCHOR = 13, 5


def _word_hashes(part: pa.RecordBatch, text: str = "_t"):
    data, offsets = view(plain(part, text))
    starts, ends, firsts = words(data, offsets)
    return data, starts, ends, firsts, span_hashes(data, starts, ends)


def _other(hashes: np.ndarray) -> np.ndarray:
    """Independent second hashes, for 128 bits together."""
    return mix(hashes ^ np.uint64(0xA5A5F00DCAFE1234))


def paths(hashes: np.ndarray, firsts: np.ndarray, window: int, anchor: int):
    """The paths of all texts: text, first word (in the slice), number of edges, anchor hash."""
    last = len(hashes) - window + 1
    if last <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    least = sliding_least(run_hashes(hashes, anchor), window - anchor + 1)
    text = np.searchsorted(firsts, np.arange(last), "right") - 1
    valid = np.arange(last) + window <= firsts[text + 1]
    head = valid.copy()
    head[1:] &= ~valid[:-1] | (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(head)
    edges = np.add.reduceat(valid, at) if len(at) else at
    return text[at], at, edges.astype(np.int64), least[at]


def _lists(values: np.ndarray, rows: np.ndarray, count: int, kind=pa.int64()) -> pa.Array:
    """One list per row from values in row order."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=count)[:count])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def _anchors(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch, "_t"):
                _, _, _, firsts, hashes = _word_hashes(part)
                text, _, _, g = paths(hashes, firsts, window, anchor)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_key"), _lists(g.view(np.int64), text, part.num_rows)], ["_key", "gs"])

    kind = docs.schema["_key"].dataType.simpleString()
    return docs.select("_key", "_t").mapInArrow(run, f"_key {kind}, gs array<long>").filter("size(gs) > 0")


def _paths(docs: DataFrame, kept: DataFrame, window: int, anchor: int) -> DataFrame:
    """Rows (_key, start, edges, g, s1, s2) of the paths through repeated anchors."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "_t"):
                _, _, _, firsts, hashes = _word_hashes(part)
                text, at, edges, g = paths(hashes, firsts, window, anchor)
                wanted = part.column("gs")
                keep = np.zeros(len(at), bool)
                cuts = np.searchsorted(text, np.arange(part.num_rows + 1))
                for i in range(part.num_rows):
                    here = slice(cuts[i], cuts[i + 1])
                    keep[here] = np.isin(g[here], wanted[i].values.to_numpy().view(np.uint64))
                text, at, edges, g = text[keep], at[keep], edges[keep], g[keep]
                stop = at + edges + window - 1
                columns = [part.column("_key").take(pa.array(text)), pa.array(at - firsts[text], pa.int32()), pa.array(edges, pa.int32()),
                           *[pa.array(x.view(np.int64)) for x in (
                               g, item_span_hashes(hashes, at, stop), item_span_hashes(_other(hashes), at, stop))]]
                yield pa.RecordBatch.from_arrays(columns, ["_key", "start", "edges", "g", "s1", "s2"])

    kind = docs.schema["_key"].dataType.simpleString()
    return docs.join(kept.hint("shuffle_hash"), "_key").select("_key", "_t", "gs").mapInArrow(
        run, f"_key {kind}, start int, edges int, g long, s1 long, s2 long")


def _edges(docs: DataFrame, heads: DataFrame, window: int) -> DataFrame:
    """Rows (k1, k2, s1, s2, _key, start, place) for every edge of the paths ``heads`` (_key, start, edges, s1, s2)."""
    per = heads.groupBy("_key").agg(F.collect_list(F.struct("start", "edges", "s1", "s2")).alias("ps"))
    kind = docs.schema["_key"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_t"):
                _, _, _, firsts, hashes = _word_hashes(part)
                one, two = run_hashes(hashes, window), run_hashes(_other(hashes), window)
                ps = part.column("ps")
                flat = ps.flatten()
                rows = np.repeat(np.arange(part.num_rows), np.diff(ps.offsets.to_numpy()))
                start, edges = (flat.field(n).to_numpy().astype(np.int64) for n in ("start", "edges"))
                which = np.repeat(np.arange(len(start)), edges)
                place = np.arange(len(which)) - np.repeat(np.cumsum(edges) - edges, edges)
                at = (start + firsts[rows])[which] + place
                take = pa.array(which)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one[at].view(np.int64)), pa.array(two[at].view(np.int64)), flat.field("s1").take(take),
                     flat.field("s2").take(take), part.column("_key").take(pa.array(rows[which])), pa.array(start[which], pa.int32()),
                     pa.array(place, pa.int32())], ["k1", "k2", "s1", "s2", "_key", "start", "place"])

    return docs.join(per.hint("shuffle_hash"), "_key").select("_key", "_t", "ps").mapInArrow(
        run, f"k1 long, k2 long, s1 long, s2 long, _key {kind}, start int, place int")


_SPAN = "array<struct<lo:int,hi:int,src:long,src_lo:int>>"
_WIDE = np.int64(1) << np.int64(32)


def _flat(column: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """The rows and the entries of a column of arrays; null arrays have none."""
    sizes = np.array(column.value_lengths().fill_null(0))
    return np.repeat(np.arange(len(column)), sizes), column.flatten()


def _compacted(pieces: DataFrame) -> DataFrame:
    """Pieces (_key, lo, hi, src, src_lo; words lo to hi exclusive, from word src_lo of src) of each key joined into
    the longest spans that advance with their source. One text's pieces make one row."""
    per = pieces.groupBy("_key").agg(F.collect_list(F.struct("src", "src_lo", "lo", "hi")).alias("ps"))

    @F.arrow_udf(_SPAN)
    def join(column: pa.Array) -> pa.Array:
        row, flat = _flat(column)
        src, src_lo, lo, hi = (flat.field(n).to_numpy().astype(np.int64) for n in ("src", "src_lo", "lo", "hi"))
        order = np.lexsort((lo, src_lo - lo, src, row))
        row, src, src_lo, lo, hi = (x[order] for x in (row, src, src_lo, lo, hi))
        other = np.ones(len(row), bool)
        other[1:] = (row[1:] != row[:-1]) | (src[1:] != src[:-1]) | ((src_lo - lo)[1:] != (src_lo - lo)[:-1])
        group = np.cumsum(other) * _WIDE
        reached = np.maximum.accumulate(group + hi)
        head = other.copy()
        head[1:] |= (group + lo)[1:] > reached[:-1]
        at = np.flatnonzero(head)
        ends = (reached - group)[np.append(at[1:], len(row)) - 1] if len(at) else reached
        spans = pa.StructArray.from_arrays([pa.array(lo[at], pa.int32()), pa.array(ends, pa.int32()), pa.array(src[at], pa.int64()),
                                            pa.array(src_lo[at], pa.int32())], ["lo", "hi", "src", "src_lo"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[at], np.arange(len(column) + 1)).astype(np.int32)), spans)

    return per.select("_key", F.explode(join("ps")).alias("s")).select("_key", "s.*")


def _digests(part: pa.RecordBatch, rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A digest of words lo to hi (exclusive) of rows, whatever stands between them; from hashes that are
    independent of those by which the words were found."""
    data, offsets = view(plain(part, "_t"))
    starts, ends, firsts = words(data, offsets)
    hashes = span_hashes(data, starts, ends, second=True)
    base = firsts[rows]
    return item_span_hashes(hashes, np.minimum(base + lo, firsts[rows + 1]), np.minimum(base + hi, firsts[rows + 1]))


def _source_digests(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``spans`` with the digest of the words at their source."""
    per = spans.groupBy(F.col("src").alias("_key")).agg(
        F.collect_set(F.struct("src_lo", (F.col("src_lo") + F.col("hi") - F.col("lo")).alias("src_hi"))).alias("ps"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_t"):
                rows, flat = _flat(part.column("ps"))
                lo, hi = (flat.field(n).to_numpy().astype(np.int64) for n in ("src_lo", "src_hi"))
                made = _digests(part, rows, lo, hi)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_key").take(pa.array(rows)), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(made.view(np.int64))],
                    ["src", "src_lo", "src_hi", "digest"])

    read = docs.join(per.hint("shuffle_hash"), "_key").select("_key", "_t", "ps").mapInArrow(
        run, "src long, src_lo int, src_hi int, digest long").distinct()
    return spans.withColumn("src_hi", F.col("src_lo") + F.col("hi") - F.col("lo")).join(read, ["src", "src_lo", "src_hi"])


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows key, lo, hi, src, src_lo, digest: words lo to hi (exclusive) of a text are those of ``src`` from src_lo on, in
    windows of ``window`` words whose first occurrence is in that smaller key. Keys are integers."""
    if not 1 <= anchor <= window:
        raise ValueError("an anchor is part of a window")
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_t")).filter("_key IS NOT NULL")
    kept = anchors.repeated(_anchors(rows, window, anchor))
    found = staged(_paths(rows, kept, window, anchor), "paths")
    settle(kept)

    first = F.min(F.struct("_key", "start")).alias("first")
    sources = staged(found.groupBy("s1", "s2").agg(first, F.max("_key").alias("last"), F.max("g").alias("g"), F.max("edges").alias("edges"))
                     .select("s1", "s2", "g", "edges", F.col("first._key").alias("src"), F.col("first.start").alias("src_start"), "last"), "sources")
    branching = sources.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("g")
    heads = sources.join(branching, "g", "left_semi").select(F.col("src").alias("_key"), F.col("src_start").alias("start"), "edges", "s1", "s2")
    edges = staged(_edges(rows, heads, window), "edges")
    origin = edges.groupBy("k1", "k2").agg(F.min(F.struct("_key", "start", "place")).alias("o"), F.max("_key").alias("hi")).filter("o._key < hi")
    earlier = edges.join(origin.select("k1", "k2", F.col("o._key").alias("src"), (F.col("o.start") + F.col("o.place")).alias("src_lo")), ["k1", "k2"])
    earlier = staged(earlier.filter("src < _key").select("s1", "s2", F.col("_key").alias("head"), "place", "src", "src_lo"), "edge-sources")
    settle(edges)

    # Occurrences after the first document repeat it whole; those in the first document repeat what its edges do.
    again = found.join(sources.filter("src < last").select("s1", "s2", "src", F.col("src_start").alias("src_lo")), ["s1", "s2"])
    whole = again.filter("src < _key").select(
        "_key", F.col("start").alias("lo"), (F.col("start") + F.col("edges") + (window - 1)).alias("hi"), "src", "src_lo")
    part = found.select("_key", "start", "s1", "s2").join(earlier, ["s1", "s2"]).filter("_key = head").select(
        "_key", (F.col("start") + F.col("place")).alias("lo"), (F.col("start") + F.col("place") + window).alias("hi"), "src", "src_lo")
    spans = staged(_compacted(whole.unionByName(part)), "spans")
    settle(found, sources, earlier)
    out = staged(_source_digests(rows, spans), "spans-read")
    settle(spans)
    return out.select(F.col("_key").alias(key), "lo", "hi", "src", "src_lo", "digest")


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, text: str = "text", key: str = "doc_id",
                   keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: the key) and n_words, n_removed, kept_text: every row of ``docs`` without the words covered by a
    window whose words also start in a document with a smaller key. Words are what stands between white space (space,
    tab to carriage return), unchanged; windows are judged on the input.

    Null and empty texts have no words. A null key is compared with nothing. A key names one text: rows
    that repeat it repeat the text, and are treated alike.
    """
    keep = [key] if keep is None else keep
    spans = repeated_spans(docs, window, anchor, text, key)
    per = staged(spans.groupBy(F.col(key).alias("_k")).agg(F.collect_list(F.struct("lo", "hi", "digest")).alias("_s")), "spans-by-text")
    settle(spans)
    rows = docs.select(F.struct(*keep).alias("_row"), F.col(key).cast("long").alias("_key"), F.col(text).alias("_t"))
    joined = rows.join(per.hint("shuffle_hash"), F.col("_key") == F.col("_k"), "left").select("_row", "_t", "_s")
    schema = joined.select("_row", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"),
                           F.lit("").alias("kept_text")).schema

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_t"):
                data, offsets = view(plain(part, "_t"))
                starts, ends, firsts = words(data, offsets)
                rows, flat = _flat(part.column("_s"))
                change = np.zeros(len(starts) + 1, np.int64)
                if len(rows):
                    lo, hi = (flat.field(n).to_numpy().astype(np.int64) for n in ("lo", "hi"))
                    agrees = _digests(part, rows, lo, hi).view(np.int64) == flat.field("digest").to_numpy()
                    np.add.at(change, (firsts[rows] + lo)[agrees], 1)
                    np.add.at(change, (firsts[rows] + hi)[agrees], -1)
                stay = np.cumsum(change[:-1]) == 0
                left = np.concatenate([[0], np.cumsum(stay)])
                total, kept = np.diff(firsts), np.diff(left[firsts])
                at = np.flatnonzero(stay)
                # Every kept word and the byte after it as its space, but for a text's last kept word.
                more = np.ones(len(at), np.int64)
                more[left[firsts[1:]][kept > 0] - 1] = 0
                edge = np.zeros(len(data) + 2, np.int64)
                edge[starts[at]] = 1
                np.add.at(edge, ends[at] + more, -1)
                inside = np.cumsum(edge[:len(data)]) > 0
                out = data.copy()
                out[(ends[at])[more == 1]] = 0x20
                sizes = np.concatenate([[0], np.cumsum(inside)])[offsets].astype(np.int32)
                texts = pa.Array.from_buffers(pa.string(), part.num_rows, [None, pa.py_buffer(sizes.tobytes()), pa.py_buffer(out[inside].tobytes())])
                yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(total, pa.int64()), pa.array(total - kept, pa.int64()), texts],
                                                 ["_row", "n_words", "n_removed", "kept_text"])

    return joined.mapInArrow(run, schema).select(*[F.col("_row").getField(c).alias(c) for c in keep], "n_words", "n_removed", "kept_text")
