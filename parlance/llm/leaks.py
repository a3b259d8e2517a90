"""Benchmark passages in documents, found with the q-gram lemma and verified by banded alignment.

Both sides are compared byte by byte with Latin letters lower-cased and every white-space byte as a space, so
positions stay those of the source. A passage of n bytes may differ by k edits (a share of n). Each
edit spoils at most q of its n - q + 1 q-grams, and all q-grams of one occurrence lie on diagonals no
more than k apart; so an occurrence has at least n - q + 1 - kq shared q-grams in one of the bands
of 2(k + 1) diagonals that begin at every (k + 1)-th diagonal. Regions that reach this count are
aligned in a band around them, and those within the budget remain. Passages under ``SHORT`` bytes must stand as
they are (so compared), and not begin or end inside a word.

Documents are scanned whole, slice by slice, beside their rows. The passages are shipped in blocks of
a fixed number of bytes, one pass per block; only hits leave a pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import LOWER, SPACES, boxed, plain, slices, span_hashes, staged, view

Q = 8
SHORT = 40
_FOLD = np.where(SPACES, 0x20, LOWER).astype(np.uint8)

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case where it takes as many bytes: A-Z and the accented Latin letters U+00C0 to U+00DE."""
    out = _FOLD[data]
    accented = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    out[1:][accented] += 0x20
    return out


def budget(n: int, share: float, q: int = Q) -> int:
    """Edits allowed in a passage of n bytes: the share, but never so many that the bound falls under 1."""
    return max(0, min(int(n * share), (n - q) // q))


@dataclass(frozen=True)
class Passages:
    """A block of passages and its q-grams by value; as large as the block's bytes allow."""

    ids: list
    bodies: list[bytes]
    edits: np.ndarray
    least: np.ndarray
    values: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    # By length: keys in order, their second hashes, and whose they are.
    short: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]
    heads: np.ndarray


def grams(data: np.ndarray) -> np.ndarray:
    """Every eight neighbouring bytes as one number."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(data) - Q + 1, np.uint64)
    for j in range(Q):
        out |= data[j:j + len(out)].astype(np.uint64) << np.uint64(8 * j)
    return out


def prepare(items: list[tuple[object, str]], share: float) -> Passages:
    bodies = [bytes(fold(np.frombuffer(t.encode(), np.uint8))) for _, t in items]
    parts = [grams(np.frombuffer(b if len(b) >= SHORT else b"", np.uint8)) for b in bodies]
    values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(bodies)), [len(p) for p in parts])
    place = np.concatenate([np.arange(len(p)) for p in parts]) if parts else np.zeros(0, int)
    edits = np.array([budget(len(b), share) if len(b) >= SHORT else 0 for b in bodies], np.int64)
    least = np.array([len(b) - Q + 1 for b in bodies], np.int64) - edits * Q
    order = np.argsort(values, kind="stable")
    return Passages([i for i, _ in items], bodies, edits, least, values[order], owner[order], place[order],
                    *_short_passages(bodies))


def _short_passages(bodies: list[bytes]) -> tuple[list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """Passages under ``SHORT`` bytes by length, and the first bytes of those with more than Q; blank ones have no words to find."""
    some = [i for i, b in enumerate(bodies) if len(b) < SHORT and b.strip()]
    out, heads = [], [np.zeros(0, np.uint64)]
    for length in sorted({len(bodies[i]) for i in some}):
        own = np.array([i for i in some if len(bodies[i]) == length])
        data = np.frombuffer(b"".join(bodies[i] for i in own), np.uint8)
        starts = np.arange(len(own)) * length
        first = _leads(data)[starts]
        keys, second = _keys(data, first, starts, length)
        if length > Q:
            heads.append(first)
        order = np.argsort(keys, kind="stable")
        out.append((length, keys[order], second[order], own[order]))
    return out, np.unique(np.concatenate(heads))


def _leads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the end."""
    return grams(np.concatenate([data, np.zeros(Q - 1, np.uint8)]))


def _keys(data: np.ndarray, first: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to Q bytes as they are; two hashes of more."""
    if length <= Q:
        keys = first & np.uint64((1 << 8 * length) - 1)
        return keys, np.zeros_like(keys)
    return span_hashes(data, starts, starts + length), span_hashes(data, starts, starts + length, second=True)


def edit_distance_within(passage: np.ndarray, window: np.ndarray, most: int, low: int, high: int) -> tuple[int, int]:
    """The least distance of the passage to a part of the window and where that part ends (-1: over ``most``).

    Only cells with low <= column - row <= high are computed: the band. Beginning and end in the window are free.
    """
    n, m = len(passage), len(window)
    width = high - low + 1
    far = n + m + 1
    lane = np.arange(width)
    column = low + lane  # columns of row 0; row i has column + i
    row = np.where((column >= 0) & (column <= m), 0, far)
    padded = np.concatenate([window, np.zeros(1, np.uint8)])
    for i in range(1, n + 1):
        column = column + 1
        inside = (column >= 0) & (column <= m)
        same = padded[np.clip(column - 1, 0, m)] == passage[i - 1]
        best = np.where((column >= 1) & inside, row + ~same, far)      # both move
        best[:-1] = np.minimum(best[:-1], row[1:] + 1)                # only the passage moves
        best = np.where(inside, best, far)
        row = np.minimum.accumulate(best - lane) + lane               # only the window moves
        row = np.where(inside, row, far)
        if row.min() > most:
            return -1, 0
    at = int(row.argmin())
    return (int(row[at]), int(column[at])) if row[at] <= most else (-1, 0)


def verify(passage: bytes, text: np.ndarray, most: int, low: int, high: int) -> tuple[int, int, int] | None:
    """Distance, start and end of an occurrence whose diagonals begin from ``low`` to ``high`` in the text."""
    start, end = max(0, low - most), min(len(text), high + len(passage) + most)
    window = text[start:end]
    exact = bytes(window).find(passage)
    if exact >= 0:
        return 0, start + exact, start + exact + len(passage)
    body = np.frombuffer(passage, np.uint8)
    distance, stop = edit_distance_within(body, window, most, low - start - most, high - start + most)
    if distance < 0:
        return None
    # The same alignment backwards from its end gives the start.
    head = window[max(0, stop - len(passage) - distance):stop][::-1]
    back, length = _from_start(body[::-1], head, distance)
    return distance, start + stop - length, start + stop


def _from_start(passage: np.ndarray, window: np.ndarray, most: int) -> tuple[int, int]:
    """As above, beginning at the window's first byte: the distance and the length of the part."""
    n, m = len(passage), len(window)
    lane = np.arange(m + 1)
    row = lane.copy()
    for i in range(1, n + 1):
        best = np.minimum(row + 1, np.concatenate([[n + m], row[:-1] + (window != passage[i - 1])]))
        row = np.minimum.accumulate(best - lane) + lane
    at = int(row.argmin())
    return int(row[at]), at


def search(passages: Passages, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(text, passage, distance, start, end) of the best occurrence of every passage in every text."""
    if not len(data):
        return []
    text = fold(data)
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    _verbatim(passages, text, offsets, found)
    if not len(passages.values) or len(data) < Q:
        return [(t, p, *rest) for (t, p), rest in sorted(found.items())]
    values = grams(text)
    # A table of 2**20 bits first, then the sorted values.
    def slot(v):
        return (v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)
    table = np.zeros(1 << 20, bool)
    table[slot(passages.values)] = True
    at = np.flatnonzero(table[slot(values)])
    owner = np.searchsorted(offsets, at, "right") - 1
    at, owner = (x[at + Q <= offsets[owner + 1]] for x in (at, owner))
    low = np.searchsorted(passages.values, values[at], "left")
    high = np.searchsorted(passages.values, values[at], "right")
    # Rows of the expansion are taken in steps, so a very common q-gram does not fill the memory; a
    # step ends between texts.
    total = np.cumsum(high - low)
    begin = 0
    while begin < len(at):
        done = total[begin - 1] if begin else 0
        stop = int(np.searchsorted(total, done + 4_000_000, "right"))
        stop = max(stop, begin + 1)
        if stop < len(at):
            edge = int(np.searchsorted(owner, owner[stop], "left"))
            stop = edge if edge > begin else int(np.searchsorted(owner, owner[begin], "right"))
        part = slice(begin, stop)
        _regions(passages, text, offsets, at[part], owner[part], low[part], high[part], found)
        begin = stop
    return [(t, p, *rest) for (t, p), rest in sorted(found.items())]


def _verbatim(passages, text, offsets, found) -> None:
    """The first place of each short passage in each text."""
    if not passages.short:
        return
    inside = np.concatenate([[False], _WORD[text], [False]])
    edge = np.zeros(len(text) + 1, bool)
    edge[offsets] = True
    cut = edge | ~inside[:-1] | ~inside[1:]  # no word goes on here
    starts = np.flatnonzero(cut[:-1])
    leads = _leads(text)[starts]
    home = np.searchsorted(offsets, starts, "right") - 1
    stop = offsets[home + 1]
    headed = None
    for length, keys, second, own in passages.short:
        if length <= Q:
            at = np.flatnonzero(starts + length <= stop)
        else:
            if headed is None:
                place = np.minimum(np.searchsorted(passages.heads, leads), len(passages.heads) - 1)
                headed = np.flatnonzero(passages.heads[place] == leads)
            at = headed[starts[headed] + length <= stop[headed]]
        at = at[cut[starts[at] + length]]
        here, more = _keys(text, leads[at], starts[at], length)
        low, high = np.searchsorted(keys, here, "left"), np.searchsorted(keys, here, "right")
        hit = np.flatnonzero(high > low)
        sizes = (high - low)[hit]
        which = np.repeat(hit, sizes)
        entry = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low[hit], sizes)
        same = second[entry] == more[which]
        which, item = at[which[same]], own[entry[same]]
        _, first = np.unique(home[which] * len(passages.ids) + item, return_index=True)
        for i in first:
            t, begin = int(home[which[i]]), int(starts[which[i]])
            begin -= int(offsets[t])
            found[t, int(item[i])] = 0, begin, begin + length


def _regions(passages, text, offsets, at, owner, low, high, found) -> None:
    sizes = high - low
    if not sizes.sum():
        return
    which = np.repeat(np.arange(len(at)), sizes)
    entry = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)
    item, home = passages.owner[entry], owner[which]
    step = passages.edits[item] + 1
    longest = max(map(len, passages.bodies))
    band = (at[which] - offsets[home] - passages.place[entry] + longest) // step
    bands = int(longest + np.diff(offsets).max()) + 2
    key = np.sort((home * len(passages.ids) + item) * bands + band)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    # A region is a band and the next one; both of its halves may be the only one with hits.
    after = np.where(np.append(key[1:], -1) == key + 1, np.append(count[1:], 0), 0)
    before = np.where(np.concatenate([[-1], key[:-1]]) == key - 1, np.concatenate([[0], count[:-1]]), 0)
    pair = key // bands
    good = np.flatnonzero(count + np.maximum(after, before) >= passages.least[pair % len(passages.ids)])
    run = np.flatnonzero(np.concatenate([[True], np.diff(key[good]) > 1])) if len(good) else []
    for i, head in enumerate(run):
        tail = run[i + 1] - 1 if i + 1 < len(run) else len(good) - 1
        home, item = divmod(int(pair[good[head]]), len(passages.ids))
        if int(pair[good[tail]]) != pair[good[head]]:
            # Neighbouring keys of two passages; each is looked at alone.
            groups = [(g, g) for g in range(head, tail + 1)]
        else:
            groups = [(head, tail)]
        for a, b in groups:
            home, item = divmod(int(pair[good[a]]), len(passages.ids))
            edits = int(passages.edits[item])
            # The band itself and one on each side: wide enough for every occurrence counted here.
            near = (int(key[good[a]] % bands) - 1) * (edits + 1) - longest
            far = (int(key[good[b]] % bands) + 2) * (edits + 1) - longest
            known = found.get((home, item))
            if known and known[0] == 0:
                continue
            hit = verify(passages.bodies[item], text[offsets[home]:offsets[home + 1]], edits, near, far)
            if hit and (known is None or hit < known):
                found[home, item] = hit


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id",
         share: float = 0.1, least_bytes: int = Q, block_bytes: int = 1 << 20) -> DataFrame:
    """Rows key, item, distance, start, end (bytes of the UTF-8 text): the best occurrence of a passage in a document.

    ``share`` of a passage's bytes may be edited; one under ``SHORT`` bytes must stand verbatim, as whole words. A part
    of a passage does not count. Passages under ``least_bytes`` are not looked for, nor are null or blank ones; 1 takes
    all. Equal rows count once. Empty and null texts have no hits.
    """
    wanted = benchmark.select(F.col(item).alias("_i"), F.col("text").alias("_t")).filter(
        F.octet_length("_t") >= least_bytes).distinct()
    size = wanted.agg(F.sum(F.octet_length("_t"))).first()[0] or 0
    blocks = max(1, -(-size * 3 // (2 * block_bytes)))
    schema = f"_k {docs.schema[key].dataType.simpleString()}, hits array<struct<p:int,distance:int,start:int,end:int>>"
    kind = pa.list_(pa.struct([(n, pa.int32()) for n in ("p", "distance", "start", "end")]))
    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    out = None
    for block in range(blocks):
        # A block is bounded; a single longer passage is a block's largest part.
        mine = wanted.filter(F.pmod(F.xxhash64("_i", "_t"), F.lit(blocks)) == block).orderBy("_i", "_t").collect()
        passages = prepare([(r["_i"], r["_t"]) for r in mine], share)

        def run(batches, passages=passages):
            for batch in batches:
                hits: list[list[dict]] = []
                for part in slices(batch, "_t"):
                    own: list[list[dict]] = [[] for _ in range(part.num_rows)]
                    for t, p, d, a, b in search(passages, *view(plain(part, "_t"))):
                        own[t].append({"p": p, "distance": d, "start": a, "end": b})
                    hits += own
                found = np.array([len(h) > 0 for h in hits], bool)
                made = pa.RecordBatch.from_arrays([batch.column("_k"), pa.array(hits, kind)], ["_k", "hits"])
                yield made.filter(pa.array(found))

        names = docs.sparkSession.createDataFrame(
            [(n, i) for n, i in enumerate(passages.ids)], f"p int, _i {benchmark.schema[item].dataType.simpleString()}")
        hit = rows.mapInArrow(run, schema).select("_k", F.explode("hits").alias("h")).join(F.broadcast(names), F.col("h.p") == F.col("p"))
        hit = staged(hit.select(F.col("_k").alias(key), F.col("_i").alias(item), "h.distance", "h.start", "h.end"), "leaks")
        out = hit if out is None else out.unionByName(hit)
    return out.groupBy(key, item).agg(F.min(F.struct("distance", "start", "end")).alias("h")).select(key, item, "h.*")


def by_document(hits: DataFrame, key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """One row per contaminated key: n_items, items (an ordered array), least_distance. A benchmark bounds the array."""
    return hits.groupBy(key).agg(F.count(F.lit(1)).alias("n_items"), F.sort_array(F.collect_list(item)).alias("items"),
                                 F.min("distance").alias("least_distance"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", **settings) -> DataFrame:
    """``docs`` without the documents that hold a passage; all columns as they were."""
    keys = find(docs, benchmark, text, key, **settings).select(F.col(key).alias("_bad")).distinct()
    rows = boxed(docs, _key=F.col(key))
    return rows.join(keys, F.col("_key").eqNullSafe(F.col("_bad")), "left_anti").select("_row.*")


def listed(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda i: i.cast("string")), ",")
