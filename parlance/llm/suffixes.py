"""Repeated byte strings by a common-prefix-aware distributed merge sort of suffixes.

A string of 100 bytes that occurs twice holds the same anchor (the 32 bytes with the least hash in it) at the
same place, so a sparse suffix array is enough: the suffixes that begin at anchors which occur more than once.

Each task sorts such suffixes with what stands before them into runs. A run is front-coded (the length of the prefix
shared with the suffix before, and the rest), cut at the splitters of a sample, and exchanged. A
partition's runs are combined by a loser tree that knows the prefix every candidate shares with the last winner:
two candidates with different shared prefixes are told apart by these lengths, and others are compared
only behind the prefix. The merged order and its common prefixes give, for every anchor, which strings around
it have an equal one that starts earlier.

Suffixes with equal surroundings leave a task as one entry, so copies cost a task one entry. An anchor
with more than ``WIDE`` occurrences does not go to one partition: its strings are grouped one by one by a
128-bit hash instead, summed before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import anchors
from .common import _TABLE, mix, plain, settle, slices, sliding_least, staged, view

LENGTH, GRAM = 100, 32
RUN = 100_000
ENTRIES = 100_000
SAMPLED = 16
WIDE = 1_000_000
SLICE = 1 << 18
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of every ``gram`` (a power of two) neighbouring bytes."""
    out, have = _TABLE[data], 1
    factor = 0x9E3779B97F4A7C15
    while have < gram:
        if len(out) <= have:
            return out[:0]
        out = out[:-have] * np.uint64(factor) + out[have:]
        factor = factor * factor % (1 << 64) | 1
        have *= 2
    return mix(out)


def anchor_places(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Text, position and hash of the anchors of all texts: those with the least hash in some string of ``length`` bytes."""
    hashes = gram_hashes(data, gram)
    span = length - gram + 1
    least = sliding_least(hashes, span)
    if not len(least):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), hashes[:0]
    # Strings that cross a text's end are none: their least counts as 0.
    crossing = np.zeros(len(least) + length, bool)
    for end in offsets[1:-1]:
        crossing[max(0, end - length + 1):end] = True
    least = np.where(crossing[:len(least)], np.uint64(0), least + np.uint64(0))
    # An anchor equals the largest least of the strings that hold it, as none of these is larger than itself.
    padded = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
    most = _TOP - sliding_least(_TOP - padded, span)
    at = np.flatnonzero((most[:len(hashes)] == hashes) & (hashes > 0))
    return np.searchsorted(offsets, at, "right") - 1, at, hashes[at]


def _anchors(docs: DataFrame) -> DataFrame:
    """Rows (_key, gs): a text's anchors, one that it repeats twice."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "_t", SLICE):
                text, _, g = anchor_places(*view(plain(part, "_t")))
                order = np.lexsort((g, text))
                text, g = text[order], g[order]
                third = np.zeros(len(g), bool)
                third[2:] = (g[2:] == g[:-2]) & (text[2:] == text[:-2])
                text, g = text[~third], g[~third]
                ends = np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_key"), pa.ListArray.from_arrays(pa.array(ends), pa.array(g.view(np.int64)))], ["_key", "gs"])

    return docs.select("_key", "_t").mapInArrow(run, "_key long, gs array<long>").filter("size(gs) > 0")


class Entries:
    """Suffixes at anchors: the bytes from the anchor on, those before it (nearest first), how many of both are the
    text's own, and key and position of the anchor."""

    def __init__(self, right, left, rlen, llen, key, pos):
        self.right, self.left, self.rlen, self.llen, self.key, self.pos = right, left, rlen, llen, key, pos

    def __len__(self):
        return len(self.key)

    def take(self, at) -> Entries:
        return Entries(*(x[at] for x in (self.right, self.left, self.rlen, self.llen, self.key, self.pos)))

    @staticmethod
    def concat(parts: list[Entries]) -> Entries:
        return Entries(*(np.concatenate([getattr(p, n) for p in parts]) for n in ("right", "left", "rlen", "llen", "key", "pos")))

    def rows(self) -> np.ndarray:
        """One comparable value per entry: suffix, surroundings and their lengths."""
        full = np.concatenate([self.right, self.left, self.rlen[:, None] + 1, self.llen[:, None] + 1], axis=1)
        return np.ascontiguousarray(full).view(f"S{full.shape[1]}").ravel()


def entries_at(data, offsets, text, at, keys) -> Entries:
    padded = np.concatenate([np.zeros(LENGTH, np.uint8), data, np.zeros(LENGTH, np.uint8)])
    rlen = np.minimum(offsets[text + 1] - at, LENGTH)
    llen = np.minimum(at - offsets[text], LENGTH - GRAM)
    ahead, behind = np.arange(LENGTH), np.arange(LENGTH - GRAM)
    right = padded[at[:, None] + LENGTH + ahead] * (ahead < rlen[:, None])
    left = padded[at[:, None] + LENGTH - 1 - behind] * (behind < llen[:, None])
    return Entries(right.astype(np.uint8), left.astype(np.uint8), rlen.astype(np.uint8), llen.astype(np.uint8), keys[text], (at - offsets[text]).astype(np.int32))


def common_prefixes(rows: np.ndarray) -> np.ndarray:
    """How many bytes each row shares with the one before it."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differs = rows[1:] != rows[:-1]
        out[1:] = np.where(differs.any(1), differs.argmax(1), rows.shape[1])
    return out


def collapse(entries: Entries) -> tuple[Entries, np.ndarray, np.ndarray, np.ndarray]:
    """Sorts entries and keeps the earliest of equal ones; also key, first and last start of the strings of the later ones."""
    values = entries.rows()
    order = np.lexsort((entries.pos, entries.key, values))
    entries, values = entries.take(order), values[order]
    new = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, bool)
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(values) else np.zeros(0, int)
    # An entry at the same place (a repeated row) is no later one.
    later = ~new & ((entries.key != entries.key[head]) | (entries.pos != entries.pos[head]))
    gone = entries.take(later)
    lo = gone.pos - gone.llen
    hi = gone.pos - np.maximum(0, LENGTH - gone.rlen.astype(np.int64))
    fits = lo <= hi
    return entries.take(new), gone.key[fits], lo[fits].astype(np.int64), hi[fits]


def encode_run(entries: Entries) -> bytes:
    """A sorted run, front-coded."""
    lcp = common_prefixes(entries.right)
    keep = np.arange(LENGTH)[None, :] >= lcp[:, None]
    parts = [np.array([len(entries)], np.int64), lcp.astype(np.uint8), entries.rlen, entries.llen, entries.key.astype(np.int64),
             entries.pos.astype(np.int32), entries.left, entries.right[keep]]
    return b"".join(np.ascontiguousarray(p).tobytes() for p in parts)


def decode_run(blob: bytes) -> tuple[Entries, np.ndarray]:
    """The entries of a run and the shared prefixes it was coded with."""
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    at = 8

    def next_(kind, count):
        nonlocal at
        out = np.frombuffer(blob, kind, count, at)
        at += out.nbytes
        return out

    lcp, rlen, llen = (next_(np.uint8, n) for _ in range(3))
    key, pos = next_(np.int64, n), next_(np.int32, n)
    left = next_(np.uint8, n * (LENGTH - GRAM)).reshape(n, -1)
    rest = next_(np.uint8, (len(blob) - at))
    right = np.zeros((n, LENGTH), np.uint8)
    keep = np.arange(LENGTH)[None, :] >= lcp[:, None]
    right[keep] = rest
    # A column comes from the last row that has its own byte there.
    own = np.where(keep, np.arange(n)[:, None], 0)
    np.maximum.accumulate(own, axis=0, out=own)
    return Entries(right[own, np.arange(LENGTH)[None, :]], left, rlen, llen, key, pos), lcp.astype(np.int64)


def merge(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges sorted runs (rows of bytes, prefix shared with the row before): run, row and shared prefix of the merged order.

    A loser tree over the runs. Every player carries the prefix it shares with the last winner.
    """
    rows = [[r.tobytes() for r in right] for right, _ in runs]
    shared = [lcp.tolist() for _, lcp in runs]
    k = 1
    while k < len(runs):
        k *= 2
    place = [0] * k
    loser: list[tuple[int, int]] = [(-1, 0)] * k  # inner nodes: run and its prefix shared with the winner that passed

    def beats(a: int, la: int, b: int, lb: int) -> tuple[int, int, int, int]:
        """Winner and loser with the loser's prefix shared with the winner; -1 is an empty run."""
        if a < 0 or b < 0:
            return (b, lb, a, la) if a < 0 else (a, la, b, lb)
        if la != lb:  # the one that shares more with the last winner is smaller, and they part where the other did
            return (a, la, b, lb) if la > lb else (b, lb, a, la)
        x, y = rows[a][place[a]], rows[b][place[b]]
        if x == y:
            return (a, la, b, len(x)) if a < b else (b, lb, a, len(x))
        rest = len(x) - la
        apart = int.from_bytes(x[la:], "big") ^ int.from_bytes(y[la:], "big")
        same = la + rest - (apart.bit_length() + 7) // 8
        return (a, la, b, same) if x[same] < y[same] else (b, lb, a, same)

    def build(node: int) -> tuple[int, int]:
        if node >= k:
            run = node - k
            return (run if run < len(runs) and rows[run] else -1), 0
        a, la = build(2 * node)
        b, lb = build(2 * node + 1)
        w, lw, l, ll = beats(a, la, b, lb)
        loser[node] = (l, ll)
        return w, lw

    winner, prefix = build(1)
    total = sum(map(len, rows))
    out_run, out_row, out_lcp = np.empty(total, np.int32), np.empty(total, np.int64), np.empty(total, np.int64)
    for n in range(total):
        out_run[n], out_row[n], out_lcp[n] = winner, place[winner], prefix
        node = (winner + k) >> 1
        place[winner] += 1
        if place[winner] < len(rows[winner]):
            prefix = shared[winner][place[winner]]
        else:
            winner, prefix = -1, 0
        while node:
            b, lb = loser[node]
            winner, prefix, l, ll = beats(winner, prefix, b, lb)
            loser[node] = (l, ll)
            node >>= 1
    return out_run, out_row, out_lcp


def repeats_in(entries: Entries, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, first and last start of strings that occur earlier, for entries in suffix order with their shared prefixes."""
    found = []
    # Equal surroundings first: all later ones repeat the earliest.
    block = np.cumsum(lcp < LENGTH)
    left = np.ascontiguousarray(np.concatenate([entries.left, entries.rlen[:, None] + 1, entries.llen[:, None] + 1], axis=1))
    left = left.view(f"S{left.shape[1]}").ravel()
    order = np.lexsort((entries.pos, entries.key, left, block))
    e, b, v = entries.take(order), block[order], left[order]
    new = np.ones(len(e), bool)
    new[1:] = (b[1:] != b[:-1]) | (v[1:] != v[:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = ~new & ((e.key != e.key[head]) | (e.pos != e.pos[head]))
    gone = e.take(later)
    found.append((gone.key, gone.pos.astype(np.int64) - gone.llen, gone.pos - np.maximum(0, LENGTH - gone.rlen.astype(np.int64))))
    # Groups with one anchor but different surroundings.
    group = np.cumsum(lcp < GRAM)[order]
    e, b, group = e.take(new), b[new], group[new]
    size = np.bincount(group)[group]
    mixed = size > 1
    e, b, group = e.take(mixed), b[mixed], group[mixed]
    if len(e):
        found.append(_strings(e, lcp, b))
    key, lo, hi = (np.concatenate([f[i] for f in found]) for i in range(3))
    fits = lo <= hi
    return key[fits], lo[fits], hi[fits]


def _strings(e: Entries, lcp: np.ndarray, block: np.ndarray):
    """String by string: the string that begins o bytes before the anchor is the o bytes before it and LENGTH - o from it on."""
    n = len(e)
    order = np.lexsort((e.pos, e.key))
    rank = np.empty(n, np.int64)
    place = np.concatenate([[0], np.cumsum((e.key[order][1:] != e.key[order][:-1]) | (e.pos[order][1:] != e.pos[order][:-1]))])
    rank[order] = place
    # Shared prefixes between blocks of equal suffixes, as a class number for every length.
    first = np.flatnonzero(lcp < LENGTH)
    steps = lcp[first]
    left = np.ascontiguousarray(e.left).view(f"S{e.left.shape[1]}").ravel()
    by_left = np.argsort(left, kind="stable")
    left_steps = common_prefixes(e.left[by_left])
    repeated = np.zeros((n, LENGTH - GRAM + 1), bool)
    for o in range(LENGTH - GRAM + 1):
        need = LENGTH - o
        ok = np.flatnonzero((e.rlen >= need) & (e.llen >= o))
        if len(ok) < 2:
            continue
        right_class = np.cumsum(steps < need)[block[ok] - 1]
        classes = np.empty(n, np.int64)
        classes[by_left] = np.cumsum(left_steps < o)
        value = right_class * (n + 1) + classes[ok]
        sort = np.argsort(value, kind="stable")
        value, ranks = value[sort], rank[ok][sort]
        starts = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        least = np.repeat(np.minimum.reduceat(ranks, starts), np.diff(np.append(starts, len(value))))
        repeated[ok[sort], o] = ranks > least
    edge = np.diff(np.concatenate([np.zeros((n, 1), np.int8), repeated.astype(np.int8), np.zeros((n, 1), np.int8)], axis=1), axis=1)
    row, begin = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    pos = e.pos[row].astype(np.int64)
    return e.key[row], pos - (end - 1), pos - begin


def _kept_places(part: pa.RecordBatch, column: str):
    """The anchors of a slice whose hash is in the row's list."""
    data, offsets = view(plain(part, "_t"))
    text, at, g = anchor_places(data, offsets)
    wanted = part.column(column)
    keep = np.zeros(len(at), bool)
    cuts = np.searchsorted(text, np.arange(part.num_rows + 1))
    for i in range(part.num_rows):
        own = wanted[i].values
        if own is not None and len(own):
            here = slice(cuts[i], cuts[i + 1])
            keep[here] = np.isin(g[here], own.to_numpy().view(np.uint64))
    return data, offsets, text[keep], at[keep]


def _leading(right: np.ndarray) -> np.ndarray:
    """The anchors themselves, as comparable values: a range may be cut between any two of them, and not inside one."""
    return np.ascontiguousarray(right[:, :GRAM]).view(f"S{GRAM}").ravel()


def united(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of starts, with those of one key that touch or overlap put together: a copied text is one range, not one for each anchor."""
    order = np.lexsort((lo, key))
    key, lo, hi = key[order], lo[order], hi[order]
    if not len(key):
        return key, lo, hi
    # Ends run on within a key, so they are compared as offsets from a base that grows with every key.
    turn = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    base = turn * (int(hi.max()) + 2)
    reach = np.maximum.accumulate(hi + base)
    new = np.concatenate([[True], lo[1:] + base[1:] > reach[:-1] + 1]) | np.concatenate([[True], key[1:] != key[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(key)) - 1
    return key[first], lo[first], reach[last] - base[last]


_RUN = "p int, blob binary, keys array<long>, los array<long>, his array<long>"


def _sorted_runs(docs: DataFrame, splitters: list[bytes]) -> DataFrame:
    """Rows (p, blob, keys, los, his): a partition's share of a run, and ranges of starts already known, dealt over the shares."""
    cuts = np.array(splitters, f"S{GRAM}")

    def cut(entries: list[Entries]) -> Iterator[pa.RecordBatch]:
        whole, key, lo, hi = collapse(Entries.concat(entries))
        key, lo, hi = united(key, lo, hi)
        target = np.searchsorted(cuts, _leading(whole.right), "right")
        at = np.searchsorted(target, np.arange(len(cuts) + 2))
        made = [(p, encode_run(whole.take(slice(at[p], at[p + 1])))) for p in range(len(cuts) + 1) if at[p + 1] > at[p]]
        ends = pa.array(np.linspace(0, len(key), len(made) + 1).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in made], pa.int32()), pa.array([b for _, b in made], pa.binary()),
             *[pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int64))) for x in (key, lo, hi)]], ["p", "blob", "keys", "los", "his"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "_t", SLICE):
                data, offsets, text, at = _kept_places(part, "gs")
                keys = part.column("_key").to_numpy()
                for i in range(0, len(at), RUN):
                    held.append(entries_at(data, offsets, text[i:i + RUN], at[i:i + RUN], keys))
                    size += len(held[-1])
                    if size >= RUN:
                        yield from cut(held)
                        held, size = [], 0
        if held:
            yield from cut(held)

    return docs.mapInArrow(run, _RUN)


def _merged(table: pa.Table) -> pa.Table:
    runs = [decode_run(b) for b in table.column("blob").to_pylist()]
    which, row, lcp = merge([(e.right, shared) for e, shared in runs])
    firsts = np.cumsum([0] + [len(e) for e, _ in runs])[:-1]
    whole = Entries.concat([e for e, _ in runs]).take(firsts[which] + row)
    known = [table.column(c).combine_chunks().flatten().to_numpy() for c in ("keys", "los", "his")]
    key, lo, hi = united(*(np.concatenate(both) for both in zip(repeats_in(whole, lcp), known)))
    return pa.table({"_key": pa.array(key, pa.int64()), "lo": pa.array(lo, pa.int64()), "hi": pa.array(hi, pa.int64())})


def _wide_strings(docs: DataFrame) -> DataFrame:
    """Rows (_key, lo, hi) for anchors too frequent for one partition: each string by its 128-bit hash."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "_t", SLICE):
                data, offsets, text, at = _kept_places(part, "wide")
                start = (at[:, None] - np.arange(LENGTH - GRAM + 1)[None, :])
                ok = (start >= offsets[text][:, None]) & (start + LENGTH <= offsets[text + 1][:, None])
                start = np.unique(start[ok])
                owner = np.searchsorted(offsets, start, "right") - 1
                raw = data.tobytes()
                made = [hashlib.blake2b(raw[s:s + LENGTH], digest_size=16).digest() for s in start.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), part.column("_key").take(pa.array(owner)),
                                                  pa.array(start - offsets[owner], pa.int64())], ["d", "_key", "lo"])

    rows = staged(docs.mapInArrow(run, "d binary, _key long, lo long"), "wide")
    first = rows.groupBy("d").agg(F.min(F.struct("_key", "lo")).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = rows.join(first, "d").filter(F.struct("_key", "lo") > F.col("f"))
    return again.select("_key", "lo", F.col("lo").alias("hi"))


def repeated_starts(docs: DataFrame, text: str = "text", key: str = "doc_id", wide: int = WIDE, entries: int = ENTRIES) -> DataFrame:
    """Rows key, starts (array of lo, hi): bytes at which a string of ``LENGTH`` bytes begins that also begins earlier."""
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_t")).filter("_key IS NOT NULL")
    kept = anchors.repeated_counted(_anchors(rows), wide)
    numbers = kept.agg(F.count(F.lit(1)).alias("texts"), F.sum(F.size("gs")).alias("n"), F.sum(F.size("wide")).alias("w")).first()
    with_text = rows.join(kept.hint("shuffle_hash"), "_key")
    parts = max(1, -(-(numbers["n"] or 0) // entries))
    splitters = _splitters(with_text, numbers["texts"], numbers["n"], parts) if parts > 1 else []
    runs = _sorted_runs(with_text.filter("size(gs) > 0"), splitters)
    found = runs.groupBy("p").applyInArrow(_merged, "_key long, lo long, hi long")
    if numbers["w"]:
        found = found.unionByName(_wide_strings(with_text.filter("size(wide) > 0")))
    # One text's starts make one row.
    out = staged(found.groupBy("_key").agg(F.collect_list(F.struct("lo", "hi")).alias("starts")), "starts")
    settle(kept)
    return out.withColumnRenamed("_key", key)


def _splitters(with_text: DataFrame, texts: int, n: int, parts: int) -> list[bytes]:
    """Anchors that cut all suffixes into ``parts`` ranges, from about ``SAMPLED`` for each range: 32 bytes each, of texts and
    places picked by a hash. They shape the partitions and not the result."""
    share = min(1.0, max(2000, 4 * parts) / texts)
    rate = min(1.0, SAMPLED * parts / (n * share))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_t", SLICE):
                data, offsets, text, at = _kept_places(part, "gs")
                keys = part.column("_key").to_numpy()
                draw = mix(keys[text].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (at - offsets[text]).astype(np.uint64))
                picked = (draw >> np.uint64(11)).astype(np.float64) < rate * (1 << 53)
                made = entries_at(data, offsets, text[picked], at[picked], keys)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in made.right[:, :GRAM]], pa.binary())], ["x"])

    some = F.pmod(F.xxhash64(F.lit("split"), "_key"), F.lit(1 << 32)) < int(share * (1 << 32))
    found = np.sort(np.array(with_text.filter(some).mapInArrow(run, "x binary").toArrow().column("x").to_pylist(), f"S{GRAM}"))
    at = np.arange(1, parts) * len(found) // parts
    return np.unique(found[at]).tolist() if len(found) else []


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: list[str] | None = None, **settings) -> DataFrame:
    """The columns ``keep`` (default: the key) and n_bytes, n_removed, n_spans, kept: every row of ``docs`` without the bytes covered
    by a string of ``LENGTH`` bytes that also starts earlier, in a smaller key or further ahead in the text.

    ``kept`` is binary, as a cut may fall inside a character. Strings are judged on the input, and do not cross texts.
    Null and empty texts have no bytes. A null key is compared with nothing. A key names one text: rows that repeat it
    repeat the text, and are treated alike.
    """
    keep = [key] if keep is None else keep
    starts = repeated_starts(docs, text, key, **settings).select(F.col(key).alias("_k"), "starts")
    rows = docs.select(F.struct(*keep).alias("_row"), F.col(key).cast("long").alias("_key"), F.col(text).alias("_t"))
    joined = rows.join(starts.hint("shuffle_hash"), F.col("_key") == F.col("_k"), "left").select("_row", "_t", "starts")
    number = F.lit(0).cast("long")
    schema = joined.select("_row", number.alias("n_bytes"), number.alias("n_removed"), number.alias("n_spans"), F.lit(b"").alias("kept")).schema

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_t"):
                data, offsets = view(plain(part, "_t"))
                lists = part.column("starts")
                size, gone, spans, kept = [], [], [], []
                for i in range(part.num_rows):
                    body = data[offsets[i]:offsets[i + 1]]
                    change = np.zeros(len(body) + 1, np.int32)
                    own = lists[i].values
                    if own is not None and len(own):
                        np.add.at(change, own.field("lo").to_numpy(), 1)
                        np.add.at(change, own.field("hi").to_numpy() + LENGTH, -1)
                    out = np.cumsum(change[:-1]) > 0
                    size.append(len(body))
                    gone.append(int(out.sum()))
                    spans.append(int((np.diff(out.astype(np.int8), prepend=0) == 1).sum()))
                    kept.append(body[~out].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column("_row"), *[pa.array(x, pa.int64()) for x in (size, gone, spans)], pa.array(kept, pa.binary())],
                    ["_row", "n_bytes", "n_removed", "n_spans", "kept"])

    made = joined.mapInArrow(run, schema)
    return made.select(*[F.col("_row").getField(c).alias(c) for c in keep], "n_bytes", "n_removed", "n_spans", "kept")
