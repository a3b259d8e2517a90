"""Near duplicates: SetSketch registers, bands, a joint likelihood estimate, and full sets.

A text's set holds the hashes of its distinct word shingles. Register i keeps the minimum over the set
of an exponential variable, stored as floor(1 - log_b(minimum)) cut off to a byte: the registers
of a union are the larger of two, and two sets agree in a register with nearly their
similarity as probability. Bands of registers that agree make candidates. How often the registers of two sets are
larger, smaller and equal, with the sets' sizes, gives the likelihood of their similarity; candidates far
below the limit end there. The others are confirmed on their full sets.

Equal sets are one class, which the smallest key represents, and only representatives go on. The smallest member
of a band's bucket is its centre. A representative is first compared with the centre that it shares most bands
with, which joins most of a group without any pairs among its members. Buckets with common members form a cluster,
and every candidate pair lies in one. Where a cluster still holds several components, the members outside its main
component are compared with all of it, in blocks of bounded size: a block counts its full sets' common
shingles by an index, and only links that join two components leave it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import LOWER, boxed, mix, plain, run_hashes, slices, span_hashes, staged, view, words
from .graph import components

BANDS, ROWS = 64, 8
REGISTERS = BANDS * ROWS
BASE, RATE = 1.1, 20.0
SLACK = 0.08
BLOCK = 512
BROADCAST_KEYS = 1_000_000
_SEEDS = np.random.default_rng(7919).integers(0, 1 << 32, (2, REGISTERS), np.int64).astype(np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles of ``size`` words; A-Z lower-cased. A text of
    fewer words is one shingle; without words the set is empty."""
    starts, ends, firsts = words(data, offsets)
    hashes = span_hashes(LOWER[data], starts, ends)
    runs = run_hashes(hashes, size)
    out = []
    for a, b in zip(firsts[:-1], firsts[1:]):
        if b - a >= size:
            out.append(np.unique(runs[a:b - size + 1]))
        elif b > a:
            out.append(run_hashes(hashes[a:b], int(b - a)) ^ mix(np.array([b - a], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """The registers of each set, a row of bytes; zeros for an empty set."""
    out = np.zeros((len(sets), REGISTERS), np.uint8)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    flat = (np.concatenate([sets[i] for i in full]) >> np.uint64(32)).astype(np.uint32)
    sizes = np.array([len(sets[i]) for i in full])
    starts = np.cumsum(sizes) - sizes
    least = np.empty((len(full), REGISTERS), np.uint32)
    work = np.empty(len(flat), np.uint32)
    for i in range(REGISTERS):
        np.bitwise_xor(flat, _SEEDS[0, i], out=work)
        np.multiply(work, _SEEDS[1, i] | np.uint32(1), out=work)
        least[:, i] = np.minimum.reduceat(work, starts)
    minimum = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    out[full] = np.clip(np.floor(1 - np.log(minimum) / np.log(BASE)), 0, 255).astype(np.uint8)
    return out


def similarity(larger: np.ndarray, smaller: np.ndarray, sizes_u: np.ndarray, sizes_v: np.ndarray, steps: int = 64) -> np.ndarray:
    """The likeliest Jaccard similarities, from the numbers of registers where U's is larger and
    smaller than V's, and the sizes of U and V."""
    total = sizes_u + sizes_v
    u, v = (sizes_u / total)[:, None], (sizes_v / total)[:, None]
    j = np.minimum(u / v, v / u) * np.linspace(0, 1, steps + 1)[None, :]

    def above(x):
        return np.clip(-np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1)

    p, q = above(np.maximum(u - v * j, 0)), above(np.maximum(v - u * j, 0))
    equal = (REGISTERS - larger - smaller)[:, None]
    score = larger[:, None] * np.log(p) + smaller[:, None] * np.log(q) + equal * np.log(np.maximum(1 - p - q, 1e-12))
    return j[np.arange(len(j)), score.argmax(1)]


def likely(regs_u: np.ndarray, regs_v: np.ndarray, sizes_u: np.ndarray, sizes_v: np.ndarray, percent: int) -> np.ndarray:
    """False for pairs whose sizes rule a link out or whose estimate is more than ``SLACK`` below the limit."""
    out = 100 * np.minimum(sizes_u, sizes_v) >= percent * np.maximum(sizes_u, sizes_v)
    at = np.flatnonzero(out)
    if len(at):
        a, b = regs_u[at], regs_v[at]
        out[at] = similarity((a > b).sum(1), (a < b).sum(1), sizes_u[at], sizes_v[at]) >= percent / 100 - SLACK
    return out


def _grid(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, REGISTERS)


def sketch_texts(docs: DataFrame, size: int, text: str, key: str) -> DataFrame:
    """Rows _key, n, set_key (a 128-bit hash of the set; null if empty) and regs."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "_t"):
                sets = shingle_sets(*view(plain(part, "_t")), size)
                names = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()),
                     pa.array([r.tobytes() for r in sketches(sets)], pa.binary())], ["_key", "n", "set_key", "regs"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_t")).mapInArrow(
        run, f"_key {kind}, n long, set_key binary, regs binary")


def _texts_of(docs: DataFrame, keys: DataFrame, text: str, key: str) -> DataFrame:
    """The rows of ``keys`` with their texts. Keys are shipped while their number is small, which is counted; else both
    sides are shuffled."""
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_t"))
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys.hint("shuffle_hash"), "_key")


def _full_set(size: int):
    @F.arrow_udf("binary")
    def full_set(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], ["t"])
        return pa.array([s.tobytes() for part in slices(batch, "t") for s in shingle_sets(*view(plain(part, "t")), size)], pa.binary())
    return full_set


def _confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int, text: str, key: str) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets are similar enough."""
    pairs = staged(pairs, "near-pairs")
    if pairs.isEmpty():
        return pairs

    @F.arrow_udf("boolean")
    def linked(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(left.to_pylist(), right.to_pylist()):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(100 * both >= percent * (len(a) + len(b) - both))
        return pa.array(out, pa.bool_())

    full_set = _full_set(size)
    members = _texts_of(docs, pairs.withColumnRenamed("a", "_key"), text, key).select(
        F.col("_key").alias("a"), "b", full_set("_t").alias("_sa"))
    centres = _texts_of(docs, pairs.select(F.col("b").alias("_key")).distinct(), text, key).select(
        F.col("_key").alias("b"), full_set("_t").alias("_sb"))
    return staged(members.join(centres, "b").filter(linked("_sa", "_sb")).select("a", "b").distinct(), "near-links")


def _clusters(members: DataFrame, star: DataFrame) -> DataFrame:
    """rep and cluster: the buckets of ``members`` (rep, centre) joined by common members.

    The pairs of ``star`` make most of a cluster; what other buckets add is counted between those parts only.
    """
    coarse = staged(components(star).select(F.col("node").alias("_n"), F.col("component").alias("_c")), "near-coarse")

    def part(df: DataFrame, column: str) -> DataFrame:
        return df.join(coarse, F.col(column) == F.col("_n"), "left").withColumn(
            f"{column}_part", F.coalesce("_c", column)).drop("_n", "_c")

    pairs = part(part(members.filter("rep <> centre").select("rep", "centre").distinct(), "rep"), "centre")
    fine = components(pairs.select(F.col("rep_part").alias("a"), F.col("centre_part").alias("b")).filter("a <> b").distinct())
    reps = part(members.select("rep").distinct(), "rep")
    return reps.join(fine, F.col("rep_part") == F.col("node"), "left").select("rep", F.coalesce("component", "rep_part").alias("cluster"))


def _cross_links(members: DataFrame, star: DataFrame, labels: DataFrame, docs: DataFrame, size: int, percent: int, text: str,
                 key: str) -> DataFrame:
    """Links (a, b) that join different components of a cluster; ``members`` are (rep, centre) of all buckets."""
    named = _clusters(members, star).join(
        labels.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = staged(named, "near-clusters")
    per = named.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("c"))
    main = per.groupBy("cluster").agg(
        F.max_by("component", F.struct("c", (-F.col("component")).alias("s"))).alias("main"), F.sum("c").alias("all"),
        F.max("c").alias("m"), F.count(F.lit(1)).alias("parts")).filter("parts > 1 AND all > 2")
    main = main.select("cluster", "main", F.ceil((F.col("all") - F.col("m")) / BLOCK).cast("int").alias("i_blocks"),
                       F.ceil(F.col("all") / BLOCK).cast("int").alias("j_blocks"))
    active = staged(named.join(main, "cluster").withColumnRenamed("rep", "_key"), "near-active")
    full = _texts_of(docs, active, text, key).select(
        "cluster", "_key", "component", "i_blocks", "j_blocks", (F.col("component") == F.col("main")).alias("inner"), _full_set(size)("_t").alias("set"))

    def dealt(df: DataFrame, own: str, other: str, side: str) -> DataFrame:
        block = F.pmod(F.xxhash64("_key"), F.col(f"{own}_blocks")).cast("int")
        return df.select("cluster", "_key", "component", "set", F.lit(side).alias("side"), block.alias(own),
                         F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)).alias(other))

    def compare(table: pa.Table) -> pa.Table:
        side = np.array(table.column("side").to_pylist()) == "a"
        keys, parts = (table.column(c).to_numpy() for c in ("_key", "component"))
        sets = [np.frombuffer(s, np.uint64) for s in table.column("set").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        outer, every = np.flatnonzero(side), np.flatnonzero(~side)
        # Every shingle of the inner side with the rows that hold it.
        index = np.concatenate([sets[y] for y in every]) if len(every) else np.zeros(0, np.uint64)
        order = np.argsort(index, kind="stable")
        index, holder = index[order], np.repeat(every, sizes[every])[order]
        joined: dict = {}

        def root(c):
            while c in joined:
                c = joined[c]
            return c

        links = []
        for x in outer:
            low, high = np.searchsorted(index, sets[x], "left"), np.searchsorted(index, sets[x], "right")
            runs = high - low
            at = np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(low, runs)
            both = np.bincount(holder[at], minlength=len(sets))
            near = np.flatnonzero((both > 0) & (100 * both >= percent * (sizes[x] + sizes - both)) & (parts != parts[x]))
            for y in near:
                a, b = root(parts[x]), root(parts[y])
                if a != b:
                    joined[max(a, b)] = min(a, b)
                    links.append((keys[x], keys[y]))
        kind = table.column("_key").type
        return pa.table({"a": pa.array([k[0] for k in links], kind), "b": pa.array([k[1] for k in links], kind)})

    kind = active.schema["_key"].dataType.simpleString()
    blocks = dealt(full.filter("NOT inner"), "i", "j", "a").unionByName(dealt(full, "j", "i", "b"))
    return staged(blocks.groupBy("cluster", "i", "j").applyInArrow(compare, f"a {kind}, b {kind}").distinct(), "near-links")


def components_of(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id, kept.

    Two texts are linked if their sets of distinct ``size``-word shingles (A-Z lower-cased) have
    100 * intersection >= percent * union; a component's id is its smallest key, whose row is ``kept``. Keys are
    integers. Texts without words, null ones included, are linked with nothing. Rows with a null key are
    linked with nothing and kept; component_id is null. A key names one text; rows that repeat both are marked alike.
    """
    rows = staged(sketch_texts(docs, size, text, key), "near-sketches")
    sets = rows.filter("set_key IS NOT NULL AND _key IS NOT NULL").groupBy("set_key").agg(
        F.min(F.struct("_key", "n", "regs")).alias("r"))
    reps = staged(sets.select("set_key", F.col("r._key").alias("rep"), "r.n", "r.regs"), "near-representatives")

    bands = F.array(*[F.struct(F.lit(b).alias("band"), F.xxhash64(F.lit(b), F.substring("regs", b * ROWS + 1, ROWS)).alias("bucket"))
                      for b in range(BANDS)])
    buckets = reps.select("rep", F.explode(bands).alias("x")).select("rep", "x.*")
    shared = buckets.groupBy("bucket").agg(F.min("rep").alias("centre"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = staged(buckets.join(shared, "bucket"), "near-buckets")

    likely_udf = _likely_udf(percent)
    # One centre for each representative, so there are no more pairs than those.
    often = members.filter("rep <> centre").groupBy("rep", "centre").agg(F.count(F.lit(1)).alias("c"))
    star = staged(often.groupBy(F.col("rep").alias("a")).agg(
        F.max_by("centre", F.struct("c", (-F.col("centre")).alias("s"))).alias("b")), "near-stars")
    known = reps.select("rep", "n", "regs")
    near = (star.join(known.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("regs").alias("r_a")), "a")
            .join(known.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("regs").alias("r_b")), "b")
            .filter(likely_udf("r_a", "r_b", "n_a", "n_b")).select("a", "b"))
    links = _confirmed(near, docs, size, percent, text, key)
    labels = components(links)
    more = _cross_links(members, star, labels, docs, size, percent, text, key)
    if not more.isEmpty():
        labels = components(links.unionByName(more))

    named = reps.select("set_key", "rep").join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        "set_key", F.coalesce("component", "rep").alias("component"))
    component = F.when(F.col("set_key").isNull(), F.col("_key")).when(F.col("_key").isNotNull(), F.col("component"))
    return rows.select("_key", "n", "set_key").join(named, "set_key", "left").select(
        F.col("_key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("_key").eqNullSafe(component).alias("kept"))


def _likely_udf(percent: int):
    @F.arrow_udf("boolean")
    def check(r_a: pa.Array, r_b: pa.Array, n_a: pa.Array, n_b: pa.Array) -> pa.Array:
        if not len(r_a):
            return pa.array([], pa.bool_())
        return pa.array(likely(_grid(r_a), _grid(r_b), n_a.to_numpy(), n_b.to_numpy(), percent))
    return check


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each component (the smallest key); all columns as they were."""
    gone = components_of(docs, size, percent, text, key).filter("NOT kept").select(F.col(key).alias("_gone")).distinct()
    return boxed(docs, _key=F.col(key)).join(gone, F.col("_key") == F.col("_gone"), "left_anti").select("_row.*")

