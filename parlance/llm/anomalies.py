"""Quality rules with an isolation forest on their statistics.

Two base rules always fail a text: too few words, or too large a part of it in windows of eight words that come
again. The other texts are judged by an isolation forest: each tree splits a small sample of texts at random places of
random rule statistics until every text stands alone, and texts that are unlike most need few splits. The mean path
length over all trees gives a score from 0 to 1 (2 to the power of minus path length over its expectation; higher is odder).
What score is too odd is read off labelled texts.

Texts are read once; their statistics, a few numbers each, are written, and the sample, the threshold and the
verdicts come from those. The forest is bounded by ``trees`` and ``sample`` and travels with the job.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACES, held_out, plain, run_hashes, slices, span_hashes, staged, view, words

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
# What the forest sees; none of it grows with a text's length.
STATISTICS = ["word_length", "symbols_per_word", "bare_words", "dup_lines", "repeat_words", "open_lines"]
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # in a hundred
BINS = 10_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:;\"')]}")] = True
_STOP[128:] = True  # full stops of other scripts


# -- statistics of a slice of texts -----------------------------------------------------------------

def _again(owner: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of items (owner, code): whether an equal one comes before, and whether there is an equal one at all."""
    order = np.lexsort((code, owner))  # stable, so equal items stay in order
    same = (owner[order][1:] == owner[order][:-1]) & (code[order][1:] == code[order][:-1])
    later, any_ = np.zeros(len(code), bool), np.zeros(len(code), bool)
    later[order[1:]] = same
    any_[order[1:]] = same
    any_[order[:-1]] |= same
    return later, any_


def measure(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row of ``COUNTS`` (integers) and one of ``STATISTICS`` for each text."""
    texts = len(offsets) - 1

    def summed(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    def by_text(owner: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(owner, values, texts)[:texts].astype(np.int64)

    starts, ends, firsts = words(data, offsets)
    word_of = np.repeat(np.arange(texts), np.diff(firsts))
    n = np.diff(firsts)
    ink = ~SPACES[data]
    point = (data & 0xC0) != 0x80
    points = np.concatenate([[0], np.cumsum(point, dtype=np.int64)])
    length = points[ends] - points[starts]
    letters = np.concatenate([[0], np.cumsum(_LETTER[data], dtype=np.int64)])
    bare = letters[ends] == letters[starts]

    # Lines: from the start of a text or after a break, to the next break or the end.
    breaks = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    line_ends = np.concatenate([line_starts[1:], [len(data)]])
    line_of = np.searchsorted(offsets, line_starts, "right") - 1
    # The break is no part of its line. One at the very end of a text leaves an empty line, which counts for no text.
    line_ends = line_ends - ((line_ends > line_starts) & (np.append(data, 0)[line_ends - 1] == 10))
    inked = np.concatenate([[0], np.cumsum(ink, dtype=np.int64)])
    line = inked[line_ends] > inked[line_starts]
    line_starts, line_ends, line_of = line_starts[line], line_ends[line], line_of[line]
    copy, _ = _again(line_of, span_hashes(data, line_starts, line_ends)) if len(line_of) else (np.zeros(0, bool), None)
    lines = by_text(line_of)
    # The last word of a line tells how it ends.
    last = np.searchsorted(starts, line_ends, "left") - 1
    open_ = ~_STOP[data[ends[last] - 1]] if len(last) else np.zeros(0, bool)

    repeated = np.zeros(len(starts) + 1, np.int64)
    if len(starts) >= WINDOW:
        inside = word_of[WINDOW - 1:] == word_of[:len(starts) - WINDOW + 1]
        place = np.flatnonzero(inside)
        code = run_hashes(span_hashes(data, starts, ends), WINDOW)[place]
        _, twice = _again(word_of[place], code)
        np.add.at(repeated, place[twice], 1)
        np.add.at(repeated, place[twice] + WINDOW, -1)
    covered = np.cumsum(repeated)[:-1] > 0

    chars, symbols, dup, again = by_text(word_of, length), summed(_SYMBOL[data]), by_text(line_of[copy]), by_text(word_of[covered])
    some, some_lines = np.maximum(n, 1), np.maximum(lines, 1)
    statistics = np.column_stack([chars / some, symbols / some, by_text(word_of[bare]) / some, dup / some_lines, again / some,
                                  by_text(line_of[open_]) / some_lines])
    return np.column_stack([n, chars, symbols, dup, again]).astype(np.int64), statistics


def base_failed() -> Column:
    n = F.col("n_words")
    return (n < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * n)


def measured(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: the key) of every row, ``COUNTS``, statistics (an array in the order of ``STATISTICS``)
    and base_failed. A null text counts as empty."""
    keep = [key] if keep is None else keep
    if clash := set(keep) & {*COUNTS, "statistics", "base_failed", "score", "kept"}:
        raise ValueError(f"the rows already have {sorted(clash)}")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), F.col(text).alias("_t"))
    schema = rows.select("_row", *[F.lit(0).cast("long").alias(c) for c in COUNTS], F.array(F.lit(0.0)).alias("statistics")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_t"):
                counts, statistics = measure(*view(plain(part, "_t")))
                ends = pa.array(np.arange(len(counts) + 1, dtype=np.int32) * statistics.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [part.column("_row"), *[pa.array(np.ascontiguousarray(c)) for c in counts.T],
                     pa.ListArray.from_arrays(ends, pa.array(statistics.ravel()))], schema.names)

    made = rows.mapInArrow(run, schema)
    return made.select(*[F.col("_row").getField(c).alias(c) for c in keep], *COUNTS, "statistics", base_failed().alias("base_failed"))


# -- the forest -------------------------------------------------------------------------------------

def expected_path(n: np.ndarray) -> np.ndarray:
    """The mean path length of an unsuccessful search in a binary tree of ``n`` rows."""
    n = np.asarray(n, float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class Forest:
    """All trees in one set of node arrays. A leaf has itself as both children; ``path`` is a leaf's depth and what its
    rows would still need."""

    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    children: np.ndarray
    path: np.ndarray
    depth: int
    expected: float

    @classmethod
    def grown(cls, rows: np.ndarray, sample: int, seed: int = 1) -> Forest:
        """A tree for every ``sample`` rows; a last incomplete sample makes one too."""
        rng = np.random.default_rng(seed)
        most = max(1, int(np.ceil(np.log2(max(min(sample, len(rows)), 2)))))
        feature, cut, children, path, roots = [], [], [], [], []
        for lo in range(0, len(rows), sample):
            roots.append(len(feature))
            waiting = [(rows[lo:lo + sample], 0, None)]
            while waiting:
                mine, depth, parent = waiting.pop()
                node = len(feature)
                if parent is not None:
                    children[parent[0]][parent[1]] = node
                low, high = mine.min(0), mine.max(0)
                varied = np.flatnonzero(high > low)
                feature.append(0)
                cut.append(0.0)
                children.append([node, node])
                path.append(depth + float(expected_path(len(mine))))
                if depth < most and len(varied):
                    f = int(rng.choice(varied))
                    c = rng.uniform(low[f], high[f])
                    right = mine[:, f] > c
                    if right.any() and not right.all():
                        feature[node], cut[node] = f, c
                        waiting += [(mine[~right], depth + 1, (node, 0)), (mine[right], depth + 1, (node, 1))]
        return cls(np.array(roots), np.array(feature, np.int64), np.array(cut), np.array(children, np.int64).reshape(-1, 2),
                   np.array(path), most, float(expected_path(min(sample, len(rows)))))

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path) of each row, rounded so that equal rows tie everywhere."""
        if not len(self.roots) or self.expected <= 0:
            return np.zeros(len(rows))
        total = np.zeros(len(rows))
        each = np.arange(len(rows))
        for root in self.roots:
            node = np.full(len(rows), root)
            for _ in range(self.depth):
                node = self.children[node, (rows[each, self.feature[node]] > self.cut[node]).astype(np.int64)]
            total += self.path[node]
        return np.round(2.0 ** (-total / len(self.roots) / self.expected), 9)


@dataclass(frozen=True)
class Rules:
    """The forest and the score from which on a text is rejected; None rejects none."""

    forest: Forest
    threshold: float | None


def grow(measures: DataFrame, trees: int = 300, sample: int = 32, key: str = "doc_id", seed: int = 1) -> Forest:
    """A forest from ``trees * sample`` rows that pass the base rules, taken in the order of a hash of their key."""
    place = F.xxhash64(F.lit("isolation"), F.lit(seed), F.col(key))
    rows = measures.filter(~F.col("base_failed")).select(place.alias("_p"), "statistics").orderBy("_p", "statistics")
    # The limit is the documented size of the sample.
    taken = rows.limit(trees * sample).collect()
    values = np.array([r["statistics"] for r in taken], float).reshape(-1, len(STATISTICS))
    return Forest.grown(values[np.random.default_rng(seed).permutation(len(values))], sample, seed)


def with_scores(measures: DataFrame, forest: Forest) -> DataFrame:
    """Adds score, 0 to 1, higher for odder rows."""
    rest = [c for c in measures.columns if c != "statistics"]
    boxed = measures.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row"), "statistics")
    schema = boxed.select("_row", F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("statistics").flatten().to_numpy().reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(forest.scores(rows))], schema.names)

    return boxed.mapInArrow(run, schema).select(*[F.col("_row").getField(c).alias(c) for c in rest], "score")


def threshold_of(scored: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", weight: float = 5.0,
                 ) -> float | None:
    """The score from which on rejecting texts costs least: a good text (label 1) counts ``weight`` times a bad one (0).

    All labelled rows that pass the base rules and are not held out count, each class as a whole the same; they are counted in ``BINS`` steps of
    the score. None without labels of both classes, or where rejecting nothing is best.
    """
    marks = labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y")).filter("_k IS NOT NULL AND _y IN (0, 1)")
    marks = marks.filter(~held_out("_k")).groupBy("_k").agg(F.min("_y").alias("_y"))
    bins = scored.filter(~F.col("base_failed")).select(F.col(key).alias("_k"), F.floor(F.col("score") * BINS).cast("int").alias("_b"))
    # One row for each step of the score and class.
    counts = bins.join(marks, "_k").groupBy("_b", "_y").count().collect()
    table = np.zeros((2, BINS + 2))
    for r in counts:
        table[r["_y"], r["_b"]] = r["count"]
    if not table.sum(1).all():
        return None
    bad, good = (np.cumsum(t[::-1])[::-1] / t.sum() for t in table)
    gain = bad - weight * good
    best = int(np.flatnonzero(gain == gain.max())[-1])
    return best / BINS if gain[best] > 0 else None


def verdicts(scored: DataFrame, threshold: float | None) -> DataFrame:
    """Adds kept: false for texts that fail a base rule or whose score reaches the threshold."""
    odd = F.lit(False) if threshold is None else F.floor(F.col("score") * BINS) >= round(threshold * BINS)
    return scored.withColumn("kept", ~F.col("base_failed") & ~odd)


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", keep: list[str] | None = None,
          trees: int = 300, sample: int = 32) -> DataFrame:
    """The columns ``keep`` (default: the key, which must be among them) of every row, ``COUNTS``, base_failed, score and kept.

    Null and empty texts have no words and fail the base rules. The forest is grown from ``trees * sample`` rows, the threshold read off all
    labelled rows that are not held out; without labels of both classes only the base rules count. Long texts are slices of their own. Repeated rows
    repeat; null keys have no label. Extra columns of any name do no harm; those in ``keep`` must not be named like the new ones.
    """
    measures = staged(measured(docs, text, key, keep), "measures")
    scored = with_scores(measures, grow(measures, trees, sample, key))
    return verdicts(scored, threshold_of(scored, labels, key))
