"""Toxicity scores: gradient-boosted trees over a few dense features, with isotonic calibration.

The features of a text are densities of lexicon words (plain, weighted, and once look-alike signs are
read as letters), how many of them stand near a second-person word, shares of capitals, of
punctuation and of signs inside words. The lexicon is learned from the labelled rows too: words far
more frequent in texts marked toxic. Trees and calibration are fitted on a bounded sample; every
text is scored whole, in batches, without a shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, functions as F

from .common import LOWER, SPACES, held_out, plain, slices, span_hashes, staged, view, words

# Words of the second person: fixed values, in English, French, German and Spanish.
SECOND_PERSON = (
    "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deiner ihr euch euer "
    "tú ti tus usted ustedes vosotros vuestro").split()
FEATURES = ["words", "hits", "hit_density", "weight_density", "disguised_density", "near_person_density",
            "person_density", "capital_share", "shouted_share", "punctuation_share", "exclamation_share", "inner_sign_share"]
REACH = 5

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
# Signs read as letters: fixed values.
_LOOK_ALIKE = LOWER.copy()
for _sign, _letter in zip("0134578@$!|+", "oieastbasiit"):
    _LOOK_ALIKE[ord(_sign)] = ord(_letter)


@dataclass(frozen=True)
class Lexicon:
    """Words with weights; no more than the bound given to ``learn_lexicon``."""

    words: list[str]
    weights: list[float]


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: Lexicon
    trees: Any
    calibration: Any
    constant: float | None = None


def _hashes(items: list[str]) -> np.ndarray:
    data, offsets = view(pa.array(items, pa.string()))
    return span_hashes(data, offsets[:-1], offsets[1:])


def text_features(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """One row of ``FEATURES`` per text; all zero for an empty one."""
    texts = len(offsets) - 1
    known, person = _hashes(lexicon.words), np.sort(_hashes(SECOND_PERSON))
    order = np.argsort(known)
    known, weights = known[order], np.array(lexicon.weights)[order]

    def per_text(positions: np.ndarray, values=None) -> np.ndarray:
        return np.bincount(np.searchsorted(offsets, positions, "right") - 1, values, texts)[:texts].astype(float)

    def found(sorted_hashes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(sorted_hashes):
            return np.zeros(len(hashes), int), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(sorted_hashes, hashes), len(sorted_hashes) - 1)
        return at, sorted_hashes[at] == hashes

    starts, ends, firsts = words(data, offsets, _LETTER)
    hashes = span_hashes(LOWER[data], starts, ends)
    at, hit = found(known, hashes)
    _, you = found(person, hashes)
    # Lexicon words with a second-person word no more than REACH words away in the same text.
    text_of = np.searchsorted(offsets, starts, "right") - 1
    seen = np.concatenate([[0], np.cumsum(you)])
    index = np.flatnonzero(hit)
    low = np.maximum(index - REACH, firsts[text_of[index]])
    high = np.minimum(index + REACH + 1, firsts[text_of[index] + 1])
    near = index[seen[high] > seen[low]]
    # The same words once signs that look like letters are read as such.
    alike = _LOOK_ALIKE[data]
    s2, e2, _ = words(alike, offsets, _LETTER)
    _, hit2 = found(known, span_hashes(alike, s2, e2))

    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    shouted = (upper[ends] - upper[starts] == ends - starts) & (ends - starts > 2)
    letter = _LETTER[data]
    sign = ~letter & ~SPACES[data]
    inner = np.zeros(len(data), bool)
    inner[1:-1] = sign[1:-1] & letter[:-2] & letter[2:]

    n = np.diff(firsts).astype(float)
    size = np.diff(offsets).astype(float)
    safe_n, safe_size = np.maximum(n, 1), np.maximum(size, 1)
    hits = per_text(starts[hit])
    return np.column_stack([
        np.log1p(n), np.log1p(hits), hits / safe_n, per_text(starts[hit], weights[at[hit]]) / safe_n,
        np.maximum(per_text(s2[hit2]) - hits, 0) / safe_n, per_text(starts[near]) / safe_n, per_text(starts[you]) / safe_n,
        per_text(np.flatnonzero(_UPPER[data])) / safe_size, per_text(starts[shouted]) / safe_n,
        per_text(np.flatnonzero(sign)) / safe_size, per_text(np.flatnonzero(data == 33)) / safe_size,
        per_text(np.flatnonzero(inner)) / safe_size])


def with_features(rows: DataFrame, lexicon: Lexicon, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``features``, an array in the order of ``FEATURES``."""
    boxed = rows.select(F.struct(*keep).alias("_row"), F.col(text).alias("_t"))
    schema = boxed.select("_row", F.array(F.lit(0.0)).alias("features")).schema

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_t"):
                made = text_features(*view(plain(part, "_t")), lexicon)
                ends = pa.array(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [part.column("_row"), pa.ListArray.from_arrays(ends, pa.array(made.ravel()))], ["_row", "features"])

    made = boxed.mapInArrow(run, schema)
    return made.select(*[F.col("_row").getField(c).alias(c) for c in keep], "features")


def learn_lexicon(rows: DataFrame, text: str, label: str, most_words: int = 500, least_rows: int = 4,
                  least_odds: float = 6.0) -> Lexicon:
    """Words at least ``least_odds`` times as frequent in the texts of label 1; the ``most_words`` most frequent."""
    positive = F.sum(F.col("_y")).alias("p")
    found = rows.select(F.col(label).cast("long").alias("_y"), F.explode(F.array_distinct(
        F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(\p{L}+)"), 1))).alias("word"))
    totals = rows.agg(F.sum(F.col(label).cast("long")), F.count(F.lit(1))).first()
    yes, no = (totals[0] or 0), totals[1] - (totals[0] or 0)
    counts = found.groupBy("word").agg(positive, F.count(F.lit(1)).alias("n"))
    odds = ((F.col("p") + 0.5) / (yes + 1)) / ((F.col("n") - F.col("p") + 0.5) / (no + 1))
    top = (counts.filter(F.col("p") >= least_rows).withColumn("odds", odds).filter(F.col("odds") >= least_odds)
           .orderBy(F.desc("p"), "word").limit(most_words).collect())
    top.sort(key=lambda r: r["word"])
    return Lexicon([r["word"] for r in top], [math.log(r["odds"]) for r in top])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id",
        sample_rows: int = 20_000, trees: int = 20, depth: int = 4) -> ToxicityModel:
    """Learns from labelled rows that are not held out.

    About ``sample_rows`` of them, picked by a hash of the key, are used: a third for the calibration, the
    others for lexicon and trees. Null labels and texts are left out. With one class only, every text
    scores that class's share.
    """
    usable = labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y")).filter(
        "_y IS NOT NULL").filter(~held_out("_k"))
    place = F.pmod(F.xxhash64(F.lit("toxicity"), "_k"), F.lit(1 << 32)) / float(1 << 32)
    share = sample_rows / max(1, usable.count())
    picked = usable.filter(place < share).limit(2 * sample_rows).groupBy("_k").agg(F.max("_y").alias("_y"))
    # Bounded by sample_rows: 12 bytes for each.
    sample = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).filter("_t IS NOT NULL").join(
        F.broadcast(picked), "_k").withColumn("_c", F.pmod(F.xxhash64(F.lit("calibration"), "_k"), F.lit(3)) == 0)
    sample = staged(sample.repartition(8), "toxicity-sample")
    classes = {r["_y"]: r["count"] for r in sample.groupBy("_y").count().collect()}
    if set(classes) != {0, 1}:
        total = sum(classes.values())
        return ToxicityModel(Lexicon([], []), None, None, classes.get(1, 0) / total if total else 0.0)
    lexicon = learn_lexicon(sample.filter("NOT _c"), "_t", "_y")
    rows = staged(with_features(sample, lexicon, ["_k", "_y", "_c"], "_t").orderBy("_k").coalesce(4), "toxicity-features")
    rows = rows.select(F.col("_y").cast("double").alias("_y"), "_c", array_to_vector("features").alias("features"))
    model = GBTClassifier(labelCol="_y", featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=0.2,
                          minInstancesPerNode=10, seed=7).fit(rows.filter("NOT _c"))
    held = _raw(model.transform(rows.filter("_c"))).select("_y", "_p")
    return ToxicityModel(lexicon, model, IsotonicRegression(labelCol="_y", featuresCol="_p").fit(held))


def _raw(df: DataFrame) -> DataFrame:
    return df.withColumn("_p", vector_to_array("probability")[1])


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", key: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """Columns key, score, predicted; only the text is an input. Null counts as empty; repeated rows repeat."""
    if model.constant is not None:
        return docs.select(key, F.lit(model.constant).alias("score"), F.lit(int(model.constant >= threshold)).alias("predicted"))
    rows = with_features(docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")), model.lexicon, ["_k"], "_t")
    rows = rows.select("_k", array_to_vector("features").alias("features"))
    scored = model.calibration.transform(_raw(model.trees.transform(rows)).select("_k", "_p"))
    # Calibration has steps; the trees' own order stays within a step.
    value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.98 * F.col("prediction") + 0.02 * F.col("_p")))
    return scored.select(F.col("_k").alias(key), value.alias("score"), (value >= threshold).cast("int").alias("predicted"))
