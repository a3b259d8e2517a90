"""Language identification by compression.

For every language a zstandard dictionary of raw content is cut from labelled texts. A text is
encoded block by block with each dictionary, and the language whose dictionary gives the fewest
bytes wins. Blocks are encoded apart, so a long text does not become its own dictionary, and every
block of it counts. Where two sizes are nearly equal the text is rejected.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import held_out, plain

UNDETERMINED = "und"
SHORT = 64
# Bytes that are letters of a-z once lower-cased, or part of a longer character; all others separate.
_LETTERS = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class LanguageModel:
    """Dictionaries by language; no larger than the number of languages times ``dictionary_bytes``."""

    dictionaries: dict[str, bytes]
    level: int = 6
    block_bytes: int = 2048
    sharpness: float = 40.0


def letters(text: str) -> bytes:
    """The text's words in lower case (A-Z), one space between them; digits and ASCII signs are dropped."""
    return b" ".join(text.encode("utf-8", "replace").translate(_LETTERS).split())


def fit(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", rows_per_language: int = 400,
        dictionary_bytes: int = 96 * 1024, **settings) -> LanguageModel:
    """Learns from rows that are not held out and have a label and a text.

    The sample is bounded: about ``rows_per_language`` rows of each language, picked by a hash of the
    key, and ``dictionary_bytes`` of them. Languages are counted over all rows first.
    """
    usable = docs.filter(~held_out(key) & F.col(label).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in usable.groupBy(label).count().collect()}  # one row per language
    if not sizes:
        return LanguageModel({}, **settings)
    place = F.pmod(F.xxhash64(F.lit("language"), F.col(key)), F.lit(1 << 32)) / float(1 << 32)
    share = F.coalesce(*[F.when(F.col(label) == name, F.lit(rows_per_language / n)) for name, n in sizes.items()])
    per_row = max(256, 4 * dictionary_bytes // rows_per_language)
    sample = (usable.filter(place < share).select(F.col(label).alias("l"), F.substring(text, 1, per_row).alias("t"), place.alias("p"))
              .orderBy("p").limit(2 * rows_per_language * len(sizes)).collect())
    parts: dict[str, list[bytes]] = {name: [] for name in sorted(sizes)}
    for row in sample:
        parts[row["l"]].append(letters(row["t"]))
    return LanguageModel({k: b" ".join(v)[:dictionary_bytes] for k, v in parts.items() if any(v)}, **settings)


def encoders(model: LanguageModel) -> list[tuple[str, zstandard.ZstdCompressor]]:
    """A compressor per language; made once per task."""
    out = []
    params = zstandard.ZstdCompressionParameters.from_level(
        model.level, write_content_size=False, write_checksum=False, write_dict_id=False)
    for name, raw in model.dictionaries.items():
        data = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(compression_params=params)
        out.append((name, zstandard.ZstdCompressor(dict_data=data, compression_params=params)))
    return out


def classify(model: LanguageModel, text: str, made: list[tuple[str, zstandard.ZstdCompressor]]) -> tuple[str, float]:
    """The language and a score from 0 to 1; ties go to the first name."""
    ink = letters(text)
    if not model.dictionaries or not any(c.isalpha() for c in text):
        return UNDETERMINED, 0.0
    if len(ink) < SHORT:  # too short to be worth a sequence: a second copy makes one, and sizes differ
        ink = ink + b"\n" + ink
    blocks = [ink[i:i + model.block_bytes] for i in range(0, len(ink), model.block_bytes)]
    sizes = [(sum(len(e.compress(b)) for b in blocks), name) for name, e in made]
    best, name = min(sizes)
    # Sizes relative to the best one, as weights.
    return name, 1.0 / sum(math.exp(-model.sharpness * (size / best - 1.0)) for size, _ in sizes)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", key: str = "doc_id",
            least_score: float = 0.4) -> DataFrame:
    """Columns key, lang_pred, score, rejected. Only the text is an input of a prediction.

    Null texts and texts without a letter are ``und`` with score 0. ``rejected`` marks those and the
    texts whose score is under ``least_score``. Repeated rows give repeated rows.
    """
    def run(batches):
        by_language = encoders(model)
        for batch in batches:
            made = [classify(model, t, by_language) for t in plain(batch, "_t").to_pylist()]
            names, scores = [m[0] for m in made], [m[1] for m in made]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_k"), pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                 pa.array([s < least_score or n == UNDETERMINED for n, s in made], pa.bool_())],
                ["_k", "lang_pred", "score", "rejected"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    return rows.mapInArrow(run, f"_k {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("_k", key)


def keep_identified(docs: DataFrame, model: LanguageModel, text: str = "text", least_score: float = 0.4) -> DataFrame:
    """The rows of ``docs`` whose text is not rejected, with all their columns as they were. The decision is
    made beside the row, without a shuffle."""
    kept: list = []  # the task's compressors

    @F.arrow_udf("boolean")
    def accepted(texts: pa.Array) -> pa.Array:
        if not kept:
            kept.append(encoders(model))
        made = (classify(model, t, kept[0]) for t in texts.fill_null("").to_pylist())
        return pa.array([n != UNDETERMINED and s >= least_score for n, s in made], pa.bool_())

    return docs.filter(accepted(F.col(text)))
