"""Vector expressions: cosine similarity and the feature-hashing embedder."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from .text import word_tokens

DEFAULT_DIMENSIONS = 768
SLICE_ROWS = 256
SLICE_TOKENS = 1 << 15
KNOWN_TOKENS = 1 << 15


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; 0.0 for different lengths or a zero vector."""
    def dot(x, y):
        return F.aggregate(
            F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")),
            F.lit(0.0), lambda acc, v: acc + v)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0.0), F.lit(0.0)).otherwise(dot(a, b) / norms)


def _slot_and_sign(token: str, dim: int) -> tuple[int, int]:
    digest = hashlib.md5(token.encode("utf-8")).hexdigest()
    return int(digest[:8], 16) % dim, 1 if int(digest[8], 16) % 2 == 0 else -1


def token_slices(tokens: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Runs of lists with at most ``SLICE_ROWS`` rows and about ``SLICE_TOKENS`` tokens, and where they start. A longer list is a run of its own."""
    offsets, lo = tokens.offsets.to_numpy(), 0
    while lo < len(tokens):
        full = int(np.searchsorted(offsets, int(offsets[lo]) + SLICE_TOKENS, "right")) - 1
        hi = max(lo + 1, min(lo + SLICE_ROWS, full, len(tokens)))
        yield lo, tokens.slice(lo, hi - lo)
        lo = hi


def hashed_vectors(tokens: pa.Array, dim: int, known: dict[str, tuple[int, int]]) -> np.ndarray:
    """One vector for each list of tokens, made for a few rows at a time, so that only the result grows with their number."""
    out = np.empty((len(tokens), dim), np.float32)
    for lo, some in token_slices(tokens):
        out[lo:lo + len(some)] = _hashed(some, dim, known)
    return out


def hashed_lists(batches: Iterator[pa.Array], dim: int) -> Iterator[pa.Array]:
    """The vectors as lists, handed on slice by slice. The tokens of a task that are remembered are few, whatever its vocabulary."""
    known: dict[str, tuple[int, int]] = {}
    for tokens in batches:
        for _, some in token_slices(tokens):
            offsets = np.arange(0, (len(some) + 1) * dim, dim, dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashed_vectors(some, dim, known).reshape(-1)))


def _hashed(tokens: pa.Array, dim: int, known: dict[str, tuple[int, int]]) -> np.ndarray:
    rows = len(tokens)
    flat = tokens.flatten()
    row_of = np.repeat(np.arange(rows), np.diff(tokens.offsets.to_numpy()))
    encoded = flat.dictionary_encode()
    if len(known) > KNOWN_TOKENS:
        known.clear()
    pairs = [known.get(t) or known.setdefault(t, _slot_and_sign(t, dim)) for t in encoded.dictionary.to_pylist()]
    out = np.zeros((rows, dim))
    if pairs:
        slot_sign = np.array(pairs)
        codes = encoded.indices.to_numpy()
        out = np.bincount(row_of * dim + slot_sign[codes, 0], slot_sign[codes, 1], rows * dim).reshape(rows, dim)
    norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norms, out=out, where=norms > 0)


def hash_embedder(dim: int = DEFAULT_DIMENSIONS):
    """An embedder ``Column of text -> Column of array<float>``.

    Every word token adds +1 or -1 to one of ``dim`` slots, both taken from the token's md5, and
    the vector gets length 1. Equal texts get equal vectors on every machine. Tokens are cut on the
    JVM; the Arrow function hashes each distinct token of a slice once and sums with numpy, so the
    whole step adds no shuffle. (Summing in SQL would explode every token and shuffle it by chunk.)
    """
    if dim < 1:
        raise ValueError("dim must be positive")

    @F.arrow_udf("array<float>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return hashed_lists(batches, dim)

    return lambda text: embed(F.coalesce(word_tokens(text), F.array().cast("array<string>")))
