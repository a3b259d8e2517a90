"""Two tokenizations of one text linked by products of incidence matrices.

Each tokenization of a text is a sparse matrix with a row for each token and a column for each byte; a token's row
has ones at its bytes. With A and B of two tokenizers, entry (i, j) of A * B' is the number of bytes that token i of one and
token j of the other share, so its non-zero entries are the overlap links. Byte offsets at which tokens of both end
cut a text into groups; with a column for each group instead, the product links all tokens of a group. Matrices are in
compressed sparse row form and multiplied row by row (Gustavson): the row of a product is the sum of those rows of the right
matrix that the row of the left one names. The texts of a slice make one block-diagonal matrix.

How many documents link a pair of ids is counted over the corpus and looked up again for every document. The pairs
found most often, a fixed number of them (``head``), are looked up in the scan, which settles nearly all links; the other
pairs are joined, and none of them is in so many documents that a join key could be hot.
"""

from __future__ import annotations

import os
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import plain, slices, staged, view

MOST_PRODUCTS = 1 << 22
HEAD = 1 << 17
_ID_BITS = 24


# -- matrices ---------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Csr:
    """A matrix in compressed sparse row form: row i has ``data[starts[i]:starts[i + 1]]`` at ``columns[...]``; all ones without ``data``."""

    starts: np.ndarray
    columns: np.ndarray
    width: int
    data: np.ndarray | None = None

    @property
    def height(self) -> int:
        return len(self.starts) - 1

    def transposed(self) -> Csr:
        rows = np.repeat(np.arange(self.height), np.diff(self.starts))
        starts = np.concatenate([[0], np.cumsum(np.bincount(self.columns, minlength=self.width))])
        if (self.columns[1:] >= self.columns[:-1]).all():
            return Csr(starts, rows, self.height, self.data)
        order = np.argsort(self.columns, kind="stable")
        return Csr(starts, rows[order], self.height, None if self.data is None else self.data[order])


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices ``starts[i], starts[i] + 1, ...`` of all runs, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths - starts, lengths)


def product_sizes(left: Csr, right: Csr) -> np.ndarray:
    """How many terms each row of the product sums; where every row of ``left`` has one entry, its entries."""
    terms = np.concatenate([[0], np.cumsum(np.diff(right.starts)[left.columns])])
    return terms[left.starts[1:]] - terms[left.starts[:-1]]


def multiply(left: Csr, right: Csr, most: int = MOST_PRODUCTS) -> Csr:
    """The product, made row by row: rows of ``right`` are taken as ``left`` names them and summed by column.
    Rows are done in blocks of about ``most`` terms; a row with more of them is a block of its own."""
    if left.width != right.height:
        raise ValueError("widths don't fit")
    done = np.concatenate([[0], np.cumsum(product_sizes(left, right))])
    parts, row = [], 0
    while row < left.height:
        stop = max(row + 1, int(np.searchsorted(done, done[row] + most, "right")) - 1)
        entries = slice(left.starts[row], left.starts[stop])
        named = left.columns[entries]
        lengths = np.diff(right.starts)[named]
        owner = np.repeat(np.arange(stop - row), np.diff(left.starts[row:stop + 1]))
        terms = right.starts[named]
        one_each = (lengths == 1).all()
        if not one_each:
            terms, owner = spread(terms, lengths), np.repeat(owner, lengths)
        key = owner * max(right.width, 1) + right.columns[terms]
        value = None
        if left.data is not None or right.data is not None:
            value = np.ones(len(key), np.int64) if right.data is None else right.data[terms]
            if left.data is not None:
                value = value * (left.data[entries] if one_each else np.repeat(left.data[entries], lengths))
        if (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, value = key[order], None if value is None else value[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        if value is None:
            value = np.diff(np.append(first, len(key)))
        elif len(first):
            value = np.add.reduceat(value, first)
        rows, columns = np.divmod(key[first], max(right.width, 1))
        parts.append((columns, value, np.bincount(rows, minlength=stop - row)))
        row = stop
    columns, data, sizes = (np.concatenate(x).astype(np.int64) for x in zip(*parts)) if parts else [np.zeros(0, np.int64)] * 3
    return Csr(np.concatenate([[0], np.cumsum(sizes)]), columns, right.width, data)


# -- tokenizers -------------------------------------------------------------------------------------

def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones for themselves, the others
    in order from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


@dataclass
class Tokenizer:
    """Encodes texts of one slice to ids; ``sizes`` and ``flat`` hold the bytes of each id. The model's file is read on
    the driver and travels with the job; each worker makes the encoder once for a task."""

    kind: str
    content: bytes
    sizes: np.ndarray
    starts: np.ndarray
    flat: np.ndarray
    _encoder: object = field(default=None, repr=False)

    @classmethod
    def of(cls, kind: str, content: bytes, entries: list[bytes]) -> Tokenizer:
        if len(entries) >= 1 << _ID_BITS:
            raise ValueError("more ids than fit a pair")
        sizes = np.array([len(e) for e in entries], np.int64)
        return cls(kind, content, sizes, np.cumsum(sizes) - sizes, np.frombuffer(b"".join(entries), np.uint8))

    def __getstate__(self):
        return {**self.__dict__, "_encoder": None}

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of each text's. Texts come with the space in front."""
        if self._encoder is None:
            self._encoder = _encoder(self.kind, self.content)
        ids = self._encoder(texts)
        return np.fromiter((i for x in ids for i in x), np.int64, sum(map(len, ids))), np.array([len(x) for x in ids], np.int64)


def _encoder(kind: str, content: bytes):
    if kind == "piece":
        from sentencepiece import SentencePieceProcessor
        model = SentencePieceProcessor(model_proto=content)
        return lambda texts: model.encode([t[1:] for t in texts], num_threads=1)  # the model adds the space itself
    if kind == "ranks":
        import tiktoken
        ranks = {bytes(token): i for i, token in pickle.loads(content)}
        model = tiktoken.Encoding("own", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [model.encode_ordinary(t) for t in texts]
    # A task has one core.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer as Model
    model = Model.from_str(content.decode())
    model.encode_special_tokens = True
    return lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]


# How byte-level models of this form cut texts before merging: a fixed value.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_level(path: str) -> Tokenizer:
    """A byte-level BPE in the JSON form of the tokenizers library. Special tokens in texts are plain text.

    A model that cuts texts in the usual way and numbers its tokens in the order of their merges is run by rank, with the
    entries of this file, which gives the same ids several times faster; any other by the library of its form.
    """
    import json
    with open(path, "rb") as f:
        content = f.read()
    form = json.loads(content)
    letters = _byte_letters()
    model, vocabulary = form["model"], form["model"]["vocab"]
    added = {t["id"]: t["content"].encode() for t in form.get("added_tokens", [])}
    known = {i: bytes(letters[c] for c in token) for token, i in vocabulary.items() if all(c in letters for c in token)}
    entries = [b""] * (max([*vocabulary.values(), *added]) + 1)
    for i, token in {**known, **added}.items():
        entries[i] = token
    merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    usual = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    plain_form = (form["normalizer"] is None and (form["pre_tokenizer"] or {}).items() >= usual.items() and model["type"] == "BPE"
                  and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")))
    by_rank = (plain_form and len(known) == len(vocabulary) == 256 + len(merged) and all(a < b for a, b in zip(merged, merged[1:]))
               and all(len(known[i]) == 1 for i in known.keys() - set(merged)) and min(merged) > max(known.keys() - set(merged)))
    if by_rank:
        return Tokenizer.of("ranks", pickle.dumps(sorted(known.items())), entries)
    return Tokenizer.of("json", content, entries)


def sentence_pieces(path: str) -> Tokenizer:
    """A SentencePiece model with byte pieces that puts a space before a text."""
    from sentencepiece import SentencePieceProcessor
    with open(path, "rb") as f:
        content = f.read()
    model = SentencePieceProcessor(model_proto=content)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return Tokenizer.of("piece", content, [bytes([int(n[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", n)
                                           else n.replace("▁", " ").encode() for n in names])


# -- alignment of a slice ---------------------------------------------------------------------------

def _kept(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, counts: np.ndarray, tokenizer: Tokenizer) -> np.ndarray:
    """For each text whether the bytes of its tokens, joined, are the text."""
    sizes = tokenizer.sizes[ids]
    token_ends = np.concatenate([[0], np.cumsum(sizes)])
    made = token_ends[np.concatenate([[0], np.cumsum(counts)])]
    same = np.diff(made) == np.diff(offsets)
    joined = tokenizer.flat[spread(tokenizer.starts[ids], sizes)]
    if same.all():
        wrong = np.flatnonzero(joined != data)
        same[np.searchsorted(offsets, wrong, "right") - 1] = False
        return same
    for i in np.flatnonzero(same):
        same[i] = np.array_equal(joined[made[i]:made[i + 1]], data[offsets[i]:offsets[i + 1]])
    return same


@dataclass(frozen=True)
class Aligned:
    """Two tokenizations of the same bytes: ids, number of tokens per text, and both incidences."""

    ids: tuple[np.ndarray, np.ndarray]
    counts: tuple[np.ndarray, np.ndarray]
    group_of: tuple[np.ndarray, np.ndarray]
    groups: np.ndarray
    overlap: Csr

    def group_matrix(self, side: int) -> Csr:
        return Csr(np.arange(len(self.group_of[side]) + 1), self.group_of[side], int(self.groups.sum()))

    def shared(self) -> Csr:
        """Links between all tokens of a group. A group without inner boundaries can make many; ``shared_sizes`` counts them without."""
        return multiply(self.group_matrix(0), self.group_matrix(1).transposed())

    def shared_sizes(self) -> np.ndarray:
        return product_sizes(self.group_matrix(0), self.group_matrix(1).transposed())


def align(texts: list[str], data: np.ndarray, offsets: np.ndarray, first: Tokenizer, second: Tokenizer) -> Aligned:
    """Both tokenizations of all texts that both give back unchanged; the others have no tokens.
    ``data`` and ``offsets`` are the texts' bytes."""
    sides = [(t, *t.encode(texts)) for t in (first, second)]
    good = np.diff(offsets) > 0
    for tokenizer, ids, counts in sides:
        good &= _kept(data, offsets, ids, counts, tokenizer)
    width = int(np.diff(offsets)[good].sum())
    matrices, ids_of, counts_of, ends_of = [], [], [], []
    for tokenizer, ids, counts in sides:
        ids = ids[np.repeat(good, counts)]
        # Tokens lie side by side, so a token's columns are the bytes from where the one before ended. Ids without bytes don't exist here.
        starts = np.concatenate([[0], np.cumsum(tokenizer.sizes[ids])])
        matrices.append(Csr(starts, np.arange(width), width))
        ids_of.append(ids)
        counts_of.append(np.where(good, counts, 0))
        ends_of.append(starts[1:])
    cuts = np.intersect1d(*ends_of, assume_unique=True)
    text_ends = np.cumsum(np.where(good, np.diff(offsets), 0))
    groups = np.diff(np.searchsorted(cuts, text_ends, "right"), prepend=0)
    return Aligned(tuple(ids_of), tuple(counts_of), tuple(np.searchsorted(cuts, e) for e in ends_of), groups,
                   multiply(matrices[0], matrices[1].transposed()))


def _digits(most: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers up to ``most`` in decimal with room for one more sign, and where each begins."""
    written = [b"%d " % i for i in range(most + 1)]
    return np.frombuffer(b"".join(written), np.uint8), np.cumsum([0, *map(len, written)])


def _written_groups(found: Aligned, digits: tuple[np.ndarray, np.ndarray]) -> pa.Array:
    """``a1,a2|b1;a3|b2,b3`` for each text: all tokens in the order of their groups, each with the sign that follows it."""
    group = np.concatenate(found.group_of)
    order = np.argsort(group, kind="stable")  # within a group the first side's tokens come first
    ids, group, second = np.concatenate(found.ids)[order], group[order], order >= len(found.ids[0])
    flat, begins = digits
    sizes = begins[ids + 1] - begins[ids]
    signs = flat[spread(begins[ids], sizes)]
    last = np.concatenate([(group[1:] != group[:-1]) | (second[1:] != second[:-1]), [True]])[:len(ids)]
    ends = np.cumsum(sizes)
    signs[ends - 1] = np.where(last, np.where(second, ord(";"), ord("|")), ord(","))
    # The sign after a text's last token is left out.
    text_ends = np.concatenate([[0], ends])[np.cumsum(found.counts[0] + found.counts[1])]
    some = np.diff(text_ends, prepend=0) > 0
    kept = np.ones(len(signs), bool)
    kept[text_ends[some] - 1] = False
    offsets = np.concatenate([[0], text_ends - np.cumsum(some)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(some), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(signs[kept].tobytes())])


def _runs(owner: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, code) in order, and how often each comes."""
    order = np.lexsort((code, owner))
    owner, code = owner[order], code[order]
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])])[:len(owner)])
    return owner[first], code[first], np.diff(np.concatenate([first, [len(owner)]]))


_FIELDS = ["n_a", "n_b", "n_groups", "n_links", "n_shared", "groups", "_pairs", "_times"]
_COUNTED = ["n_best", "count_sum"]


def _lists(owner: np.ndarray, values: np.ndarray, rows: int) -> pa.ListArray:
    ends = np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def align_documents(docs: DataFrame, first: Tokenizer, second: Tokenizer, text: str = "text", key: str = "doc_id",
                    keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: the key) of every row, and

    n_a, n_b: tokens of both; n_groups; n_links: overlap links; n_shared: links of tokens of one group; groups: the ids as
    ``a1,a2|b1;a3|b2,b3``; _pairs: the distinct linked id pairs, first id * 2**24 + second id; _times: links of each pair.

    Null and empty texts, and those that a tokenizer doesn't give back unchanged, have no tokens: zeros and no groups.
    Repeated rows and null keys are rows as any other. Long texts are slices of their own. Extra columns of any
    name do no harm; those in ``keep`` must not be named like the new ones.
    """
    keep = [key] if keep is None else keep
    if clash := set(keep) & {*_FIELDS, *_COUNTED}:
        raise ValueError(f"the rows already have {sorted(clash)}")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"),
                       F.when(F.length(text) > 0, F.concat(F.lit(" "), F.col(text))).alias("_t"))
    number, numbers = F.lit(0).cast("long"), F.array(F.lit(0).cast("long"))
    schema = rows.select("_row", *[number.alias(c) for c in _FIELDS[:5]], F.lit("").alias("groups"),
                         numbers.alias("_pairs"), numbers.alias("_times")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = _digits(max(len(first.sizes), len(second.sizes)))
        for batch in batches:
            for part in slices(batch, "_t"):
                column = plain(part, "_t")
                found = align(column.to_pylist(), *view(column), first, second)
                texts = np.arange(part.num_rows)
                text_of = [np.repeat(texts, c) for c in found.counts]
                links = np.diff(found.overlap.starts)
                token = np.repeat(np.arange(len(found.ids[0])), links)
                owner, code, times = _runs(text_of[0][token],
                                           found.ids[0][token] << _ID_BITS | found.ids[1][found.overlap.columns])
                per_text = [found.counts[0], found.counts[1], found.groups, *(
                    np.bincount(text_of[0], x, part.num_rows).astype(np.int64) for x in (links, found.shared_sizes()))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("_row"), *[pa.array(x, pa.int64()) for x in per_text], _written_groups(found, digits).cast(pa.string()),
                     _lists(owner, code, part.num_rows), _lists(owner, times.astype(np.int64), part.num_rows)], ["_row", *_FIELDS])

    made = rows.mapInArrow(run, schema)
    return made.select(*[F.col("_row").getField(c).alias(c) for c in keep], *_FIELDS)


# -- counts over the corpus -------------------------------------------------------------------------

def pair_counts(rows: DataFrame) -> DataFrame:
    """``_pair, n, best``: in how many rows a pair is linked, and whether no other pair of its first id is in more."""
    counts = staged(rows.select(F.explode("_pairs").alias("_pair")).groupBy("_pair").agg(F.count(F.lit(1)).alias("n")), "pair-counts")
    first = F.shiftright("_pair", _ID_BITS)
    most = counts.groupBy(first.alias("_a")).agg(F.max("n").alias("_most"))
    return counts.withColumn("_a", first).join(most, "_a").select("_pair", "n", (F.col("n") == F.col("_most")).alias("best"))


def count_links(aligned: DataFrame, head: int = HEAD) -> DataFrame:
    """Rows of ``align_documents``, without _pairs and _times but with

    n_best: links whose id pair is in as many rows as any pair of its first id; count_sum: these numbers of rows summed
    over all links. The rows are written once; drop before what need not be written (``groups`` is longer than a text).
    """
    given = [c for c in aligned.columns if c not in ("_pairs", "_times")]
    # Pairs repeat over all rows, so a large dictionary stores them in a few bits.
    rows = staged(aligned.select(F.struct(*[F.col(f"`{c}`") for c in given]).alias("_row"), "_pairs", "_times",
                                 F.monotonically_increasing_id().alias("_id")), "aligned", **{"parquet.dictionary.page.size": str(16 << 20)})
    counts = staged(pair_counts(rows), "pair-table")
    # The most frequent pairs, no more than ``head``; the rest is joined below.
    top = counts.orderBy(F.desc("n"), "_pair").limit(head).toArrow().sort_by("_pair")
    table = [top.column(c).to_numpy() for c in ("_pair", "n", "best")]
    schema = rows.select("_row", "_id", *[F.lit(0).cast("long").alias(c) for c in _COUNTED],
                         F.col("_pairs").alias("_left"), F.col("_times").alias("_left_times")).schema

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, times = batch.column("_pairs"), batch.column("_times")
            owner = np.repeat(np.arange(batch.num_rows), pairs.value_lengths().to_numpy(zero_copy_only=False))
            pairs, times = pairs.flatten().to_numpy(), times.flatten().to_numpy()
            known, n, best = np.zeros(len(pairs), bool), np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
            if len(table[0]):
                at = np.minimum(np.searchsorted(table[0], pairs), len(table[0]) - 1)
                known = table[0][at] == pairs
                n, best = table[1][at] * known * times, table[2][at] * known * times
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row"), batch.column("_id"), *[pa.array(_sums(owner, x, batch.num_rows)) for x in (best, n)],
                 _lists(owner[~known], pairs[~known], batch.num_rows), _lists(owner[~known], times[~known], batch.num_rows)], schema.names)

    looked = rows.mapInArrow(look_up, schema)
    out = [*[F.col("_row").getField(c).alias(c) for c in given], *_COUNTED]
    if counts.count() <= head:
        return looked.select(*out)
    looked = staged(looked, "looked-up")
    left = looked.select("_id", F.explode(F.arrays_zip("_left", "_left_times")).alias("_x")).select(
        "_id", F.col("_x._left").alias("_pair"), F.col("_x._left_times").alias("_times"))
    more = left.join(counts, "_pair").groupBy("_id").agg(
        F.sum(F.when(F.col("best"), F.col("_times")).otherwise(0)).alias("_best"), F.sum(F.col("n") * F.col("_times")).alias("_sum"))
    return looked.drop("_left", "_left_times").join(more, "_id", "left").withColumns({
        "n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))}).select(*out)


def link_tokens(docs: DataFrame, first: Tokenizer, second: Tokenizer, text: str = "text", key: str = "doc_id",
                keep: list[str] | None = None, head: int = HEAD) -> DataFrame:
    """``align_documents`` with the counts of ``count_links``."""
    return count_links(align_documents(docs, first, second, text, key, keep), head)


def _sums(owner: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Exact sums of ``values`` by ascending ``owner``."""
    total = np.concatenate([[0], np.cumsum(values.astype(np.int64))])
    ends = np.searchsorted(owner, np.arange(rows + 1))
    return total[ends[1:]] - total[ends[:-1]]
