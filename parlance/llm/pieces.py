"""SentencePiece encoding with seeded merge-dropout, and decoding.

A text is cut into chunks (a run of spaces and the characters up to the next one; a character that
no piece contains, such as a line break, ends a chunk too), and no piece crosses them. In a chunk
the agenda holds every pair of neighbours whose concatenation is a piece; the pair with the best
score is merged first, the leftmost of equals. A candidate is the triple of its start, middle and
end; a hash of the seed, the document's key, the chunk, its number in the text and that triple decides whether it is
skipped, so every occurrence of a word has its own draw, and the same seed always gives the same segmentation. Characters outside
the vocabulary become byte pieces, so decoding restores every text exactly.

The rounds of the agenda run for all chunks of a slice of texts at once.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import mix, plain, slices, span_hashes, view

SPACE = "▁"
BYTE_KIND, NORMAL_KIND = 6, 1
NONE = np.int32(2**31 - 1)
LONGEST_ROW = 64
MOST_BYTES = 1 << 18  # of text at a time; the arrays beside it take about eighty times that


@dataclass(frozen=True)
class Vocabulary:
    """A BPE model: piece bytes, the rank of each piece (lower merges first) and its byte pieces.
    Bounded by the model file; it is read on the driver and travels with the job."""

    pieces: list[bytes]
    symbols: dict[str, int]
    pair_keys: np.ndarray
    pair_ids: np.ndarray
    ranks: np.ndarray
    byte_ids: np.ndarray
    space_first: bool  # the model puts a space before every text that is not empty

    def __post_init__(self):
        if len(self.pieces) > 1 << 16:
            raise ValueError("more pieces than two bytes can number")
        # The pairs by a hash of theirs, each in the first free slot from there on; a free slot holds -1.
        bits = max(4, (4 * len(self.pair_keys)).bit_length())
        slots, numbers = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        object.__setattr__(self, "slots", slots)
        object.__setattr__(self, "numbers", numbers)
        left, at = np.arange(len(self.pair_keys)), self._slot(self.pair_keys)
        while len(left):
            free = np.flatnonzero(slots[at] < 0)
            slots[at[free]] = self.pair_keys[left[free]]
            put = slots[at] == self.pair_keys[left]
            numbers[at[put]] = self.pair_ids[left[put]]
            left, at = left[~put], (at[~put] + 1) & (len(slots) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        spread = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece made of two pieces, or -1; a negative number is no piece."""
        keys = left.astype(np.int64) << 32 | right
        at = self._slot(keys)
        found = self.slots[at]
        out = np.where(found == keys, self.numbers[at], np.int32(-1))
        # Slots that hold another pair: the next ones may hold this one.
        over = np.flatnonzero((found >= 0) & (found != keys))
        at = at[over]
        while len(over):
            at = (at + 1) & (len(self.slots) - 1)
            found = self.slots[at]
            here = found == keys[over]
            out[over[here]] = self.numbers[at[here]]
            on = (found >= 0) & ~here
            over, at = over[on], at[on]
        return out


def read_vocabulary(path: str) -> Vocabulary:
    """Reads a SentencePiece BPE model that leaves texts as they are and has all byte pieces."""
    from sentencepiece import sentencepiece_model_pb2 as pb
    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback:
        raise ValueError("not a BPE model with byte fallback")
    if proto.normalizer_spec.name != "identity" or proto.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("the model changes texts, so they cannot be restored")
    normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL_KIND}
    for piece in normal:
        if SPACE in piece.lstrip(SPACE):
            raise ValueError(f"the piece {piece!r} crosses words")
    byte_ids = np.full(256, -1, np.int32)
    for i, p in enumerate(proto.pieces):
        if p.type == BYTE_KIND:
            byte_ids[int(p.piece[3:5], 16)] = i
    if (byte_ids < 0).any():
        raise ValueError("byte pieces are missing")
    order = {s: r for r, s in enumerate(sorted({p.score for p in proto.pieces}, reverse=True))}
    pairs = sorted((normal[a] << 32 | normal[b], i) for piece, i in normal.items() for k in range(1, len(piece))
                   if (a := piece[:k]) in normal and (b := piece[k:]) in normal)
    data = [b""] * len(proto.pieces)
    for piece, i in normal.items():
        data[i] = piece.replace(SPACE, " ").encode()
    for value, i in enumerate(byte_ids):
        data[i] = bytes([value])
    return Vocabulary(
        data, {(" " if p == SPACE else p): i for p, i in normal.items() if len(p) == 1},
        np.array([k for k, _ in pairs], np.int64), np.array([i for _, i in pairs], np.int32),
        np.array([order[p.score] for p in proto.pieces], np.int32), byte_ids, proto.normalizer_spec.add_dummy_prefix)


def _skipped(chunk: np.ndarray, start, middle, end, dropout: float) -> np.ndarray:
    """True for candidates that the keyed hash drops; ``chunk`` already holds seed, key and number."""
    start, middle, end = (np.atleast_1d(x).astype(np.uint64) for x in (start, middle, end))
    place = (start << np.uint64(42)) ^ (middle << np.uint64(21)) ^ end
    return (mix(chunk ^ mix(place)) >> np.uint64(11)).astype(np.float64) < dropout * 2.0**53


def _agenda(vocab: Vocabulary, symbols: list[int], chunk: np.uint64, dropout: float) -> list[int]:
    """One chunk of any length, with a heap: n log n."""
    n = len(symbols)
    after, before, ids, ends = list(range(1, n + 1)), list(range(-1, n - 1)), list(symbols), list(range(1, n + 1))
    heap = []

    def offer(at: int) -> None:
        right = after[at] if at >= 0 else n
        if at < 0 or right >= n:
            return
        made = int(vocab.merged(np.array([ids[at]]), np.array([ids[right]]))[0])
        if made >= 0 and not _skipped(np.array([chunk]), at, right, ends[right], dropout)[0]:
            heapq.heappush(heap, (int(vocab.ranks[made]), at, right, ends[right], made))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, at, right, end, made = heapq.heappop(heap)
        if ids[at] is None or after[at] != right or ids[right] is None or ends[right] != end:
            continue
        ids[at], ids[right], ends[at], after[at] = made, None, end, after[right]
        if after[at] < n:
            before[after[at]] = at
        offer(before[at])
        offer(at)
    return [i for i in ids if i is not None]


def _rounds(vocab: Vocabulary, symbols: np.ndarray, lengths: np.ndarray, chunks: np.ndarray, dropout: float):
    """All chunks at once, their symbols one after the other: in each round every chunk merges its best pair. Gives, for the chunks
    that end in the same round, their numbers, their pieces and how many each has."""
    number, ids = np.arange(len(lengths)), symbols
    starts = np.cumsum(lengths) - lengths
    edge = np.arange(len(ids)) - np.repeat(starts, lengths) + 1  # where a symbol ends in its chunk
    made, rank = np.full(len(ids), -1, np.int32), np.full(len(ids), NONE)

    def offer(at: np.ndarray, first: np.ndarray, chunk: np.ndarray) -> None:
        """Puts up each symbol ``at`` with its right neighbour; ``first`` says that it begins its chunk."""
        pair = vocab.merged(ids[at], ids[at + 1])
        live = np.flatnonzero(pair >= 0)
        at, pair = at[live], pair[live]
        if dropout > 0:
            kept = ~_skipped(chunk[live], np.where(first[live], 0, edge[at - 1]), edge[at], edge[at + 1], dropout)
            at, pair = at[kept], pair[kept]
        made[at], rank[at] = pair, vocab.ranks[pair]

    inner = np.ones(len(ids), bool)
    inner[starts + lengths - 1] = False
    at = np.flatnonzero(inner)
    offer(at, edge[at] == 1, np.repeat(chunks, lengths - 1))
    while len(number):
        # The least rank, and of equal ones the leftmost.
        best = np.minimum.reduceat(rank.astype(np.int64) << 32 | np.arange(len(rank)), starts)
        going = best >> 32 != NONE
        keep = np.ones(len(ids), bool)
        if not going.all():
            over = np.repeat(~going, lengths)
            yield number[~going], ids[over], lengths[~going]
            keep = ~over
        best = best[going] & 0xFFFFFFFF
        ids[best], edge[best] = made[best], edge[best + 1]
        keep[best + 1] = False
        place = best - starts[going]
        number, chunks, lengths = number[going], chunks[going], lengths[going] - 1
        starts = np.cumsum(lengths) - lengths
        rank[best] = NONE
        rank[best[place > 0] - 1] = NONE
        keep = np.flatnonzero(keep)
        ids, edge, made, rank = ids[keep], edge[keep], made[keep], rank[keep]
        best = starts + place
        right, left = np.flatnonzero(place < lengths - 1), np.flatnonzero(place > 0)
        offer(np.concatenate([best[right], best[left] - 1]), np.concatenate([place[right] == 0, place[left] == 1]),
              np.concatenate([chunks[right], chunks[left]]))


def _gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of ragged runs, one after the other."""
    total = int(lengths.sum())
    ahead = np.cumsum(lengths) - lengths
    return np.repeat(starts - ahead, lengths) + np.arange(total)


class Encoder:
    """Encodes slices of texts; built once per task."""

    def __init__(self, vocab: Vocabulary, dropout: float, seed: int):
        self.vocab, self.dropout = vocab, dropout
        self.seed = mix(np.array([seed], np.uint64))[0]
        self.by_code = np.full(0x110000, -1, np.int32)
        for symbol, i in vocab.symbols.items():
            self.by_code[ord(symbol)] = i
        self.by_code[ord(SPACE)] = -1  # a text's own U+2581 goes as bytes; spaces have its piece
        self.piece_bytes = np.frombuffer(b"".join(vocab.pieces), np.uint8)
        self.piece_sizes = np.array([len(p) for p in vocab.pieces], np.int64)
        self.piece_starts = np.cumsum(self.piece_sizes) - self.piece_sizes

    def encode(self, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all texts and how many each text has."""
        texts = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint16), np.zeros(texts, np.int64)
        # Characters: where they start and their code points.
        begin = np.flatnonzero((data & 0xC0) != 0x80)
        lead = data[begin].astype(np.int32)
        padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
        tail = [padded[begin + k] & 0x3F for k in (1, 2, 3)]
        code = np.where(lead < 0x80, lead, np.where(
            lead < 0xE0, (lead & 0x1F) << 6 | tail[0], np.where(
                lead < 0xF0, (lead & 0x0F) << 12 | tail[0] << 6 | tail[1],
                (lead & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2])))
        symbol = self.by_code[np.minimum(code, 0x10FFFF)]
        # Chunks start at a text's start, at the first of a run of spaces, and around unknown characters.
        space, unknown = code == 32, symbol < 0
        first = space.copy()
        first[1:] &= ~space[:-1]
        first |= unknown
        first[1:] |= unknown[:-1]
        text_first = np.searchsorted(begin, offsets[:-1])
        first[text_first[text_first < len(begin)]] = True
        chunk_at = np.flatnonzero(first)
        chunk_chars = np.diff(np.append(chunk_at, len(begin)))
        chunk_from = begin[chunk_at]
        chunk_to = np.append(chunk_from[1:], len(data))
        text_of = np.searchsorted(offsets, chunk_from, "right") - 1
        words = span_hashes(data, chunk_from, chunk_to)
        if self.dropout > 0:
            # The chunk's number in its text; without dropout equal chunks are cut alike anyway.
            number = np.arange(len(chunk_at)) - np.searchsorted(text_of, np.arange(texts))[text_of]
            hashes = words ^ mix(keys.astype(np.uint64) + self.seed)[text_of] ^ mix(number.astype(np.uint64))
            distinct, where = hashes, np.arange(len(hashes))
            inverse = where
        else:
            distinct, where, inverse = np.unique(words, return_index=True, return_inverse=True)
        sizes = chunk_chars[where]
        counts = np.zeros(len(distinct), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # which chunk, pieces, pieces per chunk

        lone = np.flatnonzero(sizes == 1)
        at = chunk_at[where[lone]]
        known = symbol[at] >= 0
        parts.append((lone[known], symbol[at[known]], np.ones(int(known.sum()), np.int64)))
        at, lone = at[~known], lone[~known]
        stops = np.append(begin, len(data))
        widths = stops[at + 1] - begin[at]
        parts.append((lone, self.vocab.byte_ids[data[_gather(begin[at], widths)]], widths))
        some = np.flatnonzero((sizes > 1) & (sizes <= LONGEST_ROW))
        n = sizes[some]
        for group, made, per in _rounds(self.vocab, symbol[_gather(chunk_at[where[some]], n)], n, distinct[some], self.dropout):
            parts.append((some[group], made, per))
        for i in np.flatnonzero(sizes > LONGEST_ROW):
            at = chunk_at[where[i]]
            made = _agenda(self.vocab, symbol[at:at + sizes[i]].tolist(), distinct[i], self.dropout)
            parts.append((np.array([i]), np.array(made, np.int32), np.array([len(made)])))
        order = np.concatenate([p[0] for p in parts])
        flat = np.concatenate([p[1] for p in parts]).astype(np.uint16)
        per = np.concatenate([p[2] for p in parts])
        counts[order] = per
        begins = np.zeros(len(distinct), np.int64)
        begins[order] = np.cumsum(per) - per
        lengths = counts[inverse]
        return flat[_gather(begins[inverse], lengths)], np.bincount(text_of, lengths, texts).astype(np.int64)

    def decode(self, pieces: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts and where each begins."""
        sizes = self.piece_sizes[pieces]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        return self.piece_bytes[_gather(self.piece_starts[pieces], sizes)], ends


def _led(text, vocab: Vocabulary):
    return F.when(text != "", F.concat(F.lit(" "), text)) if vocab.space_first else text


def _binary(data: np.ndarray, offsets: np.ndarray, kind) -> pa.Array:
    return pa.Array.from_buffers(kind, len(offsets) - 1, [
        None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def encode(docs: DataFrame, vocab: Vocabulary, dropout: float = 0.1, seed: int = 1,
           text: str = "text", key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: the key) and n_pieces, pieces, lossless.

    ``pieces`` has two bytes per piece, the low one first. Every occurrence of a word is
    cut by a draw of its own, from ``seed``, the key and its place. ``dropout`` 0 gives the plain segmentation. ``lossless`` says that
    decoding gave back the text; null and empty texts have no pieces. Repeated rows repeat.
    """
    keep = [key] if keep is None else keep
    if not 0 <= dropout <= 1:
        raise ValueError("dropout is a share")
    names = {"n_pieces", "pieces", "lossless"} & set(keep)
    if names:
        raise ValueError(f"the rows already have {sorted(names)}")
    chosen = F.xxhash64(F.lit(seed), F.col(key))
    rows = docs.select(F.struct(*keep).alias("_row"), _led(F.col(text), vocab).alias("_t"), chosen.alias("_v"))
    schema = rows.select("_row", F.lit(0).cast("long").alias("n_pieces"), F.lit(b"").alias("pieces"),
                         F.lit(True).alias("lossless")).schema

    def run(batches):
        encoder = Encoder(vocab, dropout, seed)
        for batch in batches:
            for part in slices(batch, "_t", MOST_BYTES):
                data, offsets = view(plain(part, "_t"))
                pieces, counts = encoder.encode(data, offsets, part.column("_v").to_numpy())
                back, at = encoder.decode(pieces, counts)
                if np.array_equal(at, offsets) and np.array_equal(back, data):
                    same = np.ones(len(counts), bool)
                else:
                    same = np.array([np.array_equal(back[at[i]:at[i + 1]], data[offsets[i]:offsets[i + 1]])
                                     for i in range(len(counts))])
                ends = np.concatenate([[0], np.cumsum(2 * counts)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("_row"), pa.array(counts), _binary(pieces.astype("<u2").view(np.uint8), ends, pa.binary()),
                     pa.array(same)], ["_row", "n_pieces", "pieces", "lossless"])

    made = rows.mapInArrow(run, schema)
    return made.select(*[F.col("_row").getField(c).alias(c) for c in keep], "n_pieces", "pieces", "lossless")


def decode(rows: DataFrame, vocab: Vocabulary, pieces: str = "pieces", name: str = "text") -> DataFrame:
    """Adds the text of packed pieces. A number outside the vocabulary is an error; null has no text."""
    @F.arrow_udf("binary")
    def back(packed: pa.Array) -> pa.Array:
        values = [None if p is None else b"".join(vocab.pieces[i] for i in np.frombuffer(p, "<u2")) for p in packed.to_pylist()]
        return pa.array(values, pa.binary())

    made = F.decode(back(F.col(pieces)), "UTF-8")
    return rows.withColumn(name, F.substring(made, 2, 2**31 - 1) if vocab.space_first else made)
