import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from conftest import SMALL
from parlance.llm import pieces
from parlance.llm.common import mix, span_hashes, view

PATH = "/opt/tokenizers/piece_bpe_32k.model"
HARD = ["", " ", "a▁b  c   \n\n x\ty", "日本語 テキスト 😀 z", "x" * 300 + " " + "ab" * 200, "    lead", "tail    ", "\x00\x01", "été", "▁"]


@pytest.fixture(scope="module")
def vocab():
    return pieces.read_vocabulary(PATH)


def encoded(vocab, texts, dropout, seed=1, variants=None):
    encoder = pieces.Encoder(vocab, dropout, seed)
    data, offsets = view(pa.array([" " + t if t else t for t in texts]))
    out, counts = encoder.encode(data, offsets, np.zeros(len(texts), np.int64) if variants is None else np.array(variants))
    back, at = encoder.decode(out, counts)
    assert np.array_equal(back, data) and np.array_equal(at, offsets)
    ends = np.cumsum(counts)
    return [out[e - c:e].tolist() for e, c in zip(ends, counts)]


def test_without_dropout_it_is_the_library_s_segmentation(vocab):
    sentencepiece = pytest.importorskip("sentencepiece")
    own = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = pq.read_table(SMALL + "/documents.parquet")["text"].to_pylist()[:100] + [t for t in HARD if "▁" not in t]
    assert encoded(vocab, texts, 0.0) == [own.encode(t) for t in texts]


def restated(vocab, word, chunk, dropout):
    """The agenda step by step on a list."""
    symbols = [(i, i + 1, vocab.symbols.get(c, -1)) for i, c in enumerate(word)]
    names = {p: i for i, p in reversed(list(enumerate(vocab.pieces))) if p and i not in set(vocab.byte_ids.tolist())}
    names |= {}
    while True:
        best = None
        for n, ((a, b, _), (_, c, _)) in enumerate(zip(symbols, symbols[1:])):
            made = names.get(word[a:c].encode())
            if made is None or symbols[n][2] < 0 or symbols[n + 1][2] < 0:
                continue
            place = (np.uint64(a) << np.uint64(42)) ^ (np.uint64(b) << np.uint64(21)) ^ np.uint64(c)
            draw = int(mix(np.array([chunk]) ^ mix(np.array([place])))[0] >> np.uint64(11))
            if draw < dropout * 2.0**53 and dropout > 0:
                continue
            key = (int(vocab.ranks[made]), n)
            best = min(best, (key, n, made)) if best else (key, n, made)
        if best is None:
            return [s[2] for s in symbols]
        _, n, made = best
        symbols[n:n + 2] = [(symbols[n][0], symbols[n + 1][1], made)]


@pytest.mark.parametrize("dropout", [0.1, 0.5])
def test_dropout_equals_the_agenda_step_by_step(vocab, dropout):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefghinorst") for _ in range(rnd.randint(2, 20))) for _ in range(120)] + ["nationalization" * 6]
    for word, got in zip(words, encoded(vocab, words, dropout, seed=9)):
        data, offsets = view(pa.array([" " + word]))
        chunk = span_hashes(data, offsets[:-1], offsets[1:])[0] ^ mix(np.zeros(1, np.uint64) + mix(np.array([9], np.uint64))[0])[0]
        assert got == restated(vocab, " " + word, chunk, dropout)


def test_seeds_and_variants_vary_and_repeat(vocab):
    texts = pq.read_table(SMALL + "/documents.parquet")["text"].to_pylist()[:30]
    one = encoded(vocab, texts, 0.2, seed=1)
    assert one == encoded(vocab, texts, 0.2, seed=1) != encoded(vocab, texts, 0.2, seed=2)
    assert one != encoded(vocab, texts, 0.2, seed=1, variants=[3] * 30)
    # Slices do not matter.
    assert one == [p for t in texts for p in encoded(vocab, [t], 0.2, seed=1)]
    assert sum(map(len, one)) > sum(map(len, encoded(vocab, texts, 0.0)))


@pytest.mark.parametrize("dropout", [0.0, 0.3, 1.0])
def test_round_trip_through_tables(spark, vocab, dropout):
    texts = HARD + [None, "twice", "twice"]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, _row long")
    out = pieces.encode(docs, vocab, dropout=dropout, keep=["doc_id", "_row"])
    assert out.columns == ["doc_id", "_row", "n_pieces", "pieces", "lossless"]
    rows = pieces.decode(out, vocab).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["lossless"] and r["text"] == (texts[r["doc_id"]] or "") and len(r["pieces"]) == 2 * r["n_pieces"]


def test_bad_input(spark, vocab):
    assert pieces.encode(spark.createDataFrame([], "doc_id long, text string"), vocab).collect() == []
    with pytest.raises(ValueError):
        pieces.encode(spark.createDataFrame([], "doc_id long, text string, pieces int"), vocab, keep=["doc_id", "pieces"])
    with pytest.raises(ValueError):
        pieces.encode(spark.createDataFrame([], "doc_id long, text string"), vocab, dropout=2)


def test_every_occurrence_has_its_own_draw(spark, vocab):
    word, times = "nationalization", 300
    # All pieces of the one text, cut where a word begins.
    flat = encoded(vocab, [" ".join([word] * times)], 0.1)[0]
    starts = [i for i, p in enumerate(flat) if vocab.pieces[p].startswith(b" ")]
    cuts = {tuple(flat[a:b]) for a, b in zip(starts, [*starts[1:], len(flat)])}
    assert len(starts) == times and len(cuts) > 4
    docs = spark.createDataFrame([(i, word) for i in range(times)], "doc_id long, text string")
    rows = pieces.encode(docs, vocab).collect()
    assert len({bytes(r["pieces"]) for r in rows}) > 4 and all(r["lossless"] for r in rows)
    assert {r["doc_id"]: r["pieces"] for r in rows} == {r["doc_id"]: r["pieces"] for r in pieces.encode(docs, vocab).collect()}
    # The plain segmentation stays the most common one, as at this dropout it must.
    plain = tuple(encoded(vocab, [word], 0.0)[0])
    seen = [tuple(np.frombuffer(r["pieces"], "<u2").tolist()) for r in rows]
    assert max(set(seen), key=seen.count) == plain


def test_arrays_of_a_slice_stay_small():
    import tracemalloc

    from parlance.llm.common import slices
    encoder = pieces.Encoder(pieces.read_vocabulary("/opt/tokenizers/piece_bpe_32k.model"), 0.1, 1)
    batch = pa.RecordBatch.from_pydict({"_t": [" some words that are cut here" * 40] * 1000})
    part = next(slices(batch, "_t", pieces.MOST_BYTES))
    data, offsets = view(part.column("_t"))
    tracemalloc.start()
    encoder.encode(data, offsets, np.arange(part.num_rows))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6


def test_pairs_are_found_where_many_share_a_slot(vocab):
    left, right = (vocab.pair_keys >> 32).astype(np.int32), (vocab.pair_keys & 0xFFFFFFFF).astype(np.int32)
    assert np.array_equal(vocab.merged(left, right), vocab.pair_ids)
    known = dict(zip(vocab.pair_keys.tolist(), vocab.pair_ids.tolist()))
    rng = np.random.default_rng(3)
    a, b = (rng.integers(-2, len(vocab.pieces), 50_000).astype(np.int32) for _ in range(2))
    assert vocab.merged(a, b).tolist() == [known.get(x << 32 | y, -1) if min(x, y) >= 0 else -1 for x, y in zip(a.tolist(), b.tolist())]


def test_words_of_all_lengths_share_the_rounds(vocab, monkeypatch):
    rnd = random.Random(4)
    text = " ".join("".join(rnd.choice("abcdefghinorst") for _ in range(n % 40 + 1)) for n in range(2000))
    whole = encoded(vocab, [text], 0.1)
    calls, looked_up = [], pieces.Vocabulary.merged
    monkeypatch.setattr(pieces.Vocabulary, "merged", lambda self, left, right: (calls.append(1), looked_up(self, left, right))[1])
    assert encoded(vocab, [text], 0.1) == whole
    # One call at first and one for each round of the longest word, not so many for each width.
    assert len(calls) <= 42
