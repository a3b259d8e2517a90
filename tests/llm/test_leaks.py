import random

import numpy as np

from parlance.llm import leaks

DOCS, ITEMS = "doc_id long, text string, hits string", "item_id long, text string"


def semi_global(passage, text):
    """Least distance of the passage to any part of the text, cell by cell."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(passage, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def folded(text):
    return bytes(leaks.fold(np.frombuffer(text.encode(), np.uint8)))


def edited(rnd, text, edits):
    for _ in range(edits):
        a = rnd.randrange(len(text))
        text = text[:a] + rnd.choice(["", "z", text[a] + "q"]) + text[a + 1:]
    return text


def prose(rnd, n):
    return " ".join(rnd.choice(["the", "tion", "er", "on", "shth", "éa", "ble"]) + rnd.choice(["a", "er", "is", "on"]) for _ in range(n))


def test_equals_cell_by_cell_alignment(spark):
    rnd = random.Random(9)
    items = [(n, prose(rnd, rnd.randint(9, 40))) for n in range(8)]
    docs = []
    for i in range(120):
        text = prose(rnd, rnd.randint(0, 60))
        if i % 2:
            a = rnd.randint(0, len(text))
            passage = rnd.choice(items)[1]
            text = text[:a] + edited(rnd, passage.upper() if i % 3 else passage, rnd.randint(0, 30)) + text[a:]
        docs.append((i, text, "clash"))
    want = {}
    for i, text, _ in docs:
        for n, passage in items:
            p = folded(passage)
            d = semi_global(p, folded(text))
            if d <= leaks.budget(len(p), 0.1):
                want[i, n] = d
    tables = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    for settings in ({}, {"block_bytes": 300}):
        found = leaks.find(*tables, **settings).collect()
        assert {(r["doc_id"], r["item_id"]): r["distance"] for r in found} == want and len(want) > 20
        for r in found:
            part = folded(docs[r["doc_id"]][1])[r["start"]:r["end"]]
            assert semi_global(folded(items[r["item_id"]][1]), part) == r["distance"]


def test_clean_documents_stay_and_columns_too(spark):
    rnd = random.Random(3)
    items = spark.createDataFrame([(1, prose(rnd, 20)), (2, None), (3, "short"), (1, None)], ITEMS)
    passage = items.first()["text"]
    docs = spark.createDataFrame([(1, f"x\n{passage.replace(' ', chr(10))} y", "a"), (2, prose(rnd, 80), "b"), (3, None, "c"), (4, "", "d"),
                                  (4, "", "d"), (None, passage, "e"), (5, "short", "f"), (6, passage[:len(passage) // 2], "g")], DOCS)
    out = leaks.drop_leaks(docs, items)
    assert out.columns == docs.columns and sorted(r["hits"] for r in out.collect()) == ["b", "c", "d", "d", "f", "g"]


def test_empty_sides(spark):
    docs, items = spark.createDataFrame([(1, "t" * 200, "")], DOCS), spark.createDataFrame([(1, "passage " * 20)], ITEMS)
    assert leaks.find(docs.limit(0), items).collect() == []
    assert leaks.find(docs, items.limit(0)).collect() == []
    assert leaks.by_document(leaks.find(docs, items)).collect() == []


def test_long_text(spark):
    rnd = random.Random(4)
    passage = prose(rnd, 30)
    docs = spark.createDataFrame([(1, "the er on " * 100_000 + edited(rnd, passage, 5) + " the er" * 100_000, "")], DOCS)
    found = leaks.find(docs, spark.createDataFrame([(7, passage)], ITEMS)).collect()
    assert [(r["doc_id"], r["item_id"], r["distance"] <= 10) for r in found] == [(1, 7, True)]
    assert abs(found[0]["start"] - 1_000_000) < 30


def test_short_passages_count_verbatim_as_whole_words(spark):
    rnd = random.Random(6)
    pool = ["a", "éa", "on", "er is", "x-y", "the", "tion on", "?", "12"]
    items = [(n, " ".join(rnd.choice(pool) for _ in range(rnd.randint(1, 8)))) for n in range(60)] + [(97, "What is 12?"), (98, ""), (99, "  ")]
    items = [(n, t) for n, t in items if len(t.encode()) < leaks.SHORT] + [(96, items[0][1].upper())]
    docs = [(i, "".join(rnd.choice(pool + ["q"]) + rnd.choice([" ", " ", "\n", ""]) for _ in range(rnd.randint(0, 60))), "") for i in range(150)]
    docs += [(900, "b\nwhat IS 12? b", ""), (901, "somewhat is 12?", ""), (902, "What is 12", ""), (903, "", ""), (904, "What is 12?", "")]
    want = {}
    word = lambda b: chr(b).isalnum() and b < 128 or b >= 128
    for i, text, _ in docs:
        t = folded(text)
        for n, passage in items:
            p = folded(passage)
            for a in range(len(t) - len(p) + 1) if p.strip() else ():
                b = a + len(p)
                if t[a:b] == p and not (a and word(t[a - 1]) and word(t[a])) and not (b < len(t) and word(t[b - 1]) and word(t[b])):
                    want[i, n] = 0, a, b
                    break
    tables = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    found = leaks.find(*tables, least_bytes=1).collect()
    assert {(r["doc_id"], r["item_id"]): (r["distance"], r["start"], r["end"]) for r in found} == want
    assert (900, 97) in want and (904, 97) in want and not {(901, 97), (902, 97)} & set(want) and len(want) > 200
    assert {(r["doc_id"], r["item_id"]) for r in leaks.find(*tables).collect()} == {(i, n) for i, n in want if len(dict(items)[n].encode()) >= leaks.Q}


def test_query_and_stage_look_for_short_items(spark, tmp_path):
    import corpus_pipeline
    from parlance.llm.queries import QUERIES
    docs = spark.createDataFrame([(1, "So: Who wrote it? Nobody."), (2, "clean text"), (3, "say Why? now")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, "who wrote it?"), (6, "why?")], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = QUERIES["op6_benchmark_leaks"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["items"] for r in rows} == {1: "5", 2: "", 3: "6"}
    assert [r["doc_id"] for r in corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()] == [2]
