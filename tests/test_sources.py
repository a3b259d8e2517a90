import json

import pytest
from pyspark.sql import functions as F

from parlance.functions.vectors import hash_embedder
from parlance.operators import prep
from parlance.sources import files, vector_table as V


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(b"plain \xff text\nline two")
    (tmp_path / "sub" / "b.MD").write_text("# title")
    (tmp_path / "sub" / "c.markdown").write_text("more")
    (tmp_path / "list.json").write_text(json.dumps([
        {"title": "T", "content": "C", "text": "x"}, {"text": "only text"}, {"price": 5}]))
    (tmp_path / "one.json").write_text(json.dumps({"title": "One", "content": "body"}))
    (tmp_path / "bad.json").write_text("{not json")
    (tmp_path / "x.csv").write_text('name,price,note\nTop,"1,200","say ""hi"""\n,5,\n')
    (tmp_path / "y.csv").write_text("product,size\r\nKurti,M\r\n\r\nShawl,\r\n")
    (tmp_path / "skip.bin").write_text("no")
    return str(tmp_path)


def by_id(df):
    return {r.doc_id: (r.doc_title, r.source_uri, r.raw_text) for r in df.collect()}


def test_text_files(spark, folder):
    assert by_id(files.text_documents(spark, folder)) == {
        "DOC_a.txt": ("a.txt", "file://a.txt", "plain  text\nline two"),
        "DOC_sub/b.MD": ("b.MD", "file://sub/b.MD", "# title"),
        "DOC_sub/c.markdown": ("c.markdown", "file://sub/c.markdown", "more")}


def test_json_files(spark, folder):
    assert by_id(files.json_documents(spark, folder)) == {
        "list.json_0": ("T", "json://list.json#0", "C"),
        "list.json_1": ("list.json #2", "json://list.json#1", "only text"),
        "list.json_2": ("list.json #3", "json://list.json#2", '{"price":5}'),
        "DOC_one.json": ("One", "json://one.json", "body")}


def test_csv_files_with_different_headers(spark, folder):
    assert by_id(files.csv_documents(spark, folder)) == {
        "CSV_x.csv_0": ("Top", "csv://x.csv#0", 'name: Top | price: 1,200 | note: say "hi"'),
        "CSV_x.csv_1": ("x.csv Row 2", "csv://x.csv#1", "price: 5"),
        "CSV_y.csv_0": ("Kurti", "csv://y.csv#0", "product: Kurti | size: M"),
        "CSV_y.csv_1": ("Shawl", "csv://y.csv#1", "product: Shawl")}


def test_csv_with_line_breaks_and_repeated_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'name,x,name\r\n"two\nlines ""q""",1,last\r\n\r\n"","b\r\nc",\n')
    assert by_id(files.csv_documents(spark, str(tmp_path), multi_line=True)) == {
        "CSV_a.csv_0": ("last", "csv://a.csv#0", 'name: two\nlines "q" | x: 1 | name: last'),
        "CSV_a.csv_1": ("a.csv Row 2", "csv://a.csv#1", "x: b\r\nc")}
    with pytest.raises(Exception, match="read it with multi_line"):
        files.csv_documents(spark, str(tmp_path)).collect()


def test_files_of_one_name_stay_apart(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "readme.md").write_text(folder)
        (tmp_path / folder / "rows.csv").write_text("x\n" + folder)
    assert by_id(files.folder_documents(spark, str(tmp_path))) == {
        "DOC_a/readme.md": ("readme.md", "file://a/readme.md", "a"), "DOC_b/readme.md": ("readme.md", "file://b/readme.md", "b"),
        "CSV_a/rows.csv_0": ("rows.csv Row 1", "csv://a/rows.csv#0", "x: a"),
        "CSV_b/rows.csv_0": ("rows.csv Row 1", "csv://b/rows.csv#0", "x: b")}


def test_csv_row_numbers_over_splits(spark, tmp_path):
    (tmp_path / "big.csv").write_text("name,v\n" + "".join(f"n{i},{i}\n" for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        df = files.csv_documents(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 3
        assert {r.doc_id: r.doc_title for r in df.collect()} == {f"CSV_big.csv_{i}": f"n{i}" for i in range(2000)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_folder_honours_the_pattern(spark, folder):
    assert files.folder_documents(spark, folder).count() == 11
    assert set(by_id(files.folder_documents(spark, folder, "*.csv"))) == {
        "CSV_x.csv_0", "CSV_x.csv_1", "CSV_y.csv_0", "CSV_y.csv_1"}


def test_media(spark, tmp_path):
    wav = b"RIFF\x00\x00\x00\x00WAVEfmt "
    cases = {"a": b"OggS" + b"\0" * 10, "b": wav, "c": b"ID3" + b"\0" * 10, "d": b"\xff\xfb" + b"\0" * 12,
             "e": b"\0\0\0\x18ftypM4A " + b"\0" * 4, "f": b"\x1a\x45\xdf\xa3" + b"\0" * 10, "g": b"fLaC" + b"\0" * 10,
             "h": b"????" * 4, "i": b"OggS", "j": b"\xff\x1b" + b"\0" * 12}
    for name, content in cases.items():
        (tmp_path / name).write_bytes(content)
    df = files.media_files(spark, str(tmp_path))
    got = {r.path[-1]: r.m for r in df.select("path", files.mime_type(F.col("content")).alias("m")).collect()}
    assert got == {"a": "audio/ogg", "b": "audio/wav", "c": "audio/mp3", "d": "audio/mp3", "e": "audio/mp4", "f": "audio/webm",
                   "g": "audio/flac", "h": "audio/mp4", "i": "audio/mp4", "j": "audio/mp4"}
    inventory = {r.mime: (r.files, r.bytes) for r in files.media_inventory(df).collect()}
    assert inventory["audio/mp3"] == (2, 27)
    declared = df.withColumn("content_type", F.lit("audio/mpeg"))
    assert [r.mime for r in files.media_inventory(declared).collect()] == ["audio/mp3"]


def points(spark, texts, prefix="d"):
    return prep.to_points(prep.chunk_documents(files.inline_documents(spark, [
        {"doc_id": f"{prefix}{i}", "doc_title": "T", "source_uri": "u", "raw_text": t} for i, t in enumerate(texts)])))


def test_index_life(spark, tmp_path):
    path = str(tmp_path / "index")
    assert V.read_index(spark, path).count() == 0
    assert V.refresh_index(points(spark, ["one", "two"]), path) == 2
    assert V.upsert_points(points(spark, ["ONE"]).unionByName(points(spark, ["new"], "e")), path) == 2
    got = {r.chunk_id: r.content for r in V.read_index(spark, path).collect()}
    assert got == {"d0_chk_0": "ONE", "d1_chk_0": "two", "e0_chk_0": "new"}
    stats = V.index_stats(V.read_index(spark, path)).first()
    assert (stats.points, stats.vectors, stats.dimensions) == (3, 3, 768)
    ids = V.read_index(spark, path).filter("chunk_id = 'd1_chk_0'").select("point_id")
    assert V.delete_points(spark, path, ids) == 1
    assert V.read_index(spark, path).count() == 2
    V.upsert_points(points(spark, ["x", "back"]), path)
    assert {r.content for r in V.read_index(spark, path).collect()} == {"x", "back", "new"}
    assert V.compact_index(spark, path) == 3
    V.export_index(V.read_index(spark, path), str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    assert back.count() == 3 and len(back.first().vector) == 768
    assert V.clear_index(spark, path) == 0
    assert V.read_index(spark, path).columns[0] == "point_id"


def test_reload_does_not_duplicate(spark, tmp_path):
    path = str(tmp_path / "index")
    V.upsert_points(points(spark, ["a b", "c"]), path)
    V.upsert_points(points(spark, ["a b", "c"]), path)
    assert V.read_index(spark, path).count() == 2


def test_each_change_writes_only_itself(spark, tmp_path):
    path = tmp_path / "index"
    V.refresh_index(points(spark, ["one", "two"]), str(path))
    for i in range(17):
        V.upsert_points(points(spark, [f"text {i}"], f"p{i}_").coalesce(1), str(path))
    assert V.versions(spark, str(path)) == [1] and len(list((path / "d=18").glob("part-*"))) == 1
    index = V.read_index(spark, str(path))
    assert index.count() == 19
    plan = index.select("point_id", "content")._jdf.queryExecution().executedPlan().toString()
    # The stored side comes first: its scan goes into the broadcast join without a shuffle.
    stored = plan[plan.index("BroadcastHashJoin"):plan.index("BroadcastExchange")]
    assert "FileScan" in stored and "Exchange" not in stored
    V.compact_index(spark, str(path))
    assert V.vacuum(spark, str(path)) == 18 and V.read_index(spark, str(path)).count() == 19
    assert sorted(p.name for p in path.iterdir() if "=" in p.name) == ["v=19"]


def test_another_vector_length_is_refused(spark, tmp_path):
    path = str(tmp_path / "index")
    V.refresh_index(points(spark, ["one"]), path)
    short = points(spark, ["two"], "e").withColumn("embedding", F.slice("embedding", 1, 2))
    with pytest.raises(Exception, match="vectors of length 768, not 2"):
        V.upsert_points(short, path)
    assert V.read_index(spark, path).count() == 1


def test_a_small_change_is_broadcast(spark, tmp_path):
    path = str(tmp_path / "index")
    V.refresh_index(points(spark, ["one", "two"]), path)
    V.upsert_points(points(spark, ["ONE"]), path)
    plan = V.read_index(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_an_unfinished_version_is_ignored(spark, tmp_path):
    path = tmp_path / "index"
    V.refresh_index(points(spark, ["one"]), str(path))
    (path / "v=2").mkdir()
    (path / "d=3").mkdir()
    assert V.read_index(spark, str(path)).count() == 1
    V.upsert_points(points(spark, ["more"], "e"), str(path))
    assert V.read_index(spark, str(path)).count() == 2


def test_point_listing(spark):
    rows = V.list_points(points(spark, ["x" * 100, "short"])).collect()
    assert sorted(len(r.preview) for r in rows) == [5, 93]


def fact_points(spark, doc_ids):
    facts = spark.createDataFrame([(d, d, f"fact {d}") for d in doc_ids], "doc_id string, title string, content string")
    return prep.to_points(prep.facts_to_chunks(facts), hash_embedder(4))


def test_all_changes_are_one_scan(spark, tmp_path):
    path = str(tmp_path / "i")
    scans = []
    for i in range(6):
        V.upsert_points(fact_points(spark, [f"d{i % 4}"]), path)
        scans.append(V.read_index(spark, path)._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
    assert len(set(scans[1:])) == 1 and V.read_index(spark, path).count() == 4
    V.compact_index(spark, path)
    V.delete_points(spark, path, V.read_index(spark, path).filter("doc_id = 'd1'"))
    V.upsert_points(fact_points(spark, ["d9"]), path)
    assert {r["doc_id"] for r in V.read_index(spark, path).collect()} == {"d0", "d2", "d3", "d9"}


def test_the_vector_length_is_named_by_the_newest_folder(spark, tmp_path):
    path = tmp_path / "i"
    V.upsert_points(fact_points(spark, ["a"]), str(path))
    V.delete_points(spark, str(path), V.read_index(spark, str(path)))
    assert [f.name for f in (path / "d=2").iterdir() if f.name.startswith("_length")] == ["_length-4"]
    longer = fact_points(spark, ["b"]).withColumn("embedding", F.array(*[F.lit(1.0).cast("float")] * 5))
    with pytest.raises(Exception, match="vectors of length 4"):
        V.upsert_points(longer, str(path))
    # A writer that died before it named the length: the stored vectors tell.
    V.upsert_points(fact_points(spark, ["c"]), str(path))
    newest = max(int(f.name[2:]) for f in path.iterdir() if (f / "_SUCCESS").exists())
    (path / f"d={newest}" / "_length-4").unlink()
    with pytest.raises(Exception, match="vectors of length 4"):
        V.upsert_points(longer, str(path))
