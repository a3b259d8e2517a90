"""Registered queries on documents, sources, retrieval and the index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import space_words, squeeze, strip
from ..functions.vectors import cosine
from ..lexicons import RouterLexicon
from ..operators import cells, memory, postings, prep, retrieval, signals
from ..session import work_dir
from ..sources import files, vector_table
from . import inputs as I, pipelines
from .registry import CHECKS, query

K = 4
WEIGHT = 0.7

# Greetings and triggers for the router that occur in the given texts.
ROUTER = RouterLexicon(greetings=("und", "the", "la"), triggers=("haedre", "leque", "ungen"), max_words=60)


def _router_sql(column: str) -> str:
    clean = I.sql_strip(f"lower({column})")
    words = f"len({I.sql_words(clean)})"
    has = lambda needles: " OR ".join(f"contains({clean}, '{n}')" for n in needles)
    listed = ", ".join(f"'{g}'" for g in ROUTER.greetings)
    return (f"CASE WHEN {clean} IN ({listed}) OR ({words} <= 2 AND ({has(ROUTER.greetings)})) THEN 'CHIT_CHAT' "
            f"WHEN {has(ROUTER.triggers)} OR {words} > {ROUTER.max_words} THEN 'DEEP_REASONING' ELSE 'RAG_QUERY' END")


# -- preparation ----------------------------------------------------------------------------------

@query("normalized_text", f"""WITH {I.SQL_DOCS}, clean AS (
  SELECT doc_id, array_to_string({I.sql_words('raw_text')}, ' ') AS t FROM docs)
SELECT doc_id, length(t) AS n_chars, md5(t) AS text_md5 FROM clean WHERE t <> ''""")
def normalized_text(spark, sf_dir):
    return prep.normalize_text(I.documents(spark, sf_dir)).select(
        "doc_id", F.length("raw_text").cast("long").alias("n_chars"), F.md5("raw_text").alias("text_md5"))


_CHUNK_SQL = f"WITH {I.SQL_CHUNKS} SELECT chunk_id, doc_id, doc_title, source_uri, chunk_index, token_count, md5(content) AS content_md5 FROM chunks"


@query("chunk_documents", _CHUNK_SQL)
def chunk_documents(spark, sf_dir):
    return I.chunks(spark, sf_dir).select(
        "chunk_id", "doc_id", "doc_title", "source_uri", "chunk_index", "token_count",
        F.md5("content").alias("content_md5"))


_TAGGED = r"<(h1|h2|p)>[^<]+</(h1|h2|p)>"


@query("section_documents", f"""WITH found AS (
  SELECT CAST(page_id AS VARCHAR) AS doc_id, unnest(regexp_extract_all(html, '{_TAGGED}')) AS p,
         generate_subscripts(regexp_extract_all(html, '{_TAGGED}'), 1) AS pos FROM pages),
paragraphs AS (
  SELECT doc_id, pos, p LIKE '<h%' AS styled, {I.sql_strip("regexp_replace(p, '<[^>]*>', '', 'g')")} AS text FROM found),
marked AS (
  SELECT doc_id, pos, text, styled OR (length(text) < 60 AND regexp_matches(text, '^\\p{{Nd}}') AND contains(substr(text, 1, 3), '.')) AS head
  FROM paragraphs WHERE text <> ''),
placed AS (
  SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM marked),
sections AS (
  SELECT doc_id, section, max(text) FILTER (head) AS title, string_agg(text, ' ' ORDER BY pos) FILTER (NOT head) AS body
  FROM placed GROUP BY 1, 2),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section) AS n FROM sections WHERE body IS NOT NULL)
SELECT doc_id || '_SEC_' || n AS doc_id, coalesce(title, 'Knowledge Base') AS doc_title,
       'doc://' || doc_id || '#' || n AS source_uri, md5(body) AS text_md5 FROM numbered""")
def section_documents(spark, sf_dir):
    """Paragraphs and headings of the pages."""
    pages = I.table(spark, sf_dir, "pages", "page_id")
    found = pages.select(F.col("page_id").cast("string").alias("doc_id"),
                         F.posexplode(F.regexp_extract_all("html", F.lit(_TAGGED), F.lit(0))).alias("pos", "p"))
    paragraphs = found.select(
        "doc_id", "pos", F.col("p").startswith("<h").alias("is_heading"),
        strip(F.regexp_replace("p", "<[^>]*>", "")).alias("text")).filter(F.col("text") != "")
    return prep.section_documents(paragraphs).select(
        "doc_id", "doc_title", "source_uri", F.md5("raw_text").alias("text_md5"))


@query("section_lines", f"""WITH {I.SQL_DOCS}, lines AS (
  SELECT doc_id, unnest(string_split(raw_text, chr(10))) AS l, generate_subscripts(string_split(raw_text, chr(10)), 1) AS pos FROM docs),
clean AS (SELECT doc_id, pos, {I.sql_strip('l')} AS text FROM lines),
marked AS (
  SELECT *, length(text) < 60 AND regexp_matches(text, '^\\p{{Nd}}') AND contains(substr(text, 1, 3), '.') AS head
  FROM clean WHERE text <> ''),
placed AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM marked),
sections AS (
  SELECT doc_id, section, max(text) FILTER (head) AS title, string_agg(text, ' ' ORDER BY pos) FILTER (NOT head) AS body
  FROM placed GROUP BY 1, 2),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section) AS n FROM sections WHERE body IS NOT NULL)
SELECT doc_id || '_SEC_' || n AS doc_id, coalesce(title, 'Knowledge Base') AS doc_title, md5(body) AS text_md5 FROM numbered""")
def section_lines(spark, sf_dir):
    """The heading rule on the lines of the documents."""
    return prep.section_documents(prep.document_lines(I.documents(spark, sf_dir))).select(
        "doc_id", "doc_title", F.md5("raw_text").alias("text_md5"))


@query("feature_hash_embed", f"""WITH {I.SQL_CHUNKS}, {I.sql_vectors('vec', 'chunks', 'chunk_id', 'content')}
SELECT chunk_id, slot, round(x::DOUBLE, 6) AS weight FROM vec""")
def feature_hash_embed(spark, sf_dir):
    """The non-zero entries of every chunk's vector."""
    embedded = prep.embed(I.chunks(spark, sf_dir))
    return embedded.select("chunk_id", F.posexplode("embedding").alias("slot", "x")).filter(F.col("x") != 0).select(
        "chunk_id", "slot", F.round(F.col("x").cast("double"), 6).alias("weight"))


@query("embed_queries", f"""WITH {I.SQL_BENCHMARK}, {I.sql_vectors('vec', 'benchmark_queries', 'query_id', 'query')}
SELECT query_id, slot, round(x::DOUBLE, 6) AS weight FROM vec""")
def embed_queries(spark, sf_dir):
    embedded = prep.embed_queries(I.benchmark_queries(spark, sf_dir))
    return embedded.select("query_id", F.posexplode("embedding").alias("slot", "x")).filter(F.col("x") != 0).select(
        "query_id", "slot", F.round(F.col("x").cast("double"), 6).alias("weight"))


def _uuid5_sql(name: str) -> str:
    digest = f"sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode({name}))"
    return (f"substr({digest}, 1, 8) || '-' || substr({digest}, 9, 4) || '-5' || substr({digest}, 14, 3) || '-' || "
            f"translate(substr({digest}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({digest}, 18, 3) || '-' || "
            f"substr({digest}, 21, 12)")


@query("point_ids", f"WITH {I.SQL_CHUNKS} SELECT chunk_id, {_uuid5_sql('chunk_id')} AS point_id FROM chunks")
def point_ids(spark, sf_dir):
    return prep.with_point_id(I.chunks(spark, sf_dir)).select("chunk_id", "point_id")


_FACTS_SQL = """facts AS (
  SELECT 'FACT_' || item_id AS doc_id, split_part(text, ' ', 1) AS title,
         CASE WHEN length(text) > 200 THEN text ELSE 'Note. ' || text END AS content FROM benchmark),
fact_chunks AS (
  SELECT doc_id || '_chk_0' AS chunk_id, doc_id, title AS doc_title,
         CASE WHEN starts_with(content, title) THEN content ELSE title || ': ' || content END AS content, content AS given
  FROM facts)"""


def _facts(spark, sf_dir):
    """Benchmark passages as facts; the longer ones start with their title already."""
    text = F.col("text")
    return I.table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("FACT_"), "item_id").alias("doc_id"), F.split_part(text, F.lit(" "), F.lit(1)).alias("title"),
        F.when(F.length(text) > 200, text).otherwise(F.concat(F.lit("Note. "), text)).alias("content"))


@query("inject_facts", f"""WITH {_FACTS_SQL}
SELECT chunk_id, doc_title, md5(content) AS content_md5, CAST(len({I.sql_words('given')}) AS INTEGER) AS token_count,
       {_uuid5_sql('chunk_id')} AS point_id, 768 AS dimensions FROM fact_chunks""")
def inject_facts(spark, sf_dir):
    """Facts injected into an empty index, read back."""
    path = work_dir(spark, "facts")
    pipelines.add_facts(_facts(spark, sf_dir), path)
    return vector_table.read_index(spark, path).select(
        "chunk_id", "doc_title", F.md5("content").alias("content_md5"), "token_count", "point_id",
        F.size("embedding").alias("dimensions"))


@query("ingest_documents", f"""WITH {I.SQL_CHUNKS}
SELECT doc_id, count(*) AS chunks, CAST(sum(token_count) AS BIGINT) AS tokens, 768 AS dimensions FROM chunks GROUP BY 1""")
def ingest_documents(spark, sf_dir):
    """Chunk, embed, replace the index; what the index then holds per document."""
    path = work_dir(spark, "ingest")
    pipelines.ingest(I.documents(spark, sf_dir), path)
    return vector_table.read_index(spark, path).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("token_count").alias("tokens"),
        F.max(F.size("embedding")).alias("dimensions"))


# -- sources and sinks ----------------------------------------------------------------------------

@query("text_source", f"SELECT md5(array_to_string({I.sql_words('text')}, ' ')) AS text_md5 FROM benchmark")
def text_source(spark, sf_dir):
    """Benchmark passages written as one text file each and read back."""
    path = work_dir(spark, "text")
    I.table(spark, sf_dir, "benchmark").repartition("item_id").write.partitionBy("item_id").text(path)
    return files.text_documents(spark, path).select(F.md5(squeeze(F.col("raw_text"))).alias("text_md5"))


@query("json_source", """SELECT CASE WHEN c_acctbal > 5000 THEN c_mktsegment ELSE c_name END AS raw_text, c_name AS doc_title FROM customer""")
def json_source(spark, sf_dir):
    """Customers written as files of one JSON array per thousand keys and read back. The text is in
    ``content`` for some and in ``text`` for the others."""
    path = work_dir(spark, "json")
    rich = F.col("c_acctbal") > 5000
    item = F.struct(F.col("c_name").alias("title"), F.when(rich, F.col("c_mktsegment")).alias("content"),
                    F.when(~rich, F.col("c_name")).alias("text"))
    arrays = I.table(spark, sf_dir, "customer").groupBy(F.floor(F.col("c_custkey") / 1000).alias("part")).agg(
        F.to_json(F.collect_list(item)).alias("value"))
    arrays.repartition("part").write.partitionBy("part").text(path)
    return files.json_documents(spark, path, extensions=("txt",)).select("raw_text", "doc_title")


@query("json_source_split", CHECKS["json_source"])
def json_source_split(spark, sf_dir):
    """All customers in arrays of one file each per thousand keys, with commas, quotes, brackets and breaks in strings, read in splits."""
    path = work_dir(spark, "json")
    item = F.struct(F.col("c_name").alias("title"), F.concat(F.lit('"], {\\\n'), F.when(
        F.col("c_acctbal") > 5000, F.col("c_mktsegment")).otherwise(F.col("c_name"))).alias("content"))
    arrays = I.table(spark, sf_dir, "customer").groupBy(F.floor(F.col("c_custkey") / 1000).alias("part")).agg(
        F.to_json(F.collect_list(item)).alias("value"))
    arrays.repartition("part").write.partitionBy("part").text(path)
    read = files.json_documents(spark, path, extensions=("txt",), in_splits=True)
    return read.select(F.replace("raw_text", F.lit('"], {\\\n'), F.lit("")).alias("raw_text"), "doc_title")


@query("csv_source", """SELECT 'c_custkey: ' || c_custkey || ' | name: ' || c_name || chr(10) || 'x | c_mktsegment: ' || c_mktsegment || ' | name: ' || c_name AS raw_text,
  c_name AS doc_title, true AS with_file FROM customer""")
def csv_source(spark, sf_dir):
    """Customers written as CSV files and read back; a cell has a line break, and the header names a column twice."""
    path = work_dir(spark, "csv")
    _customer_csv(spark, sf_dir, path)
    return files.csv_documents(spark, path, multi_line=True, extensions=("txt",)).select(
        "raw_text", "doc_title", F.col("doc_id").rlike(r"^CSV_part=\d+/.*_\d+$").alias("with_file"))


def _customer_csv(spark, sf_dir, path):
    text = F.concat(F.lit('c_custkey,name,c_mktsegment,empty,name\n'), F.array_join(F.collect_list(F.concat(
        "c_custkey", F.lit(',"'), "c_name", F.lit('\nx",'), "c_mktsegment", F.lit(',,'), "c_name")), "\n"))
    parts = I.table(spark, sf_dir, "customer").groupBy(F.floor(F.col("c_custkey") / 500).alias("part")).agg(text.alias("value"))
    parts.repartition("part").write.partitionBy("part").text(path)


@query("csv_source_split", CHECKS["csv_source"])
def csv_source_split(spark, sf_dir):
    """The same files, read in splits."""
    path = work_dir(spark, "csv")
    _customer_csv(spark, sf_dir, path)
    return files.csv_documents(spark, path, extensions=("txt",), in_splits=True).select(
        "raw_text", "doc_title", F.col("doc_id").rlike(r"^CSV_part=\d+/.*_\d+$").alias("with_file"))


@query("folder_import", f"""WITH bodies AS (
  SELECT 'texts/item_id=' || item_id AS folder, text AS raw_text FROM benchmark
  UNION ALL SELECT 'tables', 's_suppkey: ' || s_suppkey || ' | name: ' || s_name FROM supplier),
cut AS (SELECT folder, {I.sql_words('raw_text')} AS w FROM bodies),
starts AS (SELECT folder, w, unnest(range(0, CAST(ceil(len(w) / 462.0) AS BIGINT))) AS i FROM cut WHERE len(w) > 0)
SELECT folder, '_chk_' || i AS chunk, md5(array_to_string(w[i * 462 + 1 : i * 462 + 512], ' ')) AS content_md5, 768 AS dimensions FROM starts""")
def folder_import(spark, sf_dir):
    """A folder of text and CSV files, many of one name, imported into an index, twice."""
    folder, path = work_dir(spark, "folder"), work_dir(spark, "folder-index")
    # Folders that one task writes have a file of one name.
    I.table(spark, sf_dir, "benchmark").repartition("item_id").write.partitionBy("item_id").text(f"{folder}/texts")
    I.table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("name")).write.option(
        "header", "true").csv(f"{folder}/tables")
    for _ in range(2):
        pipelines.import_folder(spark, folder, path)
    return vector_table.read_index(spark, path).select(
        F.regexp_extract("doc_id", r"^(?:DOC|CSV)_(.*)/", 1).alias("folder"), F.regexp_extract("chunk_id", r"(_chk_\d+)$", 1).alias("chunk"),
        F.md5("content").alias("content_md5"), F.size("embedding").alias("dimensions"))


@query("document_sync", f"""WITH {I.SQL_CHUNKS}, changed AS (
  SELECT doc_id, list_distinct({I.sql_words('raw_text')}) AS w FROM docs WHERE source_uri = 'src7'),
starts2 AS (SELECT *, unnest(range(0, CAST(ceil(len(w) / 462.0) AS BIGINT))) AS i FROM changed WHERE len(w) > 0)
SELECT chunk_id, token_count FROM chunks WHERE source_uri <> 'src7'
UNION ALL SELECT doc_id || '_chk_' || i, CAST(len(w[i * 462 + 1 : i * 462 + 512]) AS INTEGER) FROM starts2""")
def document_sync(spark, sf_dir):
    """One source's documents lost their repeated words; the index follows and drops the chunks that
    are no more."""
    path = _built_index(spark, sf_dir, "sync")
    changed = I.documents(spark, sf_dir).filter(F.col("source_uri") == "src7").withColumn(
        "raw_text", F.array_join(F.array_distinct(space_words(F.col("raw_text"))), " "))
    pipelines.sync_documents(changed, path)
    return vector_table.read_index(spark, path).select("chunk_id", "token_count")


@query("snapshot_sync", CHECKS["document_sync"])
def snapshot_sync(spark, sf_dir):
    """The same change found by comparing digests of two whole snapshots; other documents are not embedded again."""
    path, known = work_dir(spark, "snapshot-index"), work_dir(spark, "snapshot-digests")
    docs = I.documents(spark, sf_dir)
    pipelines.sync_snapshot(docs, path, known)
    fewer = F.array_join(F.array_distinct(space_words(F.col("raw_text"))), " ")
    pipelines.sync_snapshot(docs.withColumn(
        "raw_text", F.when(F.col("source_uri") == "src7", fewer).otherwise(F.col("raw_text"))), path, known)
    return vector_table.read_index(spark, path).select("chunk_id", "token_count")


@query("user_turn_scan", f"""WITH {I.SQL_TURNS}
SELECT turn_id, session_id, user_id, role, md5(content) AS content_md5 FROM turns WHERE role = 'user'""")
def user_turn_scan(spark, sf_dir):
    return memory.user_turns(I.turns(spark, sf_dir)).withColumn("content_md5", F.md5("content")).drop("content")


# What a file begins with, by the item's number; the last one has nothing else.
_HEADS = ("OggS and more ", "RIFFsizeWAVE", "ID3 and more ", "size" + "ftyp and more ", "fLaC and more ", "no signature ", "fLaC")


@query("media_inventory", f"""WITH bodies AS (
  SELECT item_id % {len(_HEADS)} AS kind, [{', '.join(repr(h) for h in _HEADS)}][item_id % {len(_HEADS)} + 1]
    || CASE WHEN item_id % {len(_HEADS)} = {len(_HEADS) - 1} THEN '' ELSE md5(text) END || chr(10) AS body FROM benchmark)
SELECT ['audio/ogg', 'audio/wav', 'audio/mp3', 'audio/mp4', 'audio/flac', 'audio/mp4', 'audio/mp4'][kind + 1] AS mime,
  count(*) AS files, CAST(sum(strlen(body)) AS BIGINT) AS bytes FROM bodies GROUP BY 1""")
def media_inventory(spark, sf_dir):
    """Files of several kinds, some of them shorter than a signature, written and taken stock of."""
    path = work_dir(spark, "media")
    kind = (F.col("item_id") % len(_HEADS)).cast("int")
    head = F.get(F.array(*[F.lit(h) for h in _HEADS]), kind)
    body = F.concat(head, F.when(kind == len(_HEADS) - 1, F.lit("")).otherwise(F.md5("text")))
    I.table(spark, sf_dir, "benchmark").select("item_id", body.alias("value")).repartition("item_id").write.partitionBy("item_id").text(path)
    return files.media_inventory(files.media_files(spark, path))


# -- retrieval ------------------------------------------------------------------------------------

@query("cosine_neighbours", """SELECT a.vec_id, round(
    list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])
      / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]))
         * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_neighbours(spark, sf_dir):
    """Similarity of every vector to the one with the next id."""
    e = I.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    following = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(following, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


_SQL_VECTOR_QUERIES = """vector_index AS (
  SELECT CAST(vec_id AS VARCHAR) AS chunk_id, label, embedding::DOUBLE[] AS embedding FROM embeddings),
first_of_label AS (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY 1),
queries AS (SELECT 'label ' || f.label AS query_id, f.label, e.embedding::DOUBLE[] AS embedding
  FROM first_of_label f JOIN embeddings e USING (vec_id)),
scored AS (
  SELECT query_id, q.label AS query_label, chunk_id, i.label, round(list_dot_product(q.embedding, i.embedding)
    / (sqrt(list_dot_product(q.embedding, q.embedding)) * sqrt(list_dot_product(i.embedding, i.embedding))), 9) AS score
  FROM queries q CROSS JOIN vector_index i)"""


def _vector_index(spark, sf_dir):
    return I.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("chunk_id"), F.col("label").cast("string").alias("doc_id"), "embedding")


def _vector_queries(spark, sf_dir):
    """The first vector of every label."""
    return I.table(spark, sf_dir, "embeddings").groupBy("label").agg(
        F.min_by("embedding", "vec_id").alias("embedding")).select(
        F.concat(F.lit("label "), "label").alias("query_id"), F.col("label").cast("string").alias("filter_value"), "embedding")


@query("dense_topk", f"""WITH {_SQL_VECTOR_QUERIES}
SELECT query_id, chunk_id, round(score, 6) AS score,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank
FROM scored QUALIFY rank <= 5""")
def dense_topk(spark, sf_dir):
    hits = retrieval.dense_topk(_vector_index(spark, sf_dir), _vector_queries(spark, sf_dir), 5)
    return hits.withColumn("score", F.round("score", 6))


@query("dense_cells", CHECKS["dense_topk"])
def dense_cells(spark, sf_dir):
    """The same hits from cells, of which only those whose angle can matter are read."""
    path = work_dir(spark, "cells-index")
    cells.build_cells(_vector_index(spark, sf_dir), path)
    return cells.cells_topk(_vector_queries(spark, sf_dir), path, 5).withColumn("score", F.round("score", 6))


@query("dense_topk_filtered", f"""WITH {_SQL_VECTOR_QUERIES}
SELECT query_id, chunk_id, round(score, 6) AS score,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank
FROM scored WHERE label = query_label QUALIFY rank <= 5""")
def dense_topk_filtered(spark, sf_dir):
    """Each query sees only its own label."""
    hits = retrieval.dense_topk(_vector_index(spark, sf_dir), _vector_queries(spark, sf_dir), 5, "doc_id")
    return hits.withColumn("score", F.round("score", 6))


@query("stored_search", f"""WITH {_SQL_VECTOR_QUERIES}, ranked AS (
  SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank
  FROM scored QUALIFY rank <= 3)
SELECT query_id, rank, chunk_id, coalesce('quality ' || l.quality, 'Knowledge') AS doc_title,
       CASE WHEN l.doc_id IS NULL THEN 'document' ELSE chunk_id END AS doc_id, round(score, 6) AS score
FROM ranked LEFT JOIN labels l ON CAST(l.doc_id AS VARCHAR) = chunk_id""")
def stored_search(spark, sf_dir):
    """Points whose payload comes from the labels table; those without a label get the defaults."""
    labels = I.table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("point_id"), F.col("doc_id").cast("string").alias("doc_id"),
        F.concat(F.lit("quality "), "quality").alias("doc_title"))
    index = (_vector_index(spark, sf_dir).select(F.col("chunk_id").alias("point_id"), "embedding")
             .join(labels, "point_id", "left")
             .withColumn("chunk_id", F.lit(None).cast("string")).withColumn("source_uri", F.lit(None).cast("string"))
             .withColumn("content", F.lit(None).cast("string")))
    hits = retrieval.stored_search(index, _vector_queries(spark, sf_dir), 3)
    return hits.select("query_id", "rank", "chunk_id", "doc_title", "doc_id", F.round("score", 6).alias("score"))


@query("lexical_topk", f"""WITH {I.SQL_CHUNKS}, {I.SQL_BENCHMARK}, {I.sql_lexical('benchmark_queries', 5)}
SELECT query_id, chunk_id, round(score, 6) AS score, CAST(r AS INTEGER) AS rank FROM lexical_ranked""")
def lexical_topk(spark, sf_dir):
    hits = retrieval.lexical_topk(I.chunks(spark, sf_dir), I.benchmark_queries(spark, sf_dir), 5)
    return hits.withColumn("score", F.round("score", 6))


@query("lexical_postings", CHECKS["lexical_topk"])
def lexical_postings(spark, sf_dir):
    """The same hits from an inverted index at rest, of which only blocks that can matter are read."""
    path = work_dir(spark, "postings-index")
    postings.build_postings(I.chunks(spark, sf_dir), path)
    return postings.postings_topk(I.benchmark_queries(spark, sf_dir), path, 5).withColumn("score", F.round("score", 6))


@query("term_overlap_topk", f"""WITH {I.SQL_CHUNKS}, {I.SQL_BENCHMARK},
terms AS (SELECT DISTINCT query_id, unnest({I.sql_words('lower(query)')}) AS t FROM benchmark_queries),
sizes AS (SELECT query_id, count(*) AS n FROM terms GROUP BY 1),
content_words AS (SELECT DISTINCT chunk_id, unnest({I.sql_words('lower(content)')}) AS t FROM chunks),
shared AS (SELECT query_id, chunk_id, count(*) AS hits FROM terms JOIN content_words USING (t) GROUP BY 1, 2),
scored AS (
  SELECT s.query_id, c.chunk_id, coalesce(h.hits, 0) / (s.n + 1.0::DOUBLE) AS score
  FROM sizes s CROSS JOIN (SELECT chunk_id FROM chunks) c
  LEFT JOIN shared h ON h.query_id = s.query_id AND h.chunk_id = c.chunk_id)
SELECT query_id, chunk_id, round(score, 6) AS score,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank
FROM scored QUALIFY rank <= 3""")
def term_overlap_topk(spark, sf_dir):
    hits = retrieval.term_overlap_topk(I.chunks(spark, sf_dir), I.benchmark_queries(spark, sf_dir), 3)
    return hits.withColumn("score", F.round("score", 6))


@query("overlap_postings", CHECKS["term_overlap_topk"])
def overlap_postings(spark, sf_dir):
    path = work_dir(spark, "overlap-index")
    postings.build_postings(I.chunks(spark, sf_dir), path, "presence")
    return postings.overlap_postings_topk(I.benchmark_queries(spark, sf_dir), path, 3).withColumn("score", F.round("score", 6))


def _benchmark_hits(spark, sf_dir):
    queries = prep.embed_queries(I.benchmark_queries(spark, sf_dir))
    return retrieval.hybrid_search(I.points(spark, sf_dir), queries, K, WEIGHT)


_HYBRID_SQL = f"WITH {I.SQL_CHUNKS}, {I.SQL_BENCHMARK}, {I.sql_hybrid('benchmark_queries', K, WEIGHT)}"


@query("hybrid_rrf", f"""{_HYBRID_SQL}
SELECT query_id, chunk_id, doc_id, round(score, 6) AS score, round(rrf_score, 9) AS rrf_score, rank
FROM hits JOIN chunks USING (chunk_id)""")
def hybrid_rrf(spark, sf_dir):
    return _benchmark_hits(spark, sf_dir).select(
        "query_id", "chunk_id", "doc_id", F.round("score", 6).alias("score"), F.round("rrf_score", 9).alias("rrf_score"), "rank")


@query("citations", f"""{_HYBRID_SQL}
SELECT query_id, rank, doc_id, doc_title, source_uri, round(score, 3) AS score, substr(content, 1, 180) || '...' AS snippet
FROM hits JOIN chunks USING (chunk_id)""")
def citations(spark, sf_dir):
    return retrieval.citations(_benchmark_hits(spark, sf_dir))


@query("retrieval_report", f"""{_HYBRID_SQL}
SELECT query_id, CAST(count(*) AS INTEGER) AS results_count, string_agg(chunk_id, ' ' ORDER BY rank) AS chunk_ids,
       md5(string_agg(content, chr(10) || '---' || chr(10) ORDER BY rank)) AS context_md5
FROM hits JOIN chunks USING (chunk_id) GROUP BY 1""")
def retrieval_report(spark, sf_dir):
    return retrieval.retrieval_report(_benchmark_hits(spark, sf_dir)).select(
        "query_id", "results_count", F.array_join("chunk_ids", " ").alias("chunk_ids"),
        F.md5("context_block").alias("context_md5"))


def _question_hits(spark, sf_dir):
    queries = prep.embed_queries(I.questions(spark, sf_dir))
    return retrieval.hybrid_search(I.points(spark, sf_dir), queries, K, WEIGHT)


_TOPICS_SQL = f"""said AS (SELECT * FROM turns WHERE role = 'user'),
said_words AS (
  SELECT user_id, ts, turn_id, unnest({I.sql_words('lower(content)')}) AS raw,
         generate_subscripts({I.sql_words('lower(content)')}, 1) AS pos FROM said),
topic_counts AS (
  SELECT user_id, trim(raw, '?,.!') AS word, count(*) AS n, min((ts, turn_id, pos)) AS first FROM said_words
  WHERE length(raw) > 3 AND trim(raw, '?,.!') NOT IN ('the','a','an','is','in','it','to','of','for','and','or','on','what','how','why','i','you')
  GROUP BY 1, 2),
top_topics AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS r FROM topic_counts QUALIFY r <= 5),
topic_lists AS (SELECT user_id, string_agg(word, ', ' ORDER BY r) AS topics FROM top_topics GROUP BY 1),
profiles AS (
  SELECT s.user_id, count(*) AS messages, any_value(t.topics) AS topics,
         'User has engaged in ' || count(*) || ' interaction turns. Frequent focus areas: '
           || coalesce(any_value(t.topics), 'General Inquiries') || '.' AS profile_summary
  FROM said s LEFT JOIN topic_lists t USING (user_id) GROUP BY 1)"""


@query("grounded_prompts", f"""WITH {I.SQL_CHUNKS}, {I.SQL_QUESTIONS}, {I.sql_hybrid('questions', K, WEIGHT)}, {_TOPICS_SQL},
sources AS (
  SELECT query_id, '### Retrieved Enterprise Knowledge (Indexed via Apache Spark):' || chr(10) || string_agg(
    '[Source ' || rank || '] Document ID: ' || doc_id || ' | Title: ' || doc_title || ' | URI: ' || source_uri || chr(10)
    || 'Content:' || chr(10) || content || chr(10), chr(10) ORDER BY rank)
    || chr(10) || '----------------------------------------' || chr(10) || chr(10) AS s
  FROM hits JOIN chunks USING (chunk_id) GROUP BY 1),
recent AS (
  SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, turn_id DESC) <= 6),
dialogue AS (
  SELECT session_id, '### Recent Conversation Context:' || chr(10) || string_agg(
    CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || content, chr(10) ORDER BY ts, turn_id)
    || chr(10) || chr(10) || '----------------------------------------' || chr(10) || chr(10) AS d
  FROM recent GROUP BY 1)
SELECT q.query_id, q.session_id, q.user_id, md5(
  '### User Long-Term Memory Profile:' || chr(10) || '- Profile Summary: ' || p.profile_summary || chr(10)
  || '- Key Interests: ' || coalesce(p.topics, '') || chr(10) || chr(10)
  || coalesce(s.s, '') || d.d || 'User Question: ' || q.query || chr(10)
  || 'Assistant Response (Grounded in context above):') AS prompt_md5
FROM questions q JOIN profiles p USING (user_id) JOIN dialogue d USING (session_id) LEFT JOIN sources s USING (query_id)""")
def grounded_prompts(spark, sf_dir):
    turns = I.turns(spark, sf_dir)
    prompts = retrieval.grounded_prompts(
        I.questions(spark, sf_dir), _question_hits(spark, sf_dir), memory.context_arrays(turns),
        memory.consolidate_profiles(turns))
    return prompts.withColumn("prompt_md5", F.md5("prompt")).drop("prompt")


@query("compact_prompts", f"""WITH {I.SQL_QUESTIONS}, numbered AS (
  SELECT session_id, role, ts, turn_id, regexp_replace(coalesce(content, ''), '\\b(size\\s*S|S\\s*size)\\b', 'sizes S-XXL', 'gi') AS content,
    row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, turn_id DESC) AS r FROM turns),
recent AS (SELECT session_id, string_agg(CASE role WHEN 'user' THEN 'Customer' ELSE 'Helper' END || ': ' || content || chr(10), '' ORDER BY r DESC) AS dialogue
  FROM numbered WHERE r <= 4 GROUP BY 1)
SELECT query_id, md5('You answer for a shop.' || chr(10) || chr(10) || 'Be brief.' || chr(10) || chr(10) || 'Conversation History:' || chr(10) || dialogue || chr(10)
  || 'Customer: ' || query || chr(10) || 'Helper:') AS prompt_md5 FROM questions JOIN recent USING (session_id)""")
def compact_prompts(spark, sf_dir):
    """The short prompt of every session's last question."""
    prompts = retrieval.compact_prompts(I.questions(spark, sf_dir), memory.context_arrays(I.turns(spark, sf_dir)),
                                        "You answer for a shop.", "Helper", "Be brief.")
    return prompts.select("query_id", F.md5("prompt").alias("prompt_md5"))


_SQL_DOC_QUERIES = f"doc_queries AS (SELECT doc_id AS query_id, array_to_string({I.sql_words('raw_text')}[1:8], ' ') AS query FROM docs)"


@query("lexical_large", f"""WITH {I.SQL_CHUNKS}, {_SQL_DOC_QUERIES}, {I.sql_lexical('doc_queries', 3)}
SELECT query_id, chunk_id, round(score, 6) AS score, CAST(r AS INTEGER) AS rank FROM lexical_ranked""")
def lexical_large(spark, sf_dir):
    """The first words of every document as queries, in several blocks."""
    asked = I.documents(spark, sf_dir).select(
        F.col("doc_id").alias("query_id"), F.array_join(F.slice(space_words(F.col("raw_text")), 1, 8), " ").alias("query"))
    hits = retrieval.lexical_topk(I.chunks(spark, sf_dir), asked, 3, max_queries=400)
    return hits.withColumn("score", F.round("score", 6))


@query("gated_retrieval", f"""WITH {I.SQL_CHUNKS}, {I.SQL_QUESTIONS},
routed AS (SELECT *, {_router_sql('query')} AS intent FROM questions),
asked AS (SELECT query_id, query FROM routed WHERE intent <> 'CHIT_CHAT'),
{I.sql_hybrid('asked', K, WEIGHT)}
SELECT r.query_id, r.intent, h.chunk_id, h.rank, round(h.rrf_score, 9) AS rrf_score
FROM routed r LEFT JOIN hits h USING (query_id)""")
def gated_retrieval(spark, sf_dir):
    routed = prep.embed_queries(I.questions(spark, sf_dir)).withColumn("intent", signals.route_intent(F.col("query"), ROUTER))
    hits = retrieval.gated_search(I.points(spark, sf_dir), routed, K, WEIGHT)
    return hits.select("query_id", "intent", "chunk_id", "rank", F.round("rrf_score", 9).alias("rrf_score"))


@query("answer_plans", f"""WITH {I.SQL_CHUNKS}, {I.SQL_QUESTIONS},
routed AS (SELECT *, {_router_sql('query')} AS intent FROM questions),
asked AS (SELECT query_id, query FROM routed WHERE intent <> 'CHIT_CHAT'),
{I.sql_hybrid('asked', K, WEIGHT)}, cited AS (
  SELECT query_id, string_agg(doc_id, ' ' ORDER BY rank) AS cited, count(*) AS n FROM hits JOIN chunks USING (chunk_id) GROUP BY 1)
SELECT query_id, intent, CASE intent WHEN 'DEEP_REASONING' THEN 'deep' ELSE 'fast' END AS model_tier,
       coalesce(cited, '') AS cited, CAST(coalesce(n, 0) AS INTEGER) AS sources FROM routed LEFT JOIN cited USING (query_id)""")
def answer_plans(spark, sf_dir):
    """From questions to intent, citations and prompt in one plan."""
    turns = I.turns(spark, sf_dir)
    plans = pipelines.prepare_answers(I.questions(spark, sf_dir), turns, memory.consolidate_profiles(turns),
                                      I.points(spark, sf_dir), K, WEIGHT, ROUTER)
    sources = (F.length("prompt") - F.length(F.replace("prompt", F.lit("[Source "), F.lit("")))) / 8
    return plans.select("query_id", "intent", "model_tier",
                        F.coalesce(F.array_join("citations.doc_id", " "), F.lit("")).alias("cited"),
                        sources.cast("int").alias("sources"))


# -- index ----------------------------------------------------------------------------------------

def _built_index(spark, sf_dir, label):
    path = work_dir(spark, label)
    vector_table.refresh_index(I.points(spark, sf_dir), path)
    return path


@query("index_upsert", f"""WITH {I.SQL_CHUNKS}, revised AS (
  SELECT chunk_id, doc_id, chunk_index, 'revised ' || content AS content FROM chunks WHERE source_uri = 'src3'),
added AS (SELECT 'new_' || item_id || '_chk_0' AS chunk_id, text AS content FROM benchmark)
SELECT chunk_id, md5(content) AS content_md5 FROM revised
UNION ALL SELECT chunk_id, md5(content) FROM chunks WHERE source_uri <> 'src3'
UNION ALL SELECT chunk_id, md5(array_to_string({I.sql_words('content')}, ' ')) FROM added""")
def index_upsert(spark, sf_dir):
    """One source's chunks revised and new documents added in one upsert."""
    path = _built_index(spark, sf_dir, "upsert")
    revised = I.chunks(spark, sf_dir).filter(F.col("source_uri") == "src3").withColumn(
        "content", F.concat(F.lit("revised "), "content"))
    added = prep.chunk_documents(I.table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("new_"), "item_id").alias("doc_id"), F.lit("New").alias("doc_title"),
        F.lit("new").alias("source_uri"), F.col("text").alias("raw_text")))
    vector_table.upsert_points(prep.to_points(revised.unionByName(added)), path)
    return vector_table.read_index(spark, path).select("chunk_id", F.md5("content").alias("content_md5"))


@query("index_stats", f"""WITH {I.SQL_CHUNKS}
SELECT count(*) AS points, count(*) AS vectors, 768 AS dimensions FROM chunks""")
def index_stats(spark, sf_dir):
    return vector_table.index_stats(I.points(spark, sf_dir))


@query("index_points", f"""WITH {I.SQL_CHUNKS}
SELECT {_uuid5_sql('chunk_id')} AS point_id, doc_title, chunk_id, source_uri,
       CASE WHEN length(content) > 90 THEN substr(content, 1, 90) || '...' ELSE content END AS preview FROM chunks""")
def index_points(spark, sf_dir):
    return vector_table.list_points(prep.with_point_id(I.chunks(spark, sf_dir)), None)


@query("index_points_page", f"""WITH {I.SQL_CHUNKS}
SELECT {_uuid5_sql('chunk_id')} AS point_id, chunk_id FROM chunks ORDER BY point_id LIMIT 50""")
def index_points_page(spark, sf_dir):
    """The first page of the listing."""
    return vector_table.list_points(prep.with_point_id(I.chunks(spark, sf_dir)), 50).select("point_id", "chunk_id")


@query("index_delete", f"""WITH {I.SQL_CHUNKS}, bad AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS doc_id FROM labels WHERE quality = 0)
SELECT chunk_id FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM bad)""")
def index_delete(spark, sf_dir):
    """The chunks of documents labelled as poor are deleted by point id."""
    path = _built_index(spark, sf_dir, "delete")
    poor = I.table(spark, sf_dir, "labels").filter(F.col("quality") == 0).select(F.col("doc_id").cast("string").alias("doc_id"))
    ids = vector_table.read_index(spark, path).join(poor, "doc_id", "left_semi").select("point_id")
    vector_table.delete_points(spark, path, ids)
    return vector_table.read_index(spark, path).select("chunk_id")


@query("index_clear", "SELECT 0::BIGINT AS points, 0::BIGINT AS vectors, 0 AS dimensions")
def index_clear(spark, sf_dir):
    path = _built_index(spark, sf_dir, "clear")
    vector_table.clear_index(spark, path)
    return vector_table.index_stats(vector_table.read_index(spark, path))


@query("index_export", f"""WITH {I.SQL_CHUNKS}
SELECT {_uuid5_sql('chunk_id')} AS id, chunk_id, token_count, md5(content) AS content_md5, 768 AS dimensions FROM chunks""")
def index_export(spark, sf_dir):
    """All points exported as JSON lines and read back."""
    path = work_dir(spark, "export")
    points = I.points(spark, sf_dir)
    vector_table.export_index(points, path)
    back = spark.read.schema(vector_table.export_rows(points).schema).json(path)
    return back.select("id", "payload.chunk_id", "payload.token_count", F.md5("payload.content").alias("content_md5"),
                       F.size("vector").alias("dimensions"))


@query("knowledge_seed", f"""WITH {I.SQL_CHUNKS}
SELECT 'part-' || p_partkey || '_chk_0' AS chunk_id, p_type AS category, md5(CASE WHEN starts_with(p_name || ' of ' || p_brand, p_type) THEN
  p_name || ' of ' || p_brand ELSE p_type || ': ' || p_name || ' of ' || p_brand END) AS content_md5 FROM part""")
def knowledge_seed(spark, sf_dir):
    """Parts as a keyword-tagged knowledge seed (id, text, category)."""
    facts = I.table(spark, sf_dir, "part").select(
        F.concat(F.lit("part-"), "p_partkey").alias("doc_id"), F.col("p_type").alias("title"),
        F.concat("p_name", F.lit(" of "), "p_brand").alias("content"))
    path = work_dir(spark, "seed")
    pipelines.add_facts(facts, path)
    return vector_table.read_index(spark, path).select(
        "chunk_id", F.col("doc_title").alias("category"), F.md5("content").alias("content_md5"))
