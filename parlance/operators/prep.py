"""Document preparation: normalising, chunking, sections, embeddings, facts, point ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ordered import MAX_ROWS, Keyed, keyed, with_running
from ..functions.text import has_text, space_words, squeeze, strip, uuid5
from ..functions.vectors import hash_embedder

CHUNK_SIZE = 512
CHUNK_OVERLAP = 50


def normalize_text(docs: DataFrame, column: str = "raw_text") -> DataFrame:
    """White space squeezed; rows with null or blank text are dropped."""
    return docs.filter(has_text(F.col(column))).withColumn(column, squeeze(F.col(column)))


def chunk_documents(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Overlapping windows of space-separated words, one row each.

    A window starts every ``size - overlap`` words until the text ends, so the last one may lie
    wholly inside the one before it. Row-wise: no shuffle, and all chunks of a document are cut
    from one split of its text.
    """
    if size < 1 or overlap < 0 or overlap >= size:
        raise ValueError("need size >= 1 and 0 <= overlap < size")
    step = size - overlap

    def cut(words: Column, i: Column) -> Column:
        part = F.slice(words, i * step + 1, F.lit(size))
        return F.struct(
            i.cast("int").alias("chunk_index"),
            F.array_join(part, " ").alias("content"),
            F.size(part).alias("token_count"),
        )

    def cut_all(words: Column) -> Column:
        last = F.floor((F.size(words) - 1) / step).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: cut(words, i))

    # The outer one-element transform names the words, so that each text is split once and slices
    # share that one array; the cost stays linear in the text.
    chunks = F.transform(F.array(space_words(F.col("raw_text"))), cut_all)[0]
    return docs.filter(has_text(F.col("raw_text"))).select(
        "doc_id", "doc_title", "source_uri", F.inline(chunks),
    ).select(
        F.concat(F.col("doc_id"), F.lit("_chk_"), F.col("chunk_index")).alias("chunk_id"),
        "doc_id", "doc_title", "source_uri", "chunk_index", "content", "token_count",
    )


def document_lines(docs: DataFrame, column: str = "raw_text") -> DataFrame:
    """One row per non-blank line of a document, in order, as unstyled paragraphs."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.col(column), "\n")).alias("pos", "text"))
    return (lines.withColumn("text", strip(F.col("text"))).filter(F.col("text") != "")
            .withColumn("is_heading", F.lit(False)))


def section_documents(paragraphs: DataFrame, default_title: str = "Knowledge Base",
                      max_rows: int = MAX_ROWS) -> DataFrame:
    """Sections from ordered paragraphs ``(doc_id, pos, text, is_heading)``.

    A paragraph is a heading if styled so, or if it is shorter than 60 characters, starts with a
    digit and has a dot among its first three characters. Body paragraphs are joined by a space
    under the last heading; headings without body vanish and take no number.
    """
    text = F.col("text")
    numbered = (F.length(text) < 60) & text.rlike(r"^\p{Nd}") & F.substring(text, 1, 3).contains(".")
    marked = paragraphs.select("doc_id", "pos", "text", (F.col("is_heading") | numbered).alias("_head"))
    lines = keyed(marked, ["doc_id"], ["pos"], max_rows)
    placed = with_running(lines, ["pos"], {"_section": ("sum", F.col("_head").cast("int"))}).rows()
    body = F.when(~F.col("_head"), F.struct("pos", "text"))
    sections = (
        placed.groupBy("doc_id", "_section")
        .agg(F.max(F.when(F.col("_head"), text)).alias("_title"),
             F.sort_array(F.collect_list(body)).alias("_body"))
        .filter(F.size("_body") > 0)
    )
    # A document has no more sections than lines.
    by_doc = keyed(sections, ["doc_id"], ["_section"], max_rows) if lines.split else Keyed(sections, ["doc_id"])
    return with_running(by_doc, ["_section"], {"_no": ("sum", F.lit(1))}).rows().select(
        F.concat(F.col("doc_id"), F.lit("_SEC_"), F.col("_no")).alias("doc_id"),
        F.coalesce("_title", F.lit(default_title)).alias("doc_title"),
        F.concat(F.lit("doc://"), F.col("doc_id"), F.lit("#"), F.col("_no")).alias("source_uri"),
        F.array_join(F.col("_body.text"), " ").alias("raw_text"),
    )


Embedder = Callable[[Column], Column]


def embed(df: DataFrame, column: str = "content", embedder: Embedder | None = None) -> DataFrame:
    """Adds ``embedding`` (array<float>). Any ``Column -> Column`` embedder fits, such as an Arrow
    UDF around a model; the default is feature hashing."""
    return df.withColumn("embedding", (embedder or hash_embedder())(F.col(column)))


def embed_queries(queries: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    return embed(queries, "query", embedder)


def with_point_id(chunks: DataFrame) -> DataFrame:
    """Name-based id of the chunk id, the same for bulk loads and single facts, so that loading
    a document again replaces its points."""
    return chunks.withColumn("point_id", uuid5(F.col("chunk_id")))


def facts_to_chunks(facts: DataFrame, source_uri: str = "cli://instant_injection") -> DataFrame:
    """One chunk per fact ``(doc_id, title, content)``; the title is put in front unless the
    content starts with it. ``token_count`` counts the words of the content as given."""
    title, content = F.col("title"), F.col("content")
    return facts.select(
        F.concat(F.col("doc_id"), F.lit("_chk_0")).alias("chunk_id"),
        "doc_id",
        title.alias("doc_title"),
        F.lit(source_uri).alias("source_uri"),
        F.lit(0).alias("chunk_index"),
        F.when(content.startswith(title), content).otherwise(F.concat(title, F.lit(": "), content)).alias("content"),
        F.size(space_words(content)).alias("token_count"),
    )


def to_points(chunks: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """Chunks with ``embedding`` and ``point_id``, the rows that an index stores."""
    return embedded_points(embedder)(with_point_id(chunks))


def embedded_points(embedder: Embedder | None = None) -> Callable[[DataFrame], DataFrame]:
    """What makes such rows of chunks that have their ``point_id``."""
    columns = ["point_id", "chunk_id", "doc_id", "doc_title", "source_uri", "chunk_index", "content",
               "token_count", "embedding"]
    return lambda chunks: embed(chunks, "content", embedder).select(*columns)


def documents_to_points(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                        embedder: Embedder | None = None) -> DataFrame:
    """The ingest plan: chunk, embed, give ids. Lazy and without a shuffle."""
    return to_points(chunk_documents(docs, size, overlap), embedder)
