"""File sources that yield raw documents, and the media inventory."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.text import non_empty
from ..schemas import RAW_DOCUMENT
from . import splits

TEXT_TYPES = ("txt", "md", "markdown")


def _glob(extensions: tuple[str, ...]) -> str:
    """A path filter for the extensions in any letter case."""
    return "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in e) for e in extensions) + "}"


def _below(path: Column, root: str) -> Column:
    """A file's path below ``root``, which tells files with one name apart; the name alone if the root is the file itself."""
    place = urlsplit(root).path.rstrip("/") + "/"
    at = F.locate(place, path)
    return F.when(at > 0, F.substr(path, at + len(place))).otherwise(F.substring_index(path, "/", -1))


def _read_text(spark: SparkSession, path: str, extensions: tuple[str, ...] | None, pattern: str | None,
               whole: bool) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", "true")
    if extensions:
        reader = reader.option("pathGlobFilter", _glob(extensions))
    lines = reader.text(path, wholetext=whole).select(
        "value", F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block")).withColumn("below", _below(F.col("path"), path))
    return matching(lines, pattern)


def matching(files: DataFrame, pattern: str | None) -> DataFrame:
    """The rows whose file name matches a pattern."""
    if pattern and pattern not in ("*", "*.*"):
        files = files.filter(F.col("name").rlike(fnmatch.translate(pattern)))
    return files


def _decodable(value: Column) -> Column:
    """The text without bytes that are not UTF-8."""
    return F.when(F.is_valid_utf8(value), value).otherwise(F.replace(F.make_valid_utf8(value), F.lit("�"), F.lit("")))


def text_documents(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """One document per text or markdown file."""
    return _read_text(spark, path, TEXT_TYPES, pattern, True).select(
        F.concat(F.lit("DOC_"), "below").alias("doc_id"),
        F.col("name").alias("doc_title"),
        F.concat(F.lit("file://"), "below").alias("source_uri"),
        _decodable(F.col("value")).alias("raw_text"))


def json_documents(spark: SparkSession, path: str, pattern: str | None = None,
                   extensions: tuple[str, ...] = ("json",), in_splits: bool = False) -> DataFrame:
    """A JSON array gives one document per element, an object gives one document.

    The text is ``content``, else ``text`` (array elements only), else the JSON itself in compact
    form. Files that are neither give no rows. With ``in_splits`` an array is read by as many tasks as its file has
    splits; without, by one. A file of one object is one task either way.
    """
    files = _read_text(spark, path, extensions, pattern, True)
    items = F.from_json("value", "array<string>")

    def field(json: Column, name: str) -> Column:
        return non_empty(F.get_json_object(json, f"$.{name}"))

    if in_splits:
        found = splits.json_array_items(spark, path, pattern, extensions)
    else:
        found = files.filter(F.ltrim(F.col("value")).startswith("[")).select("name", "below", F.posexplode(items).alias("i", "item"))
    elements = found.select(
        F.concat("below", F.lit("_"), F.col("i")).alias("doc_id"),
        F.coalesce(field(F.col("item"), "title"), F.concat("name", F.lit(" #"), F.col("i") + 1)).alias("doc_title"),
        F.concat(F.lit("json://"), "below", F.lit("#"), F.col("i")).alias("source_uri"),
        F.coalesce(field(F.col("item"), "content"), field(F.col("item"), "text"), F.col("item")).alias("raw_text"))
    objects = files.filter(F.ltrim(F.col("value")).startswith("{")
                           & F.try_parse_json(F.col("value")).isNotNull()).select(
        F.concat(F.lit("DOC_"), "below").alias("doc_id"),
        F.coalesce(F.get_json_object("value", "$.title"), F.col("name")).alias("doc_title"),
        F.concat(F.lit("json://"), "below").alias("source_uri"),
        F.coalesce(F.get_json_object("value", "$.content"), F.get_json_object("value", "$")).alias("raw_text"))
    return elements.unionByName(objects)


def csv_documents(spark: SparkSession, path: str, pattern: str | None = None, multi_line: bool = False,
                  extensions: tuple[str, ...] = ("csv",), in_splits: bool = False) -> DataFrame:
    """One document per CSV row: ``column: value | column: value`` over the non-empty cells.

    Every file may have its own header; where it names a column twice both cells are in the text, and the last counts
    as title. Files are read in splits; a row's number within its file is its place in its split plus the rows of the
    splits before. A quoted cell may hold line breaks only with ``multi_line``, which reads each file as a whole in
    one task, or with ``in_splits``, which puts the records of a file together over its splits; without both such a cell is an
    error.
    """
    if in_splits:
        lines = splits.csv_records(spark, path, pattern, extensions)
    elif multi_line:
        files = _read_text(spark, path, extensions, pattern, True)
        records = F.regexp_extract_all("value", F.lit(_RECORD), 1)
        lines = files.select("name", "path", "below", "block", F.posexplode(records).alias("line", "value"))
    else:
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        broken = F.concat(F.lit("a quoted cell goes over lines in "), "below", F.lit("; read it with multi_line"))
        lines = (_read_text(spark, path, extensions, pattern, False)
                 .withColumn("value", F.when(quotes % 2 == 1, F.raise_error(broken)).otherwise(F.col("value")))
                 .withColumn("line", F.monotonically_increasing_id()))
    lines = lines.filter(F.trim("value") != "")
    in_split = W.partitionBy("path", "block").orderBy("line")
    numbered = lines.withColumn("in_split", F.row_number().over(in_split))
    # One row per split, and one header per file.
    blocks = numbered.groupBy("path", "block").agg(F.max("in_split").alias("rows")).withColumn(
        "before", F.coalesce(F.sum("rows").over(
            W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    headers = numbered.groupBy("path").agg(
        F.min_by(_csv_cells(F.col("value")), F.struct("block", "in_split")).alias("header"))
    # Joined by split, so that a file with much of the data is not one join key.
    rows = (numbered.join(blocks.join(headers, "path").select("path", "block", "before", "header"), ["path", "block"])
            .withColumn("i", F.col("before") + F.col("in_split") - 2).filter(F.col("i") >= 0))
    filled = F.slice(F.concat(_csv_cells(F.col("value")), F.transform("header", lambda _: F.lit(""))), F.lit(1), F.size("header"))
    rows = rows.withColumn("cells", F.arrays_zip(F.col("header").alias("key"), filled.alias("value")))
    text = F.array_join(F.transform(
        F.filter("cells", lambda e: e["value"] != ""),
        lambda e: F.concat(e["key"], F.lit(": "), e["value"])), " | ")

    def named(column: str) -> Column:
        return non_empty(F.try_element_at(F.filter("cells", lambda e: e["key"] == column), F.lit(-1))["value"])

    return rows.select(
        F.concat(F.lit("CSV_"), "below", F.lit("_"), F.col("i")).alias("doc_id"),
        F.coalesce(named("title"), named("name"), named("product"),
                   F.concat("name", F.lit(" Row "), F.col("i") + 1)).alias("doc_title"),
        F.concat(F.lit("csv://"), "below", F.lit("#"), F.col("i")).alias("source_uri"),
        text.alias("raw_text"))


# A record up to its line break; quoted cells may hold any.
_RECORD = r'((?:[^"\r\n]++|"[^"]*+")++)(?:\r?\n|$)'


def _csv_cells(line: Column) -> Column:
    """The cells of one CSV line; a quoted cell loses its quotes, a doubled quote becomes one."""
    found = F.regexp_extract_all(F.concat(F.lit(","), F.regexp_replace(line, "\r$", "")),
                                 F.lit(r',("(?:[^"]|"")*"|[^,]*)'), 1)
    return F.transform(found, lambda c: F.when(
        c.startswith('"'), F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c))


def folder_documents(spark: SparkSession, folder: str, pattern: str = "*", multi_line: bool = False) -> DataFrame:
    """All text, JSON and CSV files under a folder whose names match ``pattern``."""
    return (text_documents(spark, folder, pattern)
            .unionByName(json_documents(spark, folder, pattern))
            .unionByName(csv_documents(spark, folder, pattern, multi_line)))


def inline_documents(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Raw documents from rows in the program."""
    names = RAW_DOCUMENT.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], RAW_DOCUMENT)


def media_files(spark: SparkSession, path: str, head_bytes: int = 12) -> DataFrame:
    """path, length and content of all files below ``path``; ``content`` holds the first bytes only.

    The listing reads no file. Every task then opens its own files and reads their heads, so a file's size does not
    matter. Works where the Arrow file systems do (local disks, HDFS, object stores).
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        for batch in batches:
            out = []
            for uri in batch.column("path").to_pylist():
                scheme, _, rest = uri.partition(":")
                system, place = fs.FileSystem.from_uri(f"file:///{unquote(rest).lstrip('/')}" if scheme == "file" else uri)
                if scheme == "file":
                    place = "/" + unquote(rest).lstrip("/")
                with system.open_input_stream(place, buffer_size=0) as stream:
                    out.append(stream.read(head_bytes))
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("length"), pa.array(out, pa.binary())],
                                             ["path", "length", "content"])

    return listed.mapInArrow(heads, "path string, length long, content binary")


# File signatures of the container formats, as hex at byte positions.
_DEFAULT_MIME = "audio/mp4"


def mime_type(content: Column, declared: Column | None = None) -> Column:
    """Container type. A declared content type wins over the file's first bytes."""
    head = F.hex(F.substring(content, 1, 12))

    def at(position: int, signature: str) -> Column:
        return F.substring(head, 2 * position + 1, len(signature)) == signature

    sniffed = (
        F.when(F.coalesce(F.length(content), F.lit(0)) < 12, _DEFAULT_MIME)
        .when(at(0, "4F676753"), "audio/ogg")
        .when(at(0, "52494646") & at(8, "57415645"), "audio/wav")
        .when(at(0, "494433") | head.rlike("^FF[EF]"), "audio/mp3")
        .when(at(4, "66747970"), "audio/mp4")
        .when(at(0, "1A45DFA3"), "audio/webm")
        .when(at(0, "664C6143"), "audio/flac")
        .otherwise(_DEFAULT_MIME))
    if declared is None:
        return sniffed
    return (F.when(declared.contains("ogg"), "audio/ogg")
            .when(declared.contains("aac"), "audio/aac")
            .when(declared.contains("wav"), "audio/wav")
            .when(declared.contains("mp3") | declared.contains("mpeg"), "audio/mp3")
            .when(declared.contains("mp4") | declared.contains("m4a"), "audio/mp4")
            .otherwise(sniffed))


def media_inventory(files: DataFrame) -> DataFrame:
    """Files and bytes per container type; ``files`` has content, length and maybe content_type."""
    declared = F.col("content_type") if "content_type" in files.columns else None
    return files.groupBy(mime_type(F.col("content"), declared).alias("mime")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
