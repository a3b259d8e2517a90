"""JSON arrays and quoted CSV files read in splits, however large a file is.

Whether a byte lies inside quotes depends on everything before it, which is why such files are read as a whole elsewhere. Here the
text source cuts a file at every comma (JSON) or line break (CSV), in as many tasks as it has splits, and two passes
over these pieces put the records together:

1. Each piece tells how many quotes it has and how its brackets would change the depth if it began outside or inside quotes. A
   running sum within each split gives one summary row for both cases, and a prefix over the summaries, one row per split, says in
   which state each split begins.
2. With that, every piece knows its state and whether a record ends with it. Counting the ends, first in the splits and then over
   them, numbers the records, and pieces of one number are joined.

No task holds more than one split's pieces or one record, and the driver holds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..session import work_dir

_FILE = ["path", "name", "below"]


def _pieces(spark: SparkSession, path: str, extensions: tuple[str, ...], pattern: str | None, separator: str) -> DataFrame:
    from .files import _below, _glob, matching
    rows = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", _glob(extensions)).option("lineSep", separator)
            .text(path).select("value", F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_path").alias("path"),
                               F.col("_metadata.file_block_start").alias("block"))
            .withColumn("below", _below(F.col("path"), path)).withColumn("line", F.monotonically_increasing_id()))
    return matching(rows, pattern)


def _stored(df: DataFrame, label: str) -> DataFrame:
    place = work_dir(df.sparkSession, label)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def _count(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.translate(text, signs, ""))


def _before(column: str) -> Column:
    """The sum of a column over the splits of a file before this one."""
    return F.coalesce(F.sum(column).over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def _records(pieces: DataFrame, quotes: Column, outside: Column, inside: Column, base: int, separator: str) -> DataFrame:
    """``path, name, below, record, value, block, line, depth``: pieces joined to records in the order of the file.

    ``quotes`` counts a piece's quotes; ``outside`` and ``inside`` are its changes of depth if it begins outside or inside quotes. A
    record ends where a piece ends outside quotes at a depth of ``base`` or less; ``depth`` and ``open`` are the state there. Block and line
    are those of a record's first piece.
    """
    split = W.partitionBy("path", "block").orderBy("line")
    done, so_far = split.rowsBetween(W.unboundedPreceding, -1), split.rowsBetween(W.unboundedPreceding, W.currentRow)
    begun = F.coalesce(F.sum("_q").over(done), F.lit(0)) % 2
    rows = pieces.withColumn("_q", quotes % 2).withColumn("_begun", begun).withColumns({
        "_if_out": F.when(F.col("_begun") == 0, outside).otherwise(inside),
        "_if_in": F.when(F.col("_begun") == 0, inside).otherwise(outside)})
    rows = _stored(rows, "pieces")
    # One row per split.
    sums = rows.groupBy("path", "block").agg((F.sum("_q") % 2).alias("_q"), F.sum("_if_out").alias("_out"), F.sum("_if_in").alias("_in"))
    sums = sums.withColumn("_inside", _before("_q") % 2).withColumn("_change", F.when(F.col("_inside") == 0, F.col("_out")).otherwise(F.col("_in")))
    starts = sums.select("path", "block", "_inside", _before("_change").alias("_deep"))
    change = F.when(F.col("_inside") == 0, F.col("_if_out")).otherwise(F.col("_if_in"))
    rows = rows.join(starts, ["path", "block"]).select(
        *_FILE, "block", "line", "value", ((F.col("_inside") + F.col("_begun") + F.col("_q")) % 2 == 1).alias("open"),
        (F.col("_deep") + F.sum(change).over(so_far)).alias("depth"))
    rows = _stored(rows.withColumn("_end", (~F.col("open") & (F.col("depth") <= base)).cast("long")), "states")
    ends = rows.groupBy("path", "block").agg(F.sum("_end").alias("_ends")).select("path", "block", _before("_ends").alias("_first"))
    numbered = rows.join(ends, ["path", "block"]).withColumn("record", F.col("_first") + F.coalesce(F.sum("_end").over(done), F.lit(0)))
    joined = F.sort_array(F.collect_list(F.struct("block", "line", "value", "open", "depth")))
    found = numbered.groupBy(*_FILE, "record").agg(joined.alias("_p"))
    last = F.element_at("_p", -1)
    return found.select(*_FILE, "record", F.array_join("_p.value", separator).alias("value"), F.col("_p")[0]["block"].alias("block"),
                        F.col("_p")[0]["line"].alias("line"), last["depth"].alias("depth"), last["open"].alias("open"))


def json_array_items(spark: SparkSession, path: str, pattern: str | None = None, extensions: tuple[str, ...] = ("json",)) -> DataFrame:
    """``path, name, below, i, item``: the elements of all files that hold one JSON array, as ``from_json`` gives them as strings.

    Files that hold anything else, or an array that is not well-formed or not closed, give no rows, and an empty array has none.
    """
    pieces = _pieces(spark, path, extensions, pattern, ",")
    plain = F.regexp_replace("value", r"(?s)\\.", "")  # without escaped signs, every quote left opens or closes
    outside = F.regexp_replace(plain, r'"[^"]*("|$)', "")
    inside = F.regexp_replace(F.regexp_replace(plain, r'^[^"]*("|$)', ""), r'"[^"]*("|$)', "")

    def depth(text: Column) -> Column:
        return _count(text, "[{") - _count(text, "]}")

    records = _stored(_records(pieces, _count(plain, '"'), depth(outside), depth(inside), 1, ","), "records")
    # Only the record that closes the array may end at depth 0, and nothing may follow it.
    text = F.when(F.col("record") == 0, F.regexp_replace("value", r"^\s*\[", "")).otherwise(F.col("value"))
    text = F.when(F.col("depth") == 0, F.regexp_replace(text, r"\]\s*$", "")).otherwise(text)
    items = records.withColumn("_text", text).withColumn("_item", F.from_json(F.concat(F.lit("["), "_text", F.lit("]")), "array<string>"))
    empty = (F.col("record") == 0) & (F.col("depth") == 0) & (F.trim(F.regexp_replace("_text", r"\s", " ")) == "")
    good = ~F.col("open") & F.coalesce(F.size("_item") == 1, F.lit(False)) | empty
    starts = (F.col("record") > 0) | F.col("value").rlike(r"^\s*\[")
    files = items.groupBy("path").agg(
        F.bool_and(good & starts).alias("_good"), F.max("record").alias("_last"), F.max(F.when(F.col("depth") == 0, F.col("record"))).alias("_closed"),
        F.min("depth").alias("_least"), F.count_if(F.col("depth") == 0).alias("_closings"))
    whole = files.filter("_good AND _last = _closed AND _least = 0 AND _closings = 1").select("path")
    return items.filter(~empty).join(whole, "path", "left_semi").select(*_FILE, F.col("record").alias("i"), F.col("_item")[0].alias("item"))


def csv_records(spark: SparkSession, path: str, pattern: str | None = None, extensions: tuple[str, ...] = ("csv",)) -> DataFrame:
    """``path, name, below, block, line, value``: the records of CSV files, whose quoted cells may hold line breaks."""
    pieces = _pieces(spark, path, extensions, pattern, "\n")
    none = F.lit(0)
    return _records(pieces, _count(F.col("value"), '"'), none, none, 0, "\n").drop("record", "depth", "open")
