"""Crawl exports and URL trees.

A line break inside a quoted field tears a record over two or more lines of text. Whether a line begins inside quotes
depends on all lines of the file before it, but only through the parity of their quotes, and parities add up: each
split counts its own, a running sum over the splits of a file gives each one its start, and every split then
finds its records by itself. Files of any size are read by as many tasks as they have splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.storage import cut_lineage

# The columns of a crawl export that are read, and the names used here.
EXPORT_COLUMNS = {
    "Type": "type",
    "From": "from_url",
    "To": "to_url",
    "Anchor Text": "anchor_text",
    "Alt Text": "alt_text",
    "Follow": "follow",
    "Status Code": "status_code",
    "Link Position": "link_position",
}
CSV_OPTIONS = {
    "mode": "PERMISSIVE",
    "escape": '"',
    "nullValue": "\u0000",  # cannot occur, so that "" stays an empty text and only ,, is null
    "emptyValue": "",
}
#: A quote that opens or closes a field, once doubled quotes are gone: next to a comma or an end of the line.
_FIELD_QUOTE = '(?:^|(?<=,))"|"(?=,|$)'
#: Splits, a row each of some hundred bytes, up to which their table is broadcast.
BROADCAST_SPLITS = 100_000


def crawl_csv_scan(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The used columns of a crawl CSV, all as strings; short rows give nulls, long rows are cut.

    Line breaks inside quotes are kept (as \\n). Lines end in \\n or \\r\\n, quotes within a quoted field are doubled; a
    quote within an unquoted field is plain text. A file whose last quote is never closed is read as if that
    quote were plain text. If no split of any file has a torn record, Spark's CSV reader takes the files as they are.
    """
    splits = cut_lineage(split_states(text_lines(spark, path)))
    plain = spark.read.options(**CSV_OPTIONS).option("header", True).csv(path)
    if splits.where("odd_lines > 0 or starts_inside").isEmpty():
        return plain.select(*[F.col(f"`{name}`").alias(alias) for name, alias in EXPORT_COLUMNS.items()])
    if splits.count() <= BROADCAST_SPLITS:
        splits = F.broadcast(splits)
    return _parsed(records(text_lines(spark, path), splits), plain.columns)


def text_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, start, line, value, odd): lines with the split they are in, their order within it, whether they flip the state."""
    lines = spark.read.option("lineSep", "\n").text(path)
    value = F.regexp_replace(F.col("value"), "\r$", "")
    rows = lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"),
        value.alias("value"),
    )
    quotes = F.regexp_count(F.replace(F.col("value"), F.lit('""'), F.lit("")), F.lit(_FIELD_QUOTE))
    return rows.withColumn("odd", F.when(F.contains(F.col("value"), F.lit('"')), quotes % 2 == 1).otherwise(F.lit(False)))


def split_states(lines: DataFrame) -> DataFrame:
    """A row per split: odd_lines, starts_inside (quotes), header_line (of a file's first split), odd lines of its file.

    Only counts are shuffled; the running sum of a file goes over its splits.
    """
    counts = lines.groupBy("file", "start").agg(F.count_if("odd").alias("odd_lines"), F.min("line").alias("first_line"))
    whole = Window.partitionBy("file")
    before = whole.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        "file",
        "start",
        "odd_lines",
        F.when(F.col("start") == 0, F.col("first_line")).alias("header_line"),
        F.coalesce(F.sum("odd_lines").over(before), F.lit(0)).alias("odd_before"),
        F.sum("odd_lines").over(whole).alias("total_odd"),
    ).withColumn("starts_inside", (F.col("odd_before") % 2 == 1) & (F.col("odd_before") < F.col("total_odd") - F.col("total_odd") % 2))


def records(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """(file, value): whole records, header lines left out.

    Splits without a torn record pass their lines on. The lines of the others meet their split, where a running
    count of flips tells which lines go together: record number n is closed after an even number of flips. The few records that
    cross a split's end are then joined by their number, which counts flips from the file's start.
    """
    known = lines.join(splits, ["file", "start"])
    body = known.where(F.col("header_line").isNull() | (F.col("line") != F.col("header_line")))
    plain = body.where("odd_lines = 0 and not starts_inside").select("file", "value")
    in_split = Window.partitionBy("file", "start").orderBy("line")
    flips = F.col("odd_before") + F.sum(F.col("odd").cast("long")).over(in_split.rowsBetween(Window.unboundedPreceding, 0))
    # a last, unpaired flip opens nothing
    paired = F.col("total_odd") - F.col("total_odd") % 2
    counted = body.where("odd_lines > 0 or starts_inside").withColumn("flips", flips)
    opens = F.col("odd") & (F.col("flips") % 2 == 1) & (F.col("flips") <= paired)
    closes = F.col("odd") & (F.col("flips") % 2 == 0)
    inside = (F.col("flips") % 2 == 1) & (F.col("flips") < paired) & ~F.col("odd")
    number = F.when(opens, F.col("flips")).when(closes, F.col("flips") - 1).when(inside, F.col("flips"))
    counted = counted.withColumn("number", number)
    alone = counted.where("number is null").select("file", "value")
    pieces = F.array_sort(F.collect_list(F.struct("start", "line", "value")))
    joined = counted.where("number is not null").groupBy("file", "number").agg(pieces.alias("pieces"))
    whole = joined.select("file", F.array_join(F.transform("pieces", lambda p: p["value"]), "\n").alias("value"))
    return plain.unionByName(alone).unionByName(whole)


def _as_strings(count: int) -> str:
    return ", ".join(f"c{number} string" for number in range(count))


def _parsed(rows: DataFrame, header: list[str]) -> DataFrame:
    missing = [name for name in EXPORT_COLUMNS if name not in header]
    if missing:
        raise ValueError(f"the crawl export lacks columns: {missing}")
    row: Column = F.from_csv(F.col("value"), F.lit(_as_strings(len(header))), CSV_OPTIONS | {"multiLine": "true"})
    parsed = rows.where(F.length("value") > 0).select(row.alias("row"))
    return parsed.select(*[F.col(f"row.c{header.index(name)}").alias(alias) for name, alias in EXPORT_COLUMNS.items()])


def write_crawl_csv(links: DataFrame, path: str) -> None:
    """Link rows as a crawl export."""
    export = links.select(*[F.col(alias).alias(name) for name, alias in EXPORT_COLUMNS.items()])
    (
        export.write.option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def tree_json_scan(spark: SparkSession, path: str) -> DataFrame:
    """(tree_id, tree): one parsed JSON document per file."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.input_file_name().alias("tree_id"), F.parse_json("value").alias("tree"))


def tree_json_lines_scan(spark: SparkSession, path: str) -> DataFrame:
    """(tree_id, tree): one parsed JSON document per line, for many partial trees."""
    lines = spark.read.text(path)
    return lines.select(F.sha2("value", 256).alias("tree_id"), F.parse_json("value").alias("tree"))
