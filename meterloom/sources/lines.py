"""Numbered CSV records from text files, without sorting or moving the text.

Both readers return the same two things:

* records(facts, n_bytes): one row per record with source_file, row_no, raw,
  width, open_quote and the columns of `facts`, a table with a row per wanted
  file that takes up to `n_bytes` besides the path. `row_no` is dense in file
  order, the header being -1. Facts tell in `malformed` whether a file has long
  rows or open quotes at all; only then are `width` and `open_quote` worked out;
* groups(source_file, width, open_quote, valid, quoted, first, n, first_raw): records
  per shape, with the first record of each shape and its `row_no`, and whether any of
  them holds a quote. A few rows a file;

and `widest`, the field count of the widest header that holds a quote.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterloom.functions.lines import field_count, has_open_quote, is_blank, outside_quotes
from meterloom.session import pin_split_layout, settle
from meterloom.sources import stitch

# Executors get these helpers with the task and need not have the package.
cloudpickle.register_pickle_by_value(stitch)

# A lookup table above this size is joined by a shuffle instead of being broadcast.
# Lookups are keyed by a hash of the path, so that this is some ten million splits.
MAX_BROADCAST_BYTES = 1 << 30
# Upper estimate of a lookup row without its column positions.
ROW_BYTES = 96
# A record of more bytes than this is not put together; its pieces stay rows with an open quote.
MAX_RECORD_BYTES = 256 << 20

SPLIT = ["source_file", "block_start"]
FILE_KEY = "_file"
SPLIT_KEY = [FILE_KEY, "block_start"]


@dataclass
class NumberedRecords:
    groups: DataFrame
    widest: int
    records: Callable[[DataFrame, int], DataFrame]


def small_side(table: DataFrame, n_bytes: int) -> DataFrame:
    """Broadcast only what is known to be small; without the hint Spark shuffles."""
    return F.broadcast(table) if n_bytes <= MAX_BROADCAST_BYTES else table.hint("merge")


def file_key() -> Column:
    return F.xxhash64("source_file")


def read_text(spark: SparkSession, paths, glob: str, **options) -> DataFrame:
    return (
        spark.read.options(recursiveFileLookup=True, pathGlobFilter=glob, **options)
        .text(paths)
        .select(
            F.col("value").alias("raw"),
            F.col("_metadata.file_path").alias("source_file"),
            F.col("_metadata.file_block_start").alias("block_start"),
        )
    )


def _ends_open(raw: Column) -> Column:
    return has_open_quote(outside_quotes(raw))


def _shape(records: DataFrame, raw: Column) -> DataFrame:
    outside = records.withColumn("outside", outside_quotes(raw))
    return outside.withColumns(
        {
            "width": field_count(F.col("outside")),
            "open_quote": has_open_quote(F.col("outside")),
        }
    ).drop("outside")


def _group(records: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Counts per shape. `collect_set` of a constant-size fact keeps the
    aggregation hash-based; with only `min_by` of a string Spark would sort."""
    return records.groupBy(*keys, "width", "open_quote").agg(
        F.min(order).alias("first"),
        F.count("*").alias("n"),
        F.min_by("raw", order).alias("first_raw"),
        F.array_min(F.collect_set(F.is_valid_utf8("raw"))).alias("valid"),
        F.bool_or(F.col("raw").contains('"')).alias("quoted"),
    )


def with_facts(records: DataFrame, facts: DataFrame, n_bytes: int) -> DataFrame:
    """Records of the files in `facts` (a row per file), with its columns; `records` has FILE_KEY."""
    n_files = facts.count()
    keyed = facts.withColumn(FILE_KEY, file_key()).drop("source_file")
    return records.join(small_side(keyed, n_files * (ROW_BYTES + n_bytes)), FILE_KEY)


def offsets(splits: DataFrame) -> DataFrame:
    """Rows before each split of its file, from the split's own row count `n`."""
    before = (
        Window.partitionBy("source_file")
        .orderBy("block_start")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return splits.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))


def read_lines(spark: SparkSession, paths, glob: str = "*.csv") -> NumberedRecords:
    """One record per line. Files are split and read in parallel.

    The first scan counts lines per split; the second turns Spark's position
    within the split into a position within the file by one small join.
    """
    pin_split_layout(spark)
    raw = F.col("raw")
    lines = (
        read_text(spark, paths, glob)
        .where(~is_blank(raw))
        .withColumn("position", F.monotonically_increasing_id())
    )
    # The counts are small; one exchange by file serves all steps on them.
    split_groups = settle(_group(_shape(lines, raw), SPLIT, "position"), "splits").repartition(
        "source_file"
    )
    splits = offsets(
        split_groups.groupBy(*SPLIT).agg(
            F.min("first").alias("first_position"), F.sum("n").alias("n")
        )
    )
    groups = (
        split_groups.join(splits.drop("n"), SPLIT)
        .withColumn("first", F.col("offset") + F.col("first") - F.col("first_position") - 1)
        .groupBy("source_file", "width", "open_quote")
        .agg(
            F.min_by("first_raw", "first").alias("first_raw"),
            F.min("first").alias("first"),
            F.sum("n").alias("n"),
            F.bool_and("valid").alias("valid"),
            F.bool_or("quoted").alias("quoted"),
        )
    )
    at, quoted_width = F.struct("block_start", "first"), F.when(F.col("first_raw").contains('"'), F.col("width"))
    headers = split_groups.groupBy("source_file").agg(
        F.min_by(F.coalesce(quoted_width, F.lit(1)), at).alias("width"),
        F.count_distinct("block_start").alias("n"),
    )
    widest, n_splits = headers.agg(F.max("width"), F.sum("n")).first()
    places = splits.select(file_key().alias(FILE_KEY), "block_start", "first_position", "offset", "n")
    in_split = F.col("position") - F.col("first_position")
    row_no = F.when(
        (in_split >= 0) & (in_split < F.col("n")), F.col("offset") + in_split - 1
    ).otherwise(F.raise_error(F.lit("files were split differently in the second scan")))

    def records(facts: DataFrame, n_bytes: int) -> DataFrame:
        known = with_facts(lines.withColumn(FILE_KEY, file_key()), facts, n_bytes)
        placed = (
            known.join(small_side(places, (n_splits or 0) * ROW_BYTES), SPLIT_KEY, "left")
            .withColumn("row_no", row_no)  # an unknown split raises
            .drop(*SPLIT_KEY, "position", "first_position", "offset", "n")
        )
        return _shape(placed, F.when(F.col("malformed"), raw))

    return NumberedRecords(groups, widest or 1, records)


# Quoted line breaks ---------------------------------------------------------


def chain_splits(summary: DataFrame) -> DataFrame:
    """What each split needs to know of the splits before it and of its file.

    The state before a split follows from the summaries of the earlier ones, as
    `stitch.states_after` does for lines: the last fixed state, flipped once per
    flipping split since then.
    """
    in_file = Window.partitionBy("source_file").orderBy("block_start")
    running = in_file.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole_file = Window.partitionBy("source_file")
    flip = (F.col("if_closed") & ~F.col("if_open")).cast("long")
    fixes = F.col("if_closed") == F.col("if_open")
    chained = (
        summary.withColumn("odd", F.sum(flip).over(running) % 2 == 1)
        .withColumn("base", F.when(fixes, F.col("if_closed") != F.col("odd")))
        .withColumn("base", F.coalesce(F.last("base", True).over(running), F.lit(False)))
        .withColumn("ends_open", F.col("base") != F.col("odd"))
        .withColumn("starts_open", F.coalesce(F.lag("ends_open").over(in_file), F.lit(False)))
        .withColumn("n", F.when(F.col("starts_open"), F.col("n1")).otherwise(F.col("n0")))
    )
    return (
        offsets(chained)
        .withColumn("n_file", F.sum("n").over(whole_file))
        .withColumn("file_open", F.max_by("ends_open", "block_start").over(whole_file))
        .select(*SPLIT, "starts_open", "ends_open", "offset", "n", "n_file", "file_open")
    )


def read_stitched(spark: SparkSession, paths, glob: str = "*.csv") -> NumberedRecords:
    """Records whose quoted fields may hold line breaks; files are still split.

    Whether a line starts inside a quoted field depends on all lines before it.
    Each split is therefore summarised for both cases, the summaries are chained
    per file, and only then are lines joined into records. Lines never leave
    their task; only pieces of records at the edges of splits, at most two per
    split, are written and brought together. An open quote at the end of a file would glue
    its whole tail into one record; those lines stay single, as `open_quote`.
    """
    pin_split_layout(spark)
    raw = F.col("raw")
    if_open = F.when(raw.contains('"'), _ends_open(F.concat(F.lit('"'), raw)))
    lines = read_text(spark, paths, glob, lineSep="\n").select(
        *SPLIT,
        raw.cast("binary").alias("raw"),
        _ends_open(raw).alias("if_closed"),
        F.coalesce(if_open, F.lit(True)).alias("if_open"),
        is_blank(raw).alias("blank"),
    )
    summary = settle(lines.drop("raw").mapInArrow(stitch.summarise, stitch.SUMMARY), "splits")
    n_splits = summary.count()
    splits = chain_splits(summary).withColumn(FILE_KEY, file_key()).drop("source_file")
    # Should the lookup ever be joined by a shuffle, lines are put back in their order.
    broadcast = n_splits * ROW_BYTES <= MAX_BROADCAST_BYTES
    keyed = lines.withColumn(FILE_KEY, file_key())
    if not broadcast:
        keyed = keyed.withColumn("position", F.monotonically_increasing_id())
    placed = keyed.join(small_side(splits, n_splits * ROW_BYTES), SPLIT_KEY, "left").drop(FILE_KEY)
    if not broadcast:
        placed = placed.sortWithinPartitions(*SPLIT, "position").drop("position")
    pieces = placed.mapInArrow(stitch.join_lines, stitch.PIECES)
    edges = settle(pieces.where("edge"), "edges")
    of_record = ["source_file", "record", "open_tail"]
    sizes = edges.groupBy(*of_record).agg((F.sum(F.length("raw")) > MAX_RECORD_BYTES).alias("long"))
    sized = edges.join(sizes, of_record)
    too_long = sized.where("long").select("source_file", "record", F.lit(True).alias("open_tail"), "raw")
    crossing = (
        sized.where("not long")
        .groupBy(*of_record)
        .agg(F.sort_array(F.collect_list(F.struct("block_start", "raw"))).alias("parts"))
        .withColumn("raw", F.array_join(F.col("parts.raw").cast("array<string>"), "\n"))
    )
    columns = ("source_file", "record", "raw", "open_tail")
    whole = pieces.where("not edge").withColumn("raw", raw.cast("string"))
    long_pieces = too_long.withColumn("raw", raw.cast("string"))
    gathered = crossing.select(*columns).unionByName(long_pieces.select(*columns))
    stitched = whole.select(*columns).unionByName(gathered).select(
        "source_file",
        (F.col("record") - 1).alias("row_no"),
        F.when(raw.endswith("\r"), F.expr("left(raw, length(raw) - 1)")).otherwise(raw).alias("raw"),
        "open_tail",
    )
    shaped = _shape(stitched, raw).withColumn("open_quote", F.col("open_tail")).drop("open_tail")

    def records(facts: DataFrame, n_bytes: int) -> DataFrame:
        placed = with_facts(stitched.withColumn(FILE_KEY, file_key()), facts, n_bytes).drop(FILE_KEY)
        shaped = _shape(placed, F.when(F.col("malformed"), raw))
        return shaped.withColumn("open_quote", F.col("open_tail")).drop("open_tail")

    groups = settle(_group(shaped, ["source_file"], "row_no"), "groups")
    quoted_headers = groups.where((F.col("first") == -1) & F.col("first_raw").contains('"'))
    widest = quoted_headers.agg(F.max("width")).first()[0]
    return NumberedRecords(groups, widest or 1, records)
