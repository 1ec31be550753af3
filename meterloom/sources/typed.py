"""Uploads whose columns have the types of each file, as if each were read by itself.

A meter id may be a number in one upload and a text in the next. Read as one table
with one type per column, it would be text everywhere; here each value keeps the
type its own file gives it, as a VARIANT.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterloom.operators.schema import as_variant, infer_types
from meterloom.session import settle
from meterloom.sources.lines import small_side
from meterloom.sources.uploads import Uploads, header_columns, key_columns, read_uploads

#: Upper estimates of a file's row in the lookup of types, and of one type in it.
ROW_BYTES, KIND_BYTES = 1_000, 24


@dataclass
class TypedUploads:
    """`rows`: the valid rows: source_file, row_id (and row_key), each column as VARIANT, place.
    `types`: one row per accepted file with rows: source_file, types (column name to
    long, double, boolean or string; columns its header lacks are not in it).
    `uploads`: the same files as text, with their status and quarantine.
    """

    rows: DataFrame
    types: DataFrame
    uploads: Uploads


def read_uploads_typed(spark: SparkSession, paths, columns: list[str] | None = None, **options) -> TypedUploads:
    """Read CSV files, each with the types its own text has.

    columns: those to read; every name in any header if not given. Other options as
    for `read_uploads`; no column is required unless `required` names it.

    Types follow the rules of `infer_types`, over the file's valid rows. A value
    that its file lacks, by a null token or for want of the column, is null. Two
    passes over the text: one aggregate by file and column, then the values.
    """
    if columns is None:
        columns = header_columns(spark, paths, options.get("glob", "*.csv"), options.get("multiline", False))
    options.setdefault("required", [])
    text = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    uploads = read_uploads(spark, paths, text, **options)
    if not columns:
        none = spark.createDataFrame([], "source_file string, types map<string,string>")
        return TypedUploads(uploads.rows, none, uploads)
    found = infer_types(uploads.rows, columns, by=["source_file"])
    present = found.join(uploads.files.select("source_file", "names"), "source_file").where(
        F.array_contains("names", F.col("column"))
    )
    types = present.groupBy("source_file").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("column", "type")))).alias("types")
    )
    types = settle(types, "types")

    # the map as a list in the order of the columns, so that a value needs its place only
    kinds = F.transform(F.array(*map(F.lit, columns)), lambda c: F.try_element_at("types", c))
    lookup = types.select("source_file", kinds.alias("_kinds"))
    lookup = small_side(lookup, types.count() * (ROW_BYTES + KIND_BYTES * len(columns)))
    texts = F.array(*[F.col(f"`{c}`") for c in columns])
    values = F.zip_with(texts, F.col("_kinds"), as_variant)
    rows = uploads.rows.join(lookup, "source_file").withColumn("_values", values)
    rows = rows.select(
        "source_file",
        *key_columns(uploads.judged),
        *[F.get("_values", F.lit(i)).alias(c) for i, c in enumerate(columns)],
        "place",
    )
    return TypedUploads(rows, types, uploads)
