"""Which files of a folder are taken as uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CSV_SUFFIX = ".csv"
CSV_MEDIA_TYPE = "text/csv"


def list_files(spark: SparkSession, paths, glob: str = "*") -> DataFrame:
    """One row per file: path, length. File contents are never opened.

    Spark's scans pass over files without a byte, so those are added from the
    list of names the reader has on the driver anyway.
    """
    reader = (
        spark.read.format("binaryFile")
        .options(recursiveFileLookup=True, pathGlobFilter=glob)
        .load(paths)
    )
    names = spark.createDataFrame([(n,) for n in reader.inputFiles()], "name string").select(
        F.regexp_replace("name", "^([a-z0-9]+):///", "$1:/").alias("source_file")
    )
    lengths = reader.select(F.col("_metadata.file_path").alias("source_file"), "length")
    return names.join(lengths, "source_file", "left").withColumn(
        "length", F.coalesce("length", F.lit(0))
    )


def is_admitted(path: Column, media_type: Column | None = None) -> Column:
    """By name suffix (case matters) or by declared media type."""
    by_name = path.endswith(CSV_SUFFIX)
    if media_type is None:
        return by_name
    return by_name | (F.coalesce(media_type, F.lit("")) == CSV_MEDIA_TYPE)


def admit(files: DataFrame, media_types: DataFrame | None = None) -> DataFrame:
    """Add `admitted` to a file listing.

    `media_types(source_file, media_type)` is an optional manifest of declared
    types; it has a row per file at most, so the join is left to the optimizer.
    """
    if media_types is None:
        return files.withColumn("admitted", is_admitted(F.col("source_file")))
    joined = files.join(media_types, "source_file", "left")
    return joined.withColumn("admitted", is_admitted(F.col("source_file"), F.col("media_type")))
