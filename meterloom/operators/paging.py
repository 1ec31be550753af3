"""Results page by page. Pages start at 1 and hold ten rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_SIZE = 10


def page(df: DataFrame, number: int, size: int = PAGE_SIZE) -> DataFrame:
    """The rows of one page by row id: a range filter the Parquet scan can use."""
    first = (number - 1) * size
    return df.where((F.col("row_id") >= first) & (F.col("row_id") < first + size))


def page_in_order(df: DataFrame, number: int, *keys, size: int = PAGE_SIZE) -> DataFrame:
    """One page of a result without dense ids: a top-k of the rows up to its end."""
    return df.orderBy(*keys).offset((number - 1) * size).limit(size)


def page_number(row_id: Column, size: int = PAGE_SIZE) -> Column:
    return F.floor(row_id / size) + 1


def page_count(df: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.ceil(F.count("*") / size).alias("n_pages"))


def clamp_page(wanted: Column, n_pages: Column) -> Column:
    """Previous stops at page 1, next at the last page."""
    return F.greatest(F.lit(1), F.least(wanted, n_pages))


def page_summary(df: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    """Rows and prediction range per page."""
    return df.groupBy(page_number(F.col("row_id"), size).alias("page")).agg(
        F.count("*").alias("n_rows"),
        F.min("row_id").alias("first_row_id"),
        F.min("prediction").alias("min_prediction"),
        F.max("prediction").alias("max_prediction"),
    )


def display(df: DataFrame, n: int) -> DataFrame:
    """The first `n` rows in row order, as a table to show."""
    return df.orderBy(F.col("row_id").asc_nulls_last()).limit(n)
