"""Column types inferred from text, by one aggregation over the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterloom.functions.values import drop_null_tokens, parse_as, to_boolean, to_number


SPARK_TYPES = {
    "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType(),
}
_KINDS = ("long", "double", "boolean", "string")


def _kind(text: Column) -> Column:
    """Place in `_KINDS` of the narrowest type of one text; null for a null token."""
    value = drop_null_tokens(text)
    return (
        F.when(value.isNull(), F.lit(None).cast("int"))
        .when(parse_as(value, T.LongType()).isNotNull(), F.lit(0))
        .when(to_number(value).isNotNull(), F.lit(1))
        .when(to_boolean(value).isNotNull(), F.lit(2))
        .otherwise(F.lit(3))
    )


def infer_types(df: DataFrame, columns: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """(ord, column, type, n_values) for the string columns of `df`, for each value of the columns `by`.

    long, else double (also for whole numbers with gaps, and for columns without
    any value), else boolean, else string. Dates stay strings. One aggregation
    with a few counts per column; its single row (one for each group) is unpivoted.
    """
    by = by or []
    columns = columns or [c for c in df.columns if c not in by]
    kinds = df.select(*by, *[_kind(F.col(f"`{c}`")).alias(f"k{i}") for i, c in enumerate(columns)])
    counted = kinds.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        *[
            F.struct(*[F.count_if(F.col(f"k{i}") == k).alias(f"n{k}") for k in range(4)]).alias(f"s{i}")
            for i in range(len(columns))
        ],
    )
    tall = counted.select(
        *by,
        "n_rows",
        F.inline(
            F.array(*[
                F.struct(F.lit(i + 1).alias("ord"), F.lit(c).alias("column"), F.col(f"s{i}").alias("s"))
                for i, c in enumerate(columns)
            ])
        ),
    ).where("n_rows > 0")
    n_values = F.col("s.n0") + F.col("s.n1") + F.col("s.n2") + F.col("s.n3")
    found = (
        F.when(F.col("s.n0") == F.col("n_rows"), "long")
        .when(F.col("s.n0") + F.col("s.n1") == n_values, "double")
        .when(F.col("s.n2") == n_values, "boolean")
        .otherwise("string")
    )
    return tall.select(*by, "ord", "column", found.alias("type"), n_values.alias("n_values"))


def as_variant(text: Column, kind: Column) -> Column:
    """`text` (null tokens already removed) as a VARIANT of the type that `kind` names; null where it has no value."""
    value = F.lit(None).cast("variant")
    for name, typed in (
        ("long", parse_as(text, T.LongType())), ("double", to_number(text)), ("boolean", to_boolean(text)), ("string", text),
    ):
        value = F.when((kind == name) & typed.isNotNull(), typed.cast("variant")).otherwise(value)
    return value
