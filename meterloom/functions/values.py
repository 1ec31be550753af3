"""Turning CSV text into typed values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The texts that stand for "no value" (case matters).
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# The texts read as booleans and as infinities.
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]
INFINITE_TOKENS = ["inf", "+inf", "-inf", "infinity", "+infinity", "-infinity"]


def drop_null_tokens(text: Column) -> Column:
    return F.when(~text.isin(NULL_TOKENS), text)


def to_boolean(text: Column) -> Column:
    return F.when(text.isin(TRUE_TOKENS), F.lit(True)).when(text.isin(FALSE_TOKENS), F.lit(False))


def _lookup(entries: dict[str, float], key: Column) -> Column:
    pairs = [F.lit(x) for entry in entries.items() for x in entry]
    return F.try_element_at(F.create_map(*pairs), key)


def is_whole(text: Column) -> Column:
    return text.rlike(r"^\s*[+-]?\d+\s*$")


def to_number(text: Column) -> Column:
    """Double, or null if the text is no decimal number or infinity.

    Spark's cast also takes Java literals (`1d`, `2f`, `0x1p3`) and any casing
    of NaN; those are plain text in a CSV file. Casting only what looks like a
    number also avoids an exception per text, which a failing cast costs.
    """
    decimal = text.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")
    infinite = _lookup({t: float(t) for t in INFINITE_TOKENS}, F.lower(F.trim(text)))
    return F.when(decimal, text.try_cast("double")).otherwise(infinite)


def to_feature(text: Column) -> Column:
    """Number as `to_number`; booleans count as 0 and 1."""
    truth = _lookup(
        {t: 1.0 for t in TRUE_TOKENS} | {t: 0.0 for t in FALSE_TOKENS}, text
    )
    return F.coalesce(to_number(text), truth)


def parse_as(text: Column, data_type: T.DataType) -> Column:
    """`text` (null tokens already removed) as `data_type`, null where it does not fit."""
    if isinstance(data_type, T.StringType):
        return text
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return to_feature(text).cast(data_type)
    if isinstance(data_type, T.BooleanType):
        return to_boolean(text)
    if isinstance(data_type, T.IntegralType):
        return F.when(is_whole(text), text.try_cast(data_type))
    return text.try_cast(data_type)
