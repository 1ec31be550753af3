"""Facts about one raw CSV line or record, as column expressions.

A double quote opens a quoted field only as the field's first character; inside
a quoted field `""` is one quote. Elsewhere a quote is an ordinary character.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CSV_OPTIONS = {"sep": ",", "quote": '"', "escape": '"', "mode": "PERMISSIVE"}


def is_blank(raw: Column) -> Column:
    return F.trim(raw, F.lit(" \t\r")) == ""


def outside_quotes(raw: Column) -> Column:
    """`raw` without its closed quoted parts; lines without quotes pass untouched."""
    no_doubles = F.replace(raw, F.lit('""'), F.lit(""))
    return F.when(
        raw.contains('"'), F.regexp_replace(no_doubles, '(^|,)"[^"]*"', "$1")
    ).otherwise(raw)


def has_open_quote(outside: Column) -> Column:
    """Whether a quoted field is still open at the end (takes `outside_quotes`)."""
    return outside.contains('"') & outside.rlike('(^|,)"')


def field_count(outside: Column) -> Column:
    """Number of fields (takes `outside_quotes`)."""
    commas = F.octet_length(outside) - F.octet_length(F.replace(outside, F.lit(","), F.lit("")))
    return (commas + 1).cast("int")


def parse_fields(raw: Column, width: int) -> Column:
    """The first `width` fields as a struct c0, c1, ... of strings."""
    return F.from_csv(raw, ", ".join(f"c{i} string" for i in range(width)), CSV_OPTIONS)


def split_fields(raw: Column, width: int) -> Column:
    """The first `width` fields as an array of strings, null where absent."""
    parsed = parse_fields(raw, width)
    return F.array(*[parsed.getField(f"c{i}") for i in range(width)])


def nth_field(raw: Column, at: Column) -> Column:
    """One field of a line without quotes and with more than `at` fields, without cutting the others."""
    up_to = F.call_function("substring_index", raw, F.lit(","), (at + 1).cast("int"))
    return F.substring_index(up_to, ",", -1)


def width_tiers(widest: int) -> list[int]:
    """Widths at which lines are parsed: powers of four up to the widest."""
    tiers = [8]
    while tiers[-1] < widest:
        tiers.append(4 * tiers[-1])
    return tiers


def with_fields(df: DataFrame, own: Column, tiers: list[int], skip: Column | None = None) -> DataFrame:
    """Add `fields`: at least the first `own` fields as strings, null or absent where there are fewer; null for `skip`.

    Lines without a quote need no CSV parser. The others are parsed at the
    smallest of `tiers` that holds `own` fields, so that one wide file does not
    make the lines of all others wide. Each parse is a column of its own, so that
    it runs once per line.
    """
    raw = F.col("raw")
    quoted = raw.contains('"')
    fields, below = None, 0
    for i, width in enumerate(tiers):
        fits = (own > below) & (own <= width) if below else own <= width
        df = df.withColumn(f"_parsed_{i}", parse_fields(F.when(quoted & fits, raw), width))
        as_array = F.array(*[F.col(f"_parsed_{i}.c{j}") for j in range(width)])
        here = F.col(f"_parsed_{i}").isNotNull()
        fields = F.when(here, as_array) if fields is None else fields.when(here, as_array)
        below = width
    cut = F.split(raw, ",", -1) if skip is None else F.when(~skip, F.split(raw, ",", -1))
    return df.withColumn("fields", fields.otherwise(cut)).drop(
        *[f"_parsed_{i}" for i in range(len(tiers))]
    )


def unique_names(fields: Column) -> Column:
    """Header names made unique; a small helper in Python, for one header per file.

    An empty name becomes `Unnamed: <position>`. The k-th repeat of a name gets
    the k-th suffix `.1`, `.2`, ... that no other header name already uses.
    """

    @F.pandas_udf("array<string>")
    def rename(headers: pd.Series) -> pd.Series:
        def unique(header):
            if header is None:
                return None
            named = [x if x else f"Unnamed: {i}" for i, x in enumerate(header)]
            taken, suffix, seen, out = set(named), {}, set(), []
            for name in named:
                if name not in seen:
                    seen.add(name)
                    out.append(name)
                    continue
                n = suffix.get(name, 0) + 1
                while f"{name}.{n}" in taken:
                    n += 1
                suffix[name] = n
                out.append(f"{name}.{n}")
            return out

        return headers.map(unique)

    return rename(fields)
