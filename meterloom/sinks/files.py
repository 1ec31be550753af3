"""Result files: sorted by row id, each run in a folder of its own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterloom.operators.scoring import CSV_NAMES, in_row_order
from meterloom.session import settle

# Text is written so that reading it back gives the same text.
CSV_WRITE_OPTIONS = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
ROWS_PER_FILE = 5_000_000
#: Most bytes of a CSV part that is to be joined with others.
FILE_BYTES = 256 << 20
RUNS_PER_STRETCH = 100_000


def run_path(base: str, name: str = "result") -> str:
    """A path no other run writes to."""
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread_by_place(
    df: DataFrame,
    n_rows: int,
    *order: str,
    place: str = "place",
    rows_per_file: int | None = None,
) -> DataFrame:
    """Total order by dense places below `n_rows`, with one shuffle.

    The places themselves say which output file a row belongs to, so Spark need
    not sample the input (which would compute it twice) as it does for `orderBy`.
    Within a file rows are sorted by `order`, or by place.
    """
    files = max(1, -(-n_rows // (rows_per_file or ROWS_PER_FILE)))
    per_file = max(1, -(-n_rows // files))
    last = F.lit(files - 1)
    beyond = F.raise_error(F.concat(F.lit(f"{n_rows} rows expected, found place "), F.col(place).cast("string")))
    df = df.withColumn(place, F.when(F.col(place) >= F.lit(max(n_rows, 0)), beyond).otherwise(F.col(place)))
    file = F.least(F.coalesce(F.expr(f"{place} div {per_file}"), last), last).cast("int")
    sort = [F.col(c).asc_nulls_last() for c in order or (place,)]
    return df.repartitionById(files, file).sortWithinPartitions(*sort)


def key_parts(df: DataFrame, key: str) -> list[str]:
    """The columns of a typed index: itself, or the fields of a struct."""
    kind = df.schema[key].dataType
    return [f"{key}.`{f.name}`" for f in kind.fields] if isinstance(kind, T.StructType) else [key]


def in_key_order(
    df: DataFrame, n_rows: int, key: str, unit: str, *, first: tuple[str, ...] = (), rows_per_file: int | None = None
) -> DataFrame:
    """Ordered by unit and typed index (null last, then by place); within a file by `first` before that.

    The order is sampled, so `df` should be a written table.
    """
    files = max(1, -(-n_rows // (rows_per_file or ROWS_PER_FILE)))
    order = [F.col(c).asc_nulls_last() for c in (unit, *key_parts(df, key), "place")]
    ranged = df.repartitionByRange(files, *order)
    return ranged.sortWithinPartitions(*[F.col(c) for c in first], *order)


def plain_number(value, decimals: int):
    """A double as text without an exponent; what a decimal cannot hold is printed as a double."""
    fits = F.abs(value) < F.lit(10.0 ** (37 - decimals))
    infinite = F.when(value > 0, F.lit("inf")).otherwise(F.lit("-inf"))
    return (
        F.when(fits, F.when(fits, value).cast(f"decimal(38,{decimals})").cast("string"))
        .when(F.abs(value) == F.lit(float("inf")), infinite)
        .when(value.isNotNull() & ~F.isnan(value), value.cast("string"))
    )


def write_csv(df: DataFrame, path: str, decimals: int | None = None) -> str:
    """Plain CSV write. `decimals` prints predictions without an exponent.

    Infinite predictions are written as `inf` and `-inf`; null and NaN as nothing.
    """
    value = F.col("prediction")
    if "prediction" in df.columns:
        infinite = F.when(value > 0, F.lit("inf")).otherwise(F.lit("-inf"))
        as_double = F.when(F.abs(value) == F.lit(float("inf")), infinite).when(
            ~F.isnan(value), value.cast("string")
        )
        text = as_double if decimals is None else plain_number(value, decimals)
        df = df.withColumn("prediction", text)
    df.withColumnsRenamed(CSV_NAMES).write.options(**CSV_WRITE_OPTIONS).csv(path)
    return path


def write_csv_parts(
    df: DataFrame, path: str, *, order: str = "place", columns: list[str] | None = None, max_bytes: int = FILE_BYTES
) -> str:
    """CSV parts that, joined in the order of their names, are one file: a header once, then all rows by `order`.

    `order` holds distinct whole numbers from 0, with or without gaps; `df` should be
    a written table, as it is read three times: for the bytes of its lines, for the
    bytes of runs of neighbouring rows, and to write. Runs are small shares of
    `max_bytes`, and a part takes whole runs; no part is larger than `max_bytes`
    unless a single line is.
    """
    columns = columns or [c for c in df.columns if c != order]
    quoting = {k: v for k, v in CSV_WRITE_OPTIONS.items() if k != "header"}
    named = df.select(F.col(order).alias("_at"), *[_csv_value(df, c) for c in columns]).withColumnsRenamed(CSV_NAMES)
    values = F.struct(*[F.col(f"`{c}`") for c in named.columns[1:]])
    lines = named.select("_at", F.to_csv(values, {k: str(v).lower() if isinstance(v, bool) else v for k, v in quoting.items()}).alias("value"))
    size = F.octet_length("value").cast("long") + 1  # with the line's end
    header = ",".join(_csv_name(c) for c in named.columns[1:])
    total, widest, last = lines.agg(F.sum(size), F.max(size), F.max("_at")).first()
    widest = max(widest or 0, len(header.encode()) + 1)
    per_run = max(1, max_bytes // (8 * widest))
    run_no = F.expr(f"_at div {per_run}")
    runs = lines.groupBy(run_no.alias("run")).agg(F.sum(size).alias("bytes"))
    # A row per run, summed within stretches of runs and over stretches, so that no task holds all of them.
    stretch = F.expr(f"run div {RUNS_PER_STRETCH}")
    runs = settle(runs.withColumn("stretch", stretch), "runs")
    of_stretch = runs.groupBy("stretch").agg(F.sum("bytes").alias("n"))
    before = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = of_stretch.select("stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("stretch").orderBy("run").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A part is filled up to this, so that the run that crosses its edge still fits.
    room = max(1, max_bytes - min(per_run * widest, max_bytes // 2))
    end = F.col("start") + F.sum("bytes").over(within) + F.lit(len(header.encode()) + 1)
    part = F.expr(f"(_end - 1) div {room}").cast("int")
    parts = runs.join(starts, "stretch").withColumn("_end", end).select("run", part.alias("part"))
    n_parts = ((total or 0) + len(header.encode())) // room + 1
    placed = lines.withColumn("run", run_no).join(parts, "run").select("part", "_at", "value")
    first = df.sparkSession.createDataFrame([(0, -1, header)], "part int, _at bigint, value string")
    dealt = placed.unionByName(first).repartitionById(int(n_parts), F.col("part")).sortWithinPartitions("_at")
    dealt.select("value").write.text(path)
    return path


def _csv_name(name: str) -> str:
    return '"' + name.replace('"', '""') + '"' if any(c in name for c in ',"\n\r') else name


def _csv_value(df: DataFrame, column: str):
    """A column as it is printed; infinite numbers as `inf`, NaN as nothing."""
    value = F.col(f"`{column}`")
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        infinite = F.when(value > 0, F.lit("inf")).otherwise(F.lit("-inf"))
        finite = F.when(~F.isnan(value), value.cast("string"))
        value = F.when(F.abs(value) == F.lit(float("inf")), infinite).otherwise(finite)
    return value.alias(column)


def write_result(
    df: DataFrame,
    base: str,
    *,
    n_rows: int | None = None,
    keys: tuple[str, ...] = ("row_id",),
    format: str = "parquet",
    decimals: int | None = None,
) -> str:
    """Write (row id, prediction) in row order under `base`; returns the folder.

    Give `n_rows` when ids are dense in one numbering; otherwise rows are
    sorted by `keys`.
    """
    if n_rows is not None:
        ordered = spread_by_place(df, n_rows, place="row_id")
    else:
        ordered = in_row_order(df, *keys)
    path = run_path(base)
    if format == "csv":
        return write_csv(ordered, path, decimals)
    ordered.write.format(format).save(path)
    return path
