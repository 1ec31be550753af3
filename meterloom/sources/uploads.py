"""Uploaded CSV files as one typed table, with a report on every file.

Columns are bound by the names in each file's own header, so files may order
their columns differently and carry extra ones.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterloom.functions.lines import field_count, nth_field, unique_names, width_tiers, with_fields
from meterloom.functions.values import drop_null_tokens, parse_as
from meterloom.operators.schema import SPARK_TYPES, infer_types
from meterloom.session import fence, settle
from meterloom.sources.admission import list_files
from meterloom.sources.lines import NumberedRecords, read_lines, read_stitched

# The texts of the status report.
BAD_ENCODING = "Error Parsing File. Please Upload a Valid CSV File!"
BAD_CSV = "Error parsing CSV file. Upload a valid CSV file with valid columns"
EMPTY_FILE = "No columns to parse from file"
MISSING_BEFORE, MISSING_AFTER = "KeyError: ", ". Ensure correct columns in your Data!"
NO_ROWS = "No predictions to display."

#: A line is wide if it has this many times the fields that are wanted of it.
SPARSE = 8
#: The typed index of a row, if its file has one.
ROW_KEY = "row_key"


@dataclass
class Uploads:
    """`judged`: every data row of the accepted files, parsed once, with
    source_file, row_id, place (position through all files in path order), the
    declared columns, reason (null for a valid row), bad_columns and raw; with a
    typed leading index also `row_key`.
    `files`: one row per file with its header, counts and status.
    """

    judged: DataFrame
    files: DataFrame
    columns: list[str]

    @property
    def rows(self) -> DataFrame:
        """The valid rows: source_file, row_id (and row_key), declared columns, place."""
        return self.judged.where(F.col("_fence") & F.col("reason").isNull()).select(
            "source_file", *key_columns(self.judged), *[F.col(f"`{c}`") for c in self.columns], "place"
        )

    @property
    def quarantine(self) -> DataFrame:
        """The other rows: source_file, row_id, reason, columns, raw."""
        return self.judged.where(F.col("_fence") & F.col("reason").isNotNull()).select(
            "source_file", "row_id", "reason", F.col("bad_columns").alias("columns"), "raw"
        )


def key_columns(rows: DataFrame) -> list[str]:
    """What names a row within its file."""
    return ["row_id", ROW_KEY] if ROW_KEY in rows.columns else ["row_id"]


def index_fields(leading_index) -> list[T.StructField]:
    """The index columns: none, one whole number for True, or those of a type or DDL text."""
    if not leading_index:
        return []
    if leading_index is True:
        return [T.StructField("row_id", T.LongType())]
    kind = leading_index
    if isinstance(kind, str):
        kind = T._parse_datatype_string(kind)
    return list(kind.fields) if isinstance(kind, T.StructType) else [T.StructField(ROW_KEY, kind)]


def profile_files(numbered: NumberedRecords, n_index: int = 0) -> DataFrame:
    """Header names and record counts per file, from the counts per record shape.

    A file has a leading index if its first row has `n_index` fields more than its header.
    """
    groups = numbered.groups
    headers = groups.where(F.col("first") == -1).select(
        "source_file", F.col("first_raw").alias("raw"), F.col("width").alias("n_columns")
    )
    cut = with_fields(headers, F.col("n_columns"), width_tiers(numbered.widest)).drop("raw")
    names = unique_names(F.slice("fields", F.lit(1), F.col("n_columns")))
    # Written, as names go on into joins: the helper runs once per header.
    named = settle(cut.withColumn("names", names).drop("fields"), "headers")

    extra = F.col("width") - F.col("n_columns")
    indexed = F.lit(n_index > 0) & F.bool_or((F.col("first") == 0) & (extra == n_index))
    long_rows = lambda allowed: F.coalesce(
        F.sum(F.when(~F.col("open_quote") & (extra > allowed), F.col("n"))), F.lit(0)
    )
    return (
        groups.join(named, "source_file")
        .groupBy("source_file", "names", "n_columns")
        .agg(
            (F.sum("n") - 1).alias("n_rows"),
            F.bool_and("valid").alias("valid"),
            F.bool_or("quoted").alias("quoted"),
            F.coalesce(F.sum(F.when(F.col("open_quote"), F.col("n"))), F.lit(0)).alias("n_open"),
            indexed.alias("leading_index"),
            F.when(indexed, long_rows(n_index)).otherwise(long_rows(0)).alias("n_long"),
        )
    )


def missing_columns(names: Column, required: list[str]) -> Column:
    """The required names a header lacks, in required order."""
    return F.array_except(F.array(*map(F.lit, required)).cast("array<string>"), names)


def classify(files: DataFrame, required: list[str], strict: bool, known: list[str]) -> DataFrame:
    """Status per file, and the columns of its header that are not `known`. A bad byte outranks everything, then an empty file, then
    malformed rows (only in strict mode), then missing columns."""
    malformed = F.coalesce(F.col("n_long") + F.col("n_open"), F.lit(0))
    none = F.array().cast("array<string>")
    missing = F.coalesce(missing_columns(F.col("names"), required), none)
    extra = F.coalesce(F.array_except("names", F.array(*map(F.lit, known)).cast("array<string>")), none)
    error = (
        F.when(~F.coalesce("valid", F.lit(True)), F.lit("encoding"))
        .when(F.col("names").isNull(), F.lit("empty"))
        .when(F.lit(strict) & (malformed > 0), F.lit("malformed"))
        .when(F.size("missing") > 0, F.lit("missing_column"))
        .when(F.col("n_rows") == 0, F.lit("no_rows"))
        .otherwise(F.lit("ok"))
    )
    kind = F.col("error_class")
    detail = (
        F.when(kind == "encoding", F.lit(BAD_ENCODING))
        .when(kind == "empty", F.lit(EMPTY_FILE))
        .when(kind == "malformed", F.lit(BAD_CSV))
        .when(
            kind == "missing_column",
            F.concat(
                F.lit(MISSING_BEFORE),
                F.array_join("missing", ", "),
                F.lit(MISSING_AFTER),
            ),
        )
        .when(kind == "no_rows", F.lit(NO_ROWS))
    )
    status = (
        F.when(kind.isin("ok", "no_rows"), 200).when(kind == "empty", 500).otherwise(422)
    )
    return (
        files.withColumns({"missing": missing, "extra_columns": extra})
        .withColumn("error_class", error)
        .withColumns({"status": status, "detail": detail, "bad_rows": malformed})
    )


def with_failures(files: DataFrame, failures: DataFrame) -> DataFrame:
    """`files` with the status of those a model could not score.

    failures: source_file, error_class (as `pymodel.error_class` has it), error.
    """
    kind = F.col("failure")
    status = F.when(kind == "model", 500).when(kind.isNotNull(), 422).otherwise(F.col("status"))
    detail = (
        F.when(kind == "model", F.col("error"))
        .when(kind == "missing_column", F.concat(F.lit(MISSING_BEFORE), "error", F.lit(MISSING_AFTER)))
        .when(kind == "encoding", F.lit(BAD_ENCODING))
        .when(kind == "malformed", F.lit(BAD_CSV))
        .otherwise(F.col("detail"))
    )
    named = failures.select("source_file", F.col("error_class").alias("failure"), "error")
    return (
        files.join(named, "source_file", "left")
        .withColumns({"status": status, "detail": detail, "error_class": F.coalesce(kind, "error_class")})
        .drop("failure", "error")
    )


def read_uploads(
    spark: SparkSession,
    paths,
    schema: T.StructType | None = None,
    required: list[str] | None = None,
    *,
    glob: str = "*.csv",
    multiline: bool = False,
    leading_index: bool | str | T.DataType = False,
    strict: bool = False,
    one_numbering: bool = False,
) -> Uploads:
    """Read CSV files into the columns of `schema`, or of `infer_schema` without one.

    required: columns each file must have; all of `schema` if not given.
    multiline: quoted fields may hold line breaks.
    leading_index: a first row with more fields than the header makes the first columns
      the row's index. True: one whole number, which is the row id. A type, or several
      columns with types as DDL ("at timestamp", "building string, hour int"): a typed
      `row_key` (a struct, if several) beside the dense row id. An index value that does
      not fit is quarantined as `bad_index`, and so is a missing row id; a missing
      value of a typed key is null, and such rows come last in order.
    strict: reject a file with any malformed row instead of quarantining the row.
    one_numbering: number rows through all files in path order, not per file.
    """
    index = index_fields(leading_index)
    if schema is None:
        schema = infer_schema(spark, paths, glob=glob, multiline=multiline, leading_index=leading_index)
        required = [] if required is None else required
    # Listed before the scan is planned: a file that arrives in between is left out, not called empty.
    listed = list_files(spark, paths, glob)
    reader = read_stitched if multiline else read_lines
    numbered: NumberedRecords = reader(spark, paths, glob)
    columns = schema.fieldNames()
    files = settle(
        classify(
            listed.join(profile_files(numbered, len(index)), "source_file", "left"),
            columns if required is None else required,
            strict,
            columns,
        ).withColumn("first_place", _first_place()),
        "files",
    )

    where = F.transform(
        F.array(*map(F.lit, columns)),
        lambda name: (
            F.nullif(F.array_position("names", name), F.lit(0)) - 1 + F.col("leading_index").cast("int") * len(index)
        ).cast("int"),
    )
    binding = files.select(
        "source_file",
        where.alias("where"),
        (F.col("n_columns") + F.col("leading_index").cast("int") * len(index)).alias("allowed"),
        "leading_index",
        "first_place",
        (F.col("bad_rows") > 0).alias("malformed"),
        "status",
    ).where("status = 200").drop("status")

    records = numbered.records(binding, n_bytes=8 * len(columns)).where(F.col("row_no") >= 0)
    # Few columns of a wide line without a quote are picked out of it; other lines are cut into all their fields.
    sparse = ~F.col("raw").contains('"') & (F.col("allowed") > SPARSE * (len(columns) + len(index)))
    records = records.withColumn("sparse", sparse)
    parsed = with_fields(records, F.col("allowed") + 1, _tiers(files), skip=F.col("sparse")).withColumn(
        "n_fields", F.when(F.col("sparse"), field_count(F.col("raw")))
    )

    def field(at: Column) -> Column:
        picked = F.when(at < F.col("n_fields"), nth_field(F.col("raw"), at))
        return F.when(F.col("sparse"), picked).otherwise(F.get("fields", at))

    # Values are parsed array by array, one per type: the generated code stays
    # small however many columns there are.
    by_type: dict[T.DataType, list[int]] = {}
    for i, f in enumerate(schema.fields):
        by_type.setdefault(f.dataType, []).append(i)
    text = [F.get("texts", F.lit(i)) for i in range(len(columns))]
    arrays, value = {}, {}
    for k, (data_type, members) in enumerate(by_type.items()):
        if isinstance(data_type, T.StringType):
            value |= {i: text[i] for i in members}
            continue
        source = F.array(*[text[i] for i in members]) if len(by_type) > 1 else F.col("texts")
        arrays[f"values_{k}"] = F.transform(source, _parser(data_type))
        value |= {i: F.get(f"values_{k}", F.lit(j)) for j, i in enumerate(members)}
    row_id = F.col("place") if one_numbering else F.col("row_no")
    indexed = F.col("leading_index")
    # as for the columns, one array of texts: each value is cut and cleaned once
    index_text = [F.get("index_texts", F.lit(i)) for i in range(len(index))]
    index_value = [F.when(indexed, parse_as(t, f.dataType)) for t, f in zip(index_text, index)]
    unfit_index = reduce(
        Column.__or__, [t.isNotNull() & v.isNull() for t, v in zip(index_text, index_value)], F.lit(False)
    )
    keyed = {}
    if leading_index is True:
        row_id = F.when(indexed, index_value[0]).otherwise(row_id)
        unfit_index = index_value[0].isNull()
    elif index:
        parts = F.struct(*[v.alias(f.name) for v, f in zip(index_value, index)])
        keyed = {ROW_KEY: index_value[0] if index[0].name == ROW_KEY else F.when(indexed, parts)}
    typed = (
        # Over the array of places, as code of its own per column would be a method too long for the JVM to compile.
        parsed.withColumn("texts", F.transform(F.transform("where", field), drop_null_tokens))
        .withColumn("index_texts", F.array(*[drop_null_tokens(field(F.lit(i))) for i in range(len(index))]))
        .withColumns(arrays)
        .withColumn("place", F.col("first_place") + F.col("row_no"))
        .withColumns({"row_id": row_id, "bad_index": indexed & unfit_index, **keyed})
    )
    unfit = {
        c: text[i].isNotNull() & value[i].isNull()
        for i, c in enumerate(columns)
        if not isinstance(schema[c].dataType, T.StringType)
    }
    reason = (
        F.when(F.col("open_quote"), F.lit("open_quote"))
        .when(F.col("width") > F.col("allowed"), F.lit("long_row"))
        .when(F.col("bad_index"), F.lit("bad_index"))
        .when(reduce(Column.__or__, unfit.values(), F.lit(False)), F.lit("bad_value"))
    )
    unfit_names = F.array(*[F.when(u, F.lit(c)) for c, u in unfit.items()]).cast("array<string>")
    bad_columns = F.when(F.col("reason") == "bad_value", F.array_compact(unfit_names)).otherwise(
        F.array().cast("array<string>")
    )
    judged = fence(typed.withColumn("reason", reason)).select(
        "source_file",
        "row_id",
        *keyed,
        "place",
        *[value[i].alias(c) for i, c in enumerate(columns)],
        "reason",
        bad_columns.alias("bad_columns"),
        "raw",
        "_fence",
    )
    return Uploads(judged, files, columns)


def _tiers(files: DataFrame) -> list[int]:
    """The parse widths that the accepted files with quotes need; a handful of numbers."""
    files = files.where("status = 200 and quoted")
    widest = files.agg(F.max("n_columns")).first()[0] or 1
    tiers = width_tiers(widest + 2)
    tier = F.lit(tiers[-1])
    for width in reversed(tiers[:-1]):
        tier = F.when(F.col("n_columns") + 2 <= width, width).otherwise(tier)
    needed = files.select(tier.alias("t")).distinct().collect()
    return sorted(r.t for r in needed) or tiers[:1]


def header_columns(spark: SparkSession, paths, glob: str = "*.csv", multiline: bool = False) -> list[str]:
    """Every name in any header, in the order of the headers."""
    headers = read_headers(spark, paths, glob, multiline)
    at = headers.select("source_file", F.posexplode("names").alias("at", "name"))
    # A row per distinct name.
    first = at.groupBy("name").agg(F.min(F.struct("source_file", "at")).alias("first")).orderBy("first")
    return [r.name for r in first.collect()]


def infer_schema(spark: SparkSession, paths, columns: list[str] | None = None, **options) -> T.StructType:
    """Column names and types of a folder of CSV files, from their text.

    `columns`: those to look at; every name in any header if not given, in the
    order of the headers. One pass over the text for the values, by one aggregate.
    """
    if columns is None:
        columns = header_columns(spark, paths, options.get("glob", "*.csv"), options.get("multiline", False))
    text = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = read_uploads(spark, paths, text, [], **options).rows
    found = {r["column"]: r["type"] for r in infer_types(rows, columns).collect()}
    return T.StructType([T.StructField(c, SPARK_TYPES[found.get(c, "double")]) for c in columns])


def _parser(data_type: T.DataType):
    return lambda text: parse_as(text, data_type)


def _first_place() -> Column:
    """Rows in accepted files before this one; the window runs over the file list."""
    earlier = Window.orderBy("source_file").rowsBetween(Window.unboundedPreceding, -1)
    rows = F.when(F.col("status") == 200, F.col("n_rows"))
    return F.coalesce(F.sum(rows).over(earlier), F.lit(0))


def read_headers(spark: SparkSession, paths, glob: str = "*.csv", multiline: bool = False) -> DataFrame:
    """source_file, names, n_columns, n_rows, ...: one row per file that has a header."""
    reader = read_stitched if multiline else read_lines
    return profile_files(reader(spark, paths, glob))
