"""The whole job: CSV files in, predictions, quarantine and file status out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.operators.catalog import feature_schema
from meterloom.operators.pymodel import PythonModel
from meterloom.operators.scoring import ERRORS, model_features, score, unit_means
from meterloom.session import settle
from meterloom.sinks.files import in_key_order, key_parts, run_path, spread_by_place, write_csv, write_csv_parts
from meterloom.sources.lines import small_side
from meterloom.sources.uploads import ROW_KEY, index_fields, key_columns, read_uploads, with_failures

#: Upper estimate of a failed file's path.
PATH_BYTES = 1024


@dataclass
class Scored:
    """`judged`: all rows of the accepted files with prediction and reason; only
    the file list has been computed yet (with a Python model, the rows too).
    `files`: as in `Uploads`. `drops`: rows with missing features were left out."""

    judged: DataFrame
    files: DataFrame
    drops: bool = False

    @property
    def predictions(self) -> DataFrame:
        """source_file, row_id (and row_key), prediction of the valid rows."""
        valid = self.judged.where(F.col("_fence") & F.col("reason").isNull())
        return valid.select("source_file", *key_columns(valid), "prediction")

    @property
    def quarantine(self) -> DataFrame:
        """source_file, row_id, reason, columns, raw of the other rows."""
        return self.judged.where(F.col("_fence") & F.col("reason").isNotNull()).select(
            "source_file", "row_id", "reason", F.col("bad_columns").alias("columns"), "raw"
        )


def score_files(
    spark: SparkSession,
    paths,
    model,
    *,
    features: list[str] | None = None,
    required: list[str] | None = None,
    on_null: str = "null",
    means: dict[str, float] | None = None,
    **read_options,
) -> Scored:
    """Score every row of every accepted file.

    model: a compiled model, a `PythonModel` or a fitted Spark ML pipeline.
    features: columns to read, the model's own if not given; required: columns a
    file must have, all `features` if not given. With `on_null="mean"` a missing
    feature gets its mean from `means`, or else over the valid rows of its own
    file; other files, and other batches of a stream, have no part in it.
    Other options: `read_uploads`.

    What a Python model raises for a file, or a result that does not match its rows,
    becomes that file's status: 500 with the error's text, 422 for the errors that
    stand for a bad file. None of its rows is scored; other files are not touched.
    """
    needed = model_features(model)
    uploads = read_uploads(spark, paths, feature_schema(features or needed), required, **read_options)
    valid = F.col("reason").isNull()
    # a quarantined row is never handed to a Python model
    apart = F.when(valid, F.xxhash64("source_file"))
    if on_null == "mean":
        if means is None:
            # Text is parsed once more for the means; a row per file comes out.
            means = settle(unit_means(uploads.rows, needed, "source_file"), "means")
        scored = score(uploads.judged, model, on_null="mean", means=means, unit="source_file", apart=apart)
    else:
        scored = score(uploads.judged, model, apart=apart)
    if on_null == "drop":
        scored = scored.where(F.col("_fence") & (~valid | F.col("null_features").isNull()))
    predicted = scored.withColumn("prediction", F.when(valid, F.col("prediction")))
    files = uploads.files
    if isinstance(model, PythonModel):
        predicted, files = _without_failed(predicted, files)
    return Scored(predicted, files, on_null == "drop")


def _without_failed(predicted: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without those of files a model failed on, and the files with their new status.

    The rows are written, so that the model runs once and all its errors are known
    before any result is. Of several errors of a file, that of its first row stays.
    """
    predicted = settle(predicted, "scored")
    first = F.min_by(F.struct(*ERRORS), "place").alias("first")
    failures = settle(
        predicted.where(F.col(ERRORS[0]).isNotNull())
        .groupBy("source_file")
        .agg(first)
        .select("source_file", F.col(f"first.{ERRORS[0]}").alias("error_class"), F.col(f"first.{ERRORS[1]}").alias("error")),
        "failures",
    )
    predicted = predicted.drop(*ERRORS)
    n_failed = failures.count()
    if not n_failed:
        return predicted, files
    kept = predicted.join(small_side(failures.select("source_file"), n_failed * PATH_BYTES), "source_file", "left_anti")
    return kept, settle(with_failures(files, failures), "files")


def status_table(files: DataFrame, written: DataFrame | None = None) -> DataFrame:
    """source_file, status, error_class, detail, rows, bad_rows, extra_columns.

    `bad_rows` counts malformed rows; with `written`, the rows of a finished run,
    it counts the quarantined rows of accepted files, bad values included. A bad
    value never rejects its file, in strict mode neither.
    """
    if written is not None:
        quarantined = F.count_if(F.col("outcome") == "quarantined")
        bad = written.groupBy("source_file").agg(quarantined.alias("n_quarantined"))
        files = files.join(bad, "source_file", "left").withColumn(
            "bad_rows",
            F.when(F.col("status") == 200, F.coalesce("n_quarantined", F.lit(0))).otherwise(F.col("bad_rows")),
        )
    return files.selectExpr(
        "source_file", "status", "error_class", "detail",
        "coalesce(n_rows, 0L) AS rows", "bad_rows", "extra_columns",
    )


def _check_counts(scored: Scored, written: DataFrame) -> None:
    """Every row read is scored, quarantined or, if asked for, dropped."""
    out = written.groupBy("source_file").agg(F.count("*").alias("n_out"))
    n_out, n_read = F.coalesce("n_out", F.lit(0)), F.coalesce("n_rows", F.lit(0))
    wrong = n_out > n_read if scored.drops else n_out != n_read
    lost = scored.files.where("status = 200").join(out, "source_file", "left").where(wrong)
    first = lost.select("source_file", n_read.alias("n_read"), n_out.alias("n_out")).first()
    if first:
        raise RuntimeError(f"{first.source_file}: {first.n_read} rows read, {first.n_out} written")


def run(spark: SparkSession, paths, model, base: str, *, format: str = "parquet", **options) -> str:
    """Score and write one run into a folder of its own; returns the folder.

    `read_run` reads its tables. With format "csv" the predictions are also
    exported as CSV files to `<folder>/csv`; with "joined csv" as parts of bounded
    size that are one CSV file when joined in the order of their names.
    """
    if format == "joined csv" and index_fields(options.get("leading_index")) and options["leading_index"] is not True:
        raise ValueError("parts that join need the order of dense row ids, not of a typed index")
    folder = write_run(score_files(spark, paths, model, **options), run_path(base))
    if format == "joined csv":
        scored = _stored_rows(spark, folder, "scored").select("source_file", "row_id", "prediction", "place")
        write_csv_parts(scored, f"{folder}/csv")
    if format == "csv":
        scored = _stored_rows(spark, folder, "scored")
        n_places = scored.agg(F.max("place")).first()[0] or 0
        if ROW_KEY in scored.columns:
            parts = key_parts(scored, ROW_KEY)
            named = [F.col(parts[0]).alias("row_id")] if len(parts) == 1 else [F.col(p) for p in parts]
            ordered = in_key_order(scored, n_places + 1, ROW_KEY, "source_file")
            write_csv(ordered.select("source_file", *named, "prediction"), f"{folder}/csv")
        else:
            spread = spread_by_place(scored, n_places + 1)
            write_csv(spread.select("source_file", "row_id", "prediction"), f"{folder}/csv")
    return folder


def write_run(scored: Scored, folder: str, batch: int | None = None) -> str:
    """Write `<folder>/rows/outcome={scored,quarantined}` and `<folder>/status`,
    or their `batch=<n>` parts, replacing only what this run or batch wrote before.

    One parse and one shuffle serve both outcomes: rows go to the output file
    that their place through all files names, and are in order there. Rows with a
    typed index are ordered by upload and index instead, null last; as that order is
    found by sampling, they are written once before.
    """
    spark = scored.files.sparkSession
    rows = scored.judged.select(
        "source_file", *key_columns(scored.judged), "place", "prediction", "reason",
        F.when(F.col("reason").isNotNull(), F.col("bad_columns")).alias("columns"),
        F.when(F.col("reason").isNotNull(), F.col("raw")).alias("raw"),
        F.when(F.col("reason").isNull(), "scored").otherwise("quarantined").alias("outcome"),
    )
    part = "" if batch is None else f"/batch={batch}"
    # places run through all files that were read; those of failed files are empty
    n_rows = scored.files.where("status = 200").agg(F.max(F.col("first_place") + F.col("n_rows"))).first()[0] or 0
    keyed = ROW_KEY in rows.columns
    if keyed:
        ordered = in_key_order(settle(rows, "scored"), n_rows, ROW_KEY, "source_file", first=("outcome",))
    else:
        ordered = spread_by_place(rows, n_rows, "outcome", "place")
    ordered.write.mode("overwrite").partitionBy("outcome").parquet(f"{folder}/rows{part}")
    key_type = rows.schema[ROW_KEY].dataType.simpleString() if keyed else None
    written = spark.read.schema(rows_schema(key_type)).parquet(f"{folder}/rows{part}")
    _check_counts(scored, written)
    status = status_table(scored.files, written)
    if keyed:
        status = status.withColumn(KEY_TYPE, F.lit(key_type))
    status.write.mode("overwrite").parquet(f"{folder}/status{part}")
    return folder


RUN_COLUMNS = {
    "scored": ("source_file", "row_id", "prediction"),
    "quarantined": ("source_file", "row_id", "reason", "columns", "raw"),
}
ROWS_SCHEMA = (
    "source_file string, row_id bigint, place bigint, prediction double, reason string, "
    "columns array<string>, raw string, outcome string"
)
#: In the status table: the type of the rows' typed index.
KEY_TYPE = "key_type"


def rows_schema(key_type: str | None) -> str:
    return f"{ROWS_SCHEMA}, {ROW_KEY} {key_type}" if key_type else ROWS_SCHEMA


def _stored_rows(spark: SparkSession, folder: str, outcome: str) -> DataFrame:
    status = spark.read.parquet(f"{folder}/status")
    key_type = status.agg(F.max(KEY_TYPE)).first()[0] if KEY_TYPE in status.columns else None
    rows = spark.read.schema(rows_schema(key_type)).parquet(f"{folder}/rows")
    return rows.where(F.col("outcome") == outcome)


def read_run(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The "scored" or "quarantined" rows or the "status" of a run or a stream."""
    if table == "status":
        return spark.read.parquet(f"{folder}/status").drop("batch", KEY_TYPE)
    rows = _stored_rows(spark, folder, table)
    key = [ROW_KEY] if ROW_KEY in rows.columns and table == "scored" else []
    return rows.select(*RUN_COLUMNS[table][:2], *key, *RUN_COLUMNS[table][2:])
