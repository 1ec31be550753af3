"""Continuous scoring: each file that arrives is scored once."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meterloom.plans.score_files import KEY_TYPE, ROWS_SCHEMA, score_files, write_run
from meterloom.session import scratch_path

ATTEMPTS_SCHEMA = "batch bigint, error string"
ASIDE_SCHEMA = (
    "source_file string, status int, error_class string, detail string, rows bigint, bad_rows bigint, "
    "extra_columns array<string>"
)
#: Characters of an error's text that are kept.
ERROR_TEXT = 2_000


def arriving_files(
    spark: SparkSession, folder: str, max_files: int, glob: str = "*.csv", max_bytes: int | None = None
) -> DataFrame:
    """A stream with one row per new file, in batches of so many files or bytes. Contents are not read here."""
    bound = {"maxFilesPerTrigger": max_files} if max_bytes is None else {"maxBytesPerTrigger": max_bytes}
    return (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .options(pathGlobFilter=glob, recursiveFileLookup=True, **bound)
        .load(folder)
        .select("path", "length", F.col("_metadata.file_path").alias("source_file"))
    )


def literal_path(path: str) -> str:
    """`path` as a pattern that matches only itself."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def score_stream(
    spark: SparkSession,
    folder: str,
    model,
    out: str,
    checkpoint: str,
    *,
    max_files: int = 1_000,
    max_bytes: int | None = None,
    attempts: int | None = None,
    available_now: bool = True,
    interval: str = "1 minute",
    glob: str = "*.csv",
    **options,
) -> StreamingQuery:
    """Score files as they arrive into the run folder `out`, see `read_run`.

    The checkpoint remembers which files were taken. A micro-batch is a list of at
    most `max_files` paths, or of files of about `max_bytes` in all (one larger file
    is a batch by itself); its rows are scored by an ordinary batch job. A batch
    that is repeated after a failure rewrites its own part, so every file is
    counted once. A file must not change under the same name.

    A batch that fails ends the stream, and a restart takes it again. With `attempts`,
    failures are noted under `<out>/attempts`; once a batch has failed so often, the
    files it fails on are found by halving it and set aside with status 500, class
    `set_aside` and the error, the others are scored, and the stream goes on. If
    each of several files fails by itself, the cause is no file: the stream ends.
    """
    out = out.rstrip("/")

    def score_paths(session: SparkSession, paths: list[str], target: str, batch_id: int | None) -> None:
        literal = [literal_path(p) for p in paths]
        write_run(score_files(session, literal, model, glob=glob, **options), target, batch_id)

    def score_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        # Names only: at most max_files, or those of max_bytes.
        names = {row["path"]: row["source_file"] for row in batch.select("path", "source_file").collect()}
        paths = list(names)
        if not paths:
            return
        try:
            score_paths(session, paths, out, batch_id)
        except Exception as error:
            if attempts is None or _failures(session, out, batch_id, error) < attempts:
                raise
            failed = failing(paths, lambda some: score_paths(session, some, scratch_path(session, "trial"), None))
            if len(failed) == len(paths) > 1:
                raise
            good = [p for p in paths if p not in failed]
            if good:
                score_paths(session, good, out, batch_id)
            keyed = options.get("leading_index", False) not in (True, False)
            failed = {names[p]: e for p, e in failed.items()}
            _set_aside(session, out, batch_id, failed, keep=bool(good), keyed=keyed)

    writer = (
        arriving_files(spark, folder, max_files, glob, max_bytes)
        .writeStream.foreachBatch(score_batch)
        .option("checkpointLocation", checkpoint)
    )
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def failing(paths: list[str], attempt: Callable[[list[str]], None]) -> dict[str, str]:
    """The paths on which `attempt` fails by itself, with the error, found by halving the list.

    Each failing path costs about two attempts for every time the list can be halved.
    """
    try:
        attempt(paths)
        return {}
    except Exception as error:
        if len(paths) == 1:
            return {paths[0]: str(error)[:ERROR_TEXT]}
    half = len(paths) // 2
    return failing(paths[:half], attempt) | failing(paths[half:], attempt)


def _failures(spark: SparkSession, out: str, batch_id: int, error: Exception) -> int:
    """How often the batch has failed, this failure included, which is noted."""
    folder = f"{out}/attempts"
    noted = spark.createDataFrame([(batch_id, str(error)[:ERROR_TEXT])], ATTEMPTS_SCHEMA)
    noted.coalesce(1).write.mode("append").parquet(folder)
    return spark.read.schema(ATTEMPTS_SCHEMA).parquet(folder).where(F.col("batch") == batch_id).count()


def _set_aside(spark: SparkSession, out: str, batch_id: int, failed: dict[str, str], keep: bool, keyed: bool) -> None:
    """Status rows of the failed files, beside those of the batch's other files if there are any."""
    rows = [(path, 500, "set_aside", error, 0, 0, []) for path, error in failed.items()]
    status = spark.createDataFrame(rows, ASIDE_SCHEMA).coalesce(1)
    if keyed:
        status = status.withColumn(KEY_TYPE, F.lit(None).cast("string"))
    if not keep:
        # a batch without rows
        empty = spark.createDataFrame([], ROWS_SCHEMA)
        empty.write.mode("overwrite").partitionBy("outcome").parquet(f"{out}/rows/batch={batch_id}")
    status.write.mode("append" if keep else "overwrite").parquet(f"{out}/status/batch={batch_id}")
