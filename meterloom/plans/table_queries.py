"""Every operator as a query over the given tables.

Feature tables are made from `lineitem` (features l_quantity, l_discount, l_tax,
label l_extendedprice), `events`, `orders`, `customer` and `documents`. Uploads
are written by Spark to the shared folder and read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterloom.functions.dumps import load_dump
from meterloom.functions.models import (
    CategorySplit,
    Ensemble,
    Leaf,
    Linear,
    Split,
    Stack,
    SymmetricTree,
    Tree,
    load_model,
    save_model,
)
from meterloom.functions.values import NULL_TOKENS
from meterloom.operators.catalog import catalog, missing_features, profile_features
from meterloom.operators.paging import clamp_page, display, page, page_count, page_in_order, page_summary
from meterloom.operators.pipeline import (
    compile_pipeline,
    fit_pipeline,
    fit_stacked_pipeline,
    load_pipeline,
    save_pipeline,
    score_pipeline,
)
from meterloom.operators.pymodel import PythonModel, score_python
from meterloom.operators.rowid import with_row_id
from meterloom.operators.schema import infer_types
from meterloom.operators.scoring import in_row_order, score, to_output
from meterloom.operators.training import fit_linear, fit_stack, holdout_error
from meterloom.plans.score_files import read_run, run, score_files, status_table, write_run
from meterloom.plans.staging import as_text, stage_csv, stage_lines, table, upload_name
from meterloom.session import scratch_path
from meterloom.sinks.files import CSV_WRITE_OPTIONS, run_path, spread_by_place, write_csv, write_csv_parts, write_result
from meterloom.sources.admission import admit, list_files
from meterloom.sources.lines import read_lines
from meterloom.sources.typed import read_uploads_typed
from meterloom.sources.uploads import read_headers, read_uploads
from meterloom.streaming.uploads import score_stream

FEATURES = ["l_quantity", "l_discount", "l_tax"]
LINEAR = Linear({"l_quantity": 900.0, "l_discount": -20000.0, "l_tax": 5000.0}, 1000.0)
TREE = Tree(
    Split(
        "l_quantity", 25.0,
        Split("l_discount", 0.05, Leaf(20000.0), Leaf(15000.0)),
        Split("l_tax", 0.04, Leaf(60000.0), Leaf(55000.0)),
    )
)
STACK = Stack({"linear": LINEAR, "tree": TREE}, Linear({"linear": 0.6, "tree": 0.4}, 10.0))
FOREST = Ensemble((TREE, Tree(Split("l_tax", 0.02, Leaf(30000.0), Leaf(45000.0)))), (0.5, 0.5))
EVENT_MODEL = Linear({"value": 2.5}, 3.0)
ORDER_MODEL = Linear({"o_custkey": 0.5, "o_totalprice": 0.01}, 7.0)
ROWS_PER_UPLOAD = 5_000
#: Lines of two thousand fields in a packed file: some 100 MB of text.
WIDE_ROWS_PER_UPLOAD = 50_000


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.withColumn("prediction", F.round("prediction", digits))


def scored_events(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("row_id", F.col("event_id"))
    return rounded(to_output(score(events, EVENT_MODEL)))


def stored_events(spark, sf_dir) -> DataFrame:
    """Scored events as a result folder in row order, read back."""
    events = scored_events(spark, sf_dir)
    path = write_result(events, scratch_path(spark, "results"), n_rows=events.count())
    return spark.read.parquet(path)


# Reading CSV ----------------------------------------------------------------


def csv_scan_typed(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    uploads = read_uploads(spark, stage_csv(lineitem, "lineitem"), lineitem.schema)
    return uploads.rows.select(lineitem.columns)


def csv_scan_quoted(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    path = stage_csv(documents, "documents")
    return read_uploads(spark, path, documents.schema, multiline=True).rows.select(documents.columns)


def csv_scan_inferred(spark, sf_dir):
    """Types found in the text of the files; times come back as text."""
    orders = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.to_date("o_orderdate"))
    rows = read_uploads(spark, stage_csv(orders, "orders")).rows
    return rows.select(*orders.columns)


def csv_scan_types_per_file(spark, sf_dir):
    """All orders in five kinds of uploads, in which `code` has five types; one kind lacks another column."""
    orders = table(spark, sf_dir, "orders")
    root = scratch_path(spark, "orders")
    codes = {
        "whole": F.col("o_custkey"),
        "gaps": F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey")),
        "price": F.col("o_totalprice"),
        "flag": F.col("o_custkey") % 2 == 0,
        "word": F.concat("o_orderstatus", F.col("o_custkey").cast("string")),
    }
    for i, (kind, code) in enumerate(codes.items()):
        own = orders.where(F.col("o_orderkey") % len(codes) == i).select("o_orderkey", code.alias("code"), "o_custkey")
        stage_csv((own.drop("o_custkey") if kind == "word" else own).coalesce(1), "", f"{root}/{kind}")
    rows = read_uploads_typed(spark, root).rows
    kind = F.schema_of_variant("code")
    return rows.select(
        upload_name(F.col("source_file")).alias("upload"),
        F.try_variant_get("o_orderkey", "$", "long").alias("o_orderkey"),
        kind.alias("kind"),
        F.when(kind.isin("BIGINT", "DOUBLE"), F.try_variant_get("code", "$", "double")).alias("number"),
        F.when(kind == "BOOLEAN", F.try_variant_get("code", "$", "boolean")).alias("flag"),
        F.when(kind == "STRING", F.try_variant_get("code", "$", "string")).alias("word"),
        F.try_variant_get("o_custkey", "$", "long").alias("o_custkey"),
    )


def csv_odd_header(spark, sf_dir):
    """All orders in files of two thousand columns beside the orders themselves; both bind by name."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    root = scratch_path(spark, "orders")
    stage_csv(orders, "", f"{root}/narrow")
    header = ",".join(["x"] * 1997 + ["o_totalprice", "o_custkey", "o_orderkey"])
    line = F.concat(F.repeat(F.lit(","), 1997), F.concat_ws(",", "o_totalprice", "o_custkey", F.col("o_orderkey") + 1))
    stage_lines(orders, line, header, "", f"{root}/wide", packed_rows=WIDE_ROWS_PER_UPLOAD)
    schema = "o_orderkey bigint, o_custkey bigint, o_totalprice double"
    rows = read_uploads(spark, root, T.StructType.fromDDL(schema), glob="part-*").rows
    return rows.select(upload_name(F.col("source_file")).alias("upload"), "o_orderkey", "o_custkey", "o_totalprice")


def csv_bind_by_name(spark, sf_dir):
    """Uploads with different column orders, one with a column to spare."""
    orders = table(spark, sf_dir, "orders")
    root = scratch_path(spark, "orders")
    even = F.col("o_orderkey") % 2 == 0
    stage_csv(orders.where(even).select("o_orderkey", "o_custkey", "o_totalprice"), "", f"{root}/a")
    stage_csv(
        orders.where(~even).select("o_orderstatus", "o_totalprice", "o_orderkey", "o_custkey"),
        "", f"{root}/b",
    )
    schema = "o_orderkey bigint, o_custkey bigint, o_totalprice double"
    rows = read_uploads(spark, root, T.StructType.fromDDL(schema)).rows
    return rows.select(
        upload_name(F.col("source_file")).alias("upload"), "o_orderkey", "o_custkey", "o_totalprice"
    )


def header_dedup(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    line = F.concat_ws(
        ",", "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment", F.col("c_custkey") + 1
    )
    path = stage_lines(customer, line, "key,key,key.1,,key", "customer")
    schema = T.StructType(
        [
            T.StructField("key", T.LongType()),
            T.StructField("key.2", T.IntegerType()),
            T.StructField("key.1", T.DoubleType()),
            T.StructField("Unnamed: 3", T.StringType()),
            T.StructField("key.3", T.LongType()),
        ]
    )
    rows = read_uploads(spark, path, schema, glob="*.txt").rows
    return rows.select(
        F.col("key").alias("first_key"),
        F.col("`key.2`").alias("second_key"),
        F.col("`key.1`").alias("own_key_1"),
        F.col("Unnamed: 3").alias("unnamed_3"),
        F.col("`key.3`").alias("third_key"),
    )


def schema_infer(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_id") % 10 != 0, F.col("user_id")).alias("user_gap"),
        "value",
        (F.col("event_type") == "click").alias("is_click"),
        "event_type",
        F.to_date("ts").alias("day"),
        F.lit(None).cast("string").alias("nothing"),
        F.when(F.col("event_id") % 100 == 0, F.lit("x"))
        .otherwise(F.col("user_id").cast("string"))
        .alias("mixed"),
    )
    text = T.StructType([T.StructField(c, T.StringType()) for c in events.columns])
    rows = read_uploads(spark, stage_csv(events, "events"), text).rows
    return infer_types(rows, events.columns)


def null_tokens(spark, sf_dir):
    """Each of the 19 tokens in turn, then a value; close misses stay text."""
    events = table(spark, sf_dir, "events")
    token = F.get(F.array(*map(F.lit, NULL_TOKENS)), (F.col("event_id") % 20).cast("int"))
    miss = F.get(
        F.array(*map(F.lit, ["na", "-", "NAN", "none"])), (F.col("event_id") % 5).cast("int")
    )
    path = stage_csv(
        events.select(
            "event_id",
            F.coalesce(token, F.col("value").cast("string")).alias("value"),
            F.coalesce(token, F.col("event_type")).alias("kind"),
            F.coalesce(miss, F.lit("NA")).alias("miss"),
        ),
        "events",
    )
    schema = T.StructType.fromDDL("event_id bigint, value double, kind string, miss string")
    return read_uploads(spark, path, schema).rows.select("event_id", "value", "kind", "miss")


def utf8_check(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    bad = F.unhex(F.lit("FFFE")).cast("string")
    line = F.concat(
        F.col("event_id").cast("string"),
        F.lit(",é,"),
        F.when(F.col("event_id") % 50 == 0, bad).otherwise(F.col("event_type")),
    )
    path = scratch_path(spark, "events")
    lines = events.select(line.alias("value"), (F.col("event_id") % 4).alias("upload"))
    lines.write.partitionBy("upload").text(path)
    groups = read_lines(spark, path, glob="*.txt").groups
    return groups.groupBy(upload_name(F.col("source_file")).alias("upload")).agg(
        F.bool_and("valid").alias("valid"), F.sum("n").alias("n_lines")
    )


def ragged_rows(spark, sf_dir):
    """Rows of two to five fields and unclosed quotes against a header of three."""
    events = table(spark, sf_dir, "events")
    case = F.col("event_id") % 10
    key, kind = F.col("event_id").cast("string"), F.col("event_type")
    value = F.col("value").cast("string")
    line = (
        F.when(case == 0, F.concat_ws(",", key, kind))
        .when(case == 1, F.concat_ws(",", key, kind, value, F.lit("more")))
        .when(case == 2, F.concat_ws(",", key, kind, value, F.lit("")))
        .when(case == 3, F.concat_ws(",", key, kind, value, F.lit(""), F.lit("more")))
        .when(case == 4, F.concat(key, F.lit(',"'), kind, F.lit(','), value))
        .when(case == 5, F.concat(key, F.lit(',"a,""'), kind, F.lit('""",'), value))
        .when(case == 6, F.concat(key, F.lit(',5" '), kind, F.lit(','), value))
        .otherwise(F.concat_ws(",", key, kind, value))
    )
    path = stage_lines(events, line, "event_id,event_type,value", "events")
    schema = T.StructType.fromDDL("event_id bigint, event_type string, value double")
    uploads = read_uploads(spark, path, schema, glob="*.txt")
    good = uploads.rows.select("event_id", "event_type", "value", F.lit("ok").alias("outcome"))
    bad = uploads.quarantine.select(
        F.regexp_extract("raw", r"^\d+", 0).cast("bigint").alias("event_id"),
        F.lit(None).cast("string").alias("event_type"),
        F.lit(None).cast("double").alias("value"),
        F.col("reason").alias("outcome"),
    )
    return good.unionByName(bad)


def cast_quarantine(spark, sf_dir):
    """Text in numeric columns; the forms Spark's own cast would accept too."""
    events = table(spark, sf_dir, "events")
    odd = F.get(
        F.array(*map(F.lit, ["abc", "1d", "2f", "0x1p3", "1_000", "NAN"])),
        (F.col("event_id") % 13).cast("int"),
    )
    fine = F.get(
        F.array(*map(F.lit, ["True", "FALSE", " 2 ", "1e3", "9223372036854775808", "+7", ".5", "5."])),
        (F.col("event_id") % 11).cast("int"),
    )
    path = stage_csv(
        events.select(
            "event_id",
            F.coalesce(odd, F.col("value").cast("string")).alias("value"),
            F.coalesce(fine, F.col("value").cast("string")).alias("other"),
        ),
        "events",
    )
    schema = T.StructType.fromDDL("event_id bigint, value double, other double")
    uploads = read_uploads(spark, path, schema)
    good = uploads.rows.select("event_id", "value", "other", F.lit("").alias("bad_columns"))
    bad = uploads.quarantine.select(
        F.regexp_extract("raw", r"^\d+", 0).cast("bigint").alias("event_id"),
        F.lit(None).cast("double").alias("value"),
        F.lit(None).cast("double").alias("other"),
        F.array_join("columns", "+").alias("bad_columns"),
    )
    return good.unionByName(bad)


def leading_index(spark, sf_dir):
    """A first column without a header becomes the row id."""
    customer = table(spark, sf_dir, "customer")
    line = F.concat_ws(",", "c_custkey", "c_name", "c_nationkey", "c_acctbal")
    path = stage_lines(customer, line, "c_name,c_nationkey,c_acctbal", "customer")
    schema = T.StructType.fromDDL("c_name string, c_nationkey int, c_acctbal double")
    rows = read_uploads(spark, path, schema, glob="*.txt", leading_index=True).rows
    return rows.select("row_id", "c_name", "c_nationkey", "c_acctbal")


def leading_index_time(spark, sf_dir):
    """Events indexed by their time; some have no time, and some have text in its place."""
    events = table(spark, sf_dir, "events")
    at = F.when(F.col("event_id") % 17 == 0, F.lit("noon")).when(F.col("event_id") % 19 == 0, F.lit("")).otherwise(
        F.col("ts").cast("string")
    )
    path = stage_lines(events, F.concat_ws(",", at, "event_id", "value"), "event_id,value", "events")
    schema = T.StructType.fromDDL("event_id bigint, value double")
    uploads = read_uploads(spark, path, schema, glob="*.txt", leading_index="timestamp")
    good = uploads.rows.select(F.col("row_key").alias("at"), "event_id", "value", F.lit("ok").alias("outcome"))
    bad = uploads.quarantine.select(
        F.lit(None).cast("timestamp").alias("at"),
        F.split_part("raw", F.lit(","), F.lit(2)).cast("bigint").alias("event_id"),
        F.lit(None).cast("double").alias("value"),
        F.col("reason").alias("outcome"),
    )
    return good.unionByName(bad)


def leading_index_text(spark, sf_dir):
    """Customers indexed by segment and name, scored, written in the order of the index and read back."""
    customer = table(spark, sf_dir, "customer")
    line = F.concat_ws(",", "c_mktsegment", "c_name", "c_acctbal", "c_custkey")
    path = stage_lines(customer, line, "c_acctbal,c_custkey", "customer")
    model = Linear({"c_acctbal": 2.0, "c_custkey": 0.5}, 1.0)
    folder = run(
        spark, path, model, scratch_path(spark, "results"), glob="*.txt", leading_index="segment string, name string"
    )
    scored = rounded(read_run(spark, folder, "scored"))
    return scored.select("row_key.segment", "row_key.name", "prediction")


def among(column: str, known: list[str]) -> Column:
    """The value if it is known, else (null too) the last known one, so that every row has an upload."""
    return F.when(F.col(column).isin(known[:-1]), F.col(column)).otherwise(F.lit(known[-1]))


def required_columns(spark, sf_dir):
    """Missing features per upload; uploads are the return flags."""
    lineitem = table(spark, sf_dir, "lineitem")
    root = scratch_path(spark, "lineitem")
    kept = {"A": FEATURES, "N": ["l_tax", "l_quantity", "l_partkey"], "R": ["l_discount"]}
    for flag, columns in kept.items():
        rows = lineitem.where(among("l_returnflag", list(kept)) == flag).select(*columns)
        stage_csv(rows, "", f"{root}/{flag}")
    missing = missing_features(read_headers(spark, root), FEATURES)
    return missing.groupBy(upload_name(F.col("source_file")).alias("upload"), "feature").agg(
        F.sum("n_rows").alias("n_rows")
    )


def file_admission(spark, sf_dir):
    """Files by suffix or declared type; every event type is one upload."""
    events = table(spark, sf_dir, "events")
    root = scratch_path(spark, "events")
    formats = {"click": "csv", "signup": "csv", "error": "text", "view": "text", "purchase": "json"}
    for kind, format in formats.items():
        line = F.concat_ws(" ", "event_id", "value").alias("value")
        rows = events.where(among("event_type", list(formats)) == kind).select(line)
        rows.write.format(format).save(f"{root}/{kind}")
    listed = list_files(spark, root)
    declared = listed.select(
        "source_file",
        F.when(upload_name(F.col("source_file")) == "view", "text/csv")
        .otherwise("application/octet-stream")
        .alias("media_type"),
    )
    counts = read_lines(spark, root, glob="*").groups.groupBy("source_file").agg(F.sum("n").alias("n"))
    return (
        admit(listed, declared)
        .join(counts, "source_file")
        .groupBy(upload_name(F.col("source_file")).alias("upload"))
        .agg(F.bool_and("admitted").alias("admitted"), F.sum("n").alias("n_lines"))
    )


def upload_status(spark, sf_dir):
    """One upload per outcome, from the order priorities; both reading modes."""
    orders = table(spark, sf_dir, "orders")
    root = scratch_path(spark, "orders")
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    price = F.col("o_totalprice").cast("string")
    header = "o_orderkey,o_custkey,o_totalprice"
    bad_byte = F.unhex(F.lit("FF")).cast("string")
    lines = {
        "1-URGENT": (header, F.concat_ws(",", key, cust, price)),
        "2-HIGH": (header, F.concat(key, F.lit(","), cust, F.lit(","), bad_byte, price)),
        "3-MEDIUM": ("o_orderkey,o_totalprice", F.concat_ws(",", key, price)),
        "4-NOT SPECIFIED": (
            header,
            F.concat(key, F.lit(","), cust, F.lit(","), price, F.when(
                F.col("o_orderkey") % 7 == 0, F.lit("")).otherwise(F.lit(",x"))),
        ),
        "5-LOW": (header, F.concat(key, F.lit(","), cust, F.lit(',"'), price)),
    }
    for priority, (head, line) in lines.items():
        rows = orders.where(among("o_orderpriority", list(lines)) == priority)
        stage_lines(rows, line, head, "", f"{root}/{priority[0]}")
    nothing = orders.where(F.col("o_orderkey") < 0)
    nothing.select(key.alias("value")).write.text(f"{root}/empty")
    spark.range(1).select(F.lit(header).alias("value")).coalesce(1).write.text(f"{root}/header")
    schema = T.StructType.fromDDL("o_orderkey bigint, o_custkey bigint, o_totalprice double")
    reports = [
        status_table(read_uploads(spark, root, schema, glob="*.txt", strict=strict).files).select(
            upload_name(F.col("source_file")).alias("upload"),
            F.lit(strict).alias("strict"),
            "status", "error_class", "detail", "rows", "bad_rows",
        )
        for strict in (False, True)
    ]
    return (
        reports[0].unionByName(reports[1])
        .groupBy("upload", "strict", "status", "error_class", "detail")
        .agg(F.sum("rows").alias("rows"), F.sum("bad_rows").alias("bad_rows"))
    )


# Row ids --------------------------------------------------------------------


def status_model_failure(spark, sf_dir):
    """One upload per order status; the model raises on one and returns too few predictions for another."""
    orders = table(spark, sf_dir, "orders")
    root = scratch_path(spark, "orders")
    rows = orders.select("o_custkey", "o_totalprice", F.ascii("o_orderstatus").alias("letter"), "o_orderstatus")
    as_text(rows).write.partitionBy("o_orderstatus").options(**CSV_WRITE_OPTIONS).csv(root)

    def load():
        def predict(frame):
            letter = chr(int(frame["letter"].iloc[0]))
            if letter == "P":
                raise ValueError("no prediction for pending orders")
            values = 7.0 + 0.5 * frame["o_custkey"] + 0.01 * frame["o_totalprice"]
            return values[1:] if letter == "F" else values

        return predict

    scored = score_files(spark, root, PythonModel(["o_custkey", "o_totalprice", "letter"], load))
    read_back = read_run(spark, write_run(scored, run_path(scratch_path(spark, "results"))), "scored")
    upload = upload_name(F.col("source_file")).alias("upload")
    n_scored = read_back.groupBy(upload).agg(
        F.count("*").alias("n_scored"), F.sum(F.col("prediction").cast("decimal(18,4)")).cast("double").alias("total")
    )
    status = status_table(scored.files).groupBy(upload, "status", "error_class", "detail").agg(F.sum("rows").alias("rows"))
    return status.join(n_scored, "upload", "left").withColumn("n_scored", F.coalesce("n_scored", F.lit(0)))


def row_id_keyed(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    return with_row_id(events, "event_id").select("event_id", "value", "row_id")


def row_id_text_key(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    return with_row_id(customer, "c_name").select("c_custkey", "c_name", "row_id")


def row_id_null_key(spark, sf_dir):
    """Missing and repeated keys; only the ids that the keys alone decide are shown."""
    orders = table(spark, sf_dir, "orders")
    key = F.when(F.col("o_orderkey") % 3 != 0, F.floor(F.col("o_orderkey") / 2))
    numbered = with_row_id(orders.select("o_orderkey", key.alias("key")), "key")
    return numbered.groupBy("key").agg(
        F.count("*").alias("n"), F.min("row_id").alias("first_id"), F.max("row_id").alias("last_id")
    )


def row_id_file_order(spark, sf_dir):
    """Rows numbered through several files in path order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    path = stage_csv(orders.orderBy("o_orderkey"), "orders")
    rows = read_uploads(spark, path, orders.schema, one_numbering=True).rows
    return rows.select("row_id", "o_orderkey", "o_totalprice")


def row_id_per_upload(spark, sf_dir):
    """Many uploads in one job, each numbered from 0."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    ordered = spread_by_place(
        orders, orders.count(), place="o_orderkey", rows_per_file=ROWS_PER_UPLOAD
    )
    path = stage_csv(ordered, "orders")
    rows = read_uploads(spark, path, ordered.schema).rows
    part = F.regexp_extract("source_file", r"part-(\d+)", 1).cast("bigint")
    return rows.select(part.alias("upload"), "row_id", "o_orderkey", "o_totalprice")


# Scoring --------------------------------------------------------------------


def _scored_lineitem(spark, sf_dir, model) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem")
    return rounded(to_output(score(lineitem, model), "l_orderkey", "l_linenumber"))


def score_linear(spark, sf_dir):
    return _scored_lineitem(spark, sf_dir, LINEAR)


def score_tree(spark, sf_dir):
    return _scored_lineitem(spark, sf_dir, TREE)


def score_forest(spark, sf_dir):
    return _scored_lineitem(spark, sf_dir, FOREST)


def with_gaps(spark, sf_dir) -> DataFrame:
    """`lineitem` with some discounts and taxes missing."""
    return table(spark, sf_dir, "lineitem").withColumns(
        {"l_discount": F.nullif("l_discount", F.lit(0.1)), "l_tax": F.nullif("l_tax", F.lit(0.0))}
    )


def score_category_split(spark, sf_dir):
    """A large and a small set of categories as tests; what is missing goes right."""
    suppliers = tuple(float(c) for c in range(0, 10_000, 3))
    model = Tree(
        CategorySplit(
            "l_suppkey", suppliers,
            CategorySplit("l_linenumber", (1.0, 3.0, 5.0), Leaf(10.0), Leaf(20.0)),
            Split("l_discount", 0.05, Leaf(30.0), CategorySplit("l_linenumber", (2.0,), Leaf(40.0), Leaf(50.0)), missing="right"),
        )
    )
    return to_output(score(with_gaps(spark, sf_dir), model), "l_orderkey", "l_linenumber")


def score_symmetric_trees(spark, sf_dir):
    """Fifty trees of four levels, each a table of sixteen leaves."""
    trees = tuple(
        SymmetricTree(
            (
                ("l_quantity", float(i), False, None),
                ("l_discount", (i % 11) / 100, False, None),
                ("l_tax", (i % 9) / 100, True, "left"),
                ("l_quantity", float(i * 3 % 50), True, None),
            ),
            tuple(float((i * 7 + leaf * 3) % 11) for leaf in range(16)),
        )
        for i in range(50)
    )
    model = Ensemble(trees, (0.5,) * len(trees), 1.0)
    return to_output(score(with_gaps(spark, sf_dir), model), "l_orderkey", "l_linenumber")


#: Three small models as the text that other libraries write.
SPLIT_DUMP = """[
  {"nodeid": 0, "depth": 0, "split": "f0", "split_condition": 25, "yes": 1, "no": 2, "missing": 1, "children": [
    {"nodeid": 1, "depth": 1, "split": "f1", "split_condition": 0.0500000007, "yes": 3, "no": 4, "missing": 4,
     "children": [{"nodeid": 3, "leaf": 1.5}, {"nodeid": 4, "leaf": -2.25}]},
    {"nodeid": 2, "leaf": 4}]},
  {"nodeid": 0, "depth": 0, "split": "f2", "split_condition": 0.0399999991, "yes": 1, "no": 2, "missing": 2, "children": [
    {"nodeid": 1, "leaf": 0.5}, {"nodeid": 2, "leaf": 0.75}]}
]"""
LEAFWISE_TEXT = """tree
version=v4
num_class=1
num_tree_per_iteration=1
objective=regression
feature_names=l_quantity l_discount l_tax l_linenumber

Tree=0
num_leaves=4
num_cat=1
split_feature=0 3 2
threshold=24 0 0.02
decision_type=2 1 10
left_child=1 -1 -3
right_child=2 -2 -4
leaf_value=1 2 4 8
cat_boundaries=0 1
cat_threshold=42
shrinkage=1

end of trees
"""
SYMMETRIC_JSON = """{
  "features_info": {"float_features": [
    {"feature_index": 0, "flat_feature_index": 0, "feature_id": "l_quantity", "nan_value_treatment": "AsIs"},
    {"feature_index": 1, "flat_feature_index": 1, "feature_id": "l_tax", "nan_value_treatment": "AsTrue"}]},
  "oblivious_trees": [{"leaf_values": [1, 2, 4, 8], "splits": [
    {"border": 30.5, "float_feature_index": 0, "split_type": "FloatFeature"},
    {"border": 0.0299999993, "float_feature_index": 1, "split_type": "FloatFeature"}]}],
  "scale_and_bias": [2, [0.5]]
}"""


def score_model_dump(spark, sf_dir):
    """Models written as text by three libraries, read back and compiled to columns."""
    scored = with_gaps(spark, sf_dir)
    kinds = {"split": SPLIT_DUMP, "leafwise": LEAFWISE_TEXT, "symmetric": SYMMETRIC_JSON}
    for name, text in kinds.items():
        path = scratch_path(spark, "dump")
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
        model = load_dump(spark, path, base_score=0.25, features=FEATURES)
        scored = score(scored, model, output=name).drop("null_features")
    return scored.select("l_orderkey", "l_linenumber", *kinds)


def score_stack(spark, sf_dir):
    return _scored_lineitem(spark, sf_dir, STACK)


def _with_gaps(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumns(
        {
            "l_tax": F.nullif("l_tax", F.lit(0.0)),
            "l_discount": F.nullif("l_discount", F.lit(0.1)),
        }
    )


def score_null_features(spark, sf_dir):
    scored = rounded(score(_with_gaps(spark, sf_dir), LINEAR))
    return scored.select(
        "l_orderkey", "l_linenumber", "prediction",
        F.array_join("null_features", "+").alias("null_features"),
    )


def score_drop_null(spark, sf_dir):
    scored = score(_with_gaps(spark, sf_dir), LINEAR, on_null="drop")
    return rounded(to_output(scored, "l_orderkey", "l_linenumber"))


def score_mean_imputed(spark, sf_dir):
    scored = score(_with_gaps(spark, sf_dir), LINEAR, on_null="mean")
    return rounded(to_output(scored, "l_orderkey", "l_linenumber"))


def score_output(spark, sf_dir):
    return in_row_order(scored_events(spark, sf_dir))


def _order_uploads(spark, sf_dir) -> str:
    line = F.concat_ws(",", "o_orderkey", "o_totalprice", "o_orderstatus", "o_custkey")
    return stage_lines(
        table(spark, sf_dir, "orders"), line, "o_totalprice,o_orderstatus,o_custkey", "orders"
    )


def _scored_uploads(spark, sf_dir, model, **options):
    path = _order_uploads(spark, sf_dir)
    scored = score_files(spark, path, model, glob="*.txt", leading_index=True, **options)
    return rounded(to_output(scored.predictions))


def score_uploads(spark, sf_dir):
    """The whole job: CSV uploads to row ids and predictions."""
    return _scored_uploads(spark, sf_dir, ORDER_MODEL)


def score_uploads_python(spark, sf_dir):
    """The same job with a Python model."""
    weights, intercept = dict(ORDER_MODEL.weights), ORDER_MODEL.intercept

    def load():
        return lambda frame: intercept + sum(w * frame[f] for f, w in weights.items())

    return _scored_uploads(spark, sf_dir, PythonModel(list(weights), load))


def score_uploads_pipeline(spark, sf_dir):
    """The same job with a Spark ML pipeline, fitted on the orders themselves."""
    orders = table(spark, sf_dir, "orders").withColumn("label", ORDER_MODEL.column())
    return _scored_uploads(
        spark, sf_dir, fit_pipeline(orders, ORDER_MODEL.features, "label", solver="normal")
    )


def score_uploads_mean(spark, sf_dir):
    """Missing prices get the mean price of their own file."""
    orders = table(spark, sf_dir, "orders")
    price = F.when(F.col("o_orderkey") % 7 == 0, F.lit("NA")).otherwise(F.col("o_totalprice").cast("string"))
    line = F.concat_ws(",", price, "o_custkey", "o_orderkey")
    path = scratch_path(spark, "orders-by-status")
    for status in [r[0] for r in orders.select("o_orderstatus").distinct().collect()]:
        own = orders.where(F.col("o_orderstatus").eqNullSafe(F.lit(status))).coalesce(1)
        stage_lines(own, line, "o_totalprice,o_custkey,o_orderkey", "", f"{path}/{status}")
    model = Linear({"o_totalprice": 1.0, "o_orderkey": 0.0}, 0.0)
    judged = score_files(spark, path, model, glob="*.txt", on_null="mean").judged
    return judged.select(F.col("o_orderkey").cast("long").alias("row_id"), F.round("prediction", 4).alias("prediction"))


def score_stack_pipeline(spark, sf_dir):
    """Spark ML bases under a Spark ML meta model, on a label that follows from the features."""
    lineitem = table(spark, sf_dir, "lineitem").withColumn("label", LINEAR.column())
    solver = {"solver": "normal"}
    bases = {
        "price": ("linear", ["l_quantity", "l_discount", "l_tax"], solver),
        "size": ("linear", ["l_quantity"], solver),
    }
    fitted = fit_stacked_pipeline(lineitem, bases, "label", F.pmod("l_orderkey", F.lit(3)), 3)
    scored = score(lineitem, fitted).withColumn("compiled", compile_pipeline(spark, fitted).column())
    agree = F.abs(F.col("prediction") - F.col("compiled")) < 1e-6
    right = F.abs(F.col("prediction") - F.col("label")) < 1.0
    return scored.agg(F.count("*").alias("n"), F.count_if(agree & right).alias("n_right"))


def score_large_ensemble(spark, sf_dir):
    """More nodes than generated code holds: 600 trees over the quantity, discount and tax."""
    lineitem = table(spark, sf_dir, "lineitem")
    trees = []
    for i in range(600):
        inner = Split("l_discount", (i % 11) / 100, Leaf(float(i % 5)), Leaf(float(i % 3)), strict=True)
        outer = Split("l_tax", (i % 9) / 100, Leaf(1.0), Leaf(2.0), missing="left")
        trees.append(Tree(Split("l_quantity", float(i % 50), inner, outer)))
    model = Ensemble(tuple(trees), (1.0,) * len(trees), 5.0)
    taxed = lineitem.withColumn("l_tax", F.when(F.col("l_linenumber") != 2, F.col("l_tax")))
    return rounded(to_output(score(taxed, model), "l_orderkey", "l_linenumber"))


def python_model(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    weights, intercept = dict(LINEAR.weights), LINEAR.intercept

    def load():
        return lambda frame: intercept + sum(w * frame[f] for f, w in weights.items())

    keys = ("l_orderkey", "l_linenumber")
    return rounded(score_python(lineitem, FEATURES, load, keys=keys))


def model_spec_roundtrip(spark, sf_dir):
    """A model saved as data and loaded again."""
    path = scratch_path(spark, "model")
    save_model(spark, STACK, path)
    return _scored_lineitem(spark, sf_dir, load_model(spark, path))


def model_roundtrip(spark, sf_dir):
    """A fitted Spark ML pipeline saved, loaded and applied."""
    lineitem = table(spark, sf_dir, "lineitem")
    fitted = fit_pipeline(lineitem, ["l_quantity"], "l_extendedprice", solver="normal")
    path = scratch_path(spark, "pipeline")
    save_pipeline(fitted, path)
    scored = score_pipeline(lineitem, load_pipeline(path), ["l_quantity"])
    return rounded(to_output(scored, "l_orderkey", "l_linenumber"), 3)


def model_compiled(spark, sf_dir):
    """Boosted trees as columns against the same trees as a pipeline."""
    lineitem = table(spark, sf_dir, "lineitem")
    fitted = fit_pipeline(
        lineitem, FEATURES, "l_extendedprice", "boosted", maxIter=3, maxDepth=3, seed=1
    )
    both = score_pipeline(lineitem, fitted, FEATURES).withColumn(
        "compiled", compile_pipeline(spark, fitted).column()
    )
    differs = F.abs(F.col("compiled") - F.col("prediction")) > 1e-6
    return both.agg(F.count("compiled").alias("n"), F.count_if(differs).alias("n_different"))


# Training -------------------------------------------------------------------


def _weights(spark, model: Linear) -> DataFrame:
    rows = [("intercept", model.intercept), *model.weights.items()]
    return spark.createDataFrame(rows, "term string, weight double").withColumn(
        "weight", F.round("weight", 6)
    )


def fit_linear_one(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    return _weights(spark, fit_linear(lineitem, ["l_quantity"], "l_extendedprice"))


def fit_linear_two(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    return _weights(spark, fit_linear(lineitem, ["l_quantity", "l_discount"], "l_extendedprice"))


def fit_linear_many(spark, sf_dir):
    """Seventeen features; the label is a known combination of them, so its weights are known."""
    lineitem = table(spark, sf_dir, "lineitem")
    key = F.col("l_orderkey") * 31 + F.col("l_linenumber") * 1009 + F.floor(F.col("l_extendedprice") * 100)
    features = {f"f{i}": F.pmod(key * (2 * i + 1), F.lit(97 + 6 * i)) / (i + 1) for i in range(17)}
    label = F.lit(3.0)
    for i, name in enumerate(features):
        label = label + F.lit(0.5 * (i + 1)) * F.col(name)
    frame = lineitem.select(*[c.cast("double").alias(n) for n, c in features.items()]).withColumn("label", label)
    return _weights(spark, fit_linear(frame, list(features), "label"))


def _fitted_stack(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    fold = F.pmod("l_orderkey", F.lit(5))
    bases = {"by_quantity": ["l_quantity"], "by_discount": ["l_discount"]}
    return lineitem, fit_stack(lineitem, bases, "l_extendedprice", fold, 5, decimals=2)


def fit_stack_oof(spark, sf_dir):
    _, fit = _fitted_stack(spark, sf_dir)
    return _weights(spark, fit.model.meta)


def score_out_of_fold(spark, sf_dir):
    """Base predictions by models that have not seen the row."""
    lineitem, fit = _fitted_stack(spark, sf_dir)
    return lineitem.select(
        "l_orderkey", "l_linenumber",
        fit.out_of_fold("by_quantity").alias("by_quantity"),
        fit.out_of_fold("by_discount").alias("by_discount"),
    )


def eval_metrics(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    scored = rounded(score(lineitem, STACK))
    error = holdout_error(scored, "l_extendedprice")
    return error.select("n", *[F.round(c, 6).alias(c) for c in ("rmse", "mae", "r2")])


# Results --------------------------------------------------------------------


def csv_sink_roundtrip(spark, sf_dir):
    """Written in row order, so a row's place in the files is its row id."""
    events = scored_events(spark, sf_dir)
    path = write_result(
        events, scratch_path(spark, "results"), n_rows=events.count(), format="csv"
    )
    schema = T.StructType(
        [T.StructField("Row Id", T.LongType()), T.StructField("Prediction", T.DoubleType())]
    )
    rows = read_uploads(spark, path, schema, one_numbering=True).rows
    return rows.select(
        F.col("Row Id").alias("row_id"), F.col("Prediction").alias("prediction"),
        F.col("row_id").alias("place_in_files"),
    )


def csv_sink_joined(spark, sf_dir):
    """Parts of bounded size, with one header between them; joined by name, they are one file in row order."""
    events = stored_events(spark, sf_dir)
    path = write_csv_parts(events, scratch_path(spark, "results"), order="row_id", columns=["row_id", "prediction"], max_bytes=1 << 16)
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_size").alias("size"),
    )
    of_file = Window.partitionBy("name").orderBy("start", "at")
    numbered = lines.withColumn("in_file", F.row_number().over(of_file))
    counts = numbered.groupBy("name").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    before = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    starts = counts.withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return numbered.join(starts.drop("n", "size"), "name").select(
        (F.col("earlier") + F.col("in_file") - 2).alias("line_no"),
        F.split_part("value", F.lit(","), F.lit(1)).alias("row_id"),
        F.split_part("value", F.lit(","), F.lit(2)).try_cast("double").alias("prediction"),
        (F.col("size") <= 1 << 16).alias("within_bound"),
    )


def csv_sink_plain_numbers(spark, sf_dir):
    """Predictions of up to eleven digits without an exponent."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), (F.col("o_totalprice") * 100000).alias("prediction")
    )
    path = write_csv(in_row_order(orders), scratch_path(spark, "results"), decimals=6)
    schema = T.StructType(
        [T.StructField("Row Id", T.LongType()), T.StructField("Prediction", T.StringType())]
    )
    rows = read_uploads(spark, path, schema).rows
    return rows.select(F.col("Row Id").alias("row_id"), F.col("Prediction").alias("printed"))


def csv_sink_infinite(spark, sf_dir):
    """Infinite, missing and very large predictions survive the file."""
    orders = table(spark, sf_dir, "orders")
    value = (
        F.when(F.col("o_orderkey") % 5 == 0, F.lit(float("inf")))
        .when(F.col("o_orderkey") % 5 == 1, F.lit(float("-inf")))
        .when(F.col("o_orderkey") % 5 == 2, F.lit(1e300))
        .when(F.col("o_orderkey") % 5 == 3, F.col("o_totalprice"))
    )
    frame = orders.select(F.col("o_orderkey").alias("row_id"), value.alias("prediction"))
    path = write_csv(frame, scratch_path(spark, "csv"), decimals=4)
    schema = T.StructType.fromDDL("`Row Id` bigint, Prediction double")
    return read_uploads(spark, path, schema).rows.select(
        F.col("Row Id").alias("row_id"), F.col("Prediction").alias("prediction")
    )


def page_slice(spark, sf_dir):
    return page(stored_events(spark, sf_dir), 7)


def page_unnumbered(spark, sf_dir):
    """Page 3 of the orders by price, which have no row ids."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return page_in_order(orders, 3, F.desc("o_totalprice"), "o_orderkey")


def pages(spark, sf_dir):
    return page_count(stored_events(spark, sf_dir))


def page_bounds(spark, sf_dir):
    """Where stepping back from the first and on from the last page ends."""
    counted = page_count(stored_events(spark, sf_dir))
    wanted = F.explode(F.array(F.lit(0), F.lit(1), F.col("n_pages"), F.col("n_pages") + 1))
    return counted.select("n_pages", wanted.alias("wanted")).withColumn(
        "shown", clamp_page(F.col("wanted"), F.col("n_pages"))
    )


def page_summaries(spark, sf_dir):
    return page_summary(stored_events(spark, sf_dir))


def result_display(spark, sf_dir):
    return display(stored_events(spark, sf_dir), 10)


def feature_profile(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    entries = [
        ("l_quantity", "Units ordered", "feature"),
        ("l_discount", "Discount rate", "feature"),
        ("l_tax", "Tax rate", "feature"),
        ("l_extendedprice", "Price of the line", "label"),
    ]
    return profile_features(lineitem, catalog(spark, entries), [name for name, _, _ in entries])


# Streams --------------------------------------------------------------------


def stream_score(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    line = F.concat_ws(",", "event_id", "user_id", "value")
    path = stage_lines(events, line, "user_id,value", "events")
    out = scratch_path(spark, "stream")
    query = score_stream(
        spark, path, EVENT_MODEL, out, scratch_path(spark, "stream-state"),
        glob="*.txt", leading_index=True,
    )
    query.awaitTermination()
    return rounded(read_run(spark, out, "scored").select("row_id", "prediction"))


QUERIES = {
    f.__name__: f
    for f in (
        csv_scan_typed, csv_scan_quoted, csv_scan_inferred, csv_scan_types_per_file, csv_odd_header, csv_sink_infinite,
        row_id_text_key, row_id_null_key, csv_bind_by_name, header_dedup, schema_infer, null_tokens,
        utf8_check, ragged_rows, cast_quarantine, leading_index, required_columns, file_admission,
        leading_index_time, leading_index_text, upload_status, status_model_failure, row_id_keyed, row_id_file_order, row_id_per_upload, score_linear, score_tree,
        score_forest, score_category_split, score_symmetric_trees, score_model_dump, score_stack, score_null_features, score_drop_null, score_mean_imputed,
        score_output, score_uploads, score_uploads_python, score_uploads_pipeline, score_uploads_mean,
        score_stack_pipeline, score_large_ensemble, python_model, model_spec_roundtrip, model_roundtrip,
        model_compiled, fit_linear_one, fit_linear_two, fit_linear_many, fit_stack_oof, score_out_of_fold,
        eval_metrics, csv_sink_roundtrip, csv_sink_joined, csv_sink_plain_numbers, page_slice, page_unnumbered, pages,
        page_bounds, page_summaries, result_display, feature_profile, stream_score,
    )
}
