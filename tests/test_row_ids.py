"""Row ids are dense and in file order for any files, splits and partitions."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterloom.operators.rowid import with_row_id
from meterloom.sinks.files import spread_by_place
from meterloom.sources import lines, stitch
from meterloom.sources.uploads import read_uploads

SCHEMA = T.StructType([T.StructField("n", T.LongType()), T.StructField("t", T.StringType())])
SIZES = {"a": 5, "b": 9000, "c": 7, "d": 4000, "e": 1}


@pytest.fixture
def five_files(folder):
    """Files of very different sizes; column n is the row's true number."""
    made, start = {}, 0
    for name, size in SIZES.items():
        made[name] = "n,t\n" + "".join(f"{start + i},{name}\n" for i in range(size))
        start += size
    return folder(**made)


def test_one_numbering(spark, five_files, small_splits):
    small_splits(5000, 100)
    rows = read_uploads(spark, five_files, SCHEMA, one_numbering=True).rows
    assert rows.rdd.getNumPartitions() > 5
    assert rows.count() == sum(SIZES.values())
    assert rows.where("row_id <> n").count() == 0


def test_numbering_per_file(spark, five_files, small_splits):
    small_splits(5000, 100)
    rows = read_uploads(spark, five_files, SCHEMA).rows
    got = rows.groupBy("t").agg(
        F.min("row_id").alias("low"), F.max("row_id").alias("high"),
        F.count_distinct("row_id").alias("ids"), F.count_distinct(F.expr("n - row_id")).alias("shifts"),
    )
    assert {r.t: (r.low, r.high, r.ids, r.shifts) for r in got.collect()} == {
        t: (0, n - 1, n, 1) for t, n in SIZES.items()
    }


@pytest.mark.parametrize("multiline", [False, True])
def test_numbering_without_broadcast(spark, five_files, small_splits, monkeypatch, multiline):
    monkeypatch.setattr(lines, "MAX_BROADCAST_BYTES", 0)
    small_splits(5000, 100)
    rows = read_uploads(spark, five_files, SCHEMA, one_numbering=True, multiline=multiline).rows
    assert "SortMergeJoin" in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == sum(SIZES.values())
    assert rows.where("row_id <> n").count() == 0


@pytest.mark.parametrize("limit", [0, 1 << 30])
def test_line_breaks_keep_their_order(spark, folder, small_splits, monkeypatch, limit):
    """Quoted files whose lookups are broadcast or joined by a shuffle that spills."""
    monkeypatch.setattr(lines, "MAX_BROADCAST_BYTES", limit)
    files = {
        name: "n,t\n" + "".join(f'{i},"a\n{i}"\n' if quoted and i % 3 else f"{i},b\n" for i in range(9000))
        for name, quoted in (("a", True), ("b", False), ("c", True))
    }
    small_splits(20_000)
    uploads = read_uploads(spark, folder(**files), SCHEMA, multiline=True)
    assert uploads.files.where("error_class = 'ok' and n_rows = 9000").count() == 3
    assert uploads.rows.count() == 27_000
    assert uploads.rows.where("row_id <> n").count() == 0


def test_endless_records_end_in_the_report(spark, folder, small_splits, monkeypatch):
    """A stray quote at the top and one at the end would make one record of the whole file."""
    monkeypatch.setattr(lines, "MAX_RECORD_BYTES", 2000)
    bad = 'n,t\n0,"x\n' + "".join(f"{i},y\n" for i in range(1, 900)) + '900,y"\n'
    small_splits(900)
    uploads = read_uploads(spark, folder(bad=bad, good="n,t\n0,z\n"), SCHEMA, multiline=True)
    assert [r.t for r in uploads.rows.collect()] == ["z"]
    assert {r.reason for r in uploads.quarantine.collect()} == {"open_quote"}
    status = {r.source_file[-8:-4]: r for r in uploads.files.collect()}
    assert status["good"].bad_rows == 0 and status["/bad"].bad_rows > 0


def test_line_breaks_in_many_splits(spark, folder, small_splits):
    """Random records, most over several lines, cut into many splits."""
    draw = random.Random(7)
    files, wanted = {}, {}
    for name in "abc":
        texts = [
            "".join(draw.choice(['x', '"', "\n", ",", " ", "é"]) for _ in range(draw.randint(1, 9)))
            for _ in range(400)
        ]
        wanted |= {(name, i): t for i, t in enumerate(texts)}
        quoted = ['"' + t.replace('"', '""') + '"' for t in texts]
        files[name] = "n,t\n" + "".join(f"{i},{q}\n" for i, q in enumerate(quoted))
    small_splits(900)
    rows = read_uploads(spark, folder(**files), SCHEMA, multiline=True).rows.collect()
    got = {(r.source_file[-5], r.row_id): r.t for r in rows}
    assert all(r.row_id == r.n for r in rows)
    assert got == wanted


def test_changed_split_layout_is_noticed(spark, five_files, small_splits):
    small_splits(5000, 100)
    rows = read_uploads(spark, five_files, SCHEMA).rows
    small_splits(2500, 100)
    with pytest.raises(Exception, match="split differently"):
        rows.collect()


@pytest.mark.parametrize("n", [None, 5])
def test_changed_split_layout_is_noticed_when_stitching(n):
    """A split the first scan did not know, or with another number of records."""
    facts = {"starts_open": False, "ends_open": False, "offset": 0, "n": n, "n_file": n, "file_open": False}
    line = {"source_file": "f", "block_start": 0, "raw": b"x", "if_closed": False, "if_open": True, "blank": False}
    schema = pa.schema(
        [("source_file", pa.string()), ("block_start", pa.int64()), ("raw", pa.binary())]
        + [(c, pa.bool_()) for c in ("if_closed", "if_open", "blank", "starts_open", "ends_open", "file_open")]
        + [(c, pa.int64()) for c in ("offset", "n", "n_file")]
    )
    batch = pa.RecordBatch.from_pylist([line | facts] * 3, schema=schema)
    with pytest.raises(RuntimeError, match="split differently"):
        list(stitch.join_lines([batch]))


def test_numbering_does_not_gather_rows(spark, five_files):
    plan = read_uploads(spark, five_files, SCHEMA).rows._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert "Python" not in plan


@pytest.mark.parametrize("buckets", [1, 2, 7])
def test_ids_by_key(spark, buckets):
    keys = list(range(-50, 3000, 3))
    random.Random(1).shuffle(keys)
    frame = spark.createDataFrame([(k,) for k in keys], "k long").repartition(5)
    got = {r.k: r.row_id for r in with_row_id(frame, "k", buckets=buckets).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def test_ids_by_time_and_of_nothing(spark):
    frame = spark.range(100).select(
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 7).alias("at"), "id"
    )
    assert with_row_id(frame, "at").where("row_id <> id").count() == 0
    assert with_row_id(frame.where("id < 0"), "at").count() == 0


def test_ids_lose_no_row(spark):
    """Null, repeated and text keys; a key that half of the rows share is split over ranges."""
    rows = [(None if i % 10 == 0 else "same" if i % 2 else f"k{i:04d}", i) for i in range(1000)]
    frame = spark.createDataFrame(rows, "k string, n int").repartition(3)
    numbered = with_row_id(frame, "k", buckets=8)
    got = sorted((r.row_id, r.k) for r in numbered.collect())
    assert [i for i, _ in got] == list(range(1000))
    assert [k for _, k in got] == sorted((k for k, _ in rows if k), key=str) + [None] * 100
    assert numbered.columns == ["k", "n", "row_id"]


def test_spread_keeps_total_order(spark):
    frame = spark.range(1000).select(F.col("id").alias("row_id")).repartition(7)
    spread = spread_by_place(frame, 1000, place="row_id", rows_per_file=300)
    parts = [[r.row_id for r in p] for p in spread.rdd.glom().collect()]
    assert len(parts) == 4
    assert [i for p in parts for i in p] == list(range(1000))
