"""Whole runs: sinks, pages, file admission, catalog and streams."""

import os

import pytest
from pyspark.sql import functions as F

from meterloom.functions.models import Linear
from meterloom.operators.catalog import FEATURES, catalog, feature_schema, missing_features, profile_features
from meterloom.operators.paging import clamp_page, display, page, page_count, page_in_order, page_summary
from meterloom.plans.score_files import read_run, run, score_files
from meterloom.session import scratch_path, shared_dir
from meterloom.sinks import files
from meterloom.sinks.files import write_csv, write_result
from meterloom.sources.admission import admit, list_files
from meterloom.sources.uploads import read_headers
from meterloom.streaming.uploads import score_stream

MODEL = Linear({"a": 2.0, "b": 1.0}, 0.5)


def result(spark, n):
    return spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") * 1.5).alias("prediction"))


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 100])
def test_pages_cover_the_result(spark, tmp_path, n):
    path = write_result(result(spark, n), str(tmp_path), n_rows=n)
    stored = spark.read.parquet(path)
    counted = page_count(stored).first()
    assert (counted.n_rows, counted.n_pages) == (n, -(-n // 10))
    pages = [[r.row_id for r in page(stored, p + 1).orderBy("row_id").collect()] for p in range(counted.n_pages)]
    assert [i for p in pages for i in p] == list(range(n))
    assert all(len(p) == 10 for p in pages[:-1])
    assert page(stored, counted.n_pages + 1).isEmpty()
    assert page_summary(stored).count() == counted.n_pages
    assert [r.row_id for r in display(stored, 3).collect()] == list(range(min(3, n)))


def test_page_filter_reaches_the_file(spark, tmp_path):
    stored = spark.read.parquet(write_result(result(spark, 100), str(tmp_path), n_rows=100))
    plan = page(stored, 3)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(row_id,20)" in plan and "LessThan(row_id,30)" in plan


def test_page_without_ids(spark):
    rows = page_in_order(result(spark, 35), 4, F.desc("prediction")).collect()
    assert [r.row_id for r in rows] == [4, 3, 2, 1, 0]


def test_page_bounds(spark):
    shown = lambda wanted, n: spark.range(1).select(clamp_page(F.lit(wanted), F.lit(n))).first()[0]
    assert [shown(w, 3) for w in (0, 1, 2, 3, 4)] == [1, 1, 2, 3, 3]
    assert shown(5, 0) == 1


def test_csv_text(spark, tmp_path):
    frame = spark.createDataFrame([(0, 1e7 + 0.5), (1, None), (2, 0.1)], "row_id long, prediction double")
    folder = write_csv(frame.coalesce(1).orderBy("row_id"), str(tmp_path / "out"), decimals=2)
    text = "".join(open(f"{folder}/{f}").read() for f in sorted(os.listdir(folder)) if f.endswith(".csv"))
    assert text.splitlines() == ["Row Id,Prediction", "0,10000000.50", "1,", "2,0.10"]


@pytest.mark.parametrize("decimals", [None, 2])
def test_csv_keeps_every_number(spark, tmp_path, decimals):
    inf = float("inf")
    values = [inf, -inf, 1e37, -1e300, 0.5, float("nan"), None]
    frame = spark.createDataFrame(list(enumerate(values)), "row_id long, prediction double")
    folder = write_csv(frame.coalesce(1), str(tmp_path / "out"), decimals=decimals)
    text = "".join(open(f"{folder}/{f}").read() for f in sorted(os.listdir(folder)) if f.endswith(".csv"))
    got = [line.split(",")[1] for line in text.splitlines()[1:]]
    assert got[:2] == ["inf", "-inf"] and got[5:] == ["", ""]
    assert [float(v) for v in got[:5]] == values[:5]


def test_ids_past_the_given_count_are_an_error(spark, tmp_path):
    frame = spark.createDataFrame([(0, 1.0), (7, 2.0)], "row_id long, prediction double")
    with pytest.raises(Exception, match="2 rows expected"):
        write_result(frame, str(tmp_path), n_rows=2)


def test_means_belong_to_a_file(spark, folder, tmp_path):
    path = folder(one="a,b\n2,0\n,0\n", two="a,b\n5000,0\n,0\n")
    model = Linear({"a": 1.0, "b": 0.0})
    batch = score_files(spark, path, model, on_null="mean")
    got = {(r.source_file[-7:-4], r.row_id): r.prediction for r in batch.predictions.collect()}
    assert got == {("one", 0): 2.0, ("one", 1): 2.0, ("two", 0): 5000.0, ("two", 1): 5000.0}
    given = score_files(spark, path, model, on_null="mean", means={"a": 7.0, "b": 0.0})
    assert {r.prediction for r in given.predictions.where("row_id = 1").collect()} == {7.0}
    for max_files in (1, 2):
        out, state = (str(tmp_path / f"{n}{max_files}") for n in ("out", "state"))
        score_stream(spark, path, model, out, state, max_files=max_files, on_null="mean").awaitTermination()
        rows = lambda df: sorted(map(tuple, df.collect()))
        assert rows(read_run(spark, out, "scored")) == rows(batch.predictions)
        assert "batch" not in read_run(spark, out, "status").columns


def test_a_file_that_arrives_late_is_left_out(spark, folder, tmp_path, monkeypatch):
    from meterloom.sources import uploads

    path = folder(one="a,b\n1,0\n")
    list_files_ = uploads.list_files

    def then_one_more(*args):
        listed = list_files_(*args)
        (tmp_path / "late.csv").write_text("a,b\n9,0\n")
        return listed

    monkeypatch.setattr(uploads, "list_files", then_one_more)
    scored = score_files(spark, path, MODEL)
    assert [r.error_class for r in scored.files.collect()] == ["ok"]
    assert scored.predictions.count() == 1


def test_missing_ids_come_last(spark, tmp_path):
    frame = spark.createDataFrame([(None, 1.0), (1, 2.0), (0, 3.0)], "row_id long, prediction double")
    for n_rows in (None, 2):
        stored = spark.read.parquet(write_result(frame, str(tmp_path), n_rows=n_rows))
        assert [r.row_id for r in stored.coalesce(1).collect()] == [0, 1, None]


def test_run_writes_predictions_quarantine_and_status(spark, folder, tmp_path):
    path = folder(
        one="b,a,more\n1,10,x\n2,20,y\n", two="a,b\n1,1\nx,1\n1,1,1\n,5\n", three="a\n1\n", four=""
    )
    base = str(tmp_path / "runs")
    first, second = (run(spark, path, MODEL, base) for _ in range(2))
    assert first != second
    predictions = read_run(spark, first, "scored").collect()
    assert sorted((r.source_file[-7:-4], r.row_id, r.prediction) for r in predictions if r.row_id < 3) == [
        ("one", 0, 21.5), ("one", 1, 42.5), ("two", 0, 3.5),
    ]
    assert [r.prediction for r in predictions if r.row_id == 3] == [None]
    bad = read_run(spark, first, "quarantined").orderBy("row_id").collect()
    assert [(r.row_id, r.reason, r["columns"]) for r in bad] == [(1, "bad_value", ["a"]), (2, "long_row", [])]
    status = read_run(spark, first, "status").orderBy("source_file").collect()
    assert [(r.status, r.error_class, r.rows, r.bad_rows) for r in status] == [
        (500, "empty", 0, 0), (200, "ok", 2, 0), (422, "missing_column", 1, 0), (200, "ok", 4, 2),
    ]
    assert [r.extra_columns for r in status] == [[], ["more"], [], []]
    csv = run(spark, path, MODEL, base, format="csv", strict=True)
    lines = [r.value for r in spark.read.text(f"{csv}/csv").collect()]
    assert lines[0] == "source_file,Row Id,Prediction"
    assert [line.rsplit(",", 2)[1:] for line in lines[1:]] == [["0", "21.5"], ["1", "42.5"]]


def test_run_is_in_order_through_all_files(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "ROWS_PER_FILE", 7)
    path = folder(**{f"f{i}": "a,b\n" + "".join(f"{j},{i}\n" for j in range(9)) for i in range(3)})
    made = run(spark, path, MODEL, str(tmp_path / "runs"))
    parts = sorted((tmp_path / "runs").glob("*/rows/outcome=scored/*.parquet"))
    assert len(parts) == 4
    rows = [r for p in parts for r in spark.read.parquet(str(p)).select("place", "row_id").collect()]
    assert [tuple(r) for r in rows] == [(i, i % 9) for i in range(27)]
    assert read_run(spark, made, "quarantined").isEmpty()


@pytest.mark.parametrize("on_null, wanted", [("null", [7.5, None, 4.5]), ("drop", [7.5, 4.5]), ("mean", [7.5, 7.5, 4.5])])
def test_missing_features_in_files(spark, folder, on_null, wanted):
    path = folder(f="a,b\n3,1\n,3\nx,100\n1,2\n")
    scored = score_files(spark, path, MODEL, on_null=on_null)
    assert [r.prediction for r in scored.predictions.orderBy("row_id").collect()] == wanted
    assert [r.row_id for r in scored.quarantine.collect()] == [2]


def test_all_seventeen_features(spark, folder):
    assert len(FEATURES) == 17
    names = [f for f, _, _ in FEATURES]
    model = Linear({n: float(i + 1) for i, n in enumerate(names)})
    content = ",".join(reversed(names)) + "\n" + ",".join(["1"] * 17) + "\n" + "," * 16 + "\n"
    scored = score_files(spark, folder(f=content), model)
    assert [r.prediction for r in scored.predictions.orderBy("row_id").collect()] == [153.0, None]
    assert [f.dataType.simpleString() for f in feature_schema().fields] == ["double"] * 17


def test_catalog_and_missing_features(spark, folder):
    listed = catalog(spark).orderBy("ord").collect()
    assert [r.ord for r in listed] == list(range(1, 18))
    assert (listed[0].feature, listed[16].feature) == ("mels_S", "hvac_total")
    names = [r.feature for r in listed]
    path = folder(full=",".join(names) + "\n", less=",".join(names[2:]) + ",extra\n")
    missing = missing_features(read_headers(spark, path), names).collect()
    assert sorted((r.source_file[-8:-4], r.feature) for r in missing) == [("less", "lig_S"), ("less", "mels_S")]


def test_profile(spark):
    frame = spark.createDataFrame([(1.0, None), (3.0, 5.0)], "a double, b double")
    features = catalog(spark, [("a", "first", "x"), ("b", "second", "x"), ("z", "absent", "x")])
    got = {r.feature: (r.n_rows, r.n_null, r.minimum, r.maximum) for r in profile_features(frame, features, ["a", "b"]).collect()}
    assert got == {"a": (2, 0, 1.0, 3.0), "b": (2, 1, 5.0, 5.0), "z": (None, None, None, None)}


def test_admission(spark, tmp_path):
    for name in ("a.csv", "b.CSV", "c.txt", "d.csv.gz", "e x.csv"):
        (tmp_path / name).write_text("" if name == "e x.csv" else "a\n1\n")
    listed = list_files(spark, str(tmp_path))
    names = lambda df: {r.source_file.rsplit("/", 1)[1] for r in df.where("admitted").collect()}
    assert names(admit(listed)) == {"a.csv", "e%20x.csv"}
    types = listed.where("source_file like '%.txt'").select("source_file", F.lit("text/csv").alias("media_type"))
    assert names(admit(listed, types)) == {"a.csv", "e%20x.csv", "c.txt"}
    assert {r.length for r in listed.collect()} == {0, 4}


def test_stream_equals_batch_and_takes_each_file_once(spark, tmp_path):
    uploads, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    os.mkdir(uploads)
    for i in range(5):
        (tmp_path / "in" / f"f{i}.csv").write_text("a,b\n" + "".join(f"{j},{i}\n" for j in range(10 + i)))
    (tmp_path / "in" / "bad.csv").write_bytes(b"a,b\n\xff,1\n")

    def stream():
        score_stream(spark, uploads, MODEL, out, state, max_files=2).awaitTermination()
        return sorted(map(tuple, read_run(spark, out, "scored").collect()))

    batch = lambda: sorted(map(tuple, score_files(spark, uploads, MODEL).predictions.collect()))
    assert stream() == batch()
    assert read_run(spark, out, "status").where("error_class = 'encoding'").count() == 1
    (tmp_path / "in" / "late.csv").write_text("b,a\n1,2\n")
    assert stream() == batch()
    assert read_run(spark, out, "status").count() == 7


def test_unusual_file_names(spark, tmp_path):
    os.mkdir(tmp_path / "in")
    names = ["my file.csv", "data (1).csv", "data [2].csv", "a{b}.csv", "100%.csv", "x+y&z.csv", "é.csv"]
    for i, name in enumerate(names):
        (tmp_path / "in" / name).write_text(f"a,b\n{i},0\n")
    batch = score_files(spark, str(tmp_path / "in"), MODEL)
    assert batch.files.where("status = 200").count() == len(names)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    score_stream(spark, str(tmp_path / "in"), MODEL, out, state).awaitTermination()
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(read_run(spark, out, "scored")) == rows(batch.predictions)
    assert batch.predictions.count() == len(names)


def test_no_files(spark, tmp_path):
    os.mkdir(tmp_path / "in")
    (tmp_path / "in" / "note.txt").write_text("a,b\n1,2\n")
    for multiline in (False, True):
        scored = score_files(spark, str(tmp_path / "in"), MODEL, multiline=multiline)
        assert scored.predictions.isEmpty() and scored.quarantine.isEmpty() and scored.files.isEmpty()
    made = run(spark, str(tmp_path / "in"), MODEL, str(tmp_path / "runs"), format="csv")
    assert read_run(spark, made, "scored").isEmpty()


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == named
    assert scratch_path(spark, "x").startswith(named)
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
