"""A file that cannot be scored fails alone, with its error as its status."""

import numpy as np
import pandas as pd
import pytest

from meterloom.operators.pymodel import PythonModel, error_class
from meterloom.plans.score_files import read_run, run, score_files, status_table
from meterloom.streaming.uploads import score_stream


def by_first_value(actions):
    """A model whose behaviour the first row's `x` chooses; each file here has one `x`."""

    def load():
        def predict(frame):
            return actions[int(frame["x"].iloc[0])](frame)

        return predict

    return PythonModel(["x"], load)


def raising(error):
    def action(frame):
        raise error

    return action


ACTIONS = {
    1: lambda f: f["x"] * 2,
    2: raising(ValueError("no such building")),
    3: lambda f: np.zeros(len(f) + 1),
    4: lambda f: np.zeros((len(f), 1)),
    5: lambda f: ["many"] * len(f),
    6: raising(KeyError("rtuFan")),
    7: lambda f: b"\xff".decode("utf-8"),
    8: raising(pd.errors.ParserError("odd")),
    9: lambda f: 3.0,
    10: lambda f: f["x"].mask(f["x"] > 0),  # NaN is no error
}
WANTED = {
    1: (200, "ok", None),
    2: (500, "model", "no such building"),
    3: (500, "model", "All arrays must be of the same length"),
    4: (500, "model", "Per-column arrays must each be 1-dimensional"),
    5: (500, "model", "could not convert string to float"),
    6: (422, "missing_column", "KeyError: 'rtuFan'. Ensure correct columns in your Data!"),
    7: (422, "encoding", "Error Parsing File. Please Upload a Valid CSV File!"),
    8: (422, "malformed", "Error parsing CSV file. Upload a valid CSV file with valid columns"),
    9: (500, "model", "Per-column arrays must each be 1-dimensional"),
    10: (200, "ok", None),
}


def name(path):
    return path.rsplit("/", 1)[1].removesuffix(".csv")


def test_every_kind_of_failure(spark, folder, tmp_path):
    path = folder(**{f"f{k:02}": "x\n" + f"{k}\n" * (k + 3) for k in ACTIONS})
    out = run(spark, path, by_first_value(ACTIONS), str(tmp_path / "out"))
    status = {name(r.source_file): r for r in read_run(spark, out, "status").collect()}
    for k, (code, kind, detail) in WANTED.items():
        r = status[f"f{k:02}"]
        assert (r.status, r.error_class, r.rows) == (code, kind, k + 3)
        assert r.detail == detail or (k == 5 and r.detail.startswith(detail))
    scored = read_run(spark, out, "scored").collect()
    assert {(name(r.source_file), r.row_id, r.prediction) for r in scored} == {
        *[("f01", i, 2.0) for i in range(4)], *[("f10", i, None) for i in range(13)]
    }
    assert len(scored) == 17
    assert read_run(spark, out, "quarantined").count() == 0


def test_failed_file_leaves_no_rows_however_it_is_cut(spark, folder, tmp_path, small_splits):
    """Only one row of many fails; rows scored in other batches and tasks leave too. The first error stays."""

    def load():
        def predict(frame):
            late = frame["x"] >= 900
            if late.any():
                raise ValueError(f"row {int(frame['x'][late].iloc[0])}")
            return frame["x"]

        return predict

    small_splits(600)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        good = "x\n" + "\n".join(map(str, range(500)))
        bad = "x\n" + "\n".join(map(str, range(1000))) + "\nabc\n"
        path = folder(a=good, b=bad, c=good)
        out = run(spark, path, PythonModel(["x"], load), str(tmp_path / "out"), format="csv")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    status = {name(r.source_file): (r.status, r.detail, r.bad_rows) for r in read_run(spark, out, "status").collect()}
    assert status == {"a": (200, None, 0), "b": (500, "row 900", 0), "c": (200, None, 0)}
    assert {name(r.source_file) for r in read_run(spark, out, "scored").collect()} == {"a", "c"}
    assert read_run(spark, out, "scored").count() == 1000 and read_run(spark, out, "quarantined").count() == 0
    exported = spark.read.option("header", True).csv(f"{out}/csv")
    assert exported.count() == 1000


def test_files_of_one_batch_do_not_mix(spark, folder):
    """Whole-frame models see the rows of one file only."""

    def load():
        return lambda frame: frame["x"] - frame["x"].mean()

    path = folder(a="x\n1\n3\n", b="x\n10\n30\n")
    got = score_files(spark, path, PythonModel(["x"], load)).predictions.collect()
    assert {(name(r.source_file), r.row_id): r.prediction for r in got} == {
        ("a", 0): -1.0, ("a", 1): 1.0, ("b", 0): -10.0, ("b", 1): 10.0
    }


def test_model_that_cannot_be_loaded(spark, folder):
    def load():
        raise FileNotFoundError("models/stack.joblib")

    scored = score_files(spark, folder(a="x\n1\n", b="x\n2\n", c="y\n2\n"), PythonModel(["x"], load))
    status = {name(r.source_file): (r.status, r.detail) for r in status_table(scored.files).collect()}
    assert status["a"] == status["b"] == (500, "models/stack.joblib") and status["c"][0] == 422
    assert scored.judged.count() == 0


@pytest.mark.parametrize("on_null", ["null", "drop", "mean"])
def test_quarantined_rows_are_not_handed_over(spark, folder, on_null):
    def load():
        def predict(frame):
            if frame["x"].isna().any() or (frame["y"] == 7).any():
                raise ValueError("a quarantined row")
            return frame["x"]

        return predict

    path = folder(a="x,y\n1,2\nabc,7\n3,4\n5,6,7\n")
    scored = score_files(spark, path, PythonModel(["x", "y"], load, takes_missing=True), on_null=on_null)
    assert [r.prediction for r in scored.predictions.orderBy("row_id").collect()] == [1.0, 3.0]
    assert {r.reason for r in scored.quarantine.collect()} == {"bad_value", "long_row"}


def test_stream_goes_on_after_a_failure(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    model = by_first_value(ACTIONS)
    for step, k in enumerate((1, 2, 1)):
        (source / f"s{step}.csv").write_text("x\n" + f"{k}\n" * 2)
        score_stream(spark, str(source), model, out, str(tmp_path / "check")).awaitTermination()
    status = {name(r.source_file): r.status for r in read_run(spark, out, "status").collect()}
    assert status == {"s0": 200, "s1": 500, "s2": 200}
    assert sorted(name(r.source_file) for r in read_run(spark, out, "scored").collect()) == ["s0"] * 2 + ["s2"] * 2


def test_error_classes():
    assert error_class(KeyError("a")) == "missing_column"
    assert error_class(IndexError("a")) == "model"
    assert error_class(MemoryError()) == "model"
