"""Files on which a whole batch fails are found and set aside; batches bounded by bytes."""

import os

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException

from meterloom import Linear
from meterloom.operators.pymodel import PythonModel
from meterloom.plans.score_files import read_run
from meterloom.streaming.uploads import failing, score_stream


def name(path):
    return path.rsplit("/", 1)[1].removesuffix(".csv")


def ending_worker():
    """A model that ends its Python worker on a 9, which no error report outlives."""

    def load():
        def predict(frame):
            if (frame["x"] == 9).any():
                os._exit(1)
            return np.asarray(frame["x"], float)

        return predict

    return PythonModel(["x"], load)


def write(source, **files):
    source.mkdir(exist_ok=True)
    for n, values in files.items():
        (source / f"{n}.csv").write_text("x\n" + "".join(f"{v}\n" for v in values))


def test_failing_files_are_found_by_halving():
    bad = {"f3", "f4", "f9"}
    tried = []

    def attempt(paths):
        tried.append(paths)
        if bad & set(paths):
            raise ValueError(" ".join(sorted(bad & set(paths))))

    paths = [f"f{i}" for i in range(16)]
    assert failing(paths, attempt) == {b: b for b in sorted(bad)}
    assert len(tried) < 2 * len(paths)
    assert failing(["f1"], attempt) == {}


def test_a_file_that_ends_the_worker_is_set_aside(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    write(source, a=[1, 2], b=[9], c=[3])

    def stream():
        score_stream(spark, str(source), ending_worker(), out, str(tmp_path / "check"), attempts=2).awaitTermination()

    with pytest.raises(StreamingQueryException):
        stream()
    stream()
    write(source, d=[4])
    stream()
    status = {name(r.source_file): (r.status, r.error_class, r.rows) for r in read_run(spark, out, "status").collect()}
    assert status == {"a": (200, "ok", 2), "b": (500, "set_aside", 0), "c": (200, "ok", 1), "d": (200, "ok", 1)}
    scored = sorted((name(r.source_file), r.row_id, r.prediction) for r in read_run(spark, out, "scored").collect())
    assert scored == [("a", 0, 1.0), ("a", 1, 2.0), ("c", 0, 3.0), ("d", 0, 4.0)]
    paths = [r.source_file for r in read_run(spark, out, "status").collect()]
    assert len({p.rsplit("/", 1)[0] for p in paths}) == 1


def test_a_batch_of_one_failing_file(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    write(source, **{"b %": [9]})
    score_stream(spark, str(source), ending_worker(), out, str(tmp_path / "check"), attempts=1).awaitTermination()
    status = [(name(r.source_file), r.status, r.error_class) for r in read_run(spark, out, "status").collect()]
    assert status == [("b%20%25", 500, "set_aside")]  # as all tables name it
    assert read_run(spark, out, "scored").count() == 0


def test_several_files_that_all_fail_end_the_stream(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    write(source, a=[9], b=[9])
    with pytest.raises(StreamingQueryException):
        score_stream(spark, str(source), ending_worker(), out, str(tmp_path / "check"), attempts=1).awaitTermination()


def test_batches_bounded_by_bytes(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    write(source, **{f"f{i}": [i] * 50 for i in range(4)})
    size = (source / "f0.csv").stat().st_size
    model = Linear({"x": 2.0}, 1.0)
    score_stream(spark, str(source), model, str(out), str(tmp_path / "check"), max_bytes=2 * size).awaitTermination()
    assert len([p for p in os.listdir(out / "status") if p.startswith("batch=")]) == 2
    assert read_run(spark, str(out), "scored").count() == 200
