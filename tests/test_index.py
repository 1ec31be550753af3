"""Leading index columns of any type: typed keys, their order, and values that do not fit."""

import datetime as dt

import pytest
from pyspark.sql import types as T

from meterloom import Linear
from meterloom.plans.score_files import read_run, run
from meterloom.sources.uploads import read_uploads
from meterloom.streaming.uploads import score_stream

X = T.StructType([T.StructField("x", T.DoubleType())])
MODEL = Linear({"x": 2.0}, 1.0)


def name(path):
    return path.rsplit("/", 1)[1].removesuffix(".csv")


def read(spark, path, index, **options):
    uploads = read_uploads(spark, path, X, leading_index=index, **options)
    rows = [(r.row_key, r.row_id, r.x) for r in uploads.rows.orderBy("place").collect()]
    return rows, [(r.row_id, r.reason, r.raw) for r in uploads.quarantine.orderBy("row_id").collect()]


@pytest.mark.parametrize(
    ("kind", "values", "wanted", "unfit"),
    [
        ("string", ["b", "NA", "1", "x y"], ["b", None, "1", "x y"], []),
        ("bigint", ["7", "", "x", "1.5", "-3"], [7, None, -3], ["x", "1.5"]),
        ("double", ["7", "1e3", "one", "inf"], [7.0, 1000.0, float("inf")], ["one"]),
        ("boolean", ["True", "false", "1"], [True, False], ["1"]),
        ("date", ["2020-01-31", "2020-02-31", "null"], [dt.date(2020, 1, 31), None], ["2020-02-31"]),
        (
            "timestamp",
            ["2020-01-01", "2020-01-01 10:30:00.25", "10 o'clock"],
            [dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 1, 10, 30, 0, 250000)],
            ["10 o'clock"],
        ),
        (T.IntegerType(), ["1", "3000000000"], [1], ["3000000000"]),
    ],
)
def test_types(spark, folder, kind, values, wanted, unfit):
    path = folder(a="x\n" + "".join(f"{v},{i}\n" for i, v in enumerate(values)))
    rows, bad = read(spark, path, kind)
    assert [r[0] for r in rows] == wanted
    assert [r[1:] for r in rows] == [(i, float(i)) for i, v in enumerate(values) if v not in unfit]
    assert [(reason, raw.split(",")[0]) for _, reason, raw in bad] == [("bad_index", v) for v in unfit]


def test_several_columns(spark, folder):
    path = folder(a='x\n"main, north",3,1.5\n"south ""B""",,2.5\neast,z,3.5\n', b="x\n4.5\n", c="x\n1,2,3,4\n")
    rows, bad = read(spark, path, "building string, hour int")
    assert rows == [(("main, north", 3), 0, 1.5), (('south "B"', None), 1, 2.5), (None, 0, 4.5)]
    assert [(r, raw) for _, r, raw in bad] == [("long_row", "1,2,3,4"), ("bad_index", "east,z,3.5")]


def test_whole_number_ids_are_never_null_without_a_reason(spark, folder):
    path = folder(a="x\n2020-01-01,1\n12,2\n,3\n4.5,4\n")
    uploads = read_uploads(spark, path, X, leading_index=True)
    assert [(r.row_id, r.x) for r in uploads.rows.collect()] == [(12, 2.0)]
    assert [r.reason for r in uploads.quarantine.collect()] == ["bad_index"] * 3


def test_run_is_ordered_by_the_key(spark, folder, tmp_path):
    days = ["2020-03-01", "", "2020-01-01", "2020-02-01", "never", "2020-01-01"]
    path = folder(
        a="x\n" + "".join(f"{d},{i}\n" for i, d in enumerate(days)), b="x\n2019-01-01,9\n", c="x\n8\n7\n"
    )
    out = run(spark, path, MODEL, str(tmp_path / "out"), leading_index="date", format="csv")
    day = lambda m: dt.date(2020, m, 1)
    scored = [(name(r.source_file), r.row_key, r.prediction) for r in read_run(spark, out, "scored").collect()]
    assert scored == [
        ("a", day(1), 5.0), ("a", day(1), 11.0), ("a", day(2), 7.0), ("a", day(3), 1.0), ("a", None, 3.0),
        ("b", dt.date(2019, 1, 1), 19.0), ("c", None, 17.0), ("c", None, 15.0),
    ]
    assert read_run(spark, out, "scored").columns == ["source_file", "row_id", "row_key", "prediction"]
    assert [(r.row_id, r.reason) for r in read_run(spark, out, "quarantined").collect()] == [(4, "bad_index")]
    status = {name(r.source_file): (r.rows, r.bad_rows) for r in read_run(spark, out, "status").collect()}
    assert status == {"a": (6, 1), "b": (1, 0), "c": (2, 0)}
    lines = [r.value for r in spark.read.text(f"{out}/csv").collect()]
    assert lines[0] == "source_file,Row Id,Prediction" and [x.split(",")[1] for x in lines[1:]] == [
        "2020-01-01", "2020-01-01", "2020-02-01", "2020-03-01", "", "2019-01-01", "", ""
    ]


def test_order_over_many_files_of_output(spark, folder, tmp_path, monkeypatch):
    from meterloom.sinks import files

    monkeypatch.setattr(files, "ROWS_PER_FILE", 20)
    path = folder(**{f"f{k}": "x\n" + "".join(f"k{(i * 37) % 100:02},{i}\n" for i in range(100)) for k in range(2)})
    out = run(spark, path, MODEL, str(tmp_path / "out"), leading_index="string")
    rows = spark.read.parquet(f"{out}/rows").selectExpr("_metadata.file_name AS part", "source_file", "row_key").collect()
    assert len({r.part for r in rows}) > 3
    in_order = [(r.source_file, r.row_key) for r in sorted(rows, key=lambda r: r.part)]
    assert in_order == sorted(in_order) and len(in_order) == 200


def test_struct_key_round_trip_and_stream(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for step in range(2):
        (source / f"s{step}.csv").write_text(f"x\nb,2,{step}\na,1,{step}\n")
        score_stream(
            spark, str(source), MODEL, out, str(tmp_path / "check"), leading_index="building string, hour int"
        ).awaitTermination()
    rows = {(name(r.source_file), tuple(r.row_key), r.prediction) for r in read_run(spark, out, "scored").collect()}
    assert rows == {(f"s{k}", key, 2.0 * k + 1) for k in range(2) for key in (("a", 1), ("b", 2))}


def test_quoted_line_breaks_in_the_index(spark, folder):
    path = folder(a='x\n"line\nbreak",1\nplain,2\n')
    assert read(spark, path, "string", multiline=True)[0] == [("line\nbreak", 0, 1.0), ("plain", 1, 2.0)]
