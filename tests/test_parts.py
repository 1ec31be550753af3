"""CSV parts that join to one file, wide lines of which little is wanted, and inputs computed once."""

import glob
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterloom import Linear
from meterloom.functions.sums import product_sums
from meterloom.plans.score_files import run
from meterloom.sinks.files import write_csv, write_csv_parts
from meterloom.sources.uploads import read_uploads


def joined(path):
    parts = sorted(glob.glob(f"{path}/part-*"))
    return b"".join(open(p, "rb").read() for p in parts), [os.path.getsize(p) for p in parts]


def frame(spark, n):
    text = F.when(F.col("id") % 5 == 0, F.lit('a,"b"\nc')).when(F.col("id") % 7 == 0, F.lit(" ")).otherwise(F.repeat(F.lit("é"), (F.col("id") % 40).cast("int")))
    number = F.when(F.col("id") % 6 == 0, F.lit(float("inf"))).when(F.col("id") % 4 != 0, F.col("id") / 3)
    return spark.range(n).select(F.col("id").alias("place"), text.alias("text"), number.alias("prediction")).repartition(5)


@pytest.mark.parametrize(("n", "bound"), [(0, 100), (1, 100), (700, 1000), (700, 313), (700, 10**6)])
def test_joined_parts_are_one_file(spark, tmp_path, n, bound):
    df = frame(spark, n)
    whole = write_csv(df.coalesce(1).sortWithinPartitions("place").drop("place"), str(tmp_path / "whole"))
    write_csv_parts(df, str(tmp_path / "parts"), max_bytes=bound)
    bytes_, sizes = joined(tmp_path / "parts")
    wanted = joined(whole)[0] if n else b"text,Prediction\n"
    assert bytes_ == wanted
    assert max(sizes) <= bound and len(sizes) <= 4 * len(bytes_) / bound + 2


def test_gaps_in_the_order_and_lines_above_the_bound(spark, tmp_path):
    df = spark.createDataFrame([(10**9 * i, "x" * (50 if i % 3 else 500)) for i in range(20)], "place bigint, t string")
    write_csv_parts(df, str(tmp_path / "parts"), max_bytes=120)
    bytes_, sizes = joined(tmp_path / "parts")
    assert bytes_.decode().split("\n")[1:-1] == [r.t for r in df.orderBy("place").collect()]
    assert all(s <= 120 or s % 501 < 120 for s in sizes)


def test_run_with_joined_parts(spark, folder, tmp_path):
    path = folder(a="x\n1\nbad\n2\n", b="x\n3\n")
    out = run(spark, path, Linear({"x": 1.0}), str(tmp_path / "out"), format="joined csv")
    lines = joined(f"{out}/csv")[0].decode().splitlines()
    assert lines[0] == "source_file,Row Id,Prediction"
    assert [x.split(",")[1:] for x in lines[1:]] == [["0", "1.0"], ["2", "2.0"], ["0", "3.0"]]
    with pytest.raises(ValueError, match="typed index"):
        run(spark, path, Linear({"x": 1.0}), str(tmp_path / "out"), format="joined csv", leading_index="date")


def test_few_fields_of_wide_lines(spark, folder):
    names = [f"c{i}" for i in range(300)]
    plain = [",".join(f"{r}{i:03}" for i in range(300)) for r in range(1, 4)]
    short, long = ",".join(["7"] * 150), ",".join(["8"] * 301)
    quoted = ",".join(f'"{i},9"' if i == 5 else str(i) for i in range(300))
    path = folder(a="\n".join([",".join(names), *plain, short, long, quoted, "," * 299]))
    schema = T.StructType.fromDDL("c299 double, c0 double, c149 double, c150 double, c5 string")
    uploads = read_uploads(spark, path, schema)
    rows = [tuple(r)[2:-1] for r in uploads.rows.orderBy("row_id").collect()]
    assert rows == [
        *[(r * 1000.0 + 299, r * 1000.0, r * 1000.0 + 149, r * 1000.0 + 150, f"{r}005") for r in range(1, 4)],
        (None, 7.0, 7.0, None, "7"),
        (299.0, 0.0, 149.0, 150.0, "5,9"),
        (None,) * 5,
    ]
    assert [r.reason for r in uploads.quarantine.collect()] == ["long_row"]


def test_wide_lines_with_an_index(spark, folder):
    names = [f"c{i}" for i in range(100)]
    path = folder(a=",".join(names) + "\n" + "\n".join(f"k{r}," + ",".join([str(r)] * 100) for r in range(3)) + "\n")
    uploads = read_uploads(spark, path, T.StructType.fromDDL("c99 double"), leading_index="string")
    assert [(r.row_key, r.c99) for r in uploads.rows.orderBy("row_id").collect()] == [("k0", 0.0), ("k1", 1.0), ("k2", 2.0)]


def test_sums_compute_their_input_once_a_pass(spark):
    counted = spark.sparkContext.accumulator(0)

    def count(x):
        counted.add(1)
        return float(x)

    slow = F.udf(count, "double")
    df = spark.range(50).select(slow("id").alias("x"), F.lit(2.0).alias("y"))
    assert product_sums(df, ["x", "y"])[0][("x", "y")] == 2450
    assert counted.value == 100
