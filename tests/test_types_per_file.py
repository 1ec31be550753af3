"""Types of each file by itself: VARIANT values, missing columns, gaps, quarantine and empty files."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterloom import read_uploads_typed


def values(typed, column):
    """(file, row id) to (kind, text) of a column."""
    name = F.regexp_extract("source_file", r"([^/]+)\.csv$", 1)
    rows = typed.rows.select(
        name.alias("f"), "row_id", F.schema_of_variant(f"`{column}`").alias("k"),
        F.try_variant_get(f"`{column}`", "$", "string").alias("v"),
    )
    return {(r.f, r.row_id): (r.k, r.v) for r in rows.collect()}


def kinds(typed):
    return {r.source_file.rsplit("/", 1)[1][:-4]: r.types for r in typed.types.collect()}


def test_each_file_has_its_own_types(spark, folder):
    path = folder(
        a="id,x\n1,True\n2,False\n",
        b="x,id\n1.5,n7\nNA,3\n",
        c="id\n1\n\n3\n",
        d="id,x\nNA,4\n,5\n",
        e="id,x\n",
    )
    typed = read_uploads_typed(spark, path)
    assert kinds(typed) == {
        "a": {"id": "long", "x": "boolean"},
        "b": {"id": "string", "x": "double"},
        "c": {"id": "long"},
        "d": {"id": "double", "x": "long"},
    }
    assert values(typed, "id") == {
        ("a", 0): ("BIGINT", "1"), ("a", 1): ("BIGINT", "2"), ("b", 0): ("STRING", "n7"), ("b", 1): ("STRING", "3"),
        ("c", 0): ("BIGINT", "1"), ("c", 1): ("BIGINT", "3"), ("d", 0): (None, None), ("d", 1): (None, None),
    }
    assert values(typed, "x") == {
        ("a", 0): ("BOOLEAN", "true"), ("a", 1): ("BOOLEAN", "false"), ("b", 0): ("DOUBLE", "1.5"), ("b", 1): (None, None),
        ("c", 0): (None, None), ("c", 1): (None, None), ("d", 0): ("BIGINT", "4"), ("d", 1): ("BIGINT", "5"),
    }


def test_bad_rows_do_not_change_types(spark, folder):
    path = folder(a="id,x\n1,2\n3,4,five\n5,6\n", b="id,x\none,2\n")
    typed = read_uploads_typed(spark, path, ["id"])
    assert kinds(typed) == {"a": {"id": "long"}, "b": {"id": "string"}}
    assert [r.reason for r in typed.uploads.quarantine.collect()] == ["long_row"]


def test_names_that_need_quoting_and_a_missing_required_column(spark, folder):
    path = folder(a="my.id,x y\n1,a\n", b="other\n1\n")
    typed = read_uploads_typed(spark, path, required=["my.id"])
    assert kinds(typed) == {"a": {"my.id": "long", "x y": "string"}}
    assert values(typed, "my.id") == {("a", 0): ("BIGINT", "1")}
    assert sorted(r.status for r in typed.uploads.files.collect()) == [200, 422]


@pytest.mark.parametrize("seed", range(2))
def test_types_equal_those_of_pandas_file_by_file(spark, folder, tmp_path, seed):
    rng = random.Random(seed)
    makers = [
        lambda: str(rng.randint(-9, 9)), lambda: f"{rng.uniform(-5, 5):.3f}", lambda: rng.choice(["True", "False"]),
        lambda: rng.choice(["NA", "3"]), lambda: rng.choice(["x", "y 1"]), lambda: "",
    ]
    files = {}
    for i in range(6):
        own = [rng.choice(makers) for _ in range(3)]
        lines = [",".join([str(k), *(m() for m in own)]) for k in range(5)]
        files[f"f{i}"] = "k,p,q,r\n" + "\n".join(lines) + "\n"
    got = kinds(read_uploads_typed(spark, folder(**files)))
    names = {"int64": "long", "float64": "double", "bool": "boolean"}
    for f in files:
        frame = pd.read_csv(tmp_path / f"{f}.csv")
        assert got[f] == {c: names.get(str(t), "string") for c, t in frame.dtypes.items()}, f
