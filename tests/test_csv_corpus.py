"""CSV edge cases; where pandas accepts a file, its rows are the wanted result."""

import io
import math
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterloom.functions.values import NULL_TOKENS
from meterloom.operators.schema import infer_types
from meterloom.plans.score_files import status_table
from meterloom.sources.uploads import read_headers, read_uploads


def doubles(*names):
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


def strings(*names):
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def rows_of(uploads):
    return [tuple(r)[1:] for r in uploads.rows.drop("place").orderBy("row_id").collect()]


def write_cases(tmp_path, cases):
    """One file per case, so that one job reads them all."""
    for name, content in cases.items():
        data = content if isinstance(content, bytes) else content.encode("utf-8")
        (tmp_path / f"{name.replace(' ', '_')}.csv").write_bytes(data)
    return str(tmp_path)


def case_of(path):
    return path.rsplit("/", 1)[1].removesuffix(".csv").replace("_", " ")


def rows_by_case(uploads, cases):
    """Rows per case, in row order, as dictionaries without the file name."""
    rows = {name: [] for name in cases}
    for row in uploads.rows.orderBy("row_id").collect():
        rows[case_of(row.source_file)].append(row.asDict())
    return rows


def assert_as_pandas(uploads, cases, **options):
    got = rows_by_case(uploads, cases)
    for name, content in cases.items():
        columns = header_of(content)
        mine = [(r["row_id"], *[r[c] for c in columns]) for r in got[name]]
        assert mine == pandas_rows(content, columns, **options), name


def header_of(content):
    data = content if isinstance(content, bytes) else content.encode("utf-8")
    return list(pd.read_csv(io.BytesIO(data), nrows=0).columns)


def all_headers(cases):
    return list(dict.fromkeys(c for content in cases.values() for c in header_of(content)))


def pandas_rows(content, names, **options):
    data = content if isinstance(content, bytes) else content.encode("utf-8")
    frame = pd.read_csv(io.BytesIO(data), encoding="utf-8", **options)
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return [(i, *[plain(v) for v in row]) for i, row in zip(frame.index, frame[names].values.tolist())]


def status_of(uploads):
    return [tuple(r)[1:6] for r in status_table(uploads.files).orderBy("source_file").collect()]


NUMERIC = {
    "plain": "a,b\n1,2\n3,4\n",
    "short row": "a,b\n1\n3,4\n",
    "blank lines": "\n a,b\n\n1,2\n   \n\t\n3,4\n\n".replace(" a", "a"),
    "byte order mark": b"\xef\xbb\xbfa,b\n1,2\n",
    "no final newline": "a,b\n1,2\n3,4",
    "carriage returns": "a,b\r\n1,2\r\n3,4\r\n",
    "old carriage returns": "a,b\r1,2\r3,4\r",
    "spaces in numbers": "a,b\n 2,3 \n1,1\n",
    "exponents": "a,b\n1e3,-2.5E-2\n.5,5.\n",
    "infinity": "a,b\ninf,-inf\nInfinity,1\n",
    "quoted numbers": 'a,b\n"1","2"\n"",4\n',
    "large": "a,b\n9223372036854775808,1\n2,2\n",
    "leading zeros": "a,b\n007,-0\n+1,2\n",
    "columns swapped": "b,a\n1,2\n3,4\n",
    "extra column": "a,x,b\n1,9,2\n",
}


@pytest.mark.parametrize("multiline", [False, True])
def test_numbers_as_pandas(spark, tmp_path, multiline):
    # With line breaks allowed in quotes, only a newline ends a line.
    cases = {k: v for k, v in NUMERIC.items() if not (multiline and k == "old carriage returns")}
    schema = doubles(*all_headers(cases))
    path = write_cases(tmp_path, cases)
    uploads = read_uploads(spark, path, schema, required=[], multiline=multiline)
    assert_as_pandas(uploads, cases, dtype=float, float_precision="round_trip")
    assert uploads.quarantine.count() == 0


TEXT = {
    "doubled quotes": 'a,b\n"q""q","x,y"\nz,"""w"""\n',
    "quote inside a field": 'a,b\n5" pipe,x\n6" a "b",y\n',
    "accents": "a,b\né,ñ\n漢字,🙂\n",
    "space in header": "a, b\n1x,2x\n",
    "spaces kept": "a,b\n x ,  y\n",
    "quoted header": '"a","b"\nx,y\n',
    "close to null": "a,b\nna,-\nNone.,nULL\n",
}


@pytest.mark.parametrize("multiline", [False, True])
def test_text_as_pandas(spark, tmp_path, multiline):
    schema = strings(*all_headers(TEXT))
    path = write_cases(tmp_path, TEXT)
    uploads = read_uploads(spark, path, schema, required=[], multiline=multiline)
    assert_as_pandas(uploads, TEXT, dtype=str)


MULTILINE = {
    "newline in quotes": 'a,b\n"x\ny",1\nz,2\n',
    "blank line in quotes": 'a,b\n"x\n\n  \ny",1\n\nz,2\n',
    "windows newline in quotes": 'a,b\r\n"x\r\ny",1\r\nz,2\r\n',
    "quotes around newline": 'a,b\n"x ""\n"" y",1\n"\n",2\n',
    "header over two lines": '"a\nc",b\nx,1\n',
    "several in a row": 'a,b\n"1\n2","3\n4"\n"5\n6\n7",8\n9,"10\n"\n',
    "quote inside a field": 'a,b\n5" pipe,"x\n5"" y"\n6" z,1\n',
}


@pytest.mark.parametrize("piece", [11, 1000])
def test_line_breaks_as_pandas(spark, tmp_path, small_splits, piece):
    small_splits(piece)
    schema = strings(*all_headers(MULTILINE))
    path = write_cases(tmp_path, MULTILINE)
    uploads = read_uploads(spark, path, schema, required=[], multiline=True)
    assert_as_pandas(uploads, MULTILINE, dtype=str)


def test_null_tokens(spark, tmp_path):
    assert len(NULL_TOKENS) == 19
    cases = {f"t{i}": f"a,b\n{t},1\n2,{t}\n" for i, t in enumerate(NULL_TOKENS)}
    uploads = read_uploads(spark, write_cases(tmp_path, cases), doubles("a", "b"))
    for name, rows in rows_by_case(uploads, cases).items():
        assert [(r["a"], r["b"]) for r in rows] == [(None, 1.0), (2.0, None)], name


LONG = {
    "long row": ("a,b\n1,2\n3,4,5\n", 1),
    "trailing comma, later row": ("a,b\n1,2\n3,4,\n", 1),
    "trailing comma, all rows": ("a,b\n1,2,\n3,4,\n", 2),
    "two extra fields, first empty": ("a,b\n1,2\n3,4,,5\n", 1),
    "quoted comma is no field": ('a,b\n"1,5",2\n3,4\n', 0),
}


def test_long_rows(spark, tmp_path):
    path = write_cases(tmp_path, {k: content for k, (content, _) in LONG.items()})
    wanted = {k: n for k, (_, n) in LONG.items()}
    loose = read_uploads(spark, path, strings("a", "b"))
    status = {case_of(r.source_file): r for r in status_table(loose.files).collect()}
    assert {k: (r.status, r.error_class, r.rows, r.bad_rows) for k, r in status.items()} == {
        k: (200, "ok", 2, n) for k, n in wanted.items()
    }
    bad = [(case_of(r.source_file), r.reason) for r in loose.quarantine.collect()]
    assert sorted(bad) == sorted((k, "long_row") for k, n in wanted.items() for _ in range(n))
    assert loose.rows.count() == 2 * len(LONG) - len(bad)
    strict = read_uploads(spark, path, strings("a", "b"), strict=True)
    assert {case_of(r.source_file): r.error_class for r in strict.files.collect()} == {
        k: "malformed" if n else "ok" for k, n in wanted.items()
    }
    assert strict.rows.count() == sum(2 for n in wanted.values() if n == 0)


def test_ids_keep_their_place_around_quarantined_rows(spark, folder):
    uploads = read_uploads(spark, folder(f="a,b\n1,2\n3,4,5\nx,7\n8,9\n"), doubles("a", "b"))
    assert rows_of(uploads) == [(0, 1.0, 2.0), (3, 8.0, 9.0)]
    bad = uploads.quarantine.orderBy("row_id").collect()
    assert [(r.row_id, r.reason, r["columns"], r.raw) for r in bad] == [
        (1, "long_row", [], "3,4,5"),
        (2, "bad_value", ["a"], "x,7"),
    ]


def test_text_in_a_number_column(spark, folder):
    texts = ["x", "1d", "1f", "1D ", "0x10", "0x1p3", "1_000", "NAN", "t", "1 2", "--1", "1e", "infin"]
    uploads = read_uploads(spark, folder(f="a\n" + "\n".join(texts) + "\n7\n"), doubles("a"))
    assert rows_of(uploads) == [(len(texts), 7.0)]
    bad = uploads.quarantine.orderBy("row_id").collect()
    assert [(r.raw, r["columns"]) for r in bad] == [(t, ["a"]) for t in texts]


def test_booleans_count_as_numbers(spark, folder):
    uploads = read_uploads(spark, folder(f="a,b\nTrue,FALSE\nfalse,TRUE\n"), doubles("a", "b"))
    assert rows_of(uploads) == [(0, 1.0, 0.0), (1, 0.0, 1.0)]


def test_unclosed_quote(spark, folder, small_splits):
    small_splits(13)
    path = folder(f='a,b\n1,2\n"x,2\n3,4\n')
    by_line = read_uploads(spark, path, doubles("a", "b"))
    assert rows_of(by_line) == [(0, 1.0, 2.0), (2, 3.0, 4.0)]
    stitched = read_uploads(spark, path, doubles("a", "b"), multiline=True)
    assert rows_of(stitched) == [(0, 1.0, 2.0)]
    assert {r.raw for r in stitched.quarantine.collect()} == {'"x,2', "3,4"}
    for multiline in (False, True):
        strict = read_uploads(spark, path, doubles("a", "b"), strict=True, multiline=multiline)
        assert [s[:2] for s in status_of(strict)] == [(422, "malformed")]


LEADING = {
    "leading index": "a,b\n10,1,2\n20,3,4\n",
    "trailing comma on all rows": "a,b\n1,2,\n3,4,\n",
    "first row longer": "a,b\n1,2,3\n3,4\n",
    "after a blank line": "a,b\n\n10,1,2\n",
    "not the first row": "a,b\n1,2\n",
}


def test_leading_index_as_pandas(spark, tmp_path):
    path = write_cases(tmp_path, LEADING)
    uploads = read_uploads(spark, path, doubles("a", "b"), leading_index=True)
    assert_as_pandas(uploads, LEADING)


def test_a_longer_row_after_a_leading_index_is_long(spark, folder):
    path = folder(f="a,b\n10,1,2\n20,3,4,5\n")
    uploads = read_uploads(spark, path, doubles("a", "b"), leading_index=True)
    assert rows_of(uploads) == [(10, 1.0, 2.0)]
    assert [r.reason for r in uploads.quarantine.collect()] == ["long_row"]


HEADERS = ["a,a,b", "a,a,a.1,b", "a,a.1,a", "a,a,a", "a,,b,", "a,b,a,b,a", '"x,y",x,"x,y"']


def test_header_names_as_pandas(spark, tmp_path):
    cases = {f"h{i}": header + "\n" for i, header in enumerate(HEADERS)}
    headers = read_headers(spark, write_cases(tmp_path, cases)).collect()
    assert {case_of(r.source_file): r.names for r in headers} == {
        k: header_of(v) for k, v in cases.items()
    }


def test_status_of_every_outcome(spark, folder):
    path = folder(
        a_ok="a,b\n1,2\n",
        b_bytes=b"a,b\n1,\xff\xfe\n2,3,4\n",
        c_empty="",
        d_blank="\n\n",
        e_long="a,b\n1,2,3\n",
        f_missing="a\n1\n",
        g_header="a,b\n",
        h_quote='a,b\n"1,2\n',
    )
    status = status_of(read_uploads(spark, path, doubles("a", "b"), strict=True))
    assert [r[:2] for r in status] == [
        (200, "ok"), (422, "encoding"), (500, "empty"), (500, "empty"),
        (422, "malformed"), (422, "missing_column"), (200, "no_rows"), (422, "malformed"),
    ]


def test_missing_columns_are_named(spark, tmp_path):
    cases = {"a": "b,c\n1,2\n", "b": "a,c\n1,2\n", "c": "a,b\n1,2\n", "none": "c,b,a\n1,2,3\n"}
    path = write_cases(tmp_path, cases)
    uploads = read_uploads(spark, path, doubles("a", "b", "c"))
    detail = "KeyError: {}. Ensure correct columns in your Data!"
    assert status_of(uploads) == [
        *[(422, "missing_column", detail.format(c), 1, 0) for c in "abc"],
        (200, "ok", None, 1, 0),
    ]
    assert rows_of(uploads) == [(0, 3.0, 2.0, 1.0)]
    optional = read_uploads(spark, path, doubles("a", "b", "c"), required=[])
    rows = rows_by_case(optional, cases)
    assert [rows[c][0][c] for c in "abc"] == [None, None, None]


INFERRED = {
    "long": ["1", "2", " 7"],
    "double": ["1", "2.5", "1e3"],
    "boolean": ["True", "false", "TRUE"],
    "string": ["1", "x", "True"],
}


def test_inferred_types(spark):
    frame = spark.createDataFrame(list(zip(*INFERRED.values())), ", ".join(f"{k} string" for k in INFERRED))
    got = {r["column"]: r["type"] for r in infer_types(frame).collect()}
    assert got == {k: k for k in INFERRED}


MORE = {
    "gap": (["1", "", "3"], "double"),
    "nothing": (["", "NA", "null"], "double"),
    "dates": (["2020-01-01", "2020-01-02", ""], "string"),
    "large": (["9223372036854775808", "1", "2"], "double"),
    "point": (["1.0", "2", "3"], "double"),
    "both": (["1", "True", "2"], "string"),
    "zeros": (["007", "-0", "+1"], "long"),
}


def test_more_inferred_types(spark):
    values = list(zip(*[v for v, _ in MORE.values()]))
    frame = spark.createDataFrame(values, ", ".join(f"{k} string" for k in MORE))
    got = {r["column"]: r["type"] for r in infer_types(frame).collect()}
    assert got == {k: wanted for k, (_, wanted) in MORE.items()}


def test_packed_lines_have_a_header_a_file(spark, tmp_path):
    """Files of bounded rows, packed; all rows come back."""
    import glob

    from meterloom.plans.staging import stage_lines
    from meterloom.sources.uploads import read_uploads

    rows = spark.range(0, 250, 1, 3).selectExpr("id", "id * 2 as twice")
    line = F.concat(F.lit("," * 500), F.concat_ws(",", "id", "twice"))
    header = ",".join(["x"] * 500 + ["id", "twice"])
    path = stage_lines(rows, line, header, "", str(tmp_path / "wide"), packed_rows=20)
    files = glob.glob(f"{path}/part-*.gz")
    assert len(files) >= 13 and sum(map(os.path.getsize, files)) < 250 * 500 / 10
    schema = T.StructType.fromDDL("id bigint, twice bigint")
    got = read_uploads(spark, path, schema, glob="part-*").rows
    assert sorted(tuple(r) for r in got.select("id", "twice").collect()) == [(i, 2 * i) for i in range(250)]
    assert got.agg(F.max("row_id")).first()[0] == 19


@pytest.mark.parametrize("n", [2, 11, 60])
def test_parse_of_many_columns_is_no_long_method(spark, tmp_path, n):
    """The JVM only interprets methods of more than 8,000 bytes."""
    import re

    from meterloom.sources.uploads import read_uploads

    names = [f"c{i}" for i in range(n)]
    (tmp_path / "a.csv").write_text(",".join(names) + "\n" + ",".join(str(i) for i in range(n)) + "\n")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    rows = read_uploads(spark, str(tmp_path), schema).rows
    assert rows.select(names).first() == tuple(str(i) for i in range(n))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # adaptive plans show no code
    try:
        text = spark._jvm.PythonSQLUtils.explainString(rows.select(names)._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", text))) < 8000
