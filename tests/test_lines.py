"""Facts about raw lines against a character-by-character reading of them."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from meterloom.functions.lines import field_count, has_open_quote, is_blank, outside_quotes, split_fields
from meterloom.sources.stitch import states_after


def read(raw, quoted=False):
    """(fields, is a quote open at the end)"""
    fields, state = 1, "quoted" if quoted else "start"
    for c in raw:
        if state == "quoted":
            state = "closing" if c == '"' else "quoted"
        elif c == ",":
            fields, state = fields + 1, "start"
        elif c == '"' and state in ("start", "closing"):
            state = "quoted"
        else:
            state = "plain"
    return fields, state == "quoted"


def random_lines(n, longest, alphabet):
    draw = random.Random(n)
    return ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, longest))) for _ in range(n)]


def test_fields_and_open_quotes(spark):
    lines = random_lines(6000, 12, ['"', '"', '"', ",", ",", "a", "\n", " "])
    outside, inside = outside_quotes(F.col("raw")), outside_quotes(F.concat(F.lit('"'), F.col("raw")))
    facts = (
        spark.createDataFrame([(line,) for line in lines], "raw string")
        .withColumns({"o": outside, "i": inside})
        .select("raw", field_count(F.col("o")), has_open_quote(F.col("o")), has_open_quote(F.col("i")))
    )
    for raw, fields, open_after, open_inside in facts.collect():
        wanted, is_open = read(raw)
        assert open_after == is_open, raw
        assert open_inside == read(raw, quoted=True)[1], raw
        if not is_open:
            assert fields == wanted, raw


def test_long_quoted_field(spark):
    """Many doubled quotes in one field, as in long texts."""
    raw = '1,"' + 'x ""y"", ' * 50_000 + '",2'
    frame = spark.createDataFrame([(raw,)], "raw string").withColumn("o", outside_quotes(F.col("raw")))
    row = frame.select(
        field_count(F.col("o")), has_open_quote(F.col("o")), split_fields(F.col("raw"), 3)
    ).first()
    assert row[0] == 3 and row[1] is False
    assert row[2] == ["1", 'x "y", ' * 50_000, "2"]


def test_blank_lines(spark):
    frame = spark.createDataFrame([(v,) for v in ("", " ", "\t \r", ",", " a", '""')], "raw string")
    assert [r[0] for r in frame.select(is_blank(F.col("raw"))).collect()] == [True] * 3 + [False] * 3


def test_states_after_equals_one_by_one():
    draw = np.random.default_rng(2)
    for size in (1, 2, 5, 40):
        for _ in range(200):
            if_closed, if_open = draw.random(size) < 0.4, draw.random(size) < 0.6
            for start in (False, True):
                state, wanted = start, []
                for c, o in zip(if_closed, if_open):
                    state = o if state else c
                    wanted.append(state)
                assert states_after(if_closed, if_open, start).tolist() == wanted


def test_batches_and_splits_do_not_change_records(spark):
    """The same lines in any batches and splits give the same records."""
    from meterloom.sources import stitch

    content = random_lines(400, 9, ['"', ",", "a", "b", " "]) + ['"', "end"]
    draw = random.Random(9)
    results = set()
    for _ in range(6):
        cuts = sorted(draw.sample(range(1, len(content)), draw.randint(0, 6)))
        splits = [content[a:b] for a, b in zip([0, *cuts], [*cuts, len(content)])]
        lines, facts, state, offset = [], [], False, 0
        for block, part in enumerate(splits):
            before, begun = state, 0
            for raw in part:
                begun += (not state) and raw.strip() != ""
                lines.append(
                    {"source_file": "f", "block_start": block, "raw": raw.encode(),
                     "if_closed": read(raw)[1], "if_open": read(raw, True)[1], "blank": raw.strip() == ""}
                )
                state = read(raw, state)[1]
            facts.append({"starts_open": before, "ends_open": state, "offset": offset, "n": begun})
            offset += begun
        whole = [
            line | facts[line["block_start"]] | {"n_file": offset, "file_open": state} for line in lines
        ]
        at, batches = 0, []
        while at < len(whole):
            size = draw.randint(1, 90)
            batches.append(pa.RecordBatch.from_pylist(whole[at : at + size]))
            at += size
        records = {}
        for out in stitch.join_lines(iter(batches)):
            for r in out.to_pylist():
                records.setdefault((r["record"], r["open_tail"]), []).append(r["raw"])
        results.add(tuple((k, b"\n".join(v)) for k, v in sorted(records.items())))
    assert len(results) == 1
