"""Fill-in-the-middle: words of eight bytes against plain regular expressions."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meterloom.llm import infill
from meterloom.llm.queries import QUERIES

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def plain_version(doc, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc, n, "plain", None, None, sha(text), sha(text)
    if h4 % 100 < 20:
        return doc, n, "spm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}"), sha(text)
    return doc, n, "psm", len(p), len(m), sha(f"<P>{p}<S>{s}<M>{m}"), sha(text)


TEXTS = st.lists(st.text(alphabet="abzAZ@[`{09 \n\x00éß한😀\u007f\u0080�<PSM>", max_size=40), min_size=1, max_size=8)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_units(texts):
    raw = [t.encode() for t in texts]
    units = infill.Units(raw)
    found = [UNIT.findall(t) for t in texts]
    assert units.counts.tolist() == [len(f) for f in found]
    for k in range(max(map(len, found)) + 1):
        wanted = [len("".join(f[:k]).encode()) for f in found]
        assert units.place(np.array([min(k, len(f)) for f in found])).tolist() == wanted


def test_each_byte_pair():
    for a in range(128):
        text = "".join(chr(a) + chr(b) for b in range(128))
        assert infill.Units([text.encode()]).counts.tolist() == [len(UNIT.findall(text))]


def test_op11(spark, awkward_dir, rows):
    got = sorted(map(tuple, QUERIES["op11_swar_infill"](spark, awkward_dir).collect()), key=repr)
    assert got == sorted((plain_version(doc, text) for doc, text, *_ in rows), key=repr)


def test_markers_and_edges(spark):
    texts = ["a <P> b", "<S", "<<<>>> <P <S M> P> S>", "<M>", "x" * 100_000, "é" * 50_001, "\x00\x00", "a\x00b", " "] * 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    made = infill.transform(docs)
    made = made.withColumn("back", infill.restore(made.output, made.form)).collect()
    assert {r.form for r in made} == {"plain", "psm", "spm"}
    for r in made:
        wanted = plain_version(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, sha(r.output)) == (wanted[1], wanted[2], wanted[5])
        assert r.back == texts[r.doc_id] == r.text
        if r.form != "plain":
            assert r.prefix + r.middle + r.suffix == r.text


def test_python_gets_each_text_once(spark, awkward_dir):
    plan = QUERIES["op11_swar_infill"](spark, awkward_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


@pytest.mark.parametrize("seed", [1, 7])
def test_seed_decides(spark, seed):
    docs = spark.createDataFrame([(i, "one two three four five") for i in range(200)], "doc_id bigint, text string")
    forms = [r.form for r in infill.transform(docs, seed=seed).orderBy("doc_id").collect()]
    other = [r.form for r in infill.transform(docs, seed=8 - seed).orderBy("doc_id").collect()]
    assert forms != other and 5 < forms.count("plain") < 40 and 15 < forms.count("spm") < 65
