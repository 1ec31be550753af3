"""The corpus pipeline against a plain version of its stages."""

import collections

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import brute
import corpus_pipeline
from meterloom.llm import langid, packing, secret_scan


def plain_pipeline(spark, rows, sf_dir):
    """Rows of the last stage, and the documents each stage keeps."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.train(docs, usable=~langid.held_out())
    kept = []
    for r in rows:
        mean = langid.feature_mean(r[1])
        if mean is not None and model.scores(mean[None, :]).max() >= model.reject_below:
            kept.append(r)
    by_text = {}
    for r in kept:
        if r[1] not in by_text or (r[0] is not None and (by_text[r[1]][0] is None or r[0] > by_text[r[1]][0])):
            by_text[r[1]] = r
    exact = sorted(by_text.values(), key=lambda r: (r[0] is None, r[0] or 0))
    classes, _ = brute.near_classes([r[1] for r in exact], 5)
    near = [r for i, r in enumerate(exact) if classes[i] == i]
    clean = []
    for doc, text, *rest in near:
        found = brute.spans(text, secret_scan.KINDS, secret_scan.BASE, secret_scan.SCOPE)
        text = brute.redact(text, found)
        clean.append((doc, text, *rest[:2], len(text)))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = collections.Counter()
    for doc, text, *_ in clean:
        ids, start = [*tokenizer.encode(text, add_special_tokens=False).ids, 2], 0
        for size in packing.piece_lengths(len(ids)):
            packed[(doc, start, size, np.array(ids[start : start + size], "<u4").tobytes(), len(ids))] += 1
            start += size
    return [kept, exact, near, clean], packed


@pytest.mark.parametrize("which", ["unique_dir", "clashing_dir"])
def test_stages(spark, unique_rows, which, request):
    sf_dir = request.getfixturevalue(which)
    wanted, packed = plain_pipeline(spark, unique_rows, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for (name, stage), rows in zip(corpus_pipeline.STAGES, wanted):
        docs = corpus_pipeline.settle(stage(spark, docs, sf_dir), "test")
        assert docs.columns == columns, name
        own = docs.select("doc_id", "text", "lang", "source", "n_chars").collect()
        assert collections.Counter(map(tuple, own)) == collections.Counter(map(tuple, rows)), name
    last = corpus_pipeline.run(spark, sf_dir).collect()
    got = collections.Counter((r.doc_id, r.start, r.length, bytes(r.ids), r.doc_tokens) for r in last)
    assert got == packed
    assert sorted(r.sequence_id for r in last) == list(range(len(last)))
    assert len(wanted[2]) < len(wanted[1]) < len(wanted[0]) < len(unique_rows)


def test_awkward_and_empty_tables(spark, awkward_dir, empty_dir):
    assert corpus_pipeline.run(spark, awkward_dir).count() > 0
    assert corpus_pipeline.run(spark, empty_dir).count() == 0


def test_stage_names():
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    assert corpus_pipeline.ORACLE_SQL is None
