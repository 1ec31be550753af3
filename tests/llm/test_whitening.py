"""Whitening against a plain eigen decomposition, and its exact sums against whole numbers."""

from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meterloom.llm import whitening
from meterloom.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<double>, label int"


@pytest.fixture
def run(spark, tmp_path):
    def result(rows, schema=SCHEMA, **extra):
        df = spark.createDataFrame(rows, schema).withColumns({k: F.lit(v) for k, v in extra.items()})
        df.repartition(5).write.parquet(f"{tmp_path}/{len(list(tmp_path.iterdir()))}/embeddings.parquet")
        return QUERIES["op12_spectrum_whitening"](spark, f"{tmp_path}/{len(list(tmp_path.iterdir())) - 1}").collect()

    return result


def plain(vectors, components=32):
    """x, deviations, eigenvalues and whitened entries, up to the signs of components."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    away = [[n * c - s for c, s in zip(v, sums)] for v in x]
    centred = np.array([[float(Fraction(a, n)) for a in v] for v in away])
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    values, vecs = values[order], vecs[:, order]
    return [sum(a * a for a in v) for v in away], values, centred @ vecs / np.sqrt(values), centred.var(axis=0).sum()


def check(got, ids, vectors):
    deviations, values, whitened, trace = plain(vectors)
    k = len(values)
    rows = sorted(got, key=lambda r: (r.vec_id, r.component))
    assert [(r.vec_id, r.component) for r in rows] == [(i, c) for i in sorted(ids) for c in range(1, k + 1)]
    order = np.argsort(ids)
    mine = np.array([r.whitened for r in rows]).reshape(len(ids), k)
    theirs = whitened[order]
    signs = np.sign((mine * theirs).sum(axis=0))
    assert np.abs(mine - theirs * signs).max() < 1e-6
    assert np.abs(mine.T @ mine / len(ids) - np.eye(k)).max() < 1e-4
    assert [r.deviation for r in rows[::k]] == [deviations[i] for i in order]
    assert {r.n for r in rows} == {len(ids)}
    assert np.allclose([r.explained for r in rows[:k]], values / trace, rtol=1e-9)
    assert len({r.identity_error for r in rows}) == 1 and 0 <= rows[0].identity_error < 1e-9


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    got = QUERIES["op12_spectrum_whitening"](spark, folder).collect()
    check(got, [r.vec_id for r in table], [r.embedding for r in table])


def test_unsound_rows_are_dropped(run):
    rng = np.random.default_rng(3)
    sound = [(i, v.tolist(), 1) for i, v in enumerate(rng.normal(size=(60, 5)) * [1, 2, 3, 4, 9])]
    odd = [
        (100, None, 1), (101, [], 1), (102, [1.0, None, 1.0, 1.0, 1.0], 1), (103, [1.0, float("nan"), 1.0, 1.0, 1.0], 1),
        (104, [float("inf"), 1.0, 1.0, 1.0, 1.0], 1), (105, [1.0, 2.0], 1), (106, [1e300, 0.0, 0.0, 0.0, 0.0], 1),
    ]
    plain_result = run(sound + odd)
    check(plain_result, [r[0] for r in sound], [r[1] for r in sound])
    clashing = run(sound + odd, c=1, x=2, n="a", component="b", whitened=None, v=3, i=4, d=5)
    assert sorted(tuple(r)[:6] for r in clashing) == sorted(tuple(r)[:6] for r in plain_result)


def test_repeated_rows_and_ids(run):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(rng.normal(size=(40, 3)))]
    got = run(rows + rows[:10] + [(None, [0.5, 0.25, 0.125], 1)])
    assert len(got) == 51 * 3 and {r.n for r in got} == {51}
    twice = [r for r in got if r.vec_id == 3 and r.component == 1]
    assert len(twice) == 2 and twice[0] == twice[1]


@pytest.mark.parametrize(
    ("vectors", "components"),
    [([], 0), ([[1.0, 2.0]], 0), ([[1.0, 2.0]] * 5, 0), ([[1.0, 2.0], [3.0, 2.0]], 1), ([[0.0, 1.0], [1.0, 0.0]], 1)],
)
def test_fewer_dimensions(run, vectors, components):
    got = run([(i, v, 1) for i, v in enumerate(vectors)])
    assert len(got) == len(vectors) * components
    assert all(abs(abs(r.whitened) - 1) < 1e-12 for r in got)  # two points lie one deviation to either side


def test_equal_eigenvalues(run):
    corners = [[(1.0 if i >> b & 1 else -1.0) * 4 for b in range(5)] for i in range(32)]
    got = run([(i, v, 1) for i, v in enumerate(corners)])
    w = np.array([r.whitened for r in sorted(got, key=lambda r: (r.vec_id, r.component))]).reshape(32, 5)
    assert np.abs(w.T @ w / 32 - np.eye(5)).max() < 1e-12
    assert all(abs(r.explained - 0.2) < 1e-12 for r in got)


def test_huge_entries_stay_exact(run):
    rows = [(i, [float(2**40 + 3 * i), float(i % 7)], 1) for i in range(50)]
    check(run(rows), [r[0] for r in rows], [r[1] for r in rows])
    far = [(i, [2.0**50 * i, float(i % 3)], 1) for i in range(20)]
    got = run(far)
    deviations, *_ = plain([r[1] for r in far])
    wanted = {i: d if d < 2**63 else None for i, d in enumerate(deviations)}
    assert {r.vec_id: r.deviation for r in got} == wanted and None in wanted.values()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(0, 10**6), st.sampled_from([0.0, 0.5, 3.0]))
def test_slices_hold_their_eigenvalue(n, seed, decay):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(n + 2, n)) * np.exp(-decay * np.arange(n))
    a = a.T @ a
    found = whitening.leading(a, 32)
    wanted = np.linalg.eigvalsh(a)[::-1]
    k = len(found.values)
    assert np.abs(found.values - wanted[:k]).max() <= 1e-12 * wanted[0]
    assert k == n or wanted[k] <= 1e-12 * wanted.sum()
    assert np.abs(found.vectors @ found.vectors.T - np.eye(k)).max() < 1e-12
    diagonal, off = whitening.tridiagonal(a)
    shifts = (wanted[1:] + wanted[:-1]) / 2
    apart = wanted[:-1] - wanted[1:] > 1e-9 * wanted[0]
    assert (whitening.count_above(diagonal, off, shifts) == np.arange(1, n))[apart].all()


def test_same_however_rows_are_dealt(spark):
    rows = whitening.grid(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"))
    one = whitening.fit(rows.coalesce(1))
    many = whitening.fit(rows.repartition(7))
    assert one.sums == many.sums and (one.spectrum.vectors == many.spectrum.vectors).all()
