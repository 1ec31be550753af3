"""Multiprobe neighbours against brute force: recall, order of visits, exact ranks, and awkward rows."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meterloom.llm import neighbours
from meterloom.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def likeness(a, b):
    return float((np.array(a, float) * np.array(b, float)).sum())


def sound(rows):
    rows = [(i, v) for i, v, *_ in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = [len(v) for _, v in rows]
    usual = max(set(lengths), key=lambda d: (lengths.count(d), d), default=0)
    return [(i, v) for i, v in rows if any(v) and len(v) == usual]


def plain(rows, nearest=20, step=20):
    """{query: [(vec_id, score), ...]} by comparing each query with every row."""
    rows = sound(rows)
    out = {}
    for q in {i for i, _ in rows if i % step == 0}:
        best = {}
        for own in [v for i, v in rows if i == q]:
            for i, v in rows:
                if i != q:
                    best[i] = max(best.get(i, -math.inf), likeness(own, v))
        out[q] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:nearest]
    return {q: found for q, found in out.items() if found}


def check(got, rows, least, **options):
    wanted = plain(rows, **options)
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert found.keys() == wanted.keys()
    hits = total = 0
    by_id = {}
    for i, v in sound(rows):
        by_id.setdefault(i, []).append(v)
    for q, best in wanted.items():
        own = sorted(found[q])
        assert [r for r, _, _ in own] == list(range(1, len(best) + 1))
        assert [(-s, i) for _, i, s in own] == sorted((-s, i) for _, i, s in own)
        for _, i, s in own:
            exact = max(likeness(a, b) for a in by_id[q] for b in by_id[i])
            assert s == pytest.approx(exact, rel=1e-9, abs=1e-12)
        hits += len({i for i, _ in best} & {i for _, i, _ in own})
        total += len(best)
    assert hits >= least * total


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check(QUERIES["op13_multiprobe_neighbours"](spark, folder).collect(), rows, 0.9)


def test_awkward_rows(spark, awkward_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{awkward_dir}/embeddings.parquet").collect()]
    check(QUERIES["op13_multiprobe_neighbours"](spark, awkward_dir).collect(), rows, 0.9)


def test_copies_are_searched_once(spark):
    """A third of all rows are copies of one vector, queries among them; ties go to the smallest ids."""
    rng = np.random.default_rng(1)
    hot = rng.normal(size=6).astype(np.float32).tolist()
    rows = [(i, hot if i % 3 == 0 else rng.normal(size=6).astype(np.float32).tolist(), 0) for i in range(900)]
    items = neighbours.distinct_vectors(neighbours.usable(table(spark, rows)), 20)
    assert items.count() == 601 and items.selectExpr("max(size(ids))").first()[0] == 21
    found, _ = neighbours.nearest(table(spark, rows))
    check(found.collect(), rows, 0.9)


def test_one_cell_is_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(2)
    rows = [(i, (np.ones(5) + 1e-3 * rng.normal(size=5)).astype(np.float32).tolist(), 0) for i in range(600)]
    found, index = neighbours.nearest(table(spark, rows), query_step=4)
    check(found.collect(), rows, 0.9, step=4)


def test_lengths_of_all_sizes(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=4) * 10.0 ** (i % 9 - 4)).astype(np.float32).tolist(), 0) for i in range(500)]
    found, index = neighbours.nearest(table(spark, rows))
    assert len(index.hashes.longest) > 10
    check(found.collect(), rows, 0.9)


@pytest.mark.parametrize("n", [1, 2, 5])
def test_few_rows(spark, n):
    rows = [(20 * i, [1.0, float(i)], 0) for i in range(n)]
    found, _ = neighbours.nearest(table(spark, rows))
    check(found.collect(), rows, 1.0)


def test_no_queries(spark):
    found, index = neighbours.nearest(table(spark, [(1, [1.0, 2.0], 0), (2, [2.0, 1.0], 0)]))
    assert found.collect() == [] and index is None


@settings(max_examples=80, deadline=None)
@given(st.lists(st.floats(-3, 3, width=32), min_size=1, max_size=4), st.integers(0, 1000))
def test_visits_come_by_rising_cost_and_reach_all(places, seed):
    rng = np.random.default_rng(seed)
    m = len(places)
    places = np.array(places, float)
    factors = rng.integers(0, 2**63, m, dtype=np.uint64)
    run = list(itertools.islice(neighbours.visits(places, factors, factors, m - 1), 5**m))
    changes = list(itertools.product(range(-2, 3), repeat=m))
    cost = {
        sum(c * int(f) for c, f in zip(change, factors)): float(neighbours.crossing_cost(places, np.floor(places) + change))
        for change in changes
    }
    costs = [c for c, _, _ in run]
    assert all(b >= a - 1e-9 for a, b in zip(costs, costs[1:]))
    assert len({k for _, k, _ in run}) == len(run)
    for c, k, _ in run:
        if k in cost:
            assert c == pytest.approx(cost[k], abs=1e-6)
    # what costs clearly less than the last visit has been visited
    assert {k for k, c in cost.items() if c < costs[-1] - 1e-6} <= {k for _, k, _ in run}


def test_more_is_found_with_a_higher_target(spark):
    rng = np.random.default_rng(5)
    docs = table(spark, [(i, rng.normal(size=16).astype(np.float32).tolist(), 0) for i in range(1500)])
    (_, low), (_, high) = (neighbours.nearest(docs, target=t) for t in (0.5, 0.99))
    assert low.visited < high.visited and 0.5 <= low.sample_recall < 0.99 <= high.sample_recall
