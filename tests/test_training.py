"""Fits against numpy on the same rows, and Spark ML pipelines."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterloom.operators.pipeline import (
    compile_pipeline, fit_pipeline, fit_stacked_pipeline, load_pipeline, save_pipeline, score_pipeline,
)
from meterloom.operators.scoring import score
from meterloom.operators.training import collect_sums, fit_linear, fit_stack, holdout_error

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(5)
    x = draw.uniform(-10, 10, (400, 3)).round(3)
    y = (3 * x[:, 0] - 2 * x[:, 1] + 0.5 * x[:, 2] ** 2 + draw.normal(0, 1, 400)).round(4)
    return x, y


@pytest.fixture(scope="module")
def table(spark, rows):
    x, y = rows
    data = [(i, *map(float, xi), float(yi)) for i, (xi, yi) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "id long, a double, b double, c double, y double").cache()


def least_squares(x, y):
    return np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]


def test_linear(table, rows):
    x, y = rows
    model = fit_linear(table, FEATURES, "y")
    assert [model.intercept, *model.weights.values()] == pytest.approx(list(least_squares(x, y)))


def test_fit_ignores_order_partitions_and_incomplete_rows(table, spark):
    wanted = fit_linear(table, FEATURES, "y")
    assert fit_linear(table.orderBy(F.desc("y")).repartition(7), FEATURES, "y") == wanted
    gaps = table.unionByName(table.limit(20).withColumn("b", F.lit(None).cast("double")))
    assert fit_linear(gaps, FEATURES, "y") == wanted


def test_dependent_features_are_refused(table):
    with pytest.raises(ValueError):
        fit_linear(table.withColumn("d", F.col("a") * 2), ["a", "d"], "y")


def test_stack(table, rows):
    x, y = rows
    fold = np.arange(len(y)) % 4
    bases = {"one": [0, 1], "two": [2]}
    held_out = {}
    for name, idx in bases.items():
        held_out[name] = np.empty(len(y))
        for k in range(4):
            w = least_squares(x[fold != k][:, idx], y[fold != k])
            held_out[name][fold == k] = w[0] + x[fold == k][:, idx] @ w[1:]
    named = {name: [FEATURES[i] for i in idx] for name, idx in bases.items()}
    fit = fit_stack(table, named, "y", F.pmod("id", F.lit(4)), 4)
    for name in bases:
        got = [r[0] for r in table.orderBy("id").select(fit.out_of_fold(name)).collect()]
        assert got == pytest.approx(list(held_out[name]))
    meta = least_squares(np.column_stack(list(held_out.values())), y)
    assert [fit.model.meta.intercept, *fit.model.meta.weights.values()] == pytest.approx(list(meta))
    full = {n: least_squares(x[:, idx], y) for n, idx in bases.items()}
    for name, idx in bases.items():
        base = fit.model.bases[name]
        assert [base.intercept, *base.weights.values()] == pytest.approx(list(full[name]))
    assert score(table, fit.model).where("prediction is null").count() == 0


def test_holdout_error(table, rows):
    x, y = rows
    scored = score(table, fit_linear(table, FEATURES, "y"))
    p = np.array([r.prediction for r in scored.orderBy("id").collect()])
    error = holdout_error(scored, "y").first()
    assert error.n == len(y)
    assert error.rmse == pytest.approx(np.sqrt(np.mean((y - p) ** 2)), rel=1e-9)
    assert error.mae == pytest.approx(np.mean(np.abs(y - p)), rel=1e-9)
    assert error.r2 == pytest.approx(1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2), rel=1e-9)
    none = holdout_error(scored.where("id < 0"), "y").first()
    assert (none.n, none.rmse, none.r2) == (0, None, None)


@pytest.mark.parametrize(
    "kind, params",
    [
        ("linear", {"solver": "normal"}),
        ("tree", {"maxDepth": 4}),
        ("forest", {"numTrees": 4, "maxDepth": 3, "seed": 1}),
        ("boosted", {"maxIter": 3, "maxDepth": 3, "seed": 1}),
    ],
)
def test_pipeline_saved_loaded_and_compiled(spark, table, tmp_path, kind, params):
    save_pipeline(fit_pipeline(table, FEATURES, "y", kind, **params), str(tmp_path / kind))
    model = load_pipeline(str(tmp_path / kind))
    both = score_pipeline(table, model, FEATURES).withColumn(
        "compiled", compile_pipeline(spark, model).column()
    )
    assert set(both.columns) == {*table.columns, "prediction", "compiled"}
    assert both.where("abs(compiled - prediction) > 1e-9 or prediction is null").count() == 0


def test_pipeline_keeps_rows_with_gaps(spark, table):
    model = fit_pipeline(table, FEATURES, "y", solver="normal")
    gaps = table.withColumn("a", F.when(F.col("id") >= 10, F.col("a")))
    scored = score_pipeline(gaps, model, FEATURES)
    assert scored.count() == table.count()
    assert scored.where("prediction is null").count() == 10


def test_stacked_pipeline(table, tmp_path):
    bases = {"line": ("linear", ["a", "b"], {}), "tree": ("tree", ["c"], {"maxDepth": 3})}
    model = fit_stacked_pipeline(table, bases, "y", F.pmod("id", F.lit(3)), 3)
    save_pipeline(model, str(tmp_path / "stack"))
    scored = score_pipeline(table, load_pipeline(str(tmp_path / "stack")), FEATURES)
    single = score_pipeline(table, fit_pipeline(table, ["a", "b"], "y"), ["a", "b"])
    rmse = lambda df: holdout_error(df, "y").first().rmse
    assert rmse(scored) < rmse(single)


@pytest.mark.parametrize("factor", [1e-6, 1, 1e7, 1e15])
def test_sums_do_not_depend_on_partitions(spark, factor):
    draw = np.random.default_rng(11)
    values = draw.integers(-(10**9), 10**9, (300, 2)) / 100 * [factor, 1]
    frame = spark.createDataFrame(values.tolist(), "a double, y double")
    sums = collect_sums(frame.repartition(5), ["a"], "y")
    assert sums == collect_sums(frame.orderBy("y").coalesce(1), ["a"], "y")
    a, y = ([Fraction(v) for v in values[:, i].tolist()] for i in (0, 1))
    assert sums.of("", "") == 300
    assert float(sums.of("a", "a")) == pytest.approx(float(sum(v * v for v in a)), rel=1e-13)
    wide = float(sum(abs(v * w) for v, w in zip(a, y)))
    assert float(sums.of("a", "y")) == pytest.approx(float(sum(v * w for v, w in zip(a, y))), abs=1e-13 * wide)


@pytest.mark.parametrize("slope, step", [(1e5, 3e-5), (2e6, 1e-6), (1e-15, 1e15), (3.0, 1.0)])
def test_fit_keeps_small_and_large_values(spark, slope, step):
    x = np.arange(500) * step
    y = slope * x + 7
    frame = spark.createDataFrame(np.column_stack([x, y]).tolist(), "x double, y double")
    model = fit_linear(frame, ["x"], "y")
    assert model.weights["x"] == pytest.approx(slope, rel=1e-9)
    assert model.intercept == pytest.approx(7, rel=1e-9)


def test_many_features_match_numpy(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(0, 1, (800, 17)) * 10.0 ** draw.integers(-6, 7, 17)
    y = x @ draw.normal(0, 1, 17) + draw.normal(0, 1, 800)
    names = [f"f{i}" for i in range(17)]
    frame = spark.createDataFrame(np.column_stack([x, y]).tolist(), ", ".join(f"{n} double" for n in [*names, "y"]))
    model = fit_linear(frame, names, "y")
    scale = np.abs(x).max(axis=0)
    wanted = np.linalg.lstsq(np.column_stack([np.ones(800), x / scale]), y, rcond=None)[0]
    assert [model.intercept, *model.weights.values()] == pytest.approx(
        [wanted[0], *(wanted[1:] / scale)], rel=1e-8, abs=1e-8
    )


def test_values_that_are_not_finite_take_no_part(spark, table):
    wanted = fit_linear(table, FEATURES, "y")
    odd = [float("inf"), float("-inf"), float("nan"), None]
    extra = spark.createDataFrame([(i, v, 1.0, 1.0, 1.0) for i, v in enumerate(odd)], table.schema)
    assert fit_linear(table.unionByName(extra), FEATURES, "y") == wanted
    large = spark.createDataFrame([(float(i) * 1e18, float(i)) for i in range(9)], "x double, y double")
    assert fit_linear(large, ["x"], "y").weights["x"] == pytest.approx(1e-18, rel=1e-9)
    scored = extra.withColumn("prediction", F.col("a"))
    assert holdout_error(scored, "y").first().n == 0


def test_small_errors_are_reported(spark):
    rows = [(float(i), i + 1.73e-4 * (-1) ** i) for i in range(100)]
    frame = spark.createDataFrame(rows, "y double, prediction double")
    error = holdout_error(frame, "y").first()
    assert error.rmse == pytest.approx(1.73e-4, rel=1e-9) and error.mae == pytest.approx(1.73e-4, rel=1e-9)


def test_no_rows(spark, table):
    sums = collect_sums(table.where("id < 0"), ["a"], "y")
    assert sums.of("", "") == sums.of("a", "y") == 0
    with pytest.raises(ValueError):
        fit_linear(table.where("id < 0"), ["a"], "y")


def test_trees_are_fitted_on_bounded_partitions(spark, monkeypatch):
    """A large split is dealt to more partitions, every row once; small ones stay as they are."""
    from meterloom.operators import pipeline

    df = spark.range(0, 1000, 1, 2).selectExpr("id * 1.0D as x", "id % 7 * 1.0D as y")
    assert pipeline._dealt_for_trees(df, 2) is df
    monkeypatch.setattr(pipeline, "FIT_VALUES", 400)
    dealt = pipeline._dealt_for_trees(df, 2)
    sizes = [r[1] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 250 and sorted(r.x for r in dealt.collect()) == [float(i) for i in range(1000)]
    seen = []
    dealing = pipeline._dealt_for_trees
    monkeypatch.setattr(pipeline, "_dealt_for_trees", lambda *a: seen.append(1) or dealing(*a))
    fitted = pipeline.fit_pipeline(df, ["x"], "y", "boosted", maxIter=1, maxDepth=2)
    assert seen and fitted.transform(df.limit(3)).count() == 3
