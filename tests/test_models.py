"""Compiled models against plain Python, and the shape of their plans."""

import json
import random

import pytest
from pyspark.sql import functions as F

from meterloom.functions.models import (
    CategorySplit, Ensemble, Leaf, Linear, Split, Stack, SymmetricTree, Tree, from_spec, load_model, node_count, save_model,
)
from meterloom.operators.scoring import score, to_output
from meterloom.operators.pymodel import PythonModel, score_python

LINEAR = Linear({"x": 2.0, "y": -0.5}, 1.0)
TREE = Tree(Split("x", 1.5, Leaf(10.0), Split("y", 0.0, Leaf(20.0), Leaf(30.0))))
FOREST = Ensemble((TREE, Tree(Leaf(4.0))), (0.25, 0.75), 2.0)
STACK = Stack({"a": LINEAR, "b": TREE}, Linear({"a": 0.5, "b": 0.25, "y": 1.0}, -1.0))
MODELS = {"linear": LINEAR, "tree": TREE, "forest": FOREST, "stack": STACK}


def predict(model, row):
    """The models' meaning, row by row."""
    if isinstance(model, Linear):
        return model.intercept + sum(w * row[f] for f, w in model.weights.items())
    if isinstance(model, Tree):
        node = model.root
        while isinstance(node, Split):
            node = node.left if row[node.feature] <= node.threshold else node.right
        return node.value
    if isinstance(model, Ensemble):
        return model.intercept + sum(w * predict(m, row) for m, w in zip(model.members, model.weights))
    bases = {name: predict(base, row) for name, base in model.bases.items()}
    return predict(model.meta, {**row, **bases})


@pytest.fixture(scope="module")
def table(spark):
    draw = random.Random(3)
    rows = [(i, draw.uniform(-3, 3), draw.uniform(-3, 3)) for i in range(200)] + [(200, 1.5, 0.0)]
    return spark.createDataFrame(rows, "row_id long, x double, y double")


@pytest.mark.parametrize("name", MODELS)
def test_prediction(table, name):
    for row in score(table, MODELS[name]).collect():
        assert row.prediction == pytest.approx(predict(MODELS[name], row.asDict()), abs=1e-12)


@pytest.mark.parametrize("name", MODELS)
def test_saved_model_is_the_same(spark, tmp_path, name):
    model = MODELS[name]
    assert from_spec(json.loads(json.dumps(model.spec()))) == model
    save_model(spark, model, str(tmp_path / name))
    assert load_model(spark, str(tmp_path / name)) == model


@pytest.mark.parametrize("name", MODELS)
def test_plan_is_generated_code_only(spark, table, tmp_path, name):
    wide = table.withColumn("unused", F.lit("x"))
    wide.write.parquet(str(tmp_path / "wide"))
    scored = to_output(score(spark.read.parquet(str(tmp_path / "wide")), MODELS[name]))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "unused" not in plan


def test_scoring_ignores_partitioning(table):
    rows = lambda df: sorted(map(tuple, to_output(score(df, STACK)).collect()))
    assert rows(table) == rows(table.repartition(9)) == rows(table.coalesce(1))
    assert to_output(score(table, STACK)).count() == table.count()


def test_missing_features(spark):
    rows = [(0, 1.0, 2.0), (1, None, 2.0), (2, 3.0, None), (3, None, None)]
    frame = spark.createDataFrame(rows, "row_id long, x double, y double")
    blank = {r.row_id: (r.prediction, r.null_features) for r in score(frame, LINEAR).collect()}
    assert blank == {0: (2.0, None), 1: (None, ["x"]), 2: (None, ["y"]), 3: (None, ["x", "y"])}
    assert {r.row_id for r in score(frame, TREE).where("prediction is null").collect()} == {1, 2, 3}
    assert [r.row_id for r in score(frame, LINEAR, on_null="drop").collect()] == [0]
    filled = {r.row_id: r.prediction for r in score(frame, LINEAR, on_null="mean").collect()}
    assert filled == {0: 2.0, 1: 4.0, 2: 6.0, 3: 4.0}


def grown(draw, depth, odd=False):
    if depth == 0:
        return Leaf(draw.uniform(-5, 5))
    options = {"strict": draw.random() < 0.5, "missing": draw.choice(["left", "right"])} if odd else {}
    left, right = grown(draw, depth - 1, odd), grown(draw, depth - 1, odd)
    return Split(draw.choice("xy"), draw.choice([0.0, 1.5, draw.uniform(-3, 3)]), left, right, **options)


@pytest.mark.parametrize("odd", [False, True])
def test_large_trees_are_walked_in_batches(spark, table, monkeypatch, odd):
    """The same predictions as in generated code, also for missing values."""
    from meterloom.functions import models

    draw = random.Random(8)
    gaps = table.unionByName(
        spark.createDataFrame([(300, None, 0.0), (301, 1.5, None), (302, None, None)], table.schema)
    )
    big = Tree(grown(draw, 11, odd))
    many = Ensemble((*(Tree(grown(draw, 5, odd)) for _ in range(60)), LINEAR), (0.5,) * 61, 2.0)
    stack = Stack({"a": many, "b": big}, Tree(Split("a", 0.0, Leaf(1.0), Split("a", 9.0, Leaf(2.0), Leaf(3.0)))))
    assert node_count(big) == 4095 and node_count(many) > models.MAX_COMPILED_NODES
    walked = [sorted(map(tuple, to_output(score(gaps, m)).collect())) for m in (big, many, stack)]
    monkeypatch.setattr(models, "MAX_COMPILED_NODES", 10**9)
    small = [Tree(grown(random.Random(i), 5, odd)) for i in range(3)]
    compiled = [sorted(map(tuple, to_output(score(gaps, m)).collect())) for m in small]
    monkeypatch.setattr(models, "MAX_COMPILED_NODES", 1)
    assert [sorted(map(tuple, to_output(score(gaps, m)).collect())) for m in small] == compiled
    for rows, model in zip(walked, (big, many)):
        for row_id, value in rows[:200]:
            row = table.where(F.col("row_id") == row_id).first().asDict() if row_id < 3 else None
            assert row is None or odd or value == pytest.approx(predict(model, row))
    if odd:
        assert all(value is not None for _, value in walked[0])
    else:
        assert [value for row_id, value in walked[0] if row_id >= 300] == [None] * 3
    assert from_spec(json.loads(json.dumps(big.spec()))) == big


def test_python_model_as_a_model(spark, table):
    def load():
        return lambda frame: 1.0 + 2.0 * frame["x"] - 0.5 * frame["y"]

    model = PythonModel(["x", "y"], load)
    gaps = table.unionByName(spark.createDataFrame([(300, None, 0.0)], table.schema))
    got = {r.row_id: r.prediction for r in score(gaps, model).collect()}
    assert got.pop(300) is None
    assert got == pytest.approx({r.row_id: r.prediction for r in score(table, LINEAR).collect()})
    filled = score(gaps, model, on_null="mean", means={"x": 4.0, "y": 0.0}).where("row_id = 300").first()
    assert filled.prediction == 9.0 and filled.x is None


def test_python_model(table):
    def load():
        return lambda frame: 1.0 + 2.0 * frame["x"] - 0.5 * frame["y"]

    got = {r.row_id: r.prediction for r in score_python(table, ["x", "y"], load).collect()}
    wanted = {r.row_id: r.prediction for r in score(table, LINEAR).collect()}
    assert got == pytest.approx(wanted)


def test_python_models_do_not_mix(table):
    for constant in (1.0, 2.0):
        def load(c=constant):
            return lambda frame: [c] * len(frame)

        got = {r.prediction for r in score_python(table, ["x"], load).collect()}
        assert got == {constant}


def test_python_model_must_answer_every_row(table):
    def load():
        return lambda frame: frame["x"].head(1)

    with pytest.raises(Exception, match="predictions for"):
        score_python(table, ["x"], load).collect()


def test_forms_of_walked_trees_agree_with_columns(spark, monkeypatch):
    """Tables, nested and level by level; NaN, missing, -0.0 and thresholds of NaN."""
    from meterloom.functions import forests, models

    draw = random.Random(5)
    odd = [None, float("nan"), 0.0, -0.0, 1e-36, 1.5, -2.0, 3.0]
    frame = spark.createDataFrame([(x, y) for x in odd for y in odd], "x double, y double")

    def test():
        threshold = draw.choice([0.0, 1.5, -2.0, float("nan"), draw.uniform(-3, 3)])
        return draw.choice("xy"), threshold, draw.random() < 0.5, draw.choice([None, "left", "right"])

    def tree(depth):
        if not depth:
            return Leaf(draw.uniform(-5, 5))
        feature, threshold, strict, missing = test()
        left, right = tree(depth - 1), tree(draw.choice([0, depth - 1]))
        if draw.random() < 0.2:
            return CategorySplit(feature, (1.5, 3.0, 0.0), left, right, missing, draw.random() < 0.5)
        return Split(feature, threshold, left, right, strict, missing, draw.choice([None, "left", "right"]))

    members = [Tree(tree(d)) for d in (1, 2, 3, 4, 5, 6)]
    members += [SymmetricTree(tuple(test() for _ in range(k)), tuple(map(float, range(1 << k)))) for k in (1, 4, 9)]
    rows = lambda m: [r[0] for r in frame.select(m.column()).collect()]
    monkeypatch.setattr(models, "MAX_COMPILED_NODES", 10**9)
    wanted = [rows(m) for m in members]
    monkeypatch.setattr(models, "MAX_COMPILED_NODES", 0)
    for limits in ((8, 16, 32 << 20), (0, 16, 4096), (0, -1, 1)):
        for name, value in zip(("TABLE_TESTS", "WHOLE_TREE", "OUTCOMES"), limits):
            monkeypatch.setattr(forests, name, value)
        assert [rows(m) for m in members] == wanted


def test_no_generated_method_is_too_long_to_be_compiled(spark):
    """The JVM only interprets methods of more than 8,000 bytes."""
    import re

    table = spark.range(10).selectExpr("id as row_id", "id * 0.5D as x", "nullif(id * 0.1D, 0.2D) as y")
    symmetric = SymmetricTree((("x", 0.5, False, None), ("y", 1.5, True, "left")) * 2, tuple(map(float, range(16))))
    trees = Tree(Split("x", 0.5, Split("y", 0.5, Leaf(1.0), Leaf(2.0), missing="left"), Leaf(3.0), missing="right"))
    for member, n in ((symmetric, 8), (symmetric, 50), (trees, 20), (trees, 200)):
        df = to_output(score(table, Ensemble((member,) * n, (0.5,) * n)))
        text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
        assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", text))) < 8000
