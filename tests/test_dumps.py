"""Dumps of other libraries' models, set-valued splits and symmetric trees, against plain walkers."""

import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml import Pipeline
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor

from meterloom.functions import models
from meterloom.functions.dumps import float32_test, from_split_dump, from_split_model, load_dump, parse_dump
from meterloom.functions.models import CategorySplit, Ensemble, Leaf, Split, SymmetricTree, Tree, from_spec
from meterloom.operators.pipeline import compile_pipeline, score_pipeline
from meterloom.plans.table_queries import LEAFWISE_TEXT, SPLIT_DUMP, SYMMETRIC_JSON, score_symmetric_trees

NEAR = [0.05, float(np.float32(0.05)), float(np.nextafter(np.float32(0.05), np.float32(0))), 0.0, -0.0, 1e-36, -1e-30]
VALUES = [*NEAR, 1.0, 2.0, 3.7, -2.0, 25.0, 64.0, float("nan"), None]


def table(spark, columns):
    """Every value in every place, the others shifted along."""
    n = len(VALUES)
    rows = [tuple(VALUES[(i * (k + 1) + j) % n] for k in range(len(columns))) for i in range(n) for j in range(n)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns))


def check(spark, model, columns, plain, monkeypatch):
    """As columns, as an Arrow walk, and after a round trip through the spec."""
    df = table(spark, columns)
    rows = [r.asDict() for r in df.collect()]
    wanted = [plain(r) for r in rows]
    for limit in (2000, 0):
        monkeypatch.setattr(models, "MAX_COMPILED_NODES", limit)
        again = from_spec(json.loads(json.dumps(model.spec())))
        for m in (model, again):
            got = [r[0] for r in df.select(m.column()).collect()]
            assert [g if g is None else round(g, 9) for g in got] == [w if w is None else round(w, 9) for w in wanted]


@settings(max_examples=300, deadline=None)
@given(st.floats(width=32, allow_nan=False), st.integers(-3, 3), st.floats(allow_nan=False))
def test_float32_test(threshold, steps, other):
    bound, strict = float32_test(threshold)
    near = float(np.float32(threshold))
    around = [other, near, bound]
    for x in (near, bound):
        for _ in range(abs(steps)):
            x = float(np.nextafter(x, math.copysign(math.inf, steps)))
        around.append(x)
    for x in around:
        with np.errstate(over="ignore"):
            wanted = bool(np.float32(x) < np.float32(threshold))
        if np.isfinite(np.float32(threshold)) and abs(threshold) < 3e38:
            assert (x < bound if strict else x <= bound) == wanted


def absent(x):
    return x is None or math.isnan(x)


def plain_split(node, row, names):
    """A walker of the nested dump, as its library does it."""
    while "leaf" not in node:
        x, c = row[names[int(node["split"][1:])]], node["split_condition"]
        if absent(x):
            to = node["missing"]
        elif isinstance(c, list):
            to = node["yes"] if x in c else node["no"]
        else:
            to = node["yes"] if np.float32(x) < np.float32(c) else node["no"]
        node = next(child for child in node["children"] if child["nodeid"] == to)
    return node["leaf"]


def test_split_dump(spark, monkeypatch):
    trees = json.loads(SPLIT_DUMP)
    trees.append(
        {"nodeid": 0, "split": "f2", "split_condition": [1, 2, 64], "yes": 2, "no": 1, "missing": 1,
         "children": [{"nodeid": 1, "leaf": 0.125}, {"nodeid": 2, "leaf": 7.0}]}
    )
    names = ["a", "b", "c"]
    model = parse_dump(json.dumps(trees), 0.25, names)
    check(spark, model, names, lambda r: 0.25 + sum(plain_split(t, r, names) for t in trees), monkeypatch)


def test_split_model(spark, monkeypatch):
    tree = {
        "left_children": [1, -1, 3, -1, -1], "right_children": [2, -1, 4, -1, -1], "split_indices": [0, 0, 1, 0, 0],
        "split_conditions": [0.05, 1.5, 0.0, 2.5, -4.0], "default_left": [1, 0, 0, 0, 0],
        "categories_nodes": [2], "categories_segments": [0], "categories_sizes": [2], "categories": [25, 64],
    }
    model = {
        "learner": {
            "feature_names": ["a", "b"],
            "objective": {"name": "reg:squarederror"},
            "learner_model_param": {"base_score": "[5E-1]", "num_class": "0"},
            "gradient_booster": {"model": {"trees": [tree]}},
        }
    }

    def plain(r):
        if absent(r["a"]) or np.float32(r["a"]) < np.float32(0.05):
            return 0.5 + 1.5
        return 0.5 + (-4.0 if absent(r["b"]) or r["b"] in (25, 64) else 2.5)

    check(spark, parse_dump(json.dumps(model)), ["a", "b"], plain, monkeypatch)
    model["learner"]["objective"]["name"] = "reg:logistic"
    with pytest.raises(ValueError, match="plain sum"):
        from_split_model(model)


LEAFWISE = """tree
num_class=1
objective=regression
feature_names=a b
{extra}
Tree=0
num_leaves=5
num_cat=2
split_feature=0 1 1 0
threshold=0 {t} {u} 1
decision_type=1 {d} {e} 9
left_child=1 -1 -3 -4
right_child=2 -2 3 -5
leaf_value=1 2 4 8 16
cat_boundaries=0 2 3
cat_threshold=6 1 9

Tree=1
num_leaves=1
leaf_value=100

end of trees
"""


@pytest.mark.parametrize("missing", [0, 1, 2])
@pytest.mark.parametrize("default", [0, 2])
@pytest.mark.parametrize("mean", [False, True])
def test_leafwise_text(spark, monkeypatch, missing, default, mean):
    text = LEAFWISE.format(
        t=0.05, u=-2, d=default | missing << 2, e=default | missing << 2, extra="average_output\n" if mean else ""
    )

    def number_goes_left(x, t):
        if missing == 0 and absent(x):
            x = 0.0
        if (missing == 1 and (absent(x) or abs(x) <= 1e-35)) or (missing == 2 and absent(x)):
            return bool(default)
        return x <= t

    def in_set(x, members):
        return not absent(x) and int(x) in members and int(x) >= 0

    def plain(r):
        a, b = r["a"], r["b"]
        if in_set(0.0 if absent(a) else a, {1, 2, 32}) and not (absent(a)):
            leaf = 1 if number_goes_left(b, 0.05) else 2
        elif number_goes_left(b, -2):
            leaf = 4
        else:
            leaf = 8 if in_set(a, {0, 3}) else 16
        return (leaf + 100) / (2 if mean else 1)

    check(spark, parse_dump(text), ["a", "b"], plain, monkeypatch)


def test_symmetric_json(spark, monkeypatch):
    model = json.loads(SYMMETRIC_JSON)
    model["oblivious_trees"].append({"leaf_values": [0.125], "splits": []})
    f32 = np.float32

    def plain(r):
        q, t = r["l_quantity"], r["l_tax"]
        leaf = 0 if absent(q) else int(f32(q) > f32(30.5))
        leaf += 2 if absent(t) or f32(t) > f32(0.0299999993) else 0
        return 0.5 + 2 * ([1, 2, 4, 8][leaf] + 0.125)

    check(spark, parse_dump(json.dumps(model)), ["l_quantity", "l_tax"], plain, monkeypatch)


@pytest.mark.parametrize(
    "text",
    [
        LEAFWISE_TEXT.replace("objective=regression", "objective=poisson"),
        LEAFWISE_TEXT.replace("objective=regression", "objective=regression sqrt"),
        LEAFWISE_TEXT.replace("num_class=1", "num_class=3"),
        SYMMETRIC_JSON.replace("[0.5]", "[0.5, 1]"),
        '{"learner": {"gradient_booster": {"model": {}}}}',
        "{}",
    ],
)
def test_other_models_are_refused(text):
    with pytest.raises(ValueError):
        parse_dump(text)


def test_load(spark, tmp_path):
    (tmp_path / "model.txt").write_text(LEAFWISE_TEXT)
    model = load_dump(spark, str(tmp_path / "model.txt"))
    assert model.features == ["l_linenumber", "l_quantity", "l_tax"]


def test_deep_tree_is_read_without_recursion():
    node = {"nodeid": 5001, "leaf": 1.0}
    for i in range(5000, 0, -1):
        other = {"nodeid": 10_000 + i, "leaf": 0.0}
        node = {"nodeid": i, "split": "f0", "split_condition": i, "yes": node["nodeid"], "no": other["nodeid"],
                "missing": other["nodeid"], "children": [node, other]}
    at, depth = from_split_dump([node]).members[0].root, 0
    while isinstance(at, Split):
        at, depth = at.left, depth + 1
    assert depth == 5000


def test_category_split_walks_like_columns(spark, monkeypatch):
    many = tuple(float(c) for c in range(0, 200, 2))
    model = Ensemble(
        (
            Tree(CategorySplit("a", many, Leaf(1.0), CategorySplit("b", (3.0, 25.0), Leaf(2.0), Leaf(3.0), "left", True))),
            Tree(Split("b", 0.0, Leaf(10.0), Leaf(20.0), False, "right", "right")),
        ),
        (1.0, 2.0),
        0.5,
    )

    def plain(r):
        a, b = r["a"], r["b"]
        if a is None:
            return None
        first = 1.0 if a in many else 2.0 if absent(b) or math.trunc(b) in (3, 25) else 3.0
        second = 20.0 if absent(b) or abs(b) <= 1e-35 or b > 0 else 10.0
        return 0.5 + first + 2 * second

    check(spark, model, ["a", "b"], plain, monkeypatch)


def test_pipeline_split_by_categories_compiles(spark):
    rows = [(f"k{i % 7}", float(i % 5), float([5, 1, 9, 1, 5, 9, 0][i % 7] + i % 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "kind string, x double, y double")
    indexed = StringIndexer(inputCol="kind", outputCol="k").fit(df).transform(df)
    stages = [
        VectorAssembler(inputCols=["k", "x"], outputCol="_features"),
        DecisionTreeRegressor(featuresCol="_features", labelCol="y", predictionCol="prediction", maxDepth=5),
    ]
    model = Pipeline(stages=stages).fit(indexed)
    compiled = compile_pipeline(spark, model)
    assert '"categories"' in json.dumps(compiled.spec())
    both = score_pipeline(indexed, model).withColumn("own", compiled.column())
    assert both.where("own <> prediction or own is null").count() == 0


def test_symmetric_trees_need_no_python(spark):
    plan = score_symmetric_trees(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    with pytest.raises(ValueError, match="leaves"):
        SymmetricTree((("a", 1.0, False, None),), (1.0,))
