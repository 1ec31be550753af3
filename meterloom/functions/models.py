"""Regression models as plain data that compile to Spark columns.

A compiled model is ordinary column arithmetic: it runs inside whole-stage code
generation, lets the scan read only the model's features, and needs no Python.
Trees too large for generated code are walked in Arrow batches instead (see
`functions.forests`); `column()` chooses, and the result is the same.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.functions.forests import walk_trees

# The JVM never compiles a Java method of more than 8,000 bytes but interprets it, some
# fifty times slower. A node takes 35 to 50 bytes of the generated one, the rest of a job 600.
MAX_COMPILED_NODES = 100


@dataclass(frozen=True)
class Linear:
    """intercept + sum(weight * feature)"""

    weights: dict[str, float]
    intercept: float = 0.0

    @property
    def features(self) -> list[str]:
        return list(self.weights)

    def column(self, inputs=None) -> Column:
        value = inputs or F.col
        terms = [F.lit(float(w)) * value(f) for f, w in self.weights.items()]
        return reduce(Column.__add__, terms, F.lit(float(self.intercept)))

    def spec(self) -> dict:
        return {"kind": "linear", "weights": self.weights, "intercept": self.intercept}


#: A feature no farther from 0 than this counts as 0 where 0 is missing.
NEARLY_ZERO = 1e-35


def _with_missing(test: Column, value: Column, side: str | None) -> Column:
    if side is None:
        return test
    return F.when(value.isNull() | F.isnan(value), F.lit(side == "left")).otherwise(test)


@dataclass(frozen=True)
class Leaf:
    value: float


@dataclass(frozen=True)
class Split:
    """`left` where feature <= threshold (feature < threshold if `strict`), else `right`.

    `missing` names the side a missing feature (null or NaN) takes; without it the
    prediction is null. `zero` names the side of a feature of nearly 0, for models
    that treat 0 as missing.
    """

    feature: str
    threshold: float
    left: Split | CategorySplit | Leaf
    right: Split | CategorySplit | Leaf
    strict: bool = False
    missing: str | None = None
    zero: str | None = None

    def goes_left(self, value: Column) -> Column:
        threshold = F.lit(float(self.threshold))
        test = value < threshold if self.strict else value <= threshold
        if self.zero is not None:
            test = F.when(F.abs(value) <= NEARLY_ZERO, F.lit(self.zero == "left")).otherwise(test)
        return _with_missing(test, value, self.missing)


@dataclass(frozen=True)
class CategorySplit:
    """`left` where the feature is one of `categories`, else `right`.

    `missing` as in `Split`; `whole` cuts a feature to a whole number first.
    """

    feature: str
    categories: tuple[float, ...]
    left: Split | CategorySplit | Leaf
    right: Split | CategorySplit | Leaf
    missing: str | None = None
    whole: bool = False

    def goes_left(self, value: Column) -> Column:
        # beyond ten values Spark looks them up in a set made once, not one by one
        cut = F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value)).cast("double") if self.whole else value
        return _with_missing(cut.isin([float(c) for c in self.categories]), value, self.missing)


@dataclass(frozen=True)
class SymmetricTree:
    """A tree that asks one question a level: leaf number sum(2^i) over the tests i that go right.

    tests: (feature, threshold, strict, missing) as in `Split`; 2^len(tests) leaves.
    As a column it is a comparison a level and one lookup in a literal array,
    instead of 2^depth nested cases.
    """

    tests: tuple[tuple, ...]
    leaves: tuple[float, ...]

    def __post_init__(self):
        if len(self.leaves) != 1 << len(self.tests):
            raise ValueError(f"{len(self.tests)} tests need {1 << len(self.tests)} leaves, not {len(self.leaves)}")

    @property
    def features(self) -> list[str]:
        return sorted({t[0] for t in self.tests})

    def column(self, inputs=None) -> Column:
        value = inputs or F.col
        bits, present = F.lit(0), F.lit(True)
        for i, (feature, threshold, strict, missing) in enumerate(self.tests):
            split = Split(feature, threshold, Leaf(0.0), Leaf(0.0), strict, missing)
            bits = bits + F.when(split.goes_left(value(feature)), F.lit(0)).otherwise(F.lit(1 << i))
            if missing is None:
                present = present & value(feature).isNotNull()
        return F.when(present, F.get(F.array(*[F.lit(float(v)) for v in self.leaves]), bits))

    def spec(self) -> dict:
        return {"kind": "symmetric", "tests": [list(t) for t in self.tests], "leaves": list(self.leaves)}


@dataclass(frozen=True)
class Tree:
    root: Split | CategorySplit | Leaf

    @property
    def features(self) -> list[str]:
        return sorted(_split_features(self.root))

    def column(self, inputs=None) -> Column:
        value = inputs or F.col
        if node_count(self) > MAX_COMPILED_NODES and self.features:
            return walk_trees([self], [1.0], 0.0, self.features, value)

        def walk(node) -> Column:
            if isinstance(node, Leaf):
                return F.lit(float(node.value))
            return F.when(node.goes_left(value(node.feature)), walk(node.left)).otherwise(walk(node.right))

        present = [value(f).isNotNull() for f in sorted(needed_features(self.root))]
        return F.when(reduce(Column.__and__, present, F.lit(True)), walk(self.root))

    def spec(self) -> dict:
        return {"kind": "tree", "root": _node_spec(self.root)}


@dataclass(frozen=True)
class Ensemble:
    """intercept + sum(weight * member), as in a forest or boosted trees."""

    members: tuple
    weights: tuple[float, ...]
    intercept: float = 0.0

    @property
    def features(self) -> list[str]:
        return list(dict.fromkeys(f for m in self.members for f in m.features))

    def column(self, inputs=None) -> Column:
        members = list(zip(self.members, self.weights))
        if node_count(self) <= MAX_COMPILED_NODES:
            terms = [F.lit(float(w)) * m.column(inputs) for m, w in members]
            return reduce(Column.__add__, terms, F.lit(float(self.intercept)))
        is_tree = lambda m: isinstance(m, (Tree, SymmetricTree)) and m.features
        trees = [(m, w) for m, w in members if is_tree(m)]
        others = [F.lit(float(w)) * m.column(inputs) for m, w in members if not is_tree(m)]
        if not any(isinstance(m, Tree) for m, _ in trees):
            # no Python for symmetric trees alone: a higher-order function takes the sum out of
            # whole-stage code, and Spark then cuts it into methods that the JVM compiles
            terms = [F.lit(float(w)) * m.column(inputs) for m, w in members]
            start = F.lit(float(self.intercept))
            if self.features:
                first = (inputs or F.col)(self.features[0])
                start = F.aggregate(F.array(first), start, lambda total, _: total)
            return reduce(Column.__add__, terms, start)
        features = list(dict.fromkeys(f for m, _ in trees for f in m.features))
        walked = walk_trees(
            [m for m, _ in trees], [w for _, w in trees], self.intercept, features, inputs or F.col
        )
        return reduce(Column.__add__, others, walked)

    def spec(self) -> dict:
        return {
            "kind": "ensemble",
            "members": [m.spec() for m in self.members],
            "weights": list(self.weights),
            "intercept": self.intercept,
        }


@dataclass(frozen=True)
class Stack:
    """Base models feed a meta model, which knows them by their names here.

    With `decimals`, base predictions are rounded before the meta model. As one
    column, a base is repeated wherever the meta model names it; `scoring.score`
    gives bases columns of their own instead.
    """

    bases: dict[str, object]
    meta: object
    decimals: int | None = None

    @property
    def features(self) -> list[str]:
        own = [f for f in self.meta.features if f not in self.bases]
        return list(dict.fromkeys([f for b in self.bases.values() for f in b.features] + own))

    def base_columns(self, inputs=None) -> dict[str, Column]:
        columns = {name: base.column(inputs) for name, base in self.bases.items()}
        if self.decimals is None:
            return columns
        return {name: F.round(c, self.decimals) for name, c in columns.items()}

    def column(self, inputs=None) -> Column:
        outside = inputs or F.col
        columns = self.base_columns(inputs)
        return self.meta.column(lambda name: columns[name] if name in columns else outside(name))

    def spec(self) -> dict:
        return {
            "kind": "stack",
            "bases": {name: base.spec() for name, base in self.bases.items()},
            "meta": self.meta.spec(),
            "decimals": self.decimals,
        }


def needed_features(node) -> set[str]:
    """Features without which a tree has no prediction."""
    if isinstance(node, Leaf):
        return set()
    own = {node.feature} if node.missing is None else set()
    return own | needed_features(node.left) | needed_features(node.right)


def _split_features(node) -> set[str]:
    if isinstance(node, Leaf):
        return set()
    return {node.feature} | _split_features(node.left) | _split_features(node.right)


def _node_spec(node) -> dict:
    if isinstance(node, Leaf):
        return {"value": node.value}
    spec = {"feature": node.feature, "left": _node_spec(node.left), "right": _node_spec(node.right)}
    if isinstance(node, CategorySplit):
        spec["categories"] = list(node.categories)
        if node.whole:
            spec["whole"] = True
    else:
        spec["threshold"] = node.threshold
        if node.strict:
            spec["strict"] = True
        if node.zero is not None:
            spec["zero"] = node.zero
    if node.missing is not None:
        spec["missing"] = node.missing
    return spec


def _node(spec: dict):
    if "value" in spec:
        return Leaf(spec["value"])
    left, right, missing = _node(spec["left"]), _node(spec["right"]), spec.get("missing")
    if "categories" in spec:
        whole = spec.get("whole", False)
        return CategorySplit(spec["feature"], tuple(spec["categories"]), left, right, missing, whole)
    strict, zero = spec.get("strict", False), spec.get("zero")
    return Split(spec["feature"], spec["threshold"], left, right, strict, missing, zero)


def node_count(model) -> int:
    if isinstance(model, Leaf):
        return 1
    if isinstance(model, (Split, CategorySplit)):
        return 1 + node_count(model.left) + node_count(model.right)
    if isinstance(model, Tree):
        return node_count(model.root)
    if isinstance(model, SymmetricTree):
        return 3 * len(model.tests)  # a test's code is as long as that of three nodes
    if isinstance(model, Ensemble):
        return sum(map(node_count, model.members))
    if isinstance(model, Stack):
        return sum(map(node_count, model.bases.values())) + node_count(model.meta)
    return 1


def from_spec(spec: dict):
    kind = spec["kind"]
    if kind == "linear":
        return Linear(dict(spec["weights"]), spec["intercept"])
    if kind == "tree":
        return Tree(_node(spec["root"]))
    if kind == "symmetric":
        return SymmetricTree(tuple(tuple(t) for t in spec["tests"]), tuple(spec["leaves"]))
    if kind == "ensemble":
        members = tuple(from_spec(m) for m in spec["members"])
        return Ensemble(members, tuple(spec["weights"]), spec["intercept"])
    if kind == "stack":
        bases = {name: from_spec(b) for name, b in spec["bases"].items()}
        return Stack(bases, from_spec(spec["meta"]), spec["decimals"])
    raise ValueError(f"unknown model kind {kind!r}")


def save_model(spark: SparkSession, model, path: str) -> None:
    """Write the model as one JSON text row; reading it back runs no code."""
    text = json.dumps(model.spec())
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def load_model(spark: SparkSession, path: str):
    rows: DataFrame = spark.read.text(path, wholetext=True)
    return from_spec(json.loads(rows.first()["value"]))
