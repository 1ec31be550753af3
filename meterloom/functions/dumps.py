"""Tree models of other libraries, read from their public text and JSON dumps.

Nothing is unpickled and none of those libraries is needed: a dump is plain text
that states features, thresholds and leaf values. Four kinds are read:

* `from_split_dump`: a list of trees as nested nodes, each with `split`,
  `split_condition`, `yes`, `no`, `missing`, and `leaf` at the ends (the JSON dump of
  a booster whose tests are `value < threshold` on 32-bit floats);
* `from_split_model`: the JSON model file of the same library, with its trees as
  arrays and the base score inside;
* `from_leafwise_text`: the text model file of a booster whose tests are
  `value <= threshold` on 64-bit floats, with categories as bit sets;
* `from_symmetric_json`: the JSON model of a booster whose trees ask one question a
  level, so that a leaf is named by the answers.

`load_dump` reads a file through Spark and tells the kinds apart.

What a dump decides is kept: the side a missing value takes, whether the threshold
itself goes left, and thresholds that stand for 32-bit floats. A 32-bit test on a
double is the same as a test of the double against the place where rounding to 32
bits changes sides (`float32_test`), so that no feature is ever rounded. Sums are
made in 64 bits, also for libraries that add up in 32. Models whose result is not
the plain sum (classes, links such as a logarithm) are refused with a message.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import SparkSession

from meterloom.functions.models import CategorySplit, Ensemble, Leaf, Split, SymmetricTree, Tree

# Objectives whose predictions are the plain sum of the trees.
PLAIN_OBJECTIVES = {
    "reg:squarederror", "reg:linear", "reg:absoluteerror", "reg:pseudohubererror", "reg:quantileerror",
    "regression", "regression_l2", "regression_l1", "l2", "l1", "mean_squared_error", "mean_absolute_error",
    "huber", "fair", "quantile", "mape", "RMSE", "MAE", "MAPE", "Quantile",
}
# What of a leafwise tree's decision type is which.
CATEGORICAL, DEFAULT_LEFT = 1, 2
NO_MISSING, ZERO_MISSING = 0, 1


def float32_test(threshold: float) -> tuple[float, bool]:
    """(bound, strict) such that `x < bound` (or `x <= bound`) is `float32(x) < float32(threshold)`."""
    t = np.float32(threshold)
    if not np.isfinite(t):
        return float(t), True
    below = np.nextafter(t, np.float32(-np.inf))
    if not np.isfinite(below):
        return float(t), True
    middle = (float(below) + float(t)) / 2
    # the middle itself is rounded to the neighbour with the even last bit
    return middle, bool(np.float32(middle) == t)


def _numbers(categories) -> tuple[float, ...]:
    return tuple(sorted(float(c) for c in categories))


def _split(feature, threshold, left, right, missing):
    bound, strict = float32_test(threshold)
    return Split(feature, bound, left, right, strict, missing)


def _stacked(root, children, make):
    """Build a tree from its ends, without recursion: `make(node, built children)`."""
    built, todo = {}, [(root, False)]
    while todo:
        node, seen = todo.pop()
        below = children(node)
        if seen or not below:
            built[id(node) if isinstance(node, dict) else node] = make(
                node, [built[id(c) if isinstance(c, dict) else c] for c in below]
            )
        else:
            todo += [(node, True), *[(c, False) for c in below]]
    return built[id(root) if isinstance(root, dict) else root]


def _refuse_unless_plain(objective: str | None) -> None:
    if objective is not None and objective.split(" ")[0].split(":alpha")[0] not in PLAIN_OBJECTIVES:
        raise ValueError(f"the objective {objective!r} is not a plain sum of trees")


def _named(feature, names) -> str:
    """A feature's name; dumps without names say f0, f1, ... or a number."""
    if names is None:
        return str(feature)
    text = str(feature)
    if text in names:
        return text
    number = text[1:] if text[:1] == "f" else text
    if not number.isdigit() or int(number) >= len(names):
        raise ValueError(f"no feature is called {text!r}")
    return names[int(number)]


# Tests of 32-bit floats, strictly below -------------------------------------


def from_split_dump(trees: list | str, base_score: float = 0.0, features: list[str] | None = None) -> Ensemble:
    """base_score + the sum of nested trees. `features` names f0, f1, ... if the dump does not."""
    trees = json.loads(trees) if isinstance(trees, str) else trees

    def make(node, below):
        if "leaf" in node:
            return Leaf(float(node["leaf"]))
        by_id = {child["nodeid"]: built for child, built in zip(node["children"], below)}
        feature = _named(node["split"], features)
        yes, no, missing = node["yes"], node["no"], node.get("missing", node["yes"])
        side = "left" if missing == yes else "right"
        condition = node.get("split_condition")
        if isinstance(condition, list):
            return CategorySplit(feature, _numbers(condition), by_id[yes], by_id[no], side)
        if condition is None:
            raise ValueError(f"the test of {feature!r} has no threshold")
        return _split(feature, float(condition), by_id[yes], by_id[no], side)

    built = [Tree(_stacked(t, lambda n: n.get("children", []), make)) for t in trees]
    return Ensemble(tuple(built), (1.0,) * len(built), float(base_score))


def from_split_model(model: dict | str, features: list[str] | None = None) -> Ensemble:
    """A model file with trees as arrays; names in the file come before `features`."""
    model = json.loads(model) if isinstance(model, str) else model
    learner = model["learner"]
    _refuse_unless_plain(learner.get("objective", {}).get("name"))
    booster = learner["gradient_booster"]
    dropped = booster.get("weight_drop")
    if "gbtree" in booster:  # trees with weights of their own
        booster = booster["gbtree"]
    if "model" not in booster or "trees" not in booster["model"]:
        raise ValueError("the model has no trees")
    parameters = learner.get("learner_model_param", {})
    if int(parameters.get("num_class", 0)) > 1 or int(parameters.get("num_target", 1)) > 1:
        raise ValueError("the model has several outputs")
    names = learner.get("feature_names") or features
    base = float(str(parameters.get("base_score", 0.0)).strip("[]"))
    built = []
    for tree in booster["model"]["trees"]:
        left, right = tree["left_children"], tree["right_children"]
        categories = {}
        for node, start, size in zip(
            tree.get("categories_nodes", []), tree.get("categories_segments", []), tree.get("categories_sizes", [])
        ):
            categories[node] = _numbers(tree["categories"][start : start + size])

        def make(i, below, tree=tree, categories=categories):
            if not below:
                return Leaf(float(np.float32(tree["split_conditions"][i])))
            feature = _named(tree["split_indices"][i], names)
            side = "left" if tree["default_left"][i] else "right"
            if i in categories:  # these go right
                side = "right" if tree["default_left"][i] else "left"
                return CategorySplit(feature, categories[i], below[1], below[0], side)
            return _split(feature, tree["split_conditions"][i], *below, side)

        built.append(
            Tree(_stacked(0, lambda i, left=left, right=right: [] if left[i] < 0 else [left[i], right[i]], make))
        )
    weights = tuple(float(w) for w in dropped) if dropped else (1.0,) * len(built)
    return Ensemble(tuple(built), weights, base)


# Tests of 64-bit floats, up to and including ---------------------------------


def _sections(text: str) -> tuple[dict, list[dict]]:
    head, trees, own = {}, [], None
    for line in text.splitlines():
        if line.startswith("end of trees"):
            break
        key, _, value = line.partition("=")
        if key == "Tree":
            trees.append(own := {})
        elif key:
            (head if own is None else own)[key] = value
    return head, trees


def from_leafwise_text(text: str) -> Ensemble:
    """The sum, or the mean, of trees in a text model file."""
    head, trees = _sections(text)
    _refuse_unless_plain(head.get("objective"))
    if int(head.get("num_class", 1)) > 1:
        raise ValueError("the model has several outputs")
    if "sqrt" in head.get("objective", "").split(" "):
        raise ValueError("the model predicts roots")
    names = head["feature_names"].split(" ")
    built = [_leafwise_tree(t, names) for t in trees]
    weight = 1.0 / len(built) if "average_output" in head and built else 1.0
    return Ensemble(tuple(built), (weight,) * len(built), 0.0)


def _leafwise_tree(tree: dict, names: list[str]) -> Tree:
    numbers = lambda key, kind: [kind(x) for x in tree.get(key, "").split()]
    if tree.get("is_linear", "0") != "0":
        raise ValueError("a tree has linear leaves")
    leaves = numbers("leaf_value", float)
    feature, threshold = numbers("split_feature", int), numbers("threshold", float)
    decision, left, right = (numbers(k, int) for k in ("decision_type", "left_child", "right_child"))
    edges, words = numbers("cat_boundaries", int), numbers("cat_threshold", int)

    def make(i, below):
        if i < 0:
            return Leaf(leaves[~i])
        name, missing = names[feature[i]], decision[i] >> 2 & 3
        if decision[i] & CATEGORICAL:
            k = int(threshold[i])
            bits = words[edges[k] : edges[k + 1]]
            members = tuple(float(32 * w + b) for w, word in enumerate(bits) for b in range(32) if word >> b & 1)
            # numbers are cut to whole ones; what is missing or negative is in no set, unless it counts as 0
            zero = missing == NO_MISSING and 0.0 in members
            return CategorySplit(name, members, *below, "left" if zero else "right", True)
        side = "left" if decision[i] & DEFAULT_LEFT else "right"
        if missing == NO_MISSING:  # a missing value counts as 0
            side = "left" if 0.0 <= threshold[i] else "right"
        zero = side if missing == ZERO_MISSING else None
        return Split(name, threshold[i], *below, False, side, zero)

    root = 0 if feature else -1
    return Tree(_stacked(root, lambda i: [] if i < 0 else [left[i], right[i]], make))


# One question a level --------------------------------------------------------


def from_symmetric_json(model: dict | str) -> Ensemble:
    """scale * sum of trees + bias, each tree a table of leaves addressed by the answers to its tests."""
    model = json.loads(model) if isinstance(model, str) else model
    loss = model.get("model_info", {}).get("params", {}).get("loss_function", {}).get("type")
    _refuse_unless_plain(loss)
    if "oblivious_trees" not in model:
        raise ValueError("the model has no symmetric trees")
    named = {f["feature_index"]: f for f in model["features_info"].get("float_features", [])}
    scale, bias = model.get("scale_and_bias", [1, [0.0]])
    bias = bias if isinstance(bias, list) else [bias]
    if len(bias) != 1:
        raise ValueError("the model has several outputs")
    built = []
    for tree in model["oblivious_trees"]:
        tests = []
        for split in tree.get("splits") or []:
            if split.get("split_type", "FloatFeature") != "FloatFeature":
                raise ValueError("a test is not of a number")
            known = named[split["float_feature_index"]]
            name = known.get("feature_id") or known.get("feature_name") or str(known["flat_feature_index"])
            # a value above the border sets the bit; what is missing sets it only if it counts as largest
            bound, strict = float32_test(float(np.nextafter(np.float32(split["border"]), np.float32(np.inf))))
            above = known.get("nan_value_treatment", "AsIs") == "AsTrue"
            tests.append((name, bound, strict, "right" if above else "left"))
        built.append(SymmetricTree(tuple(tests), tuple(float(v) for v in tree["leaf_values"])))
    return Ensemble(tuple(built), (float(scale),) * len(built), float(bias[0]))


# Files -----------------------------------------------------------------------


def parse_dump(text: str, base_score: float = 0.0, features: list[str] | None = None) -> Ensemble:
    """A model from the text of a dump of any of the kinds."""
    start = text.lstrip()[:1]
    if start == "[":
        return from_split_dump(text, base_score, features)
    if start != "{":
        return from_leafwise_text(text)
    model = json.loads(text)
    return from_split_model(model, features) if "learner" in model else from_symmetric_json(model)


def load_dump(spark: SparkSession, path: str, base_score: float = 0.0, features: list[str] | None = None) -> Ensemble:
    """A model file, read by Spark's text reader, wherever it lies; reading it runs no code."""
    return parse_dump(spark.read.text(path, wholetext=True).first()["value"], base_score, features)
