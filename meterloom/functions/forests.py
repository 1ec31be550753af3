"""Trees walked in Arrow batches, for models too large for generated code."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Executors get these helpers with the task and need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A tree of at most so many tests is a table of all their outcomes.
TABLE_TESTS = 8
#: Inner nodes a level up to which asking all of them costs less than following each row.
WHOLE_TREE = 16
#: Levels beyond which a tree is not nested.
DEEP = 64
#: Outcomes of tests kept at a time; a batch is cut into fewer rows when a model has many.
OUTCOMES = 32 << 20


def _test(node, place: dict[str, int]) -> tuple:
    """What an inner node asks, without its children; equal tests of all trees are asked once."""
    numeric = hasattr(node, "threshold")
    threshold, strict, zero = (float(node.threshold), bool(node.strict), node.zero) if numeric else (0.0, False, None)
    categories, whole = (None, False) if numeric else (tuple(sorted({float(c) for c in node.categories})), bool(node.whole))
    return place[node.feature], threshold, strict, node.missing, zero, categories, whole


def _goes_left(test, values, null) -> np.ndarray:
    """The outcome of a test for every row; where it needs a feature that is missing, anything."""
    feature, threshold, strict, missing, zero, categories, whole = test
    own = values[feature]
    if categories is not None:
        known, cut = np.append(categories, np.nan), np.trunc(own) if whole else own
        left = known[np.searchsorted(known[:-1], cut)] == cut
    elif threshold != threshold:  # nothing is above NaN
        left = ~np.isnan(own) if strict else np.ones(len(own), bool)
    else:  # NaN is above any threshold, as in columns
        left = own < threshold if strict else own <= threshold
    if zero is not None:
        left = np.where(np.abs(own) <= 1e-35, zero == "left", left)
    if missing is not None:
        left = np.where(null[feature] | np.isnan(own), missing == "left", left)
    return left


def _depth_and_size(root) -> tuple[int, int]:
    """Levels and inner nodes."""
    deepest, inner, todo = 0, 0, [(root, 0)]
    while todo:
        node, level = todo.pop()
        deepest = max(deepest, level)
        if not hasattr(node, "value"):
            inner += 1
            todo += [(node.left, level + 1), (node.right, level + 1)]
    return deepest, inner


def _prepared(tree, weight: float, place: dict[str, int], known: dict[tuple, int]) -> tuple:
    """A tree in the form that is cheapest to evaluate, its leaves weighted; `known` numbers the tests.

    ("table", tests, leaves): the outcomes are the bits of a leaf's number, set where a test goes right.
    ("whole", node): nested (test, left, right), with numbers as leaves.
    ("walk", arrays): see `_flat`.
    """
    number = lambda test: known.setdefault(test, len(known))
    if hasattr(tree, "tests"):
        asked = [number((place[f], float(t), bool(s), m, None, None, False)) for f, t, s, m in tree.tests]
        return "table", asked, weight * np.array(tree.leaves, float)
    depth, inner = _depth_and_size(tree.root)
    if inner > WHOLE_TREE * max(depth, 1) or depth > DEEP:
        return "walk", _flat(tree.root, place, weight)

    def nested(node):
        if hasattr(node, "value"):
            return weight * float(node.value)
        return number(_test(node, place)), nested(node.left), nested(node.right)

    def tests(node) -> set[int]:
        return {node[0]} | tests(node[1]) | tests(node[2]) if isinstance(node, tuple) else set()

    root = nested(tree.root)
    asked = sorted(tests(root))
    if len(asked) > TABLE_TESTS:
        return "whole", root
    leaves = []
    for outcome in range(1 << len(asked)):
        node = root
        while isinstance(node, tuple):
            node = node[1 + (outcome >> asked.index(node[0]) & 1)]
        leaves.append(node)
    return "table", asked, np.array(leaves, float)


def _flat(root, place: dict[str, int], weight: float):
    """Arrays over the nodes of a tree; a leaf leads to itself. Also the depth.

    `group` is the row of a node in the table of category sets (`_sets`), or -1.
    """
    feature, threshold, strict, missing, left, right, value, zero, group = [], [], [], [], [], [], [], [], []
    depth, sets = 0, []
    todo = [(root, None, None, 0)]
    while todo:
        node, parent, side, level = todo.pop()
        at = len(value)
        depth = max(depth, level)
        if parent is not None:
            (left if side == 0 else right)[parent] = at
        leaf = hasattr(node, "value")
        feature.append(0 if leaf else place[node.feature])
        numeric = not leaf and hasattr(node, "threshold")
        threshold.append(float(node.threshold) if numeric else 0.0)
        strict.append(numeric and node.strict)
        side = node.zero if numeric else None
        zero.append(-1 if side is None else int(side == "left"))
        group.append(-1)
        if not leaf and not numeric:
            group[-1] = len(sets)
            sets.append((node.categories, node.whole))
        missing.append(-1 if leaf or node.missing is None else int(node.missing == "left"))
        left.append(at)
        right.append(at)
        value.append(weight * float(node.value) if leaf else 0.0)
        if not leaf:
            todo += [(node.left, at, 0, level + 1), (node.right, at, 1, level + 1)]
    arrays = [np.array(a) for a in (feature, threshold, strict, missing, left, right, value, zero, group)]
    return (*arrays, _sets(sets), depth)


def _sets(sets):
    """Known categories, a bit for each set and category, and which sets cut to whole numbers; None without sets."""
    if not sets:
        return None
    known = np.unique(np.concatenate([np.array(c, float) for c, _ in sets] or [np.zeros(0)]))
    bits = np.zeros((len(sets), len(known) + 1), bool)
    for i, (categories, _) in enumerate(sets):
        bits[i, np.searchsorted(known, np.array(categories, float))] = True
    return np.append(known, np.nan), bits, np.array([w for _, w in sets])


def _is_member(sets, group, own):
    """Whether each value is in the set of its group."""
    known, bits, whole = sets
    own = np.where(whole[group], np.trunc(own), own)
    at = np.searchsorted(known[:-1], own)
    return bits[group, at] & (known[at] == own)


def _walked(flat, values, null) -> np.ndarray:
    """The leaf of every row, all rows a level further at a time."""
    feature, threshold, strict, missing, left, right, value, zero, group, sets, depth = flat
    n = values.shape[1]
    rows, node = np.arange(n), np.zeros(n, np.int64)
    for _ in range(depth):
        own, bound = values[feature[node], rows], threshold[node]
        below = np.where(strict[node], own < bound, own <= bound)
        # nothing is above NaN, and NaN is above any other threshold, as in columns
        goes_left = np.where(np.isnan(bound), ~(strict[node] & np.isnan(own)), below)
        if sets is not None:
            chosen = group[node]
            goes_left = np.where(chosen >= 0, _is_member(sets, np.maximum(chosen, 0), own), goes_left)
        goes_left = np.where((zero[node] >= 0) & (np.abs(own) <= 1e-35), zero[node] == 1, goes_left)
        absent = (null[feature[node], rows] | np.isnan(own)) & (missing[node] >= 0)
        goes_left = np.where(absent, missing[node] == 1, goes_left)
        node = np.where(goes_left, left[node], right[node])
    return value[node]


def _whole(node, outcomes):
    if not isinstance(node, tuple):
        return node
    return np.where(outcomes[node[0]], _whole(node[1], outcomes), _whole(node[2], outcomes))


def _total(forest, tests, intercept: float, values, null) -> np.ndarray:
    """intercept + sum of the trees, in their order."""
    n = values.shape[1]
    outcomes = [_goes_left(t, values, null) for t in tests]
    rights = [(~o).view(np.uint8) for o in outcomes]
    total = np.full(n, intercept)
    for kind, *tree in forest:
        if kind == "table":
            asked, leaves = tree
            bits = np.zeros(n, np.uint8 if len(asked) <= 8 else np.int64)
            for i, test in enumerate(asked):
                bits |= rights[test] << i if len(asked) <= 8 else rights[test].astype(np.int64) << i
            total += leaves.take(bits)
        elif kind == "whole":
            total += _whole(tree[0], outcomes)
        else:
            total += _walked(tree[0], values, null)
    return total


def _needed(tree) -> set[str]:
    """Features without which a tree has no prediction."""
    if hasattr(tree, "tests"):
        return {f for f, _, _, missing in tree.tests if missing is None}
    needed, todo = set(), [tree.root]
    while todo:
        node = todo.pop()
        if not hasattr(node, "value"):
            needed |= {node.feature} if node.missing is None else set()
            todo += [node.left, node.right]
    return needed


def walk_trees(trees, weights, intercept: float, features: list[str], inputs) -> Column:
    """intercept + sum(weight * tree); null where a feature that is needed is missing. Symmetric trees too."""
    place, known = {f: i for i, f in enumerate(features)}, {}
    forest = [_prepared(t, float(w), place, known) for t, w in zip(trees, weights)]
    needed = sorted({place[f] for t in trees for f in _needed(t)})
    tests, intercept, total_of = list(known), float(intercept), _total
    step = max(256, min(8192, OUTCOMES // max(2 * len(tests), 1)))

    @F.arrow_udf("double")
    def walk(columns):
        import pyarrow as pa

        n = len(columns)
        fields = [columns.field(i) for i in range(len(features))]
        null = np.stack([f.is_null().to_numpy(zero_copy_only=False) for f in fields])
        values = np.stack([f.fill_null(0.0).to_numpy(zero_copy_only=False) for f in fields])
        parts = [
            total_of(forest, tests, intercept, values[:, at : at + step], null[:, at : at + step])
            for at in range(0, n, step)
        ]
        blank = null[needed].any(axis=0) if needed else np.zeros(n, bool)
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64(), mask=blank)

    return walk(F.struct(*[inputs(f).cast("double").alias(f"c{i}") for i, f in enumerate(features)]))
