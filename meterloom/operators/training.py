"""Least squares and stacked models, fitted from sums.

Two passes over the data yield every sum a fit needs (see `functions.sums`); the
equations left to solve are as small as the feature list. Sums are exact, so
they are equal for every order and partitioning of the rows. Rows with a null,
NaN or infinite value in a used column take no part.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.functions.models import Linear, Stack
from meterloom.functions.sums import product_sums, usable


@dataclass
class Sums:
    """Sums of products of columns; "" stands for the constant 1."""

    products: dict[tuple[str, str], Fraction]

    def __sub__(self, other: Sums) -> Sums:
        return Sums({k: v - other.products.get(k, 0) for k, v in self.products.items()})

    def __add__(self, other: Sums) -> Sums:
        return Sums({k: v + other.products.get(k, 0) for k, v in self.products.items()})

    def of(self, a: str, b: str) -> Fraction:
        return self.products[(a, b)] if (a, b) in self.products else self.products[(b, a)]


def _pairs(features: list[str], label: str) -> list[tuple[str, str]]:
    return list(combinations_with_replacement(["", *features, label], 2))


def collect_sums(df: DataFrame, features: list[str], label: str) -> Sums:
    """Sums over the rows whose features and label are all there and finite."""
    empty = {pair: Fraction(0) for pair in _pairs(features, label)}
    return Sums(product_sums(df, [*features, label]).get(0, empty))


def collect_fold_sums(df, features: list[str], label: str, fold: Column, k: int) -> list[Sums]:
    """Sums per fold 0..k-1; rows of other folds take no part."""
    in_folds = df.withColumn("_fold", fold).where(F.col("_fold").between(0, k - 1))
    found = product_sums(in_folds, [*features, label], F.col("_fold"))
    empty = {pair: Fraction(0) for pair in _pairs(features, label)}
    return [Sums(found.get(i, empty)) for i in range(k)]


#: A feature with less than this share of its variance left after the others is taken to follow from them.
DEPENDENT = Fraction(1, 2**90)


def solve(sums: Sums, features: list[str], label: str) -> Linear:
    """Weights that minimise the squared error, by exact elimination in whole numbers."""
    names = ["", *features]
    exact = [[sums.of(a, b) for b in names] + [sums.of(a, label)] for a in names]
    shared = math.lcm(*[v.denominator for row in exact for v in row])
    rows = [[int(v * shared) for v in row] for row in exact]
    size, before, own = len(names), 1, [row[i] for i, row in enumerate(rows)]
    for i in range(size):
        # What is left on the diagonal is rows[i][i] / before: a sum of squares, never negative.
        if rows[i][i] <= own[i] * before * DEPENDENT:
            what = f"feature {names[i]!r} is constant or follows from the others" if i else "no rows to fit"
            raise ValueError(what)
        for r in range(i + 1, size):
            for c in range(size, i, -1):
                rows[r][c] = (rows[r][c] * rows[i][i] - rows[r][i] * rows[i][c]) // before
        before = rows[i][i]
        if i == 0:
            own = [Fraction(row[j], before) for j, row in enumerate(rows)]
    values = [Fraction(0)] * size
    for i in reversed(range(size)):
        rest = rows[i][-1] - sum(rows[i][c] * values[c] for c in range(i + 1, size))
        values[i] = Fraction(rest) / rows[i][i]
    return Linear(dict(zip(features, map(float, values[1:]))), float(values[0]))


def fit_linear(df: DataFrame, features: list[str], label: str) -> Linear:
    return solve(collect_sums(df, features, label), features, label)


@dataclass
class StackFit:
    """`model` is fitted on all rows; `folds[name][i]` on all rows but fold i."""

    model: Stack
    folds: dict[str, list[Linear]]
    fold: Column

    def out_of_fold(self, name: str) -> Column:
        """Prediction of base `name` by the model that has not seen the row."""
        cases = None
        for i, model in enumerate(self.folds[name]):
            hit, value = self.fold == i, model.column()
            cases = F.when(hit, value) if cases is None else cases.when(hit, value)
        return cases if self.model.decimals is None else F.round(cases, self.model.decimals)


def fit_stack(
    df: DataFrame,
    bases: dict[str, list[str]],
    label: str,
    fold: Column,
    k: int,
    decimals: int | None = None,
) -> StackFit:
    """Linear base models under a linear meta model.

    First come the sums per fold, which give all k models of every base. Then the
    meta model is fitted on out-of-fold base predictions, computed in the row.
    """
    features = list(dict.fromkeys(f for fs in bases.values() for f in fs))
    per_fold = collect_fold_sums(df, features, label, fold, k)
    total = per_fold[0]
    for part in per_fold[1:]:
        total = total + part
    folds = {
        name: [solve(total - part, fs, label) for part in per_fold] for name, fs in bases.items()
    }
    full = {name: solve(total, fs, label) for name, fs in bases.items()}
    names = list(bases)
    fit = StackFit(Stack(full, Linear({}), decimals), folds, fold)
    judged = df.where(usable([*features, label])).select(
        label, *[fit.out_of_fold(n).alias(n) for n in names]
    )
    fit.model = Stack(full, fit_linear(judged, names, label), decimals)
    return fit


def holdout_error(df: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """One row: n, rmse, mae, r2, over rows whose label and prediction are finite."""
    y = F.col(label).cast("double")
    error = y - F.col(prediction).cast("double")
    # an error is finite only where label and prediction are; other rows take no part in the sums
    judged = df.select(y.alias("y"), error.alias("error"), F.abs(error).alias("size"))
    sums = product_sums(judged, ["y", "error", "size"]).get(0)
    n, rmse, mae, r2 = 0, None, None, None
    if sums:
        n = int(sums[("", "")])
        squares = sums[("error", "error")]
        rmse, mae = math.sqrt(squares / n), float(sums[("", "size")] / n)
        spread = sums[("y", "y")] - sums[("", "y")] ** 2 / n
        r2 = float(1 - squares / spread) if spread else None
    return df.sparkSession.createDataFrame(
        [(n, rmse, mae, r2)], "n bigint, rmse double, mae double, r2 double"
    )
