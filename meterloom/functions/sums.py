"""Exact sums of products of columns, by blocks of rows.

Sums of doubles depend on the order of the rows. Here every column is shifted by
the middle of its range and taken to a whole number of 2^-50 of that range, which
is finer than a double can tell values of that range apart. Whole numbers are cut
into three parts of 17 bits, so that the products of a block of rows are plain
matrix products without rounding; the parts' sums are joined once at the end.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.session import fence

# Executors get these helpers with the task and need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 50
PART_BITS = 17
BLOCK_ROWS = 4096
ROW = "grp bigint, i int, j int, " + ", ".join(f"s{k} decimal(38,0)" for k in range(5))


def usable(columns: list[str]) -> Column:
    """Rows whose values are all there and finite; others take no part in a fit."""
    test = F.lit(True)
    for c in columns:
        value = F.col(f"`{c}`").cast("double")
        test = test & value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    return test


def _parts(values: np.ndarray) -> list[np.ndarray]:
    """Low, middle and high part of whole numbers; only the high part has a sign."""
    mask = (1 << PART_BITS) - 1
    low, middle, high = values & mask, (values >> PART_BITS) & mask, values >> (2 * PART_BITS)
    return [p.astype(np.float64) for p in (low, middle, high)]


def product_sums(df: DataFrame, columns: list[str], group: Column | None = None) -> dict[int, dict]:
    """{group: {(a, b): Fraction}} over the usable rows; "" stands for the constant 1.

    Two passes: the ranges of the columns, then one small matrix per task and
    group. Groups are whole numbers; without `group` the only one is 0. In each
    pass a derived column is computed once: the fence keeps the tests on its value
    from being replaced by its expression.
    """
    names = ["", *columns]
    n = len(columns)
    projected = df.select(
        (F.lit(0) if group is None else group).cast("long").alias("grp"),
        *[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)],
    )
    finite = [F.abs(F.col(f"c{i}")) < F.lit(float("inf")) for i in range(n)]  # NaN is above infinity
    numbers = fence(projected).where(reduce(Column.__and__, finite, F.col("_fence"))).drop("_fence")
    bounds = numbers.agg(*[f(f"c{i}") for i in range(n) for f in (F.min, F.max)]).first()
    centres, exponents = [], []
    for low, high in zip(bounds[::2], bounds[1::2]):
        low, high = low or 0.0, high or 0.0
        middle = low / 2 + high / 2
        centres.append(middle)
        exponents.append(math.frexp(max(high - middle, middle - low))[1] - BITS)
    shift, scale = np.array(centres), np.array(exponents)

    def add_up(batches: Iterator) -> Iterator:
        import pyarrow as pa

        totals: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            groups = batch.column(0).to_numpy(zero_copy_only=False)
            values = np.stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(n)], axis=1)
            whole = np.rint(np.ldexp(values - shift, -scale)).astype(np.int64)
            for g in np.unique(groups).tolist():
                own = whole[groups == g]
                for at in range(0, len(own), BLOCK_ROWS):
                    block = own[at : at + BLOCK_ROWS]
                    parts = _parts(np.concatenate([np.ones((len(block), 1), np.int64), block], axis=1))
                    total = totals.setdefault(g, [np.zeros((n + 1, n + 1), object) for _ in range(5)])
                    for a in range(3):
                        for b in range(3):
                            total[a + b] += (parts[a].T @ parts[b]).astype(np.int64).astype(object)
        rows = [
            (g, i, j, *[total[k][i, j] for k in range(5)])
            for g, total in totals.items()
            for i in range(n + 1)
            for j in range(i, n + 1)
        ]
        if rows:
            from decimal import Decimal

            fixed = list(zip(*rows))
            sums = [pa.array([Decimal(int(v)) for v in c], pa.decimal128(38, 0)) for c in fixed[3:]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(fixed[0], pa.int64()), pa.array(fixed[1], pa.int32()), pa.array(fixed[2], pa.int32()), *sums],
                names=["grp", "i", "j", *[f"s{k}" for k in range(5)]],
            )

    summed = numbers.mapInArrow(add_up, ROW).groupBy("grp", "i", "j")
    # a row per group and pair of columns
    rows = summed.agg(*[F.sum(f"s{k}").cast("decimal(38,0)").alias(f"s{k}") for k in range(5)]).collect()
    whole: dict[int, dict[tuple[int, int], int]] = {}
    for r in rows:
        whole.setdefault(r["grp"], {})[(r["i"], r["j"])] = sum(
            int(r[f"s{k}"]) << (PART_BITS * k) for k in range(5)
        )
    return {g: _in_units(sums, names, centres, exponents) for g, sums in whole.items()}


def _in_units(sums: dict, names: list[str], centres: list[float], exponents: list[int]) -> dict:
    """Sums of products of the columns, from those of their shifted whole numbers."""
    count = sums[(0, 0)]
    unit = [Fraction(1), *[Fraction(2) ** e for e in exponents]]
    centre = [Fraction(0), *[Fraction(c) for c in centres]]
    out = {}
    for (i, j), s in sums.items():
        if i == 0:
            value = Fraction(count) if j == 0 else count * centre[j] + unit[j] * s
        else:
            value = (
                count * centre[i] * centre[j]
                + centre[i] * unit[j] * sums[(0, j)]
                + centre[j] * unit[i] * sums[(0, i)]
                + unit[i] * unit[j] * s
            )
        out[(names[i], names[j])] = value
    return out
