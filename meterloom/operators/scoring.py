"""Scoring a table: features in, (row id, prediction) out."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterloom.functions.models import Stack
from meterloom.operators.pipeline import pipeline_features, score_pipeline
from meterloom.operators.pymodel import PythonModel

CSV_NAMES = {"row_id": "Row Id", "prediction": "Prediction"}


def model_features(model) -> list[str]:
    """The columns a model needs; compiled, Python and Spark ML models alike."""
    return pipeline_features(model) if isinstance(model, PipelineModel) else list(model.features)


#: Where the errors of a Python model stand when it scores by unit.
ERRORS = ("_error_class", "_error")


def with_prediction(df: DataFrame, model, output: str = "prediction", unit: Column | None = None) -> DataFrame:
    """Add a model's prediction, whatever its kind; with `unit`, a Python model's errors as columns ERRORS."""
    if isinstance(model, PythonModel) and unit is not None:
        judged = df.withColumn("_outcome", model.outcome(unit))
        value = F.col("_outcome.value")
        return judged.withColumns(
            {
                output: F.when(~F.isnan(value), value),
                ERRORS[0]: F.col("_outcome.error_class"),
                ERRORS[1]: F.col("_outcome.error"),
            }
        ).drop("_outcome")
    if isinstance(model, PipelineModel):
        return score_pipeline(df, model).withColumnRenamed("prediction", output)
    if isinstance(model, Stack):
        # Columns of their own, so that a base is computed once however often it is used.
        bases = {f"_base_{name}": c for name, c in model.base_columns().items()}
        inputs = lambda f: F.col(f"_base_{f}") if f in model.bases else F.col(f)
        return df.withColumns(bases).withColumn(output, model.meta.column(inputs)).drop(*bases)
    return df.withColumn(output, model.column())


def score(
    df: DataFrame,
    model,
    *,
    on_null: str = "null",
    means: dict[str, float] | DataFrame | None = None,
    unit: str | None = None,
    apart: Column | None = None,
    output: str = "prediction",
) -> DataFrame:
    """Add the model's prediction to every row.

    `model`: a compiled model, a `PythonModel` or a fitted Spark ML pipeline.
    on_null: what a missing feature does.
      "null": the prediction is null and `null_features` names the missing ones;
      "drop": the row is dropped;
      "mean": the feature's mean is used: from `means` if given (by feature, or a
        table as from `unit_means`); else over the rows that share the value of
        column `unit`, or over all of `df` without a unit.
    apart: what must not share a call of a Python model, see `PythonModel.outcome`.
    """
    features = model_features(model)
    if on_null == "drop":
        return with_prediction(df.dropna(subset=features), model, output, apart)
    if on_null == "mean":
        if means is None:
            means = feature_means(df, features) if unit is None else unit_means(df, features, unit)
        if isinstance(means, DataFrame):
            df = df.join(means, unit, "left")
            mean = {f: F.col(f"_mean_{f}") for f in features}
        else:
            mean = {f: F.lit(means[f]) for f in features}
        return _with_filled(df, model, output, mean, apart).drop(*[f"_mean_{f}" for f in features])
    if on_null != "null":
        raise ValueError(f"unknown on_null {on_null!r}")
    return with_prediction(df, model, output, apart).withColumn("null_features", null_features(features))


def _with_filled(df: DataFrame, model, output: str, mean: dict[str, Column], apart: Column | None = None) -> DataFrame:
    """Predict with stand-ins for missing features; the features themselves stay as they are."""
    own = {f: f"_own_{f}" for f in mean}
    filled = df.withColumnsRenamed(own).withColumns(
        {f: F.coalesce(F.col(f"`{own[f]}`"), m) for f, m in mean.items()}
    )
    scored = with_prediction(filled, model, output, apart)
    made = [c for c in (output, *ERRORS) if c in scored.columns]
    return scored.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in df.columns], *made)


def _mean(feature: str) -> Column:
    """To twelve digits: the last ones of a sum of doubles depend on the order of the rows."""
    value = F.col(f"`{feature}`").cast("double")
    finite = F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)
    return F.format_string("%.11e", F.avg(finite)).try_cast("double")


def feature_means(df: DataFrame, features: list[str]) -> dict[str, float]:
    return df.agg(*[_mean(f).alias(f) for f in features]).first().asDict()


def unit_means(df: DataFrame, features: list[str], unit: str) -> DataFrame:
    """(unit, _mean_<feature>...): means over the rows of each unit, a row per unit."""
    return df.groupBy(unit).agg(*[_mean(f).alias(f"_mean_{f}") for f in features])


def null_features(features: list[str]) -> Column:
    """Names of the row's missing features; null when none is missing."""
    any_missing = reduce(Column.__or__, [F.col(f).isNull() for f in features], F.lit(False))
    named = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in features]))
    return F.when(any_missing, named)


def to_output(df: DataFrame, *keys: str) -> DataFrame:
    """Exactly the key columns and the prediction, in this order."""
    return df.select(*(keys or ("row_id",)), "prediction")


def in_row_order(df: DataFrame, *keys: str) -> DataFrame:
    """Ascending by row id, missing ids last."""
    return df.orderBy(*[F.col(k).asc_nulls_last() for k in keys or ("row_id",)])


def with_csv_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(CSV_NAMES)
