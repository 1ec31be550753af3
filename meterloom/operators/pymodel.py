"""Scoring with any Python model, batch by batch on the executors."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from types import ModuleType

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors get these helpers with the task and need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# What is said of predictions that do not match their rows.
WRONG_LENGTH = "All arrays must be of the same length"
WRONG_SHAPE = "Per-column arrays must each be 1-dimensional"

#: A prediction, or the class and text of the error that stood in its way.
OUTCOME = "value double, error_class string, error string"


def loaded(load: Callable, token: str) -> Callable:
    """`load()`, or what it gave before in this worker; a failed load fails again, without another try.

    A module made here lives as long as the worker; no package is needed there.
    """
    worker = sys.modules.setdefault("_meterloom_worker", ModuleType("_meterloom_worker"))
    if getattr(worker, "token", None) != token:
        worker.predict = worker.failure = None
        worker.token = token
        try:
            worker.predict = load()
        except Exception as e:
            worker.failure = e
    if worker.failure is not None:
        raise worker.failure
    return worker.predict


def error_class(error: Exception) -> str:
    """The class of a file's status that an error in a model stands for."""
    if isinstance(error, UnicodeDecodeError):
        return "encoding"
    if isinstance(error, KeyError):
        return "missing_column"
    return "malformed" if isinstance(error, pd.errors.ParserError) else "model"


def checked(values, n: int, wrong_length: str | None = None) -> np.ndarray:
    """Predictions as doubles, one for each of `n` rows; `wrong_length` is said if there are more or fewer."""
    values = np.asarray(values)
    if values.ndim != 1:
        raise ValueError(WRONG_SHAPE)
    if len(values) != n:
        raise ValueError(wrong_length or f"{len(values)} predictions for {n} rows")
    return values.astype("float64")


def score_python(
    df: DataFrame,
    features: list[str],
    load: Callable[[], Callable],
    *,
    keys: tuple[str, ...] = ("row_id",),
) -> DataFrame:
    """Keys plus `prediction` from a model given as `load() -> predict(frame)`.

    `predict` gets a pandas frame with the features in the given order and
    returns one number per row. It sees one Arrow batch at a time, so it must
    treat rows independently. Each Python worker loads the model once.
    Only keys and features are sent to Python.
    """
    fields = [df.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("prediction", T.DoubleType())])
    token = uuid.uuid4().hex
    def run(batches):
        predict = loaded(load, token)
        for batch in batches:
            out = batch[list(keys)].copy()
            out["prediction"] = checked(predict(batch[features]), len(batch))
            yield out

    columns = list(dict.fromkeys([*keys, *features]))
    return df.select(*columns).mapInPandas(run, schema)


@dataclass(frozen=True)
class PythonModel:
    """A Python model that scores wherever a compiled one does.

    `load() -> predict(frame)` as in `score_python`. Rows with a missing feature
    are not handed to the model and have no prediction, unless it takes them
    (`takes_missing`, as NaN).

    `column` raises what the model raises, and so ends the job. `outcome` hands the
    model the rows of one unit (a file) at a time and returns its errors as values.
    """

    features: list[str]
    load: Callable[[], Callable]
    takes_missing: bool = False
    token: str = field(default_factory=lambda: uuid.uuid4().hex, compare=False)

    def column(self, inputs=None) -> Column:
        value = inputs or F.col
        names, load, token, takes_missing = list(self.features), self.load, self.token, self.takes_missing
        @F.pandas_udf("double")
        def predict(frame: pd.DataFrame) -> pd.Series:
            model = loaded(load, token)
            frame.columns = names
            wanted = np.ones(len(frame), bool) if takes_missing else frame.notna().all(axis=1).to_numpy()
            out = pd.Series(np.nan, index=frame.index, dtype="float64")
            if wanted.any():
                out[wanted] = checked(model(frame[wanted]), wanted.sum())
            return out

        predicted = predict(self._inputs(value))
        return F.when(~F.isnan(predicted), predicted)

    def outcome(self, unit: Column, inputs=None) -> Column:
        """OUTCOME of each row. Rows of a null unit are not handed to the model.

        The rows of a unit that lie in one Arrow batch are scored together and share
        an error; no other unit has part in it. An error is any `Exception`; what ends
        the worker itself (or the job's memory) still ends the job.
        """
        value = inputs or F.col
        names, load, token, takes_missing = list(self.features), self.load, self.token, self.takes_missing
        @F.pandas_udf(OUTCOME)
        def judge(units: pd.Series, frame: pd.DataFrame) -> pd.DataFrame:
            frame.columns = names
            wanted = units.notna().to_numpy()
            if not takes_missing:
                wanted &= frame.notna().all(axis=1).to_numpy()
            n = len(frame)
            values, classes, errors = np.full(n, np.nan), np.full(n, None, object), np.full(n, None, object)
            codes, _ = pd.factorize(units[wanted])
            places = np.flatnonzero(wanted)
            for code in range(codes.max(initial=-1) + 1):
                at = places[codes == code]
                try:
                    values[at] = checked(loaded(load, token)(frame.iloc[at].reset_index(drop=True)), len(at), WRONG_LENGTH)
                except Exception as e:
                    values[at], classes[at], errors[at] = np.nan, error_class(e), str(e)
            return pd.DataFrame({"value": values, "error_class": classes, "error": errors})

        return judge(unit, self._inputs(value))

    def _inputs(self, value) -> Column:
        return F.struct(*[value(f).cast("double").alias(f"c{i}") for i, f in enumerate(self.features)])
