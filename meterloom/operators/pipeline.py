"""Models trained with Spark ML: fit, save, load, score, and compile to columns."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressionModel,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.functions.models import CategorySplit, Ensemble, Leaf, Linear, Split, Stack, Tree
from meterloom.session import scratch_path

REGRESSORS = {
    "linear": LinearRegression,
    "tree": DecisionTreeRegressor,
    "forest": RandomForestRegressor,
    "boosted": GBTRegressor,
}


#: Values (features and label) of a partition above which trees are fitted on rows dealt anew.
FIT_VALUES = 2_000_000


def _dealt_for_trees(df: DataFrame, n_columns: int) -> DataFrame:
    """`df` in partitions of at most about FIT_VALUES values.

    Trees are fitted on rows held as objects, some sixty bytes a value, and a task reads
    a partition of them whole in every round; a file's split holds many more rows than that.
    """
    sizes = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"))  # a row per partition
    largest, n = sizes.agg(F.max("n"), F.sum("n")).first()
    rows = max(1, FIT_VALUES // n_columns)
    return df if (largest or 0) <= rows else df.repartition(-(-n // rows))


def fit_pipeline(df: DataFrame, features: list[str], label: str, kind: str = "linear", **params):
    """A `PipelineModel`: features into a vector, then one regressor. Rows with a
    missing feature or label are left out of the fit."""
    if kind != "linear":
        df = _dealt_for_trees(df, len(features) + 1)
    stages = [
        VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="skip"),
        REGRESSORS[kind](
            featuresCol="_features", labelCol=label, predictionCol="prediction", **params
        ),
    ]
    return Pipeline(stages=stages).fit(df.dropna(subset=[label]))


def fit_stacked_pipeline(
    df: DataFrame,
    bases: dict[str, tuple[str, list[str], dict]],
    label: str,
    fold,
    k: int,
    meta: str = "linear",
):
    """Any regressors under a meta regressor, as one `PipelineModel`.

    `bases` maps a name to (kind, features, params). The meta model is fitted on
    predictions by models that have not seen the row: k fits per base, each on
    the other folds. The returned pipeline holds bases fitted on all rows. Every
    fit scans `df`, so hand in a written table rather than a long computation.
    """
    names = list(bases)
    complete = df.dropna(subset=[label, *{f for _, fs, _ in bases.values() for f in fs}])
    folded = complete.withColumn("_fold", fold)
    # All k models of a base predict every row and the row's fold picks one: one
    # scan for the meta fit instead of one per fold.
    judged = folded
    for name, (kind, features, params) in bases.items():
        chosen = F.lit(None).cast("double")
        for i in range(k):
            column = f"_{name}_{i}"
            model = _base(column, kind, features, label, params).fit(
                folded.where(F.col("_fold") != i)
            )
            judged = model.transform(judged).drop(f"_{column}_features")
            chosen = F.when(F.col("_fold") == i, F.col(column)).otherwise(chosen)
        judged = judged.withColumn(name, chosen).drop(*[f"_{name}_{i}" for i in range(k)])
    held_out = judged.where(F.col("_fold").between(0, k - 1)).select(label, *names)
    top = Pipeline(
        stages=[
            VectorAssembler(inputCols=names, outputCol="_meta_features", handleInvalid="keep"),
            REGRESSORS[meta](
                featuresCol="_meta_features", labelCol=label, predictionCol="prediction"
            ),
        ]
    ).fit(held_out)
    full = [_base(n, kind, fs, label, ps).fit(complete) for n, (kind, fs, ps) in bases.items()]
    return PipelineModel(stages=[*full, top])


def _base(name, kind, features, label, params) -> Pipeline:
    vector = f"_{name}_features"
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=features, outputCol=vector, handleInvalid="keep"),
            REGRESSORS[kind](featuresCol=vector, labelCol=label, predictionCol=name, **params),
        ]
    )


def pipeline_features(model: PipelineModel) -> list[str]:
    """The columns a fitted pipeline takes from outside."""
    made, taken = set(), []
    for stage in _stages(model):
        if isinstance(stage, VectorAssembler):
            taken += [c for c in stage.getInputCols() if c not in made]
            made.add(stage.getOutputCol())
        else:
            made.add(stage.getPredictionCol())
    return list(dict.fromkeys(taken))


def score_pipeline(df: DataFrame, model: PipelineModel, features: list[str] | None = None) -> DataFrame:
    """Add `prediction`; null where a feature is missing, so no row is lost.

    The caller's model is left as it is.
    """
    complete = F.lit(True)
    for f in features or pipeline_features(model):
        complete = complete & F.col(f).isNotNull()
    # The assembler keeps rows with missing features as NaN; their result is blanked.
    lenient = _lenient(model)
    made = [c for c in lenient.transform(df.limit(0)).columns if c not in df.columns]
    scored = lenient.transform(df).withColumn("prediction", F.when(complete, F.col("prediction")))
    return scored.drop(*[c for c in made if c != "prediction"])


def _lenient(model: PipelineModel) -> PipelineModel:
    """A copy whose assemblers keep rows with missing features."""
    stages = []
    for stage in model.stages:
        if isinstance(stage, PipelineModel):
            stage = _lenient(stage)
        elif isinstance(stage, VectorAssembler):
            stage = stage.copy().setHandleInvalid("keep")
        stages.append(stage)
    return PipelineModel(stages=stages)


def _stages(model):
    for stage in model.stages:
        if isinstance(stage, PipelineModel):
            yield from _stages(stage)
        else:
            yield stage


def save_pipeline(model: PipelineModel, path: str) -> None:
    model.write().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def compile_pipeline(spark, model: PipelineModel):
    """The plain-data form of a fitted pipeline, for scoring as columns.

    A pipeline of pipelines (see `fit_stacked_pipeline`) becomes a `Stack`. Tree
    nodes are read from the table Spark ML writes when it saves the model; they
    are the model itself and pass the driver.
    """
    if all(isinstance(stage, PipelineModel) for stage in model.stages):
        *bases, top = model.stages
        named = {base.stages[-1].getPredictionCol(): compile_pipeline(spark, base) for base in bases}
        return Stack(named, compile_pipeline(spark, top))
    assembler, fitted = model.stages
    features = assembler.getInputCols()
    if hasattr(fitted, "coefficients"):
        weights = [float(w) for w in fitted.coefficients]
        return Linear(dict(zip(features, weights)), float(fitted.intercept))
    path = scratch_path(spark, "ml-model")
    fitted.write().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    if "nodeData" not in nodes.columns:
        return _tree(nodes.collect(), features)
    trees: dict[int, list] = {}
    for row in nodes.select("treeID", "nodeData.*").collect():
        trees.setdefault(row["treeID"], []).append(row)
    members = tuple(_tree(trees[i], features) for i in sorted(trees))
    if isinstance(fitted, GBTRegressionModel):
        return Ensemble(members, tuple(float(w) for w in fitted.treeWeights))
    return Ensemble(members, (1.0 / len(members),) * len(members))


def _category_split(feature: str, split, left, right) -> CategorySplit:
    """The smaller of the two sets decides, so that a category never seen takes the larger side."""
    n, of_left = split["numCategories"], {float(c) for c in split["leftCategoriesOrThreshold"]}
    if len(of_left) <= n / 2:
        return CategorySplit(feature, tuple(sorted(of_left)), left, right)
    return CategorySplit(feature, tuple(c for c in map(float, range(n)) if c not in of_left), right, left)


def _tree(rows, features: list[str]) -> Tree:
    by_id = {row["id"]: row for row in rows}

    def build(i: int):
        row = by_id[i]
        if row["leftChild"] < 0:
            return Leaf(float(row["prediction"]))
        split = row["split"]
        if split["numCategories"] >= 0:
            return _category_split(
                features[split["featureIndex"]], split, build(row["leftChild"]), build(row["rightChild"])
            )
        return Split(
            features[split["featureIndex"]],
            float(split["leftCategoriesOrThreshold"][0]),
            build(row["leftChild"]),
            build(row["rightChild"]),
        )

    return Tree(build(0))
