"""The feature catalog, the required-column check and feature profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The required features in order, each with its description and kind.
FEATURES = [
    ("mels_S", "Miscellaneous electric load for the South Wing of the building", "load"),
    ("lig_S", "Lighting load for the South Wing", "load"),
    ("mels_N", "Miscellaneous electric load for the North Wing of the building", "load"),
    ("air_temp_set_1", "Outdoor air temperature from sensor 1", "weather"),
    ("relative_humidity_set_1", "Relative humidity from sensor 1", "weather"),
    ("solar_radiation_set_1", "Solar radiation from sensor 1", "weather"),
    ("intTemp", "Zone temperature of interior zone", "zone"),
    ("extTemp", "Zone temperature of exterior zone", "zone"),
    ("airSpeed", "Supply air fan speed of Zones", "zone"),
    ("waterHeat", "Heating water valve position of Zones", "zone"),
    ("hp_hws_temp", "Heat pump heating water supply temperature", "plant"),
    ("rtuSat", "Roof Top Unit supply air temperature setpoint", "plant"),
    ("rtuRat", "Roof Top Unit return air temperature", "plant"),
    ("rtuMat", "Roof Top Unit mixed air temperature", "plant"),
    ("rtuOat", "Roof Top Unit outdoor air temperature", "plant"),
    ("rtuFan", "Roof Top Unit supply fan speed", "plant"),
    ("hvac_total", "Total HVAC load for the building", "load"),
]

CATALOG_SCHEMA = "ord int, feature string, description string, kind string"


def feature_schema(features=None) -> T.StructType:
    """All-double schema of the given (default: the catalog's) features."""
    names = features or [f for f, _, _ in FEATURES]
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


def catalog(spark: SparkSession, features=None) -> DataFrame:
    """(ord, feature, description, kind); `features` is a list of such triples."""
    rows = [(i, *entry) for i, entry in enumerate(features or FEATURES, start=1)]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def missing_features(headers: DataFrame, features: list[str]) -> DataFrame:
    """(source_file, feature) for each wanted feature a file's header lacks.

    `headers` has one row per file with its column names in `names`.
    """
    wanted = headers.withColumn("feature", F.explode(F.array(*map(F.lit, features))))
    return wanted.where(~F.array_contains("names", F.col("feature"))).drop("names")


def profile_features(df: DataFrame, features: DataFrame, names: list[str]) -> DataFrame:
    """Catalog rows joined to null count, minimum and maximum of their column.

    One aggregation over `df` covers all features; its single row is unpivoted.
    """
    stats = df.agg(
        F.count("*").alias("n_rows"),
        *[F.struct(
            F.count_if(F.col(n).isNull()).alias("n_null"),
            F.min(n).cast("double").alias("minimum"),
            F.max(n).cast("double").alias("maximum"),
        ).alias(f"s_{i}") for i, n in enumerate(names)],
    )
    tall = stats.select(
        "n_rows",
        F.inline(
            F.array(
                *[F.struct(F.lit(n).alias("feature"), F.col(f"s_{i}").alias("s"))
                  for i, n in enumerate(names)]
            )
        ),
    ).select("feature", "n_rows", "s.*")
    return features.join(F.broadcast(tall), "feature", "left").select(
        "ord", "feature", "description", "kind", "n_rows", "n_null", "minimum", "maximum"
    )
