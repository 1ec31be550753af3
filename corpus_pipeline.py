"""A corpus pipeline of five operators: `run(spark, sf_dir)` applies STAGES to `documents`.

Every stage reads what its predecessor kept, written as Parquet under the folder
of `spark.checkpoint.dir`, so a lost executor costs a stage's tasks at most.
SQL cannot express the learned first stage, so there is no ORACLE_SQL; the tests
hold `run` against a plain Python version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.llm import exact, hyperminhash, langid, packing, secret_scan
from meterloom.session import settle

ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the model is sure of; it is trained on their own labels."""
    model = langid.train(docs, usable=~langid.held_out())
    judged = langid.predict(docs, model, made=("_li_lang", "_li_score", "_li_rejected"))
    return judged.where("not _li_rejected").select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id."""
    return exact.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a similarity of 0.8 on five-word shingles, the row with the smallest id."""
    return hyperminhash.drop_near_copies(docs, words=5)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; n_chars follows the text."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces that training reads, with their ids."""
    return packing.number_sequences(packing.cut(docs))


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("secret scans", redact_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), "stage-" + name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
