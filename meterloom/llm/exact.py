"""Exact dedup with a heavy-hitter split.

A Misra-Gries pass over the digests names every digest that more than
`support` of the rows share, and perhaps some others; an exact count confirms
them. There are at most 1 / `support` of them, whatever the input, so they are
broadcast and their rows are settled where they lie. All other digests go
through an ordinary shuffle, in which no group exceeds `support` of the rows.

Defined cases: a null text counts as empty. The row with the largest id stays;
a null id is smaller than any other, and of rows that share text and id one
stays. An empty table gives an empty result. Columns of the input whose names
clash with those made here are not touched: only `id_col` and `text_col` are
read by `label_copies`, and `drop_copies` works under reserved names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterloom.session import settle

SUPPORT = 0.001
DIGEST, ROW = "_xd_digest", "_xd_row"


def text_digest(text_col: str):
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


def frequent_digests(digests: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Digests found by Misra-Gries, with exact counts; at most 1 / support rows.

    `digests` has DIGEST and an order column `place`; the result also has the
    largest `place` of each digest. `freqItems` counts binary values by identity,
    so it gets the digests as hex text, which it compares by value.
    """
    items = digests.select(F.hex(DIGEST).alias(DIGEST)).freqItems([DIGEST], support)
    candidates = items.select(F.explode(f"{DIGEST}_freqItems").alias(DIGEST)).distinct()
    candidates = candidates.select(F.unhex(DIGEST).alias(DIGEST))
    n = F.lit(digests.count() * support)
    return (
        digests.join(F.broadcast(candidates), DIGEST)
        .groupBy(DIGEST)
        .agg(F.count("*").alias("n"), F.max("place").alias("winner"))
        .where(F.col("n") > n)
    )


def label_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    keyed = docs.select(
        F.col(id_col).alias("doc_id"), text_digest(text_col).alias(DIGEST), F.monotonically_increasing_id().alias(ROW)
    )
    keyed = settle(keyed, "digests").withColumn("place", F.struct("doc_id", ROW))
    hot = F.broadcast(settle(frequent_digests(keyed, support), "hot-digests"))
    frequent = keyed.join(hot, DIGEST)
    of_digest = Window.partitionBy(DIGEST)
    rare = (
        keyed.join(hot.select(DIGEST), DIGEST, "left_anti")
        .withColumn("n", F.count("*").over(of_digest))
        .withColumn("winner", F.max("place").over(of_digest))
    )
    columns = [
        "doc_id",
        F.col("winner.doc_id").alias("keep_id"),
        F.col("n").cast("long").alias("group_size"),
        (F.col(f"winner.{ROW}") == F.col(ROW)).alias("kept"),
        F.lower(F.hex(DIGEST)).alias("text_sha256"),
    ]
    return frequent.select(*columns).unionByName(rare.select(*columns))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """`docs` without copies, columns as given.

    Copies of frequent texts are removed where they are read. What is left of
    those texts are rows that share both text and id with the winner; they are
    reduced to one per task before they are shuffled.
    """
    keyed = docs.select(text_digest(text_col).alias(DIGEST), F.struct(F.col(id_col).alias("id")).alias("place"))
    hot = F.broadcast(settle(frequent_digests(settle(keyed, "digests"), support), "hot-digests"))
    tagged = docs.withColumn(DIGEST, text_digest(text_col))
    winners = tagged.join(hot.select(DIGEST, F.col("winner.id").alias("_xd_winner")), DIGEST).where(
        F.col(id_col).eqNullSafe(F.col("_xd_winner"))
    )
    latest = Window.partitionBy(DIGEST).orderBy(F.col(id_col).desc_nulls_last())
    rare = (
        tagged.join(hot.select(DIGEST), DIGEST, "left_anti")
        .withColumn(ROW, F.row_number().over(latest))
        .where(F.col(ROW) == 1)
    )
    one_each = winners.dropDuplicates([DIGEST])
    return one_each.select(*docs.columns).unionByName(rare.select(*docs.columns))
