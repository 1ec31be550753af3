"""The contract queries: each applies an operator to all of `documents` and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.llm import (
    automaton,
    exact,
    fingerprint,
    hyperminhash,
    infill,
    langid,
    neighbours,
    packing,
    pieces,
    secret_scan,
    shard,
    suffixes,
    whitening,
)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(_documents(spark, sf_dir), carry=["doc_id"])

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in secret_scan.BASE]
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id",
        *counts,
        F.sha2(secret_scan.span_text(base), 256).alias("base_sha256"),
        secret_scan.span_text(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_linked"),
    )


def op2_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = _documents(spark, sf_dir).select(
        "doc_id",
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("digest"),
        (F.octet_length(text) + 8).cast("long").alias("bytes"),
    )
    # ordered by text digest, equal texts lie side by side; by id within a group, so that a group can be cut
    sharded = shard.shard_by_bytes(rows, [F.col("digest"), F.col("doc_id")], F.col("bytes"), shards=24)
    return sharded.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = fingerprint.compare_with_edits(_documents(spark, sf_dir))
    lengths = hashed.withColumns(
        {f"_sq_{v}": fingerprint.square(F.col(v)) for v in ("vector", "edited_vector", "next_vector")}
    )
    likeness = lambda other: fingerprint.likeness(
        F.col("vector"), F.col(other), F.col("_sq_vector"), F.col(f"_sq_{other}")
    )
    return lengths.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint.show(F.col("vector")).alias("fingerprint"),
        fingerprint.show(F.col("edited_vector")).alias("edited_fingerprint"),
        likeness("edited_vector").alias("near_edited"),
        likeness("next_vector").alias("near_next"),
    )


def op4_streaming_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode_and_decode(_documents(spark, sf_dir))
    text = F.coalesce(F.col("text"), F.lit(""))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_ids"),
        F.crc32("ids").alias("ids_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.translate(text, pieces.MARK, " ")).alias("round_trip"),
    )


def op5_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.classes(_documents(spark, sf_dir), words=4).drop("crc")


def op6_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = automaton.remove_repeats(_documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), "n_spans")


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffixes.remove_repeats(_documents(spark, sf_dir))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.cut(_documents(spark, sf_dir)).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.number_sequences(cut).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.label_copies(_documents(spark, sf_dir).select("doc_id", "text"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = langid.train(docs, usable=~langid.held_out())
    predicted = langid.predict(docs.select("doc_id", "text"), model)
    return predicted.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op11_swar_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.transform(_documents(spark, sf_dir))
    return made.select(
        "doc_id",
        "n",
        "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infill.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op12_spectrum_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.grid(_embeddings(spark, sf_dir))
    return whitening.whiten(rows, whitening.fit(rows))


def op13_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_embeddings(spark, sf_dir))[0]


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_histogram_shards,
        op3_multiset_hash,
        op4_streaming_viterbi,
        op5_hyperminhash,
        op6_suffix_automaton,
        op7_suffix_array,
        op8_binary_packing,
        op9_exact_dedup,
        op10_language_id,
        op11_swar_infill,
        op12_spectrum_whitening,
        op13_multiprobe_neighbours,
    )
}
