"""Homomorphic multiset hash of a text's paragraphs.

A paragraph is a non-empty line. Each is hashed to a wide vector: `HASH_LANES`
lanes of 32 uniform bits and `SIGN_LANES` lanes of +w or -w, w being the whole part
of the root of its length. A text's fingerprint is the lane-wise sum of its paragraphs, modulo 2^32. Addition commutes, so the
order of paragraphs does not matter, and a paragraph is inserted or removed by
adding or subtracting its vector, without the rest of the text.

Equality of texts (as multisets of paragraphs) is decided by all lanes; two
different multisets agree by chance about once in 2^256. The sign lanes also
give a likeness: the squared length of a difference estimates how many characters
stand in paragraphs that differ, so 1 - |A - B|^2 / (|A|^2 + |B|^2), cut to 0..1, is near 1 for
texts that share nearly all paragraphs and near 0 for unrelated ones.

Defined cases: null and empty texts have the zero vector; two of those are alike
by 1, one and any other text by 0. Texts that differ only in the order of lines
or in empty lines have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.llm.shard import find_splitters, long_key, range_number
from meterloom.session import settle

HASH_LANES = 8
SIGN_LANES = 128
LANES = HASH_LANES + SIGN_LANES
_MOD = (1 << 32) - 1
_SIGN_WORDS = SIGN_LANES // 64


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda p: p != "")


def _lanes(paragraph: Column) -> Column:
    """The vector of one paragraph."""
    weight = F.floor(F.sqrt(F.length(paragraph)))
    uniform = F.flatten(
        F.transform(
            F.array(*[F.xxhash64(paragraph, F.lit(i)) for i in range(HASH_LANES // 2)]),
            lambda h: F.array(h.bitwiseAND(F.lit(_MOD)), F.shiftrightunsigned(h, 32)),
        )
    )
    signs = F.flatten(
        F.transform(
            F.array(*[F.xxhash64(paragraph, F.lit(100 + i)) for i in range(_SIGN_WORDS)]),
            lambda h: F.transform(
                F.sequence(F.lit(0), F.lit(63)),
                lambda b: F.when(F.getbit(h, b) == 1, weight).otherwise(F.lit(1 << 32) - weight),
            ),
        )
    )
    return F.concat(uniform, signs)


def zero() -> Column:
    return F.array_repeat(F.lit(0).cast("long"), LANES)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit(_MOD)))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x - y).bitwiseAND(F.lit(_MOD)))


def vector_of(pieces: Column) -> Column:
    """The vector of an array of paragraphs."""
    return F.aggregate(pieces, zero(), lambda done, p: add(done, _lanes(p)))


def fingerprint(text: Column) -> Column:
    return vector_of(paragraphs(text))


def show(vector: Column) -> Column:
    """Lower-case hex, eight digits a lane."""
    return F.lower(F.array_join(F.transform(vector, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def square(vector: Column) -> Column:
    signed = F.slice(vector, HASH_LANES + 1, SIGN_LANES)
    return F.aggregate(
        signed,
        F.lit(0.0),
        lambda s, x: s + F.pow(F.when(x >= 1 << 31, x - F.lit(1 << 32)).otherwise(x).cast("double"), F.lit(2.0)),
    )


def likeness(a: Column, b: Column, square_a: Column, square_b: Column) -> Column:
    both = square_a + square_b
    share = F.lit(1.0) - square(subtract(a, b)) / both
    return F.when(a == b, F.lit(1.0)).when(both == 0, F.lit(0.0)).otherwise(F.greatest(share, F.lit(0.0)))


def with_next(docs: DataFrame, id_col: str, columns, size: Column, pieces: int | None = None) -> DataFrame:
    """`docs` plus `next`: a struct of `columns` of the next row by id; the last row gets the first's.

    Rows with one id are ordered by the hash of their text, null ids come first.
    The id order is cut into ranges of nearly equal bytes; the rows at the start
    of a range are sent to the range before it as well, so every range finds its
    last row's follower without another exchange.
    """
    spark = docs.sparkSession
    keys = ("_fp_id", "_fp_tie")
    keyed = docs.withColumn("_fp_id", long_key(F.col(id_col))).withColumn("_fp_tie", F.xxhash64("text"))
    slim = settle(keyed.select(*keys, size.alias("_fp_size")), "id-order")
    total, least = slim.agg(F.sum("_fp_size"), F.min(F.struct(*keys))).first()
    n = pieces or int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = [(total or 0) * i / n for i in range(1, n)]
    found = find_splitters(slim, keys, "_fp_size", wanted, [(total or 0) / n / 4] * (n - 1), total) if total else []
    starts = sorted({tuple(least), *(s for s, _ in found if s is not None)}) if total else []
    if not starts:
        return docs.withColumn("next", F.struct(*columns))
    n = len(starts)
    own = F.greatest(range_number(starts, keys) - 1, F.lit(0))
    heads = F.array(*[F.struct(*[F.lit(v).alias(k) for v, k in zip(s, keys)]) for s in starts])
    first_of_range = F.element_at(heads, own + 1) == F.struct(*[F.col(k) for k in keys])
    targets = F.when(
        first_of_range,
        F.array(
            F.struct(own.alias("range"), F.lit(0).alias("ghost")),
            F.struct(F.when(own == 0, F.lit(n - 1)).otherwise(own - 1).alias("range"), F.lit(1).alias("ghost")),
        ),
    ).otherwise(F.array(F.struct(own.alias("range"), F.lit(0).alias("ghost"))))
    in_order = Window.partitionBy("_fp_range").orderBy("_fp_ghost", *keys)
    return (
        keyed.withColumn("_fp_target", F.explode(targets))
        .withColumn("_fp_range", F.col("_fp_target.range").cast("int"))
        .withColumn("_fp_ghost", F.col("_fp_target.ghost"))
        .drop("_fp_target")
        .repartitionById(n, "_fp_range")
        .withColumn("next", F.lead(F.struct(*columns)).over(in_order))
        .where("_fp_ghost = 0")
        .drop("_fp_range", "_fp_ghost", *keys)
    )


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they are.

    The edited text has its last floor(n_chars / 4) code points replaced by the
    first as many of the next document. Its fingerprint is not computed anew:
    the paragraphs that end before the edit stay in the sum, the others are
    taken out and the new ones put in.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    followed = with_next(rows, "doc_id", ["text"], F.octet_length("text").cast("long") + 64)
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    head = F.substring("text", F.lit(1), F.col("n_chars").cast("int") - quarter)
    new_tail = F.substring(F.col("next.text"), F.lit(1), quarter)
    parts = followed.withColumn("_head", head).withColumn("_new", new_tail)
    # what stands before the last line break of the head is not touched by the edit
    kept_length = F.length("_head") - F.length(F.substring_index("_head", "\n", -1))
    parts = parts.withColumn("_same", F.substring("text", F.lit(1), kept_length)).withColumn("_cut", kept_length)
    own_tail = F.substring("text", F.col("_cut") + 1, F.col("n_chars").cast("int"))
    edited = F.concat("_head", "_new")
    edited_tail = F.substring(edited, F.col("_cut") + 1, F.length(edited))
    vectors = parts.select(
        "doc_id",
        "n_chars",
        F.sha2(edited, 256).alias("edited_sha256"),
        fingerprint(F.col("_same")).alias("same"),
        fingerprint(own_tail).alias("taken"),
        fingerprint(edited_tail).alias("put"),
        fingerprint(F.col("next.text")).alias("next"),
    )
    return vectors.select(
        "doc_id", "n_chars", "edited_sha256", add(F.col("same"), F.col("taken")).alias("vector"),
        add(F.col("same"), F.col("put")).alias("edited_vector"), F.col("next").alias("next_vector"),
    )
