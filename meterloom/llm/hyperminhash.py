"""Near-duplicate detection with HyperMinHash sketches.

A document is the set of hashes of its word runs. The top bits of a hash choose
one of `REGISTERS` buckets; of the least remaining value in a bucket only the
number of leading zeros and the `MANTISSA` bits after the first one are kept, 16
bits in all. Seven registers make a band; documents that agree in a band meet.
Of those pairs, the share of agreeing registers, corrected for registers that
agree by chance, estimates the similarity; pairs that may reach the bound are
confirmed on their full sets. Texts that share a template at a similarity of 0.3
meet in 1.2 of 100 pairs, at 0.4 in 9.

A band's bucket may hold a third of all documents, so its pairs are never all
made. Equal sets are one node, and of buckets with equal members one is kept. In
a first round every node is compared with one
centre of its bucket, the one that meets most others; nodes linked to a centre
are then one component, and only pairs across components are left. These are
found by what tells them from their centre: a set's runs are put in the order of
their hashes, those that the centre lacks first. Two sets of sizes m and n that
share at least c = 0.8 / 1.8 (m + n) runs share one among the first m - c + 1 of
the one and the first n - c + 1 of the other, whatever the order. Copies of one
template with so many edits of their own that they are near neither it nor each
other thus never meet. While many pairs meet and links turn up, further rounds
take other centres; at last all that meet across components are compared, so no
link between components that share a bucket is lost.

The chance that two sets at the bound agree in no band is (1 - 0.8^7)^56, below
two in a million.

Defined cases: a text without words, or null, has an empty set and is linked
with nothing. A null id is no component's name: a component is named by its
least id, and is null only if all its ids are. Repeated rows are equal sets.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterloom.llm.components import connected
from meterloom.llm.grams import LOWER, mix, shingles
from meterloom.session import settle

REGISTERS = 512
BUCKET_BITS = 9
MANTISSA = 10
PER_BAND, BANDS = 7, 56
#: Registers kept for the estimate.
ESTIMATED = 128
SIMILARITY = 80
#: Standard deviations below the bound at which an estimate rules a pair out.
MARGIN = 5.0
#: Pairs across components for each node compared with a centre, up to which all are compared at once.
FEW = 4
#: Rounds end when of so many comparisons with centres less than one gave a link, or after STAR_ROUNDS.
FOUND = 50
STAR_ROUNDS = 6


def lowered(text: str | None) -> np.ndarray:
    return LOWER[np.frombuffer((text or "").encode("utf-8"), np.uint8)]


_SEEDS = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64))
#: For each bucket, the order in which an empty one asks the others.
_PROBES = np.argsort(mix(np.arange(REGISTERS * REGISTERS, dtype=np.uint64)).reshape(REGISTERS, REGISTERS), axis=1)


def _register(values: np.ndarray) -> np.ndarray:
    """Leading zeros and the bits after the first one, never 0."""
    top = values >> np.uint64(11)
    zeros = np.where(top == 0, 53, 53 - np.frexp(top.astype(np.float64))[1]).astype(np.uint64)
    mantissa = (values << zeros << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    return (((zeros + np.uint64(1)) << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """REGISTERS numbers of 16 bits from sorted distinct hashes; all 0 for an empty set.

    A bucket that no hash falls into asks others in an order of its own and takes
    the least value of the first that has one, hashed anew, so that small sets too
    agree in a register about as often as they are similar, and not wherever both
    have nothing.
    """
    out = np.zeros(REGISTERS, np.uint16)
    if not len(hashes):
        return out
    bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))  # sorted: the least value of its bucket
    least, filled = np.zeros(REGISTERS, np.uint64), np.zeros(REGISTERS, bool)
    least[bucket[first]], filled[bucket[first]] = hashes[first], True
    out[bucket[first]] = _register(hashes[first] << np.uint64(BUCKET_BITS))
    empty = np.flatnonzero(~filled)
    for low, high in ((0, 8), (8, 64), (64, REGISTERS)):
        if len(empty):
            probes = _PROBES[empty, low:high]
            hit = filled[probes]
            at, found = hit.argmax(axis=1), hit.any(axis=1)
            e = empty[found]
            out[e] = _register(mix(least[probes[found, at[found]]] ^ _SEEDS[e]))
            empty = empty[~found]
    return out


def bands(sketches: np.ndarray) -> np.ndarray:
    """A hash of 64 bits for each sketch (row) and band."""
    parts = sketches[:, : BANDS * PER_BAND].reshape(-1, BANDS, PER_BAND).astype(np.uint64)
    out = np.broadcast_to(_SEEDS[:BANDS], parts.shape[:2])
    for i in range(PER_BAND):
        out = mix(out ^ parts[:, :, i])
    return out


def chance_agreement(size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """How often registers of unrelated sets of these sizes agree.

    The least of s uniform values has z leading zeros with probability
    (1 - 2^-(z+1))^s - (1 - 2^-z)^s; registers with equal zeros agree in their
    mantissa once in 2^MANTISSA.
    """
    z = np.arange(1, 55, dtype=np.float64)

    def spread(size):
        s = np.maximum(size[:, None] / REGISTERS, 1.0)
        edges = (1 - 2.0 ** -np.concatenate([z, [55]])) ** s
        return np.diff(edges, prepend=0, axis=1)

    return (spread(size_a) * spread(size_b)).sum(axis=1) / 2.0**MANTISSA


def may_be_near(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, similarity: int) -> np.ndarray:
    """Whether the corrected estimate does not rule out the similarity (in hundredths)."""
    filled = ((a != 0) | (b != 0)).sum(axis=1)
    agree = ((a == b) & (a != 0)).sum(axis=1)
    chance = chance_agreement(size_a, size_b)
    estimate = (agree / np.maximum(filled, 1) - chance) / (1 - chance)
    bound = similarity / 100
    filled = np.minimum(filled, np.maximum(size_a, size_b))  # registers of a small set repeat its few hashes
    return estimate >= bound - MARGIN * np.sqrt(bound * (1 - bound) / np.maximum(filled, 1))


def signatures(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, digest of the set, crc of the text, registers (of the estimate, four in a number), bands."""

    def work(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = batch.column(1).to_pylist()
                sizes, digests, crcs, registers = [], [], [], []
                for t in texts:
                    own = shingles(lowered(t), words)
                    sizes.append(len(own))
                    digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    crcs.append(zlib.crc32((t or "").encode("utf-8")))
                    registers.append(sketch(own))
                sketches = np.stack(registers)
                kept = np.ascontiguousarray(sketches[:, :ESTIMATED]).view(np.int64)
                lists = [
                    pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))
                    for m in (kept, bands(sketches).view(np.int64))
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                        pa.array(crcs, pa.int64()), *lists,
                    ],
                    names=["doc_id", "n_shingles", "digest", "crc", "registers", "bands"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(
        work, "doc_id bigint, n_shingles bigint, digest binary, crc bigint, registers array<bigint>, bands array<bigint>"
    )


def _buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, nid, meetings) of all buckets with more than one node; of buckets with equal members one.

    meetings: nodes in all these buckets of the node.
    """
    members = nodes.select("nid", F.explode("bands").alias("bucket"))
    same = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("nid")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "nid")).alias("y")]
    shared = members.groupBy("bucket").agg(*same).where("n > 1").groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket"))
    kept = settle(members.join(settle(shared.select("bucket", "n"), "shared"), "bucket"), "buckets")
    return kept.join(kept.groupBy("nid").agg(F.sum("n").alias("meetings")), "nid").select("bucket", "nid", "meetings")


def _texts(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(nid, text) of one document of each wanted node."""
    of = nodes.join(wanted, "nid", "left_semi").select("nid", "rep.*")
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("crc", F.crc32("text"))
    joined = rows.join(of, F.col("d").eqNullSafe(F.col("doc_id")) & (rows["crc"] == of["crc"]))
    same = joined.select("d", rows["crc"].alias("c"), "nid", "text")
    return settle(same.groupBy("d", "c", "nid").agg(F.first("text").alias("text")).select("nid", "text"), "texts")


def _plausible(pairs: DataFrame, nodes: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) that the sketches do not rule out."""

    def work(batches: Iterator) -> Iterator:
        for batch in (whole.slice(at, 4096) for whole in batches for at in range(0, whole.num_rows, 4096)):
            sketches = [
                batch.column(c).flatten().to_numpy(zero_copy_only=False).view(np.uint16).reshape(-1, ESTIMATED)
                for c in ("ra", "rb")
            ]
            sizes = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("na", "nb")]
            import pyarrow as pa

            keep = may_be_near(*sketches, *sizes, similarity)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    left = nodes.select(F.col("nid").alias("a"), F.col("n_shingles").alias("na"), F.col("registers").alias("ra"))
    right = nodes.select(F.col("nid").alias("b"), F.col("n_shingles").alias("nb"), F.col("registers").alias("rb"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(work, "a bigint, b bigint")


def _compared(met: DataFrame, texts: DataFrame, words: int, similarity: int) -> DataFrame:
    """(nid, centre) with the set's size, whether the two are linked, and the first of its runs, what the centre lacks first.

    As many runs are kept as any partner can ask for. Rows come sorted by `centre`, whose set is kept for its members.
    """

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        last, last_set = None, None
        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            sizes, linked, runs = [], [], []
            for row in batch.to_pylist():
                if row["centre"] != last:
                    last, last_set = row["centre"], shingles(lowered(row["tc"]), words)
                own = shingles(lowered(row["tn"]), words)
                spot = np.minimum(np.searchsorted(last_set, own), len(last_set) - 1)
                has = last_set[spot] == own
                n, common = len(own), int(has.sum())
                linked.append(100 * common >= similarity * (n + len(last_set) - common))
                first = np.concatenate([own[~has], own[has]])[: n + 1 - -(-similarity * n // 100)]
                sizes.append(n)
                runs.append((first >> np.uint64(32)).astype(np.uint32).view(np.int32))
            cuts = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("nid"), batch.column("centre"), batch.column("main"), pa.array(sizes, pa.int64()),
                    pa.array(linked, pa.bool_()),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(runs))),
                ],
                names=["nid", "centre", "main", "size", "linked", "runs"],
            )

    members = met.join(texts.withColumnRenamed("text", "tn"), "nid")
    centres = texts.join(met.select(F.col("centre").alias("nid")).distinct(), "nid", "left_semi")
    both = members.join(centres.select(F.col("nid").alias("centre"), F.col("text").alias("tc")), "centre")
    schema = "nid bigint, centre bigint, main bigint, size bigint, linked boolean, runs array<int>"
    return both.select("nid", "centre", "main", "tn", "tc").mapInArrow(work, schema)


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, similarity: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough. Rows come sorted by `b`, whose set is kept for its partners."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        last, last_set = None, None
        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            keep = []
            for row in batch.to_pylist():
                if row["b"] != last:
                    last, last_set = row["b"], shingles(lowered(row["tb"]), words)
                own = shingles(lowered(row["ta"]), words)
                common = len(np.intersect1d(own, last_set, assume_unique=True))
                keep.append(100 * common >= similarity * (len(own) + len(last_set) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(texts.select(F.col("nid").alias("a"), F.col("text").alias("ta")), "a").join(
        texts.select(F.col("nid").alias("b"), F.col("text").alias("tb")), "b"
    )
    return joined.select("a", "b", "ta", "tb").mapInArrow(work, "a bigint, b bigint")


def classes(docs: DataFrame, words: int, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text"):
    """doc_id, crc, n_shingles, component_id, kept: one row per document."""
    signed = settle(signatures(docs, words, id_col, text_col), "signatures")
    nodes = (
        signed.where("n_shingles > 0")
        .groupBy("digest")
        .agg(
            F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "crc"))).alias("named"),
            F.min(F.struct("doc_id", "crc")).alias("any"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("registers").alias("registers"),
            F.first("bands").alias("bands"),
        )
        .select("digest", F.coalesce("named", "any").alias("rep"), "n_shingles", "registers", "bands")
    )
    nodes = settle(nodes.withColumn("nid", F.monotonically_increasing_id()), "nodes")
    buckets = _buckets(nodes)
    labels = _link(docs, nodes, buckets, words, similarity, id_col, text_col)
    of_digest = nodes.select("digest", "nid").join(labels, F.col("nid") == F.col("node"), "left")
    of_digest = of_digest.select("digest", F.coalesce("component", "nid").alias("component"))
    # the least id of a node is known; the least of a component needs one row per node
    least = (
        nodes.select("digest", F.col("rep.doc_id").alias("least"))
        .join(of_digest, "digest")
        .groupBy("component")
        .agg(F.min("least").alias("component_id"))
    )
    named = settle(of_digest.join(least, "component").select("digest", "component_id"), "components")
    result = signed.select("doc_id", "crc", "n_shingles", "digest").join(named, "digest", "left")
    empty = F.col("n_shingles") == 0
    component = F.when(empty, F.col("doc_id")).otherwise(F.col("component_id"))
    return result.select(
        "doc_id", "crc", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """`rows` with the component of `nid`; a node without links is its own."""
    if labels is None:
        return rows.withColumn("component", F.col("nid"))
    named = rows.join(labels.withColumnRenamed("component", "own"), F.col("nid") == F.col("node"), "left")
    return named.select(*rows.columns, F.coalesce("own", "nid").alias("component"))


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """`labels` (node, component) after further links (a, b)."""
    if labels is None:
        return settle(connected(links), "labels")
    for end in ("a", "b"):
        other = "b" if end == "a" else "a"
        links = _labelled(links.select(F.col(end).alias("nid"), other), labels).select(F.col("component").alias(end), other)
    moved = settle(connected(links), "moved").select(F.col("node").alias("was"), F.col("component").alias("now"))
    kept = labels.join(moved, F.col("component") == F.col("was"), "left").select("node", F.coalesce("now", "component").alias("component"))
    fresh = moved.join(labels, F.col("was") == F.col("node"), "left_anti").select(F.col("was").alias("node"), F.col("now").alias("component"))
    return settle(kept.unionByName(fresh), "labels")


def _centres(buckets: DataFrame, labels: DataFrame | None, turn: int) -> DataFrame:
    """(nid, centre, main): every node with the centres of its buckets that hold nodes of more than one component.

    The centre is not of the bucket's largest component, if there are components yet.
    main: of the node's centres, the one that meets most others.
    """
    members = _labelled(buckets, labels)
    groups = members.groupBy("bucket", "component").agg(
        F.count("*").alias("n"), F.max(F.struct("meetings", F.xxhash64("nid", F.lit(turn)), "nid")).alias("first")
    )
    if labels is None:
        chosen = groups
    else:
        largest = groups.groupBy("bucket").agg(F.max(F.struct("n", "component"))["component"].alias("largest"))
        chosen = groups.join(largest, "bucket").where("component <> largest")
    chosen = chosen.groupBy("bucket").agg(F.max("first").alias("first"))
    chosen = chosen.select("bucket", F.col("first.nid").alias("centre"), F.col("first.meetings").alias("weight"))
    met = members.join(chosen, "bucket").where("nid <> centre").select("nid", "centre", "weight").distinct()
    main = F.max(F.struct("weight", "centre")).over(Window.partitionBy("nid"))["centre"]
    return met.select("nid", "centre", main.alias("main"))


def _link(docs, nodes, buckets, words, similarity, id_col, text_col) -> DataFrame:
    """(node, component) of all nodes that are linked with another."""
    texts = _texts(docs, nodes, buckets.select("nid").distinct(), id_col, text_col)
    first, labels = None, None
    for turn in range(STAR_ROUNDS):
        judged = settle(_compared(_centres(buckets, labels, turn), texts, words, similarity), "compared")
        met, found = judged.agg(F.count("*"), F.count_if("linked")).first()
        if found or labels is None:
            new = judged.where("linked").select(F.col("nid").alias("a"), F.col("centre").alias("b"))
            labels = _merged(labels, new)
        first = first or judged  # whose centres have most of what others have
        runs = _open_runs(first, labels)
        # partners of equal size meet in the runs up to here
        asked = runs.where("main = centre").where((100 + similarity) * F.col("rest") >= 2 * similarity * F.col("size"))
        groups = asked.groupBy("centre", "run").agg(F.count("*").alias("n"), F.count_if("outside").alias("out"))
        across = groups.agg(F.sum(F.col("out") * (F.col("n") - 1))).first()[0] or 0
        if across <= FEW * met or FOUND * found < met:
            break
    pairs = settle(_meeting(runs, similarity), "pairs")
    left = settle(_confirmed(_plausible(pairs, nodes, similarity), texts, words, similarity), "links")
    return labels if left.isEmpty() else _merged(labels, left)


def _open_runs(judged: DataFrame, labels: DataFrame) -> DataFrame:
    """(centre, run, nid, main, size, rest, component, outside) of the nodes of centres that were compared with several components.

    rest: the set's runs from this one on. outside: not in the largest component of those compared with the centre.
    """
    members = _labelled(judged, labels)
    parts = members.groupBy("centre", "component").agg(F.count("*").alias("n")).groupBy("centre")
    several = parts.agg(F.count("*").alias("parts"), F.max(F.struct("n", "component"))["component"].alias("largest"))
    open_ = members.join(several.where("parts > 1").select("centre", "largest"), "centre")
    fixed = ["centre", "nid", "main", "size", "component", (F.col("component") != F.col("largest")).alias("outside")]
    each = open_.select(*fixed, F.posexplode("runs").alias("at", "run"))
    return each.select("centre", "run", "nid", "main", "size", (F.col("size") - F.col("at")).alias("rest"), "component", "outside")


def _meeting(runs: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) across components that share one of the runs that sets so near must share.

    Pairs with one main centre are asked for there only.
    """
    others = runs.select(
        "centre", "run", F.col("nid").alias("other"), F.col("main").alias("other_main"), F.col("size").alias("other_size"),
        F.col("rest").alias("other_rest"), F.col("component").alias("other_component"),
    )
    met = runs.where("outside").join(others, ["centre", "run"]).where(
        (F.col("component") != F.col("other_component"))
        & ((F.col("main") != F.col("other_main")) | (F.col("main") == F.col("centre")))
        & ((100 + similarity) * F.least("rest", "other_rest") >= similarity * (F.col("size") + F.col("other_size")))
    )
    return met.select(F.greatest("nid", "other").alias("a"), F.least("nid", "other").alias("b")).distinct()


def drop_near_copies(docs: DataFrame, words: int = 5, similarity: int = SIMILARITY, id_col="doc_id", text_col="text"):
    """`docs` without near copies: of every class the rows with the least id stay, columns as given.

    Rows equal in id and text share a verdict, so both stay or both go.
    """
    gone = classes(docs, words, similarity, id_col, text_col).where("not kept")
    gone = gone.select(F.col("doc_id").alias("_nd_id"), F.col("crc").alias("_nd_crc")).distinct()
    same_text = F.crc32(F.coalesce(F.col(text_col), F.lit(""))) == F.col("_nd_crc")
    return docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col("_nd_id")) & same_text, "left_anti")
