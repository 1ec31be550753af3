"""Passages that repeat across documents: what the two substring operators share.

A text is a row of units (words or bytes). Wanted is every window of `length`
units that also starts in a document with a smaller id. Three steps make the
work follow what repeats, not what could repeat:

1. Anchors. In every window, the run of k units with the least hash is its
   anchor; equal windows have equal anchors at equal places. Only anchors are
   shuffled, about 2 in (length - k + 2) positions, and only those that occur in
   two documents are followed up. Short runs thin out the texts first; then, on
   what is left, longer ones, whose smallest document is the anchor's source.
2. Matching. The sources' passages around their anchors are dealt to reference
   shards of bounded size, and the passages of other documents to the shard of
   their source. A matcher (suffix automaton, suffix array) is built for each
   shard, and the passages are streamed past it; what it finds decides. A shard
   with very many passages is split into blocks that each get the reference.
3. Windows that the source does not have may stand in another document that
   shares the anchor. Of these, the smallest document with the window is itself
   in the same position, so steps 1 and 2 are repeated on such windows alone,
   with longer runs, at last with runs as long as the window, whose source is
   exact.

No document is compared with another outside a shard, and no list leaves the
executors. Between steps, tables are written to the shared folder.

Rows with a null id take no part. Rows that share an id do not affect each
other; they are told apart by a checksum of their text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.llm.grams import grams, mix, words
from meterloom.session import settle

#: Lengths of the runs that thin out the texts, and of those that name a source in the first round.
SIEVE, FIRST_RUN = 24, 40
#: Bytes of reference passages in a shard, and of passages that are streamed past one copy of it.
SHARD_BYTES = 1 << 18
BLOCK_BYTES = 1 << 23
#: Bytes of passages that a matcher is given at a time.
GIVEN_BYTES = 1 << 19
#: Bytes of documents that are hashed together, and documents that are unpacked at a time.
READ_BYTES, READ_ROWS = 1 << 16, 512
_SHORT, _NONE = np.uint64(0xFFFFFFFFFFFF), np.uint64(0xFFFFFFFFFFFFFFFF)


class Words:
    """Units are words `[^\\x20\\x09-\\x0D]+`; a passage is its words joined by one space."""

    @staticmethod
    def read(slices: list[bytes]):
        """Hashes of the units of all slices, units per slice, and what `passage` needs."""
        raw = b" ".join(slices)
        hashes, starts, ends = words(np.frombuffer(raw, np.uint8))
        behind = np.cumsum([len(s) + 1 for s in slices])
        return hashes, np.diff(np.searchsorted(starts, behind), prepend=0), (raw, starts, ends)

    @staticmethod
    def passage(read, start: int, end: int) -> bytes:
        raw, starts, ends = read
        return b" ".join([raw[s:e] for s, e in zip(starts[start:end].tolist(), ends[start:end].tolist())])


class Bytes:
    """Units are the bytes of a text in UTF-8."""

    _hash = mix(np.arange(1, 257, dtype=np.uint64))

    @staticmethod
    def hashes(raw: bytes) -> np.ndarray:
        return Bytes._hash[np.frombuffer(raw, np.uint8)]

    @staticmethod
    def read(slices: list[bytes]):
        raw = b"".join(slices)
        return Bytes.hashes(raw), np.array([len(s) for s in slices], np.int64), raw

    @staticmethod
    def passage(read, start: int, end: int) -> bytes:
        return read[start:end]


def _least_of(values: np.ndarray, width: int, least=np.minimum) -> np.ndarray:
    """Least value in every window of `width`, by doubling."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = least(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(hashes: np.ndarray, sizes: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and shortened hashes of the runs of k units that are least in some window of `length` units.

    `sizes`: units per slice; no run or window crosses from one slice to the next.
    """
    if len(hashes) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    runs = grams(hashes, k)
    piece = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    inside = piece[: len(runs)] == piece[k - 1 :]
    runs[~inside] = _NONE
    width = length - k + 1
    if width > 1:
        least = _least_of(runs, width)
        least[piece[: len(least)] != piece[length - 1 :]] = 0
        # a run is chosen if the greatest of the least values of its windows is its own
        edge = np.zeros(width - 1, np.uint64)
        greatest = _least_of(np.concatenate([edge, least, edge]), width, np.maximum)
        inside &= greatest == runs
    places = np.flatnonzero(inside)
    return places, runs[places] & _SHORT


def _together(batch, names: tuple[str, ...]) -> Iterator:
    """Parts of a batch of documents, to be hashed together: columns by name, and per slice its row, start and payload."""
    slices = batch.column("slices")
    counts = np.diff(slices.offsets.to_numpy())
    flat = slices.flatten()
    starts, payloads = flat.field("start").to_numpy(), flat.field("payload").to_pylist()
    ends = np.cumsum(counts)
    volume = np.cumsum([0, *[len(x) for x in payloads]])[ends]
    columns = {x: batch.column(x).to_pylist() for x in names}
    at, done = 0, 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(volume, done + READ_BYTES, side="right")))
        a, b = int(ends[at] - counts[at]), int(ends[to - 1])
        rows = np.repeat(np.arange(to - at), counts[at:to])
        yield {x: c[at:to] for x, c in columns.items()}, rows, starts[a:b], payloads[a:b]
        at, done = to, int(volume[to - 1])


def _parts(batches: Iterator) -> Iterator:
    for batch in batches:
        for at in range(0, batch.num_rows, READ_ROWS):
            yield batch.slice(at, READ_ROWS)


#: Bits of a shortened hash; above them stands the row of a document in its part.
_BITS = np.uint64(48)


def _with_row(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return (rows.astype(np.uint64) << _BITS) | hashes


def _pack(hashes: np.ndarray) -> bytes:
    return np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _joined(batches: Iterator, names: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Documents, hashes and, if asked for, sources of packed rows, one each for an anchor."""
    docs, hashes, sources = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for batch in batches:
        for d, c, h, *more in zip(*[batch.column(x).to_pylist() for x in names]):
            docs.append(np.repeat(np.frombuffer(d, np.int64), np.frombuffer(c, "<u4")))
            hashes.append(_unpack(h))
            sources += [np.frombuffer(x, np.int64) for x in more]
    return np.concatenate(docs), np.concatenate(hashes), np.concatenate(sources) if len(names) > 3 else None


def _shared_anchors(pieces: DataFrame, units, length: int, k: int, sources: bool = True) -> DataFrame:
    """(doc, hashes, sources): a row for each document with anchors that occur in another one too, in the order of their hashes.

    Anchors meet in the partition of their hash and go from there, packed by
    blocks of documents, to the partition of their document's block, so that rows
    do not grow with documents times partitions. Sources only if asked for.
    """
    import pyarrow as pa

    n = max(1, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def collect(batches: Iterator) -> Iterator:
        for part in _parts(batches):
            docs, hashes = [], []
            for columns, rows, _, payloads in _together(part, ("doc",)):
                unit_hashes, sizes, _ = units.read(payloads)
                places, found = anchors(unit_hashes, sizes, length, k)
                own = np.unique(_with_row(rows[np.searchsorted(np.cumsum(sizes), places, side="right")], found))
                docs.append(np.array(columns["doc"], np.int64)[(own >> _BITS).astype(np.int64)])
                hashes.append(own & _SHORT)
            docs, hashes = np.concatenate(docs), np.concatenate(hashes)
            to = (hashes % np.uint64(n)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            docs, hashes, to = docs[order], hashes[order], to[order]
            cuts = np.flatnonzero(np.diff(to, prepend=-1))
            rows = []
            for a, b in zip(cuts, [*cuts[1:], len(to)]):
                first = np.flatnonzero(np.diff(docs[a:b], prepend=docs[a] - 1))
                counts = np.diff(first, append=b - a).astype("<u4")
                rows.append((int(to[a]), docs[a:b][first].tobytes(), counts.tobytes(), _pack(hashes[a:b])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([],) * 4, (pa.int32(), *[pa.binary()] * 3))],
                names=["to", "docs", "counts", "hashes"],
            )

    def meet(batches: Iterator) -> Iterator:
        docs, hashes, _ = _joined(batches, ("docs", "counts", "hashes"))
        order = np.lexsort((docs, hashes))
        docs, hashes = docs[order], hashes[order]
        first = np.flatnonzero(np.diff(hashes, prepend=hashes[:1] + np.uint64(1)))
        sizes = np.diff(first, append=len(hashes))
        shared = np.repeat(docs[first] != docs[first + sizes - 1], sizes) if len(first) else np.empty(0, bool)
        source = np.repeat(docs[first], sizes)[shared] if len(first) else docs
        docs, hashes = docs[shared], hashes[shared]
        block = (mix(docs.view(np.uint64)) % np.uint64(n)).astype(np.int64)
        order = np.lexsort((docs, block))
        docs, hashes, source, block = docs[order], hashes[order], source[order], block[order]
        cuts = np.flatnonzero(np.diff(block, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(docs)]):
            first = np.flatnonzero(np.diff(docs[a:b], prepend=docs[a] - 1))
            counts = np.diff(first, append=b - a).astype("<u4")
            row = [int(block[a]), docs[a:b][first].tobytes(), counts.tobytes(), _pack(hashes[a:b]), source[a:b].tobytes()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip(row, types)], names=["block", "docs", "counts", *found]
            )

    def gather(batches: Iterator) -> Iterator:
        docs, hashes, source = _joined(batches, ("docs", "counts", *found))
        order = np.lexsort((hashes, docs))
        docs, hashes = docs[order], hashes[order]
        source = source[order] if sources else None
        cuts = np.flatnonzero(np.diff(docs, prepend=docs[:1] - 1))
        ends = [*cuts[1:], len(docs)]
        for at in range(0, len(cuts), 10_000):
            spans = list(zip(cuts[at : at + 10_000], ends[at : at + 10_000]))
            columns = [
                pa.array([int(docs[a]) for a, _ in spans], pa.int64()),
                pa.array([_pack(hashes[a:b]) for a, b in spans], pa.binary()),
            ]
            if sources:
                columns.append(pa.array([source[a:b].tobytes() for a, b in spans], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc", *found])

    found = ["hashes", "sources"] if sources else ["hashes"]
    types = [pa.int32(), *[pa.binary()] * (2 + len(found))]
    binary = "".join(f", {x} binary" for x in found)
    dealt = pieces.mapInArrow(collect, "to int, docs binary, counts binary, hashes binary").repartitionById(n, "to")
    met = dealt.mapInArrow(meet, f"block int, docs binary, counts binary{binary}").repartitionById(n, "block")
    return settle(met.mapInArrow(gather, f"doc bigint{binary}"), "anchors")


def _passages(batch, units, length: int, k: int, by_source: bool) -> Iterator:
    """Passages around shared anchors, for documents with their anchors, part by part.

    Columns, what `units.passage` needs, and arrays: the row, start and end of
    each passage, its source, and its place in the document.
    """
    names = ("doc", "crc", "hashes", "sources") if by_source else ("doc", "crc", "hashes")
    for columns, rows, begins, payloads in _together(batch, names):
        hashes, sizes, read = units.read(payloads)
        places, own = anchors(hashes, sizes, length, k)
        ends = np.cumsum(sizes)
        piece = np.searchsorted(ends, places, side="right")
        known = [_unpack(x) for x in columns["hashes"]]
        known = _with_row(np.repeat(np.arange(len(known)), [len(x) for x in known]), np.concatenate(known))
        own = _with_row(rows[piece], own)
        spot = np.minimum(np.searchsorted(known, own), len(known) - 1)
        hit = known[spot] == own
        places, piece, spot = places[hit], piece[hit], spot[hit]
        if by_source:
            source = np.frombuffer(b"".join(columns["sources"]), np.int64)[spot]
            order = np.lexsort((source, rows[piece]))  # places are in order
            places, piece, source = places[order], piece[order], source[order]
        else:
            source = np.zeros_like(places)
        # anchors of one source whose passages touch share one passage
        new = (np.diff(places, prepend=places[:1]) > length) | (np.diff(piece, prepend=piece[:1]) != 0)
        new |= np.diff(source, prepend=source[:1]) != 0
        new[:1] = True
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(places))[: len(first)] - 1
        piece = piece[first]
        begin = ends[piece] - sizes[piece]
        start = np.maximum(begin, places[first] - (length - k))
        end = np.minimum(ends[piece], places[last] + length)
        yield columns, read, rows[piece], start, end, source[first], begins[piece] + start - begin


def _sieve(pieces: DataFrame, shared: DataFrame, units, length: int, k: int) -> DataFrame:
    """`pieces` cut down to what lies around shared anchors."""
    import pyarrow as pa

    def cut(batches: Iterator) -> Iterator:
        for part in _parts(batches):
            for columns, read, row, start, end, _, at in _passages(part, units, length, k, False):
                payloads = [units.passage(read, a, b) for a, b in zip(start.tolist(), end.tolist())]
                first = np.flatnonzero(np.diff(row, prepend=-1))
                own = pa.StructArray.from_arrays([pa.array(at, pa.int64()), pa.array(payloads, pa.binary())], ["start", "payload"])
                yield pa.RecordBatch.from_arrays(
                    [
                        *[pa.array(np.array(columns[x], np.int64)[row[first]], pa.int64()) for x in ("doc", "crc")],
                        pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), own),
                    ],
                    names=["doc", "crc", "slices"],
                )

    return pieces.join(shared, "doc").mapInArrow(cut, _PIECES)


_PIECES = "doc bigint, crc bigint, slices array<struct<start:bigint,payload:binary>>"
_ROUTES = "source bigint, kind int, doc bigint, crc bigint, start bigint, payload binary"


def _routes(pieces: DataFrame, shared: DataFrame, units, length: int, k: int) -> DataFrame:
    """Passages around shared anchors: kind 0 of a source itself, kind 1 of another document."""
    import pyarrow as pa

    def route(batches: Iterator) -> Iterator:
        for part in _parts(batches):
            for columns, read, row, start, end, source, at in _passages(part, units, length, k, True):
                doc, crc = (np.array(columns[x], np.int64)[row] for x in ("doc", "crc"))
                payloads = [units.passage(read, a, b) for a, b in zip(start.tolist(), end.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(source, pa.int64()),
                        pa.array((source != doc).astype(np.int32), pa.int32()),
                        *[pa.array(x, pa.int64()) for x in (doc, crc, at)],
                        pa.array(payloads, pa.binary()),
                    ],
                    names=["source", "kind", "doc", "crc", "start", "payload"],
                )

    return pieces.join(shared, "doc").mapInArrow(route, _ROUTES)


def _matched(routes: DataFrame, matcher: Callable, length: int) -> DataFrame:
    """(doc, crc, start, end, payload): found passages with a null payload, and what was not found with its payload."""
    import pyarrow as pa

    total = routes.where("kind = 0").agg(F.sum(F.length("payload"))).first()[0] or 0
    n_shards = max(1, -(-total // SHARD_BYTES))
    sharded = routes.withColumn("shard", F.pmod(F.xxhash64("source"), F.lit(n_shards)))
    volume = sharded.where("kind = 1").groupBy("shard").agg(F.sum(F.length("payload")).alias("volume"))
    # at most one row for each BLOCK_BYTES of passages
    hot = F.broadcast(volume.where(F.col("volume") > BLOCK_BYTES))
    blocks = F.coalesce(F.ceil(F.col("volume") / BLOCK_BYTES), F.lit(1)).cast("int")
    own_block = F.pmod(F.xxhash64("doc", "start"), blocks).cast("int")
    dealt = (
        sharded.join(hot, "shard", "left")
        .withColumn("blocks", F.when(F.col("kind") == 0, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own_block)))
        .withColumn("block", F.explode("blocks"))
        .drop("blocks", "volume")
        .repartition("shard", "block")
        .sortWithinPartitions("shard", "block", "kind")
    )

    def match(batches: Iterator) -> Iterator:
        at, references, index, given, size = None, [], None, [], 0

        def judge():
            """Rows for the passages that were given; one flag per window tells what was found."""
            docs, crcs, begins, payloads = zip(*given)
            flags, cuts = index.find(list(payloads), list(docs))
            sizes = np.array([len(f) for f in flags], np.int64)
            joined = np.concatenate(flags)
            new = np.diff(joined.view(np.int8), prepend=2) != 0
            offsets = np.cumsum(sizes) - sizes
            new[offsets] = True
            first = np.flatnonzero(new)
            of = np.searchsorted(offsets, first, side="right") - 1
            starts = first - offsets[of]
            ends = np.append(first[1:], len(joined)) - offsets[of] + length - 1
            rest = [
                None if hit else cuts[i](a, b)
                for i, a, b, hit in zip(of.tolist(), starts.tolist(), ends.tolist(), joined[first].tolist())
            ]
            begin = np.array(begins, np.int64)[of]
            columns = [np.array(docs, np.int64)[of], np.array(crcs, np.int64)[of], begin + starts, begin + ends]
            given.clear()
            return pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.int64()) for c in columns], pa.array(rest, pa.binary())],
                names=["doc", "crc", "start", "end", "payload"],
            )

        for batch in batches:
            columns = [batch.column(x).to_pylist() for x in ("shard", "block", "kind", "doc", "crc", "start", "payload")]
            for shard, block, kind, doc, crc, start, payload in zip(*columns):
                if (shard, block) != at:
                    if given:
                        yield judge()
                    at, references, index, size = (shard, block), [], None, 0
                if kind == 0:
                    references.append((doc, payload))
                    continue
                if index is None:
                    index, references = matcher(references, length), []
                given.append((doc, crc, start, payload))
                size += len(payload)
                if size > GIVEN_BYTES:
                    yield judge()
                    size = 0
        if given:
            yield judge()

    columns = dealt.select("shard", "block", "kind", "doc", "crc", "start", "payload")
    return columns.mapInArrow(match, "doc bigint, crc bigint, start bigint, end bigint, payload binary")


def repeated_spans(docs: DataFrame, units, matcher: Callable, length: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, crc, spans): per text, its unit ranges that are covered by repeated windows; ranges may overlap."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), text.cast("binary").alias("payload")))
    pieces = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc"), F.crc32(text).alias("crc"), whole.alias("slices")
    )
    pieces = settle(_sieve(pieces, _shared_anchors(pieces, units, length, SIEVE, sources=False), units, length, SIEVE), "sieved")
    found = []
    for k in (FIRST_RUN, length):
        shared = _shared_anchors(pieces, units, length, k)
        routes = settle(_routes(pieces, shared, units, length, k), "passages")
        judged = settle(_matched(routes, matcher, length), "matches")
        found.append(judged.where("payload is null").drop("payload"))
        rest = judged.where("payload is not null").groupBy("doc", "crc")
        pieces = rest.agg(F.collect_list(F.struct("start", "payload")).alias("slices"))
    all_found = found[0]
    for more in found[1:]:
        all_found = all_found.unionByName(more)
    return all_found.groupBy("doc", "crc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def without_spans(docs: DataFrame, spans: DataFrame, remove: Callable, schema: str, id_col: str, text_col: str):
    """`remove(text, mask maker)` applied to every document; `spans` from `repeated_spans`."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.crc32(text).alias("own_crc"))
    joined = rows.join(
        spans, (F.col("doc_id") == F.col("doc")) & (F.col("own_crc") == F.col("crc")), "left"
    ).select("doc_id", "text", "spans")
    return joined.mapInArrow(remove, schema)


def covered(n: int, spans) -> np.ndarray:
    """True for every unit in a span."""
    depth = np.zeros(n + 1, np.int64)
    for s in spans or ():
        depth[s["start"]] += 1
        depth[s["end"]] -= 1
    return np.cumsum(depth[:n]) > 0
