"""Packing by power-of-two decomposition.

A document's ids, closed by an end id, are cut into pieces whose lengths are the
powers of two that add up to its length (full sequences first). Each piece is a
sequence of its own, so no sequence crosses documents and none needs padding;
pieces of one length form a bucket, from which batches of one shape are drawn.

Defined cases: a null or empty text has the end id alone. Ids of documents may
be null or repeated; every row is packed by itself. An empty table gives an
empty result. Only the named columns are read, so clashing names do no harm.
"""

from __future__ import annotations

import sys
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterloom.llm.grams import words
from meterloom.llm.remember import once_per_worker
from meterloom.session import settle

assert sys.byteorder == "little" and array("I").itemsize == 4

LENGTH = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
#: Words kept with their ids in each Python worker, some 40 bytes a word.
REMEMBERED_WORDS = 600_000
LONGEST_REMEMBERED = 48
#: Bytes of text encoded at a time; a longer text is encoded in one go.
TEXT_AT_ONCE = 4 << 20
#: A control character that stands between words which are encoded together, and how many those are.
APART, JOINED_WORDS = "\x01", 256
#: Pieces in a batch given to Spark: 64 MB of ids at most.
PIECES_AT_ONCE = 4096

PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, task int, place bigint"


class Remembered:
    """Ids by the hash of their word, in sorted arrays; of more than `limit` words the half used last stays."""

    def __init__(self, limit: int):
        self.limit, self.tick = limit, 0
        self.hashes, self.ids = np.empty(0, np.uint64), np.empty(0, np.uint32)
        self.start = self.length = self.used = np.empty(0, np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each hash, and whether it is known."""
        at = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == hashes[inside]
        self.tick += 1
        self.used[at[known]] = self.tick
        return at, known

    def add(self, hashes: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        """Unknown words; `ids` has theirs one after the other."""
        start = np.concatenate([self.start, len(self.ids) + np.cumsum(length) - length])
        length = np.concatenate([self.length, length])
        used = np.concatenate([self.used, np.full(len(hashes), self.tick)])
        hashes, ids = np.concatenate([self.hashes, hashes]), np.concatenate([self.ids, ids])
        order = np.argsort(hashes, kind="stable")
        if len(hashes) > self.limit:
            late = np.sort(np.argpartition(used, len(used) // 2)[len(used) // 2 :])
            stays = np.zeros(len(used), bool)
            stays[late] = True
            order = order[stays[order]]
            ids = ids[spread(start[order], length[order])]
            length = length[order]
            start, used, hashes = np.cumsum(length) - length, used[order], hashes[order]
        else:
            start, length, used, hashes = start[order], length[order], used[order], hashes[order]
        self.hashes, self.ids, self.start, self.length, self.used = hashes, ids, start, length, used


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + length[0] - 1, start[1] .. and so on."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())


class WordTokenizer:
    """Ids of whole texts for a vocabulary that drops white space.

    Such a tokenizer treats words between ASCII white space on their own, so a
    word is encoded once and its ids are remembered, within a bounded table.
    Words are told apart by hashes of 64 bits.
    """

    def __init__(self, path: str | None = None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        self.tokenizer = Tokenizer.from_file(path)
        apart = self.tokenizer.encode(APART, add_special_tokens=False).ids
        self.apart = apart[0] if len(apart) == 1 else None
        self.known = Remembered(REMEMBERED_WORDS)

    def _words(self, words: list[bytes]) -> list[bytes]:
        """Words with a control character between them are encoded in one call for many.

        White space keeps that character apart from the words, so its id stands
        between theirs; words that hold the character, or a special token, go by themselves.
        """
        mark = APART.encode("utf-8")
        odd = [i for i, w in enumerate(words) if mark in w or b"<|" in w] if self.apart is not None else range(len(words))
        out = [b""] * len(words)
        texts = [w.decode("utf-8") for w in words]
        for i, e in zip(odd, self.tokenizer.encode_batch_fast([texts[i] for i in odd], add_special_tokens=False)):
            out[i] = array("I", e.ids).tobytes()
        plain = sorted(set(range(len(words))).difference(odd)) if odd else range(len(words))
        for at in range(0, len(plain), JOINED_WORDS):
            some = plain[at : at + JOINED_WORDS]
            joined = f" {APART} ".join([texts[i] for i in some])
            ids = self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids
            ids = np.array(ids, "<u4")
            raw, start = ids.tobytes(), 0
            for i, end in zip(some, [*np.flatnonzero(ids == self.apart).tolist(), len(ids)]):
                out[i] = raw[4 * start : 4 * end]
                start = end + 1
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        tokens, ids = self.encode_joined(texts)
        raw, ends = ids.tobytes(), np.cumsum(tokens).tolist()
        return [raw[4 * (b - n) : 4 * b] for b, n in zip(ends, tokens.tolist())]

    def encode_joined(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text and the ids of all, one after the other, each text closed by `end`."""
        encoded = [t.encode("utf-8") for t in texts]
        text_ends = np.cumsum([len(t) + 1 for t in encoded])
        raw = b"\n".join(encoded)
        hashes, starts, ends = words(np.frombuffer(raw, np.uint8))
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        at, known = self.known.find(distinct)
        unknown = np.flatnonzero(~known)
        spans = zip(starts[first[unknown]].tolist(), ends[first[unknown]].tolist())
        made = self._words([raw[a:b] for a, b in spans])
        made_length = np.array([len(m) // 4 for m in made], np.int64)
        made = np.frombuffer(b"".join(made), np.uint32)
        table = self.known
        start, length = np.empty(len(distinct), np.int64), np.empty(len(distinct), np.int64)
        start[known], length[known] = table.start[at[known]], table.length[at[known]]
        start[unknown], length[unknown] = len(table.ids) + np.cumsum(made_length) - made_length, made_length
        ids = np.concatenate([table.ids, made, np.array([] if end is None else [end], np.uint32)])
        # a word more after each text, which has the end id
        last = np.searchsorted(starts, text_ends)
        which = np.insert(which, last, len(distinct))
        start, length = np.append(start, len(ids) - 1), np.append(length, 0 if end is None else 1)
        length_here = length[which]
        out = ids[spread(start[which], length_here)]
        short = (ends - starts)[first[unknown]] <= LONGEST_REMEMBERED
        table.add(distinct[unknown[short]], made[np.repeat(short, made_length)], made_length[short])
        until = np.append(0, np.cumsum(length_here))[last + np.arange(1, len(texts) + 1)]
        return np.diff(until, prepend=0), out


def piece_lengths(n: int, length: int = LENGTH) -> list[int]:
    """Full sequences, then the binary digits of what is left, largest first."""
    rest = n % length
    return [length] * (n // length) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def cut_lengths(tokens: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The text's place and the length of every piece, in order, for texts of so many tokens."""
    sizes = length >> np.arange(length.bit_length())
    times = (tokens[:, None] % length & sizes[None, :] > 0).astype(np.int64)
    times[:, 0] = tokens // length
    return np.repeat(np.arange(len(tokens)), times.sum(axis=1)), np.repeat(np.tile(sizes, len(tokens)), times.ravel())


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, path: str | None = None):
    """One row per piece (PIECES): `ids` are packed little-endian unsigned 32-bit numbers.

    `task` and `place` number the pieces as they were made.
    """
    if length & (length - 1):
        raise ValueError("the sequence length must be a power of two")

    def pieces(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        tokenizer = once_per_worker(("words", path), lambda: WordTokenizer(path))
        task, place = TaskContext.get().partitionId(), 0
        schema = pa.schema([
            ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
            ("doc_tokens", pa.int64()), ("task", pa.int32()), ("place", pa.int64()),
        ])
        for batch in batches:
            size = np.diff(np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(False)) // TEXT_AT_ONCE)
            edges = [0, *(np.flatnonzero(size) + 1).tolist(), batch.num_rows]
            for at, to in zip(edges, edges[1:]):  # bounds what is held in encoded form
                part = batch.slice(at, to - at)
                tokens, ids = tokenizer.encode_joined([t or "" for t in part.column(1).to_pylist()], END_ID)
                of, sizes = cut_lengths(tokens, length)
                starts = np.cumsum(sizes) - sizes  # in all ids of the batch
                own = starts - (np.cumsum(tokens) - tokens)[of]
                for a in range(0, len(sizes), PIECES_AT_ONCE):
                    here = slice(a, a + PIECES_AT_ONCE)
                    n = len(sizes[here])
                    first, last = int(starts[a]), int(starts[here][-1] + sizes[here][-1])
                    offsets = np.append(starts[here], last) - first
                    buffers = [None, pa.py_buffer((4 * offsets).astype(np.int32)), pa.py_buffer(ids[first:last])]
                    columns = [
                        part.column(0).take(pa.array(of[here])), pa.array(own[here]), pa.array(sizes[here]),
                        pa.Array.from_buffers(pa.binary(), n, buffers), pa.array(tokens[of[here]]),
                        pa.array(np.full(n, task, np.int32)), pa.array(np.arange(place, place + n)),
                    ]
                    place += n
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(pieces, PIECES)


def number_sequences(pieces: DataFrame) -> DataFrame:
    """`pieces` with sequence_id and offset, without `task` and `place`.

    Buckets follow each other from the longest to the shortest. The pieces are
    written once, so that their numbers hold; a bucket's sequences are numbered
    by task and place, from counts with a row per task and length.
    """
    pieces = settle(pieces, "pieces")
    in_task = Window.partitionBy("task", "length").orderBy("place")
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    buckets = counts.groupBy("length").agg(F.sum("n").alias("in_bucket"))
    longer = Window.orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row per power of two
    first = buckets.withColumn("first", F.coalesce(F.sum("in_bucket").over(longer), F.lit(0))).drop("in_bucket")
    offsets = (
        counts.withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(F.broadcast(first), "length")
        .select("length", "task", (F.col("earlier") + F.col("first")).alias("first"))
    )
    return (
        pieces.join(offsets, ["length", "task"])
        .withColumn("sequence_id", F.col("first") + F.row_number().over(in_task) - 1)
        .withColumn("offset", F.lit(0).cast("long"))
        .drop("task", "place", "first")
    )
