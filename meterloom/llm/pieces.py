"""SentencePiece encoding by a streaming Viterbi search, and decoding.

The best segmentation maximises the sum of piece scores. The search reads a text
from left to right and holds, for each of the last `longest` positions (no piece
is longer), the best score and the length of its last piece. At intervals it
follows the back pointers of all those positions; up to the position where they
meet, no later character can change the result, so the ids up to there are
committed and forgotten. Memory depends on the vocabulary, not on the text.

Where no piece can reach across a place (a space mark after another character,
in vocabularies whose pieces hold the mark at their start only) all paths meet
there at once; such segments are searched on their own and short ones are
remembered with their ids. Short segments not yet known are searched together:
one step of the search takes the same position of all of them, over the same
window of the last `longest` positions. Which pieces end where is looked up by
hashes and confirmed by their characters.

Normalisation is that of a model with the `identity` rule: a space becomes the
mark U+2581 and one mark is put before the text. Characters without a piece
become their UTF-8 bytes. Ties go to the longer last piece.

Defined cases: null and empty texts have no ids and decode to the empty text.
A U+2581 in a text decodes to a space, as the format has it; all other texts
decode to themselves. Ids of documents may be null or repeated. An empty table
gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.llm.remember import Recent, once_per_worker

MARK = "▁"
#: A character without a piece scores so much less than the worst piece.
UNKNOWN_PENALTY = 10.0
NORMAL, BYTE = 1, 6
REMEMBERED_SEGMENTS = 400_000
LONGEST_REMEMBERED = 48
#: Characters, padding included, of segments searched together; a step holds some 20 numbers for each.
TOGETHER = 1 << 16
NO_END = -2
SCHEMA = "doc_id bigint, text string, ids binary, decoded string"


class Vocabulary:
    """Pieces, scores and byte pieces, read from a SentencePiece model file."""

    def __init__(self, path: str | None = None):
        from sentencepiece import sentencepiece_model_pb2 as proto

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.pieces = [p.piece for p in model.pieces]
        self.byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        normal = [(i, p) for i, p in enumerate(model.pieces) if p.type == NORMAL]
        self.entry = {p.piece: (p.score, i) for i, p in normal}
        self.longest = max(len(p) for p in self.entry)
        self.unknown = min(s for s, _ in self.entry.values()) - UNKNOWN_PENALTY
        self.is_byte = np.zeros(len(self.pieces), bool)
        self.is_byte[list(self.byte_of)] = True
        # longer pieces by last character and length: what can end at a position
        self.lengths_by_last: dict[str, list[int]] = {}
        for piece in self.entry:
            if len(piece) > 1:
                self.lengths_by_last.setdefault(piece[-1], []).append(len(piece))
        # longest first, so that of equal scores the longer last piece wins
        self.lengths_by_last = {c: sorted(set(n), reverse=True) for c, n in self.lengths_by_last.items()}
        self.cuts_at_mark = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.entry)

    def search(self, text: str) -> Iterator[list[int]]:
        """Ids of a normalised text, committed piece by piece as paths meet."""
        longest, entry, ends, unknown = self.longest, self.entry, self.lengths_by_last, self.unknown
        score, back = [0.0], [0]  # by position from `base` on; back holds the length of the last piece
        base = 0
        for i, c in enumerate(text, 1):
            single = entry.get(c)
            best = score[-1] + (unknown if single is None else single[0])
            length, n = 1, i - base
            for m in ends.get(c, ()):
                if m <= n:
                    found = entry.get(text[i - m : i])
                    if found is not None:
                        s = score[n - m] + found[0]
                        if s > best or (s == best and length == 1):  # of equal scores the longer last piece
                            best, length = s, m
            score.append(best)
            back.append(length)
            if n >= 4 * longest:
                meet = self._meeting(back, longest)
                if meet:
                    yield self._ids(text, base, back, meet)
                    low = score[meet]
                    score = [s - low for s in score[meet:]]
                    back = back[meet:]
                    base += meet
        if base < len(text):
            yield self._ids(text, base, back, len(text) - base)

    @staticmethod
    def _meeting(back: list[int], longest: int) -> int:
        """The last position all surviving paths pass; any of the last `longest` positions may be continued."""
        at = set(range(len(back) - longest, len(back)))
        while len(at) > 1:
            top = max(at)
            at.remove(top)
            at.add(top - back[top])
        return at.pop()

    def _ids(self, text: str, base: int, back: list[int], end: int) -> list[int]:
        out = []
        while end > 0:
            piece = text[base + end - back[end] : base + end]
            known = self.entry.get(piece)
            if known is not None:
                out.append(known[1])
            else:
                out.extend(self.byte_ids[b] for b in reversed(piece.encode("utf-8")))
            end -= back[end]
        return out[::-1]

    def decode(self, ids: Iterable[int]) -> str:
        """Pieces joined, byte pieces put together as UTF-8, marks as spaces, the first mark left out."""
        ids = np.asarray(ids, np.int64)
        raw = self.is_byte[ids]
        if not raw.any():
            return "".join(map(self.pieces.__getitem__, ids.tolist())).replace(MARK, " ")[1:]
        out = []
        cuts = np.flatnonzero(np.diff(raw.view(np.int8), prepend=2))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(ids)]):
            run = ids[a:b].tolist()
            if raw[a]:
                out.append(bytes(self.byte_of[i] for i in run).decode("utf-8", "replace"))
            else:
                out.extend(map(self.pieces.__getitem__, run))
        return "".join(out).replace(MARK, " ")[1:]


def _hashes(codes: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each length, 64-bit hashes of the runs that end at each row of `codes` (position by segment).

    The hashes of length m start at row m - 1, as no shorter run is that long.
    """
    mixed = codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(31)
    total, weight = mixed, 1
    yield 1, total
    for m in range(2, min(longest, len(codes)) + 1):
        weight = weight * 0x5851F42D4C957F2D % (1 << 64)
        total = total[1:] + mixed[: len(codes) - m + 1] * np.uint64(weight)
        yield m, total


class BatchSearch:
    """The same search over many short segments at once."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        by_length: dict[int, list[str]] = {}
        for piece in vocabulary.entry:
            by_length.setdefault(len(piece), []).append(piece)
        self.tables = {}
        for m, pieces in by_length.items():
            codes = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32).reshape(-1, m)
            *_, (_, hashed) = _hashes(np.ascontiguousarray(codes.T), m)
            order = np.argsort(hashed[-1])
            hashed = hashed[-1][order]
            if (hashed[1:] == hashed[:-1]).any():
                raise ValueError("two pieces of one length share a hash")
            maybe = np.zeros(1 << 16, bool)
            maybe[hashed >> np.uint64(48)] = True
            score, ids = zip(*(vocabulary.entry[p] for p in pieces))
            self.tables[m] = maybe, hashed, codes[order], np.array(score)[order], np.array(ids, np.int32)[order]

    def __call__(self, segments: list[str]) -> list[bytes]:
        """Packed ids of each segment; none is empty."""
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        order = np.argsort(lengths, kind="stable")
        out: list[bytes] = [b""] * len(segments)
        a = 0
        while a < len(order):
            # as many of the next segments as fit with padding to the longest of them
            sizes = lengths[order[a : a + TOGETHER]]
            n = max(1, int(np.searchsorted(sizes * np.arange(1, len(sizes) + 1), TOGETHER, "right")))
            taken = order[a : a + n]
            for k, packed in zip(taken.tolist(), self._search([segments[k] for k in taken.tolist()], lengths[taken])):
                out[k] = packed
            a += n
        return out

    def _search(self, segments: list[str], lengths: np.ndarray) -> list[bytes]:
        vocabulary, n, width = self.vocabulary, len(segments), int(lengths[-1])
        longest = min(vocabulary.longest, width)
        codes = np.full((n, width), 0xFFFFFFFF, np.uint32)
        codes[np.arange(width) < lengths[:, None]] = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)
        codes = np.ascontiguousarray(codes.T)
        # by position, length (the longest first) and segment: the piece of that length that ends there
        gain = np.full((width, longest, n), -np.inf)
        piece = np.full((width, longest, n), -1, np.int32)
        gain[:, longest - 1] = vocabulary.unknown
        for m, hashed in _hashes(codes, longest):
            if m not in self.tables:
                continue
            maybe, known, own, score, ids = self.tables[m]
            start, row = np.nonzero(maybe[hashed >> np.uint64(48)])
            wanted = hashed[start, row]
            found = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
            same = known[found] == wanted
            start, row, found = start[same], row[same], found[same]
            same = (codes[start[:, None] + np.arange(m), row[:, None]] == own[found]).all(axis=1)
            start, row, found = start[same], row[same], found[same]
            gain[start + m - 1, longest - m, row] = score[found]
            piece[start + m - 1, longest - m, row] = ids[found]
        # by position, after as many places before the text
        best = np.full((longest + width + 1, n), -np.inf)
        best[longest] = 0.0
        choice = np.empty((width, n), np.int64)
        rows = np.arange(n)
        for i in range(width):
            paths = best[i + 1 : i + 1 + longest] + gain[i]
            choice[i] = paths.argmax(axis=0)  # the first, so of equal scores the longer last piece
            best[i + 1 + longest] = paths[choice[i], rows]
        # back from the ends, all segments a piece at a time
        ended = np.full((n, width), NO_END, np.int32)
        at = lengths - 1
        while len(rows):
            taken = choice[at, rows]
            ended[rows, at] = piece[at, taken, rows]
            at = at - (longest - taken)
            going = at >= 0
            rows, at = rows[going], at[going]
        counts = np.cumsum((ended != NO_END).sum(axis=1)).tolist()
        packed = ended[ended != NO_END].astype("<u4").tobytes()
        out = [packed[4 * a : 4 * b] for a, b in zip([0, *counts], counts)]
        for k in np.flatnonzero((ended == -1).any(axis=1)).tolist():
            # characters without a piece become bytes
            out[k] = self._with_bytes(segments[k], ended[k].tolist())
        return out

    def _with_bytes(self, segment: str, ended: list[int]) -> bytes:
        ids = []
        for c, i in zip(segment, ended):
            if i == -1:
                ids.extend(self.vocabulary.byte_ids[b] for b in c.encode("utf-8"))
            elif i != NO_END:
                ids.append(i)
        return array("I", ids).tobytes()


class Encoder:
    """Encodes texts with remembered segments; one per Python worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.together = BatchSearch(vocabulary)
        self.known = Recent(REMEMBERED_SEGMENTS)
        # marks and the run after them, or what stands before the first mark
        self.segment = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+") if vocabulary.cuts_at_mark else None

    def _segments(self, segments: list[str]) -> list[bytes]:
        search = self.vocabulary.search
        return [array("I", [i for ids in search(s) for i in ids]).tobytes() for s in segments]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        if self.segment is None:
            return self._segments(marked)
        parts = [self.segment.findall(t) for t in marked]
        distinct = set().union(*parts)
        long = [s for s in distinct if len(s) > LONGEST_REMEMBERED]
        known = self.known.settle(distinct.difference(long), self.together)
        if not long:
            return [b"".join(map(known.__getitem__, own)) for own in parts]
        rare = dict(zip(long, self._segments(long)))
        return [b"".join([rare[s] if s in rare else known[s] for s in own]) for own in parts]


def encode_and_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None):
    """doc_id, text, ids (packed little-endian unsigned 32-bit numbers) and the text decoded from them."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = once_per_worker(("pieces", path), lambda: Encoder(Vocabulary(path)))
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                packed = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                back = pa.array([encoder.vocabulary.decode(array("I", i)) for i in packed], pa.string())
                packed = pa.array(packed, pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, packed, back], names=["doc_id", "text", "ids", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, SCHEMA)
