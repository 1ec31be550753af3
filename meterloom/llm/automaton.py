"""Substring dedup over words with suffix automata of reference shards.

See `repeats` for how documents are sharded and why nothing is missed. Here is
what runs within a shard: an automaton that accepts every run of words of the
reference passages, with the smallest document of each run. A passage streams
through it word by word; the state holds the longest run that ends at the word
and occurs in the reference (its matching statistic, cut at the window length).
Where that run is a whole window and its smallest document is smaller than the
passage's, the window's words are removed, so maximal spans disappear.

Defined cases: a null or empty text has no words; texts shorter than the window
lose nothing; a null id loses nothing and is no reference; rows that share an id
do not affect each other. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from meterloom.llm.repeats import Words, covered, repeated_spans, without_spans

WINDOW = 50


class WordAutomaton:
    """Suffix automaton of passages (doc, words joined by spaces) with the least document of every run."""

    def __init__(self, passages: list[tuple[int, bytes]], length: int = WINDOW):
        self.length = length
        self.number: dict[bytes, int] = {}
        follow: list[dict[int, int]] = [{}]
        link, longest, least = [-1], [0], [1 << 63]
        number = self.number
        last, stop = 0, 0
        for doc, passage in passages:
            stop -= 1  # a symbol of its own ends each passage, so that no run crosses it
            for c in [*[number.setdefault(w, len(number)) for w in passage.split(b" ")], stop]:
                state = len(follow)
                follow.append({})
                longest.append(longest[last] + 1)
                link.append(0)
                least.append(doc)
                p = last
                while p >= 0 and c not in follow[p]:
                    follow[p][c] = state
                    p = link[p]
                if p >= 0:
                    q = follow[p][c]
                    if longest[q] == longest[p] + 1:
                        link[state] = q
                    else:
                        clone = len(follow)
                        follow.append(dict(follow[q]))
                        longest.append(longest[p] + 1)
                        link.append(link[q])
                        least.append(least[q])
                        while p >= 0 and follow[p].get(c) == q:
                            follow[p][c] = clone
                            p = link[p]
                        link[q] = link[state] = clone
                last = state
        for state in np.argsort(longest, kind="stable")[::-1].tolist():
            if link[state] >= 0 and least[state] < least[link[state]]:
                least[link[state]] = least[state]
        self.follow, self.link, self.longest, self.least = follow, link, longest, least

    def find(self, passages: list[bytes], docs: list[int]):
        """For each passage a flag per window, and a function that cuts a range of words out of it."""
        split = [p.split(b" ") for p in passages]
        cuts = [lambda a, b, words=words: b" ".join(words[a:b]) for words in split]
        return [self._stream(words, doc) for words, doc in zip(split, docs)], cuts

    def _stream(self, words: list[bytes], doc: int) -> np.ndarray:
        follow, link, longest, least, length = self.follow, self.link, self.longest, self.least, self.length
        flags = np.zeros(len(words) - length + 1, bool)
        state = size = 0
        for i, w in enumerate(words):
            c = self.number.get(w)
            while state and c not in follow[state]:
                state = link[state]
                size = longest[state]
            after = follow[state].get(c)
            if after is None:
                size = 0
                continue
            state, size = after, size + 1
            if size >= length:
                while longest[link[state]] >= length:
                    state = link[state]
                size = length
                flags[i - length + 1] = least[state] < doc
        return flags


def remove_repeats(docs: DataFrame, length: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, n_spans and kept: the words that stay, joined by one space."""
    spans = repeated_spans(docs, Words, WordAutomaton, length, id_col, text_col)

    def remove(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                raw = r["text"].encode("utf-8")
                words = raw.split()
                gone = covered(len(words), r["spans"])
                kept = [w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words
                n_spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                out.append((r["doc_id"], len(words), len(words) - len(kept), n_spans, b" ".join(kept).decode("utf-8")))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(c, t)
                    for c, t in zip(
                        zip(*out) if out else ([],) * 5, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                    )
                ],
                names=["doc_id", "n_words", "n_removed", "n_spans", "kept"],
            )

    schema = "doc_id bigint, n_words bigint, n_removed bigint, n_spans bigint, kept string"
    return without_spans(docs, spans, remove, schema, id_col, text_col)
