"""Fill-in-the-middle transformation, cut at whole units found with SWAR words.

A text's units are runs of ASCII letters and single other code points. The UTF-8
bytes of a text are viewed as 64-bit words, eight bytes at a time. Arithmetic on
whole words marks the last byte of each unit in that byte's top bit: the next byte
starts a code point, and the two bytes are not both letters. A bit count per word
and a running sum give the units before each word; the k-th unit's end is found by
searching the running sum for its word, then clearing that word's lower marks. No
text is walked byte by byte or turned into a list of units.

Cut places and form follow from a hash of seed and id alone, so a document is cut
alike wherever it lies. Python returns counts and byte places only; texts are
put together, and taken apart again by `restore`, in columns.

Defined cases: a null text counts as empty; an empty text is plain, with no units.
A null id is hashed as an empty one. Repeated rows are cut alike, each for itself.
A text of any length is handled whole, in memory of some ten times its bytes for the
longest one; short texts share batches of BATCH_BYTES. Texts that hold a marker are
plain, so that a marker in an output is always ours. An empty table gives an empty
result. Only the named columns are read, so clashing names do no harm.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of the documents that are transformed, and of those the percent with the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
BATCH_BYTES = 4 << 20

EACH = np.uint64(0x0101010101010101)
TOP = np.uint64(0x8080808080808080)
LOW = np.uint64(0x7F7F7F7F7F7F7F7F)
ONE, BYTE, LAST = np.uint64(1), np.uint64(8), np.uint64(56)


def _after(words: np.ndarray) -> np.ndarray:
    """For each byte, the byte that follows it; words are little-endian."""
    out = words >> BYTE
    out[:-1] |= words[1:] << LAST
    return out


def _letters(words: np.ndarray) -> np.ndarray:
    """The top bit of each byte that is an ASCII letter."""
    lower = (words | EACH * np.uint64(0x20)) & LOW
    from_a = lower + EACH * np.uint64(0x80 - ord("a"))
    beyond_z = lower + EACH * np.uint64(0x80 - ord("z") - 1)
    return from_a & ~beyond_z & ~words & TOP


def unit_ends(words: np.ndarray) -> np.ndarray:
    """The top bit of each byte that ends a unit; bytes of value 0 count as code points of their own."""
    following = _after(words)
    continued = following & ~(following << ONE) & TOP  # 10xxxxxx
    letters = _letters(words)
    return TOP & ~continued & ~(letters & _after(letters))


def _select(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the byte that holds the k-th mark (from 1) of each word."""
    word = word.copy()
    for cleared in range(1, 8):
        word = np.where(k > cleared, word & (word - ONE), word)
    return np.bitwise_count((word & (~word + ONE)) - ONE).astype(np.int64) >> 3


class Units:
    """The units of several texts, given as UTF-8 bytes."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        # a zero byte at least after each text: what follows a text's last byte is no part of a unit
        own = self.sizes // 8 + 1
        self.first = np.cumsum(own) - own
        buffer = bytearray(int(own.sum()) * 8)
        for at, text in zip((self.first * 8).tolist(), texts):
            buffer[at : at + len(text)] = text
        words = np.frombuffer(buffer, "<u8")
        self.ends = unit_ends(words)
        # the last word of each text is filled up with zero bytes; their marks do not count
        last = self.first + own - 1
        kept = (ONE << (self.sizes % 8 * 8).astype(np.uint64)) - ONE
        self.ends[last] &= kept
        self.running = np.cumsum(np.bitwise_count(self.ends), dtype=np.int64)
        before = np.concatenate(([0], self.running))
        self.earlier = before[self.first]
        self.counts = before[last + 1] - self.earlier

    def place(self, k: np.ndarray) -> np.ndarray:
        """Bytes of each text's first k units."""
        wanted = self.earlier + k
        word = np.where(k > 0, np.searchsorted(self.running, wanted), self.first)
        in_word = wanted - (self.running[word] - np.bitwise_count(self.ends[word]))
        place = (word - self.first) * 8 + _select(self.ends[word], in_word) + 1
        return np.where(k > 0, place, 0)


def _cuts(text, h1, h2):
    """Units of each text, and the two places in bytes where it is cut."""
    import pyarrow as pa
    from pyarrow import compute

    one, two = (h.to_numpy(zero_copy_only=False).astype(np.int64) for h in (h1, h2))
    sizes = np.cumsum(compute.binary_length(text).to_numpy(zero_copy_only=False), dtype=np.int64)
    # batches of about BATCH_BYTES, so that the words of few texts are held at a time
    group = sizes // BATCH_BYTES
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(text)] if len(text) else [0]
    found = []
    for start, end in zip(edges, edges[1:]):
        units = Units(text.slice(start, end - start).cast(pa.binary()).to_pylist())
        n = units.counts
        cut = np.sort(np.stack([one[start:end] % (n + 1), two[start:end] % (n + 1)]), axis=0)
        found.append((n, units.place(cut[0]), units.place(cut[1])))
    columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["n", "a", "b"])


def _bytes(raw: Column, start: Column, end: Column) -> Column:
    """Bytes from `start` to before `end`, as text."""
    return F.substring(raw, (start + 1).cast("int"), (end - start).cast("int")).cast("string")


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """doc_id, text, n, form, prefix, middle, suffix and output; the three parts are null in plain rows.

    form: `plain` (the text itself), `psm` or `spm`, by the order of the parts.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    numbers = {f"_h{i}": F.conv(F.substring(F.col("_digest"), 8 * i - 7, 8), 16, 10).cast("long") for i in range(1, 5)}
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        digest.alias("_digest"),
    )
    cuts = F.arrow_udf(_cuts, "struct<n: bigint, a: bigint, b: bigint>")
    cut = rows.withColumns(numbers).withColumn("_cut", cuts("text", "_h1", "_h2"))
    text = F.col("text")
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    form = (
        F.when((text == "") | marked | (F.col("_h3") % 100 >= TRANSFORMED), "plain")
        .when(F.col("_h4") % 100 < SUFFIX_FIRST, "spm")
        .otherwise("psm")
    )
    raw, a, b = text.cast("binary"), F.col("_cut.a"), F.col("_cut.b")
    apart = F.col("form") != "plain"
    parts = {
        "prefix": F.when(apart, _bytes(raw, F.lit(0).cast("long"), a)),
        "middle": F.when(apart, _bytes(raw, a, b)),
        "suffix": F.when(apart, _bytes(raw, b, F.octet_length(text).cast("long"))),
    }
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(text)
    return (
        cut.withColumn("form", form)
        .withColumns(parts)
        .select("doc_id", "text", F.col("_cut.n").alias("n"), "form", "prefix", "middle", "suffix", output.alias("output"))
    )


def restore(output: Column, form: Column) -> Column:
    """The exact text, from an output and its form alone.

    The parts hold no marker, and none can arise where a part meets a marker, so
    each marker stands once.
    """
    second = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    body = F.substring(output, len(PREFIX) + 1, 1 << 30)
    front, middle = F.substring_index(body, MIDDLE, 1), F.substring_index(body, MIDDLE, -1)
    one, two = F.split_part(front, second, F.lit(1)), F.split_part(front, second, F.lit(2))
    joined = F.when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))
    return F.when(form == "plain", output).otherwise(joined)
