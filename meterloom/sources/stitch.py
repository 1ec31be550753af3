"""Joining lines into records inside each file split, in one ordered pass.

Spark hands a split's lines to its task in file order. These helpers walk them
batch by batch, so the text is neither sorted nor shuffled. A line maps the state
before it (is a quoted field open?) to the state after it: `if_closed`, `if_open`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SUMMARY = (
    "source_file string, block_start bigint, n0 bigint, n1 bigint, "
    "if_closed boolean, if_open boolean"
)
PIECES = (
    "source_file string, block_start bigint, record bigint, edge boolean, "
    "open_tail boolean, raw binary"
)


def states_after(if_closed: np.ndarray, if_open: np.ndarray, start: bool) -> np.ndarray:
    """The state after each line. Lines with equal answers fix it, others keep or
    flip it: the last fixed state, flipped once per flipping line since then."""
    odd = np.cumsum(if_closed & ~if_open) % 2 == 1
    at = np.where(if_closed == if_open, np.arange(len(odd)), -1)
    at = np.maximum.accumulate(at)
    base = np.where(at >= 0, (if_closed ^ odd)[at], start)
    return base ^ odd


def _runs(batch: pa.RecordBatch):
    """(first, past last) of each stretch of lines from one split."""
    n = batch.num_rows
    if n == 0:
        return []
    changed = np.zeros(n, dtype=bool)
    for name in ("source_file", "block_start"):
        column = batch.column(name)
        differs = pc.not_equal(column.slice(1), column.slice(0, n - 1))
        changed[1:] |= differs.to_numpy(zero_copy_only=False)
    starts = [0, *np.flatnonzero(changed)]
    return list(zip(starts, [*starts[1:], n]))


def _flags(part: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [part.column(name).to_numpy(zero_copy_only=False).astype(bool) for name in names]


def _split_of(part: pa.RecordBatch) -> tuple:
    return part.column("source_file")[0].as_py(), part.column("block_start")[0].as_py()


def summarise(batches):
    """Per split and for both states before it: records begun, state after it."""
    split, begun, state = None, [0, 0], [False, True]

    def row():
        values = [[v] for v in (*split, *begun, *map(bool, state))]
        names = ["source_file", "block_start", "n0", "n1", "if_closed", "if_open"]
        return pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=names)

    for batch in batches:
        for first, past in _runs(batch):
            part = batch.slice(first, past - first)
            if _split_of(part) != split:
                if split is not None:
                    yield row()
                split, begun, state = _split_of(part), [0, 0], [False, True]
            if_closed, if_open, blank = _flags(part, "if_closed", "if_open", "blank")
            for case in (0, 1):
                after = states_after(if_closed, if_open, state[case])
                before = np.append(state[case], after[:-1])
                begun[case] += int(np.sum(~before & ~blank))
                state[case] = after[-1]
    if split is not None:
        yield row()


def join_lines(batches):
    """Records, or the pieces of them that a split holds.

    Pieces of records that cross a split's edge are marked `edge`. Lines of a
    record still open at the end of its file stay apart, marked `open_tail`.
    The last record of a stretch waits for the next one, which may go on with it.
    """
    names = ["source_file", "block_start", "record", "edge", "open_tail", "raw"]
    split, state, record, last = None, False, 0, 0
    waiting = None  # a table of one row: the record that may go on

    def finish_split():
        if record != last:
            raise RuntimeError("files were split differently in the second scan")

    for batch in batches:
        for first, past in _runs(batch):
            part = batch.slice(first, past - first)
            fact = {
                name: part.column(name)[0].as_py()
                for name in ("starts_open", "ends_open", "offset", "n", "n_file", "file_open")
            }
            if _split_of(part) != split:
                finish_split()
                if waiting is not None:
                    yield waiting
                    waiting = None
                if fact["n"] is None:
                    raise RuntimeError("files were split differently in the second scan")
                split, state, record = _split_of(part), fact["starts_open"], fact["offset"] - 1
                last = record + fact["n"]
            if_closed, if_open, blank = _flags(part, "if_closed", "if_open", "blank")
            after = states_after(if_closed, if_open, state)
            before = np.append(state, after[:-1])
            records = record + np.cumsum(~before & ~blank)
            state, record = bool(after[-1]), int(records[-1])
            kept = np.flatnonzero(before | ~blank)
            if not len(kept):
                continue
            numbers = records[kept]
            tail = numbers == (fact["n_file"] - 1 if fact["file_open"] else -2)
            begins = np.diff(numbers, prepend=numbers[0] - 1) != 0
            starts = np.flatnonzero(begins | tail)
            offsets = pa.array(np.append(starts, len(kept)), pa.int32())
            lines = part.column("raw").take(pa.array(kept)).cast(pa.binary())
            raw = pc.binary_join(pa.ListArray.from_arrays(offsets, lines), b"\n")
            numbers, tail = numbers[starts], tail[starts]
            edge = np.zeros(len(starts), bool)
            if fact["starts_open"]:
                edge |= numbers == fact["offset"] - 1
            if fact["ends_open"]:
                edge |= numbers == fact["offset"] + fact["n"] - 1
            edge &= ~tail
            if waiting is not None:
                if not tail[0] and waiting.column("record")[0].as_py() == int(numbers[0]):
                    joined = waiting.column("raw")[0].as_py() + b"\n" + raw[0].as_py()
                    raw = pa.concat_arrays([pa.array([joined], pa.binary()), raw.slice(1)])
                else:
                    yield waiting
                waiting = None
            n = len(starts)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([split[0]] * n, pa.string()), pa.array(np.full(n, split[1]), pa.int64()),
                    pa.array(numbers, pa.int64()), pa.array(edge), pa.array(tail), raw,
                ],
                names=names,
            )
            if tail[-1]:
                yield out
            else:
                waiting = out.slice(n - 1)
                if n > 1:
                    yield out.slice(0, n - 1)
    finish_split()
    if waiting is not None:
        yield waiting
