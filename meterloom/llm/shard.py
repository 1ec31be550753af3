"""Histogram sort: exact splitters by refined probes, then one exchange.

Rows are ordered by up to three whole-number columns, compared one after the
other. To cut the order into ranges of wanted sizes, every round lays evenly
spaced probes over the intervals that still hold an unmet splitter and counts,
in one distributed aggregation, the exact bytes in each cell between probes. The
driver sees a bounded number of counts per open interval, picks the cell that
holds each wanted position, and refines inside it. When an interval has shrunk
to one value of a column (a group of copies, say), the next column is probed. A
splitter is done when the bytes below it are within its tolerance, or when no
key lies between it and the wanted position; then rows are exchanged once.

Null keys sort first. Rows equal in all key columns cannot be cut apart; give a
last column that differs (`shard_by_bytes` numbers the rows of its own table).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterloom.session import settle

LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
PROBES = 256
FIRST_PROBES = 4096
KEYS = ("_sh_a", "_sh_b", "_sh_c")


class _Open:
    """One interval: key columns before `level` fixed to `prefix`, values lo..hi at `level`; bytes below it."""

    def __init__(self, prefix, lo, hi, below):
        self.prefix, self.lo, self.hi, self.below = prefix, lo, hi, below

    def id(self):
        return (*self.prefix, self.lo, self.hi)


def _bucket(iv: _Open, probes: int, keys) -> Column:
    """Cell number of the level's value in the interval, exact for 64-bit values."""
    key = F.col(keys[len(iv.prefix)])
    if iv.hi - iv.lo < probes:
        return key - F.lit(iv.lo)
    step = (iv.hi - iv.lo) // probes + 1
    shifted = key.cast("decimal(20,0)") - F.lit(iv.lo).cast("decimal(20,0)")
    return F.floor(shifted / F.lit(step).cast("decimal(20,0)")).cast("long")


def _inside(iv: _Open, keys) -> Column:
    key = F.col(keys[len(iv.prefix)])
    test = (key >= F.lit(iv.lo)) & (key <= F.lit(iv.hi))
    for name, value in zip(keys, iv.prefix):
        test = test & (F.col(name) == F.lit(value))
    return test


def find_splitters(table: DataFrame, keys, size: str, wanted, tolerance, total: int, first=FIRST_PROBES, probes=PROBES):
    """Key tuples such that about `wanted[i]` bytes lie below splitter i.

    `table` is read once per round, so it should be a written one. A splitter is
    the smallest key of the range above it, as a tuple as long as `keys`; None
    stands for "above all rows". Returns (splitter, exact bytes below) pairs.
    """
    done: dict[int, tuple] = {}
    open_: dict[int, _Open] = {i: _Open((), LOWEST, HIGHEST, 0) for i in range(len(wanted))}
    n_cells = first
    while open_:
        intervals = list({iv.id(): iv for iv in open_.values()}.values())
        place = cell = None
        for number, iv in enumerate(intervals):
            test, bucket = _inside(iv, keys), _bucket(iv, n_cells, keys)
            place = F.when(test, number) if place is None else place.when(test, number)
            cell = F.when(test, bucket) if cell is None else cell.when(test, bucket)
        counted = (
            table.select(*keys, size, place.alias("_place"), cell.alias("_cell"))
            .where("_place is not null")
            .groupBy("_place", "_cell")
            .agg(
                F.sum(size).alias("bytes"),
                F.min(F.struct(*keys)).alias("least"),
                F.max(F.struct(*keys)).alias("most"),
            )
            .orderBy("_place", "_cell")
            .collect()
        )
        by_place: dict[int, list] = {}
        for r in counted:
            by_place.setdefault(r["_place"], []).append(r)
        number_of = {iv.id(): n for n, iv in enumerate(intervals)}
        for i, iv in list(open_.items()):
            below, cells = iv.below, by_place.get(number_of[iv.id()], [])
            for j, r in enumerate(cells):
                if below + r["bytes"] > wanted[i]:
                    break
                below += r["bytes"]
            else:
                done[i] = (None, below)
                del open_[i]
                continue
            least, most = tuple(r["least"]), tuple(r["most"])
            above = below + r["bytes"]
            after = tuple(cells[j + 1]["least"]) if j + 1 < len(cells) else None
            if wanted[i] - below <= tolerance[i]:
                done[i] = (least, below)
            elif above - wanted[i] <= tolerance[i] and after is not None:
                done[i] = (after, above)
            elif least == most:  # one key: it cannot be cut, so the nearer side is taken
                done[i] = (least, below) if wanted[i] - below <= above - wanted[i] or after is None else (after, above)
            else:
                level = len(iv.prefix)
                while least[level] == most[level]:
                    level += 1
                open_[i] = _Open(least[:level], least[level], most[level], below)
                continue
            del open_[i]
        n_cells = probes
    return [done[i] for i in range(len(wanted))]


def range_number(splitters, keys) -> Column:
    """How many splitters are at or below the row's key, by binary search in nested conditions."""

    def at_or_above(splitter):
        test = F.col(keys[-1]) >= F.lit(splitter[-1])
        for name, value in list(zip(keys, splitter))[-2::-1]:
            test = (F.col(name) > F.lit(value)) | ((F.col(name) == F.lit(value)) & test)
        return test

    def search(low, high):
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        if splitters[mid] is None:
            return search(low, mid)
        return F.when(at_or_above(splitters[mid]), search(mid + 1, high)).otherwise(search(low, mid))

    return search(0, len(splitters))


def long_key(column: Column) -> Column:
    """A whole-number key without nulls."""
    return F.coalesce(column.cast("long"), F.lit(LOWEST))


def shard_by_bytes(
    rows: DataFrame, order_by, size: Column, shards: int = 24, tolerance: float = 0.002, pieces: int | None = None
) -> DataFrame:
    """`rows` plus shard, slot (gapless from 0 in the shard's order) and size, shards of nearly equal bytes.

    `order_by`: one or two whole-number columns; a row number of the written
    table breaks ties, so a group of any size can be cut. A splitter may be off
    by `tolerance` of a shard's size. Every shard is exchanged in several
    ranges, at least `pieces` in all (default: the shuffle partitions), so no
    task holds a whole shard. Input columns named size, shard or slot give way.
    """
    spark = rows.sparkSession
    named = [c for c in rows.columns if c not in ("size", "shard", "slot")]
    keys = KEYS[-len(order_by) - 1 :]
    keyed = rows.select(
        *named,
        size.alias("_sh_size"),
        *[long_key(c).alias(k) for c, k in zip(order_by, keys)],
        F.monotonically_increasing_id().alias(keys[-1]),
    )
    keyed = settle(keyed, "shard-keys")
    total = keyed.agg(F.sum("_sh_size")).first()[0] or 0
    per_shard = max(1, -(-(pieces or int(spark.conf.get("spark.sql.shuffle.partitions"))) // shards))
    n_ranges = shards * per_shard
    wanted = [total * i / n_ranges for i in range(1, n_ranges)]
    tight = [i % per_shard == 0 for i in range(1, n_ranges)]
    room = [total / shards * tolerance if t else total / n_ranges / 4 for t in tight]
    found = find_splitters(keyed, keys, "_sh_size", wanted, room, total) if total else [(None, 0)] * len(wanted)
    splitters = _ascending([s for s, _ in found])
    ranged = keyed.withColumn("_sh_range", range_number(splitters, keys).cast("int"))
    counts = [0] * n_ranges
    for r in ranged.groupBy("_sh_range").count().collect():  # one row per range
        counts[r[0]] = r[1]
    before = [sum(counts[r - r % per_shard : r]) for r in range(n_ranges)]
    offsets = F.array(*[F.lit(b).cast("long") for b in before])
    place = F.row_number().over(Window.partitionBy("_sh_range").orderBy(*keys))
    return (
        ranged.repartitionById(n_ranges, "_sh_range")
        .withColumn("slot", F.element_at(offsets, F.col("_sh_range") + 1) + place - 1)
        .select(
            *named,
            F.col("_sh_size").alias("size"),
            F.floor(F.col("_sh_range") / per_shard).cast("int").alias("shard"),
            "slot",
        )
    )


def _ascending(splitters):
    """Loose tolerances may let neighbours cross; a range may be empty, but order must hold."""
    out, last = [], None
    for s in splitters:
        if last is not None and (s is None or (out and out[-1] is None)):
            s = None
        elif last is not None and s is not None and s < last:
            s = last
        out.append(s)
        last = s if s is not None else last
    return out
