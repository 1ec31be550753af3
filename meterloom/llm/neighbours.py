"""Approximate nearest neighbours by multiprobe p-stable hashing.

A hash function projects a vector on a Gaussian direction, shifts it and cuts the
line into slots of one width; a table's bucket is the slots of several functions.
Where near vectors fall into other buckets, they do so by a slot whose edge is near
to the query's projection. A query therefore visits the buckets of a table in the
order of the sum of squared distances to the edges that must be crossed, which is the
order of their estimated chance to hold a neighbour. The candidates of all tables are
merged and ranked by their exact likeness.

Inner products become distances by one more entry: candidates are scaled by the
largest length in their band (lengths within a factor of two) and completed to length
1, queries have length 1 and a 0 there. Bands have buckets of their own; every query
visits those of each band.

How many buckets a table needs is measured, not assumed: for SAMPLE_QUERIES queries
the exact neighbours among all rows are found, and visits go on until TARGET of them
are covered. The order of visits runs through all slots, so that any share can be
reached. The width of the slots follows from the spread of SAMPLE_ROWS rows. These two
samples are all that is fitted; every row is indexed and every query is searched.

Equal vectors are brought together first and searched once: only the smallest ids of
each can be among the nearest, and so the largest group of copies costs no more than
a single row. Buckets with some first slots in common form a cell. A query is sent to
a cell once, with the buckets to visit there; large cells are dealt into blocks of
bounded size on either side.

Defined cases. Vectors that are null, empty or zero, hold null or non-finite entries,
have a null id or another length than most (of lengths equally frequent, the longest)
take no part. Repeated rows count once. Rows that share an id are one item with
several vectors, whose likeness is the best of any. Ties go to the smaller id. A table
with fewer rows gives what there is. Only the named columns are read, so clashing
names do no harm.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterloom.session import settle

NEAREST, QUERY_STEP = 20, 20
TABLES = 3
#: Width of a slot, in units of the rows' spread.
WIDTH = 2.0
SAMPLE_ROWS, SAMPLE_QUERIES, TARGET = 2048, 200, 0.95
#: Rows of either side in a block at most, on average, and bytes of their vectors.
BLOCK_ROWS, BLOCK_BYTES = 8192, 8 << 20
#: Scores held at a time.
SCORES = 1 << 22
MASK = (1 << 64) - 1
PLACES = "array<struct<far: double, vec_id: bigint>>"


# Vectors --------------------------------------------------------------------


def usable(docs: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, v (doubles) and norm of the rows that take part, each once; written once."""
    v = F.col(vector_col).cast("array<double>")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and size(v) > 0")
    sound = F.forall("v", lambda c: F.coalesce(F.abs(c) < F.lit(math.inf), F.lit(False)))  # NaN is above infinity
    # hypot, as squares might vanish or overflow
    rows = rows.where(sound).withColumn("norm", F.aggregate("v", F.lit(0.0), F.hypot))
    rows = rows.where((F.col("norm") > 0) & (F.col("norm") < F.lit(math.inf)))
    rows = settle(rows.dropDuplicates(["id", "v"]), "vectors")
    usual = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size("v") == usual.d) if usual else rows


def distinct_vectors(rows: DataFrame, nearest: int) -> DataFrame:
    """item, v, norm, band and ids: the smallest ids of each vector, one more than can be asked for."""
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = rows.withColumn("nth", nth).where(F.col("nth") <= nearest + 1)
    items = few.groupBy("v").agg(F.max("norm").alias("norm"), F.sort_array(F.collect_list("id")).alias("ids"))
    band = F.floor(F.log2("norm") + 0.5).cast("int")
    return settle(
        items.select(F.monotonically_increasing_id().alias("item"), "v", "norm", band.alias("band"), "ids"), "items"
    )


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


# Hash functions -------------------------------------------------------------


@dataclass
class Hashes:
    """The functions of all tables. A bucket's key is a sum over its slots, so that a visit changes it by addition."""

    directions: np.ndarray  # tables x functions x (entries + 1)
    shifts: np.ndarray
    width: float
    longest: dict[int, float]  # by band
    in_cell: int
    factors: np.ndarray  # tables x functions, odd
    cell_factors: np.ndarray
    band_factor: int

    @classmethod
    def make(cls, d: int, n: int, width: float, longest: dict[int, float], tables: int = TABLES, seed: int = 13):
        rng = np.random.default_rng(seed)
        # a function tells about one bit; more of them as rows grow
        functions = max(2, round(0.6 * math.log2(max(n, 2) / 50)))
        in_cell = min(functions, max(1, round(math.log2(max(n, 2) / block_rows(d)))))
        odd = lambda *shape: rng.integers(0, 2**63, shape, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        return cls(
            rng.standard_normal((tables, functions, d + 1)), rng.uniform(0, width, (tables, functions)), width, longest,
            in_cell, odd(tables, functions), odd(tables, functions), int(odd(1)[0]),
        )

    def places(self, unit: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Projections in slots: rows x tables x functions."""
        flat = self.directions.reshape(-1, self.directions.shape[2])
        projected = unit @ flat[:, :-1].T + np.outer(last, flat[:, -1])
        return projected.reshape(len(unit), *self.shifts.shape) / self.width + self.shifts / self.width

    def candidate_places(self, v: np.ndarray, norm: np.ndarray, band: np.ndarray) -> np.ndarray:
        longest = np.array([self.longest[b] for b in band.tolist()])
        unit = v / longest[:, None]
        return self.places(unit, np.sqrt(np.maximum(0.0, 1 - np.minimum(1.0, norm / longest) ** 2)))

    def query_places(self, v: np.ndarray, norm: np.ndarray) -> np.ndarray:
        return self.places(v / norm[:, None], np.zeros(len(v)))

    def keys(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and cell of each row and table, without the part that the band adds."""
        own = slots.astype(np.int64).astype(np.uint64)
        key = (own * self.factors).sum(axis=2, dtype=np.uint64)
        inner = own[:, :, : self.in_cell] * self.cell_factors[:, : self.in_cell]
        # tables differ by an amount that no visit adds
        return key, inner.sum(axis=2, dtype=np.uint64) + self.cell_factors[:, -1] * np.uint64(0x9E3779B97F4A7C15)

    def of_band(self, band) -> int:
        return (int(band) * self.band_factor) & MASK


def visits(places: np.ndarray, factors: np.ndarray, cell_factors: np.ndarray, in_cell: int) -> Iterator:
    """(cost, change of key, change of cell) of a table's buckets, by rising cost.

    Functions are ordered by the distance to their nearer edge. From a set of
    crossings whose last function is p, the next ones are: p goes one slot farther
    (to the other side, and so on); the function after p joins; or it takes p's
    place. Each set arises once, from one of a lower cost.
    """
    lower = places - np.floor(places)
    near = np.minimum(lower, 1 - lower)
    order = np.argsort(near, kind="stable").tolist()
    near, side = near.tolist(), np.where(lower <= 0.5, -1, 1).tolist()
    factors, cell_factors = factors.tolist(), cell_factors.tolist()
    m = len(order)

    def crossing(p: int, j: int) -> tuple[float, int, int]:
        """Cost and changes if the p-th function takes its j-th slot by distance."""
        f = order[p]
        distance = (j - 1) // 2 + near[f] if j % 2 else j // 2 - near[f]
        slots = side[f] * ((j + 1) // 2) if j % 2 else -side[f] * (j // 2)
        return distance * distance, slots * factors[f], slots * cell_factors[f] if f < in_cell else 0

    first = [crossing(p, 1) for p in range(m)]
    yield 0.0, 0, 0
    heap = [(*first[0], 0, 1)]
    while heap:
        cost, key, cell, p, j = heapq.heappop(heap)
        yield cost, key, cell
        own, farther = first[p] if j == 1 else crossing(p, j), crossing(p, j + 1)
        heapq.heappush(
            heap, (cost - own[0] + farther[0], key - own[1] + farther[1], cell - own[2] + farther[2], p, j + 1)
        )
        if p + 1 < m:
            c, k, x = first[p + 1]
            heapq.heappush(heap, (cost + c, key + k, cell + x, p + 1, 1))
            if j == 1:
                heapq.heappush(heap, (cost - own[0] + c, key - own[1] + k, cell - own[2] + x, p + 1, 1))


def crossing_cost(places: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The cost of visiting given slots (... x functions)."""
    lower = places - np.floor(places)
    away = slots - np.floor(places)
    distance = np.where(away > 0, away - lower, np.where(away < 0, -away - 1 + lower, 0.0))
    return (distance**2).sum(axis=-1)


def block_rows(d: int) -> int:
    return max(64, min(BLOCK_ROWS, BLOCK_BYTES // (8 * d)))


# Fitting --------------------------------------------------------------------


@dataclass
class Index:
    """Hash functions, and how many buckets of each table (and band) a query visits."""

    hashes: Hashes
    visited: int
    sample_recall: float


def _sampled(items: DataFrame, rows: int) -> list:
    """Rows with the smallest hashes of an id; at most `rows`."""
    return items.orderBy(F.xxhash64(F.element_at("ids", 1)), "item").limit(rows).collect()


def exact_neighbours(items: DataFrame, hashes: Hashes, queries: np.ndarray, own: np.ndarray, nearest: int) -> list:
    """(query, slots) of the exact nearest items of a few queries, found in one pass over all items."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        best = np.full((len(queries), 0), 0.0)
        slots = np.zeros((len(queries), 0, *hashes.shifts.shape), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                item, norm, band = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
                v = _matrix(part.column(1))
                scores = queries @ v.T
                scores[own[:, None] == item[None, :]] = -np.inf
                places = np.floor(hashes.candidate_places(v, norm, band)).astype(np.int64)
                top = np.argsort(-scores, axis=1, kind="stable")[:, :nearest]
                best = np.concatenate([best, np.take_along_axis(scores, top, 1)], axis=1)
                slots = np.concatenate([slots, places[top]], axis=1)
                top = np.argsort(-best, axis=1, kind="stable")[:, :nearest]
                best = np.take_along_axis(best, top, 1)
                slots = np.take_along_axis(slots, top[:, :, None, None], 1)
        query, place = np.nonzero(best > -np.inf)
        packed = [slots[q, p].tobytes() for q, p in zip(query.tolist(), place.tolist())]
        columns = [pa.array(query.astype(np.int32)), pa.array(best[query, place]), pa.array(packed, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["query", "score", "slots"])

    parts = items.select("item", "v", "norm", "band").mapInArrow(work, "query int, score double, slots binary")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "slots"))
    found = parts.withColumn("rank", rank).where(F.col("rank") <= nearest).select("query", "slots").collect()
    return [(r.query, np.frombuffer(r.slots, np.int64).reshape(hashes.shifts.shape)) for r in found]


def needed_visits(hashes: Hashes, places: np.ndarray, neighbours: list, target: float) -> tuple[int, float]:
    """The least number of buckets of each table with which `target` of the neighbours are found, and their share."""
    if not neighbours:
        return 1, 1.0
    query = np.array([q for q, _ in neighbours])
    cost = crossing_cost(places[query], np.array([s for _, s in neighbours]))  # pairs x tables
    tables = range(hashes.shifts.shape[0])
    wanted = math.ceil(target * len(query) - 1e-9)
    tried = 32
    while True:
        rank = np.full(len(query), np.iinfo(np.int64).max)
        for q in np.unique(query).tolist():
            pairs = np.flatnonzero(query == q)
            for t in tables:
                run = visits(places[q, t], hashes.factors[t], hashes.cell_factors[t], hashes.in_cell)
                costs = np.maximum.accumulate([c for c, _ in zip((x[0] for x in run), range(tried))])
                # equal costs count as visited late
                later = np.searchsorted(costs, cost[pairs, t] * (1 + 1e-9) + 1e-12, "right")
                rank[pairs] = np.minimum(rank[pairs], np.where(later < tried, later, np.iinfo(np.int64).max))
        visited = int(np.sort(rank)[wanted - 1])
        if visited < tried:
            visited = max(1, visited)
            return visited, float((rank <= visited).mean())
        tried *= 2


def fit(items: DataFrame, queries: DataFrame, nearest: int = NEAREST, target: float = TARGET, tables: int = TABLES) -> Index:
    """An index of `items`; `queries` has item, v, norm and ids of those that are searched."""
    bands = items.groupBy("band").agg(F.max("norm").alias("longest"), F.count("*").alias("n")).collect()
    longest = {b.band: b.longest for b in bands}  # some 2100 bands cover all doubles
    sample = _sampled(items, SAMPLE_ROWS)
    v, norm = np.array([r.v for r in sample]), np.array([r.norm for r in sample])
    scale = np.array([longest[r.band] for r in sample])
    whole = np.column_stack([v / scale[:, None], np.sqrt(np.maximum(0.0, 1 - np.minimum(1.0, norm / scale) ** 2))])
    spread = math.sqrt(whole.var(axis=0).sum())
    hashes = Hashes.make(v.shape[1], sum(b.n for b in bands), WIDTH * spread or 1.0, longest, tables)
    asked = _sampled(queries, SAMPLE_QUERIES)
    if not asked:
        return Index(hashes, 1, 1.0)
    v, norm = np.array([r.v for r in asked]), np.array([r.norm for r in asked])
    neighbours = exact_neighbours(items, hashes, v, np.array([r.item for r in asked]), nearest)
    return Index(hashes, *needed_visits(hashes, hashes.query_places(v, norm), neighbours, target))


# Searching ------------------------------------------------------------------


def _signed(values) -> np.ndarray:
    return np.asarray(values, np.uint64).view(np.int64)


def indexed(items: DataFrame, hashes: Hashes, vectors: bool) -> DataFrame:
    """A row per item and table: cell, and with `vectors` also key, item, ids and v."""
    schema = "cell bigint, key bigint, item bigint, ids array<bigint>, v array<double>" if vectors else "cell bigint"

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                norm, band = (part.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
                slots = np.floor(hashes.candidate_places(_matrix(part.column(1)), norm, band))
                key, cell = hashes.keys(slots)
                offset = np.array([hashes.of_band(b) for b in band.tolist()], np.uint64)[:, None]
                key, cell = _signed(key + offset), _signed(cell + offset)
                for t in range(key.shape[1]):
                    columns = [pa.array(np.ascontiguousarray(cell[:, t]))]
                    if vectors:
                        columns += [pa.array(np.ascontiguousarray(key[:, t])), part.column(0), part.column(4), part.column(1)]
                    names = ["cell", "key", "item", "ids", "v"][: len(columns)]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return items.select("item", "v", "norm", "band", "ids").mapInArrow(work, schema)


def probes(queries: DataFrame, index: Index) -> DataFrame:
    """A row per searched item and cell: the keys of the buckets to visit there, packed."""
    hashes, visited = index.hashes, index.visited

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        offsets = [hashes.of_band(b) for b in hashes.longest]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                places = hashes.query_places(_matrix(part.column(1)), part.column(2).to_numpy(zero_copy_only=False))
                key, cell = hashes.keys(np.floor(places))
                rows = []
                for i, item in enumerate(part.column(0).to_pylist()):
                    for t in range(places.shape[1]):
                        own: dict[int, list[int]] = {}
                        run = visits(places[i, t], hashes.factors[t], hashes.cell_factors[t], hashes.in_cell)
                        for (_, k, c), _ in zip(run, range(visited)):
                            own.setdefault(c, []).append((int(key[i, t]) + k) & MASK)
                        for c, keys in own.items():
                            keys = np.array(keys, np.uint64)
                            for offset in offsets:
                                to = (int(cell[i, t]) + c + offset) & MASK
                                rows.append((to, item, (keys + np.uint64(offset)).tobytes()))
                cells, items, packed = zip(*rows)
                columns = [pa.array(_signed(cells)), pa.array(items, pa.int64()), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["cell", "item", "keys"])

    return queries.select("item", "v", "norm").mapInArrow(work, "cell bigint, item bigint, keys binary")


def _best_of_block(nearest: int):
    def search(candidates, queries):
        """(item, best): the nearest candidates in the visited buckets of a block, a row for each query in it."""
        import pyarrow as pa

        place = pa.struct([("far", pa.float64()), ("vec_id", pa.int64())])
        schema = pa.schema([("item", pa.int64()), ("best", pa.list_(place))])
        if not candidates.num_rows or not queries.num_rows:
            return schema.empty_table()
        keys = candidates.column("key").to_numpy()
        order = np.argsort(keys, kind="stable")
        buckets, starts = np.unique(keys[order], return_index=True)
        ends = [*starts[1:].tolist(), len(keys)]
        c = _matrix(candidates.column("v"))[order]
        lists = candidates.column("ids").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())[order]
        first = lists.offsets.to_numpy()[:-1][order]
        all_ids = lists.values.to_numpy()
        q = _matrix(queries.column("v"))
        asked = queries.column("item").to_numpy()
        packed = queries.column("keys").to_pylist()
        # what two ways of adding up the same product may differ by
        slack = 4 * c.shape[1] * np.finfo(float).eps * np.abs(c).max()
        step = max(1, SCORES // len(keys))
        out = []
        for at in range(0, len(q), step):
            own = q[at : at + step]
            wanted = np.concatenate([np.frombuffer(k, np.int64) for k in packed[at : at + step]])
            row = np.repeat(np.arange(len(own)), [len(k) // 8 for k in packed[at : at + step]])
            bucket = np.minimum(np.searchsorted(buckets, wanted), len(buckets) - 1)
            there = buckets[bucket] == wanted
            bucket, row = bucket[there], row[there]
            by_bucket = np.argsort(bucket, kind="stable")
            bucket, row = bucket[by_bucket], row[by_bucket]
            scores = np.full((len(own), len(keys)), -np.inf)
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)]):
                start, end = starts[bucket[a]], ends[bucket[a]]
                scores[row[a:b], start:end] = own[row[a:b]] @ c[start:end].T
            least = np.full(len(own), -np.inf)
            if len(keys) > nearest + 1:
                least = np.partition(scores, len(keys) - nearest - 1, axis=1)[:, len(keys) - nearest - 1]
            with np.errstate(invalid="ignore"):
                enough = least - slack * np.abs(own).sum(axis=1)
            i, j = np.nonzero((scores >= enough[:, None]) & (scores > -np.inf))
            exact = np.concatenate(
                [(own[i[x : x + 65536]] * c[j[x : x + 65536]]).sum(axis=1) for x in range(0, len(i), 65536)] or [[]]
            )
            # all ids of each candidate, then the best of each query
            n = sizes[j]
            pair = np.repeat(np.arange(len(j)), n)
            ids = all_ids[first[j][pair] + np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)]
            i, exact = i[pair], exact[pair]
            rank = np.lexsort((ids, -exact, i))
            i, exact, ids = i[rank], exact[rank], ids[rank]
            starts_of = np.flatnonzero(np.diff(i, prepend=-1))
            rank_in_query = np.arange(len(i)) - np.repeat(starts_of, np.diff([*starts_of.tolist(), len(i)]))
            kept = rank_in_query <= nearest
            i, exact, ids = i[kept], exact[kept], ids[kept]
            starts_of = np.flatnonzero(np.diff(i, prepend=-1))
            best = pa.StructArray.from_arrays([pa.array(-exact), pa.array(ids)], fields=list(place))
            lists_of = pa.ListArray.from_arrays(pa.array([*starts_of.tolist(), len(i)], pa.int32()), best)
            out.append(pa.table([pa.array(asked[at + i[starts_of]]), lists_of.cast(schema.field("best").type)], schema=schema))
        return pa.concat_tables(out)

    return search


def nearest(
    docs: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    *,
    nearest: int = NEAREST,
    query_step: int = QUERY_STEP,
    target: float = TARGET,
) -> tuple[DataFrame, Index | None]:
    """query_id, rank, vec_id and score of each query's nearest rows found, and the index that was used.

    Queries are the rows whose id is divisible by `query_step`; likeness is the
    inner product.
    """
    rows = usable(docs, id_col, vector_col)
    items = distinct_vectors(rows, nearest)
    asked = rows.where(F.col("id") % query_step == 0).select(F.col("id").alias("query_id"), "v")
    of_item = settle(asked.join(items.select("v", "item"), "v").select("query_id", "item"), "asked")
    queries = items.join(of_item.select("item").distinct(), "item", "left_semi")
    queries = settle(queries, "queries")
    if queries.isEmpty():
        empty = of_item.select("query_id", F.lit(1).alias("rank"), F.col("query_id").alias("vec_id"), F.lit(0.0).alias("score"))
        return empty.where(F.lit(False)), None
    index = fit(items, queries, nearest, target)

    visiting = settle(probes(queries, index), "probes")
    size = block_rows(len(index.hashes.directions[0][0]) - 1)
    blocks = lambda n: F.ceil(F.col(n) / size).cast("int")
    candidates_of = indexed(items, index.hashes, False).groupBy("cell").agg(F.count("*").alias("n_c"))
    queries_of = visiting.groupBy("cell").agg(F.count("*").alias("n_q"))
    cells = settle(
        candidates_of.join(queries_of, "cell").select("cell", blocks("n_c").alias("c_blocks"), blocks("n_q").alias("q_blocks")),
        "cells",
    )
    salt = lambda n: F.pmod(F.xxhash64("item"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    candidates = (
        indexed(items, index.hashes, True)
        .join(cells, "cell")
        .select("cell", salt("c_blocks").alias("c_block"), every("q_blocks").alias("q_block"), "key", "item", "ids", "v")
    )
    searched = (
        visiting.join(cells, "cell")
        .join(queries.select("item", "v"), "item")
        .select("cell", every("c_blocks").alias("c_block"), salt("q_blocks").alias("q_block"), "item", "v", "keys")
    )
    block = ["cell", "c_block", "q_block"]
    found = (
        candidates.groupBy(*block)
        .cogroup(searched.groupBy(*block))
        .applyInArrow(_best_of_block(nearest), f"item bigint, best {PLACES}")
    )
    # a query has a place for each candidate it keeps of a block; a candidate comes once from each table at most
    gathered = found.groupBy("item").agg(F.sort_array(F.flatten(F.collect_list("best"))).alias("best"))

    def first_ones(kept, place):
        known = (F.size(kept) > nearest) | F.exists(kept, lambda x: x["vec_id"] == place["vec_id"])
        return F.when(known, kept).otherwise(F.concat(kept, F.array(place)))

    first = F.slice(F.array_distinct(F.slice("best", 1, TABLES * (nearest + 1))), 1, nearest + 1)
    alone = F.size(F.array_distinct(first["vec_id"])) == F.size(first)  # no id with two vectors among them
    one_each = F.aggregate("best", F.array().cast(PLACES), first_ones)
    best = gathered.select("item", F.when(alone, first).otherwise(one_each).alias("best"))
    of_items = best.select("item", F.inline("best")).withColumn("score", -F.col("far"))
    order = (F.desc("score"), F.asc("vec_id"))
    merged = (
        of_item.join(of_items, "item")
        .where("vec_id <> query_id")
        .groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    )
    return merged.where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score"), index
