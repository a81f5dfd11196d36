"""Approximate nearest neighbours among feature vectors of user windows: multiprobe p-stable hashing.

A table cuts space by `hashes` random lines into cells of one width; a bucket is one
combination of cells. A query visits, over all tables, its own buckets first and then those next
to them, in the order of their estimated chance to hold a neighbour: the smaller the sum of
the squared distances to the borders that lie between, the sooner.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from vigil.llm.store import staged
from vigil.llm.words import mix, signed

_U = np.uint64
#: Vectors whose true neighbours are looked up among all vectors, to tell how many buckets to visit.
TRIALS = 100
#: Buckets a query visits at most.
MOST_PROBES = 1 << 13
TABLES = 10
#: Width of a cell in distances of the k-th neighbour.
WIDTH = 3.0
#: Rows of either side that meet in one tile, on average; a fuller bucket is dealt out.
TILE = 1 << 15
#: Distances worked out at once.
PAIRS = 1 << 17
_SEED = 20240607


@dataclass
class Hashing:
    """The random lines, per length of vector drawn when first used, and the number of buckets to visit."""

    hashes: int
    width: float
    probes: int = MOST_PROBES

    def cells(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, place in the cell from 0 to 1) of each vector by table and line."""
        n, size = vectors.shape
        chance = np.random.default_rng([_SEED, size])
        lines = chance.standard_normal((size, TABLES * self.hashes))
        at = vectors @ lines / self.width + chance.random(TABLES * self.hashes)
        cell = np.floor(at)
        shape = (n, TABLES, self.hashes)
        return cell.astype(np.int64).reshape(shape), (at - cell).reshape(shape)

    def steps(self, size: int) -> np.ndarray:
        """What a bucket's sum changes by for each step to the next cell of a line."""
        return mix(np.arange(self.hashes, dtype=np.uint64) + _U(size << 16), 81) | _U(1)

    def sums(self, cell: np.ndarray, size: int) -> np.ndarray:
        salt = mix(np.arange(TABLES, dtype=np.uint64), 82)
        return (cell.astype(np.uint64) * self.steps(size)).sum(axis=2, dtype=np.uint64) + salt


def visits(place: np.ndarray, most: int) -> list[tuple[int, tuple[int, ...]]]:
    """The first `most` (table, borders) in order of success; border i < K is below line i, K + i above it."""
    tables, hashes = place.shape
    far = np.concatenate([place, 1 - place], axis=1) ** 2
    order = np.argsort(far, axis=1, kind="stable")
    cost = np.take_along_axis(far, order, axis=1).tolist()
    order = order.tolist()
    out: list[tuple[int, tuple[int, ...]]] = [(t, ()) for t in range(tables)][:most]
    heap = [(cost[t][0], t, (0,)) for t in range(tables)]
    heapq.heapify(heap)
    while heap and len(out) < most:
        so_far, t, ranks = heapq.heappop(heap)
        borders = tuple(order[t][r] for r in ranks)
        if len({b % hashes for b in borders}) == len(borders):
            out.append((t, borders))
        last = ranks[-1]
        if last + 1 < 2 * hashes:
            more = cost[t][last + 1]
            heapq.heappush(heap, (so_far + more, t, (*ranks, last + 1)))
            heapq.heappush(heap, (so_far - cost[t][last] + more, t, (*ranks[:-1], last + 1)))
    return out


def _by_size(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the vectors of each length."""
    size = np.asarray(column.value_lengths())
    for length in np.unique(size):
        rows = np.flatnonzero(size == length)
        yield rows, column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), int(length))


def _buckets(hashing: Hashing, schema: pa.Schema):
    """Each vector once per table, with its bucket as the first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, vectors in _by_size(batch["features"]):
                cell, _ = hashing.cells(vectors)
                bucket = mix(hashing.sums(cell, vectors.shape[1]), 83)
                for t in range(TABLES):
                    kept = [batch[name].take(pa.array(rows)) for name in schema.names[1:]]
                    yield pa.record_batch([pa.array(signed(bucket[:, t])), *kept], schema=schema)

    return run


def _probes(hashing: Hashing, schema: pa.Schema):
    """Each query once per bucket it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, vectors in _by_size(batch["features"]):
                cell, place = hashing.cells(vectors)
                sums = hashing.sums(cell, vectors.shape[1])
                steps = hashing.steps(vectors.shape[1])
                steps = np.concatenate([_U(0) - steps, steps])
                for i, row in enumerate(rows):
                    order = visits(place[i], hashing.probes)
                    found = sums[i, [t for t, _ in order]]
                    crossed = np.array([b for _, borders in order for b in borders], dtype=np.int64)
                    np.add.at(found, np.repeat(np.arange(len(order)), [len(borders) for _, borders in order]), steps[crossed])
                    source = pa.array(np.full(len(found), row))
                    kept = [batch[name].take(source) for name in schema.names[1:]]
                    yield pa.record_batch([pa.array(signed(mix(found, 83))), *kept], schema=schema)

    return run


def _number(table: pa.Table, keys: tuple[str, str]) -> np.ndarray:
    """Numbers the keys of a table that is sorted by them."""
    one, two = (table[name].combine_chunks() for name in keys)
    other = pc.or_(pc.not_equal(one[1:], one[:-1]), pc.not_equal(two[1:], two[:-1]))
    return np.r_[0, np.cumsum(other.to_numpy(zero_copy_only=False))]


def _first(query: np.ndarray, near: np.ndarray, square: np.ndarray, k: int) -> np.ndarray:
    """Indexes of each query's k smallest squares, ties to the smaller `near`, each `near` once."""
    order = np.lexsort((near, square, query))
    q, c = query[order], near[order]
    # A vector met in several buckets has the same square each time, so its rows are neighbours.
    once = np.r_[True, (q[1:] != q[:-1]) | (c[1:] != c[:-1])] if len(q) else np.zeros(0, bool)
    order, q = order[once], q[once]
    begin = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(begin, np.diff(np.r_[begin, len(q)]))
    return order[rank < k]


def _tile(k: int, schema: pa.Schema):
    """The k nearest vectors of each query among those that share a bucket with it in this tile."""

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        right = right.sort_by([("near_user_key", "ascending"), ("near_end_day", "ascending")])
        left = left.sort_by([("user_key", "ascending"), ("end_day", "ascending")])
        query, found = _number(left, ("user_key", "end_day")), _number(right, ("near_user_key", "near_end_day"))
        cells = right["cell"].to_numpy()
        order = np.argsort(cells, kind="stable")
        asked = left["cell"].to_numpy()
        low, high = (np.searchsorted(cells[order], asked, side) for side in ("left", "right"))
        size = high - low
        upto = np.cumsum(size)
        x = right["near_features"].combine_chunks()
        y = left["features"].combine_chunks()
        x, y = (v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) for v in (x, y))
        parts = []
        for begin in range(0, int(upto[-1]), PAIRS):
            pair = np.arange(begin, min(begin + PAIRS, int(upto[-1])))
            probe = np.searchsorted(upto, pair, "right")
            near = order[low[probe] + pair - (upto - size)[probe]]
            apart = x[near] - y[probe]
            square = np.einsum("ij,ij->i", apart, apart)
            best = _first(query[probe], found[near], square, k)
            parts.append((probe[best], near[best], square[best]))
        if not parts:
            return schema.empty_table()
        probe, near, square = (np.concatenate(p) for p in zip(*parts))
        best = _first(query[probe], found[near], square, k)
        probe, near = pa.array(probe[best]), pa.array(near[best])
        return pa.table(
            [left["user_key"].take(probe), left["end_day"].take(probe), right["near_user_key"].take(near), right["near_end_day"].take(near), pa.array(square[best])],
            names=schema.names,
        ).cast(schema)

    return search


def _scan(keys: list[tuple], trials: list[np.ndarray], k: int, schema: pa.Schema):
    """The k vectors nearest to each trial vector in this partition, itself left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[float, np.ndarray]]] = {i: [] for i in range(len(trials))}
        for batch in batches:
            own = list(zip(batch["user_key"].to_pylist(), batch["end_day"].to_pylist()))
            for rows, vectors in _by_size(batch["features"]):
                for i, trial in enumerate(trials):
                    if len(trial) != vectors.shape[1]:
                        continue
                    square = ((vectors - trial) ** 2).sum(axis=1)
                    for j in np.argsort(square)[: k + 1]:
                        if own[rows[j]] != keys[i]:
                            best[i].append((float(square[j]), vectors[j]))
                    best[i] = sorted(best[i], key=lambda b: b[0])[:k]
        for i, found in best.items():
            if found:
                yield pa.record_batch(
                    [pa.array([i] * len(found), pa.int32()), pa.array([s for s, _ in found]), pa.array([v.tolist() for _, v in found])],
                    schema=schema,
                )

    return run


def fit_hashing(vectors: DataFrame, k: int, recall: float) -> Hashing:
    """How to hash `vectors` so that about `recall` of the k nearest neighbours are met.

    The true neighbours of `TRIALS` vectors, chosen by hash, are found by one scan of all
    vectors; visits are as many as that share of them needs, `MOST_PROBES` at most. The driver
    sees the trial vectors and their neighbours.
    """
    spark = vectors.sparkSession
    count = vectors.count()
    # A line halves the buckets' rows and more than doubles the visits, so there is one for every two doublings.
    hashing = Hashing(max(4, round(np.log2(max(2, count)) / 2) + 1), 1.0)
    chosen = vectors.orderBy(F.xxhash64("user_key", "end_day"), "user_key", "end_day").limit(TRIALS)
    trials = [(r["user_key"], r["end_day"], np.array(r["features"])) for r in chosen.select("user_key", "end_day", "features").collect()]
    schema = spark.createDataFrame([], "trial int, square double, features array<double>").schema
    run = _scan([t[:2] for t in trials], [t[2] for t in trials], k, to_arrow_schema(schema))
    rank = F.row_number().over(Window.partitionBy("trial").orderBy("square"))
    near = vectors.mapInArrow(run, schema).withColumn("rank", rank).where(F.col("rank") <= k).collect()
    if not near:
        return hashing
    farthest: dict[int, float] = {}
    for r in near:
        farthest[r["trial"]] = max(farthest.get(r["trial"], 0.0), r["square"] ** 0.5)
    hashing.width = WIDTH * float(np.median(list(farthest.values()))) or 1.0
    needed: list[int] = []
    for i, (_, _, trial) in enumerate(trials):
        cell, place = hashing.cells(trial[None])
        order = {visit: n for n, visit in enumerate((t, frozenset(b)) for t, b in visits(place[0], MOST_PROBES))}
        for r in near:
            if r["trial"] != i:
                continue
            step = hashing.cells(np.array(r["features"])[None])[0][0] - cell[0]
            reached = [MOST_PROBES]
            for t in np.flatnonzero((np.abs(step) <= 1).all(axis=1)):
                borders = np.r_[np.flatnonzero(step[t] < 0), hashing.hashes + np.flatnonzero(step[t] > 0)]
                reached.append(order.get((int(t), frozenset(borders.tolist())), MOST_PROBES))
            needed.append(min(reached) + 1)
    hashing.probes = min(MOST_PROBES, int(np.quantile(needed, recall, method="higher")))
    return hashing


def _dealt(rows: DataFrame, hot: DataFrame, key: tuple[str, str], own: str, other: str, tiles: int) -> DataFrame:
    """Rows with the cell and tile where they meet the other side; those of a full bucket are dealt out."""
    mine = F.coalesce(F.pmod(F.xxhash64(*key), F.col(own)), F.lit(0))
    theirs = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1))
    spread = rows.join(hot, "bucket", "left").withColumn("mine", mine).withColumn("theirs", theirs)
    first, second = ("mine", "theirs") if own == "parts" else ("theirs", "mine")
    cell = F.when(F.col(own).isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", F.col(first).cast("long"), F.col(second).cast("long")))
    spread = spread.withColumn("cell", cell)
    return spread.withColumn("tile", F.pmod(F.xxhash64("cell"), F.lit(tiles)).cast("int")).drop("mine", "theirs", "parts", "blocks", "bucket")


def near_windows(queries: DataFrame, windows: DataFrame, k: int = 10, recall: float = 0.97) -> DataFrame:
    """The k nearest windows by Euclidean distance that multiprobe hashing finds for each query.

    Both sides have `user_key`, `end_day` and `features`, an array of numbers; a window is not
    compared with those of its own key. Returns user_key, end_day, rank (from 1),
    near_user_key, near_end_day, distance (in double precision on the given vectors), ties by the
    smaller key; a query that meets fewer than k windows has those it meets.

    Equal vectors are hashed once, with the k + 1 smallest of their keys, so groups of copies
    cost nothing and lose no result. Buckets with many vectors or queries are dealt out to
    several tiles; no candidate is dropped. `recall` is the share of true neighbours that the
    visited buckets hold, as measured on `TRIALS` vectors. Vectors that are null, all zero, or
    hold a null or a value that is not finite take no part, nor do rows without a whole key;
    vectors of different length are not compared; repeated windows count as often as they occur,
    repeated queries once; other columns are ignored; empty tables give no rows.
    """
    finite = F.forall("features", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole: Column = F.col("features").isNotNull() & finite & F.exists("features", lambda x: x != 0)
    whole = whole & F.col("user_key").isNotNull() & F.col("end_day").isNotNull()
    vector = F.transform("features", lambda x: x.cast("double") + F.lit(0.0)).alias("features")
    asked = queries.where(whole).select("user_key", "end_day", vector)
    asked = staged(asked.groupBy("user_key", "end_day").agg(F.min("features").alias("features")), "near-queries")
    kinds = {f.name: f.dataType.simpleString() for f in windows.schema.fields}
    user, day = kinds["user_key"], kinds["end_day"]

    held = windows.where(whole).select("user_key", "end_day", vector)
    rank = F.row_number().over(Window.partitionBy("features").orderBy("user_key", "end_day"))
    held = held.withColumn("rank", rank).where(F.col("rank") <= k + 1)
    members = F.array_sort(F.collect_list(F.struct("user_key", "end_day")))
    held = staged(held.groupBy("features").agg(members.alias("members")), "near-vectors")
    vectors = held.select(F.col("members")[0].alias("key"), "features").select("key.*", "features")
    asked_once = staged(asked.groupBy("features").agg(F.min(F.struct("user_key", "end_day")).alias("key")), "near-asked")
    hashing = fit_hashing(vectors, k, recall)

    spark = windows.sparkSession
    row = spark.createDataFrame([], f"bucket bigint, user_key {user}, end_day {day}, features array<double>").schema
    arrow = to_arrow_schema(row)
    index = vectors.mapInArrow(_buckets(hashing, arrow), row)
    probes = staged(asked_once.select("key.*", "features").mapInArrow(_probes(hashing, arrow), row), "near-probes")
    single = spark.createDataFrame([], "bucket bigint").schema
    counted = vectors.select("features").mapInArrow(_buckets(hashing, to_arrow_schema(single)), single)
    counted = counted.select("bucket", F.lit(1).alias("held"), F.lit(0).alias("asked")).unionByName(
        probes.select("bucket", F.lit(0).alias("held"), F.lit(1).alias("asked"))
    )
    counted = counted.groupBy("bucket").agg(F.sum("held").alias("held"), F.sum("asked").alias("asked"))
    full = (F.col("held") > TILE) | (F.col("asked") > TILE)
    parts = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / TILE)).cast("int")
    hot = staged(counted.where(full).select("bucket", parts("held").alias("parts"), parts("asked").alias("blocks")), "near-full")
    tiles = max(1, -(-TABLES * vectors.count() // TILE))
    left = _dealt(probes, hot, ("user_key", "end_day"), "blocks", "parts", tiles)
    right = _dealt(index, hot, ("user_key", "end_day"), "parts", "blocks", tiles)
    right = right.withColumnsRenamed({c: f"near_{c}" for c in ("user_key", "end_day", "features")})
    right = right.withColumn("size", F.size("near_features"))
    left = left.withColumn("size", F.size("features"))
    out = spark.createDataFrame([], f"user_key {user}, end_day {day}, near_user_key {user}, near_end_day {day}, square double").schema
    found = left.groupBy("tile", "size").cogroup(right.groupBy("tile", "size")).applyInArrow(_tile(k + 1, to_arrow_schema(out)), out)
    found = found.groupBy("user_key", "end_day", "near_user_key", "near_end_day").agg(F.min("square").alias("square"))
    order = Window.partitionBy("user_key", "end_day").orderBy("square", "near_user_key", "near_end_day")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1).drop("rank")

    keys = held.select(F.col("members")[0].alias("near"), "members")
    copies = found.withColumn("near", F.struct(F.col("near_user_key").alias("user_key"), F.col("near_end_day").alias("end_day")))
    copies = copies.join(keys, "near").select("user_key", "end_day", "square", F.explode("members").alias("near"))
    order = Window.partitionBy("user_key", "end_day").orderBy("square", "near.user_key", "near.end_day")
    copies = copies.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)
    lists = copies.groupBy(F.struct("user_key", "end_day").alias("key")).agg(F.array_sort(F.collect_list(F.struct("rank", "square", "near"))).alias("near"))
    answers = asked.join(asked_once, "features").drop("features").join(lists, "key")
    own = F.struct("user_key", "end_day")
    others = F.slice(F.filter("near", lambda x: x["near"] != own), 1, k)
    answers = answers.select("user_key", "end_day", F.posexplode(others).alias("at", "found"))
    return answers.select(
        "user_key", "end_day", (F.col("at") + 1).alias("rank"), F.col("found.near.user_key").alias("near_user_key"),
        F.col("found.near.end_day").alias("near_end_day"), F.sqrt("found.square").alias("distance"),
    )
