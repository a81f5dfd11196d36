"""Exact top-k search among feature vectors of user windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

#: Vectors in a shard and in a block of queries, on average; a tile is one of each.
SHARD = 8192
QUERY_BLOCK = 4096
#: Top lists of so many shards are merged at a time.
FAN = 16
#: Queries whose products with a shard are held at once.
STRIPE = 256
_EXACT = float(1 << 53)


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Integer inner products; what is beyond a long is held at its ends."""
    size = lambda m: float(np.abs(m.astype(np.float64)).max(initial=0.0))
    if size(left) * size(right) * max(1, left.shape[1]) < _EXACT:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    exact = left.astype(object) @ right.astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _best(scores: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of the indexes `at`, those of the k highest scores, ties to the smaller index."""
    row = scores[at]
    if len(at) > 4 * k:
        # Everything at or above the k-th score; ties may leave more than k. Rounding to
        # doubles keeps the order, so nothing of the first k is lost.
        rough = row.astype(np.float64)
        keep = rough >= np.partition(rough, len(at) - k)[len(at) - k]
        at, row = at[keep], row[keep]
    return at[np.lexsort((at, ~row))][:k]


def _tile(k: int, schema: pa.Schema):
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        right = right.sort_by([("near_user_key", "ascending"), ("near_end_day", "ascending")])
        users, days = right["near_user_key"].to_pylist(), right["near_end_day"].to_pylist()
        where: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(users, days)):
            where.setdefault(key, []).append(i)
        shard = _matrix(right["near_features"], right.num_rows)
        queries = _matrix(left["features"], left.num_rows)
        own = list(zip(left["user_key"].to_pylist(), left["end_day"].to_pylist()))
        asked, found, points = [], [], []
        for begin in range(0, len(own), STRIPE):
            scores = _products(queries[begin : begin + STRIPE], shard)
            for i, row in enumerate(scores):
                allowed = np.ones(len(users), dtype=bool)
                allowed[where.get(own[begin + i], [])] = False
                best = _best(row, np.flatnonzero(allowed), k)
                asked.append(np.full(len(best), begin + i))
                found.append(best)
                points.append(row[best])
        asked, found = np.concatenate(asked), np.concatenate(found)
        return pa.table(
            [
                left["user_key"].take(pa.array(asked)), left["end_day"].take(pa.array(asked)),
                left["shard"].take(pa.array(asked)),
                right["near_user_key"].take(pa.array(found)), right["near_end_day"].take(pa.array(found)),
                pa.array(np.concatenate(points), pa.int64()),
            ],
            names=schema.names,
        ).cast(schema)

    return search


def _dealt(df: DataFrame, name: str, other: str, parts: int, others: int, prefix: str = "") -> DataFrame:
    """Each vector in one part by the hash of its key, and once beside every part of the other side."""
    part = F.pmod(F.xxhash64("user_key", "end_day", F.lit(name)), F.lit(parts)).cast("int")
    return df.select(
        *[F.col(c).alias(prefix + c) for c in ("user_key", "end_day", "features")],
        F.size("features").alias("width"), part.alias(name),
        F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other),
    )


def nearest_windows(
    queries: DataFrame, windows: DataFrame, k: int = 5, shard: int = SHARD, block: int = QUERY_BLOCK
) -> DataFrame:
    """The k windows with the highest inner product for each query, exactly.

    Both sides have `user_key`, `end_day` and `features`, an array of integers; a window is not
    compared with the one of its own key. Returns user_key, end_day, rank (from 1),
    near_user_key, near_end_day, score; ties go to the smaller key, and a query that meets fewer
    than k windows has them all.

    Queries are dealt into blocks and windows into shards by the hash of their keys, so tiles
    are of even size whatever the data. A tile is one matrix product with a partial selection
    per query; the lists of `FAN` shards at a time are merged until one is left. Vectors that
    are null or hold a null take no part, nor do rows without a whole key; vectors of different
    length are not compared; scores beyond a long are held at its ends; repeated windows count as
    often as they occur, repeated queries once; other columns are ignored; empty tables give no rows.
    """
    whole: Column = F.col("features").isNotNull() & F.forall("features", lambda x: x.isNotNull())
    whole = whole & F.col("user_key").isNotNull() & F.col("end_day").isNotNull()
    queries = queries.where(whole).groupBy("user_key", "end_day").agg(F.min("features").alias("features"))
    windows = windows.where(whole)
    blocks, shards = max(1, -(-queries.count() // block)), max(1, -(-windows.count() // shard))
    kinds = {f.name: f.dataType for f in windows.schema.fields}
    out = T.StructType(
        [
            T.StructField("user_key", kinds["user_key"]), T.StructField("end_day", kinds["end_day"]),
            T.StructField("shard", T.IntegerType()),
            T.StructField("near_user_key", kinds["user_key"]), T.StructField("near_end_day", kinds["end_day"]),
            T.StructField("score", T.LongType()),
        ]
    )
    tile = ("width", "block", "shard")
    left = _dealt(queries, "block", "shard", blocks, shards).groupBy(*tile)
    right = _dealt(windows, "shard", "block", shards, blocks, "near_").groupBy(*tile)
    found = left.cogroup(right).applyInArrow(_tile(k, to_arrow_schema(out)), out)
    order = [F.desc("score"), F.asc("near_user_key"), F.asc("near_end_day")]
    while True:
        node = Window.partitionBy("user_key", "end_day", "shard").orderBy(*order)
        shards = -(-shards // FAN)
        found = found.withColumn("shard", F.floor(F.col("shard") / FAN).cast("int"))
        found = found.withColumn("rank", F.row_number().over(node)).where(F.col("rank") <= k)
        if shards == 1:
            return found.drop("shard").select("user_key", "end_day", "rank", "near_user_key", "near_end_day", "score")
        found = found.drop("rank")
