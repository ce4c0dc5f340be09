"""Exact top-k search by tiled matrix products.

Vectors are packed into shards of rows, queries into tiles.  Every tile meets every shard once,
in a task chosen by tile and shard group, so neither side is sent whole to any task.  A task takes
each tile's best from each product, merges them as it goes, and hands on one short list for each
query; Spark merges those lists, each map task pruning its own before the exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardspark.llm.common import shuffle_partitions

SHARD_ROWS, TILE_ROWS, SHARDS_PER_GROUP = 2048, 1024, 16
LONG = 2**63


def quantised(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and integer matrices (as doubles) of the usable rows, by dimension."""
    column, ids = batch.column("__vector"), batch.column("__id").to_numpy(zero_copy_only=False)
    lengths = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), -1))
    for size in np.unique(lengths[lengths > 0]):
        own = np.flatnonzero(lengths == size)
        flat = column.take(pa.array(own)).flatten().cast(pa.float64())
        matrix = np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(own), size)  # nulls become NaN
        fine = np.isfinite(matrix).all(axis=1)
        yield ids[own][fine], np.floor(matrix[fine] * scale)


def packed(df: DataFrame, scale: int, rows: int) -> DataFrame:
    """Matrices of up to ``rows`` rows: size of a vector, ids and values as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}

        def out(size: int, ids: np.ndarray, matrix: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([matrix.astype("<f8").tobytes()], pa.binary())], names=["size", "ids", "matrix"])

        for batch in batches:
            for ids, matrix in quantised(batch, scale):
                size = matrix.shape[1]
                old = waiting.pop(size, None)
                if old:
                    ids, matrix = np.concatenate([old[0], ids]), np.concatenate([old[1], matrix])
                while len(ids) >= rows:
                    yield out(size, ids[:rows], matrix[:rows])
                    ids, matrix = ids[rows:], matrix[rows:]
                if len(ids):
                    waiting[size] = [ids, matrix]
        for size, (ids, matrix) in waiting.items():
            yield out(size, ids, matrix)

    return df.mapInArrow(run, "size int, ids binary, matrix binary")


def scores(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Exact integer inner products; beyond the range of long they stop at its ends."""
    bound = np.abs(queries).max(initial=0) * np.abs(shard).max(initial=0) * queries.shape[1]
    if bound < 2**53:  # every partial sum is exact as a double
        return queries @ shard.T
    exact = np.array([[int(x) for x in row] for row in queries], dtype=object) @ np.array([[int(x) for x in row] for row in shard], dtype=object).T
    return np.vectorize(lambda x: max(-LONG, min(LONG - 1, x)), otypes=[object])(exact)


def best(query_ids: np.ndarray, product: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's ``k`` best (row, id, score), ties to smaller ids; a query's own id is left out."""
    score = product.copy()
    allowed = query_ids[:, None] != ids[None, :]
    if score.dtype != object and score.shape[1] > k + 1:
        low = np.where(allowed, score, -np.inf)
        least = np.partition(low, -k, axis=1)[:, -k]
        allowed &= low >= least[:, None]
    row, column = np.nonzero(allowed)
    return ordered(row, ids[column], score[row, column], k)


def ordered(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -score, row)) if score.dtype != object else np.array(sorted(range(len(row)), key=lambda i: (row[i], -score[i], ids[i])), dtype=np.intp)
    row, ids, score = row[order], ids[order], score[order]
    first = np.searchsorted(row, row)
    fine = np.arange(len(row)) - first < k
    return row[fine], ids[fine], score[fine]


def top_k(df: DataFrame, k: int, every: int, vector: str = "embedding", id_column: str = "vec_id", scale: int = 256) -> DataFrame:
    """The ``k`` candidates with the highest integer inner product for each query.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but those with
    the query's own id.  Components become floor(scale * x).  Returns ``query_id``, ``rank`` (from 1),
    ``vec_id`` and ``score``; ties go to the smaller id.  Rows whose id or vector is null, or whose
    vector is empty or holds null or non-finite components, take no part; vectors are compared only
    with those of their own length.  Repeated rows are candidates of their own, and a repeated query
    gets one list.  Scores beyond a long stop at its ends.  An empty table gives an empty result.
    """
    spark = df.sparkSession
    rows = df.select(df[id_column].cast("long").alias("__id"), df[vector].alias("__vector")).where("__id IS NOT NULL AND __vector IS NOT NULL")
    asked = rows.where(F.col("__id") % every == 0).dropDuplicates(["__id"])
    n, n_asked = rows.count(), rows.where(F.col("__id") % every == 0).count()
    tiles, groups = max(1, -(-n_asked // TILE_ROWS)), max(1, -(-n // (SHARD_ROWS * SHARDS_PER_GROUP)))
    asked = packed(asked.repartition(tiles, "__id"), scale, TILE_ROWS).withColumnRenamed("ids", "query_ids").withColumnRenamed("matrix", "queries")
    asked = asked.withColumn("tile", F.xxhash64("query_ids")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    shards = packed(rows, scale, SHARD_ROWS).withColumn("group", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"))
    # A group of shards meets every tile; groups and tiles are dealt out together.
    parts = max(1, min(groups * tiles, 4 * shuffle_partitions(spark)))
    slots = max(1, min(tiles, parts))
    asked = asked.withColumn("slot", F.pmod("tile", F.lit(slots)).cast("int"))
    shards = shards.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    met = asked.hint("shuffle_hash").join(shards, ["size", "group", "slot"]).select("tile", "query_ids", "queries", "ids", "matrix", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[int, tuple] = {}
        for batch in batches:
            for r in batch.to_pylist():
                asked_ids, ids = np.frombuffer(r["query_ids"], "<i8"), np.frombuffer(r["ids"], "<i8")
                tile = np.frombuffer(r["queries"], "<f8").reshape(len(asked_ids), r["size"])
                found = best(asked_ids, scores(tile, np.frombuffer(r["matrix"], "<f8").reshape(len(ids), r["size"])), ids, k)
                if old := lists.get(r["tile"]):
                    found = ordered(*(np.concatenate([a, b]) for a, b in zip(old[1], found)), k)
                lists[r["tile"]] = (asked_ids, found)
        for asked_ids, (row, ids, score) in lists.values():
            yield pa.RecordBatch.from_arrays([pa.array(asked_ids[row], pa.int64()), pa.array(ids, pa.int64()), pa.array([int(s) for s in score], pa.int64())], names=["query_id", "vec_id", "score"])

    lists = met.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
