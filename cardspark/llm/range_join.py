"""Exact metric range join of embeddings over pivot cells.

Equal vectors are first drawn together.  The angle between vectors is a metric: each vector has its
home in the cell of the nearest pivot, and by the triangle inequality a vector within angle r of it
can lie in another cell's home only if its angle to that cell's pivot exceeds its angle to its own
by at most 2 r, and only if its angle to the plane between both pivots is at most r.  So each vector
is also sent to the lower-numbered cells within these bounds, and every pair is met in the lower of
its two home cells and nowhere else.  Vectors of different lengths have cells of their own.  A cell's homes are cut into
blocks; each block is one unit of work that later blocks and visitors stream past, and long streams are cut
as well, so neither a crowded cell nor a crowd of visitors gathers in one task.  Where pivots hardly
prune there are fewer of them, and blocks grow with the input up to a size in bytes, so that a vector
travels about as often at any size; what a task holds or passes on at once is bounded in bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardspark.llm.common import checkpointed, shuffle_partitions
from cardspark.llm.components import components

#: Home vectors in a block, streamed vectors in a unit of work, vectors wanted in a cell; pivots of all lengths together.
BLOCK_ROWS, STREAM_ROWS, CELL_ROWS, MOST_PIVOTS = 4096, 65536, 4096, 1024
#: Blocks and streams of this part of all vectors, if that is more; bytes that a block holds at most; copies of a vector
#: beyond which there are fewer pivots, and vectors that these copies are counted on.
BLOCK_SHARE, STREAM_SHARE, BLOCK_BYTES, MOST_COPIES, PROBED = 8, 4, 32 << 20, 8, 512
#: Copies that are on the way at once: this many bytes, or so many times those of all vectors.
PASS_BYTES, PASS_SHARE = 256 << 20, 3
#: Streamed vectors and vectors of a block compared at once; bytes of distances to pivots, or of placed vectors, at once.
STEP_ROWS, TILE_ROWS, PLACE_BYTES = 1024, 2048, 8 << 20
SLACK = 1e-9
#: Cells whose lines are broadcast; more meet their vectors by a shuffle.
BROADCAST_CELLS = 16_384


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def unit(vectors: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares of very large or small components stay in range.
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


class Block:
    """A block of home vectors that others stream past."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, vectors: np.ndarray, least: float):
        self.ids, self.n, self.vectors, self.least = ids, n, vectors, least
        self.short = vectors.astype(np.float32)
        # What products of unit vectors lose at most in single precision.
        self.short_least = np.float32(least - (vectors.shape[1] + 8) * 1.2e-7)
        self.root = np.arange(len(ids))
        self.links = np.zeros(len(ids), np.int64)

    def within(self) -> Iterator[list[tuple[int, int, int]]]:
        """Links within the block."""
        for a in range(0, len(self.ids), STEP_ROWS):
            yield self.meet(self.ids[a : a + STEP_ROWS], self.n[a : a + STEP_ROWS], self.vectors[a : a + STEP_ROWS], own=a)

    def meet(self, ids: np.ndarray, n: np.ndarray, vectors: np.ndarray, own: int | None = None) -> list[tuple[int, int, int]]:
        """Links of the streamed vectors: (id, number of vectors linked, an id of the block that it links to).

        ``own`` is where they stand in the block itself; then each pair is met once.
        """
        short, last = vectors.astype(np.float32), len(self.ids) if own is None else own + len(ids)
        found, first = np.zeros(len(ids), np.int64), np.full(len(ids), len(self.ids))
        for at in range(0, last, TILE_ROWS):
            i, j = self._near(at, min(at + TILE_ROWS, last), vectors, short)
            if own is not None:
                once = i < own + j
                i, j = i[once], j[once]
            if not len(i):
                continue
            self.links += np.bincount(i, weights=n[j], minlength=len(self.ids)).astype(np.int64)
            found += np.bincount(j, weights=self.n[i], minlength=len(ids)).astype(np.int64)
            np.minimum.at(first, j, i)
            a, b = self.root[i], self.root[first[j]]
            for x, y in zip(*np.divmod(np.unique((a * len(self.ids) + b)[a != b]), len(self.ids))):
                while x != self.root[x]:
                    x = int(self.root[x])
                while y != self.root[y]:
                    y = int(self.root[y])
                self.root[max(x, y)] = min(x, y)
            while (self.root != self.root[self.root]).any():
                self.root = self.root[self.root]
        return [(int(ids[k]), int(found[k]), int(self.ids[first[k]])) for k in np.flatnonzero(first < len(self.ids))]

    def _near(self, start: int, stop: int, vectors: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a tile with the streamed vectors: sought in single precision, decided in double."""
        likely = self.short[start:stop] @ short.T >= self.short_least
        rows, columns = np.flatnonzero(likely.any(axis=1)), np.flatnonzero(likely.any(axis=0))
        i, j = np.nonzero(self.vectors[start + rows] @ vectors[columns].T >= self.least)
        return start + rows[i], columns[j]

    def rest(self) -> list[tuple[int, int, int]]:
        hit = np.flatnonzero((self.links > 0) | (self.root != np.arange(len(self.ids))))
        return [(int(self.ids[k]), int(self.links[k]), int(self.ids[self.root[k]])) for k in hit]


def _usable(vector: str) -> str:
    return f"{vector} IS NOT NULL AND forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists({vector}, x -> x <> 0)"


def linked_vectors(df: DataFrame, cosine: float, vector: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """Links all pairs of vectors whose cosine, in double precision, is at least ``cosine``.

    Returns one row per vector: ``vec_id``, ``n_links`` (other rows linked directly),
    ``component_id`` (smallest id reachable by links, itself included) and ``kept`` (whether that is
    its own).  Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, and vectors of different lengths never link.  Equal vectors and repeated rows link with
    each other; ids are expected to be non-null, and a null id has null ``component_id`` and ``kept``.
    Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    # Components in single precision, as embeddings mostly are, travel as they are.
    kind = "array<float>" if df.select(vector).schema[0].dataType.simpleString() == "array<float>" else "array<double>"
    rows = df.select(df[id_column].cast("long").alias("vec_id"), df[vector].cast(kind).alias("__vector"))
    usable = rows.where(_usable("__vector")).where("vec_id IS NOT NULL")
    # Equal vectors go on as one, under their smallest id.
    equal = checkpointed(usable.groupBy(F.col("__vector").alias("v")).agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n")))
    found = checkpointed(_links(equal, cosine))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    whole = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    groups = checkpointed(
        equal.join(links, "id", "left").join(whole.withColumnRenamed("node", "id"), "id", "left")
        .select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    # Both sides come straight from their exchange, so adaptive execution can split a crowded vector.
    joined = rows.join(groups, rows["__vector"] == groups["v"], "left")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _pivots(vectors: DataFrame, total: int, angle: float) -> dict[int, np.ndarray]:
    """Pivots by length of vectors, ``MOST_PIVOTS`` or so altogether.

    A length that has few vectors, or a small share of them, has none: its vectors share one cell.  Where
    vectors would mostly visit more than ``MOST_COPIES`` cells, pivots don't part them, and there are fewer.
    """
    least = max(CELL_ROWS + 1, -(-total // MOST_PIVOTS))
    sizes = vectors.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).collect()  # at most MOST_PIVOTS
    out = {}
    for r in sizes:
        n = max(1, min(-(-r["n"] // CELL_ROWS), MOST_PIVOTS * r["n"] // total))
        # Those with the smallest hashes of their ids; the next ones show how often vectors are copied.
        chosen = vectors.where(F.size("v") == r["d"]).orderBy(F.xxhash64("id"), "id").limit(n + PROBED).collect()
        chosen = unit(np.array([x["v"] for x in chosen], dtype=np.float64))
        while n > 1 and len(_cells(chosen[n:], chosen[:n], _gaps(chosen[:n]), angle)[0]) > MOST_COPIES * len(chosen[n:]):
            n = -(-n // 2)
        out[r["d"]] = chosen[:n]
    return out


def _gaps(pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (pivots @ pivots.T)))


def _cells(own: np.ndarray, pivots: np.ndarray | None, gaps: np.ndarray | None, angle: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and cell of each copy of the vectors of one length, and each row's home."""
    if pivots is None:
        none = np.zeros(len(own), dtype=np.intp)
        return np.arange(len(own)), none, none
    near = own @ pivots.T
    home, rows = near.argmax(axis=1), np.arange(len(own))
    away = np.arccos(np.clip(near, -1.0, 1.0))
    fine = away <= away[rows, home][:, None] + 2 * angle + SLACK
    if angle < math.pi / 2:
        fine &= near[rows, home][:, None] - near <= math.sin(angle) * gaps[home] + SLACK
    fine &= np.arange(len(pivots))[None, :] < home[:, None]
    fine[rows, home] = True
    return *np.nonzero(fine), home


def _placed(batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray], gaps: dict[int, np.ndarray], angle: float, kind: str) -> Iterator[pa.RecordBatch]:
    """The copies of all vectors with their cells, about ``PLACE_BYTES`` at once however many copies there are."""
    for batch in batches:
        lengths = pa.compute.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
        for d in np.unique(lengths).tolist():
            whole = batch.filter(pa.array(lengths == d))
            rows = max(1, PLACE_BYTES // (8 * max(d, len(pivots.get(d, ())))))
            for part in (whole.slice(a, rows) for a in range(0, whole.num_rows, rows)):
                values = matrix(part.column("v"))
                k, cell, home = _cells(unit(values), pivots.get(d), gaps.get(d), angle)
                data = pa.array([x.tobytes() for x in values.astype(kind)], pa.binary())
                copies = max(1, PLACE_BYTES // (8 * d + 64))
                for a in range(0, len(k), copies):
                    own, at = k[a : a + copies], cell[a : a + copies]
                    take = pa.array(own)
                    columns = [pa.array(np.full(len(own), d, dtype=np.int32)), pa.array(at.astype(np.int32)), pa.array(home[own] == at)]
                    yield pa.RecordBatch.from_arrays([*columns, part.column("id").take(take), part.column("n").take(take), data.take(take)], names=["size", "cell", "home", "id", "n", "vector"])


def _links(vectors: DataFrame, cosine: float) -> DataFrame:
    """(id, links, other): links found and spanning links."""
    spark, total = vectors.sparkSession, vectors.count()
    angle = math.acos(max(-1.0, min(1.0, cosine)))
    pivots = _pivots(vectors, total, angle)
    shared = spark.sparkContext.broadcast((pivots, {d: _gaps(p) for d, p in pivots.items()}))  # bounded by MOST_PIVOTS
    kind = "<f4" if vectors.schema["v"].dataType.simpleString() == "array<float>" else "<f8"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _placed(batches, *shared.value, angle, kind)

    placed = vectors.select("id", "n", "v").mapInArrow(place, "size int, cell int, home boolean, id long, n long, vector binary")
    block_rows = F.greatest(F.lit(1), F.least(F.lit(max(BLOCK_ROWS, total // BLOCK_SHARE)), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("size")))))
    stream_rows = max(STREAM_ROWS, total // STREAM_SHARE)
    homes, visitors = F.count(F.when(F.col("home"), 1)), F.count(F.lit(1))
    lines = placed.groupBy("size", "cell").agg(homes.alias("h"), visitors.alias("all")).where("h > 0")
    lines = checkpointed(lines.select("size", "cell", "h", "all", F.ceil(F.col("h") / block_rows).cast("int").alias("blocks"), F.ceil(F.col("all") / stream_rows).cast("int").alias("streams")))
    width = F.col("size") * int(kind[-1]) + 64
    copies = F.col("h") * (F.col("streams") + (F.col("blocks") - 1) / 2) + (F.col("all") - F.col("h")) * F.col("blocks")
    known = lines.agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(x), F.lit(0)).alias(c) for c, x in (("units", F.col("blocks") * F.col("streams")), ("whole", F.col("h") * width), ("sent", copies * width)))).first()
    passes = max(1, math.ceil(known["sent"] / max(PASS_BYTES, PASS_SHARE * known["whole"])))
    lines = lines.select("size", "cell", "blocks", "streams")
    lines = F.broadcast(lines) if known["n"] <= BROADCAST_CELLS else lines
    dealt = placed.join(lines, ["size", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("stream", F.pmod(F.xxhash64("id", F.lit(1)), F.col("streams")).cast("int"))
    # A home vector is held by every stream of its block, and streams past the blocks before its own; a visitor streams past all blocks.
    held = F.expr("if(home, transform(sequence(0, streams - 1), s -> struct(block, s AS stream, 0 AS kind)), array())")
    passing = F.expr("if(if(home, block, blocks) > 0, transform(sequence(0, if(home, block, blocks) - 1), b -> struct(b AS block, stream, 1 AS kind)), array())")
    work = dealt.select("size", "cell", "id", "n", "vector", F.explode(F.concat(held, passing)).alias("x")).select("size", "cell", "x.block", "x.stream", "x.kind", "id", "n", "vector")
    keys = ["size", "cell", "block", "stream"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _met(batches, cosine, kind):
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=["id", "links", "other"])

    def met(part: DataFrame) -> DataFrame:
        part = part.repartition(max(1, min(2 * known["units"], 4 * shuffle_partitions(spark))), *keys).sortWithinPartitions(*keys, "kind", "id")
        return part.mapInArrow(meet, "id long, links long, other long")

    if passes == 1:
        return met(work)
    # Some units of work at a time, so that the copies on the way grow no faster than the vectors.
    turn = F.pmod(F.xxhash64(*keys), F.lit(passes))
    found = [checkpointed(met(work.where(turn == k))) for k in range(passes)]
    return reduce(DataFrame.unionByName, found)


def _met(batches: Iterator[pa.RecordBatch], cosine: float, kind: str = "<f8") -> Iterator[list[tuple[int, int, int]]]:
    """Reads sorted units of work, each a block's home vectors and then those that stream past."""
    key, waiting, block = None, [], None

    def opened() -> Iterator[list[tuple[int, int, int]]]:
        nonlocal waiting, block
        block, waiting = Block(*(np.concatenate(x) for x in zip(*waiting)), cosine), []
        if key[3] == 0:  # pairs within the block belong to its first stream
            yield from block.within()

    def closed() -> Iterator[list[tuple[int, int, int]]]:
        nonlocal block
        if waiting:
            yield from opened()
        if block is not None:
            yield block.rest()
        block = None

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("size", "cell", "block", "stream", "kind")])
        bounds = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(bounds, bounds[1:]):
            if tuple(keys[:4, a].tolist()) != key:
                yield from closed()
                key = tuple(keys[:4, a].tolist())
            part = batch.slice(a, b - a)
            ids, n = (part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "n"))
            vectors = unit(np.frombuffer(b"".join(part.column("vector").to_pylist()), kind).astype(np.float64).reshape(b - a, key[0]))
            if keys[4, a] == 0:
                waiting.append((ids, n, vectors))
                continue
            if waiting:
                yield from opened()
            if block is not None:  # else no home vector fell into this block
                for s in range(0, b - a, STEP_ROWS):
                    yield block.meet(ids[s : s + STEP_ROWS], n[s : s + STEP_ROWS], vectors[s : s + STEP_ROWS])
    yield from closed()
