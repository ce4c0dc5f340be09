"""Packing of tokenised documents into windows: best-fit decreasing.

Documents longer than a window are first cut into full windows; what is left of each document is
an item.  Items of one length are alike, so best fit needs only the number of items of each
length, at most one number per possible length.  The fit is worked out over those numbers: groups
of equal windows, found through a segment tree indexed by remaining capacity, take items in
decreasing length.  The resulting plan has a bounded number of lines whatever the number of
documents, each saying which items of a length, by rank, go to which windows.  Ranks are dealt out
in two steps, within each task and by running totals over tasks, so no length gathers in one task.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardspark.llm import bpe
from cardspark.llm.common import checkpointed, slices
from cardspark.llm.word_tokens import MEMO_WORDS, SLICE_BYTES, tokenizer, tokenizer_key


class CapacityTree:
    """Segment tree over remaining capacities: how many window groups have each."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        k = capacity + self.leaves
        while k:
            self.count[k] += n
            k //= 2

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that some group has."""
        k = least + self.leaves
        if self.count[k]:
            return least
        while k > 1 and (k & 1 or not self.count[k + 1]):
            k //= 2
        if k <= 1:
            return None
        k += 1
        while k < self.leaves:
            k = 2 * k if self.count[2 * k] else 2 * k + 1
        return k - self.leaves


def best_fit_decreasing(counts: dict[int, int], window: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Plan for ``counts[length]`` items of each length, and the number of windows used.

    A line (length, first_rank, n, first_window, offset, per_window) places the items of that length
    with ranks first_rank ... first_rank + n - 1: ``per_window`` next to each other from ``offset`` on
    in each of the windows from ``first_window`` on.
    """
    tree = CapacityTree(window)
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # remaining -> groups (first window, number)
    plan, used = [], 0

    def put(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            open_[capacity].append((first, n))
            tree.add(capacity, 1)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, per = window, window // length
                n = -(-left // per)
                first, used = used, used + n
            else:
                first, n = open_[capacity].pop()
                tree.add(capacity, -1)
                per = capacity // length
            # In order, each window is filled with this length as far as it goes: it stays the tightest.
            taken = min(left, n * per)
            plan.append((length, rank, taken, first, window - capacity, per))
            full, over = divmod(taken, per)
            put(capacity - per * length, first, full)
            if over:
                put(capacity - over * length, first + full, 1)
            if capacity < window or full + bool(over) < n:
                put(capacity, first + full + bool(over), n - full - bool(over))
            rank, left = rank + taken, left - taken
    return plan, used


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, __task long, __rank long, __whole boolean"


def pieces(df: DataFrame, tokenizer_file: str, end_id: int, window: int, text: str, keep: tuple[str, ...], memo_words: int, slice_bytes: int) -> DataFrame:
    """Each document's full windows and what is left, ranked by length within the task."""
    ranges = bpe.classes()
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [PIECES])
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, task, ranks = tokenizer(tokenizer_file, ranges, decoding=False), TaskContext.get().partitionId(), Counter()
        tok.memo_words, tok.encoder.most_steps = memo_words, 2 * memo_words
        for batch in slices(batches, "__text", slice_bytes, tokenizer_key(tokenizer_file, decoding=False)):
            rows, out = [], []
            for k, entries in enumerate(tok.entries(batch.column("__text").to_pylist())):
                raw = b"".join(entries) + end
                total = len(raw) // 4
                for start in range(0, total, window):
                    length = min(window, total - start)
                    part = raw if length == total else raw[4 * start : 4 * (start + length)]
                    rows.append(k)
                    out.append((start, length, zlib.crc32(part), total, task, ranks[length], length == window))
                    ranks[length] += 1
            kept = batch.select(list(keep)).take(pa.array(rows, pa.int64())) if keep else None
            made = [pa.array(x, t) for x, t in zip(zip(*out), [pa.int64()] * 6 + [pa.bool_()])]
            yield pa.RecordBatch.from_arrays([*(kept.columns if kept else []), *made], names=[*keep, *(x.split()[0] for x in PIECES.split(", "))])

    return df.select(*keep, df[text].cast("string").alias("__text")).mapInArrow(run, schema)


def pack(df: DataFrame, tokenizer_file: str, end_id: int = 2, window: int = 4096, text: str = "text", keep: tuple[str, ...] = ("doc_id",), memo_words: int = MEMO_WORDS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Packs documents, each followed by ``end_id``, into sequences of at most ``window`` tokens.

    Returns per piece the columns ``keep`` and ``start`` (the document's ids before it), ``length``,
    ``ids_crc32`` (of the ids as little-endian unsigned 32-bit integers), ``doc_tokens``,
    ``sequence_id`` and ``offset`` in the sequence; offsets leave no gaps.  Null and empty texts are
    documents of the end id alone.  ``memo_words`` and ``slice_bytes`` bound a worker's memory and change
    nothing else.  Repeated rows are documents of their own.  Other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    # What the tasks found is held fast: ranks and plan must speak of the same rows.
    found = checkpointed(pieces(df, tokenizer_file, end_id, window, text, keep, memo_words, slice_bytes))
    per_task = found.groupBy("__task", "length").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("length").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    per_task = per_task.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    # One number for each length from 1 to the window: bounded.
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    whole = counts.pop(window, 0)
    plan, used = best_fit_decreasing(counts, window)
    if whole:
        plan.append((window, 0, whole, used, 0, 1))
    by_length: dict[int, tuple[np.ndarray, ...]] = {}
    lines = defaultdict(list)
    for length, *line in plan:
        lines[length].append(line)
    for length, own in lines.items():
        by_length[length] = tuple(np.array(x, dtype=np.int64) for x in zip(*own))
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(by_length)  # bounded by the window, not by the documents
    ranked = found.join(per_task.select("__task", "length", "__before"), ["__task", "length"])
    ranked = ranked.select(*keep, "start", "length", "ids_crc32", "doc_tokens", (F.col("__rank") + F.col("__before")).alias("__rank"))
    schema = ", ".join([f"`{c}` {ranked.schema[c].dataType.simpleString()}" for c in (*keep, "start", "length", "ids_crc32", "doc_tokens")] + ["sequence_id long", "offset long"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("__rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for size in np.unique(length):
                own = length == size
                first_rank, _, first_window, base, per = where[int(size)]
                line = np.searchsorted(first_rank, rank[own], side="right") - 1
                at = rank[own] - first_rank[line]
                sequence[own] = first_window[line] + at // per[line]
                offset[own] = base[line] + at % per[line] * size
            columns = [c for name, c in zip(batch.schema.names, batch.columns) if name != "__rank"]
            names = [name for name in batch.schema.names if name != "__rank"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)
