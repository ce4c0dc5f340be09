"""N-gram Jaccard join by signature trees.

A document is the set of its distinct word shingles; equal sets go on as one, under a hash of the set.

1. Two sets that are similar enough share a shingle among the first of each, in any order that all
   sets agree on.  A first pass counts, within a bound in each task, the shingles that come first in
   hash order; those that very many sets share are put last in the order.  A second pass deals out
   each set's first shingles by their hashes.  Where a shingle still turns out to be crowded, it is
   put last as well and the sets that had it among their first are dealt out again.
2. Sets that meet at a shingle form a bundle around the one with the smallest hash; a set goes to a
   bundle once, however many shingles it shares.  What stands before the shingle in a set bounds how
   much it can share with another: sets without a possible partner at a shingle are left out there.
3. In a bundle the sets' token bitmaps are the leaves of a signature tree whose nodes hold the
   OR of their bitmaps and the range of sizes.  A dual traversal drops pairs of nodes whose largest possible
   overlap is too small.  Sets without any partner left drop out.
   Pairs that share a smaller bundle are left to it.  Large bundles have trees of their chunks first, and
   what finds no partner in its chunk meets the trees of the others.  Sets that share a shingle by chance
   grow with the square of the input, so bitmaps travel to some of the bundles at a time.
4. The texts of the rest come to their bundles, and pairs that the tree left are compared exactly, but
   for pairs that are connected already.  Large bundles are worked on in chunks, each with the
   bundle's first set; only what no chunk connects to that set is compared across chunks, again but
   for pairs that are connected already.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardspark.llm.common import checkpointed, shuffle_partitions, slices, tidy
from cardspark.llm.components import components
from cardspark.llm.shingles import WORDS, set_hash, shingle_sets

#: Children of a tree node; sets in one unit of exact comparison; sets in a bundle that the tree is built for as one.
FANOUT, CHUNK, TREE_SETS = 16, 512, 2048
#: Bitmaps that travel to their bundles at once: this many bytes, or so many times those of all sets.
SLICE_BYTES, SLICE_SHARE = 256 << 20, 4
#: A shingle is common if more than a certain share of all sets have it: 1/1024 where that lies between these numbers
#: of sets, so that as large a part of the sets is dealt out again at any size, and at least 1/16384, which bounds how
#: many shingles can be common.
COMMON_SETS, MOST_COMMON_SETS, COMMON_SHARE = 64, 1024, 1 / 16384
#: Ids that are broadcast at most (8 bytes each).
BROADCAST_IDS = 1_000_000
#: How often common shingles are put last before cells are taken as they are.
ROUNDS = 3
#: A task counts shingles that at least 1 / LOCAL_SHARE of its sets show; shingles held before they are summed up.
LOCAL_SHARE, HELD_SHINGLES = 2048, 1 << 19
#: Set hashes or labels that a task remembers; past that it forgets them all, which costs repeated rows only.
REMEMBERED = 1 << 19
#: Rows of a shingle that are held at least before they are passed on as they come, and bits of a place in a set.
CELL_ROWS, PLACE_BITS = 1 << 19, 7


def least_overlap(total: np.ndarray, percent: int) -> np.ndarray:
    """Overlap that two sets with ``total`` members together need at least."""
    return -(-percent * total // (100 + percent))


def first_count(n: int, percent: int) -> int:
    """How many of its first shingles a set must show so that no similar set is missed."""
    return n - -(-percent * n // 100) + 1


def bitmap(shingles: np.ndarray) -> bytes:
    """Bits of the shingles' low ends; two to four times as many bits as shingles, 64 at least."""
    bits = max(64, 1 << int(2 * len(shingles) - 1).bit_length())
    flags = np.zeros(bits, dtype=np.uint8)
    flags[(shingles & np.uint64(bits - 1)).astype(np.intp)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def narrowed(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps folded to fewer words, as if made with fewer bits."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


class Node:
    """Sets a ... b of a size order: OR of their bitmaps, range of sizes, and most shingles that share a bit."""

    def __init__(self, bits: np.ndarray, low: int, high: int, spare: int, children: list, rows: np.ndarray | None = None):
        self.bits, self.low, self.high, self.spare, self.children, self.rows = bits, low, high, spare, children, rows


class SignatureTree:
    """Tree over the sets of a bundle."""

    def __init__(self, sizes: np.ndarray, bitmaps: list[bytes]):
        self.sizes = sizes
        words = np.array([len(b) // 8 for b in bitmaps])
        self.bits: dict[int, np.ndarray] = {}
        self.place = np.zeros(len(sizes), dtype=np.intp)
        self.ones = np.zeros(len(sizes), dtype=np.int64)
        nodes = []
        for w in np.unique(words):
            own = np.flatnonzero(words == w)
            own = own[np.argsort(sizes[own], kind="stable")]
            table = self.bits[int(w)] = np.frombuffer(b"".join([bitmaps[k] for k in own]), dtype="<u8").reshape(len(own), w)
            self.place[own] = np.arange(len(own))
            self.ones[own] = np.bitwise_count(table).sum(axis=1, dtype=np.int64)
            for a in range(0, len(own), FANOUT):
                rows = own[a : a + FANOUT]
                nodes.append(self._leaf(rows, table[a : a + FANOUT]))
        while len(nodes) > FANOUT:
            nodes = [self._above(nodes[a : a + FANOUT]) for a in range(0, len(nodes), FANOUT)]
        self.roots = nodes

    def _leaf(self, rows: np.ndarray, table: np.ndarray) -> Node:
        return Node(np.bitwise_or.reduce(table, axis=0)[None, :], int(self.sizes[rows].min()), int(self.sizes[rows].max()), int((self.sizes[rows] - self.ones[rows]).max()), [], rows)

    def _above(self, nodes: list[Node]) -> Node:
        words = min(x.bits.shape[1] for x in nodes)
        bits = np.bitwise_or.reduce(np.concatenate([narrowed(x.bits, words) for x in nodes]), axis=0)[None, :]
        # Folding lets more shingles share a bit: count against the OR itself.
        folded = any(x.bits.shape[1] > words for x in nodes)
        spare = max(x.high for x in nodes) if folded else max(x.spare for x in nodes)
        return Node(bits, min(x.low for x in nodes), max(x.high for x in nodes), spare, nodes)

    def pairs(self, percent: int, other: SignatureTree | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of sets whose largest possible overlap is enough, within the tree or with the sets of another."""
        stack = [(a, b) for k, a in enumerate(self.roots) for b in (other.roots if other else self.roots[k:])]
        while stack:
            a, b = stack.pop()
            if a is not b and not self._possible(a, b, percent):
                continue
            if a.rows is not None and b.rows is not None:
                yield self._leaves(a, b, percent, other or self)
            elif a is b:
                stack += [(x, y) for k, x in enumerate(a.children) for y in a.children[k:]]
            elif a.rows is None and (b.rows is not None or a.high >= b.high):
                stack += [(x, b) for x in a.children]
            else:
                stack += [(a, x) for x in b.children]

    @staticmethod
    def _possible(a: Node, b: Node, percent: int) -> bool:
        if 100 * a.high < percent * b.low or 100 * b.high < percent * a.low:
            return False
        words = min(a.bits.shape[1], b.bits.shape[1])
        shared = int(np.bitwise_count(narrowed(a.bits, words) & narrowed(b.bits, words)).sum())
        # The side whose bitmap was not folded knows how many of its shingles may hide behind shared bits.
        spare = min(a.spare if a.bits.shape[1] == words else a.high, b.spare if b.bits.shape[1] == words else b.high)
        return shared + spare >= least_overlap(np.int64(a.low + b.low), percent)

    def _leaves(self, a: Node, b: Node, percent: int, other: SignatureTree) -> tuple[np.ndarray, np.ndarray]:
        words = min(a.bits.shape[1], b.bits.shape[1])
        x, y = (narrowed(own.bits[n.bits.shape[1]][own.place[n.rows]], words) for own, n in ((self, a), (other, b)))
        shared = np.bitwise_count(x[:, None, :] & y[None, :, :]).sum(axis=2, dtype=np.int64)
        hidden_x = self.sizes[a.rows] - np.bitwise_count(x).sum(axis=1, dtype=np.int64)
        hidden_y = other.sizes[b.rows] - np.bitwise_count(y).sum(axis=1, dtype=np.int64)
        most = shared + np.minimum(hidden_x[:, None], hidden_y[None, :])
        fine = most >= least_overlap(self.sizes[a.rows][:, None] + other.sizes[b.rows][None, :], percent)
        if a is b:
            fine = np.triu(fine, 1)
        i, j = np.nonzero(fine)
        return a.rows[i], b.rows[j]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """How many members two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = overlap(a, b)
    return 100 * shared >= percent * (len(a) + len(b) - shared)


class Joined:
    """Union-find over a unit's sets."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, a: int, b: int) -> None:
        self.up[max(a, b)] = min(a, b)


class Often:
    """Counts of the shingles that many of a task's sets show, within a bound; what is rare is forgotten."""

    def __init__(self):
        self.held: list[np.ndarray] = []
        self.size = self.sets = 0
        self.token, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, shingles: np.ndarray) -> None:
        self.held.append(shingles)
        self.size += len(shingles)
        self.sets += 1
        if self.size > HELD_SHINGLES:
            self.fold()

    def fold(self) -> None:
        new, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.held]), return_counts=True)
        both = np.concatenate((self.token, new))
        self.token, where = np.unique(both, return_inverse=True)
        self.count = np.bincount(where, weights=np.concatenate((self.count, n)), minlength=len(self.token)).astype(np.int64)
        kept = self.count >= max(2, self.sets // LOCAL_SHARE)
        self.token, self.count, self.held, self.size = self.token[kept], self.count[kept], [], 0


class Seen:
    """Set hashes met before, within a bound."""

    def __init__(self):
        self.keys: set[int] = set()

    def new(self, key: int) -> bool:
        if key in self.keys:
            return False
        if len(self.keys) >= REMEMBERED:
            self.keys.clear()
        self.keys.add(key)
        return True


def document_sets(df: DataFrame, percent: int, text: str, id_column: str) -> DataFrame:
    """Per row: id, number of shingles, set hash and bitmap (null where the task showed the set before).

    Each task adds a row with ``n`` -1: its frequent first shingles and their counts, packed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, often = Seen(), Often()
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        names = ["id", "n", "key", "bits", "counts"]
        for batch in slices(batches, "t"):
            n, key, bits = [], [], []
            named = batch.column("id").is_valid().to_pylist()
            for s, takes_part in zip(shingle_sets(batch.column("t").cast(pa.binary()).to_pylist()), named):
                k = set_hash(s)
                new = takes_part and len(s) > 0 and seen.new(k)
                n.append(len(s))
                key.append(k)
                bits.append(bitmap(s) if new else None)
                if new:
                    often.add(s[: first_count(len(s), percent)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, t) for x, t in zip((n, key, bits, [None] * len(n)), kinds[1:]))], names=names)
        often.fold()
        if len(often.token):
            last = ([None], [-1], [0], [often.token.tobytes()], [often.count.tobytes()])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(last, kinds)], names=names)

    return df.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("t")).mapInArrow(run, "id long, n long, key long, bits binary, counts binary")


def _often(sets: DataFrame, least: int) -> np.ndarray:
    """Shingles that the tasks together counted ``least`` times or more, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for token, count in zip(batch.column("bits").to_pylist(), batch.column("counts").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(token, "<i8")), pa.array(np.frombuffer(count, "<i8"))], names=["token", "c"])

    counted = sets.where("n = -1").select("bits", "counts").mapInArrow(run, "token long, c long").groupBy("token").agg(F.sum("c").alias("c")).where(F.col("c") >= least)
    # At most the shingles shown, divided by ``least``.
    return np.sort(np.array([r["token"] for r in counted.select("token").collect()], dtype=np.int64).view(np.uint64))


def is_common(shingles: np.ndarray, common: np.ndarray) -> np.ndarray:
    at = np.searchsorted(common, shingles)
    at[at == len(common)] = 0
    return common[at] == shingles if len(common) else np.zeros(len(shingles), dtype=bool)


def first_of(shingles: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """A set's first shingles where those in ``common`` come last."""
    late = is_common(shingles, common)
    return np.concatenate((shingles[~late], shingles[late]))[: first_count(len(shingles), percent)]


def _shown(df: DataFrame, percent: int, text: str, common: np.ndarray, before: np.ndarray | None = None) -> DataFrame:
    """(token, key, size) of each set's first shingles; ``size`` holds the set's size and, in its low bits, the shingle's place.

    With ``before``, only of the sets that had a shingle among their first that has become common since.
    """
    shared = df.sparkSession.sparkContext.broadcast((before, common))  # bounded: see COMMON_SHARE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (old, new), seen = shared.value, Seen()
        fresh = None if old is None else np.setdiff1d(new, old)
        for batch in slices(batches, "t"):
            token, key, size = [], [], []
            for s in shingle_sets(batch.column("t").cast(pa.binary()).to_pylist()):
                n = len(s)
                if n and (fresh is None or is_common(first_of(s, old, percent), fresh).any()):
                    k = set_hash(s)
                    if seen.new(k):
                        token.append(first_of(s, new, percent))
                        place = (np.arange(len(token[-1]), dtype=np.int64) << PLACE_BITS) // n
                        key.append(np.full(len(place), k, dtype=np.int64))
                        size.append(place + (n << PLACE_BITS))
            if token:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).view(np.int64)), pa.array(np.concatenate(key)), pa.array(np.concatenate(size))], names=["token", "key", "size"])

    return df.select(F.col(text).cast("string").alias("t")).where("t IS NOT NULL").mapInArrow(run, "token long, key long, size long")


def partnered(cell: np.ndarray, n: np.ndarray, rest: np.ndarray, percent: int) -> np.ndarray:
    """Which sets have another in their cell whose size allows for enough overlap.

    Cells are numbered upwards and sorted by ``n``; ``rest`` bounds how many shingles a set has from the
    cell's on, which is the most that it shares with a set that it shares none of the earlier ones with.
    """
    low, high = -(-percent * n // 100), np.minimum(rest * (100 + percent) // percent - n, 100 * n // percent)
    at = (cell << 32) + n
    others = np.searchsorted(at, (cell << 32) + high, side="right") - np.searchsorted(at, (cell << 32) + low) - (high >= n)
    return others > 0


def _bundles(shown: DataFrame, percent: int, most: int | None, parts: int, late: np.ndarray) -> DataFrame:
    """Sets that meet at a shingle: (pivot, member), and (null, token) for shingles that more than ``most`` sets share.

    Shingles in ``late`` stand last already: dealing their sets out again would show them again, so they are taken whole.
    Rows come sorted; what a task holds is bounded, as a shingle with more rows is passed on as they come.
    """
    last = shown.sparkSession.sparkContext.broadcast(late)  # bounded: see COMMON_SHARE
    held_rows, piece_rows = max(CELL_ROWS, 2 * (most or 0)), CELL_ROWS // 4

    def rows(pivot: np.ndarray, member: np.ndarray) -> pa.RecordBatch:
        pairs = np.unique(np.stack((pivot, member), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["pivot", "member"])

    def crowded(tokens: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(tokens), pa.int64()), pa.array(tokens)], names=["pivot", "member"])

    def whole(token: np.ndarray, key: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        """All sets of some shingles."""
        n = size >> PLACE_BITS
        rest = n - ((size & ((1 << PLACE_BITS) - 1)) * n >> PLACE_BITS)
        for _ in range(2):  # the second time without those that have no partner
            cell = np.cumsum(np.append(True, token[1:] != token[:-1]))
            fine = partnered(cell, n, rest, percent)
            token, key, n, rest = token[fine], key[fine], n[fine], rest[fine]
            if not len(token):
                return
        # Cells end where the shingle changes, or where sizes leave a gap that no similar pair can bridge.
        new = np.append(True, (token[1:] != token[:-1]) | (percent * n[1:] > 100 * n[:-1]))
        starts = np.flatnonzero(new)
        count = np.diff(np.append(starts, len(token)))
        wanted = count > 1
        if most is not None:
            over = (count > most) & ~is_common(token[starts].view(np.uint64), last.value)
            wanted &= ~over
            if over.any():
                yield crowded(np.unique(token[starts[over]]))
        if wanted.any():
            kept = np.repeat(wanted, count)
            yield rows(np.repeat(np.minimum.reduceat(key, starts), count)[kept], key[kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        waiting: list[tuple[np.ndarray, ...]] = []
        held, open_token, pivot, at = 0, None, None, 0
        for batch in chain(batches, (None,)):
            if batch is not None:
                if not batch.num_rows:
                    continue
                waiting.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "key", "size")))
                held += batch.num_rows
            if not held or batch is not None and held < piece_rows:
                continue
            token, key, size = (np.concatenate(x) for x in zip(*waiting))
            again = np.append(False, (token[1:] == token[:-1]) & (key[1:] == key[:-1]))  # one set shown by several tasks
            token, key, size = token[~again], key[~again], size[~again]
            if open_token is not None:  # a shingle with very many rows goes on
                own = int(np.searchsorted(token, open_token, side="right"))
                if own and pivot is not None:
                    n = size[:own] >> PLACE_BITS
                    gap = np.append(percent * n[0] > 100 * at, percent * n[1:] > 100 * n[:-1])
                    starts = np.flatnonzero(np.append(True, gap[1:]))
                    pivots = key[starts]
                    pivots[0] = pivots[0] if gap[0] else pivot
                    yield rows(np.repeat(pivots, np.diff(np.append(starts, own))), key[:own])
                    pivot, at = pivots[-1], n[-1]
                token, key, size = token[own:], key[own:], size[own:]
                open_token = open_token if not len(token) and batch is not None else None
            stop = len(token) if batch is None else int(np.searchsorted(token, token[-1])) if len(token) else 0  # the last shingle may go on
            if stop:
                yield from whole(token[:stop], key[:stop], size[:stop])
                token, key, size = token[stop:], key[stop:], size[stop:]
            if len(token) > held_rows:
                open_token, pivot = token[0], None
                if most is not None and not is_common(token[:1].view(np.uint64), last.value)[0]:
                    yield crowded(token[:1])
                else:
                    n = size >> PLACE_BITS
                    starts = np.flatnonzero(np.append(True, percent * n[1:] > 100 * n[:-1]))
                    pivots = np.minimum.reduceat(key, starts)
                    yield rows(np.repeat(pivots, np.diff(np.append(starts, len(key)))), key)
                    pivot, at = pivots[-1], n[-1]
                token, key, size = token[:0], key[:0], size[:0]
            waiting, held = ([(token, key, size)], len(token)) if len(token) else ([], 0)

    dealt = shown.repartition(parts, "token").sortWithinPartitions("token", "size", "key")
    return dealt.mapInArrow(run, "pivot long, member long")


def _units(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal keys, from sorted batches."""
    tidy()
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in keys])
        bounds = [0, *(np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(bounds, bounds[1:]):
            key = tuple(columns[:, a].tolist())
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield last, pa.Table.from_batches(held)


def _elsewhere(i: np.ndarray, j: np.ndarray, primary: np.ndarray, pivot: int) -> np.ndarray:
    """Pairs that share a smaller bundle: they are compared there."""
    return (primary[i] == primary[j]) & (primary[i] != pivot)


def _partnered(members: DataFrame, percent: int) -> DataFrame:
    """(pivot, member, primary) of members that the signature tree of their bundle, or of their unit of it, leaves a partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (pivot, _), unit in _units(batches, ["pivot", "unit"]):
            keys, sizes, primary = (unit.column(c).to_numpy() for c in ("member", "n", "primary"))
            left = np.zeros(len(keys), dtype=bool)
            for i, j in SignatureTree(sizes, unit.column("bits").to_pylist()).pairs(percent):
                fine = ~_elsewhere(i, j, primary, pivot)
                left[i[fine]] = left[j[fine]] = True
            if left.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(left.sum()), pivot)), pa.array(keys[left]), pa.array(primary[left])], names=["pivot", "member", "primary"])

    return members.mapInArrow(run, "pivot long, member long, primary long")


def _partnered_across(members: DataFrame, percent: int) -> DataFrame:
    """(pivot, member, primary) of members held (kind 0) that have a partner among those that stream past (kind 1), and of these partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, keys, primary, tree = None, None, None, None
        for (pivot, block, kind, _), unit in _units(batches, ["pivot", "unit", "kind", "part"]):
            own_keys, sizes, own_primary = (unit.column(c).to_numpy() for c in ("member", "n", "primary"))
            own = SignatureTree(sizes, unit.column("bits").to_pylist())
            if kind == 0:
                held_key, keys, primary, tree = (pivot, block), own_keys, own_primary, own
                continue
            if (pivot, block) != held_key:
                continue
            left, met = np.zeros(len(keys), dtype=bool), np.zeros(len(own_keys), dtype=bool)
            for i, j in tree.pairs(percent, own):
                fine = (keys[i] != own_keys[j]) & ((primary[i] != own_primary[j]) | (primary[i] == pivot))
                left[i[fine]] = met[j[fine]] = True
            if left.any():
                found = [np.concatenate((a[left], b[met])) for a, b in ((keys, own_keys), (primary, own_primary))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found[0]), pivot)), *map(pa.array, found)], names=["pivot", "member", "primary"])

    return members.mapInArrow(run, "pivot long, member long, primary long")


def _by_slices(rows: DataFrame, own: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on rows with their sets' bitmaps, some units of bundles at a time.

    Only those of one slice are on the way at once, so their bytes grow no faster than the sets.
    """
    bitmaps = own.select(F.col("key").alias("member"), "n", "bits")
    size = F.coalesce(F.sum(F.octet_length("bits")), F.lit(0))
    total, every = (df.agg(size).first()[0] for df in (rows.join(bitmaps, "member"), bitmaps))
    n = max(1, -(-total // max(SLICE_BYTES, SLICE_SHARE * every)))
    out = None
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("pivot", "unit"), F.lit(n)) == k)
        found = checkpointed(work(part.join(bitmaps, "member")))
        out = found if out is None else out.unionByName(found)
    return out


def _flagged(stars: DataFrame, own: DataFrame, percent: int, parts: int) -> DataFrame:
    """(pivot, member, primary) of members that may be similar to another of their bundle, by their bitmaps.

    Units of large bundles hold about ``TREE_SETS`` sets.  What has no partner in its own unit is met by the
    whole bundle; in bundles whose sets mostly meet elsewhere, those of the others are.
    """
    units = stars.withColumn("pieces", F.ceil(F.col("m") / TREE_SETS).cast("int"))
    rows = units.select("pivot", "member", "primary", F.pmod(F.xxhash64("member"), F.col("pieces")).cast("int").alias("unit"))
    keys = ["pivot", "unit"]
    near = _by_slices(rows, own, lambda part: _partnered(part.repartition(parts, *keys).sortWithinPartitions(*keys), percent))
    large = units.where(F.col("m") > TREE_SETS)
    alone = large.where("major = pivot OR primary <> major").select("pivot", "member", "primary")
    alone = checkpointed(alone.join(near.select("pivot", "member"), ["pivot", "member"], "left_anti"))
    if alone.isEmpty():
        return near
    blocks = checkpointed(alone.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / TREE_SETS).cast("int").alias("blocks")))
    home = alone.join(blocks, "pivot").select("pivot", "member", "primary", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int").alias("unit"), F.lit(0).alias("kind"), F.lit(0).alias("part"))
    stream = large.join(blocks, "pivot").select("pivot", "member", "primary", F.explode(F.expr("sequence(0, blocks - 1)")).alias("unit"), F.lit(1).alias("kind"), F.pmod(F.xxhash64("member", F.lit(1)), F.col("pieces")).cast("int").alias("part"))
    across = _by_slices(home.unionByName(stream), own, lambda part: _partnered_across(part.repartition(parts, *keys).sortWithinPartitions(*keys, "kind", "part"), percent))
    return near.unionByName(across).distinct()


def _read_sets(unit: pa.Table) -> tuple[list[int], list[np.ndarray]]:
    """Keys and sets of a unit's texts; a text that belongs to another set of the same id is left out."""
    found: dict[int, np.ndarray] = {}
    wanted = unit.column("member").to_pylist()
    for key, s in zip(wanted, shingle_sets(unit.column("t").cast(pa.binary()).to_pylist())):
        if key not in found and set_hash(s) == key:
            found[key] = s
    return list(found), list(found.values())


def _linked(texts: DataFrame, percent: int) -> DataFrame:
    """Exact links within chunks: (a, b, pivot, root).

    ``b`` is null for a set that its chunk doesn't connect to the pivot; ``root`` then stands for those that the chunk connects it to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (pivot, chunk), unit in _units(batches, ["pivot", "chunk"]):
            keys, sets = _read_sets(unit)
            if len(keys) < 2:
                continue
            order = sorted(range(len(keys)), key=lambda k: (keys[k] != pivot, keys[k]))
            keys, sets = [keys[k] for k in order], [sets[k] for k in order]
            whole = unit.column("chunks")[0].as_py() == 1
            first = dict(zip(unit.column("member").to_pylist(), unit.column("primary").to_pylist()))
            primary = np.array([first[k] for k in keys])
            joined, a, b, root = Joined(len(keys)), [], [], []
            tree = SignatureTree(np.array([len(s) for s in sets]), [bitmap(s) for s in sets])
            found = list(tree.pairs(percent))
            i, j = (np.concatenate([x[k] for x in found]) for k in (0, 1)) if found else (np.zeros(0, int),) * 2
            if whole:
                fine = ~_elsewhere(i, j, primary, pivot)
                i, j = i[fine], j[fine]
            low, high = np.minimum(i, j), np.maximum(i, j)
            for k in np.lexsort((high, low)).tolist():  # the pivot's pairs first
                x, y = int(low[k]), int(high[k])
                p, q = joined.root(x), joined.root(y)
                if p != q and similar(sets[x], sets[y], percent):
                    joined.join(p, q)
                    a.append(keys[x])
                    b.append(keys[y])
                    root.append(None)
            if not whole:
                anchor = joined.root(0) if keys[0] == pivot else None
                for k in range(len(keys)):
                    if joined.root(k) != anchor:
                        a.append(keys[k])
                        b.append(None)
                        root.append(keys[joined.root(k)])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, [pivot] * len(a), root)], names=["a", "b", "pivot", "root"])

    return texts.mapInArrow(run, "a long, b long, pivot long, root long")


def _linked_across(texts: DataFrame, percent: int) -> DataFrame:
    """Exact links of the sets left over (kind 0, at most a chunk's worth) with all sets of their bundle that stream past (kind 1).

    ``label`` says which sets are connected already; a link is passed on only if it connects more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, keys, sets, labels, up = None, [], [], [], {}

        def root(label: int) -> int:
            while (above := up.setdefault(label, label)) != label:
                up[label] = up.setdefault(above, above)
                label = above
            return label

        def met(stream_keys: list[int], stream: list[np.ndarray], stream_labels: list[int]) -> pa.RecordBatch | None:
            a, b, n = [], [], len(sets)
            if len(up) > REMEMBERED:
                up.clear()
            both = SignatureTree(np.array([len(s) for s in sets + stream]), [bitmap(s) for s in sets + stream])
            for i, j in both.pairs(percent):
                for x, y in zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist()):
                    if x < n <= y:
                        p, q = root(labels[x]), root(stream_labels[y - n])
                        if p != q and similar(sets[x], stream[y - n], percent):
                            up[max(p, q)] = min(p, q)
                            a.append(keys[x])
                            b.append(stream_keys[y - n])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]) if a else None

        for (pivot, block, kind, part), unit in _units(batches, ["pivot", "block", "kind", "part"]):
            own_keys, own_sets = _read_sets(unit)
            label = dict(zip(unit.column("member").to_pylist(), unit.column("label").to_pylist()))
            own_labels = [label[k] for k in own_keys]
            if kind == 0:
                if (pivot, block) != held_key:
                    held_key, keys, sets, labels, up = (pivot, block), [], [], [], {}
                keys, sets, labels = keys + own_keys, sets + own_sets, labels + own_labels
            elif (pivot, block) == held_key and own_sets and sets:
                if out := met(own_keys, own_sets, own_labels):
                    yield out

    return texts.mapInArrow(run, "a long, b long")


def _with_texts(bodies: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with the texts of their ids.

    Up to ``BROADCAST_IDS`` distinct ids are sent to the texts, so that only theirs travel; more meet
    the texts by a shuffle of both.
    """
    ids = rows.select("id").distinct()
    if ids.count() <= BROADCAST_IDS:
        bodies = bodies.join(F.broadcast(ids), "id", "left_semi")
    return bodies.join(rows, "id")


def similar_documents(df: DataFrame, percent: int = 75, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Groups documents by links between sets of word shingles with 100 * overlap >= ``percent`` * union.

    Returns one row per row of ``df``: ``doc_id``, ``n_shingles`` and ``component_id`` (smallest id
    reachable by links, itself included).  Words are what stands between spaces and tab to carriage
    return, A-Z lower-cased.  Texts with fewer words than a shingle are one shingle; null texts and
    those without words have none and link with nothing.  Equal texts and repeated rows link with
    each other.  A null id takes no part and has a null ``component_id``.  Other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    spark = df.sparkSession
    shown_sets = checkpointed(document_sets(df, percent, text, id_column))
    sets = shown_sets.where("n >= 0")
    own = sets.where("n > 0 AND id IS NOT NULL").groupBy("key").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.min("bits").alias("bits"))
    own = checkpointed(own)
    n_sets = own.count()
    most = max(COMMON_SETS, min(n_sets // 1024, MOST_COMMON_SETS), int(n_sets * COMMON_SHARE))
    parts = shuffle_partitions(spark)

    named = df.where(F.col(id_column).isNotNull())
    before, common, stars = None, _often(shown_sets, max(2, most // 2)), None
    for turn in range(ROUNDS):
        last = turn == ROUNDS - 1
        found = checkpointed(_bundles(_shown(named, percent, text, common, before), percent, None if last else most, parts, common))
        met = found.where("pivot IS NOT NULL")
        stars = met if stars is None else stars.unionByName(met)
        # At most the shingles shown, divided by ``most``.
        fresh = [r["member"] for r in found.where("pivot IS NULL").select("member").distinct().collect()]
        if not fresh:
            break
        before, common = common, np.unique(np.concatenate((common, np.array(fresh, dtype=np.int64).view(np.uint64))))

    # A pair of sets is compared in the smallest bundle that it shares.  A set's primary bundle is its smallest: sets
    # with one primary bundle meet there, and need not be compared with each other in any other.
    stars = checkpointed(stars.distinct())
    stars = checkpointed(stars.join(stars.groupBy("member").agg(F.min("pivot").alias("primary")), "member"))
    per_bundle = stars.groupBy("pivot", "primary").agg(F.count(F.lit(1)).alias("k")).groupBy("pivot")
    per_bundle = per_bundle.agg(F.sum("k").alias("m"), F.count(F.lit(1)).alias("kinds"), F.max_by("primary", F.struct("k", -F.col("primary"))).alias("major"))
    per_bundle = checkpointed(per_bundle.where("kinds > 1 OR major = pivot"))
    stars = checkpointed(stars.join(per_bundle.select("pivot", "m", "major"), "pivot"))
    left = _flagged(stars, own, percent, parts).join(per_bundle.select("pivot", "m", "major"), "pivot")
    left = checkpointed(left.join(own.select(F.col("key").alias("member"), "id"), "member"))
    apart = (F.col("m") > TREE_SETS) & (F.col("major") != F.col("pivot"))
    flagged = left.where(~apart).select("member", "pivot", "primary", "id")
    counts = flagged.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    flagged = checkpointed(flagged.join(counts, "pivot"))
    bodies = df.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("t"))

    chunked = flagged.withColumn("chunk", F.when(F.col("member") == F.col("pivot"), F.expr("sequence(0, chunks - 1)")).otherwise(F.array(F.pmod(F.xxhash64("member"), F.col("chunks")).cast("int"))))
    chunked = _with_texts(bodies, chunked).withColumn("chunk", F.explode("chunk")).select("pivot", "chunk", "chunks", "member", "primary", "t")
    within = checkpointed(_linked(chunked.repartition(parts, "pivot", "chunk").sortWithinPartitions("pivot", "chunk"), percent))
    links = within.where("b IS NOT NULL").select("a", "b")
    # What is left to compare across: sets that no chunk connects to the pivot, and those of another primary bundle
    # in large bundles whose sets mostly meet elsewhere.
    mixed = left.where(apart).select("pivot", "member", "primary", "major", F.ceil(F.col("m") / CHUNK).cast("int").alias("chunks"))
    left = within.where("b IS NULL").select("pivot", F.col("a").alias("member"), F.col("root").alias("label")).unionByName(mixed.where("primary <> major").select("pivot", "member", F.col("member").alias("label")))
    left = checkpointed(left.groupBy("pivot", "member").agg(F.min("label").alias("label")))
    if not left.isEmpty():
        # Blocks of what is left, each met by its whole bundle.
        blocks = checkpointed(left.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("blocks")))
        home = left.join(blocks, "pivot").select("pivot", "member", "label", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("kind"), F.lit(0).alias("part"))
        stream = flagged.select("pivot", "member", "chunks", F.col("pivot").alias("other")).unionByName(mixed.select("pivot", "member", "chunks", F.col("member").alias("other")))
        stream = stream.join(left, ["pivot", "member"], "left").withColumn("label", F.coalesce("label", "other"))
        stream = stream.join(blocks, "pivot").select("pivot", "member", "label", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.lit(1).alias("kind"), F.pmod(F.xxhash64("member", F.lit(1)), F.col("chunks")).cast("int").alias("part"))
        both = home.unionByName(stream).join(own.select(F.col("key").alias("member"), "id"), "member")
        both = _with_texts(bodies, checkpointed(both)).select("pivot", "block", "kind", "part", "member", "label", "t")
        across = _linked_across(both.repartition(parts, "pivot", "block").sortWithinPartitions("pivot", "block", "kind", "part"), percent)
        links = links.unionByName(checkpointed(across))

    whole = components(links).withColumnRenamed("node", "key")
    named = own.select("key", "id").join(whole, "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = checkpointed(named.join(least, "component").select("key", "component_id"))
    out = sets.select("id", "n", "key").join(named, "key", "left")
    alone = (F.col("n") == 0) | F.col("id").isNull()
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
