"""Word shingles of whole texts as 64-bit hashes, worked out for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
#: Bytes of texts worked out at once.
PART_BYTES = 1 << 19
#: Odd multipliers (5 modulo 8, so that powers differ early) and the seed of the byte values.
BYTE_STEP, WORD_STEP, SEED = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED05 | 5), 20240229
BYTE_VALUES = np.random.default_rng(SEED).integers(0, 2**64, 256, dtype=np.uint64, endpoint=False)
#: Bytes that part words: space and the control characters from tab to carriage return.
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_POWERS = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(2 * n, BYTE_STEP))), dtype=np.uint64)
    return _POWERS


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, one text after another, and each text's number of words."""
    data = LOWER[np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)]
    blank = BLANK[data]
    edge = np.flatnonzero(np.diff(blank, prepend=True))  # a word's start, its end, the next one's start, ...
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    sizes = ends - starts
    inside = np.flatnonzero(~blank)
    place = np.arange(len(inside)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    value = BYTE_VALUES[data[inside]] * powers(int(sizes.max()))[place]
    hashes = mixed(np.add.reduceat(value, np.cumsum(sizes) - sizes) + sizes.astype(np.uint64))
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(starts, bounds), prepend=0)


def shingle_sets(texts: list[bytes | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text with fewer words is one shingle, one without words none.

    Texts are worked out some at a time, so that memory follows ``PART_BYTES`` or the longest text.
    """
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size < PART_BYTES):
            size += len(texts[stop] or b"")
            stop += 1
        yield from _part_sets(texts[start:stop], words)
        start = stop


def _part_sets(texts: list[bytes | None], words: int) -> Iterator[np.ndarray]:
    hashes, counts = word_hashes([t or b"" for t in texts])
    rolled = np.zeros(max(0, len(hashes) - words + 1), dtype=np.uint64)
    for k in range(words):
        rolled = rolled * WORD_STEP + hashes[k : k + len(rolled)]
    rolled = mixed(rolled)
    at = 0
    for n in counts.tolist():
        if n >= words:
            yield np.unique(rolled[at : at + n - words + 1])
        elif n:
            whole = np.uint64(n)
            with np.errstate(over="ignore"):
                for h in hashes[at : at + n]:
                    whole = whole * WORD_STEP + h
            yield mixed(np.array([whole], dtype=np.uint64))
        else:
            yield np.zeros(0, dtype=np.uint64)
        at += n


def set_hash(shingles: np.ndarray) -> int:
    """A signed 64-bit hash of a set of shingles."""
    total = mixed(shingles + np.uint64(len(shingles))).sum(dtype=np.uint64) if len(shingles) else np.uint64(0)
    return int(mixed(np.array([total], dtype=np.uint64)).view(np.int64)[0])
