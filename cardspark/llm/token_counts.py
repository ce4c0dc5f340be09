"""Token counts by finite-state transducers.

Two deterministic transducers make up the tokenizer.  The first reads character classes and
emits where pre-tokens start; its answers for contractions and white space come one or two
characters late, as the pattern's look-ahead asks.  A batch's characters are cut into chunks, the
map from entry state to exit state of every chunk is worked out for all chunks at once, the maps
are composed by a parallel prefix scan, and a second pass from the then known entry states emits.
The second transducer is the trie of pre-tokens: its states are prefixes, each transition changes the
number of tokens emitted so far, and the number at a final state is the pre-token's (see
:meth:`cardspark.llm.bpe.WordTrieEncoder.count`); those of final states are kept between batches.  Spark deals out the texts; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardspark.llm import bpe
from cardspark.llm.common import held, slices

#: Character classes: other letters, s t m d, r v, e, l, numbers, space, other white space, apostrophe, the rest, separator.
LETTER, STMD, RV, E, L, NUMBER, SPACE, WHITE, APOSTROPHE, OTHER, SEPARATOR = CLASSES = range(11)
LETTERS = (LETTER, STMD, RV, E, L)
#: States: at a pre-token's end; in letters; in numbers; in other signs; after a space; after other
#: white space; after an apostrophe that began a pre-token; after that and r or v; after that and l.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, AFTER_WHITE, QUOTE, QUOTE_RV, QUOTE_L = STATES = range(9)
#: Emissions: a pre-token starts at this character; one started at the character before.
HERE, BEFORE = 1, 2
#: Characters in a chunk; pre-tokens kept between batches and their greatest length.
CHUNK, MEMO_WORDS, MEMO_CHARACTERS = 128, 400_000, 64


def _opened(kind: int) -> int:
    """State after a pre-token's first character."""
    if kind in LETTERS:
        return IN_LETTERS
    return {NUMBER: IN_NUMBERS, SPACE: AFTER_SPACE, WHITE: AFTER_WHITE, APOSTROPHE: QUOTE, OTHER: IN_OTHERS, SEPARATOR: FRESH}[kind]


def _step(state: int, kind: int) -> tuple[int, int]:
    """Next state and emission."""
    begun = (_opened(kind), HERE)
    letter, sign = kind in LETTERS, kind in (APOSTROPHE, OTHER)
    if state == IN_LETTERS and letter or state == IN_NUMBERS and kind == NUMBER or state == IN_OTHERS and sign:
        return state, 0
    if state in (AFTER_SPACE, AFTER_WHITE):
        if kind in (SPACE, WHITE):
            return _opened(kind), 0
        if kind == SEPARATOR:
            return begun
        if state == AFTER_WHITE:
            return begun[0], HERE | BEFORE
        return (IN_OTHERS if sign else begun[0]), BEFORE  # the space is the pre-token's first character
    if state == QUOTE:
        if kind in (RV, L):
            return (QUOTE_RV if kind == RV else QUOTE_L), 0
        if kind == STMD:
            return FRESH, 0
        if sign:
            return IN_OTHERS, 0
    if state in (QUOTE_RV, QUOTE_L):
        if kind == (E if state == QUOTE_RV else L):
            return FRESH, 0
        return (IN_LETTERS, BEFORE) if letter else (begun[0], HERE | BEFORE)
    return begun


_TABLE = [[_step(s, k) for s in STATES] for k in CLASSES]
NEXT = np.array([[x[0] for x in row] for row in _TABLE], dtype=np.intp).ravel()
EMIT = np.array([[x[1] for x in row] for row in _TABLE], dtype=np.uint8).ravel()


def starts(kinds: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in a sequence of character classes."""
    n, size = len(kinds), len(STATES)
    chunks = -(-n // CHUNK)
    padded = np.full(chunks * CHUNK, SEPARATOR, dtype=np.intp)
    padded[:n] = kinds
    columns = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T) * size
    maps = np.tile(np.arange(size), (chunks, 1))
    for column in columns:
        maps = NEXT[column[:, None] + maps]
    reach = 1
    while reach < chunks:  # afterwards row k maps the first entry state to the exit state of chunk k
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], axis=1)
        reach *= 2
    state = np.concatenate(([FRESH], maps[:-1, FRESH]))
    emitted = np.empty((CHUNK, chunks), dtype=np.uint8)
    for j, column in enumerate(columns):
        at = column + state
        emitted[j] = EMIT[at]
        state = NEXT[at]
    flags = np.append(emitted.T.ravel(), np.uint8(0))
    return np.flatnonzero(((flags[:-1] & HERE) | (flags[1:] & BEFORE))[:n])


class Counter:
    """Counts of whole texts."""

    def __init__(self, path: str, ranges: dict):
        self.encoder = bpe.WordTrieEncoder(path)
        self.special = re.compile("|".join(map(re.escape, self.encoder.special)))
        kinds = self.kinds = np.full(0x110000, OTHER, dtype=np.uint8)
        for name, kind in (("letter", LETTER), ("number", NUMBER), ("space", WHITE)):
            for a, b in ranges[name]:
                kinds[a : b + 1] = kind
        for signs, kind in (("stmd", STMD), ("rv", RV), ("e", E), ("l", L), (" ", SPACE), ("'", APOSTROPHE)):
            kinds[[ord(c) for c in signs]] = kind
        self.memo: dict[str, int] = {}

    def counts(self, texts: list[str | None]) -> np.ndarray:
        parts, owner, total = [], [], np.zeros(len(texts), dtype=np.int64)
        for k, text in enumerate(texts):
            if text and "<|" in text:  # a special token's string is one token and parts the text
                own = self.special.split(text)
                total[k] += len(own) - 1
            else:
                own = [text or ""]
            parts += own
            owner += [k] * len(own)
        joined = "\n".join(parts) + "\n"
        kinds = self.kinds[np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)]
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        kinds[ends] = SEPARATOR
        begin = starts(kinds)
        bounds = begin.tolist()
        words = [joined[a:b] for a, b in zip(bounds, bounds[1:] + [len(joined)])]
        get = self.memo.get
        found = list(map(get, words))
        if None in found:
            learnt = dict(self.encoder.count({w for w, c in zip(words, found) if c is None}))
            found = [learnt[w] if c is None else c for w, c in zip(words, found)]
            if len(self.memo) > MEMO_WORDS:
                self.memo.clear()
            self.memo.update((w, c) for w, c in learnt.items() if len(w) <= MEMO_CHARACTERS)
        count = np.array(found, dtype=np.int64)
        count[kinds[begin] == SEPARATOR] = 0
        sums = np.bincount(np.searchsorted(ends, begin), weights=count, minlength=len(parts)).astype(np.int64)
        np.add.at(total, owner, sums)
        return total


def token_counts(df: DataFrame, tokenizer_file: str, text: str = "text", keep: tuple[str, ...] = (), limit: int = 1024) -> DataFrame:
    """Counts the byte-level BPE tokens of each text.

    Returns the columns ``keep`` and ``n_bytes`` (of UTF-8), ``n_tokens`` and ``over_limit``
    (more than ``limit`` tokens).  Null and empty texts have no bytes and no tokens.  Strings of
    special tokens inside texts count as one token.  Repeated rows are counted alike and kept;
    other columns are ignored, whatever their names.  An empty table gives an empty result.
    """
    ranges = tuple(bpe.classes().items())
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + ["n_bytes long", "n_tokens long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = ("counter", tokenizer_file)
        counter = held(key, lambda: Counter(tokenizer_file, dict(ranges)))
        for batch in slices(batches, "__text", keep=key):
            texts = batch.column("__text")
            size = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), size, pa.array(counter.counts(texts.to_pylist()))], names=[*keep, "n_bytes", "n_tokens"])

    return df.select(*keep, df[text].cast("string").alias("__text")).mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
