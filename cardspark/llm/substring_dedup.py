"""Removal of passages that repeat across documents, by hashing of lines and their sentences.

A text is cut into units at line ends and at ends of sentences; the start of a sentence in the
middle of a line is found from the signs around it alone, so a passage is cut alike wherever it
stands.  Units are normalised and hashed; digests are grouped globally, the occurrence that ranks
first (smallest document id, then position) stays.  Whole lines, and stretches of short units with
enough words, are hashed as one as well.  Of the other occurrences, lines and stretches go, and runs of
neighbouring units with enough words in longer units; their offsets in the text as it was are kept.
Only digests that occur more than once travel back to the documents.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardspark.llm.common import checkpointed, shuffle_partitions, slices, unused_names
from cardspark.llm.shingles import mixed

#: Words a run of repeated units must have to be removed, and those a unit must have for a run to rest on it, or a whole
#: line to be removed whatever stands around it.
RUN_WORDS, STRONG_WORDS = 12, 6
#: Kinds of characters: part of a word, white space within a line, line end, end of a sentence, capital and small letter.
WORD, BLANK, NEWLINE, STOP, UPPER, SMALL = 1, 2, 4, 8, 16, 32
#: Bytes of texts worked out at once.
SLICE_BYTES = 1 << 19
#: Odd multipliers of the two hashes of characters, words and units.
STEPS = tuple(np.array([a, b, c], dtype=np.uint64) for a, b, c in ((0x9E3779B97F4A7C15, 0xD1B54A32D192ED05, 0xA0761D6478BD642F), (0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)))


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: its kinds, and the value that stands for it whatever its case."""
    kinds, low = np.zeros(0x110000, dtype=np.uint8), np.arange(0x110000, dtype=np.uint64)
    classes = ((WORD, r"\w"), (BLANK, r"[^\S\n]"), (NEWLINE, r"\n"), (STOP, r"[.!?]"), (UPPER, "[A-ZÀ-ÖØ-Þ]"), (SMALL, r"[^\W\d_A-ZÀ-ÖØ-Þ]"))
    patterns = [(kind, re.compile(f"{p}+")) for kind, p in classes]
    for start in range(0, 0x110000, 1 << 12):
        codes = [c for c in range(start, start + (1 << 12)) if not 0xD800 <= c < 0xE000]
        block = "".join(map(chr, codes))
        for kind, pattern in patterns if block else ():
            for m in pattern.finditer(block):
                kinds[codes[m.start()] : codes[m.end() - 1] + 1] |= kind
        if block.lower() != block:
            for c in codes:
                small = chr(c).lower()
                low[c] = ord(small) if len(small) == 1 else c
    return kinds, mixed(low + np.uint64(1))


def _powers(step: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(1, n), step, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _places(starts: np.ndarray, n: int) -> np.ndarray:
    """Place of each of ``n`` rows in its group, from the groups' first rows."""
    return np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
    return edge[0::2], edge[1::2]


class Units:
    """The units of some texts that have a word, one text after another, as arrays.

    ``text``: number of the text; ``start`` and ``end``: characters of the text; ``words``: number of
    words; ``hashes``: two 64-bit hashes of the words' sequence; ``ends_line``: whether a line ends
    after the unit; ``bounds``: where each text's units begin, and the end.
    """

    def __init__(self, texts: list[str]):
        kinds_of, value_of = _tables()
        codes = np.frombuffer("\n".join([*texts, "", ""]).encode("utf-32-le"), dtype=np.uint32)
        kind = kinds_of[codes]
        # White space is a border after a sentence's end, or where it leads from a small letter to a capital with a small one behind.
        starts, ends = _runs((kind & BLANK) > 0)
        before = np.where(starts > 0, kind[starts - 1], NEWLINE)
        border = (before & STOP > 0) | (before & SMALL > 0) & (kind[ends] & UPPER > 0) & (kind[np.minimum(ends + 1, len(kind) - 1)] & SMALL > 0)
        change = np.zeros(len(kind) + 1, dtype=np.int8)
        change[starts[border]] = 1
        change[ends[border]] -= 1
        lines = (kind & NEWLINE) > 0
        start, end = _runs(~lines & (np.cumsum(change[:-1], dtype=np.int8) == 0))
        inside = (kind & WORD) > 0
        word_start, word_end = _runs(inside)
        of = np.searchsorted(start, word_start, side="right") - 1  # no word goes over a border
        count = np.bincount(of, minlength=len(start))
        kept = count > 0
        self.words = count[kept].astype(np.int64)
        first_words = np.cumsum(self.words) - self.words
        values = value_of[codes[inside]]
        sizes = word_end - word_start
        first_letters = np.cumsum(sizes) - sizes
        place, word_place = _places(first_letters, len(values)), _places(first_words, len(word_start))
        self.hashes = []
        for step in STEPS:
            if not len(sizes):
                self.hashes.append(np.zeros(0, np.uint64))
                continue
            word = mixed(np.add.reduceat(values * _powers(step[0], int(sizes.max()))[place], first_letters) + sizes.astype(np.uint64))
            unit = np.add.reduceat(word * _powers(step[1], int(self.words.max()))[word_place], first_words)
            self.hashes.append(mixed(unit + self.words.astype(np.uint64)))
        start, end = start[kept], end[kept]
        text_start = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.text = np.searchsorted(text_start, start, side="right") - 1
        passed = np.cumsum(lines)
        self.ends_line = passed[np.append(start[1:], len(passed) - 1)] > passed[np.maximum(end, 1) - 1] if len(start) else np.zeros(0, bool)
        self.start, self.end = start - text_start[self.text], end - text_start[self.text]
        self.bounds = np.searchsorted(self.text, np.arange(len(texts) + 1))

    def joint_hashes(self, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
        """Hashes of the sequences of units from ``first`` to ``last``."""
        out = []
        for unit, step in zip(self.hashes, STEPS):
            total = np.append(np.uint64(0), np.cumsum(unit * _powers(step[2], len(unit)), dtype=np.uint64))
            back = _powers(np.uint64(pow(int(step[2]), -1, 1 << 64)), len(unit))
            out.append(mixed((total[last + 1] - total[first]) * back[first] + (last - first + 2).astype(np.uint64) * step[0]))
        return out

    def stretches(self, run_words: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last unit of the shortest stretches of ``run_words`` words from each unit on and up to each unit."""
        n, total = len(self.words), np.append(0, np.cumsum(self.words))
        own = np.arange(n)
        on = np.searchsorted(total, total[:-1] + run_words) - 1
        fits = on < self.bounds[self.text + 1]
        upto = np.searchsorted(total, total[1:] - run_words, side="right") - 1
        reaches = (upto >= self.bounds[self.text]) & (total[1:] >= run_words)
        pairs = np.unique(np.concatenate((own[fits] * (n + 1) + on[fits], upto[reaches] * (n + 1) + own[reaches])))
        return pairs // (n + 1), pairs % (n + 1)

    def joint(self, run_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which units are whole lines of some words, and (first, last) of longer lines and of stretches to be hashed as one.

        Stretches are those that no run can rest on; at least half of their units must differ from each other.
        """
        n = len(self.words)
        alone = np.zeros(n, dtype=bool)
        if not n:
            return alone, np.zeros(0, np.int64), np.zeros(0, np.int64)
        total = np.append(0, np.cumsum(self.words))
        strong = np.append(0, np.cumsum(np.where(self.words >= STRONG_WORDS, self.words, 0)))
        last = np.flatnonzero(self.ends_line)
        first = np.append(0, last[:-1] + 1)
        wide = total[last + 1] - total[first] >= STRONG_WORDS
        alone[last[wide & (first == last)]] = True
        line = wide & (first < last)
        a, b = self.stretches(run_words)
        weak = 2 * (strong[b + 1] - strong[a]) < total[b + 1] - total[a]
        a, b = a[weak], b[weak]
        order = np.lexsort((np.arange(n), self.hashes[0], self.text))
        again = (self.text[order[1:]] == self.text[order[:-1]]) & (self.hashes[0][order[1:]] == self.hashes[0][order[:-1]])
        earlier = np.full(n, -1)
        earlier[order[1:][again]] = order[:-1][again]
        kinds = np.zeros(len(a), dtype=np.int64)
        for k in range(int((b - a).max()) + 1 if len(a) else 0):  # a stretch has at most as many units as words
            at = np.minimum(a + k, b)
            kinds += (a + k <= b) & (earlier[at] < a)
        fine = 2 * kinds > b - a
        pairs = np.unique(np.concatenate((first[line] * (n + 1) + last[line], a[fine] * (n + 1) + b[fine])))
        return alone, pairs // (n + 1), pairs % (n + 1)

    def rows(self, run_words: int) -> list[np.ndarray]:
        """Columns of what is hashed: text, both hashes, first unit, last unit if it goes as one (else -1), start, end and words."""
        alone, first, last = self.joint(run_words)
        n, k = len(self.words), len(first)
        seq = np.arange(n) - self.bounds[self.text]
        none = np.zeros(k, dtype=np.int64)  # lines and stretches only say which units go
        both = [np.concatenate(x) for x in zip(self.hashes, self.joint_hashes(first, last))]
        columns = ((self.text, self.text[first]), (seq, seq[first]), (np.where(alone, seq, -1), seq[last]), (self.start, none), (self.end, none), (self.words, none))
        text, *rest = (np.concatenate(x) for x in columns)
        return [text, *both, *rest]


def stretches(words: list[int], run_words: int) -> Iterator[tuple[int, int]]:
    """As in :class:`Units`, for one run of neighbouring units."""
    total = start = 0
    fresh = 0  # units before this one have had their stretch
    for last, n in enumerate(words):
        total += n
        while total - words[start] >= run_words:
            total -= words[start]
            start += 1
        if total >= run_words:
            for k in range(min(fresh, start), start + 1):
                yield k, last
            fresh = start + 1


def sums(words: list[int]) -> tuple[list[int], list[int]]:
    """Running totals of all words, and of those in units that a run can rest on; a run is strong if these are half of its words."""
    return [0, *accumulate(words)], [0, *accumulate([n if n >= STRONG_WORDS else 0 for n in words])]


def chosen(rows: list[tuple], run_words: int) -> Iterator[tuple[int, int, int, object]]:
    """Start, end, words and smallest first id of a document's spans, from its repeated rows (seq, last, start, end, words, first id)."""
    reach: dict[int, int] = {}
    for seq, last, *_ in rows:
        reach[seq] = max(last, reach.get(seq, -1))
    own = sorted((r for r in rows if r[4]), key=lambda r: r[0])
    bounds = [0, *(k for k in range(1, len(own)) if own[k][0] != own[k - 1][0] + 1), len(own)]
    for a, b in zip(bounds, bounds[1:]):
        run = own[a:b]
        words = [r[4] for r in run]
        go, until = [False] * len(run), -1
        total, strong = sums(words)
        if total[-1] >= run_words:
            if 2 * strong[-1] >= total[-1]:
                go = [True] * len(run)
            else:
                for i, j in stretches(words, run_words):
                    if 2 * (strong[j + 1] - strong[i]) >= total[j + 1] - total[i]:
                        go[i : j + 1] = [True] * (j + 1 - i)
        for k, r in enumerate(run):
            until = max(until, reach[r[0]])
            go[k] = go[k] or until >= r[0]
        k = 0
        while k < len(run):
            if not go[k]:
                k += 1
                continue
            first = k
            while k < len(run) and go[k]:
                k += 1
            ids = [r[5] for r in run[first:k] if r[5] is not None]
            yield run[first][2], run[k - 1][3], sum(words[first:k]), min(ids, default=None)


def repeated_spans(df: DataFrame, text: str = "text", id_column: str = "doc_id", run_words: int = RUN_WORDS) -> DataFrame:
    """What is to be removed: one row per span.

    Returns ``id_column``, ``text_hash`` (of the whole text), ``start`` and ``end`` (characters of the text
    as it is), ``n_words`` and ``first_doc_id`` (the smallest id of a document that keeps one of the
    span's units).  Removed are repeated whole lines of ``STRONG_WORDS`` words, stretches of units with
    ``run_words`` words that repeat as one, and runs of repeated units with ``run_words`` words, half of
    them in units of ``STRONG_WORDS``.  Units are ranked by document id (null last), then the text's hash, then position.
    Rows repeated with the same id and text are one document and keep or lose the same spans.  Null
    and empty texts, and texts without words, have none; other columns are ignored, whatever
    their names; an empty table gives an empty result.
    """
    kind = df.schema[id_column].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", SLICE_BYTES):
            row, high, low, *rest = Units(batch.column("t").to_pylist()).rows(run_words)
            kept = batch.select(["id", "text_hash"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in rest)], names=["id", "text_hash", "high", "low", "seq", "last", "start", "end", "words"])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in chain(batches, (None,)):
            held += [batch] if batch is not None and batch.num_rows else []
            if not held:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            ids, hashes = table.column("id").chunk(0), table.column("text_hash").to_numpy()
            other = pa.compute.fill_null(pa.compute.not_equal(ids[1:], ids[:-1]), False).to_numpy(zero_copy_only=False)
            there = ids.is_valid().to_numpy(zero_copy_only=False)
            new = np.append(True, other | (there[1:] != there[:-1]) | (hashes[1:] != hashes[:-1]))
            stop = table.num_rows if batch is None else int(np.flatnonzero(new)[-1])  # the last document may go on
            held, table = table.slice(stop).to_batches() if stop < table.num_rows else [], table.slice(0, stop)
            if not stop:
                continue
            doc = np.cumsum(new[:stop])
            seq = table.column("seq").to_numpy()
            order = np.lexsort((seq, doc))
            doc, seq = doc[order], seq[order]
            starts = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (seq[1:] > seq[:-1] + 1)))
            # Runs that may have a span: with enough words, or with something that repeats as one.
            words, last = (table.column(c).to_numpy()[order] for c in ("words", "last"))
            some = (np.add.reduceat(words.astype(np.int64), starts) >= run_words) | (np.maximum.reduceat(last, starts) >= 0)
            ends = np.append(starts[1:], stop)
            rows = order[np.repeat(some, ends - starts)]
            part = table.take(pa.array(rows))
            found = list(zip(*(part.column(c).to_pylist() for c in ("seq", "last", "start", "end", "words", "first_doc_id"))))
            at, owner, out = 0, [], []
            for n in (ends - starts)[some].tolist():
                spans = list(chosen(found[at : at + n], run_words))
                owner += [at] * len(spans)
                out += spans
                at += n
            if out:
                whose = part.select(["id", "text_hash"]).combine_chunks().take(pa.array(owner, pa.int64()))
                kinds = (pa.int32(), pa.int32(), pa.int64(), ids.type)
                yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in whose.columns), *(pa.array(x, t) for x, t in zip(zip(*out), kinds))], names=["id", "text_hash", "start", "end", "n_words", "first_doc_id"])

    texts = df.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).cast("string").alias("t")).where("t IS NOT NULL AND t <> ''")
    found = texts.mapInArrow(cut, f"id {kind}, text_hash long, high long, low long, seq int, last int, start int, end int, words int")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash", "seq")
    # Partial sums come first, so a digest that very many documents share sends few rows.  Checkpointed, both sides of
    # the join come straight from their exchange, and adaptive execution can split such a digest there.
    first = found.groupBy("high", "low").agg(F.min(rank).alias("first"), F.max(rank).alias("last")).where("first <> last")
    first = checkpointed(first.select("high", "low", "first"))
    others = found.join(first, ["high", "low"]).where(F.col("first") != rank).select("id", "text_hash", "seq", "last", "start", "end", "words", F.col("first.id").alias("first_doc_id")).distinct()
    # Document by document.
    own = others.repartition(shuffle_partitions(df.sparkSession), "id", "text_hash").sortWithinPartitions("id", "text_hash")
    spans = own.mapInArrow(pick, f"id {kind}, text_hash long, start int, end int, n_words long, first_doc_id {kind}")
    return spans.select(F.col("id").alias(id_column), "text_hash", "start", "end", "n_words", "first_doc_id")


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the given spans; what stands on both sides is joined by one white space character."""
    out, at = [], 0
    for a, b in sorted(spans):
        out.append(text[at:a].rstrip())
        at = b
    out.append(text[at:].strip() if out else text[at:])
    return " ".join([part for part in out if part]) if spans else text


def remove_repeated(df: DataFrame, text: str = "text", id_column: str = "doc_id", run_words: int = RUN_WORDS, spans_column: str = "__spans") -> DataFrame:
    """``df`` with repeated passages cut out of ``text``, and the spans removed in ``spans_column``.

    All rows and columns stay, whatever their names, but for a column named like ``spans_column``, which
    is replaced; spans are (start, end) in the text as it was, and null where nothing was removed.
    Null and empty texts stay as they are; rows repeated under one id lose the same spans; a null id is
    a document that ranks last.  An empty table gives an empty result.  See :func:`repeated_spans`
    for what is removed.
    """
    spans = repeated_spans(df, text, id_column, run_words)
    key, digest = unused_names(df, "id", "digest")
    df = df.drop(spans_column)
    lists = spans.groupBy(F.col(id_column).alias(key), F.col("text_hash").alias(digest)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(spans_column))  # a document's own spans
    joined = df.join(lists, F.col(id_column).eqNullSafe(F.col(key)) & (F.xxhash64(text) == F.col(digest)), "left").drop(key, digest)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            texts = [t if not s else without_spans(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(batch.column(text).to_pylist(), batch.column(spans_column).to_pylist())]
            yield batch.set_column(batch.schema.get_field_index(text), batch.schema.field(text), pa.array(texts, batch.schema.field(text).type))

    return joined.mapInArrow(cut, joined.schema)
