"""Language identification by interpolated Kneser-Ney character models.

One model of character n-grams per language is learnt from a bounded sample of labelled rows.  The
probabilities are interpolated beforehand: for each order there is one sorted array of n-gram
hashes with the log-probabilities in all languages beside it, and one of contexts with their
back-off weights.  A text's characters are looked up in the longest order that knows them, all
languages at once; the language with the lowest cross-entropy per character wins, and a text
whose cross-entropy is far above what held-back sample rows show for that language is rejected.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardspark.llm import bpe
from cardspark.llm.common import accepted_rows, checkpointed, slices

UNKNOWN = "und"
#: Longest n-gram; discount; rows of the sample for each language, of which one in five calibrates.
ORDER, DISCOUNT, SAMPLE_ROWS, CALIBRATION = 4, 0.75, 1000, 5
#: A language stands out if the next is this share of the usual distance to other languages' texts behind.
MARGIN = 0.25
#: Multiplier of the rolling n-gram hash (odd, so that it is a bijection for one character).
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SPACE = 0x20


class Characters:
    """Texts as sequences of lower-cased letters, with one space for whatever stands between words."""

    def __init__(self, letters: tuple[tuple[int, int], ...]):
        self.lower = np.full(0x110000, SPACE, dtype=np.uint32)
        for a, b in letters:
            for c in range(a, b + 1):
                low = chr(c).lower()
                self.lower[c] = ord(low) if len(low) == 1 else c

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All characters, each text led and ended by a space, and the texts' ends."""
        joined = "".join([f" {t or ''} " for t in texts])
        codes = self.lower[np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)]
        ends = np.cumsum([len(t or "") + 2 for t in texts])
        blank = codes == SPACE
        keep = np.ones(len(codes), dtype=bool)
        keep[1:] = ~(blank[1:] & blank[:-1])
        keep[ends[:-1]] = True  # a text's first space
        kept = np.cumsum(keep)
        return codes[keep].astype(np.uint64), kept[ends - 1]


def hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """Hashes of the ``order`` characters that end at each position from ``order - 1`` on."""
    n = len(codes) - order + 1
    out = np.zeros(max(0, n), dtype=np.uint64)
    for k in range(order):
        out = (out + codes[k : k + len(out)] + np.uint64(1)) * MULTIPLIER
    return out


class Model:
    """Log-probabilities of all orders and languages in sorted hash arrays."""

    def __init__(self, languages: list[str], counts: dict[int, dict[tuple[int, ...], np.ndarray]]):
        """``counts[k]``: each k-gram's number of occurrences by language, of the highest order; others are derived."""
        self.languages = languages
        n = len(languages)
        grams = {ORDER: counts[ORDER]}
        for order in range(ORDER - 1, 0, -1):  # continuation counts: distinct characters before
            own: dict[tuple[int, ...], np.ndarray] = defaultdict(lambda: np.zeros(n))
            for gram, c in grams[order + 1].items():
                own[gram[1:]] += c > 0
            grams[order] = own
        symbols = len(grams[1]) + 1
        self.floor = np.full(n, np.log(1.0 / symbols))
        below: dict[tuple[int, ...], np.ndarray] = {}
        self.tables, self.contexts = {}, {}
        for order in range(1, ORDER + 1):
            total: dict[tuple[int, ...], np.ndarray] = defaultdict(lambda: np.zeros(n))
            kinds: dict[tuple[int, ...], np.ndarray] = defaultdict(lambda: np.zeros(n))
            for gram, c in grams[order].items():
                total[gram[:-1]] += c
                kinds[gram[:-1]] += c > 0
            left = {h: np.where(t > 0, DISCOUNT * kinds[h] / np.maximum(t, 1), 1.0) for h, t in total.items()}
            here = {}
            for gram, c in grams[order].items():
                lower = below[gram[1:]] if order > 1 else np.exp(self.floor)
                t = total[gram[:-1]]
                here[gram] = np.where(t > 0, np.maximum(c - DISCOUNT, 0) / np.maximum(t, 1), 0.0) + left[gram[:-1]] * lower
            self.tables[order] = self._sorted(here, n)
            self.contexts[order] = self._sorted(left, n)
            below = here
        self.mean = self.foreign = self.wobble = np.zeros(n)

    @staticmethod
    def _sorted(table: dict[tuple[int, ...], np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
        if not table:
            return np.zeros(0, np.uint64), np.zeros((0, n), np.float32)
        keys = np.zeros(len(table), dtype=np.uint64)
        for k, gram in enumerate(table):
            if gram:
                keys[k] = hashes(np.array(gram, dtype=np.uint64), len(gram))[0]
        order = np.argsort(keys)
        values = np.log(np.array(list(table.values())))
        return keys[order], values[order].astype(np.float32)

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, _ = table
        if not len(known):
            return np.zeros(len(keys), dtype=np.intp), np.zeros(len(keys), dtype=bool)
        at = np.searchsorted(known, keys)
        at[at == len(known)] = 0
        return at, known[at] == keys

    def logs(self, codes: np.ndarray) -> np.ndarray:
        """Log-probability of each character from the second on, by language."""
        return self._logs(np.concatenate((np.full(ORDER - 1, SPACE, dtype=np.uint64), codes)), np.arange(1, len(codes)) + ORDER - 1, ORDER)

    def _logs(self, codes: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
        if order == 0:
            return np.tile(self.floor, (len(at), 1)).astype(np.float32)
        grams = hashes(codes, order)
        row, known = self._find(self.tables[order], grams[at - order + 1])
        out = self.tables[order][1][row] if len(self.tables[order][1]) else np.zeros((len(at), len(self.languages)), np.float32)
        missing = np.flatnonzero(~known)
        if len(missing):
            where = at[missing]
            value = self._logs(codes, where, order - 1)
            context = hashes(codes, order - 1)[where - order + 1] if order > 1 else np.zeros(len(where), np.uint64)
            row, known = self._find(self.contexts[order], context)
            value[known] += self.contexts[order][1][row[known]]
            out[missing] = value
        return out

    def entropies(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each text's cross-entropy per character by language, and its number of characters scored."""
        logs = self.logs(codes)
        starts = np.concatenate(([0], ends[:-1]))
        n = ends - starts - 1
        logs[ends[:-1] - 1] = 0  # a text's first space is given
        logs = np.concatenate((logs, np.zeros((1, logs.shape[1]), np.float32)))
        return -np.add.reduceat(logs, starts, axis=0, dtype=np.float64) / np.maximum(n, 1)[:, None], n

    def calibrate(self, entropies: np.ndarray, n: np.ndarray, language: np.ndarray) -> None:
        """Where the cross-entropy of each language's texts lies, and where that of other languages' texts lies.

        ``wobble`` is the spread in short texts, which length evens out.
        """
        k, strange = len(self.languages), -float(self.floor[0])
        self.mean, self.foreign, self.wobble = np.full(k, strange), np.full(k, strange), np.ones(k)
        for j in range(k):
            own, other = (language == j) & (n > 1), (language != j) & (n > 1)
            if own.any():
                h, w = entropies[own, j], n[own]
                self.mean[j] = np.average(h, weights=w)
                self.wobble[j] = max(0.5, np.sqrt(np.mean((h - self.mean[j]) ** 2 * np.minimum(w, 100))))
            if other.any():
                self.foreign[j] = np.average(entropies[other, j], weights=n[other])

    def judge(self, entropies: np.ndarray, n: np.ndarray, share: float, sigmas: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, score from 0 to 1, and whether the text is rejected."""
        best = entropies.argmin(axis=1)
        weight = np.minimum(n, 32)[:, None]
        away = np.exp(-(entropies - entropies.min(axis=1, keepdims=True)) * weight)
        score = 1.0 / away.sum(axis=1)
        gap = np.maximum(0, self.foreign[best] - self.mean[best])
        bound = self.mean[best] + share * gap + sigmas * self.wobble[best] / np.sqrt(np.maximum(n, 1))
        least = np.sort(entropies, axis=1)[:, :2]
        # No language stands out: foreign words or codes in a text of a known language don't make it strange.
        level = least[:, -1] - least[:, 0] < MARGIN * gap
        return best, score, (least[:, 0] > bound) & level


def fit(learnable: DataFrame, text: str, language: str, rows: int = SAMPLE_ROWS) -> Model | None:
    """A model from at most ``rows`` rows for each language: those whose texts have the smallest hashes.

    Null if no row has both a text and a language.
    """
    marked = learnable.select(F.col(language).cast("string").alias("l"), F.col(text).cast("string").alias("t")).where("l IS NOT NULL AND t IS NOT NULL")
    chosen = marked.select("l", F.xxhash64("t").alias("h")).distinct()
    for part in (F.pmod("h", F.lit(64)), F.lit(0)):  # first in parts, so that no language gathers in one task
        order = Window.partitionBy("l", part).orderBy("h")
        chosen = chosen.withColumn("k", F.row_number().over(order)).where(F.col("k") <= rows).select("l", "h")
    sample = marked.withColumn("h", F.xxhash64("t")).join(F.broadcast(chosen), ["l", "h"]).dropDuplicates(["l", "h"])
    sample = checkpointed(sample)  # bounded by rows and languages
    letters = bpe.classes()["letter"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        characters, found = Characters(letters), defaultdict(int)
        for batch in slices(batches, "t"):
            for lang, t in zip(batch.column("l").to_pylist(), batch.column("t").to_pylist()):
                codes, _ = characters.read([t])
                codes = np.concatenate((np.full(ORDER - 1, SPACE, dtype=np.uint64), codes))
                shape = np.lib.stride_tricks.sliding_window_view(codes, ORDER)[1:]
                grams, n = np.unique(shape, axis=0, return_counts=True)
                for g, c in zip(map(tuple, grams.tolist()), n.tolist()):
                    found[lang, g] += c
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found]), pa.array([list(k[1]) for k in found], pa.list_(pa.int64())), pa.array(list(found.values()), pa.int64())], names=["l", "g", "c"])

    learnt = sample.where(F.pmod("h", F.lit(CALIBRATION)) != 0).mapInArrow(count, "l string, g array<long>, c long").groupBy("l", "g").agg(F.sum("c").alias("c")).collect()
    languages = sorted({r["l"] for r in learnt})
    if not languages:
        return None
    counts: dict[tuple[int, ...], np.ndarray] = {}
    place = {name: k for k, name in enumerate(languages)}
    for r in learnt:
        counts.setdefault(tuple(r["g"]), np.zeros(len(languages)))[place[r["l"]]] = r["c"]
    model = Model(languages, {ORDER: counts})

    def entropies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        characters = Characters(letters)
        for batch in slices(batches, "t"):
            h, n = model.entropies(*characters.read(batch.column("t").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("l"), pa.array(h.tolist(), pa.list_(pa.float64())), pa.array(n, pa.int64())], names=["l", "e", "n"])

    held = [r for r in sample.where(F.pmod("h", F.lit(CALIBRATION)) == 0).mapInArrow(entropies, "l string, e array<double>, n long").collect() if r["l"] in place]
    model.calibrate(np.array([r["e"] for r in held]).reshape(len(held), len(languages)), np.array([r["n"] for r in held], dtype=np.int64), np.array([place[r["l"]] for r in held], dtype=np.int64))
    return model


def identify(df: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = (), share: float = 0.75, sigmas: float = 3.0) -> DataFrame:
    """The language of each text.

    Returns the columns ``keep`` and ``lang_pred``, ``score`` (0 to 1) and ``rejected``.  A text that
    is null or has no letter gets ``und``, score 0 and is rejected, as is every text if nothing could
    be learnt.  A text is also rejected if its cross-entropy lies beyond ``share`` of the way from what
    is usual in its language to what other languages' texts show there, and ``sigmas`` deviations of
    texts of its length on top, and no language stands out; ``lang_pred`` still names the nearest then.  Repeated rows are
    judged alike and kept; other columns are ignored, whatever their names; an empty table gives an
    empty result.
    """
    letters = bpe.classes()["letter"]
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + ["lang_pred string, score double, rejected boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, characters = shared.value, Characters(letters)
        for batch in slices(batches, "__text", 1 << 19):
            names, score, rejected = judged(own, characters, batch.column("__text").to_pylist(), share, sigmas)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], names=[*keep, "lang_pred", "score", "rejected"])

    return df.select(*keep, df[text].cast("string").alias("__text")).mapInArrow(run, schema)


def judged(model: Model | None, characters: Characters, texts: list[str | None], share: float, sigmas: float) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and whether it is rejected, of each text."""
    if model is None:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
    codes, ends = characters.read(texts)
    lettered = np.diff(ends, prepend=0) > 2
    best, score, rejected = model.judge(*model.entropies(codes, ends), share, sigmas)
    return [model.languages[b] if some else UNKNOWN for b, some in zip(best, lettered)], np.where(lettered, score, 0.0), rejected | ~lettered


def accepted(df: DataFrame, model: Model | None, text: str = "text", share: float = 0.75, sigmas: float = 3.0) -> DataFrame:
    """The rows of ``df`` whose text is not rejected (see :func:`identify`), with all their columns."""
    letters = bpe.classes()["letter"]
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def judge() -> Callable[[list[str | None]], np.ndarray]:
        own, characters = shared.value, Characters(letters)

        def keep(texts: list[str | None]) -> np.ndarray:
            out, start = [], 0
            while start < len(texts):  # half a megabyte at once
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size < 1 << 19):
                    size += len(texts[stop] or "")
                    stop += 1
                out.append(~judged(own, characters, texts[start:stop], share, sigmas)[2])
                start = stop
            return np.concatenate(out)

        return keep

    return accepted_rows(df, text, judge)


def remainder(column: str, divisor: int) -> Column:
    """crc32 of a column as text, modulo ``divisor``; rows without a value have none."""
    return F.crc32(F.col(column).cast("string")) % divisor
