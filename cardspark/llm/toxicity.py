"""Toxicity by a weighted lexicon.

Texts are folded (case, homoglyphs, digits and signs that stand for letters) and one Aho-Corasick
automaton finds the lexicon's terms: whole words, and beginnings of words.  The weighted hits
outside exception phrases are set against the text's length and turned into a score by a logistic
curve.  Terms, weights and curve are learnt from a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardspark.llm.common import accepted_rows, checkpointed, slices

#: Labelled rows of each class that are learnt from: those whose texts have the smallest hashes.
SAMPLE_ROWS = 4000
#: Shortest and longest beginning of a word that can be a term; whole words of any length can.
SHORTEST, LONGEST = 4, 12
#: Rows of the toxic class that must have a term: so many, or one in so many of a smaller sample (two at least).
LEAST_ROWS, LEAST_SHARE = 8, 10
#: A term's weight sets a low estimate of its share of toxic rows against a high one of the other rows', so many
#: standard errors apart from what was counted; the least weight.
ERRORS, LEAST_WEIGHT = 2.5, 1.0
#: Terms that a task counts before it hands on their sums.
HELD_TERMS = 100_000
#: What a longer term's weight must exceed that of a kept beginning by.
GAIN = 0.7
#: Characters that look like Latin letters, and digits and signs that stand for letters.
HOMOGLYPHS = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "υ": "u", "ѵ": "v", "х": "x", "у": "y", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_LETTER = r"[^\W\d_]"
_STANDS_FOR = re.compile(rf"(?<={_LETTER})[013457@$]+(?={_LETTER})|(?<![\w@$])[013457@$](?={_LETTER}{_LETTER})|(?<={_LETTER}{_LETTER})[013457](?!\w)")
_GLYPHS = re.compile("[" + "".join(HOMOGLYPHS) + "]")
_NARROW = re.compile("[\U0000ff01-\U0000ff5e\U0001d400-\U0001d7ff\U000024b6-\U000024e9​-‏⁠﻿­]")
_SIGNS = re.compile("[013457@$]")
#: What does not count as part of a word becomes one separator.
_BETWEEN = re.compile(r"(?:[^\w]|_)+")


def folded(text: str) -> str:
    """Words in lower case between single spaces, with look-alikes and stand-ins as letters."""
    if not text.isascii():
        if _NARROW.search(text):
            text = re.sub("[​-‏⁠﻿­]", "", unicodedata.normalize("NFKC", text))
        text = text.lower()
        if _GLYPHS.search(text) and re.search("[a-z]", text):
            text = _GLYPHS.sub(lambda m: HOMOGLYPHS[m[0]], text)
    else:
        text = text.lower()
    if _SIGNS.search(text):
        text = _STANDS_FOR.sub(lambda m: "".join(DIGITS[c] for c in m[0]), text)
    return " " + _BETWEEN.sub(" ", text).strip() + " "


@dataclass
class Lexicon:
    """Terms with weights; a term begins with a space, and one for a whole word ends with one."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    #: Logistic curve over (1, log of the weighted hits, weighted hits per word).
    curve: tuple[float, ...] = (-3.0, 3.0, 1.0)
    _machine: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.weights, self.exceptions, self.curve

    def __setstate__(self, state):
        self.weights, self.exceptions, self.curve = state
        self._machine = None

    def hits(self, words: str) -> tuple[float, list[str]]:
        """Sum of the weights of the terms in a folded text, and the terms."""
        if self._machine is None:
            import ahocorasick

            machine = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                machine.add_word(term, (term, weight))
            for phrase in self.exceptions:
                machine.add_word(f" {phrase} ", (f" {phrase} ", None))
            machine.make_automaton()
            self._machine = machine
        if not len(self._machine):
            return 0.0, []
        found = [(end - len(term) + 1, end, term, weight) for end, (term, weight) in self._machine.iter(words)]
        excused = [(a, b) for a, b, _, weight in found if weight is None]
        held = [(a, term, weight) for a, b, term, weight in found if weight is not None and not any(x <= a and min(b, y) == b for x, y in excused)]
        best: dict[int, tuple[float, str]] = {}
        for a, term, weight in held:  # a word counts once, by its heaviest term
            best[a] = max(best.get(a, (0.0, "")), (weight, term))
        return sum(w for w, _ in best.values()), [t.strip() for _, t in best.values()]

    def features(self, words: str) -> tuple[float, float, float]:
        total, _ = self.hits(words)
        return 1.0, math.log1p(total), total / max(1, words.count(" ") - 1)

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(features @ np.array(self.curve), -30, 30)))


def terms(words: str) -> set[str]:
    """What can become a term: a text's words and their beginnings."""
    out = set()
    for w in set(words.split()):
        out.update([" " + w[:k] for k in range(SHORTEST, min(len(w), LONGEST) + 1)])
        out.add(f" {w} ")
    return out


def closed(support: dict[str, int], weight: dict[str, float]) -> dict[str, float]:
    """Drops beginnings that a longer one accounts for, and longer ones that say no more than a kept beginning."""
    covered = set()
    for term in sorted(support, key=len, reverse=True):
        shorter = term[:-1]
        if shorter in support and support[term] >= 0.95 * support[shorter]:
            covered.add(shorter)
    kept: dict[str, float] = {}
    for term in sorted(support, key=len):
        known = max((kept.get(term[:k], 0.0) for k in range(2, len(term))), default=0.0)
        if term not in covered and weight[term] > known + GAIN * bool(known):
            kept[term] = weight[term]
    return kept


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Ridge logistic regression by Newton's steps."""
    weight = np.full(len(y), 1.0 / len(y))
    b = np.zeros(x.shape[1])
    ridge = np.diag([1e-4] + [1e-3] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + ridge, x.T @ (weight * (y - p)) - ridge @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(b.tolist())


def fit(documents: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", id_column: str = "doc_id", rows: int = SAMPLE_ROWS, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """A lexicon from at most ``rows`` labelled documents of each class (label 1, label 0).

    ``labels`` has the documents' ids and labels.  Rows without text, id or label teach nothing.
    Without any toxic row the lexicon is empty.  Phrases in which terms stand in rows of the other
    class, and never in toxic ones, become exceptions beside those given.
    """
    bodies = documents.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("t")).where("t IS NOT NULL")
    marks = labels.select(F.col(id_column).alias("id"), F.col(label).cast("int").alias("y")).where("y IN (0, 1)")
    # Only hashes travel; then the bounded number of chosen ids goes to the texts.
    keys = bodies.select("id", F.xxhash64("t").alias("h")).join(marks, "id")
    picked = [keys.where(F.col("y") == y).groupBy("h").agg(F.min("id").alias("id")).orderBy("h").limit(rows).select("id", F.lit(y).alias("y")) for y in (0, 1)]
    chosen = checkpointed(picked[0].unionByName(picked[1]).dropDuplicates(["id"]))
    sample = checkpointed(bodies.join(F.broadcast(chosen), "id").dropDuplicates(["id"]).select("y", "t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def out(y: int) -> pa.RecordBatch:
            own, found[y] = found[y], Counter()
            return pa.RecordBatch.from_arrays([pa.array(list(own)), pa.array([c if y else 0 for c in own.values()], pa.int64()), pa.array([0 if y else c for c in own.values()], pa.int64())], names=["term", "bad", "fine"])

        for batch in slices(batches, "t"):
            for y, t in zip(batch.column("y").to_pylist(), batch.column("t").to_pylist()):
                found[y].update(terms(folded(t)))
                if len(found[y]) > HELD_TERMS:
                    yield out(y)
        yield from (out(y) for y in (0, 1) if found[y])

    counts = sample.mapInArrow(count, "term string, bad long, fine long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("fine").alias("fine"))
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_bad, n_fine = sizes.get(1, 0), sizes.get(0, 0)
    support, weight = {}, {}
    least = min(LEAST_ROWS, max(2, n_bad // LEAST_SHARE))
    for r in counts.where(F.col("bad") >= least).where(F.col("bad") * max(1, n_fine) > F.col("fine") * max(1, n_bad)).collect():  # bounded by the sample
        low, high = (max(0.1, math.sqrt(r[k] + 0.375) + side * ERRORS / 2) ** 2 for k, side in (("bad", -1), ("fine", 1)))
        odds = math.log(low / (n_bad + 1)) - math.log(high / (n_fine + 1))
        if odds >= LEAST_WEIGHT:
            support[r["term"]], weight[r["term"]] = r["bad"], odds
    lexicon = Lexicon(closed(support, weight), exceptions)
    lexicon.exceptions = (*exceptions, *_phrases(sample, lexicon))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            x = [list(lexicon.features(folded(t))) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    seen = sample.mapInArrow(measure, "y int, x array<double>").collect()
    if n_bad and n_fine:
        lexicon.curve = _logistic(np.array([r["x"] for r in seen]), np.array([r["y"] for r in seen]))
    return lexicon


def _phrases(sample: DataFrame, lexicon: Lexicon) -> list[str]:
    """Pairs of words around terms that three or more rows of class 0 have and no toxic row."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for batch in slices(batches, "t"):
            for y, t in zip(batch.column("y").to_pylist(), batch.column("t").to_pylist()):
                words = folded(t)
                _, hit = lexicon.hits(words)
                if hit:
                    cut = words.split()
                    near = {k for k, w in enumerate(cut) if any(w.startswith(h) for h in set(hit))}
                    for p in {f"{cut[k]} {cut[k + 1]}" for k in range(len(cut) - 1) if k in near or k + 1 in near}:
                        found[p][y] += 1
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found)), *(pa.array([v[y] for v in found.values()], pa.int64()) for y in (0, 1))], names=["p", "fine", "bad"])

    both = sample.mapInArrow(pairs, "p string, fine long, bad long").groupBy("p").agg(F.sum("fine").alias("fine"), F.sum("bad").alias("bad"))
    return sorted(r["p"] for r in both.where("fine >= 3 AND bad = 0").collect())  # bounded by the sample


def score_toxicity(df: DataFrame, lexicon: Lexicon, text: str = "text", keep: tuple[str, ...] = (), threshold: float = 0.5) -> DataFrame:
    """Scores each text by the lexicon.

    Returns the columns ``keep`` and ``score`` (0 to 1), ``predicted`` (1 from ``threshold`` on) and
    ``terms`` (distinct terms found, in order).  Null and empty texts score as texts without hits.
    Repeated rows are scored alike and kept; other columns are ignored, whatever their names; an
    empty table gives an empty result.
    """
    shared = df.sparkSession.sparkContext.broadcast(lexicon)  # bounded by the sample
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + ["score double, predicted int, terms array<string>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, "__text"):
            features, found = [], []
            for t in batch.column("__text").to_pylist():
                words = folded(t or "")
                total, hit = own.hits(words)
                features.append((1.0, math.log1p(total), total / max(1, words.count(" ") - 1)))
                found.append(list(dict.fromkeys(hit)))
            score = own.score(np.array(features))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(found, pa.list_(pa.string()))], names=[*keep, "score", "predicted", "terms"])

    return df.select(*keep, df[text].cast("string").alias("__text")).mapInArrow(run, schema)


def accepted(df: DataFrame, lexicon: Lexicon, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``df`` whose text scores below ``threshold``, with all their columns."""
    shared = df.sparkSession.sparkContext.broadcast(lexicon)  # bounded by the sample

    def judge() -> Callable[[list[str | None]], np.ndarray]:
        own = shared.value
        return lambda texts: own.score(np.array([own.features(folded(t or "")) for t in texts])) < threshold

    return accepted_rows(df, text, judge)
