"""URL filtering by host and path rules and a weighted URL vocabulary.

Terms are counted by one Aho-Corasick automaton over the whole URL.  A hit counts only between
characters that are no ASCII letters or digits.  One strict term, or ``soft_limit`` distinct soft
terms, reject a URL; rules for hosts and paths come before.
"""

from __future__ import annotations

import functools
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Terms that reject alone, and terms that reject together.
STRICT_TERMS = ("adult", "casino", "escorts", "gambling", "hentai", "malware", "phishing", "poker", "porn", "porno", "sex", "spam", "viagra", "warez", "xxx")
SOFT_TERMS = ("ads", "bets", "betting", "bonus", "cheap", "clicks", "cracked", "dating", "farm", "free", "jackpot", "keygen", "loans", "lottery", "pills", "popups", "promo", "replica", "slots", "torrent", "track", "tracker", "win", "winner")

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
ALNUM = frozenset(string.ascii_letters + string.digits)


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path; both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest)) if found else 0
    host, rest = rest[:end], rest[end:]
    return host.translate(LOWER), rest.partition("#")[0].partition("?")[0]


@functools.cache
def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for kind, terms in ((False, soft), (True, strict)):
        for term in terms:
            machine.add_word(term, (term, kind))
    machine.make_automaton()
    return machine


def hits(url: str | None, machine) -> tuple[int, int]:
    """How many distinct strict and soft terms stand in the URL."""
    low = (url or "").translate(LOWER)
    found = set()
    for end, (term, kind) in machine.iter(low):
        before, after = end - len(term), end + 1
        if (before < 0 or low[before] not in ALNUM) and (after >= len(low) or low[after] not in ALNUM):
            found.add((term, kind))
    strict = sum(kind for _, kind in found)
    return strict, len(found) - strict


def longest_rule(host: str, path: str, rules: tuple[tuple[str, str, str], ...]) -> tuple[str, str] | None:
    """The longest rule that fits, with its verdict; rules are tried longest first."""
    for own, start, verdict in rules:
        if (host == own or host.endswith("." + own)) and path.startswith(start):
            return own + start, verdict
    return None


def filter_urls(
    df: DataFrame,
    rules: tuple[tuple[str, str, str], ...],
    url: str = "url",
    keep: tuple[str, ...] = (),
    strict: tuple[str, ...] = STRICT_TERMS,
    soft: tuple[str, ...] = SOFT_TERMS,
    soft_limit: int = 2,
) -> DataFrame:
    """Judges each URL by ``rules`` (host, path, verdict), else by the vocabulary.

    Returns the columns ``keep`` and ``host``, ``path``, ``rule`` (null if none fits), ``verdict``
    (allow or block), ``strict_hits`` and ``soft_hits`` (distinct terms).  A rule fits its host and
    all subdomains where the URL's path starts with the rule's; the longest wins, the first given
    of equally long ones.  Null URLs and those without ``://`` have an empty host and path; a null or
    empty URL is allowed.  Repeated rows are judged alike and kept; other columns are ignored,
    whatever their names; an empty table gives an empty result.
    """
    ordered = tuple(sorted(rules, key=lambda r: -len(r[0] + r[1])))
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + ["host string, path string, rule string, verdict string, strict_hits int, soft_hits int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(strict, soft)
        for batch in batches:
            rows = []
            for u in batch.column("__url").to_pylist():
                host, path = host_and_path(u)
                rule = longest_rule(host, path, ordered)
                hard, mild = hits(u, machine)
                verdict = rule[1] if rule else "block" if hard or mild >= soft_limit else "allow"
                rows.append((host, path, rule and rule[0], verdict, hard, mild))
            kinds = [pa.string()] * 4 + [pa.int32()] * 2
            made = [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 6, kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], names=[*keep, "host", "path", "rule", "verdict", "strict_hits", "soft_hits"])

    return df.select(*keep, df[url].cast("string").alias("__url")).mapInArrow(run, schema)
