"""Predicates over columns and what ranges cover of bins."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {
    "=": lambda c, v: c == v,
    "==": lambda c, v: c == v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "in": lambda c, v: c.isin(list(v)),
    "not in": lambda c, v: ~c.isin(list(v)),
    "is null": lambda c, v: c.isNull(),
    "is not null": lambda c, v: c.isNotNull(),
}


def atom(column: str | Column, operator: str, value: object = None) -> Column:
    """One comparison of a column with a literal; nulls never match but for ``is null``."""
    return _COMPARE[operator.lower()](F.col(column) if isinstance(column, str) else column, value)


def conjunction(atoms: Iterable[tuple]) -> Column:
    """All atoms (column, operator[, value]) together; an empty conjunction is true."""
    return reduce(lambda a, b: a & b, (atom(*a) for a in atoms), F.lit(True))


def overlap_share(lo: Column, hi: Column, low: float, high: float) -> Column:
    """Which share of the bin (lo, hi] the range [low, high] covers, taken as evenly filled."""
    covered = F.least(hi, F.lit(float(high))) - F.greatest(lo, F.lit(float(low)))
    return F.when(hi > lo, F.greatest(F.lit(0.0), covered) / (hi - lo)).otherwise(((lo >= low) & (lo <= high)).cast("double"))


def md5_below(threshold: str, *columns: str) -> Column:
    """A deterministic Bernoulli sample: rows whose key's md5 lies below a hexadecimal prefix."""
    key = F.concat_ws("|", *(F.col(c).cast("string") for c in columns))
    return F.md5(key) < threshold


def guarded_ratio(a: Column, b: Column) -> Column:
    """a / b with 0 / 0 and x / 0 as 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)
