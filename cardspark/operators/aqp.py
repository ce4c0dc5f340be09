"""Approximate aggregates from a deterministic sample, with confidence intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the 95 % quantile of the normal distribution (90 % two-sided intervals).
Z = 1.6448536269514722


def estimates(sample: DataFrame, rate: float, features: Column, groups: list[str] = (), weight: Column | None = None) -> DataFrame:
    """COUNT, SUM and AVG of ``features`` by group, each with a 90 % interval.

    Rows of the sample stand for ``1 / rate`` rows, times ``weight`` if one is given.  The deviation
    of a count is that of a Bernoulli sample; that of an average is the sample's over the root of its
    rows; a sum is the product of both, taken as independent.
    """
    w = F.lit(1.0) if weight is None else weight
    x = features.cast("double")
    some = F.when(x.isNotNull(), w)
    base = sample.groupBy(*groups).agg(F.sum(w).alias("__w"), F.sum(some).alias("__wx"), F.sum(w * x).alias("__s"), F.sum(w * x * x).alias("__s2"), F.count(x).alias("__n"))
    known = F.nullif(F.col("__wx"), F.lit(0.0))
    mean = F.col("__s") / known
    spread = F.sqrt(F.greatest(F.col("__s2") / known - mean * mean, F.lit(0.0)) / F.nullif(F.col("__n"), F.lit(0)))
    count_sd = F.sqrt(F.col("__w") * (1 - rate)) / rate
    known = F.coalesce(known, F.lit(0.0)) / rate
    sum_sd = F.sqrt((F.pow(count_sd, F.lit(2)) + known * known) * (spread * spread + mean * mean) - known * known * mean * mean)
    out = base.select(*groups, (F.col("__w") / rate).alias("count_est"), (F.col("__s") / rate).alias("sum_est"), mean.alias("avg_est"), count_sd.alias("count_sd"), sum_sd.alias("sum_sd"), spread.alias("avg_sd"))
    for kind in ("count", "sum", "avg"):
        out = out.withColumn(f"{kind}_lo", F.col(f"{kind}_est") - Z * F.col(f"{kind}_sd")).withColumn(f"{kind}_hi", F.col(f"{kind}_est") + Z * F.col(f"{kind}_sd"))
    return out


def what_if(condition: Column, percent: float) -> Column:
    """Weight of a row when the rows that meet a condition become more (or, below 0, fewer) by some percent."""
    return F.when(condition, F.lit(1.0 + percent / 100.0)).otherwise(F.lit(1.0))


def combined(sample: DataFrame, rate: float, terms: list[tuple[str, Column]], groups: list[str] = (), kind: str = "sum") -> DataFrame:
    """Sums (or with ``kind`` "avg" averages) of several features, added and subtracted; each ignores its own nulls only.

    ``terms`` are ("+" or "-", feature).  Terms are taken as independent for the deviation.
    """
    out = None
    for k, (_, feature) in enumerate(terms):
        one = estimates(sample, rate, feature, groups).select(*groups, F.col(f"{kind}_est").alias(f"__e{k}"), F.col(f"{kind}_sd").alias(f"__s{k}"))
        out = one if out is None else (out.join(one, list(groups)) if groups else out.join(F.broadcast(one)))  # one row without groups
    total = sum((F.col(f"__e{k}") if sign == "+" else -F.col(f"__e{k}") for k, (sign, _) in enumerate(terms)), F.lit(0.0))
    return out.select(*groups, total.alias(f"{kind}_est"), F.sqrt(sum((F.pow(f"__s{k}", F.lit(2)) for k in range(len(terms))), F.lit(0.0))).alias(f"{kind}_sd"))
