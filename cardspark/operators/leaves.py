"""Histogram leaves of sum-product networks: distributions of single columns, and what ranges hold of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardspark.operators.encode import cumulated, value_counts


#: Values beyond which a leaf has bins instead of one line for each.
MOST_VALUES = 10_000


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Distinct values with probability and cumulated probability; nulls count for the total only."""
    total = df.agg(F.count(F.lit(1)).alias("__total"))  # one row
    rows = cumulated(value_counts(df, column)).join(F.broadcast(total))
    return rows.select("value", "n", (F.col("n") / F.col("__total")).alias("p"), (F.col("upto") / F.col("__total")).alias("upto"))


def adaptive_histogram(df: DataFrame, column: str, bins: int = MOST_VALUES) -> DataFrame:
    """As :func:`histogram` for up to ``bins`` values; beyond, bins of equal width, each standing at the mean of its values.

    Bins are cumulated by their numbers: a mean's last digits depend on the order in which parts arrive, so
    two evaluations of it may differ, and a bin would lie in another stretch than the one it was counted in.
    """
    one = df.agg(F.approx_count_distinct(column, 0.02).alias("d"), F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi")).first()
    if one["d"] <= bins or one["hi"] == one["lo"]:
        return histogram(df, column)
    x = F.col(column).cast("double")
    # The least value's last digits may differ as well: what lies below the one found belongs to the first bin.
    code = F.greatest(F.lit(0), F.least(F.floor((x - one["lo"]) / ((one["hi"] - one["lo"]) / bins)), F.lit(bins - 1)))
    binned = df.where(x.isNotNull()).groupBy(code.alias("__code")).agg(F.avg(x).alias("__mean"), F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("__total"))  # one row
    rows = cumulated(binned.withColumnRenamed("__code", "value")).join(F.broadcast(total))
    return rows.select(F.col("__mean").alias("value"), "n", (F.col("n") / F.col("__total")).alias("p"), (F.col("upto") / F.col("__total")).alias("upto"))


def distinct_values(leaf: DataFrame, condition: Column) -> DataFrame:
    """The values of a leaf inside a range, null never."""
    return leaf.where(condition & F.col("value").isNotNull()).select("value")


def likelihood(leaf: DataFrame, values: DataFrame) -> DataFrame:
    """(value, p) of single values; one that the leaf has not seen has 0, null has no likelihood."""
    return values.select("value").where("value IS NOT NULL").join(leaf.select("value", "p"), "value", "left").na.fill(0.0, ["p"])


def narrowed(ranges: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Intersection of two ranges (low, high, low_open, high_open; null is unbounded) for each group row; an empty one is left out."""
    o = other.select(*keys, *(F.col(c).alias(f"__{c}") for c in ("low", "high", "low_open", "high_open")))
    both = ranges.join(o, keys, "left")

    def end(name: str, pick, wins) -> tuple[Column, Column]:
        a, b = F.col(name), F.col(f"__{name}")
        open_a, open_b = F.coalesce(f"{name}_open", F.lit(False)), F.coalesce(f"__{name}_open", F.lit(False))
        return pick(a, b), F.when(b.isNull(), open_a).when(a.isNull(), open_b).when(a == b, open_a | open_b).when(wins(a, b), open_a).otherwise(open_b)

    (low, low_open), (high, high_open) = end("low", F.greatest, lambda a, b: a > b), end("high", F.least, lambda a, b: a < b)
    out = both.select(*keys, low.alias("low"), high.alias("high"), low_open.alias("low_open"), high_open.alias("high_open"))
    return out.where("low IS NULL OR high IS NULL OR low < high OR (low = high AND NOT low_open AND NOT high_open)")


def moments(df: DataFrame, column: str) -> DataFrame:
    """Means of x, 1/x, x^2 and 1/x^2, and the share of nulls."""
    x = F.col(column).cast("double")
    inverse = F.when(x != 0, 1 / x)
    return df.agg(F.avg(x).alias("mean"), F.avg(inverse).alias("mean_inverse"), F.avg(x * x).alias("mean_square"), F.avg(inverse * inverse).alias("mean_inverse_square"), F.avg(F.col(column).isNull().cast("double")).alias("null_share"))


def interval(low: object, high: object, low_open: bool = False, high_open: bool = False, column: str = "value") -> Column:
    """Whether a leaf's value lies in an interval with open or closed ends; an end of None is unbounded."""
    value, inside = F.col(column), F.lit(True)
    if low is not None:
        inside = inside & (value > low if low_open else value >= low)
    if high is not None:
        inside = inside & (value < high if high_open else value <= high)
    return inside


def leaf_probability(leaf: DataFrame, condition: Column) -> DataFrame:
    return leaf.agg(F.coalesce(F.sum(F.when(condition, F.col("p"))), F.lit(0.0)).alias("p"))


def leaf_expectation(leaf: DataFrame, condition: Column) -> DataFrame:
    """Expectations of x, 1/x and x^2 where the condition holds, and 0 elsewhere."""
    x, p = F.col("value").cast("double"), F.col("p")
    return leaf.where(condition).agg(F.coalesce(F.sum(x * p), F.lit(0.0)).alias("e_x"), F.coalesce(F.sum(F.when(x != 0, p / x)), F.lit(0.0)).alias("e_inverse"), F.coalesce(F.sum(x * x * p), F.lit(0.0)).alias("e_square"))


def conditional_moments(df: DataFrame, column: str, condition: Column) -> DataFrame:
    """Mean, deviation, rows and their share, where a condition holds."""
    x = F.when(condition, F.col(column))
    return df.agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("deviation"), F.count(x).alias("n"), (F.count(x) / F.count(F.lit(1))).alias("p"))
