"""How far estimates are off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardspark.operators.encode import quantiles, value_counts
from cardspark.session import written


def q_error(estimate: Column, truth: Column) -> Column:
    """The larger of estimate / truth and truth / estimate; 1 where both are 0, and a single 0 or missing estimate counts as 1."""
    e = F.when(estimate.isNull() | F.isnan(estimate.cast("double")) | (estimate == 0), F.lit(1.0)).otherwise(estimate.cast("double"))
    t = F.when(truth == 0, F.lit(1.0)).otherwise(truth.cast("double"))
    return F.when((estimate == 0) & (truth == 0), F.lit(1.0)).otherwise(F.greatest(e / t, t / e))


def q_error_report(df: DataFrame, estimate: str, truth: str) -> DataFrame:
    """Percentiles and mean of the q-error, and how many queries have no estimate.

    The q-errors (a row for each query) are written first: so estimates and true counts are worked out once,
    and all parts of the report see the same last digits.
    """
    q = written(df.select(q_error(F.col(estimate), F.col(truth)).alias("q"), F.col(estimate).isNull().cast("long").alias("failed")))
    parts = quantiles(value_counts(q, "q"), [0.5, 0.9, 0.95, 0.99, 1.0])
    one = q.agg(F.count(F.lit(1)).alias("n_queries"), F.sum("failed").alias("n_failed"), F.avg("q").alias("mean")).join(F.broadcast(parts))  # one row each
    return one.select("n_queries", "n_failed", *(F.col("p")[k].alias(name) for k, name in enumerate(("p50", "p90", "p95", "p99", "max"))), "mean")


def group_report(estimate: DataFrame, truth: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Relative errors of estimated groups, share of true groups found, and groups that do not exist."""
    e = estimate.select(*groups, F.col(value).alias("__e"), F.lit(1).alias("__in_e"))
    t = truth.select(*groups, F.col(value).alias("__t"), F.lit(1).alias("__in_t"))
    both = e.join(t, groups, "full_outer")
    error = F.when(F.col("__in_e").isNotNull() & F.col("__in_t").isNotNull(), F.abs(F.col("__e") - F.col("__t")) / F.abs(F.col("__t")))
    return both.agg(F.avg(error).alias("mean_error"), F.max(error).alias("max_error"), (F.count(error) / F.count("__in_t")).alias("completeness"), F.count(F.when(F.col("__in_t").isNull(), 1)).alias("false_groups"))


def interval_report(df: DataFrame, lo: str, hi: str, truth: str, estimate: str) -> DataFrame:
    """How often intervals hold the truth, and their mean length relative to the estimate."""
    hit = F.col(truth).between(F.col(lo), F.col(hi)).cast("double")
    return df.agg(F.avg(hit).alias("hit_rate"), F.avg((F.col(hi) - F.col(lo)) / F.abs(F.col(estimate))).alias("mean_length"))


def sampled_deviations(sample: DataFrame, rows: int, condition: Column, value: str) -> DataFrame:
    """Estimates and deviations of COUNT, AVG and SUM of ``value`` under a condition, from a sample's own spread.

    A count's deviation is binomial; an average's is the spread over the root of its rows; a sum is their
    product, taken as independent.
    """
    x = F.when(condition, F.col(value).cast("double"))
    one = sample.agg(F.count(F.lit(1)).alias("m"), F.count(F.when(condition, 1)).alias("k"), F.avg(x).alias("avg_est"), F.stddev_samp(x).alias("s"))
    p = F.col("k") / F.col("m")
    one = one.select("*", (p * rows).alias("count_est"), (F.sqrt(p * (1 - p) / F.col("m")) * rows).alias("count_sd"), (F.col("s") / F.sqrt("k")).alias("avg_sd"))
    a, b = F.pow("count_sd", F.lit(2)), F.pow("avg_sd", F.lit(2))
    c, m = F.pow("count_est", F.lit(2)), F.pow("avg_est", F.lit(2))
    return one.select("count_est", "count_sd", "avg_est", "avg_sd", (F.col("count_est") * F.col("avg_est")).alias("sum_est"), F.sqrt((a + c) * (b + m) - c * m).alias("sum_sd"))
