"""Parametric leaves by closed-form aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parameters(df: DataFrame, column: str, groups: list[str] = ()) -> DataFrame:
    """Maximum-likelihood parameters of several families from one aggregation.

    Gaussian (mean, deviation), log-normal (of the logarithms of positive values), exponential and
    Poisson (rate), geometric (p, of values from 1), Bernoulli (p, share of values above 0), gamma
    (shape and scale by moments), uniform (least, largest).
    """
    x = F.col(column).cast("double")
    log = F.when(x > 0, F.log(x))
    mean, var = F.avg(x), F.var_pop(x)
    return df.groupBy(*groups).agg(
        F.count(x).alias("n"), mean.alias("mean"), F.stddev_pop(x).alias("deviation"),
        F.avg(log).alias("log_mean"), F.stddev_pop(log).alias("log_deviation"),
        (1 / F.nullif(mean, F.lit(0.0))).alias("rate"), F.avg((x > 0).cast("double")).alias("p_positive"),
        (mean * mean / F.nullif(var, F.lit(0.0))).alias("shape"), (var / F.nullif(mean, F.lit(0.0))).alias("scale"),
        F.min(x).alias("least"), F.max(x).alias("largest"),
    )


def multivariate(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: means and maximum-likelihood covariances (row by row) of a multivariate Gaussian over rows without nulls."""
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).na.drop()
    return rows.agg(F.count(F.lit(1)).alias("n"), F.array(*(F.avg(c) for c in columns)).alias("mean"), F.array(*(F.array(*(F.covar_pop(a, b) for b in columns)) for a in columns)).alias("covariance"))


def categorical(df: DataFrame, column: str, alpha: float = 0.0) -> DataFrame:
    """(value, p) of a column's values, each with ``alpha`` rows more; nulls are left out."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg((F.count(F.lit(1)) + alpha).alias("n"))
    total = counts.agg(F.sum("n").alias("__total"))  # one row
    return counts.join(F.broadcast(total)).select("value", (F.col("n") / F.col("__total")).alias("p"))


def gaussian_density(x: Column, mean: Column, deviation: Column) -> Column:
    z = (x - mean) / deviation
    return F.exp(-z * z / 2) / (deviation * 2.5066282746310002)


def width_histogram(df: DataFrame, column: str, low: float, high: float, bins: int, alpha: float = 0.0) -> DataFrame:
    """Density of equally wide bins; ``alpha`` is added to each bin's count.  Values outside are left out."""
    inside = df.where(F.col(column).between(low, high))
    code = F.least(F.floor((F.col(column) - low) / ((high - low) / bins)).cast("int"), F.lit(bins - 1))
    counts = inside.groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("code"))
    filled = grid.join(counts, "code", "left").na.fill(0, ["n"])
    total = filled.agg((F.sum("n") + alpha * bins).alias("__t"))  # one row
    width = (high - low) / bins
    return filled.join(F.broadcast(total)).select("code", "n", ((F.col("n") + alpha) / F.nullif(F.col("__t") * width, F.lit(0.0))).alias("density"))
