"""Sampling estimators over conditional tables: progressive sampling and likelihood weighting.

Both walk the network's variables parents first and keep one weight for each sample row; a row's
draws follow from its number and the seed, so a run can be repeated anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardspark.operators.encode import bounded


def _lines(table: DataFrame, allowed: Column) -> DataFrame:
    """Per parent state: mass of the allowed values, and they themselves with cumulated shares of that mass."""
    kept = table.withColumn("__in", F.when(allowed, F.col("p")).otherwise(F.lit(0.0)))
    order = Window.partitionBy("parent").orderBy("value")
    upto = kept.withColumn("__hi", F.sum("__in").over(order))
    return upto.groupBy(F.col("parent").alias("__parent")).agg(F.sum("__in").alias("__mass"), F.sort_array(F.collect_list(F.when(F.col("__in") > 0, F.struct("__hi", "value")))).alias("__lines"))


def progressive_sample(spark: SparkSession, n: int, tables: list[tuple[str, str | None, DataFrame]], conditions: dict[str, Column], seed: int = 0) -> DataFrame:
    """``n`` rows drawn under conditions on ``value``, with the weight that each stands for.

    At each variable a row's weight is multiplied by the mass of the allowed values given its
    parent's drawn value, and one of them is drawn.  The mean weight estimates the probability of
    all conditions together.  Model tables have one row per state.
    """
    rows = spark.range(n).withColumn("weight", F.lit(1.0))
    for k, (variable, parent, table) in enumerate(tables):
        lines = _lines(table, conditions.get(variable, F.lit(True)))
        lines = F.broadcast(bounded(lines))  # a line for each state of the parent: rows stay where they are
        rows = rows.join(lines, F.col(parent).eqNullSafe(F.col("__parent")), "left") if parent else rows.join(lines)
        drawn = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 40)) / float(1 << 40) * F.col("__mass")
        rows = rows.withColumn("__u", drawn).withColumn("weight", F.coalesce(F.col("weight") * F.col("__mass"), F.lit(0.0)))
        hit = F.filter("__lines", lambda x: x["__hi"] > F.col("__u"))
        value = F.coalesce(F.get(hit, F.lit(0))["value"], F.get("__lines", F.size("__lines") - 1)["value"])
        rows = rows.withColumn(variable, value).drop("__lines", "__parent", "__mass", "__u")
    return rows


def estimated_probability(sample: DataFrame) -> DataFrame:
    """Mean weight and its standard error."""
    return sample.agg(F.avg("weight").alias("p"), (F.stddev_samp("weight") / F.sqrt(F.count(F.lit(1)))).alias("error"))


def weighted_expectation(sample: DataFrame, feature: Column) -> DataFrame:
    """E[feature * 1(conditions)] and the conditional mean."""
    return sample.agg(F.avg(F.col("weight") * feature).alias("expectation"), (F.sum(F.col("weight") * feature) / F.nullif(F.sum("weight"), F.lit(0.0))).alias("mean"))
