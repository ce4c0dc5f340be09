"""Sum-product models as relations.

Columns that hardly depend on each other are split into groups (a product); within a group of
several columns the rows are clustered (a sum over clusters) and the columns of a cluster are taken
as independent (products of histogram leaves).  The model is two relations: ``leaves``
(group, cluster, attribute, value, n) and ``clusters`` (group, cluster, weight).  Both are sums of
counts, so models of parts of the rows that share their centres add up to the model of all rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardspark.operators.stats import mutual_information
from cardspark.streaming.incremental import nearest_center


@dataclass(frozen=True)
class Structure:
    """Groups of columns, and the centres of each group's clusters."""

    groups: tuple[tuple[str, ...], ...]
    centers: tuple[tuple[tuple[float, ...], ...], ...]


def column_groups(df: DataFrame, columns: list[str], threshold: float) -> list[list[str]]:
    """Connected columns: pairs whose mutual information exceeds ``threshold`` stay together."""
    group = {c: {c} for c in columns}
    for r in mutual_information(df, columns).where(F.col("mi") > threshold).collect():  # one row per pair of columns
        joined = group[r["a"]] | group[r["b"]]
        for c in joined:
            group[c] = joined
    return sorted({tuple(sorted(g)) for g in group.values()})


def learn_structure(df: DataFrame, columns: list[str], threshold: float = 0.01, clusters: int = 2, seed: int = 17) -> Structure:
    groups, centers = column_groups(df, columns, threshold), []
    for g in groups:
        if len(g) == 1:
            centers.append((tuple([0.0]),))
            continue
        rows = VectorAssembler(inputCols=list(g), outputCol="__x", handleInvalid="skip").transform(df.select(*g))
        model = KMeans(k=clusters, seed=seed, featuresCol="__x", predictionCol="__c").fit(rows)
        centers.append(tuple(tuple(float(x) for x in c) for c in model.clusterCenters()))
    return Structure(tuple(map(tuple, groups)), tuple(centers))


def fit(df: DataFrame, structure: Structure) -> DataFrame:
    """Leaves of the model: how often each value of a column occurs in each cluster; one pass over the rows."""
    each = []
    for k, (columns, centers) in enumerate(zip(structure.groups, structure.centers)):
        cluster = nearest_center(list(columns), list(centers)) if len(centers) > 1 else F.lit(0)
        each += [F.struct(F.lit(k).alias("group"), cluster.alias("cluster"), F.lit(c).alias("attribute"), F.col(c).cast("double").alias("value")) for c in columns]
    rows = df.select(F.explode(F.array(*each)).alias("x")).select("x.*")
    return rows.groupBy("group", "cluster", "attribute", "value").agg(F.count(F.lit(1)).alias("n"))


def updated(leaves: DataFrame, more: DataFrame) -> DataFrame:
    """The model of both parts of the rows."""
    return leaves.unionByName(more).groupBy("group", "cluster", "attribute", "value").agg(F.sum("n").alias("n"))


def probability(leaves: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """P of a conjunction of conditions on ``value``, one for each attribute named."""
    hit = reduce(lambda a, item: F.when(F.col("attribute") == item[0], F.when(item[1], F.col("n")).otherwise(0)).otherwise(a), conditions.items(), F.col("n"))
    parts = leaves.groupBy("group", "cluster", "attribute").agg(F.sum("n").alias("n"), F.sum(hit).alias("hit"))
    clusters = parts.groupBy("group", "cluster").agg(F.product(F.col("hit") / F.col("n")).alias("p"), F.max("n").alias("n"))
    groups = clusters.groupBy("group").agg((F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("p"))
    return groups.agg(F.product("p").alias("p"))


def expectation(leaves: DataFrame, feature: str, conditions: dict[str, Column]) -> DataFrame:
    """E[feature * 1(conditions)], P(conditions) and their ratio, the conditional mean."""
    hit = reduce(lambda a, item: F.when(F.col("attribute") == item[0], F.when(item[1], F.col("n")).otherwise(0)).otherwise(a), conditions.items(), F.col("n"))
    weight = F.when(F.col("attribute") == feature, F.col("value")).otherwise(F.lit(1.0))
    parts = leaves.groupBy("group", "cluster", "attribute").agg(F.sum("n").alias("n"), F.sum(hit).alias("hit"), F.sum(hit * weight).alias("e"))
    clusters = parts.groupBy("group", "cluster").agg(F.product(F.col("hit") / F.col("n")).alias("p"), F.product(F.col("e") / F.col("n")).alias("e"), F.max("n").alias("n"))
    groups = clusters.groupBy("group").agg((F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("p"), (F.sum(F.col("e") * F.col("n")) / F.sum("n")).alias("e"))
    return groups.agg(F.product("e").alias("expectation"), F.product("p").alias("p")).withColumn("mean", F.col("expectation") / F.nullif(F.col("p"), F.lit(0.0)))
