"""Edges of a model as a relation: closures, parents and adjustment by aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardspark.session import written


def ancestors(edges: DataFrame) -> DataFrame:
    """(node, ancestor) of a graph with edges (parent, child), however long its paths are.

    The closure is squared in each round until it stays the same, so the number of rounds grows with
    the logarithm of the longest path; each round is written, so none works out the earlier ones again.
    On a circle each node is its own ancestor.
    """
    closed = written(edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).distinct())
    size = closed.count()
    while True:
        longer = closed.join(closed.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("__up")), "ancestor").select("node", F.col("__up").alias("ancestor"))
        closed = written(closed.unionByName(longer).distinct())
        now = closed.count()
        if now == size:
            return closed
        size = now


def roots_and_leaves(edges: DataFrame) -> DataFrame:
    """Each node with the number of its parents and children."""
    ends = edges.select(F.col("child").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("parent").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("parents"), F.sum("down").alias("children"))


def markov_blanket(edges: DataFrame) -> DataFrame:
    """(node, other): parents, children, and the children's other parents."""
    parents = edges.select(F.col("child").alias("node"), F.col("parent").alias("other"))
    children = edges.select(F.col("parent").alias("node"), F.col("child").alias("other"))
    mates = edges.select(F.col("parent").alias("node"), "child").join(edges.select(F.col("parent").alias("other"), "child"), "child").where("node <> other").select("node", "other")
    return parents.unionByName(children).unionByName(mates).distinct()


def immoralities(edges: DataFrame) -> DataFrame:
    """(a, b, child): pairs of parents of one child, a < b, that no edge connects; an equivalence class shares them and its skeleton."""
    a, b = edges.select(F.col("parent").alias("a"), "child"), edges.select(F.col("parent").alias("b"), "child")
    pairs = a.join(b, "child").where("a < b")
    known = edges.select(F.least("parent", "child").alias("a"), F.greatest("parent", "child").alias("b"))
    return pairs.join(known, ["a", "b"], "left_anti").select("a", "b", "child")


def intervened(edges: DataFrame, *nodes: str) -> DataFrame:
    """The graph after setting some nodes: their incoming edges are gone."""
    return edges.where(~F.col("child").isin(list(nodes)))


def local_independencies(edges: DataFrame) -> DataFrame:
    """(node, other): pairs that are independent given the node's parents: others that don't descend from it and aren't its parents."""
    nodes = edges.select(F.col("parent").alias("node")).union(edges.select("child")).distinct()
    below = ancestors(edges).select(F.col("ancestor").alias("node"), F.col("node").alias("other"))
    near = below.unionByName(edges.select(F.col("child").alias("node"), F.col("parent").alias("other")))
    others = nodes.agg(F.collect_set("node").alias("all"))  # a model's columns
    pairs = nodes.join(F.broadcast(others)).select("node", F.explode("all").alias("other")).where("node <> other")
    return pairs.join(near, ["node", "other"], "left_anti")


def adjusted_effect(df: DataFrame, treatment: str, outcome: str, adjust: list[str]) -> DataFrame:
    """Mean difference of the outcome between treated and other rows, weighted over the strata of what is adjusted for.

    Strata without both kinds of rows say nothing and are left out of the weights.
    """
    strata = df.groupBy(*adjust).agg(F.avg(F.when(F.col(treatment), F.col(outcome))).alias("__t"), F.avg(F.when(~F.col(treatment), F.col(outcome))).alias("__c"), F.count(F.lit(1)).alias("__n"))
    both = strata.where("__t IS NOT NULL AND __c IS NOT NULL")
    return both.agg((F.sum((F.col("__t") - F.col("__c")) * F.col("__n")) / F.sum("__n")).alias("effect"), F.count(F.lit(1)).alias("strata"))
