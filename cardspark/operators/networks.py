"""Recursive sum-product networks: structure learnt from a bounded sample, leaves and weights counted over all rows.

A product splits columns that hardly depend on each other, a sum splits rows between two centres, and
a leaf is one column.  Where a row goes is an expression of its columns, so one pass over any number
of rows counts the values of all leaves, and counts of several parts of the rows add up.  Answers come
from the leaves' relation, level by level; a model has some dozens of nodes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardspark.operators.encode import bounded
from cardspark.streaming.incremental import nearest_center

#: Rows of the sample that a structure is learnt from, and of its part that columns are compared on.
SAMPLE_ROWS, COMPARED_ROWS = 100_000, 10_000


@dataclass(frozen=True)
class Node:
    """``kind`` is "sum", "product" or "leaf"; ``centers`` are those of a sum, one for each child."""

    kind: str
    columns: tuple[str, ...]
    children: tuple["Node", ...] = ()
    centers: tuple[tuple[float, ...], ...] = ()


def leaf(column: str) -> Node:
    return Node("leaf", (column,))


def product(*children: Node) -> Node:
    return Node("product", tuple(c for x in children for c in x.columns), children)


def total(columns: list[str], centers: list[tuple[float, ...]], *children: Node) -> Node:
    return Node("sum", tuple(columns), children, tuple(map(tuple, centers)))


def walk(node: Node, path: tuple[int, ...] = ()):
    """(path, node) of all nodes; a path lists the children taken from the root."""
    yield path, node
    for k, child in enumerate(node.children):
        yield from walk(child, (*path, k))


def faults(node: Node) -> list[str]:
    """What makes a structure invalid: products with shared columns, sums over different columns or without a centre for each child."""
    out = []
    for path, x in walk(node):
        scopes = [set(c.columns) for c in x.children]
        if x.kind == "product" and sum(map(len, scopes)) != len(set().union(*scopes)):
            out.append(f"{path}: children share columns")
        if x.kind == "sum" and (any(s != set(x.columns) for s in scopes) or len(x.centers) != len(x.children)):
            out.append(f"{path}: children differ in columns, or in number from the centres")
        if x.kind == "leaf" and (len(x.columns) != 1 or x.children):
            out.append(f"{path}: a leaf has one column")
    return out


def rdc(sample: DataFrame, columns: list[str], features: int = 10, scale: float = 1 / 6, seed: int = 17) -> dict[tuple[str, str], float]:
    """Randomised dependence of each pair of columns: the largest correlation between random sines of their ranks.

    ``sample`` has at most ``COMPARED_ROWS`` rows.  Nulls rank lowest.
    """
    draw = np.random.default_rng(seed)
    rows = bounded(sample, COMPARED_ROWS).select(*(F.percent_rank().over(Window.orderBy(F.col(c).asc_nulls_first())).alias(c) for c in columns))
    names = []
    for c in columns:
        for k, (a, b) in enumerate(draw.normal(size=(features, 2)) * scale * 2 * np.pi):
            names.append(f"__{len(names)}")
            rows = rows.withColumn(names[-1], F.sin(F.col(c) * float(a) * features + float(b)))
    vectors = VectorAssembler(inputCols=names, outputCol="x").transform(rows)
    whole = np.nan_to_num(Correlation.corr(vectors, "x").first()[0].toArray())  # as large as the columns' features
    blocks = {c: slice(k * features, (k + 1) * features) for k, c in enumerate(columns)}

    def root(m: np.ndarray) -> np.ndarray:
        values, axes = np.linalg.eigh(m)
        return axes @ np.diag([v**-0.5 if v > 1e-4 else 0.0 for v in values]) @ axes.T

    inverse = {c: root(whole[b, b]) for c, b in blocks.items()}
    return {(a, b): float(min(1.0, np.linalg.norm(inverse[a] @ whole[blocks[a], blocks[b]] @ inverse[b], 2))) for k, a in enumerate(columns) for b in columns[k + 1 :]}


def column_groups(columns: list[str], dependence: dict[tuple[str, str], float], threshold: float) -> list[list[str]]:
    """Columns that a chain of pairs above the threshold connects, in their order."""
    group = {c: {c} for c in columns}
    for (a, b), value in dependence.items():
        if value > threshold:
            joined = group[a] | group[b]
            for c in joined:
                group[c] = joined
    out: list[list[str]] = []
    for c in columns:
        if not any(c in g for g in out):
            out.append([x for x in columns if x in group[c]])
    return out


def learn(df: DataFrame, columns: list[str], threshold: float = 0.3, least_rows: int = 1000, most_depth: int = 6, seed: int = 17, sample_rows: int = SAMPLE_ROWS) -> Node:
    """Structure of numeric columns, learnt on a sample of about ``sample_rows`` rows at most.

    A constant column is split off; columns are split where they are independent enough, otherwise rows by
    two means; with fewer than ``least_rows`` rows or beyond ``most_depth`` the columns are taken as independent.
    """
    n = df.count()
    part = df.select(*(F.col(c).cast("double").alias(c) for c in columns))
    part = part if n <= sample_rows else part.sample(fraction=sample_rows / n, seed=seed)
    part = part.na.fill(0.0).cache()
    try:
        return _learn(part, list(columns), threshold, least_rows, most_depth, seed, False)
    finally:
        part.unpersist()


def _learn(rows: DataFrame, columns: list[str], threshold: float, least_rows: int, depth: int, seed: int, split: bool) -> Node:
    if len(columns) == 1:
        return leaf(columns[0])
    one = rows.agg(F.count(F.lit(1)).alias("n"), *((F.max(c) - F.min(c)).alias(c) for c in columns)).first()
    if one["n"] < least_rows or depth == 0:
        return product(*map(leaf, columns))
    still = [c for c in columns if not one[c]]
    if still:
        moving = [c for c in columns if one[c]]
        rest = [_learn(rows, moving, threshold, least_rows, depth, seed, split)] if moving else []
        rest = list(rest[0].children) if rest and rest[0].kind == "product" else rest
        return product(*map(leaf, still), *rest)
    part = rows if one["n"] <= COMPARED_ROWS else rows.sample(fraction=0.9 * COMPARED_ROWS / one["n"], seed=seed).limit(COMPARED_ROWS)
    groups = column_groups(columns, rdc(part, columns, seed=seed), threshold)
    if len(groups) > 1:
        return product(*(_learn(rows, g, threshold, least_rows, depth - 1, seed, True) for g in groups))
    vectors = VectorAssembler(inputCols=columns, outputCol="__x").transform(rows)
    centers = [tuple(float(x) for x in c) for c in KMeans(k=2, seed=seed, featuresCol="__x").fit(vectors).clusterCenters()]
    if len(centers) < 2:
        return product(*map(leaf, columns))
    near = nearest_center(columns, centers)
    return total(columns, centers, *(_learn(rows.where(near == k), columns, threshold, least_rows, depth - 1, seed, False) for k in range(2)))


def fit(df: DataFrame, root: Node) -> DataFrame:
    """(leaf, attribute, value, n): how often each value occurs in each leaf; one pass over the rows, whose nulls are kept."""
    each = []

    def visit(node: Node, path: tuple[int, ...], here: Column) -> None:
        if node.kind == "leaf":
            c = node.columns[0]
            each.append(F.when(here, F.struct(F.lit("/".join(map(str, path))).alias("leaf"), F.lit(c).alias("attribute"), F.col(c).cast("double").alias("value"))))
            return
        for k, child in enumerate(node.children):
            inside = here & (nearest_center(list(node.columns), list(node.centers)) == k) if node.kind == "sum" else here
            visit(child, (*path, k), inside)

    visit(root, (), F.lit(True))
    rows = df.select(F.explode(F.array(*each)).alias("x")).where("x IS NOT NULL").select("x.*")
    return rows.groupBy("leaf", "attribute", "value").agg(F.count(F.lit(1)).alias("n"))


def expectation(leaves: DataFrame, root: Node, conditions: dict[str, Column], features: dict[str, int] | None = None) -> DataFrame:
    """One row: ``expectation`` of 1(conditions) * product of column ** power, ``p`` of the conditions, and their ratio ``mean``.

    Conditions are on ``value``; powers are 1, -1, 2 or -2, and 1/0 counts as nothing.  Rows in which a
    feature is null count neither for the expectation nor for ``p``.  Columns without a condition and
    that are no feature don't matter.
    """
    features = features or {}
    x = F.col("value")
    hit, weight = F.lit(1.0), F.lit(1.0)
    for name, condition in conditions.items():
        hit = F.when(F.col("attribute") == name, F.when(condition, 1.0).otherwise(0.0)).otherwise(hit)
    for name, power in features.items():
        hit = F.when((F.col("attribute") == name) & x.isNull(), F.lit(0.0)).otherwise(hit)
        term = F.when(x.isNull(), 0.0).otherwise(F.pow(x, F.lit(abs(power))) if power > 0 else F.when(x != 0, 1 / F.pow(x, F.lit(abs(power)))).otherwise(0.0))
        weight = F.when(F.col("attribute") == name, term).otherwise(weight)
    per = leaves.groupBy("leaf").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * hit) / F.sum("n")).alias("p"), (F.sum(F.col("n") * hit * weight) / F.sum("n")).alias("e"))
    nodes = {path: node for path, node in walk(root)}
    deepest = max(map(len, nodes))
    spark = leaves.sparkSession
    known = spark.createDataFrame([("/".join(map(str, p)), len(p)) for p, x in nodes.items() if x.kind == "leaf"], "leaf string, level int")
    ready = per.join(F.broadcast(known), "leaf").withColumnRenamed("leaf", "node")
    current = ready.where(F.col("level") == deepest).select("node", "n", "p", "e")
    for level in range(deepest, 0, -1):
        kinds = [("/".join(map(str, p)), "/".join(map(str, p[:-1])), nodes[p[:-1]].kind) for p in nodes if len(p) == level]
        own = current.join(F.broadcast(spark.createDataFrame(kinds, "node string, parent string, kind string")), "node")
        n, product_ = F.sum("n"), F.first("kind") == "product"
        up = own.groupBy("parent").agg(
            F.when(product_, F.max("n")).otherwise(n).alias("n"),
            *(F.when(product_, F.product(c)).otherwise(F.sum(F.col(c) * F.col("n")) / n).alias(c) for c in ("p", "e")),
        )
        current = up.withColumnRenamed("parent", "node").unionByName(ready.where(F.col("level") == level - 1).select("node", "n", "p", "e"))
    return current.select(F.col("e").alias("expectation"), "p", (F.col("e") / F.nullif(F.col("p"), F.lit(0.0))).alias("mean"), "n")


def probability(leaves: DataFrame, root: Node, conditions: dict[str, Column]) -> DataFrame:
    return expectation(leaves, root, conditions).select("p")


def clipped(answers: DataFrame, size: int, column: str = "p") -> DataFrame:
    """A probability of 0 counts as one row of the model: at least 1 / size."""
    return answers.withColumn(column, F.greatest(F.coalesce(column, F.lit(0.0)), F.lit(1.0 / max(1, size))))


def imputed(groups: DataFrame, expectation_column: str = "expectation", p: str = "p") -> DataFrame:
    """Adds ``mean``: expectation / p by group, and where p is 0 the groups' average of it."""
    ratio = F.when(F.col(p) > 0, F.col(expectation_column) / F.col(p))
    average = groups.agg(F.avg(ratio).alias("__average"))  # one row
    return groups.join(F.broadcast(average)).withColumn("mean", F.coalesce(ratio, F.col("__average"))).drop("__average")


def with_deviation(leaves: DataFrame, root: Node, conditions: dict[str, Column], feature: str) -> DataFrame:
    """One row: p and mean of a feature under conditions, each with its deviation for a sample of the model's rows."""
    first = expectation(leaves, root, conditions, {feature: 1})
    second = expectation(leaves, root, conditions, {feature: 2}).select(F.col("expectation").alias("__square"))
    p, n = F.col("p"), F.col("n")
    spread = F.greatest(F.lit(0.0), F.col("__square") / F.nullif(p, F.lit(0.0)) - F.pow("mean", F.lit(2)))
    both = first.join(F.broadcast(second))  # one row each
    return both.select("p", F.sqrt(p * (1 - p) / n).alias("p_sd"), "mean", F.sqrt(spread / F.nullif(p * n, F.lit(0.0))).alias("mean_sd"))


def marginal(leaves: DataFrame, keep: list[str]) -> DataFrame:
    """The model over some columns only: their leaves; a node that has none left counts as 1."""
    return leaves.where(F.col("attribute").isin(list(keep)))


def moved_centers(df: DataFrame, columns: list[str], centers: list[tuple[float, ...]], counts: list[int]) -> tuple[list[tuple[float, ...]], list[int]]:
    """Centres and counts after more rows: each row goes to its nearest centre, which moves to the mean of all its rows."""
    near = nearest_center(columns, centers)
    per = {r["k"]: r for r in df.groupBy(near.alias("k")).agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in columns)).collect()}  # a row for each centre
    moved, more = [], []
    for k, (center, n) in enumerate(zip(centers, counts)):
        own = per.get(k)
        size = n + (own["n"] if own else 0)
        moved.append(tuple((x * n + (own[c] if own else 0.0)) / size if size else x for c, x in zip(columns, center)))
        more.append(size)
    return moved, more


def group_values(leaves: DataFrame, attributes: list[str], conditions: dict[str, Column]) -> DataFrame:
    """All combinations of the attributes' values that occur in some leaf under their conditions; a superset of the true groups."""
    out = None
    for name in attributes:
        own = bounded(leaves.where(F.col("attribute") == name).where(conditions.get(name, F.lit(True))).where("value IS NOT NULL").select(F.col("value").alias(name)).distinct())
        out = own if out is None else out.join(F.broadcast(own))  # dictionaries: the result is meant to be their product
    return out


def relevant(conditions: dict[str, Column], features: list[str]) -> dict[str, Column]:
    """The conditions, and for each feature that its value is known."""
    extra = {c: F.col("value").isNotNull() for c in features}
    return {c: reduce(lambda a, b: a & b, [x[c] for x in (conditions, extra) if c in x]) for c in {**conditions, **extra}}
