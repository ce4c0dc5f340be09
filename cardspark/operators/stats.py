"""Contingency, dependence and correlation of columns."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of the value pairs of all column pairs, in one pass over rows drawn together beforehand."""
    drawn = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")) for a, b in combinations(columns, 2)))).alias("p")
    return drawn.select(pairs, "n").groupBy("p.a", "p.b", "p.x", "p.y").agg(F.sum("n").alias("n"))


def mutual_information(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mutual information (natural logarithm) of each pair of columns."""
    whole, x, y = Window.partitionBy("a", "b"), Window.partitionBy("a", "b", "x"), Window.partitionBy("a", "b", "y")
    joint = pair_counts(df, columns).select("a", "b", "n", F.sum("n").over(whole).alias("t"), F.sum("n").over(x).alias("nx"), F.sum("n").over(y).alias("ny"))
    part = F.col("n") / F.col("t") * F.log(F.col("n").cast("double") * F.col("t") / (F.col("nx").cast("double") * F.col("ny")))
    return joint.groupBy("a", "b").agg(F.sum(part).alias("mi"))


def maximum_tree(weights: list[tuple[str, str, float]]) -> list[tuple[str, str, float]]:
    """Maximum spanning tree of a model's columns (tens of them); equal weights by name."""
    group: dict[str, str] = {}

    def root(k: str) -> str:
        while group.setdefault(k, k) != k:
            k = group[k]
        return k

    out = []
    for a, b, w in sorted(weights, key=lambda e: (-e[2], e[0], e[1])):
        if root(a) != root(b):
            group[root(b)] = root(a)
            out.append((a, b, w))
    return out


def chow_liu(df: DataFrame, columns: list[str]) -> list[tuple[str, str, float]]:
    """Edges of the tree that keeps most mutual information."""
    return maximum_tree([(r["a"], r["b"], r["mi"]) for r in mutual_information(df, columns).collect()])  # one row per pair of columns


def chi_square(df: DataFrame, x: str, y: str, strata: list[str] = ()) -> DataFrame:
    """Chi-squared statistic and degrees of freedom of independence, summed over strata; no continuity correction."""
    strata = list(strata)
    counted = df.groupBy(*strata, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    total, by_x, by_y = (Window.partitionBy(*strata, *extra) if strata or extra else Window.partitionBy(F.lit(1)) for extra in ([], ["x"], ["y"]))
    cells = counted.select(*strata, "x", "y", "n", F.sum("n").over(total).alias("t"), F.sum("n").over(by_x).alias("nx"), F.sum("n").over(by_y).alias("ny"))
    # Cells never seen add their expectation: sum of n^2/e over seen cells, less the total.
    expected = F.col("nx").cast("double") * F.col("ny") / F.col("t")
    per = cells.groupBy(*strata).agg((F.sum(F.col("n") * F.col("n") / expected) - F.first("t")).alias("chi2"), ((F.count_distinct("x") - 1) * (F.count_distinct("y") - 1)).alias("dof"))
    return per.agg(F.sum("chi2").alias("chi2"), F.sum("dof").alias("dof"))


def correlations(df: DataFrame, x: str, y: str, given: str) -> DataFrame:
    """Pearson correlation, partial correlation given a third column, and covariance."""
    one = df.agg(F.corr(x, y).alias("xy"), F.corr(x, given).alias("xz"), F.corr(y, given).alias("yz"), F.covar_samp(x, y).alias("covariance"))
    partial = (F.col("xy") - F.col("xz") * F.col("yz")) / F.sqrt((1 - F.pow("xz", F.lit(2))) * (1 - F.pow("yz", F.lit(2))))
    return one.select(F.col("xy").alias("pearson"), partial.alias("partial"), "covariance")


def covariances(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, covariance) of all pairs of columns, each with itself too, in one pass."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k:]]
    one = df.agg(*(F.covar_samp(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)))
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("covariance")) for k, (a, b) in enumerate(pairs)))).alias("x")
    return one.select(each).select("x.*")


def chi_square_pooled(df: DataFrame, x: str, y: str, strata: list[str]) -> DataFrame:
    """Chi-squared statistic of conditional independence over all cells of all strata at once.

    Cells whose expectation is 0 are left out; degrees of freedom are those of the whole table of
    values, whichever of them a stratum has.
    """
    counted = df.groupBy(*strata, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    own, by_x, by_y = (Window.partitionBy(*strata, *extra) for extra in ([], ["x"], ["y"]))
    cells = counted.select(*strata, "x", "y", "n", F.sum("n").over(own).alias("t"), F.sum("n").over(by_x).alias("nx"), F.sum("n").over(by_y).alias("ny"))
    expected = F.col("nx").cast("double") * F.col("ny") / F.col("t")
    per = cells.groupBy(*strata).agg((F.sum(F.col("n") * F.col("n") / expected) - F.first("t")).alias("chi2"))
    sizes = counted.agg((F.count_distinct("x") - 1).alias("dx"), (F.count_distinct("y") - 1).alias("dy"))
    return per.agg(F.sum("chi2").alias("chi2"), F.count(F.lit(1)).alias("k")).join(F.broadcast(sizes)).select("chi2", (F.col("dx") * F.col("dy") * F.col("k")).alias("dof"))


def binary_tree(df: DataFrame, columns: list[str], alpha: float = 0.01) -> DataFrame:
    """Chow-Liu tree of 0/1 columns with smoothed counts: (parent, node, parent_value, value, log_p), parents first from the first column.

    Sums of single columns and of products of two come from one aggregation; each cell of a pair's table
    gets ``alpha``, each value of a single column twice as much.
    """
    import math

    pairs = list(combinations(columns, 2))
    one = df.agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(f"s{k}") for k, c in enumerate(columns)), *(F.sum(F.col(a) * F.col(b)).alias(f"p{k}") for k, (a, b) in enumerate(pairs))).first()
    n, single = one["n"], {c: float(one[f"s{k}"] or 0) for k, c in enumerate(columns)}
    both = {p: float(one[f"p{k}"] or 0) for k, p in enumerate(pairs)}

    def joint(a: str, b: str) -> dict[tuple[int, int], float]:
        ones = both[(a, b)] if (a, b) in both else both[b, a]
        cells = {(1, 1): ones, (1, 0): single[a] - ones, (0, 1): single[b] - ones, (0, 0): n - single[a] - single[b] + ones}
        return {k: (v + alpha) / (n + 4 * alpha) for k, v in cells.items()}

    def alone(a: str) -> dict[int, float]:
        p = (single[a] + 2 * alpha) / (n + 4 * alpha)
        return {1: p, 0: 1 - p}

    gain = [(a, b, sum(p * math.log(p / (alone(a)[x] * alone(b)[y])) for (x, y), p in joint(a, b).items())) for a, b in pairs]
    near: dict[str, list[str]] = {c: [] for c in columns}
    for a, b, _ in maximum_tree(gain):
        near[a].append(b)
        near[b].append(a)
    lines, seen, waiting = [(None, columns[0], None, x, math.log(p)) for x, p in alone(columns[0]).items()], {columns[0]}, [columns[0]]
    while waiting:
        a = waiting.pop()
        for b in sorted(near[a]):
            if b not in seen:
                seen.add(b)
                waiting.append(b)
                lines += [(a, b, x, y, math.log(p / alone(a)[x])) for (x, y), p in joint(a, b).items()]
    return df.sparkSession.createDataFrame(lines, "parent string, node string, parent_value int, value int, log_p double")


def completeness(df: DataFrame, x: str, y: str) -> DataFrame:
    """Share of the product of two columns' values that occurs."""
    return df.agg(F.count_distinct(x, y).alias("pairs"), (F.count_distinct(x) * F.count_distinct(y)).alias("product")).withColumn("completeness", F.col("pairs") / F.col("product"))


def linear_gaussian(df: DataFrame, target: str, features: list[str]) -> tuple[list[float], float]:
    """Coefficients of a linear Gaussian table (see :func:`least_squares`) and the variance of what is left, in one further pass."""
    beta = least_squares(df, target, features)
    names = [*features, target]
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in names)).na.drop()
    mean = F.lit(beta[0]) + sum((F.col(c) * b for c, b in zip(features, beta[1:])), F.lit(0.0))
    return beta, rows.agg(F.avg(F.pow(F.col(target) - mean, F.lit(2))).alias("v")).first()["v"]


def least_squares(df: DataFrame, target: str, features: list[str]) -> list[float]:
    """Intercept and slopes by normal equations: the sums are one aggregation, the solution is as small as the features."""
    import numpy as np

    names = ["__one", *features]
    rows = df.select(F.lit(1.0).alias("__one"), *(F.col(c).cast("double").alias(c) for c in (*features, target))).na.drop()
    sums = rows.agg(*(F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate([*names, target]) if j >= i)).first()
    k = len(names)
    left = np.array([[sums[f"{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], dtype=float)
    right = np.array([sums[f"{i}_{k}"] for i in range(k)], dtype=float)
    return np.linalg.solve(left, right).tolist()
