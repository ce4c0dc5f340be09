"""Belief propagation on trees of cliques that are relations.

A clique is a factor (one column per variable, and ``p``); neighbouring cliques share their
sepset's variables.  Messages go to the root and back; afterwards neighbours agree on their sepsets.
The tree is a model's structure, a few dozen cliques; the factors are relations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardspark.operators.bayes import divide, eliminate, marginal, max_marginal, product


def sepset(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c in b.columns and c != "p"]


def calibrate(cliques: dict[str, DataFrame], tree: list[tuple[str, str]], largest: bool = False) -> dict[str, DataFrame]:
    """Calibrated cliques; ``tree`` lists (parent, child), parents first.  With ``largest``, messages are maxima instead of sums."""
    marginal_ = max_marginal if largest else marginal
    beliefs = dict(cliques)
    sent: dict[str, DataFrame] = {}
    for parent, child in reversed(tree):  # towards the root
        sent[child] = marginal_(beliefs[child], *sepset(beliefs[parent], beliefs[child]))
        beliefs[parent] = product(beliefs[parent], sent[child])
    for parent, child in tree:  # and back, without what the child sent itself
        back = marginal_(beliefs[parent], *sepset(beliefs[parent], beliefs[child]))
        beliefs[child] = product(beliefs[child], divide(back, sent[child]))
    return beliefs


def disagreement(beliefs: dict[str, DataFrame], tree: list[tuple[str, str]]) -> DataFrame:
    """Largest difference of neighbours' sepset marginals, by edge."""
    out = None
    for parent, child in tree:
        shared = sepset(beliefs[parent], beliefs[child])
        a, b = marginal(beliefs[parent], *shared), marginal(beliefs[child], *shared).withColumnRenamed("p", "__p")
        one = a.join(b, shared, "full_outer").agg(F.max(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("__p", F.lit(0.0)))).alias("difference")).select(F.lit(parent).alias("parent"), F.lit(child).alias("child"), "difference")
        out = one if out is None else out.unionByName(one)
    return out


def partition_function(beliefs: dict[str, DataFrame], clique: str) -> DataFrame:
    return beliefs[clique].agg(F.sum("p").alias("z"))


def clique_tree(factors: list[DataFrame], edges: list[tuple[str, str]]) -> tuple[dict[str, DataFrame], list[tuple[str, str]]]:
    """Cliques of a tree-shaped network, one for each (parent, child) edge, and the tree of cliques, parents first.

    ``factors`` are over one or two variables; each goes into a clique that has its variables.
    """
    names = [f"{a}|{b}" for a, b in edges]
    cliques: dict[str, DataFrame] = {}
    for factor in factors:
        scope = {c for c in factor.columns if c != "p"}
        name = next(n for n, e in zip(names, edges) if scope <= set(e))
        cliques[name] = product(cliques[name], factor) if name in cliques else factor
    tree = [(next(m for m, e in zip(names[:k], edges[:k]) if edges[k][0] in e), names[k]) for k in range(1, len(edges))]
    return cliques, tree


def query(beliefs: dict[str, DataFrame], tree: list[tuple[str, str]], keep: list[str], evidence: dict | None = None) -> DataFrame:
    """P(keep, evidence) from calibrated cliques: only those between the ones that hold the variables asked for are joined.

    The joint of connected cliques is the product of their beliefs over that of their sepsets.
    """
    wanted, evidence = {*keep, *(evidence or {})}, evidence or {}
    need = {n for n, b in beliefs.items() if wanted & set(b.columns)}
    parent = {c: p for p, c in tree}

    def path(n: str) -> list[str]:
        out = [n]
        while out[-1] in parent:
            out.append(parent[out[-1]])
        return out

    paths = [path(n) for n in sorted(need)]
    shared = set(paths[0]).intersection(*map(set, paths)) if paths else set()
    top = next(n for n in paths[0] if n in shared)
    used = {n for p in paths for n in p[: p.index(top) + 1]}
    factors = [beliefs[top]] + [divide(beliefs[c], marginal(beliefs[c], *sepset(beliefs[p], beliefs[c]))) for p, c in tree if c in used and p in used]
    return eliminate(factors, keep, evidence)
