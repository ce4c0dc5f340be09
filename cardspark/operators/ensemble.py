"""Cardinalities of joins from several models: one for each table or edge of a schema, multiplied with their overlaps divided out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardspark.catalog import Relationship, SchemaGraph
from cardspark.operators import joins, trees
from cardspark.operators.trees import TreeModel

#: Orders of the edges that are tried at most for one join.
MOST_VARIANTS = 10


@dataclass(frozen=True)
class EdgeModel:
    """A model of the full outer join of two tables, with the indicators ``<table>_nn`` and the parent's fan-outs."""

    edge: Relationship
    model: TreeModel


def edge_columns(edge: Relationship, columns: dict[str, list[str]], fan_outs: list[str] = ()) -> list[str]:
    own = [*columns.get(edge.parent, []), *columns.get(edge.child, []), f"{edge.parent}_nn", f"{edge.child}_nn", f"{edge.fan_out}_nn", *fan_outs]
    return list(dict.fromkeys(own))


def fit_edge(parent: DataFrame, child: DataFrame, edge: Relationship, columns: dict[str, list[str]], **options) -> EdgeModel:
    """A model of one edge; ``columns`` names each table's columns to be modelled.

    The join is grouped by what is modelled and written once, as learning reads it several times.
    """
    parent = joins.with_fan_out(parent.select(edge.pk, *(c for c in columns.get(edge.parent, []) if c != edge.pk)), child, edge)
    child = child.select(edge.fk, *(c for c in columns.get(edge.child, []) if c != edge.fk))
    own = edge_columns(edge, columns)
    rows = joins.grouped(joins.full_outer(parent, child, edge), own, "__rows")
    return EdgeModel(edge, trees.fit(rows, own, weight="__rows", **options))


def fit_tables(tables: dict[str, DataFrame], columns: dict[str, list[str]], **options) -> dict[str, TreeModel]:
    """One model for each table by itself."""
    return {name: trees.fit(df, columns[name], **options) for name, df in tables.items()}


def fit_edges(schema: SchemaGraph, tables: dict[str, DataFrame], columns: dict[str, list[str]], **options) -> dict[tuple[str, str], EdgeModel]:
    """One model for each edge of the schema between the given tables, by (child, parent)."""
    own = [r for r in schema.relationships if r.child in tables and r.parent in tables]
    return {(r.child, r.parent): fit_edge(tables[r.parent], tables[r.child], r, columns, **options) for r in own}


def _with(conditions: DataFrame, queries: DataFrame, *present: str) -> DataFrame:
    """``conditions``, and for each query that the indicator columns ``present`` are 1."""
    each = [queries.select("query_id", F.lit(c).alias("attribute"), F.lit("=").alias("op"), F.array(F.lit("1")).alias("values")) for c in present]
    return reduce(DataFrame.unionByName, each, conditions.select("query_id", "attribute", "op", "values"))


def pair_estimate(one: EdgeModel, conditions: DataFrame, queries: DataFrame, attributes: set[str] | None = None) -> DataFrame:
    """(query_id, cardinality) of the inner join of an edge's tables; ``attributes`` are those that conditions name, where known."""
    present = [f"{one.edge.parent}_nn", f"{one.edge.child}_nn"]
    both = _with(conditions, queries, *present)
    return trees.expectation(one.model, both, (), queries, None if attributes is None else {*attributes, *present}).select("query_id", "cardinality")


def side_estimate(one: EdgeModel, table: str, columns: list[str], conditions: DataFrame, queries: DataFrame, attributes: set[str] | None = None) -> DataFrame:
    """(query_id, cardinality) of one table of an edge under the conditions on its ``columns``.

    A parent's row stands in the outer join once for each child, so each counts 1 / fan-out.
    """
    own = _with(conditions.where(F.col("attribute").isin(columns)), queries, f"{table}_nn")
    inverse = [f"{one.edge.fan_out}_nn"] if table == one.edge.parent else []
    named = None if attributes is None else {*(attributes & set(columns)), f"{table}_nn"}
    return trees.expectation(one.model, own, inverse, queries, named).select("query_id", "cardinality")


def _orders(edges: list[Relationship]) -> list[list[tuple[Relationship, str | None]]]:
    """For each edge as the start: the edges in turn, each with the table that it shares with those before."""
    out = []
    for start in edges[:MOST_VARIANTS]:
        known, left, order = {start.child, start.parent}, [e for e in edges if e != start], [(start, None)]
        while left:
            step = next(((e, t) for e in left for t in (e.parent, e.child) if t in known), None)
            if step is None:
                raise ValueError("the join's edges are not connected")
            order.append(step)
            known |= {step[0].child, step[0].parent}
            left.remove(step[0])
        out.append(order)
    return out


def join_estimate(models: dict[tuple[str, str], EdgeModel], edges: list[Relationship], columns: dict[str, list[str]], conditions: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, cardinality) of inner joins along a tree of edges, for many queries at once.

    The first edge's model gives the size of its join; each further edge multiplies by its own join's
    size and divides by the size of the table that it shares with those before, both under the query's
    conditions.  Each edge starts once; the answer is the median of these variants (the upper one of
    two), 1 at least.  A factor of 0 gives 1.
    """
    queries = (conditions if queries is None else queries).select("query_id").distinct()
    attributes = {r["attribute"] for r in conditions.select("attribute").distinct().collect()}  # columns of the schema
    orders = _orders(edges)
    # Each factor is worked out once, as a column; the variants are products of them.
    total, names = queries, {}
    for edge in edges:
        one = models[edge.child, edge.parent]
        parts = {None: pair_estimate(one, conditions, queries, attributes)}
        parts |= {t: side_estimate(one, t, columns.get(t, []), conditions, queries, attributes) for t in {shared for order in orders for e, shared in order if e == edge and shared}}
        for table, part in parts.items():
            names[edge, table] = f"__f{len(names)}"
            total = total.join(part.withColumnRenamed("cardinality", names[edge, table]), "query_id")
    variants = []
    for order in orders:
        size = F.lit(1.0)
        for edge, shared in order:
            size = size * F.col(names[edge, None])
            if shared is not None:
                size = F.when(F.col(names[edge, shared]) > 0, size / F.col(names[edge, shared])).otherwise(0.0)
        variants.append(size)
    found = F.sort_array(F.array(*variants))  # at most MOST_VARIANTS numbers
    return total.select("query_id", F.greatest(F.lit(1.0), F.get(found, F.lit(len(variants) // 2))).alias("cardinality"))


def naive_join_estimate(models: dict[str, TreeModel], size: float, conditions: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, cardinality): the tables' selectivities times the join's size, as if they were independent."""
    queries = (conditions if queries is None else queries).select("query_id").distinct()
    total = queries.withColumn("p", F.lit(1.0))
    for model in models.values():
        part = trees.estimate(model, conditions, queries).select("query_id", F.col("p").alias("__p"))
        total = total.join(part, "query_id").select("query_id", (F.col("p") * F.col("__p")).alias("p"))
    return total.select("query_id", (F.col("p") * size).alias("cardinality"))


def true_counts(df: DataFrame, conditions: DataFrame, most: int = 1000, weight: str | None = None) -> DataFrame:
    """(query_id, cardinality): exact counts of a bounded set of queries over ``df``, all in one pass.

    More than ``most`` queries raise an error: they go in several calls.  Rows may be grouped, with the
    number of rows that each stands for in ``weight``.
    """
    from cardspark.operators.encode import bounded, numeric_columns

    numeric, found = numeric_columns(df), {}
    wanted = bounded(conditions.select("query_id").distinct(), most)
    for r in conditions.join(F.broadcast(wanted), "query_id").collect():
        found.setdefault(r["query_id"], []).append((r["attribute"], r["op"].lower(), r["values"] or []))

    def holds(attribute: str, op: str, values: list[str]):
        own = [float(v) if attribute in numeric else v for v in values]
        c = F.col(attribute)
        simple = {"is null": c.isNull(), "is not null": c.isNotNull()}
        if op in simple:
            return simple[op]
        if op in ("in", "not in", "=", "==", "<>", "!="):
            inside = c.isin(own)
            return inside if op in ("in", "=", "==") else ~inside
        return {"<": c < own[0], "<=": c <= own[0], ">": c > own[0], ">=": c >= own[0]}[op]

    if not found:
        return conditions.select("query_id", F.lit(0).cast("long").alias("cardinality"))
    ids = sorted(found)
    one = F.lit(1) if weight is None else F.col(weight)
    inside = {k: F.when(reduce(lambda a, b: a & b, (holds(*x) for x in found[k])), one) for k in ids}
    counts = df.agg(*((F.count(x) if weight is None else F.coalesce(F.sum(x), F.lit(0))).alias(f"n{k}") for k, x in inside.items()))
    each = F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("query_id"), F.col(f"n{k}").alias("cardinality")) for k in ids))).alias("x")
    return counts.select(each).select("x.*")
