"""Joins along foreign keys: padded outer joins, partnerless rows, fan-outs and join sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardspark.catalog import Relationship, SchemaGraph
from cardspark.session import written


def full_outer(parent: DataFrame, child: DataFrame, edge: Relationship) -> DataFrame:
    """Both sides with null padding, and ``<table>_nn`` (1 where the side has a row)."""
    left = parent.withColumn(f"{edge.parent}_nn", F.lit(1))
    right = child.withColumn(f"{edge.child}_nn", F.lit(1))
    joined = left.join(right, F.col(edge.pk) == F.col(edge.fk), "full_outer")
    return joined.na.fill(0, [f"{edge.parent}_nn", f"{edge.child}_nn"])


def without_partner(rows: DataFrame, others: DataFrame, key: str, other_key: str) -> DataFrame:
    return rows.join(others.select(F.col(other_key).alias("__key")), F.col(key) == F.col("__key"), "left_anti")


def with_partner(rows: DataFrame, others: DataFrame, key: str, other_key: str) -> DataFrame:
    return rows.join(others.select(F.col(other_key).alias("__key")), F.col(key) == F.col("__key"), "left_semi")


def with_fan_out(parent: DataFrame, child: DataFrame, edge: Relationship, rate: float = 1.0) -> DataFrame:
    """Adds the number of children (scaled up by the children's sampling rate) and the same with 0 as 1.

    Children are counted before the join, so only one row for each key travels.
    """
    counted = child.where(F.col(edge.fk).isNotNull()).groupBy(F.col(edge.fk).alias("__key")).agg(F.count(F.lit(1)).alias("__n"))
    joined = parent.join(counted, F.col(edge.pk) == F.col("__key"), "left")
    n = F.coalesce(F.col("__n"), F.lit(0))
    return joined.withColumn(edge.fan_out, n if rate == 1.0 else n / rate).withColumn(f"{edge.fan_out}_nn", F.greatest(n, F.lit(1)) if rate == 1.0 else F.greatest(n / rate, F.lit(1.0))).drop("__key", "__n")


def mean_fan_out(parent: DataFrame, child: DataFrame, edge: Relationship) -> DataFrame:
    with_n = with_fan_out(parent.select(edge.pk), child.select(edge.fk), edge)
    return with_n.agg(F.count(F.lit(1)).alias("n_parents"), F.avg(f"{edge.fan_out}_nn").alias("mean_fan_out"))


def referenced(rows: DataFrame, parent: DataFrame, child: DataFrame, edge: Relationship) -> DataFrame:
    """The parents in ``rows`` that have a child: those whose fan-out is above 0."""
    return with_fan_out(with_partner(rows, parent, edge.pk, edge.pk), child, edge).where(F.col(edge.fan_out) > 0).drop(edge.fan_out, f"{edge.fan_out}_nn")


def edge_statistics(parent: DataFrame, child: DataFrame, edge: Relationship, rate: float = 1.0) -> DataFrame:
    """One row: parents, parents without a child, mean fan-out (0 as 1), children without a parent or without a key.

    ``rate`` is the share of the child's rows that ``child`` holds; counts of children are scaled up.
    """
    with_n = with_fan_out(parent.select(edge.pk), child.select(edge.fk), edge, rate)
    up = with_n.agg(F.count(F.lit(1)).alias("parents"), F.count(F.when(F.col(edge.fan_out) == 0, 1)).alias("childless"), F.avg(f"{edge.fan_out}_nn").alias("mean_fan_out"))
    alone = child.select(edge.fk).join(parent.select(F.col(edge.pk).alias("__key")), F.col(edge.fk) == F.col("__key"), "left_anti")
    return up.join(F.broadcast(alone.agg((F.count(F.lit(1)) / rate).alias("orphans"))))  # one row each


def outer_join_size(start_rows: int, mean_fan_outs: list[float], orphans: int = 0) -> float:
    """Size of a full outer join from the root's rows, one mean fan-out per 1:N edge, and rows without a parent."""
    size = float(start_rows)
    for mean in mean_fan_outs:
        size *= mean
    return size + orphans


def join_size_estimate(statistics: dict[tuple[str, str], dict], rows: dict[str, float], edges: list[Relationship], start: str | None = None, rates: dict[str, float] | None = None) -> tuple[float, float]:
    """Sizes of a full outer join along a tree of edges, of the sampled tables and of the whole ones, without joining.

    From ``start`` (by default the table that most edges point to), an edge towards a child multiplies by
    the mean fan-out and adds the children without a parent; an edge towards a parent adds the parents
    without a child.  ``rates`` are the sampling rates of tables.  Exact for one edge.
    """
    rates = rates or {}
    names = [t for e in edges for t in (e.parent, e.child)]
    start = start or max(sorted(set(names)), key=lambda t: sum(e.parent == t for e in edges))
    known, left = {start}, list(edges)
    sample, whole = rows[start] * rates.get(start, 1.0), float(rows[start])
    while left:
        edge = next((e for e in left if e.child in known), None) or next((e for e in left if e.parent in known), None)
        if edge is None or edge.child in known and edge.parent in known:
            raise ValueError("the join's edges are not a tree")
        own = statistics[edge.child, edge.parent]
        if edge.child in known:
            known.add(edge.parent)
            sample, whole = sample + own["childless"] * rates.get(edge.parent, 1.0), whole + own["childless"]
        else:
            known.add(edge.child)
            rate = rates.get(edge.child, 1.0)
            sample, whole = sample * own["mean_fan_out"] * rate + own["orphans"] * rate, whole * own["mean_fan_out"] + own["orphans"]
        left.remove(edge)
    return sample, whole


def sampling_rate(rows: int, most_rows: int, rate: float = 1.0) -> float:
    """A table's own sampling rate, lowered so that at most about ``most_rows`` rows are taken."""
    return min(rate, most_rows / rows) if rows else rate


def hashed_below(rate: float, *columns: str) -> Column:
    """A repeatable sample at any rate: rows whose key's md5, as a number in [0, 1), lies below it."""
    key = F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in columns)))
    return F.conv(F.substring(key, 1, 12), 16, 10).cast("double") / float(16**12) < rate


def sampled_outer_join(parent: DataFrame, child: DataFrame, edge: Relationship, rate: float, key: str) -> DataFrame:
    """Full outer join in which the start table, ``edge.parent``, is sampled by the hash of its key before the join.

    Children without a parent are sampled at the same rate, by the hash of ``key``.
    """
    start = parent.where(hashed_below(rate, edge.pk))
    joined = start.withColumn(f"{edge.parent}_nn", F.lit(1)).join(child.withColumn(f"{edge.child}_nn", F.lit(1)), F.col(edge.pk) == F.col(edge.fk), "left").na.fill(0, [f"{edge.child}_nn"])
    alone = child.join(parent.select(F.col(edge.pk).alias("__key")), F.col(edge.fk) == F.col("__key"), "left_anti").where(hashed_below(rate, key))
    alone = alone.withColumn(f"{edge.parent}_nn", F.lit(0)).withColumn(f"{edge.child}_nn", F.lit(1))
    return joined.unionByName(alone, allowMissingColumns=True)


def fixed_sample(df: DataFrame, n: int, *columns: str) -> DataFrame:
    """The ``n`` rows with the smallest hashes of ``columns``: a uniform sample without replacement that can be repeated."""
    return df.orderBy(F.xxhash64(*columns), *columns).limit(n)


def grouped(df: DataFrame, columns: list[str], count: str) -> DataFrame:
    """The distinct rows of ``columns`` and in ``count`` how many rows of ``df`` each stands for, written once.

    For joins that several passes read: the join is worked out once, and what is written has no more rows
    than it, far fewer where the columns have few values.
    """
    return written(df.groupBy(*columns).agg(F.count(F.lit(1)).alias(count)))


def outer_join_sample(parent: DataFrame, child: DataFrame, edge: Relationship, n: int, key: str, factor: int = 30) -> DataFrame:
    """About ``n`` rows of a full outer join without joining all of it.

    The start table's rate is ``n`` over the join's estimated size times ``factor``; the rows with the
    smallest hashes stay.
    """
    one = edge_statistics(parent, child, edge).first()
    _, whole = join_size_estimate({(edge.child, edge.parent): one.asDict()}, {edge.parent: one["parents"]}, [edge])
    rate = min(1.0, n / whole * factor) if whole else 1.0
    return fixed_sample(sampled_outer_join(parent, child, edge, rate, key), n, edge.pk, key)


def split_for_learning(df: DataFrame, share: float | None = None, before: tuple[str, object] | None = None, keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """First part and later part: ``share`` of the rows (by the hash of ``keys``) come later, or those with column >= value."""
    if before is not None:
        column, value = before
        return df.where(F.col(column) < value), df.where(F.col(column) >= value)
    later = hashed_below(share or 0.0, *(keys or df.columns))
    return df.where(~later), df.where(later)


def join_columns(schema: SchemaGraph, tables: dict[str, DataFrame], names: list[str]) -> int:
    """Number of columns of a join of the named tables, with an indicator and the incoming fan-outs (both kinds) of each."""
    fan_outs = sum(2 for r in schema.relationships if r.parent in names)
    return sum(len(tables[t].columns) + 1 for t in names) + fan_outs


def sampled_estimate(samples: dict[str, DataFrame], conditions: dict[str, Column], size: float) -> DataFrame:
    """Selectivities on samples of the tables times the join's size; one row ``estimate``."""
    total = None
    for k, (name, df) in enumerate(samples.items()):
        part = df.agg(F.avg(conditions.get(name, F.lit(True)).cast("double")).alias(f"p{k}"))
        total = part if total is None else total.join(F.broadcast(part))  # one row each
    product = F.lit(float(size))
    for k in range(len(samples)):
        product = product * F.col(f"p{k}")
    return total.select(product.alias("estimate"))


def consistent_samples(schema: SchemaGraph, tables: dict[str, DataFrame], start: str, rate: float, most_rows: int | None = None) -> dict[str, DataFrame]:
    """Referentially consistent samples of all tables that edges connect with ``start``.

    The start table is sampled by the hash of its key; from there, a child keeps the rows whose parent
    is in the sample, and a parent the rows that a kept child refers to.  ``most_rows`` cuts the start
    table to the rows with the smallest hashes.  Edges that would close a circle are left alone.
    """
    key = schema.table(start).key
    own = tables[start].where(hashed_below(rate, key))
    kept = {start: own if most_rows is None else fixed_sample(own, most_rows, key)}
    waiting = [start]
    while waiting:
        name = waiting.pop(0)
        for r in schema.relationships:
            if r.parent == name and r.child in tables and r.child not in kept:
                kept[r.child] = with_partner(tables[r.child], kept[name], r.fk, r.pk)
                waiting.append(r.child)
            elif r.child == name and r.parent in tables and r.parent not in kept:
                kept[r.parent] = with_partner(tables[r.parent], kept[name], r.pk, r.fk)
                waiting.append(r.parent)
    return kept
