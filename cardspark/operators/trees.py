"""Tree-shaped models of tables: learnt from encoded columns, and asked for probabilities of many queries at once.

A model is a Chow-Liu tree over a table's columns with the joint counts of the codes at both ends of
each edge.  Sizes follow from the encodings (at most some dozens of codes a column), so models are
plain values on the driver and a one-row relation in queries.  Queries are a relation of conditions;
what a query asks of a column becomes an array of weights by code, and one projection sends the
messages of the whole tree, from the leaves to the root, for each query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardspark.operators import encode, stats
from cardspark.operators.encode import Encoding
from cardspark.session import written

#: Schema of conditions: comparisons take one value, ``in`` and ``not in`` several, null tests none; numbers as text.
CONDITIONS = "query_id long, attribute string, op string, values array<string>"


@dataclass(frozen=True)
class TreeModel:
    """Encodings, directed edges (parents first) and joint counts by edge (codes of the parent, codes of the child)."""

    rows: int
    encodings: tuple[Encoding, ...]
    edges: tuple[tuple[str, str], ...]
    joint: dict[tuple[str, str], list[list[int]]]
    single: dict[str, list[int]]

    @property
    def columns(self) -> list[str]:
        return [e.column for e in self.encodings]

    def encoding(self, column: str) -> Encoding:
        return next(e for e in self.encodings if e.column == column)

    def rooted(self, root: str) -> list[tuple[str | None, str]]:
        """(parent, node) of the tree seen from ``root``, parents first; columns out of its reach are roots of their own."""
        near: dict[str, list[str]] = {c: [] for c in self.columns}
        for a, b in self.edges:
            near[a].append(b)
            near[b].append(a)
        order, seen = [], set()
        for start in [root, *self.columns]:
            waiting = [(None, start)] if start not in seen else []
            while waiting:
                above, node = waiting.pop(0)
                seen.add(node)
                order.append((above, node))
                waiting += [(node, x) for x in sorted(near[node]) if x not in seen]
        return order

    def table(self, parent: str | None, node: str) -> list[list[float]]:
        """P(node | parent), a row for each code of the parent; a code never seen has a uniform row."""
        if parent is None:
            counts = [self.single[node]]
        elif (parent, node) in self.joint:
            counts = self.joint[parent, node]
        else:
            counts = [list(x) for x in zip(*self.joint[node, parent])]
        return [[c / total for c in row] if (total := sum(row)) else [1 / len(row)] * len(row) for row in counts]


def pair_counts(df: DataFrame, encodings: list[Encoding], pairs: list[tuple[str, str]], weight: str | None = None) -> DataFrame:
    """(pair, x, y, n) of the codes of the listed pairs of columns, in one pass; only sums by task are shuffled.

    A task codes and counts its rows as Arrow batches: as expressions, the codes of a few columns make
    up a method that is too long to be compiled.  A task holds a number for each pair of codes.
    """
    names = sorted({c for p in pairs for c in p})
    own = {e.column: e for e in encodings}
    size = {c: own[c].size for c in names}
    starts = np.cumsum([0, *(size[a] * size[b] for a, b in pairs)])
    coders = {c: own[c].coder() for c in names}
    rows = df.select(*(own[c].plain().alias(f"c{k}") for k, c in enumerate(names)), *([F.col(weight).cast("long").alias("n")] if weight else []))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(starts[-1], np.int64)
        for batch in batches:
            codes = {c: coders[c](batch.column(k)) for k, c in enumerate(names)}
            many = batch.column(len(names)).to_numpy() if weight else None
            for k, (a, b) in enumerate(pairs):
                found = np.bincount(codes[a] * size[b] + codes[b], many, size[a] * size[b])  # exact up to 2^53 a batch
                total[starts[k] : starts[k + 1]] += found.astype(np.int64)
        at = np.flatnonzero(total)
        pair = np.searchsorted(starts, at, "right") - 1
        x, y = np.divmod(at - starts[pair], np.array([size[b] for _, b in pairs])[pair])
        yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int32()), pa.array(x, pa.int32()), pa.array(y, pa.int32()), pa.array(total[at])], ["pair", "x", "y", "n"])

    return rows.mapInArrow(counted, "pair int, x int, y int, n long").groupBy("pair", "x", "y").agg(F.sum("n").alias("n"))


def learn_edges(counts: DataFrame, columns: list[str], pairs: list[tuple[str, str]], root: str | None = None) -> list[tuple[str, str]]:
    """Directed edges of the Chow-Liu tree over ``columns``, from the counts of ``pair_counts`` for all pairs of them."""
    whole, by_x, by_y = (Window.partitionBy("pair", *extra) for extra in ([], ["x"], ["y"]))
    counts = counts.select("pair", "n", F.sum("n").over(whole).alias("t"), F.sum("n").over(by_x).alias("nx"), F.sum("n").over(by_y).alias("ny"))
    gain = F.col("n") / F.col("t") * F.log(F.col("n").cast("double") * F.col("t") / (F.col("nx").cast("double") * F.col("ny")))
    found = stats.maximum_tree([(*pairs[r["pair"]], r["mi"]) for r in counts.groupBy("pair").agg(F.sum(gain).alias("mi")).collect()])  # a row for each pair of columns
    near: dict[str, list[str]] = {c: [] for c in columns}
    for a, b, _ in found:
        near[a].append(b)
        near[b].append(a)
    edges, seen = [], set()
    for start in [root or columns[0], *columns]:
        waiting = [start] if start not in seen else []
        seen.add(start)
        while waiting:
            node = waiting.pop(0)
            for x in sorted(near[node]):
                if x not in seen:
                    seen.add(x)
                    edges.append((node, x))
                    waiting.append(x)
    return edges


def fit(df: DataFrame, columns: list[str], n_mcv: int = 30, n_bins: int = 30, root: str | None = None, edges: list[tuple[str, str]] | None = None, error: float | None = 0.02, weight: str | None = None) -> TreeModel:
    """A model of ``columns``: encodings, structure (unless ``edges`` are given) and counts, each from Spark jobs over all rows.

    Where the structure is to be learnt, the codes of all pairs are counted once, for it and for the model's tables.
    Nulls are a code of their own, so the whole domain always has probability 1.  An empty table gives
    a model without rows.  Rows may be grouped, with the number of rows that each stands for in ``weight``.
    """
    encodings = encode.encode_table(df, columns, n_mcv, n_bins, error, weight=weight)
    rows = sum(line[5] for line in encodings[0].lines) if encodings else 0
    size = {e.column: e.size for e in encodings}
    if edges is None and len(columns) < 3:  # only one tree
        edges = [(root or columns[0], next(c for c in columns if c != (root or columns[0])))] if len(columns) == 2 else []
    linked = list(combinations(columns, 2)) if edges is None else edges
    pairs = [*linked, *((c, c) for c in columns)]
    counts = pair_counts(df, encodings, pairs, weight)
    if edges is None:
        counts = written(counts)  # at most the product of two columns' codes for each pair
        edges = learn_edges(counts.where(F.col("pair") < len(linked)), columns, linked, root)
    # A pair may be counted the other way round than its edge leads.
    wanted = {**{k: p for k, p in enumerate(pairs) if p in edges or p[0] == p[1]}, **{pairs.index((b, a)): (a, b) for a, b in edges if (a, b) not in pairs}}
    joint = {p: [[0] * size[p[1]] for _ in range(size[p[0]])] for p in wanted.values()}
    for r in counts.where(F.col("pair").isin(list(wanted))).collect():  # at most the product of two columns' codes for each edge
        pair = wanted[r["pair"]]
        i, j = (r["x"], r["y"]) if pair == pairs[r["pair"]] else (r["y"], r["x"])
        joint[pair][i][j] = r["n"]
    single = {c: [joint[c, c][i][i] for i in range(size[c])] for c in columns}
    return TreeModel(rows, tuple(encodings), tuple(edges), {p: joint[p] for p in edges}, single)


def tables(spark: SparkSession, model: TreeModel) -> DataFrame:
    """(parent, attribute, parent_code, code, p): the model's conditional tables as a relation."""
    rows = [(above, node, i if above else None, j, float(p)) for above, node in model.rooted(model.columns[0]) for i, row in enumerate(model.table(above, node)) for j, p in enumerate(row)]
    return spark.createDataFrame(rows, "parent string, attribute string, parent_code int, code int, p double")


def faulty_tables(found: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Rows of conditional tables that don't sum to 1."""
    sums = found.groupBy("attribute", "parent", "parent_code").agg(F.sum("p").alias("total"))
    return sums.where(F.abs(F.col("total") - 1) > tolerance)


def weights(conditions: DataFrame, lines: DataFrame) -> DataFrame:
    """(query_id, attribute, w): what each query asks of a column, as an array of weights by code.

    A value of a dictionary weighs its share of its code, a bin the share of it that the ranges cover;
    an equality within a bin weighs one of its values.  Conditions on one column hold together, and the
    shares of a code add up to 1 at most.
    """
    both = conditions.join(F.broadcast(lines), "attribute")
    numbers = F.transform("values", lambda v: v.try_cast("double"))
    number, bound = F.col("number"), F.get(numbers, F.lit(0))
    known = F.col("code") > 0
    listed = F.when(F.col("numeric"), F.array_contains(numbers, number)).otherwise(F.array_contains("values", F.col("text")))

    def side(compare) -> Column:
        return F.when(F.col("numeric"), compare(number, bound)).otherwise(compare(F.col("text"), F.get("values", F.lit(0)))).cast("double")

    # Of a bin: the share below the bound, the share above it, and the values listed that lie in it.
    width = F.col("hi") - F.col("lo")
    below = F.when(width > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (bound - F.col("lo")) / width))).otherwise((F.col("lo") <= bound).cast("double"))
    above = F.when(width > 0, 1 - below).otherwise((F.col("lo") >= bound).cast("double"))
    points = F.size(F.filter(F.array_distinct(numbers), lambda x: (x <= F.col("hi")) & ((x > F.col("lo")) | ((F.col("code") == 1) & (x == F.col("lo")))))) / F.col("d")
    binned, op = F.col("kind") == "continuous", F.lower("op")
    w = (
        F.when(op == "is null", (~known).cast("double")).when(~known, F.lit(0.0)).when(op == "is not null", F.lit(1.0))
        .when(op == "<", F.when(binned, below).otherwise(side(lambda a, b: a < b))).when(op == "<=", F.when(binned, below).otherwise(side(lambda a, b: a <= b)))
        .when(op == ">", F.when(binned, above).otherwise(side(lambda a, b: a > b))).when(op == ">=", F.when(binned, above).otherwise(side(lambda a, b: a >= b)))
        .when(op.isin("=", "==", "in"), F.when(binned, F.least(points, F.lit(1.0))).otherwise(listed.cast("double")))
        .when(op.isin("<>", "!=", "not in"), F.when(binned, F.greatest(1 - points, F.lit(0.0))).otherwise((~listed).cast("double")))
    )
    kinds = {"up": op.isin(">", ">="), "down": op.isin("<", "<=")}
    line = ["query_id", "attribute", "size", "code", "share", "text", "lo"]
    per_line = both.withColumn("w", F.coalesce(w, F.lit(0.0))).groupBy(*line).agg(
        F.coalesce(F.min(F.when(kinds["up"], F.col("w"))), F.lit(1.0)).alias("up"), F.coalesce(F.min(F.when(kinds["down"], F.col("w"))), F.lit(1.0)).alias("down"),
        F.coalesce(F.min(F.when(~kinds["up"] & ~kinds["down"], F.col("w"))), F.lit(1.0)).alias("rest"),
    )
    held = F.greatest(F.lit(0.0), F.col("up") + F.col("down") - 1) * F.col("rest")
    per_code = per_line.groupBy("query_id", "attribute", "size", "code").agg(F.least(F.sum(held * F.col("share")), F.lit(1.0)).alias("w"))
    packed = per_code.groupBy("query_id", "attribute", "size").agg(F.map_from_entries(F.collect_list(F.struct("code", "w"))).alias("m"))  # one entry for each code
    return packed.select("query_id", "attribute", F.expr("transform(sequence(0, size - 1), c -> coalesce(m[c], 0D))").alias("w"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _upwards(k: int, join) -> Column:
    """What column ``k`` tells each code of its parent."""
    return F.transform(f"t_{k}", lambda row: join(row, F.col(f"v_{k}")))


def _asked(model: TreeModel, conditions: DataFrame, queries: DataFrame | None, attributes: set[str] | None = None) -> tuple[DataFrame, set[str]]:
    """A row for each query with the arrays of weights by column (null where nothing is asked), and the columns asked for.

    ``known`` tells whether the model has all columns that a query names.  ``attributes`` are the columns that
    conditions name, where that is known.
    """
    spark, columns = conditions.sparkSession, model.columns
    if attributes is None:
        attributes = {r["attribute"] for r in conditions.select("attribute").distinct().where(F.col("attribute").isin(columns)).collect()}  # at most the model's columns
    asked = attributes & set(columns)
    ids = conditions.select("query_id").distinct() if queries is None else queries.select("query_id").distinct()
    if queries is None:
        known = conditions.groupBy("query_id").agg(F.min(F.col("attribute").isin(columns)).alias("known"))
        rows = ids.join(known, "query_id")
    else:
        rows = ids.withColumn("known", F.lit(True))
    if asked:
        lines = encode.encoding_lines(spark, [e for e in model.encodings if e.column in asked])
        found = weights(conditions, lines).groupBy("query_id").pivot("attribute", sorted(asked)).agg(F.first("w"))
        rows = rows.join(found.select("query_id", *(F.col(f"`{c}`").alias(f"w_{columns.index(c)}") for c in sorted(asked))), "query_id", "left")
    return rows, asked


def _sent(model: TreeModel, rows: DataFrame, asked: set[str], root: str, fan_outs: list[str] = ()) -> tuple[DataFrame, str | None, list[str]]:
    """Messages towards ``root``: adds each asked tree's products; gives the column of the root's weights and other trees' results.

    Only the part of the tree that connects the columns asked for and ``root`` is walked.
    """
    columns, order = model.columns, model.rooted(root)
    children: dict[str, list[str]] = {c: [] for c in columns}
    for above, node in order:
        if above:
            children[above].append(node)
    need = {}
    for _, node in reversed(order):
        need[node] = node in asked or node in fan_outs or any(need[x] for x in children[node])
    constants: dict[str, object] = {}
    for above, node in order:
        if need[node] or node == root:
            constants[f"t_{columns.index(node)}"] = model.table(above, node)
            if node in fan_outs:
                constants[f"f_{columns.index(node)}"] = list(model.encoding(node).fan_out)
    spark = rows.sparkSession
    schema = ", ".join(f"{k} array<{'double' if k[0] == 'f' else 'array<double>'}>" for k in constants)
    rows = rows.join(F.broadcast(spark.createDataFrame([tuple(constants.values())], schema)))  # one row
    others, top = [], None
    for above, node in reversed(order):
        if not need[node] and node != root:
            continue
        k, own = columns.index(node), model.encoding(node).size
        parts = [F.coalesce(f"w_{k}", F.array_repeat(F.lit(1.0), own))] if node in asked else []
        parts += [F.col(f"f_{k}")] if node in fan_outs else []
        parts += [F.col(f"m_{columns.index(x)}") for x in children[node] if need[x]]
        total = parts[0] if parts else F.array_repeat(F.lit(1.0), own)
        for x in parts[1:]:
            total = F.zip_with(total, x, lambda a, b: a * b)
        rows = rows.withColumn(f"v_{k}", total)
        if above:
            rows = rows.withColumn(f"m_{k}", _upwards(k, _dot))
        elif node == root:
            top = f"v_{k}"
        else:
            rows = rows.withColumn(f"m_{k}", _dot(F.get(f"t_{k}", F.lit(0)), F.col(f"v_{k}")))
            others.append(f"m_{k}")
    return rows, top, others


def expectation(model: TreeModel, conditions: DataFrame, fan_outs: list[str] = (), queries: DataFrame | None = None, attributes: set[str] | None = None) -> DataFrame:
    """(query_id, p, cardinality): E[1(conditions) * product of fan-outs], and that times the model's rows.

    ``conditions`` has the columns of ``CONDITIONS``.  A query that names a column unknown to the model has a
    null result, unless ``queries`` lists the ids: then only what the model knows counts, and queries without
    conditions have an answer as well.  Fan-outs are columns of the model (see ``encode.fan_out_kind``).
    """
    rows, asked = _asked(model, conditions, queries, attributes)
    if not model.rows:
        return rows.select("query_id", F.when(F.col("known"), F.lit(0.0)).alias("p"), F.when(F.col("known"), F.lit(0.0)).alias("cardinality"))
    root = next((c for c in model.columns if c in asked or c in fan_outs), model.columns[0])
    rows, top, others = _sent(model, rows, asked, root, list(fan_outs))
    p = _dot(F.get(f"t_{model.columns.index(root)}", F.lit(0)), F.col(top))
    for other in others:
        p = p * F.col(other)
    return rows.select("query_id", F.when(F.col("known"), p).alias("p")).withColumn("cardinality", F.col("p") * model.rows)


def estimate(model: TreeModel, conditions: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, p, cardinality) of conjunctive queries; see :func:`expectation`."""
    return expectation(model, conditions, (), queries)


def group_estimate(model: TreeModel, conditions: DataFrame, group: str, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, text, number, lo, hi, cardinality): the estimate for each value (or bin) of a column that has one; null's has neither."""
    rows, asked = _asked(model, conditions, queries)
    rows, top, others = _sent(model, rows, asked, group)
    mass = F.zip_with(F.get(f"t_{model.columns.index(group)}", F.lit(0)), F.col(top), lambda a, b: a * b)
    rows = rows.where("known").select("query_id", *others, F.posexplode(mass).alias("code", "p"))
    lines = encode.encoding_lines(conditions.sparkSession, [model.encoding(group)]).select("code", "text", "number", "lo", "hi", "share")
    size = F.col("p") * F.col("share") * model.rows
    for other in others:
        size = size * F.col(other)
    return rows.join(F.broadcast(lines), "code").select("query_id", "text", "number", "lo", "hi", size.alias("cardinality")).where("cardinality > 0")


def most_likely(model: TreeModel, conditions: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, attribute, code, p): the likeliest codes of all columns together under the conditions, and their probability.

    Messages carry the largest product instead of the sum; going back down, each column takes the first
    code that reaches it.
    """
    rows, asked = _asked(model, conditions, queries)
    columns, order = model.columns, model.rooted(model.columns[0])
    constants = {f"t_{columns.index(node)}": model.table(above, node) for above, node in order}
    one = conditions.sparkSession.createDataFrame([tuple(constants.values())], ", ".join(f"{k} array<array<double>>" for k in constants))
    rows = rows.where("known").join(F.broadcast(one))
    children: dict[str, list[str]] = {c: [] for c in columns}
    for above, node in order:
        if above:
            children[above].append(node)

    def times(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: x * y)

    for above, node in reversed(order):
        k = columns.index(node)
        total = F.coalesce(f"w_{k}", F.array_repeat(F.lit(1.0), model.encoding(node).size)) if node in asked else F.array_repeat(F.lit(1.0), model.encoding(node).size)
        for x in children[node]:
            total = times(total, F.col(f"m_{columns.index(x)}"))
        rows = rows.withColumn(f"v_{k}", total)
        if above:
            rows = rows.withColumn(f"m_{k}", _upwards(k, lambda row, v: F.array_max(times(row, v))))
    best = F.lit(1.0)
    for above, node in order:
        k = columns.index(node)
        row = F.get(f"t_{k}", F.col(f"c_{columns.index(above)}") if above else F.lit(0))
        rows = rows.withColumn(f"r_{k}", times(row, F.col(f"v_{k}")))
        rows = rows.withColumn(f"c_{k}", (F.array_position(f"r_{k}", F.array_max(f"r_{k}")) - 1).cast("int"))
        best = best if above else best * F.array_max(f"r_{k}")
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("attribute"), F.col(f"c_{k}").alias("code")) for k, c in enumerate(columns)))).alias("x")
    return rows.withColumn("p", best).where("p > 0").select("query_id", "p", each).select("query_id", "x.attribute", "x.code", "p")


def predicted(model: TreeModel, df: DataFrame, target: str, given: list[str]) -> DataFrame:
    """``df`` with the likeliest code of ``target``, given the codes of other columns; worked out once for each distinct row of codes.

    Codes never seen together leave the likeliest code of ``target`` by itself.
    """
    codes = encode.encoded(df, [model.encoding(c) for c in given], keep=[c for c in df.columns if c not in given])
    k = model.columns.index(target)
    seen = codes.select(*given).distinct()
    rows = seen.select("*", *(F.expr(f"transform(sequence(0, {model.encoding(c).size - 1}), i -> if(i = `{c}`, 1D, 0D))").alias(f"w_{model.columns.index(c)}") for c in given))
    rows, top, _ = _sent(model, rows.withColumn("known", F.lit(True)), set(given), target)
    own = F.get(f"t_{k}", F.lit(0))
    mass = F.zip_with(own, F.col(top), lambda a, b: a * b)
    mass = F.when(F.array_max(mass) > 0, mass).otherwise(own)
    likely = rows.select(*given, (F.array_position(mass, F.array_max(mass)) - 1).cast("int").alias(f"{target}_predicted"))
    return codes.join(likely, given)
