"""Estimates from models that are learnt from tables: single tables, groups, joins, and how far off they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardspark.catalog import order_schema
from cardspark.operators import encode, ensemble, evaluate, joins, trees
from cardspark.plans.registry import query

S = order_schema()


def asked(spark: SparkSession, lines: list[tuple]) -> DataFrame:
    """Conditions as (query_id, attribute, op, values...)."""
    return spark.createDataFrame([(k, a, op, [str(v) for v in values]) for k, a, op, *values in lines], trees.CONDITIONS)


def rounded(df: DataFrame) -> DataFrame:
    return df.select("query_id", F.round("cardinality", 3).alias("cardinality"))


_ONE_COLUMN = [
    (1, "l_quantity", "<", 10), (2, "l_returnflag", "in", "A", "R"), (3, "l_linestatus", "=", "O"), (4, "l_discount", ">=", 0.02), (4, "l_discount", "<=", 0.05),
    (5, "l_returnflag", "not in", "N"), (6, "l_quantity", "is not null"), (7, "l_quantity", "is null"), (8, "l_quantity", "=", -5), (9, "unknown", "=", 1), (10, "l_quantity", ">", 10), (10, "l_quantity", "in", 5, 11, 12, 12),
]
_COUNTS = [(1, "l_quantity < 10"), (2, "l_returnflag IN ('A', 'R')"), (3, "l_linestatus = 'O'"), (4, "l_discount BETWEEN 0.02 AND 0.05"), (5, "l_returnflag <> 'N'"), (6, "true"), (7, "false"), (8, "false"), (10, "l_quantity IN (11, 12)")]


@query(" UNION ALL ".join(f"SELECT {k}::BIGINT AS query_id, count(*)::DOUBLE AS cardinality FROM lineitem WHERE {c}" for k, c in _COUNTS) + " UNION ALL SELECT 9, NULL")
def model_single_column(spark: SparkSession, d: str) -> DataFrame:
    """Conditions on one column are exact where each value has a code of its own; one on an unknown column has no estimate."""
    columns = ["l_quantity", "l_returnflag", "l_linestatus", "l_discount"]
    model = trees.fit(S.read(spark, d, "lineitem"), columns, n_mcv=60)
    return rounded(trees.estimate(model, asked(spark, _ONE_COLUMN)))


@query("""SELECT 1::BIGINT AS query_id, count(*)::DOUBLE AS cardinality FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'
          UNION ALL SELECT 2, count(*) FROM lineitem WHERE l_returnflag <= 'N' AND l_linestatus IN ('O', 'F') UNION ALL SELECT 3, count(*) FROM lineitem WHERE l_linestatus > 'F' AND l_returnflag > 'A'""")
def model_two_columns(spark: SparkSession, d: str) -> DataFrame:
    """A tree of two columns is their joint distribution."""
    model = trees.fit(S.read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])
    lines = [(1, "l_returnflag", "=", "R"), (1, "l_linestatus", "=", "F"), (2, "l_returnflag", "<=", "N"), (2, "l_linestatus", "in", "O", "F"), (3, "l_linestatus", ">", "F"), (3, "l_returnflag", ">", "A")]
    return rounded(trees.estimate(model, asked(spark, lines)))


@query("""WITH j AS (SELECT d.lang, l.toxic, l.quality, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
          SELECT 1::BIGINT AS query_id, count(*)::DOUBLE AS cardinality FROM j UNION ALL SELECT 2, count(*) FROM j WHERE toxic IS NULL UNION ALL SELECT 3, count(*) FROM j WHERE toxic = 1 AND quality = 1
          UNION ALL SELECT 4, count(*) FROM j WHERE labelled AND toxic = 0 UNION ALL SELECT 5, count(*) FROM j WHERE NOT labelled AND toxic IS NULL""")
def model_null_states(spark: SparkSession, d: str) -> DataFrame:
    """A model of an outer join: nulls are a state, so nothing is lost on them."""
    edge = S.edge("labels", "documents")
    labels = S.read(spark, d, "labels").withColumnRenamed("doc_id", "label_doc_id")
    joined = joins.full_outer(S.read(spark, d, "documents").select("doc_id", "lang"), labels, type(edge)("labels", "label_doc_id", "documents", "doc_id"))
    model = trees.fit(joined, ["lang", "toxic", "quality", "labels_nn"], edges=[("toxic", "quality"), ("toxic", "labels_nn"), ("labels_nn", "lang")])
    lines = [(1, "labels_nn", "in", 0, 1), (2, "toxic", "is null"), (3, "toxic", "=", 1), (3, "quality", "=", 1), (4, "labels_nn", "=", 1), (4, "toxic", "=", 0), (5, "labels_nn", "=", 0), (5, "toxic", "is null")]
    return rounded(trees.estimate(model, asked(spark, lines)))


_STAR = """WITH f AS (SELECT l_returnflag AS f, count(*)::DOUBLE AS n, count(*) FILTER (l_linestatus = 'O')::DOUBLE AS a, count(*) FILTER (l_tax BETWEEN 0.02 AND 0.05)::DOUBLE AS b FROM lineitem GROUP BY 1)
           SELECT 1::BIGINT AS query_id, round(sum(a / n * b), 3) AS cardinality FROM f WHERE f IN ('N', 'R') UNION ALL SELECT 2, round(sum(a * b / n), 3) FROM f"""


@query(_STAR)
def model_tree(spark: SparkSession, d: str) -> DataFrame:
    """Three columns in a tree: two of them are independent given the third."""
    model = trees.fit(S.read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_tax"], edges=[("l_returnflag", "l_linestatus"), ("l_returnflag", "l_tax")])
    both = [(k, a, op, v) for k in (1, 2) for a, op, v in (("l_linestatus", "=", "O"), ("l_tax", ">=", 0.02), ("l_tax", "<=", 0.05))]
    return rounded(trees.estimate(model, asked(spark, [*both, (1, "l_returnflag", "in", "N", "R")])))


@query("""WITH m AS (SELECT o_orderstatus AS s, o_orderpriority AS p, coalesce(n, 0) AS k FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)
          SELECT 1::BIGINT AS query_id, round(sum(f * u), 3) AS cardinality FROM (SELECT avg(k) AS f, count(*) FILTER (p = '1-URGENT')::DOUBLE AS u FROM m GROUP BY s)""")
def model_expectation(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a join with the children, from the parents' model: the expectation of their fan-out."""
    edge = S.edge("lineitem", "orders")
    orders = joins.with_fan_out(S.read(spark, d, "orders"), S.read(spark, d, "lineitem"), edge)
    model = trees.fit(orders, ["o_orderstatus", "o_orderpriority", edge.fan_out], edges=[("o_orderstatus", "o_orderpriority"), ("o_orderstatus", edge.fan_out)])
    return rounded(trees.expectation(model, asked(spark, [(1, "o_orderpriority", "=", "1-URGENT")]), [edge.fan_out]))


_COLUMNS = {"customer": ["c_mktsegment"], "orders": ["o_orderstatus"], "lineitem": ["l_returnflag"]}


def _edge_model(spark: SparkSession, d: str, child: str, parent: str) -> ensemble.EdgeModel:
    """The model of an edge in which each column hangs directly on the orders' status."""
    edge, status = S.edge(child, parent), "o_orderstatus"
    other = _COLUMNS[parent if child == "orders" else child][0]
    free = [c for c in ensemble.edge_columns(edge, _COLUMNS) if c not in (status, other)]
    tree = [(status, other), *((other if c == f"{'customer' if parent == 'customer' else 'lineitem'}_nn" else status, c) for c in free)]
    return ensemble.fit_edge(S.read(spark, d, parent), S.read(spark, d, child), edge, _COLUMNS, edges=tree)


@query("SELECT 1::BIGINT AS query_id, count(*)::DOUBLE AS cardinality FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND l_returnflag = 'R' UNION ALL SELECT 2, count(*) FROM orders WHERE o_orderstatus = 'F'")
def model_outer_join(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of an inner join and of one of its sides, each from the model of the full outer join."""
    one = _edge_model(spark, d, "lineitem", "orders")
    conditions = asked(spark, [(1, "o_orderstatus", "=", "F"), (1, "l_returnflag", "=", "R")])
    pair = ensemble.pair_estimate(one, conditions, conditions)
    side = ensemble.side_estimate(one, "orders", _COLUMNS["orders"], conditions, conditions).withColumn("query_id", F.lit(2).cast("long"))
    return rounded(pair.unionByName(side))


@query("""WITH a AS (SELECT count(*)::DOUBLE AS n FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F'),
          b AS (SELECT count(*)::DOUBLE AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND l_returnflag = 'R'), c AS (SELECT count(*)::DOUBLE AS n FROM orders WHERE o_orderstatus = 'F')
          SELECT 1::BIGINT AS query_id, round(greatest(1, a.n * b.n / c.n), 3) AS cardinality FROM a, b, c""")
def model_join_of_three(spark: SparkSession, d: str) -> DataFrame:
    """A join of three tables from two models that share one of them."""
    models = {(child, parent): _edge_model(spark, d, child, parent) for child, parent in (("orders", "customer"), ("lineitem", "orders"))}
    conditions = asked(spark, [(1, "c_mktsegment", "=", "BUILDING"), (1, "o_orderstatus", "=", "F"), (1, "l_returnflag", "=", "R")])
    return rounded(ensemble.join_estimate(models, [m.edge for m in models.values()], _COLUMNS, conditions))


@query("""WITH s AS (SELECT (SELECT count(*)::DOUBLE FROM customer WHERE c_mktsegment = 'BUILDING') / (SELECT count(*) FROM customer) AS a, (SELECT count(*)::DOUBLE FROM orders WHERE o_orderstatus = 'F') / (SELECT count(*) FROM orders) AS b)
          SELECT 1::BIGINT AS query_id, round(a * b * (SELECT count(*) FROM customer FULL JOIN orders ON c_custkey = o_custkey), 3) AS cardinality FROM s""")
def model_naive_join(spark: SparkSession, d: str) -> DataFrame:
    """Selectivities of the tables' own models times a join size that is estimated without joining."""
    tables = {name: S.read(spark, d, name) for name in ("customer", "orders")}
    edge = S.edge("orders", "customer")
    one = joins.edge_statistics(tables["customer"], tables["orders"], edge).first().asDict()
    _, size = joins.join_size_estimate({("orders", "customer"): one}, {"customer": one["parents"]}, [edge])
    models = ensemble.fit_tables(tables, {name: _COLUMNS[name] for name in tables})
    return rounded(ensemble.naive_join_estimate(models, size, asked(spark, [(1, "c_mktsegment", "=", "BUILDING"), (1, "o_orderstatus", "=", "F")])))


@query("SELECT 1::BIGINT AS query_id, l_returnflag AS text, count(*)::DOUBLE AS cardinality FROM lineitem WHERE l_linestatus = 'O' GROUP BY 2")
def model_groups(spark: SparkSession, d: str) -> DataFrame:
    """A group-by answered by a model."""
    model = trees.fit(S.read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])
    out = trees.group_estimate(model, asked(spark, [(1, "l_linestatus", "=", "O")]), "l_returnflag")
    return out.select("query_id", "text", F.round("cardinality", 3).alias("cardinality"))


@query("""WITH j AS (SELECT l_returnflag AS f, l_linenumber AS s, count(*) AS n FROM lineitem GROUP BY 1, 2), b AS (SELECT 1::BIGINT AS query_id, * FROM j QUALIFY row_number() OVER (ORDER BY n DESC) = 1
          UNION ALL SELECT 2, * FROM j WHERE f = 'R' QUALIFY row_number() OVER (ORDER BY n DESC) = 1)
          SELECT query_id, round(n / (SELECT count(*) FROM lineitem), 6) AS p FROM b""")
def model_most_likely(spark: SparkSession, d: str) -> DataFrame:
    """The likeliest states of all columns together, and how likely they are."""
    model = trees.fit(S.read(spark, d, "lineitem"), ["l_returnflag", "l_linenumber"])
    out = trees.most_likely(model, asked(spark, [(1, "l_linenumber", "is not null"), (2, "l_returnflag", "=", "R")]))
    return out.groupBy("query_id").agg(F.round(F.max("p"), 6).alias("p"))


@query("SELECT 0::BIGINT AS faulty, (count(DISTINCT l_returnflag) + 1) * (count(DISTINCT l_linestatus) + 2) AS lines FROM lineitem")
def model_tables(spark: SparkSession, d: str) -> DataFrame:
    """The model's conditional tables as a relation, a line for each pair of codes (null's included); each row sums to 1."""
    model = trees.fit(S.read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], edges=[("l_returnflag", "l_linestatus")])
    found = trees.tables(spark, model)
    faulty = trees.faulty_tables(found).agg(F.count(F.lit(1)).alias("faulty"))
    return found.agg(F.count(F.lit(1)).alias("lines")).join(F.broadcast(faulty)).select("faulty", "lines")


@query("""SELECT 'l_returnflag' AS attribute, l_returnflag AS text, row_number() OVER (ORDER BY count(*) DESC, l_returnflag)::INT AS code, count(*) AS n, 1.0::DOUBLE AS share FROM lineitem GROUP BY l_returnflag
          UNION ALL SELECT 'l_linestatus', l_linestatus, row_number() OVER (ORDER BY count(*) DESC, l_linestatus)::INT, count(*), 1.0 FROM lineitem GROUP BY l_linestatus""")
def table_encoding(spark: SparkSession, d: str) -> DataFrame:
    """Dictionaries of a whole table's columns, from one call."""
    found = encode.encode_table(S.read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])
    return encode.encoding_lines(spark, found).where("code > 0").select("attribute", "text", "code", "n", "share")


@query("""SELECT l_returnflag AS text, row_number() OVER (ORDER BY count(*) DESC, l_returnflag)::INT AS code, count(*) AS n FROM lineitem GROUP BY l_returnflag""")
def encoded_table(spark: SparkSession, d: str) -> DataFrame:
    """A table's rows with codes for values."""
    lineitem = S.read(spark, d, "lineitem").withColumn("flag", F.col("l_returnflag"))
    found = encode.encode_table(lineitem, ["l_returnflag", "l_quantity"])
    return encode.encoded(lineitem, found, ["flag"]).groupBy(F.col("flag").alias("text"), F.col("l_returnflag").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'l_returnflag' AS attribute, 'A' AS text, true AS known, 1.0::DOUBLE AS share UNION ALL SELECT 'l_returnflag', 'Z', false, NULL")
def value_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Values looked up in an encoding."""
    lines = encode.encoding_lines(spark, encode.encode_table(S.read(spark, d, "lineitem"), ["l_returnflag"]))
    values = spark.createDataFrame([("l_returnflag", "A"), ("l_returnflag", "Z")], "attribute string, text string")
    return encode.looked_up(lines, values).select("attribute", "text", F.col("code").isNotNull().alias("known"), "share")


def workload(df: DataFrame, columns: list[str], n: int, weight: str | None = None) -> DataFrame:
    """``n`` queries of two conditions around values of rows with the smallest hashes, the same ones every time.

    Rows may be grouped, with the number of rows that each stands for in ``weight``: each counts as often, so the queries are the same.
    """
    numeric = encode.numeric_columns(df)
    if weight:
        first = joins.fixed_sample(df.select(*columns, F.least(F.col(weight), F.lit(n)).alias("__times")), n, *columns)
        df = first.withColumn("__time", F.explode(F.sequence(F.lit(1).cast("long"), "__times")))
    rows = joins.fixed_sample(df.select(*columns), n, *columns).withColumn("query_id", F.row_number().over(_by_hash(columns)).cast("long"))
    each = []
    for k, c in enumerate(columns):
        op = F.when(F.pmod("query_id", F.lit(3)) == k % 3, F.lit("=")).otherwise(F.lit("<=" if k % 2 else ">=")) if c in numeric else F.lit("=")
        each.append(F.struct(F.lit(c).alias("attribute"), op.alias("op"), F.array(F.col(c).cast("string")).alias("values"), F.pmod(F.xxhash64("query_id", F.lit(c)), F.lit(100)).alias("h")))
    lines = rows.select("query_id", F.explode(F.slice(F.array_sort(F.array(*each), lambda a, b: (a["h"] - b["h"]).cast("int")), 1, 2)).alias("x"))
    return lines.select("query_id", "x.attribute", "x.op", "x.values").where("values[0] IS NOT NULL")


def _by_hash(columns: list[str]):
    from pyspark.sql import Window

    return Window.orderBy(F.xxhash64(*columns), *columns)  # over the workload's queries only


#: Columns of the workload over one table.
WORK = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_extendedprice"]


@query()
def model_q_errors(spark: SparkSession, d: str) -> DataFrame:
    """q-errors of a learnt model over 60 queries with true counts."""
    lineitem = S.read(spark, d, "lineitem")
    model = trees.fit(lineitem, WORK)
    conditions = workload(lineitem, WORK, 60).cache()
    both = ensemble.true_counts(lineitem, conditions).withColumnRenamed("cardinality", "truth").join(trees.estimate(model, conditions), "query_id", "left")
    return evaluate.q_error_report(both, "cardinality", "truth")


#: Columns of the workload over a join.
JOIN_WORK = {"customer": ["c_mktsegment", "c_nationkey"], "orders": ["o_orderstatus", "o_orderpriority"], "lineitem": ["l_returnflag", "l_quantity"]}


@query()
def model_join_q_errors(spark: SparkSession, d: str) -> DataFrame:
    """q-errors of learnt edge models over 30 queries on a join of three tables."""
    tables = {name: S.read(spark, d, name) for name in JOIN_WORK}
    models = ensemble.fit_edges(S, tables, JOIN_WORK)
    edges = [m.edge for m in models.values()]
    joined = tables["lineitem"].join(tables["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(tables["customer"], F.col("o_custkey") == F.col("c_custkey"))
    columns = [c for own in JOIN_WORK.values() for c in own]
    rows = joins.grouped(joined, columns, "__rows")
    conditions = workload(rows, columns, 30, "__rows").cache()
    both = ensemble.true_counts(rows, conditions, weight="__rows").withColumnRenamed("cardinality", "truth").join(ensemble.join_estimate(models, edges, JOIN_WORK, conditions), "query_id", "left")
    return evaluate.q_error_report(both, "cardinality", "truth")
