"""Scans, predicates, joins, fan-outs and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardspark.catalog import order_schema
from cardspark.functions.predicates import conjunction, md5_below
from cardspark.operators import joins
from cardspark.plans.registry import query

S = order_schema()


@query("SELECT p_partkey, p_brand, p_size FROM part")
def scan_project(spark: SparkSession, d: str) -> DataFrame:
    return S.read(spark, d, "part").select("p_partkey", "p_brand", "p_size")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 20 AND l_discount = 0.05 AND l_returnflag > 'A'")
def filter_conjunction(spark: SparkSession, d: str) -> DataFrame:
    atoms = [("l_quantity", ">=", 10.0), ("l_quantity", "<=", 20.0), ("l_discount", "=", 0.05), ("l_returnflag", ">", "A")]
    return S.read(spark, d, "lineitem").where(conjunction(atoms)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT p_partkey, p_type FROM part WHERE p_size IN (1, 5, 9) AND p_brand NOT IN ('Brand#11', 'Brand#22')")
def filter_membership(spark: SparkSession, d: str) -> DataFrame:
    return S.read(spark, d, "part").where(conjunction([("p_size", "in", (1, 5, 9)), ("p_brand", "not in", ("Brand#11", "Brand#22"))])).select("p_partkey", "p_type")


@query("SELECT count(*) AS n, sum(l_quantity) AS quantity FROM lineitem WHERE l_quantity > 5 AND l_quantity <= 30 AND l_quantity >= 10 AND l_quantity < 40")
def filter_range_merge(spark: SparkSession, d: str) -> DataFrame:
    atoms = [("l_quantity", ">", 5.0), ("l_quantity", "<=", 30.0), ("l_quantity", ">=", 10.0), ("l_quantity", "<", 40.0)]
    return S.read(spark, d, "lineitem").where(conjunction(atoms)).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query("SELECT p_partkey, p_size FROM part WHERE p_size IN (SELECT DISTINCT p_size FROM part WHERE p_size < 10)")
def domain_expansion(spark: SparkSession, d: str) -> DataFrame:
    part = S.read(spark, d, "part")
    return joins.with_partner(part, part.select("p_size").distinct().where("p_size < 10"), "p_size", "p_size").select("p_partkey", "p_size")


@query("SELECT count(*) AS n FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE')")
def dependency_rewrite(spark: SparkSession, d: str) -> DataFrame:
    """A condition on a dependent attribute becomes one on what determines it."""
    determinants = S.read(spark, d, "nation").join(S.read(spark, d, "region").where("r_name = 'EUROPE'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joins.with_partner(S.read(spark, d, "customer"), determinants, "c_nationkey", "n_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT r_name, n_name FROM (SELECT DISTINCT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey)")
def dependency_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return S.read(spark, d, "nation").join(S.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name").distinct()


@query("SELECT count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 100000")
def inner_join_two(spark: SparkSession, d: str) -> DataFrame:
    customer = S.read(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return customer.join(S.read(spark, d, "orders").where("o_totalprice > 100000"), F.col("o_custkey") == F.col("c_custkey")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity < 20 AND c_acctbal > 0 GROUP BY o_orderstatus")
def inner_join_three(spark: SparkSession, d: str) -> DataFrame:
    joined = S.read(spark, d, "lineitem").where("l_quantity < 20").join(S.read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(S.read(spark, d, "customer").where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_brand, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey WHERE p_size <= 10 AND c_mktsegment <> 'MACHINERY' GROUP BY p_brand")
def inner_join_four(spark: SparkSession, d: str) -> DataFrame:
    joined = (
        S.read(spark, d, "lineitem").join(S.read(spark, d, "part").where("p_size <= 10"), F.col("l_partkey") == F.col("p_partkey"))
        .join(S.read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(S.read(spark, d, "customer").where("c_mktsegment <> 'MACHINERY'"), F.col("o_custkey") == F.col("c_custkey"))
    )
    return joined.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("""SELECT (o_orderkey IS NOT NULL)::INT AS orders_nn, (l_orderkey IS NOT NULL)::INT AS lineitem_nn, count(*) AS n
          FROM orders FULL OUTER JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL""")
def full_outer_join(spark: SparkSession, d: str) -> DataFrame:
    joined = joins.full_outer(S.read(spark, d, "orders"), S.read(spark, d, "lineitem"), S.edge("lineitem", "orders"))
    return joined.groupBy("orders_nn", "lineitem_nn").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT d.doc_id, toxic IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def left_outer_join(spark: SparkSession, d: str) -> DataFrame:
    labels = S.read(spark, d, "labels").withColumnRenamed("doc_id", "__doc_id")
    return S.read(spark, d, "documents").join(labels, F.col("doc_id") == F.col("__doc_id"), "left").select("doc_id", F.col("toxic").isNotNull().alias("labelled"))


@query("SELECT 'orders' AS side, o_orderkey AS id FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey UNION ALL SELECT 'documents', doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def partnerless_rows(spark: SparkSession, d: str) -> DataFrame:
    orders = joins.without_partner(S.read(spark, d, "orders"), S.read(spark, d, "lineitem"), "o_orderkey", "l_orderkey")
    documents = joins.without_partner(S.read(spark, d, "documents"), S.read(spark, d, "labels"), "doc_id", "doc_id")
    return orders.select(F.lit("orders").alias("side"), F.col("o_orderkey").alias("id")).unionByName(documents.select(F.lit("documents").alias("side"), F.col("doc_id").alias("id")))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE md5(c_custkey::VARCHAR) < '40')")
def consistent_sample(spark: SparkSession, d: str) -> DataFrame:
    customers = S.read(spark, d, "customer").where(md5_below("40", "c_custkey"))
    return joins.with_partner(S.read(spark, d, "orders"), customers, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE md5(l_orderkey::VARCHAR || '|' || l_linenumber::VARCHAR) < '1a'")
def bernoulli_sample(spark: SparkSession, d: str) -> DataFrame:
    return S.read(spark, d, "lineitem").where(md5_below("1a", "l_orderkey", "l_linenumber")).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey, coalesce(n, 0) AS mul_lineitem_l_orderkey, greatest(coalesce(n, 0), 1) AS mul_lineitem_l_orderkey_nn FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def fan_out_columns(spark: SparkSession, d: str) -> DataFrame:
    edge = S.edge("lineitem", "orders")
    return joins.with_fan_out(S.read(spark, d, "orders"), S.read(spark, d, "lineitem"), edge).select("o_orderkey", edge.fan_out, f"{edge.fan_out}_nn")


_MEAN = "SELECT '{child}' AS child, '{parent}' AS parent, count(*) AS n_parents, round(avg(greatest(coalesce(n, 0), 1)), 6) AS mean_fan_out FROM {parent} LEFT JOIN (SELECT {fk} AS k, count(*) AS n FROM {child} GROUP BY 1) ON {parent}.{pk} = k"


@query(" UNION ALL ".join(_MEAN.format(child=r.child, parent=r.parent, fk=r.fk, pk=r.pk) for r in S.relationships))
def fan_out_means(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for r in S.relationships:  # one aggregation for each edge of the schema
        one = joins.mean_fan_out(S.read(spark, d, r.parent), S.read(spark, d, r.child), r).select(F.lit(r.child).alias("child"), F.lit(r.parent).alias("parent"), "n_parents", F.round("mean_fan_out", 6).alias("mean_fan_out"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH a AS (SELECT count(*) AS n, avg(greatest(coalesce(k, 0), 1)) AS m FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1) ON c_custkey = o_custkey),
          b AS (SELECT avg(greatest(coalesce(k, 0), 1)) AS m FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS k FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)
          SELECT round(a.n * a.m * b.m, 3) AS estimate,
                 (SELECT count(*) FROM customer FULL JOIN orders ON c_custkey = o_custkey FULL JOIN lineitem ON o_orderkey = l_orderkey) AS exact FROM a, b""")
def join_size_estimate(spark: SparkSession, d: str) -> DataFrame:
    customer, orders, lineitem = (S.read(spark, d, t) for t in ("customer", "orders", "lineitem"))
    first = joins.mean_fan_out(customer, orders, S.edge("orders", "customer")).first()
    second = joins.mean_fan_out(orders, lineitem, S.edge("lineitem", "orders")).first()
    size = joins.outer_join_size(first["n_parents"], [first["mean_fan_out"], second["mean_fan_out"]])
    whole = customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "full_outer").join(lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "full_outer")
    return whole.agg(F.round(F.lit(size), 3).alias("estimate"), F.count(F.lit(1)).alias("exact"))


@query("""SELECT count(*) AS exact, count(*)::DOUBLE AS from_outer_join FROM customer WHERE c_mktsegment = 'BUILDING'""")
def outer_join_identity(spark: SparkSession, d: str) -> DataFrame:
    """A parent's exact count from the outer join with its children: each joined row weighs 1 / fan-out."""
    edge = S.edge("orders", "customer")
    customer = joins.with_fan_out(S.read(spark, d, "customer").where("c_mktsegment = 'BUILDING'"), S.read(spark, d, "orders"), edge)
    joined = customer.join(S.read(spark, d, "orders").select("o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.agg(F.count_distinct("c_custkey").alias("exact"), F.round(F.sum(1 / F.col(f"{edge.fan_out}_nn")), 6).alias("from_outer_join"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def group_rollup(spark: SparkSession, d: str) -> DataFrame:
    return S.read(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
