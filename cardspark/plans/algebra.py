"""Factor algebra, graphs, samples, densities, dependencies and networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardspark.catalog import order_schema
from cardspark.functions.predicates import md5_below
from cardspark.operators import aqp, bayes, densities, dependencies, encode, evaluate, graph, joins, leaves, networks, propagate, stats, trees
from cardspark.plans.registry import query

S = order_schema()


def lineitem(spark: SparkSession, d: str) -> DataFrame:
    return S.read(spark, d, "lineitem")


def joint(spark: SparkSession, d: str) -> DataFrame:
    """The distribution of return flag and line status."""
    counts = lineitem(spark, d).groupBy(F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s")).agg(F.count(F.lit(1)).alias("p"))
    return bayes.normalised(counts.withColumn("p", F.col("p").cast("double")))


_J = "(SELECT l_returnflag AS f, l_linestatus AS s, count(*) / (SELECT count(*) FROM lineitem)::DOUBLE AS p FROM lineitem GROUP BY 1, 2)"


@query(f"SELECT f, s, round(p + (SELECT sum(p) FROM {_J} x WHERE x.f = j.f), 6) AS p FROM {_J} j")
def factor_sum(spark: SparkSession, d: str) -> DataFrame:
    one = joint(spark, d)
    return bayes.add(one, bayes.marginal(one, "f")).select("f", "s", F.round("p", 6).alias("p"))


@query(f"SELECT f, s, 1.0::DOUBLE AS p, ((dense_rank() OVER (ORDER BY f) - 1) * (SELECT count(DISTINCT s) FROM {_J}) + dense_rank() OVER (ORDER BY s) - 1)::BIGINT AS position FROM {_J}")
def factor_positions(spark: SparkSession, d: str) -> DataFrame:
    """The identity factor with each state's number."""
    return bayes.assignment(bayes.identity(joint(spark, d)), ["f", "s"])


@query("SELECT 0.0::DOUBLE AS difference")
def factor_equality(spark: SparkSession, d: str) -> DataFrame:
    """A joint distribution equals the product of its marginal and its conditional."""
    one = joint(spark, d)
    back = bayes.product(bayes.marginal(one, "f"), bayes.conditional(one, ["s"], ["f"])).select(one.columns)
    return bayes.differences(one, back).select(F.round("difference", 9).alias("difference"))


@query(f"SELECT f, s, round(p / sum(p) OVER (PARTITION BY f), 6) AS p FROM {_J}")
def conditional_distribution(spark: SparkSession, d: str) -> DataFrame:
    return bayes.conditional(joint(spark, d), ["s"], ["f"]).select("f", "s", F.round("p", 6).alias("p"))


@query(f"WITH j AS {_J}, g AS (SELECT a.f, b.s FROM (SELECT DISTINCT f FROM j) a, (SELECT DISTINCT s FROM j) b) SELECT round(max(abs(coalesce(p, 0) - (SELECT sum(p) FROM j x WHERE x.f = g.f) * (SELECT sum(p) FROM j x WHERE x.s = g.s))), 6) AS difference FROM g LEFT JOIN j USING (f, s)")
def independence_check(spark: SparkSession, d: str) -> DataFrame:
    """How far two columns are from being independent."""
    return bayes.dependence(joint(spark, d), "f", "s").select(F.round("difference", 6).alias("difference"))


def _network(spark: SparkSession, d: str) -> list[DataFrame]:
    """Flag, status given flag, tax given both, as factors."""
    rows = lineitem(spark, d)
    flag, status = bayes.conditional_table(rows, "l_returnflag"), bayes.conditional_table(rows, "l_linestatus", "l_returnflag")
    tax = bayes.conditional_table(rows, "l_tax", ["l_returnflag", "l_linestatus"])
    return [flag.select(F.col("value").alias("f"), "p"), bayes.as_factor(status, "s", "f"), tax.select(F.col("value").alias("t"), F.col("parent.l_returnflag").alias("f"), F.col("parent.l_linestatus").alias("s"), "p")]


@query("SELECT l_tax AS t, round(count(*) / (SELECT count(*) FROM lineitem), 6) AS p FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_linestatus = 'F' GROUP BY 1")
def variable_elimination(spark: SparkSession, d: str) -> DataFrame:
    """A saturated network with two parents: variables are summed out, evidence is a set of states; equal to counting."""
    found = bayes.eliminate(_network(spark, d), ["t"], {"f": F.col("f").isin("A", "R"), "s": F.col("s") == "F"})
    return found.where("p > 0").select("t", F.round("p", 6).alias("p"))


@query("SELECT l_linestatus AS s, round(count(*) / (SELECT count(*) FROM lineitem), 6) AS p FROM lineitem GROUP BY 1")
def factor_set_marginal(spark: SparkSession, d: str) -> DataFrame:
    """Variables summed out of a set of factors."""
    rest = bayes.set_marginal(bayes.factor_sets([_network(spark, d)[:2], _network(spark, d)[2:]]), "t", "f")
    return bayes.product(*rest).select("s", F.round("p", 6).alias("p"))


@query("""SELECT l_returnflag || '|' || l_linestatus AS parent, l_tax AS value, n, round(CASE WHEN sum(n) OVER w = 0 THEN 1.0 / count(*) OVER w ELSE n / sum(n) OVER w END, 6) AS p FROM
          (SELECT a.l_returnflag, b.l_linestatus, c.l_tax, coalesce(n, 0) AS n FROM (SELECT DISTINCT l_returnflag FROM lineitem) a CROSS JOIN (SELECT DISTINCT l_linestatus FROM lineitem) b CROSS JOIN (SELECT DISTINCT l_tax FROM lineitem) c
           LEFT JOIN (SELECT l_returnflag, l_linestatus, l_tax, count(*) AS n FROM lineitem GROUP BY ALL) x ON x.l_returnflag = a.l_returnflag AND x.l_linestatus = b.l_linestatus AND x.l_tax = c.l_tax)
          WINDOW w AS (PARTITION BY l_returnflag, l_linestatus)""")
def table_two_parents(spark: SparkSession, d: str) -> DataFrame:
    found = bayes.conditional_table(lineitem(spark, d), "l_tax", ["l_returnflag", "l_linestatus"])
    return found.select(F.concat_ws("|", "parent.l_returnflag", "parent.l_linestatus").alias("parent"), "value", "n", F.round("p", 6).alias("p"))


@query("""WITH j AS (SELECT d.lang, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) SELECT coalesce(toxic, -1) AS parent, lang AS value, n, round(n / sum(n) OVER (PARTITION BY toxic), 6) AS p
          FROM (SELECT a.toxic, b.lang, (SELECT count(*) FROM j WHERE j.toxic IS NOT DISTINCT FROM a.toxic AND j.lang IS NOT DISTINCT FROM b.lang) AS n FROM (SELECT DISTINCT toxic FROM j) a, (SELECT DISTINCT lang FROM j) b)""")
def table_with_nulls(spark: SparkSession, d: str) -> DataFrame:
    """A conditional table over an outer join: null is a state of the parent."""
    labels = S.read(spark, d, "labels").withColumnRenamed("doc_id", "__id")
    rows = S.read(spark, d, "documents").join(labels, F.col("doc_id") == F.col("__id"), "left")
    found = bayes.conditional_table(rows, "lang", "toxic")
    return found.select(F.coalesce("parent", F.lit(-1)).alias("parent"), "value", "n", F.round("p", 6).alias("p"))


def _cliques(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], list[tuple[str, str]]]:
    rows = lineitem(spark, d)
    flag, status, tax = (bayes.conditional_table(rows, *x) for x in (("l_returnflag",), ("l_linestatus", "l_returnflag"), ("l_tax", "l_returnflag")))
    return propagate.clique_tree([flag.select(F.col("value").alias("f"), "p"), bayes.as_factor(status, "s", "f"), bayes.as_factor(tax, "t", "f")], [("f", "s"), ("f", "t")])


_TREE_JOINT = "(SELECT f, s, t, a / n * b / n * n / (SELECT count(*) FROM lineitem) AS p FROM (SELECT l_returnflag AS f, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1) JOIN (SELECT l_returnflag AS f, l_linestatus AS s, count(*)::DOUBLE AS a FROM lineitem GROUP BY 1, 2) USING (f) JOIN (SELECT l_returnflag AS f, l_tax AS t, count(*)::DOUBLE AS b FROM lineitem GROUP BY 1, 2) USING (f))"


@query(f"SELECT s, round(sum(p), 6) AS p FROM {_TREE_JOINT} WHERE t <= 0.03 GROUP BY 1")
def clique_query(spark: SparkSession, d: str) -> DataFrame:
    """A question that spans two cliques of a calibrated tree."""
    cliques, tree = _cliques(spark, d)
    return propagate.query(propagate.calibrate(cliques, tree), tree, ["s"], {"t": F.col("t") <= 0.03}).select("s", F.round("p", 6).alias("p"))


@query(f"SELECT round(max(p), 6) AS p, round(max(p), 6) AS other FROM {_TREE_JOINT}")
def max_calibration(spark: SparkSession, d: str) -> DataFrame:
    """After messages of maxima every clique knows the likeliest joint state's probability."""
    cliques, tree = _cliques(spark, d)
    beliefs = propagate.calibrate(cliques, tree, largest=True)
    one, other = (beliefs[n].agg(F.round(F.max("p"), 6).alias(c)) for n, c in zip(sorted(beliefs), ("p", "other")))
    return one.join(F.broadcast(other))


@query("SELECT round(sum(p), 6) AS z FROM " + _TREE_JOINT)
def partition_function(spark: SparkSession, d: str) -> DataFrame:
    cliques, tree = _cliques(spark, d)
    return propagate.partition_function(propagate.calibrate(cliques, tree), sorted(cliques)[0]).select(F.round("z", 6).alias("z"))


_EDGES = [("region", "nation"), ("nation", "customer"), ("nation", "supplier"), ("customer", "orders"), ("orders", "lineitem"), ("part", "lineitem"), ("supplier", "lineitem")]
_EDGE_SQL = "(SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _EDGES) + ") AS v(parent, child))"


def _edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_EDGES, "parent string, child string")


@query(f"SELECT a.parent AS a, b.parent AS b, a.child FROM {_EDGE_SQL} a JOIN {_EDGE_SQL} b ON a.child = b.child AND a.parent < b.parent")
def graph_immoralities(spark: SparkSession, d: str) -> DataFrame:
    return graph.immoralities(_edges(spark))


@query(f"SELECT parent, child FROM {_EDGE_SQL} WHERE child <> 'lineitem'")
def graph_intervention(spark: SparkSession, d: str) -> DataFrame:
    return graph.intervened(_edges(spark), "lineitem")


@query(f"""WITH RECURSIVE e AS {_EDGE_SQL}, a AS (SELECT parent AS x, child AS y FROM e UNION SELECT a.x, e.child FROM a JOIN e ON a.y = e.parent), n AS (SELECT parent AS x FROM e UNION SELECT child FROM e)
           SELECT p.x AS node, q.x AS other FROM n p JOIN n q ON p.x <> q.x WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.x = p.x AND a.y = q.x) AND NOT EXISTS (SELECT 1 FROM e WHERE e.child = p.x AND e.parent = q.x)""")
def graph_independencies(spark: SparkSession, d: str) -> DataFrame:
    return graph.local_independencies(_edges(spark))


@query("WITH RECURSIVE e AS (SELECT unnest(range(150))::BIGINT AS parent), f AS (SELECT parent, parent + 1 AS child FROM e), a AS (SELECT child AS node, parent AS ancestor FROM f UNION SELECT a.node, f.parent FROM a JOIN f ON a.ancestor = f.child) SELECT count(*) AS n FROM a")
def graph_long_chain(spark: SparkSession, d: str) -> DataFrame:
    """Ancestors over a path of 150 edges."""
    return graph.ancestors(spark.range(150).select(F.col("id").alias("parent"), (F.col("id") + 1).alias("child"))).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT x AS node, count(*) FILTER (up)::BIGINT AS parents, count(*) FILTER (NOT up)::BIGINT AS children FROM (SELECT child AS x, true AS up FROM {_EDGE_SQL} UNION ALL SELECT parent, false FROM {_EDGE_SQL}) GROUP BY 1")
def graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.roots_and_leaves(_edges(spark))


@query("SELECT 'l_quantity' AS attribute, min(l_quantity)::VARCHAR AS least, max(l_quantity)::VARCHAR AS largest, count(l_quantity) AS n, 0::BIGINT AS n_null FROM lineitem UNION ALL SELECT 'l_returnflag', min(l_returnflag), max(l_returnflag), count(*), 0 FROM lineitem")
def column_domains(spark: SparkSession, d: str) -> DataFrame:
    return encode.domains(lineitem(spark, d), ["l_quantity", "l_returnflag"])


@query("SELECT * FROM (SELECT 'o_orderkey' AS attribute, 'key' AS reason UNION ALL SELECT 'o_custkey', 'foreign key' UNION ALL SELECT 'note', 'only nulls' UNION ALL SELECT 'o_orderstatus', 'irrelevant' UNION ALL SELECT 'tag', 'too many categories')")
def attribute_pruning(spark: SparkSession, d: str) -> DataFrame:
    orders = S.read(spark, d, "orders").withColumn("note", F.lit(None).cast("string")).withColumn("tag", F.col("o_orderkey").cast("string")).drop("o_totalprice", "o_orderdate")
    return encode.pruned_attributes(orders, "o_orderkey", ("o_custkey",), ("o_orderstatus",), most=100)


@query("""WITH t AS (SELECT l_quantity AS v, count(*) AS n FROM lineitem GROUP BY 1), c AS (SELECT v, n, sum(n) OVER (ORDER BY v) - n AS before, sum(n) OVER () AS total FROM t)
          SELECT v AS value, n, least(floor(before * 5 / total), 4)::INT AS code FROM c""")
def frequency_codes(spark: SparkSession, d: str) -> DataFrame:
    return encode.frequency_codes(lineitem(spark, d), "l_quantity", 5)


@query("SELECT floor((l_quantity - (SELECT min(l_quantity) FROM lineitem)) / 7)::INT AS code, count(*) AS n FROM lineitem GROUP BY 1")
def width_codes(spark: SparkSession, d: str) -> DataFrame:
    return encode.width_codes(lineitem(spark, d), "l_quantity", 7.0).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT coalesce(toxic, -1) AS value, CASE WHEN toxic IS NULL THEN 0 ELSE dense_rank() OVER (ORDER BY toxic NULLS FIRST) - 1 END::INT AS code FROM (SELECT DISTINCT toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)")
def dictionary_with_null(spark: SparkSession, d: str) -> DataFrame:
    labels = S.read(spark, d, "labels").withColumnRenamed("doc_id", "__id")
    rows = S.read(spark, d, "documents").join(labels, F.col("doc_id") == F.col("__id"), "left")
    return encode.dictionary(rows, "toxic", nulls=True).select(F.coalesce("value", F.lit(-1)).alias("value"), "code")


@query("""WITH RECURSIVE m AS (SELECT o_orderkey, coalesce(n, 0) AS k FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey),
          c AS (SELECT k AS value, count(*) AS n FROM m GROUP BY 1), r AS (SELECT value, n, row_number() OVER (ORDER BY value) AS i, sum(n) OVER () AS total, least(count(*) OVER (), 3) AS q FROM (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS top FROM c) WHERE top > 2),
          f AS (SELECT i, value, n, 2 AS code, CASE WHEN n * q >= total THEN 0 ELSE n END AS held, CASE WHEN n * q >= total THEN 3 ELSE 2 END AS next FROM r WHERE i = 1
                UNION ALL SELECT r.i, r.value, r.n, f.next, CASE WHEN (f.held + r.n) * q >= total THEN 0 ELSE f.held + r.n END, CASE WHEN (f.held + r.n) * q >= total THEN f.next + 1 ELSE f.next END FROM f JOIN r ON r.i = f.i + 1)
          SELECT code::INT AS code, sum(n)::BIGINT AS n, round(sum(value * n) / sum(n), 6) AS mean_fan_out, round(sum(n * 1.0::DOUBLE / greatest(value, 1)) / sum(n), 6) AS mean_inverse FROM f GROUP BY 1""")
def fan_out_of_tail_bins(spark: SparkSession, d: str) -> DataFrame:
    """Mean fan-outs of the tail bins of a fan-out column."""
    edge = S.edge("lineitem", "orders")
    orders = joins.with_fan_out(S.read(spark, d, "orders").select("o_orderkey"), lineitem(spark, d), edge)
    coded = encode.fan_out_per_code(orders, encode.tail_bins(orders, edge.fan_out, 2, 3), edge.fan_out, edge.fan_out)
    return coded.select("code", "n", F.round("mean_fan_out", 6).alias("mean_fan_out"), F.round("mean_inverse", 6).alias("mean_inverse"))


@query("""SELECT a, b, round(c, 3) AS covariance FROM (SELECT 'l_quantity' AS a, 'l_quantity' AS b, covar_samp(l_quantity, l_quantity) AS c FROM lineitem UNION ALL SELECT 'l_quantity', 'l_extendedprice', covar_samp(l_quantity, l_extendedprice) FROM lineitem
          UNION ALL SELECT 'l_extendedprice', 'l_extendedprice', covar_samp(l_extendedprice, l_extendedprice) FROM lineitem)""")
def covariance_matrix(spark: SparkSession, d: str) -> DataFrame:
    return stats.covariances(lineitem(spark, d), ["l_quantity", "l_extendedprice"]).withColumn("covariance", F.round("covariance", 3))


@query("""WITH c AS (SELECT l_linenumber AS s, l_returnflag AS x, l_linestatus AS y, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL), e AS (SELECT s, n, sum(n) OVER (PARTITION BY s) AS t, sum(n) OVER (PARTITION BY s, x) AS nx, sum(n) OVER (PARTITION BY s, y) AS ny FROM c)
          SELECT round(sum(n * n / (nx * ny / t)) - (SELECT count(*) FROM lineitem), 6) AS chi2, ((SELECT count(DISTINCT x) - 1 FROM c) * (SELECT count(DISTINCT y) - 1 FROM c) * (SELECT count(DISTINCT s) FROM c))::BIGINT AS dof FROM e""")
def chi_square_pooled(spark: SparkSession, d: str) -> DataFrame:
    return stats.chi_square_pooled(lineitem(spark, d), "l_returnflag", "l_linestatus", ["l_linenumber"]).withColumn("chi2", F.round("chi2", 6))


@query("WITH r AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem) SELECT round(any_value(b), 4) AS slope, round(avg((l_extendedprice - a - b * l_quantity) ** 2), 0) AS variance FROM lineitem, r")
def linear_gaussian(spark: SparkSession, d: str) -> DataFrame:
    beta, variance = stats.linear_gaussian(lineitem(spark, d), "l_extendedprice", ["l_quantity"])
    return spark.createDataFrame([(round(beta[1], 4), round(variance, 0))], "slope double, variance double")


@query("SELECT count(*) AS n, round(avg(l_quantity), 6) AS mean, round(covar_pop(l_quantity, l_tax), 6) AS covariance FROM lineitem")
def multivariate_gaussian(spark: SparkSession, d: str) -> DataFrame:
    one = densities.multivariate(lineitem(spark, d), ["l_quantity", "l_tax"])
    return one.select("n", F.round(F.col("mean")[0], 6).alias("mean"), F.round(F.col("covariance")[0][1], 6).alias("covariance"))


@query("SELECT l_returnflag AS value, round((count(*) + 1) / ((SELECT count(*) + count(DISTINCT l_returnflag) FROM lineitem))::DOUBLE, 6) AS p FROM lineitem GROUP BY 1")
def categorical_leaf(spark: SparkSession, d: str) -> DataFrame:
    return densities.categorical(lineitem(spark, d), "l_returnflag", 1.0).withColumn("p", F.round("p", 6))


@query("""WITH b AS (SELECT (l_linestatus = 'O')::INT AS x, (l_returnflag = 'N')::INT AS y FROM lineitem), n AS (SELECT count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * y) AS xy FROM b),
          l AS (SELECT 'x' AS parent, 'y' AS node, a AS parent_value, c AS value, ln(((CASE WHEN a = 1 AND c = 1 THEN xy WHEN a = 1 THEN sx - xy WHEN c = 1 THEN sy - xy ELSE n - sx - sy + xy END) + 0.01) / ((CASE WHEN a = 1 THEN sx ELSE n - sx END) + 0.02)) AS log_p FROM n, (VALUES (0), (1)) p(a), (VALUES (0), (1)) q(c)
                UNION ALL SELECT NULL, 'x', NULL, a, ln((CASE WHEN a = 1 THEN sx ELSE n - sx END + 0.02) / (n + 0.04)) FROM n, (VALUES (0), (1)) p(a))
          SELECT parent, node, parent_value, value, round(log_p, 6) AS log_p FROM l""")
def binary_tree_leaf(spark: SparkSession, d: str) -> DataFrame:
    rows = lineitem(spark, d).select((F.col("l_linestatus") == "O").cast("int").alias("x"), (F.col("l_returnflag") == "N").cast("int").alias("y"))
    return stats.binary_tree(rows, ["x", "y"]).withColumn("log_p", F.round("log_p", 6))


@query("SELECT (o_orderkey IS NOT NULL)::INT AS orders_nn, (l_orderkey IS NOT NULL)::INT AS lineitem_nn, count(*) AS n FROM (SELECT * FROM orders WHERE md5(o_orderkey::VARCHAR) < '40') LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def sampled_outer_join(spark: SparkSession, d: str) -> DataFrame:
    """A full outer join whose start table is sampled before joining, at a rate of a quarter."""
    joined = joins.sampled_outer_join(S.read(spark, d, "orders"), lineitem(spark, d), S.edge("lineitem", "orders"), 0.25, "l_orderkey")
    return joined.groupBy("orders_nn", "lineitem_nn").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 500::BIGINT AS n, true AS distinct_rows")
def fixed_size_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample of a fixed size without replacement."""
    part = joins.fixed_sample(S.read(spark, d, "orders"), 500, "o_orderkey")
    return part.agg(F.count(F.lit(1)).alias("n"), (F.count_distinct("o_orderkey") == F.count(F.lit(1))).alias("distinct_rows"))


@query("SELECT 400::BIGINT AS n")
def outer_join_sample(spark: SparkSession, d: str) -> DataFrame:
    return joins.outer_join_sample(S.read(spark, d, "orders"), lineitem(spark, d), S.edge("lineitem", "orders"), 400, "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT (md5(o_orderkey::VARCHAR) < '40') AS later, count(*) AS n FROM orders GROUP BY 1")
def learning_split(spark: SparkSession, d: str) -> DataFrame:
    """A table parted for learning first and learning later."""
    first, later = joins.split_for_learning(S.read(spark, d, "orders"), 0.25, keys=("o_orderkey",))
    return first.agg(F.lit(False).alias("later"), F.count(F.lit(1)).alias("n")).unionByName(later.agg(F.lit(True).alias("later"), F.count(F.lit(1)).alias("n")))


@query("""WITH c AS (SELECT * FROM customer WHERE md5(c_custkey::VARCHAR) < '40'), o AS (SELECT * FROM orders SEMI JOIN c ON o_custkey = c_custkey), l AS (SELECT * FROM lineitem SEMI JOIN o ON l_orderkey = o_orderkey), n AS (SELECT * FROM nation SEMI JOIN c ON c_nationkey = n_nationkey)
          SELECT 'customer' AS name, count(*) AS n FROM c UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'lineitem', count(*) FROM l UNION ALL SELECT 'nation', count(*) FROM n UNION ALL SELECT 'part', count(*) FROM part SEMI JOIN l ON p_partkey = l_partkey""")
def consistent_samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples of five tables that refer to each other's rows only."""
    tables = {t: S.read(spark, d, t) for t in ("customer", "orders", "lineitem", "nation", "part")}
    kept = joins.consistent_samples(S, tables, "customer", 0.25)
    out = None
    for name, df in kept.items():  # one count for each table
        one = df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT count(*) AS n FROM orders SEMI JOIN lineitem ON o_orderkey = l_orderkey WHERE o_totalprice > 200000")
def referenced_rows(spark: SparkSession, d: str) -> DataFrame:
    orders = S.read(spark, d, "orders")
    return joins.referenced(orders.where("o_totalprice > 200000"), orders, lineitem(spark, d), S.edge("lineitem", "orders")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT (SELECT count(*) FROM orders) AS parents, (SELECT count(*) FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey) AS childless, (SELECT round(avg(greatest(coalesce(k, 0), 1)), 6) FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS k FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey) AS mean_fan_out,
          (SELECT count(*)::DOUBLE FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey) AS orphans""")
def edge_statistics(spark: SparkSession, d: str) -> DataFrame:
    one = joins.edge_statistics(S.read(spark, d, "orders"), lineitem(spark, d), S.edge("lineitem", "orders"))
    return one.select("parents", "childless", F.round("mean_fan_out", 6).alias("mean_fan_out"), "orphans")


@query("""WITH a AS (SELECT avg(greatest(coalesce(k, 0), 1)) AS m, count(*) AS n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS k FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)
          SELECT round(n * m, 3) AS whole, round(n * 0.5 * m * 0.1, 3) AS sample, (SELECT count(*) FROM orders FULL JOIN lineitem ON o_orderkey = l_orderkey FULL JOIN customer ON c_custkey = o_custkey) AS exact FROM a""")
def join_size_of_sampled_tables(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of a join of three tables and of one of samples of them, from statistics of its edges only (exact here: all keys meet)."""
    customer, orders, lines = (S.read(spark, d, t) for t in ("customer", "orders", "lineitem"))
    edges = [S.edge("lineitem", "orders"), S.edge("orders", "customer")]
    known = {("lineitem", "orders"): joins.edge_statistics(orders, lines, edges[0]).first().asDict(), ("orders", "customer"): joins.edge_statistics(customer, orders, edges[1]).first().asDict()}
    sample, whole = joins.join_size_estimate(known, {"orders": known["lineitem", "orders"]["parents"]}, edges, "orders", {"orders": 0.5, "lineitem": 0.1})
    exact = customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "full_outer").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "full_outer")
    return exact.agg(F.round(F.lit(whole), 3).alias("whole"), F.round(F.lit(sample), 3).alias("sample"), F.count(F.lit(1)).alias("exact"))


@query("SELECT round((SELECT avg((c_mktsegment = 'BUILDING')::INT) FROM customer WHERE md5(c_custkey::VARCHAR) < '40') * (SELECT avg((o_orderstatus = 'F')::INT) FROM orders WHERE md5(o_orderkey::VARCHAR) < '40') * (SELECT count(*) FROM customer FULL JOIN orders ON c_custkey = o_custkey), 3) AS estimate")
def sampled_join_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Selectivities on samples of two tables times the size of their join."""
    customer, orders = S.read(spark, d, "customer"), S.read(spark, d, "orders")
    edge = S.edge("orders", "customer")
    one = joins.edge_statistics(customer, orders, edge).first().asDict()
    _, size = joins.join_size_estimate({("orders", "customer"): one}, {"customer": one["parents"]}, [edge])
    samples = {"customer": customer.where(joins.hashed_below(0.25, "c_custkey")), "orders": orders.where(joins.hashed_below(0.25, "o_orderkey"))}
    return joins.sampled_estimate(samples, {"customer": F.col("c_mktsegment") == "BUILDING", "orders": F.col("o_orderstatus") == "F"}, size).select(F.round("estimate", 3).alias("estimate"))


@query("SELECT 16::INT AS n")
def join_columns(spark: SparkSession, d: str) -> DataFrame:
    """Number of columns of a join of two tables (4 and 6 of their own) with an indicator each and two fan-outs for each of two edges."""
    tables = {t: S.read(spark, d, t) for t in ("customer", "orders")}
    return spark.createDataFrame([(joins.join_columns(S, tables, ["customer", "orders"]),)], "n int")


@query("""SELECT n_nationkey AS value FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'""")
def dependent_condition(spark: SparkSession, d: str) -> DataFrame:
    """A condition on a region's name comes down to nations, over two dependencies."""
    nation, region = S.read(spark, d, "nation"), S.read(spark, d, "region")
    known = [dependencies.dictionary(region, "r_name", "r_regionkey"), dependencies.Dependency("r_regionkey", "n_nationkey", dependencies.dictionary(nation, "n_regionkey", "n_nationkey").pairs)]
    return dependencies.determinants("r_name", F.col("dependent") == "ASIA", known)[1]


@query("SELECT 1 AS low, 3 AS high UNION ALL SELECT 7, 7 UNION ALL SELECT 9, 10")
def ranges_of_values(spark: SparkSession, d: str) -> DataFrame:
    return dependencies.as_ranges(spark.createDataFrame([(v,) for v in (1, 2, 3, 7, 9, 10, 10)], "value int"))


@query("SELECT DISTINCT p_size AS value FROM part WHERE p_size >= 48")
def expanded_domain(spark: SparkSession, d: str) -> DataFrame:
    """A comparison as the list of a dictionary's values."""
    return dependencies.expanded(encode.dictionary(S.read(spark, d, "part"), "p_size"), F.col("value") >= 48)


@query("SELECT 'p_size' AS attribute, 1 AS code, min(p_size)::VARCHAR AS value FROM part UNION ALL SELECT 'p_brand', 1, min(p_brand) FROM part")
def inverse_dictionaries(spark: SparkSession, d: str) -> DataFrame:
    part = S.read(spark, d, "part")
    return dependencies.inverse([encode.dictionary(part, c).withColumn("attribute", F.lit(c)) for c in ("p_size", "p_brand")]).where("code = 1")


@query("SELECT 'a' AS g, 3.0::DOUBLE AS low, 5.0::DOUBLE AS high, true AS low_open, false AS high_open UNION ALL SELECT 'b', 1.0, 4.0, false, false")
def narrowed_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Ranges of groups narrowed by others; one becomes empty."""
    schema = "g string, low double, high double, low_open boolean, high_open boolean"
    own = spark.createDataFrame([("a", 1.0, 5.0, False, False), ("b", 1.0, 4.0, False, False), ("c", 1.0, 2.0, False, False)], schema)
    other = spark.createDataFrame([("a", 3.0, None, True, False), ("c", 2.0, 9.0, True, False)], schema)
    return leaves.narrowed(own, other, ["g"])


@query("SELECT DISTINCT p_size AS value FROM part WHERE p_size > 10 AND p_size <= 14")
def leaf_distinct_values(spark: SparkSession, d: str) -> DataFrame:
    return leaves.distinct_values(leaves.histogram(S.read(spark, d, "part"), "p_size"), leaves.interval(10, 14, low_open=True))


@query("SELECT 7 AS value, round(count(*) FILTER (p_size = 7) / count(*), 6) AS p FROM part UNION ALL SELECT 999, 0.0")
def leaf_likelihood(spark: SparkSession, d: str) -> DataFrame:
    values = spark.createDataFrame([(7,), (999,), (None,)], "value int")
    return leaves.likelihood(leaves.histogram(S.read(spark, d, "part"), "p_size"), values).withColumn("p", F.round("p", 6))


@query("""WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), b AS (SELECT least(floor((o_totalprice - lo) / ((hi - lo) / 50)), 49) AS c, count(*) AS n FROM orders, e GROUP BY 1)
          SELECT count(*) AS n_lines, sum(n)::BIGINT AS n FROM b""")
def leaf_of_many_values(spark: SparkSession, d: str) -> DataFrame:
    """A leaf with more values than it may have gets bins of equal width."""
    return leaves.adaptive_histogram(S.read(spark, d, "orders"), "o_totalprice", 50).agg(F.count(F.lit(1)).alias("n_lines"), F.sum("n").alias("n"))


@query("""WITH s AS (SELECT l_returnflag AS g, count(*) / 0.25::DOUBLE AS e, 1.6448536269514722 * sqrt(count(*) * 0.75) / 0.25 AS w FROM lineitem WHERE md5(l_orderkey::VARCHAR || '|' || l_linenumber::VARCHAR) < '40' GROUP BY 1), t AS (SELECT l_returnflag AS g, count(*) AS y FROM lineitem GROUP BY 1)
          SELECT round(avg((y BETWEEN e - w AND e + w)::INT), 6) AS hit_rate, round(avg(2 * w / e), 6) AS mean_length FROM s JOIN t USING (g)""")
def interval_quality(spark: SparkSession, d: str) -> DataFrame:
    """How often intervals of group counts hold the truth, and how long they are."""
    rows, sample = lineitem(spark, d), lineitem(spark, d).where(md5_below("40", "l_orderkey", "l_linenumber"))
    truth = rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("truth"))
    both = aqp.estimates(sample, 0.25, F.col("l_quantity"), ["l_returnflag"]).join(truth, "l_returnflag")
    return evaluate.interval_report(both, "count_lo", "count_hi", "truth", "count_est").select(F.round("hit_rate", 6).alias("hit_rate"), F.round("mean_length", 6).alias("mean_length"))


@query("""WITH s AS (SELECT count(*)::DOUBLE AS m, count(*) FILTER (l_quantity < 25)::DOUBLE AS k, avg(l_tax) FILTER (l_quantity < 25) AS a, stddev_samp(l_tax) FILTER (l_quantity < 25) AS s FROM lineitem WHERE md5(l_orderkey::VARCHAR || '|' || l_linenumber::VARCHAR) < '40'), n AS (SELECT count(*) AS n FROM lineitem),
          x AS (SELECT k / m * n AS c, sqrt(k / m * (1 - k / m) / m) * n AS cs, a, s / sqrt(k) AS sa FROM s, n)
          SELECT round(c, 3) AS count_est, round(cs, 3) AS count_sd, round(c * a, 4) AS sum_est, round(sqrt((cs * cs + c * c) * (sa * sa + a * a) - c * c * a * a), 4) AS sum_sd FROM x""")
def sum_deviation(spark: SparkSession, d: str) -> DataFrame:
    """Deviations of a count and a sum by a sample's own spread."""
    sample = lineitem(spark, d).where(md5_below("40", "l_orderkey", "l_linenumber"))
    one = evaluate.sampled_deviations(sample, lineitem(spark, d).count(), F.col("l_quantity") < 25, "l_tax")
    return one.select(F.round("count_est", 3).alias("count_est"), F.round("count_sd", 3).alias("count_sd"), F.round("sum_est", 4).alias("sum_est"), F.round("sum_sd", 4).alias("sum_sd"))


#: A structure of three levels: quantity is independent of the rest, whose rows are split between two centres.
NETWORK = networks.product(networks.leaf("l_quantity"), networks.total(["l_discount", "l_tax"], [(0.02, 0.02), (0.08, 0.06)], networks.product(networks.leaf("l_discount"), networks.leaf("l_tax")), networks.product(networks.leaf("l_discount"), networks.leaf("l_tax"))))
_NET = "(SELECT *, CASE WHEN (l_discount - 0.02) ** 2 + (l_tax - 0.02) ** 2 <= (l_discount - 0.08) ** 2 + (l_tax - 0.06) ** 2 THEN 0 ELSE 1 END AS k FROM lineitem)"


def _network_leaves(spark: SparkSession, d: str) -> DataFrame:
    return networks.fit(lineitem(spark, d), NETWORK)


@query(f"""WITH g AS (SELECT k, count(*)::DOUBLE AS n, avg((l_discount <= 0.05)::INT) AS a, avg((l_tax >= 0.03)::INT) AS b FROM {_NET} GROUP BY 1)
           SELECT round((SELECT avg((l_quantity < 20)::INT) FROM lineitem) * sum(n * a * b) / sum(n), 6) AS p FROM g""")
def network_probability(spark: SparkSession, d: str) -> DataFrame:
    conditions = {"l_quantity": F.col("value") < 20, "l_discount": F.col("value") <= 0.05, "l_tax": F.col("value") >= 0.03}
    return networks.probability(_network_leaves(spark, d), NETWORK, conditions).select(F.round("p", 6).alias("p"))


@query(f"""WITH g AS (SELECT k, count(*)::DOUBLE AS n, avg((l_discount <= 0.05)::INT) AS a, avg(l_tax) AS t FROM {_NET} GROUP BY 1), q AS (SELECT avg(1.0::DOUBLE / l_quantity) AS i FROM lineitem)
           SELECT round(any_value(i) * sum(n * a * t) / sum(n), 9) AS expectation, round(sum(n * a) / sum(n), 6) AS p, round(any_value(i) * sum(n * a * t) / sum(n * a), 9) AS mean FROM g, q""")
def network_expectation(spark: SparkSession, d: str) -> DataFrame:
    """The expectation of a column times the inverse of another, under a condition on a third."""
    one = networks.expectation(_network_leaves(spark, d), NETWORK, {"l_discount": F.col("value") <= 0.05}, {"l_tax": 1, "l_quantity": -1})
    return one.select(F.round("expectation", 9).alias("expectation"), F.round("p", 6).alias("p"), F.round("mean", 9).alias("mean"))


@query("SELECT round(p, 6) AS p, round(sqrt(p * (1 - p) / n), 6) AS p_sd, round(m, 6) AS mean, round(sqrt((s - m * m) / (p * n)), 6) AS mean_sd FROM (SELECT avg((l_quantity < 20)::INT) AS p, avg(l_quantity) FILTER (l_quantity < 20) AS m, avg(l_quantity * l_quantity) FILTER (l_quantity < 20) AS s, count(*) AS n FROM lineitem)")
def network_deviation(spark: SparkSession, d: str) -> DataFrame:
    """Probability and conditional mean with deviations, on one column, where the model is exact."""
    one = networks.with_deviation(_network_leaves(spark, d), NETWORK, {"l_quantity": F.col("value") < 20}, "l_quantity")
    return one.select(*(F.round(c, 6).alias(c) for c in one.columns))


@query(f"""SELECT CASE WHEN k = 0 THEN '1/0/0' ELSE '1/1/0' END AS leaf, 'l_discount' AS attribute, l_discount AS value, count(*) AS n FROM {_NET} GROUP BY k, l_discount UNION ALL SELECT '0', 'l_quantity', l_quantity, count(*) FROM lineitem GROUP BY l_quantity""")
def network_marginal(spark: SparkSession, d: str) -> DataFrame:
    """The model over two of its columns."""
    return networks.marginal(_network_leaves(spark, d), ["l_quantity", "l_discount"])


@query("SELECT q.v AS l_quantity, t.v AS l_tax FROM (SELECT DISTINCT l_quantity AS v FROM lineitem WHERE l_quantity > 48) q, (SELECT DISTINCT l_tax AS v FROM lineitem) t")
def network_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups that a model thinks possible: a superset of those that exist."""
    return networks.group_values(_network_leaves(spark, d), ["l_quantity", "l_tax"], {"l_quantity": F.col("value") > 48})


@query("SELECT 'a' AS g, 2.0::DOUBLE AS mean, 0.5::DOUBLE AS p UNION ALL SELECT 'b', 3.0, 0.01 UNION ALL SELECT 'c', 4.0, 0.5")
def network_imputed(spark: SparkSession, d: str) -> DataFrame:
    """Groups of probability 0 get the others' average, and a probability of one row."""
    rows = spark.createDataFrame([("a", 1.0, 0.5), ("b", 0.0, 0.0), ("c", 2.0, 0.5)], "g string, expectation double, p double")
    return networks.clipped(networks.imputed(rows), 100).select("g", "mean", "p")


@query("""WITH r AS (SELECT l_returnflag AS f, l_linestatus AS s, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL) SELECT 'weighted' AS method, true AS close UNION ALL SELECT 'rejected', true UNION ALL SELECT 'counted', true""")
def sampling_estimators(spark: SparkSession, d: str) -> DataFrame:
    """Likelihood weighting, rejection and counting come within three hundredths of P(flag = N | status = O) or P(both)."""
    rows = lineitem(spark, d)
    tables = [("flag", None, bayes.conditional_table(rows, "l_returnflag")), ("status", "flag", bayes.conditional_table(rows, "l_linestatus", "l_returnflag"))]
    both, given = (rows.agg(F.avg(c.cast("double")).alias(n)) for c, n in (((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"), "both"), (F.col("l_linestatus") == "O", "given")))
    truth = both.join(F.broadcast(given))
    n = F.col("flag") == "N"
    found = {
        "weighted": bayes.sampled_probability(bayes.ancestral_sample(spark, 8000, tables, 5, {"status": "O"}), n),
        "rejected": bayes.sampled_probability(bayes.rejection_sample(spark, 4000, tables, F.col("status") == "O", 6), n),
        "counted": bayes.sampled_probability(bayes.ancestral_sample(spark, 8000, tables, 7), n & (F.col("status") == "O")),
    }
    out = None
    for name, p in found.items():
        exact = F.col("both") if name == "counted" else F.col("both") / F.col("given")
        one = p.join(F.broadcast(truth)).select(F.lit(name).alias("method"), (F.abs(F.col("p") - exact) < 0.03).alias("close"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT k AS cluster, (count(*) + 10)::BIGINT AS n, round((sum(l_discount) + 10 * CASE WHEN k = 0 THEN 0.02 ELSE 0.08 END) / (count(*) + 10), 9) AS discount FROM {_NET} GROUP BY k")
def network_update(spark: SparkSession, d: str) -> DataFrame:
    """Centres and counts of a sum after more rows."""
    centers, counts = networks.moved_centers(lineitem(spark, d), ["l_discount", "l_tax"], [(0.02, 0.02), (0.08, 0.06)], [10, 10])
    return spark.createDataFrame([(k, n, round(c[0], 9)) for k, (c, n) in enumerate(zip(centers, counts))], "cluster int, n long, discount double")


@query("""WITH c AS (SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS n FROM lineitem GROUP BY 1, 2), k AS (SELECT s, row_number() OVER (ORDER BY sum(n) DESC, s) AS code FROM c GROUP BY s), b AS (SELECT f, s, sum(n) OVER (PARTITION BY f) AS total FROM c QUALIFY row_number() OVER (PARTITION BY f ORDER BY n DESC) = 1)
          SELECT code::INT AS code, sum(total)::BIGINT AS n FROM b JOIN k USING (s) GROUP BY 1""")
def model_prediction(spark: SparkSession, d: str) -> DataFrame:
    """The likeliest status of each row given its flag, by code."""
    rows = lineitem(spark, d)
    model = trees.fit(rows, ["l_returnflag", "l_linestatus"])
    found = trees.predicted(model, rows.select("l_returnflag", "l_quantity"), "l_linestatus", ["l_returnflag"])
    return found.groupBy(F.col("l_linestatus_predicted").alias("code")).agg(F.count(F.lit(1)).alias("n"))
