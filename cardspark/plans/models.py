"""Encodings, statistics, conditional tables, inference and leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardspark.catalog import order_schema
from cardspark.functions.predicates import overlap_share
from cardspark.operators import bayes, densities, encode, graph, joins, leaves, progressive, propagate, spn, stats
from cardspark.plans.registry import query

S = order_schema()
FLAGS = ["l_returnflag", "l_linestatus", "l_linenumber"]


@query("SELECT p_brand AS value, dense_rank() OVER (ORDER BY p_brand)::INT AS code FROM (SELECT DISTINCT p_brand FROM part)")
def category_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return encode.dictionary(S.read(spark, d, "part"), "p_brand")


_KIND = "SELECT '{c}' AS attribute, count(DISTINCT {c}) AS n_distinct, CASE WHEN count(DISTINCT {c}) = 2 THEN 'boolean' WHEN {numeric} AND (count(DISTINCT {c}) * 20 >= count(*) OR count(DISTINCT {c}) > 10000) THEN 'continuous' ELSE 'categorical' END AS kind FROM lineitem"


@query(" UNION ALL ".join(_KIND.format(c=c, numeric=str(c not in ("l_returnflag", "l_linestatus")).lower()) for c in ("l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_extendedprice")))
def attribute_kinds(spark: SparkSession, d: str) -> DataFrame:
    return encode.attribute_kinds(S.read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_extendedprice"])


@query("SELECT value, n, (row_number() OVER (ORDER BY n DESC, value) - 1)::INT AS code FROM (SELECT l_quantity AS value, count(*) AS n FROM lineitem GROUP BY 1) QUALIFY row_number() OVER (ORDER BY n DESC, value) <= 30")
def most_common_values(spark: SparkSession, d: str) -> DataFrame:
    return encode.most_common(S.read(spark, d, "lineitem"), "l_quantity", 30)


@query("""WITH RECURSIVE c AS (SELECT l_quantity AS value, count(*) AS n FROM lineitem GROUP BY 1),
          r AS (SELECT value, n, row_number() OVER (ORDER BY value) AS k, sum(n) OVER () AS total, least(count(*) OVER (), 8) AS q
                FROM (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS top FROM c) WHERE top > 10),
          f AS (SELECT k, value, n, 10 AS code, CASE WHEN n * q >= total THEN 0 ELSE n END AS held, CASE WHEN n * q >= total THEN 11 ELSE 10 END AS next FROM r WHERE k = 1
                UNION ALL SELECT r.k, r.value, r.n, f.next, CASE WHEN (f.held + r.n) * q >= total THEN 0 ELSE f.held + r.n END, CASE WHEN (f.held + r.n) * q >= total THEN f.next + 1 ELSE f.next END FROM f JOIN r ON r.k = f.k + 1)
          SELECT value, n, code::INT AS code, round(n / sum(n) OVER (PARTITION BY code), 6) AS share FROM f""")
def tail_bins(spark: SparkSession, d: str) -> DataFrame:
    return encode.tail_bins(S.read(spark, d, "lineitem"), "l_quantity", 10, 8).withColumn("share", F.round("share", 6))


@query("""WITH p AS (SELECT list_distinct(quantile_cont(o_totalprice, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS raw FROM orders),
          s AS (SELECT list_sort(raw) AS a FROM p), e AS (SELECT unnest(range(len(a) - 1)) AS k, a FROM s)
          SELECT k::INT AS code, round(a[k + 1], 4) AS lo, round(a[k + 2], 4) AS hi FROM e""")
def quantile_bins(spark: SparkSession, d: str) -> DataFrame:
    return encode.quantile_bins(S.read(spark, d, "orders"), "o_totalprice", 10).select("code", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


@query("""WITH p AS (SELECT list_sort(list_distinct(quantile_cont(o_totalprice, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS a FROM orders),
          e AS (SELECT unnest(range(len(a) - 1)) AS k, a FROM p)
          SELECT k::INT AS code, round(greatest(0, least(a[k + 2], 250000) - greatest(a[k + 1], 50000)) / (a[k + 2] - a[k + 1]), 6) AS share FROM e""")
def bin_coverage(spark: SparkSession, d: str) -> DataFrame:
    bins = encode.quantile_bins(S.read(spark, d, "orders"), "o_totalprice", 10)
    return bins.select("code", F.round(overlap_share(F.col("lo"), F.col("hi"), 50_000, 250_000), 6).alias("share"))


@query("""WITH m AS (SELECT o_orderpriority, coalesce(n, 0) AS k FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)
          SELECT (dense_rank() OVER (ORDER BY o_orderpriority))::INT AS code, count(*) AS n, round(avg(k), 6) AS mean_fan_out, round(avg(1.0::DOUBLE / greatest(k, 1)), 6) AS mean_inverse FROM m GROUP BY o_orderpriority""")
def fan_out_per_code(spark: SparkSession, d: str) -> DataFrame:
    edge = S.edge("lineitem", "orders")
    orders = S.read(spark, d, "orders")
    coded = encode.fan_out_per_code(joins.with_fan_out(orders, S.read(spark, d, "lineitem"), edge), encode.dictionary(orders, "o_orderpriority"), "o_orderpriority", edge.fan_out)
    return coded.select("code", "n", F.round("mean_fan_out", 6).alias("mean_fan_out"), F.round("mean_inverse", 6).alias("mean_inverse"))


@query("SELECT 'l_returnflag' AS a, 'l_linestatus' AS b, l_returnflag AS x, l_linestatus AS y, count(*) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT 'l_returnflag', 'l_linenumber', l_returnflag, l_linenumber::VARCHAR, count(*) FROM lineitem GROUP BY ALL UNION ALL SELECT 'l_linestatus', 'l_linenumber', l_linestatus, l_linenumber::VARCHAR, count(*) FROM lineitem GROUP BY ALL")
def contingency(spark: SparkSession, d: str) -> DataFrame:
    return stats.pair_counts(S.read(spark, d, "lineitem"), FLAGS)


_MI = "SELECT '{a}' AS a, '{b}' AS b, round(sum(n / t * ln(n * t / (nx * ny))), 9) AS mi FROM (SELECT n::DOUBLE AS n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY x)::DOUBLE AS nx, sum(n) OVER (PARTITION BY y) AS ny FROM (SELECT {a} AS x, {b} AS y, count(*) AS n FROM lineitem GROUP BY 1, 2))"


@query(" UNION ALL ".join(_MI.format(a=a, b=b) for k, a in enumerate(FLAGS) for b in FLAGS[k + 1 :]))
def mutual_information(spark: SparkSession, d: str) -> DataFrame:
    return stats.mutual_information(S.read(spark, d, "lineitem"), FLAGS).withColumn("mi", F.round("mi", 9))


_TREE_COLUMNS = [*FLAGS, "l_tax", "l_discount"]


@query("WITH RECURSIVE e AS (" + " UNION ALL ".join(_MI.format(a=a, b=b) for k, a in enumerate(_TREE_COLUMNS) for b in _TREE_COLUMNS[k + 1 :]) + f"""),
          p AS (SELECT ['{_TREE_COLUMNS[0]}'] AS members, NULL::VARCHAR AS a, NULL::VARCHAR AS b, NULL::DOUBLE AS mi
                UNION ALL SELECT * FROM (SELECT list_append(p.members, CASE WHEN list_contains(p.members, e.a) THEN e.b ELSE e.a END) AS members, e.a, e.b, e.mi FROM p JOIN e ON list_contains(p.members, e.a) <> list_contains(p.members, e.b) ORDER BY e.mi DESC LIMIT 1))
          SELECT a, b, mi FROM p WHERE a IS NOT NULL""")
def chow_liu_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = stats.chow_liu(S.read(spark, d, "lineitem"), _TREE_COLUMNS)
    return spark.createDataFrame([(a, b, round(mi, 9)) for a, b, mi in edges], "a string, b string, mi double")


_CHI = "SELECT round(sum(chi), 6) AS chi2, sum(dof)::BIGINT AS dof FROM (SELECT sum(n * n / (nx * ny / t)) - any_value(t) AS chi, (count(DISTINCT x) - 1) * (count(DISTINCT y) - 1) AS dof FROM (SELECT s, x, y, n::DOUBLE AS n, sum(n) OVER (PARTITION BY s)::DOUBLE AS t, sum(n) OVER (PARTITION BY s, x)::DOUBLE AS nx, sum(n) OVER (PARTITION BY s, y)::DOUBLE AS ny FROM (SELECT {s} AS s, l_returnflag AS x, l_linestatus AS y, count(*) AS n FROM lineitem GROUP BY ALL)) GROUP BY s)"


@query(_CHI.format(s="1"))
def chi_square(spark: SparkSession, d: str) -> DataFrame:
    return stats.chi_square(S.read(spark, d, "lineitem"), "l_returnflag", "l_linestatus").withColumn("chi2", F.round("chi2", 6))


@query(_CHI.format(s="l_linenumber"))
def chi_square_stratified(spark: SparkSession, d: str) -> DataFrame:
    return stats.chi_square(S.read(spark, d, "lineitem"), "l_returnflag", "l_linestatus", ["l_linenumber"]).withColumn("chi2", F.round("chi2", 6))


@query("""SELECT round(xy, 6) AS pearson, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS partial, round(c, 3) AS covariance
          FROM (SELECT corr(l_quantity, l_extendedprice) AS xy, corr(l_quantity, l_tax) AS xz, corr(l_extendedprice, l_tax) AS yz, covar_samp(l_quantity, l_extendedprice) AS c FROM lineitem)""")
def correlations(spark: SparkSession, d: str) -> DataFrame:
    one = stats.correlations(S.read(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_tax")
    return one.select(F.round("pearson", 6).alias("pearson"), F.round("partial", 6).alias("partial"), F.round("covariance", 3).alias("covariance"))


@query("SELECT count(DISTINCT (p_brand, p_size)) AS pairs, count(DISTINCT p_brand) * count(DISTINCT p_size) AS product, round(count(DISTINCT (p_brand, p_size)) / (count(DISTINCT p_brand) * count(DISTINCT p_size)), 6) AS completeness FROM part")
def pair_completeness(spark: SparkSession, d: str) -> DataFrame:
    return stats.completeness(S.read(spark, d, "part"), "p_brand", "p_size").withColumn("completeness", F.round("completeness", 6))


_STATES = "SELECT o_orderstatus AS parent, o_orderpriority AS value, coalesce(n, 0) AS n FROM (SELECT DISTINCT o_orderstatus FROM orders) CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) LEFT JOIN (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) USING (o_orderstatus, o_orderpriority)"
_CPT = "SELECT parent, value, n, round((n + {a}) / sum(n + {a}) OVER (PARTITION BY parent), 6) AS p FROM ({states})"


@query(_CPT.format(a="0", states=_STATES))
def table_likelihood(spark: SparkSession, d: str) -> DataFrame:
    return bayes.conditional_table(S.read(spark, d, "orders"), "o_orderpriority", "o_orderstatus").withColumn("p", F.round("p", 6))


@query(_CPT.format(a="1", states=_STATES))
def table_k2(spark: SparkSession, d: str) -> DataFrame:
    return bayes.conditional_table(S.read(spark, d, "orders"), "o_orderpriority", "o_orderstatus", 1.0).withColumn("p", F.round("p", 6))


@query(_CPT.format(a="10.0::DOUBLE / count(*) OVER ()", states=_STATES).replace("sum(n + 10.0::DOUBLE / count(*) OVER ()) OVER (PARTITION BY parent)", "(sum(n) OVER (PARTITION BY parent) + 10.0::DOUBLE * count(*) OVER (PARTITION BY parent) / count(*) OVER ())"))
def table_bdeu(spark: SparkSession, d: str) -> DataFrame:
    return bayes.conditional_table(S.read(spark, d, "orders"), "o_orderpriority", "o_orderstatus", "bdeu:10").withColumn("p", F.round("p", 6))


def _flag_tree(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Return flag above line status and tax."""
    lineitem = S.read(spark, d, "lineitem")
    return bayes.conditional_table(lineitem, "l_returnflag"), bayes.conditional_table(lineitem, "l_linestatus", "l_returnflag"), bayes.conditional_table(lineitem, "l_tax", "l_returnflag")


_TREE = """WITH f AS (SELECT l_returnflag AS f, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1), t AS (SELECT sum(n) AS t FROM f),
           a AS (SELECT l_returnflag AS f, count(*) FILTER (l_linestatus = 'O')::DOUBLE AS n FROM lineitem GROUP BY 1),
           b AS (SELECT l_returnflag AS f, count(*) FILTER ({tax})::DOUBLE AS n FROM lineitem GROUP BY 1)
           SELECT round(sum(f.n / t.t * a.n / f.n * b.n / f.n), 6) AS p, round(sum(f.n / t.t * a.n / f.n * b.n / f.n) * any_value(t.t), 3) AS cardinality
           FROM f JOIN a USING (f) JOIN b USING (f), t WHERE f.f IN ('N', 'R')"""


def _tree_probability(spark: SparkSession, d: str, tax) -> DataFrame:
    flag, status, taxes = _flag_tree(spark, d)
    below = bayes.message(status, bayes.inside(F.col("value") == "O")), bayes.message(taxes, bayes.inside(tax))
    top = bayes.message(flag, bayes.inside(F.col("value").isin("N", "R")), *below)
    rows = flag.agg(F.sum("n").alias("rows"))
    return top.join(F.broadcast(rows)).select(F.round("m", 6).alias("p"), F.round(F.col("m") * F.col("rows"), 3).alias("cardinality"))


@query(_TREE.format(tax="l_tax = 0.03"))
def tree_point_probability(spark: SparkSession, d: str) -> DataFrame:
    return _tree_probability(spark, d, F.col("value") == 0.03)


@query(_TREE.format(tax="l_tax BETWEEN 0.02 AND 0.05"))
def tree_range_probability(spark: SparkSession, d: str) -> DataFrame:
    return _tree_probability(spark, d, F.col("value").between(0.02, 0.05))


@query("""WITH m AS (SELECT o_orderstatus AS s, o_orderpriority AS p, coalesce(n, 0) AS k FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)
          SELECT round(sum(n / t * f * u), 6) AS expectation, round(sum(n / t * f * u) * any_value(t), 2) AS joined_rows FROM
          (SELECT s, count(*)::DOUBLE AS n, avg(k) AS f, count(*) FILTER (p = '1-URGENT')::DOUBLE / count(*) AS u FROM m GROUP BY s), (SELECT count(*)::DOUBLE AS t FROM m)""")
def tree_expectation(spark: SparkSession, d: str) -> DataFrame:
    """Rows of orders joined with lineitem for one priority, from a tree: status above priority and fan-out."""
    edge = S.edge("lineitem", "orders")
    orders = joins.with_fan_out(S.read(spark, d, "orders"), S.read(spark, d, "lineitem"), edge)
    status = bayes.conditional_table(orders, "o_orderstatus")
    priority = bayes.message(bayes.conditional_table(orders, "o_orderpriority", "o_orderstatus"), bayes.inside(F.col("value") == "1-URGENT"))
    fan = bayes.message(bayes.conditional_table(orders, edge.fan_out, "o_orderstatus"), F.col("value").cast("double"))
    top = bayes.message(status, F.lit(1.0), priority, fan)
    return top.join(F.broadcast(status.agg(F.sum("n").alias("rows")))).select(F.round("m", 6).alias("expectation"), F.round(F.col("m") * F.col("rows"), 2).alias("joined_rows"))


@query("SELECT parent, value, round(p, 6) AS p FROM (SELECT l_returnflag AS parent, l_linenumber AS value, count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag) AS p FROM lineitem GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY parent ORDER BY p DESC, value) = 1")
def most_likely_state(spark: SparkSession, d: str) -> DataFrame:
    return bayes.most_likely(bayes.conditional_table(S.read(spark, d, "lineitem"), "l_linenumber", "l_returnflag")).withColumn("p", F.round("p", 6))


def _factors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    flag, status, _ = _flag_tree(spark, d)
    return flag.select(F.col("value").alias("f"), "p"), status.select(F.col("parent").alias("f"), F.col("value").alias("s"), "p")


@query("SELECT l_returnflag AS f, l_linestatus AS s, round(count(*) / sum(count(*)) OVER (), 6) AS p FROM lineitem GROUP BY ALL")
def factor_product(spark: SparkSession, d: str) -> DataFrame:
    return bayes.product(*_factors(spark, d)).select("f", "s", F.round("p", 6).alias("p"))


@query("SELECT l_linestatus AS s, round(count(*) / (SELECT count(*) FROM lineitem), 6) AS p FROM lineitem GROUP BY 1")
def factor_marginal(spark: SparkSession, d: str) -> DataFrame:
    return bayes.marginal(bayes.product(*_factors(spark, d)), "s").withColumn("p", F.round("p", 6))


@query("SELECT l_returnflag AS f, round(max(n) / (SELECT count(*) FROM lineitem), 6) AS p FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1")
def factor_max_marginal(spark: SparkSession, d: str) -> DataFrame:
    return bayes.max_marginal(bayes.product(*_factors(spark, d)), "f").withColumn("p", F.round("p", 6))


@query("SELECT l_returnflag AS f, l_linestatus AS s, round(count(*) / sum(count(*)) OVER (PARTITION BY l_linestatus), 6) AS p FROM lineitem GROUP BY l_returnflag, l_linestatus")
def factor_divide(spark: SparkSession, d: str) -> DataFrame:
    joint = bayes.product(*_factors(spark, d))
    return bayes.divide(joint, bayes.marginal(joint, "s")).select("f", "s", F.round("p", 6).alias("p"))


@query("SELECT l_returnflag AS f, l_linestatus AS s, round(count(*) / sum(count(*)) OVER (), 6) AS p FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag IN ('A', 'N') GROUP BY ALL")
def factor_reduce(spark: SparkSession, d: str) -> DataFrame:
    joint = bayes.product(*_factors(spark, d))
    return bayes.reduced(joint, (F.col("s") == "O") & F.col("f").isin("A", "N")).select("f", "s", F.round("p", 6).alias("p"))


@query("SELECT o_orderpriority AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 6) AS p, round(sum(count(*)) OVER (ORDER BY o_orderpriority) / (SELECT count(*) FROM orders), 6) AS upto FROM orders GROUP BY 1")
def leaf_histogram(spark: SparkSession, d: str) -> DataFrame:
    return leaves.histogram(S.read(spark, d, "orders"), "o_orderpriority").select("value", "n", F.round("p", 6).alias("p"), F.round("upto", 6).alias("upto"))


@query("SELECT round(count(*) FILTER (p_retailprice > 1000 AND p_retailprice <= 1500) / count(*), 6) AS p FROM part")
def leaf_interval_probability(spark: SparkSession, d: str) -> DataFrame:
    leaf = leaves.histogram(S.read(spark, d, "part"), "p_retailprice")
    return leaves.leaf_probability(leaf, leaves.interval(1000, 1500, low_open=True)).select(F.round("p", 6).alias("p"))


@query("SELECT round(sum(p_size) FILTER (p_size BETWEEN 10 AND 20) / count(*), 6) AS e_x, round(sum(1.0::DOUBLE / p_size) FILTER (p_size BETWEEN 10 AND 20) / count(*), 6) AS e_inverse, round(sum(p_size * p_size) FILTER (p_size BETWEEN 10 AND 20) / count(*), 6) AS e_square FROM part")
def leaf_expectation(spark: SparkSession, d: str) -> DataFrame:
    leaf = leaves.histogram(S.read(spark, d, "part"), "p_size")
    return leaves.leaf_expectation(leaf, leaves.interval(10, 20)).select(*(F.round(c, 6).alias(c) for c in ("e_x", "e_inverse", "e_square")))


@query("SELECT round(avg(l_quantity), 6) AS mean, round(avg(1.0::DOUBLE / l_quantity), 6) AS mean_inverse, round(avg(l_quantity * l_quantity), 6) AS mean_square, round(avg(1.0::DOUBLE / (l_quantity * l_quantity)), 6) AS mean_inverse_square, 0.0::DOUBLE AS null_share FROM lineitem")
def leaf_moments(spark: SparkSession, d: str) -> DataFrame:
    one = leaves.moments(S.read(spark, d, "lineitem"), "l_quantity")
    return one.select(*(F.round(c, 6).alias(c) for c in one.columns))


@query("SELECT round(avg(l_extendedprice) FILTER (l_returnflag = 'R'), 4) AS mean, round(stddev_pop(l_extendedprice) FILTER (l_returnflag = 'R'), 4) AS deviation, count(*) FILTER (l_returnflag = 'R') AS n, round(count(*) FILTER (l_returnflag = 'R') / count(*), 6) AS p FROM lineitem")
def conditional_moments(spark: SparkSession, d: str) -> DataFrame:
    one = leaves.conditional_moments(S.read(spark, d, "lineitem"), "l_extendedprice", F.col("l_returnflag") == "R")
    return one.select(F.round("mean", 4).alias("mean"), F.round("deviation", 4).alias("deviation"), "n", F.round("p", 6).alias("p"))


@query()
def ancestral_sample(spark: SparkSession, d: str) -> DataFrame:
    flag, status, taxes = _flag_tree(spark, d)
    return bayes.ancestral_sample(spark, 10_000, [("flag", None, flag), ("status", "flag", status), ("tax", "flag", taxes)], seed=17)


@query("SELECT count(*) > 0 AS some, 10000::BIGINT AS n, true AS close FROM lineitem")
def ancestral_sample_quality(spark: SparkSession, d: str) -> DataFrame:
    """Frequencies of flag and status in 10,000 drawn rows come within two hundredths of the model's."""
    drawn = ancestral_sample(spark, d).groupBy(F.col("flag").alias("f"), F.col("status").alias("s")).agg((F.count(F.lit(1)) / 10_000).alias("q"))
    truth = bayes.product(*_factors(spark, d))
    far = truth.join(drawn, ["f", "s"], "full_outer").agg(F.max(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))).alias("far"), F.round(F.sum("q") * 10_000).cast("long").alias("n"))
    return far.select(F.lit(True).alias("some"), "n", (F.col("far") < 0.02).alias("close"))


SPN_COLUMNS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def _spn(spark: SparkSession, d: str) -> DataFrame:
    lineitem = S.read(spark, d, "lineitem")
    fixed = spn.Structure((("l_discount", "l_quantity"), ("l_linenumber",), ("l_tax",)), (((0.03, 12.0), (0.07, 38.0)), ((0.0,),), ((0.0,),)))
    return spn.fit(lineitem, fixed)


@query("""WITH c AS (SELECT *, CASE WHEN (l_discount - 0.03) ** 2 + (l_quantity - 12) ** 2 <= (l_discount - 0.07) ** 2 + (l_quantity - 38) ** 2 THEN 0 ELSE 1 END AS k FROM lineitem)
          SELECT 0 AS "group", k AS cluster, 'l_quantity' AS attribute, l_quantity AS value, count(*) AS n FROM c GROUP BY ALL UNION ALL SELECT 0, k, 'l_discount', l_discount, count(*) FROM c GROUP BY ALL
          UNION ALL SELECT 1, 0, 'l_linenumber', l_linenumber::DOUBLE, count(*) FROM c GROUP BY ALL UNION ALL SELECT 2, 0, 'l_tax', l_tax, count(*) FROM c GROUP BY ALL""")
def spn_leaves(spark: SparkSession, d: str) -> DataFrame:
    return _spn(spark, d)


@query("SELECT round(count(*) FILTER (l_quantity < 25) / count(*), 6) AS p FROM lineitem")
def spn_marginal(spark: SparkSession, d: str) -> DataFrame:
    """A condition on one column: the model is exact there."""
    return spn.probability(_spn(spark, d), {"l_quantity": F.col("value") < 25}).select(F.round("p", 6).alias("p"))


@query("""WITH c AS (SELECT *, CASE WHEN (l_discount - 0.03) ** 2 + (l_quantity - 12) ** 2 <= (l_discount - 0.07) ** 2 + (l_quantity - 38) ** 2 THEN 0 ELSE 1 END AS k FROM lineitem),
          g AS (SELECT k, count(*)::DOUBLE AS n, count(*) FILTER (l_quantity >= 10) / count(*)::DOUBLE AS a, count(*) FILTER (l_discount <= 0.05) / count(*)::DOUBLE AS b FROM c GROUP BY k)
          SELECT round(sum(n * a * b) / sum(n) * (SELECT count(*) FILTER (l_tax = 0.02) / count(*)::DOUBLE FROM lineitem), 6) AS p FROM g""")
def spn_probability(spark: SparkSession, d: str) -> DataFrame:
    conditions = {"l_quantity": F.col("value") >= 10, "l_discount": F.col("value") <= 0.05, "l_tax": F.col("value") == 0.02}
    return spn.probability(_spn(spark, d), conditions).select(F.round("p", 6).alias("p"))


@query("""WITH c AS (SELECT *, CASE WHEN (l_discount - 0.03) ** 2 + (l_quantity - 12) ** 2 <= (l_discount - 0.07) ** 2 + (l_quantity - 38) ** 2 THEN 0 ELSE 1 END AS k FROM lineitem),
          g AS (SELECT k, count(*)::DOUBLE AS n, sum(l_quantity) / count(*) AS e, count(*) FILTER (l_discount <= 0.05) / count(*)::DOUBLE AS b FROM c GROUP BY k)
          SELECT round(sum(n * e * b) / sum(n), 6) AS expectation, round(sum(n * b) / sum(n), 6) AS p, round(sum(n * e * b) / sum(n * b), 6) AS mean FROM g""")
def spn_expectation(spark: SparkSession, d: str) -> DataFrame:
    one = spn.expectation(_spn(spark, d), "l_quantity", {"l_discount": F.col("value") <= 0.05})
    return one.select(*(F.round(c, 6).alias(c) for c in one.columns))


@query()
def spn_learned(spark: SparkSession, d: str) -> DataFrame:
    """A model with learnt groups and clusters of orders' price and lines."""
    edge = S.edge("lineitem", "orders")
    orders = joins.with_fan_out(S.read(spark, d, "orders"), S.read(spark, d, "lineitem"), edge).withColumn("thousands", F.floor(F.col("o_totalprice") / 10_000))
    columns = [edge.fan_out, "thousands"]
    return spn.fit(orders, spn.learn_structure(orders, columns, threshold=0.0))


_EDGES = [("region", "nation"), ("nation", "customer"), ("nation", "supplier"), ("customer", "orders"), ("orders", "lineitem"), ("part", "lineitem"), ("supplier", "lineitem")]
_EDGE_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _EDGES) + ") AS e(parent, child)"


@query(f"WITH RECURSIVE e AS (SELECT * FROM {_EDGE_SQL}), a AS (SELECT child AS node, parent AS ancestor FROM e UNION SELECT a.node, e.parent FROM a JOIN e ON a.ancestor = e.child) SELECT * FROM a")
def graph_ancestors(spark: SparkSession, d: str) -> DataFrame:
    return graph.ancestors(spark.createDataFrame(_EDGES, "parent string, child string"))


@query(f"WITH e AS (SELECT * FROM {_EDGE_SQL}) SELECT child AS node, parent AS other FROM e UNION SELECT parent, child FROM e UNION SELECT a.parent, b.parent FROM e a JOIN e b ON a.child = b.child AND a.parent <> b.parent")
def graph_markov_blanket(spark: SparkSession, d: str) -> DataFrame:
    return graph.markov_blanket(spark.createDataFrame(_EDGES, "parent string, child string"))


@query("""WITH s AS (SELECT l_returnflag, l_linenumber, avg(l_extendedprice) FILTER (l_linestatus = 'O') AS t, avg(l_extendedprice) FILTER (l_linestatus <> 'O') AS c, count(*) AS n FROM lineitem GROUP BY 1, 2)
          SELECT round(sum((t - c) * n) / sum(n), 4) AS effect, count(*) AS strata FROM s WHERE t IS NOT NULL AND c IS NOT NULL""")
def adjusted_effect(spark: SparkSession, d: str) -> DataFrame:
    lineitem = S.read(spark, d, "lineitem").withColumn("open", F.col("l_linestatus") == "O")
    return graph.adjusted_effect(lineitem, "open", "l_extendedprice", ["l_returnflag", "l_linenumber"]).withColumn("effect", F.round("effect", 4))


@query("""SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS deviation, round(avg(ln(l_quantity)), 6) AS log_mean, round(stddev_pop(ln(l_quantity)), 6) AS log_deviation,
          round(1 / avg(l_quantity), 6) AS rate, 1.0::DOUBLE AS p_positive, round(avg(l_quantity) ** 2 / var_pop(l_quantity), 6) AS shape, round(var_pop(l_quantity) / avg(l_quantity), 6) AS scale, min(l_quantity) AS least, max(l_quantity) AS largest FROM lineitem GROUP BY 1""")
def leaf_parameters(spark: SparkSession, d: str) -> DataFrame:
    out = densities.parameters(S.read(spark, d, "lineitem"), "l_quantity", ["l_returnflag"])
    return out.select("l_returnflag", "n", *(F.round(c, 6).alias(c) for c in out.columns if c not in ("l_returnflag", "n")))


@query("""WITH g AS (SELECT unnest(range(20))::INT AS code), c AS (SELECT least(floor((o_totalprice - 1000) / 25000), 19)::INT AS code, count(*) AS n FROM orders WHERE o_totalprice BETWEEN 1000 AND 501000 GROUP BY 1)
          SELECT code, coalesce(n, 0) AS n, round((coalesce(n, 0) + 1) / ((SELECT sum(n) + 20 FROM c) * 25000.0::DOUBLE), 12) AS density FROM g LEFT JOIN c USING (code)""")
def leaf_width_histogram(spark: SparkSession, d: str) -> DataFrame:
    return densities.width_histogram(S.read(spark, d, "orders"), "o_totalprice", 1000.0, 501_000.0, 20, alpha=1.0).withColumn("density", F.round("density", 12))


@query("""WITH j AS (SELECT l_returnflag AS f, l_linestatus AS s, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2)
          SELECT f, s, round(n / sum(n) OVER (), 6) AS p FROM j""")
def calibrated_clique(spark: SparkSession, d: str) -> DataFrame:
    """Belief of one clique after messages over the tree; it equals the joint distribution."""
    flag, status, taxes = _flag_tree(spark, d)
    cliques = {"fs": bayes.product(flag.select(F.col("value").alias("f"), "p"), status.select(F.col("parent").alias("f"), F.col("value").alias("s"), "p")), "ft": taxes.select(F.col("parent").alias("f"), F.col("value").alias("t"), "p")}
    return propagate.calibrate(cliques, [("fs", "ft")])["fs"].select("f", "s", F.round("p", 6).alias("p"))


@query()
def progressive_probability(spark: SparkSession, d: str) -> DataFrame:
    flag, status, taxes = _flag_tree(spark, d)
    conditions = {"flag": F.col("value").isin("N", "R"), "status": F.col("value") == "O", "tax": F.col("value").between(0.02, 0.05)}
    return progressive.estimated_probability(progressive.progressive_sample(spark, 10_000, [("flag", None, flag), ("status", "flag", status), ("tax", "flag", taxes)], conditions, seed=3))


@query("SELECT true AS probability_close, true AS expectation_close")
def progressive_sample_quality(spark: SparkSession, d: str) -> DataFrame:
    """A probability and an expectation by progressive sampling come within five standard errors (or a hundredth) of the exact ones."""
    flag, status, taxes = _flag_tree(spark, d)
    conditions = {"flag": F.col("value").isin("N", "R"), "status": F.col("value") == "O"}
    sample = progressive.progressive_sample(spark, 10_000, [("flag", None, flag), ("status", "flag", status), ("tax", "flag", taxes)], conditions, seed=5)
    estimate = progressive.estimated_probability(sample).select(F.col("p").alias("p_est"), "error")
    mean = progressive.weighted_expectation(sample, F.col("tax")).select("expectation")
    below = bayes.message(status, bayes.inside(conditions["status"]))
    tax = bayes.message(taxes, F.col("value").cast("double"))
    exact = bayes.message(flag, bayes.inside(conditions["flag"]), below).select(F.col("m").alias("p_exact"))
    exact_mean = bayes.message(flag, bayes.inside(conditions["flag"]), below, tax).select(F.col("m").alias("e_exact"))
    one = estimate.join(F.broadcast(mean)).join(F.broadcast(exact)).join(F.broadcast(exact_mean))  # one row each
    return one.select((F.abs(F.col("p_est") - F.col("p_exact")) <= 5 * F.col("error") + 1e-6).alias("probability_close"), (F.abs(F.col("expectation") - F.col("e_exact")) < 0.01).alias("expectation_close"))
