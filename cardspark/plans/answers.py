"""Approximate answers, their errors, what-if questions and model maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardspark.catalog import order_schema
from cardspark.functions.predicates import md5_below
from cardspark.operators import aqp, evaluate, stats
from cardspark.plans.registry import query
from cardspark.streaming import incremental

S = order_schema()
RATE = 0.25
_SAMPLE = "(SELECT * FROM lineitem WHERE md5(l_orderkey::VARCHAR || '|' || l_linenumber::VARCHAR) < '40')"


def _sample(spark: SparkSession, d: str) -> DataFrame:
    return S.read(spark, d, "lineitem").where(md5_below("40", "l_orderkey", "l_linenumber"))


@query(f"SELECT count(*) / 0.25::DOUBLE AS count_est, round(sum(l_extendedprice) / 0.25::DOUBLE, 2) AS sum_est, round(avg(l_extendedprice), 4) AS avg_est FROM {_SAMPLE} WHERE l_quantity < 25")
def approximate_aggregates(spark: SparkSession, d: str) -> DataFrame:
    one = aqp.estimates(_sample(spark, d).where("l_quantity < 25"), RATE, F.col("l_extendedprice"))
    return one.select("count_est", F.round("sum_est", 2).alias("sum_est"), F.round("avg_est", 4).alias("avg_est"))


@query(f"SELECT l_returnflag, round(sum(l_extendedprice * l_discount) / 0.25::DOUBLE, 4) AS product_est, round((sum(l_extendedprice) - sum(l_tax)) / 0.25::DOUBLE, 2) AS difference_est FROM {_SAMPLE} GROUP BY 1")
def approximate_expressions(spark: SparkSession, d: str) -> DataFrame:
    """SUM of a product, and the difference of two SUMs."""
    sample = _sample(spark, d)
    product = aqp.estimates(sample, RATE, F.col("l_extendedprice") * F.col("l_discount"), ["l_returnflag"]).select("l_returnflag", F.round("sum_est", 4).alias("product_est"))
    difference = aqp.combined(sample, RATE, [("+", F.col("l_extendedprice")), ("-", F.col("l_tax"))], ["l_returnflag"]).select("l_returnflag", F.round("sum_est", 2).alias("difference_est"))
    return product.join(difference, "l_returnflag")


@query(f"""WITH g AS (SELECT l_returnflag, l_linestatus, count(*)::DOUBLE AS n, avg(l_quantity) AS m, greatest(avg(l_quantity * l_quantity) - avg(l_quantity) * avg(l_quantity), 0) AS v FROM {_SAMPLE} GROUP BY ALL)
           SELECT l_returnflag, l_linestatus, n / 0.25 AS count_est, round(n / 0.25 - 1.6448536269514722 * sqrt(n * 0.75) / 0.25, 4) AS count_lo, round(n / 0.25 + 1.6448536269514722 * sqrt(n * 0.75) / 0.25, 4) AS count_hi,
                  round(m, 6) AS avg_est, round(m - 1.6448536269514722 * sqrt(v / n), 6) AS avg_lo, round(m + 1.6448536269514722 * sqrt(v / n), 6) AS avg_hi FROM g""")
def approximate_groups(spark: SparkSession, d: str) -> DataFrame:
    out = aqp.estimates(_sample(spark, d), RATE, F.col("l_quantity"), ["l_returnflag", "l_linestatus"])
    return out.select("l_returnflag", "l_linestatus", "count_est", *(F.round(c, 4).alias(c) for c in ("count_lo", "count_hi")), *(F.round(c, 6).alias(c) for c in ("avg_est", "avg_lo", "avg_hi")))


@query(f"""WITH e AS (SELECT l_returnflag, l_linestatus, count(*) / 0.25::DOUBLE AS x FROM {_SAMPLE} GROUP BY ALL), t AS (SELECT l_returnflag, l_linestatus, count(*) AS y FROM lineitem GROUP BY ALL)
           SELECT round(avg(abs(x - y) / y), 6) AS mean_error, round(max(abs(x - y) / y), 6) AS max_error, round(count(x) / count(y), 6) AS completeness, count(*) FILTER (y IS NULL) AS false_groups FROM e FULL JOIN t USING (l_returnflag, l_linestatus)""")
def approximation_report(spark: SparkSession, d: str) -> DataFrame:
    groups = ["l_returnflag", "l_linestatus"]
    truth = S.read(spark, d, "lineitem").groupBy(*groups).agg(F.count(F.lit(1)).alias("count_est"))
    one = evaluate.group_report(aqp.estimates(_sample(spark, d), RATE, F.col("l_quantity"), groups), truth, groups, "count_est")
    return one.select(*(F.round(c, 6).alias(c) for c in ("mean_error", "max_error", "completeness")), "false_groups")


@query("SELECT l_returnflag, sum(CASE WHEN l_quantity >= 40 THEN 1.2 ELSE 1.0 END)::DOUBLE AS count_new, round(sum(CASE WHEN l_quantity >= 40 THEN 1.2 ELSE 1.0 END::DOUBLE * l_extendedprice), 1) AS sum_new FROM lineitem GROUP BY 1")
def what_if_increase(spark: SparkSession, d: str) -> DataFrame:
    weight = aqp.what_if(F.col("l_quantity") >= 40, 20)
    out = aqp.estimates(S.read(spark, d, "lineitem"), 1.0, F.col("l_extendedprice"), ["l_returnflag"], weight)
    return out.select("l_returnflag", F.round("count_est", 6).alias("count_new"), F.round("sum_est", 1).alias("sum_new"))


@query("""WITH e AS (SELECT l_quantity AS q, count(*) FILTER (md5(l_orderkey::VARCHAR || '|' || l_linenumber::VARCHAR) < '40') * 4.0::DOUBLE AS e, count(*) AS t FROM lineitem GROUP BY 1),
          r AS (SELECT greatest(CASE WHEN e = 0 THEN 1 ELSE e END / t, t / CASE WHEN e = 0 THEN 1 ELSE e END) AS q FROM e)
          SELECT count(*) AS n_queries, 0::BIGINT AS n_failed, round(quantile_cont(q, 0.5), 6) AS p50, round(quantile_cont(q, 0.9), 6) AS p90, round(quantile_cont(q, 0.95), 6) AS p95, round(quantile_cont(q, 0.99), 6) AS p99, round(max(q), 6) AS max, round(avg(q), 6) AS mean FROM r""")
def q_error_percentiles(spark: SparkSession, d: str) -> DataFrame:
    each = S.read(spark, d, "lineitem").groupBy("l_quantity").agg((F.count(F.when(md5_below("40", "l_orderkey", "l_linenumber"), 1)) / RATE).alias("e"), F.count(F.lit(1)).alias("t"))
    one = evaluate.q_error_report(each, "e", "t")
    return one.select("n_queries", "n_failed", *(F.round(c, 6).alias(c) for c in ("p50", "p90", "p95", "p99", "max", "mean")))


@query("""WITH s AS (SELECT (SELECT count(*)::DOUBLE FROM customer WHERE c_mktsegment = 'BUILDING') / (SELECT count(*) FROM customer) AS a, (SELECT count(*)::DOUBLE FROM orders WHERE o_totalprice > 100000) / (SELECT count(*) FROM orders) AS b)
          SELECT round(a * b * (SELECT count(*) FROM customer JOIN orders ON c_custkey = o_custkey), 3) AS estimate FROM s""")
def naive_join_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Selectivities of the tables times the size of the join, as if they were independent."""
    customer, orders = S.read(spark, d, "customer"), S.read(spark, d, "orders")
    size = customer.join(orders, F.col("c_custkey") == F.col("o_custkey")).agg(F.count(F.lit(1)).alias("size"))
    a = customer.agg(F.avg((F.col("c_mktsegment") == "BUILDING").cast("double")).alias("a"))
    b = orders.agg(F.avg((F.col("o_totalprice") > 100_000).cast("double")).alias("b"))
    return size.join(F.broadcast(a)).join(F.broadcast(b)).select(F.round(F.col("a") * F.col("b") * F.col("size"), 3).alias("estimate"))  # one row each


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_tax FROM lineitem WHERE l_quantity > 45")
def group_tuples(spark: SparkSession, d: str) -> DataFrame:
    return S.read(spark, d, "lineitem").where("l_quantity > 45").select("l_returnflag", "l_linestatus", "l_tax").distinct()


@query("SELECT round(c, 4) AS effect, round(i, 3) AS intercept FROM (SELECT regr_slope(l_extendedprice, l_quantity) AS c, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem)")
def linear_effect(spark: SparkSession, d: str) -> DataFrame:
    intercept, slope = stats.least_squares(S.read(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"])
    return spark.createDataFrame([(round(slope, 4), round(intercept, 3))], "effect double, intercept double")


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean_x, round(avg(value * value), 4) AS mean_x2, round(sum(CASE WHEN value <> 0 THEN 1 / value END) / count(value), 6) AS mean_inverse FROM events GROUP BY 1")
def incremental_leaves(spark: SparkSession, d: str) -> DataFrame:
    """State of two parts of the events, merged."""
    events = spark.read.parquet(f"{d}/events.parquet")
    early, late = F.col("event_id") % 3 != 0, F.col("event_id") % 3 == 0
    state = incremental.merged(incremental.leaf_state(events.where(early), "event_type", "value"), incremental.leaf_state(events.where(late), "event_type", "value"), "event_type")
    return incremental.statistics(state, "event_type").select("event_type", "n", F.round("mean_x", 6).alias("mean_x"), F.round("mean_x2", 4).alias("mean_x2"), F.round("mean_inverse", 6).alias("mean_inverse"))


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    events = spark.read.parquet(f"{d}/events.parquet")
    return incremental.windowed_counts(events, "ts", "1 hour", "event_type").withColumn("total", F.round("total", 4))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
          s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
          SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return incremental.sessions(spark.read.parquet(f"{d}/events.parquet"), "ts", "6 hours", "user_id")
