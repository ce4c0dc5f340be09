"""Every registered query of the core against its SQL, and small fixtures."""

import math
import os

import pytest
from pyspark.sql import functions as F

from cardspark.functions.predicates import conjunction, overlap_share
from cardspark.operators import aqp, bayes, encode, evaluate, joins, leaves, spn, stats
from cardspark.catalog import Relationship
from cardspark.plans import catalogue
from cardspark.sources import readers
from cardspark.streaming import incremental

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    own = duckdb.connect()
    for t in TABLES:
        own.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return own


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, duck, name):
    found = catalogue.queries()[name](spark, DATA)
    expected = duck.execute(catalogue.ORACLES[name])
    names = [c[0] for c in expected.description]
    assert sorted(names) == sorted(found.columns)
    rows = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in found.collect()), key=str)
    assert rows == sorted((tuple(plain(dict(zip(names, r))[c]) for c in sorted(names)) for r in expected.fetchall()), key=str)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_runs(spark, name):
    assert catalogue.queries()[name](spark, DATA).count() > 0


EDGE = Relationship("child", "fk", "parent", "pk")


@pytest.fixture(scope="module")
def padded(spark):
    parent = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "pk int, x string")
    child = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (9, 13), (None, 14)], "fk int, y int")
    return parent, child


def test_full_outer_and_fan_out(padded):
    parent, child = padded
    rows = {(r.pk, r.y): (r.parent_nn, r.child_nn) for r in joins.full_outer(parent, child, EDGE).collect()}
    assert rows == {(1, 10): (1, 1), (1, 11): (1, 1), (2, 12): (1, 1), (3, None): (1, 0), (4, None): (1, 0), (None, 13): (0, 1), (None, 14): (0, 1)}
    fan = {r.pk: (r["mul_child_fk"], r["mul_child_fk_nn"]) for r in joins.with_fan_out(parent, child, EDGE).collect()}
    assert fan == {1: (2, 2), 2: (1, 1), 3: (0, 1), 4: (0, 1)}
    assert [r.pk for r in joins.without_partner(parent, child, "pk", "fk").orderBy("pk").collect()] == [3, 4]
    one = joins.mean_fan_out(parent, child, EDGE).first()
    assert joins.outer_join_size(one.n_parents, [one.mean_fan_out], 2) == joins.full_outer(parent, child, EDGE).count()


def test_predicates(padded):
    parent, _ = padded
    assert parent.where(conjunction([])).count() == 4
    assert [r.pk for r in parent.where(conjunction([("x", "not in", ["b"]), ("pk", ">", 1)])).collect()] == [3]
    assert parent.where(conjunction([("x", "is null")])).count() == 1


def test_bin_overlap(spark):
    bins = spark.createDataFrame([(0.0, 10.0), (10.0, 20.0), (20.0, 40.0), (7.0, 7.0)], "lo double, hi double")
    share = lambda a, b: [r.s for r in bins.select(overlap_share(F.col("lo"), F.col("hi"), a, b).alias("s")).collect()]
    assert share(5, 30) == [0.5, 1.0, 0.5, 1.0]
    assert share(50, 60) == [0.0, 0.0, 0.0, 0.0]
    assert share(-5, 100) == [1.0, 1.0, 1.0, 1.0]


def test_most_common_ties_and_empty(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "a", "b", "a", "c", None]], "v string")
    assert [(r.value, r.n, r.code) for r in encode.most_common(df, "v", 2).orderBy("code").collect()] == [("a", 2, 0), ("b", 2, 1)]
    assert [(r.value, r.code) for r in encode.dictionary(df, "v").orderBy("code").collect()] == [("a", 1), ("b", 2), ("c", 3)]
    assert encode.most_common(df.limit(0), "v", 2).count() == 0
    assert [(r.value, r.code, r.share) for r in encode.tail_bins(df, "v", 2, 5).collect()] == [("c", 2, 1.0)]


def test_unseen_parent_state_is_uniform(spark):
    df = spark.createDataFrame([("u", "x"), ("u", "x"), ("w", "y"), ("z", None)], "p string, v string").where("v IS NOT NULL OR p = 'z'")
    table = bayes.conditional_table(df.na.drop(), "v", "p")
    assert {(r.parent, r.value): r.p for r in table.collect()} == {("u", "x"): 1.0, ("u", "y"): 0.0, ("w", "x"): 0.0, ("w", "y"): 1.0}


def test_message_equals_brute_force(spark):
    rows = [(a, b, (a + b) % 2) for a in range(2) for b in range(2) for _ in range(1 + a + 2 * b)]
    df = spark.createDataFrame(rows, "a int, b int, c int")
    below = bayes.message(bayes.conditional_table(df, "c", "a"), bayes.inside(F.col("value") == 1))
    found = bayes.message(bayes.conditional_table(df, "a"), F.lit(1.0), below).first().m
    assert found == pytest.approx(sum(r[2] for r in rows) / len(rows))


def test_maximum_tree_breaks_ties_by_name():
    assert stats.maximum_tree([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("c", "d", 0.5)]) == [("a", "b", 1.0), ("a", "c", 1.0), ("c", "d", 0.5)]


def test_q_error_conventions(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 5.0), (5.0, 0.0), (2.0, 8.0), (None, 4.0)], "e double, t double")
    assert [r.q for r in df.select(evaluate.q_error(F.col("e"), F.col("t")).alias("q")).collect()] == [1.0, 5.0, 5.0, 4.0, 4.0]
    assert evaluate.q_error_report(df, "e", "t").first().n_failed == 1


def test_intervals_of_leaves(spark):
    leaf = leaves.histogram(spark.createDataFrame([(1,), (2,), (2,), (4,), (None,)], "x int"), "x")
    p = lambda *a: leaves.leaf_probability(leaf, leaves.interval(*a)).first().p
    assert (p(1, 2), p(1, 2, True), p(1, 2, False, True), p(None, None), p(9, None)) == pytest.approx((0.6, 0.4, 0.2, 0.8, 0.0))


def test_estimates_without_sampling_are_exact(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], "g string, x double")
    found = {r.g: (r.count_est, r.sum_est, r.avg_est, r.count_sd) for r in aqp.estimates(df, 1.0, F.col("x"), ["g"]).collect()}
    assert found == {"a": (2.0, 4.0, 2.0, 0.0), "b": (1.0, None, None, 0.0)}


def test_sum_product_model_adds_up(spark):
    df = spark.createDataFrame([(float(k % 5), float(k % 3), k) for k in range(60)], "a double, b double, k int")
    structure = spn.learn_structure(df, ["a", "b"], threshold=0.5)
    assert structure.groups == (("a",), ("b",))
    joined = spn.Structure((("a", "b"),), (((0.0, 0.0), (4.0, 2.0)),))
    whole, parts = spn.fit(df, joined), spn.updated(spn.fit(df.where("k < 20"), joined), spn.fit(df.where("k >= 20"), joined))
    assert sorted(map(tuple, whole.collect())) == sorted(tuple(r) for r in parts.select(whole.columns).collect())
    assert spn.probability(whole, {}).first().p == pytest.approx(1.0)


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "q.sql").write_text("SELECT COUNT(*) FROM t WHERE a = 1||12\n\nSELECT COUNT(*) FROM t\n")
    assert [tuple(r) for r in readers.query_file(spark, str(tmp_path / "q.sql")).collect()] == [("SELECT COUNT(*) FROM t WHERE a = 1", 12), ("SELECT COUNT(*) FROM t", None)]
    (tmp_path / "t.csv").write_text('1,"a \\"b\\", c"\n2,\n')
    assert [tuple(r) for r in readers.headerless_csv(spark, str(tmp_path / "t.csv"), "k int, s string").collect()] == [(1, 'a "b", c'), (2, None)]
    (tmp_path / "h.csv").write_text("Body Type,Zip\nx,1\n,2\n")
    assert [tuple(r) for r in readers.headed_csv(spark, str(tmp_path / "h.csv"), ("Zip",), True).collect()] == [("x",)]
    model = {"edges": spark.createDataFrame([("a", "b", 0.5)], "a string, b string, w double")}
    readers.save_model(model, str(tmp_path / "model"))
    assert [tuple(r) for r in readers.load_model(spark, str(tmp_path / "model"), ["edges"])["edges"].collect()] == [("a", "b", 0.5)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, "t%d" % (k % 3), float(k % 7)) for k in range(100)]
    df = spark.createDataFrame(rows, "event_id long, event_type string, value double")
    for part in range(4):
        df.where(F.col("event_id") % 4 == part).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    incremental.maintain(stream, "event_type", "value", str(tmp_path / "state"), str(tmp_path / "checkpoint")).awaitTermination()
    found = {r.event_type: (r.n, r.sum_x, r.sum_x2) for r in incremental.current(spark, str(tmp_path / "state"), "event_type").collect()}
    assert found == {r.event_type: (r.n, r.sum_x, r.sum_x2) for r in incremental.leaf_state(df, "event_type", "value").collect()}


def test_summaries_for_very_many_values(spark):
    df = spark.range(10_000).select(F.col("id").cast("double").alias("x"), (F.col("id") % 2).alias("b"))
    exact, near = (encode.quantile_bins(df, "x", 10, accuracy).orderBy("code").collect() for accuracy in (None, 1000))
    assert len(exact) == len(near) == 10 and all(abs(a.hi - b.hi) <= 20 for a, b in zip(exact, near))
    kinds = {r.attribute: r.kind for r in encode.attribute_kinds(df, ["x", "b"], error=0.02).collect()}
    assert kinds == {"x": "continuous", "b": "boolean"}


def test_no_bin_is_lost_on_the_last_digits_of_its_mean(spark):
    """Means whose last digits differ each time they are worked out, as sums do that arrive in another order."""
    import random

    digits = F.udf(lambda: random.random() * 1e-9, "double").asNondeterministic()
    df = spark.range(2000).select((F.col("id") % 1000 + digits()).alias("x"))
    reuse = "spark.sql.exchange.reuse"
    spark.conf.set(reuse, "false")
    try:
        found = leaves.adaptive_histogram(df, "x", 50).collect()
    finally:
        spark.conf.unset(reuse)
    assert len(found) == 50 and sum(r.n for r in found) == 2000
    assert sorted(r.upto for r in found) == pytest.approx([(k + 1) / 50 for k in range(50)], abs=0.002)
