"""Models of tables and joins, networks and preparation on small fixtures."""

import collections
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from cardspark.catalog import Relationship, SchemaGraph, TableDef
from cardspark.operators import aqp, bayes, encode, ensemble, graph, joins, networks, stats, trees
from cardspark.plans.estimates import asked, workload
from cardspark.sources import prepare
from cardspark.streaming.incremental import nearest_center

EDGE = Relationship("child", "fk", "parent", "pk")
SCHEMA = SchemaGraph((TableDef("parent", "pk", ("note",)), TableDef("child")), (EDGE,))


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(3)
    out = [(draw.choice(["a", "b", None]), draw.choice([1, 2, None]), round(draw.gauss(0, 1), 3) if draw.random() < 0.9 else None) for _ in range(400)]
    return [(x, (y if x != "a" else 1), z if z is None or y is None else z + y) for x, y, z in out]


def test_the_whole_domain_has_probability_one(spark, rows):
    df = spark.createDataFrame(rows, "x string, y int, z double")
    model = trees.fit(df, ["x", "y", "z"], n_mcv=1, n_bins=4)
    lines = [(1, "x", "in", "a", "b"), (2, "x", "is null"), (3, "y", "is not null"), (4, "y", "is null"), (5, "z", "is null"), (6, "z", ">=", -1e9), (6, "z", "<=", 1e9), (7, "z", "<", -1e9), (8, "x", "=", "nowhere")]
    found = {r.query_id: r.cardinality for r in trees.estimate(model, asked(spark, lines)).collect()}
    n = len(rows)
    expected = [sum(x is not None for x, _, _ in rows), None, sum(y is not None for _, y, _ in rows), None, sum(z is None for *_, z in rows), sum(z is not None for *_, z in rows), 0, 0]
    expected[1], expected[3] = n - expected[0], n - expected[2]
    assert [found[k] for k in range(1, 9)] == pytest.approx(expected)
    empty = trees.fit(df.limit(0), ["x", "y"])
    assert [r.cardinality for r in trees.estimate(empty, asked(spark, [(1, "x", "=", "a")])).collect()] == [0.0]


def test_a_tree_equals_brute_force(spark, rows):
    """Messages over a chain of three columns against sums over all states, for each root."""
    df = spark.createDataFrame([(x, y, None if z is None else z > 1) for x, y, z in rows], "x string, y int, z boolean").withColumn("z", F.col("z").cast("string"))
    model = trees.fit(df, ["x", "y", "z"], edges=[("x", "y"), ("y", "z")])
    own = [tuple(r) for r in df.collect()]
    p = lambda c: sum(map(c, own)) / len(own)
    exact = 0.0
    for x, y, z in itertools.product(["a", "b", None], [1, 2, None], ["true", "false", None]):
        if x == "b" and z == "true" and p(lambda r: r[1] == y):
            exact += p(lambda r: r[:2] == (x, y)) * p(lambda r: r[1:] == (y, z)) / p(lambda r: r[1] == y)
    conditions = asked(spark, [(1, "x", "=", "b"), (1, "z", "=", "true")])
    assert trees.estimate(model, conditions).first().p == pytest.approx(exact)
    groups = {r.number: r.cardinality for r in trees.group_estimate(model, conditions, "y").collect()}
    assert sum(groups.values()) == pytest.approx(exact * len(own))
    best = max(((x, y, z) for x, y, z in itertools.product(["a", "b", None], [1, 2, None], ["true", "false", None]) if p(lambda r: r[1] == y)), key=lambda s: p(lambda r: r[:2] == s[:2]) * p(lambda r: r[1:] == s[1:]) / p(lambda r: r[1] == s[1]))
    likely = {r.attribute: (r.code, r.p) for r in trees.most_likely(model, asked(spark, [(1, "x", "is not null"), (1, "x", "is null")]).limit(0), spark.createDataFrame([(1,)], "query_id long")).collect()}
    assert likely["x"][1] == pytest.approx(p(lambda r: r[:2] == best[:2]) * p(lambda r: r[1:] == best[1:]) / p(lambda r: r[1] == best[1]))


def test_shares_of_a_code_add_up_to_one_at_most(spark):
    df = spark.createDataFrame([(k % 7,) for k in range(700)] + [(9,)] * 50, "v int")
    model = trees.fit(df, ["v"], n_mcv=1, n_bins=2)
    found = {r.query_id: r.cardinality for r in trees.estimate(model, asked(spark, [(1, "v", "in", 1, 1, 2), (2, "v", "<", 100), (3, "v", "=", 9)])).collect()}
    assert found == pytest.approx({1: 200.0, 2: 750.0, 3: 50.0})


def test_bins_cover_ranges_by_their_share(spark):
    df = spark.createDataFrame([(float(k),) for k in range(1001)], "v double")
    model = trees.fit(df, ["v"], n_bins=5)
    assert model.encodings[0].kind == "continuous"
    found = {r.query_id: r.cardinality for r in trees.estimate(model, asked(spark, [(1, "v", ">", 250), (1, "v", "<=", 750), (2, "v", "=", 500), (3, "v", "<", 0), (4, "v", "not in", 7)])).collect()}
    assert found[1] == pytest.approx(500, abs=5) and found[2] == pytest.approx(1, abs=0.1) and found[3] == pytest.approx(0, abs=1.5) and found[4] == pytest.approx(1000, abs=1)


def test_value_codes_restart_with_each_bin():
    counts = [("a", 50), ("b", 4), ("c", 1), ("d", 1), ("e", 4), ("f", 2)]
    assert [(v, c) for v, c, *_ in encode.value_codes(counts, 1, 3)] == [("a", 1), ("b", 2), ("c", 3), ("d", 3), ("e", 3), ("f", 4)]
    assert encode.value_codes([], 3, 3) == []


def test_joins_of_models_are_exact_where_columns_hang_together(spark):
    parent = spark.createDataFrame([(1, "u", "-"), (2, "v", "-"), (3, "u", "-"), (4, None, "-")], "pk int, x string, note string")
    child = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (9, 1), (None, 2)], "fk int, y int")
    columns = {"parent": ["x"], "child": ["y"]}
    edges = [("x", "y"), ("x", "mul_child_fk_nn"), ("x", "parent_nn"), ("y", "child_nn")]
    one = ensemble.fit_edge(parent, child, EDGE, columns, edges=edges)
    assert one.model.rows == 7
    conditions = asked(spark, [(1, "x", "=", "u"), (2, "x", "=", "v"), (2, "y", "=", 1), (3, "x", "=", "u"), (3, "y", "=", 7)])
    queries = conditions.select("query_id").distinct()
    assert {r.query_id: round(r.cardinality, 6) for r in ensemble.pair_estimate(one, conditions, queries).collect()} == {1: 2, 2: 1, 3: 0}
    assert {r.query_id: round(r.cardinality, 6) for r in ensemble.side_estimate(one, "parent", ["x"], conditions, queries).collect()} == {1: 2, 2: 1, 3: 2}
    joined = {r.query_id: r.cardinality for r in ensemble.join_estimate({("child", "parent"): one}, [EDGE], columns, conditions).collect()}
    assert joined == pytest.approx({1: 2.0, 2: 1.0, 3: 1.0})
    true = {r.query_id: r.cardinality for r in ensemble.true_counts(parent.join(child, F.col("pk") == F.col("fk")), conditions).collect()}
    assert true == {1: 2, 2: 1, 3: 0}
    known = joins.edge_statistics(parent, child, EDGE).first().asDict()
    assert (known["parents"], known["childless"], known["orphans"]) == (4, 2, 2.0)
    assert joins.join_size_estimate({("child", "parent"): known}, {"parent": 4}, [EDGE])[1] == joins.full_outer(parent, child, EDGE).count()
    with pytest.raises(ValueError):
        joins.join_size_estimate({("child", "parent"): known}, {"parent": 4}, [EDGE, EDGE])


def test_recursive_network_learns_and_answers(spark):
    draw = random.Random(5)
    data = []
    for _ in range(3000):
        side = draw.random() < 0.5
        data.append((draw.gauss(0 if side else 20, 1), draw.gauss(0 if side else 20, 1), float(draw.randrange(5)), 7.0))
    df = spark.createDataFrame(data, "a double, b double, c double, d double")
    root = networks.learn(df, ["a", "b", "c", "d"], least_rows=200, most_depth=3)
    assert networks.faults(root) == [] and set(root.columns) == {"a", "b", "c", "d"}
    kinds = [n.kind for _, n in networks.walk(root)]
    assert root.kind == "product" and "sum" in kinds
    leaves = networks.fit(df.withColumn("a", F.round("a")).withColumn("b", F.round("b")), root)
    true = sum(a < 10 and b < 10 for a, b, *_ in data) / len(data)
    found = networks.probability(leaves, root, {"a": F.col("value") < 10, "b": F.col("value") < 10}).first().p
    assert abs(found - true) < 0.05 and abs(found - (sum(a < 10 for a, *_ in data) / len(data)) ** 2) > 0.1
    assert networks.probability(leaves, root, {}).first().p == pytest.approx(1.0)
    assert networks.faults(networks.product(networks.leaf("a"), networks.leaf("a"))) and networks.faults(networks.total(["a"], [(1.0,)], networks.leaf("a"), networks.leaf("a")))


def test_network_of_nulls(spark):
    root = networks.total(["x", "y"], [(0.0, 0.0), (10.0, 10.0)], *(networks.product(networks.leaf("x"), networks.leaf("y")) for _ in range(2)))
    df = spark.createDataFrame([(0.0, 1.0), (None, 1.0), (10.0, None), (None, None), (9.0, 11.0)], "x double, y double")
    assert [r.k for r in df.select(nearest_center(["x", "y"], [(0.0, 0.0), (10.0, 10.0)]).alias("k")).collect()] == [0, 0, 1, 0, 1]
    leaves = networks.fit(df, root)
    assert networks.probability(leaves, root, {}).first().p == pytest.approx(1.0)
    one = networks.expectation(leaves, root, networks.relevant({"y": F.col("value") > 0}, ["x"]), {"x": 1}).first()
    assert one.p == pytest.approx(3 / 5 * (1 / 3 * 2 / 3) + 2 / 5 * (1 / 2)) and one.n == 5


def test_closures(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(100)], "parent int, child int")
    assert graph.ancestors(chain).count() == 5050
    circle = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "parent int, child int")
    assert graph.ancestors(circle).count() == 9 and graph.ancestors(circle.limit(0)).count() == 0


def test_null_states_of_tables(spark):
    df = spark.createDataFrame([("u", "x"), ("u", "x"), (None, "y"), ("w", None)], "p string, v string")
    top = bayes.message(bayes.conditional_table(df, "p"), F.lit(1.0), bayes.message(bayes.conditional_table(df, "v", "p"), F.lit(1.0)))
    assert top.first().m == pytest.approx(1.0)
    two = bayes.conditional_table(df.withColumn("q", F.lit(1)), "v", ["p", "q"])
    assert two.count() == 9 and two.where("n = 2").first().p == 1.0


def test_sums_of_different_columns(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 5.0), (None, 7.0)], "a double, b double")
    assert aqp.combined(df, 1.0, [("+", F.col("a")), ("-", F.col("b"))]).first().sum_est == 3.0 - 12.0


def test_running_sums_and_quantiles(spark):
    draw = random.Random(9)
    values = [round(draw.gauss(0, 3), 2) for _ in range(2000)] + [1.5] * 900
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    counts = encode.value_counts(df, "v")
    upto = {r.value: r.upto for r in encode.cumulated(counts).collect()}
    assert all(upto[v] == sum(x <= v for x in values) for v in random.Random(1).sample(sorted(set(values)), 50))
    points = [0.0, 0.1, 0.37, 0.5, 0.999, 1.0]
    exact = df.agg(F.percentile("v", F.array(*map(F.lit, points))).alias("p")).first().p
    assert encode.quantiles(counts, points).first().p == pytest.approx(exact)
    assert encode.quantile_bins(df.limit(0), "v", 4).count() == 0
    with pytest.raises(ValueError):
        encode.bounded(spark.range(11), 10)


def test_prepared_schema(spark, tmp_path):
    tables = {"parent": spark.createDataFrame([(1, "u", "-"), (2, None, "-"), (3, "u", "-")], "pk int, x string, note string"), "child": spark.createDataFrame([(1, 1), (1, 2), (9, 1), (None, 2)], "fk int, y int")}
    known = prepare.prepare_schema(spark, SCHEMA, tables, str(tmp_path))
    assert {(r.table, r.attribute): r.reason for r in known.collect() if r.reason} == {("parent", "pk"): "key", ("child", "fk"): "foreign key"}
    parent = spark.read.parquet(str(tmp_path / "parent"))
    assert parent.columns == ["pk", "x", "mul_child_fk", "mul_child_fk_nn"]
    assert sorted(r.y for r in spark.read.parquet(str(tmp_path / "child__without__parent")).collect()) == [1, 2]
    few, n, rate = prepare.prepared_table(SCHEMA, {"parent": spark.range(1000).select(F.col("id").alias("pk"), F.lit("x").alias("x"), F.lit("-").alias("note"))}, "parent", 100)
    assert n == 1000 and rate == 0.1 and 60 < few.count() < 140
    (tmp_path / "t.csv").write_text("query_no,x,cardinality\n0,a,5\n1,b,7\n")
    assert [tuple(r) for r in prepare.true_cardinalities(spark, str(tmp_path / "t.csv")).collect()] == [(0, 5), (1, 7)]
    assert prepare.load_models(spark, [str(tmp_path)], "metadata").count() == known.count()


def test_samples_of_joins(spark):
    parent, child = spark.range(400).select(F.col("id").alias("pk")), spark.range(900).select((F.col("id") % 450).alias("fk"), F.col("id").alias("y"))
    part = joins.sampled_outer_join(parent, child, EDGE, 0.5, "y")
    kept = {r.pk for r in part.where("pk IS NOT NULL").select("pk").distinct().collect()}
    assert 150 < len(kept) < 250 and part.where("pk IS NOT NULL").count() == 2 * len(kept)
    assert 30 < part.where("pk IS NULL").count() < 70
    assert joins.outer_join_sample(parent, child, EDGE, 100, "y").count() == 100
    first, later = joins.split_for_learning(child, before=("y", 300))
    assert (first.count(), later.count()) == (300, 600)
    assert joins.sampling_rate(1000, 100) == 0.1 and joins.sampling_rate(10, 100, 0.5) == 0.5 and joins.sampling_rate(0, 5) == 1.0


def test_dependence_of_ranks(spark):
    draw = random.Random(2)
    df = spark.createDataFrame([(x, math.sin(6 * x) + draw.gauss(0, 0.05), draw.random()) for x in (draw.random() for _ in range(1500))], "a double, b double, c double")
    found = networks.rdc(df, ["a", "b", "c"])
    assert found["a", "b"] > 0.8 and found["a", "c"] < 0.3 and found["b", "c"] < 0.3
    assert stats.covariances(df, ["a", "b"]).count() == 3


def test_counts_of_codes_equal_the_codes_counted(spark, rows):
    """Codes of Arrow batches against codes as expressions, for bins, numbers and text with nulls, and values unknown to the encoding."""
    df = spark.createDataFrame([(*r, float(k % 300)) for k, r in enumerate(rows)], "x string, y int, z double, w double")
    encodings = encode.encode_table(df, ["x", "y", "z", "w"], 2, 4)
    assert {e.kind for e in encodings} == {"categorical", "continuous"}
    more = df.unionByName(spark.createDataFrame([("new", 77, 1e9, -1.0), (None, None, math.nan, math.nan), ("a", 1, -1e9, -0.0)], df.schema)).repartition(3)
    pairs = [("x", "y"), ("z", "w"), ("y", "z"), ("x", "x"), ("w", "w")]
    codes = [r.asDict() for r in encode.encoded(more, encodings).collect()]
    expected = collections.Counter((k, r[a], r[b]) for r in codes for k, (a, b) in enumerate(pairs))
    assert {(r.pair, r.x, r.y): r.n for r in trees.pair_counts(more, encodings, pairs).collect()} == expected
    assert trees.pair_counts(more.limit(0), encodings, pairs).collect() == []


def test_grouped_rows_give_the_same_model(spark, rows):
    """Rows grouped with their number, as rows one by one; columns with bins and fan-outs among them."""
    own = [(x, y, z, float(1 + k % 3)) for k, (x, y, z) in enumerate(rows * 2)]
    df = spark.createDataFrame(own, "x string, y int, z double, mul_child_fk_nn double")
    grouped = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))
    one, other = trees.fit(df, df.columns, 2, 4), trees.fit(grouped, df.columns, 2, 4, weight="n")
    assert (one.rows, one.edges, one.joint, one.single) == (other.rows, other.edges, other.joint, other.single)
    for a, b in zip(one.encodings, other.encodings):
        assert a.lines == b.lines and (a.fan_out or ()) == pytest.approx(b.fan_out or ())


def test_counting_codes_is_compiled_whole(spark):
    """Codes are no expressions in the plan: with some columns those made up a method that was too long to be compiled."""
    df = spark.range(2000).select(*((F.col("id") * k % 2000).cast("double").alias(f"c{k}") for k in (1, 3, 7)))
    encodings = encode.encode_table(df, df.columns)
    plan = trees.pair_counts(df, encodings, list(itertools.combinations(df.columns, 2)))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and len(plan) < 2000


def test_a_workload_and_its_counts_over_grouped_rows(spark):
    """The same queries and true counts from grouped rows; the join under an edge's model is worked out once."""
    draw = random.Random(5)
    df = spark.createDataFrame([(draw.choice("abc"), draw.choice([1, 2, 3, None])) for _ in range(300)], "s string, k int")
    grouped = joins.grouped(df, ["s", "k"], "n")
    assert grouped.count() == 12 and grouped.agg(F.sum("n")).first()[0] == 300
    one, other = workload(df, ["s", "k"], 40), workload(grouped, ["s", "k"], 40, "n")
    assert sorted(one.collect()) == sorted(other.collect()) and one.select("query_id").distinct().count() == 40
    assert sorted(ensemble.true_counts(df, one).collect()) == sorted(ensemble.true_counts(grouped, other, weight="n").collect())


def test_an_edge_model_reads_its_tables_once(spark):
    """Rows of the child go through a function that counts its calls: one pass for fan-outs, one for the join, whatever is learnt from it."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(k):
        calls.add(1)
        return k

    parent = spark.createDataFrame([(k, f"p{k % 4}") for k in range(50)], "pk long, a string")
    child = spark.createDataFrame([(k % 60, f"c{k % 3}", k % 5) for k in range(300)], "fk long, b string, c long").select(seen.asNondeterministic()("fk").alias("fk"), "b", "c")
    model = ensemble.fit_edge(parent, child, EDGE, {"parent": ["a"], "child": ["b", "c"]}).model
    assert model.rows == 300 and calls.value <= 2 * 300


def test_a_tree_is_learnt_from_all_rows(spark, monkeypatch):
    """More rows than were once sampled; z follows x, but for one row in which it follows y."""
    def sample(*a, **k):
        raise AssertionError("rows were sampled")

    x, other = F.col("id") % 2, F.col("id") >= 200_000
    df = spark.range(250_000).select(x.alias("x"), F.when(other, 1 - x).otherwise(x).alias("y"), F.when(F.col("id") >= 224_999, 1 - x).otherwise(x).alias("z"))
    monkeypatch.setattr(type(df), "sample", sample)
    for columns in (["x", "y", "z"], ["z", "y", "x"]):
        model = trees.fit(df, columns)
        assert {frozenset(e) for e in model.edges} == {frozenset("xz"), frozenset("yz")}
        for a, b in model.edges:
            codes = {c: {v: k for k, v in ((line[0], line[2]) for line in model.encoding(c).lines) if v is not None} for c in (a, b)}
            counts = {(codes[a][float(r[a])], codes[b][float(r[b])]): r["count"] for r in df.groupBy(a, b).count().collect()}
            table = model.joint[a, b]
            assert {(i, j): n for i, row in enumerate(table) for j, n in enumerate(row) if n} == counts
