import math
import random

import numpy as np
import pyarrow as pa
import pytest

from cardspark.llm import range_join
from cardspark.llm.components import components
from cardspark.llm.range_join import linked_vectors
from cardspark.llm.top_k import top_k
from tests.llm import helpers

SCHEMA = "vec_id long, embedding array<float>, label int, n_links int, score int"
ODD = [None, [], [0.0, 0.0, 0.0], [math.nan, 1.0, 0.0], [math.inf, 1.0, 0.0], [None, 1.0, 0.0], [1.0, 0.0], [2.0, 0.1], [1e30, 0.0, 1e29], [1e-30, 0.0, 1e-31]]


def vectors(n, seed):
    draw = np.random.default_rng(seed)
    base = draw.normal(size=(n // 6, 3))
    out = [[float(np.float32(x)) for x in base[k % len(base)] + draw.normal(scale=0.1, size=3)] for k in range(n)]
    return [*out, *out[:20], *ODD]


def cosine_groups(table):
    usable = [k for k, v in table if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    own = dict(table)
    unit = {k: np.array(own[k], dtype=float) / max(map(abs, own[k])) for k in usable}
    unit = {k: v / np.linalg.norm(v) for k, v in unit.items()}
    links = {k: [] for k, _ in table}
    for i, a in enumerate(usable):
        for b in usable[:i]:
            if len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= 0.95:
                links[a].append(b)
                links[b].append(a)
    place = {k: i for i, (k, _) in enumerate(table)}
    roots = helpers.components(len(table), [(place[a], place[b]) for a in links for b in links[a]])
    least = {}
    for (k, _), r in zip(table, roots):
        least[r] = min(least.get(r, k), k)
    return sorted((k, len(links[k]), least[r], least[r] == k) for (k, _), r in zip(table, roots))


@pytest.mark.parametrize("block,stream,cell", [(4096, 65536, 4096), (7, 40, 25)])
def test_range_join(spark, monkeypatch, block, stream, cell):
    monkeypatch.setattr(range_join, "BLOCK_ROWS", block)
    monkeypatch.setattr(range_join, "STREAM_ROWS", stream)
    monkeypatch.setattr(range_join, "CELL_ROWS", cell)
    table = list(enumerate(vectors(150, 3)))
    random.Random(2).shuffle(table)
    df = spark.createDataFrame([(k, v, 0, 1, 2) for k, v in table], SCHEMA).repartition(3)
    assert sorted(map(tuple, linked_vectors(df, 0.95).collect())) == cosine_groups(table)


def test_range_join_of_many_lengths(spark, monkeypatch):
    """Lengths with few vectors or a small share of them have no pivots; none is left out."""
    monkeypatch.setattr(range_join, "MOST_PIVOTS", 4)
    monkeypatch.setattr(range_join, "CELL_ROWS", 20)
    monkeypatch.setattr(range_join, "BLOCK_ROWS", 8)
    draw = np.random.default_rng(6)
    lengths = [3] * 90 + [2] * 40 + list(range(4, 34)) * 2
    table = [(k, [float(x) for x in np.abs(draw.normal(size=n).astype(np.float32)) + 1]) for k, n in enumerate(lengths)]
    df = spark.createDataFrame([(k, v, 0, 1, 2) for k, v in table], SCHEMA).repartition(3)
    assert sorted(map(tuple, linked_vectors(df, 0.95).collect())) == cosine_groups(table)


def test_range_join_of_vectors_that_pivots_do_not_part(spark, monkeypatch):
    """Vectors that visit nearly all cells: there are fewer cells, and copies are passed on some at a time."""
    draw = np.random.default_rng(8)
    base = draw.normal(size=(2000, 64))
    base[1000:1200] = base[:200] + draw.normal(scale=0.2, size=(200, 64))
    monkeypatch.setattr(range_join, "CELL_ROWS", 20)
    monkeypatch.setattr(range_join, "BLOCK_ROWS", 20)
    table = [(k, [float(x) for x in v.astype(np.float32)]) for k, v in enumerate(base)]
    df = spark.createDataFrame([(k, v, 0, 1, 2) for k, v in table], SCHEMA).repartition(3)
    sent, placed = [], range_join._placed
    pivots, gaps = {64: range_join.unit(base[:100])}, {64: range_join._gaps(range_join.unit(base[:100]))}
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array([1] * 2000), pa.array([v for _, v in table], pa.list_(pa.float32()))], names=["id", "n", "v"])
    monkeypatch.setattr(range_join, "PLACE_BYTES", 1 << 16)
    for out in placed(iter([batch]), pivots, gaps, math.acos(0.95), "<f4"):
        sent.append(out.num_rows)
        assert out.nbytes <= 1 << 17
    assert sum(sent) > 20 * 2000
    near = range_join.unit(base.astype(np.float32).astype(np.float64))
    near = near @ near.T >= 0.95
    expected = near.sum(axis=1) - 1
    assert expected.sum() > 100
    vectors = df.selectExpr("vec_id AS id", "1L AS n", "embedding AS v")
    assert len(range_join._pivots(vectors, 2000, math.acos(0.95))[64]) <= 2 * range_join.MOST_COPIES + 1
    monkeypatch.setattr(range_join, "PASS_BYTES", 1)
    passes, met = [], range_join.checkpointed
    monkeypatch.setattr(range_join, "checkpointed", lambda x: passes.append(x.columns == ["id", "links", "other"]) or met(x))
    found = dict(range_join.linked_vectors(df, 0.95).select("vec_id", "n_links").collect())
    assert [found[k] for k in range(2000)] == expected.tolist()
    assert sum(passes) > 2  # those of each pass, and all of them


def test_range_join_of_rows_repeated_under_one_id(spark):
    df = spark.createDataFrame([(7, [1.0, 0.0], 0, 0, 0), (7, [1.0, 0.0], 0, 0, 0), (9, [1.0, 0.1], 0, 0, 0), (None, [1.0, 0.0], 0, 0, 0)], SCHEMA)
    assert sorted(map(tuple, linked_vectors(df, 0.95).collect()), key=str) == sorted([(7, 2, 7, True), (7, 2, 7, True), (9, 2, 7, False), (None, 2, 7, None)], key=str)


def test_range_join_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert linked_vectors(empty, 0.95).count() == 0
    only = spark.createDataFrame([(1, None, 0, 0, 0), (2, [0.0], 0, 0, 0)], SCHEMA)
    assert sorted(map(tuple, linked_vectors(only, 0.95).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_top_k(spark):
    table = list(enumerate([*vectors(200, 5), [1e38, 1e38, 1e38], [-1e38, 1e38, 1e38]]))
    df = spark.createDataFrame([(k, v, 0, 1, 2) for k, v in table], SCHEMA).repartition(4)
    usable = [(k, [math.floor(256 * x) for x in v]) for k, v in table if v and all(x is not None and math.isfinite(x) for x in v)]
    expected = []
    for q, a in usable:
        if q % 10 == 0:
            scores = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b)))), k) for k, b in usable if k != q and len(a) == len(b))
            expected += [(q, r + 1, k, -s) for r, (s, k) in enumerate(scores[:5])]
    assert sorted(map(tuple, top_k(df, 5, 10).collect())) == sorted(expected)
    assert top_k(df.limit(0), 5, 10).count() == 0


def test_top_k_ties_go_to_smaller_ids(spark):
    df = spark.createDataFrame([(k, [1.0, 2.0], 0, 0, 0) for k in (30, 10, 20, 7, 8, 9, 50, None)], SCHEMA)
    assert [tuple(r) for r in top_k(df, 3, 50).orderBy("rank").collect()] == [(50, 1, 7, 5 * 65536), (50, 2, 8, 5 * 65536), (50, 3, 9, 5 * 65536)]


def test_components(spark):
    draw = random.Random(4)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, k) for k in range(2001, 2100)] + [(5, 5)]
    df = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    nodes = sorted({x for p in links for x in p if p[0] != p[1]})
    place = {k: i for i, k in enumerate(nodes)}
    roots = helpers.components(len(nodes), [(place[a], place[b]) for a, b in links if a != b])
    assert sorted(map(tuple, components(df).collect())) == [(k, nodes[r]) for k, r in zip(nodes, roots)]
    assert components(df.limit(0)).count() == 0
