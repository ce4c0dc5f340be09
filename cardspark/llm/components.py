"""Connected components of links, by alternating star contractions.

Each round hangs larger neighbours on a node's smallest neighbour and then smaller ones on their
smallest; the number of rounds grows with the logarithm of the longest chain.  Rows of a node with
very many links are dealt out over ``SALTS`` tasks where they meet the node's minimum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardspark.llm.common import checkpointed

SALTS = 8


def _with_least(links: DataFrame) -> DataFrame:
    """Links (u, v) with the least neighbour ``m`` of each u."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return links.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(least, ["u", "s"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes in ``links`` (columns a, b); the component is its smallest node.

    Links may be repeated, turned round or lead from a node to itself; nulls link nothing.  Nodes
    that only link to themselves are left out, so no links give an empty result.
    """
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    pairs = checkpointed(pairs)
    state = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        met = _with_least(large)
        small = met.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        pairs = checkpointed(small)
        now = pairs.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).first()
        if now == state:
            break
        state = now
    nodes = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
