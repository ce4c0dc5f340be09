"""Bayesian networks as relations: conditional probability tables, factor algebra and sampling, by joins and grouping.

A table has the columns ``parent`` (value of the parent, a struct of several, null at the root),
``value`` and ``p``; a factor has one column per variable and ``p``.  A null is a state like any
other.  Tables and factors belong to encoded or categorical columns, so their sizes are bounded by
the columns' states.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardspark.operators.encode import MOST_CATEGORIES, bounded


def _states(counts: DataFrame, names: list[str]) -> DataFrame:
    """All combinations of the values that each column has, nulls included; columns of more values than a dictionary raise an error."""
    sets = counts.agg(*(F.collect_set(F.struct(F.col(c).alias("v"))).alias(c) for c in names))
    for c in names:
        own = F.when(F.size(c) > MOST_CATEGORIES, F.raise_error(F.lit(f"{c} has too many states: it needs an encoding"))).otherwise(F.col(c))
        sets = sets.withColumn(c, F.explode(own)).withColumn(c, F.col(c)["v"])
    return sets


def _natural(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on the variables that two factors share, nulls being equal; ``b``'s p becomes ``__p``.

    Factors without a shared variable are multiplied out, the second of at most ``MOST_CATEGORIES`` lines.
    """
    shared = [c for c in a.columns if c in b.columns and c != "p"]
    b = b.select(*(F.col(c).alias(f"__{c}" if c in shared or c == "p" else c) for c in b.columns))
    if not shared:
        return a.join(F.broadcast(bounded(b)))
    return a.join(b, reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in shared)), how).drop(*(f"__{c}" for c in shared))


def state_counts(df: DataFrame, variable: str, parents: str | list[str] | None = None) -> DataFrame:
    """Counts of all (parent, value) states, those never seen with 0; with several parents, of all combinations of their values."""
    if not parents:
        return df.groupBy(F.lit(None).cast("string").alias("parent"), F.col(variable).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    several = [parents] if isinstance(parents, str) else list(parents)
    names = [f"__p{k}" for k in range(len(several))]
    seen = df.groupBy(*(F.col(c).alias(n) for c, n in zip(several, names)), F.col(variable).alias("value")).agg(F.count(F.lit(1)).alias("p"))
    counts = _natural(_states(seen, [*names, "value"]), seen, "left")
    parent = F.col(names[0]) if isinstance(parents, str) else F.struct(*(F.col(n).alias(c) for n, c in zip(names, several)))
    return counts.select(parent.alias("parent"), "value", F.coalesce("__p", F.lit(0)).alias("n"))


def conditional_table(df: DataFrame, variable: str, parent: str | list[str] | None = None, pseudo: float | str = 0.0) -> DataFrame:
    """P(variable | parent), or given several parents.

    ``pseudo`` is the count added to each state: 0 for maximum likelihood (a parent's state never
    seen gives a uniform row), 1 for K2, "bdeu:<size>" for a sample of that size spread over all states.
    """
    counts = state_counts(df, variable, parent)
    states = Window.partitionBy("parent")
    if isinstance(pseudo, str):
        size = float(pseudo.partition(":")[2])
        number = counts.agg(F.count(F.lit(1)).alias("__states"))  # one row
        counts = counts.join(F.broadcast(number))
        added = F.lit(size) / F.col("__states")
    else:
        added = F.lit(float(pseudo))
    total = F.sum(F.col("n") + added).over(states)
    p = F.when(total == 0, 1.0 / F.count(F.lit(1)).over(states)).otherwise((F.col("n") + added) / total)
    return counts.select("parent", "value", "n", p.alias("p"))


def message(table: DataFrame, weight: Column, *below: DataFrame) -> DataFrame:
    """What a node tells its parent: sum of p * weight * messages from below, for each state of the parent.

    ``weight`` is 0 for excluded values, 1 for values without condition, and may hold a fan-out.
    Messages from below have ``parent`` (this node's value) and ``m``.
    """
    rows = table.withColumn("m", F.col("p") * weight)
    for k, other in enumerate(below):
        sent = other.select(F.col("parent").alias("__value"), F.col("m").alias(f"__m{k}"))
        rows = rows.join(sent, F.col("value").eqNullSafe(F.col("__value"))).withColumn("m", F.col("m") * F.col(f"__m{k}")).drop(f"__m{k}", "__value")
    return rows.groupBy("parent").agg(F.sum("m").alias("m"))


def inside(condition: Column | None) -> Column:
    """Weight of a node's values: 1 where the condition holds."""
    return F.lit(1.0) if condition is None else F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def product(*factors: DataFrame) -> DataFrame:
    """Product of factors: natural join on shared variables."""
    return reduce(lambda a, b: _natural(a, b).withColumn("p", F.col("p") * F.col("__p")).drop("__p"), factors)


def add(*factors: DataFrame) -> DataFrame:
    """Sum of factors over their shared variables; a state that one of them lacks counts 0 there only if all variables are shared."""

    def plus(a: DataFrame, b: DataFrame) -> DataFrame:
        if set(a.columns) == set(b.columns):
            return a.unionByName(b).groupBy(*(c for c in a.columns if c != "p")).agg(F.sum("p").alias("p"))
        return _natural(a, b).withColumn("p", F.col("p") + F.col("__p")).drop("__p")

    return reduce(plus, factors)


def divide(a: DataFrame, b: DataFrame) -> DataFrame:
    """Quotient of factors; 0 / 0 is 0."""
    return _natural(a, b).withColumn("p", F.when(F.col("__p") == 0, F.lit(0.0)).otherwise(F.col("p") / F.col("__p"))).drop("__p")


def identity(factor: DataFrame) -> DataFrame:
    """The factor that changes none: 1 for each of the states."""
    return factor.withColumn("p", F.lit(1.0))


def assignment(factor: DataFrame, variables: list[str]) -> DataFrame:
    """Adds ``position``: each state's number in the order of the variables, the last one fastest; states of a variable are in order."""
    out, step = factor.withColumn("position", F.lit(0).cast("long")), F.lit(1)
    for c in reversed(variables):
        lines = bounded(factor.select(F.col(c).alias("__v")).distinct())
        lines = lines.select("__v", (F.row_number().over(Window.orderBy("__v")) - 1).alias("__k"), F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))).alias(f"__n_{c}"))
        out = out.join(F.broadcast(lines), F.col(c).eqNullSafe(F.col("__v"))).withColumn("position", F.col("position") + F.col("__k") * step).drop("__v", "__k")
        step = step * F.col(f"__n_{c}")
    return out.drop(*(f"__n_{c}" for c in variables))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the largest difference of two factors over the same variables; a missing state is 0."""
    signed = a.unionByName(b.withColumn("p", -F.col("p"))).groupBy(*(c for c in a.columns if c != "p")).agg(F.sum("p").alias("p"))
    return signed.agg(F.coalesce(F.max(F.abs("p")), F.lit(0.0)).alias("difference"))


def normalised(factor: DataFrame, *given: str) -> DataFrame:
    """A factor that sums to 1, or does for each state of ``given``; sums of 0 stay."""
    total = F.sum("p").over(Window.partitionBy(*given) if given else Window.partitionBy(F.lit(1)))
    return factor.withColumn("p", F.when(total == 0, F.col("p")).otherwise(F.col("p") / total))


def conditional(joint: DataFrame, variables: list[str], given: list[str]) -> DataFrame:
    """P(variables | given) of a joint distribution."""
    return normalised(marginal(joint, *variables, *given), *given)


def dependence(joint: DataFrame, a: str, b: str, given: list[str] = ()) -> DataFrame:
    """One row: the largest difference between P(a, b | given) and P(a | given) P(b | given); 0 if they are independent."""
    given = list(given)
    both = conditional(joint, [a, b], given)
    alone = product(conditional(joint, [a], given), conditional(joint, [b], given))
    return differences(both, alone.select(both.columns))


def factor_sets(sets: list[list[DataFrame]]) -> list[DataFrame]:
    """Product of sets of factors: their union."""
    return [f for own in sets for f in own]


def set_marginal(factors: list[DataFrame], *out: str) -> list[DataFrame]:
    """A set of factors without some variables: those that mention one are multiplied and summed, one variable after another."""
    for variable in out:
        touched = [f for f in factors if variable in f.columns]
        if touched:
            joint = product(*touched)
            rest = [c for c in joint.columns if c not in (variable, "p")]
            factors = [f for f in factors if variable not in f.columns] + [marginal(joint, *rest)]
    return factors


def elimination_order(factors: list[DataFrame], out: list[str]) -> list[str]:
    """Variables to be eliminated, each time the one whose factors have the fewest others."""
    scopes, order = [{c for c in f.columns if c != "p"} for f in factors], []
    left = list(out)
    while left:
        joined = {v: set().union(*(s for s in scopes if v in s)) - {v} for v in left}
        best = min(left, key=lambda v: (len(joined[v]), v))
        scopes = [s for s in scopes if best not in s] + [joined[best]]
        order.append(best)
        left.remove(best)
    return order


def eliminate(factors: list[DataFrame], keep: list[str], evidence: dict[str, Column] | None = None) -> DataFrame:
    """P(keep, evidence) of any network: evidence may be a set of states of a variable; the others are summed out one by one."""
    for variable, condition in (evidence or {}).items():
        factors = [f.where(condition) if variable in f.columns else f for f in factors]
    names = {c for f in factors for c in f.columns if c != "p"}
    rest = set_marginal(factors, *elimination_order(factors, sorted(names - set(keep))))
    return marginal(product(*rest), *keep)


def as_factor(table: DataFrame, variable: str, *parents: str) -> DataFrame:
    """A conditional table as a factor over the variable and its parents."""
    own = [F.col("parent").alias(parents[0])] if len(parents) == 1 else [F.col("parent")[c].alias(c) for c in parents]
    return table.select(F.col("value").alias(variable), *own, "p")


def marginal(factor: DataFrame, *keep: str) -> DataFrame:
    return factor.groupBy(*keep).agg(F.sum("p").alias("p"))


def max_marginal(factor: DataFrame, *keep: str) -> DataFrame:
    return factor.groupBy(*keep).agg(F.max("p").alias("p"))


def reduced(factor: DataFrame, condition: Column) -> DataFrame:
    """A factor with some states only, normalised."""
    kept = factor.where(condition)
    return kept.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy(F.lit(1))))


def most_likely(table: DataFrame) -> DataFrame:
    """The likeliest value for each state of the parent; ties to the smaller value."""
    best = Window.partitionBy("parent").orderBy(F.desc("p"), "value")
    return table.withColumn("__k", F.row_number().over(best)).where("__k = 1").select("parent", "value", "p")


def ancestral_sample(spark: SparkSession, n: int, tables: list[tuple[str, str | None, DataFrame]], seed: int = 0, evidence: dict[str, object] | None = None) -> DataFrame:
    """``n`` rows drawn from a network, parents first; each row's draws follow from its number and the seed.

    Tables are cumulated along their values and broadcast, being bounded by a column's states, so rows stay
    where they are.  Variables in ``evidence`` are not drawn but set, and ``weight`` is the probability of
    what was set given the values drawn; without evidence it is 1.
    """
    evidence = evidence or {}
    rows = spark.range(n).withColumn("weight", F.lit(1.0))
    for k, (variable, parent, table) in enumerate(tables):
        order = Window.partitionBy("parent").orderBy("value")
        upto = table.withColumn("__hi", F.sum("p").over(order))
        drawn = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 40)) / float(1 << 40)
        lines = upto.groupBy(F.col("parent").alias("__parent")).agg(F.sort_array(F.collect_list(F.struct("__hi", "value", "p"))).alias("__lines"))
        lines = F.broadcast(bounded(lines))
        rows = rows.join(lines, F.col(parent).eqNullSafe(F.col("__parent"))) if parent else rows.join(lines)
        if variable in evidence:
            held = F.lit(evidence[variable])
            own = F.aggregate(F.filter("__lines", lambda x: x["value"].eqNullSafe(held)), F.lit(0.0), lambda a, x: a + x["p"])
            rows = rows.withColumn("weight", F.col("weight") * own).withColumn(variable, held.cast(table.schema["value"].dataType))
        else:
            hit = F.filter("__lines", lambda x: x["__hi"] > F.col("__u"))
            rows = rows.withColumn("__u", drawn).withColumn(variable, F.coalesce(F.get(hit, F.lit(0))["value"], F.element_at("__lines", -1)["value"])).drop("__u")
        rows = rows.drop("__lines", "__parent")
    return rows


def rejection_sample(spark: SparkSession, n: int, tables: list[tuple[str, str | None, DataFrame]], condition: Column, seed: int = 0, most_rounds: int = 20) -> DataFrame:
    """``n`` rows drawn under a condition: rows that don't meet it are thrown away, and more are drawn until there are enough.

    Each round draws as many as the share accepted so far calls for.  Fewer rows come back if the condition
    is so rare that ``most_rounds`` rounds don't reach ``n``.
    """
    kept, have, drawn, share = None, 0, 0, 1.0
    for turn in range(most_rounds):
        size = int((n - have) / max(share, 0.01) * 1.1) + 16
        part = ancestral_sample(spark, size, tables, seed + 7919 * turn).where(condition).withColumn("id", F.col("id") + drawn)
        kept = part if kept is None else kept.unionByName(part)
        drawn, have = drawn + size, have + part.count()
        share = have / drawn
        if have >= n:
            break
    return kept.orderBy("id").limit(n)


def sampled_probability(sample: DataFrame, condition: Column) -> DataFrame:
    """One row ``p``: the share (of the weights) of a sample's rows that meet a condition."""
    return sample.agg((F.sum(F.when(condition, F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("p"))
