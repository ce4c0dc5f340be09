"""Encodings of columns: kinds, dictionaries, most common values, tail bins, quantile bins, and of whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns with more distinct values get no dictionary.
MOST_CATEGORIES = 10_000
#: Stretches of values that running sums are worked out in, each by itself.
STRETCHES = 256
#: Dictionaries up to this length are written into the plan instead of being joined.
SHORT = 256
NUMERIC = ("byte", "short", "integer", "long", "float", "double", "decimal")


def numeric_columns(df: DataFrame) -> set[str]:
    return {f.name for f in df.schema if f.dataType.typeName() in NUMERIC}


def n_rows(weight: str | None) -> Column:
    """Number of rows; where rows are grouped, ``weight`` has how many each stands for."""
    return F.count(F.lit(1)) if weight is None else F.coalesce(F.sum(weight), F.lit(0))


def attribute_kinds(df: DataFrame, columns: list[str], error: float | None = None, weight: str | None = None) -> DataFrame:
    """Kind of each column: boolean (two values), continuous (numeric, many values), else categorical.

    Exact distinct counts send each row once per column; with ``error`` they are estimated from
    mergeable summaries with that relative deviation, in one pass without such rows.
    """
    numeric = numeric_columns(df)
    one = df.agg(n_rows(weight).alias("n"), *((F.count_distinct(c) if error is None else F.approx_count_distinct(c, error)).alias(c) for c in columns))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("attribute"), F.col(c).alias("n_distinct"), F.lit(c in numeric).alias("numeric")) for c in columns))).alias("x")
    kind = F.when(F.col("n_distinct") == 2, "boolean").when(F.col("numeric") & ((F.col("n_distinct") * 20 >= F.col("n")) | (F.col("n_distinct") > MOST_CATEGORIES)), "continuous").otherwise("categorical")
    return one.select("n", each).select("x.attribute", "x.n_distinct", "x.numeric", "n").select("attribute", "n_distinct", kind.alias("kind"))


def domains(df: DataFrame, columns: list[str]) -> DataFrame:
    """Least and largest value (as text), number of values and of nulls of each column, in one pass; NaN counts as null."""

    def some(c: str) -> Column:
        return F.nanvl(F.col(c), F.lit(None)) if df.schema[c].dataType.typeName() in ("float", "double") else F.col(c)

    one = df.agg(*(x for c in columns for x in (F.min(some(c)).cast("string").alias(f"{c}__lo"), F.max(some(c)).cast("string").alias(f"{c}__hi"), F.count(some(c)).alias(f"{c}__n"), F.count(F.lit(1)).alias(f"{c}__all"))))
    each = F.array(*(F.struct(F.lit(c).alias("attribute"), F.col(f"{c}__lo").alias("least"), F.col(f"{c}__hi").alias("largest"), F.col(f"{c}__n").alias("n"), (F.col(f"{c}__all") - F.col(f"{c}__n")).alias("n_null")) for c in columns))
    return one.select(F.explode(each).alias("x")).select("x.*")


def pruned_attributes(df: DataFrame, key: str | None = None, foreign: tuple[str, ...] = (), irrelevant: tuple[str, ...] = (), most: int = MOST_CATEGORIES, error: float | None = None) -> DataFrame:
    """(attribute, reason) of the columns that models leave out.

    Reasons, the first that holds: irrelevant, key, foreign key, only nulls, more than ``most`` categories.
    With ``error`` distinct values are estimated, as in :func:`attribute_kinds`.
    """
    numeric, columns = numeric_columns(df), df.columns
    count = F.count_distinct if error is None else lambda c: F.approx_count_distinct(c, error)
    one = df.agg(*(x for c in columns for x in (F.count(c).alias(f"{c}__n"), (F.lit(0) if c in numeric else count(F.col(c))).alias(f"{c}__d"))))

    def reason(c: str) -> Column:
        known = next((r for r, own in (("irrelevant", irrelevant), ("key", (key,)), ("foreign key", foreign)) if c in own), None)
        return F.lit(known) if known else F.when(F.col(f"{c}__n") == 0, "only nulls").when(F.col(f"{c}__d") > most, "too many categories")

    each = F.explode(F.array(*(F.struct(F.lit(c).alias("attribute"), reason(c).alias("reason")) for c in columns))).alias("x")
    return one.select(each).select("x.*").where("reason IS NOT NULL")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def bounded(values: DataFrame, most: int = MOST_CATEGORIES) -> DataFrame:
    """``values`` if they are at most ``most``; what is ordered, collected or broadcast as a whole goes through here."""
    if values.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} values: the column needs bins, or has to be left out")
    return values


def cumulated(counts: DataFrame, total: bool = False) -> DataFrame:
    """Adds ``upto`` to (value, n): the sum of ``n`` over values up to this one; with ``total`` also that of all.

    Numbers and times are summed in stretches between approximate quantiles, each by itself, so no task
    sees all values; values of other kinds are dictionaries and bounded.
    """
    kind = counts.schema["value"].dataType.typeName()
    if kind in NUMERIC or kind in ("timestamp", "date", "timestamp_ntz"):
        cuts = counts.agg(F.percentile_approx("value", F.array(*(F.lit(k / STRETCHES) for k in range(1, STRETCHES))), 10_000).alias("__cuts"))  # one row
        rows = counts.join(F.broadcast(cuts)).withColumn("__s", F.size(F.filter("__cuts", lambda c: c < F.col("value")))).drop("__cuts")
    else:
        rows = bounded(counts).withColumn("__s", F.lit(0))
    stretches = rows.groupBy("__s").agg(F.sum("n").alias("__in"))
    before = Window.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)  # a row for each stretch
    stretches = stretches.select("__s", F.coalesce(F.sum("__in").over(before), F.lit(0)).alias("__before"), F.sum("__in").over(Window.partitionBy(F.lit(1))).alias("total"))
    rows = rows.join(F.broadcast(stretches), "__s")
    rows = rows.withColumn("upto", F.col("__before") + F.sum("n").over(Window.partitionBy("__s").orderBy("value"))).drop("__s", "__before")
    return rows if total else rows.drop("total")


def quantiles(counts: DataFrame, points: list[float]) -> DataFrame:
    """One row ``p``: exact quantiles of (value, n) with linear interpolation, null where there is no value."""
    rows = cumulated(counts, total=True)

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("upto") > rank, F.col("value").cast("double")))

    place = [(F.col("total") - 1) * float(q) for q in points]
    ends = rows.agg(*(x for k, r in enumerate(place) for x in (at(F.floor(r)).alias(f"a{k}"), at(F.ceil(r)).alias(f"b{k}"))), F.max("total").alias("total"))
    between = [F.col(f"a{k}") + (F.col(f"b{k}") - F.col(f"a{k}")) * (r - F.floor(r)) for k, r in enumerate(place)]
    return ends.select(F.array(*between).alias("p"))


def dictionary(df: DataFrame, column: str, nulls: bool = False) -> DataFrame:
    """Codes 1, 2, ... of the distinct values in their order; with ``nulls`` a null has a line with code 0.

    A column with more than ``MOST_CATEGORIES`` values raises an error.
    """
    values = bounded(df.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct())
    lines = values.select("value", F.dense_rank().over(Window.orderBy("value")).alias("code"))
    if nulls:
        lines = lines.unionByName(df.where(F.col(column).isNull()).limit(1).select(F.col(column).alias("value"), F.lit(0).alias("code")))
    return lines


def most_common(df: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` most common values with codes from 0, ties by value."""
    top = value_counts(df, column).orderBy(F.desc("n"), "value").limit(n)
    return top.select("value", "n", (F.row_number().over(Window.orderBy(F.desc("n"), "value")) - 1).alias("code"))


def cut_values(lines: DataFrame, bins: int) -> DataFrame:
    """One row ``cuts``: the last value of each bin but the last, over (value, n) in order of value.

    A bin ends once it holds 1/q of the rows, q being the smaller of ``bins`` and the number of values.
    The count starts anew with each bin, so it is a fold over the sorted values, which are bounded.
    """
    packed = lines.agg(F.sort_array(F.collect_list(F.struct("value", "n"))).alias("a"), F.sum("n").alias("total"))
    kind = lines.schema["value"].dataType.simpleString()

    def put(state: Column, x: Column) -> Column:
        held = state["held"] + x["n"]
        full = held * F.least(F.size("a"), F.lit(bins)) >= F.col("total")
        return F.struct(F.when(full, F.lit(0).cast("long")).otherwise(held).alias("held"), F.when(full, F.concat(state["cuts"], F.array(x["value"]))).otherwise(state["cuts"]).alias("cuts"))

    start = F.struct(F.lit(0).cast("long").alias("held"), F.array().cast(f"array<{kind}>").alias("cuts"))
    return packed.select(F.aggregate("a", start, put)["cuts"].alias("cuts"))


def tail_bins(df: DataFrame, column: str, n_common: int, bins: int) -> DataFrame:
    """Bins of the values beyond the most common: in order of value, a bin ends once it holds 1/q of the rest.

    Returns value, n, code and the value's share of its bin.  A column with more than
    ``MOST_CATEGORIES`` further values raises an error: it needs quantile bins.
    """
    common = most_common(df, column, n_common).select("value")
    rest = bounded(value_counts(df, column).join(F.broadcast(common), "value", "left_anti"))
    lines = rest.join(F.broadcast(cut_values(rest, bins)))  # one row
    lines = lines.select("value", "n", (F.size(F.filter("cuts", lambda c: c < F.col("value"))) + n_common).alias("code"))
    return lines.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("code")))


def quantile_bins(df: DataFrame, column: str, bins: int, accuracy: int | None = None) -> DataFrame:
    """Bins (lo, hi] with about as many rows each; equal breakpoints are drawn together.

    Breakpoints are exact (see :func:`quantiles`); with ``accuracy`` they come from a mergeable
    summary of that size instead, in one pass without a shuffle of values.
    """
    points = [k / bins for k in range(bins + 1)]
    if accuracy is None:
        cuts = quantiles(value_counts(df, column), points).where("p[0] IS NOT NULL").select(F.array_distinct("p").alias("p"))
    else:
        cuts = df.agg(F.percentile_approx(column, F.array(*map(F.lit, points)), accuracy).alias("p")).select(F.array_distinct("p").alias("p"))
    return cuts.select(F.posexplode(F.slice("p", 1, F.size("p") - 1)).alias("code", "lo"), "p").select("code", "lo", F.element_at("p", F.col("code") + 2).alias("hi"))


def width_codes(df: DataFrame, column: str, size: float) -> DataFrame:
    """Adds ``code``: the value's bin of equal width, from 0 at the least value; null stays null."""
    least = df.agg(F.min(column).alias("__least"))  # one row
    return df.join(F.broadcast(least)).withColumn("code", F.floor((F.col(column) - F.col("__least")) / size).cast("int")).drop("__least")


def frequency_codes(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(value, n, code): the values' bins of about equal numbers of rows; a value goes where the rows before it end."""
    rows = cumulated(value_counts(df, column), total=True)
    return rows.select("value", "n", F.least(F.floor((F.col("upto") - F.col("n")) * bins / F.col("total")), F.lit(bins - 1)).cast("int").alias("code"))


def fan_out_per_code(df: DataFrame, codes: DataFrame, column: str, fan_out: str) -> DataFrame:
    """Mean fan-out, and mean of 1 / max(fan-out, 1), of each code; ``codes`` may be a dictionary or tail bins."""
    lines = F.broadcast(bounded(codes.select(F.col("value").alias("__value"), "code")))
    coded = df.join(lines, F.col(column).eqNullSafe(F.col("__value")))
    return coded.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.avg(fan_out).alias("mean_fan_out"), F.avg(1 / F.greatest(F.col(fan_out), F.lit(1))).alias("mean_inverse"))


def fan_out_kind(column: str) -> str | None:
    """How a column's values enter expectations: "inverse" for fan-outs with 0 as 1, "direct" for fan-outs, else null."""
    if not column.startswith("mul_"):
        return None
    return "inverse" if column.endswith("_nn") else "direct"


@dataclass(frozen=True)
class Encoding:
    """Codes of a column: 0 for null, then 1 to ``size`` - 1.

    ``lines`` (bounded: a line for each value of a dictionary, or for each bin) are (code, text,
    number, lo, hi, n, share, distinct): a categorical line has a value and its share of its code, a
    continuous one the ends of its bin (lo, hi] and how many values it has.
    """

    column: str
    kind: str
    numeric: bool
    lines: tuple[tuple, ...]
    fan_out: tuple[float, ...] | None = None

    @property
    def size(self) -> int:
        return 1 + max((line[0] for line in self.lines), default=0)

    def codes(self, df: DataFrame, out: str) -> DataFrame:
        """``df`` with the column's codes as ``out``; NaN and values that the encoding doesn't know are null's."""
        if self.kind == "continuous":
            x = F.col(self.column).cast("double")
            bins = [line for line in self.lines if line[0]]
            code = F.lit(1) + sum(((x > line[3]).cast("int") for line in bins[1:]), F.lit(0))
            inside = ~F.isnan(x) & (x >= bins[0][3]) & (x <= bins[-1][4]) if bins else F.lit(False)
            return df.withColumn(out, F.when(inside, code).otherwise(0))
        kind = "double" if self.numeric else "string"
        known = [(line[2] if self.numeric else line[1], line[0]) for line in self.lines if line[0]]
        x = F.col(self.column).cast(kind)
        if len(known) <= SHORT:
            at = F.array_position(F.array(*(F.lit(v) for v, _ in known)).cast(f"array<{kind}>"), x)
            return df.withColumn(out, F.when(at > 0, F.element_at(F.array(*(F.lit(c) for _, c in known)).cast("array<int>"), at.cast("int"))).otherwise(0))
        lines = df.sparkSession.createDataFrame(known, f"__value {kind}, __code int")
        joined = df.join(F.broadcast(lines), x == F.col("__value"), "left")  # at most MOST_CATEGORIES
        return joined.withColumn(out, F.coalesce("__code", F.lit(0))).drop("__value", "__code")

    def plain(self) -> Column:
        """The column as :meth:`coder` takes it: numbers as doubles, other values as text."""
        return F.col(self.column).cast("double" if self.numeric or self.kind == "continuous" else "string")

    def coder(self) -> Callable[[pa.Array], np.ndarray]:
        """The same codes as :meth:`codes` for an Arrow array of the column's values, by search in sorted values."""
        lines = [line for line in self.lines if line[0]]
        if self.kind != "continuous" and not self.numeric:
            known, codes = pa.array([line[1] for line in lines], pa.string()), np.array([*(line[0] for line in lines), 0])
            return lambda x: codes[pc.fill_null(pc.index_in(x.cast(pa.string()), value_set=known), len(lines)).to_numpy(zero_copy_only=False)]
        if self.kind == "continuous":
            starts, ends = np.array([line[3] for line in lines[1:]]), (lines[0][3], lines[-1][4]) if lines else (np.inf, -np.inf)

            def code(x: np.ndarray) -> np.ndarray:
                return np.where((x >= ends[0]) & (x <= ends[1]), 1 + np.searchsorted(starts, x, "left"), 0)
        else:
            own = sorted((line[2], line[0]) for line in lines)
            values, codes = np.array([*(v for v, _ in own), np.inf]), np.array([*(c for _, c in own), 0])

            def code(x: np.ndarray) -> np.ndarray:
                at = np.minimum(np.searchsorted(values, x, "left"), len(own))
                return np.where(values[at] == x, codes[at], 0)

        return lambda x: code(pc.fill_null(x, float("nan")).to_numpy(zero_copy_only=False))


def value_codes(counts: list[tuple[object, int]], n_mcv: int, n_bins: int) -> list[tuple[object, int, int, float]]:
    """(value, code, n, share of its code) of a dictionary's (value, n): most common values first, then bins as in :func:`tail_bins`."""
    ordered = sorted(counts, key=lambda x: (-x[1], x[0]))
    out = [(v, k + 1, n, 1.0) for k, (v, n) in enumerate(ordered[:n_mcv])]
    rest = sorted(ordered[n_mcv:])
    total, q, code, held, size = sum(n for _, n in rest), min(n_bins, len(rest)), len(out) + 1, [], 0
    for k, (v, n) in enumerate(rest):
        size = n + (size if held else 0)
        held.append((v, n))
        if size * q >= total or k + 1 == len(rest):
            out += [(w, code, m, m / size) for w, m in held]
            code, held = code + 1, []
    return out


def encode_table(df: DataFrame, columns: list[str], n_mcv: int = 30, n_bins: int = 30, error: float | None = 0.02, accuracy: int = 10_000, weight: str | None = None) -> list[Encoding]:
    """Encodings of all columns, with the codes' mean fan-outs where a column is one.

    Kinds follow :func:`attribute_kinds`: continuous columns get 2 * ``n_bins`` bins between approximate
    quantiles, others the codes of :func:`value_codes`.  Each step is one job for all columns; what is
    collected are dictionaries of at most ``MOST_CATEGORIES`` values and bins.  A text column with too
    many categories raises an error and must be left out before (see :func:`pruned_attributes`).  Rows may be
    grouped, with the number of rows that each stands for in ``weight``.
    """
    numeric = numeric_columns(df)
    kinds = {r["attribute"]: r for r in attribute_kinds(df, columns, error, weight).collect()}
    continuous = [c for c in columns if kinds[c]["kind"] == "continuous"]
    others = [c for c in columns if c not in continuous]
    crowded = [c for c in others if kinds[c]["n_distinct"] > MOST_CATEGORIES * (1 + 3 * (error or 0))]
    if crowded:
        raise ValueError(f"too many categories: {crowded}")

    def some(c: str) -> Column:
        return F.nanvl(F.col(c).cast("double"), F.lit(None)) if df.schema[c].dataType.typeName() in ("float", "double") else F.col(c)

    lines: dict[str, list[tuple]] = {}
    if others:
        each = F.array(*(F.struct(F.lit(k).alias("k"), (F.lit(None) if c in numeric else F.col(c)).cast("string").alias("text"), (some(c) if c in numeric else F.lit(None)).cast("double").alias("number")) for k, c in enumerate(others)))
        found: list[dict] = [{} for _ in others]
        for r in df.select(F.explode(each).alias("x"), *([weight] if weight else [])).groupBy("x.k", "x.text", "x.number").agg(n_rows(weight).alias("n")).collect():
            found[r["k"]][r["number"] if others[r["k"]] in numeric else r["text"]] = r["n"]
        for c, own in zip(others, found):
            whole = df.schema[c].dataType.typeName() in ("byte", "short", "integer", "long")
            null = (0, None, None, None, None, own.pop(None, 0), 1.0, 1)
            text = (lambda v: str(int(v)) if whole else str(v)) if c in numeric else str  # noqa: B023  used at once
            lines[c] = [null, *((code, text(v), v if c in numeric else None, None, None, n, share, 1) for v, code, n, share in value_codes(list(own.items()), n_mcv, n_bins))]
    if continuous:
        points = F.array(*(F.lit(k / (2 * n_bins)) for k in range(2 * n_bins + 1)))
        single = df if weight is None else df.select(*continuous, F.explode(F.sequence(F.lit(1).cast("long"), weight)))  # summaries take single rows
        one = single.agg(*(x for k, c in enumerate(continuous) for x in (F.percentile_approx(some(c), points, accuracy).alias(f"q{k}"), F.min(some(c)).alias(f"lo{k}"), F.max(some(c)).alias(f"hi{k}")))).first()
        for k, c in enumerate(continuous):
            cuts = sorted({float(x) for x in (one[f"q{k}"] or [])[1:-1] if one[f"lo{k}"] < x < one[f"hi{k}"]})
            ends = [float(one[f"lo{k}"]), *cuts, float(one[f"hi{k}"])] if one[f"q{k}"] else []
            lines[c] = [(0, None, None, None, None, 0, 1.0, 1), *((i + 1, None, None, lo, hi, 0, 1.0, 1) for i, (lo, hi) in enumerate(zip(ends, ends[1:])))]
    out = [Encoding(c, "continuous" if c in continuous else "categorical", c in numeric, tuple(lines[c])) for c in columns]
    means = [c for c in columns if fan_out_kind(c)]
    if continuous or means:
        out = _measured(df, out, continuous, means, weight)
    return out


def _measured(df: DataFrame, encodings: list[Encoding], continuous: list[str], means: list[str], weight: str | None = None) -> list[Encoding]:
    """Rows and distinct values of each bin, and mean fan-outs of each code, from one pass."""
    rows, wanted = df, [e for e in encodings if e.column in continuous or e.column in means]
    for k, e in enumerate(wanted):
        rows = e.codes(rows, f"__code{k}")

    def feature(c: str) -> Column:
        x = F.col(c).cast("double")
        return 1 / F.greatest(x, F.lit(1.0)) if fan_out_kind(c) == "inverse" else x

    each = F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"__code{k}").alias("code"), F.col(e.column).cast("double").alias("v"), feature(e.column).alias("f")) for k, e in enumerate(wanted)))
    per = {}
    mean = F.avg("x.f") if weight is None else F.sum(F.col("x.f") * F.col(weight)) / F.sum(F.when(F.col("x.f").isNotNull(), F.col(weight)))
    for r in rows.select(F.explode(each).alias("x"), *([weight] if weight else [])).groupBy("x.k", "x.code").agg(n_rows(weight).alias("n"), F.approx_count_distinct("x.v", 0.02).alias("d"), mean.alias("f")).collect():  # a row for each code
        per[wanted[r["k"]].column, r["code"]] = r
    out = []
    for e in encodings:
        lines, fan_out = e.lines, None
        if e.column in continuous:
            lines = tuple((*line[:5], per[e.column, line[0]]["n"], line[6], max(1, per[e.column, line[0]]["d"])) if (e.column, line[0]) in per else line for line in lines)
        if e.column in means:
            fan_out = tuple(float(per[e.column, k]["f"] or 0.0) if (e.column, k) in per else 0.0 for k in range(e.size))
        out.append(Encoding(e.column, e.kind, e.numeric, lines, fan_out))
    return out


def encoded(df: DataFrame, encodings: list[Encoding], keep: list[str] = ()) -> DataFrame:
    """The codes of all encoded columns under the columns' names, beside the columns ``keep``."""
    rows = df.select(*{*keep, *(e.column for e in encodings)})
    for k, e in enumerate(encodings):
        rows = e.codes(rows, f"__code{k}")
    return rows.select(*keep, *(F.col(f"__code{k}").alias(e.column) for k, e in enumerate(encodings)))


def encoding_lines(spark, encodings: list[Encoding]) -> DataFrame:
    """All lines as a relation with attribute, kind, numeric and size."""
    rows = [(e.column, e.kind, e.numeric, e.size, *line) for e in encodings for line in e.lines]
    return spark.createDataFrame(rows, "attribute string, kind string, numeric boolean, size int, code int, text string, number double, lo double, hi double, n long, share double, d long")


def looked_up(lines: DataFrame, values: DataFrame) -> DataFrame:
    """Code and share of (attribute, text) values; a value without a line has neither."""
    known = lines.where("text IS NOT NULL").select("attribute", "text", "code", "share")
    return values.join(known, ["attribute", "text"], "left")
