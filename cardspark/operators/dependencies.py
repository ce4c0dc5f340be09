"""Functional dependencies: dictionaries of (dependent, determinant), and conditions rewritten along them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dependency:
    """``pairs`` has the columns ``dependent`` and ``determinant``; a determinant has one dependent value."""

    dependent: str
    determinant: str
    pairs: DataFrame


def dictionary(df: DataFrame, dependent: str, determinant: str) -> Dependency:
    """The distinct pairs of two columns; pairs without a determinant are left out."""
    pairs = df.select(F.col(dependent).alias("dependent"), F.col(determinant).alias("determinant")).where("determinant IS NOT NULL").distinct()
    return Dependency(dependent, determinant, pairs)


def violations(one: Dependency) -> DataFrame:
    """Determinants with several dependent values: the dependency does not hold there."""
    return one.pairs.groupBy("determinant").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def without_dependents(df: DataFrame, dependencies: list[Dependency]) -> DataFrame:
    """``df`` without the columns that others determine."""
    return df.drop(*(d.dependent for d in dependencies))


def determinants(attribute: str, values: Column, dependencies: list[Dependency]) -> tuple[str, DataFrame]:
    """The attribute that a condition comes down to, and its values (column ``value``).

    ``values`` is a condition on ``dependent``.  As long as the attribute depends on another, its values
    become those of the determinant; each step is a semi-join with a dictionary.
    """
    by = {d.dependent: d for d in dependencies}
    one = by.get(attribute)
    if one is None:
        raise ValueError(f"nothing determines {attribute}")
    found, seen = one.pairs.where(values).select(F.col("determinant").alias("value")).distinct(), {attribute}
    attribute = one.determinant
    while attribute in by and attribute not in seen:
        seen.add(attribute)
        one = by[attribute]
        found = one.pairs.join(found, F.col("dependent") == F.col("value"), "left_semi").select(F.col("determinant").alias("value")).distinct()
        attribute = one.determinant
    return attribute, found


def as_ranges(values: DataFrame) -> DataFrame:
    """(low, high) of the stretches of neighbouring integers in ``value``; the values are those of a dictionary."""
    order = Window.orderBy("value")
    return values.distinct().withColumn("__g", F.col("value") - F.row_number().over(order)).groupBy("__g").agg(F.min("value").alias("low"), F.max("value").alias("high")).drop("__g")


def expanded(dictionary_lines: DataFrame, condition: Column) -> DataFrame:
    """The values of a dictionary that a comparison stands for, to be used as a list."""
    return dictionary_lines.where(condition).select("value")


def inverse(dictionaries: list[DataFrame]) -> DataFrame:
    """(attribute, code, value) of several dictionaries of (attribute, value, code) together; equal lines once."""
    out = None
    for d in dictionaries:
        own = d.select("attribute", "code", F.col("value").cast("string").alias("value"))
        out = own if out is None else out.unionByName(own)
    return out.distinct()
