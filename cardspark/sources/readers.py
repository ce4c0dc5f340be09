"""Tables and query files in, models and reports out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def headerless_csv(spark: SparkSession, path: str, schema: str, separator: str = ",", irrelevant: tuple[str, ...] = ()) -> DataFrame:
    """CSV without names: columns by position; quotes are ``"`` and the escape is a backslash."""
    return spark.read.csv(path, schema=schema, header=False, sep=separator, quote='"', escape="\\").drop(*irrelevant)


def headed_csv(spark: SparkSession, path: str, drop: tuple[str, ...] = (), complete_only: bool = False) -> DataFrame:
    """CSV with names, in which blanks become underscores; optionally only rows without nulls."""
    df = spark.read.csv(path, header=True, inferSchema=True).drop(*drop)
    df = df.toDF(*(c.strip().replace(" ", "_") for c in df.columns))
    return df.na.drop() if complete_only else df


def query_file(spark: SparkSession, path: str) -> DataFrame:
    """One query per line, and behind two bars its true cardinality."""
    parts = F.split("value", r"\|\|")
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.trim(parts[0]).alias("query"), F.expr("try_cast(trim(get(split(value, '[|][|]'), 1)) AS BIGINT)").alias("cardinality"))


def save_model(relations: dict[str, DataFrame], folder: str) -> None:
    """A model's relations, one Parquet folder each."""
    for name, df in relations.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_model(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def save_report(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").csv(folder, header=True)


def consistent_sample(df: DataFrame, keys: list[str], below: str) -> DataFrame:
    """The rows whose keys' md5 lies below a hexadecimal prefix; the same rows every time, everywhere."""
    from cardspark.functions.predicates import md5_below

    return df.where(md5_below(below, *keys))
