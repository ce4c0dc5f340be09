"""Tables of a whole schema made ready for models, and written with what is known of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardspark.catalog import SchemaGraph
from cardspark.operators import encode, joins


def prepared_table(schema: SchemaGraph, tables: dict[str, DataFrame], name: str, most_rows: int, rates: dict[str, float] | None = None) -> tuple[DataFrame, int, float]:
    """A table with a fan-out column (both kinds) for each incoming edge, its number of rows and its sampling rate.

    Irrelevant columns are left out.  Above ``most_rows`` rows a hash of the key (or of all columns)
    decides which rows stay, about that many.  ``rates`` are those of the tables' rows that are given;
    fan-outs are scaled up by them.
    """
    own, rates = schema.table(name), rates or {}
    df = tables[name].drop(*own.irrelevant)
    for r in schema.relationships:
        if r.parent == name and r.child in tables:
            df = joins.with_fan_out(df, tables[r.child], r, rates.get(r.child, 1.0))
    rows = df.count()
    rate = joins.sampling_rate(rows, most_rows)
    keys = [own.key] if own.key else df.columns
    return (df if rate >= 1.0 else df.where(joins.hashed_below(rate, *keys))), rows, rate


def prepare_schema(spark: SparkSession, schema: SchemaGraph, tables: dict[str, DataFrame], folder: str, most_rows: int = 20_000_000) -> DataFrame:
    """Writes each table, and for each edge the child's rows without a parent, as Parquet; returns what is known of them.

    The result, written as well, has a row for each column: table, rows, rate, attribute, least, largest, n,
    n_null and the reason for which models leave it out (null if they don't).
    """
    known = None
    for name in tables:
        own = schema.table(name)
        df, rows, rate = prepared_table(schema, tables, name, most_rows)
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        df = spark.read.parquet(f"{folder}/{name}")
        foreign = tuple(r.fk for r in schema.relationships if r.child == name)
        for r in schema.relationships:
            if r.child == name and r.parent in tables:
                joins.without_partner(df, tables[r.parent], r.fk, r.pk).write.mode("overwrite").parquet(f"{folder}/{name}__without__{r.parent}")
        reasons = encode.pruned_attributes(df, own.key, foreign, own.irrelevant, error=0.02)
        one = encode.domains(df, df.columns).join(reasons, "attribute", "left").select(F.lit(name).alias("table"), F.lit(rows).alias("rows"), F.lit(rate).alias("rate"), "*")
        known = one if known is None else known.unionByName(one)
    known.write.mode("overwrite").parquet(f"{folder}/metadata")
    return spark.read.parquet(f"{folder}/metadata")


def true_cardinalities(spark: SparkSession, path: str) -> DataFrame:
    """(query_no, cardinality) of a CSV file with a header whose last column is the true cardinality of each query in turn."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    first, last = df.columns[0], df.columns[-1]
    return df.select(F.col(first).cast("long").alias("query_no"), F.col(last).cast("long").alias("cardinality"))


def load_models(spark: SparkSession, folders: list[str], name: str) -> DataFrame:
    """One relation of several saved models, each row with the folder (``model``) that it comes from."""
    out = None
    for folder in folders:
        one = spark.read.parquet(f"{folder}/{name}").withColumn("model", F.lit(folder))
        out = one if out is None else out.unionByName(one)
    return out
