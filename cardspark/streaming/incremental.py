"""Additive model state kept up by micro-batches: counts, sums and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: A leaf's additive state: rows, and sums of x, x^2 and 1/x.
MEASURES = ("n", "sum_x", "sum_x2", "sum_inverse")


def leaf_state(df: DataFrame, group: str, value: str) -> DataFrame:
    x = F.col(value).cast("double")
    return df.groupBy(group).agg(F.count(x).alias("n"), F.sum(x).alias("sum_x"), F.sum(x * x).alias("sum_x2"), F.sum(F.when(x != 0, 1 / x)).alias("sum_inverse"))


def merged(a: DataFrame, b: DataFrame, group: str) -> DataFrame:
    """State of both parts together; all measures are sums."""
    return a.unionByName(b).groupBy(group).agg(*(F.sum(m).alias(m) for m in MEASURES))


def statistics(state: DataFrame, group: str) -> DataFrame:
    """Mean, mean square and mean inverse from the state."""
    return state.select(group, "n", *((F.col(f"sum_{k}") / F.col("n")).alias(f"mean_{k}") for k in ("x", "x2", "inverse")))


def windowed_counts(events: DataFrame, time: str, length: str, *groups: str, late: str | None = None) -> DataFrame:
    """Rows and sums in tumbling windows; on a stream, ``late`` is how long late rows are waited for."""
    rows = events.withWatermark(time, late) if late and events.isStreaming else events
    return rows.groupBy(F.window(time, length).alias("w"), *groups).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), *groups, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, user: str, late: str | None = None) -> DataFrame:
    """Sessions of a user that end after a gap."""
    rows = events.withWatermark(time, late) if late and events.isStreaming else events
    return rows.groupBy(F.session_window(time, gap).alias("w"), user).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def maintain(stream: DataFrame, group: str, value: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch's state, under its batch number, to a table that :func:`current` sums up.

    A batch that is run again after a failure overwrites its own part, so nothing counts twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        leaf_state(batch, group, value).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, folder: str, group: str) -> DataFrame:
    parts = spark.read.parquet(folder)
    return parts.groupBy(group).agg(*(F.sum(m).alias(m) for m in MEASURES))


def nearest_center(columns: list[str], centers: list[tuple[float, ...]]) -> Column:
    """Number of the centre a row is nearest to; the first of equally near ones.

    A null component says nothing: distances go by the components that the row has, and a row without
    any is the first centre's.
    """
    away = [sum((F.coalesce(F.pow(F.col(c) - x, F.lit(2)), F.lit(0.0)) for c, x in zip(columns, center)), F.lit(0.0)) for center in centers]
    least = F.least(*away) if len(away) > 1 else away[0]
    out = F.lit(len(centers) - 1)
    for k in reversed(range(len(centers) - 1)):
        out = F.when(away[k] == least, F.lit(k)).otherwise(out)
    return out
