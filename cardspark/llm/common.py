"""Helpers shared by the operators: batches, checkpoints and tokenizer files."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
from collections.abc import Callable, Hashable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of documents; a scan with fewer parts than there are cores is dealt out to all of them.

    A file of one row group is read by one task, and texts are much work for their bytes.  A table of
    many files has more parts than cores and is read as it lies, without a shuffle.
    """
    docs, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def tokenizer_path(name: str) -> str:
    """Path of an installed public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Session setting under which a query's shuffle files go when the query is done.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's shared checkpoint folder; lineage ends there.

    The folder is the one the session names in ``spark.checkpoint.dir``.  Only where none is
    named, in a local session, is a folder of our own set: on a cluster the machines would not share
    it.  The shuffle files of the job that wrote it are removed at once: nothing reads them again.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def unused_names(df: DataFrame, *names: str) -> list[str]:
    """Names for columns beside those of ``df``: led by two underscores, and more where one is taken."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while (name := f"__{name}").lower() in taken:
            pass
        out.append(name)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_held: dict[Hashable, object] = {}


def held(key: Hashable, make: Callable[[], object]) -> object:
    """The one large object, such as a tokenizer, that a Python worker keeps from task to task; that of another key takes its place."""
    if key not in _held:
        tidy()
        _held[key] = make()
    return _held[key]


def tidy(keep: Hashable = None) -> None:
    """Gives back what earlier tasks of this worker left behind, but for the object held under ``keep``."""
    if _held and keep not in _held:
        _held.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # C libraries without it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20, keep: Hashable = None) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each slice holds about ``limit`` bytes of ``column`` (one row at least).

    ``keep`` is the key of the object held that the task uses.
    """
    import numpy as np

    tidy(keep)
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def accepted_rows(df: DataFrame, text: str, judge: Callable[[], Callable[[list[str | None]], Iterable[bool]]]) -> DataFrame:
    """The rows whose text ``judge`` accepts, with all their columns as they are.

    ``judge`` is called once in each task and gives what says of a list of texts which to keep.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = judge()
        for batch in slices(batches, text):
            yield batch.filter(pa.array(list(keep(batch.column(text).to_pylist())), pa.bool_()))

    return df.mapInArrow(run, df.schema)
