"""Shared helpers of the training-data operators: table access, scratch tables, range buckets."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LOCAL_SCRATCH = "/tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table of a data folder; the path may be any that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: ``spark.checkpoint.dir``; where that is unset, a local folder in local mode, and an
    error on a cluster, whose machines share no such folder."""
    context = spark.sparkContext
    if folder := context.getConf().get("spark.checkpoint.dir"):
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL_SCRATCH


#: Lets Spark delete the shuffle files of a SQL execution when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: A measure for ``materialize``.
ROWS = {"rows": "count(1)"}


def materialize(df: DataFrame, name: str, measures: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage and survives lost executors.

    The write's shuffle files go with its end, as later plans read the table instead; otherwise they stay until the driver
    happens to collect its garbage. ``measures`` are SQL aggregates taken while it writes, for ``measured``: queries of
    their own would cost the driver memory and time.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/veilspark/{name}-{uuid.uuid4().hex}"
    seen = Observation() if measures else None
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        (df.observe(seen, *[F.expr(m).alias(k) for k, m in measures.items()]) if measures else df).write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    vars(out)["scratch_path"] = path
    vars(out)["measured"] = seen.get if measures else {}
    return out


def measured(t: DataFrame) -> dict:
    """The measures of a table that ``materialize`` returned."""
    return vars(t)["measured"]


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``materialize`` returned and that no later plan reads; anything else is left alone."""
    for t in tables:
        if t is not None and (path := vars(t).get("scratch_path")):
            context = t.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


#: Rows and bytes of an Arrow batch, the same for all operators, as the settings belong to the session.
BATCH_ROWS = 1024
BATCH_BYTES = 4 << 20


def python_operators(spark: SparkSession) -> None:
    """Let workers import this package, and bound an Arrow batch and with it a worker's memory."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def trimmed(run: Callable) -> Callable:
    """``run`` over batches, after which the worker gives freed memory back: workers are reused by later stages."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def give_back() -> None:
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    if hasattr(trim := ctypes.CDLL(None), "malloc_trim"):  # of the C library on Linux
        trim.malloc_trim(0)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` begins so, whatever the case."""
    taken = [c.lower() for c in df.columns]
    while any(c.startswith(name.lower()) for c in taken):
        name = "_" + name
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_bucket(df: DataFrame, col: str, buckets: int) -> F.Column:
    """An ascending bucket number for ``col`` (nulls last) from approximate quantiles over all rows.

    Only ``buckets - 1`` bounds reach the driver. Any bounds give right results; good ones give even buckets.
    """
    probs = [i / buckets for i in range(1, buckets)]
    bounds = []
    if probs:
        row = df.agg(F.percentile_approx(F.col(col), probs, 10000).alias("b")).first()
        bounds = sorted(set(row["b"] or []))
    if not bounds:
        return F.when(F.col(col).isNull(), F.lit(1)).otherwise(F.lit(0)).cast("int")
    return F.when(F.col(col).isNull(), F.lit(len(bounds))).otherwise(_count_at_most(F.col(col), bounds)).cast("int")


def _count_at_most(value: F.Column, bounds: list) -> F.Column:
    """Binary search over literal bounds as nested conditions: log2(n) comparisons a row, code-generated."""

    def search(lo: int, hi: int) -> F.Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < F.lit(bounds[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(bounds))


def placed(df: DataFrame, buckets: int, col: str = "bucket") -> DataFrame:
    """Rows dealt by bucket number itself, a bucket a partition; hashing the numbers would leave some partitions empty."""
    return df.repartitionById(buckets, F.pmod(F.col(col), F.lit(buckets)).cast("int"))
