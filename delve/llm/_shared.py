"""Session helpers of the operators: shared tables, batch sizes, joins on ids that may be null."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch handed to a Python worker; bounds the worker's memory whatever the partition size.
BATCH_BYTES = 4 << 20

_written: dict[str, SparkSession] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where that is unset, a folder under /tmp, on local masters only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        root = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage, so a lost executor costs one stage and not the whole job, and keeps a
    Python stage that two consumers need from running twice. The shuffle files of the finished
    step are released. Tables are deleted by :func:`release`, or else when the interpreter ends.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/delve-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _written[path] = spark
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    table = spark.read.schema(schema).parquet(path)
    table.stored_at = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that nothing reads any more."""
    for table in tables:
        path = table.stored_at
        if path in _written:
            _delete(_written.pop(path), path)


def drop_tables(spark: SparkSession | None = None) -> None:
    """Delete the tables that :func:`materialize` wrote (in ``spark``'s session, or all)."""
    for path, owner in list(_written.items()):
        if spark is not None and owner is not spark:
            continue
        try:
            _delete(owner, path)
        except Exception:  # the session is gone, and with it the way to the file system
            pass
        _written.pop(path, None)


atexit.register(drop_tables)


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches end at BATCH_BYTES rather than at 10,000 rows of any length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def trimmed(run: Callable) -> Callable:
    """A function of Arrow batches whose worker gives the memory of its arrays back when a partition is done; workers live on between tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has it
            if trim:
                trim(0)

    return wrapped


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def temp_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, in any case: inputs may hold any extra columns."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def text_of(column: Column) -> Column:
    """A null text counts as empty."""
    return F.coalesce(column.cast("string"), F.lit(""))
