"""Where jobs keep tables between steps."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_top(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or else the session's checkpoint folder. Where
    neither is set, a session on one machine gets a temporary folder, and any other raises RuntimeError: its executors
    would write to disks of their own."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("sparkseek.local.dir", None)
    if top:
        return top
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get()
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    top = tempfile.mkdtemp(prefix="sparkseek-")
    spark.conf.set("sparkseek.local.dir", top)
    return top


def shared_dir(spark: SparkSession) -> str:
    """A new folder under shared_top()."""
    return f"{shared_top(spark).rstrip('/')}/sparkseek-{uuid.uuid4().hex}"


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders, where they are, through Spark's file systems."""
    java = spark.sparkContext._jvm
    settings = spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = java.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(settings).delete(path, True)


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, none where it isn't there."""
    java = spark.sparkContext._jvm
    path = java.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in system.listStatus(path)] if system.exists(path) else []


def state_of(spark: SparkSession, path: str) -> tuple:
    """Names, lengths and times of the files of a table."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in system.listStatus(at)))


def changed_at(spark: SparkSession, folder: str) -> int:
    """When a folder was last changed, in milliseconds."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime()


def create_once(spark: SparkSession, name: str, text: str) -> bool:
    """Makes a file with this text, all at once, unless there is one; whether it did. Of several that try, one succeeds:
    the text is written aside, and moved by a rename that fails where the name is taken (on a local disk by a link)."""
    java = spark.sparkContext._jvm
    path = java.org.apache.hadoop.fs.Path(name)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    aside = java.org.apache.hadoop.fs.Path(path.getParent(), f"_{path.getName()}.{uuid.uuid4().hex}")
    out = system.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if system.getUri().getScheme() == "file":
            os.link(aside.toUri().getPath(), path.toUri().getPath())
        else:
            none = getattr(java, "org.apache.hadoop.fs.Options$Rename").NONE
            options = spark.sparkContext._gateway.new_array(getattr(java, "org.apache.hadoop.fs.Options$Rename"), 1)
            options[0] = none
            java.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(aside, path, options)
        return True
    except Exception:
        if not system.exists(path):
            raise
        return False
    finally:
        system.delete(aside, False)


_WRITTEN: ContextVar[list | None] = ContextVar("written", default=None)


def written(df: DataFrame) -> DataFrame:
    """The same rows from a table in the shared folder, for jobs that read them several times. Within temporary() the
    table goes at the end of it, else when the folder is cleared."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    if (paths := _WRITTEN.get()) is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end what written() wrote within. It gives a function that writes a table which is to outlive it."""
    outer = _WRITTEN.get()
    token = _WRITTEN.set([])

    def keep(df: DataFrame) -> DataFrame:
        own = _WRITTEN.set(outer)
        try:
            return written(df)
        finally:
            _WRITTEN.reset(own)

    try:
        yield keep
    finally:
        paths = _WRITTEN.get()
        _WRITTEN.reset(token)
        remove(spark, paths)


def numbered(df: DataFrame, order: list[Column], into: str) -> DataFrame:
    """df with a row's number in an order, from 1. Rows are sorted over ranges, written, and numbered within their range;
    what comes before a range is one number for each."""
    keys = [f"order_{k}_" for k in range(len(order))]
    ordered = written(df.withColumns(dict(zip(keys, order, strict=True))).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part_", F.spark_partition_id()))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    counts = ordered.groupBy("part_").count().select("part_", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before_"))
    within = Window.partitionBy("part_").orderBy(*keys)
    return ordered.withColumn("n_", F.row_number().over(within)).join(F.broadcast(counts), "part_").select(*df.columns, (F.col("before_") + F.col("n_")).cast("long").alias(into))


#: Up to so many bytes, a table in fewer files than there are cores is dealt to all of them before its texts are split.
_SMALL = 64 << 20


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table of texts. One small file is often one row group, which one task would read and split alone; its
    rows are dealt to all cores. Larger tables are read as they are, without a shuffle."""
    df = spark.read.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    summary = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if summary.getLength() < _SMALL and summary.getFileCount() < cores else df
