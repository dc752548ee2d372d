"""Intermediate tables in the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Spark's setting by which a finished query's shuffle files are removed at once.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a written table, and bytes of its compressed files, up to which it is broadcast in a join.
BROADCAST_ROWS, BROADCAST_BYTES = 1 << 19, 16 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``, or a temporary one where it is unset and all runs on
    this machine (tests); elsewhere an error, as executors would write where nobody reads."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillstone-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the session's JVM ends."""
    path = f"{scratch_dir(spark)}/quillstone/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts the lineage, computes once, survives lost executors.
    The shuffle files of what was written go when it is there."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a written table that nothing reads any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def file_bytes(df: DataFrame) -> int:
    """The length of the files of a table read from files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def if_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A written table, to be broadcast in a join if it has at most ``rows`` (BROADCAST_ROWS) rows in files of at most
    BROADCAST_BYTES; beyond that the join shuffles, and adaptive execution splits hot keys. The rows come out the same."""
    small = file_bytes(df) <= BROADCAST_BYTES and df.count() <= (BROADCAST_ROWS if rows is None else rows)
    return F.broadcast(df) if small else df


#: Rows of one range of a sort that numbers rows, about.
RANGE_ROWS = 1 << 20


def numbered(rows: DataFrame, order: list, at: str) -> DataFrame:
    """Adds ``at``: each row's place from 0 in the order of all rows, which is to be a total one. Rows are range-sorted; a range's
    rows are numbered in it, and a row a range tells how many are before. ``rows`` is read twice, the result is written."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // RANGE_ROWS)
    dealt = written(rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    before = F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    base = dealt.groupBy("__part").agg(F.count("*").alias("n")).select("__part", F.coalesce(before, F.lit(0)).alias("__before"))  # one row a range
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    out = dealt.withColumn(at, place).join(F.broadcast(base), "__part").withColumn(at, (F.col(at) + F.col("__before")).cast("long"))
    return written(out.drop("__part", "__before"), "numbered")


def stamp_of(spark: SparkSession, path: str) -> tuple:
    """What tells versions of a file or folder apart: its files' paths, lengths and times."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.listStatus(at)
    return tuple(sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in found))
