"""Intermediate tables in the folder that the driver and all executors share.

``spark.checkpoint.dir`` names that folder.  Where the session has none, a local
master gets a temporary one, which goes with the process, and a cluster one in the
warehouse, which all machines see.  A staged table cuts lineage, survives
the loss of any executor, and gives the planner exact sizes.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths staged since :func:`settled` began, in this thread.
_STAGED: ContextVar[list[str] | None] = ContextVar("staged", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, without a trailing slash."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if spark.sparkContext.master.startswith("local"):
            found = tempfile.mkdtemp(prefix="larkspur-")
            atexit.register(shutil.rmtree, found, ignore_errors=True)
        else:
            found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/larkspur-{spark.sparkContext.applicationId}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back."""
    return stage_at(df, tag)[0]


def stage_at(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """As :func:`stage`, with the path, for callers that drop it later."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/larkspur-{tag}-{uuid.uuid4().hex}"
    if (staged := _STAGED.get()) is not None:
        staged.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def settled(make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """Stage what ``make`` returns and delete the tables that it staged on the way."""
    staged: list[str] = []
    before = _STAGED.set(staged)
    try:
        df = make()
    finally:
        _STAGED.reset(before)
    found = stage(df, tag)
    for path in staged:
        drop_staged(found.sparkSession, path)
    del df
    release(found.sparkSession)
    return found


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, where its files make fewer tasks than there are: for small inputs of much work a row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def drop_staged(spark: SparkSession, path: str) -> None:
    """Delete a staged table that nothing will read again."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more.

    Its cleaner acts when the driver's garbage is collected, which a driver with
    little to do puts off while the disks fill."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def numbered(df: DataFrame, *order: str, name: str = "idx") -> DataFrame:
    """``df`` with dense numbers from 0 in a total order: a range-partitioned sort, then
    each partition's rows counted on from those before; only one count per partition
    comes to the driver."""
    sorted_ = stage(df.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "sorted")
    offsets, total = [], 0
    for part, n in sorted(sorted_.groupBy("_part").count().collect()):
        offsets.append((part, total))
        total += n
    start = df.sparkSession.createDataFrame(offsets, "_part int, _start long")
    return sorted_.join(F.broadcast(start), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")
