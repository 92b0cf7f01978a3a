"""Incremental maintenance from a stream of file changes.

A watcher's events (path, crate_name, seq, deleted, payload columns) arrive as a file
stream.  Every micro-batch is reduced to the last event of each path and merged into
a table partitioned by crate: only the crates touched are rewritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larkspur.plans.staging import drop_staged, stage_at

# Folders whose changes are ignored.
IGNORED_FOLDERS = ("target", ".git", "node_modules", "mutants.out")


def relevant(path: str = "path"):
    out = F.col(path).endswith(".rs")
    for folder in IGNORED_FOLDERS:
        out = out & ~F.col(path).contains(f"/{folder}/") & ~F.col(path).startswith(f"{folder}/")
    return out


def read_changes(spark: SparkSession, folder: str, schema: str, fmt: str = "json", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(folder)


def coalesce_changes(batch: DataFrame, key: str = "path", order: str = "seq") -> DataFrame:
    """The last event of each key."""
    row = F.struct(*batch.columns)
    return batch.groupBy(key).agg(F.max_by(row, F.col(order)).alias("row")).select("row.*")


def apply_batch(batch: DataFrame, table: str, key: str = "path", crate: str = "crate_name") -> None:
    """Merge one batch into the Parquet table at ``table``; deletions stay as rows that
    :func:`current` leaves out, so that a batch may come late."""
    spark = batch.sparkSession
    last = coalesce_changes(batch, key)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    rows = last
    if there:
        old = spark.read.parquet(table)
        # crates that the batch touches: those of its rows and those that its paths were in
        touched = last.select(crate).unionByName(old.join(last.select(key), key, "left_semi").select(crate)).distinct()
        rows = coalesce_changes(old.join(touched, crate, "left_semi").select(last.columns).unionByName(last), key)
    merged, path = stage_at(rows, "batch")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(crate).parquet(table)
    drop_staged(spark, path)


def current(spark: SparkSession, table: str, key: str = "path") -> DataFrame:
    """The last state of each key; a path that changed crates may have an older row in the one it left."""
    return coalesce_changes(spark.read.parquet(table), key).where("not deleted")


def maintain(changes: DataFrame, table: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start the stream; by default it ends when the files present are done."""
    return changes.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(lambda batch, _: apply_batch(batch, table)).start()
