"""Stored tables: one Parquet folder per key, symbols by crate, with a fingerprint that tells whether a graph still fits."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.ingest import merge_changed
from larkspur.plans.staging import drop_staged, stage_at


class Store:
    """Tables under one folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, key: str) -> str:
        return f"{self.root}/{key}"

    def exists(self, key: str) -> bool:
        fs, target = self._fs(self.path(key))
        return fs.exists(target)

    def _fs(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    @contextmanager
    def writing(self, wait: float = 30.0) -> Iterator[None]:
        """One writer at a time: a lock file that only one process can create."""
        fs, lock = self._fs(f"{self.root}/.write.lock")
        until = time.monotonic() + wait
        while True:
            try:
                fs.create(lock, False).close()
                break
            except Py4JJavaError as taken:
                if time.monotonic() > until:
                    raise TimeoutError(f"{self.root} is being written") from taken
                time.sleep(0.05)
        try:
            yield
        finally:
            fs.delete(lock, False)

    def put(self, key: str, rows: DataFrame, by: str | None = None) -> None:
        """Replace a table: written aside, then renamed into place; with ``by`` only the
        partitions that ``rows`` has."""
        merged, path = stage_at(rows, "put")  # rows may come from the table itself
        if by and self.exists(key):
            merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(self.path(key))
        else:
            aside = f"{self.root}/.{key}-{uuid.uuid4().hex}"
            writer = merged.write.partitionBy(by) if by else merged.write
            writer.parquet(aside)
            fs, target = self._fs(self.path(key))
            old = self._fs(f"{aside}-old")[1]
            if fs.exists(target):
                fs.rename(target, old)
            fs.rename(self._fs(aside)[1], target)
            fs.delete(old, True)
        drop_staged(self.spark, path)

    def get(self, key: str) -> DataFrame | None:
        if not self.exists(key):
            return None
        found = self.spark.read.parquet(self.path(key))
        # a partition of empty text reads back as null
        return found.withColumn("crate_name", F.coalesce(F.col("crate_name").cast("string"), F.lit(""))) if "crate_name" in found.columns else found

    def save_symbols(self, rows: DataFrame, keys: tuple[str, ...] = ("file", "name")) -> None:
        """New rows and the old ones of the crates they touch whose key none of them has."""
        old = self.get("chunks")
        if old is not None:
            touched = old.join(rows.select("crate_name").distinct(), "crate_name", "left_semi")
            rows = merge_changed(touched.select(rows.columns), rows, list(keys))
        self.put("chunks", rows, by="crate_name")

    def save_graph(self, edges: DataFrame, chunks: DataFrame) -> None:
        self.put("edges", edges)
        self.put("graph", fingerprint(chunks))

    def load_graph(self, chunks: DataFrame) -> DataFrame | None:
        """The stored edges if they were saved for these symbols."""
        saved = self.get("graph")
        if saved is None or saved.first() != fingerprint(chunks).first():
            return None
        return self.get("edges")


def fingerprint(chunks: DataFrame) -> DataFrame:
    """One row: how many symbols there are and a sum over idx, name, file and lines."""
    row = F.xxhash64("idx", "name", "file", "start_line", "end_line").cast("decimal(38,0)")
    return chunks.agg(F.count(F.lit(1)).alias("symbols"), F.coalesce(F.sum(row), F.lit(0).cast("decimal(38,0)")).alias("mark"))


def content_hash(content: Column) -> Column:
    return F.xxhash64(content)


def symbol_id(source: Column, index: Column) -> Column:
    return F.xxhash64(source, index)
