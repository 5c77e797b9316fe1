"""Paths that every executor can reach."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the folder that spark.checkpoint.dir names.

    Where it is unset, a session on one machine (tests) gets a folder below the
    warehouse; on a cluster that would be some machine's own disk, so it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/leafmend-{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, *partitions: str) -> DataFrame:
    """df written once to a fresh shared path and read again, its lineage cut."""
    path = shared_path(df.sparkSession, what)
    df.write.partitionBy(*partitions).parquet(path) if partitions else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, what: str, *keys: str) -> tuple[DataFrame, Callable[[], None]]:
    """df written once to a table bucketed by keys, so that windows and groups by them need no exchange, and what deletes it."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, what)
    name = f"leafmend_{uuid.uuid4().hex}"
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(tasks, *keys).saveAsTable(name)

    def gone() -> None:
        spark.sql(f"DROP TABLE {name}")
        deleted(spark, path)

    return spark.table(name), gone


#: Shuffle files of a query go as soon as it has ended, not when the driver's next garbage collection finds them.
TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: A join by some more keys than both sides lie by leaves them where they are.
IN_PLACE = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}

#: A row is made once: else a text is also cut for each look whether it has rows at all.
ONCE = {"spark.sql.optimizer.excludedRules": "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate"}


@contextmanager
def configured(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """The session with these settings, then as it was."""
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """df over as many tasks as the session's shuffles have, for rows that are few in bytes and dear to work on; by bytes alone they might all go to one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def deleted(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
