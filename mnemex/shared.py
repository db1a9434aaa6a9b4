"""Materialised intermediates in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        existing = spark.sparkContext.getCheckpointDir()
        base = existing or tempfile.mkdtemp(prefix="mnemex-")
        if not existing:
            spark.sparkContext.setCheckpointDir(base)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)  # a relative one is made absolute, or tables and files would part
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString().rstrip("/")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written in this block go once it is written: what comes later starts from the table."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


class Workspace:
    """Named tables of one run. A table is written once and read back, so later
    plans start from files that outlive any executor; ``drop`` frees one early."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/mnemex/{name}-{uuid.uuid4().hex}"

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def save(self, df: DataFrame, table: str) -> DataFrame:
        schema = df.schema
        with passing_shuffles(self.spark):
            df.write.mode("overwrite").parquet(self.path(table))
        return self.spark.read.schema(schema).parquet(self.path(table))

    def drop(self, table: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(table))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def within(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows, looking at no more than it must."""
    return df.limit(rows + 1).count() <= rows
