"""Cutting lineage through the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def settled(df: DataFrame, compression: str | None = None) -> DataFrame:
    """The same rows, computed once, written as Parquet and read back.

    They go to the folder of spark.checkpoint.dir, which all executors share
    (a local one only under a local master), and are removed when the driver's
    JVM ends.  The planner knows the size of what it reads.
    """
    return Parts(compression).add(df)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps, which it does when the driver's JVM collects their plans."""
    spark._jvm.System.gc()


class Parts:
    """A table that grows: every part is written once and stays as it is.  `compression` is Parquet's, by default the session's."""

    def __init__(self, compression: str | None = None) -> None:
        self.paths: list[str] = []
        self.options = {"compression": compression} if compression else {}

    def add(self, df: DataFrame) -> DataFrame:
        """The rows of `df`, settled as a further part."""
        spark = df.sparkSession
        context = spark.sparkContext
        folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = "/tmp/checkpoints"
        path = f"{folder.rstrip('/')}/settled-{uuid.uuid4().hex}"
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(where)
        df.write.options(**self.options).parquet(path)
        self.paths.append(path)
        return spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Frees the parts, which no later plan may read."""
        spark = SparkSession.getActiveSession()
        for path in self.paths:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        self.paths = []

    def all(self, like: DataFrame) -> DataFrame:
        """The rows of all parts, which have the columns of `like`."""
        return like.sparkSession.read.schema(like.schema).parquet(*self.paths)
