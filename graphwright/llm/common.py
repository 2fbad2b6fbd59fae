"""Helpers that the operators of this subpackage share.

Intermediate tables are cut from their lineage by writing them as Parquet to
the folder that the cluster names in ``spark.checkpoint.dir``; every executor
sees it, so a lost executor costs a task and never the table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where intermediate tables go if the session names no checkpoint folder (tests on one machine).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"

#: A word, as all contracts here have it.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a local one only under a local master."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return LOCAL_CHECKPOINTS


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    files, where = _hadoop(spark, path)
    files.deleteOnExit(where)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    files, where = _hadoop(spark, path)
    files.delete(where, True)


def table(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read back; its size is then known to the planner."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path  # for dropped()
    return out


def dropped(df: DataFrame) -> None:
    """Frees a table() that no later plan reads."""
    drop_path(df.sparkSession, df._scratch_path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _stands_in_files(df: DataFrame) -> bool:
    """Whether every row is a row of a file: a file scan below nothing but projections and filters that always give the same."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.getClass().getSimpleName() == "LogicalRelation" and plan.metadataOutput().nonEmpty()


def identified(df: DataFrame, paths: bool = False) -> DataFrame:
    """row (a struct of all columns, so that no name can clash), file and at: two longs that name the row.

    With `paths`, file is the path itself, so that files have an order.

    A row is named by a hash of its file's path and its place in that file, so
    the names do not depend on how files are split, and reading again gives the
    same ones.  What is no plain scan of files is written to the shared folder
    first.
    """
    if not _stands_in_files(df):
        df = table(df, "rows")
    place, row = df.metadataColumn("_metadata"), F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(row.alias("row"), (place["file_path"] if paths else F.xxhash64(place["file_path"])).alias("file"), place["row_index"].alias("at"))


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    return df.mapInArrow(f, schema)


def source_key(source: Column) -> Column:
    """A string that is never null: nulls sort behind all other sources, which keep code-point order."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def word_count(text: Column) -> Column:
    """Number of words of a text as a long, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drops columns that would clash with those an operator adds, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])
