"""Running sums over groups of any size, without a task per group.

Rows of a group are dealt to 2 ** 24 buckets by a key; sums of buckets, of 256
buckets and of 65,536 buckets give every bucket its start, and only within a
bucket are rows sorted.  No window holds more than 256 sums or the rows of one
bucket, so a group may hold any share of all rows.  DataFrame operations only.

Ranks are taken of narrow rows (file, at and what the order needs, see
common.identified()); what belongs to them meets its rank by one join on
(file, at), so a text is moved once, whatever is ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphwright.llm.common import table

BUCKETS = 1 << 24


def hash_bucket(key: Column) -> Column:
    """The top 24 bits of a 64-bit key in unsigned order; hash_order() sorts within."""
    return F.shiftrightunsigned(key, 40)


def hash_order(key: Column) -> Column:
    """A signed key that sorts as the unsigned one."""
    return key.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def _before(by: list[Column], order: list[Column], weight: str) -> Column:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(weight).over(w), F.lit(0).cast("long"))


def content(*columns: Column) -> Column:
    """A 64-bit hash of what a row has."""
    return F.xxhash64(*columns)


def content_keys(slim: DataFrame, seed: int) -> DataFrame:
    """slim (file, at, content, ...) with `key`: a 64-bit key of a row's content and its number among rows of that content.

    So an order by key is the same however files are split, written or joined,
    and rows of one content, which may be any share of all, are spread.  Only
    rows that have a twin are numbered; which of them gets which number cannot
    be seen in a result that depends on the content alone.
    """
    key = lambda number: F.xxhash64(F.lit(seed), "content", number)
    twins = table(slim.groupBy("content").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("content"), "twins")
    if twins.isEmpty():
        return slim.withColumn("key", key(F.lit(0).cast("long"))).drop("content")
    own = table(slim.join(twins, "content", "left_semi").withColumn("place", F.xxhash64("file", "at")), "twin-rows")
    own = running_sum(own, ["content"], hash_bucket(F.col("place")), [hash_order(F.col("place")), F.col("at"), F.col("file")], F.lit(1), "number").drop("place")
    single = slim.join(twins, "content", "left_anti").withColumn("number", F.lit(0).cast("long"))
    return single.unionByName(own.select(*single.columns)).withColumn("key", key(F.col("number"))).drop("number", "content")


def key_order(key: str) -> list[Column]:
    """The order of rows by their key; file and at decide between equal ones, which only differ by chance."""
    return [hash_order(F.col(key)), F.col("at"), F.col("file")]


def running_sum(slim: DataFrame, by: list[str], bucket: Column, order: list[Column], weight: Column, out: str) -> DataFrame:
    """slim with `out`: the sum of `weight` (long) over the rows of its group that come before.

    `bucket` (0 to BUCKETS - 1) must not contradict `order`; the columns `by`
    must not be null.  slim is read twice and shuffled once, so it should be a
    table() of few narrow columns, none of them named with a leading underscore.
    The sums and the buckets' starts are tables too: adaptive execution plans
    all that is left of a query anew behind every shuffle, in the driver.
    """
    d = slim.withColumns({"_k": bucket.cast("long"), "_w": weight.cast("long")})
    sums = table(d.groupBy(*by, "_k").agg(F.sum("_w").alias("_w")), "sums")
    sums = sums.withColumns({"_m": F.shiftright("_k", 8), "_t": F.shiftright("_k", 16)})
    middle = sums.groupBy(*by, "_m").agg(F.sum("_w").alias("_w")).withColumn("_t", F.shiftright("_m", 8))
    top = middle.groupBy(*by, "_t").agg(F.sum("_w").alias("_w"))
    keys = [F.col(c) for c in by]
    top = top.select(*by, "_t", _before(keys, [F.col("_t")], "_w").alias("_top"))
    middle = middle.select(*by, "_m", "_t", _before([*keys, F.col("_t")], [F.col("_m")], "_w").alias("_mid"))
    middle = middle.join(top, [*by, "_t"]).select(*by, "_m", (F.col("_top") + F.col("_mid")).alias("_start"))
    leaves = sums.select(*by, "_k", "_m", _before([*keys, F.col("_m")], [F.col("_k")], "_w").alias("_leaf"))
    leaves = table(leaves.join(middle, [*by, "_m"]).select(*by, "_k", (F.col("_start") + F.col("_leaf")).alias("_start")), "starts")
    inner = _before([*keys, F.col("_k")], order, "_w")
    return d.join(leaves, [*by, "_k"]).withColumn(out, F.col("_start") + inner).drop("_k", "_w", "_start")
