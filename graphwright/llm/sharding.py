"""Sharding by proportional stratified interleaving.

Rows of each source are ranked in a seeded hash order; a row's fractional rank
is its rank, plus a seeded offset of the source below one, over its source's
rows, so sources of one size do not tie.  In the order of fractional ranks every
stretch holds the sources in proportion, and cutting it at equal counts gives
shards that all match the mixture and differ by one row at most.

DataFrame functions only.  Both ranks come from ranks.running_sum() over narrow
rows, so neither a source nor the whole table is ever sorted in one task, and
whole rows are shuffled once: to meet their shard and slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright.llm.common import identified, source_key, table, without
from graphwright.llm.ranks import BUCKETS, content, content_keys, hash_bucket, key_order, running_sum


def byte_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def offset(source: Column, seed: int) -> Column:
    """A number between 0 and 1 for each source."""
    return (F.pmod(F.xxhash64(F.lit(seed), source), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def assign_shards(docs: DataFrame, n_shards: int, seed: int = 29) -> DataFrame:
    """docs with shard (0 to n_shards - 1) and slot (0, 1, ... within the shard).

    docs needs doc_id and source and is read twice; columns named shard or slot
    are replaced, others keep their values whatever their names.  A null source
    is one source; null doc_ids are rows like others.  Repeated rows are
    separate rows.  With fewer rows than shards some shards are empty; an empty
    table gives an empty result.  The seed and what the rows have (columns that
    hold maps aside) decide, not files, partitions or joins.
    """
    d = identified(without(docs, "shard", "slot"))
    fields = [F.col(f"row.`{f.name}`") for f in d.schema["row"].dataType.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    made = d.select("file", "at", source_key(F.col("row.source")).alias("source"), content(*fields).alias("content"))
    slim = table(content_keys(table(made, "contents"), seed), "keys")
    counts = table(slim.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    ranked = running_sum(slim, ["source"], hash_bucket(F.col("key")), key_order("key"), F.lit(1), "rank").join(counts, "source")
    share = (F.col("rank") + offset(F.col("source"), seed)) / F.col("n").cast("double")
    ranked = table(ranked.select("file", "at", "source", "rank", share.alias("share")), "ranked")
    bucket = F.least(F.lit(BUCKETS - 1), F.floor(F.col("share") * BUCKETS))
    placed = running_sum(ranked, [], bucket, [F.col("share"), F.col("source"), F.col("rank")], F.lit(1), "place")
    placed = placed.withColumn("shard", F.expr(f"place * {n_shards} div {max(total, 1)}").cast("int"))
    first = F.expr(f"(shard * {total}L + {n_shards - 1}) div {n_shards}")
    placed = placed.select("file", "at", "shard", (F.col("place") - first).alias("slot"))
    return d.join(placed.hint("merge"), ["file", "at"]).select("row.*", "shard", "slot")
