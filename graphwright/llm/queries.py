"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwright.llm.common import documents, fresh_path


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphwright.llm.mixing import mix

    out = mix(documents(spark, sf_dir))
    digest = F.expr("aggregate(pieces, 0L, (a, p) -> xxhash64(a, p.shard, p.place, p.block, p.words))")
    return out.select("doc_id", "size", "source_size", "target", "taken", F.size("pieces").alias("n_pieces"), digest.alias("digest"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphwright.llm.decontaminate import contaminated

    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphwright.llm.secretscan import scan

    return scan(documents(spark, sf_dir))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphwright.llm.sharding import assign_shards, byte_size

    text = F.coalesce("text", F.lit(""))
    slim = documents(spark, sf_dir).select("doc_id", "source", byte_size(F.col("text")).alias("size"), F.crc32(text).alias("text_crc32"))
    out = assign_shards(slim, 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphwright.llm.tokenfiles import digest_token_files, write_token_files

    path = fresh_path(spark, "token-files")
    write_token_files(documents(spark, sf_dir), path, "byte_bpe_50k.json")
    return digest_token_files(spark, path)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphwright.llm.lm import score

    return score(documents(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphwright.llm.linededup import line_report

    return line_report(documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphwright.llm.quality import judge

    return judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphwright.llm.tokens import token_counts

    return token_counts(documents(spark, sf_dir), "word_bpe_49k.json", 2048)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphwright.llm.neardup import near_duplicates

    return near_duplicates(documents(spark, sf_dir), percent=85)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphwright.llm.trie import prefix_trie

    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphwright.llm.packing import pack

    return pack(documents(spark, sf_dir), 2048, "word_bpe_49k.json", 1)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphwright.llm.negatives import hard_negatives, points

    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(points(e.select("vec_id", label.alias("label"), "embedding")), F.col("vec_id") % 50 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from graphwright.llm import linededup, negatives, trie

    return {"op7_line_dedup": linededup.REPORT_SQL, "op11_prefix_trie": trie.SQL, "op13_hard_negatives": negatives.SQL}
