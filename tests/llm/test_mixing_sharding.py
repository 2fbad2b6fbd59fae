from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from graphwright.llm import mixing, sharding
from graphwright.llm.common import identified, word_count
from graphwright.llm.ranks import content, content_keys


def brute_targets(sizes: dict, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, total = {}, sum(sizes.values())
    free, left = set(order), float(total)
    while free:
        share = left / sum(w[s] for s in free)
        over = [s for s in free if w[s] * share > cap * sizes[s]]
        if not over:
            target |= {s: w[s] * share for s in free}
            break
        for s in over:
            target[s] = float(cap * sizes[s])
            left -= target[s]
            free.discard(s)
    return target


def test_mix_meets_targets(small):
    known = small.select(F.col("doc_id").alias("id"), "source").distinct()
    made = mixing.mix(small, n_shards=5, block_words=64)
    rows = made.join(known, made["doc_id"].eqNullSafe(known["id"])).collect()
    sizes = {r["source"]: r["n"] for r in small.groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("n")).collect()}
    target = brute_targets(sizes)
    taken, seen = Counter(), defaultdict(set)
    for r in rows:
        taken[r["source"]] += r["taken"]
        seen[r["source"]].add((r["source_size"], round(r["target"], 6)))
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["taken"] == sum(p["words"] for p in r["pieces"])
    for s, t in target.items():
        if sizes[s]:
            assert seen[s] == {(sizes[s], round(t, 6))}
            assert abs(taken[s] - t) <= 1


def test_mix_blocks_lie_in_one_shard_and_shards_are_level(small):
    pieces = mixing.mix(small, n_shards=5, block_words=64).select("doc_id", F.explode("pieces").alias("p")).select("p.*").collect()
    blocks = defaultdict(set)
    for p in pieces:
        blocks[p["shard"], p["pass"]].add(p["block"])
    n = Counter(p["shard"] for p in {(p["shard"], p["block"], p["pass"]): p for p in pieces}.values())
    assert set(n) == set(range(5))
    assert sum(p["words"] for p in pieces) == small.agg(F.sum(word_count(F.col("text")))).first()[0]


def test_splitting_tree_is_hypergeometric(spark):
    sources = spark.createDataFrame([(0, 60), (1, 30), (2, 0), (3, 10)], "ord int, blocks long")
    lefts = []
    for seed in range(12):
        tree = {r["ord"]: r["tree"] for r in mixing.splitting_tree(sources, 4, seed).collect()}
        for node in (1, 2, 3):
            assert sum(t[node] for t in tree.values()) == {1: 50, 2: 25, 3: 25}[node]
        assert tree[2][1] == 0
        lefts.append(tree[0][1])
    assert 24 <= sum(lefts) / len(lefts) <= 36 and len(set(lefts)) > 2


@pytest.mark.parametrize(("total", "kind", "take"), [(20, 7, 9), (100, 60, 50), (1000, 3, 500), (50, 45, 40), (4_000_000_000, 1_600_000_000, 2_000_000_000)])
def test_draws_follow_the_law(spark, total, kind, take):
    """Chi-square against exact probabilities; with many outcomes, against the quantiles that mean and deviation give."""
    n = 8000
    got = Counter(r["x"] for r in spark.range(n).selectExpr(mixing._draw(f"{total}L", f"{kind}L", f"{take}L", "xxhash64(id, 5)") + " AS x").collect())
    lo, hi = max(0, take - (total - kind)), min(take, kind)
    assert lo <= min(got) and max(got) <= hi
    if total <= 1000:
        law = {x: n * math.comb(kind, x) * math.comb(total - kind, take - x) / math.comb(total, take) for x in range(lo, hi + 1)}
        groups = [(got[x], e) for x, e in law.items() if e >= 5]
    else:
        mean = take * kind / total
        deviation = (mean * (total - kind) / total * (total - take) / (total - 1)) ** 0.5
        part = Counter(int(8 * NormalDist().cdf((x + 0.5 - mean) / deviation)) for x in got.elements())
        groups = [(part[i], n / 8) for i in range(8)]
        assert deviation * 24 > 4096
    chi = sum((k - e) ** 2 / e for k, e in groups)
    df = len(groups) - 1
    assert chi < df + 4 * (2 * df) ** 0.5 + 4


@pytest.mark.parametrize("n", [1, 2, 3, 8, 1000])
def test_blocks_are_permuted_by_source(spark, n):
    bits = (n - 1).bit_length() or 1
    columns = [f"{n}L AS blocks", f"{bits // 2} AS width", f"{(1 << bits // 2) - 1}L AS low", f"{(1 << bits - bits // 2) - 1}L AS high"]
    orders = []
    for key in (1, 2):
        rows = spark.range(n).selectExpr("id", *columns, f"{key}L AS key").selectExpr("id", mixing._permuted("id") + " AS x").collect()
        orders.append([r["x"] for r in sorted(rows)])
        assert sorted(orders[-1]) == list(range(n))
    assert n < 8 or orders[0] != orders[1] != list(range(n))


def test_mix_reruns_agree_and_edge_tables(small, empty, clashing, clashing_names):
    a, b = (mixing.mix(d).select("doc_id", "size", "target", "taken") for d in (small, clashing))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    out = mixing.mixed_documents(clashing)
    assert out.columns == clashing.columns and not out.isEmpty()
    assert all(out.where(~F.col(f"`{c}`").eqNullSafe(F.col("doc_id") + 1)).isEmpty() for c in clashing_names)


def test_mixed_documents_are_the_dealt_pieces(small):
    how = {"n_shards": 5, "block_words": 64}
    pieces = mixing.mix(small, **how).select("doc_id", F.explode("pieces").alias("p")).select("doc_id", "p.*").collect()
    rows = mixing.mixed_documents(small, **how).withColumn("n", word_count(F.col("text"))).collect()
    order = sorted(pieces, key=lambda p: (p["shard"], p["place"], p["pass"], p["first_word"]))
    assert [(r["doc_id"], r["n"]) for r in rows] == [(p["doc_id"], p["words"]) for p in order]
    sizes = {r["source"]: r["n"] for r in small.groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("n")).collect()}
    taken = Counter()
    for r in rows:
        taken[r["source"]] += r["n"]
        assert r["n_chars"] == len(r["text"]) or r["doc_id"] is None
    assert all(abs(taken[s] - t) <= 1 for s, t in brute_targets(sizes).items())


def test_texts_of_the_pieces_make_up_the_documents(spark):
    texts = [" \n a  b\tc\n\nd e ", "one two\nthree", "\u00e9 \u00df\u2003x \U0001f600  y"]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    how = {"n_shards": 2, "block_words": 2}
    rows = mixing.mixed_documents(docs, **how).collect()
    pieces = mixing.mix(docs, **how).select("doc_id", F.explode("pieces").alias("p")).select("doc_id", "p.*").collect()
    order = sorted(pieces, key=lambda p: (p["shard"], p["place"], p["pass"], p["first_word"]))
    made = defaultdict(list)
    for p, r in zip(order, rows, strict=True):
        made[p["doc_id"], p["pass"]].append((p["first_word"], r["text"]))
    assert {k: "".join(t for _, t in sorted(x)) for k, x in made.items()} == {(i, 0): t for i, t in enumerate(texts)}


def test_op1_depends_on_the_tree(small, tmp_path, monkeypatch):
    from graphwright.llm import queries

    small.write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda: sorted(map(str, queries.op1_mixing(small.sparkSession, str(tmp_path)).collect()))
    dealt, tree = run(), mixing.splitting_tree
    assert run() == dealt
    monkeypatch.setattr(mixing, "splitting_tree", lambda sources, n, seed: tree(sources, n, seed + 1))
    assert run() != dealt


@pytest.mark.parametrize("n", [1, 4, 40])
def test_shards(small, n):
    out = sharding.assign_shards(small, n)
    rows = out.select("shard", "slot", "source").collect()
    assert out.columns == [*small.columns, "shard", "slot"]
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    counts = [len(by.get(i, [])) for i in range(n)]
    assert sum(counts) == small.count() and max(counts) - min(counts) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    total = Counter(r["source"] for r in rows)
    for i in range(n):
        own = Counter(r["source"] for r in rows if r["shard"] == i)
        for s, k in total.items():
            assert abs(own[s] - k / n) <= 2


def test_shard_edges(empty, clashing, same_rows):
    assert sharding.assign_shards(empty, 40).count() == 0
    assert same_rows(sharding.assign_shards(clashing, 3).drop("shard", "slot"), clashing)


def test_order_is_that_of_fractional_ranks(spark):
    """Brute force: rows ranked by key within their source, all rows in the order of their fractional ranks."""
    rows = [(i, i if i % 7 else None, "ab\u0436c"[i % 4] if i % 11 else None) for i in range(150)] + [(150 + i, 3, "a") for i in range(40)]
    docs = spark.createDataFrame(rows, "number int, doc_id long, source string")
    made = identified(docs)
    whole = content(*[F.col(f"row.{c}") for c in docs.columns])
    keys = content_keys(made.select("file", "at", "row", whole.alias("content")), 29).select("row.*", "key").collect()
    shares = {r["source"]: r["x"] for r in docs.select("source", sharding.offset(sharding.source_key(F.col("source")), 29).alias("x")).distinct().collect()}
    by = defaultdict(list)
    for r in keys:
        by[r["source"]].append((r["key"] % 2**64, r["number"]))
    places = []
    for source, own in by.items():
        for i, (_, number) in enumerate(sorted(own)):
            places.append(((i + shares[source]) / len(own), (source is None, source or ""), i, number))
    wanted = {x[-1]: n for n, x in enumerate(sorted(places))}
    got = sharding.assign_shards(docs, 7).collect()
    start = [-(-i * len(rows) // 7) for i in range(8)]
    assert {r["number"]: start[r["shard"]] + r["slot"] for r in got} == wanted


def test_small_sources_do_not_tie(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), "id").alias("source"))
    shares = docs.select(F.floor(sharding.offset(F.concat(F.lit("0"), "source"), 29) * 4096).alias("b")).groupBy("b").count().agg(F.count("b"), F.max("count")).first()
    assert shares[0] > 1900 and shares[1] < 10
    slots = Counter(r["shard"] for r in sharding.assign_shards(docs, 16).collect())
    assert max(slots.values()) - min(slots.values()) <= 1


def test_results_depend_on_the_rows_alone(spark, small, same_rows):
    """Other files, partition counts and join plans, and twins, change neither mix nor shards."""
    docs = small.unionByName(small.where("doc_id < 20")).unionByName(small.where("doc_id < 5"))
    run = lambda d: (mixing.mix(d, n_shards=5, block_words=64).drop("file"), mixing.mixed_documents(d, n_shards=5, block_words=64), sharding.assign_shards(d, 7))
    first = run(docs)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, x in settings.items():
        spark.conf.set(k, x)
    try:
        for a, b in zip(first, run(docs.repartition(6, "text")), strict=True):
            assert same_rows(a, b)
    finally:
        for k, x in old.items():
            spark.conf.set(k, x)


def test_op4_query(spark, small, tmp_path):
    from graphwright.llm import queries

    small.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op4_sharding(spark, str(tmp_path)).collect()
    wanted = sorted(((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in small.collect()), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == wanted
    counts = Counter(r["shard"] for r in got)
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    assert max(counts.values()) - min(counts[i] for i in range(40)) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == i) == list(range(n)) for i, n in counts.items())


def test_op1_query(spark, small, tmp_path):
    from graphwright.llm import queries

    small.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op1_mixing(spark, str(tmp_path)).collect()
    assert sorted(((r["doc_id"], r["size"]) for r in got), key=str) == sorted(((r["doc_id"], len((r["text"] or "").encode().split())) for r in small.collect()), key=str)
    assert all(0 <= r["taken"] <= 3 * r["size"] <= 3 * r["source_size"] for r in got)


def test_running_sums_are_planned_in_small_pieces(spark):
    from graphwright.llm import common, ranks

    rows = spark.range(200).selectExpr("id as at", "id % 7 as file", "cast(id % 3 as string) as source", "xxhash64(id) as key")
    slim = common.table(rows, "test-slim")
    out = ranks.running_sum(slim, ["source"], ranks.hash_bucket(F.col("key")), ranks.key_order("key"), F.lit(1), "rank")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 4 and plan.count("Window") <= 2
    got = {}
    for r in out.collect():
        got.setdefault(r["source"], []).append((r["rank"], r["key"] % (1 << 64)))
    for pairs in got.values():
        assert [rank for rank, _ in sorted(pairs)] == list(range(len(pairs)))
        assert sorted(pairs) == sorted(pairs, key=lambda p: p[1])
