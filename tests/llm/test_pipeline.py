from __future__ import annotations

import re
from collections import Counter, defaultdict

import corpus_pipeline as cp
from graphwright.llm.common import word_count
from pyspark.sql import functions as F


def folder(spark, tmp_path, small, make):
    import random

    rng = random.Random(11)
    leak = make(rng, 25)
    extra = spark.createDataFrame([(800, make(rng, 60) + " " + leak + " " + make(rng, 60), "en", "s1", 5)], small.schema)
    small.unionByName(extra).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages(spark, tmp_path, small, make):
    where = folder(spark, tmp_path, small, make)
    docs = spark.read.parquet(f"{where}/documents.parquet")
    columns, ids = docs.columns, {}
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, where)
        docs.write.parquet(f"{where}/{re.sub('[^a-z]', '', name)}")
        docs = spark.read.parquet(f"{where}/{re.sub('[^a-z]', '', name)}")
        ids[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
        if name != "sharding":
            assert docs.columns == columns
    assert docs.columns == [*columns, "shard", "slot"]
    assert 0 in ids["quality rules"] and 53 not in ids["quality rules"]
    assert 0 in ids["near-duplicates"] and not {1, 2, 3} & set(ids["near-duplicates"])
    assert 800 in ids["near-duplicates"] and set(ids["near-duplicates"]) - set(ids["decontamination"]) == {800}
    assert sorted(map(str, ids["mixing"])) == sorted(map(str, ids["sharding"]))
    assert [n for n, _ in cp.STAGES] == ["quality rules", "near-duplicates", "decontamination", "mixing", "sharding"]


def test_run_is_the_stages_together(spark, tmp_path, small, make):
    where = folder(spark, tmp_path, small, make)
    out = cp.run(spark, where)
    assert out.agg(F.count_distinct("shard")).first()[0] <= cp.N_SHARDS
    assert out.where(word_count(F.col("text")) == 0).isEmpty()


def brute_run(rows, leaks):
    """doc_ids after the first three stages, from the definitions: base rules (too few labels certify more), similarity of word shingles, passages."""
    words = lambda text: (text or "").lower().encode().split()
    shingles = lambda w: [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []

    def good(w):
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        return len(w) >= 50 and 100 * len(covered) <= 50 * len(w)

    left = [(d, t) for d, t in rows if good((t or "").encode().split())]
    sets, root = [frozenset(shingles(words(t))) for _, t in left], list(range(len(left)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, t) in enumerate(left):
        groups[find(i)].append((d is None, d, t))
    left = [min(g, key=lambda x: (x[0], x[1] or 0)) for g in groups.values()]

    def leaked(text):
        w = shingles(words(text))
        for leak in leaks:
            bag = Counter(shingles(words(leak)))
            k = sum(bag.values())
            for a in range(max(1, len(w) - k + 1)):
                own = Counter(w[a : a + k])
                both = sum((own & bag).values())
                if both >= 0.8 * (sum(own.values()) + k - both):
                    return True
        return False

    return [d for _, d, t in left if not leaked(t)]


def test_run_agrees_with_brute_force(spark, tmp_path, small, make):
    """Which documents are left, how much of each source the mix takes, and the shards' law."""
    where = folder(spark, tmp_path, small, make)
    docs = spark.read.parquet(f"{where}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    left = brute_run(rows, [spark.read.parquet(f"{where}/benchmark.parquet").first()["text"]])
    out = cp.run(spark, where).collect()
    assert len(left) == len(set(left)) and {r["doc_id"] for r in out} <= set(left)
    source, size = {}, Counter()
    for r in docs.collect():
        if r["doc_id"] in set(left):
            source[r["doc_id"]] = r["source"]
    for d, t in dict(rows).items():
        if d in source:
            size[source[d]] += len(t.encode().split())
    order = sorted(size, key=lambda x: (x is None, x or ""))
    target, free, rest = {}, dict(zip(order, [5, 2, 1] * len(order), strict=False)), float(sum(size.values()))
    while free:
        share = rest / sum(free.values())
        over = [x for x, w in free.items() if w * share > 3 * size[x]]
        for x in over or list(free):
            target[x] = float(3 * size[x]) if over else free[x] * share
            rest -= target[x]
            del free[x]
    taken = Counter()
    for r in out:
        taken[r["source"]] += len(r["text"].encode().split())
    assert all(abs(taken[x] - target[x]) <= 1 for x in order)
    counts = Counter(r["shard"] for r in out)
    assert max(counts.values()) - min(counts[i] for i in range(40)) <= 1
    assert all(sorted(r["slot"] for r in out if r["shard"] == i) == list(range(n)) for i, n in counts.items())


def test_stages_keep_values_and_take_empty_tables(spark, tmp_path, clashing, empty, make, same_rows):
    """Clashing names, null and repeated doc_ids, null texts; and no rows at all."""
    where = folder(spark, tmp_path, empty, make)
    for name, stage in cp.STAGES:
        docs = stage(spark, empty, where)
        assert docs.count() == 0 and docs.columns[: len(empty.columns)] == empty.columns
        if name in ("quality rules", "near-duplicates", "decontamination"):
            out = stage(spark, clashing, where)
            assert out.columns == clashing.columns
            left, right = out.drop("text").distinct(), clashing.drop("text").distinct()
            assert left.exceptAll(right).isEmpty() and not left.isEmpty()
    assert same_rows(cp.STAGES[-1][1](spark, clashing, where).drop("shard", "slot"), clashing)


def test_stages_read_as_files(spark, tmp_path, small, make):
    """A repeated document counts once from the second stage on; every later row stands in exactly one shard."""
    where = folder(spark, tmp_path, small, make)
    docs = spark.read.parquet(f"{where}/documents.parquet").unionByName(small.where("doc_id = 0"))
    kept = cp.near_dedup(spark, cp.quality_rules(spark, docs, where), where)
    assert [r["doc_id"] for r in kept.where("doc_id in (0, 1, 2, 3)").collect()] == [0]
    dealt = cp.shard(spark, kept, where)
    assert dealt.count() == kept.count() == dealt.select("shard", "slot").distinct().count()
