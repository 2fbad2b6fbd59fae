"""Prefix trie, packing and hard negatives against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphwright.llm import negatives, packing, tokens, trie

# --- conversations --------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"


def brute_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5((f"{len(role)}:{role}{text}").encode()).hexdigest()
            turns[c].append(((turn is not None, turn or 0, role, key), (role, text)))
    turns = {c: [x for _, x in sorted(t)] for c, t in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole = tuple(turns.get(c - c % 20, [])[:h] + own[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = {}

    def visit(node):
        leaves, saved = 0, (len(members[node]) - 1) * (len(node[-1][1].split()) if node else 0)
        for child in children[node]:
            more, further = visit(child)
            leaves, saved = leaves + more, saved + further
        leaves = leaves or 1
        parent = min(members[node[:-1]]) if node else None
        text = ",".join(map(str, sorted(ends[node])))
        out[min(members[node]), len(node)] = (parent, len(members[node]), len(children[node]), leaves, saved, hashlib.sha256(text.encode()).hexdigest())
        return leaves, saved

    if members:
        visit(())
    return out


def trie_rows(df):
    out = {}
    for r in trie.prefix_trie(df).collect():
        assert (r["conv_id"], r["depth"]) not in out
        out[r["conv_id"], r["depth"]] = tuple(r[c] for c in ("parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))
    return out


@pytest.fixture
def many_blocks(spark):
    """Small tables are dealt to as many blocks as there are shuffle partitions."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    yield
    for k, x in old.items():
        spark.conf.set(k, x)


def family_turns(rng, n, alphabet, most):
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, most)):
            rows.append((c, t, rng.choice(["user", "bot"][: rng.randint(1, 2)]), rng.choice(alphabet)))
    return rows


@pytest.mark.parametrize(("seed", "alphabet", "most"), [(1, ["a b", "c"], 5), (2, ["x y z"], 9), (3, ["p", "q", "r s", ""], 3)])
def test_trie_over_many_blocks(spark, many_blocks, seed, alphabet, most):
    rows = family_turns(random.Random(seed), 130, alphabet, most)
    assert trie_rows(spark.createDataFrame(rows, TURNS)) == brute_trie(rows)


def test_trie_of_copies_long_conversations_and_odd_rows(spark):
    rng = random.Random(4)
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 400, 2) for t in range(3)]
    rows += [(1001, t, "user", "hi" if t < 300 else f"x{t}") for t in range(700)]
    rows += [(1003, t, "user", "hi" if t < 300 else f"y{t}") for t in range(500)]
    rows += [(1005, None, "user", "first"), (1005, 7, None, None), (1005, 7, "user", "tie"), (1005, 7, "user", "tie"), (1007, 0, "", "é  ß\n漢字 word"), (None, 0, "user", "none"), (1009, 2, "user", "w " * 5000)]
    rows += [(20 * 60, 0, "user", "only"), (20 * 60 + 3, 0, "user", "short")]
    rng.shuffle(rows)
    extra = spark.createDataFrame([(*r, 5, "x") for r in rows], TURNS + ", pos long, k string")
    assert trie_rows(extra) == brute_trie(rows)


def test_trie_of_nothing_and_of_one(spark):
    assert trie_rows(spark.createDataFrame([], TURNS)) == {}
    for rows in ([(0, 0, "user", "a")], [(40, 1, None, None), (40, 1, None, None)], [(61, 0, "u", "gone")]):
        assert trie_rows(spark.createDataFrame(rows, TURNS)) == brute_trie(rows)


def test_lists_of_a_group_do_not_change_its_hash(spark, many_blocks, monkeypatch):
    monkeypatch.setattr(trie, "LIST_TEXT", 10)
    rows = [(c, "k", [1]) for c in range(500)] + [(1000, "other", [1])]
    got = {r["conv_id"]: (r["copies"], r["ends"]) for r in trie.copies(spark.createDataFrame(rows, "conv_id long, k string, words array<long>")).collect()}
    text = ",".join(map(str, range(500)))
    assert got == {0: (500, hashlib.sha256(text.encode()).hexdigest()), 1000: (1, hashlib.sha256(b"1000").hexdigest())}


# --- packing ----------------------------------------------------------------------


def packed(df, **x):
    return packing.pack(df, with_ids=True, **x)


@pytest.mark.parametrize("length", [64, 100, 2048])
def test_pieces_hold_every_id_once(small, clashing, length):
    t = tokens.tokenizer(tokens.public_path("word_bpe_49k.json"))
    wanted = sorted(str((r["doc_id"], [*t.encode(r["text"] or "", add_special_tokens=False).ids, 1])) for r in small.collect())
    for docs in (small, clashing) if length == 64 else (small,):
        pieces = packed(docs, length=length)
        rows = sorted(pieces.collect(), key=lambda r: (r["sequence_id"], r["offset"]))
        # a document's pieces follow each other in the stream
        got, open_doc = [], None
        for r in rows:
            if r["start"] == 0:
                open_doc = (r["doc_id"], [])
                got.append(open_doc)
            assert open_doc[0] == r["doc_id"] and len(open_doc[1]) == r["start"]
            open_doc[1].extend(r["ids"])
            assert len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
            assert r["doc_tokens"] >= r["start"] + r["length"]
        assert sorted(str((d, ids)) for d, ids in got) == wanted
        sizes = defaultdict(int)
        for r in rows:
            assert r["offset"] == sizes[r["sequence_id"]]
            sizes[r["sequence_id"]] += r["length"]
        assert sorted(sizes) == list(range(len(sizes)))
        n = [sizes[i] for i in range(len(sizes))]
        full = sum(n) // length
        assert n[:full] == [length] * full and all(x & (x - 1) == 0 for x in n[full:]) and n[full:] == sorted(set(n[full:]), reverse=True)
        if length == 2048:
            whole = {r["sequence_id"]: list(r["ids"]) for r in packing.sequences(pieces).collect()}
            assert {i: len(x) for i, x in whole.items()} == dict(sizes)


def test_packing_of_nothing_and_of_any_split(spark, small, empty, same_rows, tmp_path, monkeypatch):
    assert packing.pack(empty).count() == 0
    small.repartition(3).sortWithinPartitions("doc_id").write.option("parquet.block.size", 4096).parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    whole = packing.pack(docs, 128)
    monkeypatch.setattr(packing, "SEGMENT_BITS", 3)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        assert same_rows(whole, packing.pack(docs, 128))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_runs_agree_with_the_library():
    t = tokens.tokenizer(tokens.public_path("word_bpe_49k.json"))
    rng = random.Random(6)
    e = packing.Runs("word_bpe_49k.json")
    parts = ["Word", "don't", "it's.", "É", "J̌", "J", "ß,", "a.b", "12.", "x1,", "…", ".", ",,", "<|ENDOFTEXT|>", "<|endoftext|>", "漢字.", "İ", "K", "ﬁne", "ＡＢ", "́", "naïve,", "ÿ.", "×.", "aͅ", "q" * 90, "Q" * 90 + ".", " ", "é" * 70]
    texts = ["".join(rng.choice([" ", " ", "\n", "", "\t "]) + rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    for batch in (texts[:700], texts[700:], texts[:5]):
        ids, cuts = e.texts(pa.array(["before", *batch]).slice(1))
        got = [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        assert got == [t.encode(x, add_special_tokens=False).ids for x in batch]


# --- hard negatives ---------------------------------------------------------------

VECTORS = "vec_id long, label int, embedding array<float>"


def brute_negatives(rows, every=50, n_positives=5, n_negatives=3):
    points = {}
    for i, label, x in rows:
        if i is not None and label is not None and x is not None and all(c is not None and np.isfinite(c) for c in x):
            x = [int(np.floor(256 * float(np.float32(c)))) for c in x]
            points[i] = min(points.get(i, (label, x)), (label, x))
    width = max((len(x) for _, x in points.values()), default=0)
    m = {i: np.array(x + [0] * (width - len(x)), object) for i, (_, x) in points.items()}
    out = []
    for a in points:
        if a % every:
            continue
        score = {i: int((m[a] * m[i]).sum()) for i in points if i != a}
        same = sorted((i for i in score if points[i][0] == points[a][0]), key=lambda i: (-score[i], i))[:n_positives]
        other = sorted((i for i in score if points[i][0] != points[a][0]), key=lambda i: (-score[i], i))
        for p in same:
            hits = [i for i in other if 50 * score[p] <= 100 * score[i] <= 95 * score[p]][:n_negatives]
            out += [(a, p, rank, i, score[p], score[i]) for rank, i in enumerate(hits, 1)]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in negatives.hard_negatives(negatives.points(df), F.col("vec_id") % 50 == 0).collect())


@pytest.mark.parametrize(("n", "dims", "hot"), [(400, 64, 0.4), (260, 70, 0.1)])
def test_hard_negatives(spark, monkeypatch, n, dims, hot):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 64)
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", 3)
    rng = np.random.default_rng(n)
    centre = rng.normal(size=dims)
    rows = []
    for i in range(n):
        label = 3 if rng.random() < hot else int(rng.integers(0, 6))
        # few distinct values, so that scores tie
        x = np.round(centre + rng.normal(size=dims), 1) if i % 3 else np.round(centre)
        rows.append((i, label, x.astype(float).tolist()))
    got = mined(spark.createDataFrame(rows, VECTORS))
    assert got == brute_negatives(rows) and got


def test_hard_negatives_of_odd_rows(spark):
    rng = np.random.default_rng(9)
    rows = [(i, i % 3, rng.normal(size=8).tolist()) for i in range(120)]
    rows += [(None, 1, [1.0]), (200, None, [1.0]), (250, 1, None), (300, 1, [1.0, None]), (350, 1, [float("nan")]), (400, 1, [float("inf")]), (450, 1, []), (500, 2, [1e18, -1e18]), (51, 0, [2.0] * 11), rows[0], rows[50], (50, 0, [0.5] * 8)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], VECTORS + ", score long, shard int")
    assert mined(df) == brute_negatives([r for r in rows if not (r[2] and r[2][0] == 1e18)])
    assert mined(spark.createDataFrame([], VECTORS)) == []


def test_op13_query_is_its_contract(spark, tmp_path):
    from graphwright.llm import queries

    rng = np.random.default_rng(10)
    rows = [(i, int(rng.integers(0, 10)), rng.normal(size=33).tolist()) for i in range(300)]
    spark.createDataFrame(rows, VECTORS).write.parquet(str(tmp_path / "embeddings.parquet"))
    relabelled = [(i, (label + 1) % 10 if i % 7 == 0 else label, x) for i, label, x in rows]
    assert sorted(tuple(r) for r in queries.op13_hard_negatives(spark, str(tmp_path)).collect()) == brute_negatives(relabelled)


def test_tiles_stay_in_their_task(spark, monkeypatch):
    """Panels are shuffled, tiles are not; a tile is worked off in strips."""
    monkeypatch.setattr(negatives, "STRIP", 40)
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 3)), [float(x) for x in rng.normal(size=70).round(2)]) for i in range(1, 500)]
    df = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")
    out = negatives.hard_negatives(negatives.points(df), F.col("vec_id") % 50 == 0)
    assert sorted(tuple(r) for r in out.collect()) == brute_negatives(rows)
    plan = out._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "tile" not in plan
