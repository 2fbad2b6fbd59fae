from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from graphwright.llm import decontaminate, linededup, lm, neardup, quality, secretscan
from graphwright.llm import textvec as tv


def lower_words(text):
    return (text or "").encode().lower().split()


# --- near-duplicates ----------------------------------------------------------


def brute_groups(rows, percent):
    sets = []
    for doc_id, text in rows:
        w = lower_words(text)
        sets.append((doc_id, frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()))
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(sets):
        least[find(i)].append(d)
    out = []
    for i, (d, s) in enumerate(sets):
        known = [x for x in least[find(i)] if x is not None]
        out.append((d, len(s), min(known) if known else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(small, percent):
    got = neardup.near_duplicates(small, percent).collect()
    rows = [(r["doc_id"], r["text"]) for r in small.collect()]
    assert sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got], key=str) == brute_groups(rows, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_near_copies(spark, make):
    """A chain of changed copies: links between neighbours join ends that are no links themselves."""
    rng = random.Random(8)
    rows = []
    for g in range(6):
        text = make(rng, 150).split(" ")
        for i in range(20):
            rows.append((100 * g + i, " ".join(text)))
            text[rng.randrange(len(text))] = make(rng, 1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(df, 85).collect()
    assert sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got], key=str) == brute_groups(rows, 85)


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(12)
    common = rng.integers(-(2**63), 2**63, 40)
    frequent = np.sort(common)
    rank = rng.permutation(40)
    for known in (frequent, frequent[:0]):
        for _ in range(300):
            n = int(rng.integers(1, 60))
            pool = np.unique(np.concatenate((rng.choice(common, 20, replace=False), rng.integers(-(2**63), 2**63, n))))
            a, b = (np.sort(pool[rng.random(len(pool)) < 0.93]) for _ in range(2))
            both = len(np.intersect1d(a, b))
            if len(a) and 100 * both >= 80 * (len(a) + len(b) - both):
                assert np.intersect1d(neardup.prefix(a, known, rank[: len(known)], 80), neardup.prefix(b, known, rank[: len(known)], 80)).size


def test_crowded_keys(spark, make, monkeypatch):
    """Many documents around one passage: their keys are crowded, few of them are linked, and no pairs but near ones are compared."""
    rng = random.Random(21)
    passage, rows = make(rng, 110), []
    for _ in range(700):
        rows.append((len(rows), passage + " " + make(rng, 30)))
    for i in range(0, 60, 2):
        w = rows[i][1].split(" ")
        w[rng.randrange(len(w))] = "changed"
        rows.append((len(rows), " ".join(w)))
    monkeypatch.setattr(neardup, "BLOCK", 32)
    split, made = neardup._split, []

    def counted(members, sets, percent):
        out = split(members, sets, percent)
        made.append((members.count(), out.selectExpr("sum(blocks)").first()[0] or 0))
        return out

    monkeypatch.setattr(neardup, "_split", counted)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got], key=str) == brute_groups(rows, 85)
    members, dealt = made[0]
    assert members > 600 and dealt < members


@pytest.mark.parametrize(("block", "block_shingles"), [(512, 1 << 20), (8, 1 << 20), (512, 2000)])
def test_crowds_give_forests(spark, make, monkeypatch, block, block_shingles):
    """Changed copies of one text, most of them near the threshold: what a block gives grows with its nodes, not with their pairs."""
    rng = random.Random(23)
    text, rows = make(rng, 200).split(" "), []
    for _ in range(200):
        copy = list(text)
        for at in rng.sample(range(len(text)), rng.choice([1, 2, 2, 3, 3, 3])):
            copy[at] = make(rng, 1)
        rows.append((len(rows), " ".join(copy)))
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", block_shingles)
    table, made = neardup.table, []

    def counted(df, name):
        out = table(df, name)
        if name == "more":
            made.append(out.count())
        return out

    monkeypatch.setattr(neardup, "table", counted)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got], key=str) == brute_groups(rows, 85)
    assert len(made) == 1 and made[0] < 2 * len(rows)


def test_sets_at_the_threshold():
    rng = np.random.default_rng(3)
    for _ in range(50):
        pool = np.unique(rng.integers(0, 2**64, 60, dtype=np.uint64))
        one, *others = (pool[rng.random(len(pool)) < 0.9] for _ in range(6))
        others[0] = one
        for percent in (80, 85):
            want = [100 * (n := len(np.intersect1d(one, x))) >= percent * (len(one) + len(x) - n) for x in others]
            assert neardup._at_threshold(one, others, percent).tolist() == want


def test_keep_first_decides_by_row(spark, make):
    rng = random.Random(22)
    a, b, c = (make(rng, 80) for _ in range(3))
    rows = [(5, a), (7, b), (7, a), (None, b), (None, c), (None, c), (9, ""), (9, None), (5, a)]
    left = neardup.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, left), key=str) == sorted([(5, a), (7, b), (None, c), (9, ""), (9, None)], key=str)


def test_near_duplicates_edges(small, empty, clashing):
    assert neardup.near_duplicates(empty).count() == 0 and neardup.keep_first(empty).count() == 0
    left = neardup.keep_first(clashing)
    assert left.columns == clashing.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert 1 not in ids and 2 not in ids and ids.count(4) == 1 and 0 in ids and None in ids
    assert left.join(clashing, left.columns, "left_anti").where("doc_id is not null and text is not null and lang is not null and source is not null").isEmpty()


def test_registers_and_estimate():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    c = neardup.compressed(x)
    for v, r in zip(x.tolist(), c.tolist(), strict=True):
        zeros = 64 - v.bit_length()
        assert r >> neardup.MANTISSA == zeros
    for share in (0.5, 0.8, 0.95):
        common = rng.integers(0, 2**64, int(3000 * share), dtype=np.uint64)
        a, b = (np.concatenate((common, rng.integers(0, 2**64, (3000 - len(common)) // 2, dtype=np.uint64))) for _ in range(2))
        ra, rb = (neardup._registers(s, np.array([0, len(s)]))[0] for s in (a, b))
        j = len(common) / (len(common) + (3000 - len(common)) // 2 * 2)
        assert abs(neardup.similarity_estimate((ra == rb).sum()) - j) < 4 * (j * (1 - j) / neardup.REGISTERS) ** 0.5 + 0.01


def test_word_hashes_do_not_depend_on_place():
    texts = ["Some WORDS here", "x some words\there y", "", None, "éè some"]
    data, offsets = tv.buffers(pa.array(texts))
    starts, ends, by_doc = tv.word_bounds(data, offsets)
    h = tv.word_hashes(data, starts, ends)
    assert list(np.diff(by_doc)) == [3, 5, 0, 0, 2]
    assert list(h[:3]) == list(h[4:7]) and h[9] == h[0] and len(set(h.tolist())) == 6


# --- decontamination -----------------------------------------------------------


def test_decontamination(spark, make):
    rng = random.Random(4)
    items = [(i, make(rng, rng.randint(12, 50))) for i in range(30)] + [(90, "tiny item"), (91, None), (92, ""), (93, "  ")]
    rows = []
    for i in range(40):
        text = make(rng, 80).split(" ")
        if i % 4 == 0:
            item = items[i % 30][1].split(" ")
            if i % 8 == 0:
                item[len(item) // 2] = "other"
            text[40:40] = item
        rows.append((i, " ".join(text)))
    rows += [(50, items[3][1]), (51, None), (52, ""), (53, "a tiny item here"), (54, items[5][1].upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminated(docs, bench).collect()}
    expected = brute_matches(rows, items)
    assert got.keys() == expected.keys()
    assert all(abs(got[k] - expected[k]) < 1e-9 for k in got)
    clean = decontaminate.keep_clean(docs, bench)
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in expected}
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0


def test_matches_do_not_depend_on_slices(spark, make, clashing, same_rows, monkeypatch):
    """Items with a preamble in common, copies with a word changed, short items, items without id, repeated rows."""
    rng = random.Random(14)
    preamble = make(rng, 40)
    items = [(i, preamble + " " + make(rng, 20)) for i in range(24)] + [(None, make(rng, 30)), (90, "tiny item"), (91, "tiny item"), (90, "tiny item")]
    rows = []
    for k in range(41, 59):
        w = items[k - 41][1].split(" ")
        w[k] = "other"
        rows.append((k, make(rng, 30) + " " + " ".join(w) + " " + make(rng, 30)))
    rows += [(100, "a " + items[24][1] + " b"), (101, "is a tiny item too"), (101, "is a tiny item too"), (102, make(rng, 90))]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    wanted = None
    for n in (4096, 20, 1):
        monkeypatch.setattr(decontaminate, "SLICE_ITEMS", n)
        got = sorted(map(str, decontaminate.contaminated(docs, bench).collect()))
        left = sorted(r["doc_id"] for r in decontaminate.keep_clean(docs, bench).collect())
        wanted = wanted or (got, left)
        assert (got, left) == wanted
        if n == 20:
            assert {100, 101}.isdisjoint(left) and 102 in left and sum("doc_id=101" in x for x in got) == 4
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect() if r["doc_id"] < 100} == {k for k in brute_matches(rows[:18], items[:27])}
    assert same_rows(decontaminate.keep_clean(clashing, bench), clashing)


def test_windows_at_the_threshold(make):
    """Recall of the search among windows that reach the threshold, by full comparison, and no match below it."""
    rng = random.Random(15)
    items = [make(rng, rng.randint(30, 80)) for _ in range(60)]
    index = decontaminate.Index(list(range(60)), items, decontaminate.Weights(60, np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    texts = []
    for item in items * 8:
        w = item.split(" ")
        for k in rng.sample(range(len(w)), max(1, len(w) // 50)) if rng.random() < 0.7 else rng.sample([0, 1, 2, 3, len(w) - 1, len(w) - 2], 3):
            w[k] = "other"
        texts.append(make(rng, 40) + " " + " ".join(w) + " " + make(rng, 40))
    found = {(r, i) for r, i, *_ in decontaminate.search(index, pa.array(texts))}
    wanted = {(r, r % 60) for r, text in enumerate(texts) if brute_matches([(0, text)], [(0, items[r % 60])])}  # no two items share a shingle
    assert found <= wanted and len(wanted) > 150 and len(found) >= 0.97 * len(wanted)


def test_very_long_text(make):
    """Half a million words, items at both ends and in the middle; long stretches are summed bit by bit."""
    import tracemalloc

    rng = random.Random(16)
    some = make(rng, 20000).split(" ")
    words = (some * 25)[:500_000]
    item, long_item = make(rng, 40), make(rng, 20000)
    for at in (0, 250_000, len(words) - 40):
        words[at : at + 40] = item.split(" ")
    words[300_000:320_000] = long_item.split(" ")
    text = pa.array([" ".join(words), "x" * 3_000_000 + " " + item], pa.large_string())
    index = decontaminate.Index([1, 2], [item, long_item], decontaminate.Weights(2, np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    tracemalloc.start()
    found = [(r, i, s) for r, i, s, *_ in decontaminate.search(index, text)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(0, 0, 1.0), (0, 1, 1.0), (1, 0, 1.0)] and peak < 200 << 20


def test_hashes_of_long_words_are_those_of_their_bytes():
    text = "a" * 100 + "bc" * ((tv.STEP_BYTES >> 1) + 7) + "D"
    data, offsets = tv.buffers(pa.array([text, text.lower(), text[:-1]]))
    h = tv.word_hashes(data, *tv.word_bounds(data, offsets)[:2])
    whole = sum(int(tv._FOLDED[b]) * pow(tv._BASE, i, 1 << 64) for i, b in enumerate(text.encode())) % (1 << 64)
    assert h[0] == h[1] == tv.mix(np.array([whole], np.uint64))[0] != h[2]


def brute_matches(rows, items):
    shingles = lambda w: [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else []
    own = {i: lower_words(t) for i, t in items if t is not None}
    spread = Counter(g for w in own.values() for g in set(shingles(w)))
    n = len(own)
    weight = lambda g: max(1, round(16 * math.log2(1 + n / spread[g]))) if g in spread else round(16 * math.log2(1 + n))
    out = {}
    for d, text in rows:
        w = lower_words(text)
        s = shingles(w)
        for i, item in own.items():
            if not item or not w:
                continue
            if len(item) < 5:
                if any(w[a : a + len(item)] == item for a in range(len(w))):
                    out[d, i] = 1.0
                continue
            bag, k, best = Counter(shingles(item)), len(item) - 4, 0
            for a in range(max(1, len(w) - len(item) + 1)):
                win = Counter(s[a : a + k])
                both = sum(min(win[g], bag[g]) * weight(g) for g in win)
                whole = sum(x * weight(g) for c in (win, bag) for g, x in c.items()) - both
                best = max(best, both / whole)
            if best >= 0.8:
                out[d, i] = best
    return out


# --- secrets --------------------------------------------------------------------


def test_base_spans(small, empty, clashing):
    import re

    patterns = [
        (re.compile(r"(password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), lambda m: len(m[2]) >= 6),
        (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ]
    expected = []
    for r in small.collect():
        spans = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(patterns) for m in p.finditer(r["text"] or "") if ok(m))
        joined = ",".join(f"{secretscan.KINDS[k]}:{a}:{z}" for a, k, z in spans)
        kinds = [k for _, k, _ in spans]
        expected.append((r["doc_id"], kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(joined.encode()).hexdigest()))
    for docs in (small, clashing):
        rows = secretscan.scan(docs).collect()
        got = [(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in rows]
        assert sorted(got, key=str) == sorted(expected, key=str)
        for r in rows:
            spans = [x for x in r["spans"].split(",") if x]
            assert len(spans) == r["n_assign"] + r["n_access"] + r["n_hex"] + r["n_crf"]
    assert secretscan.scan(empty).count() == 0


def test_crf_learns_and_pruned_decoding_is_exact(spark, make):
    rng = random.Random(2)
    secret = lambda n: "".join(rng.choice("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOP") for _ in range(n))
    texts = []
    for i in range(300):
        w = make(rng, 60).split(" ")
        if i % 2:
            w.insert(rng.randrange(50), rng.choice(["password=", "token = ", "api_key: "]) + secret(18))
        if i % 3 == 0:
            w.insert(rng.randrange(50), rng.choice(["4711", "12.5", "Monday", "x-ray"]))
        texts.append(" ".join(w))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:200])], "doc_id long, text string")
    scanner = secretscan.Scanner(secretscan.train(docs))
    hit = miss = wrong = 0
    for text in texts[200:]:
        raw = text.encode()
        words = raw.split()
        got = scanner.spans(raw, words, tv.word_bounds(*tv.buffers(pa.array([text])))[0], scanner.open_words(set(words)))
        tokens = [t for m in secretscan._WORD.finditer(text) for t in secretscan._TOKEN.finditer(text, m.start(), m.end())]
        tags = scanner.crf.decode(secretscan._feature_rows([t[0] for t in tokens], [], "none", secretscan.file_features(raw)))
        whole = []
        for k, (t, tag) in enumerate(zip(tokens, tags, strict=True)):
            if tag == secretscan.I and k and tags[k - 1] != secretscan.O and whole:
                whole[-1] = (whole[-1][0], 3, t.end())
            elif tag != secretscan.O:
                whole.append((t.start(), 3, t.end()))
        assert whole == got
        base = secretscan.base_spans(text)
        found = sum(any(g[0] < z and a < g[2] for g in got) for a, _, z in base)
        hit, miss = hit + found, miss + len(base) - found
        wrong += sum(not any(a < g[2] and g[0] < z for a, _, z in base) for g in got)
    assert hit / max(1, hit + miss) >= 0.9 and wrong <= 5


def test_crf_finds_secrets_that_no_pattern_knows(spark, make):
    """Held-out texts with forms that the patterns do not match; and texts with numbers, hashes and plain keywords, which hold none."""
    rng = random.Random(77)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    docs = spark.createDataFrame([(i, make(rng, 80) + rng.choice([" password=abcd1234efgh", " 17 of 20", ""])) for i in range(400)], "doc_id long, text string")
    forms = ["credential: {}", "bearer {}", "private_key = {}", "pwd={}", "passphrase is {}", "ghp_{}", 'client credential "{}"', "auth: {}", "the admin credential was {}", "Authorization: Bearer eyJ{}"]
    harmless = ["commit 3f2a91c", "version 2.14.3 of it", "the password is stored", "on 2024-03-11 at 10:30", "token: none", "invoice_2023_final.pdf", "a credential was missing", "room 12b", "id=AB123", "x = 4711"]
    rows, secrets = [], {}
    for i in range(300):
        w = make(rng, 70).split(" ")
        if i < 200:
            value = "".join(rng.choice(letters) for _ in range(rng.randint(18, 36))) + "7k"
            phrase = forms[i % 10].format(value)
            secrets[i] = value
        else:
            phrase = harmless[i % 10]
        w.insert(rng.randrange(1, 69), phrase)
        rows.append((i, " ".join(w)))
    texts = dict(rows)
    got = secretscan.scan(spark.createDataFrame(rows, "doc_id long, text string"), secretscan.train(docs)).collect()
    assert all(r["n_assign"] + r["n_access"] + r["n_hex"] == 0 for r in got)
    found = wrong = 0
    for r in got:
        cut = [texts[r["doc_id"]][int(a) : int(z)] for _, a, z in (x.split(":") for x in r["spans"].split(",") if x)]
        own = secrets.get(r["doc_id"])
        found += any(own in x for x in cut) if own else 0
        wrong += sum(not own or own not in x for x in cut)
    assert found >= 0.9 * len(secrets) and wrong <= 0.1 * found


# --- language models ------------------------------------------------------------


def test_lm_scores(small, empty, clashing):
    rows = [(r["doc_id"], lower_words(r["text"])) for r in small.collect()]
    held = lambda d: zlib.crc32(str(d).encode() if d is not None else b"") % 5 == 1
    counts = Counter(w for d, ws in rows if not held(d) for w in ws)
    n_docs = sum(not held(d) for d, _ in rows)
    n, v = sum(counts.values()) + n_docs, len(counts) + 1
    p = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    expected = sorted(((d, held(d), len(w) + 1, sum(counts[x] > 0 for x in w) + 1, n, round(sum(p(counts[x]) for x in w) + p(n_docs), 5)) for d, w in rows), key=str)
    for docs in (small, clashing):
        got = lm.score(docs).collect()
        assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got), key=str) == expected
        assert all(r["score"] < 0 for r in got)
    assert lm.score(empty).count() == 0


def test_lattice_sums_over_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "<0xC3>", "<0xA9>"]
    logs = np.log(np.array([0.1, 0.2, 0.1, 0.15, 0.05, 0.2, 0.1, 0.1]))
    table = dict(zip(pieces[:6], logs[:6], strict=True))

    def total(text):
        if not text:
            return 1.0
        return sum(math.exp(table[text[:k]]) * total(text[k:]) for k in range(1, len(text) + 1) if text[:k] in table)

    lattice = lm.Lattice(pieces, logs)
    for word in ("a", "ab", "abab", "bbaabab"):
        assert abs(lattice.score(word.encode()) - math.log(total("▁" + word))) < 1e-9
    assert abs(lattice.score("é".encode()) - (logs[0] + logs[6] + logs[7])) < 1e-9
    assert math.isfinite(lattice.score(b"ab" * 5000))


def test_lattice_prefers_text_of_its_kind(spark, make):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, make(rng, 200)) for i in range(60)] + [(1000, "zq jx vk wq " * 50)], "doc_id long, text string")
    rows = lm.score(docs).collect()
    per_char = lambda r, text: r["score"] / len(text)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    held = [per_char(r, texts[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] < 1000]
    odd = next(per_char(r, texts[1000]) for r in rows if r["doc_id"] == 1000)
    assert min(held) > odd


# --- lines and quality ------------------------------------------------------------


def test_line_report(small, empty, clashing):
    import duckdb

    copies = small.unionByName(small.where("source = 'site3'"))
    documents = copies.toArrow()  # noqa: F841 - read by the SQL
    con = duckdb.connect()
    con.register("documents", documents)
    expected = sorted(con.sql(linededup.REPORT_SQL).fetchall(), key=str)
    got = linededup.line_report(copies).select("doc_id", "n_lines", "n_removed", "bytes_left")
    assert sorted(map(tuple, got.collect()), key=str) == expected and sum(r[2] for r in expected) == 13
    assert linededup.line_report(empty).count() == 0
    assert linededup.line_report(clashing).count() == clashing.count()
    left = linededup.remove_boilerplate(clashing)
    assert left.columns == clashing.columns and left.where("text like '%every single site%'").isEmpty()
    assert left.where("text is null").count() == small.where("text is null").count()


def test_salted_join_agrees(small, monkeypatch):
    plain = sorted(map(str, linededup.line_report(small).collect()))
    monkeypatch.setattr(linededup, "BROADCAST_ROWS", -1)
    assert sorted(map(str, linededup.line_report(small).collect())) == plain


def brute_quality(text):
    text = text or ""
    words = text.encode().split()
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.encode().strip()]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    n = len(words)
    return n, sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_counts(spark, small, empty, clashing):
    labels = spark.createDataFrame([(0, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    extra = spark.createDataFrame([(900, "a b c a b c a b c\nx y\nx y\n \n#$| z", "en", "s", 1), (901, "w " * 80, "en", "s", 1)], small.schema)
    docs = small.unionByName(extra)
    rows = quality.judge(docs, labels).collect()
    got = sorted(((r["doc_id"], *[r[c] for c in quality.COUNTS], r["base_failed"]) for r in rows), key=str)
    assert got == sorted(((r["doc_id"], *brute_quality(r["text"])) for r in docs.collect()), key=str)
    assert all(r["kept"] == (not r["base_failed"]) for r in rows)  # too few labels to certify a cutoff
    assert quality.judge(empty, labels).count() == 0
    kept = quality.keep_good(clashing, labels)
    assert kept.columns == clashing.columns and kept.count() == sum(not brute_quality(r["text"])[-1] for r in small.collect())


def test_thresholds_hold_their_risk(spark, make):
    rng = random.Random(9)
    rows, marks = [], []
    for i in range(1500):
        w = make(rng, 60).split(" ")
        if i % 5 == 0:
            w = [x + "##|" for x in w]
        rows.append((i, " ".join(w), "en", "s", 1))
        marks.append((i, int(i % 5 != 0), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(docs, labels).collect()}
    assert all(kept[i] == bool(q) for i, q, _ in marks)


def test_exact_bound():
    assert abs(quality.upper_bound(0, 100, 0.05) - (1 - 0.05 ** (1 / 100))) < 1e-9
    assert quality.upper_bound(5, 5, 0.05) == 1.0
    p = quality.upper_bound(3, 50, 0.01)
    tail = sum(math.comb(50, i) * p**i * (1 - p) ** (50 - i) for i in range(4))
    assert abs(tail - 0.01) < 1e-9
    assert quality.certified([0, 0, 40], 1000, 0.01, 0.02) == 2 and quality.certified([1], 5, 0.05, 0.05) == 0


def test_repeated_labels_are_one_label(spark, make):
    """Copies of a table, and copies under other ids, certify no more than the table itself."""
    rng = random.Random(21)
    rows = [(i, make(rng, 80) + (" #" * 60 if i % 2 else ""), "en") for i in range(60)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)] + [(1000 * k + i, 1 - i % 2) for k in range(1, 8) for i in range(60)], "doc_id long, quality int")
    docs = lambda x: spark.createDataFrame(x, "doc_id long, text string, lang string")
    cuts = lambda x: sorted(map(str, quality.fit(quality.feature_table(docs(x)), labels).collect()))
    once = cuts(rows)
    assert cuts(rows * 8) == once
    assert quality.judge(docs(rows * 8), labels).where("kept").count() == 8 * quality.judge(docs(rows), labels).where("kept").count()
    again = [(1000 * k + i, t, lang) for k in range(1, 8) for i, t, lang in rows]
    assert cuts(rows + again) == once


def test_cutoffs_are_those_of_brute_force(spark, make):
    """Two languages, overlapping features, some good documents with symbols, unlabelled rows, a language of few labels."""
    rng = random.Random(19)
    rows, marks = [], []
    for i in range(900):
        bad = rng.random() < 0.3
        w = make(rng, 60).split(" ")
        for k in rng.sample(range(60), rng.randint(10, 60) if bad else rng.choice([0, 0, 0, 0, 0, 0, 0, 30])):
            w[k] += "#"
        if bad and i % 2:
            w += [w[0] + "\n"] + ["same line of it\n"] * 5
        rows.append((i, " ".join(w), ["en", "fr", None][i % 3] if i < 890 else "xx"))
        if i % 10:
            marks.append((i, int(not bad), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    feats = quality.feature_table(docs).selectExpr("*", f"{quality._PART} AS part").collect()
    marks = {d: q for d, q, _ in marks}
    judged = {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}
    own = [r for r in feats if r["doc_id"] in marks and not judged[r["doc_id"]]["base_failed"]]
    strata = {r["lang"] for r in own if not r["part"]}
    cuts = {}
    for lang in strata:
        fitted = [r for r in own if r["part"] and r["lang"] == lang]
        path = quality.steps(np.array([[r[x] for x in quality.RULES] for r in fitted]).reshape(-1, len(quality.RULES)), np.array([marks[r["doc_id"]] for r in fitted]))
        good = [r for r in own if not r["part"] and r["lang"] == lang and marks[r["doc_id"]] == 1]
        for n in range(1, len(path) + 1):
            k = sum(any(r[quality.RULES[rule]] >= cut for rule, cut in path[:n]) for r in good)
            if sum(math.comb(len(good), i) * 0.05**i * 0.95 ** (len(good) - i) for i in range(k + 1)) > 0.05 / len(strata):
                break
            cuts[lang] = path[:n]
    assert any(cuts.get(x) for x in ("en", "fr", None)) and not cuts.get("xx")
    for r in feats:
        wanted = not judged[r["doc_id"]]["base_failed"] and not any(r[quality.RULES[rule]] >= cut for rule, cut in cuts.get(r["lang"], []))
        assert judged[r["doc_id"]]["kept"] == wanted
    assert sum(not judged[i]["kept"] for i, q in marks.items() if not q) > 0.5 * sum(not q for q in marks.values())
    kept = quality.keep_good(docs, labels)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in judged.items() if r["kept"]}


@pytest.mark.parametrize("name", ["op2_decontamination", "op3_secret_scans", "op5_token_output", "op6_lm_scoring", "op8_quality_rules", "op9_token_counts", "op10_minhash_near_dedup"])
def test_registered_queries(spark, small, tmp_path, name):
    """The columns that each query promises, with one row per row of the table where it promises that."""
    from graphwright.llm import queries

    small.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, small.where("doc_id = 5").first()["text"])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = queries.queries()[name](spark, str(tmp_path))
    wanted = {
        "op2_decontamination": "doc_id bigint, item_id bigint", "op3_secret_scans": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
        "op5_token_output": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint", "op6_lm_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
        "op8_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
        "op9_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean", "op10_minhash_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    }[name]
    assert {tuple(x.split(" ")) for x in wanted.split(", ")} <= set(out.dtypes)
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    if name == "op2_decontamination":
        assert ids == [5]
    else:
        assert sorted(map(str, ids)) == sorted(str(r["doc_id"]) for r in small.collect())
