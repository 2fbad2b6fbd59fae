"""The trie of conversations' prefixes, from the Cartesian tree of an LCP array.

Conversations are sequences of turns.  Distinct sequences are sorted (a turn
counts as a fixed-width key of its role and text), and L[i] is the number of
first turns that sequence i shares with the one before.  A node of the trie in
which sequences part is an interval of the order: between the nearest smaller
values of an L[i] to its left and right, equal values in one interval being one
node.  All nearest smaller values are found in parallel:

* each range of the sorted table is a block; a stack finds what lies within it,
  and leaves the values that look beyond, with the block's prefix and suffix
  minima as chains;
* the block minima (one number for each block) tell in which block such a value
  ends, and a join with that block's chain tells where;
* nodes with the same value and left end are merged, whichever block found them.

A node's numbers are differences of running sums at the two ends of its
interval; its least conversation comes from the pieces of its interval.  Depths
between a node and its parent, where no sequences part, are filled in at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphwright.llm.common import table, word_count

#: Hex digits of a turn's key.
KEY = 32
#: Conversations whose turns may come from another one, and how many may.
FAMILY, MOST_SHARED = 20, 4
#: A position in the order: block * STEP + place in the block.
STEP = 1 << 40
#: Characters of conv_ids that one row of a list has.
LIST_TEXT = 1 << 16
#: Stands for the least conversation of a node at a seam, which has no sequence of its own yet; more than any conv_id.
SEAM = (1 << 63) - 1
NO_ENDS = hashlib.sha256(b"").hexdigest()


def ranked_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0, by turn, null first), key, words of every turn; ties by role, then by the text's key.

    Rows are dealt by ranges of (conv_id, turn, ...), so a conversation may lie
    in several parts; its rows of later parts start where the earlier end.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), key.alias("key"), word_count(text).alias("words"))
    order = ["conv_id", "turn", "role", "key"]
    ranged = table(turns, "turns").repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "key", "words")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            ids = batch.column("conv_id").to_numpy(zero_copy_only=False)
            if not len(ids):
                continue
            begins = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            at = np.arange(len(ids)) - np.repeat(begins, np.diff(np.append(begins, len(ids))))
            at += held * (ids == last) if last is not None else 0
            last, held = ids[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(ids), part, np.int32)), pa.array(at, pa.int64())], names=["conv_id", "key", "words", "part", "at"])

    placed = table(ranged.mapInArrow(f, "conv_id long, key string, words long, part int, at long"), "ranked")
    counts = placed.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.withColumn("start", before).where("start is not null").select("conv_id", "part", "start")  # one row for each part at most
    joined = placed.join(F.broadcast(starts), ["conv_id", "part"], "left")
    return joined.select("conv_id", (F.col("at") + F.coalesce("start", F.lit(0))).alias("pos"), "key", "words")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, k (the turns' keys, joined), words (array) of every conversation after rebuilding.

    Conversation c takes the first h = crc32(c) % MOST_SHARED turns of
    conversation c - c % FAMILY, then its own turns behind its first h.
    """
    turns = table(ranked_turns(conversations), "pos")
    shared = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(MOST_SHARED))
    convs = turns.select("conv_id").distinct()
    first = turns.where((F.col("pos") < MOST_SHARED - 1) & (F.col("conv_id") % FAMILY == 0)).select(F.col("conv_id").alias("base"), "pos", "key", "words")
    heads = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(first, "base").where(F.col("pos") < shared)
    rows = heads.select("conv_id", F.lit(0).alias("own"), "pos", "key", "words").unionByName(turns.where(F.col("pos") >= shared).select("conv_id", F.lit(1).alias("own"), "pos", "key", "words"))
    rows = rows.unionByName(convs.select("conv_id", F.lit(-1).alias("own"), F.lit(0).cast("long").alias("pos"), F.lit("").alias("key"), F.lit(0).cast("long").alias("words")))
    x = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("own", "pos", "key", "words"))).alias("x"))
    return x.select("conv_id", F.array_join(F.transform("x", lambda e: e["key"]), "").alias("k"), F.slice(F.transform("x", lambda e: e["words"]), F.lit(2), F.size("x")).alias("words"))


def copies(sequences: DataFrame) -> DataFrame:
    """conv_id (the least), copies, ends (SHA-256 of the ascending conv_ids) of each distinct k.

    Rows are dealt by ranges of (sequence, conv_id) and become lists of bounded
    length, so a group of any size is split; only its lists, in order, pass one
    task, which holds the state of the hash alone.
    """
    rows = sequences.select(F.md5(F.col("k").cast("binary")).alias("s"), "conv_id").repartitionByRange("s", "conv_id").sortWithinPartitions("s", "conv_id")

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, ids, size = None, [], 0
        for batch in batches:
            out = []
            for name, c in zip(batch.column("s").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if ids and (name != s or size > LIST_TEXT):
                    out.append((s, ids[0], len(ids), ",".join(map(str, ids))))
                    ids, size = [], 0
                s = name
                ids.append(c)
                size += len(str(c)) + 1
            yield pa.RecordBatch.from_pylist([dict(zip(("s", "conv_id", "copies", "text"), x, strict=True)) for x in out], schema=schema)
        if ids:
            yield pa.RecordBatch.from_pylist([{"s": s, "conv_id": ids[0], "copies": len(ids), "text": ",".join(map(str, ids))}], schema=schema)

    schema = pa.schema([("s", pa.string()), ("conv_id", pa.int64()), ("copies", pa.int64()), ("text", pa.string())])
    listed = rows.mapInArrow(lists, "s string, conv_id long, copies long, text string")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, least, n, state = None, 0, 0, hashlib.sha256()
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                if x["s"] != s:
                    if s is not None:
                        out.append({"conv_id": least, "copies": n, "ends": state.hexdigest()})
                    s, least, n, state = x["s"], x["conv_id"], 0, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(x["text"].encode())
                n += x["copies"]
            yield pa.RecordBatch.from_pylist(out, schema=digested)
        if s is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": least, "copies": n, "ends": state.hexdigest()}], schema=digested)

    digested = pa.schema([("conv_id", pa.int64()), ("copies", pa.int64()), ("ends", pa.string())])
    return listed.repartition("s").sortWithinPartitions("s", "conv_id").mapInArrow(digests, "conv_id long, copies long, ends string")


# --- blocks -------------------------------------------------------------------

#: What a block leaves: its sequences, its nodes (open at an end that is null), its chains and one row about itself.
_BLOCK = (
    "kind string, block int, i long, conv_id long, copies long, ends string, words array<long>, len long, lcp long, next long, ls long, "
    "c long, f long, a long, n long, v long, upto long, left long, right long, k long, first_key string, last_key string"
)
_BLOCK_ARROW = pa.schema([(x.split()[0], {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64())}[x.split()[1]]) for x in _BLOCK.split(", ")])


def shared_turns(a: str, b: str) -> int:
    """The number of keys that both begin with."""
    lo, hi = 0, min(len(a), len(b)) // KEY
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo * KEY : mid * KEY] == b[lo * KEY : mid * KEY]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class _Block:
    """Nearest smaller values within a block, by a stack of [value, left smaller, last index, count, least conversation]."""

    def __init__(self, block: int) -> None:
        self.block, self.i, self.out, self.stack = block, 0, [], []
        self.c = self.f = self.a = self.n = 0
        self.last: dict | None = None
        self.least = 0  # least conversation so far
        self.first: tuple[str, list[int]] = ("", [])
        self.key = ""

    def row(self, kind: str, **x) -> None:
        self.out.append({"kind": kind, "block": self.block} | x)

    def add(self, key: str, words: list[int], conv_id: int, n: int, ends: str) -> None:
        sums = np.cumsum([0, *words]).tolist()
        v = ls = None
        if self.last is None:
            self.first, self.least = (key, sums), conv_id
        else:
            v = shared_turns(self.key, key)
            least = self.last["conv_id"]
            while self.stack and self.stack[-1][0] > v:
                value, left, _, k, m = self.stack.pop()
                least = min(m, least)
                self.row("node", v=value, left=left, right=self.i, k=k, conv_id=least)
            if self.stack and self.stack[-1][0] == v:
                top = self.stack[-1]
                top[2:] = self.i, top[3] + 1, min(top[4], least)
                ls = top[1]
            else:
                if self.stack:
                    ls = self.stack[-1][2]
                else:  # less than all before: a further element of the prefix minima
                    self.row("prefix", v=v, i=self.i, upto=self.lowest, conv_id=self.least)
                    self.lowest = v
                self.stack.append([v, ls, self.i, 1, least])
            self.close(v)
            self.least = min(self.least, conv_id)
        self.last = {"i": self.i, "conv_id": conv_id, "copies": n, "ends": ends, "words": sums, "len": len(words), "lcp": v, "ls": ls, "c": self.c, "f": self.f, "a": self.a, "n": self.n}
        self.c += n
        self.a += n * sums[-1]
        self.n += sums[-1] - (sums[v] if v is not None else 0)
        self.key = key
        self.i += 1

    lowest: int | None = None

    def close(self, following: int | None) -> None:
        """The sequence before is done: what it shares with the next is known."""
        x = self.last
        self.row("sequence", next=following, **x)
        if following is not None and x["len"] > following:
            self.f += 1

    def end(self) -> None:
        if self.last is None:
            return
        self.close(None)
        least, upto = self.last["conv_id"], None
        for value, left, last, k, m in reversed(self.stack):
            self.row("suffix", v=value, i=last, upto=upto, conv_id=least)
            least, upto = min(m, least), value
            self.row("node", v=value, left=left, right=None, k=k, conv_id=least)
        self.row("block", i=self.i, v=self.stack[0][0] if self.stack else None, conv_id=least, c=self.c, f=self.f, a=self.a, n=self.n, len=self.last["len"], words=self.first[1], first_key=self.first[0], last_key=self.key)

    def take(self) -> pa.RecordBatch:
        out, self.out = self.out, []
        return pa.RecordBatch.from_pylist(out, schema=_BLOCK_ARROW)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    b = _Block(TaskContext.get().partitionId())
    for batch in batches:
        for x in zip(*(batch.column(c).to_pylist() for c in ("k", "words", "conv_id", "copies", "ends")), strict=True):
            b.add(*x)
        yield b.take()
    b.end()
    yield b.take()


def _seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each block shares with the one before, and the words of that."""
    for batch in batches:
        beta, words = [], []
        for x in batch.to_pylist():
            shared = -1 if x["before"] is None else shared_turns(x["before"], x["first_key"])
            beta.append(shared)
            words.append(x["words"][max(shared, 0)])
        keep = ["block", "i", "v", "conv_id", "c", "f", "a", "n", "len"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(beta, pa.int64()), pa.array(words, pa.int64())], names=[*keep, "beta", "shared"])


class _Minima:
    """Arrays with a number for each block, and searches in them."""

    def __init__(self, rows: list[dict]) -> None:
        col = lambda n: [x[n] for x in rows]
        self.blocks, self.beta, self.least = col("block"), col("beta"), col("conv_id")
        self.inner = [x["v"] if x["v"] is not None else 1 << 62 for x in rows]
        self.minima = [min(a, b) for a, b in zip(self.beta, self.inner, strict=True)]
        self.at = {b: j for j, b in enumerate(self.blocks)}
        self.levels, self.leasts = self._levels(self.minima), self._levels(self.least)

    @staticmethod
    def _levels(x: list[int]) -> list[np.ndarray]:
        """Minima of runs of 1, 2, 4, ... numbers."""
        out = [np.array(x, np.int64)]
        while 2 * len(out[0]) > (w := 1 << len(out)) + len(out[0]) - 1 and w <= len(out[0]):
            half = out[-1]
            out.append(np.minimum(half[: len(half) - w // 2], half[w // 2 :]))
        return out

    def before(self, j: int, v: int) -> int:
        """The last block before j that has a value below v; the first block always has."""
        j -= 1
        for level in range(len(self.levels) - 1, -1, -1):
            w = 1 << level
            if j - w + 1 >= 0 and self.levels[level][j - w + 1] >= v:
                j -= w
        return j

    def after(self, j: int, v: int) -> int | None:
        """The first block behind j that has a value below v, if any."""
        j += 1
        for level in range(len(self.levels) - 1, -1, -1):
            w = 1 << level
            if j + w <= len(self.blocks) and self.levels[level][j] >= v:
                j += w
        return j if j < len(self.blocks) else None

    def least_of(self, lo: int, hi: int) -> int:
        """The least conversation of the blocks lo to hi - 1."""
        if lo >= hi:
            return SEAM
        level = (hi - lo).bit_length() - 1
        return int(min(self.leasts[level][lo], self.leasts[level][hi - (1 << level)]))


_LOOSE = "block int, v long, k long, was_open boolean, left long, right long, conv_id long, left_block int, right_block int"


def _resolver(minima: _Minima, end: int):
    """Open nodes with the blocks in which they end; where a chain has to tell, left or right stays null."""
    pos = lambda j, i: minima.blocks[j] * STEP + i

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                j, v, left, right, least = minima.at[x["block"]], x["v"], x["left"], x["right"], x["conv_id"]
                was_open, left_block, right_block = left is None, None, None
                lo, hi = j, j + 1  # whole blocks between the two ends
                if right is None and least == SEAM and minima.inner[j] < v:
                    hi, right_block = j, x["block"]
                elif right is None:
                    b = minima.after(j, v)
                    hi = len(minima.blocks) if b is None else b
                    if b is None:
                        right = end
                    elif minima.beta[b] < v:
                        right = pos(b, 0)
                    else:
                        right_block = minima.blocks[b]
                else:
                    hi, right = j, pos(j, right)
                if left is None:
                    if minima.beta[j] < v:
                        lo, left = j, pos(j, 0)
                    else:
                        a = minima.before(j, v)
                        if minima.inner[a] < v:
                            lo, left_block = a + 1, minima.blocks[a]
                        else:
                            lo, left = a, pos(a, 0)
                else:
                    lo, left = j + 1, pos(j, left)
                out.append((x["block"], v, x["k"], was_open, left, right, min(least, minima.least_of(lo, hi)), left_block, right_block))
            names = [c.split()[0] for c in _LOOSE.split(", ")]
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=schema)

    schema = pa.schema([(c.split()[0], {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}[c.split()[1]]) for c in _LOOSE.split(", ")])
    return f


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    conversations: conv_id, turn, role, text.  Null roles and texts count as
    empty, rows without conv_id as no conversation; repeated rows are turns of
    their own.  An empty table has no node.  A conversation travels as one row
    of 32 bytes and a number for each turn, without its texts.
    """
    spark = conversations.sparkSession
    sequences = table(rebuilt(conversations), "sequences")
    groups = table(copies(sequences), "copies")
    distinct = sequences.join(groups, "conv_id").repartitionByRange("k").sortWithinPartitions("k")
    made = table(distinct.select("k", "words", "conv_id", "copies", "ends").mapInArrow(_blocks, _BLOCK), "blocks")
    of = lambda kind: made.where(F.col("kind") == kind)
    # one row for each block, numbers only
    lag = F.lag("last_key").over(Window.orderBy("block"))
    about = of("block").select("block", "i", "v", "conv_id", "c", "f", "a", "n", "len", "words", "first_key", lag.alias("before"))
    seams = about.mapInArrow(_seams, "block int, i long, v long, conv_id long, c long, f long, a long, n long, len long, beta long, shared long")
    rows = sorted((r.asDict() for r in seams.collect()), key=lambda r: r["block"])
    if not rows:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    minima, end = _Minima(rows), (rows[-1]["block"] + 1) * STEP
    offsets, sums = [], [0, 0, 0, 0]
    for r, following in zip(rows, [*rows[1:], {"beta": -1}], strict=True):
        offsets.append((r["block"], r["beta"], following["beta"], r["shared"], *sums))
        flag = int(r["len"] > following["beta"])
        sums = [x + y for x, y in zip(sums, (r["c"], r["f"] + flag, r["a"], r["n"] - r["shared"]), strict=True)]
    places = F.broadcast(spark.createDataFrame(offsets, "block int, beta long, beta_next long, shared long, c0 long, f0 long, a0 long, n0 long"))

    # open nodes, and the values at the seams, which stand at index 0 of their blocks
    seam_nodes = spark.createDataFrame([(r["block"], r["beta"], None, None, 1, SEAM) for r in rows[1:]], "block int, v long, left long, right long, k long, conv_id long")
    loose = of("node").where("left is null or right is null").select("block", "v", "left", "right", "k", "conv_id").unionByName(seam_nodes)
    loose = loose.mapInArrow(_resolver(minima, end), _LOOSE)
    chain = lambda kind, side: of(kind).select(F.col("block").alias(f"{side}_block"), F.col("v").alias(f"{side}_v"), "upto", (F.col("block") * F.lit(STEP) + F.col("i")).alias(f"{side}_at"), F.col("conv_id").alias(f"{side}_least"))
    for kind, side in (("suffix", "left"), ("prefix", "right")):
        c = chain(kind, side)
        known, asks = loose.where(f"{side}_block is null"), loose.where(f"{side}_block is not null")
        found = asks.join(c, f"{side}_block").where((F.col("v") > F.col(f"{side}_v")) & (F.col("upto").isNull() | (F.col("v") <= F.col("upto"))))
        found = found.withColumn(side, F.col(f"{side}_at")).withColumn("conv_id", F.least("conv_id", f"{side}_least"))
        loose = table(known.unionByName(found.select(*known.columns)), f"open-{side}")
    within = of("node").where("left is not null and right is not null")
    at = lambda c: (F.col("block") * F.lit(STEP) + F.col(c)).alias(c)
    nodes = within.select("v", at("left"), at("right"), "k", "conv_id").unionByName(loose.groupBy("v", "left").agg(F.max("right").alias("right"), F.sum("k").alias("k"), F.min("conv_id").alias("conv_id")))
    nodes = table(nodes, "nodes")

    # sequences in the whole order
    lefts = loose.where("was_open").groupBy("block", "v").agg(F.min("left").alias("ls")).withColumnRenamed("v", "lcp")
    s = of("sequence").join(places, "block").select(
        "block", (F.col("block") * F.lit(STEP) + F.col("i")).alias("pos"), "conv_id", "copies", "ends", "words", "len", F.coalesce("lcp", "beta").alias("lcp"), F.coalesce("next", "beta_next").alias("next"),
        (F.col("block") * F.lit(STEP) + F.col("ls")).alias("ls"), (F.col("c") + F.col("c0")).alias("c"), (F.col("f") + F.col("f0")).alias("f"), (F.col("a") + F.col("a0")).alias("a"),
        (F.col("n") + F.col("n0") - F.when(F.col("i") > 0, F.col("shared")).otherwise(0)).alias("n"),
    )
    looking = s.where("ls is null and lcp >= 0")
    found = looking.drop("ls").join(lefts, ["block", "lcp"])
    s = table(s.where("ls is not null or lcp < 0").unionByName(found.select(*s.columns)), "ordered")

    # nodes where sequences part, then those in which one sequence ends alone
    a = s.select(F.col("pos").alias("left"), *[F.col(c).alias(f"{c}_a") for c in ("lcp", "ls", "len", "ends", "words", "c", "f", "a", "n")])
    last = spark.createDataFrame([(end, -1, *sums)], "right long, lcp_b long, c_b long, f_b long, a_b long, n_b long")
    b = s.select(F.col("pos").alias("right"), *[F.col(c).alias(f"{c}_b") for c in ("lcp", "c", "f", "a", "n")]).unionByName(last)
    both = nodes.join(a, "left").join(b, "right")
    words_at = lambda words, d: F.element_at(words, (F.greatest(d, F.lit(0)) + 1).cast("int"))
    least = F.greatest("lcp_a", "lcp_b")
    parting = both.select(
        "conv_id", least.alias("lo"), F.col("v").alias("hi"), (F.col("c_b") - F.col("c_a")).alias("n_convs"), (F.col("f_b") - F.col("f_a")).alias("n_leaves"), (F.col("k") + (F.col("len_a") > F.col("v")).cast("long")).alias("children"),
        F.when(F.col("len_a") == F.col("v"), F.col("ends_a")).alias("ends"), (F.col("a_b") - F.col("a_a") - F.col("n_b") + F.col("n_a") - words_at(F.col("words_a"), F.col("lcp_a"))).alias("whole"),
        F.when(F.col("lcp_a") >= F.col("lcp_b"), F.col("ls_a")).otherwise(F.col("left")).alias("up"), F.col("words_a").alias("words"),
    )
    alone = s.where(F.col("len") > F.greatest("lcp", "next")).select(
        "conv_id", F.greatest("lcp", "next").alias("lo"), F.col("len").alias("hi"), F.col("copies").alias("n_convs"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("children"), "ends",
        ((F.col("copies") - 1) * F.element_at("words", -1)).alias("whole"), F.when(F.col("lcp") >= F.col("next"), F.col("ls")).otherwise(F.col("pos")).alias("up"), "words",
    )
    every = parting.unionByName(alone)
    above = F.slice("words", (F.greatest("lo", F.lit(0)) + 1).cast("int"), (F.col("hi") - F.greatest("lo", F.lit(0)) + 1).cast("int"))  # words of the first lo, ..., hi turns
    every = every.withColumn("words", above)
    parents = nodes.select(F.col("v").alias("lo"), F.col("left").alias("up"), F.col("conv_id").alias("parent"))
    every = every.join(parents, ["lo", "up"], "left")

    # the depths between a node and its parent
    depths = every.withColumn("depth", F.explode(F.sequence(F.col("lo") + 1, F.col("hi"))))
    lead = words_at(F.col("words"), F.col("depth") - 1 - F.greatest("lo", F.lit(0)))
    bottom, top = F.col("depth") == F.col("hi"), F.col("depth") == F.col("lo") + 1
    return depths.select(
        "conv_id", "depth", F.when(top, F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs", F.when(bottom, F.col("children")).otherwise(1).alias("n_children"), "n_leaves",
        (F.col("whole") - (F.col("n_convs") - 1) * lead).alias("saved_tokens"), F.coalesce(F.when(bottom, F.col("ends")), F.lit(NO_ENDS)).alias("ends_sha256"),
    )


_CRC = """xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length({0}) + 1), lambda i: ascii({0}[i])::BIGINT), lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""
#: Every conversation's prefixes hashed, and every node met with all below it: for tables of moderate size.
SQL = f"""WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos,
  CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '') AS x, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS w FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, {_CRC.format('CAST(c AS VARCHAR)')} % 4 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT h.c, 0 AS own, t.pos, x, w FROM h JOIN t ON t.c = h.c - h.c % 20 AND t.pos < h.h UNION ALL SELECT h.c, 1, t.pos, x, w FROM h JOIN t ON t.c = h.c AND t.pos >= h.h),
p AS (SELECT c, row_number() OVER o AS d, md5(string_agg(md5(x), '') OVER o) AS id, w FROM r WINDOW o AS (PARTITION BY c ORDER BY own, pos ROWS UNBOUNDED PRECEDING) UNION ALL SELECT c, 0, '', 0 FROM h),
l AS (SELECT c, max(d) AS len FROM p GROUP BY c),
n AS (SELECT d, id, min(c) AS conv_id, count(*) AS n_convs, max(w) AS w, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = len), '')) AS ends FROM p JOIN l USING (c) GROUP BY d, id),
up AS (SELECT n.d, n.id, q.id AS parent FROM n JOIN p q ON q.c = n.conv_id AND q.d = n.d - 1),
k AS (SELECT d - 1 AS d, parent AS id, count(*) AS n_children FROM up GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (d, id)),
s AS (SELECT q.d, q.id, count(*) FILTER (m.n_children = 0) AS n_leaves, sum((m.n_convs - 1) * m.w) AS saved FROM m JOIN p q ON q.c = m.conv_id AND q.d <= m.d GROUP BY q.d, q.id)
SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, a.conv_id AS parent_conv_id, CAST(m.n_convs AS BIGINT) AS n_convs, CAST(m.n_children AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, m.ends AS ends_sha256
FROM m JOIN s USING (d, id) LEFT JOIN up USING (d, id) LEFT JOIN m a ON a.d = m.d - 1 AND a.id = up.parent"""
