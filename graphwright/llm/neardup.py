"""MinHash near-duplicates on HyperMinHash registers.

Two documents are linked when the Jaccard similarity of their sets of distinct
five-word shingles reaches the threshold; groups are the connected components
of the links.

1.  One pass over the texts makes, per document, a digest of its word sequence
    and `REGISTERS` compressed registers: the least hash of a bucket, kept as
    its count of leading zeros (6 bits) and the 10 bits that follow.  Every
    bucket has a hash function of its own, so that short documents leave no
    register empty.
2.  Documents of one word sequence are one node.  Nodes that agree on all
    registers of a band meet under the band's key.  Under each key all nodes
    are paired with the least one, never with each other.
3.  Pairs whose estimated similarity (matching registers, corrected for the
    chance collisions of compressed registers) is within four standard
    deviations of the threshold are verified on the full shingle sets.
4.  Keys whose nodes are not all known to be in one component (one round of the
    search for components tells) are searched exactly.  Under very crowded ones
    further hubs, drawn by a hash, are first paired with all nodes of other
    components, as long as that merges many: near copies of one text become few
    components in a number of pairs that grows with their own.
    Those of up to BLOCK nodes are one block.  A crowded one is split by prefix
    filters: sets are put in one order, rare shingles first, and two sets at
    the threshold must share one of the first |set| - ceil(threshold * |set|) +
    1; all nodes of crowded keys meet under such shingles instead, so those that
    a common passage brought together part again.  A pair is compared where its
    places in the two prefixes leave enough room for the threshold, which its
    first shingle in common does.  Blocks are compared on registers, then on a
    sketch of the shingle sets, which for short documents holds nearly the
    whole set; what is near the threshold is verified on the full sets there,
    and a link is given only where no component or earlier link of the block
    joins its ends.  So a block gives less links than it has nodes.

Joins on keys and hubs, of which one may hold any share of all rows, are
between two shuffled tables of which one has a row per key, so that adaptive
execution splits a hot key's rows; a hub's set is never repeated in a shuffle.

What can be missed: a pair at 0.85 shares no band with probability 1.2e-5, at
0.8 with 6.8e-4, and less above; of pairs at the threshold each of the filters
on registers and sketches loses one in 30,000.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphwright.llm import textvec as tv
from graphwright.llm.common import identified, table
from graphwright.llm.graph import components

SHINGLE = 5
BANDS, ROWS = 24, 6
REGISTERS = 192
MANTISSA = 10
#: Members of a block in step 4, about.
BLOCK = 512
#: Shingles of a block's sets, about; what one node has beyond them stays with it.
BLOCK_SHINGLES = 1 << 20
#: Rounds of further hubs, at most, under keys of more than so many blocks (a round is some twenty jobs); any choice gives the same groups.
HUB_ROUNDS, HUB_BLOCKS = 12, 8
#: Sets that a block's node is verified with at a time.
AT_ONCE = 32
#: Shingles that are known to be frequent in crowded keys, at most; any choice gives the same links.
FREQUENT = 1 << 16
#: Bins of the sketch in step 4, by the top bits of a shingle's hash; each keeps 16 bits of its least one.
BINS = 512
#: Bits of the filter that picks the documents whose shingle sets are needed.
FILTER_BITS = 1 << 23

_XOR = tv.stream(21, REGISTERS)
_MULTIPLY = tv.stream(22, REGISTERS) | np.uint64(1)
_DIGEST = tv.stream(23, 2) | np.uint64(1)


def _digests(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """128 bits of each document's word sequence, as rows of two numbers."""
    place = np.arange(len(words), dtype=np.uint64) - np.repeat(offsets[:-1], np.diff(offsets)).astype(np.uint64)
    out = np.zeros((len(offsets) - 1, 2), np.uint64)
    rows = np.flatnonzero(np.diff(offsets))
    if len(rows):
        for i in range(2):
            out[rows, i] = np.add.reduceat(tv.mix(words + tv.mix(place * _DIGEST[i])), offsets[rows])
    return out


def compressed(least: np.ndarray) -> np.ndarray:
    """Leading zeros and the bits behind the first one, as 16-bit registers."""
    exponent = np.frexp(least.astype(np.float64))[1].astype(np.int64)  # may be one high by rounding
    exponent -= (least >> np.maximum(exponent - 1, 0).astype(np.uint64) == 0) & (exponent > 0)
    zeros = 64 - exponent
    tail = (least << np.minimum(zeros + 1, 63).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    return ((zeros.astype(np.uint64) << np.uint64(MANTISSA)) | tail).astype(np.uint16)


def _registers(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    rows = np.flatnonzero(np.diff(offsets))
    least = np.zeros((len(offsets) - 1, REGISTERS), np.uint64)
    for j in range(REGISTERS if len(rows) else 0):
        least[rows, j] = np.minimum.reduceat((shingles ^ _XOR[j]) * _MULTIPLY[j], offsets[rows])
    return compressed(least)


def _sorted_sets(shingles: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    return [np.unique(shingles[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _hashed(column: pa.Array) -> Iterator[tuple]:
    data, offsets = tv.buffers(column)
    for lo, hi in tv.runs(offsets):
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, by_doc = tv.word_bounds(part, at)
        words = tv.word_hashes(part, starts, ends)
        yield lo, hi, words, by_doc, *tv.shingle_hashes(words, by_doc, SHINGLE)


def _binary(rows: np.ndarray, valid: np.ndarray) -> pa.Array:
    wide = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * wide.shape[1]
    bits = pa.py_buffer(np.packbits(valid, bitorder="little"))
    return pa.Array.from_buffers(pa.binary(), len(rows), [bits, pa.py_buffer(offsets), pa.py_buffer(wide)])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, words, by_doc, shingles, at in _hashed(batch.column("text")):
            some = np.diff(by_doc) > 0
            sizes = np.array([len(x) for x in _sorted_sets(shingles, at)], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c)[lo:hi] for c in ("file", "at", "doc_id")],
                    _binary(_digests(words, by_doc), some),
                    pa.array(sizes),
                    _binary(_registers(shingles, at), some),
                ],
                names=["file", "at", "doc_id", "node", "n_shingles", "registers"],
            )


def signatures(rows: DataFrame) -> DataFrame:
    """file, at, doc_id, node (digest of the words; null without words), n_shingles, registers of identified() rows."""
    slim = rows.select("file", "at", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").alias("text"))
    return slim.mapInArrow(_signatures, "file long, at long, doc_id long, node binary, n_shingles long, registers binary")


def similarity_estimate(matches, n_registers: int = REGISTERS):
    """Jaccard similarity from matching registers.

    Registers of two different minima collide by chance when zeros and mantissa
    agree: about 2 ** -MANTISSA times the sum of squared exponent chances, 1/3
    to 1/2; the middle of it is taken off.
    """
    chance = 0.42 * 2.0**-MANTISSA
    return np.maximum(0.0, (matches / n_registers - chance) / (1 - chance))


def floor_for(threshold: float) -> float:
    """What the estimate of a pair at the threshold exceeds but for once in 30,000."""
    return threshold - 4 * (threshold * (1 - threshold) / REGISTERS) ** 0.5


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The bins of a sorted set of shingle hashes; 0 marks an empty one."""
    out = np.zeros(BINS, np.uint16)
    bins, first = np.unique(shingles >> np.uint64(64 - BINS.bit_length() + 1), return_index=True)
    out[bins.astype(np.int64)] = np.maximum((shingles[first] >> np.uint64(32)) & np.uint64(0xFFFF), 1)
    return out


def sketches_near(one: np.ndarray, others: np.ndarray, n_one: int, n_others: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the other sketches are within four standard deviations of the threshold.

    The bins that either set fills are a sample, without replacement, of the
    union; so the deviation shrinks as they approach all of it.
    """
    filled = ((others != 0) | (one != 0)).sum(axis=1)
    same = ((others == one) & (one != 0)).sum(axis=1)
    union = (n_one + n_others) / (1 + threshold)
    rest = np.maximum(1 - filled / np.maximum(union, 1), 1 / np.maximum(filled, 1))
    deviation = np.sqrt(threshold * (1 - threshold) / np.maximum(filled, 1) * rest)
    return same >= (threshold - 4 * deviation) * filled


def _estimates(floor: float):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
            near = similarity_estimate((a == b).sum(axis=1)) >= floor
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(near)) for c in ("a", "b")], names=["a", "b"])

    return f


def _at_threshold(one: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the other sorted sets reach the threshold with the first."""
    sizes = np.array([len(x) for x in others], np.int64)
    flat = np.concatenate(others)
    found = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    both = np.add.reduceat(found.astype(np.int64), np.cumsum(sizes) - sizes)
    return 100 * both >= percent * (len(one) + sizes - both)


def _compare_blocks(percent: int):
    floor, ratio = floor_for(percent / 100), percent / 100

    def links(group: dict[str, np.ndarray], sets: list[np.ndarray], i: int, j: int):
        """Pairs at the threshold that join what components and earlier pairs of the block do not."""
        regs, comp, size, block, place = (group[c] for c in ("registers", "comp", "n_shingles", "block", "place"))
        left = np.flatnonzero(block == i)
        right = np.flatnonzero(block == j)
        comp = comp.copy()
        sketches = np.array([sketch(x) for x in sets])
        bands = regs[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
        band = int(group["band"][0])
        for k, x in enumerate(left):
            others = right[k + 1 :] if i == j else right
            others = others[(comp[others] != comp[x]) & (np.minimum(size[others], size[x]) >= ratio * np.maximum(size[others], size[x]) - 1e-9)]
            if band < 0:  # from this shingle on there must be room for an intersection at the threshold
                room = np.minimum(size[x] - place[x], size[others] - place[others])
                others = others[room >= ratio / (1 + ratio) * (size[x] + size[others]) - 1e-6]
            if not len(others):
                continue
            near = others[similarity_estimate((regs[others] == regs[x]).sum(axis=1)) >= floor]
            if len(near):
                near = near[sketches_near(sketches[x], sketches[near], size[x], size[near], ratio)]
            if band > 0 and len(near):  # a pair that shares an earlier band too is found there
                near = near[~(bands[near, :band] == bands[x, :band]).all(axis=2).any(axis=1)]
            while len(near):
                some, near = near[:AT_ONCE], near[AT_ONCE:]
                for y in some[_at_threshold(sets[x], [sets[y] for y in some], percent)]:
                    if comp[y] != comp[x]:
                        comp[comp == comp[y]] = comp[x]
                        yield x, y
                near = near[comp[near] != comp[x]]

    def whole(table_: pa.Table) -> Iterator[pa.RecordBatch]:
        table_ = table_.combine_chunks()
        node = table_.column("node").to_pylist()
        arrays = {
            "registers": np.frombuffer(b"".join(table_.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS),
            "comp": table_.column("comp").combine_chunks().dictionary_encode().indices.to_numpy(),
            "n_shingles": table_.column("n_shingles").to_numpy(),
            "block": table_.column("block").to_numpy(),
            "place": table_.column("place").to_numpy(),
            "band": table_.column("band").to_numpy(),
        }
        lists = table_.column("shingles").combine_chunks()
        values, at = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
        i, j, key = (table_.column(c).to_numpy() for c in ("i", "j", "key"))
        cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
        found: set[tuple[bytes, bytes]] = set()
        for lo, hi in zip([0, *cuts], [*cuts, len(key)], strict=True):
            sets = [values[at[x] : at[x + 1]] for x in range(lo, hi)]
            for x, y in links({k: v[lo:hi] for k, v in arrays.items()}, sets, i[lo], j[lo]):
                found.add((min(node[lo + x], node[lo + y]), max(node[lo + x], node[lo + y])))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come sorted by key, i, j; a group may go on in the next batch."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            same = np.ones(batch.num_rows, bool)
            for c in ("key", "i", "j"):
                v = batch.column(c).to_numpy(zero_copy_only=False)
                same &= v == v[-1]
            last = batch.num_rows - int(same[::-1].argmin() if not same.all() else batch.num_rows)
            if held and last == 0 and all(held[-1].column(c)[-1].as_py() == batch.column(c)[0].as_py() for c in ("key", "i", "j")):
                held.append(batch)
                continue
            if done := [*held, *([batch.slice(0, last)] if last else [])]:
                yield from whole(pa.Table.from_batches(done))
            held = [batch.slice(last)]
        if held:
            yield from whole(pa.Table.from_batches(held))

    return f


def _filter_bits(ids: np.ndarray) -> np.ndarray:
    return (tv.mix(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(FILTER_BITS)).astype(np.int64)


def _id_filter(ids: DataFrame) -> bytes:
    """A bit for each hash of the ids.  Its size is fixed, whatever the number of ids; if it fills up, more pass."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, np.uint8)
        for batch in batches:
            bits[_filter_bits(batch.column(0).to_numpy(zero_copy_only=False))] = 1
        words = np.packbits(bits).view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], names=["at", "bits"])

    words = np.zeros(FILTER_BITS // 64, np.int64)
    rows = ids.select("doc_id").where("doc_id is not null").mapInArrow(f, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    got = rows.toArrow()  # FILTER_BITS / 64 rows at most
    words[got.column("at").to_numpy()] = got.column("bits").to_numpy()
    return words.tobytes()


def _sets_of(wanted: bytes):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(wanted, np.uint8)).astype(bool)
        for batch in batches:
            ids = batch.column("doc_id")
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            keep = ~known
            keep[known] = bits[_filter_bits(ids.drop_null().to_numpy())]
            for _, _, words, by_doc, shingles, at in _hashed(batch.column("text").filter(pa.array(keep))):
                sets = _sorted_sets(shingles, at)
                values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
                some = np.diff(by_doc) > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        _binary(_digests(words, by_doc), some),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64))),
                    ],
                    names=["node", "shingles"],
                )

    return f


def _sets(docs: DataFrame, nodes: DataFrame, needed: DataFrame) -> DataFrame:
    """node, shingles of the needed nodes, by a second pass over their documents."""
    wanted = _id_filter(nodes.join(needed, "node", "left_semi").select("doc_id"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = texts.mapInArrow(_sets_of(wanted), "node binary, shingles array<long>").where("node is not null")
    return table(sets.join(needed, "node", "left_semi").dropDuplicates(["node"]), "sets")


def _verified(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) of nodes whose full shingle sets reach the threshold; a may be the hub of any number."""
    a, b = (sets.select(F.col("node").alias(x), F.col("shingles").alias("s" + x)) for x in "ab")
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    return (
        pairs.join(b, "b")
        .join(a, "a")
        .select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb")).cast("long").alias("sum"))
        .where(100 * F.col("both") >= percent * (F.col("sum") - F.col("both")))
        .select("a", "b")
    )


def _star_links(star: DataFrame, signs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Table of those pairs (a, b) that reach the threshold; a may be the hub of any number."""
    a, b = (signs.select(F.col("node").alias(x), F.col("n_shingles").alias("n" + x), F.col("registers").alias("r" + x)) for x in "ab")
    close = star.join(b, "b").join(a, "a").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    near = table(close.select("a", "b", "ra", "rb").mapInArrow(_estimates(floor_for(percent / 100)), "a binary, b binary"), "near")
    return table(_verified(sets, near, percent), "links")


def _gathered(members: DataFrame, signs: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """_mixed() members after rounds of further hubs under very crowded keys, and the tables of links that they found.

    A round pairs one node of each key with those of other components, so its
    pairs are as many as members at most.  Rounds end when one merges few.
    """
    links: list[DataFrame] = []
    for k in range(HUB_ROUNDS):
        crowded = members.where(f"blocks > {HUB_BLOCKS}")
        was = crowded.select("comp").distinct().count()
        if not was:
            break
        drawn = crowded.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), "node", "comp")).alias("x"))
        drawn = table(drawn.select("key", F.col("x.node").alias("a"), F.col("x.comp").alias("_comp")), "hubs")
        star = table(crowded.join(drawn, "key").where("comp <> _comp").select("a", F.col("node").alias("b")).distinct(), "star")
        links.append(_star_links(star, signs, sets, percent))
        of = crowded.select("node", "comp").distinct()
        ends = (of.select(F.col("node").alias(x), F.col("comp").alias("c" + x)) for x in "ab")
        joined = components(links[-1].join(next(ends), "a").join(next(ends), "b").select("ca", "cb").distinct(), "ca", "cb")
        joined = table(joined.where("node <> root").select(F.col("node").alias("comp"), "root"), "merged")
        members = members.drop("blocks").join(joined, "comp", "left").withColumn("comp", F.coalesce("root", "comp")).drop("root")
        members = table(_mixed(table(members, "rest"), "keys"), "mixed")
        if 8 * joined.count() < was:
            break
    return members, links


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that are frequent among a batch's sets, with their numbers."""
    for batch in batches:
        hashes, n = np.unique(batch.column("shingles").flatten().to_numpy(), return_counts=True)
        often = n > max(2, batch.num_rows // 64)
        yield pa.RecordBatch.from_arrays([pa.array(hashes[often]), pa.array(n[often])], names=["shingle", "n"])


def prefix(shingles: np.ndarray, frequent: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set, rare ones first, of which any set at the threshold has one.

    The order is that of the hashes, and behind them the frequent ones (sorted
    hashes) by rank; it is the same for all sets, whatever is frequent.
    """
    at = np.minimum(np.searchsorted(frequent, shingles), max(0, len(frequent) - 1))
    place = np.where(frequent[at] == shingles, rank[at], -1) if len(frequent) else np.full(len(shingles), -1)
    keep = len(shingles) - (percent * len(shingles) + 99) // 100 + 1
    return shingles[np.lexsort((shingles, place))[:keep]]


def _prefixes(frequent: tuple[bytes, bytes], percent: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = (np.frombuffer(x, np.int64) for x in frequent)
        for batch in batches:
            offsets, values = batch.column("shingles").offsets.to_numpy(), batch.column("shingles").values.to_numpy()
            found = [prefix(values[a:z], known, rank, percent) for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
            ends = np.cumsum([0, *[len(x) for x in found]]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("comp"), pa.array(np.diff(offsets).astype(np.int64)), tokens], names=["node", "comp", "n_shingles", "tokens"])

    return f


def _split(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """band (-1), key, node, comp, n_shingles, blocks, place: nodes (node, comp) under the shingles of their prefixes, those with one component left out."""
    own = table(sets.join(members, "node").select("node", "comp", "shingles"), "crowded")
    top = own.select("shingles").mapInArrow(_tally, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow()
    hashes, rank = top.column("shingle").to_numpy(), np.arange(top.num_rows)[::-1]
    order = np.argsort(hashes)
    tokens = own.mapInArrow(_prefixes((hashes[order].tobytes(), rank[order].tobytes()), percent), "node binary, comp binary, n_shingles long, tokens array<long>")
    finer = tokens.select(F.lit(-1).alias("band"), "node", "comp", "n_shingles", F.posexplode("tokens").alias("place", "key"))
    return _mixed(table(finer, "finer"), "finer-keys")


def _mixed(members: DataFrame, name: str) -> DataFrame:
    """members (band, key, node, comp, n_shingles, place) of keys with several components, with blocks: about how many times BLOCK or BLOCK_SHINGLES there are."""
    keys = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("all"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("all") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    return members.join(table(keys.select("key", blocks), name), "key").select("band", "key", "node", "comp", "n_shingles", "place", "blocks")


def _bands(nodes: DataFrame) -> DataFrame:
    """band, key, node, hub (the least node) of all nodes under keys that several have, hubs themselves left out."""
    width = 2 * ROWS
    keys = F.expr(f"transform(sequence(0, {BANDS - 1}), b -> xxhash64(b, substring(registers, b * {width} + 1, {width})))")
    bands = nodes.select(F.posexplode(keys).alias("band", "key"), "node")
    hubs = table(bands.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "hub"), "hubs")
    return table(bands.join(hubs, "key").where("node <> hub"), "crowd")


def _grouped(docs: DataFrame, rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of signatures() of all rows, of nodes, and of the nodes that are linked (node, root)."""
    signed = table(signatures(rows), "signatures")
    nodes = table(
        signed.where("node is not null")
        .groupBy("node")
        .agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_docs"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")),
        "nodes",
    )
    crowd = _bands(nodes)
    star = table(crowd.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "star")
    met = table(star.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "met")
    sets = _sets(docs, nodes, met)
    signs = table(nodes.join(met, "node", "left_semi").select("node", "n_shingles", "registers"), "signs")

    links = _star_links(star, signs, sets, percent)
    known = table(components(links, rounds=1), "known")

    least = signs.join(known, "node", "left").select("node", "n_shingles", F.coalesce("root", "node").alias("comp"))
    rest = crowd.select("band", "key", "node").join(least, "node").select("band", "key", "node", "comp", "n_shingles", F.lit(0).alias("place"))
    rest, more = _gathered(table(_mixed(table(rest, "rest"), "keys"), "mixed"), signs, sets, percent)
    split = _split(rest.where("blocks > 1").select("node", "comp").distinct(), sets, percent)
    dealt = rest.where("blocks = 1").unionByName(split).join(signs.select("node", "registers"), "node").join(sets, "node")
    dealt = dealt.withColumn("block", F.expr("pmod(xxhash64(node, 7), blocks)").cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "band", "block", "node", "comp", "place", "n_shingles", "registers", "shingles"
    )
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    more.append(table(dealt.mapInArrow(_compare_blocks(percent), "a binary, b binary").distinct(), "more"))
    links = reduce(DataFrame.unionByName, more, links)
    return signed, nodes, table(components(links), "components")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs` (doc_id, text).

    Links have 100 * intersection >= percent * union.  component_id is the
    least doc_id that links lead to.  Null and wordless texts have no shingles
    and are linked with nothing; equal texts are; repeated rows with one doc_id
    are one document.  A null doc_id counts only where a group has no other.
    Other columns are not looked at.
    """
    signed, nodes, groups = _grouped(docs, identified(docs), percent)
    least = groups.join(nodes.select("node", "doc_id"), "node").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    grouped = groups.join(least, "root").select("node", "component_id")
    alone = nodes.where("n_docs > 1").join(groups, "node", "left_anti").select("node", F.col("doc_id").alias("component_id"))
    answers = table(grouped.unionByName(alone), "answers")
    return (
        signed.select("doc_id", "n_shingles", "node")
        .join(answers, "node", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def keep_first(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The documents with one of each near-duplicate group, columns as they came whatever their names.

    Rows are judged by their texts: of a group the row of the least doc_id
    stays (any doc_id before none, the first in its file of several).  Texts
    without words all stay.
    """
    rows = identified(docs)
    signed, _, groups = _grouped(docs, rows, percent)
    member = signed.where("node is not null").select("file", "at", "doc_id", "node").join(groups, "node", "left")
    member = table(member.select(F.coalesce("root", "node").alias("root"), "doc_id", "at", "file"), "members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at", "file")).alias("x")
    kept = member.groupBy("root").agg(first).select("x.at", "x.file")
    gone = table(member.join(kept, ["file", "at"], "left_anti").select("file", "at"), "gone")
    return rows.join(gone, ["file", "at"], "left_anti").select("row.*")
