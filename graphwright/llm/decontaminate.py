"""Benchmark decontamination: SimHash windows, multi-index Hamming search, exact verification.

An item matches a document where some window of the item's length in words has
a weighted Jaccard similarity of five-word shingles of THRESHOLD or more with
it.  Shingles weigh log2(1 + items / items that have them), in whole 1/16ths, so
what many items share counts less.  The numbers are those of the whole benchmark,
counted once: a shingle that one item or none has weighs most, and those that
more items have are a table of the SHARED most widespread ones, which is
broadcast (others would weigh as if one item had them).

Only windows that share a shingle with an item can match it, so windows are
slid past such anchors alone: the anchors of a text are found by one vectorised
pass.  Each window has a 64-bit SimHash from running sums.  The items'
SimHashes are indexed by four blocks of 16 bits, each with all values within
RADIUS // 4 bits; by the pigeonhole principle this finds every item within
RADIUS.  Candidates are verified on the full multisets.

At the threshold two multisets are at an angle of about 27 degrees or less, an
expected distance of 9.6 of 64 bits with a deviation of 2.9; RADIUS is nearly
two deviations above, and neighbouring windows get a chance each.

The items are broadcast in slices of bounded size, which stream through the
driver; each slice is one search of all documents, and results do not depend on
how items are dealt to slices.  Items of fewer than five words match as whole
sequences.  Scratch memory is linear in the text: hashes of words and shingles,
and running sums bit by bit for long stretches of windows.
"""

from __future__ import annotations

import itertools
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphwright.llm import textvec as tv
from graphwright.llm.common import table

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 15
BLOCKS, BLOCK_BITS = 4, 16
#: Bounds of what one pass broadcasts.
SLICE_ITEMS, SLICE_BYTES = 4096, 16 << 20
#: Shingles of more than one item that have a weight of their own, at most.
SHARED = 1 << 20
#: Windows that are looked up at once; stretches of more words have their running sums made bit by bit.
STRETCH, PLANES = 1 << 14, 1 << 14
_ANCHOR_BITS = 20


class Weights:
    """Weights of shingles: those of `shared` (sorted hashes) by their numbers of items, of all others as if one item had them."""

    def __init__(self, n_items: int, shared: np.ndarray, spread: np.ndarray) -> None:
        weigh = lambda x: np.maximum(1, np.round(16 * np.log2(1 + n_items / x))).astype(np.int64)
        self.shared, self.weights, self.rest = shared, weigh(spread) if len(spread) else np.zeros(0, np.int64), int(weigh(np.ones(1))[0])

    def of(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.shared):
            return np.full(len(shingles), self.rest, np.int64)
        at = np.minimum(np.searchsorted(self.shared, shingles), len(self.shared) - 1)
        return np.where(self.shared[at] == shingles, self.weights[at], self.rest)


class Index:
    """The items of one slice, made in each worker from their texts."""

    def __init__(self, ids: list[int | None], texts: list[str], weights: Weights) -> None:
        data, offsets = tv.buffers(pa.array(texts, pa.large_string()))
        starts, ends, by_item = tv.word_bounds(data, offsets)
        words = tv.word_hashes(data, starts, ends)
        self.ids, self.lengths, self.weights = ids, np.diff(by_item), weights
        shingles, at = tv.shingle_hashes(words, by_item, SHINGLE)
        counted = [np.unique(shingles[a:z], return_counts=True) for a, z in zip(at[:-1], at[1:], strict=True)]
        owner = np.repeat(np.arange(len(ids)), [len(h) for h, _ in counted])
        every = np.concatenate([h for h, _ in counted]) if counted else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.anchors, first = np.unique(every[order], return_index=True)
        self.owners, self.first = owner[order], np.append(first, len(every))
        self.maybe = np.zeros(1 << _ANCHOR_BITS, bool)
        self.maybe[(self.anchors >> np.uint64(64 - _ANCHOR_BITS)).astype(np.int64)] = True
        self.bags = [(h, n * weights.of(h)) for h, n in counted]
        self.sums = [int(w.sum()) for _, w in self.bags]
        short = [i for i in range(len(ids)) if 0 < self.lengths[i] < SHINGLE]
        self.short = {n: sorted((int(counted[i][0][0]), i) for i in short if self.lengths[i] == n) for n in {int(self.lengths[i]) for i in short}}
        self.hashes = np.array([self.simhash(h[None, :], w[None, :])[0] if len(h) else 0 for h, w in self.bags], np.uint64)
        self._blocks()

    @staticmethod
    def signs(shingles: np.ndarray) -> np.ndarray:
        """A row of 64 numbers, 1 or -1, for each hash."""
        bits = np.unpackbits(np.ascontiguousarray(shingles).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return bits.astype(np.int64) * 2 - 1

    @classmethod
    def simhash(cls, shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
        sums = (cls.signs(shingles.ravel()).reshape(*shingles.shape, 64) * weights[:, :, None]).sum(axis=1)
        return cls.packed(sums)

    @staticmethod
    def packed(sums: np.ndarray) -> np.ndarray:
        return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).ravel()

    def _blocks(self) -> None:
        near = [0]
        for n in range(1, RADIUS // BLOCKS + 1):
            near += [sum(1 << b for b in bits) for bits in itertools.combinations(range(BLOCK_BITS), n)]
        flips, long_items = np.array(near, np.int64), np.flatnonzero(self.lengths >= SHINGLE)
        self.block_items, self.block_first = [], []
        for b in range(BLOCKS):
            value = ((self.hashes[long_items] >> np.uint64(b * BLOCK_BITS)) & np.uint64(0xFFFF)).astype(np.int64)
            values, items = (value[:, None] ^ flips).ravel(), np.repeat(long_items, len(flips)).astype(np.int32)
            order = np.argsort(values, kind="stable")
            self.block_items.append(items[order])
            self.block_first.append(np.searchsorted(values[order], np.arange((1 << BLOCK_BITS) + 1)))

    def within(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, item) whose SimHashes differ in RADIUS bits at most."""
        pairs = []
        for b in range(BLOCKS):
            value = ((hashes >> np.uint64(b * BLOCK_BITS)) & np.uint64(0xFFFF)).astype(np.int64)
            lo = self.block_first[b][value]
            n = self.block_first[b][value + 1] - lo
            window = np.repeat(np.arange(len(hashes)), n)
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            item = self.block_items[b][np.repeat(lo, n) + inner]
            near = np.bitwise_count(hashes[window] ^ self.hashes[item]) <= RADIUS
            pairs.append(window[near] * len(self.ids) + item[near])
        both = np.unique(np.concatenate(pairs))
        return both // len(self.ids), both % len(self.ids)

    def similarity(self, shingles: np.ndarray, weights: np.ndarray, item: int) -> float:
        """Weighted Jaccard similarity of a window's shingles (repeats counted) and an item's."""
        own, sums = self.bags[item]
        found, place = np.unique(shingles, return_inverse=True)
        held = np.bincount(place, weights).astype(np.int64)
        at = np.minimum(np.searchsorted(own, found), len(own) - 1)
        both = int(np.where(own[at] == found, np.minimum(sums[at], held), 0).sum())
        return both / (int(weights.sum()) + self.sums[item] - both)

    def window_hashes(self, shingles: np.ndarray, weights: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """SimHashes of windows of a stretch of shingles, by running sums: of all 64 bits at once or, for long stretches, one by one."""
        if len(shingles) <= PLANES:
            sums = np.zeros((len(shingles) + 1, 64), np.int64)
            np.cumsum(self.signs(shingles) * weights[:, None], axis=0, out=sums[1:])
            return self.packed(sums[ends] - sums[starts])
        out, sums = np.zeros(len(starts), np.uint64), np.zeros(len(shingles) + 1, np.int64)
        for b in range(64):
            np.cumsum(np.where((shingles >> np.uint64(b)) & np.uint64(1), weights, -weights), out=sums[1:])
            out |= (sums[ends] > sums[starts]).astype(np.uint64) << np.uint64(b)
        return out


def _stretches(hits: np.ndarray, size: int, last: int) -> Iterator[np.ndarray]:
    """Starts of all windows of `size` words that hold one of the hits (ascending), stretch by stretch, STRETCH at once at most."""
    lo, hi = np.clip(hits - (size - SHINGLE), 0, last), np.clip(hits, 0, last)
    fresh = np.flatnonzero(lo[1:] > hi[:-1] + 1) + 1
    for a, z in zip(lo[np.append(0, fresh)].tolist(), hi[np.append(fresh, len(hits)) - 1].tolist(), strict=True):
        for at in range(a, z + 1, STRETCH):
            yield np.arange(at, min(z + 1, at + STRETCH))


def _matches(index: Index, total: int, shingles: np.ndarray, hits: np.ndarray) -> Iterator[tuple[int, float, int, int]]:
    """(item, similarity, start, words) of the best window of each item that matches a text of `total` words."""
    found = np.searchsorted(index.anchors, shingles[hits])
    n = index.first[found + 1] - index.first[found]
    place = np.repeat(hits, n)
    owner = index.owners[np.repeat(index.first[found], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    lengths = index.lengths[owner]
    best: dict[int, tuple[float, int, int]] = {}
    for size in np.unique(lengths[lengths >= SHINGLE]).tolist():
        for starts in _stretches(np.unique(place[lengths == size]), size, max(0, total - size)):
            ends = np.minimum(starts + (size - SHINGLE + 1), len(shingles))
            lo, hi = int(starts[0]), int(ends[-1])
            part, weights = shingles[lo:hi], index.weights.of(shingles[lo:hi])
            window, item = index.within(index.window_hashes(part, weights, starts - lo, ends - lo))
            same = index.lengths[item] == size
            for k, i in zip(window[same].tolist(), item[same].tolist(), strict=True):
                a, z = int(starts[k]) - lo, int(ends[k]) - lo
                s = index.similarity(part[a:z], weights[a:z], i)
                if s >= THRESHOLD and (i not in best or s > best[i][0]):
                    best[i] = (s, a + lo, min(size, total))
    for i, x in sorted(best.items()):
        yield i, *x


def search(index: Index, column: pa.Array) -> Iterator[tuple[int, int, float, int, int]]:
    """(row, item, similarity, start, words) of all matches in a column of texts."""
    data, offsets = tv.buffers(column)
    for lo, hi in tv.runs(offsets):
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, by_doc = tv.word_bounds(part, at)
        words = tv.word_hashes(part, starts, ends)
        del starts, ends
        shingles, first = tv.shingle_hashes(words, by_doc, SHINGLE)
        hits = np.flatnonzero(index.maybe[(shingles >> np.uint64(64 - _ANCHOR_BITS)).astype(np.int64)])
        hits = hits[np.isin(shingles[hits], index.anchors)]
        for n, items in index.short.items():  # items of few words, as whole sequences
            runs_, run_first = _sequences(words, by_doc, n)
            for p in np.flatnonzero(np.isin(runs_, np.array([h for h, _ in items], np.uint64))).tolist():
                d = int(np.searchsorted(run_first, p, "right")) - 1
                for k in range(bisect_left(items, (int(runs_[p]), -1)), len(items)):
                    if items[k][0] != int(runs_[p]):
                        break
                    yield lo + d, items[k][1], 1.0, int(p - run_first[d]), n
        cuts = np.searchsorted(hits, first)
        for d in np.flatnonzero(np.diff(cuts)).tolist():
            own = hits[cuts[d] : cuts[d + 1]] - first[d]
            for m in _matches(index, int(by_doc[d + 1] - by_doc[d]), shingles[first[d] : first[d + 1]], own):
                yield (lo + d, *m)


def _sequences(words: np.ndarray, by_doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every n-word sequence (n < SHINGLE), as of a text that is just the sequence."""
    counts = np.maximum(np.diff(by_doc) - n + 1, 0)
    first = np.concatenate(([0], np.cumsum(counts)))
    place = np.repeat(by_doc[:-1], counts) + np.arange(first[-1]) - np.repeat(first[:-1], counts)
    flat = words[place[:, None] + np.arange(n)].ravel() if len(place) else np.zeros(0, np.uint64)
    hashes, _ = tv.shingle_hashes(flat, np.arange(len(place) + 1) * n, SHINGLE)
    return hashes, first


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()


def _shingles_of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each item's distinct shingles."""
    for batch in batches:
        data, offsets = tv.buffers(batch.column("text"))
        for lo, hi in tv.runs(offsets):
            part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            starts, ends, by_item = tv.word_bounds(part, at)
            shingles, first = tv.shingle_hashes(tv.word_hashes(part, starts, ends), by_item, SHINGLE)
            own = [np.unique(shingles[a:z]) for a, z in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64))], names=["shingle"])


def _weights(items: DataFrame) -> tuple[int, bytes, bytes]:
    """Number of items; hashes and numbers of items of the shingles that several have, SHARED at most, sorted by hash."""
    spread = items.select("text").mapInArrow(_shingles_of_items, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    got = spread.orderBy(F.desc("n"), "shingle").limit(SHARED).toArrow()
    hashes, n = got.column("shingle").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(hashes)
    return items.count(), hashes[order].tobytes(), n[order].astype(np.int64).tobytes()


def _slices(items: DataFrame) -> Iterator[tuple[list[int | None], list[str]]]:
    """The items, in slices of bounded size, one after the other."""
    ids: list[int | None] = []
    texts: list[str] = []
    held = 0
    for r in items.orderBy("item_id", "text").toLocalIterator():
        if ids and (len(ids) >= SLICE_ITEMS or held + len(r["text"]) > SLICE_BYTES):
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(r["item_id"])
        texts.append(r["text"])
        held += len(r["text"])
    if ids:
        yield ids, texts


def _shared(benchmark: DataFrame) -> Iterator[tuple[str, object, object]]:
    """A key and the broadcasts of weights and items, slice by slice."""
    items, context = table(_items(benchmark), "items"), benchmark.sparkSession.sparkContext
    weights = context.broadcast(_weights(items))
    for ids, texts in _slices(items):
        yield uuid.uuid4().hex, weights, context.broadcast((ids, texts))


_indexes: dict[str, Index] = {}


def _index(key: str, weights, items) -> Index:
    if key not in _indexes:
        _indexes.clear()
        n, hashes, spread = weights.value
        _indexes[key] = Index(*items.value, Weights(n, np.frombuffer(hashes, np.uint64), np.frombuffer(spread, np.int64)))
    return _indexes[key]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, start_word, n_words: the best window of each item in each document.

    docs has doc_id and text, benchmark item_id and text; other columns are not
    looked at.  Null and empty texts and items match nothing; an item without id
    is one like others; equal items match separately, repeated rows of an item
    once; of repeated document rows each gives its rows.
    """
    kind = "doc_id long, item_id long, similarity double, start_word long, n_words long"
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for key, weights, items in _shared(benchmark):

        def f(batches: Iterator[pa.RecordBatch], key=key, weights=weights, items=items) -> Iterator[pa.RecordBatch]:
            index = _index(key, weights, items)
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                best: dict[tuple[int, int], tuple] = {}
                for row, item, s, start, n in search(index, batch.column("text")):
                    if (row, item) not in best or s > best[row, item][0]:
                        best[row, item] = (s, start, n)
                rows = [(ids[r], index.ids[i], *x) for (r, i), x in best.items()]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in kind.split(", ")])

        found = slim.mapInArrow(f, kind)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], kind) if out is None else out


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that no item matches, columns as they came whatever their names.

    Null and empty texts stay; repeated rows stay or go together.  Slices are
    searched one after the other in the same pass.
    """
    out = docs
    for key, weights, items in _shared(benchmark):

        def f(batches: Iterator[pa.RecordBatch], key=key, weights=weights, items=items) -> Iterator[pa.RecordBatch]:
            index = _index(key, weights, items)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                column = {n.lower(): n for n in batch.schema.names}["text"]
                for row, *_ in search(index, batch.column(column)):
                    keep[row] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(f, docs.schema)
    return out
