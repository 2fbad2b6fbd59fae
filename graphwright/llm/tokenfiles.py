"""Token ids in files of patched frame-of-reference blocks.

A segment holds the ids of whole documents in ascending doc_id order:

    magic 'GWP1' | uint32 n_docs, n_ids, n_blocks, n_exceptions | int64 first
    int64 doc_id[n_docs] | uint8 null[n_docs] | uint32 length[n_docs]
    uint32 minimum[n_blocks] | uint8 width[n_blocks]
    uint32 start[n_blocks + 1]    word at which each block's packed values begin
    uint32 patches[n_blocks + 1]  where each block's exceptions begin
    uint8 position[n_exceptions] | uint32 high[n_exceptions]
    uint64 packed[...]

all little-endian.  A block is BLOCK ids (the last is padded with its minimum).
Its minimum is subtracted, `width` is the least number of bits that PERCENTILE
percent of the differences fit in; their low bits are packed, and what larger
ones have above goes to the exception list.  The block index lets a reader
decode any block alone.  `first` counts the ids before the segment in its part.

Segments are rows of a Parquet table (part, seq, n_ids, segment), written by
Spark's own committer: it works on any file system that Spark reaches, and a
task that is lost or run twice leaves no half-written file.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphwright.llm import textvec as tv
from graphwright.llm.tokens import CACHE_BYTES, public_path, tokenizer

MAGIC = b"GWP1"
BLOCK = 256
PERCENTILE = 90
#: A segment ends with the document that brings it to so many ids.
SEGMENT_IDS = 1 << 20
#: Bytes of text that are encoded in one step; bounds the scratch memory.
STEP_BYTES = 1 << 23
#: New runs, and bytes of texts that are encoded alone, that go to the library at once.
TOGETHER, WHOLE_BYTES = 1 << 10, 1 << 18
#: A worker forgets runs beyond so many, those that stood in one step only if that is enough.
CACHE_SIZE = 1 << 21
#: Runs whose ids are gathered at once.
GATHERED = 1 << 16
END_ID = 0


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """The low `width` bits of rows of BLOCK values, 64 values to `width` words."""
    lanes = values.reshape(-1, 64).astype(np.uint64)
    if width < 64:
        lanes &= np.uint64((1 << width) - 1)
    out = np.zeros((len(lanes), width), np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        out[:, word] |= lanes[:, i] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= lanes[:, i] >> np.uint64(64 - shift)
    return out.reshape(len(values), -1)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    lanes = words.reshape(-1, width)
    out = np.empty((len(lanes), 64), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        x = lanes[:, word] >> np.uint64(shift)
        if shift + width > 64:
            x |= lanes[:, word + 1] << np.uint64(64 - shift)
        out[:, i] = x & mask
    return out.reshape(len(words), BLOCK)


def encode_blocks(ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """minimum, width, start, patches, position, high, packed of a run of ids (below 2 ** 32)."""
    n_blocks = -(-len(ids) // BLOCK)
    padded = np.empty(n_blocks * BLOCK, np.uint32)
    padded[: len(ids)] = ids
    padded[len(ids) :] = ids[(n_blocks - 1) * BLOCK :].min() if len(ids) else 0
    rows = padded.reshape(-1, BLOCK)
    minimum = rows.min(axis=1) if n_blocks else np.zeros(0, np.uint32)
    rest = rows - minimum[:, None]
    bits = np.frexp(rest.astype(np.float64))[1].astype(np.uint8)
    at = min(BLOCK - 1, BLOCK * PERCENTILE // 100)
    width = np.partition(bits, at, axis=1)[:, at] if n_blocks else np.zeros(0, np.uint8)
    words = width.astype(np.int64) * (BLOCK // 64)
    start = np.concatenate(([0], np.cumsum(words))).astype(np.uint32)
    packed = np.zeros(int(start[-1]), np.uint64)
    for w in np.unique(width[width > 0]):
        own = np.flatnonzero(width == w)
        packed[(start[own].astype(np.int64)[:, None] + np.arange(int(w) * (BLOCK // 64))).ravel()] = _pack(rest[own], int(w)).ravel()
    row, position = np.nonzero(bits > width[:, None])
    patches = np.searchsorted(row, np.arange(n_blocks + 1)).astype(np.uint32)
    high = (rest[row, position] >> width[row].astype(np.uint32)).astype(np.uint32)
    return minimum, width, start, patches, position.astype(np.uint8), high, packed


def decode_blocks(n_ids: int, minimum, width, start, patches, position, high, packed) -> np.ndarray:
    rows = np.zeros((len(minimum), BLOCK), np.uint32)
    for w in np.unique(width[width > 0]):
        own = np.flatnonzero(width == w)
        at = start[own].astype(np.int64)[:, None] + np.arange(int(w) * (BLOCK // 64))
        rows[own] = _unpack(packed[at], int(w)).astype(np.uint32)
    row = np.repeat(np.arange(len(minimum)), np.diff(patches.astype(np.int64)))
    rows[row, position] |= high << width[row].astype(np.uint32)
    return (rows + minimum[:, None]).ravel()[:n_ids]


def write_segment(doc_ids: list, lengths: list[int], ids: np.ndarray, first: int) -> bytes:
    parts = encode_blocks(ids)
    nulls = np.array([x is None for x in doc_ids], np.uint8)
    docs = np.array([0 if x is None else x for x in doc_ids], np.int64)
    head = MAGIC + struct.pack("<IIIIq", len(docs), len(ids), len(parts[0]), len(parts[5]), first)
    types = ("<u4", "u1", "<u4", "<u4", "u1", "<u4", "<u8")
    body = [docs.astype("<i8"), nulls, np.array(lengths, "<u4"), *[x.astype(t) for x, t in zip(parts, types, strict=True)]]
    return head + b"".join(x.tobytes() for x in body)


def read_segment(raw: bytes) -> tuple[list, np.ndarray, np.ndarray, int]:
    """doc_ids, lengths, ids and the number of ids before the segment."""
    if raw[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    n_docs, n_ids, n_blocks, n_high, first = struct.unpack_from("<IIIIq", raw, 4)
    at = 4 + struct.calcsize("<IIIIq")
    out = []
    for kind, n in (("<i8", n_docs), ("u1", n_docs), ("<u4", n_docs), ("<u4", n_blocks), ("u1", n_blocks), ("<u4", n_blocks + 1), ("<u4", n_blocks + 1), ("u1", n_high), ("<u4", n_high)):
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    out.append(np.frombuffer(raw, "<u8", (len(raw) - at) // 8, at))
    docs, nulls, lengths, *blocks = out
    ids = decode_blocks(n_ids, *blocks)
    return [None if z else x for x, z in zip(docs.tolist(), nulls.tolist(), strict=True)], lengths, ids, first


class _Encoder:
    """Ids of texts, 16 bits each, by a byte-level BPE of the tokenizers library.

    Its pre-tokenizer never joins a character that is not white space with a
    space or line end that follows, nor a letter or digit with punctuation, and
    what follows does not look back.  So a text may be cut before a space or
    line end that stands after a character other than white space, and between
    a letter or digit and punctuation, and the runs be encoded alone and kept.
    Texts with other white space before a space or next to a line end, or with
    a special string, are one run.

    For the same reason new runs are encoded many at a time, as one text, whose
    ids tell them apart by the space or line end that each begins with.

    The runs of a step are made distinct by Arrow, so that only distinct ones
    become Python objects, and numpy puts their ids in the order of the texts.
    """

    _BLANK = np.zeros(256, bool)
    _BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
    _ALNUM = np.zeros(256, bool)
    _ALNUM[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
    _PUNCT = np.zeros(256, bool)
    _PUNCT[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True

    def __init__(self, name: str) -> None:
        self.t = tokenizer(public_path(name))
        if self.t.get_vocab_size() > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        self.special = [x.content.encode() for x in self.t.get_added_tokens_decoder().values()]
        self.line_end = self._alone([b"\n"])[0]
        #: Numbers of the runs that are known, in this order; the ids of all of them one after another, where each run's
        #: end, and whether it stood in one step (1) or more (2).
        self.kept: dict[bytes, int] = {b".": 0, b",": 1}
        self.ids, lengths = self._alone([b".", b","])
        self.ends, self.used = np.cumsum(lengths), np.zeros(2, np.uint8)
        self.long: list[bytes] = []
        #: Ids that begin with a space (which byte-level vocabularies write as U+0120), and those that are a line end.
        self.begins = {b" ": np.zeros(1 << 16, bool), b"\n": np.zeros(1 << 16, bool)}
        for token, i in self.t.get_vocab(with_added_tokens=False).items():
            self.begins[b" "][i] = token.startswith("\u0120")
        self.begins[b"\n"][self.line_end] = True

    def _forget(self) -> None:
        """Keeps the stops and what stood in several steps; the stops alone if that is too much."""
        keep = self.used > 1
        if keep.sum() > CACHE_SIZE // 2:
            keep[:] = False
        keep[:2] = True
        runs = [x for x, k in zip(self.kept, keep.tolist(), strict=True) if k]  # in the order of their numbers
        self.kept = dict(zip(runs, range(len(runs)), strict=True))
        self.ids, self.ends = self._gather(np.flatnonzero(keep))
        self.used = np.zeros(len(runs), np.uint8)

    def _alone(self, texts: list[bytes]) -> tuple[np.ndarray, list[int]]:
        """Ids of all texts, and the number of ids of each."""
        ids, lengths = array("H"), []
        for lo, hi in tv.runs(np.cumsum([0, *map(len, texts)]), WHOLE_BYTES):
            for x in self.t.encode_batch_fast([x.decode() for x in texts[lo:hi]], add_special_tokens=False):
                ids.extend(x.ids)
                lengths.append(len(x))
        return np.array(ids, np.uint16), lengths

    def _together(self, runs: list[bytes], before: bytes) -> tuple[np.ndarray, np.ndarray | list[int]]:
        """The same of runs that begin with `before`, a space or line end, and have no other white space or special string."""
        ids = np.array(self.t.encode_batch_fast([b"".join(runs).decode()], add_special_tokens=False)[0].ids, np.uint16)
        starts = np.flatnonzero(self.begins[before][ids])
        if len(starts) != len(runs) or starts[0]:
            return self._alone(runs)
        return ids, np.diff(starts, append=len(ids))

    def _hard(self, data: np.ndarray, offsets: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Numbers of the documents that may not be cut at all of their spaces and line ends, whose byte positions are `cut`."""
        n = len(data)
        blank = self._BLANK[data]
        tail = data >= 0x80
        if tail.any():  # white space beyond ASCII, at its last byte
            one, two = np.roll(data, 1), np.roll(data, 2)
            one[:1] = 0
            two[:2] = 0
            blank = blank | ((one == 0xC2) & ((data == 0x85) | (data == 0xA0)))
            blank |= (two == 0xE1) & (one == 0x9A) & (data == 0x80)
            blank |= (two == 0xE2) & (one == 0x80) & ((data >= 0x80) & (data <= 0x8A) | (data == 0xA8) | (data == 0xA9) | (data == 0xAF))
            blank |= ((two == 0xE2) & (one == 0x81) & (data == 0x9F)) | ((two == 0xE3) & (one == 0x80) & (data == 0x80))
        bad = cut[(cut > 0) & blank[np.maximum(cut - 1, 0)]]
        lines = cut[data[cut] == 10]
        # the first byte of what follows a line end: ASCII white space, or a lead byte that white space may have
        follow = data[np.minimum(lines + 1, n - 1)]
        odd = lines[(lines + 1 < n) & (self._BLANK[follow] | (follow == 0xC2) | (follow == 0xE1) | (follow == 0xE2) | (follow == 0xE3))]
        raw, special = data.tobytes(), []
        for x in self.special:
            at = raw.find(x)
            while at >= 0:
                special.append(at)
                at = raw.find(x, at + 1)
        # a blank in the document before, or at the next one's start, makes a document hard that need not be
        return np.unique(np.searchsorted(offsets, np.concatenate((bad, odd, np.array(special, np.int64))), "right") - 1)

    def _starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the runs of a step begin."""
        begins = (data == 32) | (data == 10)
        hard = self._hard(data, offsets, np.flatnonzero(begins))
        texts = offsets[:-1][np.diff(offsets) > 0]
        begins[texts] = True
        mark = np.flatnonzero(self._PUNCT[data[1:]]) + 1
        last, lead = data[mark - 1], data[np.maximum(mark - 2, 0)]
        # ASCII, or a letter of Latin-1: no multiplication or division sign
        mark = mark[self._ALNUM[last] | (lead == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)]
        # a last full stop or comma stays with its run
        stop = (data[mark] == 46) | (data[mark] == 44)
        begins[mark[~(stop & np.append(begins[1:], True)[mark])]] = True
        for i in hard.tolist():
            begins[offsets[i] : offsets[i + 1]] = False
        begins[texts] = True
        return np.flatnonzero(begins).astype(np.int32)

    def flat(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a step, one text after another, and the number of ids of each."""
        if not len(data):
            return np.zeros(0, np.uint16), np.zeros(len(offsets) - 1, np.int64)
        starts = self._starts(data, offsets)
        at = np.append(starts, np.int32(len(data)))
        runs = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
        number = self._numbers(_bytes_of(runs.dictionary))
        ids, ends = self._gather(number[runs.indices.to_numpy()])
        before = np.concatenate(([0], ends))  # ids before each run
        return ids, np.diff(before[np.searchsorted(starts, offsets)])

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of known runs, one run after another, and where each run's end."""
        lengths = np.diff(self.ends, prepend=0)
        first = self.ends - lengths
        ends = np.cumsum(lengths[numbers])
        ids = np.empty(int(ends[-1]), np.uint16)
        done = 0
        for lo in range(0, len(numbers), GATHERED):
            own = numbers[lo : lo + GATHERED]
            many, to = lengths[own], int(ends[lo + len(own) - 1])
            shift = first[own] - (ends[lo : lo + len(own)] - many)
            ids[done:to] = self.ids[np.repeat(shift, many) + np.arange(done, to)]
            done = to
        return ids, ends

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Ids of each text."""
        ids, lengths = self.flat(data, offsets)
        return [x.tobytes() for x in np.split(ids, np.cumsum(lengths)[:-1])]

    def _numbers(self, runs: list[bytes]) -> np.ndarray:
        """Numbers of distinct runs; new ones are learnt.  Runs of more than CACHE_BYTES stay until the next step."""
        for x in self.long:  # they came last
            del self.kept[x]
        self.long = []
        n = len(self.kept)
        self.ends, self.used = self.ends[:n], self.used[:n]
        self.ids = self.ids[: self.ends[-1]]
        if n > CACHE_SIZE:
            self._forget()
        kept = self.kept
        out = np.fromiter(map(kept.get, runs, repeat(-1)), np.int64, len(runs))
        new = np.flatnonzero(out < 0).tolist()
        if new:
            self._learn([runs[i] for i in new])
            out[new] = [kept[runs[i]] for i in new]
        self.used[out] = np.minimum(self.used[out] + 1, 2)
        return out

    def _learn(self, new: list[bytes]) -> None:
        """Puts new runs into what is kept.

        One that ends with a full stop or comma behind a letter or digit is
        encoded without it, since other runs may be the same then.
        """
        kept, ids, lengths = self.kept, [], []

        def add(runs: list[bytes], found: np.ndarray, many: np.ndarray | list[int]) -> None:
            kept.update(zip(runs, range(len(kept), len(kept) + len(runs)), strict=True))
            ids.append(found)
            lengths.append(np.asarray(many, np.int64))

        def store() -> None:
            before = len(self.ids)
            self.ids = np.concatenate((self.ids, *ids))
            self.ends = np.concatenate((self.ends, before + np.cumsum(np.concatenate((*lengths, np.zeros(0, np.int64))))))
            self.used = np.concatenate((self.used, np.zeros(len(self.ends) - len(self.used), np.uint8)))
            ids.clear()
            lengths.clear()

        self.long = [x for x in new if len(x) > CACHE_BYTES]
        ends = [x for x in new if x.endswith((b".", b",")) and len(x) <= CACHE_BYTES]
        stopped = [x for x in ends if x[-2:-1].isalnum() or x[-3:-2] == b"\xc3" and x[-2] not in (0x97, 0xB7)]
        missing = {*new}.difference(self.long, stopped)
        missing.update([x[:-1] for x in stopped if x[:-1] not in kept])
        spaced = [x for x in missing if x[0] == 32]
        lines = [x for x in missing if x[0] == 10]
        others = [x for x in missing if x[0] not in (10, 32)]
        for lead, runs in ((b" ", spaced), (b"\n", lines), (b"", others)):
            for lo in range(0, len(runs), TOGETHER):
                own = runs[lo : lo + TOGETHER]
                odd = self._odd(own, lead)
                if odd:
                    add(odd, *self._alone(odd))
                    own = [x for x in own if x not in kept]
                if own and lead:
                    add(own, *self._together(own, lead))
                elif own:  # such a run is what it is behind a line end
                    found, many = self._together([b"\n" + x for x in own], b"\n")
                    many = np.asarray(many)
                    skip = len(self.line_end)
                    at = (np.cumsum(many) - many)[:, None] + np.arange(skip)
                    add(own, np.delete(found, at.ravel()), many - skip)
        store()
        if stopped:
            both = np.array([[kept[x[:-1]] for x in stopped], [kept[x[-1:]] for x in stopped]])
            found, to = self._gather(both.T.ravel())
            add(stopped, found, np.diff(to[1::2], prepend=0))
        if self.long:
            add(self.long, *self._alone(self.long))
        store()

    def _odd(self, runs: list[bytes], lead: bytes) -> list[bytes]:
        """Those with white space beside the leading one, or a special string: in one text with others they could not be told apart."""
        raw = (b"" if lead else b"\n").join(runs)
        text = raw.decode()
        words = text.split()
        if len(words) == len(runs) and words == text.split(lead.decode() or "\n")[len(lead) :] and not any(s in raw for s in self.special):
            return []
        return [x for x in runs if x.decode().split() != [x[len(lead) :].decode()] or any(s in x for s in self.special)]


def _bytes_of(column: pa.BinaryArray) -> list[bytes]:
    """What to_pylist() gives of a whole column without nulls, in a fraction of its time."""
    at, raw = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1).tolist(), column.buffers()[2].to_pybytes()
    return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


_encoders: dict[str, _Encoder] = {}


def encoder(name: str) -> _Encoder:
    if name not in _encoders:
        _encoders[name] = _Encoder(name)
    return _encoders[name]


def _write(name: str):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, first = TaskContext.get().partitionId(), 0, 0
        e = encoder(name)
        docs: list = []
        lengths: list[np.ndarray] = []
        held: list[np.ndarray] = []

        def segment() -> pa.RecordBatch:
            nonlocal seq, first
            ids = np.concatenate(held).astype(np.uint32)
            raw = write_segment(docs, np.concatenate(lengths).tolist(), ids, first)
            row = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([raw], pa.binary())]
            seq, first = seq + 1, first + len(ids)
            for x in (docs, lengths, held):
                x.clear()
            return pa.RecordBatch.from_arrays(row, names=["part", "seq", "n_ids", "segment"])

        for batch in batches:
            data, offsets = tv.buffers(batch.column("text"))
            own = batch.column("doc_id").to_pylist()
            for lo, hi in tv.runs(offsets, STEP_BYTES):
                ids, n = e.flat(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                ids, ends = np.insert(ids, np.cumsum(n), END_ID), np.cumsum(n + 1)
                at = done = 0  # documents and ids of this step that are dealt with
                while at < len(n):
                    full = SEGMENT_IDS - sum(map(len, held))
                    to = min(int(np.searchsorted(ends, done + full)) + 1, len(n))
                    docs += own[lo + at : lo + to]
                    lengths.append(n[at:to] + 1)
                    held.append(ids[done : ends[to - 1]])
                    at, done = to, int(ends[to - 1])
                    if sum(map(len, held)) >= SEGMENT_IDS:
                        yield segment()
        if docs:
            yield segment()

    return f


def write_token_files(docs: DataFrame, path: str, name: str = "byte_bpe_50k.json", parts: int | None = None) -> None:
    """Encodes every text, appends END_ID, and writes all ids to `path` in ascending doc_id order.

    Texts are dealt to parts by doc_id range and sorted within.  Null texts
    count as empty, null doc_ids come first, rows of one doc_id in text order.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = parts or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), slim.rdd.getNumPartitions())
    ordered = slim.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_write(name), "part int, seq int, n_ids long, segment binary").write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids before the document), n_tokens, ids (array) of every document in the files."""
    return _read(spark, path, with_ids=True)


def digest_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian 32-bit numbers), from the files."""
    return _read(spark, path, with_ids=False)


def _read(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    files = spark.read.schema("part int, seq int, n_ids long, segment binary").parquet(path)
    kind = "ids array<int>" if with_ids else "ids_crc32 long"

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in zip(batch.column("part").to_pylist(), batch.column("segment").to_pylist(), strict=True):
                docs, lengths, ids, first = read_segment(raw)
                ends = np.cumsum(lengths.astype(np.int64))
                starts = ends - lengths
                if with_ids:
                    offsets = np.concatenate(([0], ends)).astype(np.int32)
                    last = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
                else:
                    wide = ids.astype("<u4").tobytes()
                    last = pa.array([zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64())
                arrays = [pa.array(docs, pa.int64()), pa.array(np.full(len(docs), part, np.int32)), pa.array(first + starts), pa.array(lengths.astype(np.int64)), last]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "part", "start", "n_tokens", kind.split()[0]])

    found = files.select("part", "segment").mapInArrow(f, f"doc_id long, part int, start long, n_tokens long, {kind}")
    # one row per part, so as many as write tasks
    bases = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = bases.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    out = found.join(bases, "part").withColumn("start", F.col("base") + F.col("start"))
    return out.select("doc_id", "start", "n_tokens", kind.split()[0])
