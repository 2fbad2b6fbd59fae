"""Packing of token ids into sequences: concatenate and cut.

All documents are encoded once; their ids, with an end id behind each, form one
stream in the order of the files and of the rows in them.  Two passes of prefix
sums give every document its place in the stream: running sums within each
segment (what a task reads of a file, a million rows at most), then sums over
the segments' totals.  Ids are never shuffled.  The stream is cut every
`length` ids; a document that crosses a cut leaves a record for
each piece.  What remains behind the last full sequence is cut into sequences
whose lengths are powers of two, the largest first, so nothing is padded.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphwright.llm import textvec as tv
from graphwright.llm.common import identified, table
from graphwright.llm.tokens import CACHE_BYTES, CACHE_SIZE, public_path, tokenizer

#: Words that are encoded in one call, with spaces between them.
TOGETHER = 1024
_ALNUM = frozenset(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


class Runs:
    """Ids of texts by a lower-casing BPE with word ends, whose pre-tokenizer drops white space.

    A text's ids are those of its runs between ASCII white space, which are
    kept.  Ids of a run do not depend on the case of ASCII letters, unless it
    has a combining mark or the start of a special string; a full stop or comma
    behind a letter or digit is a pre-token of its own.  Runs of Latin letters
    alone are one pre-token each, which ends with the only id that has the word
    end, so many of them are encoded in one call.
    """

    def __init__(self, name: str) -> None:
        self.t = tokenizer(public_path(name))
        vocabulary = self.t.get_vocab(with_added_tokens=True)
        self.code = "H" if max(vocabulary.values()) < 1 << 16 else "I"
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.dtype = np.dtype(f"<u{2 if self.code == 'H' else 4}")
        self.kept: dict[bytes, bytes] = {b"": b""}
        self.long: list[bytes] = []
        self.stops = {c: self._alone([bytes([c])])[0] for c in b".,"}

    def _alone(self, runs: list[bytes]) -> list[bytes]:
        return [array(self.code, x.ids).tobytes() for x in self.t.encode_batch([r.decode() for r in runs], add_special_tokens=False)]

    def _together(self, runs: list[bytes]) -> list[bytes]:
        """Ids of runs that are one pre-token each."""
        out: list[bytes] = []
        groups = [runs[i : i + TOGETHER] for i in range(0, len(runs), TOGETHER)]
        found = self.t.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False)
        for group, x in zip(groups, found, strict=True):
            ids = np.array(x.ids, self.dtype)
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist() if len(ids) else []
            if len(cuts) != len(group) or cuts[-1] != len(ids):
                out += self._alone(group)
                continue
            raw, size = ids.tobytes(), self.dtype.itemsize
            out += [raw[size * a : size * b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
        return out

    def _learn(self, runs: list[bytes], odd: bool) -> None:
        """Puts all of `runs` into the cache; those of more than CACHE_BYTES stay until the next call.  odd: some are to stay as they are."""
        kept = self.kept
        for x in self.long:
            kept.pop(x, None)
        self.long = []
        if len(kept) > CACHE_SIZE:
            kept.clear()
            kept[b""] = b""
        derived, missing = [], set()
        for x in runs:
            if x in kept:
                continue
            y, stop = x if odd and (b"<|" in x or b"\xcc" in x or b"\xcd" in x) else x.lower(), b""
            if y[-1:] in (b".", b",") and len(y) > 1 and (y[-2] in _ALNUM or y[-3:-2] == b"\xc3" and y[-2] not in (0x97, 0xB7)):
                y, stop = y[:-1], self.stops[y[-1]]
            if y != x:
                derived.append((x, y, stop))
            if y not in kept:
                missing.add(y)
        letters, other = [], []
        for x in missing:
            (letters if x.isalpha() or _latin(x) else other).append(x)
        kept.update(zip(letters, self._together(letters), strict=True))
        kept.update(zip(other, self._alone(other), strict=True))
        for x, y, stop in derived:
            kept[x] = kept[y] + stop
        self.long = [x for x in missing if len(x) > CACHE_BYTES] + [x for x, _, _ in derived if len(x) > CACHE_BYTES]

    def texts(self, docs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the n + 1 offsets of the texts in it.

        Only the distinct runs of the texts meet Python; their ids are put in
        the runs' places by array operations.
        """
        split = pc.ascii_split_whitespace(pc.fill_null(docs.cast(pa.large_string()), ""))
        found = split.flatten().dictionary_encode()
        runs = found.dictionary.cast(pa.large_binary()).to_pylist()
        odd = pc.any(pc.match_substring_regex(found.dictionary, _AS_IT_IS)).as_py()
        self._learn(runs, bool(odd))
        ids = [self.kept[x] for x in runs]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        whole = np.frombuffer(b"".join(ids), self.dtype)
        at = found.indices.to_numpy(zero_copy_only=False)
        n = sizes[at]
        ends = np.concatenate(([0], np.cumsum(n)))
        from_start = (np.cumsum(sizes) - sizes)[at] - ends[:-1]
        words = split.offsets.to_numpy().astype(np.int64)
        return whole[np.repeat(from_start, n) + np.arange(ends[-1])], ends[words - words[0]]


#: Runs in which the case of ASCII letters may matter: a combining mark, or the start of a special string.
_AS_IT_IS = "<\\||[\u0300-\u036f]"


def _latin(run: bytes) -> bool:
    """Letters below U+0250 only."""
    text = run.decode()
    return text.isalpha() and max(text) < "ɐ"


_runs: dict[str, Runs] = {}


def _encoder(name: str) -> Runs:
    if name not in _runs:
        _runs[name] = Runs(name)
    return _runs[name]


#: Bytes of text that are encoded at a time.
STEP_BYTES = 1 << 22
#: Binary logarithm of the rows of a file that a segment has at most.
SEGMENT_BITS = 20
_STREAM = "doc_id long, n long, ids binary, file string, segment long, part int, at long, before long"


def encoded(docs: DataFrame, name: str, end_id: int) -> DataFrame:
    """The ids of every text with its end id, as little-endian numbers of the width that the vocabulary needs.

    A row's segment is (file, segment, part); `before` counts the ids before it in that.
    """

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part = _encoder(name), TaskContext.get().partitionId()
        end = np.array([end_id], e.dtype).tobytes()
        held: dict[tuple[str, int], int] = {}  # a task reads few files
        for batch in batches:
            _, offsets = tv.buffers(batch.column("text"))
            for lo, hi in tv.runs(offsets, STEP_BYTES):
                own = batch.slice(lo, hi - lo)
                found, starts = e.texts(own.column("text"))
                cuts = starts.tolist()
                ids = [found[a:b].tobytes() + end for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                n = (np.diff(starts) + 1).tolist()
                segments, before = (own.column("at").to_numpy() >> SEGMENT_BITS).tolist(), []
                for key, k in zip(zip(own.column("file").to_pylist(), segments, strict=True), n, strict=True):
                    before.append(done := held.get(key, 0))
                    held[key] = done + k
                arrays = [own.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.large_binary()).cast(pa.binary()), own.column("file"), pa.array(segments, pa.int64()), pa.array(np.full(len(n), part, np.int32)), own.column("at"), pa.array(before, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _STREAM.split(", ")])

    rows = identified(docs, paths=True)
    return rows.select(F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").alias("text"), "file", "at").mapInArrow(f, _STREAM)


def windows(first: np.ndarray, last: np.ndarray, total: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc, start (in the stream), sequence and offset of every piece of the spans [first, last) of a stream of `total` ids."""
    full = total // length
    tails = [1 << b for b in range(length.bit_length() - 1, -1, -1) if total % length >> b & 1]
    cuts = np.cumsum([full * length, *tails])  # starts of the sequences behind the full ones, and the end
    number = lambda x: np.where(x < full * length, x // length, full + np.searchsorted(cuts, x, "right") - 1)
    lo, hi = number(first), number(last - 1)
    doc = np.repeat(np.arange(len(first)), hi - lo + 1)
    sequence = np.arange(len(doc)) - np.repeat(np.cumsum(hi - lo + 1) - (hi - lo + 1), hi - lo + 1) + lo[doc]
    begins = np.where(sequence < full, sequence * length, cuts[np.clip(sequence - full, 0, len(cuts) - 1)])
    start = np.maximum(first[doc], begins)
    return doc, start, sequence, start - begins


def pack(docs: DataFrame, length: int = 2048, name: str = "word_bpe_49k.json", end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pieces of all rows of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null texts count as empty, so they are their end id; null doc_ids and
    repeated rows have pieces like others.  The order is that of the rows in
    their files, however these are split; what is no plain scan of files is
    written first.  With `with_ids` a piece has its ids as an array too.  No
    rows: no pieces.
    """
    placed = table(encoded(docs, name, end_id), "token-stream")
    key = ["file", "segment", "part"]
    totals = placed.groupBy(*key).agg(F.sum("n").alias("total"), F.min("at").alias("at"))
    totals = totals.withColumn("end", F.sum("total").over(Window.orderBy("file", "at")))
    totals = table(totals.select(*key, (F.col("end") - F.col("total")).alias("base"), "end"), "token-segments")
    total = totals.agg(F.max("end")).first()[0] or 0
    kind = "ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = _encoder(name).dtype
        for batch in batches:
            if not batch.num_rows:
                continue
            first = batch.column("first").to_numpy(zero_copy_only=False)
            n = batch.column("n").to_numpy(zero_copy_only=False)
            doc, start, sequence, offset = windows(first, first + n, total, length)
            stop = np.append(start[1:], 0)
            ends_doc = np.append(doc[1:] != doc[:-1], True)
            size = np.where(ends_doc, (first + n)[doc], stop) - start
            at = start - first[doc]
            raw = [np.frombuffer(x.as_py(), dtype) for x in batch.column("ids")]
            parts = [raw[d][a : a + k].astype("<u4") for d, a, k in zip(doc.tolist(), at.tolist(), size.tolist(), strict=True)]
            arrays = [batch.column("doc_id").take(pa.array(doc)), pa.array(at), pa.array(size), pa.array(n[doc]), pa.array(sequence), pa.array(offset), pa.array([zlib.crc32(x.tobytes()) for x in parts], pa.int64())]
            names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.array([x.tolist() for x in parts], pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    bases = F.broadcast(totals.drop("end"))  # a row for each task's part of a file and million rows
    based = placed.join(bases, key).select("doc_id", "n", (F.col("base") + F.col("before")).alias("first"), "ids")
    pieces = based.mapInArrow(f, f"doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, {kind}")
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids: the sequences whole, from pieces with their ids; a sequence has a bounded number of ids."""
    parts = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("x"))
    return parts.select("sequence_id", F.flatten(F.transform("x", lambda e: e["ids"])).alias("ids"))
