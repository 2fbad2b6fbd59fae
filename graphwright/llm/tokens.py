"""Token counts by a map-side two-tier lookup.

The unit of lookup is a pre-token run between ASCII white space.  For a
vocabulary whose pre-tokenizer drops white space, the tokens of a text are
those of its runs, so counts can be kept per run.

Tier one is a table of the most frequent runs with their token counts.  It is
gathered from all documents: every task counts its runs with a bounded table
(the rarer half is dropped whenever it is full) and hands on its most frequent
ones, so what is shuffled does not grow with the texts of a task.  The table
has TABLE_SIZE entries at most and is broadcast.  Tier two is a cache in each
worker, filled by the tokenizer for runs that miss.  The result does not depend
on either, and pre-tokens are never shuffled.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphwright.llm import textvec as tv

#: Entries of the broadcast table and, per task, of the tally that feeds it.
TABLE_SIZE = 1 << 16
TALLY_SIZE = 1 << 18
PER_TASK = 1 << 15
#: A worker's cache is emptied beyond so many entries; runs of more bytes are not kept.
CACHE_SIZE = 1 << 20
CACHE_BYTES = 64

_tokenizers: dict[str, object] = {}


def tokenizer(path: str):
    """The library's tokenizer of a .json file, one per process, without truncation or padding."""
    if path not in _tokenizers:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _tokenizers[path] = t
    return _tokenizers[path]


def public_path(name: str) -> str:
    """Where a public tokenizer file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def counter(name: str) -> Callable[[list[bytes]], list[int]]:
    """A function that gives the number of tokens of each string, by the library for the file's kind."""
    path = public_path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda runs: [len(x) for x in model.encode([r.decode() for r in runs], num_threads=1)]
    t = tokenizer(path)
    return lambda runs: [len(x) for x in t.encode_batch([r.decode() for r in runs], add_special_tokens=False)]


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[bytes] = Counter()
    for batch in batches:
        data, offsets = tv.buffers(batch.column("text"))
        for lo, hi in tv.runs(offsets):
            seen.update(_joined(data, offsets, lo, hi).split())
            if len(seen) > 2 * TALLY_SIZE:
                seen = Counter(dict(seen.most_common(TALLY_SIZE)))
    top = [x for x in seen.most_common(PER_TASK) if x[1] > 1 and len(x[0]) <= CACHE_BYTES]
    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], names=["run", "n"])


def _joined(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> bytes:
    """The texts of a run of documents with a line end between them."""
    if hi == lo + 1:
        return data[offsets[lo] : offsets[hi]].tobytes()
    whole = data[offsets[lo] : offsets[hi]].tobytes()
    at = (offsets[lo : hi + 1] - offsets[lo]).tolist()
    return b"\n".join([whole[a:b] for a, b in zip(at[:-1], at[1:], strict=True)])


def frequent_lengths(docs: DataFrame, name: str) -> tuple[bytes, bytes]:
    """The most frequent runs, joined by line ends, and their numbers of tokens as 16-bit numbers."""
    rows = docs.select("text").mapInArrow(_tally, "run binary, n long").groupBy("run").agg(F.sum("n").alias("n"))
    top = rows.orderBy(F.desc("n"), "run").limit(TABLE_SIZE).toArrow().column("run").to_pylist()
    lengths = np.minimum(np.array(counter(name)(top) if top else [], np.int64), 65535)
    return b"\n".join(top), lengths.astype(np.uint16).tobytes()


class _Lengths:
    """The broadcast table and a worker's own cache over it."""

    def __init__(self, name: str, table: tuple[bytes, bytes]) -> None:
        self.name, self.table, self.count = name, table, None
        self.long: list[bytes] = []
        self.cache = self._fixed()

    def _fixed(self) -> dict[bytes, int]:
        runs = self.table[0].split(b"\n") if self.table[0] else []
        return dict(zip(runs, np.frombuffer(self.table[1], np.uint16).tolist(), strict=True))

    def of(self, runs: set[bytes]) -> dict[bytes, int]:
        """A table with the lengths of all of `runs`, until the next call; what is missing is encoded."""
        for r in self.long:
            del self.cache[r]
        if len(self.cache) > CACHE_SIZE:
            self.cache = self._fixed()
        missing = [r for r in runs if r not in self.cache]
        self.long = [r for r in missing if len(r) > CACHE_BYTES]
        if missing:
            if self.count is None:
                self.count = counter(self.name)
            self.cache.update(zip(missing, self.count(missing), strict=True))
        return self.cache


_lengths: dict[tuple, _Lengths] = {}


def token_counts(docs: DataFrame, name: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs (doc_id, text); null texts count as empty.

    Special strings in a text are what the library makes of them: they cannot
    hold white space, so a run holds them whole.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(frequent_lengths(docs, name))
    key = (name, uuid.uuid4().hex)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _lengths:
            _lengths.clear()
            _lengths[key] = _Lengths(name, shared.value)
        lengths = _lengths[key]
        for batch in batches:
            column = batch.column("text")
            data, offsets = tv.buffers(column)
            counts = []
            for lo, hi in tv.runs(offsets):
                whole = data[offsets[lo] : offsets[hi]].tobytes()
                at = (offsets[lo : hi + 1] - offsets[lo]).tolist()
                split = [whole[a:b].split() for a, b in zip(at[:-1], at[1:], strict=True)]
                runs: set[bytes] = set()
                for x in split:
                    runs.update(x)
                get = lengths.of(runs).__getitem__
                counts += [sum(map(get, x)) for x in split]
            n = pa.array(counts, pa.int64())
            size = pa.array(np.diff(offsets).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), size, n, pc.greater(n, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(f, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
