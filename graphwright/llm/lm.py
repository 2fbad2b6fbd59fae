"""Scores of texts under unigram language models.

The base model is a unigram model over lower-cased words.  The other one is a
subword lattice model: the vocabulary of a public tokenizer, each piece with a
unigram score (log10 probability), and a text's likelihood is the sum over all
ways to segment its words into pieces, by a forward recursion in log space.
Pieces do not cross words, so a text's score is the sum of its words' scores
and of the end's.  Every distinct word is scored once, in the table of words.

The vocabulary is not trained.  Its piece scores are estimated from the
training documents: all their words, counted, are segmented by the tokenizer,
and the pieces' frequencies, smoothed, are the scores.  Characters that no
piece covers fall back to their UTF-8 bytes, as in the tokenizer.

The table of words is gathered from all documents with partial sums in every
task; it counts training documents only.  The TABLE_SIZE most frequent words go
to the workers as a broadcast of bounded size; the other words of a document
meet their counts and scores in a join.  So no word that many documents share
is ever shuffled.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphwright.llm import textvec as tv
from graphwright.llm.common import table
from graphwright.llm.tokens import CACHE_BYTES, public_path

HOLD_OUT, FOLDS = 1, 5
TABLE_SIZE = 1 << 17
#: A task hands on its counts when it holds so many words.
TALLY_SIZE = 1 << 19
SPACE = "▁"
_LOG10 = math.log(10)


def held_out(doc_id):
    """True where crc32 of the id as text leaves HOLD_OUT when divided by FOLDS; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == HOLD_OUT


def _lists(column: pa.Array) -> Iterator[list[list[bytes]]]:
    """Lower-cased words of texts, a run of documents at a time."""
    data, offsets = tv.buffers(column)
    for lo, hi in tv.runs(offsets):
        whole = data[offsets[lo] : offsets[hi]].tobytes().lower()
        at = (offsets[lo : hi + 1] - offsets[lo]).tolist()
        yield [whole[a:b].split() for a, b in zip(at[:-1], at[1:], strict=True)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: tuple[Counter[bytes], Counter[bytes]] = (Counter(), Counter())  # in training and in held-out texts

    def out() -> pa.RecordBatch:
        words = [*seen[0], *seen[1]]
        n = np.zeros((2, len(words)), np.int64)
        n[0, : len(seen[0])], n[1, len(seen[0]) :] = list(seen[0].values()), list(seen[1].values())
        for x in seen:
            x.clear()
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n[0]), pa.array(n[1])], names=["word", "n", "held"])

    size = 0  # bytes of the long words in the tally, at most
    for batch in batches:
        held, at = batch.column("held_out").to_pylist(), 0
        for docs in _lists(batch.column("text")):
            for words in docs:
                tally = seen[bool(held[at])]
                tally.update(words)
                if words and max(map(len, words)) > CACHE_BYTES:
                    size += sum(len(w) for w in words if len(w) > CACHE_BYTES)
                at += 1
            if len(seen[0]) + len(seen[1]) > TALLY_SIZE or size > TALLY_SIZE * CACHE_BYTES:
                size = 0
                yield out()
    yield out()


def word_counts(docs: DataFrame) -> DataFrame:
    """word (UTF-8 bytes, lower-cased) of all texts of `docs`, n: how often it is in training texts, held: in held-out ones."""
    made = docs.select("held_out", "text").mapInArrow(_counts, "word binary, n long, held long")
    return made.groupBy("word").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))


def _piece_counts(model: str):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=public_path(model))
        total = np.zeros(sp.get_piece_size(), np.int64)
        for batch in batches:
            words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            got = sp.encode([w.decode() for w in words], num_threads=1)
            flat = np.fromiter((i for x in got for i in x), np.int64)
            np.add.at(total, flat, np.repeat(n, [len(x) for x in got]))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["piece", "n"])

    return f


def piece_scores(counts: DataFrame, n_docs: int, model: str) -> tuple[list[str], np.ndarray, float]:
    """Pieces, their natural-log probabilities and the end's, from a table of word counts.

    At most one row per piece of the vocabulary reaches the driver.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_path(model))
    got = counts.mapInArrow(_piece_counts(model), "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(sp.get_piece_size())
    n[got.column("piece").to_numpy()] = got.column("n").to_numpy()
    usable = np.array([not (sp.is_unknown(i) or sp.is_control(i)) for i in range(len(n))])
    n = np.where(usable, n + 0.5, 0)
    total = n.sum() + n_docs + 0.5
    with np.errstate(divide="ignore"):
        return [sp.id_to_piece(i) for i in range(len(n))], np.log(n / total), math.log((n_docs + 0.5) / total)


class Lattice:
    """Marginal log probability of a word over all its segmentations."""

    def __init__(self, pieces: list[str], logs: np.ndarray) -> None:
        self.bytes = [0.0] * 256
        self.logs: dict[str, float] = {}
        for piece, x in zip(pieces, logs.tolist(), strict=True):
            if x == -math.inf:
                continue
            if len(piece) == 6 and piece.startswith("<0x"):
                self.bytes[int(piece[3:5], 16)] = x
            else:
                self.logs[piece] = x
        self.longest = max(map(len, self.logs), default=1)
        self.starts = {p[:2] for p in self.logs}

    def score(self, word: bytes) -> float:
        text = SPACE + word.decode()
        n, get, starts, longest, exp = len(text), self.logs.get, self.starts, self.longest, math.exp
        best = [-math.inf] * (n + 1)  # log of the sum so far
        best[0] = 0.0
        for i in range(n):
            at = best[i]
            one = text[i]
            x = get(one)
            if x is None:  # byte fallback
                x = sum(self.bytes[b] for b in one.encode())
            self._add(best, i + 1, at + x)
            if text[i : i + 2] not in starts:
                continue
            for j in range(i + 2, min(n, i + longest) + 1):
                x = get(text[i:j])
                if x is not None:
                    x += at
                    y = best[j]
                    if y == -math.inf:
                        best[j] = x
                    elif x > y:
                        best[j] = x + math.log1p(exp(y - x))
                    else:
                        best[j] = y + math.log1p(exp(x - y))
        return best[n]

    @staticmethod
    def _add(best: list[float], j: int, x: float) -> None:
        y = best[j]
        if y == -math.inf:
            best[j] = x
        else:
            best[j] = max(x, y) + math.log1p(math.exp(-abs(x - y)))


_models: dict[str, Lattice] = {}
_tables: dict[str, tuple] = {}


def score(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """Both scores of every row of docs (doc_id, text); null texts count as empty.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: all
    training documents (not held out) are counted; scores are log10
    probabilities.  Repeated rows are documents of their own.  Without any
    training document no word is known.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    counts = table(word_counts(slim), "words")
    n_docs = slim.where("not held_out").select("doc_id").count()
    words, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    n_all, v = words + n_docs, distinct + (n_docs > 0)
    pieces, logs, end = piece_scores(counts.where("n > 0"), n_docs, model)
    shared, key, scale = spark.sparkContext.broadcast((pieces, logs)), uuid.uuid4().hex, n_all + 0.5 * (v + 1)

    def lattice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _models:
            _models.clear()
            _models[key] = Lattice(*shared.value)
        own = _models[key].score
        for batch in batches:
            scores = [own(w) / _LOG10 for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("word", "n", "held")], pa.array(scores, pa.float64())], names=["word", "n", "held", "score"])

    scored = table(counts.mapInArrow(lattice, "word binary, n long, held long, score double"), "word-scores")
    top = scored.where(F.length("word") <= CACHE_BYTES).orderBy(F.desc(F.col("n") + F.col("held")), "word").limit(TABLE_SIZE).toArrow()
    scored = scored.drop("held")
    base_of = lambda n: np.log10((n + 0.5) / scale)
    frequent = spark.sparkContext.broadcast((b"\n".join(top.column("word").to_pylist()), base_of(top.column("n").to_numpy()).tobytes(), top.column("score").to_numpy().tobytes(), top.column("n").to_numpy().tobytes()))
    top_key, end_base, end_score = uuid.uuid4().hex, float(base_of(n_docs)), end / _LOG10

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if top_key not in _tables:
            _tables.clear()
            names, base, own, n = frequent.value
            names = names.split(b"\n") if names else []
            tables = [dict(zip(names, np.frombuffer(x).tolist(), strict=True)) for x in (base, own)]
            _tables[top_key] = (*tables, {w for w, k in zip(names, np.frombuffer(n, np.int64).tolist(), strict=True) if not k})
        base, own, unseen = _tables[top_key]
        for batch in batches:
            at = 0
            for texts in _lists(batch.column("text")):
                hits, base_sums, own_sums, missed, times = [], [], [], [], []
                for x in texts:
                    got = [w for w in x if w in base]
                    miss = Counter(w for w in x if w not in base) if len(got) < len(x) else {}
                    hits.append(len(got) + (n_docs > 0) - (sum(w in unseen for w in got) if unseen else 0))
                    base_sums.append(math.fsum(map(base.__getitem__, got)) + end_base)
                    own_sums.append(math.fsum(map(own.__getitem__, got)) + end_score)
                    missed.append(list(miss))
                    times.append(list(miss.values()))
                rows = batch.slice(at, len(texts))
                at += len(texts)
                lengths = pa.array([len(x) + 1 for x in texts], pa.int64())
                arrays = [rows.column("doc_id").cast(pa.int64()), rows.column("held_out"), lengths, pa.array(hits, pa.int64()), pa.array(base_sums, pa.float64()), pa.array(own_sums, pa.float64())]
                arrays += [pa.array(missed, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "missed", "times"])

    made = slim.mapInArrow(f, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, missed array<binary>, times array<int>")
    made = table(made.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = made.select("row", F.explode(F.arrays_zip("missed", "times")).alias("m")).select("row", F.col("m.missed").alias("word"), F.col("m.times").alias("times"))
    rare = rare.join(scored, "word")
    found = rare.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).cast("long").alias("more_known"),
        F.sum(F.col("times") * F.log10((F.col("n") + 0.5) / F.lit(float(scale)))).alias("more_base"),
        F.sum(F.col("times") * F.col("score")).alias("more_score"),
    )
    out = made.drop("missed", "times").join(found, "row", "left")
    plus = lambda c, more, zero: (F.col(c) + F.coalesce(more, F.lit(zero))).alias(c)
    known, base_sum, own_sum = plus("n_known", "more_known", 0), plus("base_score", "more_base", 0.0), plus("score", "more_score", 0.0)
    return out.select("doc_id", "held_out", "n_tokens", known, F.lit(int(n_all)).cast("long").alias("train_tokens"), base_sum, own_sum)
