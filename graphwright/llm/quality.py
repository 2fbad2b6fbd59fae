"""Quality rules with risk-controlled thresholds.

Rules reject a document where a feature reaches a cutoff.  Cutoffs come from
labelled documents, in every stratum (language) for itself:

1.  A third of the labelled documents, chosen by a hash of their doc_id, of
    which FIT_ROWS at most are used per stratum, gives an order in which the
    rules' cutoffs of a fixed grid are tightened: what catches most bad
    documents and spares good ones comes first, lenient cutoffs before strict
    ones.  This is a list of steps (rule, cutoff); it decides nothing else.
2.  On all the others, the holdout, the rules together are tested after each
    step: the exact (Clopper-Pearson) upper bound of the share of good
    documents that they reject must stay within RISK.  The first step that
    fails ends the sequence.

The steps do not depend on the holdout, so a stratum's tests in sequence cost
one test of its level, DELTA over the number of strata (Bonferroni).  With
probability 1 - DELTA no stratum loses more than RISK of its good documents.
A stratum with too few labels certifies no step and loses nothing: with k
strata one step without any false rejection needs log(DELTA / k) / log(1 - RISK)
good documents in the holdout, 59 for one stratum and 90 for five.

Features come from one vectorised pass over the texts.  Steps, counts and
cutoffs are tables with a few rows per stratum; there may be any number of
strata, and none of this reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from graphwright.llm import textvec as tv
from graphwright.llm.common import table

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
RISK, DELTA = 0.05, 0.05
#: A good document rejected weighs as much as so many bad ones caught.
GOOD_WEIGHT = 10
#: Labelled documents of a stratum that order its steps, at most; the bound of a sample, not of the holdout.
FIT_ROWS = 4096
#: Cutoffs of each rule, lenient ones first; a feature at or above the cutoff rejects.
GRID = {
    "symbol_rate": [round(3.0 - 0.1 * i, 2) for i in range(28)],
    "dup_line_rate": [round(1.0 - 0.05 * i, 2) for i in range(17)],
    "repeat_rate": [round(1.0 - 0.05 * i, 2) for i in range(17)],
    "long_word": [round(40.0 - 2 * i, 1) for i in range(15)],
    "short_word": [round(-1.0 - 0.1 * i, 1) for i in range(20)],
}
RULES = list(GRID)

_SYMBOL = np.zeros(256, np.int32)
_SYMBOL[list(SYMBOLS)] = 1
_POINT = np.ones(256, np.int32)
_POINT[0x80:0xC0] = 0
_POINT[[0x20, 9, 10, 11, 12, 13]] = 0

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ", ".join([f"{c} long" for c in COUNTS] + [f"{r} double" for r in RULES])


def _per_doc(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeat_words(words: np.ndarray, by_doc: np.ndarray) -> np.ndarray:
    """Per document, words that lie in a three-word window found twice or more."""
    windows, at = tv.shingle_hashes(words, by_doc, 3)
    doc = np.repeat(np.arange(len(by_doc) - 1), np.diff(at))
    own = tv.mix(windows + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(own)
    same = own[order][1:] == own[order][:-1]
    twice = np.zeros(len(own), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    start = np.flatnonzero(twice)
    start = start - at[doc[start]] + by_doc[doc[start]]
    covered = np.zeros(len(words) + 3, bool)
    for i in range(3):
        covered[start + i] = True
    return _per_doc(covered[: len(words)], by_doc)


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw, n, dup = data.tobytes(), [], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        lines = [x for x in raw[a:b].split(b"\n") if x and not x.isspace()]
        n.append(len(lines))
        dup.append(len(lines) - len(set(lines)))
    return np.array(n, np.int64), np.array(dup, np.int64)


def features(column: pa.Array) -> dict[str, np.ndarray]:
    """Counts and rule features of each text; null counts as empty."""
    data, offsets = tv.buffers(column)
    out: dict[str, list] = {c: [] for c in [*COUNTS, *RULES]}
    for lo, hi in tv.runs(offsets):
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, by_doc = tv.word_bounds(part, at)
        words = tv.word_hashes(part, starts, ends, fold=False)
        n_words, chars = np.diff(by_doc), _per_doc(_POINT[part], at)
        n_symbols, (n_lines, n_dup) = _per_doc(_SYMBOL[part], at), _lines(part, at)
        n_repeat = _repeat_words(words, by_doc)
        per_word = lambda x, n=np.maximum(n_words, 1): x / n
        for name, x in {
            "n_words": n_words,
            "word_chars": chars,
            "n_symbols": n_symbols,
            "n_dup_lines": n_dup,
            "n_repeat_words": n_repeat,
            "symbol_rate": per_word(n_symbols),
            "dup_line_rate": n_dup / np.maximum(n_lines, 1),
            "repeat_rate": per_word(n_repeat),
            "long_word": per_word(chars),
            "short_word": np.where(n_words > 0, -per_word(chars), -1e9),
        }.items():
            out[name].append(x)
    return {c: np.concatenate(x) if x else np.zeros(0) for c, x in out.items()}


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        f = features(batch.column("text"))
        arrays = [batch.column("doc_id").cast(pa.int64()), batch.column("lang"), batch.column("digest")]
        arrays += [pa.array(f[c].astype(np.int64)) for c in COUNTS] + [pa.array(f[r].astype(np.float64)) for r in RULES]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "lang", "digest", *COUNTS, *RULES])


def feature_table(docs: DataFrame) -> DataFrame:
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("digest"), "text")
    return slim.mapInArrow(_feature_rows, f"doc_id long, lang string, digest long, {FEATURES}")


def upper_bound(rejected: int, n: int, level: float) -> float:
    """Clopper-Pearson: the largest rate at which at most `rejected` of n has probability `level`."""
    if n == 0 or rejected >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(rejected + 1)]
    lo, hi = rejected / n, 1.0
    for _ in range(60):
        p = (lo + hi) / 2
        tail = sum(math.exp(c + i * math.log(p) + (n - i) * math.log1p(-p)) for i, c in enumerate(logs)) if p < 1 else 0.0
        lo, hi = (p, hi) if tail > level else (lo, p)
    return hi


def steps(values: np.ndarray, quality: np.ndarray) -> list[tuple[int, float]]:
    """(rule, cutoff) one after the other, from features (a column per rule) of labelled documents.

    Time and again, of all rules and stricter cutoffs the one with the best
    balance of bad and good documents newly rejected is aimed at; on the way
    there every cutoff that catches another bad document is a step.
    """
    out: list[tuple[int, float]] = []
    at, left = [0] * len(RULES), np.ones(len(quality), bool)
    while True:
        best = (0, 0, 0)
        for r, rule in enumerate(RULES):
            for i in range(at[r], len(GRID[rule])):
                hit = left & (values[:, r] >= GRID[rule][i])
                gain = int((hit & (quality == 0)).sum()) - GOOD_WEIGHT * int((hit & (quality == 1)).sum())
                if gain > best[0]:
                    best = (gain, r, i + 1)
        gain, r, end = best
        if not gain:
            return out
        for cut in GRID[RULES[r]][at[r] : end]:
            hit = left & (values[:, r] >= cut)
            if (hit & (quality == 0)).any():
                out.append((r, cut))
                left &= ~hit
        at[r] = end


def certified(good: list[int], n_good: int, level: float, risk: float) -> int:
    """How many steps hold in sequence; good: good documents newly rejected by each."""
    rejected = 0
    for i, g in enumerate(good):
        rejected += g
        if upper_bound(rejected, n_good, level) > risk:
            return i
    return len(good)


#: SQL for the third of the documents that orders the steps.
_PART = "pmod(xxhash64(31, doc_id), 3) = 0"
_CUTS = ", ".join(f"{r} double" for r in RULES)


def _sample(labelled: DataFrame, most: int) -> DataFrame:
    """Rows of a third of the documents, about `most` per stratum at most: the lowest of 65,536 buckets of a hash, up to the one that brings them there."""
    part = labelled.where(_PART).withColumn("bucket", F.expr("pmod(xxhash64(32, doc_id), 65536)"))
    sizes = part.groupBy("stratum", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("stratum").orderBy("bucket")) - F.col("n")
    return part.join(sizes.withColumn("before", before).where(F.col("before") < most).select("stratum", "bucket"), ["stratum", "bucket"])


def _order(rows: pd.DataFrame) -> pd.DataFrame:
    found = steps(rows[RULES].to_numpy(), rows["quality"].to_numpy())
    own = rows["stratum"].iloc[0]
    return pd.DataFrame([(own, i, r, c) for i, (r, c) in enumerate(found)], columns=["stratum", "step", "rule", "cut"])


def _upto(level: float, risk: float):
    def f(rows: pd.DataFrame) -> pd.DataFrame:
        """rows: stratum, step, rule, cut, good (newly rejected good documents), n_good."""
        rows = rows.sort_values("step")
        kept = rows.iloc[: certified(rows["good"].tolist(), int(rows["n_good"].iloc[0]), level, risk)]
        last = {RULES[r]: c for r, c in zip(kept["rule"], kept["cut"], strict=True)}
        return pd.DataFrame([{"stratum": rows["stratum"].iloc[0]} | {r: last.get(r) for r in RULES}]).astype({r: "float64" for r in RULES})

    return f


def fit(feats: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, most: int = FIT_ROWS) -> DataFrame:
    """stratum, and the cutoff of each rule or null: a table() from all labelled documents of `feats`.

    A document that is there several times has one label, and so have equal
    texts of a stratum: their worst.

    labels: doc_id, quality (1 good, 0 bad).  A stratum without certified steps
    has no row, or one of nulls.
    """
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.min("quality").alias("quality"))
    seen = feats.where(f"n_words >= {MIN_WORDS} and 100 * n_repeat_words <= {MAX_REPEAT_PERCENT} * n_words").join(marks, "doc_id")
    values = F.struct(*RULES).alias("values")
    # the bounds hold for independent labels: one for each document, and one for equal texts, the worst
    of_document = seen.select("doc_id", "quality", _stratum(F.col("lang")).alias("stratum"), "digest", values).groupBy("doc_id").agg(F.min(F.struct("digest", "stratum", "quality", "values")).alias("x"))
    of_text = of_document.groupBy("x.stratum", "x.digest").agg(F.min("doc_id").alias("doc_id"), F.min("x.quality").alias("quality"), F.min("x.values").alias("values"))
    labelled = table(of_text.select("doc_id", "stratum", "quality", "values.*"), "labelled")
    strata = table(labelled.where(f"not ({_PART})").groupBy("stratum").agg(F.count_if(F.col("quality") == 1).alias("n_good")), "strata")
    order = table(_sample(labelled, most).select("stratum", "quality", *RULES).groupBy("stratum").applyInPandas(_order, "stratum string, step int, rule int, cut double"), "steps")
    path = order.groupBy("stratum").agg(F.array_sort(F.collect_list(F.struct("step", "rule", "cut"))).alias("path"))
    values = F.array(*RULES)
    first = F.array_min(F.transform("path", lambda x: F.when(F.get(values, x["rule"]) >= x["cut"], x["step"])))
    rejected = labelled.where(f"quality = 1 and not ({_PART})").join(path, "stratum").select("stratum", first.alias("step")).where("step is not null")
    counts = rejected.groupBy("stratum", "step").agg(F.count(F.lit(1)).alias("good"))
    tested = order.join(counts, ["stratum", "step"], "left").join(strata, "stratum").fillna(0, ["good"])
    level = delta / max(1, strata.count())
    return table(tested.groupBy("stratum").applyInPandas(_upto(level, risk), f"stratum string, {_CUTS}"), "cutoffs")


def _stratum(lang: Column) -> Column:
    """A language as a string that is never null."""
    return F.when(lang.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), lang))


def _kept(feats: DataFrame, cuts: DataFrame) -> DataFrame:
    """feats, which has a column stratum, with base_failed and kept.

    The table of cutoffs has a row per stratum; the planner broadcasts it where
    it is small, and a hot stratum is split by adaptive execution where not.
    """
    own = cuts.select("stratum", *[F.col(r).alias(f"cut_{r}") for r in RULES])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    reached = reduce(lambda a, b: a | b, [F.coalesce(F.col(r) >= F.col(f"cut_{r}"), F.lit(False)) for r in RULES])
    return feats.join(own, "stratum", "left").withColumn("base_failed", failed).withColumn("kept", ~failed & ~reached)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every row of docs (doc_id, text, lang).

    Null texts count as empty and fail the base rule.  Null languages are a
    stratum.  Labels with nulls are ignored, several of one document count as
    the worst.  Repeated rows get one verdict each.  Other columns are not
    looked at.
    """
    feats = table(feature_table(docs), "features")
    judged = _kept(feats.withColumn("stratum", _stratum(F.col("lang"))), fit(feats, labels))
    return judged.select("doc_id", *COUNTS, "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that stay, columns as they came, whatever their names; repeated rows stay or go together.

    Texts are measured twice, for the cutoffs and for the verdict, and never shuffled.
    """
    cuts = fit(feature_table(docs), labels)
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = {c.lower(): n for c, n in zip(docs.columns, names, strict=True)}
    plain = docs.toDF(*names).withColumn("stratum", _stratum(F.col(at["lang"]).cast("string")))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(at["text"]))
            arrays = [pa.array(x["n_words"].astype(np.int64)), pa.array(x["n_repeat_words"].astype(np.int64)), *[pa.array(x[r].astype(np.float64)) for r in RULES]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, "n_words", "n_repeat_words", *RULES])

    measured = T.StructType([*plain.schema.fields, *T._parse_datatype_string(f"n_words long, n_repeat_words long, {_CUTS}").fields])
    kept = _kept(plain.mapInArrow(f, measured), cuts).where("kept")
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
