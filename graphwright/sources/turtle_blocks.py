"""Turtle read in blocks of a file, like any splittable text.

A file is split where Spark splits it.  What a block cannot know alone are
three things: whether it begins within a long string, how the statement ends
that the block before began, and which prefixes hold.

* Every block is scanned as if it began in each of the three states that a line
  can begin in (no string, a long string in either kind of quotes), which gives
  a function from the state at its start to that at its end.  Composed along
  the file (a few numbers for each block), these give the true states.
* The scan also leaves the block's directives.  Those that change nothing are
  left out along the file; the others, which are few, go to all tasks.
* Then blocks are parsed alone, each once; what they cannot parse, the head of
  their text and its tail, make whole statements with those of their neighbours.

A task works off many blocks, so their size does not set the number of tasks.

A file in which a directive itself crosses a block is read whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwright.plans.tables import settled
from graphwright.sources.turtle import _LEXER, Term, Turtle

#: States of a line's start, and how a long string ends.
_LONG_END = {"double": re.compile(r'(?:(?:"|"")?(?:[^"\\]|\\.))*"""', re.S), "single": re.compile(r"(?:(?:'|'')?(?:[^'\\]|\\.))*'''", re.S)}
_STATES = ("plain", "double", "single")
_OPENS = {'"""': "double", "'''": "single"}
#: Directives of all files that change something; more are refused.
MOST_DIRECTIVES = 100_000
#: Triples of one batch that a task hands on.
_BATCH = 20_000
#: Bytes of text that a task works off.
TASK_BYTES = 32 << 20
_SCANS = "path string, start long, state string, end_state string, directives array<string>, cut boolean"
_MARK = re.compile("prefix|base", re.I)


def scan(text: str, state: str) -> dict:
    """What a block leaves if it begins in a state.

    end_state; dots (whether a statement ends in it); head (up to the first
    statement's end), tail (behind the last one's); directives (texts, in
    order); cut (whether a directive is not finished).
    """
    out = {"state": state, "end_state": state, "dots": False, "head": text, "tail": "", "tail_at": 0, "directives": [], "cut": False}
    at = 0
    if state != "plain":
        m = _LONG_END[state].match(text)
        if not m:
            return out
        at = m.end()
    first = last = None
    directive: list[str] | None = None
    out["end_state"] = "plain"
    while at < len(text):
        opened = _OPENS.get(text[at : at + 3])
        m = _LEXER.match(text, at)
        if opened and (not m or m.lastgroup != "long"):
            out["end_state"] = opened
            break
        if not m:  # whoever parses it tells
            at += 1
            continue
        at = m.end()
        kind = m.lastgroup
        if kind == "directive":
            directive = [m[0]]
        elif kind == "skip":
            continue
        elif directive is not None:
            directive.append(m[0])
            needs = (3 if directive[0].strip("@").lower() == "prefix" else 2) + directive[0].startswith("@")
            if len(directive) == needs:
                out["directives"].append(" ".join(directive))
                directive = None
        if kind == "sign" and m[0] == ".":
            first, last = at if first is None else first, at
    out["cut"] = directive is not None
    if first is not None:
        out |= {"dots": True, "head": text[:first], "tail": text[last:], "tail_at": last}
    return out


class _Block(Turtle):
    """Parses what is whole in a text; `rest` is where the first statement begins that does not end."""

    def __init__(self, text: str, base: str, scope: str, fresh: str, prefixes: dict[str, str]) -> None:
        self.at_end, self.rest, self.fresh = 0, 0, fresh
        self.text = text
        super().__init__(text, base, scope)
        self.prefixes = dict(prefixes)

    def _tokens(self, text: str) -> Iterator[tuple[str, str]]:  # type: ignore[override]
        at = 0
        while at < len(text):
            m = _LEXER.match(text, at)
            if not m or text[at : at + 3] in _OPENS and m.lastgroup != "long":
                break
            at = m.end()
            if m.lastgroup != "skip":
                self.at_end = at
                yield m.lastgroup, m[0]
        while True:
            yield "end", ""

    def _fresh(self):
        self.made += 1
        return Term("bnode", f"_:{self.scope}{self.fresh}b{self.made}")

    def triples(self):
        while self.kind != "end":
            out, directive = [], self.kind == "directive"
            sparql = directive and not self.value.startswith("@")
            try:
                if directive:
                    self._directive_unfinished()
                else:
                    bare = self.value == "["
                    subject = self._term(out)
                    if not (bare and self.value == "."):
                        self._predicates(subject, out)
                if not sparql:
                    stop = self.at_end
                    self._take(".")
                    self.rest = stop
            except ValueError:
                if self.kind == "end":
                    return
                raise
            yield from out

    def _directive_unfinished(self) -> None:
        """A directive without its full stop."""
        word = self._next()[1].strip("@").lower()
        if word == "prefix":
            name = self._next()[1].rstrip(":")
            self.prefixes[name] = self._iri(*self._next())
        else:
            self.base = self._iri(*self._next())


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str]]:
    """path, start and text of each block, from its lines in order."""
    key, lines = None, []
    for batch in batches:
        for path, start, value in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "value")), strict=True):
            if (path, start) != key:
                if key:
                    yield *key, "\n".join(lines) + "\n"
                key, lines = (path, start), []
            lines.append(value)
    if key:
        yield *key, "\n".join(lines) + "\n"


def changes(directives: list[str], known: dict[str, str] | None = None) -> list[str]:
    """The directives without those that state what holds anyway; `known` has the prefixes' IRIs so far and is kept up to date."""
    known, out = {} if known is None else known, []
    for text in directives:
        word, *rest = text.split(" ")
        if word.strip("@").lower() == "base":
            known.clear()  # the same IRI may mean another one now
            out.append(text)
        elif not rest[1].startswith("<"):
            known.pop(rest[0], None)
            out.append(text)
        elif known.get(rest[0]) != rest[1]:
            known[rest[0]] = rest[1]
            out.append(text)
    return out


def _scans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for path, start, text in _blocks(batches):
        text = text.removeprefix("\ufeff") if start == 0 else text
        found = []
        for s in _STATES if start else _STATES[:1]:
            # without its quotes in the block, a long string goes on through all of it; without any, and without directives, nothing changes
            if s == "plain" and not _MARK.search(text) and not any(q in text for q in _OPENS) or s != "plain" and _QUOTES[s] not in text:
                x = {"end_state": s, "directives": [], "cut": False}
            else:
                x = scan(text, s)
            found.append({"path": path, "start": start, "state": s, "end_state": x["end_state"], "directives": changes(x["directives"]), "cut": x["cut"]})
        yield pa.RecordBatch.from_pylist(found, schema=_SCANS_ARROW)


_QUOTES = {v: k for k, v in _OPENS.items()}
_SCANS_ARROW = pa.schema([("path", pa.string()), ("start", pa.int64()), ("state", pa.string()), ("end_state", pa.string()), ("directives", pa.list_(pa.string())), ("cut", pa.bool_())])


def _true_states(scans: DataFrame) -> DataFrame:
    """path, start, state, directives, cut of every block: the functions of a file's blocks composed, a row of a few texts for each block.

    Directives are those that change something along the file.
    """

    def f(batch: pd.DataFrame) -> pd.DataFrame:
        state, out, known = "plain", [], {}
        by = {(r.start, r.state): r for r in batch.itertuples(index=False)}
        for start in sorted(set(batch["start"])):
            x = by[start, state]
            out.append((x.path, start, state, changes(list(x.directives), known), x.cut))
            state = x.end_state
        return pd.DataFrame(out, columns=["path", "start", "state", "directives", "cut"])

    return scans.groupBy("path").applyInPandas(f, "path string, start long, state string, directives array<string>, cut boolean")


def _crossing(true: DataFrame) -> DataFrame:
    """path, start, at, text of the statements that cross blocks: they begin behind `at` characters of the block `start`."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("path").orderBy("start")
    before = F.last(F.when(F.col("dots"), F.col("start")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    first = F.min("start").over(Window.partitionBy("path"))
    rows = true.withColumns({"owner": F.coalesce(before, F.lit(-1)), "first": first})
    # the first block's head is parsed with it, unless no statement ends there
    heads = rows.where("start > first or not dots").select("path", F.col("owner").alias("from"), "start", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("at"), F.col("head").alias("text"))
    tails = rows.where("dots").select("path", F.col("start").alias("from"), "start", F.lit(1).alias("piece"), F.col("tail_at").alias("at"), F.col("tail").alias("text"))
    pieces = heads.unionByName(tails).groupBy("path", "from").agg(F.array_sort(F.collect_list(F.struct("start", "piece", "at", "text"))).alias("x"))
    return pieces.select("path", F.col("from").alias("start"), F.col("x")[0]["at"].alias("at"), F.array_join(F.transform("x", lambda e: e["text"]), "").alias("text"))


@contextmanager
def _block_size(spark: SparkSession, size: str | None) -> Iterator[None]:
    """Files are read in blocks of so many bytes, if a size is named."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size or old)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def read_turtle(spark: SparkSession, path: str, base: str = "", whole: Callable[[str, str], list[tuple]] | None = None, block: str | None = None) -> DataFrame:
    """The triples of Turtle files (a path, folder or glob), each file read in blocks: as many as Spark splits it into, or of the size `block`.

    A statement must fit a worker's memory, a file's directives all of them.
    Relative IRIs and labels of blank nodes are the file's.  Rows of TRIPLES,
    not yet distinct; `whole` parses one file whole: (name, text) to rows.
    """
    from graphwright.sources.rdf import COLUMNS, TRIPLES, hash_name, parse

    whole = whole or (lambda name, text: parse(text, "turtle", name, base)[0])
    place = "_metadata.file_path as path", "_metadata.file_block_start as start"
    lines = spark.read.option("lineSep", "\n").text(path).selectExpr(*place, "value")
    total = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    lines = lines.coalesce(max(4 * spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES)))
    with _block_size(spark, block):
        scans = settled(lines.mapInArrow(_scans, _SCANS))
    true = settled(_true_states(scans))
    cut = [r[0] for r in true.where("cut").select("path").distinct().collect()]  # names of files that are read whole
    inside = {(r[0], r[1]): r[2] for r in true.where("state <> 'plain'").select("path", "start", "state").collect()}  # blocks, at most as many as there are
    stated = true.where(F.size("directives") > 0).select("path", "start", "directives")
    if (n := stated.agg(F.sum(F.size("directives"))).first()[0] or 0) > MOST_DIRECTIVES:
        raise ValueError(f"{n} directives are too many for a prologue")
    directives: dict[str, list[tuple[int, list[str]]]] = {}
    for r in stated.collect():
        directives.setdefault(r["path"], []).append((r["start"], r["directives"]))
    for x in directives.values():
        x.sort()
    shared = spark.sparkContext.broadcast((inside, directives, set(cut)))

    def declared(texts: list[str], at: str, prefixes: dict[str, str]) -> tuple[str, dict[str, str]]:
        prefixes = dict(prefixes)
        for text in texts:
            part = Turtle(text, at, "")
            part.prefixes = prefixes
            part._directive()
            at = part.base
        return at, prefixes

    def environment(name: str, before: int) -> tuple[str, dict[str, str]]:
        """Base and prefixes that hold at the start of a block."""
        return declared([text for start, texts in shared.value[1].get(name, []) if start < before for text in texts], base, {})

    def rows(name: str, reader: Turtle, first: int) -> Iterator[pa.RecordBatch]:
        batch: list[tuple] = []
        for i, (subject, p, o) in enumerate(reader.triples()):
            batch.append((name, subject.value, subject.kind, p, o.value, o.kind, o.datatype, o.lang, first + i))
            if len(batch) >= _BATCH:
                yield _columns(batch)
                batch = []
        yield _columns(batch)

    def parse_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, _, skipped = shared.value
        for name, start, text in _blocks(batches):
            if name in skipped:
                continue
            text = text.removeprefix("\ufeff") if start == 0 else text
            at, prefixes = environment(name, start)
            found = 0
            if start:
                state = starts.get((name, start), "plain")
                found = scan_head(text, state)
                if found is None:
                    yield _fragment(name, start, False, text, None, 0)
                    continue
                # directives before the first statement's end hold too
                if _MARK.search(text, 0, found) and (own := scan(text[:found], state)["directives"]):
                    at, prefixes = declared(own, at, prefixes)
            reader = _Block(text[found:], at, f"{abs(hash_name(name)):x}-", f"{start:x}-", prefixes)
            for batch in rows(name, reader, 2 * start):
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.nulls(batch.num_rows, f.type) for f in _FRAGMENT_ARROW)], schema=_PARSED_ARROW)
            if start or reader.rest:
                yield _fragment(name, start, True, text[:found], text[found + reader.rest :], found + reader.rest)
            else:
                yield _fragment(name, start, False, text, None, 0)

    def parse_crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start, place, text in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "at", "text")), strict=True):
                if name in shared.value[2] or not text.strip():
                    continue
                at, prefixes = environment(name, start + 1)
                reader = _Block(text, at, f"{abs(hash_name(name)):x}-", f"{max(start, 0):x}x-", prefixes)
                yield from rows(name, reader, 2 * max(start, 0) + place)
                if text[reader.rest :].strip() and _has_tokens(text[reader.rest :]):
                    raise ValueError(f"no Turtle at {text[reader.rest :].strip()[:60]!r}")

    with _block_size(spark, block):
        parsed = settled(lines.mapInArrow(parse_blocks, f"{TRIPLES}, {_FRAGMENT}"))
    true = parsed.where("start is not null").select(F.col("graph").alias("path"), "start", "dots", "head", "tail", "tail_at")
    out = parsed.where("start is null").select(*COLUMNS).unionByName(settled(_crossing(true)).mapInArrow(parse_crossing, TRIPLES))
    if cut:

        def parse_whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for name, content in zip(batch["path"], batch["content"], strict=True):
                    yield pd.DataFrame(whole(name, bytes(content).decode("utf-8-sig")), columns=COLUMNS)

        out = out.unionByName(spark.read.format("binaryFile").load([unquote(x) for x in cut]).select("path", "content").mapInPandas(parse_whole, TRIPLES))
    return out


def scan_head(text: str, state: str) -> int | None:
    """Where the first statement ends in a block that begins in a state; None if none does."""
    at = 0
    if state != "plain":
        m = _LONG_END[state].match(text)
        if not m:
            return None
        at = m.end()
    while at < len(text):
        m = _LEXER.match(text, at)
        if text[at : at + 3] in _OPENS and (not m or m.lastgroup != "long"):
            return None
        at = m.end() if m else at + 1
        if m and m.lastgroup == "sign" and m[0] == ".":
            return at
    return None


def _has_tokens(text: str) -> bool:
    m = _LEXER.match(text)
    return not (m and m.lastgroup == "skip" and m.end() == len(text))


#: What a block leaves beside triples: the head and tail of its text, and whether a statement ends in it.
_FRAGMENT = "start long, dots boolean, head string, tail string, tail_at long"
_FRAGMENT_ARROW = [pa.field("start", pa.int64()), pa.field("dots", pa.bool_()), pa.field("head", pa.string()), pa.field("tail", pa.string()), pa.field("tail_at", pa.int64())]
_TRIPLES_ARROW = pa.schema([*[(n, pa.string()) for n in ("graph", "s", "s_kind", "p", "o", "o_kind", "o_datatype", "o_lang")], ("ord", pa.int64())])

_PARSED_ARROW = pa.schema([*_TRIPLES_ARROW, *_FRAGMENT_ARROW])


def _fragment(path: str, start: int, dots: bool, head: str, tail: str | None, tail_at: int) -> pa.RecordBatch:
    row = {"graph": path, "start": start, "dots": dots, "head": head, "tail": tail, "tail_at": tail_at}
    return pa.RecordBatch.from_pylist([row], schema=_PARSED_ARROW)


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_TRIPLES_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _TRIPLES_ARROW, strict=True)], schema=_TRIPLES_ARROW)
