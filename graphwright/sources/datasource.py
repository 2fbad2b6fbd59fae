"""The data source "rdf": reading with pushed filters, and writing in parts.

spark.read.format("rdf").option("path", glob) reads local or mounted files,
N-Triples in byte ranges, other syntaxes a file a partition.  With the option
pushdown, which needs spark.sql.python.filterPushdown.enabled, filters on single
columns are met while parsing, so a scan by predicate builds no other triples;
lines of N-Triples that cannot hold a wanted predicate are not even parsed.

triples.write.format("rdf").option("path", folder).option("syntax", "turtle")
writes a document for each partition; see sinks.write_parts() for the order.
Parts have temporary names until all tasks are done.
"""

from __future__ import annotations

import glob
import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)

TRIPLES = "graph string, s string, s_kind string, p string, o string, o_kind string, o_datatype string, o_lang string, ord long"
COLUMNS = [c.split()[0] for c in TRIPLES.split(", ")]
_SCHEMA = pa.schema([(c, pa.int64() if c == "ord" else pa.string()) for c in COLUMNS])
#: Bytes of N-Triples that one task reads.
RANGE_BYTES = 32 << 20
_BATCH = 20_000


class RdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rdf"

    def schema(self) -> str:
        return TRIPLES

    def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
        return FilteringReader(self.options) if self.options.get("pushdown", "").lower() == "true" else RdfReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return RdfWriter(self.options, [f.name for f in schema.fields], overwrite)


@dataclass
class Range(InputPartition):
    path: str
    start: int = 0
    end: int | None = None  # None: the whole file, in its own syntax


def _test(f: Filter) -> Callable[[tuple], bool] | None:
    """A test of rows for a filter that can be met while parsing."""
    if len(f.attribute) != 1 or f.attribute[0] not in COLUMNS[:-1]:
        return None
    at = COLUMNS.index(f.attribute[0])
    if isinstance(f, EqualTo):
        return lambda r: r[at] == f.value
    if isinstance(f, In):
        wanted = frozenset(f.value)
        return lambda r: r[at] in wanted
    if isinstance(f, IsNotNull):
        return lambda r: r[at] is not None
    if isinstance(f, IsNull):
        return lambda r: r[at] is None
    for kind, test in ((StringStartsWith, str.startswith), (StringEndsWith, str.endswith), (StringContains, str.__contains__)):
        if isinstance(f, kind):
            return lambda r, test=test: r[at] is not None and test(r[at], f.value)
    return None


class RdfReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.options, self.filters = dict(options), []

    def partitions(self) -> list[InputPartition]:
        from graphwright.sources.rdf import detect_format

        out: list[InputPartition] = []
        size = int(self.options.get("rangebytes", RANGE_BYTES))
        for path in sorted(glob.glob(self.options["path"])):
            if (self.options.get("syntax") or detect_format(path)) == "nt":
                whole = os.path.getsize(path)
                out += [Range(path, at, min(at + size, whole)) for at in range(0, whole, size)]
            else:
                out.append(Range(path))
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        tests = [_test(f) for f in self.filters]
        batch: list[tuple] = []
        for row in self._rows(partition):
            if all(t(row) for t in tests):
                batch.append(row)
                if len(batch) >= _BATCH:
                    yield _record_batch(batch)
                    batch = []
        yield _record_batch(batch)

    def _rows(self, x: Range) -> Iterator[tuple]:
        from graphwright.sources.rdf import parse

        if x.end is None:
            with open(x.path, encoding="utf-8-sig") as f:
                yield from parse(f.read(), self.options.get("syntax"), x.path)[0]
            return
        needles = self._needles()
        with open(x.path, "rb") as f:
            # a line belongs to the range in which it begins
            if x.start:
                f.seek(x.start - 1)
                f.readline()
            while (at := f.tell()) < x.end:
                lines: list[bytes] = []
                while len(lines) < 4096 and f.tell() < x.end:
                    line = f.readline()
                    if needles is None or b"\\u" in line or b"\\U" in line or any(n in line for n in needles):
                        lines.append(line)
                for row in parse(b"".join(lines).decode(), "nt", x.path)[0]:
                    yield (*row[:-1], 2 * at + row[-1])

    def _needles(self) -> list[bytes] | None:
        """What a line must hold for its predicate to be wanted; None: any line."""
        for f in self.filters:
            if f.attribute == ("p",) and isinstance(f, (EqualTo, In)):
                return [f"<{p}>".encode() for p in ([f.value] if isinstance(f, EqualTo) else f.value) if p is not None]
        return None


class FilteringReader(RdfReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, IsNotNull, IsNull, StringStartsWith, StringEndsWith, StringContains)) and _test(f):
                self.filters.append(f)
            else:
                yield f


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(COLUMNS)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


@dataclass
class Part(WriterCommitMessage):
    made: str | None
    triples: int


class RdfWriter(DataSourceArrowWriter):
    def __init__(self, options, columns: list[str], overwrite: bool) -> None:
        self.path, self.syntax, self.columns, self.overwrite = options["path"].removeprefix("file://").removeprefix("file:"), options.get("syntax", "turtle"), columns, overwrite
        self.prefixes = dict(x.split("=", 1) for x in options.get("prefixes", "").split() if x)
        self.job = uuid.uuid4().hex
        if missing := {"s", "p", "o", "o_kind"} - set(columns):
            raise ValueError(f"triples need the columns {sorted(missing)}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        from graphwright.sources.sinks import document_lines

        context, n = TaskContext.get(), 0

        def rows() -> Iterator[dict]:
            nonlocal n
            for batch in iterator:
                n += batch.num_rows
                yield from batch.to_pylist()

        os.makedirs(self.path, exist_ok=True)
        made = f"{self.path}/.part-{context.partitionId():05d}-{context.taskAttemptId()}-{self.job}"
        with open(made, "w", encoding="utf-8") as f:
            for line in document_lines(rows(), self.syntax, self.prefixes or None):
                f.write(line + "\n")
        if not n:
            os.remove(made)
        return Part(made if n else None, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        extension = {"turtle": "ttl", "n3": "n3", "xml": "rdf", "nt": "nt"}[self.syntax]
        if self.overwrite:
            for old in glob.glob(f"{self.path}/part-*"):
                os.remove(old)
        for m in messages:
            if m and m.made:
                os.replace(m.made, f"{self.path}/{os.path.basename(m.made)[1:]}.{extension}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for left in glob.glob(f"{self.path}/.part-*-{self.job}"):
            os.remove(left)
