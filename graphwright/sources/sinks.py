"""Writers: N-Triples, NDJSON, and Turtle and RDF/XML in parts, in parallel; single documents for graphs of moderate size."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain, islice
from pathlib import Path
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright.functions import vocab as v


def _escaped(text: Column) -> Column:
    for raw, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def ntriples_lines(triples: DataFrame) -> DataFrame:
    """value: one N-Triples line for each triple."""
    node = lambda c, kind: F.when(F.col(kind) == "bnode", F.col(c)).otherwise(F.concat(F.lit("<"), F.col(c), F.lit(">")))
    t = triples
    for name, default in (("s_kind", F.lit("uri")), ("o_datatype", F.lit(None).cast("string")), ("o_lang", F.lit(None).cast("string"))):
        if name not in t.columns:
            t = t.withColumn(name, default)
    suffix = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).when(F.col("o_datatype").isNotNull(), F.concat(F.lit("^^<"), "o_datatype", F.lit(">"))).otherwise("")
    literal = F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"'), suffix)
    target = F.when(F.col("o_kind") == "literal", literal).otherwise(node("o", "o_kind"))
    return t.select(F.concat(node("s", "s_kind"), F.lit(" <"), "p", F.lit("> "), target, F.lit(" .")).alias("value"))


def write_ntriples(triples: DataFrame, path: str) -> None:
    ntriples_lines(triples).write.mode("overwrite").text(path)


def jsonld_nodes(triples: DataFrame) -> DataFrame:
    """s, node: the expanded JSON-LD object of each subject."""
    quote = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    t = triples.withColumn("o_lang", F.col("o_lang") if "o_lang" in triples.columns else F.lit(None).cast("string"))
    literal = F.concat(F.lit('{"@value":'), quote("o"), F.when(F.col("o_lang").isNotNull(), F.concat(F.lit(',"@language":'), quote("o_lang"))).when(F.col("o_datatype").isNotNull(), F.concat(F.lit(',"@type":'), quote("o_datatype"))).otherwise(""), F.lit("}"))
    value = F.when(F.col("p") == v.TYPE, quote("o")).when(F.col("o_kind") == "literal", literal).otherwise(F.concat(F.lit('{"@id":'), quote("o"), F.lit("}")))
    by_property = t.withColumn("x", value).groupBy("s", "p").agg(F.array_join(F.array_sort(F.collect_list("x")), ",").alias("x"))
    key = F.when(F.col("p") == v.TYPE, F.lit('"@type"')).otherwise(quote("p"))
    pairs = by_property.withColumn("x", F.concat(key, F.lit(":["), "x", F.lit("]"))).groupBy("s").agg(F.array_join(F.array_sort(F.collect_list("x")), ",").alias("x"))
    return pairs.select("s", F.concat(F.lit('{"@id":'), quote("s"), F.lit(","), "x", F.lit("}")).alias("node"))


def write_jsonld(triples: DataFrame, path: str) -> None:
    """One JSON-LD object a line."""
    jsonld_nodes(triples).select(F.col("node").alias("value")).write.mode("overwrite").text(path)


#: Rows of what is written as one document, through the driver; more are refused.
DOCUMENT_ROWS = 1_000_000


def bounded(df: DataFrame, most: int | None = None) -> DataFrame:
    """The table, if it has no more rows than one document may."""
    most = DOCUMENT_ROWS if most is None else most
    if df.limit(most + 1).count() > most:
        raise ValueError(f"over {most} rows are too many for one document; write N-Triples or lines of JSON instead")
    return df


def _sorted(triples: DataFrame) -> Iterator:
    bounded(triples)
    yield from triples.select("s", "p", "o", "o_kind", "o_datatype", "o_lang").orderBy("s", "p", "o").toLocalIterator()


def _short(uri: str, prefixes: dict[str, str]) -> str:
    for name, ns in prefixes.items():
        rest = uri[len(ns) :]
        if uri.startswith(ns) and re.fullmatch(r"[A-Za-z_][\w-]*", rest):
            return f"{name}:{rest}"
    return uri if uri.startswith("_:") else f"<{uri}>"


def _ended(lines: Iterator[tuple[bool, str]]) -> Iterator[str]:
    """Lines of Turtle: what another line of the same subject follows ends with a semicolon."""
    held = None
    for more, line in lines:
        if held is not None:
            yield held + (" ;" if more else " .")
        held = line
    if held is not None:
        yield held + " ."


def turtle_lines(rows: Iterator, names: dict[str, str]) -> Iterator[str]:
    """A Turtle document from rows that come subject by subject."""
    yield from (f"@prefix {k}: <{x}> ." for k, x in names.items())
    yield ""

    def statements() -> Iterator[tuple[bool, str]]:
        subject = None
        for r in rows:
            if r["o_kind"] == "literal":
                tag = f"@{r['o_lang']}" if r.get("o_lang") else f"^^{_short(r['o_datatype'], names)}" if r.get("o_datatype") else ""
                value = json.dumps(r["o"], ensure_ascii=False) + tag
            else:
                value = _short(r["o"], names)
            line = f"{'a' if r['p'] == v.TYPE else _short(r['p'], names)} {value}"
            yield (True, f"    {line}") if r["s"] == subject else (False, f"{_short(r['s'], names)} {line}")
            subject = r["s"]

    yield from _ended(statements())


_NOT_XML = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")


def rdfxml_lines(rows: Iterator, names: dict[str, str]) -> Iterator[str]:
    """An RDF/XML document from rows that come subject by subject; predicates in a namespace without prefix declare it themselves."""
    head = " ".join(f"xmlns:{k}={quoteattr(x)}" for k, x in names.items())
    yield '<?xml version="1.0" encoding="UTF-8"?>'
    yield f"<rdf:RDF {head}>"
    prefix_of, subject = {x: k for k, x in names.items()}, None
    for r in rows:
        if r["s"] != subject:
            if subject is not None:
                yield "  </rdf:Description>"
            subject = r["s"]
            about = f"rdf:nodeID={quoteattr(subject[2:])}" if subject.startswith("_:") else f"rdf:about={quoteattr(subject)}"
            yield f"  <rdf:Description {about}>"
        m = re.search(r"[^\W\d][\w.-]*$", r["p"])
        if not m:
            raise ValueError(f"RDF/XML has no name for the predicate {r['p']}")
        ns, local = r["p"][: m.start()], m[0]
        own = "" if ns in prefix_of else f" xmlns:ns={quoteattr(ns)}"
        tag = f"{prefix_of.get(ns, 'ns')}:{local}"
        if r["o_kind"] == "literal":
            if _NOT_XML.search(r["o"]):
                raise ValueError(f"XML has no such characters: {r['o'][:60]!r}")
            extra = f" xml:lang={quoteattr(r['o_lang'])}" if r.get("o_lang") else f" rdf:datatype={quoteattr(r['o_datatype'])}" if r.get("o_datatype") else ""
            yield f"    <{tag}{own}{extra}>{escape(r['o']).replace(chr(13), '&#13;')}</{tag}>"
        else:
            ref = f"rdf:nodeID={quoteattr(r['o'][2:])}" if r["o"].startswith("_:") else f"rdf:resource={quoteattr(r['o'])}"
            yield f"    <{tag}{own} {ref}/>"
    if subject is not None:
        yield "  </rdf:Description>"
    yield "</rdf:RDF>"


def document_lines(rows: Iterator, syntax: str, prefixes: dict[str, str] | None = None) -> Iterator[str]:
    """The lines of a document in Turtle, N3 or RDF/XML."""
    names = {"rdf": v.RDF} | (prefixes or v.PREFIXES)
    if syntax not in ("turtle", "n3", "xml"):
        raise ValueError(f"no writer of {syntax!r} in parts")
    return rdfxml_lines(rows, names) if syntax == "xml" else turtle_lines(rows, names)


def to_turtle(triples: DataFrame, prefixes: dict[str, str] | None = None) -> str:
    """A Turtle document; rows come subject by subject."""
    return "\n".join(turtle_lines((r.asDict() for r in _sorted(triples)), prefixes or v.PREFIXES)) + "\n"


def to_rdfxml(triples: DataFrame, prefixes: dict[str, str] | None = None) -> str:
    return "\n".join(rdfxml_lines((r.asDict() for r in _sorted(triples)), {"rdf": v.RDF} | (prefixes or v.PREFIXES))) + "\n"


#: Triples of one of several documents, about: readers of most syntaxes hold a document whole.
PART_TRIPLES = 50_000


def by_subject(triples: DataFrame) -> DataFrame:
    """The triples dealt by ranges of subject and value, so that a subject with any number of values is spread, and sorted.

    There are so many ranges that one has some PART_TRIPLES, however large the graph is.
    """
    t = triples.select(*[F.col(c) if c in triples.columns else F.lit(None).cast("string").alias(c) for c in ("s", "p", "o", "o_kind", "o_datatype", "o_lang")])
    n = -(-t.count() // PART_TRIPLES)
    return (t.repartitionByRange(n, "s", "p", "o") if n > 1 else t.repartitionByRange("s", "p", "o")).sortWithinPartitions("s", "p", "o")


def write_parts(triples: DataFrame, path: str, syntax: str = "turtle", prefixes: dict[str, str] | None = None) -> None:
    """A folder of documents in Turtle, N3 or RDF/XML, one for each range of subjects, all with the same prefixes.

    Spark's text writer commits them, so any file system that Spark reaches
    will do.  Labels of blank nodes are those of the graph: read_rdf() keeps
    them apart by file, so a graph with blank nodes belongs in one file or in
    N-Triples, and is refused here.
    """
    if not triples.where(F.startswith("s", F.lit("_:")) | (F.col("o_kind") == "bnode")).isEmpty():
        raise ValueError("blank nodes cannot be shared by several documents")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        rows = (r for b in chain([first], batches) for r in b.to_pylist())
        lines = document_lines(rows, syntax, prefixes)
        while batch := list(islice(lines, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(batch, pa.string())], names=["value"])

    by_subject(triples).mapInArrow(f, "value string").write.mode("overwrite").text(path)


def save(triples: DataFrame, path: str, parts: bool = False) -> None:
    """By extension: .nt and .jsonl as folders written in parallel, .rdf/.owl/.xml, .jsonld and by default Turtle (.ttl, .n3: it is N3 too) as files.

    With `parts`, Turtle and RDF/XML are folders of documents too (write_parts()), of any size.
    """
    extension = Path(path).suffix.lower()
    if parts and extension not in (".nt", ".jsonl", ".jsonld", ".json"):
        write_parts(triples, path, "xml" if extension in (".rdf", ".owl", ".xml") else "turtle")
        return
    if extension == ".nt":
        write_ntriples(triples, path)
    elif extension == ".jsonl":
        write_jsonld(triples, path)
    elif extension in (".rdf", ".owl", ".xml"):
        Path(path).write_text(to_rdfxml(triples))
    elif extension in (".jsonld", ".json"):
        nodes = [json.loads(r["node"]) for r in jsonld_nodes(bounded(triples)).orderBy("s").toLocalIterator()]
        Path(path).write_text(json.dumps(nodes, indent=2, ensure_ascii=False))
    else:
        Path(path).write_text(to_turtle(triples))


def save_document(document: dict, path: str | None, indent: int = 2, sort_keys: bool = False) -> str:
    """A schema or other document as JSON or YAML, by extension; returned if there is no path."""
    if path and Path(path).suffix in (".yaml", ".yml"):
        import yaml

        text = yaml.dump(document, sort_keys=sort_keys, allow_unicode=True)
    else:
        text = json.dumps(document, indent=indent, sort_keys=sort_keys, ensure_ascii=False) + "\n"
    if path:
        Path(path).write_text(text)
    return text
