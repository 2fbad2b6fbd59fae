"""RDF files as a DataFrame of triples.

N-Triples are read as text lines, so they split and scale like any text file.
Turtle and N3 are read in blocks if a file is large (turtle_blocks).  The other
syntaxes have document-wide state; each file is parsed whole, files in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwright.sources.jsonld import JsonLd
from graphwright.sources.rdfxml import RdfXml
from graphwright.sources.turtle import Turtle, unescape

TRIPLES = "graph string, s string, s_kind string, p string, o string, o_kind string, o_datatype string, o_lang string, ord long"
COLUMNS = [c.split()[0] for c in TRIPLES.split(", ")]

#: Syntax by file extension (fixed values).
EXTENSIONS = {
    "ttl": "turtle", "turtle": "turtle", "n3": "n3", "nt": "nt", "ntriples": "nt", "jsonld": "json-ld", "json": "json-ld",
    "rdf": "xml", "rdfs": "xml", "owl": "xml", "xml": "xml",
}
_PARSERS = {"turtle": Turtle, "n3": Turtle, "nt": Turtle, "xml": RdfXml, "json-ld": JsonLd}
_LINE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(?:<([^>]*)>|(_:[^\s.]+(?:\.[^\s.]+)*)|"([^"]*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?)\s*\.\s*(?:#.*)?$'
#: Escapes of the two characters that delimit, as \\u escapes: then a literal ends at the next quote.
_PLAIN = (("\\\\", "\\u005C"), ('\\"', "\\u0022"))
_BLANK = r"^\s*(#|$)"
#: What a text with escapes consists of: runs of \uXXXX (surrogates come in pairs), \UXXXXXXXX, other escapes, plain text.
_PIECE = r"(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+"


def detect_format(path: str, head: str = "") -> str | None:
    """The syntax by extension, else by the first characters, else None."""
    extension = path.rsplit("/", 1)[-1].rpartition(".")[2].lower()
    if extension in EXTENSIONS:
        return EXTENSIONS[extension]
    start = head[:1000].lstrip()
    if start.startswith(("<?xml", "<rdf:RDF", "<RDF")):
        return "xml"
    if start.startswith(("{", "[")) and "@" in start:
        return "json-ld"
    if "@prefix" in start or "@base" in start or start.upper().startswith(("PREFIX", "BASE")):
        return "turtle"
    return "nt" if start.startswith(("<http", "_:")) else None


def parse(text: str, syntax: str | None, name: str = "", base: str = "") -> tuple[list[tuple], dict[str, str]]:
    """Rows of triples and the prefixes of one document; XML that does not parse is tried as Turtle."""
    kind = syntax or detect_format(name, text) or "xml"
    scope = f"{abs(hash_name(name)):x}-"

    def run(which: str) -> tuple[list[tuple], dict[str, str]]:
        reader = _PARSERS[which](text, base, scope)
        rows = [(name, s.value, s.kind, p, o.value, o.kind, o.datatype, o.lang, i) for i, (s, p, o) in enumerate(reader.triples())]
        return rows, dict(reader.prefixes)

    if kind not in _PARSERS:
        raise ValueError(f"unknown RDF syntax {kind!r}")
    try:
        return run(kind)
    except Exception:
        if kind != "xml":
            raise
        try:
            return run("turtle")
        except Exception:  # noqa: BLE001 - the first error is the one to report
            pass
        return run(kind)


def hash_name(name: str) -> int:
    import zlib

    return zlib.crc32(name.encode())


def _distinct(df: DataFrame) -> DataFrame:
    keys = [c for c in COLUMNS if c != "ord"]
    return df.groupBy(*keys).agg(F.min("ord").alias("ord")).select(*COLUMNS)


def unescaped(text: Column) -> Column:
    """A text with the escapes of N-Triples resolved, in one pass from left to right."""
    letters = F.create_map(*[F.lit(x) for pair in {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}.items() for x in pair])

    def piece(x: Column) -> Column:
        code = F.substring(x, 2, 1)
        wide = F.decode(F.unhex(F.substring(x, F.lit(3), F.length(x))), "UTF-32")
        short = F.decode(F.unhex(F.replace(x, F.lit("\\u"), F.lit(""))), "UTF-16BE")
        plain = F.coalesce(F.try_element_at(letters, code), code)
        return F.when(~F.startswith(x, F.lit("\\")), x).when((code == "u") & (F.length(x) > 2), short).when((code == "U") & (F.length(x) > 2), wide).otherwise(plain)

    whole = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0)), piece), "")
    return F.when(F.contains(text, F.lit("\\")), whole).otherwise(text)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text that are no comment and not empty, without quotes within literals."""
    value = F.col("value")
    for escape, code in _PLAIN:
        value = F.replace(value, F.lit(escape), F.lit(code))
    return spark.read.text(path).where(~F.col("value").rlike(_BLANK)).withColumn("plain", value)


def ntriples_errors(spark: SparkSession, path: str) -> DataFrame:
    """value: the lines that are no triple, no comment and not empty."""
    return _lines(spark, path).where(~F.col("plain").rlike(_LINE)).select("value")


def read_ntriples(spark: SparkSession, path: str, distinct: bool = True, bad: str = "raise") -> DataFrame:
    """N-Triples by regular expression, line by line.

    A line that is no triple raises an error; with bad="skip" it is left out,
    and ntriples_errors() has it.
    """
    if bad not in ("raise", "skip"):
        raise ValueError(f"bad is raise or skip, not {bad!r}")
    lines = _lines(spark, path)
    good = F.col("plain").rlike(_LINE)
    lines = lines.where(good if bad == "skip" else F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not a triple: "), F.substring("value", 1, 200))).cast("boolean")))
    at = lambda i: F.regexp_extract("plain", _LINE, i)
    some = lambda i: F.when(at(i) != "", unescaped(at(i)))
    literal = F.col("plain").rlike(r'^\s*(<[^>]*>|_:\S+)\s+<[^>]*>\s+"')
    kind = lambda c: F.when(F.startswith(c, F.lit("_:")), "bnode").otherwise("uri")
    subject = F.regexp_replace(unescaped(at(1)), "^<|>$", "")
    target = F.when(literal, unescaped(at(5))).otherwise(F.coalesce(some(4), unescaped(at(3))))
    df = lines.select(
        F.lit(path).alias("graph"), subject.alias("s"), kind(subject).alias("s_kind"), unescaped(at(2)).alias("p"), target.alias("o"),
        F.when(literal, "literal").otherwise(kind(target)).alias("o_kind"), some(6).alias("o_datatype"), F.lower(some(7)).alias("o_lang"),
        F.monotonically_increasing_id().alias("ord"),
    )
    return _distinct(df) if distinct else df


def _splits(spark: SparkSession, path: str) -> bool:
    """Whether Spark would read a file of the path in several pieces."""
    most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    largest = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0]
    return largest is not None and largest > most


def read_rdf(spark: SparkSession, path: str, syntax: str | None = None, base: str = "", split: bool | None = None, block: str | None = None) -> DataFrame:
    """Triples of one or more files (a path, folder or glob), as a set.

    Turtle and N3 are read in blocks with `split`, by default if a file is
    larger than what Spark gives to one task; the result is the same.  `block`
    is the size of the blocks, by default what Spark gives to one task.
    """
    kind = syntax or detect_format(path)
    if kind == "nt":
        return read_ntriples(spark, path)
    if kind in ("turtle", "n3") and (split or split is None and _splits(spark, path)):
        from graphwright.sources.turtle_blocks import read_turtle

        return _distinct(read_turtle(spark, path, base, block=block))

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame(parse(bytes(content).decode("utf-8-sig"), syntax, name, base)[0], columns=COLUMNS)

    return _distinct(spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(f, TRIPLES))


def read_prefixes(spark: SparkSession, path: str, syntax: str | None = None) -> DataFrame:
    """prefix, ns: the namespaces that the files declare."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame(list(parse(bytes(content).decode("utf-8-sig"), syntax, name)[1].items()), columns=["prefix", "ns"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(f, "prefix string, ns string").distinct()


def from_string(spark: SparkSession, text: str, syntax: str = "xml", base: str = "") -> DataFrame:
    """Triples of a document at hand."""
    return spark.createDataFrame(parse(text, syntax, "string", base)[0], TRIPLES).transform(_distinct)


def parse_rdf_table():
    """A table function: parse_rdf(text, syntax) gives the triples of one document, so that SQL parses a document a row.

    spark.udtf.register("parse_rdf", parse_rdf_table()); then
    SELECT t.* FROM docs, LATERAL parse_rdf(text, 'turtle') t.  A null text has
    no triples; labels of blank nodes are the document's own only if a third
    argument names it.
    """
    from pyspark.sql.functions import udtf

    class ParseRdf:
        def eval(self, text: str, syntax: str, name: str = ""):
            if text is not None:
                yield from parse(text, syntax, name or "")[0]

    return udtf(ParseRdf, returnType=TRIPLES)


from graphwright.sources.datasource import RdfSource  # noqa: E402 - needs parse()

__all__ = ["TRIPLES", "detect_format", "from_string", "ntriples_errors", "parse", "parse_rdf_table", "read_ntriples", "read_prefixes", "read_rdf", "RdfSource", "unescape"]
