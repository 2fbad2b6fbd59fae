"""Names, labels and literals as Column expressions, so that they stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def local_name(uri: Column | str) -> Column:
    """What follows the last '#', else the last '/', else all of it."""
    u = _col(uri)
    return F.when(F.contains(u, F.lit("#")), F.substring_index(u, "#", -1)).when(F.contains(u, F.lit("/")), F.substring_index(u, "/", -1)).otherwise(u)


def clean_name(name: Column | str) -> Column:
    """A definition's key: behind the last ':', then '/', then '#'; blanks and hyphens become underscores."""
    tail = reduce(lambda c, sep: F.substring_index(c, sep, -1), ":/#", _col(name))
    return F.translate(tail, " -", "__")


def document_name(uri: Column | str) -> Column:
    """The last path segment before any '#'."""
    return F.substring_index(F.substring_index(_col(uri), "#", 1), "/", -1)


def pick_language(texts: Column | str, language: str | Column) -> Column:
    """From a map of texts by language: the one asked for, else English."""
    m = _col(texts)
    wanted = F.lit(language) if isinstance(language, str) else language
    return F.coalesce(F.try_element_at(m, wanted), F.try_element_at(m, F.lit("en")))


def normal_base(uri: Column | str) -> Column:
    """A base IRI that ends in one '#'."""
    return F.concat(F.regexp_replace(_col(uri), "[#/]+$", ""), F.lit("#"))


def definition_ref(name: Column | str) -> Column:
    return F.concat(F.lit("#/definitions/"), _col(name))


def format_annotations(pairs: Column | str, style: str = "text") -> Column:
    """A map as 'key: value; ...', keys sorted, or as JSON."""
    if style != "text":
        return F.to_json(_col(pairs))
    entries = F.array_sort(F.map_entries(_col(pairs)))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")


def shorten(df: DataFrame, uri: str, prefixes: DataFrame, out: str) -> DataFrame:
    """df with `out`: prefix:rest by the longest namespace that `uri` starts with, else the local name.

    A namespace ends behind the last '#' or '/', so prefixes meet by equality
    on the namespace of the term rather than by a range join.
    """
    namespace = F.regexp_extract(F.col(uri), "^(.*[#/])", 1)
    best = prefixes.groupBy("ns").agg(F.min("prefix").alias("_prefix")).withColumnRenamed("ns", "_ns")
    joined = df.withColumn("_ns", namespace).join(best, "_ns", "left")
    short = F.concat("_prefix", F.lit(":"), F.expr(f"substring({uri}, length(_ns) + 1)"))
    return joined.withColumn(out, F.coalesce(short, local_name(uri))).drop("_ns", "_prefix")


def contextual_text(property_name: Column, pick: Column) -> Column:
    """A made-up string that suits a property's name; `pick` chooses from a list of eight."""
    name, out = F.lower(property_name), None
    for words, values in _SAMPLES:
        hit = reduce(lambda a, b: a | b, [F.contains(name, F.lit(w)) for w in words])
        value = F.element_at(F.array(*[F.lit(v) for v in values]), F.pmod(pick, F.lit(len(values))).cast("int") + 1)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(F.concat(F.lit("text "), F.hex(F.abs(pick))))


_SAMPLES = (
    (("firstname", "givenname"), ["Ada", "Blaise", "Carl", "Emmy", "Grace", "Leonhard", "Mary", "Niels"]),
    (("lastname", "surname", "familyname"), ["Abel", "Bohr", "Curie", "Euler", "Gauss", "Hopper", "Noether", "Pascal"]),
    (("email", "mail"), ["ada@example.org", "carl@example.org", "emmy@example.org", "mary@example.org"]),
    (("phone", "tel"), ["+1-555-0100", "+1-555-0111", "+1-555-0122", "+1-555-0133"]),
    (("street", "address"), ["1 Elm Street", "2 Oak Avenue", "3 Mill Lane", "4 High Street"]),
    (("city", "town"), ["Basel", "Delft", "Lund", "Turin"]),
    (("country",), ["Austria", "Chile", "Ghana", "Japan"]),
    (("postal", "zip"), ["10115", "20095", "50667", "80331"]),
    (("company", "organization", "organisation"), ["Acme Works", "Delta Freight", "Northern Foods", "Union Mills"]),
    (("title",), ["Annual report", "Field notes", "Handbook", "Survey"]),
    (("description", "comment"), ["A short description.", "Made for tests.", "No further details.", "See the handbook."]),
    (("url", "website", "homepage"), ["https://example.org/a", "https://example.org/b", "https://example.org/c"]),
    (("code", "id", "number"), ["A-1001", "B-2002", "C-3003", "D-4004"]),
    (("color", "colour"), ["blue", "green", "red", "yellow"]),
    (("name",), ["Alder", "Birch", "Cedar", "Hazel", "Larch", "Maple", "Rowan", "Willow"]),
)
