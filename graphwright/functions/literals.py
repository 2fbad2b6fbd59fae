"""Literals by value: canonical forms of the XSD datatypes as Column expressions.

Two literals are equal if their datatypes have a common value space and their
values are the same: "01"^^xsd:integer is "1.0"^^xsd:decimal, and neither is
"1"^^xsd:string.  A literal becomes one string, its term: the canonical text in
quotes and the value space, so equality, grouping and joins of terms go by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphwright.functions.vocab import RDF, XSD

#: Bounds of the datatypes that are derived from integer: least and greatest value (fixed values of XSD).
INTEGERS = {
    "integer": (None, None), "nonNegativeInteger": (0, None), "positiveInteger": (1, None), "nonPositiveInteger": (None, 0), "negativeInteger": (None, -1),
    "long": (-(2**63), 2**63 - 1), "int": (-(2**31), 2**31 - 1), "short": (-(2**15), 2**15 - 1), "byte": (-128, 127),
    "unsignedLong": (0, 2**64 - 1), "unsignedInt": (0, 2**32 - 1), "unsignedShort": (0, 2**16 - 1), "unsignedByte": (0, 255),
}
STRINGS = ("string", "normalizedString", "token", "language", "Name", "NCName", "NMTOKEN")
_OWN_SPACE = ("double", "float", "boolean", "dateTime", "date", "time", "duration", "hexBinary", "base64Binary", "anyURI")
_ZONE = r"(Z|[+-]\d\d:\d\d)?"
_DAY = r"-?\d{4,}-\d\d-\d\d"
_CLOCK = r"\d\d:\d\d:\d\d(?:\.\d+)?"
_DURATION = r"^(-)?P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$"


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x worked out once however often f uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _group(text: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(text, pattern, i)


def _digits(text: Column) -> Column:
    """Canonical decimal digits: no plus sign, no zeros before or behind, no point without digits."""
    for pattern, new in ((r"^\+", ""), (r"^(-?)0+(?=\d)", "$1"), (r"(\.\d*?)0+$", "$1"), (r"\.$", ""), (r"^(-?)\.", "$10."), (r"^-0$", "0")):
        text = F.regexp_replace(text, pattern, new)
    return text


def _decimal(text: Column) -> Column:
    return F.when(text.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$"), _digits(text))


def _integer(text: Column, local: Column) -> Column:
    """Whole digits that the derived datatype's bounds allow."""

    def fits(x: Column) -> Column:
        minus, wide, out = F.startswith(x, F.lit("-")), x.try_cast("decimal(38,0)"), F.lit(True)
        for name, (least, most) in INTEGERS.items():
            if least is not None and most is not None:
                ok = F.coalesce(wide.between(F.lit(str(least)).cast("decimal(38,0)"), F.lit(str(most)).cast("decimal(38,0)")), F.lit(False))
            elif least is not None:
                ok = ~minus & (x != "0") if least else ~minus
            elif most is not None:
                ok = minus | (x == "0") if most == 0 else minus
            else:
                continue
            out = F.when(local == name, ok).otherwise(out)
        return F.when(out, x)

    return _let(F.when(text.rlike(r"^[+-]?\d+$"), _digits(text)), fits)


def _floating(text: Column, kind: str) -> Column:
    special = F.when(text.isin("INF", "+INF"), "INF").when(text == "-INF", "-INF").when(text == "NaN", "NaN")
    number = F.when(text.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), text.try_cast(kind))
    written = lambda x: F.when(x == float("inf"), "INF").when(x == float("-inf"), "-INF").otherwise((x + F.lit(0.0).cast(kind)).cast("string"))
    return F.coalesce(special, _let(number, written))


def _instant(text: Column) -> Column:
    """With a time zone the instant in UTC, without one the local time."""
    zone, fraction = _group(text, _ZONE + "$", 1), F.rtrim(_group(text, r"\.(\d+)", 1), F.lit("0"))
    local = F.regexp_replace(text, r"(\.\d+)?(Z|[+-]\d\d:\d\d)?$", "").try_cast("timestamp_ntz")

    def written(x: Column) -> Column:
        hours, minutes = F.substring(x["zone"], 2, 2).try_cast("int"), F.substring(x["zone"], 5, 2).try_cast("int")
        shift = F.when(x["zone"].isin("", "Z"), 0).when(F.startswith(x["zone"], F.lit("-")), -(hours * 60 + minutes)).otherwise(hours * 60 + minutes)
        moved = x["local"] - F.make_dt_interval(mins=F.coalesce(shift, F.lit(0)))
        return F.concat(F.date_format(moved, "yyyy-MM-dd'T'HH:mm:ss"), F.when(x["fraction"] == "", "").otherwise(F.concat(F.lit("."), x["fraction"])), F.when(x["zone"] == "", "").otherwise("Z"))

    parts = F.struct(zone.alias("zone"), fraction.alias("fraction"), local.alias("local"))
    return F.when(text.rlike(f"^{_DAY}T{_CLOCK}{_ZONE}$"), _let(parts, written))


def _date(text: Column) -> Column:
    zone = F.regexp_replace(_group(text, _ZONE + "$", 1), r"^[+-]00:00$", "Z")
    return F.when(text.rlike(f"^{_DAY}{_ZONE}$") & _group(text, f"^({_DAY})", 1).try_cast("date").isNotNull(), F.concat(_group(text, f"^({_DAY})", 1), zone))


def _time(text: Column) -> Column:
    """By the instant of a day, which is the same for all zones."""
    return F.when(text.rlike(f"^{_CLOCK}{_ZONE}$"), F.regexp_replace(_instant(F.concat(F.lit("2000-01-02T"), text)), "^.*T", ""))


def _duration(text: Column) -> Column:
    """Months and seconds, which are the value of a duration."""
    n = lambda i: F.coalesce(_group(text, _DURATION, i).try_cast("decimal(30,9)"), F.lit(0).cast("decimal(30,9)"))
    parts = F.struct((n(2) * 12 + n(3)).alias("months"), (n(4) * 86400 + n(5) * 3600 + n(6) * 60 + n(7)).alias("seconds"), _group(text, _DURATION, 1).alias("sign"))
    zero = lambda x: (x["months"] == 0) & (x["seconds"] == 0)
    written = lambda x: F.concat(F.when(zero(x), "").otherwise(x["sign"]), _digits(x["months"].cast("string")), F.lit("M"), _digits(x["seconds"].cast("string")), F.lit("S"))
    return F.when(text.rlike(_DURATION) & text.rlike(r"\d[YMDHS]$"), _let(parts, written))


def _local(datatype: Column) -> Column:
    return F.when(F.startswith(datatype, F.lit(XSD)), F.substring(datatype, F.lit(len(XSD) + 1), F.length(datatype)))


def _value(x: Column) -> Column:
    """The canonical text of x: text, trimmed, local (name of the XSD datatype), lang; null if it is ill-typed."""
    text, trimmed, local = x["text"], x["trimmed"], x["local"]
    one_space, packed = F.regexp_replace(trimmed, r"[ \t\n\r]+", " "), F.regexp_replace(trimmed, r"\s", "")
    out = F.when(x["lang"].isNotNull() | (local == "string"), text).when(local == "normalizedString", F.regexp_replace(text, r"[\t\n\r]", " ")).when(local == "language", F.lower(one_space)).when(local.isin(*STRINGS), one_space)
    out = out.when(local == "decimal", _decimal(trimmed)).when(local.isin(*INTEGERS), _integer(trimmed, local))
    out = out.when(local == "double", _floating(trimmed, "double")).when(local == "float", _floating(trimmed, "float"))
    out = out.when(local == "boolean", F.when(trimmed.isin("true", "1"), "true").when(trimmed.isin("false", "0"), "false"))
    out = out.when(local.isin("dateTime", "dateTimeStamp"), F.when((local == "dateTime") | trimmed.rlike(r"(Z|[+-]\d\d:\d\d)$"), _instant(trimmed)))
    out = out.when(local == "date", _date(trimmed)).when(local == "time", _time(trimmed)).when(local == "duration", _duration(trimmed))
    out = out.when(local == "hexBinary", F.when(trimmed.rlike(r"^([0-9A-Fa-f]{2})*$"), F.upper(trimmed)))
    out = out.when(local == "base64Binary", F.when(packed.rlike(r"^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"), packed))
    return out.when(local == "anyURI", trimmed).otherwise(text)


def canonical(text: Column, datatype: Column, lang: Column | None = None) -> Column:
    """struct(space, value) of a literal; value is null if the text is none of its datatype's.

    Unknown datatypes are spaces of their own, in which the text is the value.
    Times of 24:00:00 count as no value; years have four digits.
    """
    lang = F.lit(None).cast("string") if lang is None else lang
    trimmed = F.regexp_replace(text, r"^[ \t\n\r]+|[ \t\n\r]+$", "")
    parts = F.struct(text.alias("text"), trimmed.alias("trimmed"), F.when(datatype.isNull(), "string").otherwise(_local(datatype)).alias("local"), datatype.alias("datatype"), lang.alias("lang"))

    def made(x: Column) -> Column:
        local = x["local"]
        space = F.when(x["lang"].isNotNull(), F.concat(F.lit("@"), F.lower(x["lang"]))).when(local.isin(*STRINGS), "string").when(local.isin("decimal", *INTEGERS), "decimal").when(local == "dateTimeStamp", "dateTime").when(local.isin(*_OWN_SPACE), local).otherwise(x["datatype"])
        return F.struct(space.alias("space"), _value(x).alias("value"))

    return _let(parts, made)


def term(o: Column, o_kind: Column, datatype: Column, lang: Column | None = None) -> Column:
    """The object of a triple as one string: nodes as they are, literals as "value"^^space, ill-typed ones as "text"^^!datatype."""
    literal = lambda c: F.when(c["value"].isNull(), F.concat(F.lit('"'), o, F.lit('"^^!'), datatype)).otherwise(F.concat(F.lit('"'), c["value"], F.lit('"^^'), c["space"]))
    return F.when(o_kind == "literal", _let(canonical(o, datatype, lang), literal)).otherwise(o)


def term_text(t: Column) -> Column:
    """What stands between the quotes of a literal's term; nodes as they are."""
    return F.regexp_replace(t, r'(?s)^"(.*)"\^\^[^"]*$', "$1")


def term_space(t: Column) -> Column:
    """The value space of a literal's term, '!' and the datatype if it is ill-typed; empty for nodes."""
    return F.regexp_extract(t, r'(?s)^".*"\^\^([^"]*)$', 1)


def holds(t: Column, datatype: Column) -> Column:
    """Whether the value of a literal's term belongs to a datatype; null if nothing is known of the datatype.

    A duration's canonical text is no duration's, so of durations the space alone counts.
    """

    def within(x: Column) -> Column:
        known = x["local"].isin("decimal", *INTEGERS, *STRINGS, "dateTimeStamp", *_OWN_SPACE)
        same = x["space"] == x["own"]["space"]
        return F.when(x["datatype"] == RDF + "langString", F.startswith(x["space"], F.lit("@"))).when(known & (x["local"] == "duration"), same).when(known, same & x["own"]["value"].isNotNull())

    parts = F.struct(datatype.alias("datatype"), _local(datatype).alias("local"), term_space(t).alias("space"), canonical(term_text(t), datatype).alias("own"))
    return _let(parts, within)
