"""A reader of Turtle and N3 (without rules), from the W3C grammar of Turtle 1.1."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import urljoin

from graphwright.functions.vocab import FIRST, NIL, REST, TYPE, XSD


class Term(NamedTuple):
    kind: str  # uri, bnode or literal
    value: str
    datatype: str | None = None
    lang: str | None = None


Triple = tuple[Term, str, Term]

_LEXER = re.compile(
    r"""(?P<skip>(?:\s+|\#[^\n]*)+)
    |(?P<iri><(?:[^<>"{}|^`\\\x00-\x20]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)
    |(?P<long>\"\"\"(?:(?:"|"")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*''')
    |(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<directive>@prefix\b|@base\b|(?i:PREFIX|BASE)(?=[\s<]))
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<type>\^\^)
    |(?P<blank>_:[\w](?:[\w.-]*[\w-])?)
    |(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<name>(?:[^\W\d_](?:[\w.-]*[\w-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?\#@%-])(?:(?:[\w.:-]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?\#@%-])*(?:[\w:-]|%[0-9A-Fa-f]{2}|\\[_~.!$&'()*+,;=/?\#@%-]))?)?)
    |(?P<word>a\b|true\b|false\b)
    |(?P<sign>[.;,\[\]()=])""",
    re.X | re.S,
)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
_LETTERS = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    out = _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _LETTERS.get(m[3], m[3]), text)
    return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace")  # joins pairs of surrogates


class Turtle:
    """Parses a document; prefixes holds the declared ones afterwards."""

    def __init__(self, text: str, base: str = "", scope: str = "") -> None:
        self.base, self.scope, self.prefixes, self.made = base, scope, {}, 0
        self.tokens = self._tokens(text)
        self.kind, self.value = "", ""
        self._next()

    @staticmethod
    def _tokens(text: str) -> Iterator[tuple[str, str]]:
        at = 0
        while at < len(text):
            m = _LEXER.match(text, at)
            if not m:
                raise ValueError(f"no Turtle at {text[at : at + 40]!r}")
            at = m.end()
            if m.lastgroup != "skip":
                yield m.lastgroup, m[0]
        while True:
            yield "end", ""

    def _next(self) -> tuple[str, str]:
        was = self.kind, self.value
        self.kind, self.value = next(self.tokens)
        return was

    def _take(self, sign: str) -> None:
        if self.value != sign or self.kind != "sign":
            raise ValueError(f"expected {sign!r}, found {self.value!r}")
        self._next()

    def _iri(self, kind: str, value: str) -> str:
        if kind == "iri":
            uri = unescape(value[1:-1])
            return urljoin(self.base, uri) if self.base and ":" not in uri.split("/")[0] else uri
        prefix, _, rest = value.partition(":")
        if prefix not in self.prefixes:
            raise ValueError(f"unknown prefix {prefix!r}")
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", rest)

    def _fresh(self) -> Term:
        self.made += 1
        return Term("bnode", f"_:{self.scope}b{self.made}")

    def triples(self) -> Iterator[Triple]:
        while self.kind != "end":
            if self.kind == "directive":
                self._directive()
                continue
            out: list[Triple] = []
            bare = self.value == "["
            subject = self._term(out)
            if not (bare and self.value == "."):
                self._predicates(subject, out)
            self._take(".")
            yield from out

    def _directive(self) -> None:
        word = self._next()[1]
        if word.strip("@").lower() == "prefix":
            name = self._next()[1].rstrip(":")
            self.prefixes[name] = self._iri(*self._next())
        else:
            self.base = self._iri(*self._next())
        if word.startswith("@"):
            self._take(".")

    def _predicates(self, subject: Term, out: list[Triple]) -> None:
        while True:
            kind, value = self._next()
            predicate = TYPE if value == "a" else "http://www.w3.org/2002/07/owl#sameAs" if value == "=" else self._iri(kind, value)
            while True:
                inner: list[Triple] = []
                out.append((subject, predicate, self._term(inner)))
                out += inner
                if self.value != "," or self.kind != "sign":
                    break
                self._next()
            while self.value == ";" and self.kind == "sign":
                self._next()
                if self.kind not in ("iri", "name", "word"):
                    if self.value != ";":
                        return
            if self.kind == "sign":
                return

    def _term(self, out: list[Triple]) -> Term:
        kind, value = self._next()
        if kind in ("iri", "name"):
            return Term("uri", self._iri(kind, value))
        if kind == "blank":
            return Term("bnode", f"_:{self.scope}{value[2:]}")
        if kind in ("text", "long"):
            text = unescape(value[3:-3] if kind == "long" else value[1:-1])
            if self.kind == "lang":
                return Term("literal", text, None, self._next()[1][1:].lower())
            if self.kind == "type":
                self._next()
                return Term("literal", text, self._iri(*self._next()))
            return Term("literal", text)
        if kind == "number":
            name = "double" if "e" in value.lower() else "decimal" if "." in value else "integer"
            return Term("literal", value, XSD + name)
        if value in ("true", "false"):
            return Term("literal", value, XSD + "boolean")
        if value == "[":
            node = self._fresh()
            if self.value != "]":
                self._predicates(node, out)
            self._take("]")
            return node
        if value == "(":
            return self._list(out)
        raise ValueError(f"no term: {value!r}")

    def _list(self, out: list[Triple]) -> Term:
        items: list[tuple[Term, list[Triple]]] = []
        while not (self.kind == "sign" and self.value == ")"):
            inner: list[Triple] = []
            items.append((self._term(inner), inner))
        self._next()
        cells = [self._fresh() for _ in items]
        for i, (item, inner) in enumerate(items):
            out.append((cells[i], FIRST, item))
            out += inner
            out.append((cells[i], REST, cells[i + 1] if i + 1 < len(cells) else Term("uri", NIL)))
        return cells[0] if cells else Term("uri", NIL)
