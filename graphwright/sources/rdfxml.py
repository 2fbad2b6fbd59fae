"""A reader of RDF/XML, from the W3C syntax: typed nodes, attributes, parse types, containers of properties."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import urljoin

from graphwright.functions.vocab import FIRST, NIL, RDF, REST, TYPE
from graphwright.sources.turtle import Term, Triple

_XML = "{http://www.w3.org/XML/1998/namespace}"
_R = "{" + RDF + "}"
_SYNTAX = {_R + x for x in ("about", "ID", "nodeID", "resource", "datatype", "parseType")}


class RdfXml:
    def __init__(self, text: str, base: str = "", scope: str = "") -> None:
        self.base, self.scope, self.prefixes, self.made = base, scope, {}, 0
        self.root = None
        for event, x in ET.iterparse(io.BytesIO(text.encode()), events=("start-ns", "start")):
            if event == "start-ns":
                self.prefixes.setdefault(x[0], x[1])
            elif self.root is None:
                self.root = x

    def triples(self) -> Iterator[Triple]:
        self.base = self.root.get(_XML + "base", self.base)
        nodes = list(self.root) if self.root.tag == _R + "RDF" else [self.root]
        for node in nodes:
            out: list[Triple] = []
            self._node(node, self.root.get(_XML + "lang"), out)
            yield from out

    def _fresh(self) -> Term:
        self.made += 1
        return Term("bnode", f"_:{self.scope}x{self.made}")

    def _uri(self, ref: str) -> str:
        if ":" in ref.split("/")[0].split("#")[0]:
            return ref
        return self.base.split("#")[0] + ref if ref.startswith("#") or not ref else urljoin(self.base, ref)

    @staticmethod
    def _name(tag: str) -> str:
        return tag[1:].replace("}", "", 1)

    def _node(self, e: ET.Element, lang: str | None, out: list[Triple]) -> Term:
        lang = e.get(_XML + "lang", lang)
        if _R + "about" in e.attrib:
            subject = Term("uri", self._uri(e.get(_R + "about")))
        elif _R + "ID" in e.attrib:
            subject = Term("uri", self._uri("#" + e.get(_R + "ID")))
        elif _R + "nodeID" in e.attrib:
            subject = Term("bnode", f"_:{self.scope}{e.get(_R + 'nodeID')}")
        else:
            subject = self._fresh()
        if e.tag != _R + "Description":
            out.append((subject, TYPE, Term("uri", self._name(e.tag))))
        self._attributes(subject, e, lang, out)
        for child in e:
            self._property(subject, child, lang, out)
        return subject

    def _attributes(self, subject: Term, e: ET.Element, lang: str | None, out: list[Triple]) -> None:
        for key, value in e.attrib.items():
            if key in _SYNTAX or key.startswith(_XML) or not key.startswith("{"):
                continue
            o = Term("uri", self._uri(value)) if key == _R + "type" else Term("literal", value, None, lang.lower() if lang else None)
            out.append((subject, self._name(key), o))

    def _property(self, subject: Term, e: ET.Element, lang: str | None, out: list[Triple]) -> None:
        lang, predicate = e.get(_XML + "lang", lang), self._name(e.tag)
        how = e.get(_R + "parseType")
        if _R + "resource" in e.attrib or _R + "nodeID" in e.attrib:
            o = Term("uri", self._uri(e.get(_R + "resource"))) if _R + "resource" in e.attrib else Term("bnode", f"_:{self.scope}{e.get(_R + 'nodeID')}")
            out.append((subject, predicate, o))
            self._attributes(o, e, lang, out)
        elif how == "Collection":
            cells = [self._fresh() for _ in e]
            out.append((subject, predicate, cells[0] if cells else Term("uri", NIL)))
            for i, child in enumerate(e):
                inner: list[Triple] = []
                out.append((cells[i], FIRST, self._node(child, lang, inner)))
                out += inner
                out.append((cells[i], REST, cells[i + 1] if i + 1 < len(cells) else Term("uri", NIL)))
        elif how == "Resource":
            o = self._fresh()
            out.append((subject, predicate, o))
            for child in e:
                self._property(o, child, lang, out)
        elif how == "Literal":
            inner_xml = (e.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in e)
            out.append((subject, predicate, Term("literal", inner_xml, RDF + "XMLLiteral")))
        elif len(e):
            inner = []
            out.append((subject, predicate, self._node(e[0], lang, inner)))
            out += inner
        elif any(k.startswith("{") and k not in _SYNTAX and not k.startswith(_XML) for k in e.attrib):
            o = self._fresh()
            out.append((subject, predicate, o))
            self._attributes(o, e, lang, out)
        else:
            kind = e.get(_R + "datatype")
            out.append((subject, predicate, Term("literal", e.text or "", self._uri(kind) if kind else None, None if kind or not lang else lang.lower())))
