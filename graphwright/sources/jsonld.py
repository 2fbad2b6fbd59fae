"""A reader of JSON-LD with inline contexts (prefixes, @vocab, @base, term definitions); nothing is fetched."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import urljoin

from graphwright.functions.vocab import FIRST, NIL, REST, TYPE, XSD
from graphwright.sources.turtle import Term, Triple


class JsonLd:
    def __init__(self, text: str, base: str = "", scope: str = "") -> None:
        self.scope, self.made, self.doc = scope, 0, json.loads(text)
        self.root = {"@base": base}
        self.prefixes: dict[str, str] = {}

    def triples(self) -> Iterator[Triple]:
        out: list[Triple] = []
        for item in self.doc if isinstance(self.doc, list) else [self.doc]:
            context = self._context(self.root, item.get("@context"))
            self.prefixes |= {k: v["@id"] for k, v in context.items() if isinstance(v, dict) and v.get("@id", "").endswith(("#", "/"))}
            graph = item["@graph"] if set(item) <= {"@context", "@graph"} and "@graph" in item else [item]
            for node in graph if isinstance(graph, list) else [graph]:
                self._node(node, context, out)
        yield from out

    def _context(self, active: dict, local) -> dict:
        out = dict(active)
        for part in local if isinstance(local, list) else [local]:
            if isinstance(part, str):
                raise ValueError("remote contexts are not fetched")
            for k, v in (part or {}).items():
                out[k] = v if k.startswith("@") else v if isinstance(v, dict) else {"@id": v} if v else {}
        for k, v in out.items():
            if isinstance(v, dict) and "@id" in v:
                out[k] = v | {"@id": self._expand(v["@id"], out, True, k)}
        return out

    def _expand(self, value: str, context: dict, vocab: bool, own: str | None = None) -> str:
        if value.startswith(("@", "_:")):
            return value
        if vocab and value != own and isinstance(context.get(value), dict) and "@id" in context[value]:
            return context[value]["@id"]
        head, colon, rest = value.partition(":")
        if colon:
            if not rest.startswith("//") and head != own and isinstance(context.get(head), dict) and "@id" in context[head]:
                return context[head]["@id"] + rest
            return value
        if vocab:
            return context.get("@vocab", "") + value
        return urljoin(context.get("@base") or "", value) if context.get("@base") else value

    def _ref(self, value: str, context: dict, vocab: bool = False) -> Term:
        uri = self._expand(value, context, vocab)
        return Term("bnode", f"_:{self.scope}{uri[2:]}") if uri.startswith("_:") else Term("uri", uri)

    def _fresh(self) -> Term:
        self.made += 1
        return Term("bnode", f"_:{self.scope}j{self.made}")

    def _node(self, node: dict, context: dict, out: list[Triple]) -> Term:
        if "@context" in node:
            context = self._context(context, node["@context"])
        keys = {self._expand(k, context, True): k for k in node if k != "@context"}
        subject = self._ref(node[keys["@id"]], context) if "@id" in keys else self._fresh()
        for name, key in keys.items():
            value = node[key]
            if name == "@type":
                for t in value if isinstance(value, list) else [value]:
                    out.append((subject, TYPE, self._ref(t, context, True)))
            elif name == "@graph":
                for child in value if isinstance(value, list) else [value]:
                    self._node(child, context, out)
            elif not name.startswith("@") and ":" in name:
                rule = context.get(key) if isinstance(context.get(key), dict) else {}
                if rule.get("@container") == "@list":
                    value = {"@list": value}
                for item in value if isinstance(value, list) else [value]:
                    if item is not None:
                        inner: list[Triple] = []
                        out.append((subject, name, self._value(item, rule, context, inner)))
                        out += inner
        return subject

    def _value(self, item, rule: dict, context: dict, out: list[Triple]) -> Term:
        if isinstance(item, dict):
            if "@value" in item:
                v, kind, lang = item["@value"], item.get("@type"), item.get("@language")
                typed = self._expand(kind, context, True) if kind else None
                return self._literal(v, typed, lang)
            if "@list" in item:
                items = item["@list"] if isinstance(item["@list"], list) else [item["@list"]]
                cells = [self._fresh() for _ in items]
                for i, x in enumerate(items):
                    out.append((cells[i], FIRST, self._value(x, rule, context, out)))
                    out.append((cells[i], REST, cells[i + 1] if i + 1 < len(cells) else Term("uri", NIL)))
                return cells[0] if cells else Term("uri", NIL)
            return self._node(item, context, out)
        kind = rule.get("@type")
        if kind in ("@id", "@vocab") and isinstance(item, str):
            return self._ref(item, context, kind == "@vocab")
        return self._literal(item, self._expand(kind, context, True) if kind else None, rule.get("@language", context.get("@language")))

    @staticmethod
    def _literal(v, kind: str | None, lang: str | None) -> Term:
        if isinstance(v, bool):
            return Term("literal", str(v).lower(), kind or XSD + "boolean")
        if isinstance(v, (int, float)):
            return Term("literal", str(v), kind or XSD + ("integer" if isinstance(v, int) else "double"))
        return Term("literal", v, kind, lang.lower() if lang and not kind else None)
