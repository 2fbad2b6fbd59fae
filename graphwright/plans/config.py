"""Which rules run, with which options."""

from __future__ import annotations

import copy
import json
from pathlib import Path

#: Rules in the order in which they apply, with what they do.
RULES = {
    "class_to_object": "classes become object definitions",
    "class_hierarchy": "superclasses become allOf references",
    "class_restrictions": "restrictions become array facets, constants and required properties",
    "object_property": "object properties become references in their domains",
    "datatype_property": "datatype properties become typed values in their domains",
    "property_cardinality": "cardinalities become array facets",
    "property_restrictions": "value restrictions become items, contains and constants",
    "labels_to_titles": "labels become titles",
    "comments_to_descriptions": "comments become descriptions",
    "annotations_to_metadata": "other annotations become metadata",
    "enumeration_to_enum": "enumerations become enum",
    "union_to_anyOf": "unions become anyOf",
    "intersection_to_allOf": "intersections become allOf",
    "complement_to_not": "complements become not",
    "equivalent_classes": "equivalent classes share a definition",
    "disjoint_classes": "disjoint subclasses become oneOf",
    "ontology_to_document": "the ontology's header becomes the document's",
    "individuals_to_examples": "individuals become examples",
    "ontology_metadata": "metadata of the ontology go to the root",
    "thing_with_uri": "a common base definition with the instance's URI",
}
#: Rules whose results the parity profile uses.
PARITY = (
    "class_to_object", "class_hierarchy", "class_restrictions", "object_property", "datatype_property", "labels_to_titles",
    "enumeration_to_enum", "disjoint_classes", "ontology_metadata", "thing_with_uri",
)
_OFF = ("annotations_to_metadata", "disjoint_classes", "individuals_to_examples")


def default_config() -> dict:
    rules = {r: {"enabled": r not in _OFF, "options": {}} for r in RULES if r != "thing_with_uri"}
    for r in ("labels_to_titles", "comments_to_descriptions"):
        rules[r]["options"]["language"] = "en"
    rules["property_cardinality"]["options"]["use_arrays"] = True
    return {"rules": rules, "output": {"format": "json-schema-draft-07", "indent": 2, "include_uri": False}}


class Config:
    """A rule that is not named is on; an empty configuration is the default one.

    Accepts nested settings ({"rules": {...}, "output": {...}}) and flat ones
    ({rule: {"enabled": ...}}).
    """

    def __init__(self, settings: dict | None = None) -> None:
        data = copy.deepcopy(settings) if settings else default_config()
        if "rules" not in data and any(k in RULES for k in data):
            data = {"rules": data, "output": {}}
        self.data = {"rules": {}, "output": {}} | data

    @classmethod
    def from_file(cls, path: str) -> Config:
        file = Path(path)
        if not file.exists():
            raise FileNotFoundError(path)
        return cls(_load(file))

    def to_file(self, path: str) -> None:
        Path(path).write_text(_dump(self.data, Path(path).suffix))

    def is_enabled(self, rule: str) -> bool:
        return bool(self.data["rules"].get(rule, {}).get("enabled", True))

    def options(self, rule: str) -> dict:
        return self.data["rules"].get(rule, {}).get("options", {}) or {}

    def option(self, rule: str, name: str, default=None):
        return self.options(rule).get(name, default)

    def _rule(self, rule: str) -> dict:
        return self.data["rules"].setdefault(rule, {"enabled": True, "options": {}})

    def enable(self, rule: str) -> None:
        self._rule(rule)["enabled"] = True

    def disable(self, rule: str) -> None:
        self._rule(rule)["enabled"] = False

    def set_option(self, rule: str, name: str, value) -> None:
        self._rule(rule).setdefault("options", {})[name] = value

    def output(self, name: str, default=None):
        return self.data["output"].get(name, default)

    def enabled_rules(self) -> list[str]:
        return [r for r in RULES if self.is_enabled(r)]

    def disabled_rules(self) -> list[str]:
        return [r for r in RULES if not self.is_enabled(r)]


def _load(file: Path) -> dict:
    if file.suffix in (".yaml", ".yml"):
        import yaml

        return yaml.safe_load(file.read_text())
    if file.suffix == ".json":
        return json.loads(file.read_text())
    raise ValueError(f"unknown kind of configuration file: {file.suffix!r}")


def _dump(data: dict, suffix: str, indent: int = 2) -> str:
    if suffix in (".yaml", ".yml"):
        import yaml

        return yaml.dump(data, sort_keys=False, allow_unicode=True)
    if suffix == ".json":
        return json.dumps(data, indent=indent, ensure_ascii=False) + "\n"
    raise ValueError(f"unknown kind of file: {suffix!r}")
