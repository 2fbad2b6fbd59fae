"""From an ontology's tables to a JSON Schema document.

The relational work of all enabled rules (joins, inference, merging, division)
is one Spark plan: every rule's rows are tagged, turned into JSON and unioned,
and one job collects them.  They are as many as the ontology has axioms.  The
driver folds them, in rule order, into the document; of two writers to one
place the later rule wins.

An ontology whose document the driver cannot hold is compiled by
Engine.definitions(): what rules say of a definition is dealt by its name, and
tasks fold the same rules over their names.

Profiles: `parity` uses the rules of config.PARITY; `documented` uses all.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphwright.functions import datatypes as dt
from graphwright.operators import rules as r
from graphwright.operators.tbox import TBox
from graphwright.plans.config import PARITY, RULES, Config
from graphwright.plans.tables import settled
from graphwright.sources.sinks import bounded

SCHEMA_ID = "http://json-schema.org/draft-07/schema#"
#: Individuals that a schema may have as examples; with more the rule is refused.
MOST_EXAMPLES = 10_000
#: Keys that root metadata may set (fixed values).
ROOT_KEYS = {"title", "description", "$id", "$comment", "$defs", "additionalProperties", "type"}
Rows = dict[str, list[dict]]


def clean(name: str) -> str:
    for sep in ":/#":
        name = name.rsplit(sep, 1)[-1]
    return name.replace(" ", "_").replace("-", "_")


def pick(texts: dict | None, language: str) -> str | None:
    texts = texts or {}
    if set(texts) == {"default"}:
        return texts["default"]
    return texts.get(language, texts.get("en"))


def tables(t: TBox, config: Config, profile: str) -> dict[str, DataFrame]:
    """What the enabled rules read, as DataFrames."""
    on = {x for x in RULES if config.is_enabled(x) and (profile != "parity" or x in PARITY)}
    out = {"ontology": t.ontology, "classes": t.classes, "annotations": t.annotations}
    props = t.properties
    if on & {"object_property", "datatype_property", "comments_to_descriptions", "labels_to_titles"}:
        domains = r.property_domains(props, t.prop_domain, t.prop_range).groupBy(F.col("prop").alias("uri")).agg(F.array_sort(F.collect_list(F.struct("ord", "domain"))).alias("domains"))
        ranges = r.property_ranges(props, t.prop_domain, t.prop_range, t.restrictions).withColumnRenamed("prop", "uri")
        functional = r.property_functional(props).withColumnRenamed("prop", "uri").withColumnRenamed("functional", "is_functional")
        out["properties"] = props.join(domains, "uri", "left").join(ranges, "uri", "left").join(functional, "uri", "left")
    if "class_hierarchy" in on:
        out["supers"] = t.class_super
    if on & {"class_restrictions"}:
        out["merged"] = r.merged_restrictions(t.restrictions)
    if on & {"property_cardinality", "property_restrictions"}:
        out["restrictions"] = t.restrictions
    if "enumeration_to_enum" in on:
        out["enums"] = t.enum_members
    if on & {"union_to_anyOf", "intersection_to_allOf", "complement_to_not"}:
        out["expressions"] = t.expressions
    if "equivalent_classes" in on:
        out["equivalent"] = t.class_equiv
    if "disjoint_classes" in on:
        out["unions"] = r.disjoint_unions(t.class_super, t.class_disjoint)
        if profile == "documented":
            out["disjoint_groups"] = r.disjoint_groups(t.class_disjoint)
    if "individuals_to_examples" in on:
        out |= {"individuals": bounded(t.individuals, MOST_EXAMPLES), "ind_type": t.ind_type, "ind_prop": t.ind_prop}
    return out


def collect(frames: dict[str, DataFrame]) -> Rows:
    """All rows of all tables in one job."""
    whole = None
    for kind, df in frames.items():
        one = df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns)).alias("row"))
        whole = one if whole is None else whole.unionByName(one)
    out: Rows = defaultdict(list)
    for row in whole.collect():
        out[row["kind"]].append(json.loads(row["row"]))
    for rows in out.values():
        rows.sort(key=lambda x: (x.get("ord", 0), json.dumps(x, sort_keys=True)))
    return out


class Document:
    """A schema under construction."""

    def __init__(self) -> None:
        self.root: dict = {"$schema": SCHEMA_ID}
        self.definitions: dict[str, dict] = {}
        self.properties: dict[str, dict] = {}
        self.required: list[str] = []
        self.examples: list = []

    def add_to_root(self, key: str, value) -> None:
        self.root[key] = value

    def add_definition(self, name: str, schema: dict) -> None:
        self.definitions[clean(name)] = schema

    def add_property(self, name: str, schema: dict, required: bool = False) -> None:
        self.properties[name] = schema
        if required and name not in self.required:
            self.required.append(name)

    def add_example(self, example) -> None:
        self.examples.append(example)

    def add_to_schema(self, path: str, value) -> None:
        at = self.root
        *way, last = path.split("/")
        for step in way:
            at = at.setdefault(step, {})
        at[last] = value

    def set_property(self, owner: str, name: str, schema: dict) -> None:
        """Nothing happens if there is no such definition."""
        if clean(owner) in self.definitions:
            self.definitions[clean(owner)].setdefault("properties", {})[name] = schema

    def require(self, owner: str, name: str) -> None:
        if clean(owner) in self.definitions:
            needed = self.definitions[clean(owner)].setdefault("required", [])
            if name not in needed:
                needed.append(name)

    def merge(self, other: dict) -> None:
        self.definitions |= other.get("definitions", {})
        self.properties |= other.get("properties", {})
        self.required += [x for x in other.get("required", []) if x not in self.required]
        self.examples += other.get("examples", [])

    def build(self) -> dict:
        out = dict(self.root)
        if self.definitions:
            out["definitions"] = self.definitions
        if self.properties:
            out |= {"type": "object", "properties": self.properties} | ({"required": self.required} if self.required else {})
        elif self.definitions and not out.get("type"):
            out |= {"type": "object", "additionalProperties": False}
        if self.examples:
            out["examples"] = self.examples
        if "type" not in out and "definitions" not in out:
            out["type"] = "object"
        return json.loads(json.dumps(out))


# --- the fold: one function a rule -------------------------------------------


def _titled(schema: dict, row: dict, language: str) -> dict:
    for key, texts in (("title", row.get("label")), ("description", row.get("comment"))):
        if texts:
            text = pick(texts, language)
            if text is not None:
                schema[key] = text
    return schema


def _class_to_object(doc: Document, rows: Rows, c: Config) -> None:
    for x in rows["classes"]:
        schema = _titled({"type": "object", "properties": {}}, x, c.option("class_to_object", "language", "en"))
        if c.output("include_uri", False):
            schema["$comment"] = f"OWL Class URI: {x['uri']}"
        doc.add_definition(dt.local(x["uri"]), schema)


def _class_hierarchy(doc: Document, rows: Rows, c: Config) -> None:
    supers: dict[str, list[str]] = {}
    for x in rows["supers"]:
        supers.setdefault(dt.local(x["class"]), []).append(dt.local(x["other"]))
    for name, parents in supers.items():
        doc.definitions.setdefault(clean(name), {})["allOf"] = [*[{"$ref": f"#/definitions/{p}"} for p in parents], {"type": "object", "properties": {}}]


def _class_restrictions(doc: Document, rows: Rows, c: Config) -> None:
    for x in rows["merged"]:
        owner, prop, schema = dt.local(x["class"]), dt.local(x["prop"]), {}
        if any(k in x for k in ("min_items", "max_items", "filler")):
            schema["type"] = "array"
        for key, column in (("minItems", "min_items"), ("maxItems", "max_items")):
            if column in x:
                schema[key] = x[column]
        if "filler" in x:
            schema["items"] = dt.filler_reference(x["filler"])
        if "all_filler" in x:
            schema["description"] = f"Array of {dt.local(x['all_filler'])} or @id references"
        if "const" in x:
            schema["const"] = x["const"]
        doc.set_property(owner, prop, schema)
        if x["required"]:
            doc.require(owner, prop)


def _properties(rule: str, kind: str, schema_of: Callable[[dict], dict]) -> Callable:
    def fold(doc: Document, rows: Rows, c: Config) -> None:
        for x in rows["properties"]:
            if x["kind"] != kind:
                continue
            schema = _titled(schema_of(x), x, c.option(rule, "language", "en"))
            single = x.get("is_functional") if kind == "object" else x.get("functional")
            if not single:
                schema = {"type": "array", "items": schema}
            if c.output("include_uri", False):
                schema["$comment"] = f"OWL Property URI: {x['uri']}"
            for d in x.get("domains") or []:
                if kind == "object" or d.get("stated", True):
                    doc.set_property(dt.local(d["domain"]), dt.local(x["uri"]), json.loads(json.dumps(schema)))

    return fold


def _property_cardinality(doc: Document, rows: Rows, c: Config) -> None:
    arrays = c.option("property_cardinality", "use_arrays", True)
    for x in rows["restrictions"]:
        if x["kind"] != "cardinality":
            continue
        owner, prop, low, high, exact = dt.local(x["class"]), dt.local(x["prop"]), x.get("min"), x.get("max"), x.get("exact")
        facets = {}
        if exact not in (None, 1):
            facets = {"minItems": exact, "maxItems": exact}
        elif exact is None:
            facets |= {"minItems": low} if low is not None and low > 1 else {}
            facets |= {"maxItems": high} if high is not None and high != 1 else {}
        if facets and arrays and clean(owner) in doc.definitions:
            now = doc.definitions[clean(owner)].setdefault("properties", {}).get(prop, {})
            doc.set_property(owner, prop, (now if now.get("type") == "array" else {"items": now} if now else {}) | {"type": "array"} | facets)
        if low and low >= 1:
            doc.require(owner, prop)


def _property_restrictions(doc: Document, rows: Rows, c: Config) -> None:
    found: dict[tuple[str, str], list[dict]] = {}
    for x in rows["restrictions"]:
        if x["kind"] == "allValuesFrom":
            ref = dt.filler_reference(x["filler"])
            schema = {"type": "array", "items": ref} if c.option("property_restrictions", "arrays_for_restrictions", False) else ref
        elif x["kind"] == "someValuesFrom":
            schema = {"type": "array", "minItems": 1, "contains": dt.filler_reference(x["filler"])}
        elif x["kind"] == "hasValue":
            schema = {"const": x["value"]}
        else:
            continue
        found.setdefault((dt.local(x["class"]), dt.local(x["prop"])), []).append(schema)
    for (owner, prop), schemas in found.items():
        now = doc.definitions.get(clean(owner), {}).get("properties", {}).get(prop)
        if now is None:
            doc.set_property(owner, prop, schemas[0] if len(schemas) == 1 else {"allOf": schemas})
        elif now.get("type") == "array":  # a property that has a shape keeps it; the restrictions hold for its members
            for s in schemas:
                now |= {"minItems": max(1, now.get("minItems", 0)), "contains": s["contains"]} if "contains" in s else {}


def _texts(rule: str, column: str, key: str) -> Callable:
    def fold(doc: Document, rows: Rows, c: Config) -> None:
        language = c.option(rule, "language", "en")
        for x in rows["classes"]:
            text = pick(x.get(column), language) if x.get(column) else None
            if text and clean(dt.local(x["uri"])) in doc.definitions:
                doc.definitions[clean(dt.local(x["uri"]))][key] = text

    return fold


def _annotations_to_metadata(doc: Document, rows: Rows, c: Config) -> None:
    rule = "annotations_to_metadata"
    names = {x["uri"]: clean(dt.local(x["uri"])) for x in rows["classes"]}
    by: dict[str, dict] = defaultdict(dict)
    for x in rows["annotations"]:
        if x["subject"] in names:
            by[names[x["subject"]]][x["key"]] = x["value"]
    for name, pairs in sorted(by.items()):
        if name in doc.definitions:
            text = "; ".join(f"{k}: {v}" for k, v in sorted(pairs.items())) if c.option(rule, "format_style", "dict") == "string" else pairs
            if c.option(rule, "include_in_comment", True):
                doc.definitions[name]["$comment"] = f"Annotations: {text}"
            elif field := c.option(rule, "custom_field"):
                doc.definitions[name][field] = text
            elif isinstance(text, dict):
                doc.definitions[name] |= text


def _enumeration_to_enum(doc: Document, rows: Rows, c: Config) -> None:
    values: dict[str, list[dict]] = {}
    for x in rows["enums"]:
        values.setdefault(x["class"], []).append(x)
    for x in rows["classes"]:
        if x["uri"] in values:
            enum = [m["value"] for m in sorted(values[x["uri"]], key=lambda m: m["pos"])]
            doc.add_definition(dt.local(x["uri"]), _titled({"type": "string", "enum": enum}, x, c.option("enumeration_to_enum", "language", "en")))


def _expressions(op: str, key: str) -> Callable:
    def fold(doc: Document, rows: Rows, c: Config) -> None:
        refs: dict[str, list[dict]] = {}
        for x in rows["expressions"]:
            if x["op"] == op:
                refs.setdefault(clean(dt.local(x["class"])), []).append({"$ref": f"#/definitions/{dt.local(x['other'])}"})
        for name, found in refs.items():
            if name in doc.definitions:
                doc.definitions[name][key] = found[0] if op == "complement" else [*doc.definitions[name].get(key, []), *found] if op == "intersection" else found

    return fold


def _equivalent_classes(doc: Document, rows: Rows, c: Config) -> None:
    """Members of a group of equivalent classes share one definition, named after the least member."""
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for x in rows["equivalent"]:
        a, b = sorted((find(clean(dt.local(x["class"]))), find(clean(dt.local(x["other"])))))
        parent[b] = a
    groups: dict[str, list[str]] = defaultdict(list)
    for name in sorted(parent):
        groups[find(name)].append(name)
    for least, members in groups.items():
        own = [doc.definitions[m] for m in members if m in doc.definitions]
        if own and len(members) > 1:
            doc.definitions[f"_shared_{least}"] = own[0] if len(own) == 1 else {"allOf": own}
            for m in members:
                doc.definitions[m] = {"$ref": f"#/definitions/_shared_{least}"}


def _disjoint_classes(doc: Document, rows: Rows, c: Config) -> None:
    order = {x["uri"]: i for i, x in enumerate(rows["classes"])}
    kids: dict[str, list[dict]] = {}
    if not rows["unions"]:
        _disjoint_comment(doc, rows.get("disjoint_groups", []), {dt.local(x["uri"]): i for i, x in enumerate(rows["classes"])})
    for x in rows["unions"]:
        kids.setdefault(x["parent"], []).append(x)
    for parent, found in sorted(kids.items()):
        names = [x["child"] for x in sorted(found, key=lambda x: (x.get("class_ord", order.get(x["class"], float("inf"))), x["child"]))]
        old = doc.definitions.get(clean(parent))
        if old is None:
            continue
        new = {"oneOf": [{"$ref": f"#/definitions/{n}"} for n in names], "title": parent, "description": f"Disjoint union of: {', '.join(names)}"}
        if old.get("properties"):
            new["properties"] = old["properties"]
            if old.get("required"):
                new["required"] = list(old["required"])
        doc.definitions[clean(parent)] = new


def _disjoint_comment(doc: Document, groups: list[dict], order: dict[str, int]) -> None:
    """Where disjoint classes make up no union, a comment names their groups: each class stands in the first that has it."""
    named: list[list[str]] = []
    done: set[str] = set()
    for x in sorted(groups, key=lambda x: (order.get(x["class"], len(order)), x["class"])):
        if x["class"] not in done:
            named.append(x["together"])
            done |= set(x["together"])
    if named:
        doc.add_to_root("$comment", f"Disjoint class groups: {named}")


def _ontology_pairs(rows: Rows) -> tuple[str | None, dict[str, str], list[str]]:
    uri = rows["ontology"][0]["uri"] if rows["ontology"] else None
    own = [x for x in rows["annotations"] if x["subject"] == uri]
    pairs = {x["key"]: x["value"] for x in own}
    pairs |= {k.split(":", 1)[1]: x for k, x in pairs.items() if k.startswith(("owl:", "dcterms:"))}
    return uri, pairs, [x["value"] for x in own if x["key"] == "owl:imports"]


def _ontology_to_document(doc: Document, rows: Rows, c: Config) -> None:
    uri, pairs, imports = _ontology_pairs(rows)
    if uri:
        doc.add_to_root("$id", uri)
        doc.add_to_root("title", pairs.get("title") or pairs.get("dc:title") or uri.split("#")[0].rsplit("/", 1)[-1])
    if text := pairs.get("description") or pairs.get("dc:description"):
        doc.add_to_root("description", text)
    if imports and c.option("ontology_to_document", "include_imports", True):
        doc.add_to_root("$comment", f"Imports: {', '.join(imports)}")


def _individuals_to_examples(doc: Document, rows: Rows, c: Config) -> None:
    rule, kinds, props = "individuals_to_examples", defaultdict(list), defaultdict(dict)
    for x in rows["ind_type"]:
        kinds[x["uri"]].append(dt.local(x["type"]))
    for x in rows["ind_prop"]:
        props[x["uri"]][dt.local(x["prop"])] = x["value"]
    for x in rows["individuals"]:
        out, types = {}, kinds[x["uri"]]
        if types and c.option(rule, "include_type", True):
            out["@type"] = types[0] if len(types) == 1 else types
        if label := x.get("label"):
            out["label"] = label["default"] if set(label) == {"default"} else label
        out |= props[x["uri"]]
        if c.option(rule, "include_id", False):
            out["@id"] = x["uri"]
        if out:
            doc.add_example(out)


#: Metadata of an ontology and the annotations that give them, first found first.
_METADATA = {
    "version": ("versionInfo",), "author": ("creator", "dc:creator"), "license": ("license", "dc:rights"), "created": ("created", "dc:date"),
    "modified": ("modified", "dc:modified"), "contributors": ("contributor", "dc:contributor"), "source": ("source", "dc:source"),
}


def _ontology_metadata(doc: Document, rows: Rows, c: Config) -> None:
    rule, (_, pairs, _) = "ontology_metadata", _ontology_pairs(rows)
    found = {k: next(pairs[n] for n in names if n in pairs) for k, names in _METADATA.items() if any(n in pairs for n in names)}
    if c.option(rule, "include_all_annotations", False):
        used = {n for names in _METADATA.values() for n in names} | {"title", "description", "comment"}
        found |= {f"owl:{k}": x for k, x in sorted(pairs.items()) if k not in used}
    if not found:
        return
    placement = c.option(rule, "placement", "root")
    out = {"$comment": f"Metadata: {json.dumps(found)}"} if placement == "comment" else {"info": found} if placement == "info" else found
    for key, value in out.items():
        if key in ROOT_KEYS:
            doc.add_to_root(key, value)


def _thing_with_uri(doc: Document, rows: Rows, c: Config) -> None:
    """The base definition; wrap() makes the others inherit from it at the end."""
    rule, uri = "thing_with_uri", {"type": "string", "format": "uri", "description": "The URI identifier for this instance"}
    thing = {"type": "object", "properties": {"uri": uri}, "required": c.option(rule, "uri_required", [])}
    if c.option(rule, "include_description", True):
        thing["description"] = "Base object that all classes inherit from"
    if c.option(rule, "include_title", True):
        thing["title"] = "_Thing"
    doc.add_definition("_Thing", thing)


def wrap(doc: Document, c: Config, profile: str) -> None:
    skip = c.option("thing_with_uri", "skip_patterns", [])
    for name, schema in doc.definitions.items():
        title = schema.get("title", "")
        if name == "_Thing" or title == "_Thing" or any(p in title for p in skip):
            continue
        if profile != "parity" and ("enum" in schema or "$ref" in schema):
            continue  # a string cannot be an object too
        outer = {k: schema[k] for k in ("title", "description") if k in schema}
        doc.definitions[name] = {"allOf": [{"$ref": "#/definitions/_Thing"}, {k: x for k, x in schema.items() if k not in outer}]} | outer


FOLDS: dict[str, Callable[[Document, Rows, Config], None]] = {
    "class_to_object": _class_to_object,
    "class_hierarchy": _class_hierarchy,
    "class_restrictions": _class_restrictions,
    "object_property": _properties("object_property", "object", lambda x: dt.object_reference(dt.local(x["range"]) if x.get("range") else None)),
    "datatype_property": _properties("datatype_property", "datatype", lambda x: dt.fragment(x.get("range"))),
    "property_cardinality": _property_cardinality,
    "property_restrictions": _property_restrictions,
    "labels_to_titles": _texts("labels_to_titles", "label", "title"),
    "comments_to_descriptions": _texts("comments_to_descriptions", "comment", "description"),
    "annotations_to_metadata": _annotations_to_metadata,
    "enumeration_to_enum": _enumeration_to_enum,
    "union_to_anyOf": _expressions("union", "anyOf"),
    "intersection_to_allOf": _expressions("intersection", "allOf"),
    "complement_to_not": _expressions("complement", "not"),
    "equivalent_classes": _equivalent_classes,
    "disjoint_classes": _disjoint_classes,
    "ontology_to_document": _ontology_to_document,
    "individuals_to_examples": _individuals_to_examples,
    "ontology_metadata": _ontology_metadata,
    "thing_with_uri": _thing_with_uri,
}


class Engine:
    """Compiles ontologies; rules can be switched, replaced and added.

    An own rule is a function (document, rows, config) that changes the
    document; rows are the collected tables, plus any in `frames`.
    """

    def __init__(self, config: Config | dict | None = None, profile: str = "parity") -> None:
        if profile not in ("parity", "documented"):
            raise ValueError(f"no profile {profile!r}")
        self.config = config if isinstance(config, Config) else Config(config)
        self.profile, self.rules = profile, dict(FOLDS)
        self.frames: dict[str, Callable[[TBox], DataFrame]] = {}

    def add_rule(self, name: str, fold: Callable, frame: Callable[[TBox], DataFrame] | None = None) -> None:
        self.rules[name] = fold
        if frame:
            self.frames[name] = frame

    def remove_rule(self, name: str) -> None:
        self.rules.pop(name, None)

    def get_rule(self, name: str) -> Callable | None:
        return self.rules.get(name)

    def enable_rule(self, name: str) -> None:
        self.config.enable(name)

    def disable_rule(self, name: str) -> None:
        self.config.disable(name)

    def enabled_rules(self) -> list[str]:
        return [x for x in self.rules if self.config.is_enabled(x)]

    def disabled_rules(self) -> list[str]:
        return [x for x in self.rules if not self.config.is_enabled(x)]

    def transform(self, tbox: TBox) -> dict:
        frames = tables(tbox, self.config, self.profile) | {k: f(tbox) for k, f in self.frames.items()}
        rows, doc = collect(frames), Document()
        for name, fold in self.rules.items():
            used = self.profile != "parity" or name in PARITY or name not in FOLDS
            if used and self.config.is_enabled(name):
                fold(doc, rows, self.config)
        if "thing_with_uri" in self.rules and self.config.is_enabled("thing_with_uri"):
            wrap(doc, self.config, self.profile)
        return doc.build()

    def definitions(self, tbox: TBox) -> DataFrame:
        """name, schema_json, n_properties, n_required, is_enum, inherits: the definitions of transform(), folded by tasks.

        For the rules of the package but equivalent_classes, which joins definitions.
        """
        used = [x for x in self.rules if (self.profile != "parity" or x in PARITY or x not in FOLDS) and self.config.is_enabled(x)]
        if alone := [x for x in used if self.rules[x] is not FOLDS.get(x) or x == "equivalent_classes"]:
            raise ValueError(f"{alone} need the whole document")
        folds = [self.rules[x] for x in used if x not in _OF_ROOT]
        config, profile, wrapped = self.config, self.profile, "thing_with_uri" in used
        rows = None
        for kind, df in _by_definition(tables(tbox, config, profile)).items():
            one = df.select(F.lit(kind).alias("kind"), F.regexp_extract("_owner", "[^:/#]*$", 0).alias("_owner"), F.to_json(F.struct(*[c for c in df.columns if c != "_owner"])).alias("row"))
            rows = one if rows is None else rows.unionByName(one)
        dealt = settled(rows.withColumn("_owner", F.translate("_owner", " -", "__")))
        n = max(1, -(-dealt.count() // DEFINITION_ROWS))

        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _whole_owners(batches):
                for some in part.values():
                    some.sort(key=lambda x: (x.get("ord", 0), json.dumps(x, sort_keys=True)))
                doc = Document()
                for fold in folds:
                    fold(doc, part, config)
                if wrapped:
                    wrap(doc, config, profile)
                yield pa.RecordBatch.from_pylist([dict(zip(_DEFINITION.names, _definition(name, d), strict=True)) for name, d in doc.definitions.items()], schema=_DEFINITION)

        made = dealt.repartition(n, "_owner").sortWithinPartitions("_owner").mapInArrow(f, _DEFINITION_SQL)
        if wrapped:
            thing = Document()
            _thing_with_uri(thing, {}, config)
            made = made.unionByName(tbox.classes.sparkSession.createDataFrame([_definition(*x) for x in thing.definitions.items()], _DEFINITION_SQL))
        return made


#: Rules that say nothing of a single definition.
_OF_ROOT = ("ontology_to_document", "individuals_to_examples", "ontology_metadata", "thing_with_uri")
#: Rows of a task and of a fold.
DEFINITION_ROWS, _FOLD_ROWS = 200_000, 5_000
#: The column that names the class of a row's definition.
_OWNERS = {"classes": "uri", "annotations": "subject", "supers": "class", "merged": "class", "restrictions": "class", "enums": "class", "expressions": "class", "unions": "parent"}
_DEFINITION_SQL = "name string, schema_json string, n_properties int, n_required int, is_enum boolean, inherits boolean"
_DEFINITION = pa.schema([("name", pa.string()), ("schema_json", pa.string()), ("n_properties", pa.int32()), ("n_required", pa.int32()), ("is_enum", pa.bool_()), ("inherits", pa.bool_())])


def _by_definition(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables with a column _owner, whose name is that of the definition that a row says something of."""
    out = {kind: df.withColumn("_owner", F.col(_OWNERS[kind])) for kind, df in frames.items() if kind in _OWNERS}
    if "unions" in out:
        order = frames["classes"].select(F.col("uri").alias("class"), F.col("ord").alias("class_ord"))
        out["unions"] = out["unions"].join(order, "class", "left")
    if "properties" in frames:
        each = frames["properties"].withColumn("_d", F.explode("domains"))
        out["properties"] = each.withColumn("domains", F.array("_d")).withColumn("_owner", F.col("_d")["domain"]).drop("_d")
    return out


def _whole_owners(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
    """Rows by table, some thousand at once, never without all of an owner; they come owner by owner."""
    part, n, owner = defaultdict(list), 0, None
    for batch in batches:
        for name, kind, row in zip(*(batch.column(c).to_pylist() for c in ("_owner", "kind", "row")), strict=True):
            if name != owner and n >= _FOLD_ROWS:
                yield part
                part, n = defaultdict(list), 0
            owner, n = name, n + 1
            part[kind].append(json.loads(row))
    if n:
        yield part


def _definition(name: str, d: dict) -> tuple:
    body = next((x for x in d.get("allOf", []) if "$ref" not in x), d) if "properties" not in d and "allOf" in d else d
    return name, json.dumps(d), len(body.get("properties", {})), len(body.get("required", [])), "enum" in body, "allOf" in body


def definitions_table(spark, schema: dict) -> DataFrame:
    """name, ord, schema_json, n_properties, n_required, is_enum, inherits of a compiled schema."""
    rows = []
    for i, (name, d) in enumerate(schema.get("definitions", {}).items()):
        name, *rest = _definition(name, d)
        rows.append((name, i, *rest))
    return spark.createDataFrame(rows, "name string, ord int, schema_json string, n_properties int, n_required int, is_enum boolean, inherits boolean")


def statistics(definitions: DataFrame) -> DataFrame:
    """Totals over a definitions_table()."""
    return definitions.agg(
        F.count(F.lit(1)).alias("definitions"), F.sum("n_properties").alias("properties"), F.sum("n_required").alias("required"),
        F.avg("n_properties").alias("avg_properties"), F.count_if("is_enum").alias("enums"), F.count_if("inherits").alias("inheriting"),
    )
