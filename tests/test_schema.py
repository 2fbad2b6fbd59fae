from __future__ import annotations

import json

import pytest

from graphwright import cli
from graphwright.operators.tbox import TBox
from graphwright.plans.compile import Document, Engine, clean
from graphwright.plans.config import RULES, Config, default_config
from graphwright.sources.rdf import from_string

HEAD = "@prefix : <http://r.org/x#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .\n"
FLEET = HEAD + """<http://r.org/x> a owl:Ontology ; owl:versionInfo "2.0" .
:Asset a owl:Class ; rdfs:label "Asset"@en .
:Train a owl:Class ; rdfs:subClassOf :Asset , [ a owl:Restriction ; owl:onProperty :madeOf ; owl:allValuesFrom :Asset ] ; owl:disjointWith :Car ; rdfs:label "Train"@en .
:Car a owl:Class ; rdfs:subClassOf :Asset , %s ; rdfs:label "Car"@en .
:Kind a owl:Class ; rdfs:subClassOf [ a owl:Class ; owl:oneOf ( :Box :Tank ) ] .
:Box a owl:NamedIndividual ; rdfs:label "Box car"@en . :Tank a owl:NamedIndividual .
:madeOf a owl:ObjectProperty , owl:InverseFunctionalProperty ; owl:inverseOf :inside ; rdfs:range :Asset ; rdfs:label "made of"@en .
:inside a owl:ObjectProperty , owl:FunctionalProperty ; rdfs:label "inside"@en .
:kind a owl:ObjectProperty , owl:FunctionalProperty ; rdfs:domain :Car ; rdfs:range :Kind .
:built a owl:DatatypeProperty , owl:FunctionalProperty ; rdfs:domain :Asset ; rdfs:range xsd:dateTime .
:marks a owl:DatatypeProperty ; rdfs:domain :Asset , :Unknown ; rdfs:range xsd:unsignedByte .
"""
VARIANTS = [
    "[ a owl:Restriction ; owl:onProperty :kind ; owl:someValuesFrom owl:Thing ]",
    "[ owl:intersectionOf ( [ a owl:Restriction ; owl:onProperty :kind ; owl:minCardinality 1 ] [ a owl:Restriction ; owl:onProperty :kind ; owl:maxCardinality 1 ] ) ]",
    "[ a owl:Restriction ; owl:onProperty :kind ; owl:minQualifiedCardinality 1 ; owl:onClass :Kind ]",
]


def compiled(spark, text, config=None, profile="parity"):
    return Engine(config, profile).transform(TBox.of(from_string(spark, text, "turtle")))


def body(schema, name):
    return schema["definitions"][name]["allOf"][1]


@pytest.mark.parametrize("variant", VARIANTS)
def test_required_and_inferred_properties(spark, variant):
    s = compiled(spark, FLEET % variant)
    assert body(s, "Car")["required"] == ["kind"]
    assert "required" not in body(s, "Asset") and "required" not in body(s, "Train")
    assert body(s, "Car")["properties"]["kind"]["oneOf"][0] == {"$ref": "#/definitions/Kind"}
    inside = body(s, "Asset")["properties"]["inside"]  # domain from the inverse's range, range from the inverse's user
    assert inside["oneOf"][0] == {"$ref": "#/definitions/Train"} and inside["title"] == "inside"
    assert body(s, "Train")["properties"]["madeOf"]["type"] == "array"
    assert body(s, "Asset")["properties"]["built"] == {"type": "string", "format": "date-time"}
    assert body(s, "Asset")["properties"]["marks"] == {"type": "array", "items": {"type": "integer", "minimum": 0, "maximum": 255}}
    assert body(s, "Kind") == {"type": "string", "enum": ["Box car", "Tank"]}
    assert s["additionalProperties"] is False and s["type"] == "object" and "Unknown" not in s["definitions"]


def test_disjoint_union_on_and_off(spark):
    s = compiled(spark, FLEET % VARIANTS[0], {"rules": {"disjoint_classes": {"enabled": True}}})
    assert body(s, "Asset")["oneOf"] == [{"$ref": "#/definitions/Train"}, {"$ref": "#/definitions/Car"}]
    assert s["definitions"]["Asset"]["description"] == "Disjoint union of: Train, Car" and "built" in body(s, "Asset")["properties"]
    assert "oneOf" not in body(compiled(spark, FLEET % VARIANTS[0]), "Asset")


def test_base_definition_on_and_off(spark):
    text = HEAD + ":A a owl:Class . :B a owl:Class ; rdfs:subClassOf :A ."
    on = compiled(spark, text)
    assert on["definitions"]["A"]["allOf"][0] == {"$ref": "#/definitions/_Thing"} and "uri" in on["definitions"]["_Thing"]["properties"]
    off = compiled(spark, text, {"rules": {"thing_with_uri": {"enabled": False}}})
    assert off["definitions"] == {"A": {"type": "object", "properties": {}}, "B": {"type": "object", "properties": {}, "allOf": [{"$ref": "#/definitions/A"}, {"type": "object", "properties": {}}]}}


def test_documented_profile(spark):
    text = HEAD + """<http://r.org/x> a owl:Ontology ; owl:versionInfo "2.0" ; owl:imports <http://o.org/y> .
:A a owl:Class ; :note "n" . :B a owl:Class ; owl:equivalentClass :A . :U a owl:Class ; owl:equivalentClass [ owl:unionOf ( :A :C ) ] .
:C a owl:Class ; rdfs:subClassOf [ owl:complementOf :A ] , [ a owl:Restriction ; owl:onProperty :p ; owl:maxCardinality 3 ] .
:p a owl:DatatypeProperty ; rdfs:domain :C ; rdfs:range xsd:int . :i a owl:NamedIndividual , :C ; :p 4 ."""
    config = {"rules": {"individuals_to_examples": {"enabled": True, "options": {"include_id": True}}, "annotations_to_metadata": {"enabled": True}, "thing_with_uri": {"enabled": False}, "ontology_metadata": {"options": {"placement": "comment"}}}}
    s = compiled(spark, text, config, "documented")
    d = s["definitions"]
    assert d["A"] == d["B"] == {"$ref": "#/definitions/_shared_A"} and "_shared_A" in d
    assert d["U"]["anyOf"] == [{"$ref": "#/definitions/A"}, {"$ref": "#/definitions/C"}] and d["C"]["not"] == {"$ref": "#/definitions/A"}
    assert d["C"]["properties"]["p"]["maxItems"] == 3 and d["C"]["properties"]["p"]["items"] == {"type": "integer"}
    assert s["examples"] == [{"@type": "C", "p": "4", "@id": "http://r.org/x#i"}]
    assert s["$id"] == "http://r.org/x" and s["$comment"].startswith("Metadata: ") and json.loads(s["$comment"][10:]) == {"version": "2.0"}


def test_engine_rules(spark):
    e = Engine()
    e.disable_rule("class_hierarchy")
    assert "class_hierarchy" in e.disabled_rules() and "class_to_object" in e.enabled_rules()
    e.enable_rule("class_hierarchy")
    e.add_rule("own", lambda doc, rows, c: doc.add_to_root("title", f"{len(rows['names'])} names"), lambda t: t.classes.select("uri"))
    e.frames["names"] = e.frames.pop("own")
    s = e.transform(TBox.of(from_string(spark, HEAD + ":A a owl:Class .", "turtle")))
    assert s["title"] == "1 names"
    e.remove_rule("own")
    assert e.get_rule("own") is None
    with pytest.raises(ValueError):
        Engine(profile="other")
    empty = Engine().transform(TBox.from_rows(spark))
    assert list(empty["definitions"]) == ["_Thing"]


def test_config(tmp_path):
    c = Config()
    assert not c.is_enabled("disjoint_classes") and c.is_enabled("thing_with_uri") and Config({"rules": {"x": {}}}).is_enabled("disjoint_classes")
    assert not Config({"class_hierarchy": {"enabled": False}}).is_enabled("class_hierarchy")
    assert Config({}).data["rules"] == default_config()["rules"]
    for name in ("c.yaml", "c.json"):
        try:
            c.to_file(f"{tmp_path}/{name}")
        except ImportError:
            continue
        assert Config.from_file(f"{tmp_path}/{name}").data == c.data
    with pytest.raises(FileNotFoundError):
        Config.from_file(f"{tmp_path}/none.json")
    (tmp_path / "c.txt").write_text("x")
    with pytest.raises(ValueError):
        Config.from_file(f"{tmp_path}/c.txt")


def test_document():
    d = Document()
    d.add_definition("ns:a-b c", {"type": "object"})
    d.set_property("missing", "p", {})
    d.set_property("a-b c", "p", {"type": "string"})
    d.require("a-b c", "p")
    d.require("a-b c", "p")
    d.add_to_schema("x/y", 1)
    d.merge({"definitions": {"Z": {}}, "required": ["q"], "examples": [1]})
    out = d.build()
    assert out["definitions"] == {"a_b_c": {"type": "object", "properties": {"p": {"type": "string"}}, "required": ["p"]}, "Z": {}} and out["x"] == {"y": 1} and out["examples"] == [1]
    d.add_property("p", {"type": "string"}, True)
    assert d.build()["required"] == ["q", "p"]
    assert Document().build() == {"$schema": out["$schema"], "type": "object"} and clean("http://a/b#c-d") == "c_d"


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "x.ttl").write_text(HEAD + ":A a owl:Class .")
    assert cli.main(["list-rules"]) == 0 and len(capsys.readouterr().out.splitlines()) == len(RULES)
    assert cli.main(["generate-config", f"{tmp_path}/c.json"]) == 0
    assert cli.main(["transform", f"{tmp_path}/x.ttl", "-o", f"{tmp_path}/o.json", "-c", f"{tmp_path}/c.json", "--disable-rule", "thing_with_uri"]) == 0
    assert json.loads((tmp_path / "o.json").read_text())["definitions"] == {"A": {"type": "object", "properties": {}}}


@pytest.mark.parametrize("wrapped", [False, True])
def test_definitions_folded_by_tasks_are_those_of_the_document(spark, monkeypatch, wrapped):
    """The same definitions without a document on the driver, also where every task folds a few rows at once."""
    from graphwright.catalog_queries import catalog
    from graphwright.operators.tbox import TBox
    from graphwright.plans import compile as c

    rules = {"disjoint_classes": {"enabled": True}, "annotations_to_metadata": {"enabled": True}, "thing_with_uri": {"enabled": wrapped}, "equivalent_classes": {"enabled": False}}
    tbox = TBox.of(catalog(spark, "/root/testdata/sf0.001"))
    for profile in ("parity", "documented"):
        engine = c.Engine({"rules": rules}, profile)
        wanted = engine.transform(tbox)["definitions"]
        monkeypatch.setattr(c, "DEFINITION_ROWS", 300)
        monkeypatch.setattr(c, "collect", None)
        got = {r["name"]: json.loads(r["schema_json"]) for r in engine.definitions(tbox).collect()}
        monkeypatch.undo()
        assert got == wanted
