from __future__ import annotations

import json
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphwright.functions import terms
from graphwright.functions import vocab as v
from graphwright.operators import closure, consistency, instances, jsonschema
from graphwright.operators.generate import Generator
from graphwright.operators.tbox import TBox, list_members
from graphwright.plans.compile import Engine, clean
from graphwright.sources.rdf import from_string
from graphwright.streaming import monitor

HEAD = "@prefix : <http://p.org/x#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .\n"
TEAM = HEAD + """:Human a owl:Class . :Worker a owl:Class ; rdfs:subClassOf :Human . :Firm a owl:Class ; owl:disjointWith :Human .
:name a owl:DatatypeProperty ; rdfs:domain :Human ; rdfs:range xsd:string . :age a owl:DatatypeProperty , owl:FunctionalProperty ; rdfs:domain :Human ; rdfs:range xsd:integer .
:at a owl:ObjectProperty , owl:FunctionalProperty ; rdfs:domain :Worker ; rdfs:range :Firm ; owl:inverseOf :staff . :staff a owl:ObjectProperty .
:near a owl:ObjectProperty , owl:TransitiveProperty , owl:SymmetricProperty ."""
PEOPLE = HEAD + """:ann a owl:NamedIndividual , :Worker ; :name "Ann" , "Anna" ; :age "41"^^xsd:integer ; :at :acme . :bob a :Human ; :name "Bob" ; :age "old" .
:acme a owl:NamedIndividual , :Firm ; :staff :ann ."""


def test_conversion(spark):
    schema = Engine({"rules": {"thing_with_uri": {"enabled": False}}}).transform(TBox.of(from_string(spark, TEAM, "turtle")))
    people = from_string(spark, PEOPLE, "turtle")
    got = {r["uri"].split("#")[1]: json.loads(r["obj"]) for r in instances.convert(people, schema, "http://p.org/x#").collect()}
    assert got["ann"] == {"uri": "http://p.org/x#ann", "name": ["Ann", "Anna"], "age": 41, "at": {"@id": "http://p.org/x#acme"}}
    assert got["bob"] == {"uri": "http://p.org/x#bob", "name": ["Bob"], "age": "old"}
    inline = {r["uri"].split("#")[1]: json.loads(r["obj"]) for r in instances.convert(people, schema, "http://p.org/x#", "inline", 1).collect()}
    assert inline["ann"]["at"] == got["acme"] and inline["acme"]["staff"] == [got["ann"]]
    found = instances.convert(people, schema, "http://p.org/x#")
    doc = instances.jsonld_document(found, schema, "http://p.org/x#")
    assert doc["@context"]["Human"] == "http://p.org/x#Human" and {"@id", "@type"} <= set(doc["@graph"][0]) and "uri" not in doc["@graph"][0]
    results = {r["uri"].split("#")[1]: (r["valid"], r["path"]) for r in jsonschema.validate(found, schema).collect()}
    assert results["bob"] == (False, "age")
    assert "bob" not in jsonschema.report(jsonschema.validate(found, schema)) and "old" in jsonschema.report(jsonschema.validate(found, schema))
    assert [r["idx"] for r in found.where("type = 'Human'").collect()] == [0]


def brute_components(edges):
    nodes = {x for e in edges for x in e}
    reach = {n: {n} for n in nodes}
    while True:
        grown = {n: r | {b for a, b in edges if a in r} for n, r in reach.items()}
        if grown == reach:
            break
        reach = grown
    groups = {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}
    return {(n, r) for n, r in groups.items() if sum(x == r for x in groups.values()) > 1}


@pytest.mark.parametrize("seed", [1, 2])
def test_strongly_connected_components(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(18)] + [("x", "x"), ("x", "y")]
    got = {tuple(r) for r in closure.strongly_connected(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == brute_components(edges)


def test_inline_by_components(spark):
    """A chain, a circle that a chain leads to and from, and one held twice."""
    text = HEAD + """:a a :N ; :to :b . :b a :N ; :to :c . :c a :N ; :to :d , :e . :d a :N ; :to :b . :e a :N ; :to :f . :f a :N . :g a :N ; :to :f , :g , :gone . :h a :M ; :has :a ."""
    ref = {"oneOf": [{"$ref": "#/definitions/N"}, {"type": "object"}]}
    schema = {"definitions": {"N": {"type": "object", "properties": {"to": {"type": "array", "items": ref}}}, "M": {"type": "object", "properties": {"has": ref}}}}
    got = {r["uri"].split("#")[1]: json.loads(r["obj"].replace("http://p.org/x#", "")) for r in instances.convert(from_string(spark, text, "turtle"), schema, "http://p.org/x#", "inline").collect()}
    f = {"uri": "f"}
    e = {"uri": "e", "to": [f]}
    b, c, d = {"uri": "b", "to": [{"@id": "c"}]}, {"uri": "c", "to": [{"@id": "d"}, e]}, {"uri": "d", "to": [{"@id": "b"}]}
    a = {"uri": "a", "to": [b]}
    assert got == {"a": a, "b": b, "c": c, "d": d, "e": e, "f": f, "g": {"uri": "g", "to": [f, {"@id": "g"}, {"@id": "gone"}]}, "h": {"uri": "h", "has": a}}


def test_shallow_and_deep_inheritance():
    inner = {"type": "object", "properties": {"own": {}}, "allOf": [{"$ref": "#/definitions/Up"}, {"properties": {}}]}
    defs = {"_T": {"properties": {"uri": {}}}, "Up": {"allOf": [{"$ref": "#/definitions/_T"}, {"properties": {"far": {}}}]}, "Low": {"allOf": [{"$ref": "#/definitions/_T"}, inner]}}
    assert set(instances.class_properties(defs, "Low")) == {"uri", "own"}
    assert set(instances.class_properties(defs, "Low", deep=True)) == {"uri", "own", "far"}


def test_validator():
    root = {"definitions": {"N": {"type": "integer", "minimum": 0}}}
    ok = lambda x, s: jsonschema.Validator(root | s).ok(x, root | s if False else s)
    assert ok(3, {"$ref": "#/definitions/N"}) and not ok(-1, {"$ref": "#/definitions/N"}) and not ok(1, {"$ref": "#/definitions/None"})
    assert ok({"a": [1, 2]}, {"properties": {"a": {"items": {"type": "integer"}, "minItems": 2, "maxItems": 2, "contains": {"const": 2}}}, "required": ["a"], "additionalProperties": False})
    assert not ok({"b": 1}, {"properties": {"a": {}}, "additionalProperties": False}) and not ok({}, {"required": ["a"]})
    assert ok("x", {"oneOf": [{"type": "string"}, {"type": "integer"}]}) and not ok(True, {"oneOf": [{"type": "boolean"}, {"enum": [True]}]})
    assert not ok(True, {"enum": [1]}) and not ok(True, {"type": "integer"}) and ok(1.0, {"type": "integer"})
    assert ok(5, {"not": {"type": "string"}}) and ok(5, {"anyOf": [{"type": "string"}, {"maximum": 5}]}) and not ok(5, {"allOf": [{"maximum": 4}]})


def test_expressions_agree_with_the_validator(spark):
    rng = random.Random(3)
    scalars = [0, -1, 5, 2.5, 3.0, 1e20, "", "a", "abc", True, False, None]

    def value(depth=3):
        kind = rng.random()
        if depth and kind < 0.3:
            return {n: value(depth - 1) for n in rng.sample(["a", "b", "@id", "x y"], rng.randint(0, 3))}
        return [value(depth - 1) for _ in range(rng.randint(0, 3))] if depth and kind < 0.5 else rng.choice(scalars)

    def schema(depth=3):
        out = {}
        for k in rng.sample(["type", "enum", "const", "properties", "required", "items", "minItems", "maxItems", "minimum", "maximum", "minLength", "maxLength", "allOf", "anyOf", "oneOf", "not", "additionalProperties", "$ref", "title", "pattern", "uniqueItems"], rng.randint(1, 4)):
            some = lambda n=2: [schema(depth - 1) for _ in range(rng.randint(1, n))]
            if k in ("allOf", "anyOf", "oneOf", "not", "items", "properties") and not depth:
                continue
            out[k] = {
                "type": lambda: rng.choice(["string", "integer", "number", "boolean", "object", "array", "null", ["string", "null"]]), "enum": lambda: rng.sample(["a", "abc", True, 5], 2), "const": lambda: rng.choice(["a", False, 0]),
                "properties": lambda: {n: schema(depth - 1) for n in rng.sample(["a", "b", "@id", "x y"], 2)}, "required": lambda: rng.sample(["a", "b", "@id"], rng.randint(0, 2)), "items": lambda: schema(depth - 1), "minItems": lambda: rng.randint(0, 2),
                "maxItems": lambda: rng.randint(0, 3), "minimum": lambda: rng.choice([0, 2.5]), "maximum": lambda: rng.choice([4, 3.0]), "minLength": lambda: 1, "maxLength": lambda: 2, "allOf": some, "anyOf": some, "oneOf": some, "not": lambda: schema(depth - 1),
                "additionalProperties": lambda: False, "$ref": lambda: "#/definitions/Base", "title": lambda: "t", "pattern": lambda: "^a", "uniqueItems": lambda: True,
            }[k]()
        return out

    base, rows, quick = {"type": ["object", "string"], "required": ["a"]}, [], 0
    for i in range(40):
        one = schema()
        definitions = {"Base": base, "T": one}
        values = [value() for _ in range(30)]
        df = spark.createDataFrame([("T", json.dumps(x)) for x in values], "type string, obj string").coalesce(1)
        got = [r[0] for r in df.select(jsonschema.surely_valid({"definitions": definitions})).collect()]
        wanted = [jsonschema.Validator({"definitions": definitions}).ok(x, one) for x in values]
        assert all(w or not g for g, w in zip(got, wanted, strict=True)), (one, [x for x, g, w in zip(values, got, wanted, strict=True) if g and not w])
        try:
            jsonschema._Expression(definitions).valid(F.try_parse_json("obj"), one)
            assert got == wanted, (one, [x for x, g, w in zip(values, got, wanted, strict=True) if g != w])
            quick += 1
        except jsonschema.Unsupported:
            assert not any(got)
    assert quick >= 15


def test_circular_definitions():
    ref = lambda n: {"$ref": f"#/definitions/{n}"}
    defs = {"Train": {"properties": {"parts": {"type": "array", "items": ref("Train")}}}, "Car": {"properties": {"inside": ref("Train")}}, "A": {"allOf": [ref("B")]}, "B": {"allOf": [ref("A")]}}
    assert [jsonschema.is_circular(defs, n) for n in ("Train", "Car", "A", "None")] == [True, False, True, False]


def test_consistency(spark):
    facts = HEAD + """:ann a owl:NamedIndividual , :Worker ; :at :acme , :other ; :near :bob . :bob :near :cat . :acme a owl:NamedIndividual , :Human .
:nil a owl:Nothing ."""
    t, a = from_string(spark, TEAM, "turtle"), from_string(spark, facts, "turtle")
    issues = {(r["type"], (r["subject"] or "").split("#")[-1]) for r in consistency.check(t, a).collect()}
    assert issues == {("functional_violation", "ann"), ("disjoint_violation", "acme"), ("nothing_instance", "nil")}
    direct = {r["type"] for r in consistency.check(t, a, reason=False).collect()}
    assert direct == {"functional_violation", "nothing_instance"}
    assert "A-box validation: 3 issues" in consistency.report(consistency.check(t, a))


def test_entailment(spark):
    facts = HEAD + ":a a :Worker ; :at :f . :x :near :y . :y :near :z . :h a :Adult . :Adult owl:intersectionOf ( :Human :Old ) . :o a :Human , :Old . :k :likes :o . :Fan a owl:Restriction ; owl:onProperty :likes ; owl:someValuesFrom :Old ."
    t = from_string(spark, TEAM, "turtle").unionByName(from_string(spark, facts, "turtle"))
    short = lambda x: x.split("#")[-1]
    got = {(short(r["s"]), short(r["p"]), short(r["o"])) for r in closure.owl_rl(t).collect()}
    assert {("a", "type", "Human"), ("f", "type", "Firm"), ("f", "staff", "a"), ("x", "near", "z"), ("z", "near", "x"), ("h", "type", "Old"), ("o", "type", "Adult"), ("k", "type", "Fan")} <= got
    assert ("a", "type", "Firm") not in got


@settings(max_examples=5, deadline=None)
@given(edges=st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), min_size=1, max_size=12))
def test_closure_is_idempotent_and_right(spark, edges):
    df = spark.createDataFrame(edges, "src int, dst int")
    got = {tuple(r) for r in closure.transitive_closure(df).collect()}
    want = set(edges)
    while more := {(a, d) for a, b in want for c, d in want if b == c} - want:
        want |= more
    assert got == want


def test_generator(spark):
    tbox = TBox.of(from_string(spark, TEAM, "turtle"))
    a, b, c = (Generator(tbox, "http://g.org/y/", s).generate(2, 4) for s in (1, 1, 2))
    assert a.exceptAll(b).isEmpty() and not a.exceptAll(c).isEmpty()
    kinds = {r["o"]: r["n"] for r in a.where(f"p = '{v.TYPE}'").groupBy("o").count().withColumnRenamed("count", "n").collect()}
    assert all(2 <= kinds[f"http://p.org/x#{k}"] <= 4 for k in ("Worker", "Firm"))
    per = a.where("p like '%#at' or p like '%#age'").groupBy("s", "p").count()
    assert per.where("count > 1").isEmpty()
    assert consistency.check(from_string(spark, TEAM, "turtle"), a, reason=False).isEmpty()


def test_numbers_are_in_the_order_of_iris(spark):
    rows = [(f"t{i % 3}", f"http://p.org/{i * 7919 % 200}", "{}") for i in range(200)]
    got = instances.number(spark.createDataFrame(rows, "type string, uri string, obj string").repartition(5)).collect()
    for kind in ("t0", "t1", "t2"):
        own = sorted((r["uri"], r["idx"]) for r in got if r["type"] == kind)
        assert [i for _, i in own] == list(range(len(own)))


def test_lists_that_go_in_a_circle(spark):
    good = from_string(spark, HEAD + ":x owl:oneOf ( :a :b :c :d :e ) .", "turtle")
    assert sorted((r["pos"], r["member"][-1]) for r in list_members(good).collect()) == list(enumerate("abcde"))
    bad = good.unionByName(from_string(spark, HEAD.replace("xsd:", "rdf:").replace("http://www.w3.org/2001/XMLSchema#", v.RDF) + ":p rdf:first :a ; rdf:rest :q . :q rdf:first :b ; rdf:rest :p .", "turtle"))
    with pytest.raises(ValueError, match="circle"):
        list_members(bad)


def test_report_is_bounded(spark):
    rows = [("a", f"m{i:03}") for i in range(50)] + [("b", "x")]
    issues = spark.createDataFrame(rows, "type string, message string")
    assert consistency.report(issues, 3).splitlines() == ["A-box validation: 51 issues", "", "a (50)", "  - m000", "  - m001", "  - m002", "", "b (1)", "  - x"]


def test_disjoint_groups_without_union(spark):
    t = from_string(spark, HEAD + ":A a owl:Class ; owl:disjointWith :B . :B a owl:Class . :C a owl:Class ; owl:disjointWith :B .", "turtle")
    on = {"rules": {"disjoint_classes": {"enabled": True}}}
    assert Engine(on, "documented").transform(TBox.of(t))["$comment"] == "Disjoint class groups: [['A', 'B'], ['B', 'C']]"


def test_streaming(spark, tmp_path):
    rows = [("a", "p", "1", "2024-01-01 00:00:00"), ("a", "p", "2", "2024-01-01 00:01:00"), ("b", "p", "1", "2024-01-01 00:02:00"), ("a", "q", "3", "2024-01-01 00:02:00")]
    spark.createDataFrame(rows, "s string, p string, o string, t string").selectExpr("s", "p", "o", "cast(t as timestamp) ts").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("s string, p string, o string, ts timestamp").parquet(f"{tmp_path}/in")
    functional = spark.createDataFrame([("p",)], "p string")
    q = monitor.functional_violations(stream, functional).writeStream.outputMode("update").format("memory").queryName("violations").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["s"], r["p"], r["n_values"]) for r in spark.table("violations").collect()] == [("a", "p", 2)]


@settings(max_examples=1, deadline=None)
@given(names=st.lists(st.text(alphabet="ab:/#- ", max_size=12), min_size=30, max_size=30))
def test_names(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "u string")
    for r in df.select("u", terms.local_name("u").alias("l"), terms.clean_name("u").alias("c")).collect():
        u = r["u"]
        assert r["l"] == (u.rsplit("#", 1)[-1] if "#" in u else u.rsplit("/", 1)[-1])
        assert r["c"] == clean(u)


def test_spark_type():
    defs = {"A": {"type": "object", "properties": {"n": {"type": "integer"}, "xs": {"type": "array", "items": {"type": "number"}}, "r": {"oneOf": [{}, {}]}}}}
    assert jsonschema.spark_type({"$ref": "#/definitions/A"}, defs).simpleString() == "struct<n:bigint,xs:array<double>,r:struct<@id:string>>"


def test_generator_is_registered_over_the_whole_vocabulary(spark):
    import __spark_entry__ as entry
    import bench

    assert "generate_individuals" in bench.HEADLINE
    rows = entry.queries()["generate_individuals"](spark, entry.SMOKE_DIR).collect()
    types = {r["o"].rsplit("#", 1)[-1] for r in rows if r["p"] == v.TYPE}
    assert {"Customer", "Supplier", "Order", "LineItem", "Part", "Nation"} <= types


def test_literals_that_many_have_do_not_fill_a_task(spark):
    """Only references meet finished objects; a literal that is the IRI of one stays a literal."""
    found = spark.createDataFrame([("A", f"u{i}", n, False, k, o, j, i, kind) for i in range(50) for n, k, o, j, kind in (("p", "literal", "x", '"x"', "string"), ("r", "uri", "x", '{"@id":"x"}', "ref"), ("s", None, "x", '"x"', "any"))],
                                  "type string, uri string, name string, is_array boolean, o_kind string, o string, json string, ord long, kind string")
    inner = spark.createDataFrame([("x", "{}")], "o string, inner string")
    made = instances._with_objects(found, inner)
    assert sorted({(r["name"], r["json"]) for r in made.collect()}) == [("p", '"x"'), ("r", "{}"), ("s", '"x"')] and made.count() == 150
    assert "hashpartitioning(o" not in made._jdf.queryExecution().executedPlan().toString()


def test_tables_that_grow_are_not_broadcast(spark, monkeypatch):
    """Neither individuals nor values, and their tasks grow in number, not in size."""
    monkeypatch.setattr(instances, "TASK_VALUES", 100)
    monkeypatch.setattr(instances, "RANGE_ROWS", 100)
    who = spark.range(3000).selectExpr("'A' as type", "concat('http://t.org/', id) as uri")
    found = who.selectExpr("*", "'p' as name", "false as is_array", "1L as ord", "'x' as o", "'1' as json").cache()
    made = instances.objects(found, instances.ranked(who))
    plan = made._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and not re.search(r"BroadcastHashJoin \[type#\d+L?, uri", plan)
    assert "hashpartitioning(type" in made._jdf.queryExecution().executedPlan().toString() and ", 30)" in made._jdf.queryExecution().executedPlan().toString()
    assert [r["idx"] for r in made.orderBy("uri").select("idx").collect()] == list(range(3000))
