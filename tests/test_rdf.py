from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphwright.functions import vocab as v
from graphwright.sources import sinks
from graphwright.sources.rdf import RdfSource, detect_format, from_string, ntriples_errors, parse, read_ntriples, read_prefixes, read_rdf

TURTLE = """@prefix : <http://t.org/x#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
@base <http://t.org/x> .
<> a owl:Ontology .   # the header
:Pet a owl:Class ; rdfs:label "Pet"@en, "Haustier"@de ; rdfs:comment \"\"\"two
lines "quoted" \"\"\" .
:Dog a owl:Class ; rdfs:subClassOf :Pet , [ a owl:Restriction ; owl:onProperty :age ; owl:maxCardinality 1 ] ; .
:kinds owl:oneOf ( :a :b "c\\t" ) .
[] :p 1.5 , -2 , 3e4 , true , <rel> , _:n .
"""
XML = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#" xml:base="http://t.org/x">
  <owl:Class rdf:about="#Dog"><rdfs:label xml:lang="en">Dog</rdfs:label>
    <rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="#age"/>
      <owl:maxCardinality rdf:datatype="http://www.w3.org/2001/XMLSchema#nonNegativeInteger">1</owl:maxCardinality></owl:Restriction></rdfs:subClassOf></owl:Class>
  <owl:Class rdf:ID="Kind"><owl:oneOf rdf:parseType="Collection"><rdf:Description rdf:about="#a"/><rdf:Description rdf:about="#b"/></owl:oneOf></owl:Class>
</rdf:RDF>"""
JSONLD = """{"@context": {"x": "http://t.org/x#", "owl": "http://www.w3.org/2002/07/owl#", "label": {"@id": "http://www.w3.org/2000/01/rdf-schema#label"},
 "sub": {"@id": "http://www.w3.org/2000/01/rdf-schema#subClassOf", "@type": "@id"}},
 "@graph": [{"@id": "x:Dog", "@type": "owl:Class", "label": {"@value": "Dog", "@language": "en"}, "sub": "x:Pet", "x:tags": {"@list": ["a", 2]}}, {"@id": "_:n", "x:p": [1.5, true]}]}"""


def rows(text, syntax):
    return [(r[1], r[3], r[4], r[5], r[6], r[7]) for r in parse(text, syntax, "t")[0]]


def test_turtle():
    got = rows(TURTLE, "turtle")
    assert ("http://t.org/x", v.TYPE, v.ONTOLOGY, "uri", None, None) in got
    assert ("http://t.org/x#Pet", v.LABEL, "Haustier", "literal", None, "de") in got
    assert ("http://t.org/x#Pet", v.COMMENT, 'two\nlines "quoted" ', "literal", None, None) in got
    assert [r[2] for r in got if r[1] == v.FIRST] == ["http://t.org/x#a", "http://t.org/x#b", "c\t"]
    assert {(r[2], r[4]) for r in got if r[1] == "http://t.org/x#p" and r[3] == "literal"} == {
        ("1.5", v.XSD + "decimal"), ("-2", v.XSD + "integer"), ("3e4", v.XSD + "double"), ("true", v.XSD + "boolean")
    }
    assert "http://t.org/rel" in {r[2] for r in got}
    assert len(got) == 24
    for bad in (":a :b :c .", "<a> <b> .", "@prefix : <http://x#> . :a :b"):
        with pytest.raises(ValueError):
            rows(bad, "turtle")


def test_xml_and_jsonld():
    got = rows(XML, "xml")
    assert ("http://t.org/x#Dog", v.LABEL, "Dog", "literal", None, "en") in got
    assert [r[2] for r in got if r[1] == v.FIRST] == ["http://t.org/x#a", "http://t.org/x#b"]
    assert [(r[2], r[4]) for r in got if r[1] == v.OWL + "maxCardinality"] == [("1", v.XSD + "nonNegativeInteger")]
    got = rows(JSONLD, "json-ld")
    assert ("http://t.org/x#Dog", v.SUBCLASS, "http://t.org/x#Pet", "uri", None, None) in got
    assert [(r[2], r[4]) for r in got if r[1] == v.FIRST] == [("a", None), ("2", v.XSD + "integer")]


def test_detection_and_fallback():
    assert [detect_format(x) for x in ("a.ttl", "a.owl", "a.nt", "a.jsonld", "a.n3")] == ["turtle", "xml", "nt", "json-ld", "n3"]
    assert detect_format("a", "<?xml") == "xml" and detect_format("a", "@prefix x:") == "turtle" and detect_format("a", "??") is None
    assert len(parse("@prefix : <http://x#> . :a :b :c .", "xml", "t")[0]) == 1
    with pytest.raises(Exception, match="."):
        parse("<a><b></a>", "xml", "t")


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "x.ttl").write_text(TURTLE)
    t = read_rdf(spark, f"{tmp_path}/x.ttl")
    keys = ["s", "p", "o", "o_kind", "o_datatype", "o_lang"]
    assert t.count() == 24
    assert {r["prefix"] for r in read_prefixes(spark, f"{tmp_path}/x.ttl").collect()} == {"", "owl", "rdfs"}
    sinks.write_ntriples(t, f"{tmp_path}/out.nt")
    back = read_ntriples(spark, f"{tmp_path}/out.nt")
    assert back.select(keys).exceptAll(t.select(keys)).isEmpty() and back.count() == 24
    named = t.where("s_kind = 'uri' and o_kind <> 'bnode'")
    for name in ("o.ttl", "o.rdf", "o.jsonld"):
        sinks.save(named, f"{tmp_path}/{name}")
        again = read_rdf(spark, f"{tmp_path}/{name}")
        assert again.select(keys).exceptAll(named.select(keys)).isEmpty() and again.count() == named.count()
    spark.dataSource.register(RdfSource)
    assert spark.read.format("rdf").option("path", f"{tmp_path}/x.ttl").load().count() == 24
    assert from_string(spark, XML, "xml").count() == len(set(rows(XML, "xml")))


def test_ntriples_escapes_and_bad_lines(spark, tmp_path):
    lines = [
        r'<http://t.org/a> <http://t.org/p> "tab\t nl\n cr\r quote\" back\\ back-t\\t u\u00e9 pair\uD83D\uDE00 wide\U0001F600 \\u0041" .',
        r"<http://t.org/\u00e9> <http://t.org/p> <http://t.org/b> . # end",
        "# a comment",
        "",
        r'_:x <http://t.org/p> ""@EN .',
    ]
    (tmp_path / "a.nt").write_text("\n".join(lines))
    got = {r["s"]: (r["o"], r["o_kind"], r["o_lang"]) for r in read_ntriples(spark, f"{tmp_path}/a.nt").collect()}
    assert got == {
        "http://t.org/a": ('tab\t nl\n cr\r quote" back\\ back-t\\t u\u00e9 pair\U0001f600 wide\U0001f600 \\u0041', "literal", None),
        "http://t.org/\u00e9": ("http://t.org/b", "uri", None), "_:x": ("", "literal", "en"),
    }
    assert {(r[1], r[4]) for r in parse(lines[0], "nt", "t")[0]} == {("http://t.org/a", got["http://t.org/a"][0])}
    (tmp_path / "b.nt").write_text("\n".join([lines[0], "<http://t.org/a> <http://t.org/p> .", '<a> <b> "open .']))
    with pytest.raises(Exception, match="not a triple"):
        read_ntriples(spark, f"{tmp_path}/b.nt").count()
    assert read_ntriples(spark, f"{tmp_path}/b.nt", bad="skip").count() == 1 and ntriples_errors(spark, f"{tmp_path}/b.nt").count() == 2


def test_any_literal_comes_back(spark, tmp_path):
    found = []
    text = st.text(st.characters(codec="utf-8"), max_size=12) | st.text('\\"\n\rtnuU0041 \t\x0b\x85\u2028.@^<>', max_size=12)

    @settings(max_examples=400, deadline=None, database=None)
    @given(text)
    def draw(x):
        found.append(x)

    draw()
    rows = [(f"http://t.org/{i}", "uri", "http://t.org/p", x, "literal", None, None) for i, x in enumerate(found)]
    t = spark.createDataFrame(rows, "s string, s_kind string, p string, o string, o_kind string, o_datatype string, o_lang string")
    sinks.write_ntriples(t, f"{tmp_path}/out.nt")
    back = {r["s"]: r["o"] for r in read_ntriples(spark, f"{tmp_path}/out.nt").collect()}
    assert back == {r[0]: r[3] for r in rows}
