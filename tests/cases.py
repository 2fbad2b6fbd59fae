"""Operators on small ontologies that are stated here, each with the rows that it must give, as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwright.functions import vocab as v
from graphwright.functions.terms import local_name
from graphwright.model_queries import _axioms
from graphwright.operators import closure, consistency, jsonschema, rules
from graphwright.operators import tbox as tb
from graphwright.operators.generate import Generator
from graphwright.plans.compile import Engine, definitions_table
from graphwright.plans.tables import Parts, settled
from graphwright.queries import _short, _tbox
from graphwright.sources import rdf, sinks
from graphwright.sources.relational import BASE

CASES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def query(sql: str):
    def add(f):
        CASES[f.__name__] = (f, sql)
        return f

    return add


#: An ontology with every construct that the extraction knows.
MODEL = f"""@prefix : <{BASE}> . @prefix owl: <{v.OWL}> . @prefix rdfs: <{v.RDFS}> . @prefix xsd: <{v.XSD}> . @prefix dc: <{v.DC}> .
<http://ex.org/d> a owl:Ontology ; owl:versionInfo "7" ; owl:imports <http://ex.org/base> ; dc:creator "Trade desk" .
:Agent a owl:Class ; rdfs:label "Agent"@en , "Akteur"@de ; rdfs:comment "Who buys or sells"@en .
:Customer a owl:Class ; rdfs:subClassOf :Agent ; rdfs:label "Customer" ; owl:disjointWith :Supplier .
:Supplier a owl:Class ; rdfs:subClassOf :Agent .
:Order a owl:Class ; rdfs:label "Order"@en ; dc:source "orders" ; rdfs:subClassOf
  [ a owl:Restriction ; owl:onProperty :placedBy ; owl:cardinality 1 ] ,
  [ a owl:Class ; owl:intersectionOf ( [ a owl:Restriction ; owl:onProperty :hasLine ; owl:minCardinality 1 ] [ a owl:Restriction ; owl:onProperty :hasLine ; owl:allValuesFrom :LineItem ] ) ] .
:LineItem a owl:Class ; rdfs:subClassOf [ a owl:Restriction ; owl:onProperty :ofPart ; owl:maxQualifiedCardinality 3 ; owl:onClass :Part ] , [ a owl:Restriction ; owl:onProperty :unit ; owl:hasValue "piece" ] .
:Part a owl:Class ; owl:equivalentClass :Article , [ a owl:Class ; owl:unionOf ( :Kit :Piece ) ] . :Article a owl:Class . :Kit a owl:Class . :Piece a owl:Class ; rdfs:subClassOf [ a owl:Class ; owl:complementOf :Kit ] .
:Priority a owl:Class ; rdfs:subClassOf [ a owl:Class ; owl:oneOf ( :urgent :high :low ) ] . :urgent rdfs:label "1-URGENT"@en . :high rdfs:label "2-HIGH" .
:placedBy a owl:ObjectProperty , owl:FunctionalProperty ; rdfs:domain :Order ; rdfs:range :Customer ; owl:inverseOf :hasOrder ; rdfs:label "placed by"@en .
:hasOrder a owl:ObjectProperty , owl:InverseFunctionalProperty . :hasLine a owl:ObjectProperty ; rdfs:domain :Order ; rdfs:range :LineItem .
:ofPart a owl:ObjectProperty , owl:AsymmetricProperty , owl:IrreflexiveProperty ; rdfs:domain :LineItem . :replaces a owl:ObjectProperty , owl:TransitiveProperty , owl:SymmetricProperty , owl:ReflexiveProperty ; rdfs:subPropertyOf :relatedTo .
:quantity a owl:DatatypeProperty , owl:FunctionalProperty ; rdfs:domain :LineItem ; rdfs:range xsd:double ; rdfs:comment "How many" . :unit a owl:DatatypeProperty ; rdfs:domain :LineItem ; rdfs:range xsd:string .
:shop a owl:NamedIndividual , :Customer ; rdfs:label "The shop"@en ; :rating "3"^^xsd:integer , "4"^^xsd:integer . :mill a owl:NamedIndividual , :Supplier , :Agent .
"""


_cache: dict[str, DataFrame] = {}


def _file(spark: SparkSession, text: str) -> str:
    """A glob for a file with the text, in the shared folder."""
    parts = Parts()
    parts.add(spark.createDataFrame([(text,)], "value string").coalesce(1))
    path = parts.paths[0] + "-text"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return f"{path}/part-*"


def _triples(spark: SparkSession) -> DataFrame:
    """The ontology's triples, read from a file once per application."""
    key = spark.sparkContext.applicationId
    if key not in _cache:
        _cache.clear()
        _cache[key] = settled(rdf.read_rdf(spark, _file(spark, MODEL), "turtle"))
    return _cache[key]


def _model(spark: SparkSession) -> tb.TBox:
    return tb.TBox.of(_triples(spark))


@query(f"SELECT syntax, CAST(n AS BIGINT) AS n FROM (VALUES ('turtle', 107), ('nt', 107), ('xml', 107), ('json-ld', 107)) v(syntax, n)")
def rdf_syntaxes(spark, sf_dir):
    """The ontology's triples, written in four syntaxes and read from files again."""
    t, out = _triples(spark), None
    nodes = sinks.jsonld_nodes(t).agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("node")), ","), F.lit("]"))).first()[0]
    texts = {"turtle": sinks.to_turtle(t), "nt": "\n".join(r["value"] for r in sinks.ntriples_lines(t).collect()), "xml": sinks.to_rdfxml(t), "json-ld": nodes}
    for syntax, text in texts.items():
        back = rdf.read_rdf(spark, _file(spark, text), syntax).where("o_kind is not null")
        one = back.agg(F.count(F.lit(1)).alias("n")).select(F.lit(syntax).alias("syntax"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT path, syntax FROM (VALUES ('a.ttl', 'turtle'), ('a.turtle', 'turtle'), ('a.n3', 'n3'), ('a.nt', 'nt'), ('a.owl', 'xml'), ('a.rdfs', 'xml'), ('a.jsonld', 'json-ld'), ('noext', 'xml')) v(path, syntax)")
def rdf_formats(spark, sf_dir):
    """The syntax of a file by its name, and for the last by its first characters."""
    names = ("a.ttl", "a.turtle", "a.n3", "a.nt", "a.owl", "a.rdfs", "a.jsonld")
    rows = [(n, rdf.detect_format(n)) for n in names] + [("noext", rdf.detect_format("noext", '<?xml version="1.0"?>'))]
    return spark.createDataFrame(rows, "path string, syntax string")


@query("SELECT * FROM (VALUES ('http://ex.org/d')) v(uri)")
def model_ontology(spark, sf_dir):
    return tb.ontology(_triples(spark))


@query("""SELECT * FROM (VALUES ('Agent', 'Agent', 'Akteur', 'Who buys or sells'), ('Customer', NULL, NULL, NULL), ('Supplier', NULL, NULL, NULL), ('Order', 'Order', NULL, NULL), ('LineItem', NULL, NULL, NULL),
('Part', NULL, NULL, NULL), ('Article', NULL, NULL, NULL), ('Kit', NULL, NULL, NULL), ('Piece', NULL, NULL, NULL), ('Priority', NULL, NULL, NULL)) v(class, en, de, comment)""")
def model_classes(spark, sf_dir):
    """Named classes with labels by language."""
    c = tb.classes(_triples(spark))
    at = lambda m, lang: F.try_element_at(m, F.lit(lang))
    return c.select(local_name("uri").alias("class"), at("label", "en").alias("en"), at("label", "de").alias("de"), at("comment", "en").alias("comment"))


@query("SELECT * FROM (VALUES ('super', 'Customer', 'Agent'), ('super', 'Supplier', 'Agent'), ('equivalent', 'Part', 'Article'), ('disjoint', 'Customer', 'Supplier')) v(kind, class, other)")
def model_class_edges(spark, sf_dir):
    t, out = _triples(spark), None
    for kind, f in (("super", tb.class_super), ("equivalent", tb.class_equiv), ("disjoint", tb.class_disjoint)):
        one = _short(f(t).select(F.lit(kind).alias("kind"), "class", "other"), "class", "other")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT * FROM (VALUES ('Priority', 0, '1-URGENT'), ('Priority', 1, '2-HIGH'), ('Priority', 2, 'low')) v(class, pos, value)")
def model_enumeration(spark, sf_dir):
    """Members by English label, untagged label, or local name."""
    return _short(tb.enum_members(_triples(spark)), "class")


@query("""SELECT * FROM (VALUES ('Order', 0, 'placedBy', 'cardinality', NULL, NULL, 1, NULL, NULL), ('Order', 1, 'hasLine', 'cardinality', 1, NULL, NULL, NULL, NULL), ('Order', 2, 'hasLine', 'allValuesFrom', NULL, NULL, NULL, 'LineItem', NULL),
('LineItem', 3, 'ofPart', 'cardinality', NULL, 3, NULL, NULL, NULL), ('LineItem', 4, 'unit', 'hasValue', NULL, NULL, NULL, NULL, 'piece')) v(class, ord, prop, kind, min, max, exact, filler, value)""")
def model_restrictions(spark, sf_dir):
    """Restrictions that stand alone or in an intersection, one facet each."""
    return _short(tb.restrictions(_triples(spark)).drop("value_dt"), "class", "prop", "filler").withColumn("ord", F.col("ord").cast("int"))


@query("""SELECT * FROM (VALUES ('placedBy', 'object', 'hasOrder', 'Functional', 'placed by'), ('hasOrder', 'object', 'placedBy', 'InverseFunctional', NULL), ('hasLine', 'object', NULL, '', NULL), ('ofPart', 'object', NULL, 'Asymmetric Irreflexive', NULL),
('replaces', 'object', NULL, 'Transitive Symmetric Reflexive', NULL), ('quantity', 'datatype', NULL, 'Functional', NULL), ('unit', 'datatype', NULL, '', NULL)) v(prop, kind, inverse_of, flags, label)""")
def model_properties(spark, sf_dir):
    """Properties with their characteristics and inverses in both directions."""
    p = tb.properties(_triples(spark))
    flags = F.array_join(F.array_compact(F.array(*[F.when(F.col(tb._snake(c)), F.lit(c)) for c in tb.CHARACTERISTICS])), " ")
    return p.select(local_name("uri").alias("prop"), "kind", local_name("inverse_of").alias("inverse_of"), flags.alias("flags"), F.try_element_at("label", F.lit("en")).alias("label"))


@query("""SELECT * FROM (VALUES ('domain', 'placedBy', 'Order'), ('domain', 'hasLine', 'Order'), ('domain', 'ofPart', 'LineItem'), ('domain', 'quantity', 'LineItem'), ('domain', 'unit', 'LineItem'),
('range', 'placedBy', 'Customer'), ('range', 'hasLine', 'LineItem'), ('range', 'quantity', 'double'), ('range', 'unit', 'string')) v(kind, prop, other)""")
def model_property_edges(spark, sf_dir):
    t = _triples(spark)
    both = tb.prop_domain(t).select(F.lit("domain").alias("kind"), "prop", "other").unionByName(tb.prop_range(t).select(F.lit("range").alias("kind"), "prop", "other"))
    return _short(both, "prop", "other")


@query("SELECT * FROM (VALUES ('shop', 'The shop', 'Customer', '4'), ('mill', NULL, 'Agent Supplier', NULL)) v(uri, label, types, rating)")
def model_individuals(spark, sf_dir):
    """Named individuals with all types and the last value of each property."""
    t = _triples(spark)
    types = tb.ind_type(t).groupBy("uri").agg(F.array_join(F.array_sort(F.collect_list(local_name("type"))), " ").alias("types"))
    rating = tb.ind_prop(t).where(F.endswith("prop", F.lit("rating"))).select("uri", F.col("value").alias("rating"))
    rows = tb.individuals(t).join(types, "uri", "left").join(rating, "uri", "left")
    return rows.select(local_name("uri").alias("uri"), F.try_element_at("label", F.lit("en")).alias("label"), "types", "rating")


@query("SELECT * FROM (VALUES ('d', 'owl:versionInfo', '7'), ('d', 'owl:imports', 'http://ex.org/base'), ('d', 'dc:creator', 'Trade desk'), ('Order', 'dc:source', 'orders')) v(subject, key, value)")
def model_annotations(spark, sf_dir):
    """Annotations of the ontology and its classes, with prefixed keys."""
    rows = _short(tb.annotations(_triples(spark)), "subject")
    return rows.where("subject in ('d', 'Order')")


@query("SELECT * FROM (VALUES ('Part', 'union', 'Kit'), ('Part', 'union', 'Piece'), ('Piece', 'complement', 'Kit')) v(class, op, other)")
def model_expressions(spark, sf_dir):
    """Class expressions of named classes."""
    return _short(tb.expressions(_triples(spark)).select("class", "op", "other"), "class", "other")


@query("SELECT * FROM (VALUES ('classes', 10), ('object properties', 5), ('datatype properties', 2), ('individuals', 2)) v(what, n)")
def model_counts(spark, sf_dir):
    return tb.counts(_model(spark)).withColumn("n", F.col("n").cast("int"))


@query("""SELECT * FROM (VALUES ('Agent', '', 0), ('Customer', 'Agent', 1), ('Supplier', 'Agent', 0), ('Order', '', 2), ('LineItem', '', 3), ('Part', '', 0), ('Article', '', 0), ('Kit', '', 0), ('Piece', '', 0), ('Priority', '', 0)) v(name, parent, n_properties)""")
def schema_definitions(spark, sf_dir):
    """Definitions of the compiled ontology without the base object: what they inherit from, and how many properties they have."""
    schema = Engine({"rules": {"thing_with_uri": {"enabled": False}}}).transform(_model(spark))
    made = definitions_table(spark, schema)
    parent = F.coalesce(F.array_join(F.transform(F.from_json(F.get_json_object("schema_json", "$.allOf"), "array<map<string,string>>"), lambda x: F.substring_index(F.try_element_at(x, F.lit("$ref")), "/", -1)), " "), F.lit(""))
    return made.select("name", parent.alias("parent"), "n_properties")


@query("SELECT * FROM (VALUES ('Order', 'hasLine'), ('Order', 'placedBy')) v(class, prop)")
def schema_required(spark, sf_dir):
    """Properties that the compiled ontology requires."""
    schema = Engine({"rules": {"thing_with_uri": {"enabled": False}}}).transform(_model(spark))
    rows = definitions_table(spark, schema).select(F.col("name").alias("class"), F.explode(F.from_json(F.get_json_object("schema_json", "$.required"), "array<string>")).alias("prop"))
    return rows


@query("SELECT * FROM (VALUES ('Train', true), ('Car', false), ('A', true), ('None', false)) v(name, circular)")
def circular_types(spark, sf_dir):
    """Types whose definitions refer to themselves, by the validator's test."""
    ref = lambda n: {"$ref": f"#/definitions/{n}"}
    d = {"Train": {"properties": {"parts": {"type": "array", "items": ref("Train")}}}, "Car": {"properties": {"inside": ref("Train")}}, "A": {"allOf": [ref("B")]}, "B": {"allOf": [ref("A")]}}
    return spark.createDataFrame([(n, jsonschema.is_circular(d, n)) for n in ("Train", "Car", "A", "None")], "name string, circular boolean")


@query("""SELECT * FROM (VALUES ('c1', 'type', 'Up'), ('e1', 'type', 'E2'), ('s1', 'wide', 's2'), ('s1', 'type', 'Dom'), ('s2', 'type', 'Ran'), ('i2', 'back', 'i1'), ('y2', 'sym', 'y1'), ('t1', 'trans', 't3'),
('k1', 'type', 'Some'), ('a2', 'type', 'Fill'), ('h1', 'has', 'red'), ('h2', 'type', 'Has'), ('n1', 'type', 'Both'), ('u1', 'type', 'Any'), ('m1', 'type', 'List'), ('m2', 'type', 'List'), ('n2', 'type', 'L'), ('n2', 'type', 'R')) v(s, p, o)""")
def owl_rules(spark, sf_dir):
    """What each rule of the entailment derives from one or two facts."""
    t = _axioms(
        spark,
        ":Low rdfs:subClassOf :Up . :c1 a :Low . :E1 owl:equivalentClass :E2 . :e1 a :E1 .",
        ":narrow rdfs:subPropertyOf :wide ; rdfs:domain :Dom ; rdfs:range :Ran . :s1 :narrow :s2 .",
        ":fore owl:inverseOf :back . :i1 :fore :i2 . :sym a owl:SymmetricProperty . :y1 :sym :y2 . :trans a owl:TransitiveProperty . :t1 :trans :t2 . :t2 :trans :t3 .",
        ":Some owl:onProperty :q ; owl:someValuesFrom :Kind . :k1 :q :k2 . :k2 a :Kind . :All owl:onProperty :w ; owl:allValuesFrom :Fill . :a1 a :All ; :w :a2 .",
        ":Has owl:onProperty :has ; owl:hasValue :red . :h1 a :Has . :h2 :has :red .",
        ":Both owl:intersectionOf ( :L :R ) . :n1 a :L , :R . :n2 a :Both . :Any owl:unionOf ( :U :V ) . :u1 a :U . :List owl:oneOf ( :m1 :m2 ) .",
    )
    found = closure.owl_rl(t).join(t.select("s", "p", "o").distinct(), ["s", "p", "o"], "left_anti").where("s rlike '#[a-z][0-9]$'")
    return _short(found.select("s", "p", "o").distinct(), "s", "p", "o")


@query("SELECT * FROM (VALUES ('a', 'a'), ('b', 'a'), ('c', 'a'), ('f', 'f'), ('g', 'f'), ('x', 'x'), ('y', 'x')) v(node, root)")
def same_individuals(spark, sf_dir):
    """Individuals that are one: stated, by a functional and an inverse-functional property, by a limit of one."""
    t = _axioms(
        spark,
        ":a owl:sameAs :b . :one a owl:FunctionalProperty . :p :one :b , :c . :id a owl:InverseFunctionalProperty . :f :id :n . :g :id :n .",
        ":Single owl:onProperty :likes ; owl:maxCardinality 1 . :s a :Single ; :likes :x , :y .",
    )
    return _short(closure.same_individuals(t), "node", "root")


@query("""SELECT * FROM (VALUES ('asymmetric_violation', 'a1'), ('complement_violation', 'c1'), ('disjoint_property_violation', 'q1'), ('disjoint_violation', 'd1'), ('disjoint_violation', 'g1'),
('functional_violation', 'f1'), ('irreflexive_violation', 'r1'), ('max_cardinality_violation', 'z1'), ('nothing_instance', 'n1')) v(type, subject)""")
def consistency_checks(spark, sf_dir):
    """One contradiction of each kind, some of them only by entailment."""
    t = _axioms(
        spark,
        ":Low rdfs:subClassOf :Up . :Up owl:disjointWith :Other . :one a owl:FunctionalProperty . :irr a owl:IrreflexiveProperty . :asy a owl:AsymmetricProperty .",
        ":Not owl:complementOf :Up . :p owl:propertyDisjointWith :q . :Zero owl:onProperty :p ; owl:maxCardinality 0 . [] a owl:AllDisjointClasses ; owl:members ( :G1 :G2 :G3 ) .",
    )
    a = _axioms(
        spark,
        ":d1 a owl:NamedIndividual , :Low , :Other . :g1 a owl:NamedIndividual , :G1 , :G3 . :f1 :one :x , :y . :r1 :irr :r1 . :a1 :asy :a2 . :a2 :asy :a1 . :c1 a :Low , :Not . :q1 :p :x ; :q :x . :z1 a :Zero ; :p :y . :n1 a owl:Nothing .",
    )
    return _short(consistency.check(t, a).select("type", "subject"), "subject")


@query("""SELECT * FROM (VALUES ('counts outside 2 to 5', 0), ('functional values twice', 0), ('inverse without its link', 0), ('links to oneself', 0), ('not of the range', 0), ('issues', 0), ('classes', 8), ('same again', 1)) v(what, n)""")
def generated_data(spark, sf_dir):
    """Seeded individuals keep the ontology's promises: what breaks them is counted."""
    t, model = _triples(spark), _model(spark)
    made = settled(Generator(model, BASE, seed=7).generate(2, 5))
    again = Generator(model, BASE, seed=7).generate(2, 5)
    typed = made.where((F.col("p") == v.TYPE) & ~F.col("o").isin(v.NAMED, v.ONTOLOGY)).select("s", "o")
    per_class = settled(typed.groupBy("o").agg(F.count(F.lit(1)).alias("n")))
    p = lambda name: F.col("p") == BASE + name
    links = made.where(F.col("o_kind") == "uri").select("s", "p", "o")
    forth, back = links.where(p("placedBy")).select("s", "o"), links.where(p("hasOrder")).select(F.col("o").alias("s"), F.col("s").alias("o"))
    targets = links.where(p("placedBy")).select(F.col("o").alias("s"))
    wrong = targets.join(typed.where(F.col("o") == BASE + "Customer"), "s", "left_anti")
    counts = {
        "counts outside 2 to 5": per_class.where("n < 2 or n > 5"),
        "functional values twice": made.where(p("quantity") | p("placedBy")).groupBy("s", "p").count().where("count > 1"),
        "inverse without its link": forth.join(back, ["s", "o"], "left_anti").unionByName(back.join(forth, ["s", "o"], "left_anti")),
        "links to oneself": links.where("s = o"), "not of the range": wrong, "issues": consistency.check(t.where("p not like '%label'"), made.where(F.col("s") != BASE.rstrip("#"))), "classes": per_class,
    }
    out = None
    for what, rows in counts.items():
        one = rows.agg(F.count(F.lit(1)).cast("int").alias("n")).select(F.lit(what).alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    same = made.select("s", "p", "o").exceptAll(again.select("s", "p", "o")).agg((F.count(F.lit(1)) == 0).cast("int").alias("n"))
    return out.unionByName(same.select(F.lit("same again").alias("what"), "n"))


@query("SELECT * FROM (VALUES ('a'), ('b'), ('c')) v(node)")
def circular_definitions(spark, sf_dir):
    edges = spark.sql("SELECT * FROM VALUES ('a', 'b'), ('b', 'c'), ('c', 'a'), ('d', 'a'), ('e', 'f') AS t(src, dst)")
    return closure.circular(edges)


@query("SELECT * FROM (VALUES ('placedBy', 'Order'), ('quantity', 'LineItem'), ('hasOrder', 'Customer')) v(prop, domain)")
def property_domain_inference(spark, sf_dir):
    t = _tbox(spark)
    return _short(rules.property_domains(t.properties, t.prop_domain, t.prop_range).select("prop", "domain"), "prop", "domain")


@query("SELECT * FROM (VALUES ('placedBy', 'Customer'), ('hasOrder', 'Order'), ('ofPart', NULL), ('partIn', 'LineItem'), ('quantity', 'double')) v(prop, range)")
def property_range_inference(spark, sf_dir):
    t = _tbox(spark)
    return _short(rules.property_ranges(t.properties, t.prop_domain, t.prop_range, t.restrictions), "prop", "range")


@query("SELECT * FROM (VALUES ('placedBy', true), ('hasOrder', false), ('ofPart', false), ('partIn', false), ('quantity', true)) v(prop, functional)")
def property_functional_inference(spark, sf_dir):
    return _short(rules.property_functional(_tbox(spark).properties), "prop")


@query("SELECT * FROM (VALUES ('ofPart', 'LineItem'), ('hasLine', 'Order')) v(prop, user)")
def property_usage(spark, sf_dir):
    return _short(rules.property_usage(_tbox(spark).restrictions), "prop", "user")


@query("SELECT * FROM (VALUES ('placedBy', 'Order'), ('quantity', 'LineItem'), ('hasOrder', 'Customer')) v(prop, class)")
def property_to_class(spark, sf_dir):
    t = _tbox(spark)
    domains = rules.property_domains(t.properties, t.prop_domain, t.prop_range)
    return _short(rules.property_to_class(domains, t.classes).select("prop", "class"), "prop", "class")


@query("SELECT * FROM (VALUES ('LineItem', 'ofPart', true, CAST(NULL AS INT), 3), ('Order', 'hasLine', true, 1, NULL)) v(class, prop, required, min_items, max_items)")
def restriction_merge(spark, sf_dir):
    m = rules.merged_restrictions(_tbox(spark).restrictions)
    return _short(m.select("class", "prop", "required", "min_items", "max_items"), "class", "prop")


@query("SELECT * FROM (VALUES ('LineItem', 'ofPart', 1, 3)) v(class, prop, min, max)")
def effective_cardinality(spark, sf_dir):
    return _short(rules.effective_cardinality(_tbox(spark).restrictions), "class", "prop")


@query("SELECT * FROM (VALUES ('Customer', 'Agent'), ('Supplier', 'Agent')) v(class, ref)")
def hierarchy_refs(spark, sf_dir):
    """What definitions of the compiled schema inherit from."""
    from graphwright.plans.compile import Engine, definitions_table

    schema = Engine({"rules": {"thing_with_uri": {"enabled": False}}}).transform(_tbox(spark))
    parts = F.from_json(F.get_json_object("schema_json", "$.allOf"), "array<map<string,string>>")
    rows = definitions_table(spark, schema).select(F.col("name").alias("class"), F.explode(parts).alias("x"))
    return rows.select("class", F.substring_index(F.try_element_at("x", F.lit("$ref")), "/", -1).alias("ref")).where("ref is not null")


@query("SELECT * FROM (VALUES ('Agent', 'Customer'), ('Agent', 'Supplier')) v(parent, child)")
def sibling_disjoint_union(spark, sf_dir):
    t = _tbox(spark)
    return rules.disjoint_unions(t.class_super, t.class_disjoint).select("parent", "child")


@query("SELECT * FROM (VALUES ('Customer'), ('Supplier'), ('Order'), ('LineItem'), ('Part'), ('Nation')) v(class)")
def concrete_classes(spark, sf_dir):
    t = _tbox(spark)
    return rules.concrete_classes(t.classes, t.class_super, t.class_disjoint, t.enum_members).select(local_name("uri").alias("class"))


@query("SELECT * FROM (VALUES ('Order', 'placedBy'), ('LineItem', 'quantity'), ('LineItem', 'ofPart')) v(class, prop)")
def applicable_properties(spark, sf_dir):
    t = _tbox(spark)
    return _short(rules.applicable_properties(t.classes, t.class_super, t.prop_domain, t.properties, t.restrictions), "class", "prop")


@query("""SELECT 'h' || head AS head, CAST(pos AS INT) AS pos, member FROM (SELECT i % 3 AS head, i // 3 AS pos, 'm' || i AS member FROM range(300) t(i))""")
def rdf_list_flatten(spark, sf_dir):
    """Three lists of 100 cells each."""
    from graphwright.functions import vocab as v
    from graphwright.operators.tbox import list_members

    cell = lambda x: F.when(x < 3, F.concat(F.lit("h"), x.cast("string"))).otherwise(F.concat(F.lit("c"), x.cast("string")))
    i = F.col("id")
    first = spark.range(300).select(cell(i).alias("s"), F.lit(v.FIRST).alias("p"), F.concat(F.lit("m"), i.cast("string")).alias("o"), F.lit("uri").alias("o_kind"))
    rest = spark.range(300).select(cell(i).alias("s"), F.lit(v.REST).alias("p"), F.when(i < 297, cell(i + 3)).otherwise(v.NIL).alias("o"), F.lit("uri").alias("o_kind"))
    return list_members(first.unionByName(rest)).select("head", "pos", "member")


@query("""WITH placed AS (SELECT * FROM (VALUES ('Order', 'placedBy'), ('LineItem', 'quantity'), ('Customer', 'hasOrder')) v(class, prop)),
restricted AS (SELECT * FROM (VALUES ('LineItem', 'ofPart'), ('Order', 'hasLine')) v(class, prop))
SELECT CAST(7 + 1 AS BIGINT) AS definitions, (SELECT count(*) + 1 FROM (SELECT * FROM placed UNION SELECT * FROM restricted)) AS properties, (SELECT count(*) FROM restricted) AS required""")
def schema_statistics(spark, sf_dir):
    """Statistics of the schema that the vocabulary of the test tables compiles to."""
    from graphwright.plans.compile import Engine, definitions_table, statistics

    schema = Engine().transform(_tbox(spark))
    wanted = statistics(definitions_table(spark, schema)).select("definitions", "properties", "required")
    return wanted.select(*[F.col(c).cast("long").alias(c) for c in wanted.columns])


_REF = '{{"oneOf": [{{"$ref": "#/definitions/{0}"}}, {{"type": "object", "properties": {{"@id": {{"type": "string", "format": "uri"}}}}, "required": ["@id"], "additionalProperties": false}}]}}'


_SCHEMA_ROWS = [
    ("Agent", 0, '{"allOf": [{"$ref": "#/definitions/_Thing"}, {"oneOf": [{"$ref": "#/definitions/Customer"}, {"$ref": "#/definitions/Supplier"}]}], "title": "Agent", "description": "Disjoint union of: Customer, Supplier"}'),
    ("Customer", 1, '{"allOf": [{"$ref": "#/definitions/_Thing"}, {"type": "object", "properties": {"hasOrder": {"type": "array", "items": ' + _REF.format("Order") + '}}, "allOf": [{"$ref": "#/definitions/Agent"}, {"type": "object", "properties": {}}]}], "title": "Customer"}'),
    ("Supplier", 2, '{"allOf": [{"$ref": "#/definitions/_Thing"}, {"type": "object", "properties": {}, "allOf": [{"$ref": "#/definitions/Agent"}, {"type": "object", "properties": {}}]}], "title": "Supplier"}'),
    ("Order", 3, '{"allOf": [{"$ref": "#/definitions/_Thing"}, {"type": "object", "properties": {"hasLine": {"type": "array", "minItems": 1, "items": ' + _REF.format("LineItem") + '}, "placedBy": ' + _REF.format("Customer") + '}, "required": ["hasLine"]}], "title": "Order"}'),
    ("LineItem", 4, '{"allOf": [{"$ref": "#/definitions/_Thing"}, {"type": "object", "properties": {"ofPart": {"type": "array", "maxItems": 3}, "quantity": {"type": "number"}}, "required": ["ofPart"]}], "title": "LineItem"}'),
    ("Part", 5, '{"allOf": [{"$ref": "#/definitions/_Thing"}, {"type": "object", "properties": {}}], "title": "Part"}'),
    ("Nation", 6, '{"allOf": [{"$ref": "#/definitions/_Thing"}, {"type": "object", "properties": {}}], "title": "Nation"}'),
    ("_Thing", 7, '{"type": "object", "properties": {"uri": {"type": "string", "format": "uri", "description": "The URI identifier for this instance"}}, "required": [], "description": "Base object that all classes inherit from", "title": "_Thing"}'),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', {i}, '{text}')" for n, i, text in _SCHEMA_ROWS) + ") v(name, ord, schema_json)")
def compiled_schema(spark, sf_dir):
    """The compiled definitions of the test tables' vocabulary, whole."""
    from graphwright.plans.compile import Engine, definitions_table

    return definitions_table(spark, Engine({"rules": {"disjoint_classes": {"enabled": True}}}).transform(_tbox(spark))).select("name", "ord", "schema_json")
