"""Queries of the model's extraction and rules over an ontology that Spark derives from the test tables.

Every part is a class below its brand, with restrictions, disjointness and
equivalence by its key; every supplier gives properties; regions are
enumerations of their nations; customers are individuals.  So the ontology grows
with the tables, and what each operator finds in it is stated in SQL over them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwright.functions import vocab as v
from graphwright.functions.terms import local_name
from graphwright.operators import closure, rules
from graphwright.operators import tbox as tb
from graphwright.plans.compile import Engine
from graphwright.plans.tables import settled
from graphwright.queries import _short, query
from graphwright.sources.relational import BASE, load

_COLUMNS = "s string, s_kind string, p string, o string, o_kind string, o_datatype string, o_lang string, ord long"


def _u(*parts: str | Column) -> Column:
    """An IRI of the catalogue, or with a leading '_:' a blank node."""
    made = F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    return made if isinstance(parts[0], str) and parts[0].startswith("_:") else F.concat(F.lit(BASE), made)


def _row(s: Column, p: str, o: Column | str, at: int, when: Column | None = None, kind: str = "uri", lang: str | None = None, datatype: str | None = None) -> Column:
    """A statement, null where it does not hold; `at` is its place among those of its row."""
    o = F.lit(o) if isinstance(o, str) else o.cast("string")
    row = F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), F.lit(datatype).cast("string").alias("o_datatype"), F.lit(lang).cast("string").alias("o_lang"), F.lit(at).cast("long").alias("at"))
    return row if when is None else F.when(when, row)


def _made(df: DataFrame, first: Column, rows: list[Column]) -> DataFrame:
    t = df.select(first.cast("long").alias("first"), F.explode(F.array_compact(F.array(*rows))).alias("x")).select("first", "x.*")
    kind = lambda c: F.when(F.startswith(c, F.lit("_:")), "bnode").otherwise("uri")
    return t.select("s", kind("s").alias("s_kind"), "p", "o", F.when(F.col("o_kind") == "literal", "literal").otherwise(kind("o")).alias("o_kind"), "o_datatype", "o_lang", (F.col("first") * 100 + F.col("at")).alias("ord"))


def _restriction(k: Column, part: Column, name: str, at: int, when: Column, prop: str, facet: str, value: Column, kind: str = "literal", datatype: str | None = "nonNegativeInteger") -> list[Column]:
    node = _u(f"_:{name}", k)
    return [
        _row(part, v.SUBCLASS, node, at, when), _row(node, v.TYPE, v.RESTRICTION, at + 1, when), _row(node, v.OWL + "onProperty", _u(prop), at + 2, when),
        _row(node, v.OWL + facet, value, at + 3, when, kind, None, v.XSD + datatype if datatype else None),
    ]


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of the ontology; statements of parts come first, by key."""
    k = F.col("p_partkey")
    part, brand = _u("Part_", k), F.concat(F.lit(BASE), F.replace("p_brand", F.lit("#"), F.lit("")))
    pair, left, right, union = _u("Pair_", k), _u("Left_", k), _u("Right_", k), _u("_:u", k)
    literal = {"kind": "literal"}
    parts = [
        _row(part, v.TYPE, v.CLASS, 0), _row(part, v.LABEL, F.col("p_name"), 1, None, "literal", "en"), _row(part, v.COMMENT, F.col("p_type"), 2, k % 2 == 0, **literal), _row(part, v.SUBCLASS, brand, 3),
        *_restriction(k, part, "a", 10, k % 3 == 0, "suppliedBy", "minCardinality", F.when(k % 6 == 0, 2).otherwise(1)),
        *_restriction(k, part, "b", 20, k % 4 == 0, "suppliedBy", "maxCardinality", F.lit(5)),
        *_restriction(k, part, "c", 30, k % 5 == 0, "madeBy", "someValuesFrom", brand, "uri", None),
        *_restriction(k, part, "d", 40, k % 7 == 0, "size", "hasValue", F.col("p_size"), "literal", "integer"),
        _row(part, v.OWL + "disjointWith", _u("Part_", k + 1), 50, k % 11 == 0), _row(part, v.OWL + "equivalentClass", _u("Part_", k + 1), 51, k % 13 == 0),
        _row(part, v.OWL + "equivalentClass", union, 52, k % 17 == 0), _row(union, v.OWL + "unionOf", _u("_:v", k), 53, k % 17 == 0),
        _row(_u("_:v", k), v.FIRST, _u("Part_", k + 1), 54, k % 17 == 0), _row(_u("_:v", k), v.REST, _u("_:w", k), 55, k % 17 == 0),
        _row(_u("_:w", k), v.FIRST, _u("Part_", k + 2), 56, k % 17 == 0), _row(_u("_:w", k), v.REST, v.NIL, 57, k % 17 == 0),
        _row(part, v.DC + "source", F.col("p_brand"), 58, k % 10 == 0, **literal),
        *[_row(x, v.TYPE, v.CLASS, 60 + i, k % 19 == 0) for i, x in enumerate((pair, left, right))],
        _row(left, v.SUBCLASS, pair, 63, k % 19 == 0), _row(right, v.SUBCLASS, pair, 64, k % 19 == 0), _row(left, v.OWL + "disjointWith", right, 65, k % 19 == 0),
    ]
    t = [_made(load(spark, sf_dir, "part"), k, parts)]
    far = lambda n: F.lit(n * 10**14)
    brands = load(spark, sf_dir, "part").select("p_brand").distinct()
    t.append(_made(brands, far(1), [_row(brand, v.TYPE, v.CLASS, 0), _row(brand, v.SUBCLASS, _u("Product"), 1)]))
    k = F.col("s_suppkey")
    sells, sold = _u("sells_", k), _u("soldBy_", k)
    flag = lambda x, name, at, when: _row(x, v.TYPE, f"{v.OWL}{name}Property", at, when)
    suppliers = [
        _row(sells, v.TYPE, v.OBJECT_PROPERTY, 0), _row(sells, v.LABEL, F.col("s_name"), 1, None, "literal", "en"), flag(sells, "Functional", 2, k % 2 == 0), flag(sells, "InverseFunctional", 3, k % 3 == 0),
        flag(sells, "Transitive", 4, k % 5 == 0), _row(sells, v.DOMAIN, _u("Part_", k), 5, (k % 2 == 1) | (k % 18 == 0)), _row(sells, v.RANGE, _u("Part_", k + 1), 6, k % 4 != 0),
        _row(sells, v.OWL + "inverseOf", sold, 7, k % 6 == 0), _row(sold, v.TYPE, v.OBJECT_PROPERTY, 8, k % 6 == 0), _row(sold, v.DOMAIN, _u("Part_", k + 2), 9, k % 12 == 0),
    ]
    t.append(_made(load(spark, sf_dir, "supplier"), far(2) + k, suppliers))
    kinds = load(spark, sf_dir, "events").select("event_type").distinct()
    e = _u(F.col("event_type"))
    t.append(_made(kinds, far(3), [_row(e, v.TYPE, v.DATATYPE_PROPERTY, 0), flag(e, "Functional", 1, F.lit(True)), _row(e, v.DOMAIN, _u("Product"), 2), _row(e, v.RANGE, v.XSD + "double", 3)]))
    n = load(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    lists = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_nationkey")).alias("m")).select("n_regionkey", F.posexplode("m").alias("i", "n_nationkey"), F.size("m").alias("size")).join(n.drop("n_regionkey"), "n_nationkey")
    r, i, nation = F.col("n_regionkey"), F.col("i"), _u("Nation_", F.col("n_nationkey"))
    cell = lambda i: _u("_:n", r, F.lit("_"), i)
    region = [
        _row(_u("Region_", r), v.TYPE, v.CLASS, 0, i == 0), _row(_u("Region_", r), v.SUBCLASS, _u("_:e", r), 1, i == 0), _row(_u("_:e", r), v.OWL + "oneOf", cell(F.lit(0)), 2, i == 0),
        _row(cell(i), v.FIRST, nation, 3), _row(cell(i), v.REST, F.when(i + 1 < F.col("size"), cell(i + 1)).otherwise(v.NIL), 4),
        _row(nation, v.LABEL, F.col("n_name"), 5, F.col("n_nationkey") % 3 == 0, "literal", "en"), _row(nation, v.LABEL, F.col("n_name"), 6, F.col("n_nationkey") % 3 == 1, **literal),
    ]
    t.append(_made(lists, far(4) + r * 1000 + i, region))
    c, who = F.col("c_custkey"), _u("Customer_", F.col("c_custkey"))
    customers = [
        _row(who, v.TYPE, v.NAMED, 0), _row(who, v.TYPE, _u("Customer"), 1), _row(who, v.TYPE, F.concat(F.lit(BASE), F.initcap("c_mktsegment")), 2), _row(who, v.LABEL, F.col("c_name"), 3, None, "literal", "en"),
        _row(who, BASE + "balance", F.lit("none"), 4, **literal), _row(who, BASE + "balance", F.col("c_acctbal"), 5, None, "literal", None, v.XSD + "double"),
    ]
    t.append(_made(load(spark, sf_dir, "customer"), far(5) + c, customers))
    top = load(spark, sf_dir, "part").agg(F.max("p_partkey").alias("k"))
    ontology = F.concat(F.lit("http://ex.org/catalog_"), F.col("k").cast("string"))
    t.append(_made(top, far(6), [_row(ontology, v.TYPE, v.ONTOLOGY, 0), _row(_u("Product"), v.TYPE, v.CLASS, 1), _row(_u("suppliedBy"), v.TYPE, v.OBJECT_PROPERTY, 2)]))
    return settled(reduce(DataFrame.unionByName, t))


_PART = "'Part_' || CAST(p_partkey AS VARCHAR)"
_NEXT = "'Part_' || CAST(p_partkey + 1 AS VARCHAR)"
_BRAND = "replace(p_brand, '#', '')"
_SELLS, _SOLD = "'sells_' || CAST(s_suppkey AS VARCHAR)", "'soldBy_' || CAST(s_suppkey AS VARCHAR)"
_KINDS = "(SELECT DISTINCT event_type FROM events)"
_SIDES = "SELECT p_partkey, side FROM part, (VALUES ('Pair_'), ('Left_'), ('Right_')) v(side) WHERE p_partkey % 19 = 0"
_CLASSES = f"""SELECT {_PART} AS class, p_name AS en, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS comment FROM part UNION ALL SELECT DISTINCT {_BRAND}, NULL, NULL FROM part UNION ALL SELECT 'Product', NULL, NULL
UNION ALL SELECT side || CAST(p_partkey AS VARCHAR), NULL, NULL FROM ({_SIDES}) UNION ALL SELECT DISTINCT 'Region_' || CAST(n_regionkey AS VARCHAR), NULL, NULL FROM nation"""
_SUPER = f"""SELECT {_PART} AS class, {_BRAND} AS other FROM part UNION ALL SELECT DISTINCT {_BRAND}, 'Product' FROM part UNION ALL SELECT side || CAST(p_partkey AS VARCHAR), 'Pair_' || CAST(p_partkey AS VARCHAR) FROM ({_SIDES}) WHERE side <> 'Pair_'"""


@query("SELECT 'http://ex.org/catalog_' || CAST(max(p_partkey) AS VARCHAR) AS uri FROM part")
def model_ontology(spark, sf_dir):
    return tb.ontology(catalog(spark, sf_dir))


@query(_CLASSES)
def model_classes(spark, sf_dir):
    """Named classes with labels by language."""
    c = tb.classes(catalog(spark, sf_dir))
    return c.select(local_name("uri").alias("class"), F.try_element_at("label", F.lit("en")).alias("en"), F.try_element_at("comment", F.lit("default")).alias("comment"))


@query(f"""SELECT 'super' AS kind, class, other FROM ({_SUPER}) UNION ALL SELECT 'equivalent', {_PART}, {_NEXT} FROM part WHERE p_partkey % 13 = 0
UNION ALL SELECT 'disjoint', {_PART}, {_NEXT} FROM part WHERE p_partkey % 11 = 0 UNION ALL SELECT 'disjoint', 'Left_' || CAST(p_partkey AS VARCHAR), 'Right_' || CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 19 = 0""")
def model_class_edges(spark, sf_dir):
    t, out = catalog(spark, sf_dir), None
    for kind, f in (("super", tb.class_super), ("equivalent", tb.class_equiv), ("disjoint", tb.class_disjoint)):
        one = _short(f(t).select(F.lit(kind).alias("kind"), "class", "other"), "class", "other")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT 'Region_' || CAST(n_regionkey AS VARCHAR) AS class, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INT) AS pos, CASE WHEN n_nationkey % 3 = 2 THEN 'Nation_' || CAST(n_nationkey AS VARCHAR) ELSE n_name END AS value FROM nation""")
def model_enumeration(spark, sf_dir):
    """Nations of regions by English label, untagged label, or local name."""
    return _short(tb.enum_members(catalog(spark, sf_dir)), "class")


_RESTRICTIONS = f"""SELECT {_PART} AS class, 'suppliedBy' AS prop, 'cardinality' AS kind, CASE WHEN p_partkey % 6 = 0 THEN 2 ELSE 1 END AS min, CAST(NULL AS INT) AS max, CAST(NULL AS VARCHAR) AS filler, CAST(NULL AS VARCHAR) AS value FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT {_PART}, 'suppliedBy', 'cardinality', NULL, 5, NULL, NULL FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT {_PART}, 'madeBy', 'someValuesFrom', NULL, NULL, {_BRAND}, NULL FROM part WHERE p_partkey % 5 = 0
UNION ALL SELECT {_PART}, 'size', 'hasValue', NULL, NULL, NULL, CAST(p_size AS VARCHAR) FROM part WHERE p_partkey % 7 = 0"""


@query(_RESTRICTIONS)
def model_restrictions(spark, sf_dir):
    """Restrictions of all parts, one facet each."""
    return _short(tb.restrictions(catalog(spark, sf_dir)).select("class", "prop", "kind", "min", "max", "filler", "value"), "class", "prop", "filler")


@query(f"""SELECT {_SELLS} AS prop, 'object' AS kind, CASE WHEN s_suppkey % 6 = 0 THEN {_SOLD} END AS inverse_of, concat_ws(' ', CASE WHEN s_suppkey % 2 = 0 THEN 'Functional' END, CASE WHEN s_suppkey % 3 = 0 THEN 'InverseFunctional' END, CASE WHEN s_suppkey % 5 = 0 THEN 'Transitive' END) AS flags, s_name AS label FROM supplier
UNION ALL SELECT {_SOLD}, 'object', {_SELLS}, '', NULL FROM supplier WHERE s_suppkey % 6 = 0 UNION ALL SELECT event_type, 'datatype', NULL, 'Functional', NULL FROM {_KINDS} UNION ALL SELECT 'suppliedBy', 'object', NULL, '', NULL""")
def model_properties(spark, sf_dir):
    """Properties with their characteristics and inverses in both directions."""
    p = tb.properties(catalog(spark, sf_dir))
    flags = F.array_join(F.array_compact(F.array(*[F.when(F.col(tb._snake(c)), F.lit(c)) for c in tb.CHARACTERISTICS])), " ")
    return p.select(local_name("uri").alias("prop"), "kind", local_name("inverse_of").alias("inverse_of"), flags.alias("flags"), F.try_element_at("label", F.lit("en")).alias("label"))


_DOMAINS = f"""SELECT {_SELLS} AS prop, 'Part_' || CAST(s_suppkey AS VARCHAR) AS domain FROM supplier WHERE s_suppkey % 2 = 1 OR s_suppkey % 18 = 0
UNION ALL SELECT {_SOLD}, 'Part_' || CAST(s_suppkey + 2 AS VARCHAR) FROM supplier WHERE s_suppkey % 12 = 0 UNION ALL SELECT event_type, 'Product' FROM {_KINDS}"""


@query(f"""SELECT 'domain' AS kind, prop, domain AS other FROM ({_DOMAINS}) UNION ALL SELECT 'range', {_SELLS}, 'Part_' || CAST(s_suppkey + 1 AS VARCHAR) FROM supplier WHERE s_suppkey % 4 <> 0 UNION ALL SELECT 'range', event_type, 'double' FROM {_KINDS}""")
def model_property_edges(spark, sf_dir):
    t = catalog(spark, sf_dir)
    both = tb.prop_domain(t).select(F.lit("domain").alias("kind"), "prop", "other").unionByName(tb.prop_range(t).select(F.lit("range").alias("kind"), "prop", "other"))
    return _short(both, "prop", "other")


@query("SELECT 'Customer_' || CAST(c_custkey AS VARCHAR) AS uri, c_name AS label, 'Customer ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS types, CAST(c_acctbal AS VARCHAR) AS balance FROM customer")
def model_individuals(spark, sf_dir):
    """Customers as named individuals with all types and the last value of a property."""
    t = catalog(spark, sf_dir)
    types = tb.ind_type(t).groupBy("uri").agg(F.array_sort(F.collect_list(local_name("type"))).alias("x"))
    types = types.select("uri", F.concat_ws(" ", F.lit("Customer"), F.array_join(F.array_remove("x", "Customer"), " ")).alias("types"))
    balance = tb.ind_prop(t).where(F.col("prop") == BASE + "balance").select("uri", F.col("value").alias("balance"))
    rows = tb.individuals(t).join(types, "uri", "left").join(balance, "uri", "left")
    return rows.select(local_name("uri").alias("uri"), F.try_element_at("label", F.lit("en")).alias("label"), "types", "balance")


@query(f"SELECT {_PART} AS subject, 'dc:source' AS key, p_brand AS value FROM part WHERE p_partkey % 10 = 0")
def model_annotations(spark, sf_dir):
    """Annotations of the parts, with prefixed keys."""
    return _short(tb.annotations(catalog(spark, sf_dir)), "subject").where("subject like 'Part%'")


@query(f"SELECT {_PART} AS class, 'union' AS op, 'Part_' || CAST(p_partkey + i AS VARCHAR) AS other FROM part, (VALUES (1), (2)) v(i) WHERE p_partkey % 17 = 0")
def model_expressions(spark, sf_dir):
    """Class expressions of named classes."""
    return _short(tb.expressions(catalog(spark, sf_dir)).select("class", "op", "other"), "class", "other")


@query(f"""SELECT 'classes' AS what, count(*) AS n FROM ({_CLASSES}) UNION ALL SELECT 'object properties', count(*) + count(*) FILTER (s_suppkey % 6 = 0) + 1 FROM supplier
UNION ALL SELECT 'datatype properties', count(*) FROM {_KINDS} UNION ALL SELECT 'individuals', count(*) FROM customer""")
def model_counts(spark, sf_dir):
    return tb.counts(tb.TBox.of(catalog(spark, sf_dir)))


# --- rules -------------------------------------------------------------------------


_INFERRED = f"{_DOMAINS} UNION ALL SELECT {_SOLD}, 'Part_' || CAST(s_suppkey + 1 AS VARCHAR) FROM supplier WHERE s_suppkey % 6 = 0 AND s_suppkey % 12 <> 0 AND s_suppkey % 4 <> 0"


def _domains(t: DataFrame) -> DataFrame:
    return rules.property_domains(tb.properties(t), tb.prop_domain(t), tb.prop_range(t))


@query(_INFERRED)
def property_domain_inference(spark, sf_dir):
    """Stated domains, else the ranges of the inverse."""
    return _short(_domains(catalog(spark, sf_dir)).select("prop", "domain"), "prop", "domain")


@query(f"""SELECT {_SELLS} AS prop, 'Part_' || CAST(CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey + 1 WHEN s_suppkey % 12 = 0 THEN s_suppkey + 2 END AS VARCHAR) AS range FROM supplier
UNION ALL SELECT {_SOLD}, CASE WHEN s_suppkey % 18 = 0 THEN 'Part_' || CAST(s_suppkey AS VARCHAR) END FROM supplier WHERE s_suppkey % 6 = 0 UNION ALL SELECT event_type, 'double' FROM {_KINDS} UNION ALL SELECT 'suppliedBy', NULL""")
def property_range_inference(spark, sf_dir):
    """Stated ranges, else the inverse's domain."""
    t = catalog(spark, sf_dir)
    return _short(rules.property_ranges(tb.properties(t), tb.prop_domain(t), tb.prop_range(t), tb.restrictions(t)), "prop", "range")


@query(f"SELECT {_SELLS} AS prop, s_suppkey % 2 = 0 AS functional FROM supplier UNION ALL SELECT {_SOLD}, s_suppkey % 3 = 0 FROM supplier WHERE s_suppkey % 6 = 0 UNION ALL SELECT event_type, true FROM {_KINDS} UNION ALL SELECT 'suppliedBy', false")
def property_functional_inference(spark, sf_dir):
    return _short(rules.property_functional(tb.properties(catalog(spark, sf_dir))), "prop")


@query(f"SELECT prop, 'Part_' || CAST(min(k) AS VARCHAR) AS user FROM (SELECT prop, CAST(replace(class, 'Part_', '') AS BIGINT) AS k FROM ({_RESTRICTIONS})) GROUP BY prop")
def property_usage(spark, sf_dir):
    """The first class that restricts each property."""
    return _short(rules.property_usage(tb.restrictions(catalog(spark, sf_dir))), "prop", "user")


@query(f"SELECT prop, domain AS class FROM ({_INFERRED}) WHERE domain = 'Product' OR domain IN (SELECT {_PART} FROM part)")
def property_to_class(spark, sf_dir):
    t = catalog(spark, sf_dir)
    return _short(rules.property_to_class(_domains(t), tb.classes(t)).select("prop", "class"), "prop", "class")


@query(f"""SELECT {_PART} AS class, 'suppliedBy' AS prop, p_partkey % 3 = 0 AS required, CASE WHEN p_partkey % 6 = 0 THEN 2 END AS min_items, CASE WHEN p_partkey % 4 = 0 THEN 5 END AS max_items FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 4 = 0
UNION ALL SELECT {_PART}, 'madeBy', true, 1, NULL FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT {_PART}, 'size', false, NULL, NULL FROM part WHERE p_partkey % 7 = 0""")
def restriction_merge(spark, sf_dir):
    m = rules.merged_restrictions(tb.restrictions(catalog(spark, sf_dir)))
    return _short(m.select("class", "prop", "required", "min_items", "max_items"), "class", "prop")


@query(f"SELECT {_PART} AS class, 'suppliedBy' AS prop, CASE WHEN p_partkey % 6 = 0 THEN 2 WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS min, CASE WHEN p_partkey % 4 = 0 THEN 5 END AS max FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 4 = 0")
def effective_cardinality(spark, sf_dir):
    return _short(rules.effective_cardinality(tb.restrictions(catalog(spark, sf_dir))), "class", "prop")


@query(f"SELECT 'Pair_' || CAST(p_partkey AS VARCHAR) AS parent, side || CAST(p_partkey AS VARCHAR) AS child FROM ({_SIDES}) WHERE side <> 'Pair_'")
def sibling_disjoint_union(spark, sf_dir):
    """Parents whose subclasses are all pairwise disjoint."""
    t = catalog(spark, sf_dir)
    return rules.disjoint_unions(tb.class_super(t), tb.class_disjoint(t)).select("parent", "child")


_ABSTRACT = "SELECT replace(a.p_brand, '#', '') FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 AND a.p_brand = b.p_brand WHERE a.p_partkey % 11 = 0"


@query(f"SELECT class FROM ({_CLASSES}) WHERE class NOT LIKE 'Pair%' AND class NOT LIKE 'Region%' AND class NOT IN ({_ABSTRACT})")
def concrete_classes(spark, sf_dir):
    """Classes that may have individuals: no enumerations, no parents of disjoint classes."""
    t = catalog(spark, sf_dir)
    return rules.concrete_classes(tb.classes(t), tb.class_super(t), tb.class_disjoint(t), tb.enum_members(t)).select(local_name("uri").alias("class"))


@query(f"""SELECT domain AS class, prop FROM ({_DOMAINS}) WHERE domain <> 'Product' AND domain IN (SELECT {_PART} FROM part) UNION ALL SELECT c, event_type FROM {_KINDS}, (SELECT DISTINCT {_BRAND} AS c FROM part UNION ALL SELECT 'Product')
UNION ALL SELECT {_PART}, 'suppliedBy' FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 4 = 0""")
def applicable_properties(spark, sf_dir):
    t = catalog(spark, sf_dir)
    return _short(rules.applicable_properties(tb.classes(t), tb.class_super(t), tb.prop_domain(t), tb.properties(t), tb.restrictions(t)), "class", "prop")


# --- the compiled schema --------------------------------------------------------------


def _definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine({"rules": {"thing_with_uri": {"enabled": False}, "disjoint_classes": {"enabled": True}}}).definitions(tb.TBox.of(catalog(spark, sf_dir)))


@query(_SUPER.replace("AS other", "AS ref"))
def hierarchy_refs(spark, sf_dir):
    """What definitions of the compiled schema inherit from."""
    parts = F.from_json(F.get_json_object("schema_json", "$.allOf"), "array<map<string,string>>")
    rows = _definitions(spark, sf_dir).select(F.col("name").alias("class"), F.explode(parts).alias("x"))
    return rows.select("class", F.substring_index(F.try_element_at("x", F.lit("$ref")), "/", -1).alias("ref")).where("ref is not null")


@query(f"SELECT {_PART} AS class, 'suppliedBy' AS prop FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT {_PART}, 'madeBy' FROM part WHERE p_partkey % 5 = 0")
def schema_required(spark, sf_dir):
    """Properties that the compiled ontology requires."""
    required = F.from_json(F.get_json_object("schema_json", "$.required"), "array<string>")
    return _definitions(spark, sf_dir).select(F.col("name").alias("class"), F.explode(required).alias("prop"))


@query(f"""SELECT class AS name, en AS title, comment AS description, CASE WHEN p_partkey % 6 = 0 THEN '2' END AS min_items, CASE WHEN p_partkey % 4 = 0 THEN '5' END AS max_items, CASE WHEN p_partkey % 7 = 0 THEN CAST(p_size AS VARCHAR) END AS const
FROM ({_CLASSES}) JOIN part ON class = {_PART}""")
def compiled_schema(spark, sf_dir):
    """Definitions of all parts in the compiled schema: titles, descriptions and what their restrictions became."""
    at = lambda path, name: F.get_json_object("schema_json", path).alias(name)
    d = _definitions(spark, sf_dir).where("name like 'Part%'")
    return d.select("name", at("$.title", "title"), at("$.description", "description"), at("$.properties.suppliedBy.minItems", "min_items"), at("$.properties.suppliedBy.maxItems", "max_items"), at("$.properties.size.const", "const"))


# --- lists and circles -------------------------------------------------------------------


@query("SELECT 'h' || CAST(l_orderkey AS VARCHAR) AS head, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS INT) AS pos, 'm' || CAST(l_linenumber AS VARCHAR) AS member FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)")
def rdf_list_flatten(spark, sf_dir):
    """An RDF list for each order, of its lines' numbers."""
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("m")).select("l_orderkey", F.posexplode("m").alias("i", "m"), F.size("m").alias("n"))
    i = F.col("i")
    cell = lambda i: F.when(i == 0, F.concat(F.lit("h"), F.col("l_orderkey").cast("string"))).otherwise(F.concat_ws("_", F.lit("c"), "l_orderkey", i))
    link = lambda p, o: F.struct(cell(i).alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit("uri").alias("o_kind"))
    rows = lines.select(F.explode(F.array(link(v.FIRST, F.concat(F.lit("m"), F.col("m").cast("string"))), link(v.REST, F.when(i + 1 < F.col("n"), cell(i + 1)).otherwise(v.NIL)))).alias("x"))
    return tb.list_members(rows.select("x.*")).select("head", "pos", "member")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey AS a, s_nationkey AS b FROM customer JOIN supplier ON c_custkey = s_suppkey), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT a AS node FROM r WHERE a = b""")
def circular_definitions(spark, sf_dir):
    """Nations on a circle of links from customers' to suppliers' nations."""
    pairs = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "supplier"), F.col("c_custkey") == F.col("s_suppkey"))
    return closure.circular(pairs.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).distinct())
