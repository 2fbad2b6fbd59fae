"""Queries that apply the operators to the test tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwright.functions import terms
from graphwright.operators import closure, consistency, rules
from graphwright.sources.relational import BASE, ENTITIES, iri, load, triplify

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _iri_sql(cls: str, key: str) -> str:
    return f"'{BASE}{cls}_' || CAST({key} AS VARCHAR)"


# --- constraint checks -----------------------------------------------------


@query(f"SELECT {_iri_sql('Part', 'l_partkey')} AS subject, count(DISTINCT l_suppkey) AS n_values FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1")
def functional_violation(spark, sf_dir):
    """suppliedBy as a functional property of parts."""
    found = consistency.functional_violations(load(spark, sf_dir, "lineitem"), ["l_partkey"], "l_suppkey")
    return found.select(iri("Part", "l_partkey").alias("subject"), "n_values")


@query(f"SELECT {_iri_sql('Customer', 'o_custkey')} AS subject, count(DISTINCT o_orderkey) AS n_values FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderkey) > 1")
def inverse_functional_violation(spark, sf_dir):
    """placedBy as inverse-functional: customers with several orders."""
    found = consistency.functional_violations(load(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey")
    return found.select(iri("Customer", "o_custkey").alias("subject"), "n_values")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def composite_key_violation(spark, sf_dir):
    return consistency.cardinality_violations(load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], 1, "n_rows")


@query("""SELECT a.user_id AS user_id, 'error' AS a, 'purchase' AS b FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'error') a
JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase') b USING (user_id)""")
def disjoint_violation(spark, sf_dir):
    """Users typed by their events, purchase and error being disjoint."""
    pairs = spark.sql("SELECT 'purchase' AS a, 'error' AS b")
    return consistency.disjoint_members(load(spark, sf_dir, "events"), pairs, "user_id", "event_type")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def min_cardinality_violation(spark, sf_dir):
    return consistency.missing(load(spark, sf_dir, "orders").select("o_orderkey"), load(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey")


@query("SELECT l_orderkey, count(*) AS n_values FROM lineitem GROUP BY l_orderkey HAVING count(*) > 7")
def max_cardinality_violation(spark, sf_dir):
    return consistency.cardinality_violations(load(spark, sf_dir, "lineitem"), ["l_orderkey"], 7)


_ISSUES_SQL = """SELECT 'functional_violation' AS type, CAST(count(*) AS BIGINT) AS n FROM (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1)
UNION ALL SELECT 'min_cardinality_violation', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'max_cardinality_violation', count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) > 7)
UNION ALL SELECT 'disjoint_violation', count(*) FROM (SELECT user_id FROM events WHERE event_type IN ('error', 'purchase') GROUP BY user_id HAVING count(DISTINCT event_type) = 2)"""


@query(_ISSUES_SQL)
def issue_report(spark, sf_dir):
    """Issues of four checks by type."""
    parts = [functional_violation, min_cardinality_violation, max_cardinality_violation, disjoint_violation]
    out = None
    for f in parts:
        one = f(spark, sf_dir).agg(F.count(F.lit(1)).alias("n")).select(F.lit(f.__name__).alias("type"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# --- validation -------------------------------------------------------------


@query("SELECT o_orderkey AS id, 'lines' AS missing FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON o_orderkey = l_orderkey WHERE l_orderkey IS NULL")
def json_missing_required(spark, sf_dir):
    """Orders as JSON instances that must have lines, through the validator."""
    lines = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_linenumber").alias("lines"))
    o = load(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left")
    bad = _validated(o, "Order", "o_orderkey", ["lines"], {"lines": {"type": "integer"}}, ["lines"]).where("not valid")
    return bad.select(F.col("idx").alias("id"), F.regexp_extract("error", "'(.*)' is a required", 1).alias("missing"))


@query("SELECT o_orderkey AS id, o_orderpriority AS value FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def json_enum_invalid(spark, sf_dir):
    """Orders whose priority is not in the schema's enumeration, through the validator."""
    priority = {"o_orderpriority": {"type": "string", "enum": ["1-URGENT", "2-HIGH"]}}
    bad = _validated(load(spark, sf_dir, "orders"), "Order", "o_orderkey", ["o_orderpriority"], priority).where("not valid and path = 'o_orderpriority'")
    return bad.select(F.col("idx").alias("id"), F.regexp_extract("error", '^"([^"]*)" is not one of', 1).alias("value"))


@query("SELECT c_custkey AS id, c_acctbal AS value FROM customer WHERE c_acctbal < 0")
def json_range_invalid(spark, sf_dir):
    """Customers below the schema's minimum balance, through the validator."""
    bad = _validated(load(spark, sf_dir, "customer"), "Customer", "c_custkey", ["c_acctbal"], {"c_acctbal": {"type": "number", "minimum": 0}}).where("not valid")
    return bad.select(F.col("idx").alias("id"), F.regexp_extract("error", "^(\\S+) is less than", 1).cast("double").alias("value"))


def _validated(df: DataFrame, cls: str, key: str, columns: list[str], properties: dict, required: list[str] | None = None) -> DataFrame:
    """Results of the validator for each row as a JSON object of some columns."""
    from graphwright.operators import jsonschema

    schema = {"definitions": {cls: {"type": "object", "properties": properties, "required": required or []}}}
    rows = df.select(F.lit(cls).alias("type"), iri(cls, key).alias("uri"), F.col(key).cast("long").alias("idx"), F.to_json(F.struct(*columns)).alias("obj"))
    return jsonschema.validate(rows, schema)


@query("""SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (c_acctbal >= 0 AND c_mktsegment <> 'MACHINERY') AS BIGINT) AS validated,
CAST(count(*) FILTER (NOT (c_acctbal >= 0 AND c_mktsegment <> 'MACHINERY')) AS BIGINT) AS errors FROM customer""")
def json_schema_validation(spark, sf_dir):
    """Customers as JSON instances through the draft-07 validator: balances from 0, one segment not in the enumeration."""
    from graphwright.operators import jsonschema

    c = load(spark, sf_dir, "customer")
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"]
    props = {"c_acctbal": {"type": "number", "minimum": 0}, "c_mktsegment": {"type": "string", "enum": segments}}
    schema = {"definitions": {"Customer": {"type": "object", "properties": props, "required": ["c_acctbal"]}}}
    obj = F.to_json(F.struct("c_acctbal", "c_mktsegment")).alias("obj")
    rows = c.select(F.lit("Customer").alias("type"), iri("Customer", "c_custkey").alias("uri"), F.col("c_custkey").alias("idx"), obj)
    return jsonschema.summary(jsonschema.validate(rows, schema)).select("total", "validated", "errors")


@query("""SELECT o_orderstatus AS class, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (o_totalprice > 0 AND o_orderpriority <> '5-LOW') AS BIGINT) AS validated,
CAST(count(*) FILTER (NOT (o_totalprice > 0 AND o_orderpriority <> '5-LOW')) AS BIGINT) AS errors FROM orders GROUP BY o_orderstatus""")
def validation_summary(spark, sf_dir):
    """Orders as instances of a class by status, through the validator, counted by class."""
    from graphwright.operators import jsonschema

    one = {"type": "object", "properties": {"o_totalprice": {"type": "number", "minimum": 0.000001}, "o_orderpriority": {"not": {"const": "5-LOW"}}}}
    o = load(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderstatus").alias("type"), iri("Order", "o_orderkey").alias("uri"), F.col("o_orderkey").alias("idx"), F.to_json(F.struct("o_totalprice", "o_orderpriority")).alias("obj"))
    results = jsonschema.validate(rows, {"definitions": {c: one for c in ("F", "O", "P")}})
    return jsonschema.summary_by_type(results).withColumnRenamed("type", "class")


# --- triples ----------------------------------------------------------------


def _triples_sql(cls: str, table: str, key: str, values: list[tuple[str, str]], links: list[tuple[str, str, str]], kind: str | None) -> str:
    s, t = _iri_sql(cls, key), "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
    parts = [f"SELECT {s} AS s, '{t}' AS p, '{BASE}{cls}' AS o FROM {table}"]
    if kind:
        parts.append(f"SELECT {s}, '{t}', '{BASE}' || replace(replace(upper({kind}[1]) || lower({kind}[2:]), ' ', ''), '-', '') FROM {table}")
    parts += [f"SELECT {s}, '{BASE}{c}', {sql} FROM {table} WHERE {c} IS NOT NULL" for c, sql in values]
    parts += [f"SELECT {s}, '{BASE}{p}', {_iri_sql(target, c)} FROM {table}" for p, target, c in links]
    return " UNION ALL ".join(parts)


_NATION_SQL = _triples_sql("Nation", "nation", "n_nationkey", [("n_name", "n_name")], [("inRegion", "Region", "n_regionkey")], None)
_CUSTOMER_SQL = _triples_sql("Customer", "customer", "c_custkey", [("c_name", "c_name"), ("c_acctbal", "CAST(c_acctbal AS VARCHAR)"), ("c_mktsegment", "c_mktsegment")], [("customerNation", "Nation", "c_nationkey")], "c_mktsegment")


@query(_NATION_SQL)
def triplify_nation(spark, sf_dir):
    return triplify(load(spark, sf_dir, "nation"), ENTITIES["Nation"]).select("s", "p", "o")


@query(_CUSTOMER_SQL)
def triplify_customer(spark, sf_dir):
    """All customer triples."""
    return triplify(load(spark, sf_dir, "customer"), ENTITIES["Customer"]).select("s", "p", "o")


@query(f"SELECT p, CAST(count(*) AS BIGINT) AS n FROM ({_NATION_SQL} UNION ALL {_CUSTOMER_SQL}) GROUP BY p")
def triples_per_predicate(spark, sf_dir):
    return triplify_nation(spark, sf_dir).unionByName(triplify_customer(spark, sf_dir)).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT '<' || s || '> <' || p || '> ' || CASE WHEN p LIKE '%name' OR p LIKE '%segment' THEN '"' || o || '"^^<http://www.w3.org/2001/XMLSchema#string>' WHEN p LIKE '%acctbal' THEN '"' || o || '"^^<http://www.w3.org/2001/XMLSchema#double>' ELSE '<' || o || '>' END || ' .' AS value FROM (""" + _NATION_SQL + " UNION ALL " + _CUSTOMER_SQL + ")")
def ntriples_output(spark, sf_dir):
    """Nations and customers as lines of N-Triples."""
    from graphwright.sources.relational import graph
    from graphwright.sources.sinks import ntriples_lines

    return ntriples_lines(graph(spark, sf_dir, "Nation", "Customer"))


@query(f"""SELECT s, '{{"@id":"' || s || '","@type":["{BASE}Customer","' || (CASE WHEN '{BASE}Customer' < k THEN k ELSE k END) || '"],' || rest AS node FROM (SELECT {_iri_sql('Customer', 'c_custkey')} AS s,
'{BASE}' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS k, c_mktsegment, c_name, c_nationkey, c_acctbal,
'"{BASE}c_acctbal":[{{"@value":"' || CAST(c_acctbal AS VARCHAR) || '","@type":"http://www.w3.org/2001/XMLSchema#double"}}],"{BASE}c_mktsegment":[{{"@value":"' || c_mktsegment || '","@type":"http://www.w3.org/2001/XMLSchema#string"}}],"{BASE}c_name":[{{"@value":"' || c_name
|| '","@type":"http://www.w3.org/2001/XMLSchema#string"}}],"{BASE}customerNation":[{{"@id":"' || {_iri_sql('Nation', 'c_nationkey')} || '"}}]}}' AS rest FROM customer)""")
def jsonld_nodes(spark, sf_dir):
    """JSON-LD objects of all customers."""
    from graphwright.sources.sinks import jsonld_nodes as nodes

    made = nodes(triplify(load(spark, sf_dir, "customer"), ENTITIES["Customer"]))
    # a customer's two types are in the order of their names
    sort = F.regexp_extract("node", '"@type":\\["([^"]*)","([^"]*)"\\]', 1)
    last = F.regexp_extract("node", '"@type":\\["([^"]*)","([^"]*)"\\]', 2)
    first = F.when(F.endswith(sort, F.lit("#Customer")), sort).otherwise(last)
    other = F.when(F.endswith(sort, F.lit("#Customer")), last).otherwise(sort)
    typed = F.concat(F.lit('"@type":["'), first, F.lit('","'), other, F.lit('"]'))
    return made.select("s", F.concat(F.substring_index("node", '"@type":', 1), typed, F.regexp_replace("node", '^.*"@type":\\[[^\\]]*\\]', "")).alias("node"))


@query(f"SELECT type, CAST(count(DISTINCT s) AS BIGINT) AS n FROM (SELECT s, o AS type FROM ({_NATION_SQL} UNION ALL {_CUSTOMER_SQL}) WHERE p LIKE '%#type') GROUP BY type")
def individual_types(spark, sf_dir):
    """Types of named individuals, by the model's extraction."""
    from graphwright.functions import vocab as v
    from graphwright.operators.tbox import ind_type
    from graphwright.sources.relational import graph

    t = _ordered(graph(spark, sf_dir, "Nation", "Customer"))
    named = t.select("s").distinct().select("s", F.lit("uri").alias("s_kind"), F.lit(v.TYPE).alias("p"), F.lit(v.NAMED).alias("o"), F.lit("uri").alias("o_kind"), F.lit(0).cast("long").alias("ord"))
    return ind_type(t.select(*named.columns).unionByName(named)).groupBy("type").agg(F.count_distinct("uri").alias("n"))


def _ordered(t: DataFrame) -> DataFrame:
    """Triples of tables, which have no order of their own, with the columns that readers give."""
    return t.withColumns({"s_kind": F.lit("uri"), "ord": F.xxhash64("s", "p", "o")})


# --- names and literals -------------------------------------------------------


@query("SELECT page_id, CASE WHEN contains(url, '#') THEN split_part(url, '#', -1) WHEN contains(url, '/') THEN split_part(url, '/', -1) ELSE url END AS name FROM pages")
def local_name(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", terms.local_name("url").alias("name"))


@query("SELECT page_id, translate(split_part(split_part(split_part(url, ':', -1), '/', -1), '#', -1), ' -', '__') AS name FROM pages")
def clean_name(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", terms.clean_name("url").alias("name"))


@query("SELECT page_id, split_part(split_part(url, '#', 1), '/', -1) AS name FROM pages")
def document_name(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", terms.document_name("url").alias("name"))


@query(f"""SELECT s, CASE WHEN starts_with(p, '{BASE}') THEN 'd:' || substr(p, {len(BASE) + 1}) ELSE 'rdf:' || split_part(p, '#', -1) END AS short FROM ({_NATION_SQL})""")
def shorten_iri(spark, sf_dir):
    prefixes = spark.createDataFrame([("d", BASE), ("rdf", "http://www.w3.org/1999/02/22-rdf-syntax-ns#")], "prefix string, ns string")
    return terms.shorten(triplify_nation(spark, sf_dir), "p", prefixes, "short").select("s", "short")


@query("""SELECT source, coalesce(max(n) FILTER (lang = 'fr'), max(n) FILTER (lang = 'en')) AS picked
FROM (SELECT source, lang, CAST(max(n_chars) AS VARCHAR) AS n FROM documents GROUP BY source, lang) GROUP BY source""")
def language_pick(spark, sf_dir):
    """A map from language to text of each source; French if there is any, else English."""
    by_lang = load(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.max("n_chars").cast("string").alias("n"))
    maps = by_lang.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("m"))
    return maps.select("source", terms.pick_language("m", "fr").alias("picked"))


@query("SELECT user_id, max_by(value, event_id) AS value FROM events GROUP BY user_id")
def last_value_wins(spark, sf_dir):
    """Of several values of an individual's property the last one counts, by the model's extraction."""
    from graphwright.functions import vocab as v
    from graphwright.operators.tbox import ind_prop

    e = load(spark, sf_dir, "events")
    link = lambda d, p, o, kind, at: d.select(iri("User", "user_id").alias("s"), F.lit("uri").alias("s_kind"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"), at.alias("ord"))
    t = link(e.select("user_id").distinct(), v.TYPE, F.lit(v.NAMED), "uri", F.lit(0).cast("long")).unionByName(link(e, BASE + "value", F.col("value").cast("string"), "literal", F.col("event_id").cast("long")))
    return ind_prop(t).select(F.substring_index("uri", "_", -1).cast("bigint").alias("user_id"), F.col("value").cast("double").alias("value"))


@query("SELECT user_id, min_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def first_matching_type(spark, sf_dir):
    """Users typed by their events in the order of these: the first type with a definition counts."""
    from graphwright.functions import vocab as v
    from graphwright.operators.instances import individuals

    e = load(spark, sf_dir, "events")
    t = e.select(iri("User", "user_id").alias("s"), F.lit("uri").alias("s_kind"), F.lit(v.TYPE).alias("p"), F.concat(F.lit(BASE), "event_type").alias("o"), F.lit("uri").alias("o_kind"), F.col("event_id").cast("long").alias("ord"))
    names = e.select(F.col("event_type").alias("name")).distinct()
    return individuals(t, names, BASE).select(F.substring_index("uri", "_", -1).cast("bigint").alias("user_id"), F.col("type").alias("event_type"))


@query("SELECT p_type AS type, 'http://ex.org/d#Part_' || p_partkey AS uri, CAST(row_number() OVER (PARTITION BY p_type ORDER BY 'http://ex.org/d#Part_' || p_partkey) - 1 AS BIGINT) AS idx FROM part")
def instance_index(spark, sf_dir):
    """Numbers within a type in IRI order."""
    from graphwright.operators.instances import number

    p = load(spark, sf_dir, "part").select(F.col("p_type").alias("type"), iri("Part", "p_partkey").alias("uri"), F.lit("{}").alias("obj"))
    return number(p).select("type", "uri", "idx")


@query("""SELECT * FROM (VALUES ('c_custkey', 'integer'), ('c_name', 'string'), ('c_nationkey', 'integer'), ('c_acctbal', 'number'), ('c_mktsegment', 'string')) v(name, json_type)""")
def xsd_mapping(spark, sf_dir):
    """JSON types of the customer table's columns, through their XSD datatypes."""
    from graphwright.functions.datatypes import fragment_table
    from graphwright.functions.vocab import XSD
    from graphwright.sources.relational import _XSD_OF

    columns = [(n, XSD + _XSD_OF[t]) for n, t in load(spark, sf_dir, "customer").dtypes]
    return spark.createDataFrame(columns, "name string, datatype string").join(fragment_table(spark), "datatype").select("name", "json_type")


@query("SELECT event_id, TRY_CAST(props->>'k' AS BIGINT) AS k FROM events")
def typed_literal(spark, sf_dir):
    """Literals as JSON where the schema asks for an integer."""
    from graphwright.operators.instances import json_value

    text = json_value(F.get_json_object("props", "$.k"), F.lit("literal"), F.lit("integer"))
    return load(spark, sf_dir, "events").select("event_id", text.try_cast("bigint").alias("k"))


@query("SELECT user_id, string_agg(k || ': ' || n, '; ' ORDER BY k) AS text FROM (SELECT user_id, event_type AS k, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def annotations_format(spark, sf_dir):
    n = load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("string").alias("n"))
    maps = n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return maps.select("user_id", terms.format_annotations("m").alias("text"))


# --- entailment ---------------------------------------------------------------


@query("SELECT o_custkey AS s, o_orderkey AS o FROM orders")
def inverse_edges(spark, sf_dir):
    """hasOrder from placedBy and inverseOf, by entailment."""
    found = _entailed(spark, load(spark, sf_dir, "orders"), ("Order", "o_orderkey"), "placedBy", ("Customer", "o_custkey"), ":placedBy owl:inverseOf :hasOrder .")
    number = lambda c: F.substring_index(c, "_", -1).cast("bigint").alias(c)
    return found.where(F.col("p") == BASE + "hasOrder").select(number("s"), number("o"))


def _entailed(spark: SparkSession, rows: DataFrame, subject: tuple[str, str], prop: str, target: tuple[str, str], *axioms: str) -> DataFrame:
    """What owl_rl() makes of one link per row and some axioms."""
    from graphwright.functions import vocab as v
    from graphwright.sources.rdf import from_string

    head = f"@prefix : <{BASE}> . @prefix owl: <{v.OWL}> . @prefix rdfs: <{v.RDFS}> .\n"
    schema = from_string(spark, head + "\n".join(axioms), "turtle").select("s", "s_kind", "p", "o", "o_kind")
    links = rows.select(iri(*subject).alias("s"), F.lit("uri").alias("s_kind"), F.lit(BASE + prop).alias("p"), iri(*target).alias("o"), F.lit("uri").alias("o_kind"))
    return closure.owl_rl(schema.unionByName(links))


@query(f"""SELECT DISTINCT {_iri_sql('Customer', 'o_custkey')} AS uri, 'Customer' AS class FROM orders UNION ALL SELECT DISTINCT {_iri_sql('Order', 'o_orderkey')}, 'Order' FROM orders""")
def domain_range_typing(spark, sf_dir):
    """Types that placedBy's domain and range entail."""
    from graphwright.functions import vocab as v

    found = _entailed(spark, load(spark, sf_dir, "orders"), ("Order", "o_orderkey"), "placedBy", ("Customer", "o_custkey"), ":placedBy rdfs:domain :Order ; rdfs:range :Customer .")
    return found.where(F.col("p") == v.TYPE).select(F.col("s").alias("uri"), terms.local_name("o").alias("class"))


@query("""SELECT a.conv_id, a.turn AS src, b.turn AS dst FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn > b.turn""")
def transitive_closure(spark, sf_dir):
    """repliesTo, from each turn to the one before, closed."""
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn")
    edge = c.join(c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("dst")), ["conv_id", "turn"])
    node = lambda x: F.struct("conv_id", F.col(x).alias("turn"))
    closed = closure.transitive_closure(edge.select(node("turn").alias("src"), node("dst").alias("dst")))
    return closed.select("src.conv_id", F.col("src.turn").alias("src"), F.col("dst.turn").alias("dst"))


@query("SELECT DISTINCT a, b FROM (SELECT c_nationkey AS a, s_nationkey AS b FROM customer, supplier WHERE c_custkey = s_suppkey UNION ALL SELECT s_nationkey, c_nationkey FROM customer, supplier WHERE c_custkey = s_suppkey)")
def symmetric_closure(spark, sf_dir):
    pairs = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "supplier"), F.col("c_custkey") == F.col("s_suppkey"))
    return rules.symmetric(pairs.select(F.col("c_nationkey").alias("class"), F.col("s_nationkey").alias("other")))


@query("SELECT user_id AS s, p, event_id AS o FROM events, (VALUES ('purchase'), ('interaction'), ('contact')) v(p) WHERE event_type = 'purchase'")
def subproperty_closure(spark, sf_dir):
    """purchase as a subproperty of interaction, and that of contact, by entailment."""
    e = load(spark, sf_dir, "events").where("event_type = 'purchase'")
    found = _entailed(spark, e, ("User", "user_id"), "purchase", ("Event", "event_id"), ":purchase rdfs:subPropertyOf :interaction . :interaction rdfs:subPropertyOf :contact .")
    number = lambda c: F.substring_index(c, "_", -1).cast("bigint").alias(c)
    return found.where(F.col("s").rlike("#User_")).select(number("s"), terms.local_name("p").alias("p"), number("o"))


@query("""WITH RECURSIVE e AS (SELECT l_suppkey AS a, min(l_partkey) AS b FROM lineitem GROUP BY l_suppkey), u AS (SELECT a, b + 1000000 AS b FROM e), x AS (SELECT a, b FROM u UNION SELECT b, a FROM u),
r AS (SELECT a AS node, a AS root FROM x UNION SELECT x.b, r.root FROM r JOIN x ON r.node = x.a) SELECT node, min(root) AS root FROM r GROUP BY node""")
def equivalent_groups(spark, sf_dir):
    """Suppliers and their least parts in connected groups."""
    e = load(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.min("l_partkey").alias("p"))
    return closure.equivalence_groups(e.select(F.col("l_suppkey").alias("a"), (F.col("p") + 1000000).alias("b")))


@query("""WITH c AS (SELECT c_custkey, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS k FROM customer)
SELECT type, CAST(count(*) AS BIGINT) AS n FROM (SELECT k AS type FROM c UNION ALL SELECT 'Customer' FROM c UNION ALL SELECT 'Agent' FROM c UNION ALL SELECT 'Supplier' FROM supplier UNION ALL SELECT 'Agent' FROM supplier) GROUP BY type""")
def type_closure(spark, sf_dir):
    """Counts of all types that subclass axioms entail: segments below Customer, Customer and Supplier below Agent."""
    c = load(spark, sf_dir, "customer").select(F.initcap("c_mktsegment").alias("type"))
    base = c.groupBy("type").agg(F.count(F.lit(1)).alias("n")).unionByName(load(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n")).select(F.lit("Supplier").alias("type"), "n"))
    kinds = c.distinct().select(F.col("type").alias("src"), F.lit("Customer").alias("dst"))
    top = spark.sql("SELECT 'Customer' AS src, 'Agent' AS dst UNION ALL SELECT 'Supplier', 'Agent'")
    above = closure.transitive_closure(kinds.unionByName(top))
    up = base.join(above.withColumnRenamed("src", "type"), "type").select(F.col("dst").alias("type"), "n")
    return base.unionByName(up).groupBy("type").agg(F.sum("n").alias("n"))


def _tbox(spark: SparkSession, further: list[tuple[str, str]] = ()):
    """The vocabulary of the test tables, as rows; further classes are pairs of a name and the class above."""
    from graphwright.operators.tbox import CHARACTERISTICS, TBox

    off = (False,) * len(CHARACTERISTICS)
    flags = lambda *on: tuple(c in on for c in CHARACTERISTICS)
    cls = ["Agent", "Customer", "Supplier", "Order", "LineItem", "Part", "Nation"]
    u = lambda x: BASE + x
    return TBox.from_rows(
        spark,
        classes=[(u(c), i, {"en": c}, None) for i, c in enumerate([*cls, *[c for c, _ in further]])],
        class_super=[(u("Customer"), u("Agent"), 0), (u("Supplier"), u("Agent"), 1), *[(u(c), u(up), i) for i, (c, up) in enumerate(further, 2)]],
        class_disjoint=[(u("Customer"), u("Supplier"), 0)],
        properties=[
            (u("placedBy"), 0, "object", None, None, u("hasOrder"), *flags("Functional")),
            (u("hasOrder"), 1, "object", None, None, u("placedBy"), *flags("InverseFunctional")),
            (u("ofPart"), 2, "object", None, None, None, *off), (u("partIn"), 3, "object", None, None, u("ofPart"), *off),
            (u("quantity"), 4, "datatype", None, None, None, *flags("Functional")),
        ],
        prop_domain=[(u("placedBy"), u("Order"), 0), (u("quantity"), u("LineItem"), 1)],
        prop_range=[(u("placedBy"), u("Customer"), 0), (u("quantity"), "http://www.w3.org/2001/XMLSchema#double", 1)],
        restrictions=[
            (u("LineItem"), 0, u("ofPart"), "cardinality", 1, None, None, None, None, None), (u("LineItem"), 1, u("ofPart"), "cardinality", None, 3, None, None, None, None),
            (u("Order"), 2, u("hasLine"), "someValuesFrom", None, None, None, u("LineItem"), None, None),
        ],
    )


def _short(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[terms.local_name(n).alias(n) if n in names else n for n in df.columns])


@query("SELECT c_mktsegment AS value, CAST(row_number() OVER (ORDER BY c_mktsegment) - 1 AS INT) AS pos FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def enum_members(spark, sf_dir):
    """Segments as the labelled members of an enumeration's RDF list, by the model's extraction."""
    from graphwright.functions import vocab as v
    from graphwright.operators.tbox import enum_members as members

    values = load(spark, sf_dir, "customer").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("x")).select(F.posexplode("x").alias("i", "value"), F.size("x").alias("n"))
    cell = lambda i: F.concat(F.lit("_:c"), i.cast("string"))
    node = lambda s, p, o, kind: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"))
    member, i = F.concat(F.lit(BASE + "m"), F.col("i").cast("string")), F.col("i")
    rest = F.when(i + 1 < F.col("n"), cell(i + 1)).otherwise(v.NIL)
    rows = values.select(F.explode(F.array(node(cell(i), v.FIRST, member, "uri"), node(cell(i), v.REST, rest, "bnode"), node(member, v.LABEL, F.col("value"), "literal"))).alias("x")).select("x.*")
    head = spark.createDataFrame([(BASE + "Segment", v.TYPE, v.CLASS, "uri"), (BASE + "Segment", v.SUBCLASS, "_:e", "bnode"), ("_:e", v.OWL + "oneOf", "_:c0", "bnode")], rows.schema)
    t = rows.unionByName(head).withColumns({"s_kind": F.when(F.startswith("s", F.lit("_:")), "bnode").otherwise("uri"), "o_lang": F.lit(None).cast("string"), "ord": F.xxhash64("s", "p")})
    return members(t).select("pos", "value")


# --- instances --------------------------------------------------------------------


@query("""SELECT 'http://ex.org/d#Nation_' || n_nationkey AS uri, '{"uri":"http://ex.org/d#Nation_' || n_nationkey || '","inRegion":{"@id":"http://ex.org/d#Region_' || n_regionkey || '"},"n_name":["' || n_name || '"]}' AS obj FROM nation""")
def instances_reference(spark, sf_dir):
    """Nations as JSON objects with references to regions."""
    return _nations(spark, sf_dir, "reference").where("type = 'Nation'").select("uri", "obj")


@query("""SELECT 'http://ex.org/d#Nation_' || n_nationkey AS uri, '{"uri":"http://ex.org/d#Nation_' || n_nationkey || '","inRegion":{"uri":"http://ex.org/d#Region_' || n_regionkey || '","r_name":["' || r_name || '"]},"n_name":["' || n_name || '"]}' AS obj FROM nation JOIN region ON n_regionkey = r_regionkey""")
def instances_inline(spark, sf_dir):
    """Nations as JSON objects with their regions inside."""
    return _nations(spark, sf_dir, "inline").where("type = 'Nation'").select("uri", "obj")


def _nations(spark: SparkSession, sf_dir: str, style: str) -> DataFrame:
    from graphwright.functions.datatypes import object_reference
    from graphwright.operators.instances import convert
    from graphwright.sources.relational import graph

    many = {"type": "array", "items": {"type": "string"}}
    schema = {"definitions": {"Nation": {"type": "object", "properties": {"n_name": many, "inRegion": object_reference("Region")}}, "Region": {"type": "object", "properties": {"r_name": many}}}}
    t = _ordered(graph(spark, sf_dir, "Nation", "Region"))
    return convert(t, schema, BASE, style)


@query("""SELECT 'http://ex.org/d#Order_' || o_orderkey AS uri, '{"uri":"http://ex.org/d#Order_' || o_orderkey || '","o_orderpriority":["' || o_orderpriority || '"],"placedBy":{"@id":"http://ex.org/d#Customer_' || o_custkey || '"}}' AS obj FROM orders
UNION ALL SELECT 'http://ex.org/d#Customer_' || c_custkey, '{"uri":"http://ex.org/d#Customer_' || c_custkey || '","c_name":["' || c_name || '"],"customerNation":{"@id":"http://ex.org/d#Nation_' || c_nationkey || '"}}' FROM customer
UNION ALL SELECT 'http://ex.org/d#Nation_' || n_nationkey, '{"uri":"http://ex.org/d#Nation_' || n_nationkey || '","n_name":["' || n_name || '"]}' FROM nation""")
def instances_reference_orders(spark, sf_dir):
    """All orders, customers and nations as JSON objects with references to each other."""
    return _orders(spark, sf_dir, "reference").select("uri", "obj")


@query("""SELECT 'http://ex.org/d#Order_' || o_orderkey AS uri, '{"uri":"http://ex.org/d#Order_' || o_orderkey || '","o_orderpriority":["' || o_orderpriority || '"],"placedBy":{"uri":"http://ex.org/d#Customer_' || c_custkey || '","c_name":["' || c_name || '"],"customerNation":{"uri":"http://ex.org/d#Nation_' || n_nationkey || '","n_name":["' || n_name || '"]}}}' AS obj
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def instances_inline_orders(spark, sf_dir):
    """All orders as JSON objects with their customers inside, and the nations inside those."""
    return _orders(spark, sf_dir, "inline").where("type = 'Order'").select("uri", "obj")


def _orders(spark: SparkSession, sf_dir: str, style: str) -> DataFrame:
    from graphwright.functions.datatypes import object_reference
    from graphwright.operators.instances import convert
    from graphwright.sources.relational import graph

    many = {"type": "array", "items": {"type": "string"}}
    properties = {"Order": {"o_orderpriority": many, "placedBy": object_reference("Customer")}, "Customer": {"c_name": many, "customerNation": object_reference("Nation")}, "Nation": {"n_name": many}}
    schema = {"definitions": {name: {"type": "object", "properties": p} for name, p in properties.items()}}
    t = _ordered(graph(spark, sf_dir, "Order", "Customer", "Nation"))
    return convert(t, schema, BASE, style)


@query("SELECT l_partkey AS subject, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS n_values, min(l_suppkey) AS first_value FROM lineitem GROUP BY l_partkey")
def instances_multi_value(spark, sf_dir):
    """Parts as JSON objects with all their suppliers in an array: how many there are, and the first."""
    from graphwright.functions import vocab as v
    from graphwright.functions.datatypes import object_reference
    from graphwright.operators.instances import convert

    pairs = load(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    link = lambda d, p, o, at: d.select(iri("Part", "l_partkey").alias("s"), F.lit("uri").alias("s_kind"), F.lit(p).alias("p"), o.alias("o"), F.lit("uri").alias("o_kind"), at.cast("long").alias("ord"))
    t = link(pairs.select("l_partkey").distinct(), v.TYPE, F.lit(BASE + "Part"), F.lit(0)).unionByName(link(pairs, BASE + "suppliedBy", iri("Supplier", "l_suppkey"), F.col("l_suppkey")))
    schema = {"definitions": {"Part": {"type": "object", "properties": {"suppliedBy": {"type": "array", "items": object_reference("Supplier")}}}}}
    refs = F.from_json(F.get_json_object("obj", "$.suppliedBy"), "array<map<string,string>>")
    number = lambda c: F.substring_index(c, "_", -1).cast("bigint")
    made = convert(t, schema, BASE).select("uri", refs.alias("refs"))
    return made.select(number("uri").alias("subject"), F.size("refs").cast("long").alias("n_values"), number(F.col("refs")[0]["@id"]).alias("first_value"))


@query("SELECT DISTINCT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.08)")
def unused_targets(spark, sf_dir):
    """Suppliers that no large, reduced line links to."""
    used = load(spark, sf_dir, "lineitem").where("l_quantity > 49 AND l_discount > 0.08").select(F.col("l_suppkey").alias("o"))
    return rules.unused_targets(load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("target")), used).select(F.col("target").alias("s_suppkey"))


@query("SELECT DISTINCT nation, customer_or_supplier FROM (SELECT c_nationkey AS nation, 'customer' AS customer_or_supplier FROM customer UNION ALL SELECT s_nationkey, 'supplier' FROM supplier)")
def range_union(spark, sf_dir):
    """Nations that properties with the ranges customer and supplier, stated or by a subclass, may link to."""
    who = lambda table, key, cls: load(spark, sf_dir, table).select(F.col(key).alias("uri"), F.lit(cls).alias("type")).distinct()
    types = who("customer", "c_nationkey", "buyer").unionByName(who("supplier", "s_nationkey", "seller"))
    ranges = spark.sql("SELECT * FROM VALUES ('customer', 'Customer'), ('supplier', 'seller') AS t(prop, range)")
    below = spark.sql("SELECT 'buyer' AS class, 'Customer' AS other")
    return rules.range_targets(ranges, below, types).select(F.col("target").alias("nation"), F.col("prop").alias("customer_or_supplier"))


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def domain_intersect(spark, sf_dir):
    """Nations in the intersection of two classes, by entailment."""
    from graphwright.functions import vocab as v
    from graphwright.sources.rdf import from_string

    axioms = from_string(spark, f"@prefix : <{BASE}> . @prefix owl: <{v.OWL}> . :Both owl:intersectionOf ( :Buying :Selling ) .", "turtle").select("s", "s_kind", "p", "o", "o_kind")
    typed = lambda table, key, cls: load(spark, sf_dir, table).select(iri("Nation", key).alias("s"), F.lit("uri").alias("s_kind"), F.lit(v.TYPE).alias("p"), F.lit(BASE + cls).alias("o"), F.lit("uri").alias("o_kind")).distinct()
    found = closure.owl_rl(axioms.unionByName(typed("customer", "c_nationkey", "Buying")).unionByName(typed("supplier", "s_nationkey", "Selling")))
    return found.where((F.col("p") == v.TYPE) & (F.col("o") == BASE + "Both")).select(F.substring_index("s", "_", -1).cast("bigint").alias("nation"))


@query("SELECT l_orderkey, l_partkey FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) <= 2")
def sample_targets(spark, sf_dir):
    """Two targets of each source, the least ones."""
    return rules.sample_targets(load(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", 2)


@query()
def generate_individuals(spark, sf_dir):
    """Seeded synthetic individuals of the vocabulary, in which the tables' segments and brands are classes."""
    from graphwright.operators.generate import Generator

    named = lambda table, c, up: load(spark, sf_dir, table).select(F.initcap(F.regexp_replace(c, "[^A-Za-z0-9]", "")).alias("c"), F.lit(up).alias("up")).distinct()
    further = named("customer", "c_mktsegment", "Customer").unionByName(named("part", "p_brand", "Part")).orderBy("c")
    classes = [tuple(r) for r in further.collect()]  # classes of the vocabulary
    return Generator(_tbox(spark, classes), BASE, seed=7).generate(2, 5).select("s", "p", "o", "o_kind")


from graphwright import catalog_queries, instance_queries, model_queries, reasoning_queries, source_queries  # noqa: E402, F401 - register their queries
