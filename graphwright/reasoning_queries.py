"""Queries of the reasoner over the test tables: equality, chains, keys, values and groups of disjoint classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwright.functions import vocab as v
from graphwright.operators import closure, consistency, equality
from graphwright.queries import _iri_sql, query
from graphwright.sources.rdf import from_string
from graphwright.sources.relational import BASE, iri, load

_COLUMNS = ["s", "s_kind", "p", "o", "o_kind", "o_datatype"]


def axioms(spark: SparkSession, text: str) -> DataFrame:
    head = f"@prefix : <{BASE}> . @prefix owl: <{v.OWL}> . @prefix rdfs: <{v.RDFS}> . @prefix xsd: <{v.XSD}> .\n"
    return from_string(spark, head + text, "turtle").select(*_COLUMNS)


def _statement(p: str, o: Column, datatype: str | None = None) -> Column:
    kind = "literal" if datatype else "uri"
    return F.struct(F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"), F.lit(v.XSD + datatype if datatype else None).cast("string").alias("o_datatype"))


def statements(df: DataFrame, subject: Column, *made: Column) -> DataFrame:
    """Triples of each row: a subject and its statements, in one pass."""
    rows = df.select(subject.alias("s"), F.explode(F.array(*made)).alias("x"))
    return rows.select("s", F.lit("uri").alias("s_kind"), "x.p", "x.o", "x.o_kind", "x.o_datatype").where("o is not null")


def _type(cls: str) -> Column:
    return _statement(v.TYPE, F.lit(BASE + cls))


_PARTNERS_SQL = "SELECT * FROM customer JOIN supplier ON c_custkey = s_suppkey"


def _partners(spark: SparkSession, sf_dir: str, customer: list[Column], supplier: list[Column], customers: DataFrame | None = None, suppliers: DataFrame | None = None) -> DataFrame:
    """Customers and suppliers whose tax numbers are written differently and have the same value."""
    c, s = customers or load(spark, sf_dir, "customer"), suppliers or load(spark, sf_dir, "supplier")
    own = statements(c, iri("Customer", "c_custkey"), _type("Customer"), _statement(BASE + "taxId", F.col("c_custkey"), "long"), *customer)
    return own.unionByName(statements(s, iri("Supplier", "s_suppkey"), _type("Supplier"), _statement(BASE + "taxId", F.concat(F.lit("+00"), "s_suppkey", F.lit(".0")), "decimal"), *supplier))


@query(f"SELECT {_iri_sql('Customer', 'c_custkey')} AS uri FROM ({_PARTNERS_SQL}) UNION ALL SELECT {_iri_sql('Supplier', 's_suppkey')} FROM ({_PARTNERS_SQL})")
def merged_types(spark, sf_dir):
    """Customers that are suppliers, by an inverse-functional number: only the merged individual is in the intersection."""
    t = axioms(spark, ":taxId a owl:InverseFunctionalProperty . :Partner owl:intersectionOf ( :Customer :Supplier ) .").unionByName(_partners(spark, sf_dir, [], []))
    found = equality.entail(t)
    return found.expanded(found.facts.where((F.col("p") == v.TYPE) & (F.col("o") == BASE + "Partner"))).select(F.col("s").alias("uri"))


_FIRST_SQL = """SELECT o.k AS o, l.k AS l FROM (SELECT o_custkey AS c, min(o_orderkey) AS k FROM orders GROUP BY 1) o JOIN (SELECT l_suppkey AS c, min(l_orderkey) AS k FROM lineitem GROUP BY 1) l USING (c)
JOIN customer ON c = c_custkey JOIN supplier ON c = s_suppkey"""


@query(f"SELECT DISTINCT {_iri_sql('Order', 'o')} AS uri FROM ({_FIRST_SQL}) UNION SELECT {_iri_sql('Shipment', 'l')} FROM ({_FIRST_SQL})")
def merged_in_turn(spark, sf_dir):
    """Orders that are shipments: customers merge with suppliers, and then their first orders with their first shipments."""
    c = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("o")), "c_custkey", "left")
    s = load(spark, sf_dir, "supplier").join(load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.min("l_orderkey").alias("l")), "s_suppkey", "left")
    link = lambda cls, key: _statement(BASE + "firstDeal", F.when(F.col(key).isNotNull(), iri(cls, key)))
    links = _partners(spark, sf_dir, [link("Order", "o")], [link("Shipment", "l")], c, s)
    deals = statements(c.where("o is not null"), iri("Order", "o"), _type("Placed")).unionByName(statements(s.where("l is not null"), iri("Shipment", "l"), _type("Sent")))
    schema = axioms(spark, ":taxId a owl:InverseFunctionalProperty . :firstDeal a owl:FunctionalProperty . :Closed owl:intersectionOf ( :Placed :Sent ) .")
    found = equality.entail(schema.unionByName(links).unionByName(deals))
    return found.expanded(found.facts.where((F.col("p") == v.TYPE) & (F.col("o") == BASE + "Closed"))).select(F.col("s").alias("uri")).distinct()


@query(f"SELECT DISTINCT {_iri_sql('Part', 'l_partkey')} AS s, {_iri_sql('Nation', 'c_nationkey')} AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey")
def chain_sold_in(spark, sf_dir):
    """soldIn as a chain of four properties: from a part to its orders, their customers and these customers' nations."""
    link = lambda d, subject, p, o: statements(d, subject, _statement(BASE + p, o))
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    t = link(lines, iri("Order", "l_orderkey"), "ofPart", iri("Part", "l_partkey"))
    t = t.unionByName(link(load(spark, sf_dir, "orders"), iri("Order", "o_orderkey"), "placedBy", iri("Customer", "o_custkey")))
    t = t.unionByName(link(load(spark, sf_dir, "customer"), iri("Customer", "c_custkey"), "customerNation", iri("Nation", "c_nationkey")))
    schema = axioms(spark, ":inOrder owl:inverseOf :ofPart . :soldIn owl:propertyChainAxiom ( :inOrder :placedBy :customerNation ) .")
    return closure.owl_rl(schema.unionByName(t)).where(F.col("p") == BASE + "soldIn").select("s", "o")


_LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
_LINE_SQL = f"'{BASE}Line_' || " + " || '_' || ".join(_LINE)


@query(f"""WITH n AS (SELECT DISTINCT l_orderkey, l_linenumber, {_LINE_SQL} AS node FROM lineitem)
SELECT node, min(node) OVER w AS root FROM n WINDOW w AS (PARTITION BY l_orderkey, l_linenumber) QUALIFY count(*) OVER w > 1""")
def key_same_lines(spark, sf_dir):
    """Line items that are the same by the key of order and number."""
    t = statements(load(spark, sf_dir, "lineitem"), iri("Line", *_LINE), _type("Line"), _statement(BASE + "inOrder", iri("Order", "l_orderkey")), _statement(BASE + "number", F.col("l_linenumber"), "int"))
    return equality.entail(axioms(spark, ":Line owl:hasKey ( :inOrder :number ) .").unionByName(t)).same


@query(f"SELECT {_iri_sql('Customer', 'c_custkey')} AS subject, 'functional_violation' AS type, CAST(2 AS BIGINT) AS n_values FROM customer WHERE c_acctbal < 0")
def functional_by_value(spark, sf_dir):
    """Balances stated twice in different texts: two values only where the second has lost its sign."""
    balance = F.col("c_acctbal").cast("decimal(14,2)").cast("string")
    again = F.when(F.col("c_acctbal") < 0, F.ltrim(balance, F.lit("-"))).otherwise(F.concat(F.lit("+00"), balance, F.lit("00")))
    t = statements(load(spark, sf_dir, "customer"), iri("Customer", "c_custkey"), _statement(BASE + "balance", balance, "decimal"), _statement(BASE + "balance", again, "decimal"))
    found = consistency.check(axioms(spark, ":balance a owl:FunctionalProperty ."), t, equality=True)
    return found.select("subject", "type", F.size("values").cast("long").alias("n_values"))


@query(f"SELECT {_iri_sql('Event', 'event_id')} AS subject, 'literal_violation' AS type, CAST(CAST(props->>'k' AS BIGINT) - 50 AS VARCHAR) AS text FROM events WHERE CAST(props->>'k' AS BIGINT) < 50 UNION ALL SELECT {_iri_sql('Event', 'event_id')}, 'range_violation', CAST(CAST(props->>'k' AS BIGINT) - 50 AS VARCHAR) FROM events WHERE CAST(props->>'k' AS BIGINT) = 50")
def literal_values(spark, sf_dir):
    """Texts that are no value of their datatype, and values outside the property's range."""
    k = (F.get_json_object("props", "$.k").try_cast("bigint") - 50).cast("string")
    t = statements(load(spark, sf_dir, "events"), iri("Event", "event_id"), _statement(BASE + "k", k, "nonNegativeInteger"))
    found = consistency.check(axioms(spark, ":k rdfs:range xsd:positiveInteger ."), t, reason=False, equality=True)
    return found.select("subject", "type", F.col("values")[0].alias("text"))


_KIND_SQL = f"'{BASE}Kind_' || p_size || '_' || replace(p_type, ' ', '')"
_BRAND_SQL = f"'{BASE}' || replace(p_brand, '#', '')"


@query(f"WITH t AS (SELECT DISTINCT {_KIND_SQL} AS subject, {_BRAND_SQL} AS brand FROM part) SELECT x.subject, x.brand AS a, y.brand AS b FROM t x JOIN t y ON x.subject = y.subject AND x.brand < y.brand")
def disjoint_brands(spark, sf_dir):
    """Kinds of parts that several brands have, all brands being in one list of disjoint classes."""
    p = load(spark, sf_dir, "part")
    kind, brand = iri("Kind", F.col("p_size"), F.replace("p_type", F.lit(" "), F.lit(""))), F.concat(F.lit(BASE), F.replace("p_brand", F.lit("#"), F.lit("")))
    t = statements(p, kind, _statement(v.TYPE, F.lit(v.NAMED)), _statement(v.TYPE, brand))
    brands = p.select(brand.alias("m")).distinct().agg(F.array_sort(F.collect_list("m")).alias("m")).select(F.posexplode("m").alias("i", "m"), F.size("m").alias("n"))  # classes of the ontology
    cell = lambda i: F.concat(F.lit("_:c"), i.cast("string"))
    node = lambda s, p, o: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    first, rest = node(cell(F.col("i")), v.FIRST, F.col("m")), node(cell(F.col("i")), v.REST, F.when(F.col("i") + 1 < F.col("n"), cell(F.col("i") + 1)).otherwise(v.NIL))
    cells = brands.select(F.explode(F.array(first, rest)).alias("x")).select("x.s", "x.p", "x.o")
    head = spark.createDataFrame([("_:g", v.TYPE, v.OWL + "AllDisjointClasses"), ("_:g", v.OWL + "members", "_:c0")], cells.schema)
    listed = cells.unionByName(head).select("s", F.lit("uri").alias("s_kind"), "p", "o", F.lit("uri").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"))
    found = consistency.check(listed, t, reason=False)
    return found.where("type = 'disjoint_violation'").select("subject", F.col("classes")[0].alias("a"), F.col("classes")[1].alias("b"))
