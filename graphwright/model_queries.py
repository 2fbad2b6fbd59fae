"""Queries that write and read graphs of the test tables, convert, validate and check them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwright.functions import vocab as v
from graphwright.functions.terms import local_name
from graphwright.operators import consistency, instances, rules
from graphwright.plans.tables import Parts
from graphwright.queries import _iri_sql, query
from graphwright.sources import rdf, sinks
from graphwright.sources.relational import BASE, ENTITIES, iri, load, triplify


def _short(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[local_name(n).alias(n) if n in names else n for n in df.columns])


def _axioms(spark: SparkSession, *lines: str) -> DataFrame:
    """Triples of Turtle statements."""
    head = f"@prefix : <{BASE}> . @prefix owl: <{v.OWL}> . @prefix rdfs: <{v.RDFS}> . @prefix xsd: <{v.XSD}> .\n"
    return rdf.from_string(spark, head + "\n".join(lines), "turtle")


# --- reading and writing ------------------------------------------------------


@query("SELECT CAST(doc_id AS BIGINT) AS doc_id, md5(text) AS digest FROM documents WHERE text IS NOT NULL")
def ntriples_roundtrip(spark, sf_dir):
    """Whole texts as literals, written as N-Triples and read again."""
    d = load(spark, sf_dir, "documents").where("text is not null")
    t = d.select(iri("Document", "doc_id").alias("s"), F.lit(BASE + "text").alias("p"), F.col("text").alias("o"), F.lit("literal").alias("o_kind"))
    parts = Parts()
    parts.add(spark.range(0))
    sinks.write_ntriples(t, parts.paths[0])
    back = rdf.read_ntriples(spark, parts.paths[0])
    return back.select(F.substring_index("s", "_", -1).cast("bigint").alias("doc_id"), F.md5(F.encode("o", "UTF-8")).alias("digest"))


# --- conversion and validation ---------------------------------------------------------


@query(f"""SELECT * FROM (SELECT o_orderkey AS id, o_orderstatus IN ('F', 'O') AND o_totalprice >= 1000 AS valid FROM orders)""")
def convert_and_validate(spark, sf_dir):
    """All orders from triples to JSON objects and through the validator, in one call."""
    state = {"type": "array", "items": {"type": "string", "enum": ["F", "O"]}}
    total = {"type": "number", "minimum": 1000}
    schema = {"definitions": {"Order": {"type": "object", "properties": {"o_orderstatus": state, "o_totalprice": total}, "required": ["o_totalprice"]}}}
    t = triplify(load(spark, sf_dir, "orders"), ENTITIES["Order"]).withColumns({"s_kind": F.lit("uri"), "ord": F.xxhash64("s", "p", "o")})
    _, results = instances.convert_and_validate(t, schema, BASE)
    return results.select(F.substring_index("uri", "_", -1).cast("bigint").alias("id"), "valid")


# --- entailment and contradictions ------------------------------------------------------


@query(f"""WITH u AS (SELECT CAST(user_id AS VARCHAR) AS k, event_type AS c FROM events), d AS (SELECT 'disjoint_violation' AS type, '{BASE}Customer_' || k AS subject FROM u WHERE c IN ('purchase', 'error') GROUP BY k HAVING count(DISTINCT c) = 2)
SELECT type, subject FROM d""")
def contradictions(spark, sf_dir):
    """Users of both disjoint event classes, by the whole check with entailment: classes are those of the events that name the user."""
    axioms = _axioms(spark, ":purchase rdfs:subClassOf :Good . :error rdfs:subClassOf :Bad . :purchase owl:disjointWith :error .")
    users = load(spark, sf_dir, "events").select(iri("Customer", "user_id").alias("s"), F.concat(F.lit(BASE), "event_type").alias("c")).distinct()
    rows = users.select("s", F.explode(F.array("c", F.lit(v.NAMED))).alias("o"))
    a = rows.select("s", F.lit("uri").alias("s_kind"), F.lit(v.TYPE).alias("p"), "o", F.lit("uri").alias("o_kind"))
    return consistency.check(axioms, a).select("type", "subject")


# --- data that the ontology allows ---------------------------------------------------------


@query(f"""SELECT 'trades' AS prop, {_iri_sql('Customer', 'c_custkey')} AS target FROM customer UNION ALL SELECT 'trades', {_iri_sql('Supplier', 's_suppkey')} FROM supplier UNION ALL SELECT 'sells', {_iri_sql('Supplier', 's_suppkey')} FROM supplier""")
def range_targets(spark, sf_dir):
    """Individuals that a property may link to: of its range or a direct subclass."""
    e = lambda rows: spark.createDataFrame(rows, "class string, other string")
    ranges = spark.createDataFrame([("trades", "Agent"), ("sells", "Supplier")], "prop string, range string")
    who = lambda cls, table, key: load(spark, sf_dir, table).select(iri(cls, key).alias("uri"), F.lit(cls).alias("type"))
    return rules.range_targets(ranges, e([("Customer", "Agent"), ("Supplier", "Agent")]), who("Customer", "customer", "c_custkey").unionByName(who("Supplier", "supplier", "s_suppkey")))
