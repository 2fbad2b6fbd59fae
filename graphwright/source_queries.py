"""Queries of readers and writers over graphs that Spark makes of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwright.functions import vocab as v
from graphwright.plans.tables import Parts
from graphwright.queries import _CUSTOMER_SQL, _iri_sql, _triples_sql, query
from graphwright.sources import rdf, sinks
from graphwright.sources.relational import BASE, ENTITIES, graph, load, triplify

_ORDERS_SQL = _triples_sql(
    "Order", "orders", "o_orderkey",
    [("o_orderstatus", "o_orderstatus"), ("o_totalprice", "CAST(o_totalprice AS VARCHAR)"), ("o_orderpriority", "o_orderpriority")], [("placedBy", "Customer", "o_custkey")], None,
)
#: Documents that one task parses.
DOCUMENTS = 10_000
_PREFIXES = {"rdf": v.RDF, "xsd": v.XSD, "d": BASE}


def _folder(spark: SparkSession) -> str:
    """A new path in the shared folder, removed at the end."""
    parts = Parts()
    parts.add(spark.range(0))
    return parts.paths[0] + "/out"


@query(_ORDERS_SQL)
def turtle_written(spark, sf_dir):
    """All orders written as Turtle in parts and read again, in blocks of 256 KB."""
    path = _folder(spark)
    sinks.write_parts(triplify(load(spark, sf_dir, "orders"), ENTITIES["Order"]), path, "turtle", _PREFIXES)
    return rdf.read_rdf(spark, path, "turtle", split=True, block="256k").select("s", "p", "o")


@query(_ORDERS_SQL)
def rdfxml_written(spark, sf_dir):
    """All orders written as RDF/XML in parts and read again."""
    path = _folder(spark)
    sinks.write_parts(triplify(load(spark, sf_dir, "orders"), ENTITIES["Order"]), path, "xml", _PREFIXES)
    return rdf.read_rdf(spark, path, "xml").select("s", "p", "o")


@query(f"SELECT CAST(doc_id AS BIGINT) AS doc_id, md5(text) AS digest FROM documents WHERE text IS NOT NULL")
def turtle_long_texts(spark, sf_dir):
    """Whole texts as long strings of many lines, in Turtle that is read in blocks of 64 KB: blocks begin within strings."""
    d = load(spark, sf_dir, "documents").where("text is not null")
    text = F.col("text")
    for raw, code in (("\\", "\\\\"), ('"', '\\"'), ("\r", "\\r")):
        text = F.replace(text, F.lit(raw), F.lit(code))
    line = F.concat(F.lit("d:Document_"), F.col("doc_id").cast("string"), F.lit(' d:text\n  """'), text, F.lit('""" ;\n  a d:Document .'))
    path = _folder(spark)
    d.select(F.concat(F.when(F.col("doc_id") % 7 == 0, F.lit(f"PREFIX d: <{BASE}>\n")).otherwise(f"@prefix d: <{BASE}> . "), line).alias("value")).where("doc_id is not null").write.text(path)
    t = rdf.read_rdf(spark, path, "turtle", split=True, block="64k")
    return t.where(F.col("p") == BASE + "text").select(F.substring_index("s", "_", -1).cast("bigint").alias("doc_id"), F.md5(F.encode("o", "UTF-8")).alias("digest"))


@query(f"SELECT {_iri_sql('Customer', 'c_custkey')} AS s, CAST(c_acctbal AS VARCHAR) AS o FROM customer")
def rdf_pushdown(spark, sf_dir):
    """One predicate of customers and nations by the data source, which parses no line that has another one."""
    path = _folder(spark)
    sinks.write_ntriples(graph(spark, sf_dir, "Customer", "Nation"), path)
    spark.dataSource.register(rdf.RdfSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    local = path.removeprefix("file://").removeprefix("file:")
    t = spark.read.format("rdf").option("path", f"{local}/part-*").option("syntax", "nt").option("pushdown", "true").option("rangebytes", "65536").load()
    return t.where((F.col("p") == BASE + "c_acctbal") & (F.col("o_kind") == "literal")).select("s", "o")


@query(_CUSTOMER_SQL)
def parse_rdf_rows(spark, sf_dir):
    """A Turtle document for each customer, parsed in SQL by the table function."""
    c = load(spark, sf_dir, "customer")
    q = lambda x: F.concat(F.lit('"'), F.col(x).cast("string"), F.lit('"'))
    kind = F.translate(F.initcap("c_mktsegment"), " -", "")
    text = F.concat(
        F.lit(f"@prefix : <{BASE}> . :Customer_"), F.col("c_custkey").cast("string"), F.lit(" a :Customer , :"), kind, F.lit(" ; :c_name "), q("c_name"), F.lit(" ; :c_acctbal "), q("c_acctbal"),
        F.lit(" ; :c_mktsegment "), q("c_mktsegment"), F.lit(" ; :customerNation :Nation_"), F.col("c_nationkey").cast("string"), F.lit(" ."),
    )
    spark.udtf.register("parse_rdf", rdf.parse_rdf_table())
    # a small file is one task, but parsing it is not
    c = c.repartition(max(1, -(-c.count() // DOCUMENTS)))
    c.select(text.alias("text")).createOrReplaceTempView("customer_documents")
    return spark.sql("SELECT t.s, t.p, t.o FROM customer_documents, LATERAL parse_rdf(text, 'turtle', '') t")


@query(_ORDERS_SQL)
def rdf_source_written(spark, sf_dir):
    """All orders written by the data source, a Turtle document for each range of subjects, and read by it."""
    path = _folder(spark).removeprefix("file://").removeprefix("file:")
    spark.dataSource.register(rdf.RdfSource)
    t: DataFrame = sinks.by_subject(triplify(load(spark, sf_dir, "orders"), ENTITIES["Order"]))
    t.write.format("rdf").mode("overwrite").option("path", path).option("syntax", "turtle").option("prefixes", " ".join(f"{k}={x}" for k, x in _PREFIXES.items())).save()
    return spark.read.format("rdf").option("path", f"{path}/part-*").load().select("s", "p", "o")
