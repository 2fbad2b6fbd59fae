"""Queries of the conversion to JSON over the test tables: objects within objects, circles, further IRIs of properties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphwright.functions.datatypes import object_reference
from graphwright.operators import instances
from graphwright.queries import _iri_sql, query
from graphwright.reasoning_queries import _statement, _type, statements
from graphwright.sources.relational import BASE, iri, load

_MANY = {"type": "array", "items": {"type": "string"}}


def _schema(**properties: dict) -> dict:
    return {"definitions": {name: {"type": "object", "properties": p} for name, p in properties.items()}}


def _ordered(t: DataFrame) -> DataFrame:
    return t.withColumn("ord", F.xxhash64("s", "p", "o"))


_TURN_SQL = f"'{{\"uri\":\"{BASE}Turn_' || c.conv_id || '_' || c.turn || '\"'"


@query(f"""WITH RECURSIVE r AS (SELECT c.conv_id, c.turn, {_TURN_SQL} || ',"role":["' || c.role || '"]}}' AS obj FROM conversations c WHERE c.turn = 0
UNION ALL SELECT c.conv_id, c.turn, {_TURN_SQL} || ',"repliesTo":' || r.obj || ',"role":["' || c.role || '"]}}' FROM conversations c JOIN r ON c.conv_id = r.conv_id AND c.turn = r.turn + 1)
SELECT '{BASE}Turn_' || conv_id || '_' || turn AS uri, obj FROM r""")
def inline_turns(spark, sf_dir):
    """Turns with the turn that they reply to inside, and so on down to the first."""
    before = F.when(F.col("turn") > 0, iri("Turn", F.col("conv_id"), F.col("turn") - 1))
    t = statements(load(spark, sf_dir, "conversations"), iri("Turn", "conv_id", "turn"), _type("Turn"), _statement(BASE + "role", F.col("role"), "string"), _statement(BASE + "repliesTo", before))
    return instances.convert(_ordered(t), _schema(Turn={"role": _MANY, "repliesTo": object_reference("Turn")}), BASE, "inline").select("uri", "obj")


_NATION_OBJ = f"'{{\"uri\":\"{BASE}Nation_' || n_nationkey || '\",\"n_name\":[\"' || n_name || '\"]}}'"


@query(f"""WITH n AS (SELECT n_nationkey, {_NATION_OBJ} AS n FROM nation),
c AS (SELECT c_custkey, '{{"uri":"' || {_iri_sql('Customer', 'c_custkey')} || '","customerNation":' || n || CASE WHEN s_suppkey IS NULL THEN '' ELSE ',"partner":{{"@id":"' || {_iri_sql('Supplier', 's_suppkey')} || '"}}' END || '}}' AS obj FROM customer JOIN n ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_suppkey = c_custkey)
SELECT {_iri_sql('Customer', 'c_custkey')} AS uri, obj FROM c
UNION ALL SELECT {_iri_sql('Supplier', 's_suppkey')}, '{{"uri":"' || {_iri_sql('Supplier', 's_suppkey')} || '"' || CASE WHEN c_custkey IS NULL THEN '' ELSE ',"partner":{{"@id":"' || {_iri_sql('Customer', 'c_custkey')} || '"}}' END || ',"supplierNation":' || n || '}}' FROM supplier JOIN n ON s_nationkey = n_nationkey LEFT JOIN customer ON s_suppkey = c_custkey
UNION ALL SELECT {_iri_sql('Order', 'o_orderkey')}, '{{"uri":"' || {_iri_sql('Order', 'o_orderkey')} || '","placedBy":' || obj || '}}' FROM orders JOIN c ON o_custkey = c_custkey""")
def inline_circles(spark, sf_dir):
    """Orders with their customers inside, these with their nations; partners refer to each other and so stay references."""
    c, s = load(spark, sf_dir, "customer"), load(spark, sf_dir, "supplier")
    t = statements(c.join(s.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_suppkey").alias("other")), "c_custkey", "left"), iri("Customer", "c_custkey"), _type("Customer"), _statement(BASE + "customerNation", iri("Nation", "c_nationkey")), _statement(BASE + "partner", F.when(F.col("other").isNotNull(), iri("Supplier", "other"))))
    t = t.unionByName(statements(s.join(c.select(F.col("c_custkey").alias("s_suppkey"), F.col("c_custkey").alias("other")), "s_suppkey", "left"), iri("Supplier", "s_suppkey"), _type("Supplier"), _statement(BASE + "supplierNation", iri("Nation", "s_nationkey")), _statement(BASE + "partner", F.when(F.col("other").isNotNull(), iri("Customer", "other")))))
    t = t.unionByName(statements(load(spark, sf_dir, "nation"), iri("Nation", "n_nationkey"), _type("Nation"), _statement(BASE + "n_name", F.col("n_name"), "string")))
    t = t.unionByName(statements(load(spark, sf_dir, "orders"), iri("Order", "o_orderkey"), _type("Order"), _statement(BASE + "placedBy", iri("Customer", "o_custkey"))))
    schema = _schema(
        Order={"placedBy": object_reference("Customer")}, Customer={"customerNation": object_reference("Nation"), "partner": object_reference("Supplier")},
        Supplier={"supplierNation": object_reference("Nation"), "partner": object_reference("Customer")}, Nation={"n_name": _MANY},
    )
    return instances.convert(_ordered(t), schema, BASE, "inline").where("type <> 'Nation'").select("uri", "obj")


@query(f"""SELECT {_iri_sql('Part', 'p_partkey')} AS uri, '{{"uri":"' || {_iri_sql('Part', 'p_partkey')} || '","made/brand":"' || CASE p_partkey % 4 WHEN 0 THEN 'near ' || p_brand ELSE p_brand END || '","size":' || p_size || '}}' AS obj FROM part""")
def fallback_iris(spark, sf_dir):
    """Parts whose properties are stated with other IRIs than the local name shows; the first kind that has values counts."""
    base = BASE.rstrip("#")
    near, brand, k = F.concat(F.lit("near "), "p_brand"), F.col("p_brand"), F.col("p_partkey") % 4
    only = lambda when, x: F.when(when, x)
    t = statements(
        load(spark, sf_dir, "part"), iri("Part", "p_partkey"), _type("Part"), _statement(base + "size", F.col("p_size"), "int"),
        # by local name, which goes before all others
        _statement("http://other.org/x#made/brand", only(k == 0, near), "string"),
        _statement(base + "made/brand", only(k == 0, brand), "string"), _statement(base + "made/brand", only(k == 1, brand), "string"),
        _statement(base + "/made/brand", only(k != 3, F.when(k == 2, brand).otherwise("unused")), "string"),
        _statement("https://example.org#made/brand", only(k == 3, brand), "string"),
    )
    schema = _schema(Part={"made/brand": {"type": "string"}, "size": {"type": "integer"}})
    return instances.convert(_ordered(t), schema, base).select("uri", "obj")
