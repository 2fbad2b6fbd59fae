"""Relational tables as a virtual graph.

A mapping names, for each class, the table, its key, and what its columns
mean.  Triples are projections of the table, so filters on class or predicate
reach its scan; checks that need no IRIs run on the keys (operators.consistency
works on any columns) and make IRIs of what is left.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwright.functions import vocab as v

BASE = "http://ex.org/d#"


@dataclass(frozen=True)
class Entity:
    """A table as a class: key columns, datatype properties and links (property -> (class, column))."""

    name: str
    table: str
    key: tuple[str, ...]
    values: tuple[str, ...] = ()
    links: dict[str, tuple[str, str]] = field(default_factory=dict)
    kind: str | None = None  # column whose values are subclasses


#: The classes of the test tables (fixed values).
ENTITIES = {
    e.name: e
    for e in (
        Entity("Region", "region", ("r_regionkey",), ("r_name",)),
        Entity("Nation", "nation", ("n_nationkey",), ("n_name",), {"inRegion": ("Region", "n_regionkey")}),
        Entity("Customer", "customer", ("c_custkey",), ("c_name", "c_acctbal", "c_mktsegment"), {"customerNation": ("Nation", "c_nationkey")}, "c_mktsegment"),
        Entity("Supplier", "supplier", ("s_suppkey",), ("s_name", "s_acctbal"), {"supplierNation": ("Nation", "s_nationkey")}),
        Entity("Part", "part", ("p_partkey",), ("p_name", "p_brand", "p_size", "p_retailprice"), {}, "p_type"),
        Entity("Order", "orders", ("o_orderkey",), ("o_orderstatus", "o_totalprice", "o_orderpriority"), {"placedBy": ("Customer", "o_custkey")}),
        Entity("Event", "events", ("event_id",), ("value",), {"byUser": ("Customer", "user_id")}, "event_type"),
    )
}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def iri(cls: str, *key: Column | str) -> Column:
    """BASE + Class_key."""
    return F.concat_ws("_", F.lit(BASE + cls), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in key])


def _rows(df: DataFrame, e: Entity, p: Column, o: Column, kind: str, datatype: Column | None = None) -> DataFrame:
    return df.select(iri(e.name, *e.key).alias("s"), p.alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), (datatype if datatype is not None else F.lit(None).cast("string")).alias("o_datatype")).where("o is not null")


_XSD_OF = {"string": "string", "bigint": "long", "int": "int", "double": "double", "timestamp": "dateTime", "boolean": "boolean"}


def triplify(df: DataFrame, e: Entity) -> DataFrame:
    """s, p, o, o_kind, o_datatype of every row: its type, subclass, values and links.

    One pass over the table: each row makes an array of its statements, which
    is exploded; nothing is shuffled.
    """
    types = dict(df.dtypes)
    statement = lambda p, o, kind, d=None: F.struct(F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"), F.lit(d).cast("string").alias("o_datatype"))
    made = [statement(v.TYPE, F.lit(BASE + e.name), "uri")]
    if e.kind:
        made.append(statement(v.TYPE, F.concat(F.lit(BASE), F.translate(F.initcap(e.kind), " -", "")), "uri"))
    made += [statement(BASE + c, F.col(c), "literal", v.XSD + _XSD_OF.get(types[c], "string")) for c in e.values]
    made += [statement(BASE + p, iri(cls, c), "uri") for p, (cls, c) in e.links.items()]
    rows = df.select(iri(e.name, *e.key).alias("s"), F.explode(F.array(*made)).alias("x"))
    return rows.select("s", "x.p", "x.o", "x.o_kind", "x.o_datatype").where("o is not null")


def graph(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """The union of the named entities' triples."""
    return reduce(DataFrame.unionByName, [triplify(load(spark, sf_dir, ENTITIES[n].table), ENTITIES[n]) for n in names])
