"""The typed ontology model, extracted from triples by filters, joins and grouped minima.

Everything is a DataFrame over `triples` (see sources.rdf.TRIPLES).  Where a
graph leaves an order open, that of the source (`ord`) counts.  Predicates are
filtered first, so a triple table partitioned by predicate is pruned, and the
instance data of a mixed graph is not read for the model.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphwright.functions import vocab as v
from graphwright.plans.tables import settled

#: Facets of a restriction, in order of precedence: one node gives one facet (fixed values).
FACETS = [
    ("minCardinality", "min"), ("maxCardinality", "max"), ("cardinality", "exact"),
    ("minQualifiedCardinality", "min"), ("maxQualifiedCardinality", "max"), ("qualifiedCardinality", "exact"),
    ("allValuesFrom", "all"), ("someValuesFrom", "some"), ("hasValue", "value"),
]
CHARACTERISTICS = ("Functional", "InverseFunctional", "Transitive", "Symmetric", "Asymmetric", "Irreflexive", "Reflexive")
#: Predicates that are structure and not annotations (fixed values).
STRUCTURAL = [
    v.TYPE, v.LABEL, v.COMMENT, v.SUBCLASS, v.SUBPROP, v.DOMAIN, v.RANGE, v.OWL + "equivalentClass", v.OWL + "disjointWith", v.OWL + "onProperty",
    v.OWL + "minCardinality", v.OWL + "maxCardinality", v.OWL + "cardinality", v.OWL + "allValuesFrom", v.OWL + "someValuesFrom", v.OWL + "hasValue",
]


@dataclass
class TBox:
    """The tables of an ontology; see the functions of this module for their columns."""

    ontology: DataFrame
    classes: DataFrame
    class_super: DataFrame
    class_equiv: DataFrame
    class_disjoint: DataFrame
    enum_members: DataFrame
    restrictions: DataFrame
    properties: DataFrame
    prop_domain: DataFrame
    prop_range: DataFrame
    individuals: DataFrame
    ind_type: DataFrame
    ind_prop: DataFrame
    annotations: DataFrame
    expressions: DataFrame

    @classmethod
    def of(cls, triples: DataFrame) -> TBox:
        """Extracts everything from a graph."""
        t = settled(triples)
        made = {f.name: globals()[f.name](t) for f in fields(cls)}
        return cls(**made)

    @classmethod
    def from_rows(cls, spark, **rows) -> TBox:
        """A model stated in rows (lists of tuples) instead of triples; tables left out are empty."""
        schemas = {
            "ontology": "uri string", "classes": "uri string, ord long, label map<string,string>, comment map<string,string>",
            "class_super": _EDGE, "class_equiv": _EDGE, "class_disjoint": _EDGE, "enum_members": "class string, pos int, value string",
            "restrictions": "class string, ord long, prop string, kind string, min int, max int, exact int, filler string, value string, value_dt string",
            "properties": "uri string, ord long, kind string, label map<string,string>, comment map<string,string>, inverse_of string, " + ", ".join(f"{_snake(c)} boolean" for c in CHARACTERISTICS),
            "prop_domain": "prop string, other string, ord long", "prop_range": "prop string, other string, ord long",
            "individuals": "uri string, ord long, label map<string,string>", "ind_type": "uri string, type string, ord long",
            "ind_prop": "uri string, prop string, value string, value_kind string, value_dt string, ord long",
            "annotations": "subject string, key string, value string", "expressions": "class string, op string, other string, ord long",
        }
        return cls(**{k: spark.createDataFrame(rows.get(k, []), s) for k, s in schemas.items()})


_EDGE = "class string, other string, ord long"


def _snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in name).lstrip("_")


def typed(t: DataFrame, *types: str) -> DataFrame:
    """s, ord of the named subjects of one of the types, by first mention."""
    return t.where((F.col("p") == v.TYPE) & F.col("o").isin(*types) & (F.col("s_kind") == "uri")).groupBy("s").agg(F.min("ord").alias("ord"))


def texts(t: DataFrame, predicate: str, out: str) -> DataFrame:
    """s and a map from language ('default' if untagged) to text; the last of a language wins."""
    rows = t.where((F.col("p") == predicate) & (F.col("o_kind") == "literal")).withColumn("lang", F.coalesce("o_lang", F.lit("default")))
    last = rows.groupBy("s", "lang").agg(F.max_by("o", "ord").alias("text"))
    return last.groupBy("s").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("lang", "text")))).alias(out))


def _labelled(t: DataFrame, subjects: DataFrame) -> DataFrame:
    return subjects.join(texts(t, v.LABEL, "label"), "s", "left").join(texts(t, v.COMMENT, "comment"), "s", "left")


def _edges(t: DataFrame, subjects: DataFrame, predicate: str, name: str = "class") -> DataFrame:
    rows = t.where((F.col("p") == predicate) & (F.col("o_kind") == "uri")).select("s", F.col("o").alias("other"), "ord")
    return rows.join(subjects.select("s"), "s", "left_semi").withColumnRenamed("s", name)


def ontology(t: DataFrame) -> DataFrame:
    """uri: of the ontology, one row at most."""
    return typed(t, v.ONTOLOGY).agg(F.min_by("s", "ord").alias("uri")).where("uri is not null")


def classes(t: DataFrame) -> DataFrame:
    """uri, ord, label, comment of the named classes."""
    return _labelled(t, typed(t, v.CLASS)).select(F.col("s").alias("uri"), "ord", "label", "comment")


def class_super(t: DataFrame) -> DataFrame:
    return _edges(t, typed(t, v.CLASS), v.SUBCLASS)


def class_equiv(t: DataFrame) -> DataFrame:
    return _edges(t, typed(t, v.CLASS), v.OWL + "equivalentClass")


def class_disjoint(t: DataFrame) -> DataFrame:
    return _edges(t, typed(t, v.CLASS), v.OWL + "disjointWith")


def list_members(t: DataFrame) -> DataFrame:
    """head, pos, member, member_kind of every RDF list.

    Each cell jumps to its predecessor's predecessor until it meets the head,
    so a list of n cells takes log2(n) joins.  A list that comes back to one of
    its own cells has no head: it raises an error.
    """
    rest = t.where(F.col("p") == v.REST).select(F.col("s").alias("prev"), F.col("o").alias("cell"))
    first = t.where(F.col("p") == v.FIRST).select(F.col("s").alias("cell"), F.col("o").alias("member"), F.col("o_kind").alias("member_kind"))
    at = first.select("cell").distinct().join(rest, "cell", "left").select("cell", F.coalesce("prev", "cell").alias("head"), F.when(F.col("prev").isNull(), 0).otherwise(1).alias("pos"))
    rounds = None
    while True:
        at = settled(at)
        rounds = at.count().bit_length() + 1 if rounds is None else rounds - 1
        up = at.select(F.col("cell").alias("head"), F.col("head").alias("higher"), F.col("pos").alias("more"))
        step = at.join(up, "head")
        open_ = step.where("higher <> head")
        if (done := open_.isEmpty()) or not rounds:
            round_ = (at.where("cell = head and pos > 0") if done else open_).agg(F.min("cell")).first()[0]
            if round_ is not None:
                raise ValueError(f"rdf:rest goes in a circle at {round_}")
            return at.join(first, "cell").select("head", "pos", "member", "member_kind")
        at = step.select("cell", F.col("higher").alias("head"), (F.col("pos") + F.col("more")).alias("pos"))


def enum_members(t: DataFrame) -> DataFrame:
    """class, pos, value: members of an enumeration that a class is a subclass of; English label, any untagged one, or local name."""
    from graphwright.functions.terms import local_name

    blank = t.where((F.col("p") == v.SUBCLASS) & (F.col("o_kind") == "bnode")).select(F.col("s").alias("class"), F.col("o").alias("node"))
    lists = t.where(F.col("p") == v.OWL + "oneOf").select(F.col("s").alias("node"), F.col("o").alias("head"))
    members = blank.join(typed(t, v.CLASS).select(F.col("s").alias("class")), "class", "left_semi").join(lists, "node").join(list_members(t), "head")
    named = members.join(texts(t, v.LABEL, "label").withColumnRenamed("s", "member"), "member", "left")
    label = F.coalesce(F.try_element_at("label", F.lit("en")), F.try_element_at("label", F.lit("default")), local_name("member"))
    return named.select("class", "pos", label.alias("value"))


def restrictions(t: DataFrame) -> DataFrame:
    """class, ord, prop, kind, min, max, exact, filler, value, value_dt of the restrictions that classes are subclasses of.

    They stand there alone or in an intersection's list.  kind is cardinality,
    allValuesFrom, someValuesFrom or hasValue.
    """
    blank = t.where((F.col("p") == v.SUBCLASS) & (F.col("o_kind") == "bnode") & (F.col("s_kind") == "uri")).select(F.col("s").alias("class"), F.col("o").alias("node"), "ord")
    blank = blank.join(typed(t, v.CLASS).select(F.col("s").alias("class")), "class", "left_semi")
    inner = t.where(F.col("p") == v.OWL + "intersectionOf").select(F.col("s").alias("node"), F.col("o").alias("head"))
    listed = blank.join(inner, "node").join(list_members(t), "head").select("class", F.col("member").alias("node"), "ord", "pos")
    nodes = blank.withColumn("pos", F.lit(0)).unionByName(listed)
    is_one = t.where((F.col("p") == v.TYPE) & (F.col("o") == v.RESTRICTION)).select(F.col("s").alias("node")).distinct()
    on = t.where(F.col("p") == v.OWL + "onProperty").groupBy(F.col("s").alias("node")).agg(F.min_by("o", "ord").alias("prop"))
    rank = F.create_map(*[x for i, (name, _) in enumerate(FACETS) for x in (F.lit(v.OWL + name), F.lit(i))])
    kinds = F.array(*[F.lit(k) for _, k in FACETS])
    facet = t.where(F.col("p").isin(*[v.OWL + n for n, _ in FACETS])).withColumn("rank", F.try_element_at(rank, F.col("p")))
    facet = facet.groupBy(F.col("s").alias("node")).agg(F.min_by(F.struct("rank", "o", "o_kind", "o_datatype"), F.struct("rank", "ord")).alias("f"))
    facet = facet.select("node", F.element_at(kinds, F.col("f.rank") + 1).alias("facet"), F.col("f.o").alias("o"), F.col("f.o_datatype").alias("dt"))
    rows = nodes.join(is_one, "node", "left_semi").join(on, "node").join(facet, "node")
    number = lambda k: F.when(F.col("facet") == k, F.col("o").try_cast("int"))
    kind = F.when(F.col("facet") == "all", "allValuesFrom").when(F.col("facet") == "some", "someValuesFrom").when(F.col("facet") == "value", "hasValue").otherwise("cardinality")
    # one row per restriction of the ontology
    order = (F.row_number().over(Window.orderBy("ord", "pos", "node")) - 1).cast("long").alias("ord")
    return rows.select(
        "class", order, "prop", kind.alias("kind"), number("min").alias("min"), number("max").alias("max"), number("exact").alias("exact"),
        F.when(F.col("facet").isin("all", "some"), F.col("o")).alias("filler"), F.when(F.col("facet") == "value", F.col("o")).alias("value"), F.col("dt").alias("value_dt"),
    )


def properties(t: DataFrame) -> DataFrame:
    """uri, ord, kind (object or datatype), label, comment, inverse_of (in both directions) and the seven characteristics."""
    both = typed(t, v.OBJECT_PROPERTY).withColumn("kind", F.lit("object")).unionByName(typed(t, v.DATATYPE_PROPERTY).withColumn("kind", F.lit("datatype")))
    flags = t.where(F.col("p") == v.TYPE).groupBy("s").agg(*[F.bool_or(F.col("o") == f"{v.OWL}{c}Property").alias(_snake(c)) for c in CHARACTERISTICS])
    stated = t.where((F.col("p") == v.OWL + "inverseOf") & (F.col("o_kind") == "uri")).groupBy("s").agg(F.min_by("o", "ord").alias("own"), F.min("ord").alias("at"))
    claimed = stated.groupBy(F.col("own").alias("s")).agg(F.min_by(F.col("s"), F.col("at")).alias("claimed"))
    p = _labelled(t, both).join(flags, "s", "left").join(stated.select("s", "own"), "s", "left").join(claimed, "s", "left")
    inverse = F.when(F.col("kind") == "object", F.coalesce("own", "claimed")).alias("inverse_of")
    return p.select(F.col("s").alias("uri"), "ord", "kind", "label", "comment", inverse, *[_snake(c) for c in CHARACTERISTICS])


def _all_properties(t: DataFrame) -> DataFrame:
    return typed(t, v.OBJECT_PROPERTY, v.DATATYPE_PROPERTY)


def prop_domain(t: DataFrame) -> DataFrame:
    return _edges(t, _all_properties(t), v.DOMAIN, "prop")


def prop_range(t: DataFrame) -> DataFrame:
    return _edges(t, _all_properties(t), v.RANGE, "prop")


def individuals(t: DataFrame) -> DataFrame:
    """uri, ord, label of the named individuals."""
    return _labelled(t, typed(t, v.NAMED)).select(F.col("s").alias("uri"), "ord", "label")


def ind_type(t: DataFrame) -> DataFrame:
    rows = t.where((F.col("p") == v.TYPE) & (F.col("o") != v.NAMED) & (F.col("o_kind") == "uri"))
    return rows.join(typed(t, v.NAMED).select("s"), "s", "left_semi").select(F.col("s").alias("uri"), F.col("o").alias("type"), "ord")


def ind_prop(t: DataFrame) -> DataFrame:
    """uri, prop, value, value_kind, value_dt, ord: the last value of each property."""
    rows = t.where(~F.col("p").isin(v.TYPE, v.LABEL, v.COMMENT)).join(typed(t, v.NAMED).select("s"), "s", "left_semi")
    last = rows.groupBy("s", "p").agg(F.max_by(F.struct("o", "o_kind", "o_datatype", "ord"), "ord").alias("x"))
    return last.select(F.col("s").alias("uri"), F.col("p").alias("prop"), F.col("x.o").alias("value"), F.col("x.o_kind").alias("value_kind"), F.col("x.o_datatype").alias("value_dt"), F.col("x.ord").alias("ord"))


def annotations(t: DataFrame) -> DataFrame:
    """subject, key, value of what is not structure, last value of each key; keys have the usual prefixes."""
    from graphwright.functions.terms import local_name

    subjects = typed(t, v.CLASS, v.OBJECT_PROPERTY, v.DATATYPE_PROPERTY, v.NAMED, v.ONTOLOGY).select("s")
    rows = t.where(~F.col("p").isin(*STRUCTURAL)).join(subjects, "s", "left_semi")
    key: Column = local_name("p")
    for prefix, ns in v.PREFIXES.items():
        key = F.when(F.startswith(F.col("p"), F.lit(ns)), F.concat(F.lit(prefix + ":"), F.expr(f"substring(p, {len(ns) + 1})"))).otherwise(key)
    return rows.groupBy(F.col("s").alias("subject"), key.alias("key")).agg(F.max_by("o", "ord").alias("value"))


def expressions(t: DataFrame) -> DataFrame:
    """class, op (union, intersection, complement), other, ord: class expressions that a class equals or is a subclass of."""
    blank = t.where(F.col("p").isin(v.SUBCLASS, v.OWL + "equivalentClass") & (F.col("s_kind") == "uri") & (F.col("o_kind") == "bnode"))
    blank = blank.select(F.col("s").alias("class"), F.col("o").alias("node"))
    lists = t.where(F.col("p").isin(v.OWL + "unionOf", v.OWL + "intersectionOf")).select(F.col("s").alias("node"), F.when(F.col("p") == v.OWL + "unionOf", "union").otherwise("intersection").alias("op"), F.col("o").alias("head"))
    members = blank.join(lists, "node").join(list_members(t).where("member_kind = 'uri'"), "head").select("class", "op", F.col("member").alias("other"), F.col("pos").cast("long").alias("ord"))
    negated = t.where((F.col("p") == v.OWL + "complementOf") & (F.col("o_kind") == "uri")).select(F.col("s").alias("node"), F.col("o").alias("other"), "ord")
    return members.unionByName(blank.join(negated, "node").select("class", F.lit("complement").alias("op"), "other", "ord"))


def counts(t: TBox) -> DataFrame:
    """what, n: classes, object properties, datatype properties and individuals of a model."""
    props = t.properties.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    known = t.properties.sparkSession.createDataFrame([("object",), ("datatype",)], "kind string").join(props, "kind", "left")
    some = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    kinds = known.select(F.concat("kind", F.lit(" properties")).alias("what"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return some(t.classes, "classes").unionByName(kinds).unionByName(some(t.individuals, "individuals"))
