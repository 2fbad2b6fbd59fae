"""Instance data as JSON objects shaped by a compiled schema.

The schema is turned into a small table of (type, property, how to write it),
which the planner broadcasts by its size; the rest is one equi-join and two
grouped aggregates over the triples, which share one shuffle.

Inline objects are built bottom-up, each once: types in the order of their
references, so an object meets the finished ones that it holds by one join.
Within types that refer to each other in a circle the individuals are ordered
instead, and references within a strongly connected component of them, which
nothing can hold whole, stay references.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphwright.functions import vocab as v
from graphwright.functions.terms import local_name
from graphwright.operators import closure
from graphwright.plans.tables import Parts, settled
from graphwright.sources.sinks import bounded

#: Values of a task where they are dealt to their individuals, individuals of a range that is numbered, and objects that are broadcast at most.
TASK_VALUES, RANGE_ROWS, SMALL = 500_000, 200_000, 1_000
DECLARED = (v.CLASS, v.RDFS + "Class", v.OBJECT_PROPERTY, v.DATATYPE_PROPERTY, v.RDF + "Property")


def class_properties(definitions: dict, name: str, deep: bool = False, seen: frozenset = frozenset()) -> dict[str, dict]:
    """Properties of a definition and of those it refers to under allOf.

    Inline parts of allOf count with their own properties only; with `deep`
    their nested allOf counts too, so inheritance is complete below a common
    base.
    """
    if name in seen or name not in definitions:
        return {}
    return _properties_of(definitions, definitions[name], deep, seen | {name})


def _properties_of(definitions: dict, schema: dict, deep: bool, seen: frozenset) -> dict[str, dict]:
    out: dict[str, dict] = {}
    for part in schema.get("allOf", []):
        if "$ref" in part:
            out |= class_properties(definitions, part["$ref"].rsplit("/", 1)[-1], deep, seen)
        elif deep:
            out |= _properties_of(definitions, part, deep, seen)
        else:
            out |= part.get("properties", {})
    return out | schema.get("properties", {})


def fallback_table(spark: SparkSession, definitions: dict, base: str, deep: bool = False) -> DataFrame | None:
    """type, name, p, rank: further IRIs that a property may have, in order of preference; None if there is none.

    They are base and name, base without its sign, a slash and name, and the
    name in two example namespaces (fixed values).  Those whose local name is
    the property's are found by it anyway.
    """
    rows = []
    for cls in definitions:
        for name in class_properties(definitions, cls, deep):
            if name != "uri":
                candidates = [f"{base}{name}", f"{base.rstrip('#/')}/{name}", f"http://example.org#{name}", f"https://example.org#{name}"]
                rows += [(cls, name, p, rank) for rank, p in enumerate(candidates, 1) if _local(p) != name and p not in candidates[: rank - 1]]
    return spark.createDataFrame(rows, "type string, name string, p string, rank int") if rows else None


def _local(uri: str) -> str:
    return uri.rsplit("#", 1)[-1] if "#" in uri else uri.rsplit("/", 1)[-1]


def property_table(spark: SparkSession, definitions: dict, deep: bool = False) -> DataFrame:
    """type, name, is_array, kind (string, integer, number, boolean, ref, any), of every definition's properties."""
    rows = []
    for cls in definitions:
        for name, schema in class_properties(definitions, cls, deep).items():
            array = schema.get("type") == "array"
            item = schema.get("items", {}) if array else schema
            kind = "ref" if "oneOf" in item or "$ref" in item else item.get("type", "any")
            rows.append((cls, name, array, kind if kind in ("string", "integer", "number", "boolean", "ref") else "any"))
    return spark.createDataFrame(rows, "type string, name string, is_array boolean, kind string")


def quoted(c: Column) -> Column:
    """A string as a JSON string."""
    text = F.to_json(F.array(c))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def _dealt(df: DataFrame, n: int, *columns: str) -> DataFrame:
    """The rows dealt by columns to tasks of some TASK_VALUES of n rows, so that tasks grow in number."""
    tasks = -(-n // TASK_VALUES)
    return df.repartition(tasks, *columns) if tasks > 1 else df


def individuals(triples: DataFrame, names: DataFrame, base: str, n: int = 0) -> DataFrame:
    """uri, type: named subjects that are no class or property, with the first of their types that has a definition.

    names has one column, name; an IRI counts as a definition's if it is the
    name, the base and the name, or has the name behind its last # or /.  n is
    the number of triples, if known.
    """
    typed = _dealt(triples.where((F.col("p") == v.TYPE) & (F.col("s_kind") == "uri")), n, "s")
    declared = typed.where(F.col("o").isin(*DECLARED)).select("s").distinct()
    mapped = F.when(F.startswith(F.col("o"), F.lit(base)), F.substring(F.col("o"), F.lit(len(base) + 1), F.length("o")))
    rows = typed.where(F.col("o") != v.NAMED).join(declared, "s", "left_anti").select(F.col("s").alias("uri"), "ord", local_name("o").alias("local"), mapped.alias("mapped"))
    known = names.select(F.col("name").alias("local"), F.col("name").alias("by_local"))
    based = names.select(F.col("name").alias("mapped"), F.col("name").alias("by_base"))
    hit = rows.join(known, "local", "left").join(based, "mapped", "left").select("uri", "ord", F.coalesce("by_base", "by_local").alias("type"))
    return hit.where("type is not null").groupBy("uri").agg(F.min_by("type", F.struct("ord", "type")).alias("type"))


def values(triples: DataFrame, who: DataFrame, props: DataFrame, fallback: DataFrame | None = None, n: int = 0) -> DataFrame:
    """type, uri, name, is_array, kind, o, o_kind, ord of all values that the schema has a place for.

    A predicate belongs to the property of its local name.  A property without
    values by that takes those of the first of its `fallback` IRIs that has any.
    """
    t = triples.where(~F.col("p").isin(v.TYPE, v.LABEL, v.COMMENT)).select(F.col("s").alias("uri"), "p", "o", "o_kind", "ord")
    t = _dealt(t, n, "uri").join(_grows(who), "uri")
    named = t.withColumn("name", local_name("p")).join(props, ["type", "name"])
    if fallback is None:
        return named.drop("p")
    probed = settled(t.join(fallback, ["type", "p"]).join(props, ["type", "name"]))
    if probed.isEmpty():
        return named.drop("p")
    best = probed.groupBy("type", "uri", "name").agg(F.min("rank").alias("rank"))
    best = best.join(_grows(named.select("type", "uri", "name").distinct()), ["type", "uri", "name"], "left_anti")
    return named.drop("p").unionByName(probed.join(_grows(best), ["type", "uri", "name", "rank"]).drop("p", "rank"))


def _grows(df: DataFrame) -> DataFrame:
    """A table that grows with the graph: it is not broadcast, however small its file is (IRIs are packed tightly there)."""
    return df.hint("merge")


def json_value(o: Column, o_kind: Column, kind: Column) -> Column:
    """A value as JSON: numbers and booleans where the schema asks for them and the text parses, references by @id."""
    reference = F.concat(F.lit('{"@id":'), quoted(o), F.lit("}"))
    whole = o.try_cast("decimal(38,0)").cast("string")
    number = o.try_cast("double")
    literal = (
        F.when((kind == "integer") & whole.isNotNull(), whole)
        .when((kind == "number") & number.isNotNull(), F.to_json(F.array(number)).substr(F.lit(2), F.length(F.to_json(F.array(number))) - 2))
        .when((kind == "boolean") & F.lower(o).isin("true", "1"), F.lit("true"))
        .when((kind == "boolean") & F.lower(o).isin("false", "0"), F.lit("false"))
        .otherwise(quoted(o))
    )
    return F.when(o_kind == "literal", literal).when(kind == "ref", reference).otherwise(quoted(o))


def objects(found: DataFrame, who: DataFrame) -> DataFrame:
    """The columns of who (type, uri, ...) and obj: one JSON object of each individual, its properties by name.

    Values are dealt to their individuals once; both groupings and the join
    need no further shuffle of them.  There are so many partitions that one has
    some TASK_VALUES; found is settled, so it is quickly counted.
    """
    dealt = found.select("type", "uri", "name", "is_array", "ord", "o", "json")
    n = found.count()
    dealt = _dealt(dealt, n, "type", "uri") if n > TASK_VALUES else dealt.repartition("type", "uri")
    lists = dealt.groupBy("type", "uri", "name").agg(F.array_sort(F.collect_list(F.struct("ord", "o", "json"))).alias("x"), F.first("is_array").alias("is_array"))
    items = F.array_join(F.transform("x", lambda e: e["json"]), ",")
    text = F.concat(quoted(F.col("name")), F.lit(":"), F.when(F.col("is_array"), F.concat(F.lit("["), items, F.lit("]"))).otherwise(F.col("x")[0]["json"]))
    body = lists.where("name <> 'uri'").groupBy("type", "uri").agg(F.array_join(F.array_sort(F.collect_list(text)), ",").alias("body"))
    rows = who.join(_grows(body), ["type", "uri"], "left")
    return rows.select(*who.columns, F.concat(F.lit('{"uri":'), quoted(F.col("uri")), F.when(F.col("body").isNotNull(), F.concat(F.lit(","), F.col("body"))).otherwise(""), F.lit("}")).alias("obj"))


def convert(triples: DataFrame, schema: dict, base: str = "https://example.org#", style: str = "reference", depth: int | None = None, deep: bool = False) -> DataFrame:
    """type, uri, idx, obj: the individuals of a graph as JSON, numbered within their type by IRI.

    style "inline" puts referenced individuals in place of references, at any
    depth; what refers to each other in a circle keeps references there.  With
    `depth`, objects end after so many levels, and circles are followed as far.
    """
    if style not in ("reference", "inline"):
        raise ValueError(f"no style {style!r}")
    spark, definitions = triples.sparkSession, schema.get("definitions", {})
    names = spark.createDataFrame([(n,) for n in definitions], "name string")
    props = property_table(spark, definitions, deep)
    n = triples.count()
    who = settled(individuals(triples, names, base, n))
    found = settled(values(triples, who, props, fallback_table(spark, definitions, base, deep), n).withColumn("json", json_value(F.col("o"), F.col("o_kind"), F.col("kind"))))
    numbered = settled(ranked(who))
    if style == "reference":
        return objects(found, numbered).select("type", "uri", "idx", "obj")
    if depth is None:
        return _inlined(found, numbered).select("type", "uri", "idx", "obj")
    out = objects(found, numbered)
    for _ in range(depth):
        inner = settled(out.select(F.col("uri").alias("o"), F.col("obj").alias("inner")))
        out = objects(_with_objects(found, inner), numbered)
    return out.select("type", "uri", "idx", "obj")


def _refers() -> Column:
    return (F.col("kind") == "ref") & (F.col("o_kind") != "literal") & (F.col("o") != F.col("uri"))


def _with_objects(found: DataFrame, inner: DataFrame) -> DataFrame:
    """The values with finished objects (o, inner) in place of references to them.

    Only references are dealt by what they refer to: a literal that many have
    would fill a task.  Few objects, to which many may refer, are broadcast.
    """
    few = inner.limit(SMALL + 1).count() <= SMALL
    refs = found.where(_refers())
    joined = (refs if few else _dealt(refs, found.count(), "o")).join(F.broadcast(inner) if few else _grows(inner), "o", "left").withColumn("json", F.coalesce("inner", "json"))
    return joined.select(*found.columns).unionByName(found.where(~F.coalesce(_refers(), F.lit(False))))


def _inlined(found: DataFrame, who: DataFrame) -> DataFrame:
    """Objects of all individuals with what they refer to inside, type by type."""
    targets = who.select(F.col("uri").alias("o"), F.col("type").alias("target"))
    edges = settled(found.where(_refers()).select("type", "uri", "o").distinct().join(_grows(targets), "o"))
    present = [r[0] for r in who.select("type").distinct().collect()]  # names of definitions
    pairs = [(r[0], r[1]) for r in edges.select("type", "target").distinct().collect()]
    done, parts = Parts(), []
    for group in _in_order(present, pairs):
        own, mine = found.where(F.col("type").isin(*group)), who.where(F.col("type").isin(*group))
        outer = {b for a, b in pairs if a in group and b not in group}
        if outer:
            finished = done.all(parts[0]).where(F.col("type").isin(*outer)).select(F.col("uri").alias("o"), F.col("obj").alias("inner"))
            own = _with_objects(own, finished)
        if any((a, b) in pairs for a in group for b in group):
            inside = edges.where(F.col("type").isin(*group) & F.col("target").isin(*group)).select(F.col("uri").alias("src"), F.col("o").alias("dst"))
            _inline_by_level(settled(own), settled(mine), settled(inside.distinct()), done, parts)
        else:
            parts.append(done.add(objects(own, mine)))
    return done.all(parts[0]) if parts else objects(found, who)


def _in_order(nodes: list[str], pairs: list[tuple[str, str]]) -> list[list[str]]:
    """Groups of types that refer to each other, those referred to before those that refer; types of an ontology."""
    reach = {n: {n} for n in nodes}
    grew = True
    while grew:
        grew = False
        for a, b in pairs:
            if not reach[b] <= reach[a]:
                reach[a] |= reach[b]
                grew = True
    groups = {tuple(sorted(m for m in reach[n] if n in reach[m])) for n in nodes}
    return [list(g) for g in sorted(groups, key=lambda g: (len(reach[g[0]]), g))]


def _inline_by_level(found: DataFrame, who: DataFrame, edges: DataFrame, done: Parts, parts: list[DataFrame]) -> None:
    """Builds the objects of types that refer to each other.

    In each round those are built whose references are all built.  Where none
    is left that can be, strongly connected components are found among the
    rest, and references within them stay as they are.
    """
    open_edges, waiting, first = edges, who, len(parts)
    kept = None  # references that are not followed
    while not waiting.isEmpty():
        blocked = open_edges.select(F.col("src").alias("uri")).distinct()
        ready = settled(waiting.join(blocked, "uri", "left_anti"))
        if ready.isEmpty():
            roots = closure.strongly_connected(open_edges)
            ends = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"_{c}"))
            both = settled(open_edges.join(ends("src"), "src", "left").join(ends("dst"), "dst", "left").withColumn("_cut", F.coalesce(F.col("_src") == F.col("_dst"), F.lit(False))).select("src", "dst", "_cut"))
            cut = both.where("_cut").select(F.col("src").alias("uri"), F.col("dst").alias("o"))
            kept = cut if kept is None else kept.unionByName(cut)
            open_edges = both.where("not _cut").drop("_cut")
            continue
        own = found.join(ready.select("uri"), "uri", "left_semi").select(*found.columns)
        if len(parts) > first:
            inner = done.all(parts[0]).join(who.select("uri"), "uri", "left_semi").select(F.col("uri").alias("o"), F.col("obj").alias("inner"))
            followed = own if kept is None else own.join(kept, ["uri", "o"], "left_anti").select(*found.columns)
            made = _with_objects(followed, inner)
            own = made if kept is None else made.unionByName(own.join(kept, ["uri", "o"], "left_semi").select(*found.columns))
        parts.append(done.add(objects(own, ready.select(*who.columns))))
        built = ready.select(F.col("uri").alias("dst"))
        open_edges = settled(open_edges.join(built, "dst", "left_anti").select("src", "dst"))
        waiting = settled(waiting.join(ready.select("uri"), "uri", "left_anti"))


def ranked(who: DataFrame) -> DataFrame:
    """type, uri and idx, from 0 within each type, in the order of IRIs.

    Rows are dealt to ranges of the IRI and settled; a type's rows of a range
    start where its rows of the ranges before end, so no task holds a type.
    """
    from pyspark.sql.window import Window

    n = -(-who.count() // RANGE_ROWS)
    names = who.select("type", "uri")
    ranged = settled((names.repartitionByRange(n, "uri") if n > 1 else names.repartitionByRange("uri")).withColumn("_part", F.spark_partition_id()))
    starts = ranged.groupBy("type", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("type").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("type", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inner = F.row_number().over(Window.partitionBy("type", "_part").orderBy("uri")) - 1
    return ranged.join(starts, ["type", "_part"]).select("type", "uri", (F.col("_start") + inner).cast("long").alias("idx"))


def number(objs: DataFrame) -> DataFrame:
    """type, uri, idx, obj: the objects with the numbers of ranked(); only names are sorted."""
    return objs.join(ranked(objs), ["type", "uri"]).select("type", "uri", "idx", "obj")


def convert_and_validate(triples: DataFrame, schema: dict, base: str = "https://example.org#", style: str = "reference", depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The instances of convert(), settled, and their results by jsonschema.validate()."""
    from graphwright.operators import jsonschema

    made = settled(convert(triples, schema, base, style, depth))
    return made, jsonschema.validate(made, schema)


def grouped(instances: DataFrame) -> dict[str, list]:
    """All instances on the driver, by type; at most as many as one document may hold."""
    out: dict[str, list] = {}
    for r in bounded(instances).orderBy("type", "idx").toLocalIterator():
        out.setdefault(r["type"], []).append(json.loads(r["obj"]))
    return out


def jsonld(instances: DataFrame, schema: dict, base: str) -> tuple[dict, DataFrame]:
    """The @context, and one JSON-LD node of each instance: uri becomes @id, the type @type."""
    context = {"@base": base, "@vocab": base} | {n: base + n for n in schema.get("definitions", {})}
    node = F.concat(F.lit('{"@id"'), F.substring(F.col("obj"), F.lit(7), F.length("obj") - 7), F.lit(',"@type":'), quoted(F.col("type")), F.lit("}"))
    return context, instances.select("type", "uri", node.alias("node"))


def jsonld_document(instances: DataFrame, schema: dict, base: str) -> dict:
    context, nodes = jsonld(instances, schema, base)
    return {"@context": context, "@graph": [json.loads(r["node"]) for r in bounded(nodes).orderBy("type", "uri").toLocalIterator()]}


def display(instances: DataFrame) -> str:
    return json.dumps(grouped(instances), indent=2, sort_keys=True)
