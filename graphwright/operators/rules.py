"""What the transformation rules need, as relational operators on the T-box tables.

They take and return DataFrames; plans.compile folds their rows into a schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphwright.functions.terms import local_name


def _first(edges: DataFrame, key: str, out: str) -> DataFrame:
    return edges.groupBy(key).agg(F.min_by("other", "ord").alias(out))


def property_usage(restrictions: DataFrame) -> DataFrame:
    """prop, user: the first class that restricts each property."""
    return restrictions.groupBy("prop").agg(F.min_by("class", "ord").alias("user"))


def property_domains(properties: DataFrame, prop_domain: DataFrame, prop_range: DataFrame) -> DataFrame:
    """prop, domain, ord: stated domains, or the ranges of the inverse if there are none."""
    stated = prop_domain.select("prop", F.col("other").alias("domain"), "ord")
    bare = properties.where("inverse_of is not null").join(prop_domain.select(F.col("prop").alias("uri")), "uri", "left_anti")
    inferred = bare.select(F.col("uri").alias("prop"), F.col("inverse_of").alias("inv")).join(prop_range.withColumnRenamed("prop", "inv"), "inv")
    return stated.unionByName(inferred.select("prop", F.col("other").alias("domain"), "ord"))


def property_functional(properties: DataFrame) -> DataFrame:
    """prop, functional: stated, or by an inverse-functional inverse."""
    other = properties.select(F.col("uri").alias("inverse_of"), F.col("inverse_functional").alias("by_inverse"))
    joined = properties.join(other, "inverse_of", "left")
    return joined.select(F.col("uri").alias("prop"), (F.coalesce("functional", F.lit(False)) | F.coalesce("by_inverse", F.lit(False))).alias("functional"))


def property_ranges(properties: DataFrame, prop_domain: DataFrame, prop_range: DataFrame, restrictions: DataFrame) -> DataFrame:
    """prop, range: the first stated one, else the inverse's first domain, else the first class that restricts the inverse."""
    own = _first(prop_range, "prop", "own")
    inv_domain = _first(prop_domain, "prop", "inv_domain").withColumnRenamed("prop", "inverse_of")
    known = properties.select(F.col("uri").alias("inverse_of")).distinct()
    usage = property_usage(restrictions).withColumnRenamed("prop", "inverse_of").join(known, "inverse_of", "left_semi")
    p = properties.select(F.col("uri").alias("prop"), "inverse_of").join(own, "prop", "left").join(inv_domain, "inverse_of", "left").join(usage, "inverse_of", "left")
    return p.select("prop", F.coalesce("own", "inv_domain", "user").alias("range"))


def property_to_class(domains: DataFrame, classes: DataFrame) -> DataFrame:
    """prop, class: domains that are classes of the ontology; others are dropped."""
    return domains.join(classes.select(F.col("uri").alias("domain")), "domain", "left_semi").select("prop", F.col("domain").alias("class"), "ord")


def merged_restrictions(restrictions: DataFrame) -> DataFrame:
    """class, prop, ord, required and the merged facets of all restrictions of a class on a property.

    A later restriction's facet replaces an earlier one's; one restriction that
    requires the property is enough.
    """
    r = restrictions
    card = F.col("kind") == "cardinality"
    required = F.when(card, (F.col("min") >= 1) | (F.col("exact") == 1)).otherwise(F.col("kind") == "someValuesFrom")
    least = F.when(F.col("min") > 1, F.col("min")).when(F.col("exact") != 1, F.col("exact")).when(F.col("kind") == "someValuesFrom", 1)
    most = F.when(F.col("max") != 1, F.col("max")).when(F.col("exact") != 1, F.col("exact"))
    filler = F.when(F.col("kind").isin("allValuesFrom", "someValuesFrom"), F.col("filler"))
    last = lambda c, out: F.max_by(c, F.when(c.isNotNull(), F.col("ord"))).alias(out)
    return r.groupBy("class", "prop").agg(
        F.min("ord").alias("ord"),
        F.bool_or(F.coalesce(required, F.lit(False))).alias("required"),
        last(least, "min_items"),
        last(most, "max_items"),
        last(filler, "filler"),
        last(F.when(F.col("kind") == "allValuesFrom", F.col("filler")), "all_filler"),
        last(F.when(F.col("kind") == "hasValue", F.col("value")), "const"),
    )


def effective_cardinality(restrictions: DataFrame) -> DataFrame:
    """class, prop, min, max: the greatest least, the least greatest, and an exact number over both."""
    g = restrictions.where("kind = 'cardinality'").groupBy("class", "prop")
    g = g.agg(F.max("min").alias("lo"), F.min("max").alias("hi"), F.max_by("exact", F.when(F.col("exact").isNotNull(), F.col("ord"))).alias("n"))
    return g.select("class", "prop", F.coalesce("n", "lo", F.lit(0)).alias("min"), F.coalesce("n", "hi").alias("max"))


def symmetric(edges: DataFrame) -> DataFrame:
    """a, b: both directions of an edge table (class, other), once each."""
    one = edges.select(F.col("class").alias("a"), F.col("other").alias("b"))
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def subclasses(class_super: DataFrame) -> DataFrame:
    """parent, child by local name, without self-loops."""
    pairs = class_super.select(local_name("other").alias("parent"), local_name("class").alias("child"), "class")
    return pairs.where("parent <> child").groupBy("parent", "child").agg(F.min("class").alias("class"))


def disjoint_unions(class_super: DataFrame, class_disjoint: DataFrame) -> DataFrame:
    """parent, child of parents with two subclasses or more that are all pairwise disjoint.

    Relational division by counting: n children have n (n - 1) ordered pairs,
    all of which must be disjoint; so no pair without an axiom is ever made.
    """
    kids = subclasses(class_super)
    n = kids.groupBy("parent").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    apart = symmetric(class_disjoint.select(local_name("class").alias("class"), local_name("other").alias("other"))).where("a <> b")
    first = kids.select("parent", F.col("child").alias("a")).join(apart, "a")
    hits = first.join(kids.select("parent", F.col("child").alias("b")), ["parent", "b"]).groupBy("parent").agg(F.count(F.lit(1)).alias("hits"))
    whole = n.join(hits, "parent").where("hits = n * (n - 1)").select("parent")
    return kids.join(whole, "parent", "left_semi").select("parent", "child", "class")


def disjoint_groups(class_disjoint: DataFrame) -> DataFrame:
    """class, together: each class with a disjointness axiom, and the sorted names of it and all classes disjoint with it."""
    apart = symmetric(class_disjoint.select(local_name("class").alias("class"), local_name("other").alias("other")))
    return apart.groupBy(F.col("a").alias("class")).agg(F.array_sort(F.array_distinct(F.concat(F.collect_set("b"), F.array(F.first("a"))))).alias("together"))


def unused_targets(targets: DataFrame, links: DataFrame) -> DataFrame:
    """The targets (target) that no link (o) goes to yet."""
    return targets.join(links.select(F.col("o").alias("target")), "target", "left_anti")


def sample_targets(links: DataFrame, source: str, target: str, k: int) -> DataFrame:
    """The least k distinct targets of each source; the planner limits groups to k rows before the shuffle."""
    w = Window.partitionBy(source).orderBy(target)
    return links.select(source, target).distinct().withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def concrete_classes(classes: DataFrame, class_super: DataFrame, class_disjoint: DataFrame, enum_members: DataFrame) -> DataFrame:
    """uri of classes that may have individuals: no owl:Thing, no enumeration, no parent of subclasses of which some two are disjoint."""
    kids = class_super.select(F.col("other").alias("parent"), F.col("class").alias("child")).where("parent <> child").distinct()
    apart = symmetric(class_disjoint)
    pairs = kids.withColumnRenamed("child", "a").join(apart, "a").join(kids.withColumnRenamed("child", "b"), ["parent", "b"])
    abstract = pairs.select(F.col("parent").alias("uri")).distinct()
    named = classes.where(~F.col("uri").like("%#Thing")).select("uri")
    return named.join(abstract, "uri", "left_anti").join(enum_members.select(F.col("class").alias("uri")), "uri", "left_anti")


def applicable_properties(classes: DataFrame, class_super: DataFrame, prop_domain: DataFrame, properties: DataFrame, restrictions: DataFrame) -> DataFrame:
    """class, prop: a domain is the class, a direct superclass or owl:Thing; a property without domain applies where it is restricted."""
    own = classes.select(F.col("uri").alias("class"), F.col("uri").alias("domain"))
    wide = own.unionByName(class_super.select("class", F.col("other").alias("domain"))).distinct()
    by_domain = wide.join(prop_domain.select("prop", F.col("other").alias("domain")), "domain").select("class", "prop")
    universal = prop_domain.where(F.col("other").like("%owl#Thing")).select("prop").distinct()
    anywhere = _everywhere(classes, universal)
    bare = properties.select(F.col("uri").alias("prop")).join(prop_domain.select("prop"), "prop", "left_anti")
    used = restrictions.select("class", "prop").join(bare, "prop", "left_semi").select("class", "prop")
    return by_domain.unionByName(anywhere).unionByName(used).distinct()


def _everywhere(classes: DataFrame, props: DataFrame) -> DataFrame:
    """Every class with every universal property; both sides are rows of the ontology."""
    return classes.select(F.col("uri").alias("class"), F.lit(1).alias("one")).join(props.withColumn("one", F.lit(1)), "one").select("class", "prop")


def range_targets(ranges: DataFrame, class_super: DataFrame, ind_type: DataFrame) -> DataFrame:
    """prop, target: individuals of a property's range or of a direct subclass of it."""
    kinds = ranges.select("prop", F.col("range").alias("type"))
    below = kinds.join(class_super.select(F.col("other").alias("type"), F.col("class").alias("sub")), "type").select("prop", F.col("sub").alias("type"))
    return kinds.unionByName(below).distinct().join(ind_type.select(F.col("uri").alias("target"), "type"), "type").select("prop", "target").distinct()
