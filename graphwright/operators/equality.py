"""Entailment with equality: individuals that are the same become one.

The facts are kept over representatives.  The rules run to their fix-point;
what they make equal is merged (a table of representatives grows), the facts
that name a merged individual are rewritten, and only these are new to the
rules' next round.  Literals are terms by value (functions.literals), so equal
values are equal whatever their text.

Merging reads the facts of functional, inverse-functional, limited and key
properties only, by grouped minima: a group of any size is a star around its
least member, and no pairs within a group are made.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphwright.functions import literals
from graphwright.functions import vocab as v
from graphwright.operators import closure
from graphwright.operators.tbox import list_members
from graphwright.plans.tables import Parts, release, settled

SAME = v.OWL + "sameAs"
_ONE = '"1"^^decimal'
_LIMITS = [v.OWL + x for x in ("maxCardinality", "cardinality")]
_QUALIFIED = [v.OWL + x for x in ("maxQualifiedCardinality", "qualifiedCardinality")]


@dataclass
class Entailed:
    """facts (s, p, o, o_kind) over representatives, literals as terms; same (node, root) of all that were merged."""

    facts: DataFrame
    same: DataFrame

    def expanded(self, facts: DataFrame | None = None) -> DataFrame:
        """The facts for every name of their subjects."""
        facts = self.facts if facts is None else facts
        names = self.same.where("node <> root").select(F.col("root").alias("s"), "node")
        return facts.unionByName(facts.join(names, "s").select(F.col("node").alias("s"), "p", "o", "o_kind"))

    def literal_columns(self, facts: DataFrame | None = None) -> DataFrame:
        """The facts with o as canonical text and o_space, the value space of literals."""
        facts = self.facts if facts is None else facts
        literal = F.col("o_kind") == "literal"
        return facts.select("s", "p", F.when(literal, literals.term_text(F.col("o"))).otherwise(F.col("o")).alias("o"), "o_kind", F.when(literal, literals.term_space(F.col("o"))).alias("o_space"))


def by_value(triples: DataFrame) -> DataFrame:
    """s, p, o, o_kind with literals as terms; o_datatype and o_lang may be missing.  All nodes are of the kind uri."""
    some = lambda c: F.col(c) if c in triples.columns else F.lit(None).cast("string")
    kind = F.when(F.col("o_kind") == "literal", "literal").otherwise("uri").alias("o_kind")
    return triples.select("s", "p", literals.term(F.col("o"), F.col("o_kind"), some("o_datatype"), some("o_lang")).alias("o"), kind)


def star(rows: DataFrame, by: list[str], node: str) -> DataFrame:
    """a, b: each member of a group of several, with the least one."""
    least = rows.groupBy(*by).agg(F.min(node).alias("a"), F.max(node).alias("z")).where("a <> z").drop("z")
    return rows.join(least, by).select("a", F.col(node).alias("b"))


def least_of_each(rows: DataFrame, by: list[str], node: str) -> DataFrame:
    """star() in one shuffle, for rows that are costly to make; a group's rows are in one task, on disk if they are many."""
    return rows.select(F.min(node).over(Window.partitionBy(*by)).alias("a"), F.col(node).alias("b")).where("a <> b")


def _axioms(t: DataFrame) -> dict[str, DataFrame]:
    """functional, inverse_functional (p); limited (node, p, filler or null); keys (key, pos, p, n) and their key_classes (o, key, n)."""
    kinds = [v.OWL + "FunctionalProperty", v.OWL + "InverseFunctionalProperty"]
    stated = [v.FIRST, v.REST] + [v.OWL + x for x in ("onProperty", "onClass", "hasKey")] + _LIMITS + _QUALIFIED
    a = settled(t.where(F.col("p").isin(*stated) | (F.col("p") == v.TYPE) & F.col("o").isin(*kinds)).distinct())
    counts = {r[0]: r[1] for r in a.groupBy(F.when(F.col("p") == v.TYPE, F.col("o")).otherwise(F.col("p"))).count().collect()}
    hinted = F.broadcast if sum(counts.values()) <= closure.BROADCAST_ROWS else lambda d: d
    kind = lambda k: a.where((F.col("p") == v.TYPE) & (F.col("o") == k)).select(F.col("s").alias("p")).distinct()
    of = lambda p, name: a.where(F.col("p") == v.OWL + p).select(F.col("s").alias("node"), F.col("o").alias(name))
    one = lambda limits: a.where(F.col("p").isin(*limits) & (F.col("o") == _ONE)).select(F.col("s").alias("node")).distinct()
    plain = one(_LIMITS).join(of("onProperty", "p"), "node").withColumn("filler", F.lit(None).cast("string"))
    within = one(_QUALIFIED).join(of("onProperty", "p"), "node").join(of("onClass", "filler"), "node")
    within = within.withColumn("filler", F.when(F.col("filler") != v.THING, F.col("filler")))
    out = {}
    if kinds[0] in counts:
        out["functional"] = hinted(kind(kinds[0]))
    if kinds[1] in counts:
        out["inverse_functional"] = hinted(kind(kinds[1]))
    if counts.keys() & {*_LIMITS, *_QUALIFIED}:
        out["limited"] = hinted(plain.unionByName(within))
    if v.OWL + "hasKey" in counts:
        heads = a.where(F.col("p") == v.OWL + "hasKey").select(F.col("s").alias("cls"), F.col("o").alias("head"))
        parts = heads.join(list_members(a), "head").select("cls", "head", "pos", F.col("member").alias("p"))
        numbered = parts.groupBy("cls", "head").agg(F.count(F.lit(1)).alias("n")).withColumn("key", F.dense_rank().over(Window.orderBy("cls", "head")))  # rows of the ontology
        keys = settled(parts.join(numbered, ["cls", "head"]))
        out["keys"] = hinted(keys.select("p", "key", "pos", "n"))
        out["key_classes"] = hinted(keys.select(F.col("cls").alias("o"), "key", "n").distinct())
    return out


def key_signatures(facts: DataFrame, keys: DataFrame, classes: DataFrame) -> DataFrame:
    """s, key, signature: what the individuals of a key's class have for all its properties.

    With several values of a property an individual has a signature for each
    combination; without any value of one it has none.  Values and types meet in
    one shuffle by individual; facts may be there several times.
    """
    values = facts.join(keys, "p").select("s", "key", "n", "pos", "o")
    types = facts.where(F.col("p") == v.TYPE).join(classes, "o").select("s", "key", "n", F.lit(-1).alias("pos"), F.lit("").alias("o"))
    own = values.unionByName(types).repartition("s", "key").groupBy("s", "key", "n").agg(F.array_sort(F.collect_set(F.struct("pos", "o"))).alias("x")).where("x[0].pos = -1")
    places = F.array_remove(F.array_distinct(F.col("x.pos")), -1)
    os = F.transform(places, lambda i: F.transform(F.filter("x", lambda e: e["pos"] == i), lambda e: e["o"]))
    whole = own.select("s", "key", "n", os.alias("os")).where(F.size("os") == F.col("n"))
    part = lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x)
    combined = F.aggregate("os", F.array(F.lit("")), lambda acc, os: F.flatten(F.transform(acc, lambda a: F.transform(os, lambda o: F.concat(a, part(o))))))
    return whole.select("s", "key", F.explode(combined).alias("signature"))


def same_pairs(facts: DataFrame, axioms: dict[str, DataFrame]) -> DataFrame:
    """a, b: nodes that the facts make the same (eq, prp-fp, prp-ifp, cls-maxc2, cls-maxqc3/4, prp-key)."""
    things = facts.where("o_kind <> 'literal'")
    found = [things.where(F.col("p") == SAME).select(F.col("s").alias("a"), F.col("o").alias("b"))]
    if "functional" in axioms:
        found.append(star(things.join(axioms["functional"], "p", "left_semi"), ["s", "p"], "o"))
    if "inverse_functional" in axioms:
        found.append(star(facts.join(axioms["inverse_functional"], "p", "left_semi"), ["o", "p"], "s"))
    if "limited" in axioms:
        types = facts.where(F.col("p") == v.TYPE)
        bound = types.select("s", F.col("o").alias("node")).join(axioms["limited"], "node")
        links = things.join(bound, ["s", "p"]).select("s", "p", "node", "filler", "o")
        members = links.where("filler is not null").join(types.select(F.col("s").alias("o"), F.col("o").alias("filler")), ["o", "filler"], "left_semi")
        found.append(star(links.where("filler is null").unionByName(members.select(*links.columns)), ["s", "p", "node"], "o"))
    if "keys" in axioms:
        found.append(least_of_each(key_signatures(facts, axioms["keys"], axioms["key_classes"]), ["key", "signature"], "s"))
    pairs = reduce(DataFrame.unionByName, found).where("a <> b")
    return pairs.distinct() if axioms.keys() - {"keys", "key_classes"} else pairs


def _merged(pairs: DataFrame) -> DataFrame:
    """node, root of the groups that pairs form, without the roots themselves; a group's root is its least IRI, or its least blank node if it has none.

    Pairs that lead to such roots already, as those of one key mostly do, are the groups; others go through rounds.
    """
    ranked = lambda c: F.concat(F.when(F.startswith(c, F.lit("_:")), "1").otherwise("0"), F.col(c)).alias(c)
    plain = lambda c: F.substring(c, F.lit(2), F.length(c))
    edges = pairs.select(ranked("a"), ranked("b"))
    if closure.disjoint_stars(edges):
        return settled(edges.select(plain(F.greatest("a", "b")).alias("node"), plain(F.least("a", "b")).alias("root")), "zstd")
    groups = closure.equivalence_groups(edges)
    return settled(groups.where("node <> root").select(plain("node").alias("node"), plain("root").alias("root")), "zstd")


def _rewritten(known: DataFrame, names: DataFrame, few: bool, looked_at: DataFrame | None) -> tuple[DataFrame, bool]:
    """The facts with merged nodes replaced, and `_state`; and whether objects were replaced.

    `_state` is 2 where a node was replaced (or the fact is looked at again), 1
    where the subject has got further names, else 0.  Facts are shuffled by
    subject, and by object only if objects are merged: which ones are is found
    from the distinct objects.
    """
    objects = known.where("o_kind <> 'literal'").select(F.col("o").alias("node")).distinct()
    objects = closure.hinted(settled(names.join(objects, "node", "left_semi"), "zstd"))
    touched = names.unionByName(names.select("root", F.col("root").alias("node")).distinct()).select(F.col("node").alias("s"), F.col("root").alias("_s"))
    out = known.join(F.broadcast(touched) if few else touched, "s", "left")
    state = F.when(F.col("_s") != F.col("s"), 2).when(F.col("_s").isNotNull(), 1).otherwise(0)
    out = out.select(F.coalesce("_s", "s").alias("s"), "p", "o", "o_kind", state.alias("_state"))
    if objects is not None:
        out = out.join(objects.select(F.col("node").alias("o"), F.col("root").alias("_o")), "o", "left")
        out = out.select("s", "p", F.coalesce("_o", "o").alias("o"), "o_kind", F.when(F.col("_o").isNotNull(), 2).otherwise(F.col("_state")).alias("_state"))
    out = out.where(~((F.col("p") == SAME) & (F.col("s") == F.col("o"))))
    if looked_at is not None:
        out = out.join(looked_at, ["p", "o"], "left").select("s", "p", "o", "o_kind", F.when(F.col("_asked"), 2).otherwise(F.col("_state")).alias("_state"))
    return out, objects is not None


def _renamed(df: DataFrame, names: DataFrame, *columns: str) -> DataFrame:
    """df with the merged nodes of some columns replaced, and `_moved`: whether any was."""
    moved = F.lit(False)
    for c in columns:
        df = df.join(names.select(F.col("node").alias(c), F.col("root").alias(f"_{c}")), c, "left")
        moved = moved | F.col(f"_{c}").isNotNull()
    df = df.withColumn("_moved", moved)
    for c in columns:
        df = df.withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return df


def entail(triples: DataFrame, most_rounds: int = 1000) -> Entailed:
    """What OWL 2 RL derives from a graph, with equality.

    Individuals become the same by owl:sameAs, functional and inverse-functional
    properties, maximum cardinalities of one (also qualified) and keys; what is
    the same has all facts of each other.  Facts are over one representative of
    each group.  Classes and properties are not merged.
    """
    spark, closed = triples.sparkSession, Parts("zstd")
    t = closed.add(by_value(triples))
    sch, axioms = closure.schema_tables(t), _axioms(t)
    several = not sch and "limited" not in axioms  # no rule joins facts with facts: they may be there several times until the end
    if not several:
        stated, closed = closed, Parts("zstd")
        t = closed.add(t.distinct())
        stated.drop()
    written = "one_of" not in sch  # the facts are the first part themselves
    closed, seed, same = closed if written else Parts("zstd"), closure.with_members(t, sch), None
    for _ in range(most_rounds):
        known = closure.fixpoint(seed, closure.rules(sch), closed=closed, settled_seed=written)
        written = False
        release(spark)
        pairs = settled(same_pairs(closure.without_partial(known, sch), axioms), "zstd")
        if pairs.isEmpty():
            break
        release(spark)
        names = _merged(pairs)
        few = names.count() <= closure.BROADCAST_ROWS // 2
        renamed = F.broadcast(names) if few else names
        # merged nodes are replaced in the schema's individuals, in the earlier representatives, and in the facts
        looked_at = None
        for name, column in (("has", "filler"), ("one_of", "s")):
            if name in sch:
                table = settled(_renamed(sch[name], renamed, column))
                sch[name] = closure.small(table.drop("_moved"))
                if name == "has":  # links to a value that has a new name count as new
                    looked_at = table.where("_moved").select(F.col("prop").alias("p"), F.col("filler").alias("o"), F.lit(True).alias("_asked")).distinct()
        same = names if same is None else settled(_renamed(same, renamed, "root").select("node", "root").unionByName(names), "zstd")
        rewritten, by_object = _rewritten(known, names, few, looked_at)
        rewritten = settled(rewritten, "zstd")
        closed.drop()
        release(spark)
        kept = rewritten.where("_state < 2").drop("_state")
        seed = closure.with_members(rewritten.where("_state = 2").drop("_state"), sch)
        if by_object or "one_of" in sch:
            seed = settled(seed.distinct(), "zstd")
            near = closure.small(seed.select("s"))  # only facts of the same subjects can be known
            beside = kept if near is None else kept.join(near, "s", "left_semi").select(*kept.columns)
        else:  # and these have got further names
            beside = rewritten.where("_state = 1").drop("_state")
        old = seed.withColumn("_new", F.lit(True)).unionByName(beside.withColumn("_new", F.lit(False)))
        seed = settled(old.groupBy(*kept.columns).agg(F.min("_new").alias("_new")).where("_new").drop("_new"), "zstd")
        release(spark)
        if seed.isEmpty():  # all that is kept was known, and its pairs are merged
            known = kept
            break
        closed = Parts("zstd")
        closed.add(kept)
    else:
        raise RuntimeError(f"no fix-point after {most_rounds} mergers")
    if same is None:
        same = t.select(F.col("s").alias("node"), F.col("s").alias("root")).limit(0)
    roots = same.select(F.col("root").alias("node"), "root").distinct()
    facts = closure.without_partial(known, sch).where(F.col("p") != SAME)
    return Entailed(facts.distinct() if several else facts, same.unionByName(roots))
