"""Synthetic instance data that an ontology allows, the same for the same seed.

Every choice is a hash of the seed and of what it is about, so rows are made
independently, in any order and on any number of machines.  Targets are drawn
as numbers: each class knows how many individuals it has, so no table of
candidates is sorted or paired with the sources.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphwright.functions import vocab as v
from graphwright.functions.terms import contextual_text, local_name, pick_language
from graphwright.operators import rules as r
from graphwright.operators.tbox import TBox
from graphwright.plans.tables import settled

#: Words in names of properties that link structure (fixed values).
STRUCTURAL = ("part", "has", "contains", "member", "component", "composed")


#: The tables of the model that the generator reads, several times each.
_READ = ("classes", "class_super", "class_disjoint", "enum_members", "properties", "prop_domain", "prop_range", "restrictions")


class Generator:
    """Individuals, values and links.  Tables with a row per axiom, and those with a row per individual or link, are settled."""

    def __init__(self, tbox: TBox, base: str = "https://example.org", seed: int = 1) -> None:
        self.t = replace(tbox, **{name: settled(getattr(tbox, name)) for name in _READ})
        self.base, self.seed = base.rstrip("#/") + "#", seed

    def draw(self, *about: Column | str) -> Column:
        return F.xxhash64(F.lit(self.seed), *[F.lit(a) if isinstance(a, str) else a for a in about])

    def between(self, lo: Column, hi: Column, *about) -> Column:
        return (F.pmod(self.draw(*about), F.greatest(hi - lo + 1, F.lit(1))) + lo).cast("int")

    def chance(self, share: float, *about) -> Column:
        return F.pmod(self.draw(*about), F.lit(1000)) < int(1000 * share)

    def uri(self, cls: Column, i: Column) -> Column:
        return F.concat(F.lit(self.base), local_name(cls), F.lit("_"), i.cast("string"), F.lit("_"), F.substring(F.hex(self.draw("id", cls, i)), 1, 6))

    def classes(self, least: int, most: int) -> DataFrame:
        """class, label, n: concrete classes and how many individuals each gets."""
        if not 0 <= least <= most:
            raise ValueError("0 <= least <= most")
        concrete = r.concrete_classes(self.t.classes, self.t.class_super, self.t.class_disjoint, self.t.enum_members)
        rows = self.t.classes.join(concrete, "uri").select(F.col("uri").alias("class"), F.coalesce(pick_language("label", "en"), local_name("uri")).alias("label"))
        return settled(rows.withColumn("n", self.between(F.lit(least), F.lit(most), "count", F.col("class"))))

    def individuals(self, least: int = 1, most: int = 3) -> DataFrame:
        """class, i, uri, label."""
        return self._individuals(self.classes(least, most))

    def _individuals(self, counts: DataFrame) -> DataFrame:
        rows = counts.where("n > 0").withColumn("i", F.explode(F.expr("sequence(1, n)")))
        return rows.select("class", "i", self.uri(F.col("class"), F.col("i")).alias("uri"), F.concat("label", F.lit(" "), F.col("i").cast("string")).alias("label"))

    def _applicable(self, kind: str) -> DataFrame:
        """class, prop, functional, ..., min, max of the properties that apply to each class."""
        props = self.t.properties.where(F.col("kind") == kind)
        pairs = r.applicable_properties(self.t.classes, self.t.class_super, self.t.prop_domain, props, self.t.restrictions)
        rows = pairs.join(props.withColumnRenamed("uri", "prop"), "prop").join(r.effective_cardinality(self.t.restrictions), ["class", "prop"], "left")
        functional = F.coalesce("functional", F.lit(False))
        most = F.when(functional, 1).otherwise(F.col("max"))
        return settled(rows.withColumns({"min": F.coalesce("min", F.lit(0)), "max": most}))

    def _values(self, who: DataFrame) -> DataFrame:
        ranges = self.t.prop_range.groupBy("prop").agg(F.min_by("other", "ord").alias("range"))
        props = self._applicable("datatype").join(ranges, "prop", "left").select("class", "prop", "range", "min", "max")
        rows = who.join(props, "class")
        about = (F.col("uri"), F.col("prop"))
        some = (F.col("min") > 0) | self.chance(0.5, "some", *about)
        top = F.greatest(F.least(F.coalesce("max", F.lit(3)), F.lit(3)), F.col("min"))
        n = F.when(F.col("max") == 1, F.when((F.col("min") > 0) | self.chance(0.5, "one", *about), 1).otherwise(0)).otherwise(self.between(F.col("min"), top, "n", *about))
        rows = rows.where(some).withColumn("n", n).where("n > 0").withColumn("j", F.explode(F.expr("sequence(1, n)")))
        pick, kind = self.draw("value", *about, F.col("j")), F.lower(local_name("range"))
        has = lambda x: F.contains(kind, F.lit(x))
        day = F.date_sub(F.lit("2025-01-01").cast("date"), F.pmod(pick, F.lit(1826)).cast("int")).cast("string")
        clock = F.date_format(F.timestamp_seconds(F.pmod(pick, F.lit(86400))), "HH:mm:ss")
        cases = [
            (has("int"), F.pmod(pick, F.lit(100)) + 1, "integer"), (has("float") | has("double") | has("decimal"), (F.pmod(pick, F.lit(100000)) / 100).cast("decimal(10,2)"), "decimal"),
            (has("bool"), F.pmod(pick, F.lit(2)) == 1, "boolean"), (has("date") & has("time"), F.concat(day, F.lit("T"), clock), "dateTime"), (has("date"), day, "date"), (has("time"), clock, "time"),
        ]
        value, datatype = contextual_text(local_name("prop"), pick), F.lit("string")
        for test, made, name in reversed(cases):
            value, datatype = F.when(test, made.cast("string")).otherwise(value), F.when(test, F.lit(name)).otherwise(datatype)
        return rows.select(F.col("uri").alias("s"), F.col("prop").alias("p"), value.alias("o"), F.lit("literal").alias("o_kind"), F.concat(F.lit(v.XSD), datatype).alias("o_datatype"), F.lit(None).cast("string").alias("o_lang")).distinct()

    def _links(self, who: DataFrame, counts: DataFrame) -> DataFrame:
        props = self._applicable("object")
        stated = self.t.prop_range.select("prop", F.col("other").alias("type"))
        fillers = self.t.restrictions.where("filler is not null").select("prop", F.col("filler").alias("type"))
        kinds = stated.unionByName(fillers).distinct()
        below = kinds.join(self.t.class_super.select(F.col("other").alias("type"), F.col("class").alias("sub")), "type").select("prop", F.col("sub").alias("type"))
        pools = kinds.unionByName(below).distinct().join(counts.select(F.col("class").alias("type"), "n"), "type")
        w = Window.partitionBy("prop").orderBy("type")
        pools = pools.withColumn("lo", F.sum("n").over(w) - F.col("n")).groupBy("prop").agg(F.array_sort(F.collect_list(F.struct("lo", "n", "type"))).alias("pool"), F.sum("n").alias("total"))
        pools = settled(pools)
        rows = who.join(props.join(pools, "prop").where("total > 0").select("class", "prop", "functional", "inverse_functional", "irreflexive", "min", "max", "pool", "total"), "class")
        about = (F.col("uri"), F.col("prop"))
        structural = F.lower(local_name("prop")).rlike("|".join(STRUCTURAL))
        go = (F.col("min") > 0) | F.when(structural, self.chance(0.7, "some", *about)).otherwise(self.chance(0.3, "some", *about))
        cap = F.when(structural, 3).otherwise(2)
        n = F.when(F.col("max") == 1, F.when((F.col("min") > 0) | self.chance(0.7, "one", *about), 1).otherwise(0)).otherwise(
            self.between(F.greatest("min", F.lit(1)), F.greatest(F.least(F.coalesce("max", cap), cap), F.greatest("min", F.lit(1))), "n", *about)
        )
        n = F.when(F.coalesce("inverse_functional", F.lit(False)), F.least(n, F.lit(1))).otherwise(n)
        rows = rows.where(go).withColumn("k", F.least(n, F.col("total")).cast("int")).where("k > 0").withColumn("j", F.explode(F.expr("sequence(0, k - 1)")))
        number = F.pmod(self.draw("target", *about) + F.col("j"), F.col("total"))
        rows = rows.withColumn("t", number).withColumn("hit", F.expr("filter(pool, x -> t >= x.lo and t < x.lo + x.n)[0]"))
        target = self.uri(F.col("hit.type"), (F.col("t") - F.col("hit.lo") + 1).cast("int"))
        links = rows.select(F.col("uri").alias("s"), F.col("prop").alias("p"), target.alias("o"), "irreflexive", "inverse_functional")
        links = links.where(~(F.coalesce("irreflexive", F.lit(False)) & (F.col("s") == F.col("o"))))
        one = links.where(F.coalesce("inverse_functional", F.lit(False))).groupBy("p", "o").agg(F.min("s").alias("s")).select("s", "p", "o")
        return links.where(~F.coalesce("inverse_functional", F.lit(False))).select("s", "p", "o").unionByName(one)

    def _both_ways(self, links: DataFrame) -> DataFrame:
        p = self.t.properties.where("kind = 'object'")
        back = links.join(p.where("inverse_of is not null").select(F.col("uri").alias("p"), "inverse_of"), "p")
        all_links = settled(links.unionByName(back.select(F.col("o").alias("s"), F.col("inverse_of").alias("p"), F.col("s").alias("o"))).distinct())
        flags = p.select(F.col("uri").alias("p"), F.coalesce("functional", F.lit(False)).alias("f"), F.coalesce("asymmetric", F.lit(False)).alias("a"))
        rows = all_links.join(flags, "p")
        single = rows.where("f").groupBy("s", "p", "a").agg(F.min("o").alias("o"))
        rows = settled(rows.where("not f").select("s", "p", "o", "a").unionByName(single.select("s", "p", "o", "a")))
        reverse = rows.where("a").select(F.col("o").alias("s"), "p", F.col("s").alias("o"))
        kept = rows.where("not a or s < o").select("s", "p", "o").unionByName(rows.where("a and s >= o").select("s", "p", "o").join(reverse.where("s >= o"), ["s", "p", "o"], "left_anti"))
        clash = rows.where("a and s > o").select("s", "p", "o").join(reverse, ["s", "p", "o"], "left_semi")
        return kept.join(clash, ["s", "p", "o"], "left_anti").distinct()

    def generate(self, least: int = 1, most: int = 3) -> DataFrame:
        """Triples: types, labels, values and links of all individuals, and the ontology's declaration."""
        counts = self.classes(least, most)
        who, none = settled(self._individuals(counts)), F.lit(None).cast("string")
        row = lambda d, p, o, kind, dt=none, lang=none: d.select(F.col("uri").alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), dt.alias("o_datatype"), lang.alias("o_lang"))
        links = self._both_ways(settled(self._links(who, counts)))
        head = who.sparkSession.createDataFrame([(self.base.rstrip("#"),)], "uri string")
        parts = [
            row(who, v.TYPE, F.col("class"), "uri"), row(who, v.TYPE, F.lit(v.NAMED), "uri"), row(who, v.LABEL, F.col("label"), "literal", none, F.lit("en")),
            self._values(who.select("class", "uri")),
            links.select("s", "p", "o", F.lit("uri").alias("o_kind"), none.alias("o_datatype"), none.alias("o_lang")), row(head, v.TYPE, F.lit(v.ONTOLOGY), "uri"),
        ]
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out.select(F.lit(self.base).alias("graph"), "s", F.lit("uri").alias("s_kind"), "p", "o", "o_kind", "o_datatype", "o_lang", F.abs(F.xxhash64("s", "p", "o")).alias("ord"))
