"""Contradictions in instance data, as rows of issues.

The checks are grouped aggregates and semi-joins over any subject, property
and value columns, so they run on triples and, without making IRIs first, on
the key columns of tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright.functions import literals
from graphwright.functions import vocab as v
from graphwright.functions.terms import local_name
from graphwright.operators import closure
from graphwright.operators import equality as equality_of
from graphwright.operators.tbox import list_members
from graphwright.plans.tables import settled

ISSUES = "type string, subject string, property string, classes array<string>, values array<string>, message string"


def functional_violations(df: DataFrame, subject: list[str], value: str, count: str = "n_values") -> DataFrame:
    """Subjects with more than one distinct value.

    Subject and value pairs are made distinct map-side before they are counted,
    so a subject with many repeats of few values is no hot key.
    """
    pairs = df.where(F.col(value).isNotNull()).groupBy(*subject, value).agg(F.count(F.lit(1)).alias("_n"))
    return pairs.groupBy(*subject).agg(F.count(F.lit(1)).alias(count)).where(F.col(count) > 1)


def cardinality_violations(df: DataFrame, subject: list[str], most: int, count: str = "n_values") -> DataFrame:
    """Closed world: subjects with more than `most` rows."""
    return df.groupBy(*subject).agg(F.count(F.lit(1)).alias(count)).where(F.col(count) > most)


def missing(subjects: DataFrame, having: DataFrame, key: str, other: str) -> DataFrame:
    """Closed world: subjects without any row in `having`."""
    return subjects.join(having.select(F.col(other).alias(key)), key, "left_anti")


def disjoint_members(types: DataFrame, pairs: DataFrame, subject: str, cls: str) -> DataFrame:
    """subject, a, b for subjects in both classes of a disjoint pair (a < b).

    Only types in some pair take part; a subject meets its own types by an
    equi-join through the pair table, not by pairing all its types.
    """
    p = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    held = types.select(subject, F.col(cls).alias("c")).distinct()
    left = held.select(subject, F.col("c").alias("a")).join(p, "a")
    return left.join(held.select(subject, F.col("c").alias("b")), [subject, "b"]).select(subject, "a", "b")


def disjoint_pairs(t: DataFrame) -> DataFrame:
    """a, b of owl:disjointWith."""
    direct = t.where(F.col("p") == v.OWL + "disjointWith").select(F.col("s").alias("a"), F.col("o").alias("b"))
    return direct.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def listed_members(t: DataFrame, kind: str, *links: str) -> DataFrame | None:
    """head, member of the lists of a kind of axiom (owl:AllDisjointClasses, owl:AllDifferent); None if there is none."""
    groups = t.where((F.col("p") == v.TYPE) & (F.col("o") == v.OWL + kind)).select(F.col("s").alias("g"))
    if groups.isEmpty():
        return None
    heads = t.where(F.col("p").isin(*[v.OWL + x for x in links])).select(F.col("s").alias("g"), F.col("o").alias("head"))
    return groups.join(heads, "g").join(list_members(t), "head").select("head", "member").distinct()


def members_of_several(held: DataFrame, groups: DataFrame, subject: str, cls: str) -> DataFrame:
    """subject, a, b (a < b) for subjects that hold several members of one list (head, member).

    What a subject holds of a list is counted first, by the least and the
    greatest; pairs are made of offenders' own members only, so a list of n
    classes costs n rows and not n squared.
    """
    own = held.select(subject, F.col(cls).alias("member")).join(groups, "member")
    several = own.groupBy(subject, "head").agg(F.min("member").alias("_a"), F.max("member").alias("_z")).where("_a <> _z").select(subject, "head")
    sets = own.join(several, [subject, "head"]).groupBy(subject, "head").agg(F.array_sort(F.collect_set("member")).alias("m"))
    first = sets.select(subject, "m", F.posexplode("m").alias("i", "a"))
    return first.select(subject, "a", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("b")).distinct()


def _issue(df: DataFrame, kind: str, subject: Column, message: Column, prop: Column | None = None, classes: Column | None = None, values: Column | None = None) -> DataFrame:
    texts = lambda c: (c if c is not None else F.lit(None)).cast("array<string>")
    return df.select(
        F.lit(kind).alias("type"), subject.cast("string").alias("subject"), (prop if prop is not None else F.lit(None)).cast("string").alias("property"),
        texts(classes).alias("classes"), texts(values).alias("values"), message.alias("message"),
    )


def check(tbox: DataFrame, abox: DataFrame, reason: bool = True, equality: bool = False) -> DataFrame:
    """Issues of T-box and A-box together: owl:Nothing, disjoint and complementary classes, functional, irreflexive,
    asymmetric and disjoint properties, and values where none is allowed.

    With `reason`, entailments count too.  An error of the reasoner is an issue.
    With `equality` too, what is the same is one individual, and literals count
    by value: several individuals of a functional property are the same and no
    violation, unless they are stated to be different; several values are one.
    Further issues are then individuals that are the same and different, texts
    that are no value of their datatype, values outside a property's datatype,
    negative statements that hold, and values beyond a qualified maximum of 0.
    """
    columns = ["s", "s_kind", "p", "o", "o_kind"]
    if equality:
        typed_columns = ["o_datatype", "o_lang"]
        more = lambda d: d.withColumns({c: F.lit(None).cast("string") for c in typed_columns if c not in d.columns})
        tbox, abox, columns = more(tbox), more(abox), [*columns, *typed_columns]
    t = settled(tbox.select(*columns).unionByName(abox.select(*columns)).distinct())
    facts, issues, entailed = t, [], None
    if reason:
        try:
            if equality:
                entailed = equality_of.entail(t)
                facts = settled(entailed.facts)
            else:
                facts = closure.owl_rl(t)
        except Exception as e:  # noqa: BLE001 - reported as an issue
            rows = t.sparkSession.createDataFrame([(str(e),)], "m string")
            issues.append(_issue(rows, "reasoning_error", F.lit(None), F.concat(F.lit("Reasoner error: "), "m")))
    elif equality:
        facts = equality_of.by_value(t)
    facts = facts.select("s", "p", "o", "o_kind")
    shown = literals.term_text if equality else lambda c: c
    whole = facts if equality else t  # the axioms, over representatives if there are any
    kinds = [v.OWL + k for k in ("FunctionalProperty", "IrreflexiveProperty", "AsymmetricProperty", "AllDisjointClasses", "AllDifferent")]
    stated = [v.FIRST, v.REST] + [v.OWL + p for p in ("disjointWith", "members", "distinctMembers", "complementOf", "propertyDisjointWith", "maxCardinality", "maxQualifiedCardinality", "onProperty", "onClass")]
    axioms = settled(whole.where(F.col("p").isin(*stated) | (F.col("p") == v.TYPE) & F.col("o").isin(*kinds)))
    named = whole.where((F.col("p") == v.TYPE) & (F.col("o") == v.NAMED)).select("s").distinct()
    typed = facts.where(F.col("p") == v.TYPE)
    nothing = typed.where((F.col("o") == v.NOTHING) & ~F.startswith("s", F.lit("_:")))
    issues.append(_issue(nothing, "nothing_instance", F.col("s"), F.concat(F.lit("Individual "), local_name("s"), F.lit(" is typed as owl:Nothing"))))
    types = typed.where(~F.col("o").isin(v.NAMED, v.THING)).join(named, "s", "left_semi")
    both = disjoint_members(types, disjoint_pairs(axioms), "s", "o")
    groups = listed_members(axioms, "AllDisjointClasses", "members")
    if groups is not None:
        both = both.unionByName(members_of_several(types, groups, "s", "o")).distinct()
    text = F.concat(F.lit("Individual "), local_name("s"), F.lit(" belongs to disjoint classes: "), local_name("a"), F.lit(" and "), local_name("b"))
    issues.append(_issue(both, "disjoint_violation", F.col("s"), text, classes=F.array("a", "b")))
    kind = lambda k: axioms.where((F.col("p") == v.TYPE) & (F.col("o") == v.OWL + k)).select(F.col("s").alias("p")).distinct()
    own = facts.join(kind("FunctionalProperty"), "p", "left_semi")
    many = own.groupBy("s", "p").agg(F.array_sort(F.collect_set(shown(F.col("o")))).alias("os"), F.count_distinct("o").alias("n")).where("n > 1")
    text = F.concat(F.lit("Functional property "), local_name("p"), F.lit(" has "), F.col("n").cast("string"), F.lit(" values for "), local_name("s"))
    issues.append(_issue(many, "functional_violation", F.col("s"), text, F.col("p"), values=F.col("os")))
    self_links = facts.join(kind("IrreflexiveProperty"), "p", "left_semi").where("s = o")
    issues.append(_issue(self_links, "irreflexive_violation", F.col("s"), F.concat(F.lit("Irreflexive property "), local_name("p"), F.lit(" links "), local_name("s"), F.lit(" to itself")), F.col("p")))
    one_way = facts.join(kind("AsymmetricProperty"), "p", "left_semi")
    back = one_way.where("s < o").join(one_way.select(F.col("o").alias("s"), "p", F.col("s").alias("o")), ["s", "p", "o"])
    issues.append(_issue(back, "asymmetric_violation", F.col("s"), F.concat(F.lit("Asymmetric property "), local_name("p"), F.lit(" holds both ways for "), local_name("s")), F.col("p"), values=F.array("o")))
    apart = axioms.where(F.col("p") == v.OWL + "complementOf").select(F.col("s").alias("a"), F.col("o").alias("b"))
    both = disjoint_members(typed.select("s", "o"), apart, "s", "o")
    text = F.concat(F.lit("Individual "), local_name("s"), F.lit(" belongs to a class and its complement: "), local_name("a"), F.lit(" and "), local_name("b"))
    issues.append(_issue(both, "complement_violation", F.col("s"), text, classes=F.array("a", "b")))
    pairs = axioms.where(F.col("p") == v.OWL + "propertyDisjointWith").select(F.least("s", "o").alias("p"), F.greatest("s", "o").alias("q")).distinct()
    held = facts.select("s", "p", "o")
    twice = held.join(pairs, "p").join(held.select("s", F.col("p").alias("q"), "o"), ["s", "q", "o"])
    text = F.concat(F.lit("Disjoint properties "), local_name("p"), F.lit(" and "), local_name("q"), F.lit(" both link "), local_name("s"), F.lit(" to "), local_name(shown(F.col("o"))))
    issues.append(_issue(twice, "disjoint_property_violation", F.col("s"), text, F.col("p"), values=F.array(shown(F.col("o")))))
    zero = '"0"^^decimal' if equality else "0"
    on = axioms.where(F.col("p") == v.OWL + "onProperty").select(F.col("s").alias("node"), F.col("o").alias("p"))
    none = axioms.where((F.col("p") == v.OWL + "maxCardinality") & (F.col("o") == zero)).select(F.col("s").alias("node")).join(on, "node")
    bound = typed.select("s", F.col("o").alias("node"))
    some = bound.join(none, "node").select("s", "p").distinct().join(held, ["s", "p"])
    text = F.concat(F.lit("Property "), local_name("p"), F.lit(" may have no value but has one for "), local_name("s"))
    issues.append(_issue(some.select("s", "p").distinct(), "max_cardinality_violation", F.col("s"), text, F.col("p")))
    if equality:
        of_class = axioms.where(F.col("p") == v.OWL + "onClass").select(F.col("s").alias("node"), F.col("o").alias("filler"))
        none = axioms.where((F.col("p") == v.OWL + "maxQualifiedCardinality") & (F.col("o") == zero)).select(F.col("s").alias("node")).join(on, "node").join(of_class, "node")
        values = bound.join(none, "node").join(held, ["s", "p"]).select("s", "p", "filler", "o")
        within = values.where(F.col("filler") == v.THING).unionByName(values.join(typed.select(F.col("s").alias("o"), F.col("o").alias("filler")), ["o", "filler"], "left_semi").select(*values.columns))
        issues.append(_issue(within.select("s", "p").distinct(), "max_cardinality_violation", F.col("s"), text, F.col("p")))
        issues += _by_value_issues(t, facts, axioms, entailed)
    return reduce(DataFrame.unionByName, issues)


def _by_value_issues(t: DataFrame, facts: DataFrame, axioms: DataFrame, entailed: equality_of.Entailed | None) -> list[DataFrame]:
    """Contradictions that need equality or values: eq-diff1 to 3, dt-not-type, datatype ranges, prp-npa1/2."""
    out = []
    different = facts.where((F.col("p") == v.OWL + "differentFrom") & (F.col("s") == F.col("o"))).select("s")
    listed = listed_members(t.where(F.col("p").isin(v.FIRST, v.REST, v.OWL + "members", v.OWL + "distinctMembers") | (F.col("p") == v.TYPE) & (F.col("o") == v.OWL + "AllDifferent")), "AllDifferent", "members", "distinctMembers")
    if listed is not None and entailed is not None:  # members by the names they have in the list, counted by representative
        roots = listed.join(entailed.same.withColumnRenamed("node", "member"), "member")
        different = different.unionByName(roots.groupBy("head", "root").agg(F.min("member").alias("_a"), F.max("member").alias("_z")).where("_a <> _z").select(F.col("root").alias("s")))
    text = F.concat(F.lit("Individual "), local_name("s"), F.lit(" is the same as one that it is different from"))
    out.append(_issue(different.distinct(), "different_violation", F.col("s"), text))
    literal = facts.where("o_kind = 'literal'")
    space, value = literals.term_space(F.col("o")), literals.term_text(F.col("o"))
    wrong = literal.where(F.startswith(space, F.lit("!"))).select("s", "p", value.alias("text"), F.substring(space, F.lit(2), F.length("o")).alias("datatype"))
    text = F.concat(F.lit("'"), F.col("text"), F.lit("' is no "), local_name("datatype"), F.lit(" ("), local_name("p"), F.lit(" of "), local_name("s"), F.lit(")"))
    out.append(_issue(wrong, "literal_violation", F.col("s"), text, F.col("p"), values=F.array("text")))
    ranges = facts.where((F.col("p") == v.RANGE) & F.startswith("o", F.lit(v.XSD))).select(F.col("s").alias("p"), F.col("o").alias("datatype"))
    outside = literal.where(~F.startswith(space, F.lit("!"))).join(ranges, "p").where(~literals.holds(F.col("o"), F.col("datatype")))
    text = F.concat(F.lit("Value '"), value, F.lit("' of "), local_name("p"), F.lit(" for "), local_name("s"), F.lit(" is no "), local_name("datatype"))
    out.append(_issue(outside, "range_violation", F.col("s"), text, F.col("p"), values=F.array(value)))
    part = lambda p, name: facts.where(F.col("p").isin(*[v.OWL + x for x in p])).select(F.col("s").alias("node"), F.col("o").alias(name))
    denied = part(["sourceIndividual"], "s").join(part(["assertionProperty"], "p"), "node").join(part(["targetIndividual", "targetValue"], "o"), "node")
    held = denied.join(facts.select("s", "p", "o"), ["s", "p", "o"], "left_semi")
    text = F.concat(F.lit("What is denied holds: "), local_name("p"), F.lit(" of "), local_name("s"))
    out.append(_issue(held, "negative_assertion_violation", F.col("s"), text, F.col("p"), values=F.array(literals.term_text(F.col("o")))))
    return out


def report(issues: DataFrame, most: int = 20) -> str:
    """Counts by type and the first messages of each, picked map-side; there are about ten types."""
    issues = settled(issues)
    counts = {r["type"]: r["n"] for r in issues.groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy("type").collect()}
    if not counts:
        return "A-box validation: consistent\n"
    out = [f"A-box validation: {sum(counts.values())} issues"]
    for kind, n in counts.items():
        first = issues.where(F.col("type") == kind).select("message").orderBy("message").limit(most).collect()
        out += ["", f"{kind} ({n})", *[f"  - {r['message']}" for r in first]]
    return "\n".join(out) + "\n"
