"""Entailment with equality, chains, keys and values."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from graphwright.functions import literals
from graphwright.functions import vocab as v
from graphwright.operators import closure, consistency, equality
from graphwright.sources.rdf import from_string

HEAD = f"@prefix : <http://p.org/x#> . @prefix owl: <{v.OWL}> . @prefix rdfs: <{v.RDFS}> . @prefix xsd: <{v.XSD}> .\n"


def read(spark, text):
    return from_string(spark, HEAD + text, "turtle")


def short(x):
    return x.split("#")[-1] if x.startswith("http") else x


def groups(found):
    out = {}
    for r in found.same.collect():
        out.setdefault(short(r["root"]), set()).add(short(r["node"]))
    return out


def facts(df):
    return {tuple(short(r[c]) for c in "spo") for r in df.collect()}


def test_merging_runs_through_rules(spark):
    """A functional value merges a and b; their types meet in an intersection, which limits a property, which merges again."""
    t = read(spark, """
:of a owl:FunctionalProperty . :x :of :a , :b . :a a :Left . :b a :Right ; :near :m , :n .
:Both owl:intersectionOf ( :Left :Right ) . :Both rdfs:subClassOf [ owl:onProperty :near ; owl:maxCardinality "01"^^xsd:nonNegativeInteger ] .
:n :colour :red . :m a :Thing1 . :y owl:sameAs :z . :z owl:sameAs :w . :w a :Late .""")
    e = equality.entail(t)
    assert groups(e) == {"a": {"a", "b"}, "m": {"m", "n"}, "w": {"w", "y", "z"}}
    got = facts(e.facts)
    assert {("a", "type", "Both"), ("m", "colour", "red"), ("a", "near", "m"), ("w", "type", "Late")} <= got and not any(s in ("b", "n", "y", "z") for s, _, _ in got)
    assert {("b", "type", "Both"), ("n", "type", "Thing1"), ("y", "type", "Late")} <= facts(e.expanded())
    # without the merger the type is not found
    assert ("b", "type", "Both") not in facts(closure.owl_rl(t))


def test_merged_individuals_of_the_schema(spark):
    t = read(spark, ":a owl:sameAs :b . :Has owl:onProperty :p ; owl:hasValue :b . :x :p :a . :y a :Has . :One owl:oneOf ( :b :c ) . _:n owl:sameAs :z . :z a :Q .")
    e = equality.entail(t)
    assert {("x", "type", "Has"), ("y", "p", "a"), ("a", "type", "One"), ("z", "type", "Q")} <= facts(e.facts)
    assert groups(e)["z"] >= {"z"}


def test_chains_of_any_length(spark):
    t = read(spark, """:far owl:propertyChainAxiom ( :p :q :r :s ) . :mid owl:propertyChainAxiom ( :p :q :r ) . :one owl:propertyChainAxiom ( :p ) . :up owl:propertyChainAxiom ( :up :p ) . :two owl:propertyChainAxiom ( [ owl:inverseOf :p ] :q2 ) .
:a :p :b . :b :q :c . :c :r :d . :d :s :e . :d :s :f . :z :up :a . :a :q2 :k .""")
    got = {x for x in facts(closure.owl_rl(t)) if x[1] in ("far", "mid", "one", "up", "two") or "chain" in x[1]}
    assert got == {("a", "far", "e"), ("a", "far", "f"), ("a", "mid", "d"), ("a", "one", "b"), ("z", "up", "a"), ("z", "up", "b"), ("b", "two", "k"), *{x for x in facts(t) if x[1] in ("far", "mid", "one", "up", "two")}}


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(f"n{rng.randrange(9)}", rng.choice("pqr"), f"n{rng.randrange(9)}") for _ in range(30)]
    t = read(spark, ":r owl:propertyChainAxiom ( :p :q ) . :w owl:propertyChainAxiom ( :r :r :p ) .\n" + "\n".join(f":{s} :{p} :{o} ." for s, p, o in rows))
    want = set(rows)
    while True:
        by = lambda p: [(s, o) for s, x, o in want if x == p]
        more = {(a, "r", d) for a, b in by("p") for c, d in by("q") if b == c}
        more |= {(a, "w", f) for a, b in by("r") for c, d in by("r") if b == c for e, f in by("p") if d == e}
        if more <= want:
            break
        want |= more
    assert {x for x in facts(closure.owl_rl(t)) if x[1] in "pqrw" and x[0].startswith("n")} == want


def test_rounds_end_where_nothing_can_fire(spark, monkeypatch):
    """Each round writes a part: none is written for rules that nothing new can meet, and facts without rules are written once."""
    add, made = closure.Parts.add, []
    monkeypatch.setattr(closure.Parts, "add", lambda self, df: made.append(self) or add(self, df))
    t = read(spark, ":in owl:inverseOf :of . :sold owl:propertyChainAxiom ( :in :by :at ) . :l :of :p . :l :by :c . :c :at :n .")
    sch = closure.schema_tables(t)
    made.clear()
    got = facts(closure.owl_rl(t, sch))
    assert {("p", "in", "l"), ("p", "sold", "n")} <= got and len(got) == t.count() + 2
    assert len(made) == 4  # the facts, :in, the first two of the chain, :sold
    plain = read(spark, ":a :p :b . :b a :C . :a :q 1 .")
    sch = closure.schema_tables(plain)
    made.clear()
    assert closure.owl_rl(plain, sch).count() == 3 and len(made) == 1
    # kinds of rules that predicates do not tell apart
    some = read(spark, ":R owl:onProperty :p ; owl:someValuesFrom :C . :a :p :b . :b a :C .")
    assert ("a", "type", "R") in facts(closure.owl_rl(some))
    assert closure.reach({"some": some})({"p"}, {"p"}) is None


def test_keys_and_qualified_maxima(spark):
    t = read(spark, """:Line owl:hasKey ( :order :number ) .
:a a :Line ; :order :o1 ; :number "1"^^xsd:int . :b a :Line ; :order :o1 ; :number "01.0"^^xsd:decimal . :c a :Line ; :order :o2 ; :number 1 . :d a :Line ; :order :o1 . :e :order :o1 ; :number 1 .
:f a :Line ; :order :o2 , :o3 ; :number 1 . :o3 owl:sameAs :o4 . :g a :Line ; :order :o4 ; :number 1 .
:Small rdfs:subClassOf [ owl:onProperty :part ; owl:maxQualifiedCardinality 1 ; owl:onClass :Wheel ] . :s a :Small ; :part :w1 , :w2 , :seat . :w1 a :Wheel . :w2 a :Wheel .""")
    assert groups(equality.entail(t)) == {"a": {"a", "b"}, "c": {"c", "f", "g"}, "o3": {"o3", "o4"}, "w1": {"w1", "w2"}}


def test_literals_by_value(spark):
    x = v.XSD
    rows = [("01", "integer", "1"), ("+1.0", "decimal", "1"), ("-0", "decimal", "0"), (".50", "decimal", "0.5"), ("5.", "decimal", "5"), ("1.0", "integer", None), ("abc", "integer", None), ("", "integer", None),
        ("300", "unsignedByte", None), ("-128", "byte", "-128"), ("128", "byte", None), ("0", "positiveInteger", None), ("9" * 50, "integer", "9" * 50), ("-1", "nonPositiveInteger", "-1"), ("0", "negativeInteger", None), ("18446744073709551616", "unsignedLong", None),
        ("1", "boolean", "true"), ("True", "boolean", None), ("1e2", "double", "100.0"), ("INF", "double", "INF"), ("Infinity", "double", None), ("NaN", "float", "NaN"), ("-0.0", "double", "0.0"),
        ("2024-01-01T01:00:00+01:00", "dateTime", "2024-01-01T00:00:00Z"), ("2024-01-01T00:00:00.500", "dateTime", "2024-01-01T00:00:00.5"), ("2024-02-30T00:00:00", "dateTime", None), ("2024-01-01T00:00:00", "dateTimeStamp", None),
        ("2024-02-29", "date", "2024-02-29"), ("2023-02-29", "date", None), ("10:00:00+02:00", "time", "08:00:00Z"), ("P1Y2M", "duration", "14M0S"), ("-PT1M", "duration", "-0M60S"), ("P", "duration", None),
        ("ab", "hexBinary", "AB"), ("abc", "hexBinary", None), (" a  b ", "token", "a b"), (" a  b ", "string", " a  b "), ("QUJD", "base64Binary", "QUJD"), ("x y", "own", "x y")]
    df = spark.createDataFrame([(a, x + b, c) for a, b, c in rows], "o string, d string, want string")
    c = literals.canonical(F.col("o"), F.col("d"))
    wrong = df.withColumn("c", c).where(~F.col("c.value").eqNullSafe(F.col("want"))).collect()
    assert not wrong
    plain = spark.createDataFrame([("a\nb \"^^ c", None, None), ("a", None, "EN"), (None, None, None)], "o string, d string, l string")
    t = literals.term(F.col("o"), F.lit("literal"), F.col("d"), F.col("l"))
    got = [(r["x"], r["s"]) for r in plain.select(literals.term_text(t).alias("x"), literals.term_space(t).alias("s")).collect()]
    assert got == [("a\nb \"^^ c", "string"), ("a", "@en"), (None, None)]


def test_contradictions_with_equality(spark):
    t = read(spark, """:f a owl:FunctionalProperty . :g a owl:FunctionalProperty . :n rdfs:range xsd:integer . :C owl:disjointWith :D . :Car rdfs:subClassOf [ owl:onProperty :part ; owl:maxQualifiedCardinality 0 ; owl:onClass :Wing ] .
[] a owl:AllDifferent ; owl:distinctMembers ( :p :q :r ) .""")
    a = read(spark, """:x a owl:NamedIndividual , :C ; :f :y , :z ; :g "1"^^xsd:int , "1.0"^^xsd:decimal . :w :g 1 , 2 . :y a owl:NamedIndividual , :C . :z a owl:NamedIndividual , :D .
:k :f :l , :m . :l owl:differentFrom :m . :i :n "x" , 4.0 , 4.5 , "no"^^xsd:integer . :o :f :p , :q .
:car a :Car ; :part :wing . :wing a :Wing . [] owl:sourceIndividual :x ; owl:assertionProperty :f ; owl:targetIndividual :z .""")
    got = sorted((r["type"], short(r["subject"])) for r in consistency.check(t, a, equality=True).collect())
    assert got == [("different_violation", "l"), ("different_violation", "p"), ("disjoint_violation", "y"), ("functional_violation", "w"), ("literal_violation", "i"), ("max_cardinality_violation", "car"), ("negative_assertion_violation", "x"), ("range_violation", "i"), ("range_violation", "i")]


def test_groups_without_pairs(spark):
    cells = "".join(f":A{i} " for i in range(40))
    t = read(spark, f"[] a owl:AllDisjointClasses ; owl:members ( {cells}) .")
    a = read(spark, ":x a owl:NamedIndividual , :A1 , :A7 , :A30 , :Z . :y a owl:NamedIndividual , :A5 . :z a owl:NamedIndividual , :A3 , :A3 .")
    got = sorted((short(r["subject"]), *map(short, r["classes"])) for r in consistency.check(t, a, reason=False).collect())
    assert got == [("x", "A1", "A30"), ("x", "A1", "A7"), ("x", "A30", "A7")]


def test_equality_of_nothing(spark):
    empty = read(spark, "").limit(0)
    e = equality.entail(empty)
    assert e.facts.isEmpty() and e.same.isEmpty()
    assert consistency.check(empty, empty, equality=True).isEmpty()


def test_merged_facts_that_are_known(spark, monkeypatch):
    """Groups of one key are stars and need no rounds, and facts that their roots have already end the job."""
    calls = []
    for module, name in ((equality, "same_pairs"), (closure, "equivalence_groups")):
        monkeypatch.setattr(module, name, lambda *a, _f=getattr(module, name), _n=name: calls.append(_n) or _f(*a))
    text = ":Line owl:hasKey ( :order :number ) . :a a :Line ; :order :o1 ; :number 1 . :b a :Line ; :order :o1 ; :number 1 . :c a :Line ; :order :o2 ; :number 1 . "
    t = read(spark, text)
    e = equality.entail(t.unionByName(t))
    assert groups(e) == {"a": {"a", "b"}} and calls == ["same_pairs"]
    assert sorted(r["s"] for r in e.facts.where(F.col("o").endswith("#Line")).collect()) == ["http://p.org/x#a", "http://p.org/x#c"]
    calls.clear()
    # b has a fact of its own; that a and b are the same makes their orders the same, and these make c and f the same
    more = ":b :code 7 . :Order owl:hasKey ( :line ) . :o2 a :Order ; :line :a . :o3 a :Order ; :line :b . :f a :Line ; :order :o3 ; :number 1 ."
    e = equality.entail(read(spark, text + more))
    assert groups(e) == {"a": {"a", "b"}, "o2": {"o2", "o3"}, "c": {"c", "f"}}
    assert ("a", "code", '"7"^^decimal') in facts(e.facts) and calls.count("same_pairs") > 2


@pytest.mark.parametrize("seed", [1, 2])
def test_keys_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = {(f"n{rng.randrange(14)}", rng.choice(["p", "q", "r", "f"]), f"n{rng.randrange(14)}") for _ in range(26)} | {(f"n{i}", "type", rng.choice("CD")) for i in range(14)} | {("n3", "sameAs", "n9")}
    name = {"type": "a", "sameAs": "owl:sameAs"}
    text = ":C owl:hasKey ( :p :q ) . :D owl:hasKey ( :r ) . :f a owl:FunctionalProperty .\n" + "\n".join(f":{s} {name.get(p, ':' + p)} :{o} ." for s, p, o in sorted(rows))
    root = {f"n{i}": f"n{i}" for i in range(14)}
    least = lambda a, b: min(a, b)
    while True:
        now = {(root[s], p, root.get(o, o)) for s, p, o in rows}
        of = lambda s, p: {o for x, y, o in now if (x, y) == (s, p)}
        pairs = {(root[s], root[o]) for s, p, o in rows if p == "sameAs"}
        for s in set(root.values()):
            pairs |= {(a, b) for a in of(s, "f") for b in of(s, "f")}
            for z in set(root.values()):
                both = of(s, "type") & of(z, "type")
                if "C" in both and of(s, "p") & of(z, "p") and of(s, "q") & of(z, "q") or "D" in both and of(s, "r") & of(z, "r"):
                    pairs.add((s, z))
        pairs = {(a, b) for a, b in pairs if a != b}
        if not pairs:
            break
        a, b = sorted(pairs)[0]
        root = {n: least(a, b) if r in (a, b) else r for n, r in root.items()}
    e = equality.entail(read(spark, text))
    want = {}
    for n, r in root.items():
        want.setdefault(r, set()).add(n)
    assert groups(e) == {r: m for r, m in want.items() if len(m) > 1}
    got = [(short(r["s"]), short(r["p"]), short(r["o"])) for r in e.facts.collect()]
    assert len(got) == len(set(got)) and {x for x in got if x[1] in ("p", "q", "r", "f") and x[0] != "f"} == {x for x in now if x[1] in ("p", "q", "r", "f")}
