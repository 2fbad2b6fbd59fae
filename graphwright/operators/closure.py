"""Fix-points: transitive closure and OWL 2 RL entailment, evaluated semi-naively.

Each round joins only what the last one found; what is new is settled in the
shared folder, so the plan does not grow with the rounds.  Schema tables are
rows of the ontology; the planner broadcasts them by their size.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphwright.functions import vocab as v
from graphwright.operators.tbox import list_members
from graphwright.plans.tables import Parts, settled


#: So many predicates at most are told apart where a round leaves out rules that nothing new can meet.
NAMED = 1000


def predicates(facts: DataFrame) -> set[str] | None:
    """The predicates of facts; None if they are more than NAMED."""
    rows = facts.select("p").distinct().limit(NAMED + 1).collect()
    return None if len(rows) > NAMED else {r["p"] for r in rows}


def fixpoint(seed: DataFrame, step: Callable[..., DataFrame], most_rounds: int = 1000, closed: Parts | None = None, settled_seed: bool = False) -> DataFrame:
    """The least set of rows with `seed` and closed under step(new, all).  A round writes what it found, and nothing again.

    `closed`, if given, has rows that are closed already and share none with
    `seed`: only what follows from the seed is worked out; the parts found are
    added to it.  With `settled_seed` the seed, distinct, is all that is in
    `closed`, and not written again.

    A step with a function `active` (rules()) says by predicates which rules can
    fire: the others are left out, what is found is compared only with known
    rows of the predicates that it may have, and no round is run for nothing.
    """
    parts = Parts() if closed is None else closed
    fresh = seed if settled_seed else parts.add(seed.distinct())
    known = parts.all(fresh)
    active = getattr(step, "active", None)
    names = active and predicates(known)
    for _ in range(most_rounds):
        may, old = None, known
        if active and (may := active(predicates(fresh), names)) is not None:
            if not may:
                return known
            made = set().union(*may.values())
            old = known.where(F.col("p").isin(*made & names))
            names = names | made
        found = (step(fresh, known) if may is None else step(fresh, known, may)).select(*known.columns).distinct()
        fresh = parts.add(found.join(old, known.columns, "left_anti"))
        if fresh.isEmpty():
            return known
        known = parts.all(fresh)
    raise RuntimeError(f"no fix-point after {most_rounds} rounds")


def transitive_closure(edges: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """All (source, target) with a path.

    Paths are doubled (new paths are joined with all known ones on both sides),
    so the rounds grow with the logarithm of the longest path.
    """
    seed = edges.select(F.col(source).alias("src"), F.col(target).alias("dst"))

    def step(new: DataFrame, known: DataFrame) -> DataFrame:
        head, tail = (lambda d: d.select("src", F.col("dst").alias("mid"))), (lambda d: d.select(F.col("src").alias("mid"), "dst"))
        return head(new).join(tail(known), "mid").unionByName(head(known).join(tail(new), "mid")).select("src", "dst")

    return fixpoint(seed, step).select(F.col("src").alias(source), F.col("dst").alias(target))


def circular(edges: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """Nodes that lie on a cycle."""
    return transitive_closure(edges, source, target).where(F.col(source) == F.col(target)).select(F.col(source).alias("node"))


def disjoint_stars(edges: DataFrame, left: str = "a", right: str = "b") -> bool:
    """Whether every edge leads to the least member of its group: each greater end is there once, and no lesser end is one.

    It reads the edges once and shuffles a count per node.  False where an edge is there twice or leads to itself.
    """
    ends = F.array(F.struct(F.least(left, right).alias("node"), F.lit(0).alias("n")), F.struct(F.greatest(left, right).alias("node"), F.lit(1).alias("n")))
    nodes = edges.select(F.explode(ends).alias("x")).groupBy("x.node").agg(F.sum("x.n").alias("n"), F.min("x.n").alias("least"))
    return nodes.where("n > 1 OR n = 1 AND least = 0").isEmpty()


def equivalence_groups(edges: DataFrame, left: str = "a", right: str = "b", most_rounds: int = 1000) -> DataFrame:
    """node, root: connected components; root is the least member.  Labels jump to their label's label each round; a round's table goes when the next is written."""
    both = settled(edges.select(F.col(left).alias("a"), F.col(right).alias("b")).unionByName(edges.select(F.col(right).alias("a"), F.col(left).alias("b"))).distinct())
    held = Parts()
    now = held.add(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"))
    for _ in range(most_rounds):
        near = both.join(now.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = now.join(near, "node").select("node", F.least("root", "near").alias("root"))
        jump = step.select(F.col("node").alias("root"), F.col("root").alias("up"))
        made = Parts()
        new = made.add(step.join(jump, "root").select("node", F.col("up").alias("root")))
        if new.join(now, ["node", "root"], "left_anti").isEmpty():
            return new
        held.drop()
        now, held = new, made
    raise RuntimeError(f"no fix-point after {most_rounds} rounds")


def strongly_connected(edges: DataFrame, source: str = "src", target: str = "dst") -> DataFrame:
    """node, root: nodes that reach each other, with the least of them; only nodes on a cycle.

    Nodes without an edge in or out are taken away first, as often as there are
    any.  Then the least name that reaches a node is carried forward; of those
    that got one name, what leads back to it is its component.  The rest goes
    round again.  Rounds grow with the longest path.
    """
    e = settled(edges.select(F.col(source).alias("src"), F.col(target).alias("dst")).where("src <> dst").distinct())
    found = Parts()
    out: DataFrame | None = None
    while True:
        left = -1
        while left != (n := e.count()):
            left = n
            e = settled(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        if not left:
            break
        colour = settled(e.select(F.col("src").alias("node")).distinct().withColumn("root", F.col("node")))
        while True:
            sent = e.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("root").alias("near"))
            new = settled(colour.join(sent, "node", "left").select("node", F.least("root", "near").alias("root"), (F.col("near") < F.col("root")).alias("changed")))
            if new.where("changed").isEmpty():
                break
            colour = new.drop("changed")
        same = settled(e.join(colour.withColumnRenamed("node", "src"), "src").join(colour.select(F.col("node").alias("dst"), F.col("root").alias("_to")), "dst").where("root = _to").select("src", "dst", "root"))
        back = fixpoint(colour.where("node = root"), lambda new, known: new.join(same.select(F.col("dst").alias("node"), "root", "src"), ["node", "root"]).select(F.col("src").alias("node"), "root"))  # noqa: B023
        out = found.add(back)
        gone = back.select(F.col("node").alias("src"))
        e = settled(e.join(gone, "src", "left_anti").join(gone.withColumnRenamed("src", "dst"), "dst", "left_anti").select("src", "dst"))
    none = e.select(F.col("src").alias("node"), F.col("src").alias("root"))
    members = none if out is None else found.all(out)
    return members.join(members.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("root"), "root", "left_semi").select("node", "root")


#: A schema table of so many rows at most is broadcast.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame | None:
    """The table, settled, with a hint to broadcast it if it is small enough; None if it is empty."""
    return hinted(settled(df.distinct()))


def hinted(kept: DataFrame) -> DataFrame | None:
    """A settled table with a hint to broadcast it if it is small enough; None if it is empty."""
    n = kept.count()
    return None if n == 0 else F.broadcast(kept) if n <= BROADCAST_ROWS else kept


#: What a schema is stated with: predicates, and classes of properties.
_STATED = [v.SUBCLASS, v.SUBPROP, v.DOMAIN, v.RANGE, v.FIRST, v.REST] + [
    v.OWL + x for x in ("equivalentClass", "equivalentProperty", "inverseOf", "onProperty", "someValuesFrom", "allValuesFrom", "hasValue", "intersectionOf", "unionOf", "oneOf", "propertyChainAxiom")
]
_KINDS = [v.OWL + "SymmetricProperty", v.OWL + "TransitiveProperty"]


def schema_tables(triples: DataFrame) -> dict[str, DataFrame]:
    """Closed schema relations of a graph, as far as it states them.

    sub (class, super), subprop, domain, range, inverse, intersection, kinds of
    properties, restrictions, one_of and chain.  The graph is read once, for its
    axioms; which kinds there are decides what is worked out at all.  Tables that
    are parts of the axioms are to be broadcast if these are counted to be few;
    closures are counted themselves.
    """
    is_axiom = F.col("p").isin(*_STATED) | (F.col("p") == v.TYPE) & F.col("o").isin(*_KINDS)
    t = settled(triples.where(is_axiom).select("s", "p", "o", "o_kind").distinct())
    counts = {r[0].removeprefix(v.OWL): r[1] for r in t.groupBy(F.when(F.col("p") == v.TYPE, F.col("o")).otherwise(F.col("p"))).count().collect()}  # at most as many as named above
    stated, marked = set(counts), (F.broadcast if sum(counts.values()) <= BROADCAST_ROWS else lambda d: d)
    has = lambda *names: any(n in stated for n in names)
    edge = lambda p: t.where((F.col("p") == p) & (F.col("o_kind") != "literal")).select(F.col("s").alias("src"), F.col("o").alias("dst"))
    flip = lambda d: d.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    both = lambda d: d.unionByName(flip(d))
    members = list_members(t) if has("intersectionOf", "unionOf", "oneOf", "propertyChainAxiom") else t.select(F.col("s").alias("head"), F.col("o").alias("member"), F.lit(0).alias("pos")).limit(0)
    lists = lambda p: edge(p).join(members.select(F.col("head").alias("dst"), "member"), "dst")
    inter = lists(v.OWL + "intersectionOf").select("src", F.col("member").alias("dst"))
    union = lists(v.OWL + "unionOf").select(F.col("member").alias("src"), F.col("src").alias("dst"))
    kind = lambda k: t.where((F.col("p") == v.TYPE) & (F.col("o") == v.OWL + k)).select(F.col("s").alias("prop")).distinct()
    on = t.where(F.col("p") == v.OWL + "onProperty").select(F.col("s").alias("node"), F.col("o").alias("prop"))
    value = lambda p: t.where(F.col("p") == v.OWL + p).select(F.col("s").alias("node"), F.col("o").alias("filler")).join(on, "node")
    out: dict[str, DataFrame] = {}
    if has(v.SUBCLASS, "equivalentClass", "intersectionOf", "unionOf"):
        out["sub"] = small(transitive_closure(reduce(DataFrame.unionByName, [edge(v.SUBCLASS), both(edge(v.OWL + "equivalentClass")), inter, union])))
    chains, single = None, None
    if has("propertyChainAxiom"):
        chains, single = chain_steps(edge(v.OWL + "propertyChainAxiom").join(members.select(F.col("head").alias("dst"), "pos", "member"), "dst"))
        out["chain"] = marked(settled(chains))
    if has(v.SUBPROP, "equivalentProperty", "propertyChainAxiom"):
        edges = edge(v.SUBPROP).unionByName(both(edge(v.OWL + "equivalentProperty")))
        out["subprop"] = small(transitive_closure(edges if single is None else edges.unionByName(single)))  # a chain of one property is a subproperty
    direct = {"domain": (v.DOMAIN, lambda: edge(v.DOMAIN)), "range": (v.RANGE, lambda: edge(v.RANGE)), "inverse": ("inverseOf", lambda: both(edge(v.OWL + "inverseOf"))), "intersection": ("intersectionOf", lambda: inter)}
    direct |= {"symmetric": ("SymmetricProperty", lambda: kind("SymmetricProperty")), "transitive": ("TransitiveProperty", lambda: kind("TransitiveProperty"))}
    direct |= {"some": ("someValuesFrom", lambda: value("someValuesFrom")), "all": ("allValuesFrom", lambda: value("allValuesFrom")), "has": ("hasValue", lambda: value("hasValue"))}
    direct["one_of"] = ("oneOf", lambda: lists(v.OWL + "oneOf").select(F.col("member").alias("s"), F.col("src").alias("c")))
    out |= {name: marked(make()) for name, (needs, make) in direct.items() if has(needs)}
    return {k: d for k, d in out.items() if d is not None}


#: Links along the first properties of a chain; they are facts while the fix-point runs.
PARTIAL = "chain:"


def chain_steps(axioms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(left, right, result) and (src, dst) from the members (src, dst, pos, member) of property chains.

    A chain of n properties becomes n - 1 steps of two: links along its first k
    properties have a name of their own, and chains that begin alike share it.
    Chains of one property are edges from it to the whole.
    """
    chains = axioms.groupBy("src", "dst").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "member"))), lambda x: x["member"]).alias("m"))
    several, one = chains.where("size(m) > 1"), chains.where("size(m) = 1")
    at = several.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("m") - 1)))
    name = lambda n: F.concat(F.lit(PARTIAL), F.md5(F.array_join(F.slice("m", F.lit(1), n), " ").cast("binary")))
    left = F.when(F.col("k") == 1, F.col("m")[0]).otherwise(name(F.col("k")))
    result = F.when(F.col("k") == F.size("m") - 1, F.col("src")).otherwise(name(F.col("k") + 1))
    return at.select(left.alias("left"), F.element_at("m", F.col("k") + 1).alias("right"), result.alias("result")).distinct(), one.select(F.col("m")[0].alias("src"), F.col("src").alias("dst"))


def owl_rl(triples: DataFrame, schema: dict[str, DataFrame] | None = None) -> DataFrame:
    """s, p, o, o_kind: the facts of a graph and what OWL 2 RL derives from them.

    Rules (names of the W3C tables): cax-sco, cax-eqc, cls-uni, cls-int1/2,
    prp-spo1, prp-spo2, prp-eqp, prp-dom, prp-rng, prp-inv, prp-symp, prp-trp,
    cls-svf1/2, cls-avf, cls-hv1/2, cls-oo.  Individuals that are the same stay
    apart here: equality.entail() merges them.  Contradictions are left to
    consistency.check().
    """
    facts = triples.select("s", "p", "o", "o_kind")
    sch = schema_tables(triples) if schema is None else schema
    return without_partial(fixpoint(with_members(facts, sch), rules(sch)), sch)


def with_members(facts: DataFrame, sch: dict[str, DataFrame]) -> DataFrame:
    """The facts and the types that enumerations state."""
    if "one_of" not in sch:
        return facts
    return facts.unionByName(sch["one_of"].select("s", F.lit(v.TYPE).alias("p"), F.col("c").alias("o"), F.lit("uri").alias("o_kind")))


def without_partial(facts: DataFrame, sch: dict[str, DataFrame]) -> DataFrame:
    return facts.where(~F.startswith("p", F.lit(PARTIAL))) if "chain" in sch else facts


def reach(sch: dict[str, DataFrame]) -> Callable[[set[str] | None, set[str] | None], dict[str, set[str]] | None]:
    """active(new, known): the rules that facts of new predicates can fire, with the predicates they make.

    It gives None where it cannot tell: with restrictions, intersections, or
    more than NAMED predicates.
    """
    pairs: dict[str, set[tuple]] | None = {}
    for name, d in sch.items():
        if name == "one_of":
            continue
        columns = {"chain": ["left", "right", "result"], "symmetric": ["prop"], "transitive": ["prop"]}.get(name, ["src", "dst"])
        if name == "sub":
            pairs[name] = {(v.TYPE, v.TYPE)}
        elif name in ("domain", "range", "subprop", "inverse", "symmetric", "transitive", "chain"):
            rows = d.select(*columns).limit(NAMED + 1).collect()
            if len(rows) > NAMED:
                pairs = None
                break
            kind = {"domain": lambda r: (r[0], v.TYPE), "range": lambda r: (r[0], v.TYPE), "symmetric": lambda r: (r[0], r[0]), "transitive": lambda r: (r[0], r[0])}.get(name, tuple)
            pairs[name] = {kind(r) for r in rows}
        else:
            pairs = None
            break

    def active(new: set[str] | None, known: set[str] | None) -> dict[str, set[str]] | None:
        if pairs is None or new is None or known is None:
            return None
        out = {name: {x[1] for x in rows if x[0] in new} for name, rows in pairs.items() if name != "chain"}
        chain = pairs.get("chain", set())
        out["chain_left"] = {x[2] for x in chain if x[0] in new and x[1] in known}
        out["chain_right"] = {x[2] for x in chain if x[1] in new and x[0] in known}
        return {name: made for name, made in out.items() if made}

    return active


def rules(sch: dict[str, DataFrame]) -> Callable[..., DataFrame]:
    """One round of the rules that a schema has rows for, from what is new and all that is known; of some rules only, if reach() named them."""
    is_type = F.col("p") == v.TYPE

    def types(rows: DataFrame) -> DataFrame:
        return rows.select("s", F.lit(v.TYPE).alias("p"), F.col("c").alias("o"), F.lit("uri").alias("o_kind"))

    def via(d: DataFrame, name: str, c: str) -> DataFrame:
        return d.join(sch[name].select(F.col("src").alias(c), F.col("dst").alias("q")), c)

    def only(d: DataFrame, name: str) -> DataFrame:
        return d.where("o_kind <> 'literal'").join(sch[name].withColumnRenamed("prop", "p"), "p", "left_semi")

    def kind_of(d: DataFrame) -> DataFrame:
        return d.select(F.col("s").alias("x"), F.col("o").alias("k"))

    def step(new: DataFrame, known: DataFrame, may: dict[str, set[str]] | None = None) -> DataFrame:
        """Only the rules whose part of the schema has rows are in the plan."""
        typed, links = new.where(is_type), new.where(~is_type)
        all_types, all_links = known.where(is_type), known.where(~is_type)
        things = links.where("o_kind <> 'literal'")
        uri = F.lit("uri").alias("o_kind")
        out = [new.limit(0)]
        has = lambda name: name in sch if may is None else name in may
        if has("sub"):
            out.append(types(via(typed, "sub", "o").select("s", F.col("q").alias("c"))))
        if has("subprop"):
            out.append(via(links, "subprop", "p").select("s", F.col("q").alias("p"), "o", "o_kind"))
        if has("domain"):
            out.append(types(via(links, "domain", "p").select("s", F.col("q").alias("c"))))
        if has("range"):
            out.append(types(via(things, "range", "p").select(F.col("o").alias("s"), F.col("q").alias("c"))))
        if has("inverse"):
            out.append(via(things, "inverse", "p").select(F.col("o").alias("s"), F.col("q").alias("p"), F.col("s").alias("o"), uri))
        if has("symmetric"):
            out.append(only(links, "symmetric").select(F.col("o").alias("s"), "p", F.col("s").alias("o"), uri))
        if has("transitive"):
            for a, b in ((new, known), (known, new)):
                left, right = only(a, "transitive").select("s", "p", F.col("o").alias("m")), only(b, "transitive").select(F.col("s").alias("m"), "p", "o", "o_kind")
                out.append(left.join(right, ["m", "p"]).select("s", "p", "o", "o_kind"))
        if "chain" in sch:
            firsts, nexts = (sch["chain"].select(F.col(c).alias("p")).distinct() for c in ("left", "right"))  # rows of the ontology
            for name, a, b in (("chain_left", things, all_links), ("chain_right", all_links.where("o_kind <> 'literal'"), links)):
                if may is not None and name not in may:
                    continue
                left = a.join(firsts, "p", "left_semi").join(sch["chain"].withColumnRenamed("left", "p"), "p").select("s", F.col("o").alias("m"), "right", "result")
                right = b.join(nexts, "p", "left_semi").select(F.col("s").alias("m"), F.col("p").alias("right"), "o", "o_kind")
                out.append(left.join(right, ["m", "right"]).select("s", F.col("result").alias("p"), "o", "o_kind"))
        for some_links, some_types in ((links, all_types), (all_links, typed)):
            if "some" in sch:
                rows = some_links.join(sch["some"].withColumnRenamed("prop", "p"), "p")
                hit = rows.join(kind_of(some_types), (F.col("o") == F.col("x")) & (F.col("filler") == F.col("k")))
                out.append(types(hit.select("s", F.col("node").alias("c"))))
            if "all" in sch:
                rows = some_links.where("o_kind <> 'literal'").join(sch["all"].withColumnRenamed("prop", "p"), "p")
                hit = rows.join(kind_of(some_types), (F.col("s") == F.col("x")) & (F.col("node") == F.col("k")))
                out.append(types(hit.select(F.col("o").alias("s"), F.col("filler").alias("c"))))
        if "some" in sch:
            any_value = sch["some"].where(F.col("filler") == v.THING).withColumnRenamed("prop", "p")
            out.append(types(links.join(any_value, "p").select("s", F.col("node").alias("c"))))
        if "has" in sch:
            value = sch["has"]
            out.append(typed.join(value.withColumnRenamed("node", "o"), "o").select("s", F.col("prop").alias("p"), F.col("filler").alias("o"), uri))
            out.append(types(links.join(value.select(F.col("prop").alias("p"), F.col("filler").alias("o"), "node"), ["p", "o"]).select("s", F.col("node").alias("c"))))
        if "intersection" in sch:
            sizes = sch["intersection"].groupBy("src").agg(F.count(F.lit(1)).alias("n"))
            whole = all_types.join(typed.select("s").distinct(), "s", "left_semi").join(sch["intersection"].select(F.col("dst").alias("o"), "src"), "o")
            met = whole.groupBy("s", "src").agg(F.count_distinct("o").alias("k")).join(sizes, "src").where("k = n")
            out.append(types(met.select("s", F.col("src").alias("c"))))
        return reduce(DataFrame.unionByName, out)

    step.active = reach(sch)
    return step


def same_individuals(facts: DataFrame) -> DataFrame:
    """node, root: individuals that are the same, by the least of them.

    facts: s, p, o, o_kind with the axioms among them (owl_rl()'s result, or a
    graph as it is).  Stated sameAs, several values of a functional property,
    several subjects of an inverse-functional one, and several values where at
    most one is allowed.  Each is a star around the least individual, so no
    pairs within a group are made.
    """
    links = facts.where("o_kind <> 'literal'").select("s", "p", "o")
    kind = lambda k: facts.where((F.col("p") == v.TYPE) & (F.col("o") == v.OWL + k)).select(F.col("s").alias("p")).distinct()

    def star(rows: DataFrame, by: list[str], node: str) -> DataFrame:
        least = rows.groupBy(*by).agg(F.min(node).alias("a"), F.max(node).alias("z")).where("a <> z").drop("z")
        return rows.join(least, by).select("a", F.col(node).alias("b"))

    functional = star(links.join(kind("FunctionalProperty"), "p", "left_semi"), ["s", "p"], "o")
    inverse = star(links.join(kind("InverseFunctionalProperty"), "p", "left_semi"), ["o", "p"], "s")
    one = facts.where((F.col("p") == v.OWL + "maxCardinality") & (F.col("o") == "1")).select(F.col("s").alias("node"))
    on = facts.where(F.col("p") == v.OWL + "onProperty").select(F.col("s").alias("node"), F.col("o").alias("p")).join(one, "node")
    typed = facts.where(F.col("p") == v.TYPE).select("s", F.col("o").alias("node"))
    limited = star(links.join(typed.join(on, "node").select("s", "p").distinct(), ["s", "p"], "left_semi"), ["s", "p"], "o")
    stated = links.where(F.col("p") == v.OWL + "sameAs").select(F.col("s").alias("a"), F.col("o").alias("b"))
    pairs = settled(reduce(DataFrame.unionByName, [stated, functional, inverse, limited]).where("a <> b").distinct())
    return equivalence_groups(pairs)
