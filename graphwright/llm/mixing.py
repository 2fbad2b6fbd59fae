"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is a stream of its documents in a seeded hash order, repeated as
often as its target asks, and cut into blocks of a fixed number of words.  The
numbers of blocks of each source are the exact quotas.  A binary tree over the
output shards splits them: at each node the left half's share is drawn from the
multivariate hypergeometric distribution (source by source, each drawn exactly
at every size), so the leaves hold what a shuffle of all blocks would give, and
sum exactly to the quotas.  A shard then takes its own range of each source's
permuted block list, and orders its pieces by a hash.

DataFrame and SQL functions only.  Documents are not gathered by source
anywhere: their places in the stream come from ranks.running_sum().  The table
of sources has one row per source; it is written to the shared folder, so the
planner knows its size and broadcasts it only below its own threshold.  The
tree is drawn source by source in one row per node: it is meant for up to some
ten thousand sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphwright.llm.common import WORD, identified, source_key, table, word_count
from graphwright.llm.ranks import content, content_keys, hash_bucket, key_order, running_sum

WEIGHTS = (5, 2, 1)
#: A document is taken at most so often.
MAX_REPEATS = 3
BLOCK_WORDS = 2048
#: Candidates of one draw, and steps of one walk, at most.
TRIES, WALKS = 200, 128
#: A word with the white space behind it, and before it at the start of a text.
SPACED_WORD = rf"(?:\A[\x20\x09-\x0D]+)?{WORD}[\x20\x09-\x0D]*"

def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """_source, source_size, ord, weight, target (double), quota (long) of every source.

    `sizes` has _source and size.  Weights repeat over the sources in order.
    Targets share the total by weight; one above max_repeats times its source
    stops there and the excess goes to the others by weight (water-filling:
    sources sorted by limit per weight, one pass of running sums).  Quotas are
    the targets rounded so that they sum to the total.
    """
    s = sizes.groupBy("_source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("ord", F.row_number().over(Window.orderBy("_source")) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("ord") % len(weights) + 1))
    s = s.withColumn("_limit", (F.lit(max_repeats) * F.col("source_size")).cast("double")).withColumn("_ratio", F.col("_limit") / F.col("weight"))
    w = Window.orderBy("_ratio", "ord")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = s.withColumn("_total", F.sum("source_size").over(everything).cast("double"))
    level = (F.col("_total") - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    s = s.withColumn("_level", level).withColumn("_open", F.col("_ratio") >= F.col("_level"))
    s = s.withColumn("_water", F.min(F.when(F.col("_open"), F.struct("_ratio", "ord", "_level"))).over(everything)["_level"])
    s = s.withColumn("target", F.least("_limit", F.coalesce(F.col("weight") * F.col("_water"), F.col("_limit"))))
    s = s.withColumn("_sum", F.sum("target").over(Window.orderBy("ord")))
    quota = F.floor(F.col("_sum") + 0.5) - F.floor(F.col("_sum") - F.col("target") + 0.5)
    return s.select("_source", "source_size", "ord", "weight", "target", F.least(quota.cast("long"), F.col("_limit").cast("long")).alias("quota"))


def _log_ratio(a: str, b: str) -> str:
    """SQL for ln(a! / b!): Stirling's series from eleven on, as a difference, so that nothing large cancels."""
    up, down = f"({a} + 11D)", f"({b} + 11D)"
    series = lambda z: f"(1D / 12 - (1D / 360 - (1D / 1260 - 1D / (1680 * {z} * {z})) / ({z} * {z})) / ({z} * {z})) / {z}"
    places = " * ".join(f"(({b} + {i}D) / ({a} + {i}D))" for i in range(1, 11))
    return f"(({up} - 0.5D) * log1p(({up} - {down}) / {down}) + ({up} - {down}) * (ln({down}) - 1) + {series(up)} - {series(down)} + ln({places}))"


def _draw(total: str, kind: str, take: str, salt: str) -> str:
    """SQL for a hypergeometric number: of `total` blocks `kind` are of the source and `take` are drawn; salt seeds it.

    Ratio of uniforms (Stadlober, 1990), whose work does not depend on the
    numbers: a point under the hat gives a candidate, which is accepted by its
    exact probability relative to the mode's.  About seven in ten are, so that
    of TRIES all fail with probability below 1e-90.
    """
    uniform = lambda j: f"((pmod(xxhash64(p.salt, {j}), 9007199254740992) + 0.5D) / 9007199254740992D)"
    facts = f"""transform(array(named_struct('total', {total}, 'kind', {kind}, 'take', {take})), q -> named_struct(
        'total', q.total, 'kind', q.kind, 'take', q.take, 'k', least(q.kind, q.total - q.kind), 'm', least(q.take, q.total - q.take)))"""
    facts = f"""transform({facts}, q -> named_struct('total', q.total, 'kind', q.kind, 'take', q.take, 'k', q.k, 'm', q.m, 'rest', q.total - q.k - q.m, 'salt', {salt},
        'mode', cast(floor((q.m + 1D) * (q.k + 1D) / (q.total + 2D)) as bigint), 'mean', cast(q.m as double) * q.k / greatest(q.total, 1L),
        'spread', sqrt(cast(q.m as double) * q.k / greatest(q.total, 1L) * (q.total - q.k) / greatest(q.total, 1L) * (q.total - q.m) / greatest(q.total - 1, 1L) + 0.5D)))"""
    relative = " + ".join(_log_ratio(a, b) for a, b in (("p.mode", "x"), ("(p.k - p.mode)", "(p.k - x)"), ("(p.m - p.mode)", "(p.m - x)"), ("(p.rest + p.mode)", "(p.rest + x)")))
    point = f"""greatest(-1D, least(1e18D, p.mean + 0.5D + (2 * sqrt(2 / e()) * p.spread + 3 - 2 * sqrt(3 / e())) * (w.v - 0.5D) / w.u))"""
    attempt = f"""transform(array(named_struct('u', {uniform("2 * t")}, 'v', {uniform("2 * t + 1")})), w -> transform(array(cast(floor({point}) as bigint)),
        x -> if(x >= 0 and x <= least(p.k, p.m), if(2 * ln(w.u) <= {relative}, x, cast(null as bigint)), cast(null as bigint)))[0])[0]"""
    found = f"if(p.k = 0 or p.m = 0, 0L, coalesce(aggregate(sequence(1, {TRIES}), cast(null as bigint), (z, t) -> if(z is not null, z, {attempt})), p.mode))"
    back = "transform(array(if(p.kind > p.k, p.m - z, z)), y -> if(p.take > p.m, p.kind - y, y))[0]"
    return f"transform({facts}, p -> transform(array({found}), z -> {back})[0])[0]"


def _permuted(block: str) -> str:
    """SQL for the place of `block` in the shuffled list of its source's blocks.

    A Feistel network with a key of the source permutes the numbers below the
    next power of two (columns low and high: masks of its two halves; width:
    bits of the low one), and is walked until it comes below `blocks`.  Half of
    all numbers are, so WALKS steps are enough but for once in 2 ** WALKS.
    """
    network = lambda x: f"""aggregate(sequence(1, 6), {x}, (y, r) -> if(r % 2 = 1,
        y ^ (xxhash64(key, r, shiftright(y, width)) & low), y ^ shiftleft(xxhash64(key, r, y & low) & high, width)))"""  # noqa: E731
    return f"aggregate(sequence(1, {WALKS}), {network(block)}, (x, t) -> if(x < blocks, x, {network('x')}))"


def _split(seed: int) -> str:
    """SQL for the left half's blocks of each source, an array like q; the node's columns are node, q and n_left."""
    draw = _draw("acc.total", "q[i]", "acc.take", f"xxhash64({seed}, node, i)")
    return f"""aggregate(sequence(0, size(q) - 1),
        named_struct('total', aggregate(q, 0L, (a, b) -> a + b), 'take', n_left, 'out', cast(array() as array<bigint>)),
        (acc, i) -> transform(array({draw}), d -> named_struct('total', acc.total - q[i], 'take', acc.take - d, 'out', concat(acc.out, array(d))))[0]).out"""


def splitting_tree(sources: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """ord, tree: for every source, how many of its blocks go left at each inner node (heap order from 1).

    `sources` has ord and blocks.  All sources are in one row here; there are as
    many numbers as sources times shards.
    """
    root = sources.agg(F.array_sort(F.collect_list(F.struct("ord", "blocks"))).alias("q")).selectExpr(
        "1 as node", "0 as lo", f"{n_shards} as hi", "transform(q, x -> x.blocks) as q", "aggregate(q, 0L, (a, x) -> a + x.blocks) as n_all"
    ).where("size(q) > 0")
    level, done = root, None
    for depth in range(max(1, (n_shards - 1).bit_length())):
        inner = level.where("hi - lo > 1").withColumn("mid", F.expr("cast((lo + hi) div 2 as int)"))
        inner = inner.withColumn("n_left", F.expr(f"(mid * n_all) div {n_shards} - (lo * n_all) div {n_shards}"))
        inner = inner.withColumn("left", F.expr(_split(seed)))
        inner = inner.select("node", "lo", "mid", "hi", "q", "n_all", "left")
        inner = table(inner, "tree")
        done = inner.select("node", "left") if done is None else done.unionByName(inner.select("node", "left"))
        # in one branch, as a union would hold the draw's long expression twice; a task for each node
        halves = "stack(2, 2 * node, lo, mid, left, n_all, 2 * node + 1, mid, hi, transform(q, (x, i) -> x - left[i]), n_all) as (node, lo, hi, q, n_all)"
        level = inner.selectExpr(halves).repartition(2 << depth)
    rows = done.select("node", F.posexplode("left").alias("ord", "n"))
    tree = rows.groupBy("ord").agg(F.map_from_entries(F.collect_list(F.struct("node", "n"))).alias("tree"))
    return tree


def _pieces(n_shards: int, seed: int) -> str:
    """SQL for the pieces of a document: where its passes meet blocks, and the shards of these."""
    depth = max(1, (n_shards - 1).bit_length())
    rank = _permuted("p.block")
    shard = f"""aggregate(sequence(1, {depth}), named_struct('node', 1, 'lo', 0, 'hi', {n_shards}, 'rank', {rank}),
        (s, _) -> case when s.hi - s.lo <= 1 then s
          when s.rank < tree[s.node] then named_struct('node', 2 * s.node, 'lo', s.lo, 'hi', (s.lo + s.hi) div 2, 'rank', s.rank)
          else named_struct('node', 2 * s.node + 1, 'lo', cast((s.lo + s.hi) div 2 as int), 'hi', s.hi, 'rank', s.rank - tree[s.node]) end).lo"""
    shard = shard.replace("(s.lo + s.hi) div 2", "cast((s.lo + s.hi) div 2 as int)").replace("cast(cast((s.lo + s.hi) div 2 as int) as int)", "cast((s.lo + s.hi) div 2 as int)")
    passes = f"""transform(filter(sequence(0, {MAX_REPEATS}), r -> size > 0 and r * source_size + start < quota),
        r -> named_struct('pass', r, 'a', r * source_size + start, 'z', least(quota, r * source_size + start + size)))"""
    cut = f"""flatten(transform({passes}, t -> transform(sequence(t.a div block_words, (t.z - 1) div block_words), b -> named_struct(
        'pass', t.pass, 'block', b,
        'first', greatest(t.a, b * block_words) - t.a,
        'words', least(t.z, (b + 1) * block_words) - greatest(t.a, b * block_words)))))"""
    return f"""transform({cut}, p -> named_struct('shard', {shard}, 'place', xxhash64({seed}, _source, start, p.pass, p.block), 'pass', p.pass, 'block', p.block, 'first_word', p.first, 'words', p.words))"""


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, n_shards: int = 16, block_words: int = BLOCK_WORDS, seed: int = 17) -> DataFrame:
    """One row per row of `docs` (doc_id, text, source), texts aside: how the mix takes it.

    doc_id, size (words), source_size, target (of its source), taken (words the
    mix takes, repeats counted) and pieces: an array of shard, place (order
    within the shard), pass, block, first_word and words.  The last document
    that a source's quota reaches is taken in part, so quotas hold to the word.

    The mix depends on the seed and on what the rows have in these columns, not
    on files, partitions or joins.  Null texts have size 0 and no pieces; a null
    source is one source, sorted last; rows with one doc_id, or none, are
    separate documents; an empty table gives an empty result.  Other columns are
    not looked at.
    """
    slim = _sized(identified(docs), seed)
    taken = F.expr("aggregate(pieces, 0L, (a, p) -> a + p.words)")
    return _dealt(slim, weights, n_shards, block_words, seed).select("doc_id", "size", "source_size", "target", taken.alias("taken"), "pieces")


def _sized(rows: DataFrame, seed: int) -> DataFrame:
    """A table of file, at, doc_id, _source, size, key of every row; one pass over the texts."""
    whole = content(F.col("row.doc_id"), F.col("row.source"), F.col("row.text"))
    made = rows.select("file", "at", "row.doc_id", source_key(F.col("row.source")).alias("_source"), word_count(F.col("row.text")).alias("size"), whole.alias("content"))
    return table(content_keys(table(made, "contents"), seed), "sizes")


def _dealt(slim: DataFrame, weights: tuple[float, ...], n_shards: int, block_words: int, seed: int) -> DataFrame:
    """The rows of `slim`, a table() of _sized() rows, with source_size, target and pieces."""
    sources = table(targets(slim, weights), "sources")
    sources = table(sources.withColumn("block_words", F.lit(block_words).cast("long")).withColumn("blocks", F.expr("(quota + block_words - 1) div block_words")), "sources")
    tree = splitting_tree(sources.select("ord", "blocks"), n_shards, seed)
    bits = "length(bin(greatest(blocks - 1, 0L)))"
    plan = sources.join(tree, "ord", "left").withColumns({"source_key": F.expr(f"xxhash64({seed}, ord)"), "width": F.expr(f"{bits} div 2").cast("int"), "bits": F.expr(bits)})
    plan = plan.withColumns({"low": F.expr("shiftleft(1L, width) - 1"), "high": F.expr("shiftleft(1L, cast(bits - width as int)) - 1")})
    plan = table(plan.drop("bits"), "plan")
    placed = running_sum(slim, ["_source"], hash_bucket(F.col("key")), key_order("key"), F.col("size"), "start").drop("key")
    return placed.join(plan.withColumnRenamed("source_key", "key"), "_source").withColumn("pieces", F.expr(_pieces(n_shards, seed)))


def _texts(text: Column) -> Column:
    """shard, place, pass, first_word and text of each piece; the texts of a whole pass together are the document's.

    White space goes with the word before it, and what leads a text with its
    first word.
    """
    made = lambda p, t: F.struct(*[p[c].alias(c) for c in ("shard", "place", "pass", "first_word")], t.alias("text"))
    words = F.regexp_extract_all(text, F.lit(SPACED_WORD), F.lit(0))
    part = lambda w, p: F.array_join(F.slice(w, (p["first_word"] + 1).cast("int"), p["words"].cast("int")), "")
    cut = F.transform(F.array(words), lambda w: F.transform("pieces", lambda p: made(p, part(w, p))))[0]
    whole = F.forall("pieces", lambda p: p["words"] == F.col("size"))
    return F.when(whole, F.transform("pieces", lambda p: made(p, text))).otherwise(cut)


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, n_shards: int = 16, block_words: int = BLOCK_WORDS, seed: int = 17) -> DataFrame:
    """The mix itself: a row for each piece that mix() deals, with the piece as text, the other columns as they came.

    Rows are in the order of shard and place; a shard is several partitions in
    a row, each a range of places.  A column n_chars is that of the piece.
    Whole rows are shuffled twice: to meet their pieces, and to their shard.
    Documents without words or beyond their source's quota are not in the mix.
    """
    columns = docs.columns
    rows = identified(docs)
    slim = _sized(rows, seed)
    dealt = _dealt(slim, weights, n_shards, block_words, seed).where("size(pieces) > 0").select("file", "at", "size", "pieces")
    parts = -(-int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // n_shards)
    cut = rows.join(dealt.hint("merge"), ["file", "at"]).select("row", F.explode(_texts(F.col("row.text"))).alias("piece"))
    new = {"text": F.col("piece.text")}
    new |= {c: F.when(F.col("piece.text") == F.col("row.text"), F.col(f"row.`{c}`")).otherwise(F.length("piece.text").cast(t)) for c, t in docs.dtypes if c == "n_chars"}
    whole = F.struct(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns])
    cut = cut.select(whole.alias("row"), *[F.col(f"piece.{c}").alias(c) for c in ("shard", "place", "pass", "first_word")])
    # The top 24 bits of a place are its range, from -(2 ** 23) on.
    part = F.expr(f"cast(shard * {parts} + (((place >> 40) + 8388608) * {parts} >> 24) as int)")
    cut = cut.repartitionById(n_shards * parts, part).sortWithinPartitions("shard", "place", "pass", "first_word")
    return cut.select("row.*")


__all__ = ["mix", "mixed_documents", "splitting_tree", "targets"]
