"""Hard negatives by a two-dimensional block matrix multiply.

Scores of anchors against all rows are a matrix product.  Anchors and rows are
dealt to blocks by a hash, their dimensions to chunks.  Every pair of an anchor
block and a row block gets all chunks of its two panels, adds the partial
products chunk by chunk in 64-bit integers, a strip of anchors at a time, and
leaves only the best of each anchor in the tile; these are reduced over the
tiles.  So panels and the best travel, but no tile does.  Two such products are
made: of anchors and rows of their label (positives), in groups of labels, and
of anchors and all rows (negatives), where a negative must lie in a window
below the positive's score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphwright.llm.common import table

#: Rows of a block at least and at most, of which a shard has some 64 in between; anchors of a block at most.
BLOCK_ROWS = 2048
MOST_ROWS = 16384
BLOCK_ANCHORS = 8192
#: Numbers that a panel has at most, beyond 256 rows.
PANEL = 1 << 22
#: Scores that a strip of a tile has.
STRIP = 1 << 22
#: Dimensions of a chunk at least, and chunks at most.
CHUNK = 32
MOST_CHUNKS = 16
#: Groups that labels are dealt to.
LABEL_GROUPS = 256
_PANEL = "shard int, block int, chunk int, kind string, n int, panel binary, ids binary, labels binary, wanted binary"
_LEAST = np.iinfo(np.int64).min


def points(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, x (array of long): floor(scale * component) of the rows that take part.

    Rows with a null vec_id, label or vector, or with a component that is null,
    not finite or beyond 64 bits when scaled, do not.  Of rows that share a
    vec_id one counts, the least by label and vector.
    """
    scaled = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).try_cast("long"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= (2.0**62) / scale))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
    rows = rows.where(F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), scaled.alias("x"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("_least")).select("vec_id", "_least.label", "_least.x")


def _kind(values: np.ndarray) -> str:
    """The narrowest type that holds the values."""
    most = max(int(values.max(initial=0)), -int(values.min(initial=0)) - 1) if values.size else 0
    return "i2" if most < 1 << 15 else "i4" if most < 1 << 31 else "i8"


def _panels(rows: DataFrame, least: int, most: int, dims: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of rows of a shard cut into chunks of their dimensions; and (shard, n_blocks), a row for each shard.

    rows: shard, vec_id, label, x, wanted (struct arrays of positives, or null).
    """
    most = min(most, max(256, PANEL // max(1, dims)))
    n = F.count(F.lit(1))
    size = F.least(F.lit(most), F.greatest(F.lit(least), F.ceil(n / 64)))
    blocks = table(rows.groupBy("shard").agg(F.ceil(n / size).cast("int").alias("n_blocks")), "blocks")
    dealt = rows.join(F.broadcast(blocks), "shard")  # at most LABEL_GROUPS rows
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("n_blocks")).cast("int")).drop("n_blocks")

    def f(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("vec_id")
        ids, labels = t.column("vec_id").to_numpy().astype("<i8"), t.column("label").to_numpy().astype("<i8")
        x = t.column("x").combine_chunks()
        lengths = np.diff(x.offsets.to_numpy().astype(np.int64))
        whole = np.zeros((len(ids), dims), np.int64)
        whole[np.repeat(np.arange(len(ids)), lengths), np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = x.flatten().to_numpy(zero_copy_only=False)
        wanted = None
        if "wanted" in t.column_names:
            lists = t.column("wanted").to_pylist()
            flat = [(i, w["vec_id"], w["score"]) for i, ws in enumerate(lists) for w in ws or []]
            wanted = np.array(flat, "<i8").reshape(-1, 3).tobytes()
        out = []
        for c in range(max(1, -(-dims // chunk))):
            part = whole[:, c * chunk : (c + 1) * chunk]
            kind = _kind(part)
            lead = c == 0  # ids, labels and positives travel with the first chunk
            out.append((key[0].as_py(), key[1].as_py(), c, kind, len(ids), part.astype(f"<{kind}").tobytes(), *((ids.tobytes(), labels.tobytes(), wanted) if lead else (None, None, None))))
        frame = pd.DataFrame(out, columns=[w.split()[0] for w in _PANEL.split(", ")])
        return pa.Table.from_pandas(frame, schema=_PANEL_ARROW, preserve_index=False)

    return dealt.groupBy("shard", "block").applyInArrow(f, _PANEL), blocks


_PANEL_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("chunk", pa.int32()), ("kind", pa.string()), ("n", pa.int32()), ("panel", pa.binary()), ("ids", pa.binary()), ("labels", pa.binary()), ("wanted", pa.binary())])
def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in 64-bit integers; by floating point where that is exact."""
    most = max(1, int(np.abs(a).max(initial=0))) * max(1, int(np.abs(b).max(initial=0))) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _strips(left: pa.Table, right: pa.Table) -> Iterator[tuple[slice, np.ndarray, dict]]:
    """Strips of a tile's scores, each with its anchors' places, and the ids, labels and positives of the whole tile."""
    a, r = ({x["chunk"]: x for x in t.to_pylist()} for t in (left, right))
    panel = lambda x: np.frombuffer(x["panel"], f"<{x['kind']}").reshape(x["n"], -1)
    pairs = [(panel(a[c]), panel(r[c])) for c in sorted(a)]
    lead = {f"{side}_{n}": np.frombuffer(x[0][n], "<i8") for side, x in (("a", a), ("r", r)) for n in ("ids", "labels")}
    if a[0]["wanted"] is not None:
        lead["wanted"] = np.frombuffer(a[0]["wanted"], "<i8").reshape(-1, 3)
    step = max(1, STRIP // max(1, r[0]["n"]))
    for i in range(0, a[0]["n"], step):
        part = slice(i, min(i + step, a[0]["n"]))
        scores = None
        for x, y in pairs:
            more = _product(x[part], y)
            scores = more if scores is None else scores + more
        yield part, scores, lead


def _columns(schema: pa.Schema, parts: list[tuple]) -> pa.Table:
    joined = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * len(schema)
    return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in joined], schema=schema)


_POSITIVES = pa.schema([(n, pa.int64()) for n in ("anchor_id", "vec_id", "score")])
_NEGATIVES = pa.schema([(n, pa.int64()) for n in ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")])


def _best_positives(most: int) -> Callable:
    def f(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:  # noqa: ARG001
        out: list[tuple] = []
        if not left.num_rows or not right.num_rows:
            return _POSITIVES.empty_table()
        for strip, scores, x in _strips(left, right):
            a_ids, a_labels = x["a_ids"][strip], x["a_labels"][strip]
            for label in np.unique(a_labels):
                rows, own = np.flatnonzero(x["r_labels"] == label), np.flatnonzero(a_labels == label)
                if not len(rows):
                    continue
                part, k = scores[np.ix_(own, rows)], min(most + 1, len(rows))  # one more: the anchor may be among them
                least = np.partition(part, len(rows) - k, axis=1)[:, len(rows) - k]
                for i, anchor in enumerate(a_ids[own]):
                    at = np.flatnonzero(part[i] >= least[i])
                    s = part[i][at]
                    # places are in the order of ids, so a stable sort leaves ties so
                    order = np.argsort(~s, kind="stable")[:k]  # ~x falls as x rises, without overflow
                    found = x["r_ids"][rows[at[order]]]
                    keep = found != anchor
                    out.append((np.full(int(keep.sum()), anchor), found[keep], s[order][keep]))
        return _columns(_POSITIVES, out)

    return f


def _best_negatives(most: int, low: int, high: int) -> Callable:
    def f(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:  # noqa: ARG001
        out: list[tuple] = []
        if not left.num_rows or not right.num_rows:
            return _NEGATIVES.empty_table()
        for strip, scores, x in _strips(left, right):
            # low * wanted <= 100 * score <= high * wanted, in whole numbers; by anchor
            asked: dict[int, list[tuple[int, int, int, int]]] = {}
            begin, end = np.searchsorted(x["wanted"][:, 0], [strip.start, strip.stop])
            for i, positive, wanted in x["wanted"][begin:end].tolist():
                if (least := -(low * -wanted // 100)) <= (top := high * wanted // 100):
                    asked.setdefault(i - strip.start, []).append((positive, wanted, least, top))
            for i, windows in asked.items():
                s = scores[i]
                # only what lies in some window is put in order
                at = np.flatnonzero((s >= min(w[2] for w in windows)) & (s <= max(w[3] for w in windows)))
                at = at[x["r_labels"][at] != x["a_labels"][strip.start + i]]
                at = at[np.argsort(~s[at], kind="stable")]
                falling = ~s[at]
                for positive, wanted, least, top in windows:
                    first = int(np.searchsorted(falling, ~top, "left"))
                    found = at[first : min(first + most, int(np.searchsorted(falling, ~least, "right")))]
                    anchor = x["a_ids"][strip.start + i]
                    out.append((*(np.full(len(found), v) for v in (anchor, positive, wanted)), x["r_ids"][found], s[found]))
        return _columns(_NEGATIVES, out)

    return f


def _tiles(anchors: DataFrame, rows: DataFrame, dims: int, best: Callable, names: str) -> DataFrame:
    """What `best` leaves of the tiles of every anchor block and row block of its shard."""
    chunk = max(CHUNK, -(-dims // MOST_CHUNKS))
    a, a_blocks = _panels(anchors, BLOCK_ANCHORS, BLOCK_ANCHORS, dims, chunk)
    r, r_blocks = _panels(rows, BLOCK_ROWS, MOST_ROWS, dims, chunk)
    n = a_blocks.withColumnRenamed("n_blocks", "m").join(F.broadcast(r_blocks), "shard").agg(F.sum(F.col("m") * F.col("n_blocks"))).first()[0] or 1
    many = lambda d, blocks, name: d.join(F.broadcast(blocks), "shard").withColumn(name, F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).drop("n_blocks")
    keys = ["shard", "ab", "rb"]
    # panels are small beside the work on them: so many partitions that tiles are not put together in few tasks
    dealt = lambda d: d.repartition(min(2 * n, 2000), *keys).groupBy(*keys)
    left = many(a.withColumnRenamed("block", "ab"), r_blocks, "rb")
    right = many(r.withColumnRenamed("block", "rb"), a_blocks, "ab")
    return dealt(left).cogroup(dealt(right)).applyInArrow(best, names)


def hard_negatives(rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: points().  A score is the inner product with the anchor; a shorter
    vector counts as filled up with zeros.  Higher scores come first, ties by
    smaller vec_id.  An anchor's positives are its first `n_positives` other
    rows of the same label (all, if fewer); for each, the first `n_negatives`
    rows of other labels with low% <= score / positive's score <= high% are
    given.  Anchors without positives, and positives without such rows, give
    none; so does an empty table.  Scores must fit 64 bits.
    """
    kept = table(rows.withColumn("is_anchor", F.coalesce(is_anchor, F.lit(False))), "points")
    dims = kept.agg(F.max(F.size("x"))).first()[0] or 0
    group = F.pmod(F.xxhash64("label"), F.lit(LABEL_GROUPS)).cast("int").alias("shard")
    own = ["vec_id", "label", "x"]
    found = _tiles(kept.where("is_anchor").select(group, *own), kept.select(group, *own), dims, _best_positives(n_positives), "anchor_id long, vec_id long, score long")
    first = lambda by, score, tie, most: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie)) <= most
    best = found.withColumn("_in", first(["anchor_id"], "score", "vec_id", n_positives)).where("_in")
    wanted = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("vec_id", "score")).alias("wanted"))
    wanted = table(wanted, "positives")
    everywhere = F.lit(0).alias("shard")
    names = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    asking = kept.where("is_anchor").join(wanted, "vec_id").select(everywhere, *own, "wanted")
    near = _tiles(asking, kept.select(everywhere, *own), dims, _best_negatives(n_negatives, low, high), names)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    out = near.withColumn("rank", rank).where(F.col("rank") <= n_negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: The contract's relabelling, scaling, anchors and windows.
SQL = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS vec_id, a.label = r.label AS same, CAST(list_sum(list_transform(list_zip(a.x, r.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e a JOIN e r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3"""
