"""Line dedup by distinct-site spread.

A line of MIN_WORDS words or more that stands on MIN_SITES distinct sites
(here: sources) or more is boilerplate and is removed everywhere.

Lines are hashed (128 bits) once per document, into a table in the shared
folder.  Counts and the least and greatest site of each line, which need no
sketch, leave out lines that cannot reach the threshold: most occur once.  For
the others HyperLogLog sketches of sites, made map-side per line and merged by
the aggregation, estimate the spread.  Where the estimate is within NEAR of the
threshold, sites are counted exactly.  A line that a third of all documents
share is summed up in every task before it is shuffled.

Joins with lines of documents broadcast the other side only after counting it;
beyond BROADCAST_ROWS they spread each key over SALTS partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright.llm.common import WORD, identified, source_key, table

MIN_SITES = 10
MIN_WORDS = 5
#: Sketches have 2 ** LG_K registers: a standard error of 1.04 / 2 ** (LG_K / 2), 3.3 %.
LG_K = 10
#: Relative distance from the threshold within which sites are counted exactly: five standard errors.
NEAR = 0.17
BROADCAST_ROWS, SALTS = 1 << 18, 16
_KEY = ["h1", "h2"]


def _hashes(line: Column) -> tuple[Column, Column]:
    return F.xxhash64(line), F.xxhash64(F.lit("line"), line)


def line_table(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text, source): row, doc_id, site, n_lines, n_bytes, and its long lines' hashes."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    h1, h2 = (lambda x: _hashes(x)[0]), (lambda x: _hashes(x)[1])
    long_lines = F.filter(lines, lambda x: F.regexp_count(x, F.lit(WORD)) >= MIN_WORDS)
    hashes = F.transform(long_lines, lambda x: F.struct(h1(x).alias("h1"), h2(x).alias("h2"), F.octet_length(x).alias("size")))
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.xxhash64(source_key(F.col("source"))).alias("site"),
        F.size(lines).cast("long").alias("n_lines"),
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        hashes.alias("lines"),
    )


def _exploded(made: DataFrame) -> DataFrame:
    return made.select("row", "site", F.explode("lines").alias("x")).select("row", "site", "x.h1", "x.h2", "x.size")


def matching(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """The lines whose hashes are in `keys` (a table()), however often one of them occurs."""
    if keys.count() <= BROADCAST_ROWS:
        return lines.join(F.broadcast(keys), _KEY)
    salted = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return lines.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, [*_KEY, "salt"]).drop("salt")


def boilerplate(made: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h1, h2 of the lines on `min_sites` sites or more, from a line_table()."""
    lines = _exploded(made)
    counts = lines.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"), F.min("site").alias("a"), F.max("site").alias("b"))
    often = table(counts.where((F.col("n") >= min_sites) & ((F.col("a") != F.col("b")) | F.lit(min_sites <= 1))).select(*_KEY), "often")
    sketches = matching(lines, often).groupBy(*_KEY).agg(F.hll_sketch_agg("site", LG_K).alias("sites"))
    spread = table(sketches.select(*_KEY, F.hll_sketch_estimate("sites").alias("about")), "spread")
    near = F.col("about").between(min_sites * (1 - NEAR) - 1, min_sites * (1 + NEAR) + 1)
    close = table(spread.where(near).select(*_KEY), "close")
    exact = matching(lines, close).select(*_KEY, "site").distinct().groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"))
    far = spread.where(~near & (F.col("about") >= min_sites)).select(*_KEY)
    return far.unionByName(exact.where(F.col("n") >= min_sites).select(*_KEY))


def line_report(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, n_lines, n_removed, bytes_left for every row of docs.

    n_lines counts all lines of the text, split at line ends; bytes_left is the
    UTF-8 size of what is left, joined by line ends.  Null texts count as
    empty: one empty line.  A null source is a site of its own.  Repeated rows
    are reported each.
    """
    made = table(line_table(docs), "lines")
    bad = table(boilerplate(made, min_sites), "boilerplate")
    found = matching(_exploded(made), bad).groupBy("row").agg(F.count(F.lit(1)).alias("n_removed"), F.sum(F.col("size") + 1).cast("long").alias("gone"))
    out = made.drop("lines", "site").join(found, "row", "left")
    n = F.coalesce("n_removed", F.lit(0)).cast("long")
    left = F.when(n >= F.col("n_lines"), F.lit(0)).otherwise(F.col("n_bytes") - F.coalesce("gone", F.lit(0)))
    return out.select("doc_id", "n_lines", n.alias("n_removed"), left.cast("long").alias("bytes_left"))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """docs with boilerplate lines cut from the text, columns as they came whatever their names; null texts stay null.

    Repeated rows, and rows of one or no doc_id, are documents of their own.
    """
    bad = table(boilerplate(table(line_table(docs), "lines"), min_sites), "boilerplate")
    if bad.isEmpty():
        return docs
    rows = identified(docs)
    lines = rows.select("file", "at", F.posexplode(F.split("row.text", "\n", -1)).alias("pos", "line"))
    lines = lines.where(F.regexp_count("line", F.lit(WORD)) >= MIN_WORDS)
    lines = lines.select("file", F.col("at").alias("row"), "pos", _hashes(F.col("line"))[0].alias("h1"), _hashes(F.col("line"))[1].alias("h2"))
    gone = matching(lines, bad).groupBy("file", F.col("row").alias("at")).agg(F.collect_set("pos").alias("gone"))
    left = F.array_join(F.filter(F.split("row.text", "\n", -1), lambda x, i: ~F.array_contains("gone", i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(left)
    cut = [(text if c.lower() == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    return rows.join(gone, ["file", "at"], "left").select(*cut)


#: The report in SQL, with exact counts.
REPORT_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
x AS (SELECT r, source, unnest(lines) AS line FROM d),
y AS (SELECT * FROM x WHERE len(regexp_extract_all(line, '{WORD}')) >= {MIN_WORDS}),
b AS (SELECT line FROM y GROUP BY line HAVING count(DISTINCT coalesce('0' || source, '1')) >= {MIN_SITES}),
g AS (SELECT r, count(*) AS n, sum(strlen(line) + 1) AS gone FROM y JOIN b USING (line) GROUP BY r)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  CAST(CASE WHEN coalesce(n, 0) >= len(lines) THEN 0 ELSE strlen(array_to_string(lines, chr(10))) - coalesce(gone, 0) END AS BIGINT) AS bytes_left
FROM d LEFT JOIN g USING (r)
"""
