"""Consistency of a stream of triples.

The ontology's tables are static; triples arrive with an event time `ts`.
State is bounded by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_triples(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each triple once within the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["s", "p", "o"])


def functional_violations(stream: DataFrame, functional: DataFrame, window: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """window, s, p, n_values: subjects with more than one value of a functional property in a window.

    functional has one column, p.  Values are counted by their distinct hashes,
    kept as a set per key and window; a functional property has few.
    """
    own = stream.withWatermark("ts", delay).join(functional, "p", "left_semi")
    counts = own.groupBy(F.window("ts", window), "s", "p").agg(F.size(F.collect_set(F.xxhash64("o"))).alias("n_values"))
    return counts.where("n_values > 1")


def typed_stream(stream: DataFrame, domains: DataFrame) -> DataFrame:
    """s, class, ts: types that a property's domain entails, by a stream-static join; domains has p and class."""
    return stream.join(domains, "p").select("s", "class", "ts")
