"""Connected components of a distributed edge list by alternating large and small stars.

Defined cases: edges with a null end take no part; repeated edges, loops and either direction make no difference; no edges, no rows; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"] or 0


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` of every node that isn't its component's smallest, from edges ``(u, v)``.

    All groupings are minima with map-side combining, so a node with very many neighbours costs no task its list.
    Each round is cut in the shared checkpoint folder; the rounds grow with the logarithm of the longest path.
    """
    e = edges.filter("u is not null and v is not null").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b"))
    e = cut(e.filter(F.col("a") != F.col("b")).distinct())
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        state, before = _state(e), state
        if state == before:
            break
    return e.select(F.col("a").alias("id"), F.col("b").alias("component"))
