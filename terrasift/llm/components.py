"""Connected components of a graph of ids by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrasift.llm.common import dropped, stored

#: An id is a hub with more edges than this and than a HUBS-th of all: so there are 2 * HUBS at most.
HUB_EDGES, HUBS = 500, 2000


def with_least(edges: DataFrame, limit: int) -> DataFrame:
    """(u, v, m) of edges (u, v): m is the smallest v of u.

    An id with more than limit edges would fill one task of a shuffled join, so those meet their m by broadcast: they
    are as many as edges / limit at most. m itself is a minimum combined before the shuffle.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d"))
    hubs = least.where(F.col("d") > limit).select("u", "m")
    rest = edges.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(least.where(F.col("d") <= limit).select("u", "m"), "u")
    return edges.join(F.broadcast(hubs), "u").unionByName(rest)


def _stars(edges: DataFrame, n: int) -> DataFrame:
    """One large-star and one small-star step over n edges (u > v)."""
    limit = max(HUB_EDGES, n // HUBS)
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = with_least(both, limit).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    # u > v holds again: v is at most the old u, which was less than the old v. A node's smallest neighbour takes the others.
    large = stored(large.distinct(), "large")
    small = with_least(large, limit)
    out = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") > F.col("v")).unionByName(small.select("u", F.col("m").alias("v")))
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (a, b) that isn't its component's smallest; component is that smallest id.

    The edge table is written to the shared folder in each round, so neither lineage nor the driver grows with
    it. Rounds needed grow with the logarithm of the largest component.
    """
    now = stored(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        got = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == (got.n, got.h) or not got.n:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        state = (got.n, got.h)
        after = stored(_stars(now, got.n), "edges")
        dropped(now)
        now = after
