"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum (summed up before the shuffle) and a join of the edges with it.  Nodes of many edges
are met by a broadcast, not by the shuffle, so a node with any number of neighbours is no single task's burden: there
are at most MOST_HUBS of them, whatever the number of edges.  Nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard
from .common import stored

#: A hub has more than LEAST_HUB edges, and more than a MOST_HUBS-th of all.
LEAST_HUB, MOST_HUBS = 256, 100_000


def _met(edges: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """edges with the minimum m of their node a.  least: a, m, n (edges of a); n: edges in all."""
    hub = F.col("n") > max(LEAST_HUB, 2 * n // MOST_HUBS)
    hubs = F.broadcast(least.where(hub).select("a", F.col("m").alias("h")))  # at most MOST_HUBS rows
    tagged = edges.join(hubs, "a", "left")
    others = tagged.where("h is null").drop("h").join(least.where(~hub).select("a", "m"), "a")
    return tagged.where("h is not null").select("a", "b", F.col("h").alias("m")).unionAll(others)


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """edges (a > b).  Large: each node ties its larger neighbours to its smallest one (or itself).  Small: the others."""
    if large:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        # larger neighbours only: the other direction of the edges
        out = _met(edges.select(F.col("b").alias("a"), F.col("a").alias("b")), least, n).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        out = _met(edges, least, n).select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
    return out.where("a > b").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: columns a, b (long, not null).  Returns node, root for every node of an edge; root is its component's least node.

    Loops and repeated edges do no harm; no edges give no rows.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    n, state = now.count(), None
    for _ in range(most_rounds):
        before, now = now, stored(_star(_star(now, True, n), False, n), "stars")
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        discard(before)
        if seen == state or not seen[0]:
            break
        n, state = seen[0], seen
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
