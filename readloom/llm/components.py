"""Connected components of a link table by alternating large-star and small-star steps.

Both steps are an aggregation and an equi-join over links.  A node with very many
neighbours is pre-aggregated on the map side and joined by broadcast.  Every step is
written to the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm._common import BROADCAST_ROWS, durable


#: Links of a node, at least, from which its smallest neighbour is broadcast.
LARGE = 512


def _with_least(near: DataFrame, links: int) -> DataFrame:
    """near(u, v) with m, the smallest of u and its neighbours.

    Nodes with very many of the links, of which there are few, are joined by
    broadcast, so that no task gets all links of one node.
    """
    by = near.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    most = max(LARGE, links // BROADCAST_ROWS)
    if links <= most:
        return near.join(by.drop("n"), "u")
    large = durable(by.where(F.col("n") > most).select("u", "m"), BROADCAST_ROWS)
    if large.isEmpty():
        return near.join(by.drop("n"), "u")
    rest = near.join(F.broadcast(large.select("u")), "u", "left_anti")
    few = by.where(F.col("n") <= most).drop("n")
    return near.join(F.broadcast(large), "u").unionByName(rest.join(few, "u"))


def _star(links: DataFrame, large: bool, number: int) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v < u")
    joined = _with_least(near, 2 * number)
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, component) for every node of links(u, v); component is the smallest node it reaches.

    Ids are long.  Self-links and repeated links are allowed, null ends are
    dropped.  A node that occurs only in self-links has no row.  rows bounds the
    number of links, if that is known.
    """
    edges = durable(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), rows
    )
    state = _state(edges)
    while state[0]:
        # a round never makes more links than twice those it gets
        edges = durable(_star(edges, True, state[0]), 2 * state[0])
        edges = durable(_star(edges, False, 2 * state[0]), 2 * state[0])
        last, state = state, _state(edges)
        if state == last:
            break
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
