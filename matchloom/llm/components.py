"""Connected components by alternating large-star and small-star steps.

Both steps are an aggregate and an equi-join on narrow (long, long) rows, so a
hub with very many neighbours is never gathered in one task: its minimum is
pre-aggregated before the shuffle and the join back can be split by AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .storage import durable, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u > v) after one step; every node keeps a path to its component's minimum."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    near = both.join(low, "u")
    if large:
        out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node with an edge to another one.

    Null ends and loops are ignored; an empty edge table gives an empty result.
    Each round is written to the shared folder, so a lost executor costs one round.
    The loop ends when a round leaves the edge set as it was.
    """
    now = durable(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
        .distinct(),
        "edges",
    )
    seen = _digest(now)
    while seen[0]:
        after = durable(_star(_star(now, True), False), "edges")
        release(now)
        now, before, seen = after, seen, _digest(after)
        if seen == before:
            break
    labels = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return durable(labels.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct(), "labels")


def _digest(edges: DataFrame) -> tuple:
    """Row count and two order-free hashes of the edge set."""
    h = F.xxhash64("u", "v")
    row = edges.agg(
        F.count("*").alias("n"), F.sum(h.bitwiseAND(0xFFFFFFFF)).alias("x"), F.sum(F.shiftrightunsigned(h, 32)).alias("y")
    ).first()
    return row["n"], row["x"], row["y"]
