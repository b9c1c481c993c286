"""Sharding by a hierarchical weighted hash tree, all as Spark expressions.

Leaves are shards, grouped into racks and regions; a node weighs what its leaves
weigh.  A key descends from the root: at every level each child draws
``-ln(u) / weight`` with u hashed from the key and the child's name, and the smallest
draw wins.  Draws of other children don't change when one child's weight does, so keys
move only into a subtree that grew or out of one that shrank.  A new shard is added as
a region of its own; then it takes keys from everywhere and no other shard gets any.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Runs that the rows of a shard are numbered in.
RUNS = 1024


@dataclass(frozen=True)
class Leaf:
    """A shard and its place in the tree."""

    shard: int
    rack: str
    region: str
    weight: float = 1.0


def balanced(shards: int, racks: int = 4, regions: int = 2) -> tuple[Leaf, ...]:
    """Shards 0 to ``shards`` - 1 in racks of equal size (as far as they go), racks in regions likewise."""
    out = []
    for s in range(shards):
        rack = s * racks // shards
        out.append(Leaf(s, f"rack{rack}", f"region{rack * regions // racks}"))
    return tuple(out)


def grown(tree: tuple[Leaf, ...], weight: float = 1.0) -> tuple[Leaf, ...]:
    """The tree with one more shard, in a new region."""
    n = max((x.shard for x in tree), default=-1) + 1
    return (*tree, Leaf(n, f"rack-{n}", f"region-{n}", weight))


def reweighted(tree: tuple[Leaf, ...], shard: int, weight: float) -> tuple[Leaf, ...]:
    """The tree with another weight of one shard."""
    return tuple(replace(x, weight=weight) if x.shard == shard else x for x in tree)


def _pick(key: Column, children: list[tuple[str, float, Callable[[], Column]]]) -> Column:
    """The value of the child with the smallest draw; equal draws go to the first name."""
    if len(children) == 1:
        return children[0][2]()
    draws = []
    for name, weight, _ in children:
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(name), key), 11).cast("double") + 0.5) * 2.0**-53
        draws.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("draw"), F.lit(name).alias("name")))
    best = F.array_min(F.array(*draws))["name"]
    out = F.when(best == children[0][0], children[0][2]())
    for name, _, value in children[1:]:
        out = out.when(best == name, value())
    return out


def shard_of(key: Column, tree: tuple[Leaf, ...]) -> Column:
    """The shard of a 64-bit key: three levels of weighted draws."""

    def level(leaves: list[Leaf], names: tuple[str, ...], prefix: str) -> Column:
        if not names:
            return F.lit(leaves[0].shard)
        groups: dict[str, list[Leaf]] = {}
        for x in leaves:
            groups.setdefault(str(getattr(x, names[0])), []).append(x)
        return _pick(
            key,
            [
                (f"{prefix}/{g}", sum(x.weight for x in members), lambda m=members, g=g: level(m, names[1:], f"{prefix}/{g}"))
                for g, members in sorted(groups.items())
            ],
        )

    live = [x for x in tree if x.weight > 0]
    if not live:
        raise ValueError("the tree has no shard with a weight")
    return level(live, ("region", "rack", "shard"), "")


def shard(docs: DataFrame, tree: tuple[Leaf, ...], id_col: str = "doc_id", more: tuple[Leaf, ...] | None = None) -> DataFrame:
    """Adds shard, slot (gapless from 0 in every shard) and, with another tree ``more``, grown_shard.

    The id alone decides; rows that share an id share a shard, and rows with a null id lie in one shard.  Slots
    follow a hash of the row within runs, whose totals are pre-aggregated, so no
    shard is numbered in one task.  Equal rows are interchangeable.  An empty table stays empty.
    """
    key = F.xxhash64(F.col(id_col))
    columns = [c for c in docs.columns if c not in ("shard", "slot", "grown_shard")]
    # Runs by id and by the whole row: rows that share an id, or have none, spread too.
    rows = docs.select(*columns).withColumn("_row", F.xxhash64(*columns)).withColumn("_run", F.pmod("_row", F.lit(RUNS)))
    rows = rows.withColumn("shard", shard_of(key, tree))
    if more is not None:
        rows = rows.withColumn("grown_shard", shard_of(key, more))
    totals = rows.groupBy("shard", "_run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", "_run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("shard", "_run").orderBy("_row", *columns)
    out = rows.withColumn("_at", F.row_number().over(within) - 1).join(bases, ["shard", "_run"])
    added = ["shard", "slot"] + ["grown_shard"] * (more is not None)
    return out.withColumn("slot", (F.col("_at") + F.col("_base")).cast("long")).select(*columns, *added)
