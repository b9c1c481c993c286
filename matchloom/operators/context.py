"""Columns that say how a candidate stands among the others of its query row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import similarity as sim, text as tx
from .features import enrich


def candidate_scores(pairs: DataFrame, s1: DataFrame, other: DataFrame) -> DataFrame:
    """(s1, o, sn, sa, slot): word-set similarities of name and address from 0 to 100, and the place per source.

    slot counts from 0 by sn + sa descending, ties by id, separately for each source of the partner.
    """
    words = lambda e: e.select(
        "entity_id",
        F.array_distinct(tx.tokens(F.lower(tx.text(F.col("business_name"))))).alias("n"),
        F.array_distinct(tx.tokens(F.lower(tx.text(F.col("business_address"))))).alias("a"),
    )
    p = enrich(pairs.select("s1", "o"), words(s1), words(other))
    scored = p.select(
        "s1",
        "o",
        F.round(100 * sim.jaccard(F.col("a_n"), F.col("b_n")), 6).alias("sn"),
        F.round(100 * sim.jaccard(F.col("a_a"), F.col("b_a")), 6).alias("sa"),
    )
    order = Window.partitionBy("s1", F.substring_index("o", "-", 1)).orderBy(F.desc(F.col("sn") + F.col("sa")), "o")
    return scored.withColumn("slot", F.row_number().over(order) - 1)


def context_columns(scored: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """Adds rank, total_cands, top_sim, gap_to_next, gap_from_second and, given entities, the densities.

    A density is the number of the query row's candidates with the same postal code, the same last address word
    or the same first 4 name characters; a candidate without one counts itself only.
    """
    total = F.round(F.col("sn") + F.col("sa"), 6)
    per = Window.partitionBy("s1")
    order = per.orderBy(F.desc("total"), "o")
    out = scored.withColumn("total", total).withColumns(
        {
            "rank": F.row_number().over(order) - 1,
            "total_cands": F.count("*").over(per),
            "top_sim": F.max("total").over(per),
            "gap_to_next": F.round(F.coalesce(F.col("total") - F.lead("total").over(order), F.lit(0.0)), 6),
            "second": F.nth_value("total", 2).over(
                order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            ),
        }
    )
    out = out.withColumn("gap_from_second", F.round(F.coalesce(F.col("total") - F.col("second"), F.lit(0.0)), 6)).drop("second", "total")
    if other is None:
        return out
    keys = other.select(
        F.col("entity_id").alias("o"),
        sim.postal(F.lower(tx.text(F.col("business_address")))).alias("kz"),
        F.try_element_at(tx.tokens(F.lower(tx.text(F.col("business_address")))), F.lit(-1)).alias("kc"),
        F.nullif(F.left(F.lower(tx.text(F.col("business_name"))), F.lit(4)), F.lit("")).alias("kp"),
    )
    out = out.join(keys, "o", "left")
    for key, name in (("kz", "zip_density"), ("kc", "city_density"), ("kp", "prefix_density")):
        out = out.withColumn(name, F.when(F.col(key).isNull(), 1).otherwise(F.count("*").over(Window.partitionBy("s1", key))))
    return out.drop("kz", "kc", "kp")
