"""Pair features in three generations: 21, 56 and 150 columns.

Entities are prepared once (normal forms, words, gram sets), joined to the pair table
twice, and features are projected in stages, so no text is normalised for every pair and
no stage's code grows too long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import similarity as sim, text as tx, udfs
from ..functions.similarity import flag

C = F.col


def enrich(pairs: DataFrame, s1: DataFrame, other: DataFrame) -> DataFrame:
    """Pairs with the columns of both sides, prefixed by a_ and b_.  Pairs whose partner is unknown go."""
    left = s1.select([C(c).alias("s1" if c == "entity_id" else f"a_{c}") for c in s1.columns])
    right = other.select([C(c).alias("o" if c == "entity_id" else f"b_{c}") for c in other.columns])
    return pairs.join(right, "o").join(left, "s1", "left")


def prepared(entities: DataFrame) -> DataFrame:
    """(entity_id, n, a, c, raw, words and gram sets) for the first two generations."""
    e = entities.select(
        "entity_id",
        tx.text(C("business_name")).alias("raw"),
        tx.normalize_name(C("business_name")).alias("n"),
        tx.normalize_address(C("business_address")).alias("a"),
        tx.normalize_country(C("country")).alias("c"),
    ).withColumn("f", F.concat("n", F.lit(" "), "a"))
    return e.withColumns(
        {
            **{f"{x}t": tx.tokens(C(x)) for x in "naf"},
            **{f"{x}3": tx.grams(C(x), 3) for x in "naf"},
            **{f"{x}4": tx.grams(C(x), 4) for x in "na"},
            "n5": tx.grams(C("n"), 5),
            "nn": sim.numbers(C("n")),
            "an": sim.numbers(C("a")),
            "p": sim.postal(C("a")),
        }
    )


def _ab(name: str) -> tuple[Column, Column]:
    return C(f"a_{name}"), C(f"b_{name}")


def _length_ratio(name: str) -> Column:
    a, b = _ab(name)
    return F.length(a) / (F.length(b) + 1e-6)


def features_21(pairs: DataFrame, s1: DataFrame, other: DataFrame) -> DataFrame:
    """(s1, o) and the 21 basic features."""
    p = enrich(pairs.select("s1", "o"), prepared(s1), prepared(other))
    n, a, nt, at = _ab("n"), _ab("a"), _ab("nt"), _ab("at")
    cut = lambda x, k: F.left(x, F.lit(k))
    return p.select(
        "s1",
        "o",
        sim.jaccard(*nt).alias("name_jaccard"),
        sim.overlap(*nt).alias("name_token_overlap"),
        sim.edit_share(*n, 60).alias("name_edit_distance_norm"),
        sim.jaccard(*_ab("n3")).alias("name_char3_overlap"),
        sim.jaccard(*_ab("n4")).alias("name_char4_overlap"),
        flag(cut(n[0], 6) == cut(n[1], 6)).alias("name_prefix_6"),
        flag(cut(n[0], 4) == cut(n[1], 4)).alias("name_prefix_4"),
        _length_ratio("n").alias("name_len_ratio"),
        sim.common(*nt).cast("double").alias("name_common_tokens"),
        sim.jaccard(*at).alias("addr_jaccard"),
        sim.overlap(*at).alias("addr_token_overlap"),
        sim.edit_share(*a, 60).alias("addr_edit_distance_norm"),
        sim.jaccard(*_ab("a3")).alias("addr_char3_overlap"),
        _length_ratio("a").alias("addr_len_ratio"),
        flag(C("a_c") == C("b_c")).alias("country_exact_match"),
        sim.jaccard(*_ab("ft")).alias("name_addr_jaccard"),
        flag(F.contains(a[1], cut(n[0], 6)) | F.contains(a[0], cut(n[1], 6))).alias("name_in_addr"),
        *[F.length(C(f"{x}_{y}")).cast("double").alias(f"{s}_{w}_len") for y, w in (("n", "name"), ("a", "addr")) for x, s in (("a", "s1"), ("b", "s2"))],
    )


def features_56(pairs: DataFrame, s1: DataFrame, other: DataFrame, vectors: DataFrame | None = None, native: bool = False) -> DataFrame:
    """(s1, o) and the 56 features; with ``native``, without the five that need Python.

    ``vectors`` has (entity_id, name_v, addr_v, full_v); without it those six features are 0.
    """
    left, right = prepared(s1), prepared(other)
    if vectors is not None:
        left, right = (x.join(vectors, "entity_id", "left") for x in (left, right))
    p = enrich(pairs.select("s1", "o"), left, right)
    n, a, f, nt, at, nn, an, post = (_ab(x) for x in ("n", "a", "f", "nt", "at", "nn", "an", "p"))

    def prefix(k: int) -> Column:
        x, y = (F.left(s, F.lit(k)) for s in n)
        return flag((x == y) & (n[0] != "") & (n[1] != ""))

    inside = lambda short, whole: flag((F.length(short) > 0) & F.contains(whole, F.left(short, F.lit(6))))
    python = {} if native else {
        "name_jaro_winkler": udfs.jaro_winkler(*n), "name_token_sort_ratio": udfs.token_sort_ratio(*n), "name_partial_ratio": udfs.partial_ratio(*n),
        "addr_partial_ratio": udfs.partial_ratio(*a), "addr_token_sort_ratio": udfs.token_sort_ratio(*a),
    }
    vec = {}
    for key, col in (("name", "name_v"), ("addr", "addr_v"), ("combined", "full_v")):
        vec[f"emb_{key}_cosine"] = sim.vector_cosine(*_ab(col)) if vectors is not None else F.lit(0.0)
        vec[f"emb_{key}_l2"] = sim.vector_l2(*_ab(col)) if vectors is not None else F.lit(0.0)
    features = {
        "name_jaccard": sim.jaccard(*nt),
        "name_token_overlap": sim.overlap(*nt),
        "name_edit_norm": sim.edit_share(*n),
        **{f"name_char{k}_overlap": sim.jaccard(*_ab(f"n{k}")) for k in (3, 4, 5)},
        "name_prefix6_match": prefix(6),
        "name_prefix4_match": prefix(4),
        "name_first_token_match": sim.first_match(*nt),
        "name_last_token_match": sim.first_match(*nt, -1),
        "name_len_ratio": _length_ratio("n"),
        "name_common_token_count": sim.common(*nt).cast("double"),
        "name_initialism": sim.initialism(*n, *nt),
        "name_has_legal_a": sim.matches(C("a_raw"), tx.LEGAL_MARKERS),
        "name_has_legal_b": sim.matches(C("b_raw"), tx.LEGAL_MARKERS),
        "name_number_overlap": sim.jaccard(*nn),
        "name_conflicting_numbers": sim.conflicting(*nn),
        "addr_jaccard": sim.jaccard(*at),
        "addr_token_overlap": sim.overlap(*at),
        "addr_edit_norm": sim.edit_share(*a),
        **{f"addr_char{k}_overlap": sim.jaccard(*_ab(f"a{k}")) for k in (3, 4)},
        "addr_first_token_match": sim.first_match(*at),
        "addr_last_token_match": sim.first_match(*at, -1),
        "addr_len_ratio": _length_ratio("a"),
        "addr_number_overlap": sim.jaccard(*an),
        "addr_conflicting_numbers": sim.conflicting(*an),
        "addr_pincode_match": sim.postal_match(*post),
        "addr_pincode_exact": F.coalesce(flag(post[0] == post[1]), F.lit(0.0)),
        "country_exact_match": flag(C("a_c") == C("b_c")),
        "country_both_known": flag((C("a_c") != "unknown") & (C("b_c") != "unknown")),
        "combined_jaccard": sim.jaccard(*_ab("ft")),
        "combined_token_overlap": sim.overlap(*_ab("ft")),
        "combined_char3_overlap": sim.jaccard(*_ab("f3")),
        "name_in_addr_a": inside(n[0], a[1]),
        "name_in_addr_b": inside(n[1], a[0]),
        "combined_edit_norm": sim.edit_share(*f),
        "s1_name_len": F.length(n[0]), "s2_name_len": F.length(n[1]), "s1_addr_len": F.length(a[0]), "s2_addr_len": F.length(a[1]),
        "name_len_diff": F.abs(F.length(n[0]) - F.length(n[1])), "addr_len_diff": F.abs(F.length(a[0]) - F.length(a[1])),
        "s1_name_token_count": F.size(nt[0]), "s2_name_token_count": F.size(nt[1]),
        **vec,
        **python,
    }
    return p.select("s1", "o", *[v.cast("double").alias(k) for k, v in features.items()])


def features_63(scored: DataFrame, s1: DataFrame, other: DataFrame, vectors: DataFrame | None = None, native: bool = False) -> DataFrame:
    """(s1, o), seven columns of the candidate itself (sn, sa and slot come with it), and :func:`features_56`."""
    sn, sa = F.col("sn"), F.col("sa")
    name = lambda x: F.lower(tx.strip(tx.text(F.col(f"{x}_business_name"))))
    own = enrich(scored.select("s1", "o", "sn", "sa", "slot"), s1, other).select(
        "s1", "o", sn.alias("cand_sn"), sa.alias("cand_sa"), F.col("slot").alias("cand_slot"), (sn + sa).alias("cand_sim_sum"),
        (sn / F.greatest(sa, F.lit(1.0))).alias("cand_rel_margin"), flag(F.col("o").startswith("S2-")).alias("is_source_2"),
        flag(name("a") == name("b")).alias("exact_norm_name"),
    )
    return own.join(features_56(scored, s1, other, vectors, native), ["s1", "o"])
