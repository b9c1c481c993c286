"""The 150-column generation of pair features, projected group by group.

Every group is a dict of columns over what earlier stages made, so its order is the
order of the result.  ``context`` columns (see ``context.py``) are used where the pair
table has them; else the documented defaults hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import similarity as sim, text as tx, udfs
from ..functions.similarity import flag
from .features import enrich

C = F.col
#: Context columns and their defaults; None: derived from features.
CONTEXT = {
    "emb_name_cos": None, "emb_addr_cos": None, "emb_full_cos": None, "emb_rank": 0.0, "emb_margin": 0.0, "emb_score_ratio": 1.0,
    "rank": 0.0, "total_cands": 1.0, "sn": None, "sa": None, "top_sim": None, "gap_to_next": 0.0, "gap_from_second": 0.0,
    "zip_density": 1.0, "city_density": 1.0, "prefix_density": 1.0, "slot": 0.0,
}


def prepared_full(entities: DataFrame) -> DataFrame:
    """(entity_id, trimmed and lower-cased fields, words, gram sets, numbers) for the third generation."""
    e = entities.select(
        "entity_id",
        tx.strip(tx.text(C("business_name"))).alias("name"),
        tx.strip(tx.text(C("business_address"))).alias("addr"),
        F.lower(tx.strip(tx.text(C("country")))).alias("c"),
    ).withColumns({"n": F.lower("name"), "a": F.lower("addr")})
    e = e.withColumns({"street": tx.strip(F.regexp_replace("a", "\\d+", "")), "legal": tx.without_legal(C("n"))})
    found = lambda words: F.array_distinct(F.regexp_extract_all(C("a"), F.lit(f"\\b({words})\\b"), F.lit(1)))
    return e.withColumns(
        {
            "nt": tx.tokens(C("n")), "at": tx.tokens(C("a")), "st": tx.tokens(C("street")), "lt": tx.tokens(C("legal")),
            "an": tx.alnum(C("n")), "chars": sim.char_set(C("n")), "digits": F.array_distinct(sim.numbers(C("a"))),
            **{f"n{k}": tx.grams(C("n"), k) for k in (2, 3, 4, 5)}, **{f"a{k}": tx.grams(C("a"), k) for k in (3, 4)},
            "zip": sim.postal(C("a")), "house": F.nullif(F.regexp_extract("a", "^\\D*(\\d+)", 1), F.lit("")),
            "units": found(tx.UNIT_WORDS), "winds": found(tx.CARDINALS),
        }
    ).withColumns({"w2": tx.word_grams(C("nt")), "acro": sim.initials(C("nt")), "vowels": sim.vowel_share(C("n"))})


def _ab(name: str) -> tuple[Column, Column]:
    return C(f"a_{name}"), C(f"b_{name}")


def _both(name: str) -> Column:
    a, b = _ab(name)
    return a.isNotNull() & b.isNotNull()


def _equal(name: str) -> Column:
    a, b = _ab(name)
    return flag((a == b) & (F.length(a) > 0))


def _end(name: str, n: int, side=F.left) -> Column:
    a, b = _ab(name)
    return flag((side(a, F.lit(n)) == side(b, F.lit(n))) & (F.length(a) >= n))


def _lengths(name: str, words: str) -> tuple[Column, Column, Column]:
    a, b = (F.length(x) for x in _ab(name))
    s, t = (F.size(x) for x in _ab(words))
    return F.least(a, b) / F.greatest(a, b, F.lit(1)), F.abs(a - b), F.abs(s - t)


def _names(native: bool) -> dict[str, Column]:
    n, nt, lt = _ab("n"), _ab("nt"), _ab("lt")
    most = F.greatest(sim.longest(*n), F.lit(1))
    ratio, diff, words = _lengths("n", "nt")
    acro = _ab("acro")
    heads = [F.coalesce(F.get(t, F.lit(0)), F.lit("")) for t in nt]
    spoken = (F.size(nt[0]) > 0) & (F.size(nt[1]) > 0)
    cut = [F.left(x, F.lit(50)) for x in n]
    none = F.lit(None).cast("double")
    return {
        "name_exact": _equal("name"),
        "name_exact_ci": _equal("n"),
        "name_alphanum_match": _equal("an"),
        "name_token_jaccard": sim.jaccard(*nt),
        "name_token_dice": sim.dice(*nt),
        "name_token_overlap": sim.overlap(*nt, 1.0),
        "name_token_simpson": sim.share_of_larger(*nt),
        "name_lev_ratio": sim.edit_similarity(*n),
        "name_jaro": none if native else udfs.indel_ratio(*n),
        "name_jaro_winkler": none if native else udfs.jaro_winkler(*n),
        **{f"name_char_{k}gram_jaccard": sim.jaccard(*_ab(f"n{k}")) for k in (2, 3, 4, 5)},
        "name_char_3gram_cosine": sim.set_cosine(*_ab("n3")),
        "name_word_2gram_jaccard": sim.jaccard(*_ab("w2")),
        **{f"name_prefix_{k}": _end("n", k) for k in (3, 4, 5, 6)},
        **{f"name_suffix_{k}": _end("n", k, F.right) for k in (3, 4)},
        "name_lcs_ratio": none if native else udfs.lcs_substring(*cut) / most,
        "name_lcsq_ratio": none if native else udfs.lcs_subsequence(*cut) / most,
        "name_length_ratio": ratio,
        "name_length_diff": diff,
        "name_token_count_diff": words,
        "name_clean_legal_match": _equal("legal"),
        "name_clean_legal_jaccard": sim.jaccard(*lt),
        "name_soundex_match": F.when(spoken, flag(F.soundex(heads[0]) == F.soundex(heads[1]))).otherwise(_end("n", 3)),
        "name_metaphone_match": none if native else F.when(spoken, flag(udfs.metaphone(heads[0]) == udfs.metaphone(heads[1]))).otherwise(_end("n", 3)),
        "name_first_word_exact": sim.first_match(*nt),
        "name_last_word_exact": sim.first_match(*nt, -1),
        "name_acronym_match": flag(((n[0] == acro[1]) | (n[1] == acro[0])) & (F.length(acro[0]) >= 2)),
        "name_rf_token_sort": none if native else udfs.token_sort_ratio(*n),
    }


def _addresses(native: bool) -> dict[str, Column]:
    a, at, street, house, zips = _ab("a"), _ab("at"), _ab("street"), _ab("house"), _ab("zip")
    units, winds, digits = _ab("units"), _ab("winds"), _ab("digits")
    ratio, diff, words = _lengths("a", "at")
    apart = F.abs(F.try_cast(house[0], "decimal(38,0)") - F.try_cast(house[1], "decimal(38,0)")) if hasattr(F, "try_cast") else F.abs(
        house[0].try_cast("decimal(38,0)") - house[1].try_cast("decimal(38,0)")
    )
    none = F.lit(None).cast("double")
    countries = (C("a_c") != "") & (C("b_c") != "")
    yes = lambda x: F.coalesce(flag(x), F.lit(0.0))
    partial = none if native else udfs.partial_ratio(*a)
    return {
        "addr_exact": _equal("addr"),
        "addr_token_jaccard": sim.jaccard(*at),
        "addr_token_overlap": sim.overlap(*at, 1.0),
        "addr_lev_ratio": sim.edit_similarity(*a),
        "addr_jaro_winkler": none if native else udfs.jaro_winkler(*a),
        "addr_char_3gram_cosine": sim.set_cosine(*_ab("a3")),
        "addr_char_4gram_cosine": sim.set_cosine(*_ab("a4")),
        "addr_house_num_exact": yes(house[0] == house[1]),
        "addr_house_num_both_present": flag(_both("house")),
        "addr_house_num_diff": F.coalesce(apart.cast("double"), F.lit(0.0)),
        "addr_street_name_sim": none if native else udfs.jaro_winkler(*street),
        "addr_zip_exact": yes(zips[0] == zips[1]),
        "addr_zip_both_present": flag(_both("zip")),
        "addr_zip_prefix_3": yes(F.left(zips[0], F.lit(3)) == F.left(zips[1], F.lit(3))),
        "addr_city_exact": flag(sim.common(*at) >= 2),
        "addr_city_sim": partial,
        "addr_state_country_match": flag(countries & (C("a_c") == C("b_c"))),
        "addr_length_ratio": ratio,
        "addr_length_diff": diff,
        "addr_token_count_diff": words,
        "addr_unit_match": flag(F.arrays_overlap(*units)),
        "addr_cardinal_dir_match": flag(F.arrays_overlap(*winds)),
        "addr_po_box_match": flag(F.contains(a[0], F.lit("po box")) & F.contains(a[1], F.lit("po box"))),
        "addr_first_word_match": sim.first_match(*at),
        "addr_last_word_match": sim.first_match(*at, -1),
        "addr_digit_overlap": sim.common(*digits) / F.greatest(F.size(F.array_union(*digits)), F.lit(1)),
        "addr_clean_street_jaccard": sim.jaccard(*_ab("st")),
        "addr_has_suite": flag((F.size(units[0]) > 0) | (F.size(units[1]) > 0)),
        "addr_rf_token_sort": none if native else udfs.token_sort_ratio(*a),
        "addr_rf_partial_ratio": partial,
    }


def _spread(values: list[Column]) -> tuple[Column, Column]:
    """Mean and population standard deviation."""
    mean = sum(values[1:], values[0]) / len(values)
    squares = [(v - mean) * (v - mean) for v in values]
    return mean, F.sqrt(sum(squares[1:], squares[0]) / len(values))


def _embeddings() -> dict[str, Column]:
    n, a, f = C("x_cos_n"), C("x_cos_a"), C("x_cos_f")
    mean, deviation = _spread([n, a, f])
    product = F.greatest(n * a * f, F.lit(0.0))
    return {
        "emb_name_cosine": n, "emb_addr_cosine": a, "emb_full_cosine": f, "emb_dot_product": n * a,
        "emb_euclidean_dist": F.sqrt(F.greatest(2 - 2 * f, F.lit(0.0))), "emb_manhattan_dist": F.abs(1 - n) + F.abs(1 - a),
        "emb_cosine_diff": F.abs(n - a), "emb_min_cosine": F.least(n, a), "emb_max_cosine": F.greatest(n, a),
        "emb_harmonic_mean_cosine": 2 * n * a / F.greatest(n + a, F.lit(1e-6)),
        "emb_prod_mean": mean, "emb_prod_std": deviation, "emb_prod_max": F.greatest(n, a, f), "emb_prod_min": F.least(n, a, f),
        "emb_norm_ratio": flag(f > 0.85), "emb_diff_norm": F.abs(n - f),
        "emb_top5_component_1": n * n, "emb_top5_component_2": a * a, "emb_top5_component_3": f * f, "emb_top5_component_4": F.cbrt(product),
        "emb_top5_component_5": flag((n > 0.90) & (a > 0.70)),
        "emb_dense_rank": C("x_emb_rank"), "emb_dense_margin": C("x_emb_margin"), "emb_dense_score_ratio": C("x_emb_score_ratio"),
        "emb_bge_confidence": flag(f > 0.88),
    }


def _candidates() -> dict[str, Column]:
    rank, total, sn, sa, top = C("x_rank"), C("x_total_cands"), C("x_sn"), C("x_sa"), C("x_top_sim")
    return {
        "cand_rank": rank, "cand_rank_percentile": rank / total, "cand_total_for_s1": total, "cand_sn": sn, "cand_sa": sa,
        "cand_sim_sum": sn + sa, "cand_sim_prod": sn * sa, "cand_sim_ratio": sn / F.greatest(sa, F.lit(0.01)),
        "cand_rel_margin": top - (sn + sa), "cand_rel_margin_ratio": (sn + sa) / F.greatest(top, F.lit(0.01)),
        "cand_gap_to_next": C("x_gap_to_next"), "cand_gap_from_second": C("x_gap_from_second"),
        **{f"cand_is_rank_{k}": flag(rank == k) for k in range(3)},
        **{f"cand_{x}_density": C(f"x_{x}_density") for x in ("zip", "city", "prefix")},
        **{f"cand_is_source_{k}": flag(C("o").startswith(f"S{k}-")) for k in (2, 3)},
    }


def _blocks() -> dict[str, Column]:
    slot, sn, sa = C("x_slot"), C("x_sn"), C("x_sa")
    exact = flag((C("name_alphanum_match") == 1) & (C("addr_zip_exact") == 1))
    near = flag((C("name_prefix_4") == 1) & (C("addr_zip_prefix_3") == 1))
    by_name, by_addr = flag(sn >= 30), flag(sa >= 30)
    return {
        "cand_slot": slot, **{f"block_is_slot_{k}": flag(slot == k) for k in range(3)},
        "block_exact_det_match": exact, "block_sorted_neigh_match": near, "block_tfidf_name_match": by_name, "block_tfidf_addr_match": by_addr,
        "block_channel_count": exact + near + by_name + by_addr,
        "block_euclidean_sn_sa": F.sqrt(sn * sn + sa * sa), "block_harmonic_sn_sa": 2 * sn * sa / F.greatest(sn + sa, F.lit(1e-5)),
        "block_geometric_sn_sa": F.sqrt(F.greatest(sn * sa, F.lit(0.0))), "block_l1_dist": F.abs(sn - sa),
        "block_confuser_hardness": F.when(slot < 2, sn + sa).otherwise(0.0), "block_priority_score": sn * 0.6 + sa * 0.4 - slot * 5,
    }


def _cross() -> dict[str, Column]:
    n, a, street, digits = _ab("n"), _ab("a"), _ab("street"), _ab("digits")
    tj, aj, jw, ajw = C("name_token_jaccard"), C("addr_token_jaccard"), C("name_jaro_winkler"), C("addr_jaro_winkler")
    over, zip_, city, house = C("name_token_overlap") >= 0.8, C("addr_zip_exact") == 1, C("addr_city_exact") == 1, C("addr_house_num_exact") == 1
    countries = (C("a_c") != "") & (C("b_c") != "")
    mean, deviation = _spread([tj, jw, aj, ajw])
    same, placed = C("name_exact_ci") == 1, C("addr_exact") == 1
    yes = lambda x: F.coalesce(flag(x), F.lit(0.0))
    return {
        "cross_name_in_addr": flag((F.length(n[0]) >= 4) & F.contains(a[1], n[0])),
        "cross_addr_in_name": flag((F.length(street[0]) >= 4) & F.contains(n[1], street[0])),
        "cross_city_in_name": flag(F.exists("a_at", lambda t: (F.length(t) >= 4) & F.contains(n[1], t))),
        "cross_name_and_addr_jaccard_prod": tj * aj, "cross_name_and_addr_jaro_prod": jw * ajw,
        "cross_name_and_addr_lev_prod": C("name_lev_ratio") * C("addr_lev_ratio"),
        "cross_name_and_zip_match": flag(over & zip_), "cross_name_and_city_match": flag(over & city), "cross_name_and_house_match": flag(over & house),
        "cross_high_precision_triplet": flag((tj >= 0.75) & house & zip_), "cross_mismatch_penalty": yes((jw >= 0.85) & ~zip_ & ~city),
        "cross_country_mismatch": flag(countries & (C("a_c") != C("b_c"))), "cross_digit_count_diff": F.abs(F.size(digits[0]) - F.size(digits[1])),
        "cross_vowel_diff": F.abs(C("a_vowels") - C("b_vowels")), "cross_charset_overlap": sim.jaccard(*_ab("chars")),
        "cross_min_all_sims": F.least(tj, jw, aj, ajw), "cross_max_all_sims": F.greatest(tj, jw, aj, ajw),
        "cross_mean_all_sims": mean, "cross_std_all_sims": deviation, "cross_geometric_mean_sim": F.sqrt(F.greatest(jw * ajw, F.lit(0.0))),
        "cross_short_name_penalty": yes((F.least(F.length(n[0]), F.length(n[1])) <= 4) & (jw < 0.95)),
        "cross_exact_name_fuzzy_addr": yes(same & (ajw < 0.5)), "cross_fuzzy_name_exact_addr": yes((jw < 0.6) & placed),
        "cross_both_exact": flag(same & placed),
        "cross_branch_detector": yes((jw >= 0.85) & city & ~house & (C("addr_house_num_both_present") == 1)),
    }


def features_150(pairs: DataFrame, s1: DataFrame, other: DataFrame, native: bool = False) -> DataFrame:
    """(s1, o) and the 150 features, as doubles.

    ``pairs`` may bring any of the ``CONTEXT`` columns.  With ``native``, nothing runs in Python: the
    kernels' features are null, and so is what is a mean or product of them (null similarities are skipped by
    least and greatest).
    """
    given = [c for c in CONTEXT if c in pairs.columns]
    p = enrich(pairs.select("s1", "o", *[C(c).cast("double").alias(f"g_{c}") for c in given]), prepared_full(s1), prepared_full(other))
    first, second = _names(native), _addresses(native)
    p = p.withColumns({k: v.cast("double") for k, v in first.items()}).withColumns({k: v.cast("double") for k, v in second.items()})
    have = lambda key, default: F.coalesce(C(f"g_{key}"), default) if key in given else default
    p = p.withColumns({"x_cos_n": have("emb_name_cos", C("name_char_3gram_cosine")), "x_cos_a": have("emb_addr_cos", C("addr_char_3gram_cosine"))})
    p = p.withColumns(
        {
            "x_cos_f": have("emb_full_cos", 0.5 * (C("x_cos_n") + C("x_cos_a"))),
            "x_sn": have("sn", C("name_char_3gram_cosine") * 100), "x_sa": have("sa", C("addr_char_3gram_cosine") * 100),
            **{f"x_{k}": have(k, F.lit(v)) for k, v in CONTEXT.items() if v is not None},
        }
    ).withColumns({"x_top_sim": have("top_sim", C("x_sn") + C("x_sa")), "x_total_cands": F.greatest("x_total_cands", F.lit(1.0))})
    groups = [_embeddings(), _candidates(), _blocks(), _cross()]
    for group in groups:
        p = p.withColumns({k: v.cast("double") for k, v in group.items()})
    names = [*first, *second, *(k for g in groups for k in g)]
    return p.select("s1", "o", *names)


#: Names of all features, in order; the tests hold their number against 150.
def feature_names() -> list[str]:
    return [*_names(True), *_addresses(True), *_embeddings(), *_candidates(), *_blocks(), *_cross()]
