"""SQL that checks the queries of ``queries.py`` on the same tables.

Written for the SQL engine, not derived from the Spark plans: shared CTEs for the entity
views, and small functions that spell scalar formulas.
"""

from __future__ import annotations

from .functions import text as tx

ORACLE_SQL: dict[str, str] = {}

PARTY = """
    party AS (
        SELECT 'S' || (1 + p_partkey % 3) || '-' || p_partkey AS entity_id, CAST(1 + p_partkey % 3 AS INTEGER) AS src, p_partkey AS row_pos,
               p_name || ' ' || lower(p_type) || CASE p_partkey % 4 WHEN 0 THEN ' Pvt. Ltd.' WHEN 1 THEN ' Inc' WHEN 2 THEN ' LLC' ELSE '' END AS business_name,
               p_size || ' ' || CASE p_partkey % 2 WHEN 0 THEN 'M.G. Rd' ELSE 'MG Road' END || ', ' || lower(replace(p_brand, '#', ' ')) || ' '
                   || (10000 + p_size * 100 + ascii(left(p_name, 1))) AS business_address,
               CASE WHEN p_partkey % 7 <> 0 THEN 'C' || (length(p_name) % 3) END AS country,
               p_name || '|' || p_size || '|' || p_type AS truth_key
        FROM part),
    truth AS (
        SELECT a.entity_id AS s1, b.entity_id AS o FROM party a JOIN party b ON a.truth_key = b.truth_key AND a.src = 1 AND b.src IN (2, 3))"""


def _rewrite(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


def _collapse(x: str) -> str:
    return f"trim({_rewrite(x, '\\s+', ' ')})"


def _plain(x: str, address: bool = False) -> str:
    x = f"lower(regexp_replace(strip_accents(coalesce({x}, '')), '[^\\x00-\\x7F]', '', 'g'))"
    if address:
        x = f"trim({x})"
        for pattern, to in tx.ADDRESS_WORDS:
            x = _rewrite(x, pattern, to)
    return _collapse(_rewrite(x, "[^\\w\\s]", " "))


def _name(x: str) -> str:
    x = f"regexp_replace({_plain(x)}, '^({'|'.join(tx.HONORIFICS)})\\b\\s*', '')"
    return _collapse(_rewrite(x, f"\\b({tx.LEGAL_NAME})\\b", " "))


def _address(x: str) -> str:
    return _plain(x, True)


def _key_name(x: str) -> str:
    x = f"regexp_replace(lower(coalesce({x}, '')), '^({'|'.join(tx.HONORIFICS)})\\b\\s*', '')"
    return _collapse(_rewrite(_rewrite(x, f"\\b({tx.LEGAL_KEYS})\\b", " "), "[^\\p{L}\\p{M}\\p{N}_\\s]", " "))


def _key_address(x: str) -> str:
    x = f"lower(coalesce({x}, ''))"
    for pattern, to in tx.KEY_ADDRESS_WORDS:
        x = _rewrite(x, pattern, to)
    return _collapse(_rewrite(x, "[^\\p{L}\\p{M}\\p{N}_\\s]", " "))


def _tokens(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda t: t <> '')"


KEYS = f"""
    fields AS (
        SELECT entity_id, src, row_pos, {_key_name("business_name")} AS n, {_key_address("business_address")} AS a, lower(trim(coalesce(country, ''))) AS c
        FROM party),
    bits AS (
        SELECT *, replace(n, ' ', '') AS nc, {_tokens("n")} AS t, regexp_extract(a, '\\b(\\d{{1,6}})\\b', 1) AS h, regexp_extract(a, '\\b([a-z]{{4,}})\\b', 1) AS w,
               regexp_extract(a, '\\b(\\d{{5,6}})\\b', 1) AS p
        FROM fields),
    six AS (
        SELECT entity_id, src, row_pos, unnest(range(6)) AS key_ord, unnest([
            c || '|' || left(nc, 8),
            c || '|first_' || CASE WHEN length(coalesce(t[1], '')) >= 3 THEN t[1] ELSE '' END,
            c || '|sorted_' || CASE WHEN len(t) >= 2 THEN array_to_string(list_sort(t[1:3]), ' ') ELSE '' END,
            CASE WHEN h <> '' AND w <> '' THEN c || '|' || h || '|' || w ELSE '' END,
            CASE WHEN p <> '' THEN c || '|pin_' || p ELSE '' END,
            c || '|' || left(nc, 5)]) AS block_key
        FROM bits),
    keys AS (SELECT entity_id, src, row_pos, CAST(key_ord AS INTEGER) AS key_ord, block_key FROM six WHERE length(block_key) >= ([6, 9, 5, 4, 7, 7])[key_ord + 1])"""


def _deterministic(bucket: int, per_key: int, per_s1: int) -> str:
    return f"""
    small AS (SELECT block_key FROM keys WHERE src <> 1 GROUP BY 1 HAVING count(*) <= {bucket}),
    hits AS (
        SELECT block_key, entity_id AS o FROM keys JOIN small USING (block_key) WHERE src <> 1
        QUALIFY row_number() OVER (PARTITION BY block_key ORDER BY row_pos, key_ord) <= {per_key}),
    probed AS (SELECT entity_id AS s1, o, min(key_ord) AS key_ord FROM keys JOIN hits USING (block_key) WHERE src = 1 GROUP BY ALL),
    levels AS (SELECT s1, key_ord, count(*) AS n FROM probed GROUP BY ALL),
    before AS (SELECT s1, key_ord, coalesce(sum(n) OVER (PARTITION BY s1 ORDER BY key_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had FROM levels),
    det AS (SELECT s1, o, key_ord FROM probed JOIN before USING (s1, key_ord) WHERE had < {per_s1})"""


BASE = f"WITH {PARTY}, {KEYS}, {_deterministic(150, 40, 80)}"


def _gram_set(x: str, n: int) -> str:
    return f"list_distinct(list_transform(range(1, length({x}) - {n} + 2), lambda i: substring({x}, i, {n})))"


def _common(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def _union(a: str, b: str) -> str:
    return f"len(list_distinct(list_concat({a}, {b})))"


def _guarded(a: str, b: str, value: str, both: float) -> str:
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN {both} WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE {value} END"


def _jaccard(a: str, b: str, both: float = 1.0) -> str:
    return _guarded(a, b, f"{_common(a, b)} / {_union(a, b)}", both)


def _overlap(a: str, b: str, both: float = 0.0) -> str:
    return _guarded(a, b, f"{_common(a, b)} / least(len(list_distinct({a})), len(list_distinct({b})))", both)


def _edit(a: str, b: str, cap: int | None = None) -> str:
    x, y = (a, b) if cap is None else (f"left({a}, {cap})", f"left({b}, {cap})")
    return f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN 0.0 ELSE levenshtein({x}, {y}) / greatest(length({a}), length({b})) END"


def _flag(x: str) -> str:
    return f"CASE WHEN {x} THEN 1.0 ELSE 0.0 END"


def _conflict(a: str, b: str) -> str:
    return _flag(f"len({a}) > 0 AND len({b}) > 0 AND len(list_intersect({a}, {b})) = 0")


def _inside(short: str, whole: str) -> str:
    return _flag(f"length({short}) > 0 AND contains({whole}, left({short}, 6))")


def _initialism() -> str:
    one = lambda s, t: (
        f"(length({s}) BETWEEN 2 AND 8 AND len({t}) >= length({s}) AND starts_with(array_to_string(list_transform({t}, lambda w: left(w, 1)), ''), lower({s})))"
    )
    return _flag(f"{one('a.n', 'b.nt')} OR {one('b.n', 'a.nt')}")


PREPARED = f"""
    plain AS (
        SELECT entity_id, business_name AS raw, {_name("business_name")} AS n, {_address("business_address")} AS a, coalesce(lower(trim(country)), 'unknown') AS c FROM party),
    sides AS (
        SELECT *, n || ' ' || a AS f, {_tokens("n")} AS nt, {_tokens("a")} AS adt, {_tokens("n || ' ' || a")} AS ft,
               {", ".join(f"{_gram_set('n', k)} AS n{k}" for k in (3, 4, 5))}, {_gram_set("a", 3)} AS a3, {_gram_set("a", 4)} AS a4, {_gram_set("(n || ' ' || a)", 3)} AS f3,
               regexp_extract_all(n, '\\d+') AS nn, regexp_extract_all(a, '\\d+') AS an, nullif(regexp_extract(a, '\\b\\d{{5,6}}\\b'), '') AS p
        FROM plain)"""

_FROM_SIDES = "FROM det d JOIN sides a ON a.entity_id = d.s1 JOIN sides b ON b.entity_id = d.o"


def _selected(features: dict[str, str]) -> str:
    return ", ".join(f"round({v}, 6) AS {k}" for k, v in features.items())


_LENGTHS = {
    f"{s}_{w}_len": f"length({x}.{y})" for y, w in (("n", "name"), ("a", "addr")) for x, s in (("a", "s1"), ("b", "s2"))
}
BASIC = {
    "name_jaccard": _jaccard("a.nt", "b.nt"), "name_token_overlap": _overlap("a.nt", "b.nt"), "name_edit_distance_norm": _edit("a.n", "b.n", 60),
    "name_char3_overlap": _jaccard("a.n3", "b.n3"), "name_char4_overlap": _jaccard("a.n4", "b.n4"),
    "name_prefix_6": _flag("left(a.n, 6) = left(b.n, 6)"), "name_prefix_4": _flag("left(a.n, 4) = left(b.n, 4)"),
    "name_len_ratio": "length(a.n) / (length(b.n) + 1e-6)", "name_common_tokens": _common("a.nt", "b.nt"),
    "addr_jaccard": _jaccard("a.adt", "b.adt"), "addr_token_overlap": _overlap("a.adt", "b.adt"), "addr_edit_distance_norm": _edit("a.a", "b.a", 60),
    "addr_char3_overlap": _jaccard("a.a3", "b.a3"), "addr_len_ratio": "length(a.a) / (length(b.a) + 1e-6)",
    "country_exact_match": _flag("a.c = b.c"), "name_addr_jaccard": _jaccard("a.ft", "b.ft"),
    "name_in_addr": _flag("contains(b.a, left(a.n, 6)) OR contains(a.a, left(b.n, 6))"), **_LENGTHS,
}


def _prefix(k: int) -> str:
    return _flag(f"a.n <> '' AND b.n <> '' AND left(a.n, {k}) = left(b.n, {k})")


def _end(t: str, at: int) -> str:
    return _flag(f"len(a.{t}) > 0 AND len(b.{t}) > 0 AND a.{t}[{at}] = b.{t}[{at}]")


MIDDLE = {
    "name_jaccard": _jaccard("a.nt", "b.nt"), "name_token_overlap": _overlap("a.nt", "b.nt"), "name_edit_norm": _edit("a.n", "b.n"),
    **{f"name_char{k}_overlap": _jaccard(f"a.n{k}", f"b.n{k}") for k in (3, 4, 5)},
    "name_prefix6_match": _prefix(6), "name_prefix4_match": _prefix(4), "name_first_token_match": _end("nt", 1), "name_last_token_match": _end("nt", -1),
    "name_len_ratio": "length(a.n) / (length(b.n) + 1e-6)", "name_common_token_count": _common("a.nt", "b.nt"), "name_initialism": _initialism(),
    **{f"name_has_legal_{x}": _flag(f"regexp_matches({x}.raw, '(?i)\\b({tx.LEGAL_MARKERS})\\b')") for x in "ab"},
    "name_number_overlap": _jaccard("a.nn", "b.nn"), "name_conflicting_numbers": _conflict("a.nn", "b.nn"),
    "addr_jaccard": _jaccard("a.adt", "b.adt"), "addr_token_overlap": _overlap("a.adt", "b.adt"), "addr_edit_norm": _edit("a.a", "b.a"),
    "addr_char3_overlap": _jaccard("a.a3", "b.a3"), "addr_char4_overlap": _jaccard("a.a4", "b.a4"),
    "addr_first_token_match": _end("adt", 1), "addr_last_token_match": _end("adt", -1), "addr_len_ratio": "length(a.a) / (length(b.a) + 1e-6)",
    "addr_number_overlap": _jaccard("a.an", "b.an"), "addr_conflicting_numbers": _conflict("a.an", "b.an"),
    "addr_pincode_match": "CASE WHEN a.p IS NULL OR b.p IS NULL THEN 0.5 WHEN a.p = b.p THEN 1.0 ELSE 0.0 END",
    "addr_pincode_exact": "CASE WHEN a.p = b.p THEN 1.0 ELSE 0.0 END", "country_exact_match": _flag("a.c = b.c"),
    "country_both_known": _flag("a.c <> 'unknown' AND b.c <> 'unknown'"), "combined_jaccard": _jaccard("a.ft", "b.ft"),
    "combined_token_overlap": _overlap("a.ft", "b.ft"), "combined_char3_overlap": _jaccard("a.f3", "b.f3"),
    "name_in_addr_a": _inside("a.n", "b.a"), "name_in_addr_b": _inside("b.n", "a.a"), "combined_edit_norm": _edit("a.f", "b.f"), **_LENGTHS,
    "name_len_diff": "abs(length(a.n) - length(b.n))", "addr_len_diff": "abs(length(a.a) - length(b.a))",
    "s1_name_token_count": "len(a.nt)", "s2_name_token_count": "len(b.nt)",
    **{f"emb_{k}_{m}": "0.0" for k in ("name", "addr", "combined") for m in ("cosine", "l2")},
}

SCORED = f"""
    words AS (SELECT entity_id, list_distinct({_tokens("lower(coalesce(business_name, ''))")}) AS n, list_distinct({_tokens("lower(coalesce(business_address, ''))")}) AS a FROM party),
    sims AS (
        SELECT d.s1, d.o, round(100 * ({_jaccard("a.n", "b.n")}), 6) AS sn, round(100 * ({_jaccard("a.a", "b.a")}), 6) AS sa
        FROM det d JOIN words a ON a.entity_id = d.s1 JOIN words b ON b.entity_id = d.o),
    scored AS (
        SELECT *, CAST(row_number() OVER (PARTITION BY s1, split_part(o, '-', 1) ORDER BY sn + sa DESC, o) - 1 AS INTEGER) AS slot FROM sims),
    labelled AS (SELECT scored.*, CAST(t.s1 IS NOT NULL AS INTEGER) AS label FROM scored LEFT JOIN (SELECT DISTINCT * FROM truth) t USING (s1, o)),
    models AS (
        SELECT s1, o, round((sn + sa) / 200, 6) AS p1, round(sn / 100, 6) AS p2, round(sa / 100, 6) AS p3, round((sn + sa) / 200, 6) AS score, label FROM labelled),
    spine AS (SELECT entity_id AS s1 FROM party WHERE src = 1),
    n_true AS (SELECT s1, count(*) AS n_true FROM truth GROUP BY 1)"""
ALL = f"{BASE}, {SCORED}"


def _draw(seed: int, *ids: str) -> str:
    return "md5(" + " || '|' || ".join([*ids, f"'{seed}'"]) + ")"


def _share(seed: int, key: str) -> str:
    return f"CAST('0x' || substring({_draw(seed, key)}, 1, 8) AS BIGINT)"


def _f05(pred: str = "n_pred", true: str = "n_true", hit: str = "n_hit") -> str:
    p, r = f"({hit} / {pred})", f"({hit} / {true})"
    return f"CASE WHEN {true} = 0 THEN CASE WHEN {pred} = 0 THEN 1.0 ELSE 0.0 END WHEN {hit} = 0 THEN 0.0 ELSE 1.25 * {p} * {r} / (0.25 * {p} + {r}) END"


def _swept(kept: str, params: str, by: str) -> str:
    """Mean F0.5 over the spine for every parameter row."""
    on = " AND ".join(f"k.{c} = g.{c}" for c in by.split(", "))
    return f"""{ALL}, params AS ({params}), kept AS ({kept}),
    grown AS (
        SELECT {", ".join("g." + c for c in by.split(", "))}, s.s1, coalesce(any_value(t.n_true), 0) AS n_true, count(k.o) AS n_pred, count(x.o) AS n_hit
        FROM params g CROSS JOIN spine s LEFT JOIN n_true t ON t.s1 = s.s1 LEFT JOIN kept k ON k.s1 = s.s1 AND {on}
        LEFT JOIN truth x ON x.s1 = k.s1 AND x.o = k.o GROUP BY ALL)
    SELECT {by}, round(avg({_f05()}), 6) AS f05 FROM grown GROUP BY ALL"""


def _tfidf(text: str, k: int, tail: str, cte: str = PARTY, table: str = "party") -> str:
    """Gram weights of both sides; vocabulary and idf from the reference side."""
    word_grams = (
        "CASE WHEN length(w) <= 3 THEN [w] ELSE list_concat(list_transform(range(1, length(w) - 1), lambda i: substring(w, i, 3)), "
        "list_transform(range(1, length(w) - 2), lambda i: substring(w, i, 4))) END"
    )
    return f"""WITH {cte},
    texts AS (SELECT entity_id AS id, src, unnest({_tokens(text)}) AS word FROM {table}),
    padded AS (SELECT id, src, ' ' || lower(word) || ' ' AS w FROM texts),
    counts AS (SELECT id, src, gram, count(*) AS tf FROM (SELECT id, src, unnest({word_grams}) AS gram FROM padded) GROUP BY ALL),
    side AS (SELECT count(*) AS n FROM {table} WHERE src <> 1),
    vocab AS (
        SELECT gram, count(*) AS df, sum(tf) AS total, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM counts, side WHERE src <> 1
        GROUP BY gram HAVING count(*) >= 3 AND count(*) <= greatest(0.05, least(0.99, 4 / any_value(n))) * any_value(n)
        ORDER BY total DESC, gram LIMIT 50000),
    raw AS (SELECT id, src, gram, (1 + ln(tf)) * idf AS x FROM counts JOIN vocab USING (gram)),
    weights AS (SELECT id, src, gram, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS w FROM raw),
    sims AS (
        SELECT q.id AS s1, i.id AS o, round(sum(q.w * i.w), 6) AS sim FROM weights q JOIN weights i ON q.gram = i.gram AND q.src = 1 AND i.src <> 1 GROUP BY ALL),
    kept AS (SELECT *, count(*) OVER (PARTITION BY s1) AS n, max(sim) OVER (PARTITION BY s1) AS top FROM sims)
    {tail.replace("TOPK", f"SELECT s1, o, sim FROM kept WHERE n <= {k} OR top < 0.12 OR sim >= 0.12 QUALIFY row_number() OVER (PARTITION BY s1 ORDER BY sim DESC, o) <= {k}")}"""


_FULL = f"concat_ws(' ', nullif({_name('business_name')}, ''), nullif({_name('business_name')}, ''), nullif({_address('business_address')}, ''))"


def _neighbours(table: str, window: int) -> str:
    return f"""
    placed AS (
        SELECT entity_id, src, row_number() OVER (ORDER BY lower(trim(coalesce(country, ''))) || '|'
               || regexp_replace(regexp_replace(lower(coalesce(business_name, '')), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', '', 'g'), entity_id) AS p
        FROM {table}),
    near AS (SELECT DISTINCT a.entity_id AS s1, b.entity_id AS o FROM placed a JOIN placed b ON a.src = 1 AND b.src <> 1 AND b.p BETWEEN a.p - {window} AND a.p + {window})"""


_UNITED = f"""{BASE}, {_neighbours("party", 10)},
    both_ AS (SELECT s1, o, min(priority) AS priority FROM (SELECT s1, o, 0 AS priority FROM det UNION ALL SELECT s1, o, 1 FROM near) WHERE s1 <> o GROUP BY ALL),
    united AS (SELECT * FROM both_ QUALIFY row_number() OVER (PARTITION BY s1 ORDER BY priority, o) <= 200)"""
_DOCS = """
    docs AS (
        SELECT 'S' || (1 + doc_id % 3) || '-' || doc_id AS entity_id, 1 + doc_id % 3 AS src, lang AS country, text,
               array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')[1:6], ' ') AS business_name
        FROM documents)"""
_PER_S1 = "SELECT s.s1, count(d.o) AS n_candidates FROM (SELECT entity_id AS s1 FROM party WHERE src = 1) s LEFT JOIN det d USING (s1) GROUP BY ALL"
_BEST_O = "SELECT s1, o, score FROM models WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY o ORDER BY score DESC, s1) = 1"
_TWO = f"SELECT s1, o, score FROM ({_BEST_O}) QUALIFY row_number() OVER (PARTITION BY s1, split_part(o, '-', 1) ORDER BY score DESC, o) = 1"

ORACLE_SQL |= {
    "pair_features_63_native": f"""{ALL}, {PREPARED} SELECT d.s1, d.o, sn AS cand_sn, sa AS cand_sa, slot AS cand_slot, round(sn + sa, 6) AS cand_sim_sum,
        round(sn / greatest(sa, 1.0), 6) AS cand_rel_margin, {_flag("starts_with(d.o, 'S2-')")} AS is_source_2,
        {_flag("lower(trim(a.raw)) = lower(trim(b.raw))")} AS exact_norm_name, {_selected(MIDDLE)} {_FROM_SIDES.replace("det d", "scored d")}""",
    "alpha_sweep": _swept(
        """SELECT a AS alpha, t.threshold, m.s1, m.o FROM (
               SELECT a, s1, o, round(a * p2 + (1 - a) * p3, 6) AS mixed FROM models, (SELECT DISTINCT alpha AS a FROM params)
               QUALIFY row_number() OVER (PARTITION BY a, o ORDER BY mixed DESC, s1) = 1) m JOIN params t ON t.alpha = m.a AND m.mixed >= t.threshold""",
        """SELECT alpha::DOUBLE AS alpha, threshold::DOUBLE AS threshold FROM (SELECT unnest([0.0, 0.2, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 1.0]) AS alpha),
           (SELECT unnest([0.2, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.85]) AS threshold)""",
        "alpha, threshold",
    ),
    "stack_features": f"""{ALL}, c AS (SELECT s1, o, greatest(1e-6, least(1 - 1e-6, p2)) AS x, greatest(1e-6, least(1 - 1e-6, p3)) AS y FROM models)
        SELECT s1, o, round(x, 6) AS m_a, round(y, 6) AS m_b, round(x * y, 6) AS m_product, round(abs(x - y), 6) AS m_apart, round(greatest(x, y), 6) AS m_high,
               round(least(x, y), 6) AS m_low, round(ln(x / (1 - x)), 6) AS m_logit_a, round(ln(y / (1 - y)), 6) AS m_logit_b FROM c""",
    "scores_with_default": f"{ALL} SELECT s1, o, CASE WHEN score >= 0.5 THEN score ELSE 0.0 END AS score FROM models",
    "map_replace_default": """SELECT c_custkey, CAST(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'MACHINERY' THEN 3 ELSE 0 END AS INTEGER) AS segment
        FROM customer""",
    "curriculum_stages": f"""{ALL}, pos AS (SELECT s1, o, label, {_draw(42, "s1", "o")} AS d FROM labelled WHERE label = 1 ORDER BY d, s1, o LIMIT 15000),
        neg AS (SELECT s1, o, label, slot FROM labelled WHERE label = 0 ORDER BY {_draw(42, "s1", "o")}, s1, o LIMIT (SELECT 2 * count(*) FROM pos)),
        ranked AS (SELECT *, percent_rank() OVER (ORDER BY slot, s1, o) AS r FROM neg)
        SELECT s1, o, label, CAST(ntile(3) OVER (ORDER BY d, s1, o) - 1 AS INTEGER) AS stage FROM pos
        UNION ALL SELECT s1, o, label, CASE WHEN r >= 0.75 THEN 0 WHEN r >= 0.35 THEN 1 ELSE 2 END FROM ranked""",
    "super_hard_negatives": f"""WITH {PARTY}, e AS (
            SELECT entity_id, src, {_name("business_name")} AS n, coalesce(lower(trim(country)), 'unknown') AS c FROM party),
        near AS (
            SELECT a.entity_id AS s1, b.entity_id AS o, round(jaro_winkler_similarity(a.n, b.n), 6) AS name_sim
            FROM e a JOIN e b ON a.c = b.c AND a.src = 1 AND b.src <> 1 ANTI JOIN truth t ON t.s1 = a.entity_id AND t.o = b.entity_id),
        pool AS (SELECT * FROM near WHERE name_sim >= 0.6 QUALIFY row_number() OVER (PARTITION BY s1 ORDER BY name_sim DESC, o DESC) <= 15)
        SELECT s1, o, name_sim FROM pool QUALIFY row_number() OVER (PARTITION BY s1 ORDER BY {_draw(42, "s1", "o")}, o) <= 5""",
    "hint_text": f"""{BASE}, f AS (
            SELECT entity_id, business_name AS n, business_address AS a, lower(trim(coalesce(country, ''))) AS c, {_tokens("lower(business_name)")} AS nt,
                   {_tokens("lower(business_address)")} AS adt, {_gram_set("lower(business_name)", 3)} AS n3, {_gram_set("lower(business_address)", 3)} AS a3,
                   regexp_extract(business_address, '\\b\\d{{5,6}}\\b') AS z, regexp_extract(business_address, '^\\D*(\\d+)', 1) AS h FROM party)
        SELECT d.s1, d.o, 'ZIP_MATCH=' || CAST(a.z <> '' AND a.z = b.z AS INTEGER) || ' CITY_MATCH=' || CAST(list_has_any(a.adt, b.adt) AS INTEGER)
            || ' STATE_MATCH=' || CAST(a.c <> '' AND a.c = b.c AS INTEGER) || ' NAME_TFIDF=' || printf('%.3f', {_jaccard("a.n3", "b.n3", 0.0)})
            || ' ADDRESS_TFIDF=' || printf('%.3f', {_jaccard("a.a3", "b.a3", 0.0)}) || ' TOKEN_OVERLAP=' || printf('%.2f', {_jaccard("a.nt", "b.nt", 0.0)})
            || ' JARO=' || printf('%.2f', jaro_winkler_similarity(a.n, b.n)) || ' LEVENSHTEIN=' || printf('%.2f', 1.0 - levenshtein(a.n, b.n) / greatest(length(a.n), length(b.n)))
            || ' HOUSE_MATCH=' || CAST(a.h <> '' AND a.h = b.h AS INTEGER)
            || ' PREFIX_MATCH=' || CAST(trim(lower(left(a.n, 4))) = trim(lower(left(b.n, 4))) AND length(a.n) >= 4 AS INTEGER) AS hints
        FROM det d JOIN f a ON a.entity_id = d.s1 JOIN f b ON b.entity_id = d.o""",
    "norm_name": f"WITH {PARTY} SELECT entity_id, {_name('business_name')} AS name FROM party",
    "norm_address": f"WITH {PARTY} SELECT entity_id, {_address('business_address')} AS address FROM party",
    "norm_text_documents": f"SELECT doc_id, {_plain('text')} AS plain FROM documents",
    "norm_country": f"WITH {PARTY} SELECT entity_id, coalesce(lower(trim(country)), 'unknown') AS country FROM party",
    "combined_text": f"WITH {PARTY} SELECT entity_id, {_FULL} AS whole FROM party",
    "block_keys_live": f"WITH {PARTY}, {KEYS} SELECT entity_id, key_ord, block_key FROM keys",
    "block_keys_legacy": f"""WITH {PARTY}, n AS (
            SELECT entity_id, {_name("business_name")} AS n, replace({_name("business_name")}, ' ', '') AS nc, replace({_address("business_address")}, ' ', '') AS ac,
                   coalesce(lower(trim(country)), 'unknown') AS c FROM party),
        k AS (SELECT entity_id, unnest([c || '|' || left(nc, 4), c || '|' || left(ac, 5), left(nc, 6), array_to_string(list_sort({_tokens("n")})[1:4], ' '),
                     left(nc, 3) || '|' || left(ac, 3)]) AS block_key, unnest([4, 4, 3, 1, 5]) AS least FROM n)
        SELECT entity_id, block_key FROM k WHERE length(block_key) >= least""",
    "bucket_sizes": f"WITH {PARTY}, {KEYS} SELECT block_key, count(*) AS bucket_size FROM keys WHERE src <> 1 GROUP BY ALL",
    "block_deterministic": f"{BASE} SELECT * FROM det",
    "block_deterministic_small_buckets": f"WITH {PARTY}, {KEYS}, {_deterministic(10, 5, 12)} SELECT * FROM det",
    "tfidf_vocab": _tfidf(_FULL, 30, "SELECT gram, df, round(idf, 6) AS idf FROM vocab"),
    "tfidf_weights": _tfidf(_FULL, 30, "SELECT id, gram, round(w, 6) AS w FROM weights WHERE src <> 1"),
    "block_tfidf_name": _tfidf(_name("business_name"), 30, "TOPK", _DOCS, "docs"),
    "block_tfidf_nameaddr": _tfidf(_FULL, 40, "TOPK"),
    "block_vector": """
        SELECT q.vec_id AS s1, i.vec_id AS o, round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])), 6) AS sim
        FROM embeddings q JOIN embeddings i ON q.vec_id % 5 = 0 AND q.vec_id <> i.vec_id
        QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY sim DESC, i.vec_id) <= 30""",
    "block_sorted_neighbourhood": f"WITH {PARTY}, {_neighbours('party', 10)} SELECT * FROM near",
    "block_sorted_neighbourhood_documents": f"WITH {_DOCS}, {_neighbours('docs', 10)} SELECT * FROM near",
    "union_cap": f"{_UNITED} SELECT * FROM united",
    "filter_valid_ids": f"{_UNITED} SELECT s1, o FROM united WHERE o IN (SELECT entity_id FROM party WHERE src = 2)",
    "spine_cover": f"{BASE} {_PER_S1}",
    "candidate_stats": f"""{BASE} SELECT count(*) AS n_entities, round(avg(n_candidates), 6) AS avg_candidates, median(n_candidates) AS median_candidates,
        max(n_candidates) AS max_candidates, min(n_candidates) AS min_candidates, count(*) FILTER (n_candidates = 0) AS n_empty, sum(n_candidates) AS total_pairs FROM ({_PER_S1})""",
    "export_candidates": f"""{BASE} SELECT s.entity_id AS source1_entity_id, coalesce(string_agg(DISTINCT d.o, ',' ORDER BY d.o), '') AS candidate_entity_ids
        FROM party s LEFT JOIN det d ON d.s1 = s.entity_id WHERE s.src = 1 GROUP BY ALL""",
    "pair_features_21": f"{BASE}, {PREPARED} SELECT d.s1, d.o, {_selected(BASIC)} {_FROM_SIDES}",
    "pair_features_56_native": f"{BASE}, {PREPARED} SELECT d.s1, d.o, {_selected(MIDDLE)} {_FROM_SIDES}",
    "sim_jaro_winkler": f"""{BASE} SELECT d.s1, d.o, round(jaro_winkler_similarity(a.business_name, b.business_name), 6) AS name_sim
        FROM det d JOIN party a ON a.entity_id = d.s1 JOIN party b ON b.entity_id = d.o""",
    "common_prefix_length": f"""{BASE} SELECT d.s1, d.o, len(list_filter(range(1, least(length(a.business_name), length(b.business_name)) + 1),
        lambda i: left(a.business_name, i) = left(b.business_name, i))) AS n FROM det d JOIN party a ON a.entity_id = d.s1 JOIN party b ON b.entity_id = d.o""",
    "vector_cosine_l2": """
        SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS cosine,
               round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS l2
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "candidate_scores": f"{ALL} SELECT * FROM scored",
    "context_ranks": f"""{ALL}, k AS (
            SELECT entity_id AS o, nullif(regexp_extract(lower(business_address), '\\b\\d{{5,6}}\\b'), '') AS kz, list_last({_tokens("lower(business_address)")}) AS kc,
                   nullif(left(lower(business_name), 4), '') AS kp FROM party),
        t AS (SELECT *, round(sn + sa, 6) AS total FROM scored JOIN k USING (o))
        SELECT s1, o, sn, sa, slot, row_number() OVER w - 1 AS rank, count(*) OVER p AS total_cands, max(total) OVER p AS top_sim,
               round(coalesce(total - lead(total) OVER w, 0), 6) AS gap_to_next,
               round(coalesce(total - nth_value(total, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0), 6) AS gap_from_second,
               CASE WHEN kz IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY s1, kz) END AS zip_density,
               CASE WHEN kc IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY s1, kc) END AS city_density,
               CASE WHEN kp IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY s1, kp) END AS prefix_density
        FROM t WINDOW p AS (PARTITION BY s1), w AS (PARTITION BY s1 ORDER BY total DESC, o)""",
    "gt_pairs": f"WITH {_DOCS} SELECT DISTINCT a.entity_id AS s1, b.entity_id AS o FROM docs a JOIN docs b ON a.text = b.text AND a.src = 1 AND b.src IN (2, 3)",
    "label_pairs": f"{ALL} SELECT s1, o, label FROM labelled",
    "split_val": f"WITH {PARTY} SELECT entity_id FROM party WHERE src = 1 AND {_share(42, 'entity_id')} < {int(0.2 * 2**32)}",
    "sample_exact": f"WITH {PARTY} SELECT entity_id FROM party WHERE src = 1 ORDER BY {_draw(7, 'entity_id')}, entity_id LIMIT 50",
    "group_folds": f"{BASE} SELECT s1, o, CAST({_share(42, 's1')} % 5 AS INTEGER) AS fold FROM det",
    "hard_negatives_topk": f"{ALL} SELECT * FROM labelled WHERE label = 0 AND slot < 6 QUALIFY row_number() OVER (PARTITION BY s1 ORDER BY round(sn + sa, 6) DESC, o) <= 3",
    "mined_negatives": f"""{ALL} SELECT s1, o FROM (SELECT l.s1, l.o, n_true, row_number() OVER (PARTITION BY l.s1 ORDER BY {_draw(42, "l.s1", "l.o")}, l.o) AS r
        FROM labelled l LEFT JOIN n_true USING (s1) WHERE label = 0) WHERE r <= greatest(coalesce(n_true, 0) * 3, 3)""",
    "balanced_pairs": f"""{ALL} SELECT s1, o, label FROM (SELECT s1, o, label, sum(label) OVER (PARTITION BY s1) AS pos,
        row_number() OVER (PARTITION BY s1, label ORDER BY {_draw(42, "s1", "o")}, o) AS r FROM labelled) WHERE label = 1 OR r <= greatest(3 * pos, 3)""",
    "stratified_negatives": f"{ALL} SELECT * FROM labelled WHERE label = 1 OR slot <= 6 OR slot BETWEEN 8 AND 9",
    "sample_weights": f"""{ALL} SELECT *, round(CASE WHEN label = 1 THEN 1.0 WHEN slot <= 1 THEN 1 + 5 * (sn + sa) / 100 ELSE 0.5 + 1.5 * (sn + sa) / 100 END, 6) AS weight
        FROM labelled""",
    "pair_texts": f"""{BASE}, t AS (SELECT entity_id, '[NAME] ' || coalesce(nullif(trim(business_name), ''), 'N/A') || ' [ADDRESS] ' || coalesce(nullif(trim(business_address), ''), 'N/A')
            || ' [COUNTRY] ' || coalesce(nullif(trim(country), ''), 'N/A') AS text FROM party)
        SELECT d.s1, d.o, a.text AS text_a, b.text AS text_b FROM det d JOIN t a ON a.entity_id = d.s1 JOIN t b ON b.entity_id = d.o
        QUALIFY row_number() OVER (PARTITION BY d.s1 ORDER BY d.o) <= 20""",
    "threshold_predict": f"{ALL} SELECT s1, o FROM models WHERE score >= 0.7",
    "singleton_rule": f"{ALL} SELECT s1, o FROM (SELECT *, max(score) OVER (PARTITION BY s1) AS best FROM models) WHERE best >= 0.5 AND score >= 0.4",
    "blend_scores": f"{ALL} SELECT s1, o, round(CASE WHEN p3 > 0 THEN 0.5 * p1 + 0.3 * p2 + 0.2 * p3 ELSE (0.5 * p1 + 0.3 * p2) / 0.8 END, 6) AS score FROM models",
    "temperature_grid": f"""{ALL}, z AS (SELECT label, temperature, ln(c / (1 - c)) / temperature AS z
            FROM (SELECT label, greatest(1e-7, least(1 - 1e-7, score)) AS c FROM models), (SELECT unnest([0.25, 0.5, 1.0, 2.0, 4.0]) AS temperature))
        SELECT CAST(temperature AS DOUBLE) AS temperature, round(avg(greatest(z, 0) - z * label + ln(1 + exp(-abs(z)))), 6) AS mean_nll FROM z GROUP BY ALL""",
    "threshold_sweep": _swept(
        "SELECT threshold, s1, o FROM models, params WHERE score >= threshold", "SELECT round(0.1 + 0.05 * i, 2)::DOUBLE AS threshold FROM range(17) t(i)", "threshold"
    ),
    "threshold_sweep_singletons": _swept(
        "SELECT threshold, s1, o FROM (SELECT *, max(score) OVER (PARTITION BY s1) AS best FROM models), params WHERE best >= 0.5 AND score >= threshold",
        "SELECT round(0.1 + 0.05 * i, 2)::DOUBLE AS threshold FROM range(17) t(i)", "threshold",
    ),
    "weight_grid": _swept(
        "SELECT w1, w2, threshold, s1, o FROM models, params WHERE round(w1 * p1 + w2 * p2 + (1 - w1 - w2) * p3, 6) >= threshold",
        """SELECT w1::DOUBLE AS w1, w2::DOUBLE AS w2, threshold::DOUBLE AS threshold FROM (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS w1),
           (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS w2), (SELECT unnest([0.3, 0.5, 0.7, 0.9]) AS threshold) WHERE w1 + w2 <= 1""",
        "w1, w2, threshold",
    ),
    "assign_best_per_o": f"{ALL} {_BEST_O}",
    "assign_two_step": f"{ALL} {_TWO}",
    "f05_macro": f"""{ALL}, e AS (
            SELECT s.s1, coalesce(any_value(t.n_true), 0) AS n_true, count(m.o) AS n_pred, count(x.o) AS n_hit FROM spine s LEFT JOIN n_true t ON t.s1 = s.s1
            LEFT JOIN models m ON m.s1 = s.s1 AND m.score >= 0.8 LEFT JOIN truth x ON x.s1 = m.s1 AND x.o = m.o GROUP BY ALL)
        SELECT count(*) AS n_entities, round(avg({_f05()}), 6) AS f05,
               round(avg(CASE WHEN n_pred > 0 THEN n_hit / n_pred WHEN n_true = 0 THEN 1.0 ELSE 0.0 END), 6) AS precision,
               round(avg(CASE WHEN n_true > 0 THEN n_hit / n_true ELSE 1.0 END), 6) AS recall FROM e""",
    "blocking_recall": f"""{BASE}, f AS (SELECT t.o, d.o IS NOT NULL AS hit FROM truth t LEFT JOIN det d USING (s1, o)),
        g AS (SELECT 'all' AS scope, hit FROM f UNION ALL SELECT split_part(o, '-', 1), hit FROM f)
        SELECT scope, round(count(*) FILTER (hit) / count(*), 6) AS recall, count(*) FILTER (hit) AS recovered, count(*) AS total_true FROM g GROUP BY ALL""",
    "missed_pairs": f"""{BASE} SELECT t.s1, t.o, a.business_name AS a_name, a.business_address AS a_address, b.business_name AS b_name, b.business_address AS b_address
        FROM truth t ANTI JOIN det d USING (s1, o) JOIN party a ON a.entity_id = t.s1 JOIN party b ON b.entity_id = t.o""",
    "score_diagnostics": f"""{ALL} SELECT min(score) AS low, max(score) AS high, round(avg(score), 6) AS mean, median(score) AS median,
        count(*) FILTER (score >= 0.5) AS n_50, count(*) FILTER (score >= 0.7) AS n_70, count(*) FILTER (score >= 0.9) AS n_90 FROM models""",
    "export_matches": f"""{ALL}, m AS ({_TWO}) SELECT s.s1 AS source1_entity_id, coalesce(string_agg(m.o, ',' ORDER BY m.o), '') AS matched_entity_ids
        FROM spine s LEFT JOIN m USING (s1) GROUP BY ALL""",
    "check_export": f"""{BASE}, ids AS (SELECT entity_id AS s1, row_pos AS k FROM party WHERE src = 1),
        rows_ AS (SELECT s1, k FROM ids WHERE k % 11 <> 0 UNION ALL SELECT s1, k FROM ids WHERE k % 13 = 0)
        SELECT (SELECT count(*) FROM ids WHERE k % 11 = 0 AND k % 13 <> 0) AS missing, (SELECT count(*) FROM ids WHERE k % 11 <> 0 AND k % 13 = 0) AS repeated,
               (SELECT count(*) FROM rows_ WHERE k % 17 = 0) AS unknown""",
    "catalog_field_extract": "SELECT p_partkey, p_name AS item_name, CAST(p_size AS VARCHAR) AS item_value, 'Count' AS item_unit, p_brand || ' ' || p_type AS item_text FROM part",
    "semi_valid_customers": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "anti_unmatched_customers": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "topk_orders_per_customer": """SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS r
        FROM orders QUALIFY r <= 3""",
    "left_enrich_two_tables": """SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""",
    "group_concat_sorted": "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS order_keys FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders) GROUP BY 1",
    "category_codes": "SELECT p_type, dense_rank() OVER (ORDER BY p_type) - 1 AS code FROM (SELECT DISTINCT p_type FROM part)",
}

#: Product texts of the parts, by pieces: {0} writes a number.
_SPELL = (
    "CASE WHEN {0} < 20 THEN list_extract(['zero', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten', 'eleven', 'twelve', "
    "'thirteen', 'fourteen', 'fifteen', 'sixteen', 'seventeen', 'eighteen', 'nineteen'], CAST({0} + 1 AS BIGINT)) "
    "ELSE list_extract(['twenty', 'thirty', 'forty', 'fifty', 'sixty', 'seventy', 'eighty', 'ninety'], CAST({0} // 10 - 1 AS BIGINT)) "
    "|| CASE WHEN {0} % 10 > 0 THEN '-' || list_extract(['one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine'], CAST({0} % 10 AS BIGINT)) ELSE '' END END"
)


def _described(value: str, bullets: str) -> str:
    head = f"'Item Name: ' || lower(p_name) || chr(10) || 'Value: ' || {value} || chr(10) || 'Units: count'"
    return f"""SELECT p_partkey, {head} || CASE WHEN p_partkey % 3 = 0 THEN chr(10) || 'Description: ' || lower(p_name) || chr(10) || 'of ' || lower(p_type)
        ELSE {bullets} END AS text FROM part"""


_PLAIN_KEY = "regexp_replace(lower(coalesce({0}, '')), '[^\\w\\s]', ' ', 'g')"
_POOLED = " + ".join(f"CAST(embedding[{16 * j} + dim + 1] AS DOUBLE) * CAST((vec_id + {j}) % 3 <> 0 AS INTEGER)" for j in range(4))
_MARKED = " + ".join(f"CAST((vec_id + {j}) % 3 <> 0 AS INTEGER)" for j in range(4))
_HELD = f"{_share(42, 's1')} < {int(0.2 * 2**32)}"

ORACLE_SQL |= {
    "diagnostic_keys": f"""WITH {PARTY}, n AS (
            SELECT entity_id, lower(trim(coalesce(country, ''))) AS c, replace({_PLAIN_KEY.format('business_address')}, ' ', '') AS a,
                   {_collapse(_PLAIN_KEY.format("regexp_replace(lower(business_name), '" + chr(92) + 'b(' + tx.LEGAL_DIAGNOSTIC + ')' + chr(92) + "b', ' ', 'g')"))} AS name
            FROM party),
        k AS (SELECT *, replace(name, ' ', '') AS n FROM n)
        SELECT entity_id, c || '|' || left(n, 8) AS key_a, c || '|' || left(a, 8) AS key_b, left(n, 10) AS key_c,
               array_to_string(list_sort(list_filter(string_split(name, ' '), lambda w: w <> ''))[1:5], ' ') AS key_d,
               left(n, 6) || '|' || left(a, 6) AS key_e, left(n, 5) || '|' || c AS key_f FROM k""",
    "product_text": "SELECT p_partkey, 'Units: count' || chr(10) || 'Value: ' || p_size || chr(10) || 'Item Name: ' || lower(p_name) AS text FROM part",
    "product_text_described": _described(
        "p_size", "chr(10) || 'Bullet Points 1: ' || lower(p_brand) || chr(10) || 'Bullet Points 2: ' || lower(p_type)"
    ),
    "product_text_spelled": _described(_SPELL.format("p_size"), "''"),
    "order_slice": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 250 OFFSET 100",
    "mean_pooling": f"""SELECT vec_id, CAST(dim AS INTEGER) AS dim, round(({_POOLED}) / greatest({_MARKED}, 1e-9), 6) AS value
        FROM (SELECT *, unnest(range(16)) AS dim FROM embeddings)""",
    "block_vector_all_cells": ORACLE_SQL["block_vector"],
    "l2_normalized": """SELECT vec_id, CAST(dim AS INTEGER) AS dim, round(CAST(embedding[dim + 1] AS DOUBLE) / (sqrt(list_inner_product(CAST(embedding AS DOUBLE[]),
        CAST(embedding AS DOUBLE[]))) + 1e-8), 6) AS value FROM (SELECT *, unnest(range(len(embedding))) AS dim FROM embeddings)""",
    "without_held_out": f"{BASE} SELECT s1, o FROM det WHERE NOT ({_HELD})",
    "share_sample": f"WITH {PARTY} SELECT entity_id FROM party WHERE src = 1 AND {_share(11, 'entity_id')} < {int(0.3 * 2**32)}",
}
