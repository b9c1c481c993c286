"""The registered queries of the reference's operators, over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .functions import similarity as sim, text as tx, udfs
from .operators import blocking as bl, context as cx, decision as de, features as fe, features_full as ff, training as tr
from .plans import pipeline as pl
from .sources import tables as tb
from .sources.shared import checkpointed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Sweep parameters that the SQL repeats.
THRESHOLDS = (0.3, 0.5, 0.7, 0.9)
SWEEP = [round(0.1 + 0.05 * i, 2) for i in range(17)]
STEPS = [0.0, 0.25, 0.5, 0.75, 1.0]
ALPHAS = [0.0, 0.2, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 1.0]
ALPHA_THRESHOLDS = [0.2, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.85]
TEMPERATURES = [0.25, 0.5, 1.0, 2.0, 4.0]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _party(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = tb.party_er(spark, sf_dir)
    return (e, *tb.split_sources(e))


def _docs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = tb.docs_er(spark, sf_dir)
    return (e, *tb.split_sources(e))


def _pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Candidate pairs of the parties by their keys, and the tables they come from."""
    e, s1, other = _party(spark, sf_dir)
    return bl.block_deterministic(s1, other).select("s1", "o"), e, s1, other


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    pairs, e, s1, other = _pairs(spark, sf_dir)
    return cx.candidate_scores(pairs, s1, other), e, s1, other


def _modelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores of three stand-in models, the truth, and the query rows."""
    scored, e, s1, _ = _scored(spark, sf_dir)
    p = scored.select(
        "s1", "o",
        F.round((F.col("sn") + F.col("sa")) / 200, 6).alias("p1"), F.round(F.col("sn") / 100, 6).alias("p2"), F.round(F.col("sa") / 100, 6).alias("p3"),
    )
    return p.withColumn("score", F.col("p1")), tb.truth_pairs(e), s1


@query
def norm_name(spark, sf_dir):
    return _party(spark, sf_dir)[0].select("entity_id", tx.normalize_name(F.col("business_name")).alias("name"))


@query
def norm_address(spark, sf_dir):
    return _party(spark, sf_dir)[0].select("entity_id", tx.normalize_address(F.col("business_address")).alias("address"))


@query
def norm_text_documents(spark, sf_dir):
    return tb.read_table(spark, sf_dir, "documents").select("doc_id", tx.normalize_text(F.col("text")).alias("plain"))


@query
def norm_country(spark, sf_dir):
    return _party(spark, sf_dir)[0].select("entity_id", tx.normalize_country(F.col("country")).alias("country"))


@query
def combined_text(spark, sf_dir):
    return _party(spark, sf_dir)[0].select("entity_id", pl.full_text().alias("whole"))


@query
def block_keys_live(spark, sf_dir):
    return bl.block_keys(_party(spark, sf_dir)[0]).select("entity_id", "key_ord", "block_key")


@query
def block_keys_legacy(spark, sf_dir):
    return bl.legacy_keys(_party(spark, sf_dir)[0])


@query
def bucket_sizes(spark, sf_dir):
    return bl.bucket_sizes(bl.block_keys(_party(spark, sf_dir)[2]))


@query
def block_deterministic(spark, sf_dir):
    _, s1, other = _party(spark, sf_dir)
    return bl.block_deterministic(s1, other)


@query
def block_deterministic_small_buckets(spark, sf_dir):
    _, s1, other = _party(spark, sf_dir)
    return bl.block_deterministic(s1, other, 10, 5, 12)


def _grams(e: DataFrame) -> DataFrame:
    return bl.gram_counts(e.select(F.col("entity_id").alias("id"), pl.full_text().alias("text")))


@query
def tfidf_vocab(spark, sf_dir):
    other = _party(spark, sf_dir)[2]
    return bl.vocabulary(_grams(other), other.count()).select("gram", "df", F.round("idf", 6).alias("idf"))


@query
def tfidf_weights(spark, sf_dir):
    other = _party(spark, sf_dir)[2]
    counts = _grams(other)
    return bl.weights(counts, bl.vocabulary(counts, other.count())).select("id", "gram", F.round("w", 6).alias("w"))


@query
def block_tfidf_name(spark, sf_dir):
    _, s1, other = _docs(spark, sf_dir)
    return bl.block_tfidf(s1, other, pl.name_text())


@query
def block_tfidf_nameaddr(spark, sf_dir):
    _, s1, other = _party(spark, sf_dir)
    return bl.block_tfidf(s1, other, pl.full_text(), 40)


@query
def block_vector(spark, sf_dir):
    v = tb.read_table(spark, sf_dir, "embeddings")
    return bl.block_vector(v.where("vec_id % 5 = 0"), v, 30)


@query
def block_sorted_neighbourhood(spark, sf_dir):
    _, s1, other = _party(spark, sf_dir)
    return bl.block_sorted_neighbourhood(s1, other)


@query
def block_sorted_neighbourhood_documents(spark, sf_dir):
    _, s1, other = _docs(spark, sf_dir)
    return bl.block_sorted_neighbourhood(s1, other)


def _united(spark, sf_dir):
    _, s1, other = _party(spark, sf_dir)
    return bl.union_candidates([bl.block_deterministic(s1, other), bl.block_sorted_neighbourhood(s1, other)], 200), s1, other


@query
def union_cap(spark, sf_dir):
    return _united(spark, sf_dir)[0]


@query
def filter_valid_ids(spark, sf_dir):
    pairs, _, other = _united(spark, sf_dir)
    return bl.valid_only(pairs, other.where("src = 2")).select("s1", "o")


@query
def spine_cover(spark, sf_dir):
    pairs, _, s1, _ = _pairs(spark, sf_dir)
    return bl.cover_spine(pairs, s1)


@query
def candidate_stats(spark, sf_dir):
    pairs, _, s1, _ = _pairs(spark, sf_dir)
    return bl.candidate_stats(pairs, s1)


@query
def export_candidates(spark, sf_dir):
    pairs, _, s1, _ = _pairs(spark, sf_dir)
    return tb.export_candidates(pairs, s1)


@query
def blocking_benchmark(spark, sf_dir):
    e, s1, other = _party(spark, sf_dir)
    return pl.benchmark(s1, other, tb.truth_pairs(e))


@query
def pair_features_21(spark, sf_dir):
    pairs, _, s1, other = _pairs(spark, sf_dir)
    return _rounded(fe.features_21(pairs, s1, other))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query
def pair_features_56_native(spark, sf_dir):
    pairs, _, s1, other = _pairs(spark, sf_dir)
    return _rounded(fe.features_56(pairs, s1, other, native=True))


@query
def pair_features_56(spark, sf_dir):
    pairs, _, s1, other = _pairs(spark, sf_dir)
    return _rounded(fe.features_56(pairs, s1, other))


@query
def pair_features_150(spark, sf_dir):
    scored, _, s1, other = _scored(spark, sf_dir)
    return _rounded(ff.features_150(cx.context_columns(scored, other), s1, other))


@query
def pair_features_150_native(spark, sf_dir):
    pairs, _, s1, other = _pairs(spark, sf_dir)
    return _rounded(ff.features_150(pairs, s1, other, native=True))


@query
def sim_jaro_winkler(spark, sf_dir):
    pairs, _, s1, other = _pairs(spark, sf_dir)
    p = fe.enrich(pairs, s1, other)
    return p.select("s1", "o", F.round(udfs.jaro_winkler("a_business_name", "b_business_name"), 6).alias("name_sim"))


@query
def sim_kernels(spark, sf_dir):
    pairs, _, s1, other = _pairs(spark, sf_dir)
    p, two = fe.enrich(pairs, s1, other), ("a_business_name", "b_business_name")
    each = {"indel": udfs.indel_ratio, "sorted_words": udfs.token_sort_ratio, "partial": udfs.partial_ratio}
    return p.select(
        "s1", "o", *[F.round(f(*two), 6).alias(k) for k, f in each.items()], udfs.lcs_substring(*two).alias("substring"),
        udfs.lcs_subsequence(*two).alias("subsequence"), udfs.metaphone("a_business_name").alias("metaphone"), F.soundex("a_business_name").alias("soundex"),
    )


@query
def common_prefix_length(spark, sf_dir):
    pairs, _, s1, other = _pairs(spark, sf_dir)
    p = fe.enrich(pairs, s1, other)
    return p.select("s1", "o", sim.common_prefix(F.col("a_business_name"), F.col("b_business_name")).alias("n"))


@query
def vector_cosine_l2(spark, sf_dir):
    v = tb.read_table(spark, sf_dir, "embeddings")
    a = v.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"))
    b = v.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, "a").select(
        "a", "b", F.round(sim.vector_cosine(F.col("x"), F.col("y")), 5).alias("cosine"), F.round(sim.vector_l2(F.col("x"), F.col("y")), 5).alias("l2")
    )


@query
def candidate_scores(spark, sf_dir):
    return _scored(spark, sf_dir)[0]


@query
def context_ranks(spark, sf_dir):
    scored, _, _, other = _scored(spark, sf_dir)
    return cx.context_columns(scored, other)


@query
def gt_pairs(spark, sf_dir):
    e, s1, _ = _docs(spark, sf_dir)
    lists = tb.export_matches(tb.truth_pairs(e), s1)
    untidy = lists.withColumn("matched_entity_ids", F.concat(F.lit(" "), F.replace("matched_entity_ids", F.lit(","), F.lit(" , ,"))))
    return tb.parse_truth(untidy)


@query
def label_pairs(spark, sf_dir):
    pairs, e, _, _ = _pairs(spark, sf_dir)
    return tr.label_pairs(pairs, tb.truth_pairs(e))


def _labelled(spark, sf_dir):
    scored, e, s1, other = _scored(spark, sf_dir)
    return tr.label_pairs(scored, tb.truth_pairs(e)), e, s1, other


@query
def split_val(spark, sf_dir):
    return tr.split_val(_party(spark, sf_dir)[1], 0.2)[1].select("entity_id")


@query
def sample_exact(spark, sf_dir):
    return tr.sample_exact(_party(spark, sf_dir)[1], 50, 7, "entity_id").select("entity_id")


@query
def group_folds(spark, sf_dir):
    return tr.group_folds(_pairs(spark, sf_dir)[0])


@query
def hard_negatives_topk(spark, sf_dir):
    return tr.top_negatives(_labelled(spark, sf_dir)[0])


@query
def mined_negatives(spark, sf_dir):
    pairs, e, _, _ = _pairs(spark, sf_dir)
    return tr.hard_negatives(pairs, tb.truth_pairs(e))


@query
def balanced_pairs(spark, sf_dir):
    return tr.balanced_pairs(_labelled(spark, sf_dir)[0].select("s1", "o", "label"))


@query
def stratified_negatives(spark, sf_dir):
    return tr.stratified_negatives(_labelled(spark, sf_dir)[0])


@query
def sample_weights(spark, sf_dir):
    return tr.sample_weights(_labelled(spark, sf_dir)[0])


@query
def curriculum_stages(spark, sf_dir):
    return tr.curriculum(_labelled(spark, sf_dir)[0])


@query
def super_hard_negatives(spark, sf_dir):
    e, s1, other = _party(spark, sf_dir)
    return tr.super_hard_negatives(s1, other, tb.truth_pairs(e))


@query
def hint_text(spark, sf_dir):
    pairs, _, s1, other = _pairs(spark, sf_dir)
    return tr.hint_text(pairs, s1, other)


@query
def pair_texts(spark, sf_dir):
    pairs, _, s1, other = _pairs(spark, sf_dir)
    return tr.pair_texts(pairs, s1, other)


@query
def threshold_predict(spark, sf_dir):
    return de.at_least(_modelled(spark, sf_dir)[0], 0.7)


@query
def singleton_rule(spark, sf_dir):
    return de.singleton_rule(_modelled(spark, sf_dir)[0], 0.4)


@query
def blend_scores(spark, sf_dir):
    p = _modelled(spark, sf_dir)[0].withColumn("p3", F.when(F.col("p3") > 0, F.col("p3")))
    return de.blend(p, {"p1": 0.5, "p2": 0.3, "p3": 0.2}).select("s1", "o", "score")


@query
def temperature_grid(spark, sf_dir):
    p, truth, _ = _modelled(spark, sf_dir)
    return de.temperature_grid(tr.label_pairs(p, truth), TEMPERATURES)


@query
def threshold_sweep(spark, sf_dir):
    p, truth, s1 = _modelled(spark, sf_dir)
    return de.threshold_sweep(p, truth, s1, SWEEP)


@query
def threshold_sweep_singletons(spark, sf_dir):
    p, truth, s1 = _modelled(spark, sf_dir)
    return de.threshold_sweep(p, truth, s1, SWEEP, 0.5)


@query
def weight_grid(spark, sf_dir):
    p, truth, s1 = _modelled(spark, sf_dir)
    return de.weight_grid(p, truth, s1, STEPS, list(THRESHOLDS))


@query
def assign_best_per_o(spark, sf_dir):
    return de.best_per_other(_modelled(spark, sf_dir)[0], 0.5)


@query
def assign_two_step(spark, sf_dir):
    return de.two_step(_modelled(spark, sf_dir)[0], 0.5)


@query
def assign_greedy(spark, sf_dir):
    return de.greedy(_modelled(spark, sf_dir)[0], 0.5)


@query
def f05_macro(spark, sf_dir):
    p, truth, s1 = _modelled(spark, sf_dir)
    return de.f05_macro(de.at_least(p, 0.8), truth, s1)


@query
def blocking_recall(spark, sf_dir):
    pairs, e, _, _ = _pairs(spark, sf_dir)
    return de.blocking_recall(pairs, tb.truth_pairs(e))


@query
def missed_pairs(spark, sf_dir):
    pairs, e, s1, other = _pairs(spark, sf_dir)
    return de.missed_pairs(pairs, tb.truth_pairs(e), s1, other)


@query
def score_diagnostics(spark, sf_dir):
    return de.score_diagnostics(_modelled(spark, sf_dir)[0])


@query
def export_matches(spark, sf_dir):
    p, _, s1 = _modelled(spark, sf_dir)
    return tb.export_matches(de.two_step(p, 0.5), s1)


@query
def check_export(spark, sf_dir):
    pairs, _, s1, other = _pairs(spark, sf_dir)
    exported = tb.export_candidates(pairs, s1)
    number = F.substring_index("source1_entity_id", "-", -1).cast("long")
    # Planted faults: rows left out, rows written twice, and partners that don't exist.
    faulty = exported.where(number % 11 != 0).unionByName(exported.where(number % 13 == 0))
    unknown = F.when(number % 17 == 0, F.concat_ws(",", F.nullif("candidate_entity_ids", F.lit("")), F.lit("S2-none"))).otherwise(F.col("candidate_entity_ids"))
    return tb.check_export(faulty.withColumn("candidate_entity_ids", unknown), s1, other, "candidate_entity_ids")


@query
def out_of_fold_scores(spark, sf_dir):
    labelled, _, s1, other = _labelled(spark, sf_dir)
    rows = tr.group_folds(labelled.select("s1", "o", "label", "sn", "sa", "slot"), 3)
    return tr.out_of_fold(rows, ["sn", "sa", "slot"], 3, trees=5, depth=3)


@query
def catalog_field_extract(spark, sf_dir):
    text = F.concat(
        F.lit("Item Name: "), F.col("p_name"), F.lit("\nBullet Point 1: "), F.col("p_brand"), F.lit("\nBullet Point 2: "), F.col("p_type"),
        F.lit("\nValue: "), F.col("p_size").cast("string"), F.lit("\nUnit: Count\n"),
    )
    fields = tx.catalog_fields(text)
    return tb.read_table(spark, sf_dir, "part").select("p_partkey", *[v.alias(k) for k, v in fields.items()])


@query
def semi_valid_customers(spark, sf_dir):
    c, o = tb.read_table(spark, sf_dir, "customer"), tb.read_table(spark, sf_dir, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").select("c_custkey")


@query
def anti_unmatched_customers(spark, sf_dir):
    c, o = tb.read_table(spark, sf_dir, "customer"), tb.read_table(spark, sf_dir, "orders")
    return c.join(o.where("o_totalprice > 300000"), c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")


@query
def topk_orders_per_customer(spark, sf_dir):
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    o = tb.read_table(spark, sf_dir, "orders").withColumn("r", F.row_number().over(order))
    return o.where(F.col("r") <= 3).select("o_custkey", "o_orderkey", "r")


@query
def left_enrich_two_tables(spark, sf_dir):
    o, c, n = (tb.read_table(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    joined = o.join(c, o["o_custkey"] == c["c_custkey"], "left").join(n, c["c_nationkey"] == n["n_nationkey"], "left")
    return joined.select("o_orderkey", "c_name", "n_name")


@query
def group_concat_sorted(spark, sf_dir):
    o = tb.read_table(spark, sf_dir, "orders")
    keys = F.transform(F.sort_array(F.collect_set("o_orderkey")), lambda x: x.cast("string"))
    return o.groupBy("o_custkey").agg(F.array_join(keys, ",").alias("order_keys"))


@query
def category_codes(spark, sf_dir):
    kinds = tb.read_table(spark, sf_dir, "part").select("p_type").distinct()
    return kinds.withColumn("code", F.dense_rank().over(Window.orderBy("p_type")) - 1)


@query
def pair_features_63_native(spark, sf_dir):
    scored, _, s1, other = _scored(spark, sf_dir)
    return _rounded(fe.features_63(scored, s1, other, native=True))


@query
def alpha_sweep(spark, sf_dir):
    p, truth, s1 = _modelled(spark, sf_dir)
    return de.alpha_sweep(p, truth, s1, ALPHAS, ALPHA_THRESHOLDS, "p2", "p3")


@query
def stack_features(spark, sf_dir):
    return _rounded(tr.meta_features(_modelled(spark, sf_dir)[0], "p2", "p3").select("s1", "o", *tr.META))


@query
def stacked_scores(spark, sf_dir):
    p, truth, _ = _modelled(spark, sf_dir)
    rows = checkpointed(tr.meta_features(tr.label_pairs(p, truth), "p2", "p3"))
    return tr.predict_proba(tr.train_stacker(rows, tr.META), rows).select("s1", "o", "score")


@query
def fold_mean_scores(spark, sf_dir):
    labelled = checkpointed(_labelled(spark, sf_dir)[0].select("s1", "o", "label", "sn", "sa", "slot"))
    rows, features = tr.group_folds(labelled, 3), ["sn", "sa", "slot"]
    models = [tr.train_boosted(rows.where(F.col("fold") != k), features, trees=3, depth=3) for k in range(3)]
    return tr.mean_of_models(models, labelled, "score").select("s1", "o", "score")


@query
def scores_with_default(spark, sf_dir):
    p = _modelled(spark, sf_dir)[0]
    return de.with_default(p, p.where("score >= 0.5"))


@query
def map_replace_default(spark, sf_dir):
    rank = {"AUTOMOBILE": 1, "BUILDING": 2, "MACHINERY": 3}
    return tb.read_table(spark, sf_dir, "customer").select("c_custkey", de.replaced(F.col("c_mktsegment"), rank, 0).alias("segment"))


@query
def diagnostic_keys(spark, sf_dir):
    return bl.diagnostic_keys(_party(spark, sf_dir)[0])


def _product_texts(spark, sf_dir) -> DataFrame:
    """Product texts of the parts; every third has a description, the others bullet points."""
    described = F.concat(F.lit("\nProduct Description: "), F.col("p_name"), F.lit("\nOf "), F.col("p_type"))
    bullets = F.concat(F.lit("\nBullet Point 1: "), F.col("p_brand"), F.lit("\nBullet Point 2:  "), F.col("p_type"))
    text = F.concat(
        F.lit("Item Name: \U0001f600"), F.col("p_name"), F.when(F.col("p_partkey") % 3 == 0, described).otherwise(bullets),
        F.lit("\nValue: "), F.col("p_size").cast("string"), F.lit("\nUnits: Count\n"),
    )
    return tb.read_table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))


@query
def product_text(spark, sf_dir):
    return _product_texts(spark, sf_dir).select("p_partkey", tx.product_text(F.col("text")).alias("text"))


@query
def product_text_described(spark, sf_dir):
    return _product_texts(spark, sf_dir).select("p_partkey", tx.product_text_described(F.col("text")).alias("text"))


@query
def product_text_spelled(spark, sf_dir):
    return _product_texts(spark, sf_dir).select("p_partkey", tx.product_text_described(F.col("text"), udfs.spelled_numbers).alias("text"))


@query
def order_slice(spark, sf_dir):
    o = tb.read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return tb.slice_rows(o, [F.col("o_orderkey")], 100, 250)


@query
def mean_pooling(spark, sf_dir):
    tokens = F.array(*[F.slice("embedding", 16 * j + 1, 16) for j in range(4)])
    mask = F.array(*[((F.col("vec_id") + j) % 3 != 0).cast("int") for j in range(4)])
    v = tb.read_table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(sim.mean_pooled(tokens, mask)).alias("dim", "value"))
    return v.withColumn("value", F.round("value", 6))


@query
def block_vector_cells(spark, sf_dir):
    v = tb.read_table(spark, sf_dir, "embeddings")
    return bl.block_vector_cells(v.where("vec_id % 5 = 0"), v, bl.vector_cells(v, 16), 30, 8)


@query
def block_vector_all_cells(spark, sf_dir):
    v = tb.read_table(spark, sf_dir, "embeddings")
    return bl.block_vector_cells(v.where("vec_id % 5 = 0"), v, bl.vector_cells(v, 16), 30, 16)


@query
def l2_normalized(spark, sf_dir):
    v = tb.read_table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(sim.l2_normalized(F.col("embedding"))).alias("dim", "value"))
    return v.withColumn("value", F.round("value", 6))


@query
def without_held_out(spark, sf_dir):
    pairs, _, s1, _ = _pairs(spark, sf_dir)
    return tr.without_ids(pairs, tr.split_val(s1, 0.2)[1])


@query
def share_sample(spark, sf_dir):
    return tr.sample_share(_party(spark, sf_dir)[1], 0.3, 11, "entity_id").select("entity_id")


@query
def blocking_report_timed(spark, sf_dir):
    e, s1, other = _party(spark, sf_dir)
    return pl.timed_report(s1, other, tb.truth_pairs(e), pl.Config(skip_tfidf=True))
