"""Training sets: labels, splits, hard negatives, weights, curriculum, prompts, and models.

Samples are ordered by a hash of the ids and a seed, so they don't depend on partitions
or row order.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import similarity as sim, text as tx, udfs
from ..sources.shared import checkpointed
from .features import enrich


def draw(seed: int, *ids: str) -> Column:
    """A pseudo-random text per row: the MD5 of ids and seed."""
    return F.md5(F.concat_ws("|", *[F.col(i).cast("string") for i in ids], F.lit(str(seed))))


def label_pairs(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Adds label: 1 for true pairs, else 0."""
    marked = truth.select("s1", "o", F.lit(1).alias("hit")).distinct()
    return pairs.join(marked, ["s1", "o"], "left").withColumn("label", F.coalesce("hit", F.lit(0))).drop("hit")


def sample_exact(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows, the same ones each time; fewer if there are fewer."""
    return df.orderBy(draw(seed, key), key).limit(n)


def sample_share(df: DataFrame, share: float, seed: int, key: str) -> DataFrame:
    """About ``share`` of the rows, each by its own hash."""
    return df.where(F.conv(F.substring(draw(seed, key), 1, 8), 16, 10).cast("long") < F.lit(int(share * 2**32)))


def split_val(ids: DataFrame, share: float = 0.05, seed: int = 42, key: str = "entity_id") -> tuple[DataFrame, DataFrame]:
    """Training and validation rows, disjoint, by the hash of the key."""
    val = F.conv(F.substring(draw(seed, key), 1, 8), 16, 10).cast("long") < F.lit(int(share * 2**32))
    return ids.where(~val), ids.where(val)


def group_folds(pairs: DataFrame, folds: int = 5, seed: int = 42) -> DataFrame:
    """Adds fold; all pairs of a query row share one."""
    return pairs.withColumn("fold", (F.conv(F.substring(draw(seed, "s1"), 1, 8), 16, 10).cast("long") % folds).cast("int"))


def without_ids(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """Pairs whose query row isn't among the held-out ones."""
    return pairs.join(ids.select(F.col("entity_id").alias("s1")), "s1", "left_anti")


def top_negatives(scored: DataFrame, k: int = 3, slots: int = 6) -> DataFrame:
    """The k most similar negatives of each query row among the first slots."""
    order = Window.partitionBy("s1").orderBy(F.desc(F.round(F.col("sn") + F.col("sa"), 6)), "o")
    negatives = scored.where((F.col("label") == 0) & (F.col("slot") < slots))
    return negatives.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def hard_negatives(pairs: DataFrame, truth: DataFrame, ratio: int = 3, seed: int = 42) -> DataFrame:
    """Non-matches, max(true pairs * ratio, ratio) of each query row, where all true pairs count, found or not."""
    counts = truth.groupBy("s1").agg(F.count("*").alias("n_true"))
    order = Window.partitionBy("s1").orderBy(draw(seed, "s1", "o"), "o")
    others = pairs.select("s1", "o").join(truth, ["s1", "o"], "left_anti").join(counts, "s1", "left")
    most = F.greatest(F.coalesce("n_true", F.lit(0)) * ratio, F.lit(ratio))
    return others.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select("s1", "o")


def balanced_pairs(labelled: DataFrame, ratio: int = 3, seed: int = 42) -> DataFrame:
    """All positives, and max(positives * ratio, ratio) negatives of each query row in hash order."""
    per = Window.partitionBy("s1")
    order = Window.partitionBy("s1", "label").orderBy(draw(seed, "s1", "o"), "o")
    numbered = labelled.withColumns({"pos": F.sum("label").over(per), "r": F.row_number().over(order)})
    return numbered.where((F.col("label") == 1) | (F.col("r") <= F.greatest(F.col("pos") * ratio, F.lit(ratio)))).drop("pos", "r")


def super_hard_negatives(
    s1: DataFrame, other: DataFrame, truth: DataFrame, least: float = 0.6, pool: int = 15, n: int = 5, seed: int = 42, block: int = 1000
) -> DataFrame:
    """(s1, o, name_sim): non-matches of the same country with a similar name, n of the ``pool`` most similar in hash order.

    Every row meets all rows of its country.  A country is cut into blocks of about ``block`` rows on both sides; each pair
    of blocks is a join key of its own, and the best of a block go on to meet those of the others.
    """
    side = lambda e: e.select(
        "entity_id", tx.normalize_name(F.col("business_name")).alias("n"), tx.normalize_country(F.col("country")).alias("c")
    )
    parts = lambda e, name: e.groupBy("c").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    a, b = side(s1), side(other)
    blocks = F.broadcast(parts(a, "qs").join(parts(b, "rs"), "c"))
    mine = lambda count: F.pmod(F.xxhash64("entity_id"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    true = truth.groupBy("s1").agg(F.collect_set("o").alias("true"))
    left = a.join(true, a["entity_id"] == true["s1"], "left").drop("s1").join(blocks, "c").select(
        F.col("entity_id").alias("s1"), F.col("n").alias("x"), "true", "c", mine("qs").alias("q"), every("rs").alias("r")
    )
    right = b.join(blocks, "c").select(F.col("entity_id").alias("o"), F.col("n").alias("y"), "c", every("qs").alias("q"), mine("rs").alias("r"))
    near = (
        left.join(right, ["c", "q", "r"])
        .where(~F.coalesce(F.array_contains("true", F.col("o")), F.lit(False)))
        .withColumn("name_sim", F.round(udfs.jaro_winkler("x", "y"), 6)).where(F.col("name_sim") >= least)
        .select("s1", "o", "name_sim", F.col("r").alias("block"))
    )
    first = Window.partitionBy("s1", "block").orderBy(F.desc("name_sim"), F.desc("o"))
    best = Window.partitionBy("s1").orderBy(F.desc("name_sim"), F.desc("o"))
    some = Window.partitionBy("s1").orderBy(draw(seed, "s1", "o"), "o")
    top = near.withColumn("r", F.row_number().over(first)).where(F.col("r") <= pool)
    top = top.withColumn("r", F.row_number().over(best)).where(F.col("r") <= pool)
    return top.withColumn("r", F.row_number().over(some)).where(F.col("r") <= n).select("s1", "o", "name_sim")


def stratified_negatives(labelled: DataFrame) -> DataFrame:
    """Positives, and negatives of slots 0 to 6, 8 and 9, each pair once."""
    slot = F.col("slot")
    wanted = (F.col("label") == 1) | (slot < 3) | slot.between(3, 6) | slot.between(8, 9)
    return labelled.where(wanted).dropDuplicates(["s1", "o"])


def sample_weights(labelled: DataFrame) -> DataFrame:
    """Adds weight: 1 for positives; negatives by h = (sn + sa) / 100: 1 + 5 h in the first two slots, 0.5 + 1.5 h beyond."""
    h = (F.col("sn") + F.col("sa")) / 100
    weight = F.when(F.col("label") == 1, 1.0).when(F.col("slot") <= 1, 1 + 5 * h).otherwise(0.5 + 1.5 * h)
    return labelled.withColumn("weight", F.round(weight, 6))


def curriculum(labelled: DataFrame, positives: int = 15_000, seed: int = 42) -> DataFrame:
    """(s1, o, label, stage): positives spread over three stages, negatives from easy to ultra-hard.

    Twice as many negatives as positives, in hash order; by slot the last 25 % are easy, the next 40 % hard and the first
    35 % ultra-hard.
    """
    pos = labelled.where("label = 1").orderBy(draw(seed, "s1", "o"), "s1", "o").limit(positives)
    pos = pos.withColumn("stage", F.ntile(3).over(Window.orderBy(draw(seed, "s1", "o"), "s1", "o")) - 1)
    n = 2 * pos.count()
    neg = labelled.where("label = 0").orderBy(draw(seed, "s1", "o"), "s1", "o").limit(n)
    share = F.percent_rank().over(Window.orderBy("slot", "s1", "o"))
    neg = neg.withColumn("stage", F.when(share >= 0.75, 0).when(share >= 0.35, 1).otherwise(2))
    return pos.unionByName(neg).select("s1", "o", "label", "stage")


def record_text(name: Column, address: Column, country: Column) -> Column:
    """A record in bracket tags; blanks as N/A."""
    shown = lambda x: F.coalesce(F.nullif(tx.strip(tx.text(x)), F.lit("")), F.lit("N/A"))
    return F.concat(F.lit("[NAME] "), shown(name), F.lit(" [ADDRESS] "), shown(address), F.lit(" [COUNTRY] "), shown(country))


def pair_texts(pairs: DataFrame, s1: DataFrame, other: DataFrame, per_s1: int = 20) -> DataFrame:
    """(s1, o, text_a, text_b) for text models, at most ``per_s1`` candidates of each query row."""
    order = Window.partitionBy("s1").orderBy("o")
    few = pairs.select("s1", "o").withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_s1).drop("r")
    p = enrich(few, s1, other)
    text = lambda x: record_text(F.col(f"{x}_business_name"), F.col(f"{x}_business_address"), F.col(f"{x}_country"))
    return p.select("s1", "o", text("a").alias("text_a"), text("b").alias("text_b"))


def hint_text(pairs: DataFrame, s1: DataFrame, other: DataFrame) -> DataFrame:
    """(s1, o, hints): a line of ten similarity hints for each pair, for text models."""
    side = lambda e: e.select(
        "entity_id", tx.text(F.col("business_name")).alias("n"), tx.text(F.col("business_address")).alias("a"), F.lower(tx.strip(tx.text(F.col("country")))).alias("c")
    ).withColumns(
        {"nt": tx.tokens(F.lower("n")), "at": tx.tokens(F.lower("a")), "n3": tx.grams(F.lower("n"), 3), "a3": tx.grams(F.lower("a"), 3),
         "z": F.nullif(F.regexp_extract("a", "\\b\\d{5,6}\\b", 0), F.lit("")), "h": F.nullif(F.regexp_extract("a", "^\\D*(\\d+)", 1), F.lit("")),
         "f": tx.strip(F.lower(F.left("n", F.lit(4))))}
    )
    p = enrich(pairs.select("s1", "o"), side(s1), side(other))
    ab = lambda x: (F.col(f"a_{x}"), F.col(f"b_{x}"))
    shown = lambda d, x: F.format_string(f"%.{d}f", F.bround(x, d))  # noqa: E731  ties to even
    yes = lambda x: F.when(x, "1").otherwise("0")
    #: The hints' names, in order.
    parts = [
        ("ZIP_MATCH", yes(F.equal_null(*ab("z")) & F.col("a_z").isNotNull())),
        ("CITY_MATCH", yes(F.arrays_overlap(*ab("at")))),
        ("STATE_MATCH", yes((F.col("a_c") == F.col("b_c")) & (F.col("a_c") != ""))),
        ("NAME_TFIDF", shown(3, sim.jaccard(*ab("n3"), 0.0))),
        ("ADDRESS_TFIDF", shown(3, sim.jaccard(*ab("a3"), 0.0))),
        ("TOKEN_OVERLAP", shown(2, sim.jaccard(*ab("nt"), 0.0))),
        ("JARO", udfs.jaro_winkler_shown(*ab("n"))),
        ("LEVENSHTEIN", shown(2, sim.edit_similarity(*ab("n")))),
        ("HOUSE_MATCH", yes(F.equal_null(*ab("h")) & F.col("a_h").isNotNull())),
        ("PREFIX_MATCH", yes((F.col("a_f") == F.col("b_f")) & (F.length("a_n") >= 4))),
    ]
    return p.select("s1", "o", F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), v) for k, v in parts]).alias("hints"))


def _assembled(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")


def _some(train: DataFrame, features: list[str]) -> DataFrame:
    """The rows to fit on; without any, one of each class that no feature tells apart, which makes every probability a half."""
    if not train.isEmpty():
        return train
    return train.sparkSession.range(2).select(*[F.lit(0.0).alias(f) for f in features], F.col("id").cast("int").alias("label"), F.lit(1.0).alias("_w"))


def train_boosted(train: DataFrame, features: list[str], trees: int = 20, depth: int = 5, step: float = 0.1, seed: int = 42):
    """Gradient-boosted trees on label; the positive class weighs as much as the negative one, times ``weight`` if there is one.

    Fitting reads the rows again and again, so give rows that are kept.  Without rows the model says 0.5 everywhere.
    """
    n = train.agg(F.sum("label").alias("p"), F.count("*").alias("n")).first()
    scale = (n["n"] - (n["p"] or 0)) / max(n["p"] or 0, 1)
    own = F.col("weight") if "weight" in train.columns else F.lit(1.0)
    weighted = train.withColumn("_w", F.when(F.col("label") == 1, scale).otherwise(1.0) * own)
    model = GBTClassifier(labelCol="label", weightCol="_w", maxIter=trees, maxDepth=depth, stepSize=step, seed=seed)
    return Pipeline(stages=[_assembled(features), model]).fit(_some(weighted, features))


def predict_proba(model, df: DataFrame, name: str = "score") -> DataFrame:
    """Adds the positive-class probability."""
    return model.transform(df).withColumn(name, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def save_model(model, path: str) -> None:
    """Writes a fitted model; ``load_model`` reads it."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def out_of_fold(folded: DataFrame, features: list[str], folds: int = 5, **params) -> DataFrame:
    """(s1, o, label, fold, score): each row scored by the model that never saw its fold; 0.5 where there is no other fold."""
    folded = checkpointed(folded)
    parts = []
    for k in range(folds):
        model = train_boosted(folded.where(F.col("fold") != k), features, **params)
        parts.append(predict_proba(model, folded.where(F.col("fold") == k)).select("s1", "o", "label", "fold", "score"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def importances(model, features: list[str]) -> list[tuple[str, float]]:
    """(feature, importance), most important first."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    return sorted(zip(features, values, strict=True), key=lambda x: (-x[1], x[0]))


def train_stacker(oof: DataFrame, scores: list[str], positive: float = 2.0):
    """Logistic regression over out-of-fold scores; positives weigh ``positive``.

    Fitting reads the rows again and again, so give rows that are kept.  Without rows the model says 0.5 everywhere.
    """
    weighted = oof.withColumn("_w", F.when(F.col("label") == 1, positive).otherwise(1.0))
    return Pipeline(stages=[_assembled(scores), LogisticRegression(labelCol="label", weightCol="_w")]).fit(_some(weighted, scores))


def meta_features(scores: DataFrame, a: str, b: str) -> DataFrame:
    """Adds the eight features of the stacker: both scores, their product, distance, larger, smaller, and their logits."""
    x, y = (F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(c))) for c in (a, b))
    each = {"m_a": x, "m_b": y, "m_product": x * y, "m_apart": F.abs(x - y), "m_high": F.greatest(x, y), "m_low": F.least(x, y)}
    return scores.withColumns(each | {"m_logit_a": F.log(x / (1 - x)), "m_logit_b": F.log(y / (1 - y))})


META = ["m_a", "m_b", "m_product", "m_apart", "m_high", "m_low", "m_logit_a", "m_logit_b"]


def mean_of_models(models: list, df: DataFrame, name: str = "score") -> DataFrame:
    """Adds the mean probability of several models, such as those of the folds, for rows that none of them has seen."""
    columns = df.columns
    for i, model in enumerate(models):
        df = predict_proba(model, df, f"_p{i}")
    mean = sum((F.col(f"_p{i}") for i in range(len(models))), F.lit(0.0)) / len(models)
    return df.select(*columns, mean.alias(name))


def mean_importances(models: list, features: list[str]) -> list[tuple[str, float]]:
    """(feature, mean importance over the models), most important first."""
    total = dict.fromkeys(features, 0.0)
    for model in models:
        for k, v in importances(model, features):
            total[k] += v / len(models)
    return sorted(total.items(), key=lambda x: (-x[1], x[0]))
