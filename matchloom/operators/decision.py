"""From scores to matches: calibration, blending, thresholds, assignment, and metrics.

Grids of parameters are joined to scores as small literal tables and reduced by one
group-by, instead of a loop of jobs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.similarity import f_beta, logit, sigmoid
from ..sources.shared import checkpointed


def grid(spark: SparkSession, name: str, values: list[float]) -> DataFrame:
    """A literal parameter table (position, value)."""
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], f"pos int, {name} double")


def _swept(scores: DataFrame, params: DataFrame) -> DataFrame:
    """Every score row with every parameter; the parameters are a stated list."""
    return scores.crossJoin(F.broadcast(params))


def blend(scores: DataFrame, weights: dict[str, float], name: str = "score") -> DataFrame:
    """Adds the weighted mean of the score columns that are there; null scores and their weights are left out."""
    top, bottom = F.lit(0.0), F.lit(0.0)
    for column, w in weights.items():
        there = F.col(column).isNotNull()
        top = top + F.when(there, F.col(column) * w).otherwise(0.0)
        bottom = bottom + F.when(there, w).otherwise(0.0)
    return scores.withColumn(name, F.round(F.when(bottom > 0, top / F.nullif(bottom, F.lit(0.0))), 6))


def at_least(scores: DataFrame, threshold: float) -> DataFrame:
    """(s1, o) with a score of at least the threshold."""
    return scores.where(F.col("score") >= threshold).select("s1", "o")


def singleton_rule(scores: DataFrame, threshold: float, least: float = 0.5) -> DataFrame:
    """As ``at_least``, but nothing for a query row whose best score is below ``least``."""
    best = F.max("score").over(Window.partitionBy("s1"))
    return scores.withColumn("best", best).where((F.col("best") >= least) & (F.col("score") >= threshold)).select("s1", "o")


def nll(z: Column, label: Column) -> Column:
    """Log loss of a logit."""
    return F.greatest(z, F.lit(0.0)) - z * label + F.log1p(F.exp(-F.abs(z)))


def temperature_grid(scores: DataFrame, values: list[float] | None = None) -> DataFrame:
    """(temperature, mean_nll) for every temperature, of (score, label) rows."""
    values = values or [round(0.05 * i, 2) for i in range(1, 201)]
    params = grid(scores.sparkSession, "temperature", values)
    z = logit(F.col("score")) / F.col("temperature")
    return _swept(scores, params).groupBy("temperature").agg(F.round(F.avg(nll(z, F.col("label"))), 6).alias("mean_nll"))


def fit_temperature(scores: DataFrame, values: list[float] | None = None) -> float:
    """The temperature of least log loss, the lowest of equal ones."""
    return temperature_grid(scores, values).orderBy("mean_nll", "temperature").first()["temperature"]


def calibrate(scores: DataFrame, temperature: float) -> DataFrame:
    return scores.withColumn("score", sigmoid(logit(F.col("score")) / temperature))


def per_entity(predicted: DataFrame, truth: DataFrame, spine: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, s1, n_pred, n_true, n_hit) for every query row; ``by`` holds parameter columns of ``predicted``.

    A query row without predictions under a parameter isn't listed there; see ``macro``.
    """
    by = by or []
    hits = predicted.join(truth.withColumn("hit", F.lit(1)), ["s1", "o"], "left")
    counts = hits.groupBy(*by, "s1").agg(F.count("*").alias("n_pred"), F.coalesce(F.sum("hit"), F.lit(0)).alias("n_hit"))
    true = truth.groupBy("s1").agg(F.count("*").alias("n_true"))
    ids = spine.select(F.col("entity_id").alias("s1")).distinct().join(true, "s1", "left")
    if by:
        return counts.join(ids, "s1").withColumn("n_true", F.coalesce("n_true", F.lit(0)))
    return ids.join(counts, "s1", "left").select(
        "s1", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_pred", "n_true", "n_hit")]
    )


def _f05(n_pred: Column, n_true: Column, n_hit: Column) -> Column:
    p = F.when(n_pred > 0, n_hit / F.nullif(n_pred, F.lit(0))).otherwise(0.0)
    r = F.when(n_true > 0, n_hit / F.nullif(n_true, F.lit(0))).otherwise(0.0)
    return F.when(n_true == 0, F.when(n_pred == 0, 1.0).otherwise(0.0)).otherwise(f_beta(p, r, 0.5))


def f05_macro(predicted: DataFrame, truth: DataFrame, spine: DataFrame) -> DataFrame:
    """One row: f05, precision, recall, each the mean over all query rows.

    A row without true partners scores 1 if nothing is predicted, else 0; its recall is 1.
    """
    e = per_entity(predicted.select("s1", "o").distinct(), truth, spine)
    n, t, h = F.col("n_pred"), F.col("n_true"), F.col("n_hit")
    p = F.when(n > 0, h / F.nullif(n, F.lit(0))).when(t == 0, 1.0).otherwise(0.0)
    r = F.when(t > 0, h / F.nullif(t, F.lit(0))).otherwise(1.0)
    return e.agg(
        F.count("*").alias("n_entities"),
        F.round(F.avg(_f05(n, t, h)), 6).alias("f05"),
        F.round(F.avg(p), 6).alias("precision"),
        F.round(F.avg(r), 6).alias("recall"),
    )


def swept_f05(kept: DataFrame, by: list[str], params: DataFrame, truth: DataFrame, spine: DataFrame) -> DataFrame:
    """(by, f05) for every parameter row, from the pairs kept under it.

    Query rows without a pair under a parameter come in through totals: 1 each if they have no true partner.
    """
    e = per_entity(kept, truth, spine, by)
    some = e.groupBy(*by).agg(
        F.sum(_f05(F.col("n_pred"), F.col("n_true"), F.col("n_hit"))).alias("sum"), F.count_if(F.col("n_true") == 0).alias("single")
    )
    ids = spine.select(F.col("entity_id").alias("s1")).distinct()
    totals = ids.join(truth.select("s1").distinct().withColumn("has", F.lit(1)), "s1", "left").agg(
        F.count("*").alias("n"), F.count_if(F.col("has").isNull()).alias("n_single")
    )
    rows = params.select(*by).join(some, by, "left").crossJoin(F.broadcast(totals))
    mean = (F.coalesce("sum", F.lit(0.0)) + F.col("n_single") - F.coalesce("single", F.lit(0))) / F.col("n")
    return rows.select(*by, F.round(mean, 6).alias("f05"))


def threshold_sweep(scores: DataFrame, truth: DataFrame, spine: DataFrame, values: list[float], least: float | None = None) -> DataFrame:
    """(threshold, f05); with ``least`` under the singleton rule."""
    params = grid(scores.sparkSession, "threshold", values).drop("pos")
    if least is not None:
        best = F.max("score").over(Window.partitionBy("s1"))
        scores = scores.withColumn("_best", best).where(F.col("_best") >= least).drop("_best")
    kept = _swept(scores.select("s1", "o", "score"), params).where(F.col("score") >= F.col("threshold"))
    return swept_f05(kept.select("threshold", "s1", "o"), ["threshold"], params, truth, spine)


def best_threshold(sweep: DataFrame) -> tuple[float, float]:
    """(threshold, f05) of the best one, the lowest of equal ones."""
    row = sweep.orderBy(F.desc("f05"), "threshold").first()
    return row["threshold"], row["f05"]


def weight_grid(scores: DataFrame, truth: DataFrame, spine: DataFrame, steps: list[float], thresholds: list[float]) -> DataFrame:
    """(w1, w2, threshold, f05) of blends w1 p1 + w2 p2 + (1 - w1 - w2) p3 over a lattice of weights."""
    spark = scores.sparkSession
    lattice = [(a, b) for a in steps for b in steps if a + b <= 1 + 1e-9]
    params = spark.createDataFrame([(a, b, t) for a, b in lattice for t in thresholds], "w1 double, w2 double, threshold double")
    mixed = F.round(F.col("w1") * F.col("p1") + F.col("w2") * F.col("p2") + (1 - F.col("w1") - F.col("w2")) * F.col("p3"), 6)
    kept = _swept(scores.select("s1", "o", "p1", "p2", "p3"), params).where(mixed >= F.col("threshold"))
    by = ["w1", "w2", "threshold"]
    return swept_f05(kept.select(*by, "s1", "o"), by, params, truth, spine)


def source_of(o: str = "o") -> Column:
    return F.substring_index(o, "-", 1)


def best_per_other(scores: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(s1, o, score): each partner goes to its best query row."""
    order = Window.partitionBy("o").orderBy(F.desc("score"), "s1")
    rows = scores.where(F.col("score") >= threshold).select("s1", "o", "score")
    return rows.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def two_step(scores: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(s1, o, score): best query row of each partner, then the best partner of each query row and source."""
    order = Window.partitionBy("s1", source_of()).orderBy(F.desc("score"), "o")
    return best_per_other(scores, threshold).withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def greedy(scores: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(s1, o, score): edges by score descending, each partner once, each query row once per source.

    Rounds of mutually best edges give the sequential result, as the order (score, s1, o) is total.  Every
    round is checkpointed to the session's checkpoint folder; at least the best edge left is taken in
    each, and most edges in the first few.
    """
    left = checkpointed(scores.where(F.col("score") >= threshold).select("s1", "o", "score", source_of().alias("src")))
    taken = []
    by_query = Window.partitionBy("s1", "src").orderBy(F.desc("score"), "s1", "o")
    by_other = Window.partitionBy("o").orderBy(F.desc("score"), "s1", "o")
    while not left.isEmpty():
        ranked = left.withColumns({"a": F.row_number().over(by_query), "b": F.row_number().over(by_other)})
        mutual = checkpointed(ranked.where("a = 1 and b = 1").select("s1", "o", "score", "src"))
        taken.append(mutual.select("s1", "o", "score"))
        left = checkpointed(left.join(mutual.select("s1", "src"), ["s1", "src"], "left_anti").join(mutual.select("o"), "o", "left_anti"))
    out = left.select("s1", "o", "score")
    for t in taken:
        out = out.unionByName(t)
    return out


def blocking_recall(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """One row per scope (all, and each partner source): recall, recovered, total; recall 1 if there is nothing to find."""
    found = truth.join(pairs.select("s1", "o").distinct().withColumn("hit", F.lit(1)), ["s1", "o"], "left")
    scoped = found.select(F.explode(F.array(F.lit("all"), source_of())).alias("scope"), "hit")
    total = F.count("*")
    return scoped.groupBy("scope").agg(
        F.round(F.count("hit") / total, 6).alias("recall"), F.count("hit").alias("recovered"), total.alias("total_true")
    )


def missed_pairs(pairs: DataFrame, truth: DataFrame, s1: DataFrame, other: DataFrame) -> DataFrame:
    """True pairs that no pass found, with their texts."""
    lost = truth.join(pairs.select("s1", "o").distinct(), ["s1", "o"], "left_anti")
    text = lambda e, key, x: e.select(F.col("entity_id").alias(key), F.col("business_name").alias(f"{x}_name"), F.col("business_address").alias(f"{x}_address"))
    return lost.join(text(s1, "s1", "a"), "s1").join(text(other, "o", "b"), "o")


def score_diagnostics(scores: DataFrame, cuts: tuple[float, ...] = (0.5, 0.7, 0.9)) -> DataFrame:
    """One row: min, max, mean and median score, and counts above cut-offs."""
    above = [F.count_if(F.col("score") >= c).alias(f"n_{int(100 * c)}") for c in cuts]
    return scores.agg(
        F.min("score").alias("low"), F.max("score").alias("high"), F.round(F.avg("score"), 6).alias("mean"),
        F.median("score").alias("median"), *above,
    )


def alpha_sweep(
    scores: DataFrame, truth: DataFrame, spine: DataFrame, alphas: list[float], thresholds: list[float], a: str = "p1", b: str = "p2"
) -> DataFrame:
    """(alpha, threshold, f05) of blends alpha a + (1 - alpha) b, where each partner goes to its best query row.

    That row doesn't depend on the threshold, so partners are assigned once for each alpha.
    """
    spark = scores.sparkSession
    mixed = F.round(F.col("alpha") * F.col(a) + (1 - F.col("alpha")) * F.col(b), 6)
    each = _swept(scores.select("s1", "o", a, b), grid(spark, "alpha", alphas).drop("pos")).select("alpha", "s1", "o", mixed.alias("score"))
    first = Window.partitionBy("alpha", "o").orderBy(F.desc("score"), "s1")
    best = each.withColumn("r", F.row_number().over(first)).where("r = 1")
    params = spark.createDataFrame([(float(x), float(t)) for x in alphas for t in thresholds], "alpha double, threshold double")
    kept = best.join(F.broadcast(params), "alpha").where(F.col("score") >= F.col("threshold"))
    return swept_f05(kept.select("alpha", "threshold", "s1", "o"), ["alpha", "threshold"], params, truth, spine)


def with_default(pairs: DataFrame, scores: DataFrame, default: float = 0.0) -> DataFrame:
    """(s1, o, score) of every pair: its score, or ``default`` where it has none."""
    return pairs.select("s1", "o").join(scores.select("s1", "o", "score"), ["s1", "o"], "left").fillna({"score": default})


def replaced(column: Column, values: dict, default) -> Column:
    """The value that a mapping has for the column, or ``default``."""
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(table, column), F.lit(default))
