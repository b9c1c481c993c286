"""Whole runs: blocking of one source pair, the blocking benchmark, training and matching."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from ..operators import blocking as bl, context as cx, decision as de, features as fe, training as tr
from ..sources import tables as tb
from ..sources.shared import checkpointed


@dataclass(frozen=True)
class Config:
    """Parameters of a run and their defaults."""

    val_share: float = 0.05
    max_val: int = 10_000
    max_train: int = 50_000
    max_bucket: int = 150
    per_key: int = 40
    per_s1: int = 80
    top_k_name: int = 30
    top_k_address: int = 40
    min_similarity: float = 0.12
    window: int = 10
    max_candidates: int = 150
    top_k_dense: int = 30
    hard_negative_ratio: int = 3
    trees: int = 20
    step: float = 0.1
    skip_tfidf: bool = False
    seed: int = 42


def name_text():
    return tx.normalize_name(F.col("business_name"))


def full_text():
    return tx.combined_text(name_text(), tx.normalize_address(F.col("business_address")))


def _makers(s1: DataFrame, other: DataFrame, config: Config, vectors: DataFrame | None) -> dict[str, Callable[[], DataFrame]]:
    def tfidf() -> DataFrame:
        names = bl.block_tfidf(s1, other, name_text(), config.top_k_name, config.min_similarity)
        whole = bl.block_tfidf(s1, other, full_text(), config.top_k_address, config.min_similarity)
        return names.select("s1", "o").unionByName(whole.select("s1", "o")).distinct()

    def dense() -> DataFrame:
        mine = lambda e: vectors.join(e.select("entity_id"), "entity_id", "left_semi")
        return bl.block_vector(mine(s1), mine(other), config.top_k_dense, id_col="entity_id", vector_col="vector")

    out = {"deterministic": lambda: bl.block_deterministic(s1, other, config.max_bucket, config.per_key, config.per_s1)}
    if not config.skip_tfidf:
        out["tfidf"] = tfidf
    out["sorted_neighbourhood"] = lambda: bl.block_sorted_neighbourhood(s1, other, config.window)
    return out if vectors is None else {**out, "dense": dense}


def passes(s1: DataFrame, other: DataFrame, config: Config = Config(), vectors: DataFrame | None = None) -> dict[str, DataFrame]:
    """Candidate pairs of each blocking pass, in order of priority."""
    return {name: made() for name, made in _makers(s1, other, config, vectors).items()}


def block_one_source(s1: DataFrame, other: DataFrame, config: Config = Config(), vectors: DataFrame | None = None) -> DataFrame:
    """The capped union of all passes, partners that exist only."""
    union = bl.union_candidates(list(passes(s1, other, config, vectors).values()), config.max_candidates)
    return bl.valid_only(union, other)


def benchmark(s1: DataFrame, other: DataFrame, truth: DataFrame, config: Config = Config(), vectors: DataFrame | None = None) -> DataFrame:
    """A report row per pass and for the final union: recall over all true pairs and candidate statistics."""
    found = passes(s1, other, config, vectors)
    found = {**found, "final_union": bl.union_candidates(list(found.values()), 200)}
    rows = None
    for name, pairs in found.items():
        row = _report_row(name, pairs, s1, truth)
        rows = row if rows is None else rows.unionByName(row)
    return rows


def _report_row(name: str, pairs: DataFrame, s1: DataFrame, truth: DataFrame) -> DataFrame:
    recall = de.blocking_recall(pairs, truth).where("scope = 'all'").drop("scope")
    return bl.candidate_stats(pairs, s1).crossJoin(recall).select(
        F.lit(name).alias("method"), "recall", "recovered", "total_true", (F.col("total_true") - F.col("recovered")).alias("missed"),
        "avg_candidates", "median_candidates", "max_candidates", "n_empty", "total_pairs",
    )


def timed_report(
    s1: DataFrame, other: DataFrame, truth: DataFrame, config: Config = Config(), vectors: DataFrame | None = None, path: str | None = None
) -> DataFrame:
    """The report of ``benchmark`` with the seconds of every pass; as a CSV file, too, if there is a ``path``.

    Each pass is made once and kept in the checkpoint folder, so its time is its own and the rest reads its pairs.
    """
    found, took = {}, {}
    for name, made in _makers(s1, other, config, vectors).items():
        began = time.monotonic()
        found[name] = checkpointed(made().select("s1", "o"))
        took[name] = time.monotonic() - began
    began = time.monotonic()
    found["final_union"] = checkpointed(bl.union_candidates(list(found.values()), 200))
    took["final_union"] = time.monotonic() - began
    rows = None
    for name, pairs in found.items():
        row = _report_row(name, pairs, s1, truth).withColumnRenamed("n_empty", "n_singletons").withColumn("time_sec", F.lit(round(took[name], 2)))
        rows = row if rows is None else rows.unionByName(row)
    if path:
        tb.write_report(rows, path)
    return rows


def train_and_tune(s1: DataFrame, other: DataFrame, truth: DataFrame, config: Config = Config()):
    """(model, feature names, threshold, f05): trees on balanced candidates, threshold tuned on held-out query rows."""
    train, val = tr.split_val(s1, config.val_share, config.seed)
    pairs = cx.candidate_scores(block_one_source(s1, other, config), s1, other)
    labelled = tr.label_pairs(pairs, truth)
    fit = tr.balanced_pairs(labelled.join(train.select(F.col("entity_id").alias("s1")), "s1", "left_semi"), config.hard_negative_ratio, config.seed)
    held = labelled.join(val.select(F.col("entity_id").alias("s1")), "s1", "left_semi")
    table = lambda p: fe.features_56(p, s1, other, native=True).join(p.select("s1", "o", "label"), ["s1", "o"])
    fit_rows = table(fit)
    names = [c for c in fit_rows.columns if c not in ("s1", "o", "label")]
    model = tr.train_boosted(fit_rows, names, config.trees, step=config.step, seed=config.seed)
    scored = tr.predict_proba(model, table(held)).select("s1", "o", "score")
    sweep = de.threshold_sweep(scored, truth.join(val.select(F.col("entity_id").alias("s1")), "s1", "left_semi"), val, [round(0.05 * i, 2) for i in range(2, 20)])
    threshold, f05 = de.best_threshold(sweep)
    return model, names, threshold, f05


def match(model, threshold: float, s1: DataFrame, other: DataFrame, config: Config = Config()) -> DataFrame:
    """One row per query row with its matches, by the model, the singleton rule and one-to-one assignment."""
    pairs = block_one_source(s1, other, config)
    scored = tr.predict_proba(model, fe.features_56(pairs, s1, other, native=True)).select("s1", "o", "score")
    kept = de.singleton_rule(scored, threshold).join(scored, ["s1", "o"])
    return tb.export_matches(de.two_step(kept), s1)
