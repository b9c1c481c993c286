"""A training-corpus pipeline: quality rules, line dedup, near-dedup, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``.  All but the last return the
columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from matchloom.llm.lines import without_repeats
from matchloom.llm.minhash import near_duplicates
from matchloom.llm.packing import pack, tokenized_pieces
from matchloom.llm.quality import quality_filter
from matchloom.llm.storage import durable


def _counted(docs: DataFrame) -> DataFrame:
    """Characters counted anew; a null text keeps what its row says."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their too frequent lines.

    A null, empty or short text fails the base rules and goes; a null source is a source of its own; repeated rows stay
    repeated; an empty table stays empty; other columns stay.
    """
    return _counted(quality_filter(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; of near-equal lines the first stays, and near copies of one document keep theirs.

    Null, empty and blank texts stay as they are; a null id comes first; of rows that share an id the first lines of a class
    stay alike; an empty table stays empty; other columns stay.
    """
    return _counted(without_repeats(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest id.

    Texts without words stay; of repeated rows (equal id and text) one stays; rows with one id and different texts count as
    one document, and so do all rows with a null id, which stay if the words of one of them are in no row
    with an id; an empty table stays empty; other columns stay.
    """
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("id")).distinct().withColumn("key", F.xxhash64("id"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("key", F.xxhash64("row.doc_id"))
    left = rows.join(kept, (rows["key"] == kept["key"]) & F.col("row.doc_id").eqNullSafe(kept["id"]), "left_semi")
    # Rows are dealt by the key already; repeated ones are neighbours.
    again = F.row_number().over(Window.partitionBy("key", "row.doc_id", "row.text").orderBy("key"))
    left = left.withColumn("again", again).where("again = 1")
    return left.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences of at most 1024 tokens.

    A null or empty text is one piece that holds the end id; repeated rows have their pieces each; an empty table has
    none; other columns play no part.
    """
    import public_tokenizers

    pieces = tokenized_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, size=1024)
    return pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), 1024)


STAGES = [("quality_rules", quality), ("line_dedup", line_dedup), ("minhash_near_dedup", near_dedup), ("best_fit_packing", packing)]

#: Token ids and signatures can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
