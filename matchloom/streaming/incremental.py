"""Incremental matching: new query rows as a stream against a reference table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.blocking import block_deterministic, block_keys
from ..operators.context import candidate_scores


def stream_candidates(stream: DataFrame, other: DataFrame) -> DataFrame:
    """(s1, o, key_ord) of a stream of query rows: a stream-static join on block keys, without state or caps."""
    index = block_keys(other).select("block_key", "entity_id")
    keys = block_keys(stream).withColumnRenamed("entity_id", "s1").select("s1", "key_ord", "block_key")
    return keys.join(index.withColumnRenamed("entity_id", "o"), "block_key").select("s1", "o", "key_ord")


def match_batches(stream: DataFrame, other: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Blocks and scores every micro-batch with the caps of the batch operator; rows are written per batch, so a repeated one overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        pairs = block_deterministic(batch, other)
        candidate_scores(pairs, batch, other).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
