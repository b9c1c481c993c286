"""Byte-level BPE with a local rank file: encoding of whole texts and raw-byte decoding.

Long texts are cut before the library's regular expression sees them, so its work and
memory for a call are bounded.  A cut is made only where a match of the pattern always
ends: after a letter, digit or mark that isn't white space and before a space or line
feed, since white space stands in a match only at its start or fills it wholly.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Characters after which the next safe place ends a part.
PART = 20_000
_SAFE = re.compile(r"(?<=[^\W_]|[.,;:!?])(?=[ \n])")


@functools.cache
def encoding(path: str, pattern: str):
    """The ``tiktoken`` encoding of a rank file, without special tokens."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = PART) -> Iterator[str]:
    """Consecutive parts of the text that encode to the same ids as the whole."""
    at = 0
    while len(text) - at > size and (cut := _SAFE.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(text: str, path: str, pattern: str) -> np.ndarray:
    """Ids of a whole text as unsigned 32-bit integers."""
    e = encoding(path, pattern)
    ids: list[int] = []
    for part in parts(text):
        ids += e.encode_ordinary(part)
    return np.array(ids, "<u4")


def decode(ids: np.ndarray, path: str, pattern: str) -> bytes:
    """The raw bytes of ids; they need not be valid UTF-8 if ids were cut."""
    return encoding(path, pattern).decode_bytes(ids.tolist())


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of every row, ids as little-endian unsigned 32-bit integers.

    A null text counts as empty and has no ids; repeated rows give repeated results; other columns
    play no part.  Lone surrogates can't occur in Spark strings.  ``path`` is a file that every
    executor can open (a tokenizer file of the installation, not of the data).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                some = pdf.iloc[at : at + 1000]
                yield pd.DataFrame({"id": pd.array(some["id"], "Int64"), "ids": [encode(t or "", path, pattern).tobytes() for t in some["text"]]})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "id long, ids binary").withColumnRenamed("id", id_col)


def decoded(rows: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """Adds the column ``bytes``: the decoded raw bytes of ``ids_col``."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for ids in batches:
            yield pd.Series([decode(np.frombuffer(x, "<u4"), path, pattern) for x in ids], dtype=object)

    return rows.withColumn("bytes", run(ids_col))
