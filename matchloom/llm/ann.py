"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables.

A pseudo-rotation is three rounds of random signs and a fast Hadamard transform; a unit
vector hashes to the signed axis nearest to it.  A table concatenates such hashes.
The first names the bucket that rows are dealt by, the others are compared inside.  A
query probes the combinations of axes that lose least, and ranks what it finds by exact
distances of the original vectors.

The number of combinations grows with the number n of vectors, as n ** ``GROWTH``, while the number of probes
stays: the share of rows that a query ranks falls as the table grows, and neighbours, which are nearer in
larger tables, are still found.  A query that finds fewer than ``k`` rows is compared with all rows, in blocks.

Equal vectors collapse first: of a group, only the smallest ``k`` + 1 ids can be among
``k`` nearest, so a vector that a third of all rows share costs as much as any other.
Buckets of near vectors that hold more than ``BLOCK`` rows are split into blocks that
every query of the bucket visits; nothing is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .storage import durable

#: Tables, and probed combinations of axes in each.
TABLES, PROBES = 16, 128
#: A table has ``COMBINATIONS`` for ``ROWS`` vectors, and grows by this power of their number.
COMBINATIONS, ROWS, GROWTH = 8192, 10_000, 0.41
BLOCK = 8192


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows with a power of two of columns, orthonormal."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """Three rounds of random signs and Hadamard transforms."""
    rng = np.random.default_rng(seed)
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], x.shape[1]))
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 and padded to a power of two of columns."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def axes(rows: int, width: int) -> list[int]:
    """Axes of each hash of a table for so many vectors: combinations are a power of two, and only the last hash has fewer axes."""
    bits = max(1, round(math.log2(COMBINATIONS * (max(rows, 1) / ROWS) ** GROWTH)))
    whole = width.bit_length()
    out = [width] * (bits // whole)
    return out + [1 << bits % whole - 1] if bits % whole else out


def _rotated(x: np.ndarray, table: int, each: list[int]) -> list[np.ndarray]:
    return [rotate(x, 1000 * table + i)[:, :n] for i, n in enumerate(each)]


def hashes(x: np.ndarray, table: int, each: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The first hash of unit rows in a table, 2 axis + (1 if negative), and the others as one number."""
    codes = []
    for m in _rotated(x, table, each):
        i = np.abs(m).argmax(axis=1)
        codes.append(2 * i + (m[np.arange(len(m)), i] < 0))
    rest = np.zeros(len(x), np.int64)
    for code, n in zip(codes[1:], each[1:], strict=True):
        rest = rest * 2 * n + code
    return codes[0], rest


def probes(x: np.ndarray, table: int, each: list[int], most: int = PROBES) -> tuple[np.ndarray, np.ndarray]:
    """For each unit row, the ``most`` combinations that lose least, as two arrays of (rows, probes) like :func:`hashes`.

    Losses add up, so the best combinations of some hashes begin with the best of fewer ones.
    """
    row = np.arange(len(x))[:, None]
    loss, first, rest = np.zeros((len(x), 1)), None, np.zeros((len(x), 1), np.int64)
    for m, n in zip(_rotated(x, table, each), each, strict=True):
        both = np.stack((m, -m), axis=2).reshape(len(m), -1)
        more = loss[:, :, None] + ((both.max(axis=1, keepdims=True) - both) ** 2)[:, None, :]
        best = np.argsort(more.reshape(len(x), -1), axis=1, kind="stable")[:, :most]
        loss, before, code = np.take_along_axis(more.reshape(len(x), -1), best, axis=1), best // (2 * n), best % (2 * n)
        if first is None:
            first, rest = code, np.zeros_like(code)
        else:
            first, rest = first[row, before], rest[row, before] * 2 * n + code
    return first, rest


def _matrix(column: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1).astype(float)


def _bytes(vectors: DataFrame, vector_col: str, kind: str, *keep: str) -> DataFrame:
    """The kept columns and the vector as floats of its own width in ``v``."""

    @F.pandas_udf("binary")
    def pack(x: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(v, kind).tobytes() for v in x], dtype=object)

    return vectors.select(*keep, pack(vector_col).alias("v"))


def _nearest(points: pd.DataFrame, asked: pd.DataFrame, k: int, kind: str) -> pd.DataFrame:
    """The k nearest distinct vectors of each query among a block's rows that share one of its ``rests``; of all rows, where that is null."""
    if not len(points) or not len(asked):
        return pd.DataFrame({"q": [], "p": [], "score": []}).astype({"q": "int64", "p": "int64", "score": "float64"})
    rest, gid, x = points["rest"].to_numpy(), points["gid"].to_numpy(), _matrix(points["v"], kind)
    low = points["low"].to_numpy()
    out_q, out_p, out_s = [], [], []
    for q, rests, v in zip(asked["gid"], asked["rests"], asked["v"], strict=True):
        at = np.arange(len(x)) if rests is None else np.flatnonzero(np.isin(rest, rests))
        if not len(at):
            continue
        d = x[at] - np.frombuffer(v, kind).astype(float)
        score = np.sqrt((d * d).sum(axis=1))
        if len(at) > k:
            least = np.partition(score, k - 1)[k - 1]
            at, score = at[score <= least], score[score <= least]
            best = np.lexsort((low[at], score))[:k]
            at, score = at[best], score[best]
        out_q.append(np.full(len(at), q, np.int64)), out_p.append(gid[at]), out_s.append(score)
    if not out_q:
        return _nearest(points.iloc[:0], asked, k, kind)
    return pd.DataFrame({"q": np.concatenate(out_q), "p": np.concatenate(out_p), "score": np.concatenate(out_s)})


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """The ``k`` nearest rows found for each query: query_id, rank (from 1), ``id_col``, score.

    ``queries`` has the ids of rows of ``vectors``.  score: Euclidean distance of the
    original vectors in double precision; nearest first, ties to the smaller id.  Rows
    that are null, empty, zero, hold a null or non-finite component, lack an id or have another
    dimension than most take no part.  Repeated rows count once; of rows that share an id but not a
    vector each is a row, and none answers a query by its own id.  A query has fewer than ``k``
    results only if there are fewer rows; empty tables give none; other columns play no part.
    """
    vectors = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    fine = vectors.where(F.col("id").isNotNull() & whole & F.exists("vector", lambda x: x != 0))
    sizes = fine.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    fine = fine.where(F.size("vector") == (sizes["n"] if sizes else 0)).withColumn("gid", F.xxhash64("vector"))
    kind = "<f4" if dict(fine.dtypes)["vector"] == "array<float>" else "<f8"
    order = Window.partitionBy("gid").orderBy("id")
    few = fine.select("id", "gid").distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    ids = few.groupBy("gid").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    # One vector for each group: its smallest id has a row with it.
    firsts = few.where("r = 1").select("gid", "id")
    distinct = fine.join(firsts, ["gid", "id"]).dropDuplicates(["gid"])
    distinct = durable(_bytes(distinct, "vector", kind, "gid", F.col("id").alias("low")).join(ids, "gid"), "vectors")
    wanted = queries.select(F.col(id_col).alias("query_id")).distinct()
    asked = durable(fine.select(F.col("id").alias("query_id"), "gid").join(wanted, "query_id", "left_semi").distinct(), "queries")
    each = axes(distinct.count(), 1 << max(1, (sizes["n"] - 1).bit_length())) if sizes else [1]

    def table_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 2000):
                part = pdf.iloc[at : at + 2000]
                x = unit(_matrix(part["v"], kind))
                for table in range(TABLES):
                    first, rest = hashes(x, table, each)
                    yield part.assign(bucket=(table << 16) + first, rest=rest)

    def probe_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 200):
                part = pdf.iloc[at : at + 200]
                x = unit(_matrix(part["v"], kind))
                for table in range(TABLES):
                    first, rest = probes(x, table, each)
                    rows = [
                        (g, v, (table << 16) + int(a), f2[f1 == a].tolist())
                        for g, v, f1, f2 in zip(part["gid"], part["v"], first, rest, strict=True)
                        for a in np.unique(f1)
                    ]
                    yield pd.DataFrame(rows, columns=["gid", "v", "bucket", "rests"])

    def found(points: DataFrame, visitors: DataFrame) -> DataFrame:
        """(q, p, score): what visitors (gid, v, bucket, rests) find among points (gid, low, v, bucket, rest), bucket by bucket, in blocks."""
        sizes = durable(points.groupBy("bucket").count().select("bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "buckets")
        dealt = points.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("gid", "bucket"), F.col("blocks")).cast("int"))
        counts = sizes.select(F.col("bucket").alias("place"), F.col("blocks").alias("parts"))
        visits = visitors.withColumnRenamed("bucket", "place").join(counts, "place").select(
            "gid", "v", "rests", "place", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
        )
        dealt = dealt.select("gid", "low", "v", "rest", "bucket", "block")
        both = dealt.groupBy("bucket", "block").cogroup(visits.groupBy("place", "part"))
        return both.applyInPandas(lambda p, q: _nearest(p, q, k + 1, kind), "q long, p long, score double")

    best = Window.partitionBy("q").orderBy("score", "low")
    rank = Window.partitionBy("query_id").orderBy("score", "id")

    def ranked(pairs: DataFrame) -> DataFrame:
        """(gid, query_id, rank, id, score) of the found pairs' rows."""
        merged = pairs.groupBy("q", "p").agg(F.min("score").alias("score"))
        short = merged.join(distinct.select(F.col("gid").alias("p"), "low", "ids"), "p").withColumn("r", F.row_number().over(best))
        short = short.where(F.col("r") <= k + 1).select("q", "score", "ids")
        rows = asked.join(short, asked["gid"] == short["q"]).select("gid", "query_id", "score", F.explode("ids").alias("id"))
        return rows.where(F.col("id") != F.col("query_id")).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)

    points = distinct.select("gid", "low", "v").mapInPandas(table_rows, "gid long, low long, v binary, bucket int, rest long")
    seeds = distinct.join(asked, "gid", "left_semi").select("gid", "v")
    near = durable(ranked(found(points, seeds.mapInPandas(probe_rows, "gid long, v binary, bucket int, rests array<long>"))), "nearest")
    done = near.groupBy("gid", "query_id").count().where(F.col("count") >= k).select("gid", "query_id")
    open_ = asked.join(done, ["gid", "query_id"], "left_anti").select("gid").distinct()
    lacking = durable(distinct.join(open_, "gid", "left_semi").select("gid", "v"), "lacking")
    if not lacking.isEmpty():
        every = distinct.select("gid", "low", "v", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("rest"))
        visitors = lacking.select("gid", "v", F.lit(0).alias("bucket"), F.lit(None).cast("array<long>").alias("rests"))
        exact = ranked(found(every, visitors)).join(lacking, "gid", "left_semi")
        near = near.join(lacking, "gid", "left_anti").unionByName(exact)
    return near.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
