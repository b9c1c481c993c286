"""Best-fit packing of documents into fixed-size sequences.

The pieces' lengths make a histogram, bounded by the sequence size and not by the
data.  On it the driver plans: patterns of one to three lengths that fill a sequence
exactly are enumerated, repeat counts are fitted to the histogram by non-negative
least squares (an active-set method), rounded down, and capped by what is there; the rest of
the histogram is packed best-fit decreasing, on counts.  Executors then number the
pieces of every length and look their places up in the plan.
"""

from __future__ import annotations

import functools
import json
import os
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .storage import durable

#: Fixed value: the pattern of byte-level pre-tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PROBE = "It's 12.5 % of déjà-vu;\n\n  naïve  Straße\t\u00a0x -- don't, 漢字 ½ \U0001f600 end. "
#: Least repeats of a fitted pattern, in the plans that are compared.
LEAST_REPEATS = (1, 2, 3)
#: Pieces of one length that are numbered together in a task.
RUN = 50_000


def are_ranks(merges: list[tuple[bytes, bytes]], ranks: dict[bytes, int]) -> bool:
    """Whether merging listed pairs in their order and merging whatever has the least rank give the same ids for all bytes.

    They do if every token but the single bytes is the result of one merge, in the order of ids, and if its bytes,
    merged by lower ranks, end in the two parts of that merge: no other two parts of it can then ever be neighbours.
    """
    made = [ranks.get(a + b, -1) for a, b in merges]
    if any(x >= y for x, y in zip(made, made[1:], strict=False)) or made[:1] == [-1]:
        return False
    if len(made) + sum(len(t) == 1 for t in ranks) != len(ranks):
        return False
    for (a, b), own in zip(merges, made, strict=True):
        whole = a + b
        parts = [whole[i : i + 1] for i in range(len(whole))]
        while len(parts) > 2:
            low, at = min((ranks.get(parts[i] + parts[i + 1], own), i) for i in range(len(parts) - 1))
            if low >= own:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if parts != [a, b]:
            return False
    return True


class TextEncoder:
    """Ids of whole texts by a ``tokenizers`` file.

    A byte-level BPE file whose merges are in the order of their ids may be a rank table, and the
    rank-based library encodes it several times faster.  That way is taken if every merge is proved to be
    that of the ranks and both libraries cut ``PROBE`` alike; else, and for any text with a special token's string, the
    file's own library encodes.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.ranked = None
        ranked = self._ranked(path)
        if ranked is not None and ranked.encode_ordinary(PROBE) == self.direct(PROBE):
            self.ranked = ranked

    @staticmethod
    def _ranked(path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        if not all(c in byte for t in vocab for c in t):
            return None
        plain = lambda t: bytes(byte[c] for c in t)
        ranks = {plain(t): i for t, i in vocab.items()}
        pairs = [tuple(map(plain, m.split(" ") if isinstance(m, str) else m)) for m in spec["model"]["merges"]]
        if not are_ranks(pairs, ranks):
            return None
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def direct(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        ids = self.direct(text) if self.ranked is None or "<|" in text else self.ranked.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()


@functools.cache
def encoder(path: str) -> TextEncoder:
    """One encoder for a worker process."""
    return TextEncoder(path)


def tokenized_pieces(
    docs: DataFrame, tokenizer: str, end_id: int, size: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, piece, start, length, ids): each document's ids and the end id, cut only where longer than ``size``.

    The first piece of a long document is the shorter one.  ids: little-endian unsigned 32-bit.  Defined cases: a null
    text counts as empty, one piece that holds the end id; a null id stays null; repeated rows have
    their pieces each; an empty table has none; other columns play no part, whatever their names.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        for pdf in batches:
            texts = pdf["text"].fillna("")
            block = (texts.str.len() + 100).cumsum() // 1_000_000
            for at in block.unique():
                mine = (block == at).to_numpy()
                rows = []
                for doc, text in zip(pdf["doc"][mine], texts[mine], strict=True):
                    ids = encode(text) + end
                    n = len(ids) // 4
                    first = (n - 1) % size + 1
                    cuts = [0, *range(first, n + 1, size)]
                    rows += [(doc, i, a, b - a, ids[4 * a : 4 * b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
                out = pd.DataFrame(rows, columns=["doc", "piece", "start", "length", "ids"])
                yield out.assign(doc=pd.array(out["doc"], "Int64"))

    rows = docs.select(_column(id_col).cast("long").alias("doc"), _column(text_col).alias("text"))
    made = rows.mapInPandas(run, "doc long, piece int, start long, length long, ids binary")
    return made.withColumnRenamed("doc", id_col)


def patterns(size: int, lengths: np.ndarray) -> np.ndarray:
    """Rows (a, b, c) with a >= b >= c >= 0 and a + b + c = size, of the given lengths and 0."""
    there = np.zeros(size + 1, bool)
    there[lengths] = True
    there[0] = True
    a, b = np.meshgrid(np.flatnonzero(there), np.flatnonzero(there), indexing="ij")
    c = size - a - b
    ok = (a >= b) & (b >= c) & (c >= 0) & (a > 0)
    ok[ok] = there[c[ok]]
    return np.stack((a[ok], b[ok], c[ok]), axis=1)


def fit(target: np.ndarray, rows: np.ndarray, most: int = 1500) -> np.ndarray:
    """Non-negative repeat counts x of the patterns with least squared distance of A x to the histogram.

    Lawson and Hanson's active-set method.  A has at most three entries in a column, so
    the gradient is three gathers; the inverse of the passive columns' Gram matrix is
    kept by bordering, in one buffer.  Counts are rounded later, so it ends when no
    column has half a repeat to gain, or after ``most`` exchanges; what isn't fitted is
    packed as the residual.
    """
    x = np.zeros(len(rows))
    used = rows > 0
    weight = 1 / np.sqrt(np.maximum(used.sum(axis=1), 1))
    rest = target.astype(float).copy()
    barred = np.zeros(len(rows), bool)
    room = min(most, len(target)) + 1
    inverse, columns, values = np.zeros((room, room)), np.zeros((room, len(target))), np.zeros(room)
    passive: list[int] = []
    for _ in range(most if len(rows) else 0):
        k = len(passive)
        gain = (rest[rows] * used).sum(axis=1) * weight
        gain[passive] = -1
        gain[barred] = -1
        j = int(gain.argmax())
        if gain[j] <= 0.5 or k == room - 1:
            break
        col = np.bincount(rows[j][used[j]], minlength=len(target)).astype(float)
        cross = columns[:k] @ col
        solved = inverse[:k, :k] @ cross
        schur = float(col @ col - cross @ solved)
        if schur < 1e-8:  # depends on the passive columns
            barred[j] = True
            continue
        inverse[:k, :k] += np.outer(solved, solved / schur)
        inverse[:k, k] = inverse[k, :k] = -solved / schur
        inverse[k, k] = 1 / schur
        columns[k], values[k] = col, col @ target
        passive.append(j)
        while passive:
            k = len(passive)
            best = inverse[:k, :k] @ values[:k]
            down = best <= 0
            if not down.any():
                break
            now = x[passive]
            step = np.min(now[down] / np.maximum(now[down] - best[down], 1e-300))
            moved = np.maximum(now + step * (best - now), 0)
            out = np.flatnonzero(down & (moved <= 1e-9))
            x[passive] = moved
            for i in (out if len(out) else np.flatnonzero(down)[:1])[::-1]:
                x[passive[i]] = 0
                k = len(passive)
                pivot = inverse[:k, i].copy()
                inverse[:k, :k] -= np.outer(pivot, pivot / pivot[i])
                keep = np.delete(np.arange(k), i)
                inverse[: k - 1, : k - 1] = inverse[np.ix_(keep, keep)]
                columns[: k - 1], values[: k - 1] = columns[keep], values[keep]
                del passive[i]
        x[:] = 0
        if passive:
            x[passive] = best
        rest = target - x[passive] @ columns[: len(passive)]
    return x


@dataclass
class Plan:
    """Segments of places: the k-th piece of a length falls into the last segment whose ``first`` is <= k."""

    starts: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int
    fitted: int

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence numbers and offsets of the pieces."""
        big = np.int64(2**48)
        at = np.searchsorted(self.first, length * big + rank, side="right") - 1
        return self.sequence[at] + rank - (self.first[at] - self.starts[at] * big), self.offset[at]


def best_fit_decreasing(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, number of such sequences), by best fit in decreasing length, on counts."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r, groups in open_.items() if r >= length and groups), default=None)
            if room is None:
                each = size // length
                whole, part = divmod(left, each)
                for times, n in ((each, whole), (part, 1)):
                    if times and n:
                        open_[size - times * length].append(((length,) * times, n))
                break
            lengths, n = open_[room].pop()
            take = min(n, left)
            # As many copies as still fit go into the same sequence while pieces last.
            if n > take:
                open_[room].append((lengths, n - take))
            open_[room - length].append(((*lengths, length), take))
            left -= take
    return [g for groups in open_.values() for g in groups]


def _repeats(
    histogram: dict[int, int], rows: np.ndarray, x: np.ndarray, least: int
) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Patterns with at least ``least`` repeats, rounded down and capped by what is there, and what they leave."""
    left, groups = dict(histogram), []
    for j in np.argsort(-x, kind="stable"):
        if x[j] + 1e-6 < least:
            break
        lengths = tuple(int(v) for v in rows[j] if v)
        n = min([int(x[j] + 1e-6), *(left.get(v, 0) // lengths.count(v) for v in lengths)])
        if n:
            groups.append((lengths, n))
            for v in lengths:
                left[v] -= n
    return groups, left


def plan(histogram: dict[int, int], size: int) -> Plan:
    """Sequences for pieces of the given lengths (1 to ``size``): fitted patterns first, then the residual.

    Repeat counts are rounded down, as a repeat too many takes the short pieces that fill the residual.  Of the plans that
    leave patterns of under one, two or three repeats to the residual, that with the fewest sequences is taken.
    """
    left = dict(histogram)
    whole = [((size,), left.pop(size))] if left.get(size) else []
    target = np.zeros(size + 1)
    for length, n in left.items():
        target[length] = n
    rows = patterns(size, np.flatnonzero(target))
    x = fit(target, rows)
    made = []
    for least in LEAST_REPEATS:
        taken, rest = _repeats(left, rows, x, least)
        packed = best_fit_decreasing({v: n for v, n in rest.items() if n}, size)
        made.append((sum(n for _, n in taken + packed), whole + taken, packed))
    _, groups, packed = min(made, key=lambda m: m[0])
    fitted = sum(n for _, n in groups)
    groups = groups + packed
    segments, given, base = [], defaultdict(int), 0
    for lengths, n in groups:
        offset = 0
        for v in lengths:
            segments.append((v, given[v], base, offset))
            given[v] += n
            offset += v
        base += n
    segments.sort()
    table = np.array(segments, np.int64).reshape(-1, 4)
    return Plan(table[:, 0], table[:, 0] * 2**48 + table[:, 1], table[:, 2], table[:, 3], base, fitted)


def pack(pieces: DataFrame, size: int = 1024, order: tuple[str, ...] = ("doc_id", "piece"), length_col: str = "length") -> DataFrame:
    """Adds sequence_id (from 0) and offset to rows with a length from 1 to ``size``; their other columns stay.

    Every sequence holds at most ``size`` and has no gaps.  ``order`` numbers the pieces of
    a length; equal rows are interchangeable.  The rows are written once to the shared
    folder, as the plan and the numbering both read them.  An empty table stays empty; columns
    that are named sequence_id or offset are replaced.
    """
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows = durable(pieces.select(*[_column(c) for c in columns]), "pieces")
    counts = {r[0]: r[1] for r in rows.groupBy(_column(length_col).alias("length")).agg(F.count("*").alias("n")).collect()}
    made = plan(counts, size)
    # Numbers within a length: in runs of bounded size, spread by hash, with the runs' totals before each.
    split = 1 + max(counts.values(), default=0) // RUN
    salted = rows.select(
        F.struct(*[_column(c) for c in columns]).alias("row"), _column(length_col).alias("length"), F.struct(*[_column(c) for c in order]).alias("order")
    ).withColumn("salt", F.pmod(F.xxhash64("order"), F.lit(split)).cast("int"))
    totals = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("order")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).drop("order").join(bases, ["length", "salt"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = made.places(length.to_numpy(np.int64), rank.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = ranked.select("row", place(F.col("length"), F.col("rank") + F.col("base")).alias("at"))
    return placed.select(*[F.col("row")[c].alias(c) for c in columns], "at.sequence_id", "at.offset")


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids, starts) of packed pieces with their ids: the token arrays of at most ``size`` tokens."""
    parts = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    whole = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return parts.select("sequence_id", whole.alias("ids"), F.transform("parts", lambda x: x["offset"]).alias("starts"))
