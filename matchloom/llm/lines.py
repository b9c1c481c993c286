"""Near-duplicate lines by a segment-partition edit join.

Lines within ``tau`` edits are linked; a class is a connected component, and its first
occurrence (smallest document, then line) is kept.

1. A line is known by a 64-bit hash.  Equal ones of a batch collapse at once; the rest meet under
   equal keys, where only different hashes are paired, so everything from step 3 on works on distinct lines.
2. A line of length l is cut into tau + 1 segments, which are indexed by l, place and
   content.  A longer or equal line within tau edits must hold one of them at a place
   that the edits before and after it allow, so it probes only those substrings, for
   the lengths l - tau to l.  Contents are compared as polynomial hashes, which prefix
   sums give for all substrings of a batch at once.
3. Entries with equal keys are a bucket.  Index and probe members are paired in small
   buckets; in large ones each meets one hub first, and what then isn't connected yet
   is paired in a second round, in pairs of blocks, so no link between classes is lost.  A pair is
   emitted only if the counts of its characters allow the edits.
4. Pairs are verified with a banded bit-parallel edit distance.

Lines shorter than ``min_chars`` characters are linked by equality only: a few edits
would turn them into quite other lines.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .components import components
from .minhash import _similar
from .sketch import shingles, words
from .storage import durable, release

TAU, MIN_CHARS = 2, 25
#: Index times probe members up to which all pairs of a bucket are compared at once.
SMALL = 1 << 22
#: Members of one side of a large bucket that a task compares with as many of the other at a time.
BLOCK = 4096
#: Most line hashes, labels or document ids (16 bytes each at most) that are broadcast.
FEW = 500_000
#: Parts into which the copies of one document are dealt.
SALTS = 256
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = " \t\n\x0b\f\r"


def within(a: str, b: str, tau: int) -> bool:
    """Whether the edit distance is at most ``tau``: a bit-parallel band of 2 tau + 1 diagonals."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > tau:
        return False
    start, end = 0, len(b)
    while start < end and a[start] == b[start]:
        start += 1
    shift = len(a) - len(b)
    while end > start and a[end - 1 + shift] == b[end - 1]:
        end -= 1
    a, b = a[start : end + shift], b[start:end]
    score = shift
    if not b:
        return True
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    mask = (1 << 2 * tau + 1) - 1
    goal = 1 << tau + shift
    plus, minus = mask & ~((1 << tau) - 1), 0
    for j, c in enumerate(b):
        x = ((at.get(c, 0) << tau) >> j) & mask | minus
        zero = (((x & plus) + plus) ^ plus | x) & mask
        up, down = minus | mask & ~(zero | plus), zero & plus
        half = zero >> 1
        minus, plus = half & up, down | mask & ~(half | up)
        if not zero & goal:
            score += 1
            if score > tau:
                return False
    return True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _points(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mixed code points of all lines in a row, and the lines' lengths."""
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return _mix(points + np.uint64(1)), np.fromiter(map(len, lines), np.int64, len(lines))


@functools.cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """2 ** ``bits`` powers of the base and of its inverse."""
    both = []
    for x in (_BASE, _INVERSE):
        each = np.full(1 << bits, x, np.uint64)
        each[0] = 1
        both.append(np.multiply.accumulate(each))
    return both[0], both[1]


def _segments(mixed: np.ndarray, size: np.ndarray, tau: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`segment_keys` of :func:`_points`."""
    start = np.cumsum(size) - size
    n = len(mixed)
    power, inverse = _powers(max(19, n.bit_length()))
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed * power[:n], out=prefix[1:])
    rows, keys, kinds = [], [], []

    def put(which: np.ndarray, place: np.ndarray, length: np.ndarray, of: np.ndarray, i: int, index: bool) -> None:
        a = start[which] + place
        content = (prefix[a + length] - prefix[a]) * inverse[a]
        tag = (of * (tau + 1) + i).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        rows.append(which), keys.append(_mix(content ^ tag)), kinds.append(np.full(len(which), index))

    for delta in range(tau + 1):
        which = np.flatnonzero(size - delta >= least)
        of = size[which] - delta
        short, extra = of // (tau + 1), of % (tau + 1)
        for i in range(tau + 1):
            longer = np.maximum(0, i - (tau + 1 - extra))
            place, length = i * short + longer, short + (i >= tau + 1 - extra)
            if delta == 0:
                put(which, place, length, of, i, True)
            for move in range(max(-i, delta - (tau - i)), min(i, delta + tau - i) + 1):
                ok = (place + move >= 0) & (place + move + length <= size[which])
                put(which[ok], place[ok] + move, length[ok], of[ok], i, False)
    return np.concatenate(rows), np.concatenate(keys).view(np.int64), np.concatenate(kinds)


def segment_keys(lines: list[str], tau: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, is index) of all segments and probes of the lines with at least ``least`` characters."""
    return _segments(*_points(lines), tau, least)


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc, line, lid, text) of (doc, text): every line with a character besides white space, trimmed; lines count from 0."""
    each = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    return each.select("doc", "line", F.btrim("raw", F.lit(_SPACE)).alias("text")).where("text <> ''").withColumn("lid", F.xxhash64("text"))


def _counts(mixed: np.ndarray, size: np.ndarray) -> np.ndarray:
    """:func:`bags` of :func:`_points`."""
    lane = ((mixed * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(60)).astype(np.int64)
    lane += np.repeat(np.arange(0, 16 * len(size), 16), size)
    return (np.bincount(lane, minlength=16 * len(size)).reshape(-1, 16) & 15).astype(np.uint64)


def bags(lines: list[str]) -> np.ndarray:
    """A row of 16 counts (modulo 16) per line, of characters by a hash: an edit moves at most two of them by one."""
    return _counts(*_points(lines))


def _packed(counts: np.ndarray) -> np.ndarray:
    return (counts << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64).view(np.int64)


def _lanes(bag: np.ndarray) -> np.ndarray:
    return ((bag.view(np.uint64)[:, None] >> (np.arange(16, dtype=np.uint64) * np.uint64(4))) & np.uint64(15)).astype(np.int8)


def _entries(lines: DataFrame, tau: int, least: int) -> DataFrame:
    """(key, lid, bag) of all segments and probes; the key's lowest bit marks segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lid = batch.column("lid").to_numpy()
            one = np.sort(np.unique(lid, return_index=True)[1])
            lid, texts = lid[one], batch.column("text").take(pa.array(one)).to_pylist()
            ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))) // 400_000
            for part in np.unique(ends):
                i, j = np.searchsorted(ends, [part, part + 1])
                points = _points(texts[i:j])
                row, key, index = _segments(*points, tau, least)
                arrays = [key & -2 | index, lid[i:j][row], _packed(_counts(*points))[row]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["key", "lid", "bag"])

    long = lines.where(F.length("text") >= least).select("lid", "text")
    return long.mapInArrow(run, "key long, lid long, bag long")


def _pairs_in(
    lid: np.ndarray, index: np.ndarray, bag: np.ndarray, tau: int, comp: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Index and probe members whose character bags allow ``tau`` edits, block by block; with ``comp`` only across components."""
    left, at = np.unique(lid[index], return_index=True)
    a, ca = _lanes(bag[index][at]), None if comp is None else comp[index][at]
    right, at = np.unique(lid[~index], return_index=True)
    b, cb = _lanes(bag[~index][at]), None if comp is None else comp[~index][at]
    out = [(left[:0], right[:0])]
    for i in range(0, len(left), 64):
        for j in range(0, len(right), 2048):
            apart = np.abs(a[i : i + 64, None] - b[None, j : j + 2048])
            near = np.minimum(apart, 16 - apart).sum(axis=2) <= 2 * tau
            near &= left[i : i + 64, None] != right[None, j : j + 2048]
            if comp is not None:
                near &= ca[i : i + 64, None] != cb[None, j : j + 2048]
            x, y = np.nonzero(near)
            out.append((left[i + x], right[j + y]))
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


_FOUND = {"a": np.int64, "b": np.int64, "key": np.int64, "lid": np.int64, "is_index": bool, "bag": np.int64}


class _Buckets:
    """Runs of equal keys in sorted rows: candidate pairs (a, b), and all members of large runs (key, lid, is_index, bag).

    Holds the current batch and, of a run that crosses batches, either its rows (up to ``SMALL`` pairs) or, once
    it is large, only its two hubs, which its further members meet.
    """

    def __init__(self, tau: int):
        self.tau = tau
        self.key: int | None = None
        self.hubs: list[tuple[int, int] | None] | None = None
        self.left = [np.empty(0, np.int64)] * 3

    def large(self, key: int, lid: np.ndarray, index: np.ndarray, bag: np.ndarray) -> list[tuple]:
        """The pairs of these members with the hubs of the run."""
        if self.hubs is None:
            self.hubs = [None, None]
        out = []
        for side, mine in enumerate((index, ~index)):
            if self.hubs[side] is None and mine.any():
                i = np.flatnonzero(mine)[lid[mine].argmin()]
                self.hubs[side] = (int(lid[i]), int(bag[i]))
        for side, mine in enumerate((index, ~index)):
            if (hub := self.hubs[1 - side]) is not None:
                sides = np.append(mine[mine], False) if side == 0 else np.append(~mine[mine], True)
                out.append(_pairs_in(np.append(lid[mine], hub[0]), sides, np.append(bag[mine], hub[1]), self.tau))
        return out

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield self.step([np.concatenate((r, batch.column(n).to_numpy())) for r, n in zip(self.left, ("key", "lid", "bag"), strict=True)], False)
        yield self.step(self.left, True)

    def step(self, rows: list[np.ndarray], last: bool) -> pa.RecordBatch:
        key, lid, bag = rows
        pairs, members = [], []
        self.left = [r[:0] for r in rows]
        if len(key):
            index, key = (key & 1).astype(bool), key >> 1
            cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            ends = np.r_[cuts[1:], len(key)]
            lo, hi = np.minimum.reduceat(lid, cuts), np.maximum.reduceat(lid, cuts)
            if self.key != key[0]:
                self.key, self.hubs = None, None
            todo = set(np.flatnonzero(lo != hi).tolist()) | {0} | {len(cuts) - 1}
            for i in sorted(todo):
                at = slice(cuts[i], ends[i])
                n = int(index[at].sum())
                open_ = i == len(cuts) - 1 and not last
                many = self.hubs is not None and i == 0 or n * (ends[i] - cuts[i] - n) > SMALL
                if open_ and not many and n < 2048 and ends[i] - cuts[i] < 4096:
                    self.left = [r[at] for r in rows]
                elif many or open_:  # open: one side only, so far, but long
                    pairs += self.large(int(key[at][0]), lid[at], index[at], bag[at])
                    members.append((key[at], lid[at], index[at], bag[at]))
                elif lo[i] != hi[i]:
                    pairs.append(_pairs_in(lid[at], index[at], bag[at], self.tau))
                if open_:
                    self.key = int(key[at][0])
                else:
                    self.key, self.hubs = None, None
        n, m = sum(len(x) for x, _ in pairs), sum(len(x) for x, *_ in members)
        out = []
        for at, (name, kind) in enumerate(_FOUND.items()):
            parts = [p[at] for p in pairs] if at < 2 else [x[at - 2] for x in members]
            known = pa.array(np.concatenate([np.empty(0, kind), *parts]).astype(kind))
            none = pa.nulls(m if at < 2 else n, known.type)
            out.append(pa.concat_arrays([known, none] if at < 2 else [none, known]))
        return pa.RecordBatch.from_arrays(out, names=list(_FOUND))


def _verified(pairs: DataFrame, docs: DataFrame, places: DataFrame, tau: int) -> DataFrame:
    """The pairs (a, b) of distinct lines that are within ``tau`` edits; texts come from the documents that hold them."""

    @F.pandas_udf("boolean")
    def near(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([within(p, q, tau) for p, q in zip(x, y, strict=True)], dtype=bool)

    ends = durable(pairs.select(F.col("a").alias("lid")).unionByName(pairs.select(F.col("b").alias("lid"))).distinct(), "ends")
    # Few ends and documents, by count, go to the lines and texts; else they meet by hash.
    ends = F.broadcast(ends) if ends.count() <= FEW else ends
    held = durable(places.select("lid", "doc").join(ends, "lid").groupBy("lid").agg(F.min("doc").alias("doc")), "held")
    mine = held.select("doc").distinct()
    mine = F.broadcast(mine) if held.count() <= FEW else mine
    texts = line_rows(docs.join(mine.where("doc is not null"), "doc", "left_semi")).unionByName(line_rows(docs.where("doc is null")))
    texts = texts.select("lid", "text").join(ends, "lid", "left_semi").dropDuplicates(["lid"])
    texts = durable(texts, "texts")
    full = pairs.join(texts.select(F.col("lid").alias("a"), F.col("text").alias("x")), "a").join(
        texts.select(F.col("lid").alias("b"), F.col("text").alias("y")), "b"
    )
    out = durable(full.where(near("x", "y")).select("a", "b"), "links")
    release(texts, held)
    return out


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _across(members: DataFrame, tau: int) -> DataFrame:
    """Candidate pairs (a, b) between components of large buckets: (key, lid, is_index, bag, comp), in pairs of blocks.

    A member visits every block of the other side, so no task holds more than two blocks whatever a bucket holds.
    """
    side = lambda c: F.greatest(F.ceil(F.sum(c.cast("int")) / BLOCK), F.lit(1)).cast("int")
    keys = members.groupBy("key").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), side(F.col("is_index")).alias("ni"), side(~F.col("is_index")).alias("nj")
    )
    dealt = members.join(keys.where("lo < hi").select("key", "ni", "nj"), "key")
    own, other = F.when(F.col("is_index"), F.col("ni")).otherwise(F.col("nj")), F.when(F.col("is_index"), F.col("nj")).otherwise(F.col("ni"))
    dealt = dealt.withColumns({"own": F.pmod(F.xxhash64("lid"), own).cast("int"), "other": F.explode(F.sequence(F.lit(0), other - 1))})
    i, j = (F.when(c, F.col("own")).otherwise(F.col("other")) for c in (F.col("is_index"), ~F.col("is_index")))

    def pairs(g: pd.DataFrame) -> pd.DataFrame:
        a, b = _pairs_in(*(g[c].to_numpy() for c in ("lid", "is_index", "bag")), tau, g["comp"].to_numpy())
        return pd.DataFrame({"a": a, "b": b})

    dealt = dealt.select("key", i.alias("i"), j.alias("j"), "lid", "is_index", "bag", "comp")
    return dealt.groupBy("key", "i", "j").applyInPandas(pairs, "a long, b long").select(*_ordered(F.col("a"), F.col("b"))).distinct()


def line_links(docs: DataFrame, places: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS) -> DataFrame:
    """Links (a, b) between distinct lines that span the same classes as all links within ``tau`` edits.

    ``docs`` has (doc, text), and ``places`` the (doc, lid) of its lines.
    """
    least = max(min_chars, tau + 1)
    entries = _entries(line_rows(docs), tau, least)
    schema = "a long, b long, key long, lid long, is_index boolean, bag long"
    found = durable(entries.repartition(F.shiftright("key", 1)).sortWithinPartitions("key").mapInArrow(lambda x: _Buckets(tau).run(x), schema), "pairs")
    first = found.where("key is null").select(*_ordered(F.col("a"), F.col("b"))).distinct()
    first = _verified(first, docs, places, tau)
    members = found.where("key is not null").select("key", "lid", "is_index", "bag").distinct()
    if members.isEmpty():
        return first
    label = components(first).withColumnRenamed("node", "lid")
    members = members.join(label, "lid", "left").select("key", "lid", "is_index", "bag", F.coalesce("component", "lid").alias("comp"))
    members = durable(members, "members")
    return first.unionByName(_verified(durable(_across(members, tau), "across"), docs, places, tau))


def _places(docs: DataFrame, id_col: str, text_col: str, tau: int, min_chars: int) -> DataFrame:
    """(doc, line, lid, size, class, first, kept) of every line with a word; first: (doc, line) of its class."""
    rows = docs.select(_column(id_col).cast("long").alias("doc"), _column(text_col).alias("text"))
    places = durable(line_rows(rows).select("doc", "line", "lid", F.length("text").alias("size")), "places")
    label = components(line_links(rows, places, tau, min_chars)).withColumnRenamed("node", "lid")
    few = label.count() <= FEW
    named = places.join(F.broadcast(label) if few else label, "lid", "left").select(
        "doc", "line", "lid", "size", F.coalesce("component", "lid").alias("class")
    )
    named = named if few else durable(named, "named")
    first = named.groupBy("class").agg(F.min(F.struct("doc", "line")).alias("first"))
    return named.join(first, "class").withColumn(
        "kept", F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("line") == F.col("first.line"))
    )


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def line_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU, min_chars: int = MIN_CHARS
) -> DataFrame:
    """One row per line with a word: ``id_col``, line, class_doc, class_line, kept.

    Lines are split at ``\\n``, trimmed of ``[\\x20\\x09-\\x0D]`` and counted from 0 with the blank ones.
    The class is named by its first occurrence; ``kept`` marks that one.  Defined cases: null, empty
    and blank texts have no rows; a null id comes before all others; of repeated rows or ids with the same
    line number all first ones are kept alike; an empty table gives an empty result; other columns
    play no part.
    """
    return _places(docs, id_col, text_col, tau, min_chars).select(
        F.col("doc").alias(id_col),
        F.col("line").cast("long").alias("line"),
        F.col("first.doc").alias("class_doc"),
        F.col("first.line").cast("long").alias("class_line"),
        "kept",
    )


def _near_copies(cut: DataFrame, k: int, percent: int) -> DataFrame:
    """(c, h) of the rows of ``cut`` whose ``part`` has the similarity to the text of document ``of``, on full shingle sets."""

    @F.pandas_udf("boolean")
    def near(x: pd.Series, y: pd.Series) -> pd.Series:
        sets = ((shingles(words(p), k), shingles(words(q), k)) for p, q in zip(x, y, strict=True))
        return pd.Series([len(a) > 0 and len(b) > 0 and _similar(a, b, percent) for a, b in sets], dtype=bool)

    asked = cut.where("part is not null and of is not null and id is not null").select(
        F.col("id").alias("c"), F.xxhash64("text", "part").alias("h"), "of", F.col("part").alias("x")
    )
    asked = asked.withColumn("salt", F.pmod("h", F.lit(SALTS)))
    # A document with many copies goes to those parts of them that occur; few, by count, go to the texts.
    wanted = durable(asked.select("of", "salt").distinct(), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= FEW else wanted
    texts = cut.select(F.col("id").alias("of"), F.col("text").alias("y")).join(wanted, "of")
    return asked.join(texts, ["of", "salt"]).where(near("x", "y")).select("c", "h").distinct()


def without_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tau: int = TAU,
    min_chars: int = MIN_CHARS,
    spare: float = 0.5,
    k: int = 5,
    threshold: float = 0.75,
) -> DataFrame:
    """The rows of ``docs`` with all but the first occurrence of every line class cut out of their texts.

    A document that would lose more than ``spare`` of its characters may be a near copy, which is a matter for a
    document-level step.  Of its repeats those are put back whose first occurrences the one other document holds
    that has most of them; they stay if the two, as they are left then, reach the ``threshold`` of that step on their
    ``k``-word shingles.  In all other documents every repeat is cut.  Rows, columns and other lines stay as they are.

    Defined cases: null, empty and blank texts stay; a null id comes before all others, and its rows are no near
    copies; rows that share an id but not a text are told apart by their lines; repeated rows stay repeated; an
    empty table gives an empty result; other columns stay, whatever their names.
    """
    # A line within a document: half of its hash, then its place.
    spot = lambda lid, line: lid.bitwiseAND(-(1 << 32)).bitwiseOR(line.cast("long"))
    gone = _places(docs, id_col, text_col, tau, min_chars).where("not kept")
    gone = gone.groupBy("doc", F.col("first.doc").alias("of")).agg(
        F.collect_set(spot(F.col("lid"), F.col("line"))).alias("spots"), F.sum("size").alias("n")
    )
    other = F.when(~F.col("of").eqNullSafe(F.col("doc")), F.struct("n", "of"))
    gone = gone.groupBy("doc").agg(F.collect_list(F.struct("of", "spots")).alias("by"), F.max(other)["of"].alias("of"))
    gone = gone.select(
        "doc", "of", F.flatten(F.col("by.spots")).alias("gone"),
        F.flatten(F.transform(F.filter("by", lambda b: ~b["of"].eqNullSafe(F.col("of"))), lambda b: b["spots"])).alias("others"),
    )
    rest = F.struct(*[_column(c).alias(c) for c in docs.columns if c != text_col])
    rows = docs.select(rest.alias("row"), _column(id_col).cast("long").alias("id"), _column(text_col).alias("text"))
    cut = rows.join(gone, rows["id"].eqNullSafe(gone["doc"]), "left").drop("doc")
    cut = cut.withColumn("lines", F.when(F.col("gone").isNotNull(), F.split("text", "\n")))
    cut = cut.withColumn("spots", F.transform("lines", lambda x, i: spot(F.xxhash64(F.btrim(x, F.lit(_SPACE))), i)))
    without = lambda name: F.array_join(
        F.transform(F.array_except("spots", name), lambda x: F.get("lines", x.bitwiseAND((1 << 32) - 1).cast("int"))), "\n"
    )
    cut = cut.withColumn("left", F.when(F.col("gone").isNotNull(), without("gone")))
    short = F.length("left") < (1 - spare) * F.length("text")
    cut = cut.select("row", "id", F.coalesce("left", "text").alias("text"), "of", F.when(short, without("others")).alias("part"))
    cut = durable(cut, "cut")
    copies = durable(_near_copies(cut, k, round(threshold * 100)), "copies")
    asked = cut.where("part is not null").withColumn("h", F.xxhash64("text", "part"))
    asked = asked.join(copies, (asked["id"] == copies["c"]) & (asked["h"] == copies["h"]), "left")
    asked = asked.withColumn("text", F.when(F.col("c").isNotNull(), F.col("part")).otherwise(F.col("text")))
    whole = cut.where("part is null").select("row", "text").unionByName(asked.select("row", "text"))
    return whole.select(*[(F.col("text") if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
