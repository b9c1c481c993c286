"""MinHash near-duplicate groups of documents.

Documents are linked when the Jaccard similarity of their sets of word shingles
reaches the threshold; a group is a connected component of links.

1. One pass makes a sketch of every document: its set size, a 64-bit
   fingerprint of its word sequence, 128 minima of universal hashes and one byte
   of each minimum for estimates.
2. Documents with equal word sequences collapse to one node, so exact copies never
   meet in a bucket.
3. The minima are cut into bands of four.  Nodes that share a band are a bucket;
   every member is compared with the bucket's smallest member: by signature
   first, then on full shingle sets.
4. Components of the confirmed links.  Buckets whose members all lie in one
   component are done.  In the others, only pairs across components are left;
   they are tested inside the bucket, in blocks, by signature and then on full
   sets.  Pairs that a task already knows to be connected are skipped, and a pair
   is tested in the first band it shares only.
5. Components of all confirmed links.

With 32 bands of 4 a pair at similarity 0.75 misses every bucket with a chance of
5e-6.  ``SLACK`` below the threshold, over three standard deviations of the
signature's estimate there, lies the cut-off under which a pair isn't tested on
full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from .components import components
from .sketch import MinHash, shingles, words
from .storage import durable, release

ROWS, BANDS = 4, 32
SLACK = 0.13
#: Members of a bucket that one task compares with as many others at a time.
BLOCK = 2048


def _node(tokens: list[bytes]) -> int:
    """64 bits of a word sequence: documents with equal ones are one node."""
    return xxhash.xxh3_64_intdigest(b" ".join(tokens)) - 2**63


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """(doc, n_shingles, id, sig, tiny) of every row; ``id`` is the node, null for a text without words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = MinHash(ROWS * BANDS)
        for pdf in batches:
            n, node, sig, tiny = [], [], [], []
            for text in pdf["text"]:
                tokens = words(text)
                s = shingles(tokens, k)
                n.append(len(s))
                if len(s):
                    low = hashes(s)
                    node.append(_node(tokens))
                    sig.append(low.astype("<u4").tobytes())
                    tiny.append((low & 0xFF).astype(np.uint8).tobytes())
                else:
                    node.append(None), sig.append(None), tiny.append(None)
            yield pd.DataFrame(
                {"doc": pdf["doc"], "n_shingles": np.array(n, np.int64), "id": pd.array(node, "Int64"), "sig": sig, "tiny": tiny}
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc long, n_shingles long, id long, sig binary, tiny binary")


def shingle_sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, hashes) of the nodes (id, rep), read from their documents ``rep``: sorted distinct shingle hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            every = [words(t) for t in pdf["text"]]
            ids = np.array([_node(w) if w else 0 for w in every], np.int64)
            mine = ids == pdf["id"].to_numpy()  # another text under the same document id
            yield pd.DataFrame({"id": ids[mine], "hashes": [shingles(w, k).tobytes() for w, m in zip(every, mine, strict=True) if m]})

    rows = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text")).join(nodes.select("id", "rep"), "rep")
    return rows.select("id", "text").mapInPandas(run, "id long, hashes binary").dropDuplicates(["id"])


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, exactly."""
    small, big = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(big):
        return False
    at = np.searchsorted(big, small)
    at[at == len(big)] = 0
    both = int((big[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that hold on full sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = [
                _similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                for x, y in zip(pdf["x"], pdf["y"], strict=True)
            ]
            yield pdf.loc[keep, ["a", "b"]]

    full = pairs.join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b").join(
        sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), "a"
    )
    return full.select("a", "b", "x", "y").mapInPandas(run, "a long, b long")


def _estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and signatures allow the threshold."""
    least = round((percent / 100 - SLACK) * ROWS * BANDS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.frombuffer(b"".join(pdf["x"]), np.uint8).reshape(len(pdf), -1)
                y = np.frombuffer(b"".join(pdf["y"]), np.uint8).reshape(len(pdf), -1)
                yield pdf.loc[(x == y).sum(axis=1) >= least, ["a", "b"]]

    x = nodes.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("tiny").alias("x"))
    y = nodes.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("tiny").alias("y"))
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return pairs.join(x, "a").join(y, "b").where(fits).select("a", "b", "x", "y").mapInPandas(run, "a long, b long")


def _across(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """New links between components in one bucket, or in one pair of its blocks."""
    least = round((percent / 100 - SLACK) * ROWS * BANDS)
    group = group.drop_duplicates("id")
    band, i, j = int(group["band"].iloc[0]), int(group["i"].iloc[0]), int(group["j"].iloc[0])
    ids, size, block = group["id"].to_numpy(), group["n_shingles"].to_numpy(), group["block"].to_numpy()
    sig = np.frombuffer(b"".join(group["sig"]), "<u4").reshape(len(ids), -1)
    tiny = sig.astype(np.uint8)
    sets = [np.frombuffer(x, np.uint64) for x in group["hashes"]]
    labels, comp = np.unique(group["comp"].to_numpy(), return_inverse=True)
    parent = np.arange(len(labels))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found = []
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    for at, s in enumerate(left):
        others = left[at + 1 :] if i == j else right
        others = others[comp[others] != comp[s]]
        fits = 100 * np.minimum(size[others], size[s]) >= percent * np.maximum(size[others], size[s])
        others = others[fits]
        same = tiny[others] == tiny[s]
        match = same.sum(axis=1)
        near = match >= least
        if near.any():
            others, match = others[near], match[near]
            # On full minima, as buckets are: single bytes of an earlier band may agree by chance.
            first = (sig[others] == sig[s]).reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band
            for o in others[first][np.argsort(-match[first], kind="stable")]:
                p, q = find(comp[s]), find(comp[o])
                if p != q and _similar(sets[s], sets[o], percent):
                    parent[max(p, q)] = min(p, q)
                    found.append((ids[s], ids[o]))
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def links(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """Links (a, b) between nodes that span the same components as all links do."""
    bands = nodes.select(
        "id", F.posexplode(F.array(*[F.substring("sig", 4 * ROWS * i + 1, 4 * ROWS) for i in range(BANDS)])).alias("band", "part")
    )
    bands = bands.select("id", "band", F.xxhash64("band", "part").alias("key"))
    hubs = bands.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last"), F.count("*").alias("members"))
    members = durable(bands.join(hubs.where("hub < last").select("key", "hub", "members"), "key"), "members")
    star = members.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    star = durable(_estimated(star, nodes, percent), "star")
    ends = star.select(F.col("a").alias("id")).unionByName(star.select(F.col("b").alias("id"))).distinct()
    sets = durable(shingle_sets(docs, nodes.join(ends, "id", "left_semi"), id_col, text_col, k), "sets")
    first = durable(_confirm(star, sets, percent), "links")
    release(star, sets)
    label = components(first)
    labelled = members.join(label.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "comp", F.coalesce("component", "id")
    )
    open_keys = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("members") / BLOCK)).cast("int")
    rest = durable(
        labelled.join(open_keys, "key", "left_semi").select(
            "key", "band", "id", "comp", blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block")
        ),
        "open",
    )
    sets = durable(shingle_sets(docs, nodes.join(rest, "id", "left_semi"), id_col, text_col, k), "sets")
    # A member goes to every pair of blocks that holds its own; small buckets have one block and one pair.
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")),
    )
    dealt = (
        rest.join(sets, "id")
        .join(nodes.select("id", "n_shingles", "sig"), "id")
        .withColumn("pair", F.explode(pairs))
        .select("key", "band", "id", "comp", "block", "pair.i", "pair.j", "n_shingles", "sig", "hashes")
    )
    more = durable(
        dealt.groupBy("key", "i", "j").applyInPandas(lambda g: _across(g, percent), "a long, b long"), "links"
    )
    release(members, rest, sets)
    return first.unionByName(more)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.75
) -> DataFrame:
    """One row per document: ``id_col``, n_shingles, component_id, kept.

    Text is lower-cased in A-Z and cut into words ``[^\\x20\\x09-\\x0D]+``; the set of a
    document holds its distinct ``k``-word shingles, or its whole word sequence if it
    has fewer words.  ``component_id`` is the smallest id reachable by links, ``kept``
    marks it.  Defined cases: a null, empty or blank text has no shingles, is linked
    with nothing and kept; repeated rows share a component; rows that share an id count
    as one document; a row with a null id never is the smallest one: it is kept only if
    no row with an id has its words, and is linked with no other text then.  Other columns are not touched or returned.
    """
    percent = round(threshold * 100)
    sk = durable(sketches(docs, id_col, text_col, k), "sketches")
    reps = sk.where("id is not null").groupBy("id").agg(F.min("doc").alias("rep"))
    keyed = durable(sk.select("doc", "n_shingles", "id").join(reps, "id", "left"), "keyed")
    # One sketch for each node: that of its smallest document.
    nodes = sk.withColumnRenamed("doc", "rep").join(reps, ["id", "rep"], "left_semi").dropDuplicates(["id"])
    nodes = durable(nodes, "nodes")
    release(sk)
    found = links(docs, nodes, id_col, text_col, k, percent)
    shared = keyed.where("doc is not null and id is not null").groupBy("doc").agg(F.min("id").alias("a"), F.max("id").alias("b"))
    texts = keyed.join(shared.where("a < b"), "doc").select("a", F.col("id").alias("b")).where("a < b")
    label = components(found.unionByName(texts)).withColumnRenamed("node", "id")
    grouped = keyed.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    smallest = grouped.where("component is not null").groupBy("component").agg(F.min("rep").alias("least"))
    out = grouped.join(smallest, "component", "left")
    component = F.coalesce("least", "doc")
    return out.select(
        F.col("doc").alias(id_col),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc") == component, component.isNull()).alias("kept"),
    )
