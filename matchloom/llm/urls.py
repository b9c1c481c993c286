"""URL filtering: a blocked Bloom filter before an exact hash join, all as Spark expressions.

Listed entries are canonical URLs without scheme: host, then a path or its beginning.
Entries that end the matter for a whole subtree are rules (allow or block); the
others name single pages.  A page makes one key for every host suffix and every length
that a listed path has, so its probes are equalities.  The filter is a table of blocks
of eight 32-bit lanes with one bit set in each, made by an aggregate; a probe meets
only its own block, and only keys that pass it reach the exact join, which removes the
false positives.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

LANES = 8
#: Bits of the filter for every listed entry: about one false positive in two thousand.
BITS = 24
_RULES = T.StructType([T.StructField(x, T.StringType()) for x in ("entry", "verdict")])


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; '' without ``://``."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to ``? #`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_suffixes(name: Column) -> Column:
    """The host and all its parent domains, longest first: a.b.c, b.c, c."""
    labels = F.split(name, "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def rules(spark: SparkSession, listed: Iterable[tuple[str, str]]) -> DataFrame:
    """A rule table from (entry, verdict) pairs; an entry is a host, a slash and the beginning of a path."""
    return spark.createDataFrame(list(listed), _RULES)


def _lane_bits(key: Column) -> list[Column]:
    h = F.xxhash64(F.lit(7), key)
    return [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(h, 5 * i).bitwiseAND(31).cast("int")) for i in range(LANES)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def bloom(entries: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, l0 to l7): the filter of the column ``key``.  Its size is 36 bytes a block, whatever the data."""
    lanes = {f"l{i}": b for i, b in enumerate(_lane_bits(F.col(key)))}
    each = entries.select(_block(F.col(key), blocks).alias("block"), *[b.alias(n) for n, b in lanes.items()])
    return each.groupBy("block").agg(*[F.bit_or(n).alias(n) for n in lanes])


def passes(probes: DataFrame, key: str, made: DataFrame, blocks: int) -> DataFrame:
    """The probes that the filter can't rule out."""
    hit = F.lit(True)
    for i, bit in enumerate(_lane_bits(F.col(key))):
        hit = hit & (F.col(f"l{i}").bitwiseAND(bit) == bit)
    joined = probes.withColumn("block", _block(F.col(key), blocks)).join(made, "block")
    return joined.where(hit).select(*probes.columns)


def judge(
    pages: DataFrame,
    listed: DataFrame,
    url_col: str = "url",
    page_list: DataFrame | None = None,
    default: str = "allow",
) -> DataFrame:
    """Adds host, path, rule, rule_verdict and verdict to every row.

    ``listed`` has (entry, verdict).  A rule fits its host and all subdomains if the path
    starts with the rule's; the longest entry wins, and of equal ones a block.
    ``page_list`` has (url): single pages, as canonical host and path; a page that no rule
    fits is blocked if it is listed, else gets ``default``.  Defined cases: a null url or
    one without ``://`` has an empty host and path and fits no rule; repeated rows and hot
    hosts cost nothing more, as distinct (host, path) pairs are judged once; an empty table or list is
    fine; columns of other names stay, columns of the added names are replaced.
    """
    added = ("host", "path", "rule", "rule_verdict", "verdict")
    rows = pages.drop(*[c for c in added if c != url_col and c in pages.columns])
    keyed = rows.withColumns({"_host": host(F.col(url_col)), "_path": path(F.col(url_col))})
    places = keyed.select(F.col("_host").alias("host"), F.col("_path").alias("path")).where("host <> ''").distinct()

    cut = F.instr("entry", "/")
    entries = listed.where("entry is not null").groupBy("entry").agg(F.max("verdict").alias("kind"))
    lengths = entries.agg(
        F.count("*").alias("n"), F.collect_set(F.length("entry") - cut).alias("after")
    ).first()  # distinct lengths of listed paths: bounded by the longest one
    blocks = max(1, lengths["n"] * BITS // (32 * LANES))
    after = F.array(*[F.lit(int(x)) for x in sorted(lengths["after"])]) if lengths["after"] else F.array().cast("array<int>")
    fitting = F.filter(after, lambda n: n < F.length("path"))
    keys = F.flatten(
        F.transform(
            host_suffixes(F.col("host")),
            lambda h: F.transform(fitting, lambda n: F.concat(h, F.substring("path", F.lit(1), n + 1))),
        )
    )
    probes = places.select("host", "path", F.explode(F.array_distinct(keys)).alias("entry"))
    possible = passes(probes, "entry", bloom(entries, "entry", blocks), blocks)
    exact = possible.join(entries, "entry")
    best = exact.groupBy("host", "path").agg(
        F.max_by(F.struct("entry", "kind"), F.struct(F.length("entry"), "kind")).alias("best")
    ).select("host", "path", "best.entry", "best.kind")
    judged = places.join(best, ["host", "path"], "left")
    if page_list is not None:
        single = page_list.where("url is not null").select(F.col("url").alias("at")).distinct()
        size = max(1, single.count() * BITS // (32 * LANES))
        open_ = judged.where("entry is null").select("host", "path", F.concat("host", "path").alias("at"))
        named = passes(open_, "at", bloom(single, "at", size), size).join(single, "at", "left_semi")
        judged = judged.join(named.select("host", "path", F.lit(True).alias("named")), ["host", "path"], "left")
    else:
        judged = judged.withColumn("named", F.lit(None).cast("boolean"))
    judged = judged.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "entry", "kind", "named")
    out = keyed.join(judged, ["_host", "_path"], "left")
    own = F.when(F.col("named"), F.lit("block")).otherwise(F.lit(default))
    kept = [c for c in rows.columns]
    return out.select(
        *kept,
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("entry").alias("rule"),
        F.col("kind").alias("rule_verdict"),
        F.coalesce("kind", own).alias("verdict"),
    )
