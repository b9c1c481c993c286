"""Quality rules: per-text counts and cross-document line frequency, all as Spark expressions.

A line is normalised (lower-cased, digits as 0, runs of other characters than
letters and digits as one space) and hashed.  For every host the number of distinct
documents that hold the line is counted.  Copies must not make a clean line look like
boilerplate, so documents are told apart by a hash of all their distinct normalised
lines: copies that differ in case, digits, punctuation, blank lines or the order of lines
count as one, and what other lines are shared plays no part.  A near copy with another line
is a document of its own.  Lines above both limits are removed, and a document left with too
little of its words is rejected.

Texts are read once: counts and hashed lines of every document go into a narrow table, from
which frequencies, removals and verdicts are made.  So a filter on a verdict meets plain columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .storage import durable

#: Fixed values of the base rules: least words, and most per cent of words in repeated windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Limits of the line rule: distinct documents of a host, the same as a share of the host's
#: documents, what that share may come to at most, and the least share of words that must be left.
MAX_DOCS, MAX_SHARE, MAX_SHARED, MIN_LEFT = 20, 0.02, 200, 0.3
#: Most frequent lines (about 50 bytes each) that are broadcast.
FEW = 500_000
#: White space between words, the same as a class, and the class of counted symbols.
_BLANK, _SPACE, _SYMBOL = "\t\n\x0b\f\r ", "[\\x20\\x09-\\x0D]", "[#*$%&|<>]"
_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def tokens(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order."""
    return F.array_remove(F.split(text, _SPACE), "")


def _neighbour(array: str, i: Column, same) -> Column:
    """Whether the element before or after place ``i`` is the ``same``."""
    return F.coalesce(same(F.get(array, i - 1)), F.lit(False)) | F.coalesce(same(F.get(array, i + 1)), F.lit(False))


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed; a null text counts as empty.

    Repeated 3-word windows: a window is a 64-bit hash.  Sorted with their places as single longs (half of
    the hash, then the place), equal halves are neighbours; these candidates, few or none, are sorted
    once more by the whole hash, where equal neighbours are repeats.  Their places, in order, cover three
    words each, less the overlap.  That is n log n for a text of n words, whatever its length.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    full = F.filter(F.split(text, "\n"), lambda x: F.ltrim(x, F.lit(_BLANK)) != "")
    out = docs.withColumns({"_pieces": F.split(text, _SPACE), "_full": full})
    out = out.withColumns(
        {
            "n_dup_lines": (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"),
            "word_chars": (F.length(text) - F.size("_pieces") + 1).cast("long"),
            "n_symbols": (F.size(F.split(text, _SYMBOL)) - 1).cast("long"),
            "_words": F.array_remove("_pieces", ""),
        }
    ).drop("_pieces", "_full")
    out = out.withColumns({"_n": F.size("_words"), "_h": F.transform("_words", lambda w: F.xxhash64(w))}).drop("_words")
    out = out.withColumn(
        "_win",
        F.transform(
            F.slice("_h", 1, F.greatest(F.col("_n") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("_h", i + 1), F.get("_h", i + 2))
        ),
    ).drop("_h")
    packed = F.transform("_win", lambda x, i: x.bitwiseAND(-(1 << 32)).bitwiseOR(i.cast("long")))
    out = out.withColumn("_by", F.when(F.size(F.array_distinct("_win")) < F.size("_win"), F.sort_array(packed)))
    half = lambda x: F.shiftright(x, 32)
    place = lambda x: x.bitwiseAND((1 << 32) - 1).cast("int")
    close = F.filter("_by", lambda x, i: _neighbour("_by", i, lambda y: half(x) == half(y)))
    whole = F.transform(close, lambda x: F.struct(F.get("_win", place(x)).alias("h"), place(x).alias("p")))
    out = out.withColumn("_by", F.sort_array(whole)).drop("_win")
    repeated = F.filter("_by", lambda x, i: _neighbour("_by", i, lambda y: x["h"] == y["h"]))
    out = out.withColumn("_at", F.sort_array(F.transform(repeated, lambda x: x["p"]))).drop("_by")
    steps = F.transform("_at", lambda p, i: F.coalesce(F.least(F.lit(3), p - F.get("_at", i - 1)), F.lit(3)))
    out = out.withColumns(
        {
            "n_words": F.col("_n").cast("long"),
            "n_repeat_words": F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"),
        }
    ).drop("_n", "_at")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _hashed_lines(text: Column) -> Column:
    """(line, at, words) of the lines that hold a letter or digit: hash of the normal form, place from 0, words."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "[1-9]", "0"), "[^\\p{L}\\p{N}\\n]+", " ")
    each = F.zip_with(F.split(plain, "\n"), F.split(text, "\n"), lambda x, raw: F.struct(F.trim(x).alias("x"), raw.alias("raw")))
    hashed = F.transform(
        each,
        lambda x, i: F.when(
            x["x"] != "", F.struct(F.xxhash64(x["x"]).alias("line"), i.alias("at"), F.size(tokens(x["raw"])).alias("words"))
        ),
    )
    return F.array_compact(hashed)


def _rows(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """id, host, text and a hash of them; other columns are left behind."""
    host = F.coalesce(_column(host_col).cast("string"), F.lit(""))
    rows = docs.select(_column(id_col).alias("id"), host.alias("host"), _column(text_col).alias("text"))
    return rows.withColumn("key", F.xxhash64("id", "text", "host"))


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def frequent_lines(
    rows: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, max_shared: int = MAX_SHARED
) -> DataFrame:
    """(host, line) of the lines whose distinct documents at the host exceed both limits.

    ``rows`` has host, doc (what tells documents apart) and lines.  Counts are combined before the shuffle, so a host
    or line that a third of all rows hold costs a row for each task.
    """
    each = rows.select("host", "doc", F.explode(F.array_distinct("lines.line")).alias("line"))
    seen = each.distinct().groupBy("host", "line").count().where(F.col("count") > max_docs)
    hosts = rows.groupBy("host").agg(F.least(F.count("*") * max_share, F.lit(max_shared)).alias("limit"))
    return seen.join(hosts, "host").where(F.col("count") > F.col("limit")).select("host", "line")


def _judged(docs: DataFrame, id_col: str, text_col: str, host_col: str, limits: tuple, min_left: float) -> DataFrame:
    """id, key, counts, words_removed, lines_removed (their places) and kept of every row."""
    counted = with_counts(_rows(docs, id_col, text_col, host_col)).withColumn("lines", _hashed_lines(F.coalesce("text", F.lit(""))))
    doc = F.xxhash64(F.sort_array(F.array_distinct("lines.line")))
    rows = durable(counted.select("id", "key", "host", *_BASE, doc.alias("doc"), "lines"), "counted")
    frequent = durable(frequent_lines(rows, *limits), "frequent")
    # Few, by count, go to the lines; else both meet by host and line.
    few = frequent.count() <= FEW
    hits = rows.select("id", "key", "host", F.inline("lines")).join(F.broadcast(frequent) if few else frequent, ["host", "line"])
    removed = hits.groupBy(F.col("id").alias("_id"), F.col("key").alias("_key")).agg(F.collect_set(F.struct("at", "words")).alias("gone"))
    out = rows.join(removed, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    gone = F.coalesce(F.aggregate("gone", F.lit(0), lambda a, x: a + x["words"]), F.lit(0)).cast("long")
    out = out.select("id", "key", *_BASE, gone.alias("words_removed"), F.col("gone.at").alias("lines_removed"))
    left = F.col("n_words") - F.col("words_removed") >= min_left * F.col("n_words")
    return out.withColumn("kept", ~F.col("base_failed") & left)


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_docs: int = MAX_DOCS,
    max_share: float = MAX_SHARE,
    max_shared: int = MAX_SHARED,
    min_left: float = MIN_LEFT,
) -> DataFrame:
    """Every row's id, counts, base_failed, words_removed and kept.

    A line is frequent if more than ``max_docs`` distinct documents of the host hold it, and more than a ``max_share`` of the
    host's documents, which counts as ``max_shared`` at most.  ``kept`` is false if the base rules fail or if less than
    ``min_left`` of the words are left without frequent lines.  Defined cases: a null text counts as empty (no words, base
    fails); a null host is a host of its own, the empty one; repeated rows get equal results; an empty table gives
    an empty result; columns beyond the three named ones play no part, whatever their names.
    """
    judged = _judged(docs, id_col, text_col, host_col, (max_docs, max_share, max_shared), min_left)
    return judged.select(F.col("id").alias(id_col), *_BASE, "words_removed", "kept")


def quality_filter(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_docs: int = MAX_DOCS,
    max_share: float = MAX_SHARE,
    max_shared: int = MAX_SHARED,
    min_left: float = MIN_LEFT,
) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_rules` keeps, with their frequent lines taken out of the text.

    Columns are those of ``docs``.  Defined cases as there; repeated rows stay repeated.
    """
    judged = _judged(docs, id_col, text_col, host_col, (max_docs, max_share, max_shared), min_left)
    kept = judged.where("kept").select(F.col("id").alias("_id"), F.col("key").alias("_key"), "lines_removed").dropDuplicates(["_id", "_key"])
    host = F.coalesce(_column(host_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.struct(*[_column(c) for c in docs.columns]).alias("row"),
        _column(id_col).alias("id"),
        F.xxhash64(_column(id_col), _column(text_col), host).alias("key"),
    )
    both = rows.join(kept, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")))
    lines = F.split(F.col("row")[text_col], "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("lines_removed"))
    rest = both.withColumn("_lines", F.when(F.col("lines_removed").isNotNull(), lines)).withColumn(
        "_rest", F.when(F.col("lines_removed").isNotNull(), F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n"))
    )
    each = [
        F.coalesce("_rest", F.col("row")[c]).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns
    ]
    return rest.select(*each)
