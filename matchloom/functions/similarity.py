"""Similarities of strings, token sets and vectors as Spark columns.

The set forms differ in what empty sides mean; ``both`` is the value for two empty sets.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import tokens


def flag(x: Column) -> Column:
    """1.0 where true, else 0.0."""
    return F.when(x, 1.0).otherwise(0.0)


def common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def _guarded(a: Column, b: Column, value: Column, both: float) -> Column:
    a0, b0 = F.size(a) == 0, F.size(b) == 0
    return F.when(a0 & b0, float(both)).when(a0 | b0, 0.0).otherwise(value)


def jaccard(a: Column, b: Column, both: float = 1.0) -> Column:
    return _guarded(a, b, common(a, b) / F.size(F.array_union(a, b)), both)


def overlap(a: Column, b: Column, both: float = 0.0) -> Column:
    """Common members by the smaller set."""
    return _guarded(a, b, common(a, b) / F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))), both)


def dice(a: Column, b: Column, both: float = 1.0) -> Column:
    return _guarded(a, b, 2 * common(a, b) / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))), both)


def set_cosine(a: Column, b: Column, both: float = 1.0) -> Column:
    sizes = F.size(F.array_distinct(a)) * F.size(F.array_distinct(b))
    return _guarded(a, b, common(a, b) / F.sqrt(sizes.cast("double")), both)


def share_of_larger(a: Column, b: Column) -> Column:
    """Common members by the larger set."""
    return common(a, b) / F.greatest(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)), F.lit(1))


def longest(a: Column, b: Column) -> Column:
    return F.greatest(F.length(a), F.length(b))


def edit_capped(a: Column, b: Column, cap: int) -> Column:
    """Edit distance of the first ``cap`` characters."""
    return F.levenshtein(F.left(a, F.lit(cap)), F.left(b, F.lit(cap)))


def edit_share(a: Column, b: Column, cap: int | None = None) -> Column:
    """Edit distance by the longer length; 0 for two empty texts."""
    distance = F.levenshtein(a, b) if cap is None else edit_capped(a, b, cap)
    return F.when(longest(a, b) == 0, 0.0).otherwise(distance / F.greatest(longest(a, b), F.lit(1)))


def edit_similarity(a: Column, b: Column) -> Column:
    return 1.0 - edit_share(a, b)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix."""
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(0), n), lambda i: F.left(a, i) == F.left(b, i))
    return F.array_max(same)


def numbers(x: Column) -> Column:
    """Runs of digits, in order."""
    return F.regexp_extract_all(x, F.lit("\\d+"), F.lit(0))


def conflicting(a: Column, b: Column) -> Column:
    """1 if both have members and none is common."""
    return flag((F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b))


def postal(x: Column) -> Column:
    """The first number of five or six digits, or null."""
    return F.nullif(F.regexp_extract(x, "\\b\\d{5,6}\\b", 0), F.lit(""))


def postal_match(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), 0.5).otherwise(flag(a == b))


def first_match(a: Column, b: Column, at: int = 1) -> Column:
    """1 if both have a member at the end given by ``at`` (1 or -1) and they are equal."""
    return flag((F.size(a) > 0) & (F.size(b) > 0) & (F.try_element_at(a, F.lit(at)) == F.try_element_at(b, F.lit(at))))


def initials(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.left(w, F.lit(1))), "")


def initialism(a: Column, b: Column, wa: Column, wb: Column) -> Column:
    """1 if one text of 2 to 8 characters begins the initials of the other's words."""

    def one(short: Column, words: Column) -> Column:
        n = F.length(short)
        return n.between(2, 8) & (F.size(words) >= n) & F.lower(initials(words)).startswith(F.lower(short))

    return flag(one(a, wb) | one(b, wa))


def matches(x: Column, words: str) -> Column:
    return flag(x.rlike(f"(?i)\\b({words})\\b"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def vector_cosine(a: Column, b: Column) -> Column:
    """0 for a null or zero vector."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(norms > 0, dot(a, b) / norms), F.lit(0.0))


def vector_l2(a: Column, b: Column) -> Column:
    """0 for a null vector."""
    d = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.coalesce(F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x)), F.lit(0.0))


def l2_normalized(a: Column) -> Column:
    norm = F.sqrt(dot(a, a)) + 1e-8
    return F.transform(a, lambda x: x.cast("double") / norm)


def mean_pooled(tokens: Column, mask: Column) -> Column:
    """The mean of the vectors of an array that a 0/1 mask marks; zeros where it marks none."""
    marks = F.transform(mask, lambda m: m.cast("double"))
    total = F.greatest(F.aggregate(marks, F.lit(0.0), lambda s, m: s + m), F.lit(1e-9))
    part = lambda i: F.zip_with(tokens, marks, lambda t, m: t[i].cast("double") * m)
    dims = F.sequence(F.lit(0), F.size(tokens[0]) - 1)
    return F.transform(dims, lambda i: F.aggregate(part(i), F.lit(0.0), lambda s, x: s + x) / total)


def vowel_share(x: Column) -> Column:
    return (F.length(x) - F.length(F.translate(x, "aeiou", ""))) / F.greatest(F.length(x), F.lit(1))


def char_set(x: Column) -> Column:
    return F.array_distinct(F.filter(F.split(x, ""), lambda c: c != ""))


def f_beta(precision: Column, recall: Column, beta: float = 0.5) -> Column:
    """0 where both are 0."""
    b = beta * beta
    return F.when(precision + recall > 0, (1 + b) * precision * recall / (b * precision + recall)).otherwise(0.0)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column, eps: float = 1e-7) -> Column:
    clipped = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return F.log(clipped / (1 - clipped))


def sorted_words(x: Column) -> Column:
    return F.array_join(F.array_sort(tokens(x)), " ")
