"""Arrow-batched functions for the kernels, and their registration for SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from . import kernels


def _pairwise(kernel, returns: T.DataType):
    """A two-column function; null counts as empty, and equal pairs in a batch are computed once."""

    @pandas_udf(returns)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for x, y in zip(a.fillna(""), b.fillna(""), strict=True):
            if (x, y) not in known:
                known[x, y] = kernel(x, y)
            out.append(known[x, y])
        return pd.Series(out)

    return run


def _single(kernel):
    @pandas_udf(T.StringType())
    def run(a: pd.Series) -> pd.Series:
        return pd.Series([kernel(x) for x in a.fillna("")], dtype=object)

    return run


jaro_winkler = _pairwise(kernels.jaro_winkler, T.DoubleType())
jaro_winkler_shown = _pairwise(lambda a, b: f"{kernels.jaro_winkler(a, b):.2f}", T.StringType())
indel_ratio = _pairwise(kernels.indel, T.DoubleType())
token_sort_ratio = _pairwise(kernels.token_sort, T.DoubleType())
partial_ratio = _pairwise(kernels.partial, T.DoubleType())
lcs_substring = _pairwise(kernels.substring, T.IntegerType())
lcs_subsequence = _pairwise(kernels.subsequence, T.IntegerType())
metaphone = _single(kernels.metaphone)
ascii_fold_exact = _single(kernels.ascii_fold)
spelled_numbers = _single(kernels.spelled_numbers)


def register(spark: SparkSession) -> None:
    """Makes the functions callable from SQL under their names."""
    for name in (
        "jaro_winkler", "indel_ratio", "token_sort_ratio", "partial_ratio", "lcs_substring", "lcs_subsequence", "metaphone", "ascii_fold_exact", "spelled_numbers",
    ):
        spark.udf.register(name, globals()[name])
