"""Similarity of two texts, cheapest test first.

Spark's bounded Levenshtein brackets the optimal string alignment distance d
(a swap costs 1 instead of 2): d <= Levenshtein <= 2 d. At most k accepts, above
2 k rejects, and only the pairs between go to an Arrow UDF.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from brindle.functions import plain


@F.pandas_udf(IntegerType())
def _osa(left: pd.Series, right: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else plain.osa(a, b, int(k)) for a, b, k in zip(left, right, most, strict=True)], dtype="Int32")


def word_set(value: Column) -> Column:
    return F.array_distinct(F.filter(F.split(value, r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def token_containment(left: Column, right: Column) -> Column:
    """Shared words over the smaller set of words; 0 if one has none."""
    a, b = word_set(left), word_set(right)
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def osa_within(left: Column, right: Column, most: Column) -> Column:
    """Whether the optimal string alignment distance is at most ``most``."""
    double = most * 2
    near = F.levenshtein(left, right)
    gap = (near > most) & (near <= double)
    exact = _osa(F.when(gap, left), F.when(gap, right), F.when(gap, most).cast("int"))
    return (near <= most) | (gap & F.coalesce(exact <= most, F.lit(False)))


def similar(left: Column, right: Column, threshold: float) -> Column:
    """Equal, or of like length and either sharing most words or within an edit bound."""
    n, m = F.length(left), F.length(right)
    short, long_ = F.least(n, m), F.greatest(n, m)
    ratio, t = short / long_, F.lit(float(threshold))
    most = F.floor((F.lit(1.0) - t) * long_).cast("int")
    # NULLs keep pairs that are settled already from the edit distance.
    open_ = (left != right) & (ratio >= t) & ~((token_containment(left, right) >= t) & (short >= 4))
    edits = osa_within(F.when(open_, left), F.when(open_, right), most)
    return (left == right) | ((ratio >= 0.6) & (short >= 4) & (token_containment(left, right) >= t)) | F.coalesce(edits, F.lit(False))
