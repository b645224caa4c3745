"""Keep-first deduplication (the ``QUALIFY row_number() ... = 1`` idiom)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column],
               rn: str = "_rn") -> DataFrame:
    """One row per ``keys``: the first by ``order``.

    ``order`` should end with a unique tie-breaker so the kept row is
    deterministic. Catalyst plans ``row_number() = 1`` as a WindowGroupLimit
    that keeps one row per key *before* the shuffle as well as after, so a hot
    key is reduced map-side instead of being shipped whole to one task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rn, F.row_number().over(w)).filter(F.col(rn) == 1).drop(rn)


def uniqueness_check(df: DataFrame, key: str) -> DataFrame:
    """One row: total rows and distinct values of ``key`` (equal after a dedup)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.col(key)).alias("n_keys"))
