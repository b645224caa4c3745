"""Top-N groups per partition, used as labels, and a plain top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from disputelens.functions.semantics import asc, desc


def rank_groups(df: DataFrame, partition: Sequence[str], value: str, measure: str, n: Column | int,
                rank_col: str, most: int | None = None) -> DataFrame:
    """Groups (``partition``, ``value``) ranked per ``partition`` by sum of ``measure``.

    Largest sum first (a NULL sum first, as the source dialect orders DESC),
    ties broken by ``value``. A NULL ``value`` forms a group and takes a rank.
    Only ranks <= ``n`` are kept, so the result has at most n rows per
    partition value. Where ``n`` is a column, ``most`` is its largest value: a literal
    bound on the rank lets Spark cut each task's groups to that many before the
    shuffle (WindowGroupLimit).
    """
    sums = df.groupBy(*partition, value).agg(F.sum(measure).alias("_sum"))
    w = Window.partitionBy(*partition).orderBy(desc("_sum"), asc(value))
    bound = F.lit(True) if most is None else F.col(rank_col) <= F.lit(most)
    return sums.withColumn(rank_col, F.row_number().over(w)).filter(bound & (F.col(rank_col) <= n)).drop("_sum")


def top_label(rank: Column | str, value: Column | str, n: int) -> Column:
    """'<rank>.<value>' when ranked within ``n``, else '99.others' (NULL value -> NULL)."""
    r = F.col(rank) if isinstance(rank, str) else rank
    v = F.col(value) if isinstance(value, str) else value
    return F.when(r <= n, F.concat(r.cast("string"), F.lit("."), v.cast("string"))).otherwise(F.lit("99.others"))


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows by ``order``; planned as TakeOrderedAndProject (no full sort)."""
    return df.orderBy(*order).limit(k)
