"""A global order from split points that are known beforehand.

``DataFrame.orderBy`` finds its ranges by running the last stage of its input once for a
sample and again for the sort. Where the input is dear and its keys' spread is known
from stored tables, the points come from a sample of those, and the input runs once.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sampled rows per range; the sample is all that reaches the driver.
ROWS_PER_RANGE = 100
#: Most rows that a sample is made for, however many ranges are asked for.
SAMPLE_ROWS = 1_000_000


def split_points(rows: DataFrame, total: int, ranges: int, seed: int = 0,
                 cut: Callable[[DataFrame], DataFrame] | None = None) -> list[tuple]:
    """At most ``ranges`` - 1 distinct ascending points that cut ``rows`` (its columns are the keys, none
    NULL) into about equal ranges.

    ``total`` is about the number of rows that ``rows`` has been cut from, such as the stored
    tables' count. About ``ROWS_PER_RANGE`` * ``ranges`` of them, at most ``SAMPLE_ROWS``, are
    sampled; where ``rows`` is a small part of them, there are fewer points. A ``cut`` that takes a
    join is made in the sample, so that no more rows than that are shuffled for it.
    """
    wanted = min(ROWS_PER_RANGE * ranges, SAMPLE_ROWS)
    found = rows if total <= wanted else rows.sample(fraction=wanted / total, seed=seed)
    found = cut(found) if cut else found
    keys = sorted(tuple(r) for r in found.collect())
    ranges = min(ranges, len(keys) * ranges // wanted + 1)
    cuts = [keys[i * len(keys) // ranges] for i in range(1, ranges)]
    return sorted(set(cuts))


def range_number(keys: Sequence[Column], types: Sequence[str], points: Sequence[tuple]) -> Column:
    """How many of the ascending ``points`` are not above the ``keys`` (none NULL): a binary search
    in an array constant, by halving steps."""
    if not points:
        return F.lit(0)
    schema = ", ".join(f"k{i}: {t}" for i, t in enumerate(types))
    rows = [{f"k{i}": v if isinstance(v, int) else str(v) for i, v in enumerate(p)} for p in points]
    table = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    key = F.struct(*[k.cast(t).alias(f"k{i}") for i, (k, t) in enumerate(zip(keys, types))])
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(points).bit_length()))])
    # beyond the last point get() is NULL, and the step isn't taken
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        key >= F.get(table, at + step - 1), at + step).otherwise(at))


def order_by_points(df: DataFrame, keys: Sequence[Column], types: Sequence[str], points: Sequence[tuple],
                    order: Sequence[Column], only: DataFrame | None = None) -> DataFrame:
    """``df`` in the global order ``order``, whose leading part are ``keys``: one shuffle to the range of
    each row, then a sort inside. Rows of equal keys share a range.

    ``only`` cuts ``df`` to the whole numbers in its one column, which has the name of the first key's column
    in ``df`` (a semi-join; NULL is in nothing). Each number goes as a mark to the ranges that its rows may lie in,
    with the same shuffle, and a row stays if its range has a mark of its number. There are as many marks as numbers
    and points at most, so a hot number is no matter.
    """
    n = len(points) + 1
    placed = df.withColumn("_range", range_number(keys, types, points))
    if only is not None:
        (key,) = only.columns
        number = lambda found: range_number([F.col(key)], types[:1], found)
        # points below a number, and those not above it
        below, upto = [(p[0] + 1,) for p in points if p[0] < 2**63 - 1], [p[:1] for p in points]
        marks = only.select(key, F.explode(F.sequence(number(below), number(upto))).alias("_range"),
                            F.lit(True).alias("_mark"))
        placed = placed.unionByName(marks, allowMissingColumns=True)
    placed = placed.repartitionById(n, F.col("_range"))
    if only is not None:
        first = (Window.partitionBy("_range", key).orderBy(F.col("_mark").desc_nulls_last(), *order)
                 .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        placed = placed.withColumn("_in", F.max("_mark").over(first)).where(F.col("_in") & F.col("_mark").isNull())
        placed = placed.drop("_in", "_mark")
    return placed.sortWithinPartitions(*order).drop("_range")
