"""``lead`` over an ordered group without sending the group to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from disputelens.functions.semantics import asc, desc


def _sort(order: Sequence[tuple[str, str]]) -> list[Column]:
    return [asc(c) if d == "asc" else desc(c) for c, d in order]


def lead_in_order(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, str]], values: Sequence[str],
                  out: Sequence[str], segment: Column) -> DataFrame:
    """Add ``out[i] = lead(values[i]) over (partition by keys order by order)``, lazily.

    ``order`` is a list of (column, "asc" | "desc") with the dialect's NULL
    placement, total within a group (end it with a unique column). ``segment`` is
    a number that never falls along that order, such as the day of an ascending
    time; rows without one come last. A group is then worked on segment by
    segment, so an account with a third of all rows is as many tasks' work as it
    has days:

    1. lead within each (group, segment), with the segment's first values on its last row;
    2. the successor of a segment's last row is the first row of the group's next segment
       that has rows: a lead over the segments' last rows, which are all that is
       shuffled again. The other rows are complete.
    """
    sort = _sort(order)
    s = df.withColumn("_seg", F.coalesce(segment.cast("bigint"), F.lit(2**62)))
    within = Window.partitionBy(*keys, "_seg").orderBy(*sort)
    s = s.withColumn("_last", F.lead(F.lit(1)).over(within).isNull())
    for v, o in zip(values, out):
        s = s.withColumn(f"_lead_{o}", F.lead(F.col(v)).over(within)).withColumn(
            f"_head_{o}", F.first(F.col(v)).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    over = Window.partitionBy(*keys).orderBy("_seg")
    inner = s.where(~F.col("_last")).select(*df.columns, *[F.col(f"_lead_{o}").alias(o) for o in out])
    ends = s.where(F.col("_last")).select(*df.columns, *[F.lead(F.col(f"_head_{o}")).over(over).alias(o) for o in out])
    return inner.unionByName(ends)
