"""Join shapes the analyses need beyond a plain equi join.

Every shape here keeps an equality on a high-cardinality key so Spark can plan
a hash or sort-merge join; none falls back to a nested loop or a cartesian
product. ``interval_join`` and ``range_lookup`` compare the pairs of a key that
lie in the same or neighbouring time buckets; where only a maximum or the nearest
event is wanted, ``running_max_within`` and ``nearest_within`` form no pairs at all.

Callers give both sides distinct column names; conditions use names only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from disputelens.functions.semantics import epoch_seconds

Keys = Sequence[tuple[str, str]]


def _eq(keys: Keys) -> list[Column]:
    return [F.col(lk) == F.col(rk) for lk, rk in keys]


def _epoch(c: Column) -> Column:
    return epoch_seconds(c)


def interval_join(left: DataFrame, right: DataFrame, keys: Keys, left_ts: str,
                  right_lo: Column, right_hi: Column, *, lo_inclusive: bool, hi_inclusive: bool,
                  bucket_seconds: int, how: str = "left") -> DataFrame:
    """``left`` ⟕ ``right`` on ``keys`` and ``right_lo <(=) left_ts <(=) right_hi``.

    The time range becomes an extra equi key: each right row is copied into
    every ``bucket_seconds`` bucket its range touches (2 for a range no wider
    than a bucket) and each left row falls into exactly one bucket. A pair
    therefore meets at most once, the left-outer semantics stay exact, and only
    pairs in neighbouring buckets are compared, however many rows share a key.
    """
    b = bucket_seconds
    r = (right.withColumn("_lo", right_lo).withColumn("_hi", right_hi)
         .withColumn("_rb", F.explode(F.sequence(F.floor(_epoch(F.col("_lo")) / F.lit(b)),
                                                 F.floor(_epoch(F.col("_hi")) / F.lit(b))))))
    l = left.withColumn("_lb", F.floor(_epoch(F.col(left_ts)) / b))
    t = F.col(left_ts)
    lo_ok = t >= F.col("_lo") if lo_inclusive else t > F.col("_lo")
    hi_ok = t <= F.col("_hi") if hi_inclusive else t < F.col("_hi")
    cond = _eq(keys) + [F.col("_lb") == F.col("_rb"), lo_ok, hi_ok]
    out = l.join(r, _and(cond), how)
    return out.drop("_lb", "_rb", "_lo", "_hi")


def range_lookup(left: DataFrame, right: DataFrame, keys: Keys, right_ts: str,
                 left_lo: Column, left_hi: Column, *, lo_inclusive: bool, hi_inclusive: bool,
                 bucket_seconds: int) -> DataFrame:
    """``left`` ⟕ ``right`` on ``keys`` and ``left_lo <(=) right_ts <(=) left_hi``.

    The mirror of ``interval_join``: here the *left* row is copied into each
    bucket its range touches, which pays off when the left side is the small
    one (a few weeks of transactions against years of alerts). A left row comes
    out once per touched bucket, matched or not, so use it only under an
    aggregation per left row that ignores NULLs and repeats (max, min).
    """
    b = bucket_seconds
    l = (left.withColumn("_lo", left_lo).withColumn("_hi", left_hi)
         .withColumn("_lb", F.explode(F.sequence(F.floor(_epoch(F.col("_lo")) / F.lit(b)),
                                                 F.floor(_epoch(F.col("_hi")) / F.lit(b))))))
    r = right.withColumn("_rb", F.floor(_epoch(F.col(right_ts)) / b))
    t = F.col(right_ts)
    lo_ok = t >= F.col("_lo") if lo_inclusive else t > F.col("_lo")
    hi_ok = t <= F.col("_hi") if hi_inclusive else t < F.col("_hi")
    out = l.join(r, _and(_eq(keys) + [F.col("_lb") == F.col("_rb"), lo_ok, hi_ok]), "left")
    return out.drop("_lb", "_rb", "_lo", "_hi")


def either_key_join(left: DataFrame, right: DataFrame, keys: Keys, left_codes: Sequence[str],
                    right_code: str, *, collapse: bool = True) -> DataFrame:
    """``left`` ⟕ ``right`` on ``keys`` and (``right_code`` = any of ``left_codes``).

    The distinct non-NULL codes of each left row are exploded and joined on
    equality, so the OR never reaches the join condition. A left row whose
    codes all miss would then appear once per code; ``collapse`` removes those
    copies and drops the unmatched copies of a row that matched through another
    code. It numbers the left rows for that, so equal left rows each stay. Pass
    ``collapse=False`` only when a later keep-first over the same rows orders a
    match before a NULL match.
    """
    codes = F.array_distinct(F.filter(F.array(*[F.col(c) for c in left_codes]), lambda x: x.isNotNull()))
    l = left.withColumn("_row", F.monotonically_increasing_id()) if collapse else left
    l = l.withColumn("_code", F.explode_outer(codes))
    r = right.withColumn("_hit", F.lit(1))
    out = l.join(r, _and(_eq(keys) + [F.col("_code") == F.col(right_code)]), "left")
    if collapse:
        w = Window.partitionBy("_row")
        out = (out.withColumn("_any", F.max(F.coalesce(F.col("_hit"), F.lit(0))).over(w))
               .withColumn("_n", F.row_number().over(w.orderBy(F.col("_code").asc_nulls_last())))
               .filter(F.col("_hit").isNotNull() | ((F.col("_any") == 0) & (F.col("_n") == 1)))
               .drop("_any", "_n", "_row"))
    return out.drop("_code", "_hit")


def any_party_join(left: DataFrame, right: DataFrame, left_party: str, right_parties: Sequence[str],
                   keys: Keys, how: str = "left", cut: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """``left`` ⟕ ``right`` on ``keys`` and ``left_party`` = any of ``right_parties``.

    Each right row is exploded into its distinct non-NULL parties, so a pair
    meets at most once and the join is a plain equi join on (party, keys).
    ``cut`` may drop parties (rows, name of the party column) before the join.
    """
    parties = F.array_distinct(F.filter(F.array(*[F.col(c) for c in right_parties]), lambda x: x.isNotNull()))
    r = right.withColumn("_party", F.explode(parties))
    r = cut(r, "_party") if cut else r
    out = left.join(r, _and([F.col(left_party) == F.col("_party")] + _eq(keys)), how)
    return out.drop("_party")


def semi_join(df: DataFrame, keys_df: DataFrame, col: str, keys_col: str) -> DataFrame:
    """Rows of ``df`` whose ``col`` is in ``keys_df.keys_col`` (an IN subquery).

    No hint: the planner broadcasts the distinct keys if their measured size
    allows it, and shuffles both sides otherwise.
    """
    ks = keys_df.select(F.col(keys_col).alias("_k")).where(F.col("_k").isNotNull()).distinct()
    return df.join(ks, F.col(col) == F.col("_k"), "left_semi")


#: Bits of a rough set. It is a table of a row per 64 bits at most, 4 MB, whatever it holds.
ROUGH_BITS = 1 << 24


def _rough_place(c: Column) -> Column:
    return F.pmod(F.xxhash64(c.cast("bigint")), F.lit(ROUGH_BITS).cast("bigint"))


def _rough_bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % 64).cast("int"))


def rough_set(keys: DataFrame, col: str) -> DataFrame:
    """A bit for each of the whole numbers in ``col``, by their hash, in at most ``ROUGH_BITS`` / 64 rows."""
    place = _rough_place(F.col(col))
    return (keys.where(F.col(col).isNotNull())
            .groupBy(F.shiftright(place, 6).alias("_word")).agg(F.bit_or(_rough_bit(place)).alias("_bits")))


def in_rough_set(df: DataFrame, col: Column, rough: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``col`` may be in the ``rough_set``: all that are, and some that aren't.

    The set is bounded, so it is broadcast and no row of ``df`` is shuffled. A cut that is exact has to follow.
    """
    place = _rough_place(col)
    found = df.withColumn("_place", F.when(col.isNotNull(), place)).join(
        F.broadcast(rough), F.shiftright("_place", 6) == F.col("_word"))
    return found.where(F.col("_bits").bitwiseAND(_rough_bit(F.col("_place"))) != 0).drop("_place", "_word", "_bits")


def running_max_within(points: DataFrame, events: DataFrame, key: str, ts: str, value: str,
                       seconds: int, bucket_seconds: int = 3600, by: Sequence[str] | None = None) -> DataFrame:
    """(``by``, ``value``): for each distinct (key, ts) of ``points`` the largest
    ``value`` of the ``events`` with ts - ``seconds`` <= event ts <= ts (NULL without any).
    With ``by``, columns of ``points``, the largest over all points that agree in them.
    Points without a time are left out; a NULL key matches nothing.

    No pair of a point and an event is ever formed. The range is cut at bucket
    borders: whole buckets inside it need one maximum per bucket, and the two
    buckets at its ends a running maximum in time order. A point sends two marks, one
    to the bucket of each end, where the events are; the maximum of the whole
    buckets comes to the later end's bucket as a row before all times. So the events
    are shuffled once, and the points once as marks. ``seconds`` is a whole number of
    buckets, and both inputs name their columns alike. A hot key is spread over its buckets;
    the window over a key's buckets has one row per bucket.
    """
    by = list(by or (key, ts))
    n = seconds // bucket_seconds
    bucket = F.floor(_epoch(F.col("_at")) / F.lit(bucket_seconds))
    p = points.select(*dict.fromkeys([*by, key, ts])).where(F.col(ts).isNotNull()).distinct()
    e = (events.select(F.col(key).alias("_k"), F.col(ts).alias("_at"), F.col(value).alias("_v"))
         .where(F.col("_k").isNotNull() & F.col("_at").isNotNull() & F.col("_v").isNotNull()).withColumn("_b", bucket))
    none = F.lit(None).cast(e.schema["_v"].dataType)

    # whole buckets strictly between the two ends
    ends_here = (p.select(F.col(key).alias("_k"), F.col(ts).alias("_at")).withColumn("_b", bucket)
                 .select("_k", "_b", none.alias("_v"), F.lit(True).alias("_point")))
    cells = (e.select("_k", "_b", "_v", F.lit(False).alias("_point")).unionByName(ends_here)
             .groupBy("_k", "_b").agg(F.max("_v").alias("_v"), F.max("_point").alias("_point")))
    span = Window.partitionBy("_k").orderBy("_b").rangeBetween(-(n - 1), -1)
    middle = (cells.withColumn("_v", F.max("_v").over(span))
              .where(F.col("_point") & F.col("_v").isNotNull()).select("_k", "_b", "_v"))

    # the two ends
    ends = F.array(F.struct(F.lit(True).alias("_late"), F.col(ts).alias("_at")),
                   F.struct(F.lit(False).alias("_late"),
                            F.timestamp_add("SECOND", F.lit(-seconds), F.col(ts)).alias("_at")))
    marks = (p.select(F.col(key).alias("_k"), F.struct(*by).alias("_of"), F.inline(ends))
             .withColumn("_b", bucket).withColumn("_v", none))
    rows = (marks.unionByName(e, allowMissingColumns=True).unionByName(middle, allowMissingColumns=True))
    # both frames grow from the first row, so each window takes one pass
    upto = Window.partitionBy("_k", "_b").orderBy(F.col("_at").asc_nulls_first())
    since = Window.partitionBy("_k", "_b").orderBy(F.col("_at").desc_nulls_last())
    grow = (Window.unboundedPreceding, Window.currentRow)
    best = F.when(F.col("_late"), F.max("_v").over(upto.rangeBetween(*grow))).otherwise(
        F.max("_v").over(since.rangeBetween(*grow)))
    return (rows.withColumn("_best", best).where(F.col("_of").isNotNull())
            .groupBy(*[F.col("_of")[c].alias(c) for c in by]).agg(F.max("_best").alias(value)))


def nearest_within(points: DataFrame, events: DataFrame, keys: Keys, point_ts: str, event_ts: str, seconds: int,
                   *, last: bool) -> DataFrame:
    """``points`` with ``event_ts``: per row the least time e of the events of its ``keys`` with
    ts - ``seconds`` <= e < ts, or with ``last`` the greatest with ts - ``seconds`` <= e <= ts (NULL without any).

    An as-of join without pairs. Times are cut into segments of ``seconds``; what
    is looked for lies in the segment of the range's inner end (a running
    minimum or maximum over points and events in time order) or in the neighbouring one
    (its minimum or maximum). A hot key is spread over its segments.
    """
    left, right = [k for k, _ in keys], [k for _, k in keys]
    seg = lambda c: F.floor(_epoch(c) / F.lit(seconds))
    marks = points.select(*left, point_ts).where(F.col(point_ts).isNotNull()).distinct()
    at = F.col(point_ts) if last else F.timestamp_add("SECOND", F.lit(-seconds), F.col(point_ts))
    marks = marks.withColumn("_at", at).withColumn("_seg", seg(F.col("_at")))
    found = events.select(*[F.col(r).alias(l) for l, r in keys], F.col(event_ts).alias("_at")).where(F.col("_at").isNotNull())
    found = found.withColumn("_seg", seg(F.col("_at")))
    none = F.lit(None).cast(found.schema["_at"].dataType)
    both = marks.withColumn("_e", none).unionByName(
        found.withColumn("_e", F.col("_at")).withColumn(point_ts, F.lit(None).cast(marks.schema[point_ts].dataType)))
    # the frame grows from the first row in either direction, so the window takes one pass
    w = (Window.partitionBy(*left, "_seg").orderBy(F.col("_at").asc() if last else F.col("_at").desc())
         .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    pick = F.max if last else F.min
    here = both.withColumn("_here", pick("_e").over(w)).where(F.col(point_ts).isNotNull()).select(*left, point_ts, "_seg", "_here")
    beside = (found.groupBy(*left, "_seg").agg(pick("_at").alias("_beside"))
              .withColumn("_seg", F.col("_seg") + (1 if last else -1)))
    near = F.coalesce("_here", "_beside")
    ok = (near >= F.timestamp_add("SECOND", F.lit(-seconds), F.col(point_ts))) if last else near < F.col(point_ts)
    hits = here.join(beside, [*left, "_seg"], "left").select(
        *[F.col(k).alias(f"_k_{k}") for k in left], F.col(point_ts).alias("_k_ts"), F.when(ok, near).alias(event_ts))
    on = [F.col(k) == F.col(f"_k_{k}") for k in left] + [F.col(point_ts) == F.col("_k_ts")]
    return points.join(hits.where(F.col(event_ts).isNotNull()), _and(on), "left").drop("_k_ts", *[f"_k_{k}" for k in left])


def _and(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out
