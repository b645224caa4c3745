"""Randomised checks of the join operators against brute force on small inputs."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from disputelens.operators.joins import either_key_join, interval_join

BASE = dt.datetime(2020, 1, 1)
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

codes = st.one_of(st.none(), st.integers(1, 6))
left_rows = st.lists(st.tuples(st.integers(1, 3), codes, codes), min_size=1, max_size=12)
right_rows = st.lists(st.tuples(st.integers(1, 3), codes), min_size=0, max_size=12)


@SETTINGS
@given(left_rows, right_rows)
def test_either_key_join_is_the_or_join(spark, lrows, rrows):
    left = spark.createDataFrame([(i, u, a, b) for i, (u, a, b) in enumerate(lrows)], "lid int, u long, k1 long, k2 long")
    right = spark.createDataFrame([(u, c, j) for j, (u, c) in enumerate(rrows)], "ru long, code long, rid int")
    got = sorted(((r.lid, r.rid) for r in either_key_join(left, right, [("u", "ru")], ["k1", "k2"], "code").collect()),
                 key=lambda x: (x[0], -1 if x[1] is None else x[1]))
    want = []
    for i, (u, a, b) in enumerate(lrows):
        hits = [j for j, (ru, c) in enumerate(rrows) if ru == u and c is not None and (c == a or c == b)]
        want += [(i, j) for j in hits] or [(i, None)]
    assert got == sorted(want, key=lambda x: (x[0], -1 if x[1] is None else x[1]))


offsets = st.integers(0, 6 * 3600)
ev = st.lists(st.tuples(st.integers(1, 2), offsets), min_size=1, max_size=10)


@SETTINGS
@given(ev, ev, st.booleans(), st.booleans())
def test_interval_join_is_the_range_join(spark, lrows, rrows, lo_inc, hi_inc):
    width = 3600
    left = spark.createDataFrame([(i, u, BASE + dt.timedelta(seconds=s)) for i, (u, s) in enumerate(lrows)],
                                 "lid int, u long, t timestamp_ntz")
    right = spark.createDataFrame([(j, u, BASE + dt.timedelta(seconds=s)) for j, (u, s) in enumerate(rrows)],
                                  "rid int, ru long, o timestamp_ntz")
    j = interval_join(left, right, [("u", "ru")], "t", F.col("o"),
                      F.timestamp_add("SECOND", F.lit(width), F.col("o")),
                      lo_inclusive=lo_inc, hi_inclusive=hi_inc, bucket_seconds=width)
    got = sorted(((r.lid, r.rid) for r in j.collect()), key=lambda x: (x[0], -1 if x[1] is None else x[1]))
    want = []
    for i, (u, t) in enumerate(lrows):
        hits = [k for k, (ru, o) in enumerate(rrows)
                if ru == u and (o <= t if lo_inc else o < t) and (t <= o + width if hi_inc else t < o + width)]
        want += [(i, k) for k in hits] or [(i, None)]
    assert got == sorted(want, key=lambda x: (x[0], -1 if x[1] is None else x[1]))
