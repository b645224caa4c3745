"""Join operators: endpoints, fan-out and brute-force equivalence on hand-made rows."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from disputelens.operators.joins import (
    any_party_join, either_key_join, interval_join, nearest_within, range_lookup, running_max_within, semi_join,
)


def ts(s):
    return dt.datetime.fromisoformat(s)


def test_interval_join_half_open_endpoints(spark):
    # override exactly at the event time is out, exactly 1 h before is in
    left = spark.createDataFrame([(1, 7, ts("2020-01-01 12:00:00"))], "id int, u long, t timestamp_ntz")
    right = spark.createDataFrame(
        [(7, ts("2020-01-01 12:00:00")), (7, ts("2020-01-01 11:00:00")), (7, ts("2020-01-01 10:59:59")),
         (7, ts("2020-01-01 11:30:00")), (8, ts("2020-01-01 11:30:00"))], "ru long, o timestamp_ntz")
    j = interval_join(left, right, [("u", "ru")], "t", F.col("o"), F.timestamp_add("HOUR", F.lit(1), F.col("o")),
                      lo_inclusive=False, hi_inclusive=True, bucket_seconds=3600)
    assert sorted(r.o for r in j.collect()) == [ts("2020-01-01 11:00:00"), ts("2020-01-01 11:30:00")]


def test_interval_join_keeps_unmatched_once(spark):
    left = spark.createDataFrame([(1, 7, ts("2020-01-01 12:00:00")), (2, 9, None)], "id int, u long, t timestamp_ntz")
    right = spark.createDataFrame([(7, ts("2020-01-02 00:00:00"))], "ru long, o timestamp_ntz")
    j = interval_join(left, right, [("u", "ru")], "t", F.col("o"), F.timestamp_add("SECOND", F.lit(60), F.col("o")),
                      lo_inclusive=True, hi_inclusive=True, bucket_seconds=60)
    assert sorted((r.id, r.o) for r in j.collect()) == [(1, None), (2, None)]


def test_login_window_closed_ends(spark):
    # success exactly 60 s before the session and exactly at it are both in
    left = spark.createDataFrame([(1, "d1", ts("2020-01-01 12:00:00"))], "u long, d string, t timestamp_ntz")
    right = spark.createDataFrame([(1, "d1", ts("2020-01-01 11:59:00")), (1, "d1", ts("2020-01-01 12:00:00")),
                                   (1, "d1", ts("2020-01-01 11:58:59")), (1, "d2", ts("2020-01-01 11:59:30"))],
                                  "ru long, rd string, s timestamp_ntz")
    j = interval_join(left, right, [("u", "ru"), ("d", "rd")], "t", F.col("s"),
                      F.timestamp_add("SECOND", F.lit(60), F.col("s")),
                      lo_inclusive=True, hi_inclusive=True, bucket_seconds=60)
    assert sorted(r.s for r in j.collect()) == [ts("2020-01-01 11:59:00"), ts("2020-01-01 12:00:00")]


def test_range_lookup_seven_days(spark):
    # an alert exactly 7 days before the transaction is in; max ignores the bucket copies
    left = spark.createDataFrame([(1, 10, ts("2020-01-08 12:00:00"))], "u long, code long, t timestamp_ntz")
    right = spark.createDataFrame([(1, ts("2020-01-01 12:00:00"), 0.3), (1, ts("2020-01-01 11:59:59"), 0.9),
                                   (1, ts("2020-01-08 12:00:01"), 0.8), (1, ts("2020-01-05 00:00:00"), 0.2)],
                                  "bu long, s timestamp_ntz, score double")
    j = range_lookup(left, right, [("u", "bu")], "s", F.timestamp_add("DAY", F.lit(-7), F.col("t")), F.col("t"),
                     lo_inclusive=True, hi_inclusive=True, bucket_seconds=86400)
    r = j.groupBy("u", "code").agg(F.max("score").alias("m")).collect()
    assert [(x.code, x.m) for x in r] == [(10, 0.3)]


def brute_either(left_rows, right_rows):
    out = []
    for lid, u, k1, k2 in left_rows:
        hits = [(ru, code, rid) for ru, code, rid in right_rows if ru == u and code is not None and code in (k1, k2)]
        out += [(lid, rid) for _, _, rid in hits] or [(lid, None)]
    return sorted(out, key=lambda x: (x[0], x[1] is None, x[1] or 0))


def test_either_key_join_matches_or_join(spark):
    left_rows = [(1, 1, 10, 20), (2, 1, 10, 10), (3, 1, 30, None), (4, 2, None, None), (5, 1, 99, 98),
                 (6, 1, 20, 10)]
    right_rows = [(1, 10, 100), (1, 10, 101), (1, 20, 102), (2, 30, 103), (1, None, 104), (1, 30, 105)]
    left = spark.createDataFrame(left_rows, "lid int, u long, k1 long, k2 long")
    right = spark.createDataFrame(right_rows, "ru long, code long, rid int")
    j = either_key_join(left, right, [("u", "ru")], ["k1", "k2"], "code", collapse=True)
    got = sorted(((r.lid, r.rid) for r in j.collect()), key=lambda x: (x[0], x[1] is None, x[1] or 0))
    assert got == brute_either(left_rows, right_rows)


def test_any_party_join_counts_each_pair_once(spark):
    left = spark.createDataFrame([(1, 5, "m"), (2, 6, "m"), (3, 7, "m")], "id int, u long, minute string")
    right = spark.createDataFrame([(100, 5, 6, "m"), (101, 5, 5, "m"), (102, 8, 9, "m")],
                                  "pid int, s long, r long, pm string")
    j = any_party_join(left, right, "u", ["s", "r"], [("minute", "pm")])
    got = sorted((r.id, r.pid) for r in j.collect() if r.pid is not None)
    brute = sorted((i, p) for (i, u, _), (p, s, r_) in itertools.product(
        [(1, 5, "m"), (2, 6, "m"), (3, 7, "m")], [(100, 5, 6), (101, 5, 5), (102, 8, 9)]) if u in (s, r_))
    assert got == brute
    assert j.filter(F.col("pid").isNull()).count() == 1


def test_either_key_join_keeps_equal_left_rows(spark):
    left = spark.createDataFrame([(1, 1, 50, 60), (1, 1, 50, 60), (2, 1, 10, 60), (2, 1, 10, 60)],
                                 "lid int, u long, k1 long, k2 long")
    right = spark.createDataFrame([(1, 10, 100)], "ru long, code long, rid int")
    j = either_key_join(left, right, [("u", "ru")], ["k1", "k2"], "code")
    assert sorted(((r.lid, r.rid) for r in j.collect()), key=str) == [(1, None), (1, None), (2, 100), (2, 100)]


def test_semi_join_is_an_in_subquery(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "u long")
    keys = spark.createDataFrame([(1,), (3,), (3,), (None,)], "k long")
    assert sorted(r.u for r in semi_join(df, keys, "u", "k").collect()) == [1, 3]
    plan = semi_join(df, keys, "u", "k")._jdf.queryExecution().logical().toString()
    assert "hint" not in plan.lower()  # how to join is left to the measured sizes


@pytest.mark.parametrize("segment", ["ts", "ts div 10", "0", "cast(null as bigint)"])
def test_lead_in_order_matches_window_on_a_hot_group(spark, segment):
    from disputelens.operators.sequence import lead_in_order

    rows = [(1 if i % 3 else 2, "A" if i % 5 else None, i // 4 if i % 17 else None, i, f"n{i}") for i in range(400)]
    rows += [(3, "B", 7, 1000, "solo")]
    df = spark.createDataFrame(rows, "u long, t string, ts long, id long, v string").repartition(7)
    got = lead_in_order(df, ["u", "t"], [("ts", "asc"), ("id", "asc")], ["ts", "v"], ["next_ts", "next_v"],
                        segment=F.expr(segment))
    w = Window.partitionBy("u", "t").orderBy(F.col("ts").asc_nulls_last(), F.col("id").asc_nulls_last())
    want = df.withColumn("next_ts", F.lead("ts").over(w)).withColumn("next_v", F.lead("v").over(w))
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=lambda r: r[3]) == \
        sorted(map(tuple, want.collect()), key=lambda r: r[3])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_running_max_within_against_all_pairs(spark, seed):
    """A hot account and its borders: exactly 7 days before, the very moment, bucket borders, no event at all."""
    r = random.Random(seed)
    base, week = dt.datetime(2020, 1, 10), dt.timedelta(days=7)
    moment = lambda: base + dt.timedelta(seconds=r.choice([3600, 60, 1]) * r.randint(-500, 500))
    events = [(1 if r.random() < 0.7 else r.randint(2, 6), moment(), round(r.random(), 3)) for _ in range(150)]
    points = [(1 if r.random() < 0.7 else r.randint(2, 8), moment()) for _ in range(150)]
    points += [(u, t) for u, t, _ in events[:20]] + [(u, t + week) for u, t, _ in events[20:40]] + [(9, None)]
    points += [(u, t + week + dt.timedelta(seconds=1)) for u, t, _ in events[40:60]]
    got = running_max_within(spark.createDataFrame(points, "u long, t timestamp_ntz"),
                             spark.createDataFrame(events, "u long, t timestamp_ntz, s double"), "u", "t", "s", 7 * 86400)
    want = {(u, t): max((s for eu, et, s in events if eu == u and t - week <= et <= t), default=None)
            for u, t in points if t is not None}
    assert {(x.u, x.t): x.s for x in got.collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_running_max_within_by_other_columns_and_null_keys(spark):
    t = dt.datetime(2020, 1, 10)
    points = [(1, "a", t), (1, "a", t + dt.timedelta(days=9)), (1, "b", t), (None, "c", t), (2, None, t), (1, "d", None)]
    events = [(1, t - dt.timedelta(days=7), 3), (1, t + dt.timedelta(days=8), 5), (None, t, 9), (2, t, None), (2, t, 4),
              (1, None, 8)]
    got = running_max_within(spark.createDataFrame(points, "u long, c string, t timestamp_ntz"),
                             spark.createDataFrame(events, "u long, t timestamp_ntz, s long"), "u", "t", "s", 7 * 86400,
                             by=["u", "c"])
    assert {(x.u, x.c): x.s for x in got.collect()} == {(1, "a"): 5, (1, "b"): 3, (None, "c"): None, (2, None): 4}
    assert got.columns == ["u", "c", "s"]


def test_running_max_within_takes_one_pass_of_a_hot_hour(spark):
    """200,000 points and 200,000 events of one account in an hour, in frames that grow from the first row."""
    n = 200_000
    at = "timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 0.018)"
    points = spark.range(n).selectExpr("1L AS u", "id AS c", f"{at} AS t")
    events = spark.range(n).selectExpr("1L AS u", f"{at} AS t", "id AS s")
    got = running_max_within(points, events, "u", "t", "s", 7 * 86400, by=["u", "c"])
    assert got.filter("s = c").count() == n
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    physical = got._jdf.queryExecution().sparkPlan().toString()
    assert "unboundedfollowing" not in physical.lower()


def test_rank_groups_ties_null_groups_and_null_sums(spark):
    from disputelens.operators.topn import rank_groups, top_label

    rows = [("a", "x", 5), ("a", "y", 5), ("a", None, 9), ("a", "z", None), ("a", "w", 1), ("b", "x", 1), ("b", "y", 2)]
    df = spark.createDataFrame(rows, "p string, v string, m long")
    got = {(r.p, r.v): r.k for r in rank_groups(df, ["p"], "v", "m", 4, "k").collect()}
    # a NULL sum comes first, the NULL value takes a rank, ties go by value, rank 5 falls out
    assert got == {("a", "z"): 1, ("a", None): 2, ("a", "x"): 3, ("a", "y"): 4, ("b", "y"): 1, ("b", "x"): 2}
    labelled = spark.createDataFrame([(1, "x"), (4, "x"), (None, "x"), (2, None)], "k int, v string")
    assert [r.l for r in labelled.select(top_label("k", "v", 3).alias("l")).collect()] == [
        "1.x", "99.others", "99.others", None]


def _times(seconds):
    return [None if s is None else dt.datetime(2020, 1, 1) + dt.timedelta(seconds=s) for s in seconds]


@pytest.mark.parametrize("seed,last", [(1, True), (1, False), (2, True), (2, False)])
def test_nearest_within_against_all_pairs(spark, seed, last):
    r = random.Random(seed)
    stamp = lambda: r.choice([None, *range(0, 400, 7)])
    points = [(r.choice([1, 2, None]), t) for t in _times(stamp() for _ in range(120))]
    events = [(r.choice([1, 2, None]), t) for t in _times(stamp() for _ in range(40))]
    got = nearest_within(spark.createDataFrame(points, "u long, t timestamp_ntz"), spark.createDataFrame(events, "v long, e timestamp_ntz"),
                         [("u", "v")], "t", "e", 60, last=last).select("u", "t", "e").collect()
    minute = dt.timedelta(seconds=60)

    def want(u, t):
        near = [e for v, e in events if None not in (u, t, e) and u == v and t - minute <= e and (e <= t if last else e < t)]
        return (max if last else min)(near) if near else None

    fix = lambda rows: sorted(map(str, rows))
    assert fix([tuple(x) for x in got]) == fix([(u, t, want(u, t)) for u, t in points])


def test_nearest_within_makes_no_pairs_for_a_hot_device(spark):
    """10,000 sessions and 10,000 logins of one device in a minute: a row each, not 10^8 pairs."""
    n = 10_000
    at = "timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(0, 0, 0, {0})"
    sessions = spark.range(n).selectExpr("1L AS u", f"{at.format('id * 0.005')} AS t")
    logins = spark.range(n).selectExpr("1L AS v", f"{at.format('id * 0.005')} AS e")
    out = nearest_within(sessions, logins, [("u", "v")], "t", "e", 60, last=True)
    assert out.filter("e = t").count() == n and out.count() == n


def test_nearest_within_takes_one_pass_when_the_first_is_wanted(spark):
    """200,000 sessions and logins of one device in a minute; the first login of the minute before each session."""
    n = 200_000
    at = "timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 0.0003)"
    sessions = spark.range(n).selectExpr("1L AS u", f"{at} AS t")
    logins = spark.range(n).selectExpr("1L AS v", f"{at} AS e")
    out = nearest_within(sessions, logins, [("u", "v")], "t", "e", 60, last=False)
    assert out.filter("e = timestamp_ntz'2020-01-01 00:00:00'").count() == n - 1


def test_follow_ups_of_an_authorisation_with_id_zero(spark):
    from disputelens.plans.risk_cut import join_dual

    rows = [(1, 0, 0, 10), (1, 5, 0, 11), (2, 7, 0, 12), (2, 8, 7, 13)]
    auth = spark.createDataFrame(rows, "user_id long, auth_id long, original_auth_id long, auth_event_id long")
    got = sorted((r.auth_event_id, r.dual_auth_event_id or 0) for r in join_dual(auth, auth).collect())
    assert got == [(10, 10), (10, 11), (11, 0), (12, 13), (13, 0)]
