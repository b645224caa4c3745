"""Ordering by known split points: global order, ties, missing points, hot keys, one run of the input."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from disputelens.operators.ranges import order_by_points, range_number, split_points
from disputelens.plans.history import AccountSet, HistorySources, account_history, account_timeline, history_points
from disputelens.plans.registry import fixtures_for
from tests.conftest import SMALL

TYPES = ("bigint", "timestamp_ntz")
START = dt.datetime(1999, 1, 1)


def _rows(n=2000, hot=0.4):
    rnd = random.Random(5)
    return [(7 if rnd.random() < hot else rnd.randrange(50), START + dt.timedelta(microseconds=rnd.randrange(10**9)), i)
            for i in range(n)]


@pytest.mark.parametrize("n_points", [0, 1, 2, 3, 7, 8, 37])
def test_range_number_counts_the_points_not_above(spark, n_points):
    rows = _rows(400)
    points = sorted({(u, t) for u, t, _ in random.Random(1).sample(rows, n_points)})
    df = spark.createDataFrame(rows, "u bigint, t timestamp_ntz, i int")
    got = df.select("u", "t", range_number([F.col("u"), F.col("t")], TYPES, points).alias("r")).collect()
    for r in got:
        assert r.r == sum(p <= (r.u, r.t) for p in points)


def test_order_is_global_and_a_hot_key_is_spread(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "u bigint, t timestamp_ntz, i int")
    keys = [F.col("u"), F.col("t")]
    points = split_points(df.select("u", "t"), len(rows), 10)
    assert len(points) == 9 and points == sorted(points)
    out = order_by_points(df, keys, TYPES, points, [F.col("u").asc(), F.col("t").asc(), F.col("i").asc()])
    assert out.rdd.getNumPartitions() == 10
    got = out.withColumn("p", F.spark_partition_id()).collect()
    assert [tuple(r)[:3] for r in got] == sorted(rows)
    sizes = [sum(r.p == p for r in got) for p in range(10)]
    assert max(sizes) <= 2 * len(rows) / 10
    assert len({r.p for r in got if r.u == 7}) >= 4


def test_equal_keys_share_a_range(spark):
    rows = [(1, START, i) for i in range(50)] + [(2, START, 50)]
    df = spark.createDataFrame(rows, "u bigint, t timestamp_ntz, i int")
    points = split_points(df.select("u", "t"), len(rows), 8)
    assert len(points) <= 2
    out = order_by_points(df, [F.col("u"), F.col("t")], TYPES, points, [F.col("u").asc(), F.col("t").asc(), F.col("i").asc()])
    assert [tuple(r) for r in out.collect()] == rows


def test_empty_sample_gives_no_points(spark):
    df = spark.createDataFrame([], "u bigint, t timestamp_ntz")
    assert split_points(df, 0, 8) == []
    assert order_by_points(df, [F.col("u"), F.col("t")], TYPES, [], [F.col("u").asc()]).collect() == []


def test_sample_is_bounded(spark):
    df = spark.range(200_000).select(F.col("id").alias("u"))
    points = split_points(df, 200_000, 4)
    assert len(points) == 3
    for want, (got,) in zip((50_000, 100_000, 150_000), points):
        assert abs(got - want) < 20_000


def test_timeline_by_points_equals_the_sorted_timeline(spark):
    fx = fixtures_for(spark, SMALL)
    src, acc = HistorySources.from_fixtures(fx), AccountSet.of(fx.member, "id")
    points = history_points(src, acc, ranges=12)
    assert len(points) == 11
    got = account_history(src, acc, points=points)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan.lower()  # nothing samples the feeds
    order = lambda df: [(r.user_id, r.timestamp, r.type, r.id) for r in df.collect()]
    want = order(account_history(src, acc))
    assert order(got) == want and len(want) == account_timeline(src, acc).count()


def test_one_account_keeps_its_rows(spark):
    fx = fixtures_for(spark, SMALL)
    src, acc = HistorySources.from_fixtures(fx), AccountSet.of_ids(spark, [3])
    got = account_history(src, acc, points=history_points(src, acc))
    assert sorted(map(str, got.collect())) == sorted(map(str, account_timeline(src, acc).collect()))
