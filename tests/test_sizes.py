"""What a query shuffles and writes: one stored base, views over it, shuffles sized by the input."""

import datetime as dt
import os

from pyspark.sql import functions as F

from disputelens.plans.history import (
    AccountSet, HistorySources, first_disputes, hist_auths_joined, hist_disputes_joined,
)
from disputelens.plans.registry import fact_buckets, fixtures_for
from disputelens.session import BYTES_PER_PARTITION, partitions_for, size_shuffles
from disputelens.sources.fixtures import Fixtures

INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def _tables(spark, folder, lines, orders):
    """Driver tables with the given (order, line, part, price) lines and (order, customer) orders."""
    day = dt.datetime(1999, 5, 20)
    spark.createDataFrame([(o, n, p, 7, 4.0, price, 0.02, "R", day) for o, n, p, price in lines],
                          "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, "
                          "l_extendedprice double, l_discount double, l_returnflag string, l_shipdate timestamp_ntz"
                          ).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint").write.parquet(f"{folder}/orders.parquet")


def test_line_base_counts_repeated_lines_and_orders(spark, tmp_path):
    _tables(spark, tmp_path, [(1, 1, 5, 10.25), (1, 1, 3, 2.0), (1, 2, 9, 4.0), (2, 1, 1, None), (None, 1, 1, 8.0), (4, 1, 1, 3.0)],
            [(1, 70), (1, 70), (1, 71), (1, None), (2, 70), (None, 9), (3, 70)])
    got = Fixtures(spark, str(tmp_path), reuse_base=False).line_base.select("code", "u", "amt", "pk").collect()
    key = lambda r: tuple(str(v) for v in r)
    # 12.25 a pair of equal orders counts twice; no order, no row
    assert sorted(map(key, got)) == sorted([
        ("11", "70", "24.50", "3"), ("11", "71", "12.25", "3"), ("11", "None", "12.25", "3"),
        ("12", "70", "8.00", "9"), ("12", "71", "4.00", "9"), ("12", "None", "4.00", "9"), ("21", "70", "None", "1")])


def test_projections_of_the_base_are_not_stored(spark, tmp_path):
    """One shuffle of the lines and one table, whatever projections a query reads: F1 to F9."""
    _tables(spark, tmp_path, [(1, n, n, 1.0) for n in range(1, 6)], [(1, 70)])
    fx = Fixtures(spark, str(tmp_path))
    base = {os.path.dirname(f) for f in fx.line_base.inputFiles()}
    for name in ("settled_txn", "disputed_txn", "auth_event", "posted_txn", "auth_decision", "fraud_override",
                 "alert_auth_event", "member_override", "pay_friend", "pay_friend_score"):
        df = getattr(fx, name)
        assert {os.path.dirname(f) for f in df.inputFiles()} == base, name
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString(), name


def test_lines_are_sorted_once_and_not_before_the_shuffle(spark, tmp_path):
    _tables(spark, tmp_path, [(1, 1, 1, 1.0)], [(1, 70)])
    fx = Fixtures(spark, str(tmp_path), reuse_base=False)
    plan = fx.line_base._jdf.queryExecution().executedPlan().toString()
    scan = plan.index("ReadSchema: struct<l_orderkey")
    below = plan[plan.rindex("REPARTITION_BY_COL", 0, scan):scan]
    assert "Aggregate" not in below and "Sort" not in below


def test_shuffles_follow_the_input(spark):
    before = spark.conf.get(INITIAL, None)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        assert partitions_for(spark, 0) == least and partitions_for(spark, 6 * 10**9) == -(-6 * 10**9 // BYTES_PER_PARTITION)
        size_shuffles(spark, 10**9)
        assert int(spark.conf.get(INITIAL)) == partitions_for(spark, 10**9) > least
        size_shuffles(spark, 0)
        assert int(spark.conf.get(INITIAL)) == least
        spark.conf.set(INITIAL, "77")  # the user's own number
        size_shuffles(spark, 10**9)
        assert spark.conf.get(INITIAL) == "77"
    finally:
        spark.conf.set(INITIAL, before) if before else spark.conf.unset(INITIAL)
    assert fact_buckets(0) == 16 and fact_buckets(6 * 10**9) * BYTES_PER_PARTITION >= 6 * 10**9


def test_auths_take_the_first_dispute_of_either_code(spark):
    """By auth id, by the follow-up's, by both, by neither; several disputes of a code; no exchange of the
    authorisations for the dispute join (F1, F2, F6)."""
    from conftest import SMALL

    fx = fixtures_for(spark, SMALL)
    src = HistorySources.from_fixtures(fx)
    got = hist_auths_joined(src, AccountSet.of(fx.member, "id")).select(
        "auth_event_id", "d_unique_transaction_id", "d_claim_txn_id").collect()
    d = {}
    for r in fx.disputed_txn.select("user_id", "authorization_code", "unique_transaction_id",
                                    "user_dispute_claim_txn_id").collect():
        d.setdefault((r[0], r[1]), []).append((r[2], r[3]))
    auths = fx.auth_event.select("auth_event_id", "user_id", "auth_id", "original_auth_id", "final_amt").collect()
    dual = {}
    for r in auths:
        if r.original_auth_id:
            dual.setdefault((r.user_id, r.original_auth_id), []).append((r.auth_event_id, r.auth_id))
    want = {}
    for r in auths:
        if r.original_auth_id == 0 and r.final_amt >= 0:
            follow = min(dual.get((r.user_id, r.auth_id), [(None, None)]))[1]
            found = d.get((r.user_id, r.auth_id), []) + d.get((r.user_id, follow), [])
            want[r.auth_event_id] = min(found, default=(None, None))
    assert {r[0]: (r[1], r[2]) for r in got if r[0] in want} == want and len(got) >= len(want)
    rows = spark.createDataFrame([(1, 5, None, 2), (1, 5, 9, 3), (1, 5, 9, 1), (2, 5, None, None)],
                                 "d_user_id bigint, d_authorization_code bigint, d_unique_transaction_id bigint, d_claim_txn_id bigint")
    assert sorted(map(tuple, first_disputes(rows).collect())) == [(1, 5, 9, 1), (2, 5, None, None)]
    assert first_disputes(rows).where(F.col("d_claim_txn_id") == 1).count() == 1


def _auth_sources(spark, auths, cards, overrides):
    """Relations of which only the messages, cards and overrides have rows."""
    from conftest import SMALL

    fx = fixtures_for(spark, SMALL)
    empty = {f: getattr(fx, f).limit(0) for f in HistorySources.FIELDS}
    at = dt.datetime(1999, 5, 20)
    like = lambda name, rows, cols: spark.createDataFrame(
        [tuple(r) for r in rows], cols) if rows else empty[name]
    base = fx.auth_event.limit(1).drop("auth_event_id", "user_id", "auth_id", "original_auth_id", "final_amt", "pan")
    keys = like("auth_event", auths, "auth_event_id bigint, user_id bigint, auth_id bigint, pan string")
    auth = keys.crossJoin(base).withColumn("original_auth_id", F.lit(0).cast("bigint")).withColumn(
        "final_amt", F.lit(1).cast("decimal(18,2)"))
    empty["auth_event"] = auth.select(*fx.auth_event.columns)
    empty["card"] = like("card", [(*c, at) for c in cards],
                         "user_id bigint, card_id string, card_number string, card_type string, card_created_ts timestamp_ntz")
    empty["fraud_override"] = like("fraud_override", [(u, a, 1, False, "deny", at + dt.timedelta(hours=h)) for u, a, h in overrides],
                                   "user_id bigint, realtime_auth_id bigint, decision_id bigint, is_suppressed boolean, "
                                   "response_signal string, response_received_at timestamp_ntz")
    return HistorySources(**empty), AccountSet.of_ids(spark, [1, 2, 3])


def test_an_event_id_of_several_auths_is_kept_once(spark):
    """Decided by the keep-first's order, over accounts and auth ids, among them none and -1 (F2)."""
    src, acc = _auth_sources(
        spark, auths=[(10, 1, 100, "x0001"), (10, 2, 200, "x0002"), (11, 1, 101, "x0001"), (11, 1, 101, "x0009"),
                      (12, 3, None, "x0003"), (13, 3, -1, "x0004"), (14, 3, None, "x0004"), (14, 3, -1, "x0004"),
                      (None, 1, 102, "x0007"), (None, 2, 103, "x0007")],
        cards=[(1, "b", "n0001", "B"), (1, "a", "n0001", "A"), (1, "c", "n0009", "C"), (3, "d", "n0003", "D"), (3, "e", "n0004", "E")],
        overrides=[(1, 100, 2), (2, 200, 1), (3, -1, 5), (2, 103, 3)])
    got = hist_auths_joined(src, acc).select("auth_event_id", "user_id", "auth_id", "dc_card_type", "o_decision_id").collect()
    assert sorted(map(tuple, got), key=str) == sorted([
        (10, 2, 200, None, 1), (11, 1, 101, "A", None), (12, 3, None, "D", None), (13, 3, -1, "E", 1),
        (14, 3, -1, "E", 1), (None, 2, 103, None, 1)], key=str)


def test_auths_are_shuffled_once_with_all_their_columns(spark):
    """The merchant's text of a message passes one exchange, not one for cards, one for the joins and one for the
    keep-first (F2)."""
    from conftest import SMALL

    fx = fixtures_for(spark, SMALL)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        src = HistorySources.from_fixtures(fx)
        joined = hist_auths_joined(src, AccountSet.of(fx.member, "id")).select("auth_event_id", "auth_event_merchant_name_raw", "dc_card_type")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        text = plan.splitlines()
        main = next(i for i, line in enumerate(text) if "Window" in line)
        # no exchange lies between the last window and the first join below it
        below = next(i for i in range(main, len(text)) if "Join" in text[i])
        assert not any("Exchange" in line for line in text[main:below])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_disputes_are_shuffled_once_for_the_claim(spark):
    """Its three joins on the claim share a shuffle, whose rows are already the latest of their transaction (F2, F4)."""
    from conftest import SMALL

    fx = fixtures_for(spark, SMALL)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = hist_disputes_joined(HistorySources.from_fixtures(fx), AccountSet.of(fx.member, "id"))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(_claim") == 1 and "hashpartitioning(user_dispute_claim_id" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_lead_in_order_shuffles_rows_once_and_segments_once(spark):
    """Two exchanges of rows: by (group, segment), and of the segments' last rows by group (F2)."""
    from disputelens.operators.sequence import lead_in_order

    df = spark.range(20).select((F.col("id") % 2).alias("u"), F.col("id").alias("n"))
    out = lead_in_order(df, ["u"], [("n", "asc")], ["n"], ["nxt"], segment=F.floor(F.col("n") / 5))
    assert sorted(map(tuple, out.collect())) == [(n % 2, n, n + 2 if n < 18 else None) for n in sorted(range(20), key=lambda n: (n % 2, n))]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
