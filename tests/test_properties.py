"""Properties of the jobs: uniqueness, counts, sums, account independence, plans."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SMALL
from disputelens.plans import params as P
from disputelens.plans.dispute_wow import detail_base, dispute_wow_detail, dispute_wow_summary, report_tables, run_dispute_wow
from disputelens.plans.history import (
    FEEDS, AccountSet, HistorySources, account_history, account_timeline, hist_disputes, write_account_history,
)
from disputelens.plans.registry import fixtures_for, queries
from disputelens.plans.weekly_cases import weekly_top_cases
from disputelens.sources.fixtures import RELATIONS


def q(spark, key, sf=SMALL):
    return E.queries()[key](spark, sf)


def test_risk_cut_one_row_per_event(spark):
    r = q(spark, "risk_cut_check").collect()[0]
    assert r.n_rows == r.n_keys > 0


def test_dedups_give_unique_keys(spark):
    for key, col in [("dedup_auth_event", "auth_event_id"), ("dedup_dispute", "unique_transaction_id"),
                     ("dedup_auth_response", "auth_event_id"), ("hist_auths", "id")]:
        df = q(spark, key)
        assert df.count() == df.select(col).distinct().count(), key


def test_union_count_is_sum_of_feeds(spark):
    total = q(spark, "account_history").count()
    assert total == sum(q(spark, k).count() for k, _ in FEEDS)


def test_summary_sums_equal_detail_sums(spark):
    d = q(spark, "dispute_wow_detail").agg(
        F.sum("settled_amt").alias("s"), F.sum(F.when(F.col("dispute_ind_7d") == 1, F.col("settled_amt"))).alias("d"))
    s = q(spark, "dispute_wow_summary").agg(F.sum("settled_amt_sum").alias("s"), F.sum("dispute_amt_sum").alias("d"))
    a, b = d.collect()[0], s.collect()[0]
    assert a.s == b.s and (a.d or 0) == b.d


def test_refund_bucket_is_not_empty(spark):
    # refunds make settled_amt * -1 negative: the '1. <=0' bucket must be used
    assert q(spark, "dispute_wow_detail", "/root/testdata/sf0.01").filter(F.col("settled_amt_cat") == "1. <=0").count() > 0


def test_one_account_equals_its_rows_among_many(spark):
    fx = fixtures_for(spark, SMALL)
    src = HistorySources.from_fixtures(fx)
    users = fx.member.select(F.col("id").alias("user_id"))
    pair = users.filter(F.col("user_id").isin(3, 7))
    one = users.filter(F.col("user_id") == 3)
    a = sorted(tuple(r) for r in account_history(src, one).collect())
    b = sorted(tuple(r) for r in account_history(src, pair).filter(F.col("user_id") == 3).collect())
    assert a == b and len(a) > 0


def _executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_nested_loop_or_cartesian_plans(spark):
    """Every registered result, and the plans that the stored ones come from."""
    fx = fixtures_for(spark, SMALL)
    day1, day2 = P.wow_window(P.AS_OF)
    plans = {key: fn(spark, SMALL) for key, fn in queries().items()}
    plans["timeline"] = account_timeline(HistorySources.from_fixtures(fx), AccountSet.of(fx.member, "id"))
    plans["base"] = detail_base(fx.settled_txn, fx.disputed_txn, fx.auth_event, fx.dim_member, day1, day2,
                                P.DISPUTE_WIN, P.AS_OF)
    plans["cut"] = q(spark, "risk_score_cut")
    for key, df in plans.items():
        assert not any(b in _executed(df) for b in ("BroadcastNestedLoopJoin", "CartesianProduct")), key


def test_builders_are_lazy(spark):
    """Calling a job's function runs no job (the sorted timeline is nine feeds in one plan)."""
    fx = fixtures_for(spark, SMALL)
    src, acc = HistorySources.from_fixtures(fx), AccountSet.of(fx.member, "id")
    day1, day2 = P.wow_window(P.AS_OF)
    inputs = [getattr(fx, r) for r in RELATIONS]  # written on first use, outside the count
    assert len(inputs) == len(RELATIONS)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "builders")
    try:
        history = account_history(src, acc)
        dispute_wow_detail(fx.settled_txn, fx.disputed_txn, fx.auth_event, fx.dim_member, fx.login_alert, day1, day2,
                           P.DISPUTE_WIN, P.AS_OF)
        weekly_top_cases(fx.disputed_txn, fx.inspector_dispute, fx.inspector_txn, P.AS_OF)
        assert list(tracker.getJobIdsForGroup("lazy")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert _executed(history).count("Union") >= 1


def test_every_account_table_is_cut_to_the_accounts(spark):
    """One account: a semi-join stands on each scan with an account column."""
    fx = fixtures_for(spark, SMALL)
    plan = account_timeline(HistorySources.from_fixtures(fx), AccountSet.of_ids(spark, [3]))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    # 9 feeds' own scans and 12 context scans with an account column
    assert text.count("LeftSemi") >= 20


def test_fixtures_exercise_the_operators(spark):
    fx = fixtures_for(spark, "/root/testdata/sf0.01")
    posted = fx.posted_txn.count()
    assert 0 < q(spark, "semi_join_users", "/root/testdata/sf0.01").count() < posted
    logins = q(spark, "join_login_60s", "/root/testdata/sf0.01").count()
    assert q(spark, "dedup_login", "/root/testdata/sf0.01").count() < logins
    labels = q(spark, "label_top_n", "/root/testdata/sf0.01")
    assert labels.filter("top_mcc_cd = '99.others'").count() > 0 and labels.filter("top_mcc_cd like '3.%'").count() > 0
    shared = fx.disputed_txn.groupBy("unique_transaction_id").agg(F.count_distinct("user_id").alias("n")).filter("n > 1")
    assert shared.count() > 0
    contacts = fx.dispute_contact.filter("dispute_contact_category = 'Filing'").groupBy("dispute_id").count()
    assert contacts.filter("count > 1").count() > 0


def test_account_filter_comes_after_the_dispute_dedup(spark):
    """A transaction whose latest row is another account's is not in the first account's history."""
    fx = fixtures_for(spark, "/root/testdata/sf0.01")
    src = HistorySources.from_fixtures(fx)
    latest = q(spark, "dedup_dispute", "/root/testdata/sf0.01").select("user_dispute_claim_txn_id")
    for user in (3, 7, 11):
        own = fx.disputed_txn.filter(F.col("user_id") == user)
        want = own.join(latest, "user_dispute_claim_txn_id", "left_semi").count()
        assert hist_disputes(src, AccountSet.of_ids(spark, [user])).count() == want
    assert fx.disputed_txn.join(latest, "user_dispute_claim_txn_id", "left_anti").count() > 0


def test_write_account_history_is_ranged_and_sorted(spark, tmp_path):
    fx = fixtures_for(spark, SMALL)
    src, acc = HistorySources.from_fixtures(fx), AccountSet.of(fx.member, "id")
    path = str(tmp_path / "history")
    write_account_history(src, acc, path)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(map(tuple, spark.read.parquet(path).collect()), key=key) == sorted(
        map(tuple, account_timeline(src, acc).collect()), key=key)


def test_filters_reach_the_scan(spark):
    fx = fixtures_for(spark, SMALL)
    df = fx.src.read("orders", ["o_orderkey", "o_orderdate"]).filter(
        F.to_date("o_orderdate").between(F.lit(dt.date(1999, 1, 1)), F.lit(dt.date(1999, 1, 31))))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan


def test_run_dispute_wow_writes_detail_and_summary(spark):
    fx = fixtures_for(spark, SMALL)
    day1, day2 = P.wow_window(P.AS_OF)
    out = tempfile.mkdtemp(prefix="disputelens-wow-")
    run_dispute_wow(spark, fx, out, day1, day2, P.DISPUTE_WIN, P.AS_OF)
    detail, summary = report_tables(spark, out)
    for table in (detail, summary):
        parts = [p for p in os.listdir(table) if p.startswith("txn_week=")]
        assert parts, table  # partitioned by week: readers prune to the weeks they ask for
    pruned = spark.read.parquet(detail).filter(F.col("txn_week") == F.lit(day1))
    assert "PartitionFilters: [isnotnull(txn_week" in pruned._jdf.queryExecution().executedPlan().toString()
    written = spark.read.parquet(summary)
    direct = dispute_wow_summary(dispute_wow_detail(fx.settled_txn, fx.disputed_txn, fx.auth_event, fx.dim_member,
                                                    fx.login_alert, day1, day2, P.DISPUTE_WIN, P.AS_OF))
    cols = sorted(direct.columns)
    norm = lambda df: sorted(tuple(str(v) for v in r) for r in df.select(*cols).collect())
    assert norm(written) == norm(direct)


def test_wow_window_dates():
    assert P.wow_window(dt.date(1999, 6, 16)) == (dt.date(1999, 5, 10), dt.date(1999, 6, 6))
    assert P.wow_window(dt.date(1999, 6, 14)) == (dt.date(1999, 5, 10), dt.date(1999, 6, 6))
    assert P.wow_window(dt.date(1999, 6, 13)) == (dt.date(1999, 5, 3), dt.date(1999, 5, 30))


def test_weekly_step_counts_match_fixture_notes(spark):
    from disputelens.functions import codes
    from disputelens.plans.weekly_cases import last_complete_week, ntz, weekly_case_rows, weekly_top_cases

    fx = fixtures_for(spark, "/root/testdata/sf0.01")
    lo, hi = last_complete_week(P.AS_OF)
    week = fx.disputed_txn.filter((F.col("dispute_created_at") >= ntz(lo)) & (F.col("dispute_created_at") < ntz(hi)))
    assert week.count() == 51
    assert week.filter(F.col("transaction_code").isin(*codes.WEEKLY_CASE_CODES)).count() == 47
    rows = weekly_case_rows(fx.disputed_txn, fx.inspector_dispute, P.AS_OF)
    assert rows.count() == 41
    top = weekly_top_cases(fx.disputed_txn, fx.inspector_dispute, fx.inspector_txn, P.AS_OF, n=1000)
    assert top.count() == 16
    assert weekly_top_cases(fx.disputed_txn, fx.inspector_dispute, fx.inspector_txn, P.AS_OF).count() == 10


def test_report_counts_match_fixture_notes(spark):
    d = q(spark, "dispute_wow_detail", "/root/testdata/sf0.01")
    assert d.count() == 472
    assert d.select("user_id", "authorization_code").distinct().count() == 446
    assert d.filter(F.col("dispute_ind_7d") == 1).count() == 102
    assert d.filter((F.col("dispute_ind_7d") == 0) & F.col("reason").isNotNull()).count() == 63
    assert d.filter(F.col("card_network_cd").isNull()).count() == 40


def test_single_account_pull_plans_a_hash_semi_join(spark):
    fx = fixtures_for(spark, SMALL)
    src = HistorySources.from_fixtures(fx)
    acc = AccountSet.of_ids(spark, [3])
    plan = account_timeline(src, acc)._jdf.queryExecution().executedPlan().toString()
    df = account_history(src, acc)
    assert "LeftSemi" in plan
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    users = fx.member.select(F.col("id").alias("user_id"))
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, account_history(
        src, users).filter(F.col("user_id") == 3).collect()))


def test_account_set_accepts_text_ids(spark):
    df = spark.createDataFrame([("3",), ("3.0",), ("anon-1",), (None,), ("7",)], "user_id string")
    acc = AccountSet.of(df)
    assert sorted(r._uid for r in acc.users.collect()) == [3, 7]


def test_drop_materialized_removes_this_apps_tables(spark):
    from disputelens.session import _tables_root, drop_materialized, materialize

    from disputelens.plans import registry
    from disputelens.sources import fixtures

    df = materialize(spark.range(10))
    root = _tables_root(spark).replace("file:", "")
    assert os.path.isdir(root) and df.count() == 10
    fixtures_for(spark, SMALL).member  # a cached relation of this application
    drop_materialized(spark)
    assert not os.path.isdir(root)
    app = spark.sparkContext.applicationId
    assert not any(k[0] == app for k in fixtures._BASES) and not any(k[0] == app for k in registry._FIXTURES)
    # later queries rebuild what they need
    assert q(spark, "user_set").count() > 0


def test_a_lost_run_leaves_the_former_tables(spark, monkeypatch):
    """The run breaks between the two tables: readers still get the former pair; the next run replaces both."""
    from disputelens.plans import dispute_wow

    fx = fixtures_for(spark, SMALL)
    day1, day2 = P.wow_window(P.AS_OF)
    out = tempfile.mkdtemp(prefix="disputelens-wow-")
    with pytest.raises(FileNotFoundError):
        report_tables(spark, out)
    run_dispute_wow(spark, fx, out, day1, day2, P.DISPUTE_WIN, P.AS_OF)
    before = report_tables(spark, out)
    counts = [spark.read.parquet(t).count() for t in before]

    def broken(detail):
        raise RuntimeError("lost between the two tables")

    monkeypatch.setattr(dispute_wow, "dispute_wow_summary", broken)
    with pytest.raises(RuntimeError):
        run_dispute_wow(spark, fx, out, day1, day2, P.DISPUTE_WIN, P.AS_OF)
    assert report_tables(spark, out) == before
    assert [spark.read.parquet(t).count() for t in before] == counts
    monkeypatch.undo()
    run_dispute_wow(spark, fx, out, day1, day2, P.DISPUTE_WIN, P.AS_OF)
    after = report_tables(spark, out)
    assert after != before and [spark.read.parquet(t).count() for t in after] == counts
    assert len([p for p in os.listdir(out) if p.startswith("version-")]) == 2  # the lost one is gone


def test_label_ranks_are_cut_before_the_shuffle(spark):
    from disputelens.plans.dispute_wow import add_top_labels

    fx = fixtures_for(spark, SMALL)
    day1, day2 = P.wow_window(P.AS_OF)
    base = detail_base(fx.settled_txn, fx.disputed_txn, fx.auth_event, fx.dim_member, day1, day2, P.DISPUTE_WIN, P.AS_OF)
    plan = add_top_labels(base, 9, 20, 9)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and ", 20, Partial" in plan
