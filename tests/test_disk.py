"""What the account history leaves on the disks: no table shuffled by the account alone, shuffles deleted feed by feed."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from disputelens.operators import joins
from disputelens.operators.joins import in_rough_set, rough_set
from disputelens.operators.ranges import order_by_points, split_points
from disputelens.plans import history as H
from disputelens.plans.registry import fixtures_for
from disputelens.session import _FREE, materialize, shuffles_freed

START = dt.datetime(1999, 1, 1)
TYPES = ("bigint", "timestamp_ntz")


@pytest.fixture
def no_broadcasts(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    found = blocks.mkString(",").split(",")
    return {b for b in found if b.startswith("shuffle_")}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    df = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert sorted(r.k for r in df.collect()) == list(range(7))
    for _ in range(50):  # deleted in the background
        left = _shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.2)
    assert not left


def test_freeing_is_for_the_block_only(spark):
    assert spark.conf.get(_FREE, "false") == "false"
    with shuffles_freed(spark):
        with shuffles_freed(spark):
            assert spark.conf.get(_FREE) == "true"
        assert spark.conf.get(_FREE) == "true"
    assert spark.conf.get(_FREE) == "false"


@pytest.mark.parametrize("bits", [64, 1 << 24])
def test_rough_set_lets_all_members_through(spark, monkeypatch, bits):
    monkeypatch.setattr(joins, "ROUGH_BITS", bits)
    ids = [*range(0, 3000, 3), 2**63 - 1, -(2**63), -5]
    keys = spark.createDataFrame([(i,) for i in [*ids, None]], "k bigint")
    df = spark.createDataFrame([(i,) for i in [*range(3000), 2**63 - 1, -(2**63), -5, -6, None]], "u bigint")
    rough = rough_set(keys, "k")
    got = [r.u for r in in_rough_set(df, F.col("u"), rough).collect()]
    assert rough.count() <= bits // 64 and set(ids) <= set(got) and None not in got and len(got) == len(set(got))
    assert bits == 64 or len(got) < len(ids) + 20
    plan = in_rough_set(df, F.col("u"), rough)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("ranges", [1, 2, 9])
def test_ordered_rows_are_cut_to_the_marks(spark, ranges):
    """A hot number over many ranges, one without rows, numbers at both ends, rows without number or time."""
    ends = [2**63 - 1, -(2**63)]
    rows = [(7 if i % 2 else i % 40, START + dt.timedelta(seconds=i * 37 % 4001), i) for i in range(900)]
    rows += [(None, START, 900), (7, None, 901), (8, None, 902), *((u, START, 903) for u in ends)]
    df = spark.createDataFrame(rows, "u bigint, t timestamp_ntz, i int")
    keys = [F.col("u"), F.coalesce("t", F.lit("9999-12-31 23:59:59.999999").cast("timestamp_ntz"))]
    known = df.where("u is not null").select(keys[0].alias("a"), keys[1].alias("b"))
    points = split_points(known, len(rows), ranges)
    order = [F.col("u").asc_nulls_last(), F.col("t").asc_nulls_last(), F.col("i").asc()]
    last = lambda r: (r[0], r[1] or dt.datetime.max, r[2])
    for some in ([7, 4, 999, *ends], [], [*range(40), *ends]):
        only = spark.createDataFrame([(u,) for u in some], "u bigint")
        got = order_by_points(df, keys, TYPES, points, order, only=only)
        assert got.columns == df.columns and got.rdd.getNumPartitions() == len(points) + 1
        assert [tuple(r) for r in got.collect()] == sorted((r for r in rows if r[0] in some), key=last)


def test_the_cut_shares_the_shuffle_of_the_order(spark, no_broadcasts):
    df = spark.createDataFrame([(1, START)], "u bigint, t timestamp_ntz")
    got = order_by_points(df, [F.col("u"), F.col("t")], TYPES, [(1, START)], [F.col("u").asc(), F.col("t").asc()],
                          only=df.select("u"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_no_feed_is_shuffled_for_the_accounts(spark, no_broadcasts):
    """With points, no table meets the account set in a shuffle; only the few contested event ids do."""
    fx = fixtures_for(spark, SMALL)
    src, acc = H.HistorySources.from_fixtures(fx), H.AccountSet.of(fx.member, "id")
    got = H.account_history(src, acc, points=[(5, START)])
    plan = got._jdf.queryExecution().executedPlan().toString()
    semis = [line for line in plan.splitlines() if "LeftSemi" in line and "_uid#" in line]
    assert len(semis) == 2  # the contested ids, once as such and once for the losers


@pytest.mark.parametrize("ids", [[3], [2, 3, 40]])
@pytest.mark.parametrize("bits", [64, 1 << 24])
def test_history_is_cut_exactly_whatever_the_rough_set_lets_through(spark, monkeypatch, ids, bits):
    monkeypatch.setattr(joins, "ROUGH_BITS", bits)
    fx = fixtures_for(spark, SMALL)
    src, acc = H.HistorySources.from_fixtures(fx), H.AccountSet.of_ids(spark, ids)
    stored = []

    def keep(df):
        stored.append(df.columns)
        return materialize(df)

    got = H.account_history(src, acc, points=H.history_points(src, acc, ranges=5), keep=keep).collect()
    want = H.account_timeline(src, acc).collect()
    assert len(stored) == 1 + len(H.SHUFFLING)  # the rough set and the feeds
    assert sorted(map(str, got)) == sorted(map(str, want)) and got
    order = [(r.user_id, r.timestamp or dt.datetime.max) for r in got]
    assert order == sorted(order)


def test_an_event_id_of_another_account_does_not_win(spark, monkeypatch):
    """Both accounts pass the rough set; the other one's message comes first in the keep-first's order."""
    from test_sizes import _auth_sources

    monkeypatch.setattr(joins, "ROUGH_BITS", 64)
    src, _ = _auth_sources(spark, auths=[(10, 1, 100, "x0001"), (10, 2, 200, "x0002")], cards=[],
                           overrides=[(1, 100, 2), (2, 200, 1)])
    acc = H.AccountSet.of_ids(spark, [1])
    rough = H.RoughAccounts.of_set(acc, lambda df: df)
    assert [r.user_id for r in H.hist_auths(src, rough).collect() if r.user_id == 1] == [1]
    got = H.account_history(src, acc, points=[(1, START), (2, START)]).collect()
    assert [(r.user_id, r.id) for r in got] == [(1, "100")]


def test_points_are_cut_to_the_accounts_in_the_sample(spark):
    """The cut meets the sampled rows, not the tables."""
    seen = []
    df = spark.range(200_000).select(F.col("id").alias("u"))

    def cut(found):
        seen.append(found.count())
        return found.where("u < 100000")

    points = split_points(df, 200_000, 4, cut=cut)
    assert seen[0] < 1000 and all(u < 100_000 for u, in points)


def _dispute_sources(spark, disputes, cases, claims, contacts, inspected):
    """Relations of which only the disputes and their context have rows."""
    fx = fixtures_for(spark, SMALL)
    tables = {f: getattr(fx, f).limit(0) for f in H.HistorySources.FIELDS}
    cols = ("unique_transaction_id", "user_dispute_claim_id", "user_dispute_claim_txn_id", "dispute_created_at",
            "authorization_code", "user_id", "transaction_code")
    keys = spark.createDataFrame([(u, c, x, START + dt.timedelta(hours=h), a, 1, "ADX") for u, c, x, h, a in disputes],
                                 "unique_transaction_id bigint, user_dispute_claim_id bigint, user_dispute_claim_txn_id bigint, "
                                 "dispute_created_at timestamp_ntz, authorization_code bigint, user_id bigint, transaction_code string")
    tables["disputed_txn"] = keys.crossJoin(fx.disputed_txn.limit(1).drop(*cols)).select(*fx.disputed_txn.columns)
    for name, rows in (("inspector_dispute", cases), ("dispute_claim", claims), ("dispute_contact", contacts),
                       ("inspector_txn", inspected)):
        if rows:
            tables[name] = spark.createDataFrame(rows, ", ".join(
                f"{f.name} {f.dataType.simpleString()}" for f in getattr(fx, name).schema))
    return H.HistorySources(**tables), H.AccountSet.of_ids(spark, [1])


def test_disputes_keep_the_first_context_of_tied_and_single_rows(spark):
    """Against all pairs: several cases, entries and contacts of a claim, inspected twice, NULLs, ties over claims."""
    from itertools import product

    from disputelens.functions.mappings import inspector_ext_id

    disputes = [(1, 10, 5, 0, 100), (2, 10, 6, 0, 200), (2, 11, 6, 0, 200), (3, 12, 7, 1, 300), (3, 10, 7, 0, 300),
                (4, 12, None, 0, 400), (4, 13, None, 0, 401), (5, None, 8, 0, 500), (6, 14, 9, 0, None),
                (7, 11, 9, 0, 700), (7, 11, 9, 0, 700), (8, 13, 1, 0, 401)]
    cases = [(900, "10", "fax"), (901, "10", "web"), (None, "11", "paper_mail"), (903, "11", None), (904, "13", "web"),
             (None, "14", "fax"), (905, None, "fax")]
    claims = [(10, "mobile"), (10, None), (10, "fax"), (12, None), (13, "mobile"), (None, "mobile")]
    contacts = [(10, "Filing", "b", None), (10, "Filing", "a>app", None), (10, "Filing", "a>app", "Phone"), (10, "Other", "a", "a"),
                (12, "Filing", None, "EMAIL"), (12, "Filing", "z", None), (None, "Filing", "a", "b")]
    ext = {a: spark.range(1).select(inspector_ext_id(F.lit("ADX"), F.lit(a).cast("bigint"))).first()[0] for a in (100, 200, 300, 401, 700)}
    inspected = [(900, ext[100], "deny"), (900, ext[100], "approve"), (901, ext[100], "aaa"), (900, ext[200], None),
                 (903, ext[200], "deny"), (903, ext[700], "x"), (904, ext[401], "approve"), (None, ext[300], "no")]
    src, acc = _dispute_sources(spark, disputes, cases, claims, contacts, inspected)
    low = lambda *v: [(x is None, x) if x is not None else (True, "") for x in v]
    want = {}
    for u in {r[0] for r in disputes}:
        found = []
        rows = [r for r in disputes if r[0] == u]
        top = max(rows, key=lambda r: (r[3], r[2] is None, r[2] or 0))
        for r in [r for r in rows if (r[3], r[2]) == (top[3], top[2])]:
            c = [x[0] for x in cases if r[1] is not None and x[1] == str(r[1])] or [None]
            e = [x[1] for x in claims if r[1] is not None and x[0] == r[1]] or [None]
            k = [x[2:] for x in contacts if r[1] is not None and x[0] == r[1] and x[1] == "Filing"] or [(None, None)]
            for i, d, m in product(c, e, k):
                t = [x[2] for x in inspected if i is not None and x[0] == i and x[1] == ext.get(r[4])] or [None]
                found += [(i, d, *m, y) for y in t]
        want[u] = min(found, key=lambda f: low(*f))
    got = H.hist_disputes_joined(src, acc).select(
        "unique_transaction_id", "r_inspector_dispute_id", "dc_intake_type", "mc_interactions_str_seq", "mc_contact_flow",
        "investigation_resolution").collect()
    assert len(got) == len(want) and {r[0]: tuple(r)[1:] for r in got} == want


def test_untied_disputes_pass_no_second_keep_first(spark, no_broadcasts):
    """The merchant's name passes the exchanges of the transaction, the claim and the inspected id, and no more."""
    fx = fixtures_for(spark, SMALL)
    joined = H.hist_disputes_joined(H.HistorySources.from_fixtures(fx), H.RoughAccounts.of_set(
        H.AccountSet.of(fx.member, "id"), lambda df: df))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    union = plan.index("Union")
    assert "hashpartitioning(unique_transaction_id" not in plan[:union]
    single = plan[union:plan.index("WindowGroupLimit", union)]
    assert single.count("hashpartitioning(_claim") == 1 and "_tied_claim" not in single


def test_scores_join_the_payments_and_not_the_postings(spark, no_broadcasts):
    fx = fixtures_for(spark, SMALL)
    acc = H.AccountSet.of(fx.member, "id")
    plan = H.hist_transfers(H.HistorySources.from_fixtures(fx), acc)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    joins_ = [line for line in lines if "SortMergeJoin" in line]
    assert "prs_pay_friend_id" not in joins_[0] and sum("prs_pay_friend_id" in line for line in joins_) == 1


def test_written_history_deletes_its_stored_feeds(spark, tmp_path):
    import os

    from disputelens.session import _tables_root

    fx = fixtures_for(spark, SMALL)
    src, acc = H.HistorySources.from_fixtures(fx), H.AccountSet.of_ids(spark, [3, 5])
    want = H.account_timeline(src, acc).collect()
    root = _tables_root(spark).removeprefix("file:")
    before = set(os.listdir(root))
    H.write_account_history(src, acc, str(tmp_path / "out"))
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, want))
    assert set(os.listdir(root)) == before
