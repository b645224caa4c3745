"""Registered queries: key -> callable(spark, sf_dir) -> DataFrame.

Every query reads the driver tables of ``sf_dir`` through ``Fixtures`` and
runs over all of their rows; only the analyses' own parameters (dates, top-n
sizes, the account set) shape the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from disputelens.plans import params as P
from disputelens.plans.dispute_wow import (
    detail_base, detail_of, dispute_wow_summary, report_tables, run_dispute_wow, wow_window_cols,
)
from disputelens.plans.operator_queries import OPS
from disputelens.plans.history import FEEDS, AccountSet, HistorySources, account_history, history_points
from disputelens.plans.risk_cut import risk_cut_check, risk_score_cut
from disputelens.plans.weekly_cases import weekly_top_cases
from disputelens.session import BYTES_PER_PARTITION, materialize, partitions_for, scratch_folder, size_shuffles
from disputelens.sources.bucketed import BucketedSources
from disputelens.sources.fixtures import Fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


_FIXTURES: dict[tuple[str, str], Fixtures] = {}


def fixtures_for(spark: SparkSession, sf_dir: str) -> Fixtures:
    """One ``Fixtures`` per (session, sf_dir): its relation plans are built once."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _FIXTURES:
        _FIXTURES[key] = Fixtures(spark, sf_dir)
    return _FIXTURES[key]


def register(key: str):
    def deco(fn: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            fx = fixtures_for(spark, sf_dir)
            size_shuffles(spark, fx.source_bytes)
            return fn(fx)

        QUERIES[key] = run
        return fn
    return deco


# --- jobs ---------------------------------------------------------------------

@register("weekly_top_cases")
def q_weekly_top_cases(fx: Fixtures) -> DataFrame:
    return weekly_top_cases(fx.disputed_txn, fx.inspector_dispute, fx.inspector_txn, P.AS_OF, P.TOP_CASES)


def _risk_cut(fx: Fixtures) -> DataFrame:
    return risk_score_cut(fx.auth_event, fx.member_override, fx.disputed_txn, P.RISK_START, P.RISK_END)


@register("risk_score_cut")
def q_risk_score_cut(fx: Fixtures) -> DataFrame:
    return _risk_cut(fx)


@register("risk_cut_check")
def q_risk_cut_check(fx: Fixtures) -> DataFrame:
    return risk_cut_check(_risk_cut(fx))


def _wow_detail(fx: Fixtures | BucketedSources) -> DataFrame:
    """The detail on a base written first, as the procedure does (it is read several times)."""
    day1, day2 = P.wow_window(P.AS_OF)
    base = materialize(detail_base(fx.settled_txn, fx.disputed_txn, fx.auth_event, fx.dim_member,
                                   day1, day2, P.DISPUTE_WIN, P.AS_OF))
    return detail_of(base, fx.login_alert, day1, day2, P.TOP_MCC, P.TOP_MERCHANT, P.TOP_STATE)


@register("risk_cut_stored_check")
def q_risk_cut_stored_check(fx: Fixtures) -> DataFrame:
    """The check of a cut that was stored as a table."""
    return risk_cut_check(materialize(_risk_cut(fx)))


@register("dispute_wow_detail")
def q_dispute_wow_detail(fx: Fixtures) -> DataFrame:
    return _wow_detail(fx)


def fact_buckets(source_bytes: int) -> int:
    """``P.BUCKETS`` at the test data's size; doubled with a larger input, so that a bucket fits a task."""
    n = P.BUCKETS
    while n * BYTES_PER_PARTITION < source_bytes:
        n *= 2
    return n


@register("dispute_wow_bucketed")
def q_dispute_wow_bucketed(fx: Fixtures) -> DataFrame:
    """The detail from facts that are stored in buckets of their join keys."""
    spark = fx.src.spark
    folder = scratch_folder(spark, "facts")
    facts = BucketedSources.store(spark, fx, folder, folder.rsplit("/", 1)[-1].replace("-", "_"),
                                  fact_buckets(fx.source_bytes))
    detail = _wow_detail(facts)
    facts.drop()
    return detail


@register("dispute_wow_summary")
def q_dispute_wow_summary(fx: Fixtures) -> DataFrame:
    return dispute_wow_summary(_wow_detail(fx))


@register("dispute_wow_run")
def q_dispute_wow_run(fx: Fixtures) -> DataFrame:
    """The scheduled procedure: write the detail, read it back, write the summary; the written summary."""
    spark = fx.src.spark
    day1, day2 = P.wow_window(P.AS_OF)
    out = scratch_folder(spark, "wow-run")
    run_dispute_wow(spark, fx, out, day1, day2, P.DISPUTE_WIN, P.AS_OF)
    return spark.read.parquet(report_tables(spark, out)[1])


@register("wow_window")
def q_wow_window(fx: Fixtures) -> DataFrame:
    """The report window for every settled date taken as a run date."""
    runs = fx.settled_txn.select(F.to_date("transaction_timestamp").alias("as_of")).distinct()
    day1, day2 = wow_window_cols(F.col("as_of"))
    return runs.select("as_of", day1.alias("day1"), day2.alias("day2"))


# --- account history: the account set is every member ----------------------------

def all_members(fx: Fixtures) -> AccountSet:
    """Every member as the account set."""
    acc = fx.__dict__.get("_all_members")
    if acc is None:
        acc = fx.__dict__["_all_members"] = AccountSet.of(fx.member, "id")
    return acc


@register("account_history")
def q_account_history(fx: Fixtures) -> DataFrame:
    src, acc = HistorySources.from_fixtures(fx), all_members(fx)
    return account_history(src, acc, keep=materialize, points=history_points(
        src, acc, ranges=partitions_for(fx.src.spark, fx.source_bytes)))


@register("account_history_subset")
def q_account_history_subset(fx: Fixtures) -> DataFrame:
    """The pull of a few accounts, given as text ids of which one is malformed."""
    ids = fx.member.filter(F.col("id") < P.SUBSET_BELOW).select(F.col("id").cast("string").alias("user_id"))
    ids = ids.union(ids.limit(1).select(F.lit("not-an-id").alias("user_id")))
    return account_history(HistorySources.from_fixtures(fx), ids)


def _feed(fn):
    def run(fx: Fixtures) -> DataFrame:
        return fn(HistorySources.from_fixtures(fx), all_members(fx))
    return run


for _key, _fn in FEEDS:
    register(_key)(_feed(_fn))


# --- single operators ----------------------------------------------------------------

for _key, _fn in OPS.items():
    register(_key)(_fn)


def queries() -> dict[str, Query]:
    return dict(QUERIES)
