"""Week-over-week dispute report: a detail table and a 17-key segment summary.

detail (31 columns)
  base   settled transactions of [day1, day2], mature for ``dispute_win`` days,
         purchase or ATM codes, ⟕ disputes, ⟕ auths, ⟕ member (fan-out kept);
         26 columns. The run writes it once: everything below reads it.
  labels top MCC / merchant / merchant state per product, ranked by 7-day
         disputed dollars in the latest week of the base; one scan ranks all
         three, and a scalar map of the ranks labels the rows.
  score  highest login-alert score in the 7 days up to each transaction.
summary  ``groupBy(17 keys)`` over the materialised detail, 2 sums.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from disputelens.functions import codes
from disputelens.functions.mappings import (
    amount_bucket, dispute_within, login_flag, login_score_bucket, product_type, risk_bucket,
    settled_merchant_state, tenure_bucket,
)
from disputelens.functions.semantics import month_diff, week_start
from disputelens.operators.joins import running_max_within
from disputelens.operators.topn import rank_groups, top_label
from disputelens.session import materialized
from disputelens.sources.versions import current_version, new_version

# label specs: (value column, rank column, label column, top n)
LABELS = (
    ("mcc_cd", "rnk_mcc", "top_mcc_cd"),
    ("merchant_name_raw", "rnk_mrch", "top_merchant_name_raw"),
    ("merchant_state_cd", "rnk_mrch_state", "top_merchant_state_cd"),
)
SUMMARY_KEYS = (
    "txn_week", "card_type", "customer_state_cd", "top_merchant_state_cd", "cust_mrch_state_diff",
    "mob_cat", "card_network_cd", "new_dvc_login_ind", "atom_score_cat", "top_mcc_cd",
    "top_merchant_name_raw", "transaction_cd", "unique_program_id", "settled_amt_cat",
    "risk_score_cat", "entry_type", "is_international",
)


def report_scope(settled: DataFrame, day1: dt.date, day2: dt.date, dispute_win: int,
                 as_of: dt.date) -> DataFrame:
    """Settled rows in the window, mature, with a purchase or ATM code.

    ``datediff(day, ts, as_of) >= win`` is written as ``date(ts) <= as_of - win``:
    the same rows, but a range Catalyst pushes into the scan.
    """
    last_mature = as_of - dt.timedelta(days=dispute_win)
    d = F.to_date("transaction_timestamp")
    return settled.filter(d.between(F.lit(day1), F.lit(day2)) & (d <= F.lit(last_mature))
                          & F.col("transaction_cd").isin(*codes.REPORT_CODES))


def detail_base(settled: DataFrame, disputes: DataFrame, auth: DataFrame, members: DataFrame,
                day1: dt.date, day2: dt.date, dispute_win: int, as_of: dt.date) -> DataFrame:
    a = report_scope(settled, day1, day2, dispute_win, as_of)
    d = disputes.select(F.col("user_id").alias("d_user_id"),
                        F.col("authorization_code").alias("d_authorization_code"),
                        F.col("dispute_created_at").alias("d_dispute_created_at"),
                        F.col("reason"), F.col("resolution_code"), F.col("close_code"),
                        F.col("updated_transaction_amount").alias("d_updated_transaction_amount"))
    r = auth.select(F.col("user_id").alias("rae_user_id"), F.col("auth_id").alias("rae_auth_id"),
                    "risk_score", "is_international", "card_network_cd", "entry_type")
    m = members.select(F.col("user_id").alias("m_user_id"), F.col("state_cd").alias("customer_state_cd"),
                       "enrollment_initiated_ts")
    j = (a.join(d, (F.col("user_id") == F.col("d_user_id"))
                & (F.col("authorization_code") == F.col("d_authorization_code")), "left")
         .join(r, (F.col("user_id") == F.col("rae_user_id"))
               & (F.col("authorization_code") == F.col("rae_auth_id")), "left")
         .join(m, F.col("user_id") == F.col("m_user_id"), "left"))
    settled_neg = (F.col("settled_amt") * -1).cast("decimal(18,2)")
    months = month_diff("enrollment_initiated_ts", "transaction_timestamp")
    return j.select(
        "user_id", "authorization_code", "transaction_timestamp", "customer_state_cd",
        settled_merchant_state("merchant_name_raw").alias("merchant_state_cd"),
        (F.col("customer_state_cd") != settled_merchant_state("merchant_name_raw")).alias("cust_mrch_state_diff"),
        week_start("transaction_timestamp").alias("txn_week"),
        product_type("transaction_cd", "unique_program_id").alias("card_type"),
        months.alias("mondiff_enrollinit_auth"),
        tenure_bucket(months).alias("mob_cat"),
        "merchant_name_raw", "transaction_cd", "unique_program_id",
        settled_neg.alias("settled_amt"),
        amount_bucket(settled_neg).alias("settled_amt_cat"),
        "mcc_cd", "risk_score", "is_international", "card_network_cd",
        risk_bucket("risk_score").alias("risk_score_cat"),
        "entry_type",
        dispute_within("d_dispute_created_at", "transaction_timestamp", dispute_win).alias("dispute_ind_7d"),
        "reason", "resolution_code", "close_code",
        F.coalesce(F.col("d_updated_transaction_amount"), settled_neg).cast("decimal(18,2)")
        .alias("updated_transaction_amount"),
    )


def latest_week_disputed(base: DataFrame) -> DataFrame:
    """7-day-disputed rows of the latest transaction week (a scalar subquery)."""
    latest = base.select(F.max("txn_week")).scalar()
    return base.filter((F.col("dispute_ind_7d") == 1) & (F.col("txn_week") == latest))


def add_top_labels(base: DataFrame, n_mcc: int, n_merchant: int, n_state: int) -> DataFrame:
    """Three '<rank>.<value>' labels; rows outside the top n get '99.others'.

    One scan of the latest week ranks all three lists. They hold at most n rows
    per product type each, so they become one small map, a scalar that every row
    looks its labels up in: no join touches the base.
    """
    tops = dict(zip([label for _, _, label in LABELS], (n_mcc, n_merchant, n_state)))
    entries = F.array(*[F.struct(F.lit(label).alias("label"), F.col(value).cast("string").alias("value"))
                        for value, _, label in LABELS])
    long = latest_week_disputed(base).select("card_type", "settled_amt", F.inline(entries))
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in tops.items() for x in pair]), F.col("label"))
    ranked = rank_groups(long, ["label", "card_type"], "value", "settled_amt", limit, "place",
                         most=max(tops.values()))
    key = F.struct("label", "card_type", "value")
    places = ranked.where(F.col("value").isNotNull()).select(
        F.map_from_entries(F.collect_list(F.struct(key, F.col("place"))))).scalar()
    out = base
    for value, _, label in LABELS:
        place = F.element_at(places, F.struct(F.lit(label).alias("label"), F.col("card_type"),
                                              F.col(value).cast("string").alias("value")))
        out = out.withColumn(label, top_label(place, value, tops[label]))
    return out


def alerts_in_reach(alerts: DataFrame, day1: dt.date, day2: dt.date) -> DataFrame:
    """Alerts in [day1 - 7 d, day2 + 1 d): no other can match a transaction of the window."""
    lo = dt.datetime.combine(day1 - dt.timedelta(days=7), dt.time())
    hi = dt.datetime.combine(day2 + dt.timedelta(days=1), dt.time())
    return alerts.filter((F.col("session_timestamp") >= F.lit(str(lo)).cast("timestamp_ntz"))
                         & (F.col("session_timestamp") < F.lit(str(hi)).cast("timestamp_ntz")))


def login_scores(base: DataFrame, alerts: DataFrame) -> DataFrame:
    """max(score > 0) of alerts with txn_ts - 7 d <= session_ts <= txn_ts, per (user, code).

    The maximum comes from maxima per hour and running maxima at the two ends, so
    an account with very many transactions and alerts is never paired up.
    """
    ts = "transaction_timestamp"
    txns = base.select("user_id", "authorization_code", ts).distinct()
    al = alerts.filter(F.col("score") > 0).select("user_id", F.col("session_timestamp").alias(ts), "score")
    return running_max_within(txns, al, "user_id", ts, "score", seconds=7 * 86400, by=["user_id", "authorization_code"])


def dispute_wow_detail(settled: DataFrame, disputes: DataFrame, auth: DataFrame, members: DataFrame,
                       alerts: DataFrame, day1: dt.date, day2: dt.date, dispute_win: int,
                       as_of: dt.date, n_mcc: int = 9, n_merchant: int = 20, n_state: int = 9) -> DataFrame:
    """The report's rows, lazily. ``detail_of`` takes a base that was written first."""
    base = detail_base(settled, disputes, auth, members, day1, day2, dispute_win, as_of)
    return detail_of(base, alerts, day1, day2, n_mcc, n_merchant, n_state)


def detail_of(base: DataFrame, alerts: DataFrame, day1: dt.date, day2: dt.date,
              n_mcc: int = 9, n_merchant: int = 20, n_state: int = 9) -> DataFrame:
    """Labels and login scores on a base that is read several times."""
    t2 = add_top_labels(base, n_mcc, n_merchant, n_state)
    t3 = (login_scores(base, alerts_in_reach(alerts, day1, day2))
          .select(F.col("user_id").alias("s_user_id"), F.col("authorization_code").alias("s_code"), "score"))
    out = t2.join(t3, (F.col("user_id") == F.col("s_user_id")) & (F.col("authorization_code") == F.col("s_code")),
                  "left")
    return out.select(*[c for c in t2.columns],
                      login_flag("score").alias("new_dvc_login_ind"),
                      login_score_bucket("score").alias("atom_score_cat"))


def dispute_wow_summary(detail: DataFrame) -> DataFrame:
    settled = F.col("settled_amt")
    return (detail.groupBy(*[week_start("transaction_timestamp").alias("txn_week") if k == "txn_week" else F.col(k)
                             for k in SUMMARY_KEYS])
            .agg(F.sum(settled).cast("decimal(38,2)").alias("settled_amt_sum"),
                 F.sum(F.when(F.col("dispute_ind_7d") == 1, settled).otherwise(F.lit(0)))
                 .cast("decimal(38,2)").alias("dispute_amt_sum")))


def wow_window_cols(as_of: Column) -> tuple[Column, Column]:
    """(day1, day2) of a run on ``as_of`` (DATE column)."""
    day1 = week_start(F.date_sub(as_of, 35))
    day2 = F.date_sub(week_start(F.date_sub(as_of, 7)), 1)
    return day1, day2


def run_dispute_wow(spark, sources, out_dir: str, day1: dt.date, day2: dt.date, dispute_win: int = 7,
                    as_of: dt.date | None = None) -> None:
    """The scheduled procedure: write the detail, read it back, write the summary.

    ``sources`` provides ``settled_txn, disputed_txn, auth_event, dim_member,
    login_alert``. Both outputs are parquet partitioned by week. They are written
    to a new version's folder and become the current ones together, by one
    rename, when both are complete; ``report_tables`` names them. A run that is
    lost leaves the former version as it was. The summary is computed
    from the written detail, so the detail's joins run once.
    """
    as_of = as_of or spark.sql("SELECT current_date()").first()[0]
    with new_version(spark, out_dir) as version:
        detail_path, summary_path = f"{version}/{DETAIL}", f"{version}/{SUMMARY}"
        with materialized(detail_base(sources.settled_txn, sources.disputed_txn, sources.auth_event, sources.dim_member,
                                      day1, day2, dispute_win, as_of)) as base:
            # a week's rows meet in a few files of even size
            (detail_of(base, sources.login_alert, day1, day2).hint("rebalance", "txn_week")
             .write.partitionBy("txn_week").parquet(detail_path))
        summary = dispute_wow_summary(spark.read.parquet(detail_path))
        summary.write.partitionBy("txn_week").parquet(summary_path)


DETAIL, SUMMARY = "dispute_wow_detail", "dispute_wow_summary"


def report_tables(spark, out_dir: str) -> tuple[str, str]:
    """Paths of the current detail and summary."""
    version = current_version(spark, out_dir)
    return f"{version}/{DETAIL}", f"{version}/{SUMMARY}"
