"""Risk cut: approved contactless debit authorisations with override state and
dispute outcome, one row per authorisation event, and its uniqueness check.

Joins (all left outer, all keyed on a high-cardinality equality):
  auth ⟕ follow-up message   (user_id, original_auth_id = auth_id)
  ⟕ first fraud-rule override (user_id, hour segment), o.ts < created <= o.ts + 1 h
  ⟕ dispute                  (user_id, code) with code in {auth_id, follow-up auth_id}
then the first row per event by (follow-up desc, override time, dispute time).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from disputelens.functions import codes
from disputelens.functions.mappings import dispute_flags, merchant_state
from disputelens.functions.semantics import asc, day_diff, desc
from disputelens.operators.dedup import keep_first, uniqueness_check
from disputelens.operators.joins import either_key_join, interval_join, nearest_within, semi_join

AUTH_COLUMNS = (
    "auth_event_id", "user_id", "auth_event_created_ts", "account_status_cd", "card_status_cd",
    "available_funds", "card_network_cd", "card_sub_network_cd", "auth_event_merchant_name_raw",
    "req_amt", "final_amt", "trans_ts", "mti_cd", "merch_id", "mcc_cd", "risk_score",
    "pin_result_cd", "is_international", "acq_id", "entry_type", "is_card_present",
    "is_cardholder_present",
)


def eligible_auths(auth: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Approved contactless debit spend created on [start, end] (dates inclusive)."""
    return auth.filter(
        F.to_date("auth_event_created_ts").between(F.lit(start), F.lit(end))
        & F.col("entry_type").like("%Contactless%")
        & F.col("response_cd").isin(*codes.APPROVED_RESPONSE_CODES)
        & (F.col("req_amt") < 0))


def follow_ups(auth: DataFrame, followed: DataFrame) -> DataFrame:
    """Messages keyed by the authorisation that they follow.

    0 marks a first message. It follows nothing unless an authorisation has id 0,
    so first messages are kept for the accounts of ``followed`` that have one:
    without any, no account's first messages pile onto one join key.
    """
    zero = followed.filter(F.col("auth_id") == 0).select("user_id")
    firsts = auth.filter(F.col("original_auth_id") == 0)
    return (auth.filter(F.col("original_auth_id") != 0).unionByName(semi_join(firsts, zero, "user_id", "user_id"))
            .select(F.col("user_id").alias("dual_user_id"),
                    F.col("original_auth_id").alias("dual_original_auth_id"),
                    F.col("auth_id").alias("dual_auth_id"),
                    F.col("auth_event_id").alias("dual_auth_event_id")))


def join_dual(rae: DataFrame, auth: DataFrame) -> DataFrame:
    d = follow_ups(auth, rae)
    return rae.join(d, (F.col("user_id") == F.col("dual_user_id"))
                    & (F.col("auth_id") == F.col("dual_original_auth_id")), "left").drop("dual_user_id")


def join_override(df: DataFrame, overrides: DataFrame, ts_col: str = "auth_event_created_ts") -> DataFrame:
    o = (overrides.filter(F.col("type") == codes.OVERRIDE_DISABLE_RULES)
         .select(F.col("user_id").alias("o2_user_id"), F.col("type").alias("o2_type"),
                 F.col("timestamp").alias("o2_timestamp")))
    return interval_join(df, o, [("user_id", "o2_user_id")], ts_col,
                         F.col("o2_timestamp"), F.timestamp_add("HOUR", F.lit(1), F.col("o2_timestamp")),
                         lo_inclusive=False, hi_inclusive=True, bucket_seconds=3600).drop("o2_user_id")


def join_first_override(df: DataFrame, overrides: DataFrame, ts_col: str = "auth_event_created_ts") -> DataFrame:
    """``join_override`` cut to each row's earliest override, which is the one that the cut keeps; no pairs are formed."""
    o = (overrides.filter(F.col("type") == codes.OVERRIDE_DISABLE_RULES)
         .select(F.col("user_id").alias("o2_user_id"), F.col("timestamp").alias("o2_timestamp")))
    out = nearest_within(df, o, [("user_id", "o2_user_id")], ts_col, "o2_timestamp", 3600, last=False)
    return out.withColumn("o2_type", F.when(F.col("o2_timestamp").isNotNull(), codes.OVERRIDE_DISABLE_RULES))


DISPUTE_COLUMNS = ("unique_transaction_id", "user_dispute_claim_txn_id", "dispute_created_at",
                   "resolution_decision", "reason", "resolution")


def join_dispute(df: DataFrame, disputes: DataFrame, *, collapse: bool = True) -> DataFrame:
    d = disputes.select(F.col("user_id").alias("dt_user_id"),
                        F.col("authorization_code").alias("dt_authorization_code"),
                        *[F.col(c).alias(f"dt_{c}") for c in DISPUTE_COLUMNS])
    return either_key_join(df, d, [("user_id", "dt_user_id")], ["auth_id", "dual_auth_id"],
                           "dt_authorization_code", collapse=collapse).drop("dt_user_id")


def first_per_event(j: DataFrame) -> DataFrame:
    """One row per auth event: latest follow-up, then earliest override, then earliest dispute."""
    return keep_first(j, ["auth_event_id"], [
        desc("dual_original_auth_id"), asc("o2_timestamp"), asc("dt_dispute_created_at"),
        asc("dt_unique_transaction_id"), asc("dt_user_dispute_claim_txn_id"), asc("dual_auth_event_id")])


def risk_score_cut(auth: DataFrame, overrides: DataFrame, disputes: DataFrame,
                   start: dt.date, end: dt.date) -> DataFrame:
    rae = eligible_auths(auth, start, end)
    j = join_dual(rae, auth)
    j = join_first_override(j, overrides)
    # collapse=False: the keep-first below orders a real dispute match ahead of
    # the unmatched copy of the same (event, follow-up, override) row.
    j = join_dispute(j, disputes, collapse=False)
    j = first_per_event(j)
    matched = F.col("dt_unique_transaction_id").isNotNull()
    flags = dispute_flags(matched, "dt_reason", "dt_resolution", "dt_resolution_decision")
    return j.select(
        *[F.col(c).alias("card_status_at_txn") if c == "card_status_cd" else F.col(c) for c in AUTH_COLUMNS],
        F.col("o2_type").alias("dfe_rule_disable_status"),
        F.col("o2_timestamp").alias("dfe_rule_disable_time"),
        merchant_state("card_network_cd", "auth_event_merchant_name_raw").alias("merchant_state"),
        F.col("dt_dispute_created_at").alias("dispute_created_at"),
        F.col("dt_resolution_decision").alias("resolution_decision"),
        flags["dispute_ind"].alias("dispute_ind"),
        F.when(matched, day_diff("auth_event_created_ts", "dt_dispute_created_at")).alias("dispute_txn_daydiff"),
        flags["dispute_unauth_ind"].alias("dispute_unauth_ind"),
        flags["dispute_unauth_pending_ind"].alias("dispute_unauth_pending_ind"),
        flags["dispute_aprv_ind"].alias("dispute_aprv_ind"),
        flags["dispute_unauth_aprv_ind"].alias("dispute_unauth_aprv_ind"),
    )


def risk_cut_check(cut: DataFrame) -> DataFrame:
    return uniqueness_check(cut, "auth_event_id")
