"""Registered queries for the single operators of the inventory.

Each runs one operator over the full derived relations and returns the key of
the driving row plus the computed columns, so it can be checked on its own
against the DuckDB oracle. The jobs use the very same functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from disputelens.functions import codes
from disputelens.functions import mappings as M
from disputelens.functions.semantics import (
    asc, day_diff, desc, ilike_any, labelled, local_time, minute_start, month_diff, safe_number,
    second_diff, week_start,
)
from disputelens.operators.dedup import keep_first
from disputelens.operators.joins import any_party_join, interval_join, semi_join
from disputelens.plans import params as P
from disputelens.plans.dispute_wow import dispute_wow_detail, login_scores
from disputelens.plans.history import (
    HistorySources, hist_auths_joined, hist_disputes_joined, join_places, join_rules,
)
from disputelens.plans.risk_cut import first_per_event, join_dispute, join_dual, join_override
from disputelens.plans.weekly_cases import last_complete_week, ntz
from disputelens.sources.fixtures import Fixtures

C = F.col
OPS: dict[str, callable] = {}


def op(key: str):
    def deco(fn):
        OPS[key] = fn
        return fn
    return deco


# --- joins -------------------------------------------------------------------------------

def first_messages(fx: Fixtures) -> DataFrame:
    return fx.auth_event.filter(C("original_auth_id") == 0)


@op("join_dual_message")
def join_dual_message(fx: Fixtures) -> DataFrame:
    return join_dual(fx.auth_event, fx.auth_event).select(
        "auth_event_id", "auth_id", "dual_auth_id", "dual_auth_event_id")


@op("join_override_1h")
def join_override_1h(fx: Fixtures) -> DataFrame:
    return join_override(fx.auth_event, fx.member_override).select(
        "auth_event_id", C("o2_timestamp").alias("override_ts"))


@op("join_dispute_either_code")
def join_dispute_either_code(fx: Fixtures) -> DataFrame:
    j = join_dispute(join_dual(fx.auth_event, fx.auth_event), fx.disputed_txn, collapse=True)
    return j.select("auth_event_id", "dual_auth_event_id",
                    C("dt_unique_transaction_id").alias("unique_transaction_id"),
                    C("dt_user_dispute_claim_txn_id").alias("user_dispute_claim_txn_id"),
                    C("dt_dispute_created_at").alias("dispute_created_at"))


def _claim_join(fx: Fixtures) -> DataFrame:
    d = fx.disputed_txn
    i = fx.inspector_dispute.select(C("id").alias("r_inspector_dispute_id"),
                                    C("claim_ext_id").cast("string").alias("_claim_ext_id"))
    return d.join(i, d.user_dispute_claim_id.cast("string") == C("_claim_ext_id"), "left").drop("_claim_ext_id")


@op("join_claim_text_key")
def join_claim_text_key(fx: Fixtures) -> DataFrame:
    return _claim_join(fx).select("unique_transaction_id", "user_dispute_claim_txn_id", "dispute_created_at",
                                  "r_inspector_dispute_id")


@op("join_composite_ext_id")
def join_composite_ext_id(fx: Fixtures) -> DataFrame:
    d = _claim_join(fx).withColumn("ext_id", M.inspector_ext_id("transaction_code", "authorization_code"))
    t = fx.inspector_txn.select(C("dispute_id").alias("_t_dispute_id"), C("transaction_ext_id").alias("_t_ext_id"),
                                "investigation_resolution")
    j = d.join(t, (C("r_inspector_dispute_id") == C("_t_dispute_id")) & (C("ext_id") == C("_t_ext_id")), "left")
    return j.select("unique_transaction_id", "user_dispute_claim_txn_id", "dispute_created_at", "ext_id",
                    "investigation_resolution")


@op("join_peer_transfer")
def join_peer_transfer(fx: Fixtures) -> DataFrame:
    t = fx.posted_txn.select("authorization_code", "user_id",
                             minute_start("transaction_timestamp").alias("_minute"),
                             F.abs("settled_amt").alias("_abs_amt"))
    pf = fx.pay_friend.select(C("id").alias("pf_id"), C("sender_id").alias("pf_sender_id"),
                              C("receiver_id").alias("pf_receiver_id"), F.abs("amount").alias("pf_amount"),
                              minute_start("created_at").alias("pf_minute"),
                              M.transfer_kind("type_code").alias("txn_type"))
    j = any_party_join(t, pf, "user_id", ["pf_sender_id", "pf_receiver_id"],
                       [("_minute", "pf_minute"), ("_abs_amt", "pf_amount")])
    return j.select("authorization_code", "pf_id", "txn_type")


@op("join_card_last4")
def join_card_last4(fx: Fixtures) -> DataFrame:
    a = fx.auth_event.select("auth_event_id", "user_id", F.right(C("pan"), F.lit(4)).alias("_l4"))
    c = fx.card.select(C("user_id").alias("_cu"), F.right(C("card_number"), F.lit(4)).alias("_cl4"), "card_id")
    return (a.join(c, (C("user_id") == C("_cu")) & (C("_l4") == C("_cl4")), "left")
            .select("auth_event_id", "card_id"))


@op("join_auth_decision")
def join_auth_decision(fx: Fixtures) -> DataFrame:
    return join_rules(fx.auth_event, fx.auth_decision).select(
        "auth_event_id", C("rta2_policy_name").alias("policy_name"), C("rta2_decision_outcome").alias("decision_outcome"))


@op("join_ip_geo")
def join_ip_geo(fx: Fixtures) -> DataFrame:
    return join_places(fx.user_session, fx.ip_geo_map, fx.geo_city).select(
        "user_id", "session_timestamp", "ip", C("loc_time_zone").alias("time_zone"))


def _session_logins(fx: Fixtures) -> DataFrame:
    lr = fx.login_request.select(C("user_id").alias("lr_user_id"), C("segment_device_id").alias("lr_device_id"),
                                 C("login_success_at").alias("login_success_at"))
    s = C("login_success_at")
    return interval_join(fx.user_session.select("user_id", "session_timestamp", "device_id"), lr,
                         [("user_id", "lr_user_id"), ("device_id", "lr_device_id")], "session_timestamp",
                         s, F.timestamp_add("SECOND", F.lit(60), s),
                         lo_inclusive=True, hi_inclusive=True, bucket_seconds=60)


@op("join_login_60s")
def join_login_60s(fx: Fixtures) -> DataFrame:
    return _session_logins(fx).select("user_id", "session_timestamp", "device_id", "login_success_at")


@op("join_alert_7d")
def join_alert_7d(fx: Fixtures) -> DataFrame:
    return login_scores(fx.settled_txn, fx.login_alert)


@op("semi_join_users")
def semi_join_users(fx: Fixtures) -> DataFrame:
    some = fx.member.filter(C("id") < P.SUBSET_BELOW)
    return semi_join(fx.posted_txn, some, "user_id", "id").select("authorization_code", "user_id")


@op("user_set")
def user_set(fx: Fixtures) -> DataFrame:
    return fx.member.select(C("id").cast("string").alias("user_id")).distinct()


# --- filters -------------------------------------------------------------------------------

@op("filter_in_list")
def filter_in_list(fx: Fixtures) -> DataFrame:
    return (fx.settled_txn.filter(C("transaction_cd").isin(*codes.REPORT_CODES))
            .select("authorization_code", "transaction_cd"))


@op("filter_not_in_list")
def filter_not_in_list(fx: Fixtures) -> DataFrame:
    return (fx.posted_txn.filter(~C("description").isin(*codes.EXCLUDED_POSTING_DESCRIPTIONS)
                                 & ~C("mcc_cd").isin(*codes.WITHDRAWAL_MCCS))
            .select("authorization_code", "description", "mcc_cd"))


@op("filter_date_between")
def filter_date_between(fx: Fixtures) -> DataFrame:
    day1, day2 = P.wow_window(P.AS_OF)
    return (fx.settled_txn.filter(F.to_date("transaction_timestamp").between(F.lit(day1), F.lit(day2)))
            .select("authorization_code", "transaction_timestamp"))


@op("filter_mature")
def filter_mature(fx: Fixtures) -> DataFrame:
    return (fx.settled_txn.filter(day_diff("transaction_timestamp", F.lit(P.AS_OF)) >= P.DISPUTE_WIN)
            .select("authorization_code", "transaction_timestamp"))


@op("filter_last_week")
def filter_last_week(fx: Fixtures) -> DataFrame:
    lo, hi = last_complete_week(P.AS_OF)
    d = fx.disputed_txn.filter((C("dispute_created_at") >= ntz(lo)) & (C("dispute_created_at") < ntz(hi)))
    return d.select("user_dispute_claim_txn_id", "dispute_created_at")


@op("filter_latest_week")
def filter_latest_week(fx: Fixtures) -> DataFrame:
    s = fx.settled_txn.withColumn("txn_week", week_start("transaction_timestamp"))
    latest = s.select(F.max("txn_week")).scalar()
    return s.filter(C("txn_week") == latest).select("authorization_code", "txn_week")


@op("filter_ilike_any")
def filter_ilike_any(fx: Fixtures) -> DataFrame:
    v = fx.version_change.withColumn("item_change", M.changed_field("object_changes"))
    return v.filter(ilike_any("item_change", codes.PROFILE_CHANGE_FIELDS)).select("versions_id", "item_change")


# --- dedups ---------------------------------------------------------------------------------

@op("dedup_auth_event")
def dedup_auth_event(fx: Fixtures) -> DataFrame:
    j = join_dual(fx.auth_event, fx.auth_event)
    j = join_override(j, fx.member_override)
    j = join_dispute(j, fx.disputed_txn, collapse=False)
    j = first_per_event(j)
    return j.select("auth_event_id", "dual_auth_id", C("o2_timestamp").alias("override_ts"),
                    C("dt_unique_transaction_id").alias("unique_transaction_id"),
                    C("dt_dispute_created_at").alias("dispute_created_at"))


@op("dedup_auth_response")
def dedup_auth_response(fx: Fixtures) -> DataFrame:
    o = fx.fraud_override.select(C("user_id").alias("o_user_id"), C("realtime_auth_id").alias("o_auth_id"),
                                 C("response_received_at"), C("response_signal"), C("decision_id"))
    j = first_messages(fx).select("auth_event_id", "user_id", "auth_id").join(
        o, (C("user_id") == C("o_user_id")) & (C("auth_id") == C("o_auth_id")), "left")
    j = keep_first(j, ["auth_event_id"], [asc("response_received_at"), asc("decision_id"), asc("response_signal")])
    return j.select("auth_event_id", "response_received_at", "response_signal")


@op("dedup_dispute")
def dedup_dispute(fx: Fixtures) -> DataFrame:
    d = keep_first(fx.disputed_txn, ["unique_transaction_id"],
                   [desc("dispute_created_at"), desc("user_dispute_claim_txn_id")])
    return d.select("unique_transaction_id", "user_dispute_claim_txn_id", "dispute_created_at")


@op("dedup_login")
def dedup_login(fx: Fixtures) -> DataFrame:
    j = keep_first(_session_logins(fx), ["user_id", "session_timestamp", "device_id"], [desc("login_success_at")])
    return j.select("user_id", "session_timestamp", "device_id", "login_success_at")


# --- top-n labels -------------------------------------------------------------------------------

@op("label_top_n")
def label_top_n(fx: Fixtures) -> DataFrame:
    day1, day2 = P.wow_window(P.AS_OF)
    d = dispute_wow_detail(fx.settled_txn, fx.disputed_txn, fx.auth_event, fx.dim_member, fx.login_alert,
                           day1, day2, P.DISPUTE_WIN, P.AS_OF, P.LABEL_TOP, P.LABEL_TOP, P.LABEL_TOP)
    return d.select("authorization_code", "top_mcc_cd", "top_merchant_name_raw", "top_merchant_state_cd")


# --- mappings and buckets ------------------------------------------------------------------------

@op("map_merchant_state")
def map_merchant_state(fx: Fixtures) -> DataFrame:
    return fx.auth_event.select("auth_event_id", "card_network_cd",
                                M.merchant_state("card_network_cd", "auth_event_merchant_name_raw")
                                .alias("merchant_state"))


@op("map_product")
def map_product(fx: Fixtures) -> DataFrame:
    return fx.settled_txn.select("authorization_code", "transaction_cd", "unique_program_id",
                                 M.product_type("transaction_cd", "unique_program_id").alias("card_type"))


@op("bucket_tenure")
def bucket_tenure(fx: Fixtures) -> DataFrame:
    m = fx.dim_member.select(C("user_id").alias("_mu"), "enrollment_initiated_ts")
    j = fx.settled_txn.join(m, C("user_id") == C("_mu"), "left")
    months = month_diff("enrollment_initiated_ts", "transaction_timestamp")
    return j.select("authorization_code", months.alias("mondiff_enrollinit_auth"), M.tenure_bucket(months).alias("mob_cat"))


@op("bucket_amount")
def bucket_amount(fx: Fixtures) -> DataFrame:
    neg = (C("settled_amt") * -1).cast("decimal(18,2)")
    return fx.settled_txn.select("authorization_code", neg.alias("settled_amt"),
                                 M.amount_bucket(neg).alias("settled_amt_cat"))


@op("bucket_risk")
def bucket_risk(fx: Fixtures) -> DataFrame:
    return fx.auth_event.select("auth_event_id", "risk_score", M.risk_bucket("risk_score").alias("risk_score_cat"))


@op("bucket_login_score")
def bucket_login_score(fx: Fixtures) -> DataFrame:
    a = fx.login_alert
    score = F.when(C("score") > 0, C("score"))
    return a.select("user_id", "device_id", "session_timestamp", "score",
                    M.login_flag(score).alias("new_dvc_login_ind"),
                    M.login_score_bucket(score).alias("atom_score_cat"))


@op("dispute_within_n")
def dispute_within_n(fx: Fixtures) -> DataFrame:
    return fx.disputed_txn.select(
        "user_dispute_claim_txn_id",
        M.dispute_within("dispute_created_at", "transaction_timestamp", P.DISPUTE_WIN).alias("dispute_ind_7d"))


@op("map_txn_family")
def map_txn_family(fx: Fixtures) -> DataFrame:
    return fx.disputed_txn.select("user_dispute_claim_txn_id", "transaction_code",
                                  M.txn_family("transaction_code").alias("transaction_id"),
                                  M.inspector_ext_id("transaction_code", "authorization_code").alias("ext_id"))


@op("map_intake_channel")
def map_intake_channel(fx: Fixtures) -> DataFrame:
    from disputelens.plans.registry import all_members

    j = hist_disputes_joined(HistorySources.from_fixtures(fx), all_members(fx))
    return j.select("unique_transaction_id", "intake_type")


@op("dispute_flags")
def dispute_flags(fx: Fixtures) -> DataFrame:
    flags = M.dispute_flags(F.lit(True), "reason", "resolution", "resolution_decision")
    return fx.disputed_txn.select(
        "user_dispute_claim_txn_id",
        day_diff("transaction_timestamp", "dispute_created_at").alias("dispute_txn_daydiff"),
        *[v.alias(k) for k, v in flags.items() if k != "dispute_ind"])


@op("map_account_type")
def map_account_type(fx: Fixtures) -> DataFrame:
    c = fx.card.select(C("card_id").alias("_cid"), C("user_id").alias("_cu"), "card_number")
    j = fx.posted_txn.join(c, (C("card_id").cast("string") == C("_cid")) & (C("_cu") == C("user_id")), "left")
    return j.select("authorization_code", M.account_type("unique_program_id", "card_id", "card_number")
                    .alias("card_type"))


@op("map_decline_reason")
def map_decline_reason(fx: Fixtures) -> DataFrame:
    return fx.auth_event.select("auth_event_id", "response_cd",
                                M.decline_reason("response_cd").alias("decline_resp_cd"))


@op("map_rule_outcome")
def map_rule_outcome(fx: Fixtures) -> DataFrame:
    from disputelens.plans.registry import all_members

    j = hist_auths_joined(HistorySources.from_fixtures(fx), all_members(fx))
    return j.select("auth_event_id", M.rule_outcome("response_cd", "rta2_policy_name", "rta2_decision_outcome",
                                                    "o_decision_id", "o_is_suppressed", "o_response_signal")
                    .alias("rules_denied"))


# --- string, number and time functions ----------------------------------------------------------

@op("str_concat")
def str_concat(fx: Fixtures) -> DataFrame:
    lr = fx.login_request
    return lr.select("user_id", "login_started_at", "segment_device_id",
                     F.concat(F.lit("FALIED RSN: "), C("tfa_method_deprecated"), F.lit("; PLATFORM: "),
                              C("platform")).alias("description"),
                     F.concat(C("segment_device_id"), F.lit(" "), C("tfa_method")).alias("device_method"))


@op("str_right")
def str_right(fx: Fixtures) -> DataFrame:
    return fx.auth_event.select("auth_event_id", F.right(C("pan"), F.lit(4)).alias("pan_l4d"))


@op("str_split_part")
def str_split_part(fx: Fixtures) -> DataFrame:
    return fx.version_change.select("versions_id", M.changed_field("object_changes").alias("item_change"))


@op("str_login_desc")
def str_login_desc(fx: Fixtures) -> DataFrame:
    s = fx.user_session
    desc_col = F.concat(labelled("DEVICE:", "device_model"), F.lit("  "), labelled("LOCALE:", "locale"),
                        F.lit("  "), labelled("TZ:", "timezone"), F.lit(""), labelled("CARRIER:", "network_carrier"),
                        F.lit("  "), labelled("IP:", "ip"), F.lit(" "), labelled("Platform:", "platform"))
    return s.select("user_id", "session_timestamp", "device_id", desc_col.alias("description"))


@op("num_try_cast")
def num_try_cast(fx: Fixtures) -> DataFrame:
    m = fx.menu_tap
    return m.select(C("user_id").alias("user_text"), "original_timestamp", "context_device_id",
                    safe_number("user_id").alias("user_id"))


@op("ts_local")
def ts_local(fx: Fixtures) -> DataFrame:
    return fx.auth_event.select("auth_event_id", "trans_ts",
                                local_time("trans_ts", codes.TIMELINE_TZ).alias("local_ts"))


@op("ts_week")
def ts_week(fx: Fixtures) -> DataFrame:
    return fx.disputed_txn.select("user_dispute_claim_txn_id", "dispute_created_at",
                                  week_start("dispute_created_at").alias("week"))


@op("date_diffs")
def date_diffs(fx: Fixtures) -> DataFrame:
    m = fx.dim_member.select(C("user_id").alias("_mu"), "enrollment_initiated_ts")
    j = fx.settled_txn.join(m, C("user_id") == C("_mu"), "left")
    a, b = "enrollment_initiated_ts", "transaction_timestamp"
    return j.select("authorization_code", day_diff(a, b).alias("day_diff"), month_diff(a, b).alias("month_diff"),
                    second_diff(a, b).alias("second_diff"))


@op("date_adds")
def date_adds(fx: Fixtures) -> DataFrame:
    ts = C("transaction_timestamp")
    return fx.settled_txn.select(
        "authorization_code",
        F.timestamp_add("HOUR", F.lit(1), ts).alias("plus_1h"),
        F.timestamp_add("DAY", F.lit(P.DISPUTE_WIN), ts).alias("plus_win_days"),
        F.timestamp_add("SECOND", F.lit(-60), ts).alias("minus_60s"),
        F.date_add(F.to_date(ts), -1).alias("day_before"))
