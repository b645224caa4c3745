"""Account history: one time-ordered timeline per account from nine feeds.

Every feed and every context table with an account column is cut to the account
set *first* (a semi join), then joined to its context tables, de-duplicated where the
analysis does so, and cast to the 13-column timeline schema:

    user_id, timestamp, id, merchant_name, type, description, card_type,
    decision, decline_resp_cd, vrs, rules_denied, amt, is_disputed

Times are converted from UTC to the analysis's local zone and kept as
wall-clock TIMESTAMP_NTZ; the card-replacement feed is left as stored. For
many accounts at once the per-account windows (login dedup, card lead) are
partitioned by ``user_id`` as well.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import ExitStack
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from disputelens.functions import codes
from disputelens.functions.mappings import (
    account_type, auth_decision_text, auth_kind, change_type, changed_field, counterparty,
    decline_reason, force_post_account_type, inspector_ext_id, intake_channel, rule_outcome,
    transfer_description, transfer_kind, txn_family, yes_no,
)
from disputelens.functions.semantics import (
    asc, desc, ilike_any, labelled, local_time, minute_start, safe_number, second_diff,
)
from disputelens.operators.dedup import keep_first
from disputelens.operators.joins import any_party_join, in_rough_set, nearest_within, rough_set, semi_join
from disputelens.plans.risk_cut import follow_ups
from disputelens.operators.ranges import order_by_points, split_points
from disputelens.operators.sequence import lead_in_order
from disputelens.session import materialized

TIMELINE = (
    ("user_id", "bigint"), ("timestamp", "timestamp_ntz"), ("id", "string"), ("merchant_name", "string"),
    ("type", "string"), ("description", "string"), ("card_type", "string"), ("decision", "string"),
    ("decline_resp_cd", "string"), ("vrs", "string"), ("rules_denied", "string"),
    ("amt", "decimal(18,2)"), ("is_disputed", "string"),
)
NA = "n/a"
def timeline(df: DataFrame, **cols: Column | str) -> DataFrame:
    """Project ``df`` onto the timeline schema; missing columns become 'n/a'."""
    out = []
    for name, typ in TIMELINE:
        v = cols.get(name, F.lit(NA))
        v = F.col(v) if isinstance(v, str) else v
        out.append(v.cast(typ).alias(name))
    return df.select(*out)


@dataclass
class AccountSet:
    """The accounts to pull (a one-column ``user_id`` BIGINT relation)."""

    users: DataFrame

    @classmethod
    def of(cls, users: DataFrame, col: str = "user_id") -> "AccountSet":
        """Accounts from a column of ids (numbers or numeric text, as the
        source's text user set; malformed text matches nothing)."""
        u = (users.select(safe_number(F.col(col).cast("string")).alias("_uid"))
             .where(F.col("_uid").isNotNull()).distinct())
        return cls(u)

    @classmethod
    def of_ids(cls, spark, ids) -> "AccountSet":
        """A handful of accounts given by id (the single-account pull)."""
        return cls.of(spark.createDataFrame([(int(i),) for i in ids], "user_id bigint"))

    def keep(self, df: DataFrame, col: Column | str) -> DataFrame:
        """Rows of the accounts. Every table with an account column is cut so
        before its joins; Spark chooses how from the set's measured size."""
        c = F.col(col) if isinstance(col, str) else col
        return df.join(self.users, c == F.col("_uid"), "left_semi")

    def exactly(self, df: DataFrame, col: str) -> DataFrame:
        """``df``, which comes from tables that were kept, cut to the accounts alone."""
        return df


@dataclass
class RoughAccounts(AccountSet):
    """The accounts, with tables cut to those that may be among them.

    A large account set can't be broadcast, and a semi-join would shuffle each of the feeds' twenty tables by the
    account alone, a key that no other join has. ``rough`` is bounded and broadcast instead; the timeline is
    cut exactly once, in its last shuffle. Until then a feed may hold other accounts too, which is no matter where
    rows of two accounts don't meet.
    """

    rough: DataFrame

    @classmethod
    def of_set(cls, acc: AccountSet, keep: Callable[[DataFrame], DataFrame]) -> "RoughAccounts":
        return cls(acc.users, keep(rough_set(acc.users, "_uid")))

    def keep(self, df: DataFrame, col: Column | str) -> DataFrame:
        return in_rough_set(df, F.col(col) if isinstance(col, str) else col, self.rough)

    def exactly(self, df: DataFrame, col: str) -> DataFrame:
        return AccountSet.keep(self, df, col)


class HistorySources:
    """The 20 relations the feeds read, resolved lazily by attribute.

    Each feed touches only its own relations, so building one feed does not
    construct (and analyse) the other feeds' inputs.
    """

    FIELDS = (
        "posted_txn", "pay_friend", "disputed_txn", "card", "pay_friend_score", "auth_event",
        "auth_decision", "fraud_override", "alert_auth_event", "inspector_dispute", "inspector_txn",
        "dispute_claim", "dispute_contact", "user_session", "ip_geo_map", "geo_city", "login_alert",
        "login_request", "version_change", "menu_tap",
    )

    def __init__(self, **tables):
        missing = set(self.FIELDS) - set(tables)
        if missing:
            raise ValueError(f"missing relations: {sorted(missing)}")
        self._tables = tables

    @classmethod
    def from_fixtures(cls, fx) -> "HistorySources":
        return cls(**{f: (lambda f=f: getattr(fx, f)) for f in cls.FIELDS})

    def __getattr__(self, name: str) -> DataFrame:
        tables = self.__dict__.get("_tables", {})
        if name not in tables:
            raise AttributeError(name)
        v = tables[name]
        return v() if callable(v) else v


def _disputes(src: HistorySources, acc: AccountSet, prefix: str = "d_") -> DataFrame:
    d = acc.keep(src.disputed_txn, "user_id")
    return d.select(F.col("user_id").alias(f"{prefix}user_id"),
                    F.col("authorization_code").alias(f"{prefix}authorization_code"),
                    F.col("unique_transaction_id").alias(f"{prefix}unique_transaction_id"),
                    F.col("user_dispute_claim_txn_id").alias(f"{prefix}claim_txn_id"))


# -- a: transfers, deposits, fees ------------------------------------------------

def hist_transfers(src: HistorySources, acc: AccountSet, tz: str = codes.TIMELINE_TZ) -> DataFrame:
    t = acc.keep(src.posted_txn, "user_id").filter(
        ~F.col("description").isin(*codes.EXCLUDED_POSTING_DESCRIPTIONS)
        & (F.col("type") != "Purchase")
        & ~F.col("mcc_cd").isin(*codes.WITHDRAWAL_MCCS))
    t = t.withColumn("_minute", minute_start("transaction_timestamp")) \
         .withColumn("_abs_amt", F.abs("settled_amt"))
    pf = src.pay_friend.select(
        F.col("id").alias("pf_id"), F.col("sender_id").alias("pf_sender_id"),
        F.col("receiver_id").alias("pf_receiver_id"), F.abs("amount").alias("pf_amount"),
        minute_start("created_at").alias("pf_minute"), transfer_kind("type_code").alias("pf_txn_type"))
    prs = src.pay_friend_score.select(F.col("pay_friend_id").alias("prs_pay_friend_id"),
                                      F.col("score").alias("prs_score"))
    # the score is the friend payment's: it joins the payments, not the postings, which are wider
    j = any_party_join(t, pf, "user_id", ["pf_sender_id", "pf_receiver_id"],
                       [("_minute", "pf_minute"), ("_abs_amt", "pf_amount")],
                       cut=lambda parties, party: acc.keep(parties, party).join(
                           prs, F.col("prs_pay_friend_id") == F.col("pf_id"), "left"))
    d = _disputes(src, acc)
    j = j.join(d, (F.col("user_id") == F.col("d_user_id"))
               & (F.col("authorization_code") == F.col("d_authorization_code")), "left")
    dc = acc.keep(src.card, "user_id").select(F.col("card_id").alias("dc_card_id"),
                                                 F.col("user_id").alias("dc_user_id"),
                                                 F.col("card_number").alias("dc_card_number"))
    j = j.join(dc, (F.col("card_id").cast("string") == F.col("dc_card_id"))
               & (F.col("dc_user_id") == F.col("user_id")), "left")
    return timeline(
        j,
        user_id="user_id",
        timestamp=local_time("transaction_timestamp", tz),
        id=F.col("authorization_code").cast("string"),
        merchant_name=counterparty("transaction_details_2", "deposit_type_cd", "description",
                                   "pf_receiver_id", "pf_sender_id", "merchant_name"),
        type="type",
        description=transfer_description("description", "pf_txn_type", "transaction_cd", "prs_score"),
        card_type=account_type("unique_program_id", "card_id", "dc_card_number"),
        decision=F.when(F.col("transaction_cd").isNotNull(), F.lit("Approved")),
        amt="settled_amt",
        is_disputed=yes_no(F.col("d_authorization_code").isNotNull()),
    )


# -- b: authorisations ------------------------------------------------------------

def acted_rules(decisions: DataFrame) -> DataFrame:
    """The rule decisions that were acted on."""
    return (decisions
            .filter((F.col("is_shadow_mode") == "false") & (F.col("policy_result") == "criteria_met")
                    & F.expr("policy_actions LIKE concat('%', decision_outcome, '%')")
                    & F.col("decision_outcome").isin(*codes.ACTED_RULE_OUTCOMES))
            .select(F.col("user_id").alias("rta2_user_id"), F.col("auth_id").alias("rta2_auth_id"),
                    F.col("policy_name").alias("rta2_policy_name"),
                    F.col("decision_outcome").alias("rta2_decision_outcome")))


def join_rules(df: DataFrame, decisions: DataFrame) -> DataFrame:
    """``df`` (user_id, auth_id) ⟕ the rule decisions that were acted on."""
    return df.join(acted_rules(decisions), (F.col("user_id") == F.col("rta2_user_id")) & (F.col("auth_id") == F.col("rta2_auth_id")),
                   "left")


def first_disputes(disputes: DataFrame) -> DataFrame:
    """The first dispute of each (account, code) in the order of the authorisations' keep-first."""
    return keep_first(disputes, ["d_user_id", "d_authorization_code"],
                      [asc("d_unique_transaction_id"), asc("d_claim_txn_id")])


def hist_auths_joined(src: HistorySources, acc: AccountSet) -> DataFrame:
    """First messages of the accounts with follow-up, rule, override, card and dispute context.

    The messages are shuffled once, by (user_id, auth_id), where all context is: the cards
    are looked up with the keys alone, and the keep-first per ``auth_event_id`` needs no
    shuffle of its own, because an id that more than one (user_id, auth_id) claims is
    decided beforehand, also with the keys alone. A dispute may match the follow-up's
    auth id too: that one is joined to the follow-ups, which are few, and the earlier of
    the two in the keep-first's order is taken. It is the one that the keep-first over
    both would keep.
    """
    firsts = acc.keep(src.auth_event, "user_id").filter((F.col("original_auth_id") == 0) & (F.col("final_amt") >= 0))
    # messages without an auth id have a place of their own, where they meet cards only
    rta = (firsts.withColumn("_last4", F.right(F.col("pan"), F.lit(4))).withColumn("_aid", F.coalesce("auth_id", F.lit(-1)))
           .withColumn("_no_aid", F.col("auth_id").isNull()).drop("auth_id"))
    own = first_disputes(_disputes(src, acc))
    dual = follow_ups(acc.keep(src.auth_event, "user_id"), firsts)
    dual = dual.join(own.select(*[F.col(c).alias(f"dual_{c}") for c in own.columns]),
                     (F.col("dual_user_id") == F.col("dual_d_user_id"))
                     & (F.col("dual_auth_id") == F.col("dual_d_authorization_code")), "left")
    rules = acted_rules(acc.keep(src.auth_decision, "user_id"))
    o = acc.keep(src.fraud_override, "user_id").select(
        F.col("user_id").alias("o_user_id"), F.col("realtime_auth_id").alias("o_realtime_auth_id"),
        F.col("decision_id").alias("o_decision_id"), F.col("is_suppressed").alias("o_is_suppressed"),
        F.col("response_signal").alias("o_response_signal"),
        F.col("response_received_at").alias("o_response_received_at"))
    keys = rta.select("auth_event_id", "user_id", "_aid", "_no_aid", "_last4")
    cards = first_cards(keys, acc.keep(src.card, "user_id"))
    context = lambda rows: _auth_context(rows, cards, dual, rules, o, own)
    order = [asc(c) for c in AUTH_ORDER]
    # the one place where accounts meet: an event id that two of them claim
    contested = acc.exactly(contested_auths(keys), "user_id")
    won = keep_first(context(contested), ["auth_event_id"], order).select(*contested.columns)
    lost = (contested.withColumn("_won", F.lit(0)).unionByName(won.withColumn("_won", F.lit(1)))
            .groupBy("auth_event_id", "user_id", "_aid", "_no_aid").agg(F.max("_won").alias("_won"))
            .where(F.col("_won") == 0)
            .select(F.col("user_id").alias("lost_user_id"), F.col("_aid").alias("lost_aid"),
                    F.struct("auth_event_id", "_no_aid").alias("lost_message")))
    left = rta.join(lost, (F.col("user_id") == F.col("lost_user_id")) & (F.col("_aid") == F.col("lost_aid"))
                    & _beside("lost_message", F.struct("auth_event_id", "_no_aid")), "left_anti")
    kept = keep_first(context(left), ["user_id", "_aid", "_no_aid", "auth_event_id"], order)
    return kept.withColumn("auth_id", F.when(~F.col("_no_aid"), F.col("_aid")))


#: Which of an authorisation's joined rows is kept: the first by these, NULLs last. (The card's id decides on its type;
#: with both, contested messages need the same columns as the others and Spark reuses the cards' shuffle.)
AUTH_ORDER = ("o_response_received_at", "dc_card_id", "dc_card_type", "dual_auth_event_id", "d_unique_transaction_id",
              "d_claim_txn_id", "rta2_policy_name", "rta2_decision_outcome", "o_decision_id")


def _beside(col: str, value: Column) -> Column:
    """``col`` = ``value`` as a condition that isn't a join key, so that the join keeps its other keys' shuffle."""
    return F.array_contains(F.array(col), value)


def first_cards(keys: DataFrame, cards: DataFrame) -> DataFrame:
    """The card with the least id of each message's account and last four digits, for (user, _aid, digits).

    The keep-first takes the least card id: only that card of an account and its last digits can be shown.
    """
    card = F.when(F.col("card_id").isNotNull(), F.struct("card_id", "card_type"))
    dc = (cards.groupBy(F.col("user_id").alias("dc_user_id"), F.right(F.col("card_number"), F.lit(4)).alias("dc_last4"))
          .agg(F.min(card).alias("dc_card")))
    return (keys.join(dc, (F.col("user_id") == F.col("dc_user_id")) & (F.col("_last4") == F.col("dc_last4")))
            .groupBy("dc_user_id", "dc_last4", F.col("_aid").alias("dc_aid")).agg(F.first("dc_card").alias("dc_card")))


def contested_auths(keys: DataFrame) -> DataFrame:
    """The distinct ``keys`` of event ids that more than one (user, auth id) has, and of those without an event id."""
    w = Window.partitionBy("auth_event_id")
    pair = F.struct("user_id", "_aid", "_no_aid")
    several = (keys.where(F.col("auth_event_id").isNotNull())
               .withColumn("_least", F.min(pair).over(w)).withColumn("_most", F.max(pair).over(w))
               .where(F.col("_least") != F.col("_most")).drop("_least", "_most"))
    return several.unionByName(keys.where(F.col("auth_event_id").isNull())).distinct()


def _auth_context(rows: DataFrame, cards: DataFrame, dual: DataFrame, rules: DataFrame, overrides: DataFrame,
                  own: DataFrame) -> DataFrame:
    """``rows`` (user_id, _aid, _no_aid, _last4) ⟕ all context, every join on (user_id, _aid)."""
    def on(user: str, code: str) -> Column:
        return (F.col("user_id") == F.col(user)) & (F.col("_aid") == F.col(code)) & ~F.col("_no_aid")

    j = rows.join(dual, on("dual_user_id", "dual_original_auth_id"), "left")
    j = j.join(rules, on("rta2_user_id", "rta2_auth_id"), "left")
    j = j.join(overrides, on("o_user_id", "o_realtime_auth_id"), "left")
    j = j.join(own, on("d_user_id", "d_authorization_code"), "left")
    j = j.join(cards, (F.col("user_id") == F.col("dc_user_id")) & (F.col("_aid") == F.col("dc_aid"))
               & _beside("dc_last4", F.col("_last4")), "left")
    j = j.withColumn("dc_card_id", F.col("dc_card.card_id")).withColumn("dc_card_type", F.col("dc_card.card_type"))
    # NULLs last, as in the keep-first; of equal keys a real match first
    place = lambda p: F.struct(*[x for c in ("unique_transaction_id", "claim_txn_id")
                                 for x in (F.col(f"{p}d_{c}").isNull(), F.col(f"{p}d_{c}"))],
                               F.col(f"{p}d_authorization_code").isNull())
    j = j.withColumn("_of_dual", place("dual_") < place(""))
    for c in own.columns:
        j = j.withColumn(c, F.when(F.col("_of_dual"), F.col(f"dual_{c}")).otherwise(F.col(c)))
    return j.drop("_of_dual", *[f"dual_{c}" for c in own.columns])


def hist_auths(src: HistorySources, acc: AccountSet, tz: str = codes.TIMELINE_TZ) -> DataFrame:
    j = hist_auths_joined(src, acc)
    return timeline(
        j,
        user_id="user_id",
        timestamp=local_time("trans_ts", tz),
        id=F.col("auth_id").cast("string"),
        merchant_name="auth_event_merchant_name_raw",
        type=auth_kind("mcc_cd"),
        description=F.concat(F.lit("Card Transaction "), F.col("entry_type"), F.lit("; MCC_CD: "), F.col("mcc_cd")),
        card_type=F.concat(F.col("dc_card_type"), F.lit(" "), F.col("_last4")),
        decision=auth_decision_text("response_cd"),
        decline_resp_cd=decline_reason("response_cd"),
        vrs=F.col("risk_score").cast("string"),
        rules_denied=rule_outcome("response_cd", "rta2_policy_name", "rta2_decision_outcome", "o_decision_id",
                                  "o_is_suppressed", "o_response_signal"),
        amt="req_amt",
        is_disputed=yes_no(F.col("d_authorization_code").isNotNull()),
    )


# -- c: settle alerts without an authorisation -------------------------------------

def hist_force_posts(src: HistorySources, acc: AccountSet, tz: str = codes.TIMELINE_TZ) -> DataFrame:
    ev = acc.keep(src.alert_auth_event, "user_id").filter(F.col("type") == "settle")
    rta = acc.keep(src.auth_event, "user_id").select(F.col("user_id").alias("rta_user_id"),
                                                        F.col("auth_id").alias("rta_auth_id"))
    ev = ev.join(rta, (F.col("user_id") == F.col("rta_user_id")) & (F.col("auth_id") == F.col("rta_auth_id")),
                 "left_anti")
    d = _disputes(src, acc)
    j = ev.join(d, (F.col("user_id") == F.col("d_user_id")) & (F.col("auth_id") == F.col("d_authorization_code")),
                "left")
    return timeline(
        j,
        user_id="user_id",
        timestamp=local_time("tran_timestamp", tz),
        id=F.col("auth_id").cast("string"),
        merchant_name="merch_name",
        type=F.lit("Purchase"),
        description=F.concat(F.lit("Card Transaction "), F.lit("likely force post")),
        # the authorisation side is anti-joined away, so its card number is NULL
        card_type=force_post_account_type("prog_id", F.lit(None).cast("string")),
        decision=F.lit("Approved"),
        amt="amount",
        is_disputed=yes_no(F.col("d_authorization_code").isNotNull()),
    )


# -- d: disputes ---------------------------------------------------------------------

def _first_of(*cols: str) -> Column:
    """The least values of ``cols`` together, NULLs last, as an aggregate."""
    return F.min(F.struct(*[x for c in cols for x in (F.col(c).isNull().alias(f"_{c}"), F.col(c))]))


def _dispute_context(src: HistorySources) -> Callable[[DataFrame, str], DataFrame]:
    """(rows, name) -> ``rows`` with claim, contact and inspector context, one row each.

    A claim's cases, entries and contacts and an inspected transaction's rows are joined independently, so the
    row that the keep-first takes has the first of each in its order; the others are dropped before the joins.
    The external id is text: all three joins take the claim as text (``name``), so the rows are shuffled once for them.
    """
    d = (src.inspector_dispute.select(F.col("id").alias("r_inspector_dispute_id"), F.col("intake_type").alias("d_intake_type"),
                                      F.col("claim_ext_id").cast("string").alias("d_claim_ext_id"))
         .where(F.col("d_claim_ext_id").isNotNull())
         .groupBy("d_claim_ext_id").agg(_first_of("r_inspector_dispute_id", "d_intake_type").alias("_d"))
         .select("d_claim_ext_id", "_d.r_inspector_dispute_id", "_d.d_intake_type"))
    dc = (src.dispute_claim.where(F.col("id").isNotNull()).groupBy(F.col("id").cast("string").alias("dc_id"))
          .agg(F.min("intake_type").alias("dc_intake_type")))
    mc = (src.dispute_contact.filter((F.col("dispute_contact_category") == codes.CONTACT_CATEGORY_FILING)
                                     & F.col("dispute_id").isNotNull())
          .select(F.col("dispute_id").cast("string").alias("mc_dispute_id"),
                  F.col("interactions_str_seq").alias("mc_interactions_str_seq"),
                  F.col("contact_flow").alias("mc_contact_flow"))
          .groupBy("mc_dispute_id").agg(_first_of("mc_interactions_str_seq", "mc_contact_flow").alias("_mc"))
          .select("mc_dispute_id", "_mc.mc_interactions_str_seq", "_mc.mc_contact_flow"))
    t = (src.inspector_txn.where(F.col("dispute_id").isNotNull() & F.col("transaction_ext_id").isNotNull())
         .groupBy(F.col("dispute_id").alias("t_dispute_id"), F.col("transaction_ext_id").alias("t_ext_id"))
         .agg(F.min("investigation_resolution").alias("investigation_resolution")))

    def joined(rows: DataFrame, claim: str) -> DataFrame:
        j = (rows.withColumn(claim, F.col("user_dispute_claim_id").cast("string"))
             .join(d, F.col(claim) == F.col("d_claim_ext_id"), "left")
             .join(dc, F.col(claim) == F.col("dc_id"), "left")
             .join(mc, F.col(claim) == F.col("mc_dispute_id"), "left").drop(claim))
        j = j.withColumn("intake_type", intake_channel("dc_intake_type", "d_intake_type",
                                                       "mc_interactions_str_seq", "mc_contact_flow")) \
             .withColumn("transaction_id", txn_family("transaction_code")) \
             .withColumn("_ext_id", inspector_ext_id("transaction_code", "authorization_code"))
        return j.join(t, (F.col("r_inspector_dispute_id") == F.col("t_dispute_id"))
                      & (F.col("_ext_id") == F.col("t_ext_id")), "left")
    return joined


def hist_disputes_joined(src: HistorySources, acc: AccountSet) -> DataFrame:
    # a transaction's latest row may be another account's: cut to the transactions the
    # accounts touch, take the latest row over all accounts, and choose accounts last
    touched = acc.keep(src.disputed_txn, "user_id").select("unique_transaction_id")
    dt = semi_join(src.disputed_txn, touched, "unique_transaction_id", "unique_transaction_id")
    # the latest row's own columns lead the order: only rows that tie in them need the context
    newest = Window.partitionBy("unique_transaction_id").orderBy(desc("dispute_created_at"), desc("user_dispute_claim_txn_id"))
    dt = dt.withColumn("_place", F.rank().over(newest)).where(F.col("_place") == 1).drop("_place")
    dt = dt.withColumn("_ties", F.count(F.lit(1)).over(Window.partitionBy("unique_transaction_id")))
    context = _dispute_context(src)
    # a row that no other ties with has one row of context, so it isn't shuffled again for the keep-first
    single = context(dt.where(F.col("_ties") == 1), "_claim")
    tied = keep_first(context(dt.where(F.col("_ties") > 1), "_tied_claim"), ["unique_transaction_id"], [
        asc("r_inspector_dispute_id"), asc("dc_intake_type"), asc("mc_interactions_str_seq"), asc("mc_contact_flow"),
        asc("investigation_resolution")])
    latest = single.unionByName(tied).drop("_ties")
    return acc.keep(latest, "user_id")


def hist_disputes(src: HistorySources, acc: AccountSet, tz: str = codes.TIMELINE_TZ) -> DataFrame:
    j = hist_disputes_joined(src, acc)
    return timeline(
        j,
        user_id="user_id",
        timestamp=local_time("dispute_created_at", tz),
        id=F.col("user_dispute_claim_txn_id").cast("string"),
        merchant_name="merchant_name",
        type=F.lit("dispute"),
        description=F.concat(F.col("reason"), F.lit("; dispute_claim_id:"),
                             F.col("user_dispute_claim_id").cast("string")),
        card_type="intake_type",
        decision=F.coalesce(F.col("investigation_resolution"), F.col("resolution_decision")),
        amt="transaction_amount",
        is_disputed=F.lit(NA),
    )


# -- e: logins ---------------------------------------------------------------------------

def join_places(sessions: DataFrame, ip_geo_map: DataFrame, geo_city: DataFrame) -> DataFrame:
    """``sessions`` (ip) ⟕ ip map ⟕ city: adds ``loc_time_zone``."""
    ipm = ip_geo_map.select(F.col("ip").alias("map_ip"), F.col("geoname_id").alias("map_geoname_id"))
    loc = geo_city.select(F.col("geoname_id").alias("loc_geoname_id"), F.col("time_zone").alias("loc_time_zone"))
    return (sessions.join(ipm, F.col("ip") == F.col("map_ip"), "left")
            .join(loc, F.col("loc_geoname_id") == F.col("map_geoname_id"), "left"))


def hist_logins_joined(src: HistorySources, acc: AccountSet) -> DataFrame:
    j = join_places(acc.keep(src.user_session, "user_id"), src.ip_geo_map, src.geo_city)
    # Only the highest alert score of a (user, device) survives the dedup, so
    # the alerts are reduced to it before the join instead of fanning out.
    atom = (acc.keep(src.login_alert, "user_id").filter(F.col("score") != 0)
            .groupBy(F.col("user_id").alias("atom_user_id"), F.col("device_id").alias("atom_device_id"))
            .agg(F.max("score").alias("atom_score")))
    j = j.join(atom, (F.col("user_id") == F.col("atom_user_id")) & (F.col("device_id") == F.col("atom_device_id")),
               "left")
    # the keep-first shows the latest login of the minute before the session: one row per login time is left to find
    lr = keep_first(acc.keep(src.login_request, "user_id").select(
        F.col("user_id").alias("lr_user_id"), F.col("segment_device_id").alias("lr_device_id"),
        F.col("login_success_at").alias("lr_at"),
        F.col("login_started_at").alias("lr_login_started_at"),
        F.col("tfa_method_deprecated").alias("lr_tfa_method_deprecated")),
        ["lr_user_id", "lr_device_id", "lr_at"], [desc("lr_login_started_at"), asc("lr_tfa_method_deprecated")])
    j = nearest_within(j, lr.withColumnRenamed("lr_at", "lr_login_success_at"),
                       [("user_id", "lr_user_id"), ("device_id", "lr_device_id")], "session_timestamp",
                       "lr_login_success_at", 60, last=True)
    j = j.join(lr, (F.col("user_id") == F.col("lr_user_id")) & (F.col("device_id") == F.col("lr_device_id"))
               & (F.col("lr_login_success_at") == F.col("lr_at")), "left").drop("lr_user_id", "lr_device_id", "lr_at")
    return keep_first(j, ["user_id", "session_timestamp", "device_id"], [
        desc("lr_login_success_at"), desc("lr_login_started_at"), asc("lr_tfa_method_deprecated"),
        asc("loc_time_zone"), asc("ip"), asc("device_model"), asc("platform"), asc("locale"), asc("timezone"),
        asc("network_carrier")])


def login_description(score, device_model, locale, timezone, carrier, ip, ip_zone, platform, tfa,
                      started, success) -> Column:
    c = F.col
    return F.concat(
        labelled("ATOMv2 score:", c(score).cast("string")), F.lit("  "),
        labelled("DEVICE:", device_model), F.lit("  "),
        labelled("LOCALE:", locale), F.lit("  "),
        labelled("TZ:", timezone), F.lit(""),
        labelled("CARRIER:", carrier), F.lit("  "),
        labelled("IP:", ip, F.lit(" "), ip_zone), F.lit(" "),
        labelled("Platform:", platform), F.lit(" "),
        labelled("TFA_METHOD:", tfa), F.lit(" "),
        labelled("TIME_SPENT:", second_diff(started, success).cast("string")),
    )


def hist_logins(src: HistorySources, acc: AccountSet, tz: str = codes.TIMELINE_TZ) -> DataFrame:
    j = hist_logins_joined(src, acc)
    return timeline(
        j,
        user_id="user_id",
        timestamp=local_time("session_timestamp", tz),
        id=F.col("device_id").cast("string"),
        type=F.lit("login"),
        description=login_description("atom_score", "device_model", "locale", "timezone", "network_carrier",
                                      "ip", "loc_time_zone", "platform", "lr_tfa_method_deprecated",
                                      "lr_login_started_at", "lr_login_success_at"),
        amt=F.lit(0),
    )


# -- f: failed logins ----------------------------------------------------------------------

def hist_failed_logins(src: HistorySources, acc: AccountSet, tz: str = codes.TIMELINE_TZ) -> DataFrame:
    lr = acc.keep(src.login_request, "user_id").filter(
        F.col("tfa_method").isNotNull() & (F.col("login_success") == 0) & (F.col("mfa_auth_success") == 0))
    return timeline(
        lr,
        user_id="user_id",
        timestamp=local_time("login_started_at", tz),
        id="segment_device_id",
        type=F.lit("login failed"),
        description=F.concat(F.lit("FALIED RSN: "), F.col("tfa_method_deprecated"), F.lit("; PLATFORM: "),
                             F.col("platform")),
        amt=F.lit(0),
    )


# -- g: profile changes ------------------------------------------------------------------------

def hist_info_changes(src: HistorySources, acc: AccountSet, tz: str = codes.TIMELINE_TZ) -> DataFrame:
    v = acc.keep(src.version_change, "item_id").withColumn("item_change", changed_field("object_changes"))
    v = v.filter(ilike_any("item_change", codes.PROFILE_CHANGE_FIELDS) & (F.col("item_type") == "User"))
    return timeline(
        v,
        user_id="item_id",
        timestamp=local_time("created_at", tz),
        id=F.col("versions_id").cast("string"),
        type=change_type("item_change"),
        description=F.concat(F.concat(F.lit("change from:"), F.col("change_from")), F.lit(" "),
                             F.concat(F.lit("to:"), F.col("change_to")), F.lit(" "),
                             F.concat(F.lit("by: "), F.col("whodunnit"))),
        amt=F.lit(0),
    )


# -- h: app views ------------------------------------------------------------------------------

def hist_app_views(src: HistorySources, acc: AccountSet, tz: str = codes.TIMELINE_TZ) -> DataFrame:
    m = src.menu_tap.withColumn("_uid", safe_number("user_id"))
    m = m.filter(ilike_any("unique_id", codes.APP_VIEW_ITEMS) & (F.col("location") != "Dialogue"))
    m = acc.keep(m.withColumnRenamed("_uid", "_menu_uid"), "_menu_uid")
    return timeline(
        m,
        user_id="_menu_uid",
        timestamp=local_time("original_timestamp", tz),
        id=F.col("context_device_id").cast("string"),
        type=F.lit("app_view_activity"),
        description=F.concat(F.concat(F.lit("app location: "), F.col("location")), F.lit(" "),
                             F.concat(F.lit("; label: "), F.col("label")), F.lit(" "),
                             F.concat(F.lit("; what was viewed: "), F.col("unique_id"))),
        amt=F.lit(0),
    )


# -- i: card replacements -------------------------------------------------------------------------

def hist_card_replacements(src: HistorySources, acc: AccountSet) -> DataFrame:
    """Old card -> next card of the same type for the account, by creation time.

    The next card is a ``lead`` per (account, card type); ``lead_in_order``
    computes it without gathering an account's cards into one task.
    """
    cards = acc.keep(src.card, "user_id").filter(F.col("shipped_dt").isNotNull())
    day = F.datediff(F.to_date("card_created_ts"), F.lit("1970-01-01").cast("date"))
    cards = lead_in_order(cards, ["user_id", "card_type"], [("card_created_ts", "asc"), ("card_id", "asc")],
                          ["card_created_ts", "card_number"], ["_next_ts", "_next_number"], segment=day)
    cards = cards.filter(F.col("_next_ts").isNotNull())
    return timeline(
        cards,
        user_id="user_id",
        timestamp="_next_ts",
        id=F.concat(F.col("card_number"), F.lit(" to "), F.col("_next_number")),
        type=F.lit("card_replacement"),
        description=F.concat(F.lit("old card status changed to "), F.col("card_status"), F.lit(" on "),
                             F.col("last_status_change_dt")),
        card_type="card_type",
        amt=F.lit(0),
    )


FEEDS = (
    ("hist_transfers", hist_transfers),
    ("hist_auths", hist_auths),
    ("hist_force_posts", hist_force_posts),
    ("hist_disputes", hist_disputes),
    ("hist_logins", hist_logins),
    ("hist_failed_logins", hist_failed_logins),
    ("hist_info_changes", hist_info_changes),
    ("hist_app_views", hist_app_views),
    ("hist_card_replacements", lambda src, acc, tz=None: hist_card_replacements(src, acc)),
)
#: The feeds that shuffle rows; the others filter and project one table.
SHUFFLING = ("hist_transfers", "hist_auths", "hist_force_posts", "hist_disputes", "hist_logins", "hist_card_replacements")


def account_timeline(src: HistorySources, acc: AccountSet, tz: str = codes.TIMELINE_TZ,
                     keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The nine feeds for the accounts of ``acc``, unioned (lazy, unordered).

    With ``keep`` (such as ``session.materialize``) it isn't lazy: the feeds that shuffle rows are stored
    one after the other, each without the others' shuffles on the disks.
    """
    out = None
    for name, feed in FEEDS:
        part = feed(src, acc, tz)
        part = keep(part) if keep and name in SHUFFLING else part
        out = part if out is None else out.unionByName(part)
    return out


def account_history(src: HistorySources, users: DataFrame | AccountSet, tz: str = codes.TIMELINE_TZ,
                    user_col: str = "user_id", points: list[tuple] | None = None,
                    keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All nine feeds for the accounts in ``users``, ordered by account and time.

    Ranges of (account, time) are sorted, so a hot account is split. With the
    ``points`` of ``history_points`` each feed runs once, and its tables are cut to the accounts without a
    shuffle (``RoughAccounts``); without them Spark's sort runs the feeds' last stages a second time to find the
    ranges. Lazy, unless ``keep`` stores the feeds (see ``account_timeline``), which needs the points too.
    """
    acc = users if isinstance(users, AccountSet) else AccountSet.of(users, user_col)
    if points is None:
        return account_timeline(src, acc, tz).orderBy(*timeline_order())
    rows = account_timeline(src, RoughAccounts.of_set(acc, keep or (lambda df: df)), tz, keep)
    return order_by_points(rows, _range_key("user_id", F.col("timestamp")), RANGE_TYPES, points, timeline_order(),
                           only=acc.users.select(F.col("_uid").alias("user_id")))


def timeline_order() -> list[Column]:
    return [asc("user_id"), asc("timestamp"), asc("type"), asc("id")]


#: The keys that the timeline's ranges are cut by.
RANGE_TYPES = ("bigint", "timestamp_ntz")
#: Each feed's own table, its account and its time column (the last one's time is shown as stored).
FEED_TIMES = (
    ("posted_txn", "user_id", "transaction_timestamp"), ("auth_event", "user_id", "trans_ts"),
    ("alert_auth_event", "user_id", "tran_timestamp"), ("disputed_txn", "user_id", "dispute_created_at"),
    ("user_session", "user_id", "session_timestamp"), ("login_request", "user_id", "login_started_at"),
    ("version_change", "item_id", "created_at"), ("menu_tap", "user_id", "original_timestamp"),
    ("card", "user_id", "card_created_ts"),
)


def _range_key(user: Column | str, time: Column) -> list[Column]:
    """Account and time as range keys; rows without a time come last in their account, as in the order."""
    return [F.col(user) if isinstance(user, str) else user,
            F.coalesce(time.cast("timestamp_ntz"), F.lit("9999-12-31 23:59:59.999999").cast("timestamp_ntz"))]


def history_points(src: HistorySources, acc: AccountSet, tz: str = codes.TIMELINE_TZ,
                   ranges: int | None = None) -> list[tuple]:
    """Split points of (account, time) for the timeline of ``acc``, from a bounded sample of the feeds'
    own tables (two columns each, cut to the accounts). Runs two jobs: a count and the sample.

    The feeds' filters aren't applied, so the ranges are as even as the feeds are alike among accounts;
    a wrong guess costs balance, never rows or order.
    """
    spark = acc.users.sparkSession
    rows = None
    for name, user, time in FEED_TIMES:
        table = getattr(src, name)
        at = F.col(time) if name == "card" else local_time(time, tz)
        part = table.select(*[c.alias(n) for c, n in zip(
            _range_key(safe_number(F.col(user).cast("string")), at), ("account", "time"))])
        rows = part if rows is None else rows.unionByName(part)
    return split_points(rows.where(F.col("account").isNotNull()), rows.count(),
                        ranges or int(spark.conf.get("spark.sql.shuffle.partitions")),
                        cut=lambda found: acc.keep(found, "account"))


def write_account_history(src: HistorySources, users: DataFrame | AccountSet, path: str, tz: str = codes.TIMELINE_TZ,
                          user_col: str = "user_id") -> None:
    """Write the timeline under ``path``: files ranged by (account, time) and sorted inside.

    The nine feeds run once: the ranges are known from ``history_points``. The feeds that shuffle rows are stored one
    after the other meanwhile, and deleted at the end (see ``account_timeline``).
    """
    acc = users if isinstance(users, AccountSet) else AccountSet.of(users, user_col)
    with ExitStack() as tables:
        account_history(src, acc, tz, points=history_points(src, acc, tz),
                        keep=lambda df: tables.enter_context(materialized(df))).write.mode("overwrite").parquet(path)
