"""The 25 warehouse relations the analyses read, derived from the driver tables.

The analyses run against a card-payment warehouse that is not available, so
each relation is derived from the TPC-H-style driver tables by fixed integer
rules on keys (``FIXTURES.md``). The same rules are written in DuckDB SQL in
``disputelens.oracle.fixtures_sql``; both sides must agree row for row.

Most relations derive from one line-level base. The base groups ``lineitem``
by (order key, line number) and joins it to ``orders`` on the order key: lines
are shuffled by the order key and sorted once, for the grouping and the join.

The relations play the warehouse's stored tables. What takes a shuffle to derive
(the base and the ``distinct`` ones) is written once per session and source
snapshot as a parquet table into the shared checkpoint folder, and every query
reads it back. The other relations are projections and filters of such a table or of a
driver table, so they are views: storing them would shuffle and write
every row again for each relation that a query reads.
``Fixtures(..., reuse_base=False)`` gives the plain lazy derivations instead
(the tests compare those with their SQL twins).
"""

from __future__ import annotations

import os
from functools import cached_property, wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from disputelens.functions import codes
from disputelens.functions.mappings import txn_family
from disputelens.session import materialize
from disputelens.sources.tables import TableSource

_BASES: dict[tuple, DataFrame] = {}

# --- fixture rule values (test-data design, not from the analyses) ----------
SETTLED_CODES = codes.PURCHASE_CODES + codes.ATM_CODES + ("ADX", "FEX")
SETTLED_PROGRAMS = (600, 278, 512, 609)
DISPUTE_REASONS = codes.UNAUTHORIZED_REASONS + ("not_received",)
DISPUTE_RESOLUTIONS = ("Pending Resolution", None, "Resolved")
DISPUTE_DECISIONS = (None, "approve", "Approved", "deny")
RESOLUTION_CODES = ("R01", "R02", "R03")
CLOSE_CODES = ("C1", "C2")
ACCOUNT_STATUS = ("active", "suspended")
CARD_STATUS = ("active", "inactive", "lost")
NETWORKS = ("Visa", "Mastercard", "Discover")
SUB_NETWORKS = ("Interlink", "Maestro", "Star")
MTI = ("0100", "0120")
PIN_RESULTS = ("Y", "N", None)
ENTRY_TYPES = ("Contactless EMV", "EMV", "Magstripe", "Contactless MSD")
RESPONSE_CODES = ("00", "10", "51", "59", "04", "00", "00", "N7", "99", "00")
INSPECTOR_INTAKE = ("mobile", "fax", "paper_mail", "web", None, None)
INSPECTOR_RESOLUTION = ("approve", None, "deny")
POSTING_DESCRIPTIONS = (codes.PF_SENT, codes.PF_RECEIVED, "Direct Deposit", "Savings Interest")
POSTING_TYPES = ("Purchase", "Transfer", "Deposit", "Fee")
PF_TYPE_CODES = ("to_member", "to_non_member")
FUNDING_TYPES = ("linked_card", "bank_account")
CARD_STATES = ("active", "closed", "lost")
DECISION_OUTCOMES = codes.ACTED_RULE_OUTCOMES + ("observe",)
SIGNALS = ("approve", "deny")
CLAIM_INTAKE = ("mobile", "fax", None, None)
CONTACT_FLOWS = (None, "Phone", "EMAIL")
DEVICE_MODELS = ("iPhone 12", "Pixel 6", "Galaxy S21")
TIMEZONES = ("America/New_York", "America/Chicago", None, "America/Los_Angeles")
CARRIERS = ("Verizon", "T-Mobile", None, "AT&T", "Sprint")
PLATFORMS = ("ios", "android")
CITY_ZONES = ("America/New_York", "America/Chicago", "America/Denver", "America/Los_Angeles")
TFA_METHODS = ("sms", "scan_id")
TFA_DEPRECATED = ("SMS 2FA Auth", "Scan ID Auth", "Step Down")
PROFILE_FIELDS = ("status", "phone", "email", "zip_code", "favorite_color")
MENU_LOCATIONS = ("Dialogue", "Home", None)
MENU_LABELS = ("tab", "button")
MENU_ITEMS = ("Account tab", "virtual_card", "help")
FOLLOW_UP_OFFSET = 1_000_000_000
INSPECTOR_ID_OFFSET = 500_000
ENROLL_EPOCH = "1994-01-01 00:00:00"


def pick(values, idx: Column) -> Column:
    """``values[idx]`` for a 0-based integer column."""
    return F.array(*[F.lit(v) for v in values])[idx.cast("int")]


def c(name: str) -> Column:
    return F.col(name)


def txt(x: Column) -> Column:
    return x.cast("string")


def add(unit: str, n, ts: Column) -> Column:
    return F.timestamp_add(unit, n if isinstance(n, Column) else F.lit(n), ts)


def stored(fn):
    """A table computed once per session and source snapshot (see module doc)."""
    name = fn.__name__

    @wraps(fn)
    def get(self) -> DataFrame:
        df = fn(self)
        if not self.reuse_base:
            return df
        key = (*self.snapshot_key, name)
        if key not in _BASES:
            _BASES[key] = materialize(df)
        return _BASES[key]

    return cached_property(get)


SOURCE_TABLES = ("lineitem", "orders", "customer", "events", "nation")


class Fixtures:
    """DataFrames T1..T25 for one ``sf_dir``."""

    def __init__(self, spark: SparkSession, sf_dir: str, reuse_base: bool = True):
        self.src = TableSource(spark, sf_dir)
        self.reuse_base = reuse_base

    @cached_property
    def snapshot_key(self) -> tuple:
        return (self.src.spark.sparkContext.applicationId, self.src.sf_dir,
                *(self._snapshot(t) for t in SOURCE_TABLES))

    @cached_property
    def source_bytes(self) -> int:
        """Stored bytes of the driver tables."""
        return sum(self.src.size(t) for t in SOURCE_TABLES)

    def materialize_all(self, threads: int = 4) -> None:
        """Write the stored tables now. After the shared base, the writes are
        independent Spark jobs, submitted from a few driver threads at once."""
        from concurrent.futures import ThreadPoolExecutor

        for shared in ("line_base", "settled_ext", "disputed_ext", "auth_ext", "posted_ext", "claims"):
            getattr(self, shared)
        with ThreadPoolExecutor(max_workers=threads) as pool:
            list(pool.map(lambda n: getattr(self, n), RELATIONS))

    # -- line-level base ----------------------------------------------------------
    @stored
    def line_base(self) -> DataFrame:
        return self.derive_line_base()

    def _snapshot(self, table: str):
        path = self.src.path(table)
        try:
            st = os.stat(path)
            return st.st_mtime_ns, st.st_size
        except OSError:  # not a local path: key by name only
            return path

    def derive_line_base(self) -> DataFrame:
        """One row per (order key, line number, customer).

        Lines are shuffled before they are grouped, not grouped on both sides of the shuffle:
        few repeat, and the task that reads a split would sort it. An order that comes
        several times for a customer counts that often in the amount.
        """
        li = self.src.read("lineitem", [
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
            "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate"])
        lines = (li.where(c("l_orderkey").isNotNull()).repartition("l_orderkey")
                 .groupBy("l_orderkey", "l_linenumber")
                 .agg(F.min("l_shipdate").alias("ts"),
                      F.sum(c("l_extendedprice").cast("decimal(18,2)")).alias("amt"),
                      F.min("l_partkey").alias("pk"),
                      F.min("l_suppkey").alias("sk"),
                      F.min("l_returnflag").alias("rf"),
                      F.round(F.min("l_discount") * 100).cast("int").alias("disc"),
                      F.min("l_quantity").cast("int").alias("qty")))
        orders = self.src.read("orders", ["o_orderkey", "o_custkey"])
        owners = (orders.where(c("o_orderkey").isNotNull()).repartition("o_orderkey")
                  .groupBy("o_orderkey", "o_custkey").agg(F.count(F.lit(1)).alias("times")))
        return (lines.join(owners, c("l_orderkey") == c("o_orderkey"))
                .select((c("l_orderkey") * 10 + c("l_linenumber")).alias("code"), c("o_custkey").alias("u"), "ts",
                        (c("amt") * c("times")).cast("decimal(18,2)").alias("amt"), "pk", "sk", "rf", "disc", "qty"))

    @cached_property
    def settled_ext(self) -> DataFrame:
        b = self.line_base
        return b.select(
            "code", "u", "pk", "sk", "qty", "disc", "rf",
            add("HOUR", c("pk") % 24, c("ts")).alias("transaction_timestamp"),
            F.concat(F.rpad(F.concat(F.lit("MERCHANT "), txt(c("sk") % 40)), 36, " "),
                     F.lpad(txt(c("sk") % 25), 2, "0")).alias("merchant_name_raw"),
            pick(SETTLED_CODES, c("pk") % 37).alias("transaction_cd"),
            pick(SETTLED_PROGRAMS, c("qty") % 4).alias("unique_program_id"),
            F.when((c("rf") == "N") & (c("disc") == 0), c("amt")).otherwise(-c("amt"))
            .cast("decimal(18,2)").alias("settled_amt"),
            F.when(c("pk") % 31 == 0, F.lit(None).cast("string"))
            .when(c("pk") % 30 == 10, F.lit("6010"))
            .otherwise(txt(c("pk") % 30 + 5000)).alias("mcc_cd"),
        )

    # T24
    @cached_property
    def settled_txn(self) -> DataFrame:
        return self.settled_ext.select(
            c("u").alias("user_id"), c("code").alias("authorization_code"),
            "transaction_timestamp", "merchant_name_raw", "transaction_cd",
            "unique_program_id", "settled_amt", "mcc_cd")

    # T3
    @cached_property
    def disputed_ext(self) -> DataFrame:
        s = self.settled_ext.filter(c("rf") == "R")
        # k = 2: the next account disputes the same transaction id, much later
        s = s.withColumn("k", F.explode(
            F.when(c("qty") % 5 == 0, F.array(F.lit(0), F.lit(1)))
            .when(c("qty") % 5 == 1, F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(0)))))
        return s.select(
            "pk", "sk", "qty", "k",
            (c("u") + F.when(c("k") == 2, 1).otherwise(0)).alias("user_id"),
            c("code").alias("authorization_code"),
            c("code").alias("unique_transaction_id"),
            c("transaction_cd").alias("transaction_code"),
            "transaction_timestamp",
            add("DAY", c("qty") % 15 + F.when(c("k") == 2, 4000).otherwise(c("k")), c("transaction_timestamp"))
            .alias("dispute_created_at"),
            pick(DISPUTE_REASONS, c("disc") % 4).alias("reason"),
            pick(DISPUTE_RESOLUTIONS, c("pk") % 3).alias("resolution"),
            pick(DISPUTE_DECISIONS, c("qty") % 4).alias("resolution_decision"),
            pick(RESOLUTION_CODES, c("sk") % 3).alias("resolution_code"),
            pick(CLOSE_CODES, c("pk") % 2).alias("close_code"),
            c("settled_amt").alias("transaction_amount"),
            F.when(c("qty") % 2 == 0, -c("settled_amt")).cast("decimal(18,2)")
            .alias("updated_transaction_amount"),
            F.concat(F.lit("MERCHANT "), txt(c("sk") % 40)).alias("merchant_name"),
            F.expr("code div 10").alias("user_dispute_claim_id"),
            (c("code") * 10 + c("k")).alias("user_dispute_claim_txn_id"),
        )

    @cached_property
    def disputed_txn(self) -> DataFrame:
        return self.disputed_ext.drop("pk", "sk", "qty", "k")

    # T1 (with rule helper columns)
    @cached_property
    def auth_ext(self) -> DataFrame:
        s = self.settled_ext.filter(c("pk") % 10 != 0)
        s = s.withColumn("m", F.explode(
            F.when(c("qty") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        return s.select(
            (c("code") * 10 + c("m")).alias("auth_event_id"),
            c("u").alias("user_id"),
            add("MINUTE", c("m"), c("transaction_timestamp")).alias("auth_event_created_ts"),
            pick(ACCOUNT_STATUS, c("sk") % 2).alias("account_status_cd"),
            pick(CARD_STATUS, c("pk") % 3).alias("card_status_cd"),
            (c("qty") * 10).cast("decimal(18,2)").alias("available_funds"),
            pick(NETWORKS, c("qty") % 3).alias("card_network_cd"),
            pick(SUB_NETWORKS, c("sk") % 3).alias("card_sub_network_cd"),
            c("merchant_name_raw").alias("auth_event_merchant_name_raw"),
            (-F.abs(c("settled_amt"))).cast("decimal(18,2)").alias("req_amt"),
            F.abs(c("settled_amt")).cast("decimal(18,2)").alias("final_amt"),
            c("transaction_timestamp").alias("trans_ts"),
            pick(MTI, c("m")).alias("mti_cd"),
            F.concat(F.lit("M"), txt(c("sk"))).alias("merch_id"),
            "mcc_cd",
            F.when(c("qty") % 11 == 0, F.lit(None).cast("double"))
            .otherwise((c("disc") * 10).cast("double")).alias("risk_score"),
            pick(PIN_RESULTS, c("pk") % 3).alias("pin_result_cd"),
            (c("sk") % 9 == 0).alias("is_international"),
            F.concat(F.lit("A"), txt(c("sk") % 7)).alias("acq_id"),
            pick(ENTRY_TYPES, c("sk") % 4).alias("entry_type"),
            (c("pk") % 2 == 0).alias("is_card_present"),
            (c("qty") % 2 == 0).alias("is_cardholder_present"),
            (c("code") + c("m") * FOLLOW_UP_OFFSET).alias("auth_id"),
            (c("code") * c("m")).alias("original_auth_id"),
            pick(RESPONSE_CODES, c("qty") % 10).alias("response_cd"),
            F.concat(F.lit("TKN"), F.lpad(txt(F.expr("code div 10")), 8, "0")).alias("pan"),
            # rule helpers for T2, T11, T12 (dropped by ``auth_event``)
            c("m").alias("_m"), c("pk").alias("_pk"), c("sk").alias("_sk"), c("qty").alias("_qty"),
        )

    # T2
    @cached_property
    def member_override(self) -> DataFrame:
        a = self.auth_ext.filter((c("_m") == 0) & (c("_qty") % 13 == 0))
        return a.select(
            "user_id",
            F.when(c("_sk") % 5 == 0, F.lit("other")).otherwise(F.lit(codes.OVERRIDE_DISABLE_RULES)).alias("type"),
            add("MINUTE", -(c("_pk") % 91), c("auth_event_created_ts")).alias("timestamp"),
        )

    @stored
    def claims(self) -> DataFrame:
        return self.disputed_ext.select(c("user_dispute_claim_id").alias("claim")).distinct()

    # T4
    @cached_property
    def inspector_dispute(self) -> DataFrame:
        return self.claims.filter(c("claim") % 9 != 0).select(
            (c("claim") + INSPECTOR_ID_OFFSET).alias("id"),
            txt(c("claim")).alias("claim_ext_id"),
            pick(INSPECTOR_INTAKE, c("claim") % 6).alias("intake_type"),
        )

    # T5
    @stored
    def inspector_txn(self) -> DataFrame:
        d = (self.disputed_ext.filter(c("unique_transaction_id") % 2 == 0)
             .select("unique_transaction_id", "user_dispute_claim_id", "transaction_code").distinct())
        return d.select(
            (c("user_dispute_claim_id") + INSPECTOR_ID_OFFSET).alias("dispute_id"),
            F.concat(txt(txn_family("transaction_code")), txt(c("unique_transaction_id"))).alias("transaction_ext_id"),
            pick(INSPECTOR_RESOLUTION, c("unique_transaction_id") % 3).alias("investigation_resolution"),
        )

    # T6
    @cached_property
    def member(self) -> DataFrame:
        return self.src.read("customer", ["c_custkey"]).select(c("c_custkey").alias("id"))

    # T25
    @cached_property
    def dim_member(self) -> DataFrame:
        cu = self.src.read("customer", ["c_custkey", "c_nationkey"])
        return cu.select(
            c("c_custkey").alias("user_id"),
            F.lpad(txt(c("c_nationkey")), 2, "0").alias("state_cd"),
            add("DAY", c("c_custkey") % 1500, F.lit(ENROLL_EPOCH).cast("timestamp_ntz"))
            .alias("enrollment_initiated_ts"),
        )

    # T7
    @cached_property
    def posted_ext(self) -> DataFrame:
        s = self.settled_ext.filter(c("pk") % 3 == 0)
        return s.select(
            "pk", "sk", "qty",
            c("u").alias("user_id"),
            "transaction_timestamp",
            c("code").alias("authorization_code"),
            F.when(c("qty") % 6 == 0, F.concat(F.lit("ACH transfer "), txt(c("sk"))))
            .when(c("qty") % 6 == 1, F.lit(None).cast("string"))
            .otherwise(F.lit("")).alias("transaction_details_2"),
            F.when(c("sk") % 7 == 0, F.lit("Cash Deposit")).otherwise(F.lit("Other")).alias("deposit_type_cd"),
            pick(POSTING_DESCRIPTIONS, c("sk") % 4).alias("description"),
            F.concat(F.lit("MERCHANT "), txt(c("sk") % 40)).alias("merchant_name"),
            pick(POSTING_TYPES, c("qty") % 4).alias("type"),
            "transaction_cd",
            F.when(c("sk") % 11 == 0, F.lit(777)).otherwise(c("unique_program_id")).alias("unique_program_id"),
            F.when(c("qty") % 3 == 0, F.lit(0).cast("bigint")).otherwise(F.expr("code div 10")).alias("card_id"),
            "settled_amt",
            "mcc_cd",
        )

    @cached_property
    def posted_txn(self) -> DataFrame:
        return self.posted_ext.drop("pk", "sk", "qty")

    # T8
    @cached_property
    def pay_friend(self) -> DataFrame:
        p = self.posted_ext.filter(c("description").isin(codes.PF_SENT, codes.PF_RECEIVED))
        sent = c("description") == codes.PF_SENT
        return p.select(
            c("authorization_code").alias("id"),
            F.when(sent, c("user_id")).otherwise(c("user_id") + 1).alias("sender_id"),
            F.when(sent, c("user_id") + 1).otherwise(c("user_id")).alias("receiver_id"),
            F.concat(F.lit("memo "), txt(c("authorization_code"))).alias("memo"),
            (-c("settled_amt")).cast("decimal(18,2)").alias("amount"),
            pick(PF_TYPE_CODES, c("qty") % 2).alias("type_code"),
            add("SECOND", c("pk") % 50, c("transaction_timestamp")).alias("created_at"),
            pick(FUNDING_TYPES, c("sk") % 2).alias("funding_source_type"),
        )

    # T10
    @cached_property
    def pay_friend_score(self) -> DataFrame:
        return self.pay_friend.filter(c("id") % 3 != 0).select(
            c("id").alias("pay_friend_id"), ((c("id") % 100).cast("double") / 100).alias("score"))

    # T9
    @cached_property
    def card(self) -> DataFrame:
        o = self.src.read("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"])
        return o.select(
            txt(c("o_orderkey")).alias("card_id"),
            c("o_custkey").alias("user_id"),
            F.concat(F.lit("TKN"), F.lpad(txt(c("o_orderkey")), 8, "0")).alias("card_number"),
            c("o_orderstatus").alias("card_type"),
            c("o_orderdate").alias("card_created_ts"),
            pick(CARD_STATES, c("o_orderkey") % 3).alias("card_status"),
            txt(F.to_date(add("DAY", 30, c("o_orderdate")))).alias("last_status_change_dt"),
            F.when(c("o_orderkey") % 5 == 0, F.lit(None).cast("timestamp_ntz"))
            .otherwise(add("DAY", 2, c("o_orderdate"))).alias("shipped_dt"),
        )

    # T11
    @cached_property
    def auth_decision(self) -> DataFrame:
        a = self.auth_ext.filter(c("_pk") % 2 == 1)
        outcome = pick(DECISION_OUTCOMES, c("_pk") % 7)
        return a.select(
            "user_id", "auth_id",
            F.when(c("_qty") % 6 == 0, F.lit("true")).otherwise(F.lit("false")).alias("is_shadow_mode"),
            F.when(c("_qty") % 5 == 0, F.lit("no_match")).otherwise(F.lit("criteria_met")).alias("policy_result"),
            F.when(c("_sk") % 3 == 0, F.lit("none")).otherwise(F.concat(F.lit("["), outcome, F.lit("]")))
            .alias("policy_actions"),
            outcome.alias("decision_outcome"),
            F.concat(F.lit("policy_"), txt(c("_sk") % 5)).alias("policy_name"),
        )

    # T12
    @cached_property
    def fraud_override(self) -> DataFrame:
        a = self.auth_ext.filter(c("response_cd") == "59")
        a = a.withColumn("r", F.explode(F.array(F.lit(0), F.lit(1))))
        return a.select(
            "user_id",
            c("auth_id").alias("realtime_auth_id"),
            F.when(c("_qty") % 3 == 0, F.lit(None).cast("bigint"))
            .otherwise(c("auth_id") * 10 + c("r")).alias("decision_id"),
            (c("_qty") % 4 == 0).alias("is_suppressed"),
            F.when(c("_sk") % 3 == 0, F.lit(None).cast("string"))
            .otherwise(pick(SIGNALS, c("r"))).alias("response_signal"),
            add("SECOND", (c("r") + 1) * 30, c("auth_event_created_ts")).alias("response_received_at"),
        )

    # T13
    @cached_property
    def alert_auth_event(self) -> DataFrame:
        s = self.settled_ext.filter((c("pk") % 10).isin(0, 1))
        return s.select(
            c("u").alias("user_id"),
            c("transaction_timestamp").alias("tran_timestamp"),
            c("code").alias("auth_id"),
            F.concat(F.lit("MERCHANT "), txt(c("sk") % 40)).alias("merch_name"),
            F.when(c("sk") % 9 == 0, F.lit(100)).otherwise(c("unique_program_id")).alias("prog_id"),
            c("settled_amt").alias("amount"),
            F.when(c("qty") % 3 == 0, F.lit("authorize")).otherwise(F.lit("settle")).alias("type"),
        )

    # T14
    @cached_property
    def dispute_claim(self) -> DataFrame:
        return self.claims.select(c("claim").alias("id"),
                                  pick(CLAIM_INTAKE, c("claim") % 4).alias("intake_type"))

    # T15
    @cached_property
    def dispute_contact(self) -> DataFrame:
        # some claims have two contacts, which tell different stories
        contacts = self.claims.withColumn("m", F.explode(
            F.when(c("claim") % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        return contacts.select(
            c("claim").alias("dispute_id"),
            F.when(c("claim") % 5 == 0, F.lit("Other")).otherwise(F.lit(codes.CONTACT_CATEGORY_FILING))
            .alias("dispute_contact_category"),
            F.when((c("claim") + c("m")) % 3 == 0, F.lit("App>chat")).otherwise(F.lit("ivr>agent"))
            .alias("interactions_str_seq"),
            pick(CONTACT_FLOWS, (c("claim") + c("m")) % 3).alias("contact_flow"),
        )

    def _events(self, *types: str) -> DataFrame:
        e = self.src.read("events", ["event_id", "ts", "user_id", "event_type"])
        return e.filter(c("event_type").isin(*types))

    # T17
    @cached_property
    def user_session(self) -> DataFrame:
        # some sessions come twice, from another place and device (m = 1)
        e = self._events("view").withColumn("m", F.explode(
            F.when(c("event_id") % 11 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        return e.select(
            "user_id",
            c("ts").alias("session_timestamp"),
            F.concat(F.lit("d"), txt(c("event_id") % 5)).alias("device_id"),
            pick(DEVICE_MODELS, (c("event_id") + c("m")) % 3).alias("device_model"),
            F.when(c("event_id") % 3 == 0, F.lit(None).cast("string")).otherwise(F.lit("en_US")).alias("locale"),
            pick(TIMEZONES, c("event_id") % 4).alias("timezone"),
            pick(CARRIERS, c("event_id") % 5).alias("network_carrier"),
            F.concat(F.lit("10.0."), txt(c("user_id")), F.lit("."), txt((c("event_id") + c("m")) % 8)).alias("ip"),
            pick(PLATFORMS, (c("event_id") + c("m")) % 2).alias("platform"),
        )

    # T18
    @stored
    def ip_geo_map(self) -> DataFrame:
        e = self._events("view").filter(c("event_id") % 8 < 6)
        return e.select(
            F.concat(F.lit("10.0."), txt(c("user_id")), F.lit("."), txt(c("event_id") % 8)).alias("ip"),
            (c("user_id") % 20).alias("geoname_id"),
        ).distinct()

    # T19
    @cached_property
    def geo_city(self) -> DataFrame:
        n = self.src.read("nation", ["n_nationkey"]).filter(c("n_nationkey") < 18)
        return n.select(c("n_nationkey").cast("bigint").alias("geoname_id"),
                        pick(CITY_ZONES, c("n_nationkey") % 4).alias("time_zone"))

    # T20
    @cached_property
    def login_alert(self) -> DataFrame:
        o = self.src.read("orders", ["o_orderkey", "o_custkey", "o_orderdate"])
        return o.select(
            c("o_custkey").alias("user_id"),
            F.concat(F.lit("d"), txt(c("o_orderkey") % 5)).alias("device_id"),
            add("DAY", c("o_orderkey") % 20, c("o_orderdate")).alias("session_timestamp"),
            F.when(c("o_orderkey") % 7 == 0, F.lit(0.0))
            .otherwise((c("o_orderkey") % 10).cast("double") / 10).alias("score"),
        )

    # T21
    @cached_property
    def login_request(self) -> DataFrame:
        e = self._events("view", "error")
        ok = c("event_type") == "view"
        # some requests come twice: both succeed up to a minute before the session (m = 1)
        e = e.withColumn("m", F.explode(
            F.when(c("event_id") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        back = F.when(c("m") == 1, c("event_id") % 60).otherwise(c("event_id") % 120)
        return e.select(
            "user_id",
            F.concat(F.lit("d"), txt(c("event_id") % 5)).alias("segment_device_id"),
            add("SECOND", -back - 20 - c("m"), c("ts")).alias("login_started_at"),
            F.when(ok, add("SECOND", -back, c("ts"))).alias("login_success_at"),
            F.when(c("event_id") % 4 == 0, F.lit(None).cast("string"))
            .otherwise(pick(TFA_METHODS, c("event_id") % 2)).alias("tfa_method"),
            pick(TFA_DEPRECATED, (c("event_id") + c("m")) % 3).alias("tfa_method_deprecated"),
            pick(PLATFORMS, c("event_id") % 2).alias("platform"),
            F.when(ok, F.lit(1)).otherwise(F.lit(0)).alias("login_success"),
            F.when(c("event_id") % 6 == 0, F.lit(1)).otherwise(F.lit(0)).alias("mfa_auth_success"),
        )

    # T22
    @cached_property
    def version_change(self) -> DataFrame:
        o = self.src.read("orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"])
        field = pick(PROFILE_FIELDS, F.substring(c("o_orderpriority"), 1, 1).cast("int") - 1)
        frm = F.concat(F.lit("old"), txt(c("o_orderkey") % 7))
        to = F.concat(F.lit("new"), txt(c("o_orderkey") % 11))
        return o.select(
            c("o_custkey").alias("item_id"),
            F.when(c("o_orderkey") % 10 == 0, F.lit("Account")).otherwise(F.lit("User")).alias("item_type"),
            add("MINUTE", c("o_orderkey") % 1440, c("o_orderdate")).alias("created_at"),
            c("o_orderkey").alias("versions_id"),
            F.concat(F.lit("---"), F.when(c("o_orderkey") % 4 == 0, F.lit("")).otherwise(F.lit("\n")),
                     field, F.lit(":\n- "), frm, F.lit("\n- "), to).alias("object_changes"),
            frm.alias("change_from"),
            to.alias("change_to"),
            F.when(c("o_orderkey") % 9 == 0, F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("admin"), txt(c("o_orderkey") % 3))).alias("whodunnit"),
        )

    # T23
    @cached_property
    def menu_tap(self) -> DataFrame:
        e = self._events("click")
        return e.select(
            F.when(c("event_id") % 7 == 0, F.concat(F.lit("anon-"), txt(c("event_id"))))
            .when(c("event_id") % 7 == 1, F.concat(txt(c("user_id")), F.lit(".4")))
            .when(c("event_id") % 7 == 2, F.lit("99999999999999999999"))
            .otherwise(txt(c("user_id"))).alias("user_id"),
            c("ts").alias("original_timestamp"),
            F.concat(F.lit("d"), txt(c("event_id") % 5)).alias("context_device_id"),
            pick(MENU_LOCATIONS, c("event_id") % 3).alias("location"),
            pick(MENU_LABELS, c("event_id") % 2).alias("label"),
            pick(MENU_ITEMS, (c("event_id") % 4) % 3).alias("unique_id"),
        )

    # T1
    @cached_property
    def auth_event(self) -> DataFrame:
        return self.auth_ext.drop("_m", "_pk", "_sk", "_qty")


RELATIONS = (
    "auth_event", "member_override", "disputed_txn", "inspector_dispute", "inspector_txn",
    "member", "posted_txn", "pay_friend", "card", "pay_friend_score", "auth_decision",
    "fraud_override", "alert_auth_event", "dispute_claim", "dispute_contact", "user_session",
    "ip_geo_map", "geo_city", "login_alert", "login_request", "version_change", "menu_tap",
    "settled_txn", "dim_member",
)


def relation(fx: Fixtures, name: str) -> DataFrame:
    return getattr(fx, name)
