"""DuckDB SQL for the 24 derived relations (same rules as ``sources.fixtures``).

``with_relations(query, names)`` prefixes ``query`` with the CTEs it needs, in
dependency order, so each oracle query is one self-contained statement over
the driver's pre-registered tables.
"""

from __future__ import annotations

from disputelens.functions import codes
from disputelens.sources import fixtures as fx


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return str(v)


def pick(values, idx: str) -> str:
    arms = " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(values))
    return f"(CASE ({idx}) {arms} END)"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def family_digit(col: str) -> str:
    arms = " ".join(f"WHEN {col} LIKE '{p}%' THEN {d}" for p, d in codes.TXN_FAMILY_DIGITS)
    return f"(CASE {arms} ELSE 0 END)"


def add(unit: str, n: str, ts: str) -> str:
    fn = {"DAY": "to_days", "HOUR": "to_hours", "MINUTE": "to_minutes", "SECOND": "to_seconds"}[unit]
    cast = "DOUBLE" if unit == "SECOND" else "INTEGER"
    return f"({ts} + {fn}(CAST({n} AS {cast})))"


RELATIONS: dict[str, tuple[tuple[str, ...], str]] = {}


def rel(name: str, deps: tuple[str, ...], sql: str) -> None:
    RELATIONS[name] = (deps, sql)


rel("line_base", (), """
SELECT l.l_orderkey * 10 + l.l_linenumber AS code,
       o.o_custkey AS u,
       min(l.l_shipdate) AS ts,
       CAST(sum(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS amt,
       min(l.l_partkey) AS pk,
       min(l.l_suppkey) AS sk,
       min(l.l_returnflag) AS rf,
       CAST(round(min(l.l_discount) * 100) AS INTEGER) AS disc,
       CAST(min(l.l_quantity) AS INTEGER) AS qty
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
GROUP BY l.l_orderkey, l.l_linenumber, o.o_custkey""")

rel("settled_ext", ("line_base",), f"""
SELECT code, u, pk, sk, qty, disc, rf,
       {add('HOUR', 'pk % 24', 'ts')} AS transaction_timestamp,
       rpad('MERCHANT ' || CAST(sk % 40 AS VARCHAR), 36, ' ') || lpad(CAST(sk % 25 AS VARCHAR), 2, '0') AS merchant_name_raw,
       {pick(fx.SETTLED_CODES, 'pk % 37')} AS transaction_cd,
       CAST({pick(fx.SETTLED_PROGRAMS, 'qty % 4')} AS INTEGER) AS unique_program_id,
       CAST(CASE WHEN rf = 'N' AND disc = 0 THEN amt ELSE -amt END AS DECIMAL(18,2)) AS settled_amt,
       CASE WHEN pk % 31 = 0 THEN NULL WHEN pk % 30 = 10 THEN '6010'
            ELSE CAST(pk % 30 + 5000 AS VARCHAR) END AS mcc_cd
FROM line_base""")

rel("settled_txn", ("settled_ext",), """
SELECT u AS user_id, code AS authorization_code, transaction_timestamp, merchant_name_raw,
       transaction_cd, unique_program_id, settled_amt, mcc_cd
FROM settled_ext""")

rel("disputed_ext", ("settled_ext",), f"""
SELECT pk, sk, qty, k,
       u + CASE WHEN k = 2 THEN 1 ELSE 0 END AS user_id, code AS authorization_code, code AS unique_transaction_id,
       transaction_cd AS transaction_code, transaction_timestamp,
       {add('DAY', 'qty % 15 + CASE WHEN k = 2 THEN 4000 ELSE k END', 'transaction_timestamp')} AS dispute_created_at,
       {pick(fx.DISPUTE_REASONS, 'disc % 4')} AS reason,
       {pick(fx.DISPUTE_RESOLUTIONS, 'pk % 3')} AS resolution,
       {pick(fx.DISPUTE_DECISIONS, 'qty % 4')} AS resolution_decision,
       {pick(fx.RESOLUTION_CODES, 'sk % 3')} AS resolution_code,
       {pick(fx.CLOSE_CODES, 'pk % 2')} AS close_code,
       settled_amt AS transaction_amount,
       CAST(CASE WHEN qty % 2 = 0 THEN -settled_amt END AS DECIMAL(18,2)) AS updated_transaction_amount,
       'MERCHANT ' || CAST(sk % 40 AS VARCHAR) AS merchant_name,
       code // 10 AS user_dispute_claim_id,
       code * 10 + k AS user_dispute_claim_txn_id
FROM settled_ext, (SELECT unnest([0, 1, 2]) AS k) ks
WHERE rf = 'R' AND (k = 0 OR k = 1 AND qty % 5 = 0 OR k = 2 AND qty % 5 = 1)""")

rel("disputed_txn", ("disputed_ext",), """
SELECT user_id, authorization_code, unique_transaction_id, transaction_code, transaction_timestamp,
       dispute_created_at, reason, resolution, resolution_decision, resolution_code, close_code,
       transaction_amount, updated_transaction_amount, merchant_name, user_dispute_claim_id,
       user_dispute_claim_txn_id
FROM disputed_ext""")

rel("auth_ext", ("settled_ext",), f"""
SELECT code * 10 + m AS auth_event_id,
       u AS user_id,
       {add('MINUTE', 'm', 'transaction_timestamp')} AS auth_event_created_ts,
       {pick(fx.ACCOUNT_STATUS, 'sk % 2')} AS account_status_cd,
       {pick(fx.CARD_STATUS, 'pk % 3')} AS card_status_cd,
       CAST(qty * 10 AS DECIMAL(18,2)) AS available_funds,
       {pick(fx.NETWORKS, 'qty % 3')} AS card_network_cd,
       {pick(fx.SUB_NETWORKS, 'sk % 3')} AS card_sub_network_cd,
       merchant_name_raw AS auth_event_merchant_name_raw,
       CAST(-abs(settled_amt) AS DECIMAL(18,2)) AS req_amt,
       CAST(abs(settled_amt) AS DECIMAL(18,2)) AS final_amt,
       transaction_timestamp AS trans_ts,
       {pick(fx.MTI, 'm')} AS mti_cd,
       'M' || CAST(sk AS VARCHAR) AS merch_id,
       mcc_cd,
       CASE WHEN qty % 11 = 0 THEN NULL ELSE CAST(disc * 10 AS DOUBLE) END AS risk_score,
       {pick(fx.PIN_RESULTS, 'pk % 3')} AS pin_result_cd,
       (sk % 9 = 0) AS is_international,
       'A' || CAST(sk % 7 AS VARCHAR) AS acq_id,
       {pick(fx.ENTRY_TYPES, 'sk % 4')} AS entry_type,
       (pk % 2 = 0) AS is_card_present,
       (qty % 2 = 0) AS is_cardholder_present,
       code + m * {fx.FOLLOW_UP_OFFSET} AS auth_id,
       code * m AS original_auth_id,
       {pick(fx.RESPONSE_CODES, 'qty % 10')} AS response_cd,
       'TKN' || lpad(CAST(code // 10 AS VARCHAR), 8, '0') AS pan,
       m AS _m, pk AS _pk, sk AS _sk, qty AS _qty
FROM settled_ext, (SELECT unnest([0, 1]) AS m) ms
WHERE pk % 10 <> 0 AND (m = 0 OR qty % 7 = 0)""")

rel("auth_event", ("auth_ext",), """
SELECT * EXCLUDE (_m, _pk, _sk, _qty) FROM auth_ext""")

rel("member_override", ("auth_ext",), f"""
SELECT user_id,
       CASE WHEN _sk % 5 = 0 THEN 'other' ELSE {lit(codes.OVERRIDE_DISABLE_RULES)} END AS type,
       {add('MINUTE', '-(_pk % 91)', 'auth_event_created_ts')} AS timestamp
FROM auth_ext WHERE _m = 0 AND _qty % 13 = 0""")

rel("claims", ("disputed_ext",), """
SELECT DISTINCT user_dispute_claim_id AS claim FROM disputed_ext""")

rel("inspector_dispute", ("claims",), f"""
SELECT claim + {fx.INSPECTOR_ID_OFFSET} AS id, CAST(claim AS VARCHAR) AS claim_ext_id,
       {pick(fx.INSPECTOR_INTAKE, 'claim % 6')} AS intake_type
FROM claims WHERE claim % 9 <> 0""")

rel("inspector_txn", ("disputed_ext",), f"""
SELECT user_dispute_claim_id + {fx.INSPECTOR_ID_OFFSET} AS dispute_id,
       CAST({family_digit('transaction_code')} AS VARCHAR) || CAST(unique_transaction_id AS VARCHAR) AS transaction_ext_id,
       {pick(fx.INSPECTOR_RESOLUTION, 'unique_transaction_id % 3')} AS investigation_resolution
FROM (SELECT DISTINCT unique_transaction_id, user_dispute_claim_id, transaction_code
      FROM disputed_ext WHERE unique_transaction_id % 2 = 0) d""")

rel("member", (), "SELECT c_custkey AS id FROM customer")

rel("dim_member", (), f"""
SELECT c_custkey AS user_id, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS state_cd,
       {add('DAY', 'c_custkey % 1500', "TIMESTAMP '" + fx.ENROLL_EPOCH + "'")} AS enrollment_initiated_ts
FROM customer""")

rel("posted_ext", ("settled_ext",), f"""
SELECT pk, sk, qty,
       u AS user_id, transaction_timestamp, code AS authorization_code,
       CASE WHEN qty % 6 = 0 THEN 'ACH transfer ' || CAST(sk AS VARCHAR)
            WHEN qty % 6 = 1 THEN NULL ELSE '' END AS transaction_details_2,
       CASE WHEN sk % 7 = 0 THEN 'Cash Deposit' ELSE 'Other' END AS deposit_type_cd,
       {pick(fx.POSTING_DESCRIPTIONS, 'sk % 4')} AS description,
       'MERCHANT ' || CAST(sk % 40 AS VARCHAR) AS merchant_name,
       {pick(fx.POSTING_TYPES, 'qty % 4')} AS type,
       transaction_cd,
       CAST(CASE WHEN sk % 11 = 0 THEN 777 ELSE unique_program_id END AS INTEGER) AS unique_program_id,
       CAST(CASE WHEN qty % 3 = 0 THEN 0 ELSE code // 10 END AS BIGINT) AS card_id,
       settled_amt, mcc_cd
FROM settled_ext WHERE pk % 3 = 0""")

rel("posted_txn", ("posted_ext",), "SELECT * EXCLUDE (pk, sk, qty) FROM posted_ext")

rel("pay_friend", ("posted_ext",), f"""
SELECT authorization_code AS id,
       CASE WHEN description = {lit(codes.PF_SENT)} THEN user_id ELSE user_id + 1 END AS sender_id,
       CASE WHEN description = {lit(codes.PF_SENT)} THEN user_id + 1 ELSE user_id END AS receiver_id,
       'memo ' || CAST(authorization_code AS VARCHAR) AS memo,
       CAST(-settled_amt AS DECIMAL(18,2)) AS amount,
       {pick(fx.PF_TYPE_CODES, 'qty % 2')} AS type_code,
       {add('SECOND', 'pk % 50', 'transaction_timestamp')} AS created_at,
       {pick(fx.FUNDING_TYPES, 'sk % 2')} AS funding_source_type
FROM posted_ext WHERE description IN ({lit(codes.PF_SENT)}, {lit(codes.PF_RECEIVED)})""")

rel("pay_friend_score", ("pay_friend",), """
SELECT id AS pay_friend_id, CAST(id % 100 AS DOUBLE) / 100 AS score
FROM pay_friend WHERE id % 3 <> 0""")

rel("card", (), f"""
SELECT CAST(o_orderkey AS VARCHAR) AS card_id, o_custkey AS user_id,
       'TKN' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS card_number,
       o_orderstatus AS card_type, o_orderdate AS card_created_ts,
       {pick(fx.CARD_STATES, 'o_orderkey % 3')} AS card_status,
       CAST(CAST({add('DAY', '30', 'o_orderdate')} AS DATE) AS VARCHAR) AS last_status_change_dt,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE {add('DAY', '2', 'o_orderdate')} END AS shipped_dt
FROM orders""")

rel("auth_decision", ("auth_ext",), f"""
SELECT user_id, auth_id,
       CASE WHEN _qty % 6 = 0 THEN 'true' ELSE 'false' END AS is_shadow_mode,
       CASE WHEN _qty % 5 = 0 THEN 'no_match' ELSE 'criteria_met' END AS policy_result,
       CASE WHEN _sk % 3 = 0 THEN 'none' ELSE '[' || {pick(fx.DECISION_OUTCOMES, '_pk % 7')} || ']' END AS policy_actions,
       {pick(fx.DECISION_OUTCOMES, '_pk % 7')} AS decision_outcome,
       'policy_' || CAST(_sk % 5 AS VARCHAR) AS policy_name
FROM auth_ext WHERE _pk % 2 = 1""")

rel("fraud_override", ("auth_ext",), f"""
SELECT user_id, auth_id AS realtime_auth_id,
       CASE WHEN _qty % 3 = 0 THEN NULL ELSE auth_id * 10 + r END AS decision_id,
       (_qty % 4 = 0) AS is_suppressed,
       CASE WHEN _sk % 3 = 0 THEN NULL ELSE {pick(fx.SIGNALS, 'r')} END AS response_signal,
       {add('SECOND', '(r + 1) * 30', 'auth_event_created_ts')} AS response_received_at
FROM auth_ext, (SELECT unnest([0, 1]) AS r) rs
WHERE response_cd = '59'""")

rel("alert_auth_event", ("settled_ext",), """
SELECT u AS user_id, transaction_timestamp AS tran_timestamp, code AS auth_id,
       'MERCHANT ' || CAST(sk % 40 AS VARCHAR) AS merch_name,
       CAST(CASE WHEN sk % 9 = 0 THEN 100 ELSE unique_program_id END AS INTEGER) AS prog_id,
       settled_amt AS amount,
       CASE WHEN qty % 3 = 0 THEN 'authorize' ELSE 'settle' END AS type
FROM settled_ext WHERE pk % 10 IN (0, 1)""")

rel("dispute_claim", ("claims",), f"""
SELECT claim AS id, {pick(fx.CLAIM_INTAKE, 'claim % 4')} AS intake_type FROM claims""")

rel("dispute_contact", ("claims",), f"""
SELECT claim AS dispute_id,
       CASE WHEN claim % 5 = 0 THEN 'Other' ELSE {lit(codes.CONTACT_CATEGORY_FILING)} END AS dispute_contact_category,
       CASE WHEN (claim + m) % 3 = 0 THEN 'App>chat' ELSE 'ivr>agent' END AS interactions_str_seq,
       {pick(fx.CONTACT_FLOWS, '(claim + m) % 3')} AS contact_flow
FROM claims, (SELECT unnest([0, 1]) AS m) ms WHERE m = 0 OR claim % 4 = 0""")

rel("user_session", (), f"""
SELECT user_id, ts AS session_timestamp,
       'd' || CAST(event_id % 5 AS VARCHAR) AS device_id,
       {pick(fx.DEVICE_MODELS, '(event_id + m) % 3')} AS device_model,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'en_US' END AS locale,
       {pick(fx.TIMEZONES, 'event_id % 4')} AS timezone,
       {pick(fx.CARRIERS, 'event_id % 5')} AS network_carrier,
       '10.0.' || CAST(user_id AS VARCHAR) || '.' || CAST((event_id + m) % 8 AS VARCHAR) AS ip,
       {pick(fx.PLATFORMS, '(event_id + m) % 2')} AS platform
FROM events, (SELECT unnest([0, 1]) AS m) ms WHERE event_type = 'view' AND (m = 0 OR event_id % 11 = 0)""")

rel("ip_geo_map", (), """
SELECT DISTINCT '10.0.' || CAST(user_id AS VARCHAR) || '.' || CAST(event_id % 8 AS VARCHAR) AS ip,
       user_id % 20 AS geoname_id
FROM events WHERE event_type = 'view' AND event_id % 8 < 6""")

rel("geo_city", (), f"""
SELECT CAST(n_nationkey AS BIGINT) AS geoname_id, {pick(fx.CITY_ZONES, 'n_nationkey % 4')} AS time_zone
FROM nation WHERE n_nationkey < 18""")

rel("login_alert", (), f"""
SELECT o_custkey AS user_id, 'd' || CAST(o_orderkey % 5 AS VARCHAR) AS device_id,
       {add('DAY', 'o_orderkey % 20', 'o_orderdate')} AS session_timestamp,
       CASE WHEN o_orderkey % 7 = 0 THEN 0.0 ELSE CAST(o_orderkey % 10 AS DOUBLE) / 10 END AS score
FROM orders""")

rel("login_request", (), f"""
SELECT user_id, 'd' || CAST(event_id % 5 AS VARCHAR) AS segment_device_id,
       {add('SECOND', '-(event_id % (CASE WHEN m = 1 THEN 60 ELSE 120 END)) - 20 - m', 'ts')} AS login_started_at,
       CASE WHEN event_type = 'view'
            THEN {add('SECOND', '-(event_id % (CASE WHEN m = 1 THEN 60 ELSE 120 END))', 'ts')} END AS login_success_at,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE {pick(fx.TFA_METHODS, 'event_id % 2')} END AS tfa_method,
       {pick(fx.TFA_DEPRECATED, '(event_id + m) % 3')} AS tfa_method_deprecated,
       {pick(fx.PLATFORMS, 'event_id % 2')} AS platform,
       CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS login_success,
       CASE WHEN event_id % 6 = 0 THEN 1 ELSE 0 END AS mfa_auth_success
FROM events, (SELECT unnest([0, 1]) AS m) ms
WHERE event_type IN ('view', 'error') AND (m = 0 OR event_id % 5 = 0)""")

_field = pick(fx.PROFILE_FIELDS, "CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1")
rel("version_change", (), f"""
SELECT o_custkey AS item_id,
       CASE WHEN o_orderkey % 10 = 0 THEN 'Account' ELSE 'User' END AS item_type,
       {add('MINUTE', 'o_orderkey % 1440', 'o_orderdate')} AS created_at,
       o_orderkey AS versions_id,
       '---' || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE chr(10) END || {_field} || ':' || chr(10) || '- '
         || 'old' || CAST(o_orderkey % 7 AS VARCHAR) || chr(10) || '- ' || 'new' || CAST(o_orderkey % 11 AS VARCHAR)
         AS object_changes,
       'old' || CAST(o_orderkey % 7 AS VARCHAR) AS change_from,
       'new' || CAST(o_orderkey % 11 AS VARCHAR) AS change_to,
       CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'admin' || CAST(o_orderkey % 3 AS VARCHAR) END AS whodunnit
FROM orders""")

rel("menu_tap", (), f"""
SELECT CASE WHEN event_id % 7 = 0 THEN 'anon-' || CAST(event_id AS VARCHAR)
            WHEN event_id % 7 = 1 THEN CAST(user_id AS VARCHAR) || '.4'
            WHEN event_id % 7 = 2 THEN '99999999999999999999'
            ELSE CAST(user_id AS VARCHAR) END AS user_id,
       ts AS original_timestamp,
       'd' || CAST(event_id % 5 AS VARCHAR) AS context_device_id,
       {pick(fx.MENU_LOCATIONS, 'event_id % 3')} AS location,
       {pick(fx.MENU_LABELS, 'event_id % 2')} AS label,
       {pick(fx.MENU_ITEMS, '(event_id % 4) % 3')} AS unique_id
FROM events WHERE event_type = 'click'""")


def _order(names) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        if n in out:
            return
        for d in RELATIONS[n][0]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def with_relations(query: str, names) -> str:
    """``WITH <relations and their dependencies> <query>``."""
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({RELATIONS[n][1].strip()})" for n in _order(names))
    return f"WITH {ctes}\n{query.strip()}"
