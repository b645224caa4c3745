"""Conditional and bucket mappings, each a function from Columns to a Column.

All are CASE chains on built-in expressions: they stay inside whole-stage
codegen and need no Python at run time. Order of the branches matters and is
kept as in the analyses.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from disputelens.functions import codes
from disputelens.functions.semantics import col


def merchant_state(network: Column | str, merchant_raw: Column | str) -> Column:
    """Mastercard: text from position 38; Visa: 2 characters at 37; else NULL."""
    raw = col(merchant_raw)
    return (F.when(col(network) == "Mastercard", F.trim(F.substring(raw, 38, 1 << 30)))
            .when(col(network) == "Visa", F.trim(F.substring(raw, 37, 2))))


def settled_merchant_state(merchant_raw: Column | str) -> Column:
    return F.trim(F.substring(col(merchant_raw), 37, 2))


def dispute_flags(matched: Column, reason: Column | str, resolution: Column | str,
                  decision: Column | str) -> dict[str, Column]:
    """The five 0/1 dispute indicators of the risk cut (the day gap is separate)."""
    unauth = col(reason).isin(*codes.UNAUTHORIZED_REASONS)
    approved = col(decision).isin(*codes.APPROVED_DECISIONS)
    pending = (col(resolution) == codes.PENDING_RESOLUTION) | col(resolution).isNull()

    def flag(cond: Column) -> Column:
        return F.when(cond, F.lit(1)).otherwise(F.lit(0))

    return {
        "dispute_ind": flag(matched),
        "dispute_unauth_ind": flag(matched & unauth),
        "dispute_unauth_pending_ind": flag(matched & unauth & pending),
        "dispute_aprv_ind": flag(approved),
        "dispute_unauth_aprv_ind": flag(approved & unauth),
    }


def txn_family(txn_code: Column | str) -> Column:
    """Family digit by code prefix: AD 4, FE 5, IS 6, PM 7, SD 8, VS 9, else 0."""
    out = None
    for prefix, digit in codes.TXN_FAMILY_DIGITS:
        cond = col(txn_code).startswith(prefix)
        out = F.when(cond, F.lit(digit)) if out is None else out.when(cond, F.lit(digit))
    return out.otherwise(F.lit(0))


def inspector_ext_id(txn_code: Column | str, auth_code: Column | str) -> Column:
    """Composite external id: family digit followed by the authorisation code."""
    return F.concat(txn_family(txn_code).cast("string"), col(auth_code).cast("string"))


def counterparty(details: Column | str, deposit_type: Column | str, description: Column | str,
                 receiver_id: Column | str, sender_id: Column | str,
                 merchant_name: Column | str) -> Column:
    return (F.when(col(details) != "", col(details))
            .when(col(deposit_type) == "Cash Deposit", col(deposit_type))
            .when(col(description) == codes.PF_SENT,
                  F.concat(F.lit("receiver id:"), col(receiver_id).cast("string")))
            .when(col(description) == codes.PF_RECEIVED,
                  F.concat(F.lit("sender id:"), col(sender_id).cast("string")))
            .otherwise(col(merchant_name)))


def transfer_kind(type_code: Column | str) -> Column:
    return F.when(col(type_code) == "to_member", F.lit("PF")).otherwise(F.lit("PA"))


def transfer_description(description: Column | str, kind: Column | str,
                         txn_code: Column | str, score: Column | str) -> Column:
    """Description + code + score; NULL whenever any piece (e.g. the score) is NULL."""
    d, k = col(description), col(kind)
    text = (F.when((d == codes.PF_SENT) & (k == "PF"), F.lit(codes.PF_SENT))
            .when((d == codes.PF_SENT) & (k == "PA"), F.lit(codes.PA_SENT))
            .when((d == codes.PF_RECEIVED) & (k == "PF"), F.lit(codes.PF_RECEIVED))
            .when((d == codes.PF_RECEIVED) & (k == "PA"), F.lit(codes.PA_RECEIVED))
            .otherwise(d))
    return F.concat(text, F.lit("; Tran_cd: "), col(txn_code),
                    F.lit("; Prism Score: "), col(score).cast("string"))


def account_type(program: Column | str, card_id: Column | str, card_number: Column | str) -> Column:
    p, c = col(program), col(card_id)
    return (F.when(p.isin(*codes.CHECKING_PROGRAMS) & (c != 0),
                   F.concat(F.lit("checking "), F.right(col(card_number), F.lit(4))))
            .when(p.isin(*codes.CREDIT_BUILDER_PROGRAMS), F.lit("CB"))
            .when(p.isin(*codes.CHECKING_PROGRAMS) & (c == 0), F.lit("savings"))
            .otherwise(p.cast("string")))


def force_post_account_type(program: Column | str, pan: Column | str) -> Column:
    p, last4 = col(program), F.right(col(pan), F.lit(4))
    return (F.when(p.isin(*codes.CHECKING_PROGRAMS), F.concat(F.lit("checking "), last4))
            .when(p.isin(*codes.CREDIT_BUILDER_PROGRAMS), F.concat(F.lit("CB "), last4))
            .otherwise(p.cast("string")))


def is_approved(response_cd: Column | str) -> Column:
    return col(response_cd).isin(*codes.APPROVED_RESPONSE_CODES)


def auth_decision_text(response_cd: Column | str) -> Column:
    return F.when(is_approved(response_cd), F.lit("Approved")).otherwise(F.lit("Declined"))


def auth_kind(mcc: Column | str) -> Column:
    return F.when(col(mcc).isin(*codes.WITHDRAWAL_MCCS), F.lit("Withdrawal")).otherwise(F.lit("Purchase"))


def decline_reason(response_cd: Column | str) -> Column:
    """'n/a' when approved, else '<code> <text>' with the code itself as text if unlisted."""
    r = col(response_cd)
    text = None
    for code, label in codes.DECLINE_REASONS:
        text = F.when(r == code, F.lit(label)) if text is None else text.when(r == code, F.lit(label))
    text = text.otherwise(r)
    return F.when(is_approved(r), F.lit("n/a")).otherwise(F.concat(r, F.lit(" "), text))


def rule_outcome(response_cd: Column | str, policy_name: Column | str, decision_outcome: Column | str,
                 override_decision_id: Column | str, is_suppressed: Column | str,
                 response_signal: Column | str) -> Column:
    r = col(response_cd)
    override = (F.when(col(override_decision_id).isNull(), col(decision_outcome))
                .when(col(is_suppressed) == F.lit(True), F.lit("suppressed"))
                .when(col(response_signal).isNull(), F.lit("no response"))
                .otherwise(col(response_signal)))
    return (F.when(r == codes.RULE_DENIED_RESPONSE_CODE,
                   F.concat(col(policy_name), F.lit(" -"), override))
            .when(is_approved(r), F.concat(col(policy_name), F.lit(" -"), col(decision_outcome)))
            .otherwise(F.lit("n/a")))


def intake_channel(claim_intake: Column | str, inspector_intake: Column | str,
                   interactions: Column | str, contact_flow: Column | str) -> Column:
    ii = col(inspector_intake)
    return (F.when(F.coalesce(col(claim_intake), ii) == "mobile", F.lit("in_app"))
            .when(ii.isin("fax", "paper_mail"), F.lit("email"))
            .when(ii.isNotNull(), ii)
            .when(col(interactions).ilike("%app%"), F.lit("chat_bot"))
            .when(col(contact_flow).ilike("%phone%"), F.lit("phone"))
            .when(col(contact_flow).ilike("%email%"), F.lit("email"))
            .otherwise(F.lit("agent_channel_unknown")))


def yes_no(matched: Column) -> Column:
    return F.when(matched, F.lit("yes")).otherwise(F.lit("no"))


def product_type(txn_code: Column | str, program: Column | str) -> Column:
    return (F.when(col(txn_code).isin(*codes.ATM_CODES), F.lit("atm"))
            .when(col(program).isin(*codes.CREDIT_PURCHASE_PROGRAMS), F.lit("credit_purchase"))
            .otherwise(F.lit("debit_purchase")))


def tenure_bucket(months: Column | str) -> Column:
    m = col(months)
    return (F.when(m < 12, F.lit("1. <12"))
            .when(m < 24, F.lit("2. 12-24"))
            .when(m < 36, F.lit("3. 24-36"))
            .otherwise(F.lit("9. >=36")))


def amount_bucket(amount: Column | str) -> Column:
    a = col(amount)
    return (F.when(a <= 0, F.lit("1. <=0"))
            .when(a < 100, F.lit("2. 0-100"))
            .when(a < 500, F.lit("3. 100-500"))
            .when(a < 1000, F.lit("4. 500-1k"))
            .otherwise(F.lit("9. >=1k")))


def risk_bucket(score: Column | str) -> Column:
    """Tens up to 50. The 20-30 label reads '3. 20-50' in the report; NULL -> '9. >=50'."""
    s = col(score)
    return (F.when(s < 10, F.lit("1. <10"))
            .when(s < 20, F.lit("2. 10-20"))
            .when(s < 30, F.lit("3. 20-50"))
            .when(s < 40, F.lit("4. 30-40"))
            .when(s < 50, F.lit("5. 40-50"))
            .otherwise(F.lit("9. >=50")))


def dispute_within(created: Column | str, txn_ts: Column | str, days: int | Column) -> Column:
    """1 if the dispute was opened within ``days`` of the transaction (no lower bound)."""
    n = days if isinstance(days, Column) else F.lit(days)
    return F.when(col(created) <= F.timestamp_add("DAY", n, col(txn_ts)), F.lit(1)).otherwise(F.lit(0))


def login_flag(score: Column | str) -> Column:
    return F.when(col(score).isNotNull(), F.lit("new dvc login")).otherwise(F.lit("no new dvc"))


def login_score_bucket(score: Column | str) -> Column:
    s = col(score)
    return (F.when(s.isNull(), F.lit("0. no new dvc"))
            .when(s < 0.1, F.lit("1. <0.1"))
            .when(s < 0.2, F.lit("2. <0.2"))
            .when(s < 0.3, F.lit("3. <0.3"))
            .when(s < 0.4, F.lit("4. <0.4"))
            .when(s < 0.5, F.lit("5. <0.5"))
            .otherwise(F.lit("9. >=0.5")))


def change_type(field: Column | str) -> Column:
    f = col(field)
    return F.when(f == "status", F.lit("status change")).otherwise(F.concat(f, F.lit(" "), F.lit("change")))


def changed_field(object_changes: Column | str) -> Column:
    """Text between '---' and the first ':' (a leading newline is kept)."""
    head = F.split_part(col(object_changes), F.lit(":"), F.lit(1))
    return F.split_part(head, F.lit("---"), F.lit(2))
