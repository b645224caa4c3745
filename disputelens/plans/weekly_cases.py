"""Weekly top cases: accounts with the most approved unauthorised-dispute dollars.

Steps: disputes opened in the last complete week with a listed code ->
inspector case (claim id as text) -> latest row per transaction -> inspector
transaction on the composite external id (fan-out kept: it counts) -> approved
and unauthorised -> sum per (user, week) -> top n.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from disputelens.functions import codes
from disputelens.functions.mappings import inspector_ext_id, txn_family
from disputelens.functions.semantics import asc, desc, week_start
from disputelens.operators.dedup import keep_first
from disputelens.operators.joins import semi_join
from disputelens.operators.topn import top_k


def ntz(value: dt.date | dt.datetime | str):
    """A TIMESTAMP_NTZ literal (constant-folded, comparable without casts)."""
    return F.lit(str(value)).cast("timestamp_ntz")


def last_complete_week(as_of: dt.date) -> tuple[dt.date, dt.date]:
    """[Monday of the week before ``as_of``'s week, Monday of ``as_of``'s week)."""
    monday = as_of - dt.timedelta(days=as_of.weekday())
    return monday - dt.timedelta(days=7), monday


def week_disputes(disputes: DataFrame, as_of: dt.date) -> DataFrame:
    lo, hi = last_complete_week(as_of)
    return disputes.filter((F.col("dispute_created_at") >= ntz(lo)) & (F.col("dispute_created_at") < ntz(hi))
                           & F.col("transaction_code").isin(*codes.WEEKLY_CASE_CODES))


def weekly_case_rows(disputes: DataFrame, insp_disputes: DataFrame, as_of: dt.date) -> DataFrame:
    """Disputes of the last complete week, one (latest) row per transaction."""
    d = week_disputes(disputes, as_of)
    i = insp_disputes.select(F.col("id").alias("r_inspector_dispute_id"),
                             F.col("claim_ext_id").cast("string").alias("_claim_ext_id"))
    # one week of disputes against all inspector cases: cut the cases first
    i = semi_join(i, d.select(d.user_dispute_claim_id.cast("string").alias("_c")), "_claim_ext_id", "_c")
    d = (d.join(i, d.user_dispute_claim_id.cast("string") == F.col("_claim_ext_id"), "left")
         .drop("_claim_ext_id")
         .withColumn("transaction_id", txn_family("transaction_code")))
    return keep_first(d, ["unique_transaction_id"],
                      [desc("dispute_created_at"), desc("user_dispute_claim_txn_id"),
                       asc("r_inspector_dispute_id")])


def weekly_top_cases(disputes: DataFrame, insp_disputes: DataFrame, insp_txns: DataFrame,
                     as_of: dt.date, n: int = 10) -> DataFrame:
    d = weekly_case_rows(disputes, insp_disputes, as_of)
    d = d.withColumn("_ext_id", inspector_ext_id("transaction_code", "authorization_code"))
    t = insp_txns.select(F.col("dispute_id").alias("_t_dispute_id"),
                         F.col("transaction_ext_id").alias("_t_ext_id"),
                         F.col("investigation_resolution"))
    ids = week_disputes(disputes, as_of).select(inspector_ext_id("transaction_code", "authorization_code").alias("_id"))
    t = semi_join(t, ids, "_t_ext_id", "_id")
    j = d.join(t, (F.col("r_inspector_dispute_id") == F.col("_t_dispute_id"))
               & (F.col("_ext_id") == F.col("_t_ext_id")), "left")
    j = j.filter(F.coalesce(F.col("investigation_resolution"), F.col("resolution_decision"))
                 .isin(*codes.APPROVED_DECISIONS)
                 & F.col("reason").isin(*codes.UNAUTHORIZED_REASONS))
    g = (j.groupBy(F.col("user_id"), week_start("dispute_created_at").alias("week"))
         .agg((F.sum("transaction_amount") * -1).cast("decimal(38,2)").alias("sum_dispute"),
              F.count(F.lit(1)).alias("n_disputes")))
    return top_k(g, [desc("sum_dispute"), asc("user_id"), asc("week")], n)
