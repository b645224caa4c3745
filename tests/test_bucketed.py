"""Facts in buckets of their join keys: the same rows, and no exchange below the fact joins."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from disputelens.plans.dispute_wow import detail_base
from disputelens.session import scratch_folder
from disputelens.sources.bucketed import LAYOUT, BucketedSources


class Tables:
    """A third of all rows belong to account 1; codes and users may be missing."""

    def __init__(self, spark):
        ids = spark.range(3000)
        user = "CASE WHEN id % 3 = 0 THEN 1L WHEN id % 101 = 0 THEN NULL ELSE id % 40 END AS user_id"
        code = "CASE WHEN id % 97 = 0 THEN NULL ELSE id % 700 END AS {0}"
        at = "timestamp_ntz'2020-03-01 00:00:00' + make_dt_interval(CAST(id % 28 AS INT))"
        self.settled_txn = ids.selectExpr(
            user, code.format("authorization_code"), f"{at} AS transaction_timestamp",
            "'shop ' || id % 9 || ' CA' AS merchant_name_raw", "'POS' AS transaction_cd", "7L AS unique_program_id",
            "CAST(-id AS DECIMAL(18,2)) AS settled_amt", "CAST(id % 5 AS STRING) AS mcc_cd")
        self.disputed_txn = ids.filter("id % 7 = 0").selectExpr(
            user, code.format("authorization_code"), f"{at} AS dispute_created_at", "'r' AS reason", "'x' AS resolution_code",
            "'c' AS close_code", "CAST(id AS DECIMAL(18,2)) AS updated_transaction_amount")
        self.auth_event = ids.selectExpr(user, code.format("auth_id"), "CAST(id % 100 AS INT) AS risk_score",
                                         "false AS is_international", "'v' AS card_network_cd", "'chip' AS entry_type")
        self.dim_member = spark.range(40).selectExpr("id AS user_id", "'CA' AS state_cd",
                                                     "timestamp_ntz'2019-01-01 00:00:00' AS enrollment_initiated_ts")


def _base(t, codes):
    day = dt.date(2020, 3, 1)
    return detail_base(t.settled_txn.withColumn("transaction_cd", F.lit(codes[0])), t.disputed_txn, t.auth_event,
                       t.dim_member, day, dt.date(2020, 3, 28), 7, dt.date(2020, 6, 1))


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_fact_joins_read_bucket_against_bucket(spark, no_broadcast):
    from disputelens.functions import codes

    plain = Tables(spark)
    folder = scratch_folder(spark, "bucketed-test")
    stored = BucketedSources.store(spark, plain, folder, "bucketed_test", 16)
    try:
        want, got = _base(plain, codes.REPORT_CODES), _base(stored, codes.REPORT_CODES)
        exchange = r"Exchange hashpartitioning\((\w+)#\w+(?:, (\w+)#\w+)?"
        keys = lambda df: sorted(re.findall(exchange, df._jdf.queryExecution().executedPlan().toString()))
        assert [k for k in keys(want) if k[1] in ("authorization_code", "d_authorization_code", "rae_auth_id")]
        # only the join with the members is shuffled
        assert keys(got) == [("m_user_id", ""), ("user_id", "")]
        assert want.exceptAll(got).count() == 0 and got.exceptAll(want).count() == 0 and got.count() > 3000
        # the hot account lies in many buckets, not in one
        files = spark.read.parquet(f"{folder}/settled_txn").filter("user_id = 1").select(F.input_file_name().alias("f"))
        assert files.distinct().count() == 16
    finally:
        stored.drop()


def test_tables_are_replaced_and_forgotten(spark):
    folder = scratch_folder(spark, "bucketed-test")
    tables = Tables(spark)
    for _ in range(2):
        stored = BucketedSources.store(spark, tables, folder, "bucketed_again", 4)
    assert stored.settled_txn.count() == 3000
    assert stored.dim_member is tables.dim_member
    stored.drop()
    assert not any(spark.catalog.tableExists(f"bucketed_again_{name}") for name in LAYOUT)
