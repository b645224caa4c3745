"""Edge rows for the dialect rules."""

import datetime as dt

from pyspark.sql import functions as F

from disputelens.functions import mappings as M
from disputelens.functions import semantics as S
from disputelens.operators.dedup import keep_first


def ts(s):
    return dt.datetime.fromisoformat(s)


def one(df, col):
    return [r[col] for r in df.collect()]


def test_null_ordering(spark):  # S1
    df = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    assert one(df.orderBy(S.asc("x")), "x") == [1, 3, None]
    assert one(df.orderBy(S.desc("x")), "x") == [None, 3, 1]


def test_calendar_boundaries(spark):  # S2, S3, S4
    df = spark.createDataFrame(
        [(ts("2020-01-01 23:00:00"), ts("2020-01-02 01:00:00")),
         (ts("2020-01-31 12:00:00"), ts("2020-02-01 00:00:00")),
         (ts("2020-01-01 00:00:00.900000"), ts("2020-01-01 00:00:01.100000"))],
        "a timestamp_ntz, b timestamp_ntz")
    r = df.select(S.day_diff("a", "b").alias("d"), S.month_diff("a", "b").alias("m"),
                  S.second_diff("a", "b").alias("s")).collect()
    assert (r[0].d, r[1].m, r[2].s) == (1, 1, 1)
    assert (r[1].d, r[0].m, r[0].s) == (1, 0, 7200)


def test_concat_null_and_labelled(spark):  # S5
    df = spark.createDataFrame([("a", None), ("a", "b")], "x string, y string")
    r = df.select(F.concat("x", "y").alias("c"), S.labelled("L:", "y").alias("l")).collect()
    assert [(x.c, x.l) for x in r] == [(None, ""), ("ab", "L:b")]


def test_keep_first(spark):  # S6
    df = spark.createDataFrame([(1, None, "a"), (1, 5, "b"), (1, 7, "c"), (2, None, "d")], "k int, t int, v string")
    got = {r.k: r.v for r in keep_first(df, ["k"], [S.desc("t"), S.asc("v")]).collect()}
    assert got == {1: "a", 2: "d"}
    got = {r.k: r.v for r in keep_first(df, ["k"], [S.asc("t"), S.asc("v")]).collect()}
    assert got == {1: "b", 2: "d"}


def test_safe_number(spark):  # S10
    df = spark.createDataFrame([("12.5",), ("12.4",), ("abc",), ("anon-7",), (None,)], "u string")
    assert one(df.select(S.safe_number("u").alias("n")), "n") == [13, 12, None, None, None]


def test_week_start(spark):  # S14
    df = spark.createDataFrame([(ts("1999-06-13 23:59:00"),), (ts("1999-06-14 00:00:00"),), (ts("1999-06-20 10:00:00"),)],
                               "t timestamp_ntz")
    assert one(df.select(S.week_start("t").alias("w")), "w") == [dt.date(1999, 6, 7), dt.date(1999, 6, 14),
                                                                 dt.date(1999, 6, 14)]


def test_split_part_field(spark):  # S16, CS20
    df = spark.createDataFrame([("---\nemail:\n- a",), ("---status:\n- b",), ("nothing",)], "o string")
    assert one(df.select(M.changed_field("o").alias("f")), "f") == ["\nemail", "status", ""]
    assert one(df.select(M.change_type(M.changed_field("o")).alias("t")), "t") == [
        "\nemail change", "status change", " change"]


def test_like_from_column(spark):  # S17
    df = spark.createDataFrame([("[x-block]", "hard_block"), ("[hard_block]", "hard_block"), ("none", "deny")],
                               "a string, o string")
    got = one(df.select(F.expr("a LIKE concat('%', o, '%')").alias("m")), "m")
    assert got == [False, True, False]
    df2 = spark.createDataFrame([("[hardXblock]", "hard_block")], "a string, o string")
    assert one(df2.select(F.expr("a LIKE concat('%', o, '%')").alias("m")), "m") == [True]


def test_not_in_drops_null(spark):  # S18
    df = spark.createDataFrame([("6010",), ("5000",), (None,)], "m string")
    assert one(df.filter(~F.col("m").isin("6010", "6011")), "m") == ["5000"]


def test_case_null_falls_to_else(spark):  # S19
    df = spark.createDataFrame([(None,), (5.0,), (25.0,), (55.0,)], "s double")
    assert one(df.select(M.risk_bucket("s").alias("b")), "b") == ["9. >=50", "1. <10", "3. 20-50", "9. >=50"]
    assert one(df.select(M.login_score_bucket(F.col("s") / 100).alias("b")), "b") == [
        "0. no new dvc", "1. <0.1", "3. <0.3", "9. >=0.5"]


def test_ilike_any_matches_like_chain(spark):
    texts = ["ZIP_CODE", "zipXcode", "zip\ncode", "Status", "\nEMAIL", "address line", "phone", "lastname",
             "last_name", "firstXname", "nothing", None, "ST%TUS"]
    pats = ["zip_code", "status", "state_code", "phone", "last_name", "first_name", "email", "address"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    chain = None
    for p in pats:
        term = F.col("t").ilike(f"%{p}%")
        chain = term if chain is None else chain | term
    r = df.select(S.ilike_any("t", pats).alias("a"), chain.alias("b")).collect()
    assert [x.a for x in r] == [x.b for x in r]


def test_amount_and_tenure_buckets(spark):
    df = spark.createDataFrame([(0, 0), (50, 11), (100, 12), (999, 35), (1000, 36)], "a int, m int")
    r = df.select(M.amount_bucket("a").alias("a"), M.tenure_bucket("m").alias("m")).collect()
    assert [x.a for x in r] == ["1. <=0", "2. 0-100", "3. 100-500", "4. 500-1k", "9. >=1k"]
    assert [x.m for x in r] == ["1. <12", "1. <12", "2. 12-24", "3. 24-36", "9. >=36"]


def test_txn_family_and_ext_id(spark):
    df = spark.createDataFrame([("ADX", 11), ("VSA", 12), ("MPW", 13), (None, 14)], "c string, a long")
    r = df.select(M.txn_family("c").alias("f"), M.inspector_ext_id("c", "a").alias("e")).collect()
    assert [(x.f, x.e) for x in r] == [(4, "411"), (9, "912"), (0, "013"), (0, "014")]


def test_decline_reason(spark):
    df = spark.createDataFrame([("00",), ("41",), ("43",), ("N7",), ("99",)], "r string")
    assert one(df.select(M.decline_reason("r").alias("d")), "d") == [
        "n/a", "41 Lost/Stolen", "43 Lost/Stolen", "N7 Incorrect CVV", "99 99"]


def test_local_time(spark):  # D1
    df = spark.createDataFrame([(ts("1999-06-16 10:00:00"),), (ts("1999-01-16 10:00:00"),)], "t timestamp_ntz")
    assert one(df.select(S.local_time("t", "America/Los_Angeles").alias("l")), "l") == [
        ts("1999-06-16 03:00:00"), ts("1999-01-16 02:00:00")]


def test_time_helpers_ignore_session_zone(spark):
    # wall-clock arithmetic must not move when the session zone has a DST jump
    df = spark.createDataFrame([(ts("2021-03-14 01:59:50"), ts("2021-03-14 03:00:10")),
                                (ts("2021-03-14 02:30:45"), ts("2021-03-14 02:31:05"))], "a timestamp_ntz, b timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        r = df.select(S.second_diff("a", "b").alias("s"), S.minute_start("a").alias("m"),
                      S.epoch_seconds("a").alias("e")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert [x.s for x in r] == [3620, 20]
    assert [x.m for x in r] == [ts("2021-03-14 01:59:00"), ts("2021-03-14 02:30:00")]
    assert r[0].e == int((ts("2021-03-14 01:59:50") - ts("1970-01-01 00:00:00")).total_seconds())
