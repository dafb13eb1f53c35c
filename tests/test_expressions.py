"""Scalar and aggregate helpers on hand-written edge frames (EXP-*, AGG-*)."""

from pyspark.sql import functions as F

from funnelworks.functions.metrics import any_flag, money_sum, safe_divide, week_start, weeks_between
from funnelworks.functions.params import event_param, session_key

PARAMS = "p array<struct<key string, value struct<string_value string, int_value bigint, " \
         "double_value double, float_value double>>>"


def _p(key, s=None, i=None):
    return (key, (s, i, None, None))


def test_event_param_first_match_missing_null_and_empty(spark):
    rows = [([_p("a", i=1), _p("b", s="x"), _p("a", i=2)],), ([],), (None,), ([_p(None, i=9), _p("a", i=3)],)]
    df = spark.createDataFrame(rows, PARAMS)
    out = df.select(event_param("a", "int_value", "p").alias("a"), event_param("b", "string_value", "p").alias("b"),
                    event_param("a", "string_value", "p").alias("a_str")).collect()
    assert [r.a for r in out] == [1, None, None, 3]       # duplicate key: first wins
    assert [r.b for r in out] == ["x", None, None, None]
    assert all(r.a_str is None for r in out)              # other typed sub-field is NULL


def test_event_param_rejects_unknown_type():
    import pytest
    with pytest.raises(ValueError):
        event_param("a", "bool_value")


def test_session_key_null_propagation(spark):
    df = spark.createDataFrame([("u", 5), ("u", None), (None, 7)], "u string, s bigint")
    assert [r.k for r in df.select(session_key("u", "s").alias("k")).collect()] == ["u-5", None, None]


def test_safe_divide(spark):
    df = spark.createDataFrame([(1, 2), (1, 0), (None, 2), (3, None)], "a int, b int")
    assert [r.x for r in df.select(safe_divide("a", "b").alias("x")).collect()] == [0.5, None, None, None]


def test_money_sum_is_order_independent(spark):
    vals = [0.1, 0.2, 0.3, 1e6 + 0.07, 12.34, 0.01] * 50
    a = spark.createDataFrame([(v,) for v in vals], "v double").agg(money_sum("v").alias("s")).first().s
    b = spark.createDataFrame([(v,) for v in reversed(vals)], "v double").repartition(7) \
        .agg(money_sum("v").alias("s")).first().s
    assert a == b == round(sum(vals), 6)


def test_any_flag_never_null(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, n string")
    out = dict(df.groupBy("k").agg(any_flag(F.col("n") == "x").alias("f")).collect())
    assert out == {1: False, 2: True}


def test_weeks(spark):
    df = spark.createDataFrame([("2024-01-07",), ("2024-01-08",), ("2024-01-21",)], "d string") \
        .select(F.to_date("d").alias("d"))
    ws = [r.w.isoformat() for r in df.select(week_start("d").alias("w")).collect()]
    assert ws == ["2024-01-01", "2024-01-08", "2024-01-15"]
    n = df.select(weeks_between(week_start(F.lit("2024-01-21").cast("date")),
                                week_start(F.lit("2024-01-02").cast("date"))).alias("n")).first().n
    assert n == 2
