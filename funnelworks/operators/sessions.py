"""M-2 ``sessions``, M-3 ``users`` and M-5 ``session_funnel``.

Each model is one ``groupBy`` (one shuffle). "Attributes of the earliest
row" is a ``min`` over a struct led by the timestamp (``first_by_time``),
which replaces the reference's aggregate + ``row_number() = 1`` + self-join:
same grouping key on both sides, so the join always matched once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelworks.functions import sql as S
from funnelworks.sources.schema import FUNNEL_COLUMNS, SESSION_COLUMNS, USER_COLUMNS

# Presence flags of the sessions model, (column, event name).
SESSION_FLAGS = [
    ("has_page_view", "page_view"),
    ("has_view_item", "view_item"),
    ("has_add_to_cart", "add_to_cart"),
    ("has_begin_checkout", "begin_checkout"),
    ("has_purchase", "purchase"),
    ("has_search", "view_search_results"),
]

# Default sequential funnel steps and the short labels used in flag names.
FUNNEL_STEPS = ("view_item", "add_to_cart", "begin_checkout", "purchase")
FUNNEL_LABELS = ("view", "cart", "checkout", "purchase")

# First-event attributes, (source column in staging, output column).
FIRST_EVENT_ATTRS = [
    ("device_category", "device_category"),
    ("operating_system", "operating_system"),
    ("browser", "browser"),
    ("country", "country"),
    ("city", "city"),
    ("first_user_source", "first_user_source"),
    ("first_user_medium", "first_user_medium"),
    ("first_user_campaign", "first_user_campaign"),
    ("page_location", "landing_page"),
]


# EXP-7: canonical transaction key.
TRANSACTION_KEY = "coalesce(ecommerce_transaction_id, transaction_id)"


def _session_aggs() -> list[Column]:
    purchase = "event_name = 'purchase'"
    pairs = [
        ("session_start_timestamp", "min(event_timestamp_utc)"),
        ("session_end_timestamp", "max(event_timestamp_utc)"),
        ("session_date", "min(event_date_parsed)"),
        ("user_pseudo_id", "min(user_pseudo_id)"),
        ("event_count", "count(1)"),
    ]
    pairs += [(name, S.any_flag(f"event_name = '{ev}'")) for name, ev in SESSION_FLAGS]
    pairs += [
        ("session_revenue_usd",
         f"coalesce({S.money_sum(f'IF({purchase}, ecommerce_purchase_revenue_in_usd, NULL)')}, CAST(0 AS DOUBLE))"),
        ("total_engagement_time_msec", "sum(coalesce(engagement_time_msec, 0))"),
        ("_first", S.first_by(["event_timestamp_utc"], [c for c, _ in FIRST_EVENT_ATTRS])),
    ]
    return [F.expr(e) for e in S.aliased(pairs)]


def _transaction_counts(ev: DataFrame) -> DataFrame:
    """Distinct transaction keys of purchase events per session.

    Counted apart from the session aggregation: a ``count(DISTINCT ...)``
    inside it would make Spark shuffle every session twice, while purchase
    events are a small share of all events. The result is hash-partitioned
    by ``session_key`` like the session aggregation, so joining the two
    adds no exchange.
    """
    return (ev.where(f"event_name = 'purchase' AND {TRANSACTION_KEY} IS NOT NULL")
            .selectExpr("session_key", f"{TRANSACTION_KEY} AS t").distinct()
            .groupBy("session_key").agg(F.expr("count(1) AS transaction_count")))


def _aggregate_sessions(stg: DataFrame, extra: list[Column]) -> DataFrame:
    ev = _with_session_key(stg)
    main = ev.groupBy("session_key").agg(*_session_aggs(), *extra)
    return (main.join(_transaction_counts(ev), "session_key", "left")
            .withColumn("transaction_count", F.expr("coalesce(transaction_count, CAST(0 AS BIGINT))")))


def _funnel_time_aggs(steps) -> list[Column]:
    return [F.expr(f"min(IF(event_name = '{s}', event_timestamp_utc, NULL)) AS first_{s}_time") for s in steps]


def funnel_flag_sql(steps=FUNNEL_STEPS, labels=FUNNEL_LABELS) -> list[str]:
    """Cumulative sequential flags: step n is reached iff the first times of
    steps 1..n all exist and never decrease (ties pass)."""
    times = [f"first_{s}_time" for s in steps]
    flags = ["true AS reached_session"]
    for n, step in enumerate(steps):
        conds = [f"{times[0]} IS NOT NULL"]
        for i in range(1, n + 1):
            conds.append(f"{times[i]} IS NOT NULL AND {times[i]} >= {times[i - 1]}")
        name = f"reached_{step}" if n == 0 else f"reached_{step}_after_{labels[n - 1]}"
        flags.append(f"({' AND '.join(conds)}) AS {name}")
    return flags


def _with_session_key(stg: DataFrame) -> DataFrame:
    return stg.where("session_key IS NOT NULL")


def _session_select() -> list[str]:
    first = {out: f"_first.{src} AS {out}" for src, out in FIRST_EVENT_ATTRS}
    return [first.get(c, c) for c in SESSION_COLUMNS]


def sessions(stg: DataFrame) -> DataFrame:
    """M-2: one row per ``session_key`` (events without a session are dropped)."""
    return _aggregate_sessions(stg, []).selectExpr(*_session_select())


def session_funnel(stg: DataFrame, steps=FUNNEL_STEPS, labels=FUNNEL_LABELS) -> DataFrame:
    """M-5: first time of each step per session and the sequential flags."""
    grouped = (_with_session_key(stg).groupBy("session_key", "user_pseudo_id")
               .agg(F.expr("min(event_timestamp_utc) AS session_start_time"), *_funnel_time_aggs(steps)))
    cols = ["session_key", "user_pseudo_id", "session_start_time"] + [f"first_{s}_time" for s in steps]
    out = grouped.selectExpr(*cols, *funnel_flag_sql(steps, labels))
    if tuple(steps) == FUNNEL_STEPS:
        out = out.select(*FUNNEL_COLUMNS)
    return out


def session_facts(stg: DataFrame, steps=FUNNEL_STEPS, labels=FUNNEL_LABELS) -> DataFrame:
    """Sessions and funnel in one ``groupBy(session_key)``: one shuffle for both.

    Both models read the same filtered events and group by the same key, so
    the funnel mart's join of the two disappears on this path.
    """
    grouped = _aggregate_sessions(stg, _funnel_time_aggs(steps))
    time_cols = [f"first_{s}_time" for s in steps]
    return grouped.selectExpr(*_session_select(), "session_start_timestamp AS session_start_time",
                              *time_cols, *funnel_flag_sql(steps, labels))


def users(sess: DataFrame) -> DataFrame:
    """M-3: one row per user from sessions (``session_key`` is unique there,
    so distinct session counts are plain counts)."""
    first = S.first_by(["session_start_timestamp", "session_key"],
                       ["device_category", "first_user_source", "first_user_medium", "first_user_campaign"])
    agg = sess.groupBy("user_pseudo_id").agg(*[F.expr(e) for e in S.aliased([
        ("first_seen_date", "min(session_date)"),
        ("last_seen_date", "max(session_date)"),
        ("session_count", "count(session_key)"),
        ("purchase_session_count", S.count_when("has_purchase")),
        ("order_count", "sum(transaction_count)"),
        ("total_revenue_usd", S.money_sum("session_revenue_usd")),
        ("is_purchaser", S.any_flag("has_purchase")),
        ("has_ever_searched", S.any_flag("has_search")),
        ("_first", first),
    ])])
    rename = {"first_device_category": "_first.device_category AS first_device_category"}
    return agg.selectExpr(*[rename.get(c, f"_first.{c} AS {c}" if c.startswith("first_user_") else c)
                            for c in USER_COLUMNS])
