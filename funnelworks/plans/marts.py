"""Marts M-7...M-12.

Distinct counts over keys that are unique in the input (``session_key`` in
sessions, the transaction key in orders) are plain counts; distinct users
are counted by a two-level aggregation (first per (group, user), then per
group), so no ``Expand`` multiplies rows and every level combines map-side
before its shuffle: a hot user or a hot group value never lands whole in
one task. Outputs whose size is bounded by the calendar or by the number of
segment values are ordered in one task after their final aggregation
(``small_ordered``); item-level output is range-sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelworks.functions import sql as S
from funnelworks.functions.metrics import safe_divide, week_start, weeks_between
from funnelworks.operators.global_rank import SortKey, global_ntile
from funnelworks.sources.sinks import materialize



def _exprs(pairs: list[tuple[str, str]]) -> list[Column]:
    """Aggregate expressions from (name, SQL) pairs."""
    return [F.expr(e) for e in S.aliased(pairs)]


def small_ordered(df: DataFrame, *cols) -> DataFrame:
    """Total order for an output of bounded size (days, segments, cohorts).

    ``repartition(1)`` (not ``coalesce(1)``, which would pull the final
    aggregation itself into one task) moves only the finished rows; the
    sort then needs no sampling job.
    """
    return df.repartition(1).sortWithinPartitions(*cols)


# ---------------------------------------------------------------- M-7
def kpis_daily(sess: DataFrame, ords: DataFrame) -> DataFrame:
    """One row per session date; order days without sessions drop out (left join)."""
    per_user = sess.groupBy("session_date", "user_pseudo_id").agg(*_exprs([
        ("n", "count(session_key)"),
        ("pv", S.count_when("has_view_item")),
        ("atc", S.count_when("has_add_to_cart")),
        ("chk", S.count_when("has_begin_checkout")),
        ("pur", S.count_when("has_purchase")),
        ("srch", S.count_when("has_search")),
        ("buyer", S.any_flag("has_purchase")),
    ]))
    daily = per_user.groupBy("session_date").agg(*_exprs([
        ("daily_active_users", "count(user_pseudo_id)"),
        ("total_sessions", "sum(n)"),
        ("daily_purchasers", S.count_when("buyer AND user_pseudo_id IS NOT NULL")),
        ("sessions_with_product_view", "sum(pv)"),
        ("sessions_with_add_to_cart", "sum(atc)"),
        ("sessions_with_checkout", "sum(chk)"),
        ("sessions_with_purchase", "sum(pur)"),
        ("sessions_with_search", "sum(srch)"),
    ]))
    daily_orders = ords.groupBy(F.col("order_date").alias("session_date")).agg(*_exprs([
        ("total_orders", "count(order_transaction_key)"),
        ("total_revenue_usd", S.money_sum("order_revenue_usd")),
    ]))
    # One row per calendar day on each side: the broadcast is bounded by the date range.
    j = daily.join(F.broadcast(daily_orders), "session_date", "left")
    orders_n = "CAST(coalesce(total_orders, 0) AS BIGINT)"
    revenue = "coalesce(total_revenue_usd, CAST(0 AS DOUBLE))"
    out = j.selectExpr(*S.aliased([
        ("report_date", "session_date"),
        ("daily_active_users", "daily_active_users"),
        ("total_sessions", "total_sessions"),
        ("daily_purchasers", "daily_purchasers"),
        ("total_orders", orders_n),
        ("total_revenue_usd", revenue),
        ("sessions_with_product_view", "sessions_with_product_view"),
        ("sessions_with_add_to_cart", "sessions_with_add_to_cart"),
        ("sessions_with_checkout", "sessions_with_checkout"),
        ("sessions_with_purchase", "sessions_with_purchase"),
        ("sessions_with_search", "sessions_with_search"),
        ("user_conversion_rate", S.safe_divide("daily_purchasers", "daily_active_users")),
        ("session_conversion_rate", S.safe_divide("sessions_with_purchase", "total_sessions")),
        ("avg_order_value_usd", S.safe_divide(revenue, orders_n)),
        ("revenue_per_session_usd", S.safe_divide(revenue, "total_sessions")),
        ("product_view_rate", S.safe_divide("sessions_with_product_view", "total_sessions")),
        ("view_to_cart_rate", S.safe_divide("sessions_with_add_to_cart", "sessions_with_product_view")),
        ("cart_to_checkout_rate", S.safe_divide("sessions_with_checkout", "sessions_with_add_to_cart")),
        ("checkout_to_purchase_rate", S.safe_divide("sessions_with_purchase", "sessions_with_checkout")),
        ("search_adoption_rate", S.safe_divide("sessions_with_search", "total_sessions")),
    ]))
    return small_ordered(out, "report_date")


# ---------------------------------------------------------------- M-8
FUNNEL_COUNTS = [
    ("sessions_entered", "reached_session"),
    ("sessions_product_view", "reached_view_item"),
    ("sessions_add_to_cart", "reached_add_to_cart_after_view"),
    ("sessions_begin_checkout", "reached_begin_checkout_after_cart"),
    ("sessions_purchase", "reached_purchase_after_checkout"),
]


def funnel_performance(funnel: DataFrame, sess: DataFrame | None = None,
                       normalize_first: bool = True) -> DataFrame:
    """By (date, device): five step counts, four step rates and the overall rate.

    Pass the output of ``session_facts`` alone (fused path, no join), or
    ``session_funnel`` plus ``sessions`` (model path: inner join on
    ``session_key``; both sides are hash-partitioned by it).
    Grouping is on the defaulted label, so NULL and a literal 'unknown' are one row per date (the
    select alias has the grouping column's name and wins); ``normalize_first=False`` groups on the
    raw device and labels afterwards.
    """
    if sess is not None:
        funnel = funnel.select("session_key", *[f for _, f in FUNNEL_COUNTS]).join(
            sess.select("session_key", "session_date", "device_category"), "session_key")
    if normalize_first:
        funnel = funnel.withColumn("device_category", F.expr("coalesce(device_category, 'unknown')"))
    agg = funnel.groupBy("session_date", "device_category").agg(
        *_exprs([(name, S.count_when(f"{flag} AND session_key IS NOT NULL")) for name, flag in FUNNEL_COUNTS]))
    out = agg.selectExpr(*S.aliased([
        ("report_date", "session_date"),
        ("device_category", "coalesce(device_category, 'unknown')"),
        *[(name, name) for name, _ in FUNNEL_COUNTS],
        ("rate_session_to_view", S.safe_divide("sessions_product_view", "sessions_entered")),
        ("rate_view_to_cart", S.safe_divide("sessions_add_to_cart", "sessions_product_view")),
        ("rate_cart_to_checkout", S.safe_divide("sessions_begin_checkout", "sessions_add_to_cart")),
        ("rate_checkout_to_purchase", S.safe_divide("sessions_purchase", "sessions_begin_checkout")),
        ("overall_conversion_rate", S.safe_divide("sessions_purchase", "sessions_entered")),
    ]))
    return small_ordered(out, "report_date", "device_category")


# ---------------------------------------------------------------- M-9
def retention_cohorts(sess: DataFrame, zero_fill: bool = False) -> DataFrame:
    """Weekly cohorts: (cohort week, activity week index) -> retained users.

    One shuffle by user collects each user's set of active weeks (bounded by
    the number of weeks in the data window, combined map-side); the cohort
    is its smallest element. A second, tiny aggregation counts users per
    (cohort, week); week-0 counts are the cohort sizes. Weeks in which no
    cohort member was active are absent (the reference's behaviour);
    ``zero_fill`` lists them with 0 retained users instead.
    """
    weeks = (sess.where(F.col("user_pseudo_id").isNotNull())
             .select("user_pseudo_id", week_start("session_date").alias("w"))
             .groupBy("user_pseudo_id").agg(F.array_sort(F.collect_set("w")).alias("weeks")))
    activity = weeks.select(F.col("weeks")[0].alias("cohort_week"), F.explode("weeks").alias("activity_week"))
    cells = activity.groupBy("cohort_week", "activity_week").agg(F.count(F.lit(1)).alias("retained_users")) \
        .withColumn("activity_week_index", weeks_between("activity_week", "cohort_week"))
    # cells has one row per (cohort, week): bounded by the calendar.
    size = F.max(F.when(F.col("activity_week_index") == 0, F.col("retained_users"))) \
        .over(Window.partitionBy("cohort_week"))
    cells = cells.withColumn("cohort_size", size).where(F.col("activity_week_index") >= 0)
    if zero_fill:
        # every week from the cohort's own week to the last active week of the data, 0 where no
        # user returned; each cohort expands its own range (bounded by the calendar), no cross join
        last = F.max("activity_week").over(Window.partitionBy(F.lit(1)))
        grid = (cells.withColumn("_last", last).where(F.col("activity_week_index") == 0)
                .select("cohort_week", "cohort_size",
                        F.explode(F.sequence(F.col("cohort_week"), F.col("_last"), F.expr("INTERVAL 7 DAYS")))
                        .alias("activity_week")))
        cells = (grid.join(cells.select("cohort_week", "activity_week", "retained_users"),
                           ["cohort_week", "activity_week"], "left")
                 .withColumn("retained_users", F.coalesce(F.col("retained_users"), F.lit(0).cast("long")))
                 .withColumn("activity_week_index", weeks_between("activity_week", "cohort_week")))
    out = cells.select("cohort_week", "activity_week", "activity_week_index", "cohort_size", "retained_users",
                       safe_divide("retained_users", "cohort_size").alias("retention_rate"))
    return small_ordered(out, "cohort_week", "activity_week_index")


# ---------------------------------------------------------------- M-10
# RFM tiles, segment rules (first match wins) and the default label.
RFM_TILES = 5
RFM_RULES = [
    ("Champions", lambda r, f, m: (r >= 4) & (f >= 4) & (m >= 4)),
    ("Loyal Customers", lambda r, f, m: (f >= 4) & (r >= 3)),
    ("Potential Loyalists", lambda r, f, m: (r >= 4) & (f >= 2) & (f <= 3)),
    ("Recent Customers", lambda r, f, m: (r >= 4) & (f == 1)),
    ("At Risk", lambda r, f, m: (r <= 2) & (f >= 3)),
]
RFM_DEFAULT = "Occasional Customers"


def rfm_label(r: Column, f: Column, m: Column) -> Column:
    expr = None
    for label, rule in RFM_RULES:
        cond = rule(r, f, m)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(RFM_DEFAULT))


def purchaser_metrics(ords: DataFrame) -> DataFrame:
    """Per-user frequency, money and first/last order date (one row per purchaser)."""
    return ords.groupBy("user_pseudo_id").agg(*_exprs([
        ("frequency", "count(order_transaction_key)"),
        ("monetary_value_usd", S.money_sum("order_revenue_usd")),
        ("last_order_date", "max(order_date)"),
        ("first_order_date", "min(order_date)"),
    ]))


def with_recency(pm: DataFrame) -> DataFrame:
    """Reference date = latest order date overall (= latest last-order date), one row, broadcast."""
    ref = pm.agg(F.max("last_order_date").alias("analysis_reference_date"))
    return (pm.crossJoin(F.broadcast(ref))
            .withColumn("recency_days", F.expr("CAST(datediff(analysis_reference_date, last_order_date) AS BIGINT)")))


def customer_rfm(ords: DataFrame, tiles: int = RFM_TILES, ranges: int | None = None) -> DataFrame:
    """One row per purchaser: recency / frequency / money quintiles and a label.

    Quintiles are exact global ``ntile`` (see ``global_rank``), with
    ``user_pseudo_id`` as the tie-break the reference lacks. The per-user table is stored first:
    its latest order date is the reference date, and the orders are scanned once.
    """
    pm = with_recency(materialize(purchaser_metrics(ords), "rfm-purchasers"))
    specs = {
        "r_score": [SortKey("recency_days", False), SortKey("user_pseudo_id")],
        "f_score": [SortKey("frequency"), SortKey("user_pseudo_id")],
        "m_score": [SortKey("monetary_value_usd"), SortKey("user_pseudo_id")],
    }
    scored = global_ntile(pm, specs, tiles, ranges)
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    return scored.select(
        "user_pseudo_id", "recency_days", "frequency", "monetary_value_usd", "first_order_date",
        "last_order_date", "analysis_reference_date", "r_score", "f_score", "m_score",
        rfm_label(r, f, m).alias("rfm_segment"))


# ---------------------------------------------------------------- M-11
SEGMENT_COLUMNS = [
    "segment_type", "segment_value", "unique_users", "total_sessions", "purchase_sessions", "purchasers",
    "total_revenue_usd", "total_orders", "session_conversion_rate", "revenue_per_session_usd",
    "avg_order_value_usd",
]


def segment_performance(sess: DataFrame, usrs: DataFrame | None = None, normalize_first: bool = False,
                        method: str = "stack") -> DataFrame:
    """Device, medium and search segments (session level) plus purchaser status (user level).

    The three session-level segmentations share one scan: each session is
    emitted once per segmentation with its raw group value, then two levels
    of aggregation ((type, value, user) then (type, value)) replace the
    distinct counts. Labels are applied after grouping on the raw value,
    so NULL and a literal default label stay two rows, as in the reference;
    ``normalize_first`` applies the default labels before grouping instead.
    ``method="grouping_sets"`` builds the first level with GROUPING SETS
    and ``grouping_id()`` (same rows; timed against the stacked scan in

    Without ``usrs`` the purchaser-status block comes from the same pass:
    its first level (one row per user) is exactly the user rollup of
    ``users(sess)``, so sessions are read once for all four blocks. Pass a
    stored users table to take that block from it instead.
    """
    if method not in ("stack", "grouping_sets"):
        raise ValueError("method must be 'stack' or 'grouping_sets'")
    device, medium = (("coalesce(device_category, 'unknown')", "coalesce(first_user_medium, '(none)')")
                      if normalize_first else ("device_category", "first_user_medium"))
    user_block = ", named_struct('t', 'purchaser_status', 'v', CAST(NULL AS STRING))" if usrs is None else ""
    dims = (f"array(named_struct('t', 'device_category', 'v', {device}), "
            f"named_struct('t', 'acquisition_medium', 'v', {medium}), "
            f"named_struct('t', 'search_adoption', 'v', CAST(has_search AS STRING)){user_block})")
    user_metrics = [
        ("n", "count(session_key)"),
        ("ps", S.count_when("has_purchase AND session_key IS NOT NULL")),
        ("buyer", S.any_flag("has_purchase")),
        ("rev", S.money_sum("session_revenue_usd")),
        ("txn", "sum(transaction_count)"),
    ]
    if method == "stack":
        stacked = sess.selectExpr("user_pseudo_id", "session_key", "has_purchase", "session_revenue_usd",
                                  "transaction_count", f"explode({dims}) AS d")
        per_user = stacked.groupBy(F.col("d.t").alias("t"), F.col("d.v").alias("v"), "user_pseudo_id") \
            .agg(*_exprs(user_metrics))
    else:
        base = sess.selectExpr("user_pseudo_id", "session_key", "has_purchase", "session_revenue_usd",
                               "transaction_count", f"{device} AS dv", f"{medium} AS md",
                               "CAST(has_search AS STRING) AS sr")
        sets = [["dv", "user_pseudo_id"], ["md", "user_pseudo_id"], ["sr", "user_pseudo_id"]]
        if usrs is None:
            sets.append(["user_pseudo_id"])
        gs = base.groupingSets(sets, "dv", "md", "sr", "user_pseudo_id") \
            .agg(*_exprs(user_metrics), F.expr("grouping_id() AS gid"))
        # bits (dv, md, sr, user) = 8, 4, 2, 1, set when aggregated away: 6 -> device set,
        # 10 -> medium set, 12 -> search set, 14 -> user only (purchaser status)
        per_user = gs.selectExpr(
            "CASE gid WHEN 6 THEN 'device_category' WHEN 10 THEN 'acquisition_medium' WHEN 12 THEN 'search_adoption' "
            "ELSE 'purchaser_status' END AS t",
            "CASE gid WHEN 6 THEN dv WHEN 10 THEN md WHEN 12 THEN sr END AS v",
            "user_pseudo_id", "n", "ps", "buyer", "rev", "txn")
    # purchaser status is known only per user: set it from the user's rollup
    per_user = per_user.withColumn("v", F.expr("IF(t = 'purchaser_status', CAST(buyer AS STRING), v)"))
    seg = per_user.groupBy("t", "v").agg(*_exprs([
        ("unique_users", "count(user_pseudo_id)"),
        ("total_sessions", "sum(n)"),
        ("purchase_sessions", "sum(ps)"),
        ("purchasers", S.count_when("buyer AND user_pseudo_id IS NOT NULL")),
        ("total_revenue_usd", S.money_sum("rev")),
        ("total_orders", "sum(txn)"),
    ]))
    label = ("CASE WHEN t = 'device_category' THEN coalesce(v, 'unknown') "
             "WHEN t = 'acquisition_medium' THEN coalesce(v, '(none)') "
             "WHEN t = 'purchaser_status' THEN IF(v = 'true', 'purchaser', 'non_purchaser') "
             "ELSE IF(v = 'true', 'search_session', 'non_search_session') END")
    session_level = seg.selectExpr(*S.aliased([("segment_type", "t"), ("segment_value", label)]),
                                   *_segment_metric_sql())
    if usrs is None:
        return session_level.select(*SEGMENT_COLUMNS)
    pu = usrs.groupBy("is_purchaser").agg(*_exprs([
        ("unique_users", "count(user_pseudo_id)"),
        ("total_sessions", "sum(session_count)"),
        ("purchase_sessions", "sum(purchase_session_count)"),
        ("purchasers", S.count_when("is_purchaser")),
        ("total_revenue_usd", S.money_sum("total_revenue_usd")),
        ("total_orders", "sum(order_count)"),
    ]))
    user_level = pu.selectExpr(*S.aliased([
        ("segment_type", "'purchaser_status'"),
        ("segment_value", "IF(is_purchaser, 'purchaser', 'non_purchaser')")]), *_segment_metric_sql())
    return session_level.unionByName(user_level).select(*SEGMENT_COLUMNS)


def _segment_metric_sql() -> list[str]:
    return S.aliased([
        ("unique_users", "unique_users"), ("total_sessions", "total_sessions"),
        ("purchase_sessions", "purchase_sessions"), ("purchasers", "purchasers"),
        ("total_revenue_usd", "total_revenue_usd"), ("total_orders", "total_orders"),
        ("session_conversion_rate", S.safe_divide("purchase_sessions", "total_sessions")),
        ("revenue_per_session_usd", S.safe_divide("total_revenue_usd", "total_sessions")),
        ("avg_order_value_usd", S.safe_divide("total_revenue_usd", "total_orders")),
    ])


# ---------------------------------------------------------------- M-12
def product_performance(pe: DataFrame) -> DataFrame:
    """Purchase metrics per ``item_id`` (not deduplicated by transaction).

    Three nested aggregations - (item, user, session), (item, user), item -
    count distinct sessions and users without ``Expand``; a hot item is
    combined map-side at every level. Item attributes (min of the names)
    come from a separate aggregation joined on ``item_id``.
    """
    items = pe.where("event_name = 'purchase' AND item_id IS NOT NULL").selectExpr(
        "item_id", "item_name", "item_brand", "item_category", "user_pseudo_id", "session_key", "event_date_parsed",
        "coalesce(quantity, 1) AS q",
        "coalesce(item_revenue_in_usd, item_revenue, price_in_usd, price, CAST(0 AS DOUBLE)) AS r")
    # Names are taken in their own one-level aggregation: string buffers force sort-based
    # aggregation, so keeping them out of the three counting levels lets those hash-aggregate.
    names = items.groupBy("item_id").agg(*_exprs([(c, f"min({c})") for c in ("item_name", "item_brand",
                                                                           "item_category")]))
    l1 = items.groupBy("item_id", "user_pseudo_id", "session_key").agg(*_exprs([
        ("n", "count(1)"), ("q", "sum(q)"), ("r", S.money_sum("r")),
        ("d0", "min(event_date_parsed)"), ("d1", "max(event_date_parsed)")]))
    l2 = l1.groupBy("item_id", "user_pseudo_id").agg(*_exprs([
        ("n", "sum(n)"), ("q", "sum(q)"), ("r", S.money_sum("r")), ("s", "count(session_key)"),
        ("d0", "min(d0)"), ("d1", "max(d1)")]))
    l3 = l2.groupBy("item_id").agg(*_exprs([
        ("purchase_event_count", "sum(n)"), ("total_units_sold", "sum(q)"),
        ("unique_purchasers", "count(user_pseudo_id)"), ("purchase_sessions", "sum(s)"),
        ("total_item_revenue_usd", S.money_sum("r")),
        ("first_purchase_date", "min(d0)"), ("last_purchase_date", "max(d1)")]))
    # both sides are one row per item, hash-partitioned by item_id: the join adds no shuffle
    l3 = l3.join(names, "item_id")
    return l3.selectExpr(
        "item_id", "item_name", "item_brand", "item_category", "purchase_event_count", "total_units_sold",
        "unique_purchasers", "purchase_sessions", "total_item_revenue_usd",
        f"{S.safe_divide('total_item_revenue_usd', 'total_units_sold')} AS avg_revenue_per_unit_usd",
        "first_purchase_date", "last_purchase_date",
    ).orderBy(F.col("total_item_revenue_usd").desc_nulls_last(), F.col("item_id"))
