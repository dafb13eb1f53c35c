"""Findings and dashboard computations as DataFrame operators (INS-*, FLT-13).

They read marts, whose size is bounded by the calendar, the segment lists or
the funnel steps - except the RFM table (one row per purchaser), whose
running shares use the distributed ranges of ``global_rank``. Windows
without ``partitionBy`` appear only over those bounded tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelworks.functions.metrics import count_when, money, money_sum, safe_divide
from funnelworks.operators.global_rank import SortKey, running_sum
from funnelworks.plans.marts import small_ordered

# Funnel step labels, trend threshold (percent) and stabilization delta.
FUNNEL_STEP_LABELS = [
    ("sessions_entered", "Sessions Entered"),
    ("sessions_product_view", "Product View"),
    ("sessions_add_to_cart", "Add to Cart"),
    ("sessions_begin_checkout", "Begin Checkout"),
    ("sessions_purchase", "Purchase"),
]
DEVICE_STEP_LABELS = {
    "sessions_entered": "Entered",
    "sessions_product_view": "Product View",
    "sessions_add_to_cart": "Add to Cart",
    "sessions_begin_checkout": "Checkout",
    "sessions_purchase": "Purchase",
}
TREND_THRESHOLD_PCT = 5.0
STABILIZATION_DELTA = 0.01


def _dbl(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


# ------------------------------------------------------------ INS-1
def kpi_totals(kpis: DataFrame) -> DataFrame:
    """Period totals; conversion here is orders / sessions (not the mart's session rate)."""
    return kpis.agg(
        F.min("report_date").alias("start_date"),
        F.max("report_date").alias("end_date"),
        F.sum("daily_active_users").alias("total_user_days"),
        F.sum("total_sessions").alias("total_sessions"),
        F.sum("total_orders").alias("total_orders"),
        money_sum("total_revenue_usd").alias("total_revenue_usd"),
        safe_divide(F.sum("total_orders"), F.sum("total_sessions")).alias("overall_session_conversion"),
        safe_divide(money_sum("total_revenue_usd"), F.sum("total_orders")).alias("overall_aov"),
    )


# ------------------------------------------------------------ INS-2, INS-3
def _pct_change(new: Column, base: Column) -> Column:
    return F.when(base > 0, (new - base) / base * F.lit(100.0)).otherwise(F.lit(0.0))


def _ratio_or_zero(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def week_over_week(kpis: DataFrame) -> DataFrame:
    """Last 7 days vs the 7 before, relative to the last report date.

    Percent change for sessions, orders, revenue and AOV (0 when the base is
    0); percentage-point change for conversion (orders / sessions); plus the
    trend class of the revenue change.
    """
    # one row per report day: a whole-table window is bounded by the calendar and avoids
    # joining the mart with its own aggregate (which would plan the mart twice)
    k = kpis.withColumn("_max", F.max("report_date").over(Window.partitionBy(F.lit(1))))
    last = F.col("report_date") > F.date_sub("_max", 7)
    prev = (F.col("report_date") <= F.date_sub("_max", 7)) & (F.col("report_date") > F.date_sub("_max", 14))

    def s(cond, c):
        return F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).cast("double")

    def m(cond, c):
        return F.coalesce(money_sum(F.when(cond, F.col(c))), F.lit(0.0))

    a = k.agg(s(last, "total_sessions").alias("l7_sessions"), s(prev, "total_sessions").alias("p7_sessions"),
              s(last, "total_orders").alias("l7_orders"), s(prev, "total_orders").alias("p7_orders"),
              m(last, "total_revenue_usd").alias("l7_revenue_usd"),
              m(prev, "total_revenue_usd").alias("p7_revenue_usd"))
    l7_cvr = _ratio_or_zero(F.col("l7_orders"), F.col("l7_sessions"))
    p7_cvr = _ratio_or_zero(F.col("p7_orders"), F.col("p7_sessions"))
    l7_aov = _ratio_or_zero(F.col("l7_revenue_usd"), F.col("l7_orders"))
    p7_aov = _ratio_or_zero(F.col("p7_revenue_usd"), F.col("p7_orders"))
    rev = _pct_change(F.col("l7_revenue_usd"), F.col("p7_revenue_usd"))
    return a.select(
        "*",
        _pct_change(F.col("l7_sessions"), F.col("p7_sessions")).alias("session_delta_pct"),
        _pct_change(F.col("l7_orders"), F.col("p7_orders")).alias("order_delta_pct"),
        rev.alias("revenue_delta_pct"),
        ((l7_cvr - p7_cvr) * F.lit(100.0)).alias("cvr_delta_pp"),
        _pct_change(l7_aov, p7_aov).alias("aov_delta_pct"),
        trend(rev).alias("trend"),
    )


def trend(revenue_delta_pct: Column, threshold: float = TREND_THRESHOLD_PCT) -> Column:
    """INS-3: growth above +threshold %, contraction below -threshold %, else stable."""
    return (F.when(revenue_delta_pct > threshold, F.lit("growth"))
            .when(revenue_delta_pct < -threshold, F.lit("contraction"))
            .otherwise(F.lit("stable")))


def trend_class(kpis: DataFrame) -> DataFrame:
    return week_over_week(kpis).select("revenue_delta_pct", "trend")


# ------------------------------------------------------------ INS-4
def peak_week(kpis: DataFrame) -> DataFrame:
    """Date with the largest trailing 7-day revenue (earliest date on ties)."""
    day = F.datediff("report_date", F.lit("1970-01-01").cast("date")).cast("long")
    amount = money("total_revenue_usd")
    # One row per report day: the single ordered window is bounded by the calendar.
    w = Window.orderBy(day).rangeBetween(-6, 0)
    rolled = kpis.select("report_date", F.sum(amount).over(w).alias("_r"))
    best = rolled.agg(F.min(F.struct((-F.col("_r")).alias("k"), F.col("report_date").alias("d"))).alias("b"))
    return best.select(F.col("b.d").alias("peak_date"),
                       (-F.col("b.k")).cast("double").alias("peak_7d_revenue_usd"))


# ------------------------------------------------------------ INS-5, INS-6, INS-17
def _funnel_sums(funnel_mart: DataFrame) -> DataFrame:
    return funnel_mart.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
                             for c, _ in FUNNEL_STEP_LABELS])


def funnel_total(funnel_mart: DataFrame) -> DataFrame:
    """Five rows: step, sessions, share of entered, share of the previous step."""
    t = _funnel_sums(funnel_mart)
    entered = F.col("sessions_entered")
    rows = []
    for i, (c, label) in enumerate(FUNNEL_STEP_LABELS):
        prev = F.col(FUNNEL_STEP_LABELS[i - 1][0]) if i else None
        rows.append(F.struct(
            F.lit(i + 1).alias("step_index"), F.lit(label).alias("step"), F.col(c).alias("sessions"),
            _ratio_or_zero(_dbl(c), _dbl(entered)).alias("pct_of_entered"),
            (F.lit(None).cast("double") if prev is None else _ratio_or_zero(_dbl(c), _dbl(prev)))
            .alias("pct_of_previous")))
    return t.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def largest_drop(funnel_mart: DataFrame) -> DataFrame:
    """Step pair with the largest drop 1 - n_i / n_(i-1) over positive bases; first wins ties."""
    t = _funnel_sums(funnel_mart)
    cands = []
    for i in range(1, len(FUNNEL_STEP_LABELS)):
        (pc, pl), (c, label) = FUNNEL_STEP_LABELS[i - 1], FUNNEL_STEP_LABELS[i]
        cands.append(F.when(F.col(pc) > 0, F.struct(
            (-(F.lit(1.0) - _dbl(c) / _dbl(pc))).alias("k"), F.lit(i).alias("i"),
            F.lit(pl).alias("from_step"), F.lit(label).alias("to_step"))))
    best = t.select(F.array_min(F.array_compact(F.array(*cands))).alias("b"))
    return best.select(F.col("b.from_step").alias("from_step"), F.col("b.to_step").alias("to_step"),
                       (-F.col("b.k")).alias("drop_rate"))


def cart_abandonment(funnel_mart: DataFrame) -> DataFrame:
    """INS-17: 1 - checkout / cart on the sequential funnel."""
    t = _funnel_sums(funnel_mart)
    return t.select("sessions_add_to_cart", "sessions_begin_checkout",
                    (F.lit(1.0) - safe_divide("sessions_begin_checkout", "sessions_add_to_cart"))
                    .alias("cart_abandonment_rate"))


# ------------------------------------------------------------ INS-7
def funnel_by_device(funnel_mart: DataFrame) -> DataFrame:
    """Long form: (device, step label, sessions)."""
    cols = [c for c, _ in FUNNEL_STEP_LABELS]
    wide = funnel_mart.groupBy("device_category").agg(*[F.sum(c).alias(c) for c in cols])
    long = wide.unpivot("device_category", cols, "funnel_step", "sessions")
    label = None
    for c, lab in DEVICE_STEP_LABELS.items():
        label = (F.when(F.col("funnel_step") == c, F.lit(lab)) if label is None
                 else label.when(F.col("funnel_step") == c, F.lit(lab)))
    return long.select("device_category", label.alias("funnel_step"), "sessions")


# ------------------------------------------------------------ INS-8
def segment_compare(segments: DataFrame, types=("device_category", "search_adoption")) -> DataFrame:
    return (segments.where(F.col("segment_type").isin(*types))
            .select("segment_type", "segment_value", "unique_users", "total_sessions", "total_revenue_usd",
                    "session_conversion_rate", "avg_order_value_usd")
            .transform(lambda d: small_ordered(d, "segment_type", F.col("total_sessions").desc(), "segment_value")))


# ------------------------------------------------------------ INS-9
def rfm_distribution(rfm: DataFrame) -> DataFrame:
    return (rfm.groupBy("rfm_segment").agg(
        F.count(F.lit(1)).alias("customer_count"),
        money_sum("monetary_value_usd").alias("total_revenue_usd"),
        (F.sum("frequency").cast("double") / F.count("frequency")).alias("avg_frequency"),
        (F.sum("recency_days").cast("double") / F.count("recency_days")).alias("avg_recency_days"),
    ).transform(lambda d: small_ordered(d, F.col("total_revenue_usd").desc(), "rfm_segment")))


# ------------------------------------------------------------ INS-10...14
def retention_curve(retention: DataFrame, max_week: int | None = 8) -> DataFrame:
    """Ratio of summed retained users to summed cohort sizes per week index."""
    r = retention if max_week is None else retention.where(F.col("activity_week_index") <= max_week)
    return (r.groupBy("activity_week_index").agg(
        F.sum("retained_users").alias("total_retained"),
        F.sum("cohort_size").alias("total_cohort_size"))
        .withColumn("avg_retention_rate", safe_divide("total_retained", "total_cohort_size"))
        .transform(lambda d: small_ordered(d, "activity_week_index")))


def retention_matrix(retention: DataFrame, max_week: int = 8) -> DataFrame:
    """Cohort x week-index matrix of retention rates (pivot with fixed columns)."""
    weeks = list(range(max_week + 1))
    p = (retention.where(F.col("activity_week_index") <= max_week)
         .groupBy("cohort_week").pivot("activity_week_index", weeks).agg(F.avg("retention_rate")))
    return small_ordered(p.select("cohort_week", *[F.col(f"`{w}`").alias(f"week_{w}") for w in weeks]), "cohort_week")


def retention_stabilization(retention: DataFrame, delta: float = STABILIZATION_DELTA) -> DataFrame:
    """First week i-1 where |change| at rows i-1 and i are both below ``delta``,
    scanning from the third row of the full curve; NULL when none."""
    curve = retention_curve(retention, None)
    # One row per week index: the ordered window is bounded by the calendar.
    w = Window.orderBy("activity_week_index")
    c = (curve.withColumn("_rn", F.row_number().over(w) - 1)
         .withColumn("_diff", F.abs(F.col("avg_retention_rate") - F.lag("avg_retention_rate").over(w)))
         .withColumn("_pdiff", F.lag("_diff").over(w))
         .withColumn("_pidx", F.lag("activity_week_index").over(w))
         .withColumn("_prate", F.lag("avg_retention_rate").over(w)))
    hit = c.where((F.col("_rn") >= 2) & (F.col("_pdiff") < delta) & (F.col("_diff") < delta))
    best = hit.agg(F.min(F.struct("_rn", "_pidx", "_prate")).alias("b"))
    return best.select(F.col("b._pidx").alias("stabilization_week"),
                       F.col("b._prate").alias("stabilization_rate"))


def cohort_sizes(retention: DataFrame) -> DataFrame:
    return (retention.where(F.col("activity_week_index") == 0)
            .select("cohort_week", "cohort_size").transform(lambda d: small_ordered(d, "cohort_week")))


def week1_retention(retention: DataFrame) -> DataFrame:
    return retention_curve(retention, None).where(F.col("activity_week_index") == 1) \
        .select("total_retained", "total_cohort_size", F.col("avg_retention_rate").alias("week1_retention_rate"))


# ------------------------------------------------------------ INS-15
def revenue_concentration(rfm: DataFrame, ranges: int | None = None) -> DataFrame:
    """Cumulative revenue share by purchaser, ranked by revenue (desc, user tie-break)."""
    buyers = rfm.where(F.col("monetary_value_usd") > 0).select("user_pseudo_id", "monetary_value_usd")
    keys = [SortKey("monetary_value_usd", False), SortKey("user_pseudo_id")]
    r = running_sum(buyers, keys, "monetary_value_usd", "cumulative_revenue", ranges)
    return r.select(
        "user_pseudo_id", "monetary_value_usd",
        (F.col("cumulative_revenue_pos") + 1).alias("customer_rank"),
        "cumulative_revenue",
        (F.col("cumulative_revenue") / F.col("cumulative_revenue_total")).alias("cumulative_revenue_pct"),
        ((F.col("cumulative_revenue_pos") + 1).cast("double") / F.col("cumulative_revenue_n"))
        .alias("customer_percentile"),
        F.col("cumulative_revenue_n").alias("purchasers"))


def top_decile_share(concentration: DataFrame) -> DataFrame:
    """Cumulative share at row int(n * 0.1) - 1; no row when fewer than 10 purchasers."""
    k = F.floor(F.col("purchasers").cast("double") * F.lit(0.1)).cast("long")
    return (concentration.where((k >= 1) & (F.col("customer_rank") == k))
            .select("purchasers", k.alias("top_decile_customers"),
                    F.col("cumulative_revenue_pct").alias("top_decile_revenue_share")))


# ------------------------------------------------------------ INS-16
def top_products(products: DataFrame, n: int = 20) -> DataFrame:
    if not 1 <= n:
        raise ValueError("n must be positive")
    return products.orderBy(F.col("total_item_revenue_usd").desc_nulls_last(), "item_id").limit(n)


# ------------------------------------------------------------ INS-18, INS-19
def repeat_rate(usrs: DataFrame) -> DataFrame:
    return usrs.agg(count_when(F.col("is_purchaser")).alias("purchasers"),
                    count_when(F.col("is_purchaser") & (F.col("order_count") > 1)).alias("repeat_purchasers")) \
        .withColumn("repeat_purchase_rate", safe_divide("repeat_purchasers", "purchasers"))


def ltv_proxy(usrs: DataFrame) -> DataFrame:
    return usrs.agg(F.count("user_pseudo_id").alias("users"),
                    count_when(F.col("is_purchaser")).alias("purchasers"),
                    money_sum("total_revenue_usd").alias("total_revenue_usd")) \
        .withColumn("revenue_per_user_usd", safe_divide("total_revenue_usd", "users")) \
        .withColumn("revenue_per_purchaser_usd", safe_divide("total_revenue_usd", "purchasers"))


# ------------------------------------------------------------ FLT-13
def apply_filters(df: DataFrame, start=None, end=None, devices=None, mediums=None,
                  date_col: str = "report_date") -> DataFrame:
    """Global filter: inclusive dates; a dimension filters only when its column
    exists; an empty selection returns no rows; NULL values are never selected."""
    if date_col in df.columns:
        if start is not None:
            df = df.where(F.col(date_col) >= F.lit(start).cast("date"))
        if end is not None:
            df = df.where(F.col(date_col) <= F.lit(end).cast("date"))
    for col, sel in (("device_category", devices), ("acquisition_medium", mediums)):
        if sel is None or col not in df.columns:
            continue
        df = df.where(F.col(col).isin(*sel)) if len(sel) else df.where(F.lit(False))
    return df


# ------------------------------------------------------------ SRT-7
def filter_options(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct non-NULL values of a dimension (the options of a global filter)."""
    return (df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("option"))
            .distinct().transform(lambda d: small_ordered(d, "option")))
