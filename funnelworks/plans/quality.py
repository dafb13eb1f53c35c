"""Data-quality operators (Q-1...Q-13).

Each check is a DataFrame. Global profiles with several exact distinct
counts are split into one-distinct aggregations joined as one-row frames,
so Spark never has to ``Expand`` the input; grouped checks shuffle once on
their key after map-side combining.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from funnelworks.functions.metrics import count_when, money_sum, safe_divide
from funnelworks.functions.params import event_param
from funnelworks.plans.marts import small_ordered
from funnelworks.sources.events import table_exists

# Events the checklist requires and the tolerance of the reconciliation test.
REQUIRED_EVENTS = ("page_view", "view_item", "add_to_cart", "begin_checkout", "purchase", "view_search_results")
MAX_USER_NULL_RATE = 0.001
RECONCILIATION_REL_TOL = 0.01
RECONCILIATION_ABS_TOL = 1.0
MART_NAMES = ("mart_product_kpis_daily", "mart_funnel_performance", "mart_retention_cohorts",
              "mart_customer_rfm", "mart_segment_performance", "mart_product_performance")

# Schema tests of the models, (model, column, test, accepted values).
RFM_SEGMENTS = ("Champions", "Loyal Customers", "Potential Loyalists", "Recent Customers", "At Risk",
                "Occasional Customers")
SEGMENT_TYPES = ("device_category", "acquisition_medium", "search_adoption", "purchaser_status")
SCHEMA_TESTS = [
    ("stg_ga4_events", "user_pseudo_id", "not_null", None),
    ("int_sessions", "session_key", "unique", None),
    ("int_sessions", "session_key", "not_null", None),
    ("int_sessions", "user_pseudo_id", "not_null", None),
    ("int_sessions", "session_date", "not_null", None),
    ("int_users", "user_pseudo_id", "unique", None),
    ("int_users", "user_pseudo_id", "not_null", None),
    ("int_users", "first_seen_date", "not_null", None),
    ("int_orders", "order_transaction_key", "unique", None),
    ("int_orders", "order_transaction_key", "not_null", None),
    ("int_orders", "user_pseudo_id", "not_null", None),
    ("int_session_funnel", "session_key", "unique", None),
    ("int_session_funnel", "session_key", "not_null", None),
    ("mart_product_kpis_daily", "report_date", "unique", None),
    ("mart_product_kpis_daily", "report_date", "not_null", None),
    ("mart_funnel_performance", "report_date", "not_null", None),
    ("mart_retention_cohorts", "cohort_week", "not_null", None),
    ("mart_customer_rfm", "user_pseudo_id", "unique", None),
    ("mart_customer_rfm", "user_pseudo_id", "not_null", None),
    ("mart_customer_rfm", "rfm_segment", "accepted_values", RFM_SEGMENTS),
    ("mart_segment_performance", "segment_type", "not_null", None),
    ("mart_segment_performance", "segment_type", "accepted_values", SEGMENT_TYPES),
    ("mart_product_performance", "item_id", "unique", None),
    ("mart_product_performance", "item_id", "not_null", None),
]


# ------------------------------------------------------------ Q-1
def source_coverage(raw: DataFrame) -> DataFrame:
    per_date = raw.groupBy("event_date").agg(F.count(F.lit(1)).alias("n"))      # one row per date
    dates = per_date.agg(F.sum("n").alias("total_events"), F.min("event_date").alias("earliest_date"),
                         F.max("event_date").alias("latest_date"),
                         F.count("event_date").alias("distinct_dates"))
    users = raw.agg(F.countDistinct("user_pseudo_id").alias("distinct_users"))
    return dates.crossJoin(users)


# ------------------------------------------------------------ Q-2
def event_inventory(raw: DataFrame) -> DataFrame:
    return (raw.groupBy("event_name").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.countDistinct("user_pseudo_id").alias("distinct_users"),
        F.min("event_date").alias("first_seen"), F.max("event_date").alias("last_seen"))
        .transform(lambda d: small_ordered(d, F.col("event_count").desc(), "event_name")))


# ------------------------------------------------------------ Q-3
def null_fields() -> list[tuple[str, Column]]:
    """(label, column) pairs profiled by ``null_profile``."""
    return [
        ("user_id", F.col("user_pseudo_id")),
        ("event_name", F.col("event_name")),
        ("timestamp", F.col("event_timestamp")),
        ("session_id", event_param("ga_session_id", "int_value")),
        ("ecom_txn_id", F.col("ecommerce.transaction_id")),
    ]


def null_profile(raw: DataFrame) -> DataFrame:
    """(field, null_count, null_rate); the rate is 0 for an empty input."""
    fields = null_fields()
    a = raw.agg(F.count(F.lit(1)).alias("total"),
                *[F.count_if(c.isNull()).alias(name) for name, c in fields])
    rows = F.array(*[F.struct(F.lit(name).alias("field"), F.col(name).alias("null_count")) for name, _ in fields])
    return a.select("total", F.explode(rows).alias("r")).select(
        "r.field", "r.null_count",
        F.when(F.col("total") > 0, F.col("r.null_count") / F.col("total")).otherwise(F.lit(0.0)).alias("null_rate"))


# ------------------------------------------------------------ Q-4
def dup_transactions(raw: DataFrame, top: int = 10) -> DataFrame:
    """Transaction ids (ecommerce field only) on more than one purchase event, top ``top``."""
    return (raw.where((F.col("event_name") == "purchase") & F.col("ecommerce.transaction_id").isNotNull())
            .groupBy(F.col("ecommerce.transaction_id").alias("txn_id"))
            .agg(F.count(F.lit(1)).alias("event_count"))
            .where(F.col("event_count") > 1)
            .orderBy(F.col("event_count").desc(), "txn_id")
            .limit(top))


# ------------------------------------------------------------ Q-5
def mart_row_counts(spark: SparkSession, marts: dict[str, DataFrame] | None = None, base: str | None = None,
                    names=MART_NAMES) -> DataFrame:
    """(mart, status, row_count): counts of given frames, or of Parquet marts under ``base``."""
    schema = T.StructType([T.StructField("mart", T.StringType()), T.StructField("status", T.StringType()),
                           T.StructField("row_count", T.LongType())])
    parts = []
    for name in names:
        df = (marts or {}).get(name)
        if df is None and base is not None and table_exists(spark, name, base):
            df = spark.read.parquet(f"{base.rstrip('/')}/{name}")
        if df is None:
            parts.append(spark.createDataFrame([(name, "missing", None)], schema))
        else:
            parts.append(df.agg(F.count(F.lit(1)).alias("row_count"))
                         .select(F.lit(name).alias("mart"), F.lit("ok").alias("status"), "row_count"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ------------------------------------------------------------ Q-6
def reconciliation(stg: DataFrame, ords: DataFrame, rel_tol: float = RECONCILIATION_REL_TOL,
                   abs_tol: float = RECONCILIATION_ABS_TOL) -> DataFrame:
    """Deduplicated order revenue vs source purchase revenue; fails only when
    both the relative and the absolute tolerance are exceeded."""
    o = ords.agg(money_sum("order_revenue_usd").alias("orders_revenue"))
    src = stg.where((F.col("event_name") == "purchase")
                    & F.coalesce(F.col("ecommerce_transaction_id"), F.col("transaction_id")).isNotNull())
    s = src.agg(money_sum(F.coalesce(F.col("ecommerce_purchase_revenue_in_usd"),
                                     F.col("ecommerce_purchase_revenue"), F.lit(0.0))).alias("source_revenue"))
    diff = F.abs(F.col("orders_revenue") - F.col("source_revenue"))
    return (o.crossJoin(s)
            .withColumn("absolute_diff", diff)
            .withColumn("relative_diff", safe_divide(diff, "source_revenue"))
            .withColumn("exceeds_tolerance", F.coalesce((F.col("relative_diff") > rel_tol)
                                                        & (F.col("absolute_diff") > abs_tol), F.lit(False))))


# ------------------------------------------------------------ Q-7
def purchase_profile(raw: DataFrame) -> DataFrame:
    usd = F.col("ecommerce.purchase_revenue_in_usd")
    p = raw.where(F.col("event_name") == "purchase")
    return p.agg(
        F.count(F.lit(1)).alias("total_purchase_events"),
        F.count("ecommerce.transaction_id").alias("has_ecommerce_txn_id"),
        F.count(event_param("transaction_id", "string_value")).alias("has_param_txn_id"),
        F.count("ecommerce.purchase_revenue").alias("has_purchase_revenue"),
        F.count(usd).alias("has_purchase_revenue_usd"),
        F.min(usd).alias("min_revenue_usd"), F.max(usd).alias("max_revenue_usd"),
        (money_sum(usd) / F.count(usd)).alias("avg_revenue_usd"),
        count_when(F.size("items") > 0).alias("has_items"),
        F.countDistinct("ecommerce.transaction_id").alias("distinct_txn_ids"),
    )


# ------------------------------------------------------------ Q-8
def session_crosscheck(sess: DataFrame, kpis: DataFrame) -> DataFrame:
    a = sess.agg(F.countDistinct("session_key").alias("total_sessions"))
    b = sess.agg(F.countDistinct("user_pseudo_id").alias("total_users"))
    model = a.crossJoin(b).select(F.lit("int_sessions").alias("model"), "total_sessions", "total_users")
    mart = kpis.agg(F.sum("total_sessions").alias("total_sessions"),
                    F.sum("daily_active_users").alias("total_users")) \
        .select(F.lit("mart_kpis_sum").alias("model"), "total_sessions", "total_users")
    return model.unionByName(mart)


# ------------------------------------------------------------ Q-9
def schema_checks(models: dict[str, DataFrame], tests=SCHEMA_TESTS) -> DataFrame:
    """(model, column_name, test, failures) with schema-test counting: NULL rows for
    not_null, duplicated values for unique, distinct unaccepted values for
    accepted_values. One pass per model for not_null, one shuffle per unique key."""
    parts = []
    by_model: dict[str, list] = {}
    for t in tests:
        if t[0] in models:
            by_model.setdefault(t[0], []).append(t)
    for model, ts in by_model.items():
        df = models[model]
        simple = [(c, test, vals) for _, c, test, vals in ts if test == "not_null"]
        if simple:
            a = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"f{i}") for i, (c, _, _) in enumerate(simple)])
            rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(test).alias("test"),
                                      F.col(f"f{i}").cast("long").alias("failures"))
                             for i, (c, test, _) in enumerate(simple)])
            parts.append(a.select(F.explode(rows).alias("r")).select(F.lit(model).alias("model"), "r.*"))
        for _, c, test, vals in ts:
            if test == "unique":
                f = (df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
                     .agg(count_when(F.col("n") > 1).alias("failures")))
            elif test == "accepted_values":
                f = (df.where(~F.col(c).isin(*vals)).select(c).distinct()
                     .agg(F.count(F.lit(1)).alias("failures")))
            else:
                continue
            parts.append(f.select(F.lit(model).alias("model"), F.lit(c).alias("column_name"),
                                  F.lit(test).alias("test"), F.coalesce(F.col("failures"), F.lit(0)).cast("long")
                                  .alias("failures")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ------------------------------------------------------------ Q-10
def negative_revenue(ords: DataFrame) -> DataFrame:
    return ords.where(F.col("order_revenue_usd") < 0).select("order_transaction_key", "order_revenue_usd")


# ------------------------------------------------------------ Q-11
def funnel_consistency(funnel: DataFrame, sample: int = 10) -> DataFrame:
    """Sessions whose sequential flags contradict each other (0 rows expected), a sample of ``sample``."""
    bad = ((F.col("reached_begin_checkout_after_cart") & ~F.col("reached_add_to_cart_after_view"))
           | (F.col("reached_purchase_after_checkout") & ~F.col("reached_begin_checkout_after_cart"))
           | (F.col("reached_add_to_cart_after_view") & ~F.col("reached_view_item")))
    return funnel.where(bad).select(
        "session_key", "reached_view_item", "reached_add_to_cart_after_view",
        "reached_begin_checkout_after_cart", "reached_purchase_after_checkout").limit(sample)


# ------------------------------------------------------------ Q-12
def missing_dates(stg: DataFrame) -> DataFrame:
    """Calendar days between the first and last event date with no events.

    The calendar comes from ``sequence`` over the one-row min/max and has one
    row per day of the range, so it is bounded by the range, not the data.
    """
    present = stg.select("event_date_parsed").where(F.col("event_date_parsed").isNotNull()).distinct()
    bounds = stg.agg(F.min("event_date_parsed").alias("lo"), F.max("event_date_parsed").alias("hi"))
    cal = bounds.where(F.col("lo").isNotNull()).select(F.explode(F.sequence("lo", "hi")).alias("missing_date"))
    return cal.join(present, cal["missing_date"] == present["event_date_parsed"], "left_anti")


def quality_checklist(stg: DataFrame, required_events=REQUIRED_EVENTS,
                      max_user_null_rate: float = MAX_USER_NULL_RATE) -> DataFrame:
    """(check, value, passed): user-id null rate, gap days, each required event present."""
    a = stg.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("user_pseudo_id").isNull()).alias("nulls"),
                *[F.count_if(F.col("event_name") == e).alias(f"ev_{i}") for i, e in enumerate(required_events)])
    gaps = missing_dates(stg).agg(F.count(F.lit(1)).alias("gaps"))
    rate = F.when(F.col("n") > 0, F.col("nulls") / F.col("n")).otherwise(F.lit(0.0))
    rows = [F.struct(F.lit("user_pseudo_id_null_rate").alias("check"), rate.alias("value"),
                     (rate < max_user_null_rate).alias("passed")),
            F.struct(F.lit("missing_dates").alias("check"), F.col("gaps").cast("double").alias("value"),
                     (F.col("gaps") == 0).alias("passed"))]
    rows += [F.struct(F.lit(f"event_present:{e}").alias("check"), F.col(f"ev_{i}").cast("double").alias("value"),
                      (F.col(f"ev_{i}") > 0).alias("passed")) for i, e in enumerate(required_events)]
    return a.crossJoin(gaps).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


# ------------------------------------------------------------ Q-13
def privacy_check(extracts: dict[str, DataFrame], forbidden=None) -> DataFrame:
    """(table_name, column_name) of forbidden columns still present; 0 rows expected.

    Looks at schemas only (driver metadata), nothing is read.
    """
    from funnelworks.plans.export import FORBIDDEN_COLUMNS
    spark = next(iter(extracts.values())).sparkSession
    forbidden = set(forbidden or FORBIDDEN_COLUMNS)
    rows = [(t, c) for t, df in extracts.items() for c in df.columns if c.lower() in forbidden]
    schema = "table_name string, column_name string"
    return spark.createDataFrame(rows, schema)
