"""Declared schemas (SRC-2) and typed column lists of every model (section 1.3)."""

from __future__ import annotations

from pyspark.sql import types as T

PARAM_VALUE = T.StructType([
    T.StructField("string_value", T.StringType()),
    T.StructField("int_value", T.LongType()),
    T.StructField("double_value", T.DoubleType()),
    T.StructField("float_value", T.DoubleType()),
])

EVENT_PARAM = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("value", PARAM_VALUE),
])

ECOMMERCE = T.StructType([
    T.StructField("purchase_revenue", T.DoubleType()),
    T.StructField("purchase_revenue_in_usd", T.DoubleType()),
    T.StructField("transaction_id", T.StringType()),
    T.StructField("total_item_quantity", T.LongType()),
])

DEVICE = T.StructType([
    T.StructField("category", T.StringType()),
    T.StructField("operating_system", T.StringType()),
    T.StructField("web_info", T.StructType([T.StructField("browser", T.StringType())])),
])

GEO = T.StructType([
    T.StructField("country", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("continent", T.StringType()),
    T.StructField("sub_continent", T.StringType()),
])

TRAFFIC_SOURCE = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("medium", T.StringType()),
    T.StructField("name", T.StringType()),
])

ITEM = T.StructType([
    T.StructField("item_id", T.StringType()),
    T.StructField("item_name", T.StringType()),
    T.StructField("item_brand", T.StringType()),
    T.StructField("item_category", T.StringType()),
    T.StructField("item_category2", T.StringType()),
    T.StructField("item_category3", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("price_in_usd", T.DoubleType()),
    T.StructField("quantity", T.LongType()),
    T.StructField("item_revenue", T.DoubleType()),
    T.StructField("item_revenue_in_usd", T.DoubleType()),
])

# Raw event, one row per event; event_date (yyyyMMdd text) is the partition column.
RAW_EVENT = T.StructType([
    T.StructField("event_date", T.StringType()),
    T.StructField("event_timestamp", T.LongType()),
    T.StructField("event_name", T.StringType()),
    T.StructField("user_pseudo_id", T.StringType()),
    T.StructField("event_params", T.ArrayType(EVENT_PARAM)),
    T.StructField("ecommerce", ECOMMERCE),
    T.StructField("device", DEVICE),
    T.StructField("geo", GEO),
    T.StructField("traffic_source", TRAFFIC_SOURCE),
    T.StructField("items", T.ArrayType(ITEM)),
])

# Experiment unit table (one row per user).
EXPERIMENT_UNIT = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("experiment_id", T.StringType()),
    T.StructField("variant", T.StringType()),
    T.StructField("assignment_timestamp", T.TimestampType()),
    T.StructField("is_eligible", T.BooleanType()),
    T.StructField("device_category", T.StringType()),
    T.StructField("converted_purchase", T.IntegerType()),
    T.StructField("revenue_usd", T.DoubleType()),
    T.StructField("payment_error", T.IntegerType()),
    T.StructField("refund_or_cancelled", T.IntegerType()),
    T.StructField("checkout_duration_seconds", T.DoubleType()),
])

# Output column orders (section 1.3).
STG_COLUMNS = [
    "event_date", "event_timestamp", "event_timestamp_utc", "event_date_parsed", "event_name",
    "user_pseudo_id", "ga_session_id", "session_key", "ga_session_number", "page_location",
    "page_title", "page_referrer", "search_term", "transaction_id", "ecommerce_purchase_revenue",
    "ecommerce_purchase_revenue_in_usd", "ecommerce_transaction_id", "ecommerce_total_item_quantity",
    "device_category", "operating_system", "browser", "country", "city", "continent", "sub_continent",
    "first_user_source", "first_user_medium", "first_user_campaign", "engagement_time_msec",
    "engaged_session_event", "items",
]

SESSION_COLUMNS = [
    "session_key", "session_start_timestamp", "session_end_timestamp", "session_date",
    "user_pseudo_id", "device_category", "operating_system", "browser", "country", "city",
    "first_user_source", "first_user_medium", "first_user_campaign", "landing_page", "event_count",
    "has_page_view", "has_view_item", "has_add_to_cart", "has_begin_checkout", "has_purchase",
    "has_search", "session_revenue_usd", "transaction_count", "total_engagement_time_msec",
]

USER_COLUMNS = [
    "user_pseudo_id", "first_seen_date", "last_seen_date", "session_count", "purchase_session_count",
    "order_count", "total_revenue_usd", "is_purchaser", "has_ever_searched", "first_device_category",
    "first_user_source", "first_user_medium", "first_user_campaign",
]

ORDER_COLUMNS = [
    "order_transaction_key", "order_timestamp", "order_date", "user_pseudo_id", "session_key",
    "order_revenue_usd", "total_item_quantity", "device_category", "country", "first_user_source",
    "first_user_medium",
]

FUNNEL_COLUMNS = [
    "session_key", "user_pseudo_id", "session_start_time", "first_view_item_time",
    "first_add_to_cart_time", "first_begin_checkout_time", "first_purchase_time", "reached_session",
    "reached_view_item", "reached_add_to_cart_after_view", "reached_begin_checkout_after_cart",
    "reached_purchase_after_checkout",
]

PRODUCT_EVENT_COLUMNS = [
    "event_timestamp_utc", "event_date_parsed", "event_name", "user_pseudo_id", "session_key",
    "device_category", "item_id", "item_name", "item_brand", "item_category", "item_category2",
    "item_category3", "price", "price_in_usd", "quantity", "item_revenue", "item_revenue_in_usd",
]
