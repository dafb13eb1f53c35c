"""M-1 ``stage_events``: flatten raw events into typed columns (no shuffle)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from funnelworks.functions.params import event_param_sql
from funnelworks.sources.events import date_range
from funnelworks.sources.schema import STG_COLUMNS

# Parameters extracted from event_params, (output column, key, typed sub-field).
STAGED_PARAMS = [
    ("ga_session_id", "ga_session_id", "int_value"),
    ("ga_session_number", "ga_session_number", "int_value"),
    ("page_location", "page_location", "string_value"),
    ("page_title", "page_title", "string_value"),
    ("page_referrer", "page_referrer", "string_value"),
    ("search_term", "search_term", "string_value"),
    ("transaction_id", "transaction_id", "string_value"),
    ("engagement_time_msec", "engagement_time_msec", "int_value"),
    ("engaged_session_event", "engaged_session_event", "int_value"),
]


def stage_events(raw: DataFrame, start: str | None = None, end: str | None = None,
                 lenient_dates: bool = False) -> DataFrame:
    """One row per event, columns of ``stg_ga4_events`` in order.

    A single narrow projection, written as SQL expressions: parameter
    lookups are array_position/get on the array (no explode, no lambda),
    structs are flattened by dot access, and the date range is a partition
    filter when ``raw`` comes from ``scan_events``. ``lenient_dates`` turns
    a malformed ``event_date`` into NULL instead of an error.
    """
    raw = date_range(raw, start, end)
    parse = "try_to_date" if lenient_dates else "to_date"
    p = {out: event_param_sql(key, kind) for out, key, kind in STAGED_PARAMS}
    cols = {
        "event_date": "event_date",
        "event_timestamp": "event_timestamp",
        "event_timestamp_utc": "timestamp_micros(event_timestamp)",
        "event_date_parsed": f"{parse}(event_date, 'yyyyMMdd')",
        "event_name": "event_name",
        "user_pseudo_id": "user_pseudo_id",
        "session_key": f"IF(({p['ga_session_id']}) IS NOT NULL, "
                       f"concat(user_pseudo_id, '-', CAST({p['ga_session_id']} AS STRING)), NULL)",
        "ecommerce_purchase_revenue": "ecommerce.purchase_revenue",
        "ecommerce_purchase_revenue_in_usd": "ecommerce.purchase_revenue_in_usd",
        "ecommerce_transaction_id": "ecommerce.transaction_id",
        "ecommerce_total_item_quantity": "ecommerce.total_item_quantity",
        "device_category": "device.category",
        "operating_system": "device.operating_system",
        "browser": "device.web_info.browser",
        "country": "geo.country",
        "city": "geo.city",
        "continent": "geo.continent",
        "sub_continent": "geo.sub_continent",
        "first_user_source": "traffic_source.source",
        "first_user_medium": "traffic_source.medium",
        "first_user_campaign": "traffic_source.name",
        "items": "items",
        **p,
    }
    return raw.selectExpr(*[f"{cols[c]} AS {c}" for c in STG_COLUMNS])
