"""M-6 ``product_events``: one row per (item event, item), keeping events
whose item array is empty or NULL (left lateral unnest)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelworks.sources.schema import ITEM, PRODUCT_EVENT_COLUMNS

ITEM_EVENT_NAMES = (
    "view_item", "view_item_list", "select_item", "add_to_cart", "remove_from_cart",
    "begin_checkout", "add_shipping_info", "add_payment_info", "purchase",
)


def product_events(stg: DataFrame, event_names=ITEM_EVENT_NAMES) -> DataFrame:
    """Filter + ``explode_outer``: narrow, no shuffle."""
    base = ["event_timestamp_utc", "event_date_parsed", "event_name", "user_pseudo_id", "session_key",
            "device_category"]
    exploded = (stg.where(F.col("event_name").isin(*event_names))
                .select(*base, F.explode_outer("items").alias("item")))
    return exploded.select(*base, *[F.col(f"item.{f.name}").alias(f.name) for f in ITEM.fields]) \
        .select(*PRODUCT_EVENT_COLUMNS)
