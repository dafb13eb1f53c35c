"""M-4 ``orders``: purchase events deduplicated by transaction key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelworks.functions import sql as S
from funnelworks.operators.sessions import TRANSACTION_KEY
from funnelworks.sources.schema import ORDER_COLUMNS


def orders(stg: DataFrame) -> DataFrame:
    """One row per transaction key: the earliest purchase event for the key.

    ``groupBy(key)`` with ``min(struct(ts, ...))``; the remaining columns are
    the tie-break. Map-side partial aggregation collapses duplicate
    purchases of a hot key before the shuffle.
    """
    pe = (stg.where(f"event_name = 'purchase' AND {TRANSACTION_KEY} IS NOT NULL")
          .selectExpr(f"{TRANSACTION_KEY} AS order_transaction_key", "event_timestamp_utc", "event_date_parsed",
                      "user_pseudo_id", "session_key",
                      "coalesce(ecommerce_purchase_revenue_in_usd, ecommerce_purchase_revenue, CAST(0 AS DOUBLE)) "
                      "AS order_revenue_usd",
                      "ecommerce_total_item_quantity AS total_item_quantity", "device_category", "country",
                      "first_user_source", "first_user_medium"))
    values = ["event_date_parsed", "user_pseudo_id", "session_key", "order_revenue_usd", "total_item_quantity",
              "device_category", "country", "first_user_source", "first_user_medium"]
    agg = pe.groupBy("order_transaction_key").agg(F.expr(f"{S.first_by(['event_timestamp_utc'], values)} AS f"))
    rename = {"order_timestamp": "_o0", "order_date": "event_date_parsed"}
    return agg.selectExpr("order_transaction_key", *[
        f"f.{rename.get(c, c)} AS {c}" for c in ORDER_COLUMNS if c != "order_transaction_key"])
