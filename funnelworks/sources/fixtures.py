"""Adapters from the generated test tables to the reference's inputs (FIXTURES.md part B).

Pure column arithmetic on the given tables: every adapter is a narrow
projection (no shuffle), so it grows with its input like a real source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelworks.sources.schema import RAW_EVENT

# Fixed values of the fixture rules (FIXTURES.md F1).
EVENT_NAME_MAP = {
    "view": "view_item",
    "click": "add_to_cart",
    "signup": "begin_checkout",
    "error": "view_search_results",
    "purchase": "purchase",
}
ITEM_EVENTS = ("view_item", "add_to_cart", "begin_checkout", "purchase")
DEVICE_CATEGORIES = ("desktop", "mobile", "tablet")          # index 3 -> NULL
MEDIUMS = ("organic", "(none)", "cpc", "referral")            # index 4 -> NULL
SOURCES = ("google", "(direct)")                             # index 2 -> NULL
MAX_ITEMS = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _param_sql(key: str, kind: str, value: str, present: str) -> str:
    """SQL for a zero- or one-element array holding one event parameter."""
    typed = {k: "CAST(NULL AS {})".format("STRING" if k == "string_value" else "BIGINT" if k == "int_value"
                                          else "DOUBLE") for k in ("string_value", "int_value", "double_value",
                                                                   "float_value")}
    typed[kind] = f"CAST({value} AS {'STRING' if kind == 'string_value' else 'BIGINT'})"
    inner = ", ".join(f"'{k}', {v}" for k, v in typed.items())
    return (f"slice(array(named_struct('key', '{key}', 'value', named_struct({inner}))), 1, "
            f"IF(({present}) AND ({value}) IS NOT NULL, 1, 0))")


def _item_sql(j: int) -> str:
    ej = f"(e + {j})"
    k = f"((e * 7 + {j}) % 50)"
    price = f"CAST(1 + {ej} % 20 AS DOUBLE)"
    item = (f"named_struct('item_id', IF({ej} % 19 <> 0, concat('SKU', {k}), NULL), "
            f"'item_name', concat('Item ', {k}), 'item_brand', concat('Brand ', {k} % 5), "
            f"'item_category', concat('Category ', {k} % 4), "
            f"'item_category2', CAST(NULL AS STRING), 'item_category3', CAST(NULL AS STRING), "
            f"'price', {price}, 'price_in_usd', IF({ej} % 8 <> 0, {price}, NULL), "
            f"'quantity', IF({ej} % 6 <> 0, CAST(1 + {ej} % 3 AS BIGINT), NULL), "
            f"'item_revenue', CAST(NULL AS DOUBLE), "
            f"'item_revenue_in_usd', IF({ej} % 4 <> 0, {price} * (1 + {ej} % 3), NULL))")
    return f"slice(array({item}), 1, IF(e % 3 > {j}, 1, 0))"


def _case(expr: str, values: tuple[str, ...]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {expr} {whens} END"


def raw_events(events: DataFrame) -> DataFrame:
    """the ``events`` table as raw nested events (schema RAW_EVENT).

    Written as SQL expressions: two projections, compiled into the scan's
    whole-stage code (zero- or one-element arrays are concatenated instead
    of filtering with a lambda).
    """
    names = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_NAME_MAP.items())
    base = events.selectExpr(
        "event_id AS e", "user_id AS u", "value AS v",
        "date_format(CAST(ts AS TIMESTAMP), 'yyyyMMdd') AS day",
        "unix_micros(CAST(ts AS TIMESTAMP)) AS micros",
        f"IF(event_id % 9 = 0, 'page_view', CASE event_type {names} END) AS name",
    ).selectExpr("*", "concat(CAST(u AS STRING), '-', day) AS txn", "name = 'purchase' AS is_purchase")
    params = "concat(" + ", ".join([
        _param_sql("ga_session_id", "int_value", "CAST(day AS BIGINT)", "e % 20 <> 0"),
        _param_sql("page_location", "string_value", "concat('/p/', e % 50)", "TRUE"),
        _param_sql("search_term", "string_value", "concat('term', e % 10)", "name = 'view_search_results'"),
        _param_sql("transaction_id", "string_value", "txn", "is_purchase AND e % 11 <> 0"),
        _param_sql("engagement_time_msec", "int_value", "round(v * 1000)", "e % 3 <> 0"),
    ]) + ")"
    items = ("IF(name IN (" + ", ".join(f"'{n}'" for n in ITEM_EVENTS) + "), concat("
             + ", ".join(_item_sql(j) for j in range(MAX_ITEMS)) + "), NULL)")
    out = base.selectExpr(
        "day AS event_date",
        "micros AS event_timestamp",
        "name AS event_name",
        "CAST(u AS STRING) AS user_pseudo_id",
        f"{params} AS event_params",
        "named_struct('purchase_revenue', IF(is_purchase AND e % 17 <> 0, v, NULL), "
        "'purchase_revenue_in_usd', IF(is_purchase AND e % 7 <> 0, v, NULL), "
        "'transaction_id', IF(is_purchase AND e % 5 <> 0, txn, NULL), "
        "'total_item_quantity', IF(is_purchase, 1 + e % 3, NULL)) AS ecommerce",
        f"named_struct('category', IF(e % 29 = 0, 'unknown', {_case('(u + e) % 4', DEVICE_CATEGORIES)}), "
        "'operating_system', concat('os', e % 3), "
        "'web_info', named_struct('browser', concat('br', e % 4))) AS device",
        "named_struct('country', concat('C', u % 7), 'city', concat('T', u % 11), "
        "'continent', concat('K', u % 3), 'sub_continent', concat('S', u % 5)) AS geo",
        f"named_struct('source', {_case('u % 3', SOURCES)}, 'medium', {_case('u % 5', MEDIUMS)}, "
        "'name', concat('cmp', u % 4)) AS traffic_source",
        f"{items} AS items",
    )
    # Cast to the declared schema so adapters and real sources are interchangeable.
    return out.selectExpr(*[f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in RAW_EVENT.fields])


def raw_events_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_events(table(spark, sf_dir, "events"))


def retention_sessions(orders: DataFrame) -> DataFrame:
    """session-like rows (user, session_key, session_date) from ``orders``."""
    return orders.select(F.col("o_custkey").cast("string").alias("user_pseudo_id"),
                         F.col("o_orderkey").cast("string").alias("session_key"),
                         F.to_date(F.col("o_orderdate")).alias("session_date"))


def rfm_orders(orders: DataFrame) -> DataFrame:
    """order rows (int_orders columns used by RFM) from ``orders``."""
    return orders.select(
        F.col("o_orderkey").cast("string").alias("order_transaction_key"),
        F.to_date(F.col("o_orderdate")).alias("order_date"),
        F.col("o_custkey").cast("string").alias("user_pseudo_id"),
        F.col("o_totalprice").alias("order_revenue_usd"),
    )


def experiment_units(orders: DataFrame) -> DataFrame:
    """experiment unit table (schema EXPERIMENT_UNIT) from ``orders``."""
    k = F.col("o_orderkey")
    converted = F.col("o_orderpriority") == "1-URGENT"
    return orders.select(
        k.cast("string").alias("user_id"),
        F.when(F.col("o_custkey") % 2 == 0, F.lit("exp_a")).otherwise(F.lit("exp_b")).alias("experiment_id"),
        F.when(k % 2 == 0, F.lit("control")).otherwise(F.lit("treatment")).alias("variant"),
        F.col("o_orderdate").cast("timestamp").alias("assignment_timestamp"),
        F.lit(True).alias("is_eligible"),
        F.lit("mobile").alias("device_category"),
        converted.cast("int").alias("converted_purchase"),
        F.when(converted, F.col("o_totalprice")).otherwise(F.lit(0.0)).alias("revenue_usd"),
        (F.col("o_orderstatus") == "P").cast("int").alias("payment_error"),
        ((F.col("o_orderstatus") == "F") & (k % 50 == 0)).cast("int").alias("refund_or_cancelled"),
        (20 + k % 200).cast("double").alias("checkout_duration_seconds"),
    )


def experiment_events(events: DataFrame, experiment_id: str = "exp_checkout",
                      exposure_event: str = "experiment_impression") -> DataFrame:
    """experiment event stream (exposures and outcomes) from ``events``.

    Exposure = each user's first ``view`` (skipped when u%10=0, a missing
    exposure); variant by u%2; a second exposure with the other variant when
    u%15=0 (contamination). Outcomes: purchase -> purchase and, at the same time, checkout_completed
    (20 + e%200 seconds); purchases with e%13=0 are refunded a second later; error -> payment_error.
    The first view per user is found with one groupBy (min of a struct).
    """
    u = F.col("user_id")
    ts = F.col("ts").cast("timestamp")
    first_view = (events.where(F.col("event_type") == "view")
                  .groupBy("user_id")
                  .agg(F.min(F.struct(ts.alias("t"), F.col("event_id").alias("e"))).alias("f"))
                  .where(F.col("user_id") % 10 != 0))
    variant = F.when(u % 2 == 0, F.lit("control")).otherwise(F.lit("treatment"))
    other = F.when(u % 2 == 0, F.lit("treatment")).otherwise(F.lit("control"))
    exp_cols = lambda v, extra_us: [
        F.lit(exposure_event).alias("event_name"), F.lit(experiment_id).alias("experiment_id"),
        v.alias("variant"), u.cast("string").alias("user_pseudo_id"),
        (F.unix_micros(F.col("f.t")) + F.lit(extra_us)).alias("event_timestamp"),
        F.lit(None).cast("string").alias("transaction_id"), F.lit(None).cast("double").alias("revenue_usd"),
        F.lit(None).cast("double").alias("checkout_duration_seconds"),
    ]
    exposures = first_view.select(*exp_cols(variant, 0))
    second = first_view.where(u % 15 == 0).select(*exp_cols(other, 1))
    e, bought = F.col("event_id"), F.col("event_type") == "purchase"
    kinds = F.filter(F.array(
        F.when(bought, F.lit("purchase")).otherwise(F.lit("payment_error")),
        F.when(bought, F.lit("checkout_completed")),
        F.when(bought & (e % 13 == 0), F.lit("refund_or_cancelled"))), lambda x: x.isNotNull())
    outcomes = events.where(F.col("event_type").isin("purchase", "error")).withColumn("kind", F.explode(kinds))
    kind = F.col("kind")
    outcomes = outcomes.select(
        kind.alias("event_name"), F.lit(experiment_id).alias("experiment_id"), F.lit(None).cast("string").alias("variant"),
        u.cast("string").alias("user_pseudo_id"),
        (F.unix_micros(ts) + F.when(kind == "refund_or_cancelled", F.lit(1_000_000)).otherwise(F.lit(0))).alias("event_timestamp"),
        F.when(bought, F.concat(F.lit("t"), e.cast("string"))).alias("transaction_id"),
        F.when(kind == "purchase", F.col("value")).alias("revenue_usd"),
        F.when(kind == "checkout_completed", (20 + e % 200).cast("double")).alias("checkout_duration_seconds"))
    return exposures.unionByName(second).unionByName(outcomes)
