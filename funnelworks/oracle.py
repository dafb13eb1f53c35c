"""DuckDB SQL oracles for the driver's correctness check.

Written independently of the Spark code: the fixture rules of FIXTURES.md
are applied directly in flat SQL (no nested records), and each model is the
reference's SQL semantics in plain ANSI SQL with the same added tie-breaks
and exact money sums (integer micro-units) as the Spark side.
"""

from __future__ import annotations

MICRO = "1000000"

# Fixed values, written out here so that a wrong one in the code is noticed.
REQUIRED_EVENTS = ("page_view", "view_item", "add_to_cart", "begin_checkout", "purchase", "view_search_results")
NOT_NULL = {
    "stg_ga4_events": ["user_pseudo_id"], "int_sessions": ["session_key", "user_pseudo_id", "session_date"],
    "int_users": ["user_pseudo_id", "first_seen_date"], "int_orders": ["order_transaction_key", "user_pseudo_id"],
    "int_session_funnel": ["session_key"], "mart_product_kpis_daily": ["report_date"],
    "mart_funnel_performance": ["report_date"], "mart_retention_cohorts": ["cohort_week"],
    "mart_customer_rfm": ["user_pseudo_id"], "mart_segment_performance": ["segment_type"],
    "mart_product_performance": ["item_id"],
}
UNIQUE = {"int_sessions": "session_key", "int_users": "user_pseudo_id", "int_orders": "order_transaction_key",
          "int_session_funnel": "session_key", "mart_product_kpis_daily": "report_date",
          "mart_customer_rfm": "user_pseudo_id", "mart_product_performance": "item_id"}
ACCEPTED = {
    ("mart_customer_rfm", "rfm_segment"): ["Champions", "Loyal Customers", "Potential Loyalists", "Recent Customers",
                                           "At Risk", "Occasional Customers"],
    ("mart_segment_performance", "segment_type"): ["device_category", "acquisition_medium", "search_adoption",
                                                   "purchaser_status"],
}
SCHEMA_TESTS = ([(m, c, "not_null", None) for m, cols in NOT_NULL.items() for c in cols]
                + [(m, c, "unique", None) for m, c in UNIQUE.items()]
                + [(m, c, "accepted_values", v) for (m, c), v in ACCEPTED.items()])
Z_ALPHA = 1.9599639845400536    # standard normal quantile at 0.975
Z_POWER = 0.8416212335729144    # and at 0.8
MIN_PRACTICAL_LIFT = 0.005
DECISION_REASONS = {
    "Ship": "Primary metric significantly improved beyond MDE. Guardrails hold.",
    "Iterate": "Conversion improved, but guardrails were harmed. Iterate on the design.",
    "Stop": "Treatment significantly harmed conversion.",
    "Inconclusive": "Insufficient evidence to ship. Consider running longer if business case warrants.",
}


def msum(x: str) -> str:
    """Exact money sum, same value as funnelworks.functions.metrics.money_sum."""
    return f"(CAST(SUM(CAST(ROUND(({x}) * {MICRO}) AS BIGINT)) AS DOUBLE) / {MICRO}.0)"


def sdiv(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


# F1 as a flat staging table (stg) and its item rows (items_x).
STG = """
ev AS (
  SELECT event_id AS e, user_id AS u, value AS v, event_type, ts,
         strftime(ts, '%Y%m%d') AS day,
         CASE WHEN event_id % 9 = 0 THEN 'page_view'
              WHEN event_type = 'view' THEN 'view_item'
              WHEN event_type = 'click' THEN 'add_to_cart'
              WHEN event_type = 'signup' THEN 'begin_checkout'
              WHEN event_type = 'error' THEN 'view_search_results'
              WHEN event_type = 'purchase' THEN 'purchase' END AS name
  FROM events
),
stg AS (
  SELECT
    e, u, v,
    day AS event_date,
    epoch_us(ts) AS event_timestamp,
    ts AS event_timestamp_utc,
    CAST(ts AS DATE) AS event_date_parsed,
    name AS event_name,
    CAST(u AS VARCHAR) AS user_pseudo_id,
    CASE WHEN e % 20 <> 0 THEN CAST(day AS BIGINT) END AS ga_session_id,
    CASE WHEN e % 20 <> 0 THEN CAST(u AS VARCHAR) || '-' || day END AS session_key,
    CAST(NULL AS BIGINT) AS ga_session_number,
    '/p/' || CAST(e % 50 AS VARCHAR) AS page_location,
    CAST(NULL AS VARCHAR) AS page_title,
    CAST(NULL AS VARCHAR) AS page_referrer,
    CASE WHEN name = 'view_search_results' THEN 'term' || CAST(e % 10 AS VARCHAR) END AS search_term,
    CASE WHEN name = 'purchase' AND e % 11 <> 0 THEN CAST(u AS VARCHAR) || '-' || day END AS transaction_id,
    CASE WHEN name = 'purchase' AND e % 17 <> 0 THEN v END AS ecommerce_purchase_revenue,
    CASE WHEN name = 'purchase' AND e % 7 <> 0 THEN v END AS ecommerce_purchase_revenue_in_usd,
    CASE WHEN name = 'purchase' AND e % 5 <> 0 THEN CAST(u AS VARCHAR) || '-' || day END AS ecommerce_transaction_id,
    CASE WHEN name = 'purchase' THEN 1 + e % 3 END AS ecommerce_total_item_quantity,
    CASE WHEN e % 29 = 0 THEN 'unknown' ELSE CASE (u + e) % 4 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobile' WHEN 2 THEN 'tablet' END END AS device_category,
    'os' || CAST(e % 3 AS VARCHAR) AS operating_system,
    'br' || CAST(e % 4 AS VARCHAR) AS browser,
    'C' || CAST(u % 7 AS VARCHAR) AS country,
    'T' || CAST(u % 11 AS VARCHAR) AS city,
    'K' || CAST(u % 3 AS VARCHAR) AS continent,
    'S' || CAST(u % 5 AS VARCHAR) AS sub_continent,
    CASE u % 3 WHEN 0 THEN 'google' WHEN 1 THEN '(direct)' END AS first_user_source,
    CASE u % 5 WHEN 0 THEN 'organic' WHEN 1 THEN '(none)' WHEN 2 THEN 'cpc' WHEN 3 THEN 'referral' END
      AS first_user_medium,
    'cmp' || CAST(u % 4 AS VARCHAR) AS first_user_campaign,
    CASE WHEN e % 3 <> 0 THEN CAST(ROUND(v * 1000) AS BIGINT) END AS engagement_time_msec,
    CAST(NULL AS BIGINT) AS engaged_session_event
  FROM ev
),
items_x AS (
  SELECT s.*, r.j,
    CASE WHEN r.j IS NOT NULL AND (s.e + r.j) % 19 <> 0 THEN 'SKU' || CAST((s.e * 7 + r.j) % 50 AS VARCHAR) END AS item_id,
    CASE WHEN r.j IS NOT NULL THEN 'Item ' || CAST((s.e * 7 + r.j) % 50 AS VARCHAR) END AS item_name,
    CASE WHEN r.j IS NOT NULL THEN 'Brand ' || CAST(((s.e * 7 + r.j) % 50) % 5 AS VARCHAR) END AS item_brand,
    CASE WHEN r.j IS NOT NULL THEN 'Category ' || CAST(((s.e * 7 + r.j) % 50) % 4 AS VARCHAR) END AS item_category,
    CAST(NULL AS VARCHAR) AS item_category2,
    CAST(NULL AS VARCHAR) AS item_category3,
    CAST(1 + (s.e + r.j) % 20 AS DOUBLE) AS price,
    CASE WHEN (s.e + r.j) % 8 <> 0 THEN CAST(1 + (s.e + r.j) % 20 AS DOUBLE) END AS price_in_usd,
    CASE WHEN (s.e + r.j) % 6 <> 0 THEN CAST(1 + (s.e + r.j) % 3 AS BIGINT) END AS quantity,
    CAST(NULL AS DOUBLE) AS item_revenue,
    CASE WHEN (s.e + r.j) % 4 <> 0 THEN CAST(1 + (s.e + r.j) % 20 AS DOUBLE) * (1 + (s.e + r.j) % 3) END
      AS item_revenue_in_usd
  FROM stg s
  LEFT JOIN (SELECT range AS j FROM range(0, 3)) r ON r.j < s.e % 3
  WHERE s.event_name IN ('view_item', 'view_item_list', 'select_item', 'add_to_cart', 'remove_from_cart',
                         'begin_checkout', 'add_shipping_info', 'add_payment_info', 'purchase')
)"""

STG_SCALAR_COLS = (
    "event_date, event_timestamp, event_timestamp_utc, event_date_parsed, event_name, user_pseudo_id, "
    "ga_session_id, session_key, ga_session_number, page_location, page_title, page_referrer, search_term, "
    "transaction_id, ecommerce_purchase_revenue, ecommerce_purchase_revenue_in_usd, ecommerce_transaction_id, "
    "ecommerce_total_item_quantity, device_category, operating_system, browser, country, city, continent, "
    "sub_continent, first_user_source, first_user_medium, first_user_campaign, engagement_time_msec, "
    "engaged_session_event")

SESSIONS = f"""
sess_ev AS (SELECT * FROM stg WHERE session_key IS NOT NULL),
sess_first AS (
  SELECT * FROM (
    SELECT session_key, device_category, operating_system, browser, country, city, first_user_source,
           first_user_medium, first_user_campaign, page_location AS landing_page,
           ROW_NUMBER() OVER (PARTITION BY session_key ORDER BY event_timestamp_utc,
             device_category NULLS FIRST, operating_system NULLS FIRST, browser NULLS FIRST,
             country NULLS FIRST, city NULLS FIRST, first_user_source NULLS FIRST,
             first_user_medium NULLS FIRST, first_user_campaign NULLS FIRST, page_location NULLS FIRST) AS rn
    FROM sess_ev) WHERE rn = 1
),
sess_agg AS (
  SELECT session_key,
    MIN(event_timestamp_utc) AS session_start_timestamp,
    MAX(event_timestamp_utc) AS session_end_timestamp,
    MIN(event_date_parsed) AS session_date,
    MIN(user_pseudo_id) AS user_pseudo_id,
    COUNT(*) AS event_count,
    MAX(CASE WHEN event_name = 'page_view' THEN 1 ELSE 0 END) = 1 AS has_page_view,
    MAX(CASE WHEN event_name = 'view_item' THEN 1 ELSE 0 END) = 1 AS has_view_item,
    MAX(CASE WHEN event_name = 'add_to_cart' THEN 1 ELSE 0 END) = 1 AS has_add_to_cart,
    MAX(CASE WHEN event_name = 'begin_checkout' THEN 1 ELSE 0 END) = 1 AS has_begin_checkout,
    MAX(CASE WHEN event_name = 'purchase' THEN 1 ELSE 0 END) = 1 AS has_purchase,
    MAX(CASE WHEN event_name = 'view_search_results' THEN 1 ELSE 0 END) = 1 AS has_search,
    COALESCE({msum("CASE WHEN event_name = 'purchase' THEN ecommerce_purchase_revenue_in_usd END")}, 0.0)
      AS session_revenue_usd,
    COUNT(DISTINCT CASE WHEN event_name = 'purchase'
                        THEN COALESCE(ecommerce_transaction_id, transaction_id) END) AS transaction_count,
    CAST(SUM(COALESCE(engagement_time_msec, 0)) AS BIGINT) AS total_engagement_time_msec
  FROM sess_ev GROUP BY session_key
),
sessions AS (
  SELECT a.session_key, a.session_start_timestamp, a.session_end_timestamp, a.session_date, a.user_pseudo_id,
    f.device_category, f.operating_system, f.browser, f.country, f.city, f.first_user_source,
    f.first_user_medium, f.first_user_campaign, f.landing_page, a.event_count, a.has_page_view,
    a.has_view_item, a.has_add_to_cart, a.has_begin_checkout, a.has_purchase, a.has_search,
    a.session_revenue_usd, a.transaction_count, a.total_engagement_time_msec
  FROM sess_agg a LEFT JOIN sess_first f ON a.session_key = f.session_key
)"""

FUNNEL = """
funnel_t AS (
  SELECT session_key, user_pseudo_id,
    MIN(event_timestamp_utc) AS session_start_time,
    MIN(CASE WHEN event_name = 'view_item' THEN event_timestamp_utc END) AS first_view_item_time,
    MIN(CASE WHEN event_name = 'add_to_cart' THEN event_timestamp_utc END) AS first_add_to_cart_time,
    MIN(CASE WHEN event_name = 'begin_checkout' THEN event_timestamp_utc END) AS first_begin_checkout_time,
    MIN(CASE WHEN event_name = 'purchase' THEN event_timestamp_utc END) AS first_purchase_time
  FROM stg WHERE session_key IS NOT NULL GROUP BY session_key, user_pseudo_id
),
funnel AS (
  SELECT *, TRUE AS reached_session,
    first_view_item_time IS NOT NULL AS reached_view_item,
    (first_add_to_cart_time IS NOT NULL AND first_view_item_time IS NOT NULL
      AND first_add_to_cart_time >= first_view_item_time) AS reached_add_to_cart_after_view,
    (first_begin_checkout_time IS NOT NULL AND first_add_to_cart_time IS NOT NULL
      AND first_view_item_time IS NOT NULL AND first_add_to_cart_time >= first_view_item_time
      AND first_begin_checkout_time >= first_add_to_cart_time) AS reached_begin_checkout_after_cart,
    (first_purchase_time IS NOT NULL AND first_begin_checkout_time IS NOT NULL
      AND first_add_to_cart_time IS NOT NULL AND first_view_item_time IS NOT NULL
      AND first_add_to_cart_time >= first_view_item_time
      AND first_begin_checkout_time >= first_add_to_cart_time
      AND first_purchase_time >= first_begin_checkout_time) AS reached_purchase_after_checkout
  FROM funnel_t
)"""

FUNNEL_MART = f"""
funnel_mart AS (
  SELECT s.session_date AS report_date,
    COALESCE(s.device_category, 'unknown') AS device_category,
    COUNT(DISTINCT CASE WHEN f.reached_session THEN f.session_key END) AS sessions_entered,
    COUNT(DISTINCT CASE WHEN f.reached_view_item THEN f.session_key END) AS sessions_product_view,
    COUNT(DISTINCT CASE WHEN f.reached_add_to_cart_after_view THEN f.session_key END) AS sessions_add_to_cart,
    COUNT(DISTINCT CASE WHEN f.reached_begin_checkout_after_cart THEN f.session_key END) AS sessions_begin_checkout,
    COUNT(DISTINCT CASE WHEN f.reached_purchase_after_checkout THEN f.session_key END) AS sessions_purchase
  FROM funnel f JOIN sessions s ON f.session_key = s.session_key
  GROUP BY s.session_date, COALESCE(s.device_category, 'unknown')
),
funnel_perf AS (
  SELECT report_date, device_category, sessions_entered, sessions_product_view, sessions_add_to_cart,
    sessions_begin_checkout, sessions_purchase,
    {sdiv("sessions_product_view", "sessions_entered")} AS rate_session_to_view,
    {sdiv("sessions_add_to_cart", "sessions_product_view")} AS rate_view_to_cart,
    {sdiv("sessions_begin_checkout", "sessions_add_to_cart")} AS rate_cart_to_checkout,
    {sdiv("sessions_purchase", "sessions_begin_checkout")} AS rate_checkout_to_purchase,
    {sdiv("sessions_purchase", "sessions_entered")} AS overall_conversion_rate
  FROM funnel_mart
)"""


USERS = f"""
users_agg AS (
  SELECT user_pseudo_id, MIN(session_date) AS first_seen_date, MAX(session_date) AS last_seen_date,
    COUNT(DISTINCT session_key) AS session_count,
    COUNT(DISTINCT CASE WHEN has_purchase THEN session_key END) AS purchase_session_count,
    CAST(SUM(transaction_count) AS BIGINT) AS order_count,
    {msum("session_revenue_usd")} AS total_revenue_usd,
    MAX(CASE WHEN has_purchase THEN 1 ELSE 0 END) = 1 AS is_purchaser,
    MAX(CASE WHEN has_search THEN 1 ELSE 0 END) = 1 AS has_ever_searched
  FROM sessions GROUP BY user_pseudo_id
),
users_first AS (
  SELECT * FROM (
    SELECT user_pseudo_id, device_category AS first_device_category, first_user_source, first_user_medium,
      first_user_campaign,
      ROW_NUMBER() OVER (PARTITION BY user_pseudo_id ORDER BY session_start_timestamp, session_key) AS rn
    FROM sessions) WHERE rn = 1
),
users AS (
  SELECT a.*, f.first_device_category, f.first_user_source, f.first_user_medium, f.first_user_campaign
  FROM users_agg a LEFT JOIN users_first f ON a.user_pseudo_id = f.user_pseudo_id
)"""

ORDERS = """
orders_m AS (
  SELECT order_transaction_key, order_timestamp, order_date, user_pseudo_id, session_key, order_revenue_usd,
         total_item_quantity, device_category, country, first_user_source, first_user_medium
  FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY order_transaction_key ORDER BY order_timestamp,
        order_date NULLS FIRST, user_pseudo_id NULLS FIRST, session_key NULLS FIRST,
        order_revenue_usd NULLS FIRST, total_item_quantity NULLS FIRST, device_category NULLS FIRST,
        country NULLS FIRST, first_user_source NULLS FIRST, first_user_medium NULLS FIRST) AS rn
    FROM (
      SELECT COALESCE(ecommerce_transaction_id, transaction_id) AS order_transaction_key,
        event_timestamp_utc AS order_timestamp, event_date_parsed AS order_date, user_pseudo_id, session_key,
        COALESCE(ecommerce_purchase_revenue_in_usd, ecommerce_purchase_revenue, 0.0) AS order_revenue_usd,
        ecommerce_total_item_quantity AS total_item_quantity, device_category, country, first_user_source,
        first_user_medium
      FROM stg
      WHERE event_name = 'purchase' AND COALESCE(ecommerce_transaction_id, transaction_id) IS NOT NULL))
  WHERE rn = 1
)"""

PRODUCT_EVENTS = """
product_events AS (
  SELECT event_timestamp_utc, event_date_parsed, event_name, user_pseudo_id, session_key, device_category,
    item_id, item_name, item_brand, item_category, item_category2, item_category3, price, price_in_usd,
    quantity, item_revenue, item_revenue_in_usd
  FROM items_x
)"""

KPIS = f"""
daily_sessions AS (
  SELECT session_date,
    COUNT(DISTINCT user_pseudo_id) AS daily_active_users,
    COUNT(DISTINCT session_key) AS total_sessions,
    COUNT(DISTINCT CASE WHEN has_view_item THEN session_key END) AS sessions_with_product_view,
    COUNT(DISTINCT CASE WHEN has_add_to_cart THEN session_key END) AS sessions_with_add_to_cart,
    COUNT(DISTINCT CASE WHEN has_begin_checkout THEN session_key END) AS sessions_with_checkout,
    COUNT(DISTINCT CASE WHEN has_purchase THEN session_key END) AS sessions_with_purchase,
    COUNT(DISTINCT CASE WHEN has_search THEN session_key END) AS sessions_with_search,
    COUNT(DISTINCT CASE WHEN has_purchase THEN user_pseudo_id END) AS daily_purchasers
  FROM sessions GROUP BY session_date
),
daily_orders AS (
  SELECT order_date, COUNT(DISTINCT order_transaction_key) AS total_orders,
    {msum("order_revenue_usd")} AS total_revenue_usd
  FROM orders_m GROUP BY order_date
),
kpis AS (
  SELECT ds.session_date AS report_date, ds.daily_active_users, ds.total_sessions, ds.daily_purchasers,
    COALESCE(o.total_orders, 0) AS total_orders, COALESCE(o.total_revenue_usd, 0.0) AS total_revenue_usd,
    ds.sessions_with_product_view, ds.sessions_with_add_to_cart, ds.sessions_with_checkout,
    ds.sessions_with_purchase, ds.sessions_with_search,
    {sdiv("ds.daily_purchasers", "ds.daily_active_users")} AS user_conversion_rate,
    {sdiv("ds.sessions_with_purchase", "ds.total_sessions")} AS session_conversion_rate,
    {sdiv("COALESCE(o.total_revenue_usd, 0.0)", "COALESCE(o.total_orders, 0)")} AS avg_order_value_usd,
    {sdiv("COALESCE(o.total_revenue_usd, 0.0)", "ds.total_sessions")} AS revenue_per_session_usd,
    {sdiv("ds.sessions_with_product_view", "ds.total_sessions")} AS product_view_rate,
    {sdiv("ds.sessions_with_add_to_cart", "ds.sessions_with_product_view")} AS view_to_cart_rate,
    {sdiv("ds.sessions_with_checkout", "ds.sessions_with_add_to_cart")} AS cart_to_checkout_rate,
    {sdiv("ds.sessions_with_purchase", "ds.sessions_with_checkout")} AS checkout_to_purchase_rate,
    {sdiv("ds.sessions_with_search", "ds.total_sessions")} AS search_adoption_rate
  FROM daily_sessions ds LEFT JOIN daily_orders o ON ds.session_date = o.order_date
)"""


def _segment_block(seg_type: str, label: str, group: str) -> str:
    return f"""
  SELECT '{seg_type}' AS segment_type, {label} AS segment_value,
    COUNT(DISTINCT user_pseudo_id) AS unique_users,
    COUNT(DISTINCT session_key) AS total_sessions,
    COUNT(DISTINCT CASE WHEN has_purchase THEN session_key END) AS purchase_sessions,
    COUNT(DISTINCT CASE WHEN has_purchase THEN user_pseudo_id END) AS purchasers,
    {msum("session_revenue_usd")} AS total_revenue_usd,
    CAST(SUM(transaction_count) AS BIGINT) AS total_orders,
    {sdiv("COUNT(DISTINCT CASE WHEN has_purchase THEN session_key END)", "COUNT(DISTINCT session_key)")}
      AS session_conversion_rate,
    {sdiv(msum("session_revenue_usd"), "COUNT(DISTINCT session_key)")} AS revenue_per_session_usd,
    {sdiv(msum("session_revenue_usd"), "SUM(transaction_count)")} AS avg_order_value_usd
  FROM sessions GROUP BY {group}"""


SEGMENTS = f"""
segments AS (
  {_segment_block("device_category", "COALESCE(device_category, 'unknown')", "device_category")}
  UNION ALL
  {_segment_block("acquisition_medium", "COALESCE(first_user_medium, '(none)')", "first_user_medium")}
  UNION ALL
  {_segment_block("search_adoption",
                  "CASE WHEN has_search THEN 'search_session' ELSE 'non_search_session' END", "has_search")}
  UNION ALL
  SELECT 'purchaser_status' AS segment_type,
    CASE WHEN is_purchaser THEN 'purchaser' ELSE 'non_purchaser' END AS segment_value,
    COUNT(DISTINCT user_pseudo_id) AS unique_users,
    CAST(SUM(session_count) AS BIGINT) AS total_sessions,
    CAST(SUM(purchase_session_count) AS BIGINT) AS purchase_sessions,
    CAST(SUM(CASE WHEN is_purchaser THEN 1 ELSE 0 END) AS BIGINT) AS purchasers,
    {msum("total_revenue_usd")} AS total_revenue_usd,
    CAST(SUM(order_count) AS BIGINT) AS total_orders,
    {sdiv("SUM(purchase_session_count)", "SUM(session_count)")} AS session_conversion_rate,
    {sdiv(msum("total_revenue_usd"), "SUM(session_count)")} AS revenue_per_session_usd,
    {sdiv(msum("total_revenue_usd"), "SUM(order_count)")} AS avg_order_value_usd
  FROM users GROUP BY is_purchaser
)"""

PRODUCTS = f"""
product_perf AS (
  SELECT item_id, MIN(item_name) AS item_name, MIN(item_brand) AS item_brand,
    MIN(item_category) AS item_category, COUNT(*) AS purchase_event_count,
    CAST(SUM(COALESCE(quantity, 1)) AS BIGINT) AS total_units_sold,
    COUNT(DISTINCT user_pseudo_id) AS unique_purchasers,
    COUNT(DISTINCT session_key) AS purchase_sessions,
    {msum("COALESCE(item_revenue_in_usd, item_revenue, price_in_usd, price, 0.0)")} AS total_item_revenue_usd,
    {sdiv(msum("COALESCE(item_revenue_in_usd, item_revenue, price_in_usd, price, 0.0)"),
          "SUM(COALESCE(quantity, 1))")} AS avg_revenue_per_unit_usd,
    MIN(event_date_parsed) AS first_purchase_date, MAX(event_date_parsed) AS last_purchase_date
  FROM items_x WHERE event_name = 'purchase' AND item_id IS NOT NULL
  GROUP BY item_id
)"""

# session-like rows from orders (retention).
F2 = """
f2 AS (
  SELECT CAST(o_custkey AS VARCHAR) AS user_pseudo_id, CAST(o_orderkey AS VARCHAR) AS session_key,
         CAST(o_orderdate AS DATE) AS session_date
  FROM orders
)"""

RETENTION = f"""
ufw AS (
  SELECT user_pseudo_id, CAST(date_trunc('week', MIN(session_date)) AS DATE) AS cohort_week
  FROM f2 GROUP BY user_pseudo_id
),
uaw AS (SELECT DISTINCT user_pseudo_id, CAST(date_trunc('week', session_date) AS DATE) AS activity_week FROM f2),
ca AS (
  SELECT ufw.cohort_week, uaw.activity_week,
    CAST(date_diff('day', ufw.cohort_week, uaw.activity_week) // 7 AS BIGINT) AS activity_week_index,
    COUNT(DISTINCT uaw.user_pseudo_id) AS retained_users
  FROM ufw JOIN uaw ON ufw.user_pseudo_id = uaw.user_pseudo_id
  GROUP BY ufw.cohort_week, uaw.activity_week
),
cs AS (SELECT cohort_week, COUNT(DISTINCT user_pseudo_id) AS cohort_size FROM ufw GROUP BY cohort_week),
retention AS (
  SELECT ca.cohort_week, ca.activity_week, ca.activity_week_index, cs.cohort_size, ca.retained_users,
    {sdiv("ca.retained_users", "cs.cohort_size")} AS retention_rate
  FROM ca JOIN cs ON ca.cohort_week = cs.cohort_week
  WHERE ca.activity_week_index >= 0
)"""

# orders for RFM.
F3 = """
f3 AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_transaction_key, CAST(o_orderdate AS DATE) AS order_date,
         CAST(o_custkey AS VARCHAR) AS user_pseudo_id, o_totalprice AS order_revenue_usd
  FROM orders
)"""

RFM = f"""
pm AS (
  SELECT user_pseudo_id, COUNT(DISTINCT order_transaction_key) AS frequency,
    {msum("order_revenue_usd")} AS monetary_value_usd,
    MAX(order_date) AS last_order_date, MIN(order_date) AS first_order_date
  FROM f3 GROUP BY user_pseudo_id
),
rd AS (SELECT MAX(order_date) AS ref_date FROM f3),
rc AS (SELECT pm.*, rd.ref_date, date_diff('day', pm.last_order_date, rd.ref_date) AS recency_days
       FROM pm CROSS JOIN rd),
sc AS (
  SELECT *,
    ntile(5) OVER (ORDER BY recency_days DESC, user_pseudo_id) AS r_score,
    ntile(5) OVER (ORDER BY frequency, user_pseudo_id) AS f_score,
    ntile(5) OVER (ORDER BY monetary_value_usd, user_pseudo_id) AS m_score
  FROM rc
),
rfm AS (
  SELECT user_pseudo_id, CAST(recency_days AS BIGINT) AS recency_days, frequency, monetary_value_usd,
    first_order_date, last_order_date, ref_date AS analysis_reference_date,
    CAST(r_score AS BIGINT) AS r_score, CAST(f_score AS BIGINT) AS f_score, CAST(m_score AS BIGINT) AS m_score,
    CASE WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN 'Champions'
         WHEN f_score >= 4 AND r_score >= 3 THEN 'Loyal Customers'
         WHEN r_score >= 4 AND f_score >= 2 AND f_score <= 3 THEN 'Potential Loyalists'
         WHEN r_score >= 4 AND f_score = 1 THEN 'Recent Customers'
         WHEN r_score <= 2 AND f_score >= 3 THEN 'At Risk'
         ELSE 'Occasional Customers' END AS rfm_segment
  FROM sc
)"""


FUNNEL_SUMS = """
fsum AS (
  SELECT CAST(COALESCE(SUM(sessions_entered), 0) AS BIGINT) AS se,
         CAST(COALESCE(SUM(sessions_product_view), 0) AS BIGINT) AS spv,
         CAST(COALESCE(SUM(sessions_add_to_cart), 0) AS BIGINT) AS sac,
         CAST(COALESCE(SUM(sessions_begin_checkout), 0) AS BIGINT) AS sbc,
         CAST(COALESCE(SUM(sessions_purchase), 0) AS BIGINT) AS sp
  FROM funnel_perf
)"""

CURVE_ALL = f"""
curve_all AS (
  SELECT activity_week_index, CAST(SUM(retained_users) AS BIGINT) AS total_retained,
    CAST(SUM(cohort_size) AS BIGINT) AS total_cohort_size,
    {sdiv("SUM(retained_users)", "SUM(cohort_size)")} AS avg_retention_rate
  FROM retention GROUP BY activity_week_index
)"""

CONCENTRATION = """
conc AS (
  SELECT user_pseudo_id, monetary_value_usd,
    ROW_NUMBER() OVER (ORDER BY monetary_value_usd DESC, user_pseudo_id) AS customer_rank,
    CAST(SUM(CAST(ROUND(monetary_value_usd * 1000000) AS BIGINT)) OVER (
      ORDER BY monetary_value_usd DESC, user_pseudo_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
      AS DOUBLE) / 1000000.0 AS cumulative_revenue,
    CAST(SUM(CAST(ROUND(monetary_value_usd * 1000000) AS BIGINT)) OVER () AS DOUBLE) / 1000000.0 AS total,
    COUNT(*) OVER () AS n
  FROM rfm WHERE monetary_value_usd > 0
)"""


def _pct(new: str, base: str) -> str:
    return f"(CASE WHEN {base} > 0 THEN ({new} - {base}) / {base} * 100.0 ELSE 0.0 END)"


def _roz(a: str, b: str) -> str:
    return f"(CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0.0 END)"


def _wow_body() -> str:
    def s(cond, c):
        return f"CAST(COALESCE(SUM(CASE WHEN {cond} THEN {c} END), 0) AS DOUBLE)"

    def m(cond, c):
        return f"COALESCE({msum(f'CASE WHEN {cond} THEN {c} END')}, 0.0)"
    last = "report_date > mx - 7"
    prev = "report_date <= mx - 7 AND report_date > mx - 14"
    rev = _pct("l7_revenue_usd", "p7_revenue_usd")
    return f"""
wow_a AS (
  SELECT {s(last, "total_sessions")} AS l7_sessions, {s(prev, "total_sessions")} AS p7_sessions,
         {s(last, "total_orders")} AS l7_orders, {s(prev, "total_orders")} AS p7_orders,
         {m(last, "total_revenue_usd")} AS l7_revenue_usd, {m(prev, "total_revenue_usd")} AS p7_revenue_usd
  FROM kpis CROSS JOIN (SELECT MAX(report_date) AS mx FROM kpis)
),
wow AS (
  SELECT *, {_pct("l7_sessions", "p7_sessions")} AS session_delta_pct,
    {_pct("l7_orders", "p7_orders")} AS order_delta_pct,
    {rev} AS revenue_delta_pct,
    ({_roz("l7_orders", "l7_sessions")} - {_roz("p7_orders", "p7_sessions")}) * 100.0 AS cvr_delta_pp,
    {_pct(_roz("l7_revenue_usd", "l7_orders"), _roz("p7_revenue_usd", "p7_orders"))} AS aov_delta_pct,
    CASE WHEN {rev} > 5.0 THEN 'growth' WHEN {rev} < -5.0 THEN 'contraction' ELSE 'stable' END AS trend
  FROM wow_a
)"""


F4 = """
f4 AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS user_id,
    CASE WHEN o_custkey % 2 = 0 THEN 'exp_a' ELSE 'exp_b' END AS experiment_id,
    CASE WHEN o_orderkey % 2 = 0 THEN 'control' ELSE 'treatment' END AS variant,
    o_orderdate AS assignment_timestamp, TRUE AS is_eligible, 'mobile' AS device_category,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS converted_purchase,
    CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice ELSE 0.0 END AS revenue_usd,
    CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS payment_error,
    CASE WHEN o_orderstatus = 'F' AND o_orderkey % 50 = 0 THEN 1 ELSE 0 END AS refund_or_cancelled,
    CAST(20 + o_orderkey % 200 AS DOUBLE) AS checkout_duration_seconds
  FROM orders
)"""

F5 = """
fv AS (SELECT user_id, MIN(ts) AS t FROM events WHERE event_type = 'view' GROUP BY user_id HAVING user_id % 10 <> 0),
f5 AS (
  SELECT 'experiment_impression' AS event_name, 'exp_checkout' AS experiment_id,
    CASE WHEN user_id % 2 = 0 THEN 'control' ELSE 'treatment' END AS variant,
    CAST(user_id AS VARCHAR) AS user_pseudo_id, epoch_us(t) AS event_timestamp,
    CAST(NULL AS VARCHAR) AS transaction_id, CAST(NULL AS DOUBLE) AS revenue_usd, CAST(NULL AS DOUBLE) AS duration
  FROM fv
  UNION ALL
  SELECT 'experiment_impression', 'exp_checkout', CASE WHEN user_id % 2 = 0 THEN 'treatment' ELSE 'control' END,
    CAST(user_id AS VARCHAR), epoch_us(t) + 1, CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE), NULL
  FROM fv WHERE user_id % 15 = 0
  UNION ALL
  SELECT CASE WHEN event_type = 'purchase' THEN 'purchase' ELSE 'payment_error' END, 'exp_checkout',
    CAST(NULL AS VARCHAR), CAST(user_id AS VARCHAR), epoch_us(ts),
    CASE WHEN event_type = 'purchase' THEN 't' || CAST(event_id AS VARCHAR) END,
    CASE WHEN event_type = 'purchase' THEN value END, NULL
  FROM events WHERE event_type IN ('purchase', 'error')
  UNION ALL
  SELECT 'checkout_completed', 'exp_checkout', CAST(NULL AS VARCHAR), CAST(user_id AS VARCHAR), epoch_us(ts),
    't' || CAST(event_id AS VARCHAR), NULL, CAST(20 + event_id % 200 AS DOUBLE)
  FROM events WHERE event_type = 'purchase'
  UNION ALL
  SELECT 'refund_or_cancelled', 'exp_checkout', CAST(NULL AS VARCHAR), CAST(user_id AS VARCHAR), epoch_us(ts) + 1000000,
    't' || CAST(event_id AS VARCHAR), NULL, NULL
  FROM events WHERE event_type = 'purchase' AND event_id % 13 = 0
)"""


def _dlit(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def _ab_ctes() -> str:
    za, k, mde2 = _dlit(Z_ALPHA), _dlit((Z_ALPHA + Z_POWER) ** 2), _dlit(MIN_PRACTICAL_LIFT ** 2)
    mde = _dlit(MIN_PRACTICAL_LIFT)
    cols = ["n", "conversions", "conversion_rate", "arpu", "payment_error_rate", "refund_rate",
            "median_checkout_duration_seconds"]
    wide = ", ".join(f"MAX(CASE WHEN variant = '{v}' THEN {c} END) AS {c}_{s}"
                     for v, s in (("control", "c"), ("treatment", "t")) for c in cols)
    return f"""
abm AS (
  SELECT experiment_id, variant, COUNT(*) AS n, CAST(SUM(converted_purchase) AS BIGINT) AS conversions,
    {sdiv("SUM(converted_purchase)", "COUNT(*)")} AS conversion_rate,
    {msum("revenue_usd")} AS revenue_usd, {sdiv(msum("revenue_usd"), "COUNT(*)")} AS arpu,
    CAST(SUM(payment_error) AS DOUBLE) / COUNT(payment_error) AS payment_error_rate,
    CAST(SUM(refund_or_cancelled) AS DOUBLE) / COUNT(refund_or_cancelled) AS refund_rate,
    MEDIAN(checkout_duration_seconds) AS median_checkout_duration_seconds
  FROM f4 GROUP BY experiment_id, variant
),
abw AS (SELECT experiment_id, {wide} FROM abm GROUP BY experiment_id),
abv AS (
  SELECT *, CAST(conversions_c + conversions_t AS DOUBLE) / (CAST(n_c AS DOUBLE) + CAST(n_t AS DOUBLE)) AS pooled,
    {za} * SQRT(conversion_rate_t * (1 - conversion_rate_t) / CAST(n_t AS DOUBLE)) AS half_t,
    {za} * SQRT(conversion_rate_c * (1 - conversion_rate_c) / CAST(n_c AS DOUBLE)) AS half_c
  FROM abw
),
aba AS (
  SELECT experiment_id, n_c, n_t, conversions_c, conversions_t,
    conversion_rate_c AS cvr_control, conversion_rate_t AS cvr_treatment,
    conversion_rate_t - conversion_rate_c AS absolute_lift,
    CASE WHEN conversion_rate_c > 0 THEN (conversion_rate_t - conversion_rate_c) / conversion_rate_c ELSE 0.0 END
      AS relative_lift,
    (conversion_rate_t - conversion_rate_c) / NULLIF(SQRT(pooled * (1 - pooled)
      * (1.0 / CAST(n_t AS DOUBLE) + 1.0 / CAST(n_c AS DOUBLE))), 0.0) AS z_stat,
    (conversion_rate_t - half_t) - (conversion_rate_c + half_c) AS diff_ci_low,
    (conversion_rate_t + half_t) - (conversion_rate_c - half_c) AS diff_ci_high,
    arpu_c AS arpu_control, arpu_t AS arpu_treatment,
    payment_error_rate_c AS payment_error_rate_control, payment_error_rate_t AS payment_error_rate_treatment,
    refund_rate_c AS refund_rate_control, refund_rate_t AS refund_rate_treatment,
    median_checkout_duration_seconds_c AS median_duration_control,
    median_checkout_duration_seconds_t AS median_duration_treatment,
    CAST(CEIL({k} * (conversion_rate_c * (1 - conversion_rate_c)
      + (conversion_rate_c + {mde}) * (1 - (conversion_rate_c + {mde}))) / {mde2}) AS BIGINT) AS required_n_per_arm
  FROM abv
),
abd AS (
  SELECT *, CASE
    WHEN absolute_lift > 0 AND diff_ci_low > 0 AND absolute_lift >= {mde}
         AND payment_error_rate_treatment - payment_error_rate_control <= CAST('0.002' AS DOUBLE)
         AND refund_rate_treatment - refund_rate_control <= CAST('0.002' AS DOUBLE) THEN 'Ship'
    WHEN absolute_lift > 0 AND (NOT (payment_error_rate_treatment - payment_error_rate_control <= CAST('0.002' AS DOUBLE))
         OR NOT (refund_rate_treatment - refund_rate_control <= CAST('0.002' AS DOUBLE))) THEN 'Iterate'
    WHEN diff_ci_high < 0 THEN 'Stop'
    ELSE 'Inconclusive' END AS decision
  FROM aba
)"""


def with_ctes(*parts: str, body: str) -> str:
    return "WITH " + ",".join(p.strip() for p in parts) + "\n" + body


def oracle_sql() -> dict[str, str]:
    q = {}
    q["stage_events"] = with_ctes(STG, body=f"SELECT {STG_SCALAR_COLS} FROM stg")
    q["sessions"] = with_ctes(STG, SESSIONS, body="SELECT * FROM sessions")
    q["session_funnel"] = with_ctes(STG, FUNNEL, body="SELECT * FROM funnel")
    q["funnel_performance"] = with_ctes(STG, SESSIONS, FUNNEL, FUNNEL_MART, body="SELECT * FROM funnel_perf")
    base = (STG, SESSIONS)
    q["users"] = with_ctes(*base, USERS, body="SELECT * FROM users")
    q["orders"] = with_ctes(STG, ORDERS, body="SELECT * FROM orders_m")
    q["product_events"] = with_ctes(STG, PRODUCT_EVENTS, body="SELECT * FROM product_events")
    q["kpis_daily"] = with_ctes(*base, ORDERS, KPIS, body="SELECT * FROM kpis")
    q["segment_performance"] = with_ctes(*base, USERS, SEGMENTS, body="SELECT * FROM segments")
    q["product_performance"] = with_ctes(STG, PRODUCTS, body="SELECT * FROM product_perf")
    q["retention_cohorts"] = with_ctes(F2, RETENTION, body="SELECT * FROM retention")
    q["customer_rfm"] = with_ctes(F3, RFM, body="SELECT * FROM rfm")
    kp = (STG, SESSIONS, ORDERS, KPIS)
    fm = (STG, SESSIONS, FUNNEL, FUNNEL_MART)
    q["kpi_totals"] = with_ctes(*kp, body=f"""
SELECT MIN(report_date) AS start_date, MAX(report_date) AS end_date,
  CAST(SUM(daily_active_users) AS BIGINT) AS total_user_days, CAST(SUM(total_sessions) AS BIGINT) AS total_sessions,
  CAST(SUM(total_orders) AS BIGINT) AS total_orders, {msum("total_revenue_usd")} AS total_revenue_usd,
  {sdiv("SUM(total_orders)", "SUM(total_sessions)")} AS overall_session_conversion,
  {sdiv(msum("total_revenue_usd"), "SUM(total_orders)")} AS overall_aov
FROM kpis""")
    q["week_over_week"] = with_ctes(*kp, _wow_body(), body="SELECT * FROM wow")
    q["trend_class"] = with_ctes(*kp, _wow_body(), body="SELECT revenue_delta_pct, trend FROM wow")
    q["peak_week"] = with_ctes(*kp, body="""
SELECT report_date AS peak_date, CAST(r AS DOUBLE) / 1000000.0 AS peak_7d_revenue_usd FROM (
  SELECT report_date, SUM(CAST(ROUND(total_revenue_usd * 1000000) AS BIGINT)) OVER (
    ORDER BY report_date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS r FROM kpis)
ORDER BY r DESC, report_date LIMIT 1""")
    steps = [("se", "Sessions Entered"), ("spv", "Product View"), ("sac", "Add to Cart"),
             ("sbc", "Begin Checkout"), ("sp", "Purchase")]
    parts = []
    for i, (c, lab) in enumerate(steps):
        prev = "CAST(NULL AS DOUBLE)" if i == 0 else _roz(f"CAST({c} AS DOUBLE)", f"CAST({steps[i-1][0]} AS DOUBLE)")
        parts.append(f"SELECT {i + 1} AS step_index, '{lab}' AS step, {c} AS sessions, "
                     f"{_roz(f'CAST({c} AS DOUBLE)', 'CAST(se AS DOUBLE)')} AS pct_of_entered, "
                     f"{prev} AS pct_of_previous FROM fsum")
    q["funnel_total"] = with_ctes(*fm, FUNNEL_SUMS, body="\nUNION ALL\n".join(parts))
    drops = [f"SELECT {i} AS i, '{steps[i-1][1]}' AS from_step, '{steps[i][1]}' AS to_step, "
             f"1.0 - CAST({steps[i][0]} AS DOUBLE) / CAST({steps[i-1][0]} AS DOUBLE) AS drop_rate "
             f"FROM fsum WHERE {steps[i-1][0]} > 0" for i in range(1, 5)]
    q["largest_drop"] = with_ctes(*fm, FUNNEL_SUMS, body=f"""
SELECT from_step, to_step, drop_rate FROM ({" UNION ALL ".join(drops)}) ORDER BY drop_rate DESC, i LIMIT 1""")
    q["cart_abandonment"] = with_ctes(*fm, FUNNEL_SUMS, body=f"""
SELECT sac AS sessions_add_to_cart, sbc AS sessions_begin_checkout, 1.0 - {sdiv("sbc", "sac")} AS cart_abandonment_rate
FROM fsum""")
    dev = [("sessions_entered", "Entered"), ("sessions_product_view", "Product View"),
           ("sessions_add_to_cart", "Add to Cart"), ("sessions_begin_checkout", "Checkout"),
           ("sessions_purchase", "Purchase")]
    q["funnel_by_device"] = with_ctes(*fm, body="\nUNION ALL\n".join(
        f"SELECT device_category, '{lab}' AS funnel_step, CAST(SUM({c}) AS BIGINT) AS sessions "
        f"FROM funnel_perf GROUP BY device_category" for c, lab in dev))
    q["segment_compare"] = with_ctes(STG, SESSIONS, USERS, SEGMENTS, body="""
SELECT segment_type, segment_value, unique_users, total_sessions, total_revenue_usd, session_conversion_rate,
  avg_order_value_usd
FROM segments WHERE segment_type IN ('device_category', 'search_adoption')""")
    q["rfm_distribution"] = with_ctes(F3, RFM, body=f"""
SELECT rfm_segment, COUNT(*) AS customer_count, {msum("monetary_value_usd")} AS total_revenue_usd,
  CAST(SUM(frequency) AS DOUBLE) / COUNT(frequency) AS avg_frequency,
  CAST(SUM(recency_days) AS DOUBLE) / COUNT(recency_days) AS avg_recency_days
FROM rfm GROUP BY rfm_segment""")
    rt = (F2, RETENTION)
    q["retention_curve"] = with_ctes(*rt, CURVE_ALL, body="SELECT * FROM curve_all WHERE activity_week_index <= 8")
    q["retention_matrix"] = with_ctes(*rt, body="SELECT cohort_week, " + ", ".join(
        f"AVG(CASE WHEN activity_week_index = {w} THEN retention_rate END) AS week_{w}" for w in range(9))
        + " FROM retention WHERE activity_week_index <= 8 GROUP BY cohort_week")
    q["retention_stabilization"] = with_ctes(*rt, CURVE_ALL, body="""
, c AS (
  SELECT activity_week_index, avg_retention_rate AS rate,
    ROW_NUMBER() OVER (ORDER BY activity_week_index) - 1 AS rn,
    ABS(avg_retention_rate - LAG(avg_retention_rate) OVER (ORDER BY activity_week_index)) AS d,
    LAG(activity_week_index) OVER (ORDER BY activity_week_index) AS pidx,
    LAG(avg_retention_rate) OVER (ORDER BY activity_week_index) AS prate
  FROM curve_all),
c2 AS (SELECT *, LAG(d) OVER (ORDER BY activity_week_index) AS pd FROM c),
hit AS (SELECT * FROM c2 WHERE rn >= 2 AND pd < CAST(0.01 AS DOUBLE) AND d < CAST(0.01 AS DOUBLE)
        ORDER BY rn LIMIT 1)
SELECT (SELECT pidx FROM hit) AS stabilization_week, (SELECT prate FROM hit) AS stabilization_rate""".lstrip())
    q["cohort_sizes"] = with_ctes(*rt, body="SELECT cohort_week, cohort_size FROM retention WHERE activity_week_index = 0")
    q["week1_retention"] = with_ctes(*rt, CURVE_ALL, body="""
SELECT total_retained, total_cohort_size, avg_retention_rate AS week1_retention_rate
FROM curve_all WHERE activity_week_index = 1""")
    q["revenue_concentration"] = with_ctes(F3, RFM, CONCENTRATION, body="""
SELECT user_pseudo_id, monetary_value_usd, customer_rank, cumulative_revenue,
  cumulative_revenue / total AS cumulative_revenue_pct, CAST(customer_rank AS DOUBLE) / n AS customer_percentile,
  n AS purchasers
FROM conc""")
    q["top_decile_share"] = with_ctes(F3, RFM, CONCENTRATION, body="""
SELECT n AS purchasers, CAST(FLOOR(n * CAST(0.1 AS DOUBLE)) AS BIGINT) AS top_decile_customers,
  cumulative_revenue / total AS top_decile_revenue_share
FROM conc WHERE customer_rank = FLOOR(n * CAST(0.1 AS DOUBLE)) AND FLOOR(n * CAST(0.1 AS DOUBLE)) >= 1""")
    q["top_products"] = with_ctes(STG, PRODUCTS, body="""
SELECT * FROM product_perf ORDER BY total_item_revenue_usd DESC, item_id LIMIT 20""")
    us = (STG, SESSIONS, USERS)
    q["repeat_rate"] = with_ctes(*us, body=f"""
SELECT CAST(SUM(CASE WHEN is_purchaser THEN 1 ELSE 0 END) AS BIGINT) AS purchasers,
  CAST(SUM(CASE WHEN is_purchaser AND order_count > 1 THEN 1 ELSE 0 END) AS BIGINT) AS repeat_purchasers,
  {sdiv("SUM(CASE WHEN is_purchaser AND order_count > 1 THEN 1 ELSE 0 END)",
        "SUM(CASE WHEN is_purchaser THEN 1 ELSE 0 END)")} AS repeat_purchase_rate
FROM users""")
    q["ltv_proxy"] = with_ctes(*us, body=f"""
SELECT COUNT(user_pseudo_id) AS users, CAST(SUM(CASE WHEN is_purchaser THEN 1 ELSE 0 END) AS BIGINT) AS purchasers,
  {msum("total_revenue_usd")} AS total_revenue_usd,
  {sdiv(msum("total_revenue_usd"), "COUNT(user_pseudo_id)")} AS revenue_per_user_usd,
  {sdiv(msum("total_revenue_usd"), "SUM(CASE WHEN is_purchaser THEN 1 ELSE 0 END)")} AS revenue_per_purchaser_usd
FROM users""")
    q["filtered_kpis"] = with_ctes(*fm, body="""
SELECT * FROM funnel_perf
WHERE report_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-21' AND device_category IN ('desktop', 'mobile')""")
    q["source_coverage"] = with_ctes(STG, body="""
SELECT COUNT(*) AS total_events, MIN(event_date) AS earliest_date, MAX(event_date) AS latest_date,
  COUNT(DISTINCT event_date) AS distinct_dates, COUNT(DISTINCT user_pseudo_id) AS distinct_users FROM stg""")
    q["event_inventory"] = with_ctes(STG, body="""
SELECT event_name, COUNT(*) AS event_count, COUNT(DISTINCT user_pseudo_id) AS distinct_users,
  MIN(event_date) AS first_seen, MAX(event_date) AS last_seen FROM stg GROUP BY event_name""")
    nulls = [("user_id", "user_pseudo_id"), ("event_name", "event_name"), ("timestamp", "event_timestamp"),
             ("session_id", "ga_session_id"), ("ecom_txn_id", "ecommerce_transaction_id")]
    q["null_profile"] = with_ctes(STG, body="\nUNION ALL\n".join(
        f"SELECT '{f}' AS field, COUNT(*) FILTER (WHERE {c} IS NULL) AS null_count, "
        f"CASE WHEN COUNT(*) > 0 THEN CAST(COUNT(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) / COUNT(*) ELSE 0.0 END "
        f"AS null_rate FROM stg" for f, c in nulls))
    q["dup_transactions"] = with_ctes(STG, body="""
SELECT ecommerce_transaction_id AS txn_id, COUNT(*) AS event_count FROM stg
WHERE event_name = 'purchase' AND ecommerce_transaction_id IS NOT NULL
GROUP BY ecommerce_transaction_id HAVING COUNT(*) > 1 ORDER BY event_count DESC, txn_id LIMIT 10""")
    all_marts = (STG, SESSIONS, FUNNEL, FUNNEL_MART, ORDERS, KPIS, USERS, SEGMENTS, PRODUCTS, F2, RETENTION, F3, RFM)
    mart_tables = [("mart_product_kpis_daily", "kpis"), ("mart_funnel_performance", "funnel_perf"),
                   ("mart_retention_cohorts", "retention"), ("mart_customer_rfm", "rfm"),
                   ("mart_segment_performance", "segments"), ("mart_product_performance", "product_perf")]
    q["mart_row_counts"] = with_ctes(*all_marts, body="\nUNION ALL\n".join(
        f"SELECT '{m}' AS mart, 'ok' AS status, COUNT(*) AS row_count FROM {t}" for m, t in mart_tables))
    q["reconciliation"] = with_ctes(STG, ORDERS, body=f"""
, o AS (SELECT {msum("order_revenue_usd")} AS orders_revenue FROM orders_m),
s AS (SELECT {msum("COALESCE(ecommerce_purchase_revenue_in_usd, ecommerce_purchase_revenue, 0.0)")} AS source_revenue
      FROM stg WHERE event_name = 'purchase' AND COALESCE(ecommerce_transaction_id, transaction_id) IS NOT NULL)
SELECT orders_revenue, source_revenue, ABS(orders_revenue - source_revenue) AS absolute_diff,
  {sdiv("ABS(orders_revenue - source_revenue)", "source_revenue")} AS relative_diff,
  COALESCE({sdiv("ABS(orders_revenue - source_revenue)", "source_revenue")} > CAST(0.01 AS DOUBLE)
           AND ABS(orders_revenue - source_revenue) > CAST(1.0 AS DOUBLE), FALSE) AS exceeds_tolerance
FROM o CROSS JOIN s""".lstrip())
    q["purchase_profile"] = with_ctes(STG, body=f"""
SELECT COUNT(*) AS total_purchase_events, COUNT(ecommerce_transaction_id) AS has_ecommerce_txn_id,
  COUNT(transaction_id) AS has_param_txn_id, COUNT(ecommerce_purchase_revenue) AS has_purchase_revenue,
  COUNT(ecommerce_purchase_revenue_in_usd) AS has_purchase_revenue_usd,
  MIN(ecommerce_purchase_revenue_in_usd) AS min_revenue_usd, MAX(ecommerce_purchase_revenue_in_usd) AS max_revenue_usd,
  {msum("ecommerce_purchase_revenue_in_usd")} / COUNT(ecommerce_purchase_revenue_in_usd) AS avg_revenue_usd,
  CAST(SUM(CASE WHEN e % 3 > 0 THEN 1 ELSE 0 END) AS BIGINT) AS has_items,
  COUNT(DISTINCT ecommerce_transaction_id) AS distinct_txn_ids
FROM stg WHERE event_name = 'purchase'""")
    q["session_crosscheck"] = with_ctes(STG, SESSIONS, ORDERS, KPIS, body="""
SELECT 'int_sessions' AS model, COUNT(DISTINCT session_key) AS total_sessions,
  COUNT(DISTINCT user_pseudo_id) AS total_users FROM sessions
UNION ALL
SELECT 'mart_kpis_sum' AS model, CAST(SUM(total_sessions) AS BIGINT), CAST(SUM(daily_active_users) AS BIGINT)
FROM kpis""")
    tbl = dict(mart_tables)
    tbl.update({"stg_ga4_events": "stg", "int_sessions": "sessions", "int_users": "users",
                "int_orders": "orders_m", "int_session_funnel": "funnel"})
    checks = []
    for model, col, test, vals in SCHEMA_TESTS:
        t = tbl[model]
        if test == "not_null":
            expr = f"SELECT COUNT(*) FILTER (WHERE {col} IS NULL) AS failures FROM {t}"
        elif test == "unique":
            expr = (f"SELECT COUNT(*) AS failures FROM (SELECT {col} FROM {t} WHERE {col} IS NOT NULL "
                    f"GROUP BY {col} HAVING COUNT(*) > 1)")
        else:
            inlist = ", ".join("'" + v.replace("'", "''") + "'" for v in vals)
            expr = f"SELECT COUNT(DISTINCT {col}) AS failures FROM {t} WHERE {col} NOT IN ({inlist})"
        checks.append(f"SELECT '{model}' AS model, '{col}' AS column_name, '{test}' AS test, "
                      f"CAST(failures AS BIGINT) AS failures FROM ({expr})")
    q["schema_checks"] = with_ctes(*all_marts, body="\nUNION ALL\n".join(checks))
    q["scan_range"] = with_ctes(STG, body="""
SELECT event_name, COUNT(*) AS event_count, COUNT(DISTINCT user_pseudo_id) AS distinct_users,
  MIN(event_date) AS first_seen, MAX(event_date) AS last_seen FROM stg
WHERE event_date BETWEEN '20240105' AND '20240114' GROUP BY event_name""")
    q["extract_counts"] = with_ctes(*all_marts, body="\nUNION ALL\n".join(
        f"SELECT '{m}' AS mart, 'ok' AS status, COUNT(*) AS row_count, 'generated' AS source_dataset, "
        f"'generated tables' AS dataset_disclosure FROM {t}" for m, t in mart_tables))
    q["negative_revenue"] = with_ctes(STG, ORDERS, body="""
SELECT order_transaction_key, order_revenue_usd FROM orders_m WHERE order_revenue_usd < 0""")
    q["funnel_consistency"] = with_ctes(STG, FUNNEL, body="""
SELECT session_key, reached_view_item, reached_add_to_cart_after_view, reached_begin_checkout_after_cart,
  reached_purchase_after_checkout FROM funnel
WHERE (reached_begin_checkout_after_cart AND NOT reached_add_to_cart_after_view)
   OR (reached_purchase_after_checkout AND NOT reached_begin_checkout_after_cart)
   OR (reached_add_to_cart_after_view AND NOT reached_view_item)
LIMIT 10""")
    q["missing_dates"] = with_ctes(STG, body="""
SELECT CAST(d AS DATE) AS missing_date
FROM (SELECT unnest(generate_series(MIN(event_date_parsed), MAX(event_date_parsed), INTERVAL 1 DAY)) AS d FROM stg)
WHERE CAST(d AS DATE) NOT IN (SELECT event_date_parsed FROM stg WHERE event_date_parsed IS NOT NULL)""")
    ev_rows = "\nUNION ALL\n".join(
        f"SELECT 'event_present:{e}' AS check, CAST(COUNT(*) FILTER (WHERE event_name = '{e}') AS DOUBLE) AS value, "
        f"COUNT(*) FILTER (WHERE event_name = '{e}') > 0 AS passed FROM stg" for e in REQUIRED_EVENTS)
    q["quality_checklist"] = with_ctes(STG, body=f"""
, gaps AS (
  SELECT COUNT(*) AS g FROM (
    SELECT CAST(d AS DATE) AS md FROM (SELECT unnest(generate_series(MIN(event_date_parsed), MAX(event_date_parsed),
      INTERVAL 1 DAY)) AS d FROM stg)
    WHERE CAST(d AS DATE) NOT IN (SELECT event_date_parsed FROM stg WHERE event_date_parsed IS NOT NULL)))
SELECT 'user_pseudo_id_null_rate' AS check,
  CASE WHEN COUNT(*) > 0 THEN CAST(COUNT(*) FILTER (WHERE user_pseudo_id IS NULL) AS DOUBLE) / COUNT(*) ELSE 0.0 END
    AS value,
  (CASE WHEN COUNT(*) > 0 THEN CAST(COUNT(*) FILTER (WHERE user_pseudo_id IS NULL) AS DOUBLE) / COUNT(*) ELSE 0.0 END)
    < CAST(0.001 AS DOUBLE) AS passed FROM stg
UNION ALL
SELECT 'missing_dates', CAST(g AS DOUBLE), g = 0 FROM gaps
UNION ALL
{ev_rows}""".lstrip())
    label = ("CASE segment_value WHEN '(none)' THEN 'Direct' WHEN '(data deleted)' THEN 'Unknown' "
             "WHEN '<Other>' THEN 'Other' WHEN '(not set)' THEN 'Unknown' ELSE segment_value END")
    q["safe_extract"] = with_ctes(STG, SESSIONS, USERS, SEGMENTS, body=f"""
SELECT segment_type, {label} AS segment_value, unique_users, total_sessions, purchase_sessions, purchasers,
  total_revenue_usd, total_orders, session_conversion_rate, revenue_per_session_usd, avg_order_value_usd
FROM segments""")
    q["load_extract"] = q["safe_extract"]
    q["safe_extract_rfm"] = with_ctes(F3, RFM, body="""
SELECT recency_days, frequency, monetary_value_usd, first_order_date, last_order_date, analysis_reference_date,
  r_score, f_score, m_score, rfm_segment FROM rfm""")
    q["ab_validity"] = with_ctes(F4, body="""
, pu AS (SELECT experiment_id, COUNT(*) FILTER (WHERE nv <> 1) AS multi_variant_users
         FROM (SELECT experiment_id, user_id, COUNT(DISTINCT variant) AS nv FROM f4 GROUP BY 1, 2) GROUP BY 1),
agg AS (
  SELECT experiment_id, COUNT(*) AS n_units,
    COUNT(*) FILTER (WHERE NOT COALESCE(variant IN ('control', 'treatment'), FALSE)) AS bad_variant,
    COUNT(*) FILTER (WHERE variant = 'control') AS n_control,
    COUNT(*) FILTER (WHERE variant = 'treatment') AS n_treatment,
    COUNT(*) FILTER (WHERE NOT COALESCE(is_eligible, FALSE) OR NOT COALESCE(device_category = 'mobile', FALSE))
      AS not_eligible_mobile,
    COUNT(*) FILTER (WHERE NOT COALESCE(revenue_usd >= 0, FALSE)) AS negative_revenue,
    COUNT(*) FILTER (WHERE converted_purchase = 0 AND NOT COALESCE(revenue_usd = 0, FALSE)) AS nonconverter_revenue
  FROM f4 GROUP BY experiment_id)
SELECT a.experiment_id, a.n_units, p.multi_variant_users, p.multi_variant_users = 0 AS single_variant_per_user,
  (a.bad_variant = 0 AND a.n_control > 0 AND a.n_treatment > 0) AS valid_variants_only,
  a.not_eligible_mobile = 0 AS all_eligible_mobile, a.negative_revenue = 0 AS non_negative_revenue,
  a.nonconverter_revenue = 0 AS nonconverters_zero_revenue
FROM agg a JOIN pu p ON a.experiment_id = p.experiment_id""".lstrip())
    q["ab_metrics"] = with_ctes(F4, _ab_ctes(), body="""
SELECT experiment_id, variant, n, conversions, conversion_rate, revenue_usd, arpu, payment_error_rate, refund_rate,
  median_checkout_duration_seconds FROM abm""")
    q["ab_lift"] = with_ctes(F4, _ab_ctes(), body="""
SELECT experiment_id, cvr_control, cvr_treatment, absolute_lift, relative_lift FROM aba""")
    q["ab_interval"] = with_ctes(F4, _ab_ctes(), body="""
SELECT experiment_id, z_stat, diff_ci_low, diff_ci_high FROM aba""")
    q["ab_power"] = with_ctes(F4, _ab_ctes(), body="SELECT experiment_id, cvr_control, required_n_per_arm FROM aba")
    # 1 - erf(|x|) from its power series, for the p-values; |x| beyond 8 is 0 to ten places.
    p_of = lambda x, src: (
        f"SELECT s.*, ROUND(CASE WHEN x IS NULL THEN NULL WHEN x = 0 THEN 1.0 WHEN x > 8 THEN 0.0 ELSE "
        f"1 - (SELECT SUM(EXP((2 * n + 1) * LN(x) - x * x - LGAMMA(n + 1.5))) FROM range(0, 400) t(n)) END, 10) AS p_value "
        f"FROM (SELECT *, {x} AS x FROM {src}) s")
    q["ab_srm"] = with_ctes(F4, body=f"""
, c AS (SELECT experiment_id, COUNT(*) FILTER (WHERE variant = 'control') AS n_control,
    COUNT(*) FILTER (WHERE variant = 'treatment') AS n_treatment FROM f4 GROUP BY experiment_id),
k AS (SELECT *, (POW(n_control - (n_control + n_treatment) / 2.0, 2) + POW(n_treatment - (n_control + n_treatment) / 2.0, 2))
    / NULLIF((n_control + n_treatment) / 2.0, 0) AS chi2 FROM c),
p AS ({p_of("SQRT(chi2 / 2)", "k")})
SELECT experiment_id, n_control, n_treatment, chi2, p_value, COALESCE(p_value > 0.001, FALSE) AS srm_passed FROM p""".lstrip())
    q["ab_ztest"] = with_ctes(F4, _ab_ctes(), body=f"""
, p AS ({p_of("ABS(z_stat) / SQRT(2)", "aba")})
SELECT experiment_id, z_stat, p_value FROM p""".lstrip())
    reason = "CASE decision " + " ".join(f"WHEN '{d}' THEN '{t}'" for d, t in DECISION_REASONS.items()) + " END"
    q["ab_decision"] = with_ctes(F4, _ab_ctes(), body=f"""
SELECT experiment_id, absolute_lift, diff_ci_low, diff_ci_high, decision, {reason} AS reason FROM abd""")
    q["ab_summary"] = with_ctes(F4, _ab_ctes(), body=f"""
, p AS ({p_of("ABS(z_stat) / SQRT(2)", "abd")})
SELECT experiment_id, 'conversion_rate' AS metric, cvr_control AS control, cvr_treatment AS treatment, absolute_lift,
  p_value, decision, {reason} AS reason FROM p""".lstrip())
    q["ab_guardrails"] = with_ctes(F4, _ab_ctes(), body="\nUNION ALL\n".join(
        f"SELECT experiment_id, '{m}' AS metric, {c}_control AS control, {c}_treatment AS treatment FROM aba"
        for m, c in (("arpu", "arpu"), ("payment_error_rate", "payment_error_rate"), ("refund_rate", "refund_rate"),
                     ("median_duration", "median_duration"))))
    q["experiment_tables"] = q["ab_guardrails"]
    q["experiment_csv"] = with_ctes(F4, _ab_ctes(), body="""
SELECT experiment_id, variant, n, conversions, conversion_rate, revenue_usd, arpu, payment_error_rate, refund_rate FROM abm""")
    q["ab_histogram"] = with_ctes(F4, body="""
, conv AS (SELECT * FROM f4 WHERE converted_purchase = 1),
rng AS (SELECT experiment_id, MIN(revenue_usd) AS lo, MAX(revenue_usd) AS hi FROM conv GROUP BY experiment_id),
h AS (
  SELECT c.experiment_id, c.variant, r.lo, r.hi, (r.hi - r.lo) / 50.0 AS w,
    CAST(CASE WHEN (r.hi - r.lo) / 50.0 > 0 THEN LEAST(FLOOR((c.revenue_usd - r.lo) / ((r.hi - r.lo) / 50.0)), 49)
         ELSE 0 END AS INTEGER) AS bin
  FROM conv c JOIN rng r ON c.experiment_id = r.experiment_id)
SELECT experiment_id, variant, bin, lo + bin * w AS bin_start, lo + (bin + 1) * w AS bin_end, COUNT(*) AS units
FROM h GROUP BY experiment_id, variant, bin, lo, hi, w""".lstrip())
    firstchk = """
, firstchk AS (
  SELECT * FROM (
    SELECT user_pseudo_id, event_timestamp_utc, device_category,
      ROW_NUMBER() OVER (PARTITION BY user_pseudo_id ORDER BY event_timestamp_utc, device_category NULLS FIRST) AS rn
    FROM stg WHERE event_name = 'begin_checkout' AND user_pseudo_id IS NOT NULL) WHERE rn = 1
)"""
    q["ab_eligible"] = with_ctes(STG, F5, body=firstchk.lstrip() + """
SELECT user_pseudo_id, event_timestamp_utc AS eligibility_timestamp FROM firstchk
WHERE device_category = 'mobile' AND user_pseudo_id NOT IN (
  SELECT user_pseudo_id FROM f5 WHERE event_name = 'experiment_impression' AND experiment_id = 'exp_checkout')""")
    q["ab_assign"] = with_ctes(STG, body=firstchk.lstrip() + """
, b AS (SELECT user_pseudo_id, CAST(CAST(('0x' || substr(md5('exp_checkout:' || user_pseudo_id), 1, 8)) AS BIGINT)
          % 100 AS INTEGER) AS bucket FROM firstchk WHERE device_category = 'mobile')
SELECT 'exp_checkout' AS experiment_id, user_pseudo_id, bucket,
  CASE WHEN bucket < 50 THEN 'control' ELSE 'treatment' END AS variant FROM b""")
    q["ab_attribution"] = with_ctes(F5, body=f"""
, fe AS (
  SELECT experiment_id, user_pseudo_id, exposure_ts, variant FROM (
    SELECT experiment_id, user_pseudo_id, event_timestamp AS exposure_ts, variant,
      ROW_NUMBER() OVER (PARTITION BY experiment_id, user_pseudo_id ORDER BY event_timestamp, variant NULLS FIRST) AS rn
    FROM f5 WHERE event_name = 'experiment_impression') WHERE rn = 1),
oc AS (SELECT experiment_id, user_pseudo_id, event_name AS outcome, event_timestamp AS outcome_ts, revenue_usd, duration
       FROM f5 WHERE event_name <> 'experiment_impression'),
pu AS (
  SELECT fe.experiment_id, fe.variant, fe.user_pseudo_id,
    COUNT(*) FILTER (WHERE oc.outcome = 'purchase' AND oc.outcome_ts >= fe.exposure_ts) AS purchases,
    COUNT(*) FILTER (WHERE oc.outcome = 'payment_error' AND oc.outcome_ts >= fe.exposure_ts) AS payment_errors,
    COUNT(*) FILTER (WHERE oc.outcome = 'refund_or_cancelled' AND oc.outcome_ts >= fe.exposure_ts) AS refunds,
    SUM(oc.duration) FILTER (WHERE oc.outcome_ts >= fe.exposure_ts) AS seconds,
    COUNT(oc.duration) FILTER (WHERE oc.outcome_ts >= fe.exposure_ts) AS checkouts,
    {msum("CASE WHEN oc.outcome = 'purchase' AND oc.outcome_ts >= fe.exposure_ts THEN oc.revenue_usd END")} AS revenue
  FROM fe LEFT JOIN oc ON fe.experiment_id = oc.experiment_id AND fe.user_pseudo_id = oc.user_pseudo_id
  GROUP BY 1, 2, 3)
SELECT experiment_id, variant, COUNT(*) AS exposed_users, COUNT(*) FILTER (WHERE purchases > 0) AS converted_users,
  CAST(COALESCE(SUM(purchases), 0) AS BIGINT) AS purchases, COALESCE({msum("revenue")}, 0.0) AS revenue_usd,
  CAST(COALESCE(SUM(payment_errors), 0) AS BIGINT) AS payment_errors,
  CAST(COALESCE(SUM(refunds), 0) AS BIGINT) AS refunds, {sdiv("SUM(seconds)", "SUM(checkouts)")} AS avg_checkout_duration_seconds,
  {sdiv("SUM(refunds)", "SUM(purchases)")} AS refund_rate,
  {sdiv("COUNT(*) FILTER (WHERE purchases > 0)", "COUNT(*)")} AS conversion_rate
FROM pu GROUP BY experiment_id, variant""".lstrip())
    q["ab_exposure_once"] = with_ctes(F5, body="""
SELECT experiment_id, user_pseudo_id, COUNT(*) AS exposures FROM f5 WHERE event_name = 'experiment_impression'
GROUP BY 1, 2 HAVING COUNT(*) <> 1""")
    q["ab_missing_exposure"] = with_ctes(F5, body="""
SELECT p.experiment_id, p.user_pseudo_id, p.transaction_id, p.event_timestamp, p.revenue_usd
FROM f5 p WHERE p.event_name = 'purchase' AND NOT EXISTS (
  SELECT 1 FROM f5 x WHERE x.event_name = 'experiment_impression' AND x.experiment_id = p.experiment_id
    AND x.user_pseudo_id = p.user_pseudo_id)""")
    q["ab_contamination"] = with_ctes(F5, body="""
SELECT experiment_id, user_pseudo_id, COUNT(DISTINCT variant) AS variants FROM f5
WHERE event_name = 'experiment_impression' GROUP BY 1, 2 HAVING COUNT(DISTINCT variant) > 1""")
    q["ab_duration"] = with_ctes(STG, FUNNEL, body="""
SELECT session_key, user_pseudo_id, first_begin_checkout_time AS checkout_start_time,
  first_purchase_time AS purchase_time,
  CAST(epoch_us(first_purchase_time) - epoch_us(first_begin_checkout_time) AS DOUBLE) / CAST(1000000.0 AS DOUBLE)
    AS checkout_duration_seconds
FROM funnel WHERE first_begin_checkout_time IS NOT NULL AND first_purchase_time IS NOT NULL
  AND first_purchase_time >= first_begin_checkout_time""")
    f2_from_sessions = "f2 AS (SELECT user_pseudo_id, session_key, session_date FROM sessions)"
    f3_from_orders = ("f3 AS (SELECT order_transaction_key, order_date, user_pseudo_id, order_revenue_usd "
                      "FROM orders_m)")
    built = (STG, SESSIONS, FUNNEL, FUNNEL_MART, ORDERS, KPIS, USERS, SEGMENTS, PRODUCTS, f2_from_sessions,
             RETENTION, f3_from_orders, RFM)
    q["build_all"] = with_ctes(*built, body="\nUNION ALL\n".join(
        f"SELECT '{m}' AS mart, 'ok' AS status, COUNT(*) AS row_count FROM {t}" for m, t in mart_tables))
    q["filter_options"] = with_ctes(*fm, body="""
SELECT DISTINCT CAST(device_category AS VARCHAR) AS option FROM funnel_perf WHERE device_category IS NOT NULL""")
    return q
