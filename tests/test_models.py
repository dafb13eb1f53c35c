"""Intermediate models and marts on hand-written edge frames (section 8 semantics)."""

import datetime as dt

from pyspark.sql import functions as F

from funnelworks.operators.orders import orders
from funnelworks.operators.products import product_events
from funnelworks.operators.sessions import session_facts, session_funnel, sessions, users
from funnelworks.operators.staging import stage_events
from funnelworks.plans import marts
from helpers import ev, item, raw_df


def stg(spark, rows):
    return stage_events(raw_df(spark, rows))


def test_staging_drops_nothing_and_builds_keys(spark):
    s = stg(spark, [ev("page_view", "u1", 1), ev("page_view", "u1", 2, sid=None), ev("page_view", None, 3)])
    keys = [r.session_key for r in s.orderBy("event_timestamp").collect()]
    assert keys == ["u1-1", None, None]


def test_staging_date_range_is_inclusive(spark):
    rows = [ev("page_view", "u", 1, day=d) for d in ("20240101", "20240102", "20240103")]
    s = stage_events(raw_df(spark, rows), "20240102", "20240103")
    assert sorted(r.event_date for r in s.collect()) == ["20240102", "20240103"]


def test_funnel_cart_before_view_and_ties(spark):
    rows = [
        # s1: cart, view, cart again -> first cart precedes first view: stops at view
        ev("add_to_cart", "a", 1, sid=1), ev("view_item", "a", 2, sid=1), ev("add_to_cart", "a", 3, sid=1),
        # s2: all steps at the same instant -> ties pass, reaches purchase
        *[ev(n, "a", 5, sid=2) for n in ("view_item", "add_to_cart", "begin_checkout", "purchase")],
        # s3: purchase without checkout
        ev("view_item", "a", 1, sid=3), ev("add_to_cart", "a", 2, sid=3), ev("purchase", "a", 3, sid=3),
    ]
    f = {r.session_key: r for r in session_funnel(stg(spark, rows)).collect()}
    assert (f["a-1"].reached_view_item, f["a-1"].reached_add_to_cart_after_view) == (True, False)
    assert f["a-2"].reached_purchase_after_checkout is True
    assert (f["a-3"].reached_add_to_cart_after_view, f["a-3"].reached_begin_checkout_after_cart,
            f["a-3"].reached_purchase_after_checkout) == (True, False, False)
    # flags are monotone
    for r in f.values():
        assert r.reached_view_item >= r.reached_add_to_cart_after_view >= r.reached_begin_checkout_after_cart \
            >= r.reached_purchase_after_checkout


def test_session_first_event_attributes_and_flags(spark):
    rows = [
        ev("page_view", "u", 10, device="desktop", page="/late"),
        ev("page_view", "u", 1, device=None, page="/landing"),     # first event: NULL device stays NULL
        ev("purchase", "u", 20, usd=5.5, ecom_txn="t1"),
        ev("purchase", "u", 21, usd=5.5, txn="t1"),                # same txn via param: counted once
        ev("purchase", "u", 22, usd=None, rev=7.0, ecom_txn="t2"),  # local revenue is ignored for sessions
        ev(None, "u", 23),
    ]
    r = sessions(stg(spark, rows)).first()
    assert r.device_category is None and r.landing_page == "/landing"
    assert r.event_count == 6 and r.transaction_count == 2 and r.session_revenue_usd == 11.0
    assert r.has_purchase and r.has_page_view and not r.has_search and not r.has_view_item


def test_session_without_events_flags_false(spark):
    r = sessions(stg(spark, [ev(None, "u", 1)])).first()
    assert r.has_page_view is False and r.has_purchase is False


def test_orders_keep_earliest_and_fallback_revenue(spark):
    rows = [
        ev("purchase", "u", 5, ecom_txn="t1", usd=None, rev=3.0),
        ev("purchase", "u", 2, txn="t1", usd=9.0),               # earliest for t1
        ev("purchase", "u", 7, ecom_txn=None, txn=None, usd=4.0),  # no key: dropped
        ev("purchase", "v", 1, ecom_txn="t2", usd=None, rev=None),  # revenue defaults to 0
    ]
    o = {r.order_transaction_key: r for r in orders(stg(spark, rows)).collect()}
    assert set(o) == {"t1", "t2"}
    assert o["t1"].order_revenue_usd == 9.0 and o["t2"].order_revenue_usd == 0.0


def test_product_events_keep_empty_and_null_items(spark):
    rows = [ev("view_item", "u", 1, items=[item("A"), item("B")]), ev("add_to_cart", "u", 2, items=[]),
            ev("purchase", "u", 3, items=None), ev("page_view", "u", 4, items=[item("C")])]
    pe = product_events(stg(spark, rows))
    got = sorted((r.event_name, r.item_id) for r in pe.collect())
    assert got == [("add_to_cart", None), ("purchase", None), ("view_item", "A"), ("view_item", "B")]


def test_product_performance_fallbacks(spark):
    rows = [ev("purchase", "u", 1, sid=1, items=[item("A", price=4.0, qty=None, rev_usd=None),
                                                 item("A", price=2.0, qty=3, rev_usd=6.0)]),
            ev("purchase", "v", 2, sid=1, items=[item("A", price=1.0, qty=1, rev_usd=None), item(None)])]
    r = marts.product_performance(product_events(stg(spark, rows))).first()
    # revenue falls back to unit price, not price x quantity; quantity defaults to 1
    assert (r.purchase_event_count, r.total_units_sold, r.unique_purchasers, r.purchase_sessions) == (3, 5, 2, 2)
    assert r.total_item_revenue_usd == 11.0 and r.avg_revenue_per_unit_usd == 11.0 / 5


def test_segments_null_and_literal_none_are_two_rows(spark):
    rows = [ev("page_view", "a", 1, medium=None), ev("page_view", "b", 1, medium="(none)"),
            ev("purchase", "b", 2, usd=3.0, ecom_txn="t")]
    s = stg(spark, rows)
    se = sessions(s)
    seg = marts.segment_performance(se, users(se)).where(F.col("segment_type") == "acquisition_medium").collect()
    assert sorted(r.segment_value for r in seg) == ["(none)", "(none)"]
    assert sorted(r.purchasers for r in seg) == [0, 1]


def test_kpis_drop_order_days_without_sessions(spark):
    rows = [ev("page_view", "a", 1, day="20240101"),
            ev("purchase", "b", 1, sid=None, day="20240102", ecom_txn="t", usd=2.0)]  # order, no session
    s = stg(spark, rows)
    k = marts.kpis_daily(sessions(s), orders(s)).collect()
    assert [r.report_date for r in k] == [dt.date(2024, 1, 1)]
    assert k[0].total_orders == 0 and k[0].avg_order_value_usd is None


def test_fused_and_joined_funnel_paths_agree(spark):
    rows = [ev(n, u, t, sid=sid, device=d) for (n, u, t, sid, d) in [
        ("view_item", "a", 1, 1, "mobile"), ("add_to_cart", "a", 2, 1, "desktop"),
        ("view_item", "b", 1, 1, None), ("page_view", "c", 1, 2, "tablet")]]
    s = stg(spark, rows)
    fused = sorted(tuple(r) for r in marts.funnel_performance(session_facts(s)).collect())
    joined = sorted(tuple(r) for r in marts.funnel_performance(session_funnel(s), sessions(s)).collect())
    assert fused == joined


def test_retention_single_week_and_gaps(spark):
    df = spark.createDataFrame(
        [("u1", "s1", dt.date(2024, 1, 1)), ("u1", "s2", dt.date(2024, 1, 16)), ("u2", "s3", dt.date(2024, 1, 2))],
        "user_pseudo_id string, session_key string, session_date date")
    r = [(x.activity_week_index, x.cohort_size, x.retained_users, x.retention_rate)
         for x in marts.retention_cohorts(df).collect()]
    assert r == [(0, 2, 2, 1.0), (2, 2, 1, 0.5)]       # week 1 absent, not zero


def test_rfm_fewer_purchasers_than_tiles(spark):
    df = spark.createDataFrame([("a", dt.date(2024, 1, 1), "u1", 5.0), ("b", dt.date(2024, 1, 3), "u2", 1.0)],
                               "order_transaction_key string, order_date date, user_pseudo_id string, "
                               "order_revenue_usd double")
    r = {x.user_pseudo_id: x for x in marts.customer_rfm(df).collect()}
    assert (r["u1"].recency_days, r["u2"].recency_days) == (2, 0)
    assert (r["u1"].r_score, r["u2"].r_score) == (1, 2)      # recency desc: most recent scores highest
    assert (r["u1"].m_score, r["u2"].m_score) == (2, 1)


def test_normalize_first_merges_null_and_literal_label(spark):
    rows = [ev("page_view", "a", 1, medium=None, device=None), ev("page_view", "b", 1, medium="(none)", device="unknown")]
    s = stg(spark, rows)
    se = sessions(s)
    seg = marts.segment_performance(se, users(se), normalize_first=True)
    med = [r for r in seg.collect() if r.segment_type == "acquisition_medium"]
    assert [(r.segment_value, r.unique_users) for r in med] == [("(none)", 2)]
    f = marts.funnel_performance(session_facts(s), normalize_first=True).collect()
    assert [(r.device_category, r.sessions_entered) for r in f] == [("unknown", 2)]
    assert len(marts.funnel_performance(session_facts(s), normalize_first=False).collect()) == 2


def test_retention_invariants_on_orders_fixture(spark):
    from conftest import SF_CHECK
    import __spark_entry__ as entry
    r = entry.queries()["retention_cohorts"](spark, SF_CHECK)
    week0 = r.where("activity_week_index = 0").collect()
    assert week0 and all(x.retention_rate == 1.0 and x.retained_users == x.cohort_size for x in week0)
    assert r.where("retained_users > cohort_size OR activity_week_index < 0").count() == 0


def test_segment_methods_agree(spark):
    from conftest import SF_SMALL
    import funnelworks.queries as q
    se = sessions(q.stg(spark, SF_SMALL))
    u = users(se)
    runs = [sorted(tuple(r) for r in marts.segment_performance(se, users_, method=m).collect())
            for users_ in (u, None) for m in ("stack", "grouping_sets")]
    assert all(r == runs[0] for r in runs) and len(runs[0]) > 4


def test_retention_zero_fill(spark):
    df = spark.createDataFrame(
        [("u1", "s1", dt.date(2024, 1, 1)), ("u1", "s2", dt.date(2024, 1, 16)), ("u2", "s3", dt.date(2024, 1, 9))],
        "user_pseudo_id string, session_key string, session_date date")
    r = [(x.cohort_week.isoformat(), x.activity_week_index, x.retained_users, x.retention_rate)
         for x in marts.retention_cohorts(df, zero_fill=True).collect()]
    assert r == [("2024-01-01", 0, 1, 1.0), ("2024-01-01", 1, 0, 0.0), ("2024-01-01", 2, 1, 1.0),
                 ("2024-01-08", 0, 1, 1.0), ("2024-01-08", 1, 0, 0.0)]
    plain = marts.retention_cohorts(df).collect()
    assert [(x.activity_week_index, x.retained_users) for x in plain] == [(0, 1), (2, 1), (0, 1)]


def test_global_filter_rules(spark):
    from funnelworks.plans.insights import apply_filters
    df = spark.createDataFrame(
        [(dt.date(2024, 1, 1), "mobile", "cpc"), (dt.date(2024, 1, 2), None, "organic"),
         (dt.date(2024, 1, 3), "desktop", None)],
        "report_date date, device_category string, acquisition_medium string")
    assert apply_filters(df, "2024-01-02", "2024-01-03").count() == 2            # inclusive range
    assert apply_filters(df, devices=["mobile", "desktop"]).count() == 2         # NULL never selected
    assert apply_filters(df, devices=[]).count() == 0                            # empty selection
    assert apply_filters(df, mediums=["cpc"]).count() == 1
    no_dims = df.select("report_date")
    assert apply_filters(no_dims, devices=[], mediums=[]).count() == 3           # absent columns do not filter


def test_funnel_with_custom_steps(spark):
    rows = [ev("view_search_results", "a", 1), ev("view_item", "a", 2), ev("purchase", "a", 3),
            ev("view_item", "b", 1, sid=2), ev("view_search_results", "b", 2, sid=2)]
    f = session_funnel(stg(spark, rows), steps=("view_search_results", "view_item", "purchase"),
                       labels=("search", "view", "purchase"))
    assert "reached_view_item_after_search" in f.columns and "reached_purchase_after_view" in f.columns
    got = {r.session_key: (r.reached_view_search_results, r.reached_view_item_after_search,
                           r.reached_purchase_after_view) for r in f.collect()}
    assert got == {"a-1": (True, True, True), "b-2": (True, False, False)}
