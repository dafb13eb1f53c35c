"""Extracts, sinks, the full build and incremental staging."""

import json
import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from funnelworks.plans import export, quality
from funnelworks.plans.build import build_all
from funnelworks.sources import fixtures
from funnelworks.sources.events import load_mart, table_exists
from funnelworks.streaming import stage_incrementally


def test_safe_extract_drops_and_cleans(spark):
    df = spark.createDataFrame([("u", "(none)", "x", "(not set)", 1)],
                               "User_Pseudo_Id string, medium string, Token string, city string, n int")
    out = export.safe_extract(df)
    assert out.columns == ["medium", "city", "n"]
    assert tuple(out.first()) == ("Direct", "Unknown", 1)
    assert quality.privacy_check({"t": out}).count() == 0
    assert quality.privacy_check({"t": df}).count() == 2


def test_build_all_and_extracts(spark, tmp_dir):
    t = build_all(spark, fixtures.raw_events_from(spark, SF_SMALL), f"{tmp_dir}/warehouse")
    for name in ("stg_ga4_events", "int_sessions", "int_users", "int_orders", "int_session_funnel",
                 "int_product_events", "mart_product_kpis_daily", "mart_customer_rfm"):
        assert table_exists(spark, name, f"{tmp_dir}/warehouse"), name
    assert os.path.isdir(f"{tmp_dir}/warehouse/stg_ga4_events/event_date=20240101")
    marts = {k: v for k, v in t.items() if k.startswith("mart_")}
    meta = export.write_extracts(spark, marts, f"{tmp_dir}/extracts", disclosure="public sample").first()
    assert meta.dataset_disclosure == "public sample" and meta.export_timestamp_utc
    for name in marts:
        ext = load_mart(spark, name, "static", f"{tmp_dir}/extracts")
        assert not {c.lower() for c in ext.columns} & set(export.FORBIDDEN_COLUMNS)
    files = os.listdir(f"{tmp_dir}/extracts/metadata")
    rec = json.loads(open(f"{tmp_dir}/extracts/metadata/" + [f for f in files if f.endswith(".json")][0]).readline())
    assert {"export_timestamp_utc", "dataset_disclosure"} <= set(rec)
    counts = {r.mart: r.row_count for r in quality.mart_row_counts(spark, base=f"{tmp_dir}/extracts").collect()}
    assert all(v is not None and v > 0 for v in counts.values())
    missing = quality.mart_row_counts(spark, base=f"{tmp_dir}/nothing").collect()
    assert {r.status for r in missing} == {"missing"}


def test_load_mart_rejects_bad_mode(spark):
    import pytest
    with pytest.raises(ValueError):
        load_mart(spark, "x", "warehouse-xyz")


def test_incremental_staging_is_exactly_once(spark, tmp_dir):
    raw = fixtures.raw_events_from(spark, SF_SMALL)
    raw.where(F.col("event_date") <= "20240110").write.partitionBy("event_date").parquet(f"{tmp_dir}/raw")
    stage_incrementally(spark, f"{tmp_dir}/raw", f"{tmp_dir}/stg", f"{tmp_dir}/ckpt")
    n1 = spark.read.parquet(f"{tmp_dir}/stg").count()
    raw.where(F.col("event_date") > "20240110").write.mode("append").partitionBy("event_date") \
        .parquet(f"{tmp_dir}/raw")
    stage_incrementally(spark, f"{tmp_dir}/raw", f"{tmp_dir}/stg", f"{tmp_dir}/ckpt")
    stage_incrementally(spark, f"{tmp_dir}/raw", f"{tmp_dir}/stg", f"{tmp_dir}/ckpt")   # nothing new
    assert spark.read.parquet(f"{tmp_dir}/stg").count() == raw.count() > n1


def test_view_materialization(spark):
    from funnelworks.sources.sinks import as_view
    as_view(spark.range(3), "fw_view_test")
    assert spark.sql("SELECT count(*) AS n FROM fw_view_test").first().n == 3


def test_build_from_partitioned_scan_matches_lazy_models(spark, tmp_dir):
    from funnelworks.operators.orders import orders
    from funnelworks.operators.products import product_events
    from funnelworks.operators.sessions import session_facts, sessions
    from funnelworks.operators.staging import stage_events
    from funnelworks.plans import marts
    from funnelworks.sources.events import scan_events

    raw = fixtures.raw_events_from(spark, SF_SMALL)
    raw.write.partitionBy("event_date").parquet(f"{tmp_dir}/raw")
    t = build_all(spark, scan_events(spark, f"{tmp_dir}/raw", "20240103", "20240120"), f"{tmp_dir}/wh")
    stg = stage_events(raw, "20240103", "20240120")
    se = sessions(stg)
    lazy = {
        "mart_product_kpis_daily": marts.kpis_daily(se, orders(stg)),
        "mart_funnel_performance": marts.funnel_performance(session_facts(stg)),
        "mart_retention_cohorts": marts.retention_cohorts(se),
        "mart_customer_rfm": marts.customer_rfm(orders(stg)),
        "mart_segment_performance": marts.segment_performance(se),
        "mart_product_performance": marts.product_performance(product_events(stg)),
    }
    key = lambda r: tuple((x is None, str(x)) for x in r)
    for name, df in lazy.items():
        cols = df.columns
        a = sorted((tuple(r) for r in t[name].select(*cols).collect()), key=key)
        b = sorted((tuple(r) for r in df.collect()), key=key)
        assert a == b and len(a) > 0, name
