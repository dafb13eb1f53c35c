"""Whole tables, shared folders, lazy analysis, wide sums, zero counts, spread hot users."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from funnelworks import session
from funnelworks.functions.metrics import count_when, money_sum
from funnelworks.functions.stats import erfc
from funnelworks.plans import experiment, insights
from funnelworks.sources import fixtures
from funnelworks.sources.events import scan_events


def test_retention_fixture_keeps_every_order(spark):
    orders = fixtures.table(spark, SF_SMALL, "orders")
    assert fixtures.retention_sessions(orders).count() == orders.count()


def test_scan_reads_all_dates_unless_told_otherwise(spark, tmp_dir):
    raw = fixtures.raw_events_from(spark, SF_SMALL)
    raw.write.partitionBy("event_date").parquet(f"{tmp_dir}/raw")
    assert scan_events(spark, f"{tmp_dir}/raw").count() == raw.count()


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[3,2,1024]"])
def test_no_machine_local_folder_on_a_cluster(master):
    class Nothing:
        def isDefined(self):
            return False

    class Context:
        def __init__(self):
            self.master = master
            self._jsc = self
            self.sparkContext = self

        def sc(self):
            return self

        def getCheckpointDir(self):
            return Nothing()

        def getConf(self):
            return {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Context())


def test_analysis_without_median_starts_no_job(spark):
    units = fixtures.experiment_units(fixtures.table(spark, SF_SMALL, "orders"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("analysis", "none expected")
    out = experiment.analysis(units)
    assert list(tracker.getJobIdsForGroup("analysis")) == []
    assert "median_duration_control" not in out.columns
    spark.sparkContext.setJobGroup("", "")


def test_money_sums_beyond_64_bits(spark):
    d = spark.createDataFrame([(9e12,), (9e12,), (0.25,), (None,)], "v double")
    assert d.agg(money_sum("v").alias("s")).first().s == 18e12 + 0.25


def test_counts_are_zero_without_rows(spark):
    d = spark.createDataFrame([], "a int")
    assert d.agg(count_when(F.col("a") > 0).alias("n")).first().n == 0
    users = spark.createDataFrame([], "user_pseudo_id string, is_purchaser boolean, order_count long, total_revenue_usd double")
    assert insights.repeat_rate(users).first().purchasers == 0
    assert insights.ltv_proxy(users).first().purchasers == 0


def test_erfc_equals_the_standard_library(spark):
    xs = [0.0, 1e-9, 0.1, 0.5, 1.0, 1.9, 2.4999, 2.5, 3.0, 4.5, 6.0, 9.0, 20.0]
    got = spark.createDataFrame([(x,) for x in [*xs, None]], "x double").select("x", erfc(F.col("x")).alias("y")).collect()
    for r in got:
        assert r.y is None if r.x is None else r.y == pytest.approx(math.erfc(r.x), rel=1e-11, abs=1e-16)


def test_attribution_spreads_a_hot_user(spark):
    """One user has 90 % of the outcomes; no reduce task of the join reads much more than its share."""
    n = 20_000
    events = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "purchase").when(F.col("id") % 3 == 1, "refund_or_cancelled").otherwise("checkout_completed").alias("event_name"),
        F.lit("e").alias("experiment_id"), F.lit(None).cast("string").alias("variant"),
        F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("u"), F.col("id") % 500)).alias("user_pseudo_id"),
        (F.col("id") + 10).alias("event_timestamp"), F.concat(F.lit("t"), "id").alias("transaction_id"), F.lit(1.0).alias("revenue_usd"),
        F.lit(30.0).alias("checkout_duration_seconds"))
    users = events.select("user_pseudo_id").distinct().select(
        F.lit(experiment.EXPOSURE_EVENT).alias("event_name"), F.lit("e").alias("experiment_id"), F.lit("control").alias("variant"),
        "user_pseudo_id", F.lit(0).cast("long").alias("event_timestamp"), F.lit(None).cast("string").alias("transaction_id"),
        F.lit(None).cast("double").alias("revenue_usd"), F.lit(None).cast("double").alias("checkout_duration_seconds"))
    r = experiment.attribution(users.unionByName(events)).first()
    third = -(-n // 3)
    assert (r.purchases, r.refunds, r.avg_checkout_duration_seconds) == (third, (n - third + 1) // 2, 30.0)
    assert r.refund_rate == pytest.approx(r.refunds / r.purchases)
    salt = F.pmod(F.xxhash64("event_timestamp", "event_name", "transaction_id"), F.lit(16))
    parts = [x["count"] for x in events.where("user_pseudo_id = 'hot'").groupBy(salt.alias("s")).count().collect()]
    assert len(parts) == 16 and max(parts) < 1.3 * min(parts)
