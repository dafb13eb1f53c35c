"""Registered queries: (spark, sf_dir) -> DataFrame over the whole generated tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelworks.operators.orders import orders as _orders
from funnelworks.operators.products import product_events as _product_events
from funnelworks.operators.sessions import session_facts as _session_facts
from funnelworks.operators.sessions import session_funnel as _session_funnel
from funnelworks.operators.sessions import sessions as _sessions
from funnelworks.operators.sessions import users as _users
from funnelworks.operators.staging import stage_events as _stage_events
from funnelworks.plans import experiment as _ab
from funnelworks.plans import export as _export
from funnelworks.plans import insights as _ins
from funnelworks.plans import marts
from funnelworks.plans import quality as _qual
from funnelworks.session import BASE_CONF
from funnelworks.sources import fixtures
from funnelworks.sources.events import load_mart, read_experiment_csv, scan_events
from funnelworks.sources.sinks import write_experiment_tables

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(fn):
    REGISTRY[fn.__name__] = fn
    return fn


def _prepare(spark: SparkSession) -> None:
    for k, v in BASE_CONF.items():
        if k != "spark.ui.enabled":
            spark.conf.set(k, v)


def stg(spark: SparkSession, sf_dir: str) -> DataFrame:
    _prepare(spark)
    return _stage_events(fixtures.raw_events_from(spark, sf_dir))


@register
def stage_events(spark, sf_dir):
    """M-1, EXP-1...6: flattened events (scalar columns; items kept by the model)."""
    return stg(spark, sf_dir).drop("items")


@register
def sessions(spark, sf_dir):
    """M-2."""
    return _sessions(stg(spark, sf_dir))


@register
def session_funnel(spark, sf_dir):
    """M-5."""
    return _session_funnel(stg(spark, sf_dir))


@register
def funnel_performance(spark, sf_dir):
    """M-8 on the fused path (sessions + funnel in one groupBy)."""
    return marts.funnel_performance(_session_facts(stg(spark, sf_dir)))


def sess(spark, sf_dir):
    return _sessions(stg(spark, sf_dir))


@register
def users(spark, sf_dir):
    """M-3."""
    return _users(sess(spark, sf_dir))


@register
def orders(spark, sf_dir):
    """M-4."""
    return _orders(stg(spark, sf_dir))


@register
def product_events(spark, sf_dir):
    """M-6."""
    return _product_events(stg(spark, sf_dir))


@register
def kpis_daily(spark, sf_dir):
    """M-7."""
    s = stg(spark, sf_dir)
    return marts.kpis_daily(_sessions(s), _orders(s))


@register
def segment_performance(spark, sf_dir):
    """M-11."""
    return marts.segment_performance(sess(spark, sf_dir))


@register
def product_performance(spark, sf_dir):
    """M-12."""
    return marts.product_performance(_product_events(stg(spark, sf_dir)))


def retention_input(spark, sf_dir):
    _prepare(spark)
    return fixtures.retention_sessions(fixtures.table(spark, sf_dir, "orders"))


@register
def retention_cohorts(spark, sf_dir):
    """M-9 on F2."""
    return marts.retention_cohorts(retention_input(spark, sf_dir))


def rfm_input(spark, sf_dir):
    _prepare(spark)
    return fixtures.rfm_orders(fixtures.table(spark, sf_dir, "orders"))


@register
def customer_rfm(spark, sf_dir):
    """M-10 on F3."""
    return marts.customer_rfm(rfm_input(spark, sf_dir))


# ------------------------------------------------------------ findings / dashboard (INS-*, FLT-13)

FILTER_WINDOW = ("2024-01-08", "2024-01-21")
FILTER_DEVICES = ("desktop", "mobile")


def kpis(spark, sf_dir):
    return kpis_daily(spark, sf_dir)


def funnel_mart(spark, sf_dir):
    return funnel_performance(spark, sf_dir)


@register
def kpi_totals(spark, sf_dir):
    """INS-1."""
    return _ins.kpi_totals(kpis(spark, sf_dir))


@register
def week_over_week(spark, sf_dir):
    """INS-2 (+ INS-3 trend column)."""
    return _ins.week_over_week(kpis(spark, sf_dir))


@register
def trend_class(spark, sf_dir):
    """INS-3."""
    return _ins.trend_class(kpis(spark, sf_dir))


@register
def peak_week(spark, sf_dir):
    """INS-4, WIN-5."""
    return _ins.peak_week(kpis(spark, sf_dir))


@register
def funnel_total(spark, sf_dir):
    """INS-5, RSH-3."""
    return _ins.funnel_total(funnel_mart(spark, sf_dir))


@register
def largest_drop(spark, sf_dir):
    """INS-6."""
    return _ins.largest_drop(funnel_mart(spark, sf_dir))


@register
def funnel_by_device(spark, sf_dir):
    """INS-7, RSH-1."""
    return _ins.funnel_by_device(funnel_mart(spark, sf_dir))


@register
def segment_compare(spark, sf_dir):
    """INS-8, FLT-8."""
    return _ins.segment_compare(segment_performance(spark, sf_dir))


@register
def rfm_distribution(spark, sf_dir):
    """INS-9."""
    return _ins.rfm_distribution(customer_rfm(spark, sf_dir))


@register
def retention_curve(spark, sf_dir):
    """INS-10."""
    return _ins.retention_curve(retention_cohorts(spark, sf_dir))


@register
def retention_matrix(spark, sf_dir):
    """INS-11, AGG-15, RSH-2."""
    return _ins.retention_matrix(retention_cohorts(spark, sf_dir))


@register
def retention_stabilization(spark, sf_dir):
    """INS-12, WIN-6, WIN-7."""
    return _ins.retention_stabilization(retention_cohorts(spark, sf_dir))


@register
def cohort_sizes(spark, sf_dir):
    """INS-13."""
    return _ins.cohort_sizes(retention_cohorts(spark, sf_dir))


@register
def week1_retention(spark, sf_dir):
    """INS-14."""
    return _ins.week1_retention(retention_cohorts(spark, sf_dir))


@register
def revenue_concentration(spark, sf_dir):
    """INS-15, WIN-3, WIN-4."""
    return _ins.revenue_concentration(customer_rfm(spark, sf_dir))


@register
def top_decile_share(spark, sf_dir):
    """INS-15 (top 10 % share)."""
    return _ins.top_decile_share(_ins.revenue_concentration(customer_rfm(spark, sf_dir)))


@register
def top_products(spark, sf_dir):
    """INS-16, SRT-5."""
    return _ins.top_products(product_performance(spark, sf_dir), 20)


@register
def cart_abandonment(spark, sf_dir):
    """INS-17."""
    return _ins.cart_abandonment(funnel_mart(spark, sf_dir))


@register
def repeat_rate(spark, sf_dir):
    """INS-18."""
    return _ins.repeat_rate(users(spark, sf_dir))


@register
def ltv_proxy(spark, sf_dir):
    """INS-19."""
    return _ins.ltv_proxy(users(spark, sf_dir))


@register
def filtered_kpis(spark, sf_dir):
    """FLT-13: global date / device filter on the funnel mart."""
    return _ins.apply_filters(funnel_mart(spark, sf_dir), FILTER_WINDOW[0], FILTER_WINDOW[1],
                              devices=list(FILTER_DEVICES))


# ------------------------------------------------------------ data quality (Q-*), extracts (X-*)


def raw(spark, sf_dir):
    _prepare(spark)
    return fixtures.raw_events_from(spark, sf_dir)


def all_marts(spark, sf_dir) -> dict:
    s = stg(spark, sf_dir)
    facts = _session_facts(s)
    se, od = _sessions(s), _orders(s)
    return {
        "mart_product_kpis_daily": marts.kpis_daily(se, od),
        "mart_funnel_performance": marts.funnel_performance(facts),
        "mart_retention_cohorts": retention_cohorts(spark, sf_dir),
        "mart_customer_rfm": customer_rfm(spark, sf_dir),
        "mart_segment_performance": marts.segment_performance(se),
        "mart_product_performance": marts.product_performance(_product_events(s)),
    }


@register
def source_coverage(spark, sf_dir):
    """Q-1."""
    return _qual.source_coverage(raw(spark, sf_dir))


@register
def event_inventory(spark, sf_dir):
    """Q-2."""
    return _qual.event_inventory(raw(spark, sf_dir))


@register
def null_profile(spark, sf_dir):
    """Q-3."""
    return _qual.null_profile(raw(spark, sf_dir))


@register
def dup_transactions(spark, sf_dir):
    """Q-4, SRT-3."""
    return _qual.dup_transactions(raw(spark, sf_dir))


@register
def mart_row_counts(spark, sf_dir):
    """Q-5."""
    return _qual.mart_row_counts(spark, all_marts(spark, sf_dir))


@register
def reconciliation(spark, sf_dir):
    """Q-6, JN-8."""
    s = stg(spark, sf_dir)
    return _qual.reconciliation(s, _orders(s))


@register
def purchase_profile(spark, sf_dir):
    """Q-7."""
    return _qual.purchase_profile(raw(spark, sf_dir))


@register
def session_crosscheck(spark, sf_dir):
    """Q-8, SET-2."""
    s = stg(spark, sf_dir)
    se = _sessions(s)
    return _qual.session_crosscheck(se, marts.kpis_daily(se, _orders(s)))


def built_tables(spark, sf_dir) -> dict:
    """Every model of M-13 written to a fresh folder under the checkpoint dir."""
    from funnelworks.plans.build import build_all as _build
    _prepare(spark)
    out = shared(spark, "build")
    return _build(spark, raw(spark, sf_dir), out)


def shared(spark, name: str) -> str:
    """A new folder in the session's shared folder."""
    import uuid

    from funnelworks.session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


SCAN_RANGE = ("20240105", "20240114")


@register
def scan_range(spark, sf_dir):
    """SRC-1, FLT-1: raw events stored by date, an inclusive date range scanned from them."""
    path = shared(spark, "raw-events")
    raw(spark, sf_dir).hint("rebalance", "event_date").write.partitionBy("event_date").parquet(path)
    return _qual.event_inventory(_stage_events(scan_events(spark, path, *SCAN_RANGE)))


def extracted(spark, sf_dir) -> str:
    path = shared(spark, "extracts")
    _export.write_extracts(spark, all_marts(spark, sf_dir), path, source_dataset="generated", disclosure="generated tables")
    return path


@register
def extract_counts(spark, sf_dir):
    """SNK-2, SNK-3, SRC-4: marts written as extracts, counted where they are found and listed in the metadata."""
    path = extracted(spark, sf_dir)
    listed = spark.read.json(f"{path}/metadata").select(F.explode("tables_exported").alias("mart"), "source_dataset", "dataset_disclosure")
    return _qual.mart_row_counts(spark, base=path).join(listed, "mart")


@register
def load_extract(spark, sf_dir):
    """SRC-3: the segment mart loaded by name from its extract."""
    path = shared(spark, "extract")
    _export.write_extracts(spark, {"mart_segment_performance": segment_performance(spark, sf_dir)}, path)
    return load_mart(spark, "mart_segment_performance", "static", path)


@register
def experiment_csv(spark, sf_dir):
    """SRC-5: experiment units written as CSV and read with the declared schema."""
    path = shared(spark, "units")
    units(spark, sf_dir).write.option("header", True).csv(path)
    return _ab.variant_metrics(read_experiment_csv(spark, path), median=False)


@register
def experiment_tables(spark, sf_dir):
    """SNK-4: the guardrail table as it is written beside the summary."""
    path, u = shared(spark, "experiment"), units(spark, sf_dir)
    write_experiment_tables(_ab.summary(u), _ab.guardrails(u), path)
    return spark.read.parquet(f"{path}/guardrails_by_variant")


@register
def schema_checks(spark, sf_dir):
    """Q-9 on the built models (as the schema tests run after a build); retention and
    RFM marts are checked on the F2 / F3 inputs."""
    models = built_tables(spark, sf_dir)
    models["mart_retention_cohorts"] = retention_cohorts(spark, sf_dir)
    models["mart_customer_rfm"] = customer_rfm(spark, sf_dir)
    return _qual.schema_checks(models)


@register
def negative_revenue(spark, sf_dir):
    """Q-10."""
    return _qual.negative_revenue(orders(spark, sf_dir))


@register
def funnel_consistency(spark, sf_dir):
    """Q-11, SRT-4."""
    return _qual.funnel_consistency(session_funnel(spark, sf_dir))


@register
def missing_dates(spark, sf_dir):
    """Q-12 (calendar gaps)."""
    return _qual.missing_dates(stg(spark, sf_dir))


@register
def quality_checklist(spark, sf_dir):
    """Q-12 (checklist thresholds)."""
    return _qual.quality_checklist(stg(spark, sf_dir))


@register
def safe_extract(spark, sf_dir):
    """X-1...X-3 on the segment mart (labels such as '(none)' are cleaned)."""
    return _export.safe_extract(segment_performance(spark, sf_dir))


@register
def safe_extract_rfm(spark, sf_dir):
    """X-1 on the RFM mart (user id dropped)."""
    return _export.safe_extract(customer_rfm(spark, sf_dir))


# ------------------------------------------------------------ experiment analysis (AB-*)

EXPERIMENT_ID = "exp_checkout"


def units(spark, sf_dir):
    _prepare(spark)
    return fixtures.experiment_units(fixtures.table(spark, sf_dir, "orders"))


def exp_events(spark, sf_dir):
    _prepare(spark)
    return fixtures.experiment_events(fixtures.table(spark, sf_dir, "events"), EXPERIMENT_ID)


@register
def ab_validity(spark, sf_dir):
    """AB-1."""
    return _ab.validity(units(spark, sf_dir))


@register
def ab_srm(spark, sf_dir):
    """AB-2; the p-value to ten places."""
    return _ab.srm(units(spark, sf_dir)).withColumn("p_value", F.round("p_value", 10))


@register
def ab_metrics(spark, sf_dir):
    """AB-3, AGG-12."""
    return _ab.variant_metrics(units(spark, sf_dir))


@register
def ab_lift(spark, sf_dir):
    """AB-4."""
    return _ab.analysis(units(spark, sf_dir)).select(
        "experiment_id", "cvr_control", "cvr_treatment", "absolute_lift", "relative_lift")


@register
def ab_interval(spark, sf_dir):
    """AB-5 (z statistic) and AB-6 (difference of per-arm normal intervals)."""
    return _ab.analysis(units(spark, sf_dir)).select("experiment_id", "z_stat", "diff_ci_low", "diff_ci_high")


@register
def ab_ztest(spark, sf_dir):
    """AB-5; the two-sided p-value to ten places."""
    return _ab.ztest(units(spark, sf_dir)).withColumn("p_value", F.round("p_value", 10))


@register
def ab_power(spark, sf_dir):
    """AB-7."""
    return _ab.analysis(units(spark, sf_dir)).select("experiment_id", "cvr_control", "required_n_per_arm")


@register
def ab_decision(spark, sf_dir):
    """AB-8."""
    return _ab.analysis(units(spark, sf_dir)).select("experiment_id", "absolute_lift", "diff_ci_low",
                                                     "diff_ci_high", "decision", "reason")


@register
def ab_summary(spark, sf_dir):
    """AB-9 summary table; the p-value to ten places."""
    return _ab.summary(units(spark, sf_dir)).withColumn("p_value", F.round("p_value", 10))


@register
def ab_guardrails(spark, sf_dir):
    """AB-9 guardrail table."""
    return _ab.guardrails(units(spark, sf_dir))


@register
def ab_histogram(spark, sf_dir):
    """AB-10, AGG-17."""
    return _ab.revenue_histogram(units(spark, sf_dir))


@register
def ab_eligible(spark, sf_dir):
    """AB-11: first checkout on mobile, not yet exposed."""
    return _ab.eligible_users(stg(spark, sf_dir), exp_events(spark, sf_dir).where(
        F.col("event_name") == _ab.EXPOSURE_EVENT), EXPERIMENT_ID)


@register
def ab_assign(spark, sf_dir):
    """AB-12: persistent hash assignment of every first-checkout-on-mobile user."""
    return _ab.assign(_ab.eligible_users(stg(spark, sf_dir)), EXPERIMENT_ID)


@register
def ab_attribution(spark, sf_dir):
    """AB-13."""
    return _ab.attribution(exp_events(spark, sf_dir))


@register
def ab_exposure_once(spark, sf_dir):
    """AB-14."""
    return _ab.exposure_counts(exp_events(spark, sf_dir))


@register
def ab_missing_exposure(spark, sf_dir):
    """AB-15."""
    return _ab.missing_exposure(exp_events(spark, sf_dir))


@register
def ab_contamination(spark, sf_dir):
    """AB-16."""
    return _ab.contamination(exp_events(spark, sf_dir))


@register
def ab_duration(spark, sf_dir):
    """AB-17."""
    return _ab.checkout_duration(session_funnel(spark, sf_dir))


# ------------------------------------------------------------ M-13
@register
def build_all(spark, sf_dir):
    """M-13: build every model into the shared folder; returns the mart row counts (Q-5)."""
    t = built_tables(spark, sf_dir)
    return _qual.mart_row_counts(spark, {k: v for k, v in t.items() if k.startswith("mart_")})


@register
def filter_options(spark, sf_dir):
    """SRT-7: device options of the global filter, from the funnel mart."""
    return _ins.filter_options(funnel_mart(spark, sf_dir), "device_category")
