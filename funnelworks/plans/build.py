"""M-13 ``build_all``: every model in dependency order, tables overwritten.

Staging is written once, projected and partitioned by ``event_date`` (the
reference re-flattens raw events for each of its four readers); sessions
and the funnel come from one aggregation; each model is read back from its
written table, so the next model starts from stored data.

Models whose inputs are ready are written concurrently (one Spark job per
thread): the small marts cannot fill a cluster alone, and independent jobs
share it instead of queueing.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from funnelworks.operators.orders import orders
from funnelworks.operators.products import product_events
from funnelworks.operators.sessions import session_facts, users
from funnelworks.operators.staging import stage_events
from funnelworks.plans import marts
from funnelworks.sources.schema import FUNNEL_COLUMNS, SESSION_COLUMNS
from funnelworks.sources.sinks import as_table, drop_folder


def build_all(spark: SparkSession, raw: DataFrame, out_dir: str, start: str | None = None,
              end: str | None = None, max_parallel: int = 8) -> dict[str, DataFrame]:
    """Build staging, intermediates and marts under ``out_dir`` (a shared folder)."""
    base = out_dir.rstrip("/")
    t: dict[str, DataFrame] = {}

    def wave(jobs: dict) -> None:
        """Write each (name -> (DataFrame builder, partition columns)) concurrently."""
        def one(item):
            name, (make, parts) = item
            return name, as_table(make(), f"{base}/{name}", parts)
        with ThreadPoolExecutor(max_workers=max(1, min(max_parallel, len(jobs)))) as pool:
            t.update(dict(pool.map(one, jobs.items())))

    # A date's events meet in few tasks before they are written; AQE splits large dates.
    wave({"stg_ga4_events": (lambda: stage_events(raw, start, end).hint("rebalance", "event_date"), ["event_date"])})
    wave({
        "_session_facts": (lambda: session_facts(t["stg_ga4_events"]), None),
        "int_orders": (lambda: orders(t["stg_ga4_events"]), None),
        "int_product_events": (lambda: product_events(t["stg_ga4_events"]), None),
    })
    # Everything else reads the stored facts, orders and item events: one concurrent wave.
    # The session columns of the facts table are exactly int_sessions.
    facts = t["_session_facts"]
    sess = facts.select(*SESSION_COLUMNS)
    wave({
        "int_sessions": (lambda: sess, None),
        "int_session_funnel": (lambda: facts.select(*FUNNEL_COLUMNS), None),
        "int_users": (lambda: users(sess), None),
        "mart_funnel_performance": (lambda: marts.funnel_performance(facts), None),
        "mart_product_kpis_daily": (lambda: marts.kpis_daily(sess, t["int_orders"]), None),
        "mart_retention_cohorts": (lambda: marts.retention_cohorts(sess), None),
        "mart_customer_rfm": (lambda: marts.customer_rfm(t["int_orders"]), None),
        "mart_segment_performance": (lambda: marts.segment_performance(sess), None),
        "mart_product_performance": (lambda: marts.product_performance(t["int_product_events"]), None),
    })
    t.pop("_session_facts")
    drop_folder(spark, f"{base}/_session_facts")    # its two halves are stored as int_sessions and int_session_funnel
    return t
