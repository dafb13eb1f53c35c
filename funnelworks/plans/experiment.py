"""A/B experiment analysis as grouped Spark jobs (AB-1...AB-17).

Everything is keyed by ``experiment_id`` (and variant), so any number of
experiments and any number of units run in one pass: unit-level data is
aggregated map-side into one row per (experiment, variant) before anything
else happens; tests and decisions are column expressions over those rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelworks.functions.metrics import count_when, money, money_sum, safe_divide
from funnelworks.functions.stats import chi2_1df_p, two_sided_p, z_quantile
from funnelworks.operators.global_rank import grouped_median

# Fixed values of the analysis.
ALPHA = 0.05
POWER = 0.80
MIN_PRACTICAL_LIFT = 0.005
MAX_PAYMENT_ERROR_INC = 0.002
MAX_REFUND_INC = 0.002
SRM_P_THRESHOLD = 0.001
VARIANTS = ("control", "treatment")
DECISION_REASONS = {
    "Ship": "Primary metric significantly improved beyond MDE. Guardrails hold.",
    "Iterate": "Conversion improved, but guardrails were harmed. Iterate on the design.",
    "Stop": "Treatment significantly harmed conversion.",
    "Inconclusive": "Insufficient evidence to ship. Consider running longer if business case warrants.",
}
HISTOGRAM_BINS = 50
EXPOSURE_EVENT = "experiment_impression"

Z_ALPHA = z_quantile(1 - ALPHA / 2)
Z_POWER = z_quantile(POWER)


def _c(name: str) -> Column:
    return F.col(name)


# ------------------------------------------------------------ AB-1
def validity(units: DataFrame) -> DataFrame:
    """Per experiment: the unit-table checks (each ``True`` when it holds)."""
    # "not exactly one variant" = no variant, or min != max: one shuffle, no distinct count
    per_user = (units.groupBy("experiment_id", "user_id")
                .agg(F.min("variant").alias("v0"), F.max("variant").alias("v1"))
                .groupBy("experiment_id")
                .agg(count_when(F.col("v0").isNull() | (F.col("v0") != F.col("v1"))).alias("multi_variant_users")))
    bad_variant = ~F.coalesce(F.col("variant").isin(*VARIANTS), F.lit(False))
    rows = units.groupBy("experiment_id").agg(
        F.count(F.lit(1)).alias("n_units"),
        count_when(bad_variant).alias("_bad_variant"),
        count_when(F.col("variant") == VARIANTS[0]).alias("_n_control"),
        count_when(F.col("variant") == VARIANTS[1]).alias("_n_treatment"),
        count_when(~F.coalesce(F.col("is_eligible"), F.lit(False))
                   | ~F.coalesce(F.col("device_category") == "mobile", F.lit(False))).alias("_not_eligible_mobile"),
        count_when(~F.coalesce(F.col("revenue_usd") >= 0, F.lit(False))).alias("_negative_revenue"),
        count_when((F.col("converted_purchase") == 0)
                   & ~F.coalesce(F.col("revenue_usd") == 0, F.lit(False))).alias("_nonconverter_revenue"),
    )
    j = rows.join(per_user, "experiment_id")
    return j.select(
        "experiment_id", "n_units", "multi_variant_users",
        (F.col("multi_variant_users") == 0).alias("single_variant_per_user"),
        ((F.col("_bad_variant") == 0) & (F.col("_n_control") > 0) & (F.col("_n_treatment") > 0))
        .alias("valid_variants_only"),
        (F.col("_not_eligible_mobile") == 0).alias("all_eligible_mobile"),
        (F.col("_negative_revenue") == 0).alias("non_negative_revenue"),
        (F.col("_nonconverter_revenue") == 0).alias("nonconverters_zero_revenue"),
    )


# ------------------------------------------------------------ AB-2
def srm(units: DataFrame, threshold: float = SRM_P_THRESHOLD) -> DataFrame:
    """Chi-square goodness of fit of the control/treatment split against 50/50."""
    c = units.groupBy("experiment_id").agg(
        count_when(F.col("variant") == VARIANTS[0]).alias("n_control"),
        count_when(F.col("variant") == VARIANTS[1]).alias("n_treatment"))
    n = (F.col("n_control") + F.col("n_treatment")).cast("double")
    e = n / 2
    stat = F.try_divide((F.col("n_control") - e) ** 2 + (F.col("n_treatment") - e) ** 2, F.nullif(e, F.lit(0.0)))
    out = c.withColumn("chi2", stat).withColumn("p_value", chi2_1df_p(F.col("chi2")))
    return out.withColumn("srm_passed", F.coalesce(F.col("p_value") > threshold, F.lit(False)))


# ------------------------------------------------------------ AB-3
def variant_metrics(units: DataFrame, median: bool = True) -> DataFrame:
    """One row per (experiment, variant).

    The median duration is exact and distributed (``grouped_median``): an
    arm holding most of the units is never merged into one task. It stores a
    sorted copy of the durations, so leave it out (``median=False``) where it is not read.
    """
    m = units.groupBy("experiment_id", "variant").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("converted_purchase").cast("long").alias("conversions"),
        money_sum("revenue_usd").alias("revenue_usd"),
        (F.sum("payment_error").cast("double") / F.count("payment_error")).alias("payment_error_rate"),
        (F.sum("refund_or_cancelled").cast("double") / F.count("refund_or_cancelled")).alias("refund_rate"),
    )
    out = m.select(
        "experiment_id", "variant", "n", "conversions",
        safe_divide("conversions", "n").alias("conversion_rate"), "revenue_usd",
        safe_divide("revenue_usd", "n").alias("arpu"), "payment_error_rate", "refund_rate")
    if not median:
        return out
    med = grouped_median(units, ["experiment_id", "variant"], "checkout_duration_seconds", ["user_id"],
                         "median_checkout_duration_seconds")
    # both sides have one row per (experiment, variant)
    return out.join(med, ["experiment_id", "variant"], "left")


def _wide(metrics: DataFrame) -> DataFrame:
    """(experiment) x {control, treatment} columns; input has <= 2 rows per experiment."""
    cols = [c for c in metrics.columns if c not in ("experiment_id", "variant")]
    aggs = []
    for v, suffix in ((VARIANTS[0], "c"), (VARIANTS[1], "t")):
        aggs += [F.max(F.when(F.col("variant") == v, F.col(c))).alias(f"{c}_{suffix}") for c in cols]
    return metrics.groupBy("experiment_id").agg(*aggs)


# ------------------------------------------------------------ AB-4...AB-8
def analysis(units: DataFrame, interval: str = "per_arm", median: bool = False) -> DataFrame:
    """Lift, z-test, interval, power and decision: one row per experiment; with ``median`` also the durations'.

    ``interval="per_arm"`` (the reference): the lift interval is the
    difference of the two per-arm normal intervals, [t_lo - c_hi, t_hi - c_lo],
    wider than a Wald interval. ``interval="wald"``: (t - c) +- z * sqrt(t(1-t)/n_t + c(1-c)/n_c).
    """
    if interval not in ("per_arm", "wald"):
        raise ValueError("interval must be 'per_arm' or 'wald'")
    w = _wide(variant_metrics(units, median))
    pc, pt = F.col("conversion_rate_c"), F.col("conversion_rate_t")
    nc, nt = F.col("n_c").cast("double"), F.col("n_t").cast("double")
    pooled = F.try_divide((F.col("conversions_c") + F.col("conversions_t")).cast("double"), nc + nt)
    se = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), nt) + F.try_divide(F.lit(1.0), nc)))
    z = F.try_divide(pt - pc, F.nullif(se, F.lit(0.0)))
    half_t = F.lit(Z_ALPHA) * F.sqrt(F.try_divide(pt * (1 - pt), nt))
    half_c = F.lit(Z_ALPHA) * F.sqrt(F.try_divide(pc * (1 - pc), nc))
    wald = F.lit(Z_ALPHA) * F.sqrt(F.try_divide(pt * (1 - pt), nt) + F.try_divide(pc * (1 - pc), nc))
    out = w.select(
        "experiment_id", "n_c", "n_t", "conversions_c", "conversions_t",
        pc.alias("cvr_control"), pt.alias("cvr_treatment"),
        (pt - pc).alias("absolute_lift"),
        F.when(pc > 0, (pt - pc) / pc).otherwise(F.lit(0.0)).alias("relative_lift"),
        z.alias("z_stat"),
        (((pt - half_t) - (pc + half_c)) if interval == "per_arm" else ((pt - pc) - wald)).alias("diff_ci_low"),
        (((pt + half_t) - (pc - half_c)) if interval == "per_arm" else ((pt - pc) + wald)).alias("diff_ci_high"),
        F.col("arpu_c").alias("arpu_control"), F.col("arpu_t").alias("arpu_treatment"),
        F.col("payment_error_rate_c").alias("payment_error_rate_control"),
        F.col("payment_error_rate_t").alias("payment_error_rate_treatment"),
        F.col("refund_rate_c").alias("refund_rate_control"), F.col("refund_rate_t").alias("refund_rate_treatment"),
        *([F.col("median_checkout_duration_seconds_c").alias("median_duration_control"),
           F.col("median_checkout_duration_seconds_t").alias("median_duration_treatment")] if median else []),
        required_sample_size(pc).alias("required_n_per_arm"),
    )
    return out.withColumn("decision", decision()).withColumn("reason", reason(F.col("decision")))


def required_sample_size(p1: Column, mde: float = MIN_PRACTICAL_LIFT) -> Column:
    """AB-7: n = ceil((z_{a/2} + z_b)^2 (p1 q1 + p2 q2) / mde^2)."""
    p2 = p1 + F.lit(mde)
    n = F.lit((Z_ALPHA + Z_POWER) ** 2) * (p1 * (1 - p1) + p2 * (1 - p2)) / F.lit(mde ** 2)
    return F.ceil(n).cast("long")


def decision(lift: str = "absolute_lift", lo: str = "diff_ci_low", hi: str = "diff_ci_high") -> Column:
    """AB-8, first match: Ship, Iterate, Stop, else Inconclusive."""
    err_inc = F.col("payment_error_rate_treatment") - F.col("payment_error_rate_control")
    ref_inc = F.col("refund_rate_treatment") - F.col("refund_rate_control")
    positive = F.coalesce(F.col(lift) > 0, F.lit(False))
    safe_err = F.coalesce(err_inc <= MAX_PAYMENT_ERROR_INC, F.lit(False))
    safe_ref = F.coalesce(ref_inc <= MAX_REFUND_INC, F.lit(False))
    sig_pos = F.coalesce(F.col(lo) > 0, F.lit(False))
    sig_neg = F.coalesce(F.col(hi) < 0, F.lit(False))
    meets = F.coalesce(F.col(lift) >= MIN_PRACTICAL_LIFT, F.lit(False))
    return (F.when(positive & sig_pos & meets & safe_err & safe_ref, F.lit("Ship"))
            .when(positive & (~safe_err | ~safe_ref), F.lit("Iterate"))
            .when(sig_neg, F.lit("Stop"))
            .otherwise(F.lit("Inconclusive")))


def reason(decision_col: Column) -> Column:
    expr = None
    for d, text in DECISION_REASONS.items():
        expr = F.when(decision_col == d, F.lit(text)) if expr is None else expr.when(decision_col == d, F.lit(text))
    return expr


def ztest(units: DataFrame) -> DataFrame:
    """AB-5: pooled two-proportion z-test, two-sided p-value."""
    a = analysis(units)
    return a.select("experiment_id", "z_stat", two_sided_p(F.col("z_stat")).alias("p_value"))


# ------------------------------------------------------------ AB-9
def summary(units: DataFrame) -> DataFrame:
    a = analysis(units)
    return a.select("experiment_id", F.lit("conversion_rate").alias("metric"),
                    F.col("cvr_control").alias("control"), F.col("cvr_treatment").alias("treatment"),
                    "absolute_lift", two_sided_p(F.col("z_stat")).alias("p_value"), "decision", "reason")


GUARDRAIL_METRICS = [
    ("arpu", "arpu"),
    ("payment_error_rate", "payment_error_rate"),
    ("refund_rate", "refund_rate"),
    ("median_duration", "median_duration"),
]


def guardrails(units: DataFrame) -> DataFrame:
    """Long form: (experiment, metric, control, treatment)."""
    a = analysis(units, median=True)
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{c}_control").alias("control"),
                              F.col(f"{c}_treatment").alias("treatment")) for m, c in GUARDRAIL_METRICS])
    return a.select("experiment_id", F.explode(rows).alias("r")).select("experiment_id", "r.*")


# ------------------------------------------------------------ AB-10
def revenue_histogram(units: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins over each experiment's converter revenue range, counted per variant."""
    conv = units.where(F.col("converted_purchase") == 1)
    rng = conv.groupBy("experiment_id").agg(F.min("revenue_usd").alias("lo"), F.max("revenue_usd").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    b = F.when(width > 0, F.least(F.floor((F.col("revenue_usd") - F.col("lo")) / width),
                                  F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    h = conv.join(rng, "experiment_id").withColumn("bin", b) \
        .groupBy("experiment_id", "variant", "bin", "lo", "hi").agg(F.count(F.lit(1)).alias("units"))
    return h.select("experiment_id", "variant", "bin",
                    (F.col("lo") + F.col("bin") * width).alias("bin_start"),
                    (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_end"), "units")


# ------------------------------------------------------------ AB-11, AB-12
def eligible_users(stg: DataFrame, assignments: DataFrame | None = None, experiment_id: str | None = None,
                   trigger_event: str = "begin_checkout", device: str = "mobile") -> DataFrame:
    """Users whose first ``trigger_event`` happened on ``device`` and who are not assigned yet."""
    first = (stg.where((F.col("event_name") == trigger_event) & F.col("user_pseudo_id").isNotNull())
             .groupBy("user_pseudo_id")
             .agg(F.min(F.struct(F.col("event_timestamp_utc").alias("t"),
                                 F.col("device_category").alias("d"))).alias("f")))
    out = first.where(F.col("f.d") == device).select(
        "user_pseudo_id", F.col("f.t").alias("eligibility_timestamp"))
    if assignments is not None:
        a = assignments
        if experiment_id is not None:
            a = a.where(F.col("experiment_id") == experiment_id)
        out = out.join(a.select("user_pseudo_id").distinct(), "user_pseudo_id", "left_anti")
    return out


def assign(users: DataFrame, experiment_id: str, treatment_share: int = 50) -> DataFrame:
    """Persistent 50/50 assignment: bucket = md5(experiment:user) -> 0..99."""
    key = F.concat(F.lit(experiment_id), F.lit(":"), F.col("user_pseudo_id"))
    bucket = (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % 100).cast("int")
    return users.select(F.lit(experiment_id).alias("experiment_id"), "user_pseudo_id", bucket.alias("bucket"),
                        F.when(bucket < 100 - treatment_share, F.lit(VARIANTS[0]))
                        .otherwise(F.lit(VARIANTS[1])).alias("variant"))


# ------------------------------------------------------------ AB-13...AB-16
def _exposures(events: DataFrame, exposure_event: str) -> DataFrame:
    return events.where(F.col("event_name") == exposure_event)


def first_exposure(events: DataFrame, exposure_event: str = EXPOSURE_EVENT) -> DataFrame:
    return (_exposures(events, exposure_event).groupBy("experiment_id", "user_pseudo_id")
            .agg(F.min(F.struct(F.col("event_timestamp").alias("t"), F.col("variant").alias("v"))).alias("f"))
            .select("experiment_id", "user_pseudo_id", F.col("f.t").alias("exposure_ts"),
                    F.col("f.v").alias("variant")))


def attribution(events: DataFrame, exposure_event: str = EXPOSURE_EVENT, salts: int = 16) -> DataFrame:
    """Per (experiment, variant of first exposure): outcomes at or after the exposure only.

    Outcomes: purchases and their revenue, payment errors, refunds or cancellations, and the
    durations of completed checkouts. A user with a hot stream of outcomes is spread over ``salts``
    parts by a hash of the outcome; the exposure (one row per user) is repeated for each part, and a
    user's parts are summed after the join. Exposed users are counted from the exposures alone and
    joined to the per-variant totals (one row per experiment and variant on both sides).
    """
    exp = first_exposure(events, exposure_event)
    duration = F.col("checkout_duration_seconds") if "checkout_duration_seconds" in events.columns else F.lit(None).cast("double")
    out = events.where(F.col("event_name") != exposure_event).select(
        "experiment_id", "user_pseudo_id", F.col("event_name").alias("outcome"),
        F.col("event_timestamp").alias("outcome_ts"), "revenue_usd", duration.alias("duration"),
        F.pmod(F.xxhash64("event_timestamp", "event_name", "transaction_id"), F.lit(salts)).alias("salt"))
    parts = exp.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    j = parts.join(out, ["experiment_id", "user_pseudo_id", "salt"]).where(F.col("outcome_ts") >= F.col("exposure_ts"))
    per_part = j.groupBy("experiment_id", "user_pseudo_id", "salt", "variant").agg(
        count_when(F.col("outcome") == "purchase").alias("purchases"),
        count_when(F.col("outcome") == "payment_error").alias("payment_errors"),
        count_when(F.col("outcome") == "refund_or_cancelled").alias("refunds"),
        F.sum(F.when(F.col("outcome") == "purchase", money("revenue_usd"))).alias("revenue"),
        F.sum(F.when(F.col("outcome") == "checkout_completed", money("duration"))).alias("seconds"),
        F.count(F.when(F.col("outcome") == "checkout_completed", F.col("duration"))).alias("checkouts"))
    sums = ["purchases", "payment_errors", "refunds", "revenue", "seconds", "checkouts"]
    per_user = per_part.groupBy("experiment_id", "variant", "user_pseudo_id").agg(*[F.sum(c).alias(c) for c in sums])
    per_variant = per_user.groupBy("experiment_id", "variant").agg(
        count_when(F.col("purchases") > 0).alias("converted_users"), *[F.sum(c).alias(c) for c in sums])
    exposed = exp.groupBy("experiment_id", "variant").agg(F.count(F.lit(1)).alias("exposed_users"))
    agg = exposed.join(per_variant, ["experiment_id", "variant"], "left").select(
        "experiment_id", "variant", "exposed_users",
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("converted_users", "purchases", "payment_errors", "refunds")],
        F.coalesce(F.col("revenue").cast("double"), F.lit(0.0)).alias("revenue_usd"),
        safe_divide("seconds", "checkouts").alias("avg_checkout_duration_seconds"))
    return (agg.withColumn("conversion_rate", safe_divide("converted_users", "exposed_users"))
            .withColumn("refund_rate", safe_divide("refunds", "purchases")))


def exposure_counts(events: DataFrame, exposure_event: str = EXPOSURE_EVENT) -> DataFrame:
    """AB-14: users whose exposure count is not exactly one."""
    return (_exposures(events, exposure_event).groupBy("experiment_id", "user_pseudo_id")
            .agg(F.count(F.lit(1)).alias("exposures")).where(F.col("exposures") != 1))


def missing_exposure(events: DataFrame, exposure_event: str = EXPOSURE_EVENT) -> DataFrame:
    """AB-15: purchases carrying the experiment id from users never exposed."""
    exp = _exposures(events, exposure_event).select("experiment_id", "user_pseudo_id").distinct()
    return (events.where(F.col("event_name") == "purchase")
            .join(exp, ["experiment_id", "user_pseudo_id"], "left_anti")
            .select("experiment_id", "user_pseudo_id", "transaction_id", "event_timestamp", "revenue_usd"))


def contamination(events: DataFrame, exposure_event: str = EXPOSURE_EVENT) -> DataFrame:
    """AB-16: users exposed to more than one variant."""
    return (_exposures(events, exposure_event).groupBy("experiment_id", "user_pseudo_id")
            .agg(F.countDistinct("variant").alias("variants")).where(F.col("variants") > 1))


# ------------------------------------------------------------ AB-17
def checkout_duration(funnel: DataFrame) -> DataFrame:
    """Seconds from the first begin_checkout to the first purchase at or after it, per session."""
    chk, pur = F.col("first_begin_checkout_time"), F.col("first_purchase_time")
    return funnel.where(chk.isNotNull() & pur.isNotNull() & (pur >= chk)).select(
        "session_key", "user_pseudo_id", chk.alias("checkout_start_time"), pur.alias("purchase_time"),
        ((F.unix_micros(pur) - F.unix_micros(chk)) / F.lit(1_000_000.0)).alias("checkout_duration_seconds"))
