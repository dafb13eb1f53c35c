"""Experiment analysis: statistics against the standard library, decision branches
on hand-written aggregate tables, unit-table checks and the CSV source."""

import datetime as dt
import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from funnelworks.plans import experiment as ab
from funnelworks.sources.events import read_experiment_csv
from funnelworks.sources.schema import EXPERIMENT_UNIT

TS = dt.datetime(2024, 1, 1)


def units(spark, spec, exp="e1"):
    """spec: list of (variant, n, conversions, errors, refunds, revenue_per_conversion)."""
    rows, uid = [], 0
    for variant, n, conv, err, ref, rev in spec:
        for i in range(n):
            uid += 1
            c = int(i < conv)
            rows.append((f"u{uid}", exp, variant, TS, True, "mobile", c, rev if c else 0.0,
                         int(i < err), int(i < ref), float(20 + i % 7)))
    return spark.createDataFrame(rows, EXPERIMENT_UNIT)


def test_ztest_and_srm_p_values_match_stdlib(spark):
    df = units(spark, [("control", 1000, 100, 10, 5, 30.0), ("treatment", 1100, 140, 10, 5, 30.0)])
    z = ab.ztest(df).first()
    pc, pt = 100 / 1000, 140 / 1100
    p = (100 + 140) / 2100
    se = math.sqrt(p * (1 - p) * (1 / 1100 + 1 / 1000))
    assert z.z_stat == pytest.approx((pt - pc) / se, rel=1e-12)
    assert z.p_value == pytest.approx(2 * (1 - NormalDist().cdf(abs((pt - pc) / se))), rel=1e-9)
    s = ab.srm(df).first()
    chi2 = ((1000 - 1050) ** 2 + (1100 - 1050) ** 2) / 1050
    assert s.chi2 == pytest.approx(chi2) and s.p_value == pytest.approx(math.erfc(math.sqrt(chi2 / 2)), rel=1e-12)
    assert s.srm_passed == (math.erfc(math.sqrt(chi2 / 2)) > 0.001)


def test_interval_and_power_formulas(spark):
    df = units(spark, [("control", 400, 40, 0, 0, 10.0), ("treatment", 400, 60, 0, 0, 10.0)])
    a = ab.analysis(df).first()
    z = NormalDist().inv_cdf(0.975)
    hc, ht = z * math.sqrt(0.1 * 0.9 / 400), z * math.sqrt(0.15 * 0.85 / 400)
    assert a.diff_ci_low == pytest.approx((0.15 - ht) - (0.1 + hc))
    assert a.diff_ci_high == pytest.approx((0.15 + ht) - (0.1 - hc))
    zb = NormalDist().inv_cdf(0.8)
    n = math.ceil((z + zb) ** 2 * (0.1 * 0.9 + 0.105 * 0.895) / 0.005 ** 2)
    assert a.required_n_per_arm == n


@pytest.mark.parametrize("spec,expected", [
    # large clear win, guardrails flat -> Ship
    ([("control", 4000, 400, 40, 8, 10.0), ("treatment", 4000, 600, 40, 8, 10.0)], "Ship"),
    # win but payment errors up 5 points -> Iterate
    ([("control", 4000, 400, 40, 8, 10.0), ("treatment", 4000, 600, 240, 8, 10.0)], "Iterate"),
    # clear loss -> Stop
    ([("control", 4000, 600, 40, 8, 10.0), ("treatment", 4000, 400, 40, 8, 10.0)], "Stop"),
    # tiny positive lift, not significant -> Inconclusive
    ([("control", 500, 50, 5, 1, 10.0), ("treatment", 500, 51, 5, 1, 10.0)], "Inconclusive"),
])
def test_decision_branches(spark, spec, expected):
    r = ab.analysis(units(spark, spec)).first()
    assert r.decision == expected and r.reason == ab.DECISION_REASONS[expected]


def test_relative_lift_zero_when_control_rate_zero(spark):
    r = ab.analysis(units(spark, [("control", 50, 0, 0, 0, 0.0), ("treatment", 50, 5, 0, 0, 9.0)])).first()
    assert r.relative_lift == 0.0 and r.absolute_lift == pytest.approx(0.1)


def test_validity_flags(spark):
    good = units(spark, [("control", 10, 2, 0, 0, 5.0), ("treatment", 10, 3, 0, 0, 5.0)])
    assert all(list(ab.validity(good).first())[3:])
    bad = good.union(spark.createDataFrame(
        [("u1", "e1", "treatment", TS, False, "desktop", 0, 4.0, 0, 0, 1.0),
         ("u99", "e1", "holdout", TS, True, "mobile", 1, -1.0, 0, 0, 1.0)], EXPERIMENT_UNIT))
    r = ab.validity(bad).first()
    assert r.multi_variant_users == 1
    assert not (r.single_variant_per_user or r.valid_variants_only or r.all_eligible_mobile
                or r.non_negative_revenue or r.nonconverters_zero_revenue)


def test_histogram_counts_every_converter(spark):
    df = units(spark, [("control", 100, 30, 0, 0, 10.0), ("treatment", 100, 40, 0, 0, 20.0)])
    df = df.withColumn("revenue_usd", F.when(F.col("converted_purchase") == 1,
                                             F.col("revenue_usd") + F.col("checkout_duration_seconds"))
                       .otherwise(F.lit(0.0)))
    h = ab.revenue_histogram(df)
    assert h.agg(F.sum("units")).first()[0] == 70
    assert h.agg(F.max("bin")).first()[0] <= 49


def test_read_experiment_csv_skips_comment(spark, tmp_dir):
    path = f"{tmp_dir}/units.csv"
    with open(path, "w") as f:
        f.write("# SIMULATED DATA - disclaimer line\n")
        f.write(",".join(x.name for x in EXPERIMENT_UNIT.fields) + "\n")
        f.write("u1,e1,control,2024-01-01 00:00:00,true,mobile,1,12.5,0,0,31.0\n")
        f.write("u2,e1,treatment,2024-01-01 00:00:00,true,mobile,0,0.0,1,0,40.0\n")
    df = read_experiment_csv(spark, path)
    assert df.count() == 2 and df.schema == EXPERIMENT_UNIT
    assert ab.validity(df).first().valid_variants_only


def test_attribution_ignores_outcomes_before_exposure(spark):
    rows = [("experiment_impression", "x", "control", "a", 100, None, None),
            ("purchase", "x", None, "a", 50, "t0", 9.0),      # before exposure: not counted
            ("purchase", "x", None, "a", 150, "t1", 4.0),
            ("experiment_impression", "x", "treatment", "b", 100, None, None),
            ("payment_error", "x", None, "b", 120, None, None)]
    ev = spark.createDataFrame(rows, "event_name string, experiment_id string, variant string, "
                                     "user_pseudo_id string, event_timestamp bigint, transaction_id string, "
                                     "revenue_usd double")
    r = {x.variant: x for x in ab.attribution(ev).collect()}
    assert (r["control"].purchases, r["control"].revenue_usd, r["control"].converted_users) == (1, 4.0, 1)
    assert (r["treatment"].purchases, r["treatment"].payment_errors) == (0, 1)
    assert ab.missing_exposure(ev).count() == 0


def test_wald_interval_option(spark):
    df = units(spark, [("control", 400, 40, 0, 0, 10.0), ("treatment", 400, 60, 0, 0, 10.0)])
    a = ab.analysis(df, interval="wald").first()
    z = NormalDist().inv_cdf(0.975)
    se = math.sqrt(0.15 * 0.85 / 400 + 0.1 * 0.9 / 400)
    assert (a.diff_ci_low, a.diff_ci_high) == (pytest.approx(0.05 - z * se), pytest.approx(0.05 + z * se))
    per_arm = ab.analysis(df).first()
    assert per_arm.diff_ci_low < a.diff_ci_low and per_arm.diff_ci_high > a.diff_ci_high
    with pytest.raises(ValueError):
        ab.analysis(df, interval="exact")


def test_experiment_tables_written(spark, tmp_dir):
    from funnelworks.sources.sinks import write_experiment_tables
    df = units(spark, [("control", 50, 5, 0, 0, 10.0), ("treatment", 50, 6, 0, 0, 10.0)])
    write_experiment_tables(ab.summary(df), ab.guardrails(df), tmp_dir, fmt="csv")
    back = spark.read.option("header", True).csv(f"{tmp_dir}/guardrails_by_variant")
    assert back.count() == 4 and "median_duration" in {r.metric for r in back.collect()}


def test_attribution_with_a_hot_user_matches_brute_force(spark):
    import random
    rnd = random.Random(5)
    rows = []
    for u in range(40):
        user = "hot" if u == 0 else f"u{u}"
        rows.append(("experiment_impression", "x", "control" if u % 2 else "treatment", user, 1000 + u, None, None))
        for k in range(600 if u == 0 else rnd.randint(0, 6)):           # the hot user: most of all outcomes
            kind = rnd.choice(["purchase", "payment_error"])
            rows.append((kind, "x", None, user, rnd.randint(900, 1200), f"t{u}-{k}",
                         round(rnd.random() * 50, 2) if kind == "purchase" else None))
    ev = spark.createDataFrame(rows, "event_name string, experiment_id string, variant string, "
                                     "user_pseudo_id string, event_timestamp bigint, transaction_id string, "
                                     "revenue_usd double")
    got = {r.variant: r for r in ab.attribution(ev).collect()}
    expo = {r[3]: (r[2], r[4]) for r in rows if r[0] == "experiment_impression"}
    want = {}
    for v in ("control", "treatment"):
        users = [u for u, (var, _) in expo.items() if var == v]
        after = [r for r in rows if r[0] != "experiment_impression" and r[3] in users and r[4] >= expo[r[3]][1]]
        buyers = {r[3] for r in after if r[0] == "purchase"}
        want[v] = (len(users), len(buyers), sum(r[0] == "purchase" for r in after),
                   round(sum(r[6] for r in after if r[0] == "purchase"), 6),
                   sum(r[0] == "payment_error" for r in after))
    for v, w in want.items():
        g = got[v]
        assert (g.exposed_users, g.converted_users, g.purchases, round(g.revenue_usd, 6), g.payment_errors) == w
