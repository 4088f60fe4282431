from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from outflow import schemas
from outflow.plans import daily, enrich, hawkes, hourly, six_hour
from outflow.plans.steps import city_steps, step_of

D = datetime(2024, 1, 10)


def complaint(i, when, city="X", kind="phishing", account=None, lat=10.0, lon=70.0, amount=100.0):
    return (f"C{i}", when, kind, city, f"D{city}", "S", "1", lat, lon, amount, account, f"PH{i}", "under_investigation")


def withdrawal(i, when, atm="A", account="acc", amount=500.0, fraud=False):
    return (f"W{i}", when, atm, account, amount, "atm", fraud)


def frames(spark, complaints, withdrawals, atms=("B", "A")):
    rows = [(a, f"bank{a}", "br", "X", "DX", "S", "1", "ps", 10.0, 70.01) for a in atms]
    centres = spark.createDataFrame([("X", 10.0, 70.0)], "city string, cc_lat double, cc_lon double")
    return (
        spark.createDataFrame(complaints, schemas.COMPLAINTS), spark.createDataFrame(withdrawals, schemas.WITHDRAWALS),
        spark.createDataFrame(rows, schemas.ATMS), centres,
    )


BASE_C = [complaint(0, D - timedelta(days=9, hours=3), account="acc"), complaint(1, D - timedelta(days=1, hours=2), kind="upi_fraud", lat=10.2)]
BASE_W = [withdrawal(0, D - timedelta(days=9)), withdrawal(1, D - timedelta(hours=30), fraud=True, amount=60000.0), withdrawal(2, D - timedelta(seconds=1), account="other")]


def day_row(spark, complaints, withdrawals, atm="A"):
    inputs = frames(spark, complaints, withdrawals)
    end = F.lit(D.date())
    return daily.atm_day_features(*inputs, first_day=end, last_day=end).where(F.col("atm_id") == atm).first()


def test_rows_at_or_after_the_day_change_nothing(spark):
    before = day_row(spark, BASE_C, BASE_W)
    late_c = [complaint(7, D, account="other"), complaint(8, D + timedelta(seconds=1), account="other", lat=12.0)]
    late_w = [withdrawal(8, D, fraud=False, amount=99000.0), withdrawal(9, D + timedelta(hours=5), account="new")]
    after = day_row(spark, BASE_C + late_c, BASE_W + late_w)
    assert {c: before[c] for c in daily.FEATURES} == {c: after[c] for c in daily.FEATURES}


def test_the_second_before_the_day_counts(spark):
    row = day_row(spark, BASE_C, BASE_W)
    assert (row.withdrawals_1h, row.withdrawals_24h, row.amount_sum_24h) == (1, 1, 500.0)
    assert row.counterparty_count_24h == 1 and row.distinct_accounts_24h == 2
    assert row.mule_reuse_count_7d == 1 and row.prior_alert_fraud_flag == 1.0
    assert row.amount_max_7d == 60000.0 and row.heavy_count_7d == 1
    assert row.n_complaints_city_24h == 1 and row.n_complaints_city_7d == 1
    assert row.hours_since_last_complaint_city == pytest.approx(26.0)
    assert row.t_upi_fraud_7d == 1 and row.upi_to_atm_transition_flag == 1.0
    assert row.fraud_decay_7d == pytest.approx(2.718281828 ** -0.5)


def test_links_need_an_earlier_complaint(spark):
    late = [complaint(5, D - timedelta(hours=1), account="other")]
    assert day_row(spark, BASE_C, BASE_W).linked_proportion_24h == 0.0
    assert day_row(spark, BASE_C + late, BASE_W).linked_proportion_24h == 1.0
    same_day = [complaint(5, D + timedelta(hours=1), account="other")]
    assert day_row(spark, BASE_C + same_day, BASE_W).linked_proportion_24h == 0.0


def test_machines_are_not_mixed(spark):
    rows = [withdrawal(i, D - timedelta(hours=3), atm=a, amount=v) for i, (a, v) in enumerate((("A", 100.0), ("B", 70000.0)))]
    assert day_row(spark, BASE_C, rows, "A").amount_max_1d == 100.0
    assert day_row(spark, BASE_C, rows, "B").amount_max_1d == 70000.0


def test_six_hour_rows_are_leak_safe(spark):
    t = D + timedelta(hours=6)

    def row(extra):
        inputs = frames(spark, BASE_C, BASE_W + extra)
        out = six_hour.atm_6h_features(*inputs).where((F.col("atm_id") == "A") & (F.col("window_start") == F.lit(t).cast("timestamp_ntz")))
        found = out.first()
        return {c: found[c] for c in six_hour.FEATURES}

    inside = [withdrawal(4, t + timedelta(hours=1))]
    assert row(inside) == row([withdrawal(4, t + timedelta(hours=2), amount=9.0)])
    assert row(inside + [withdrawal(5, t - timedelta(seconds=1))])["withdrawals_1h"] == 1


def test_hourly_window_excludes_its_own_hour(spark):
    c, w, a, centres = frames(spark, BASE_C, [withdrawal(0, D + timedelta(hours=3, minutes=1))])
    hour = lambda h: F.lit(int((D - datetime(1970, 1, 1)).total_seconds() // 3600) + h).cast("bigint")
    rows = hourly.atm_hour_features(c, w, a, centres, hour(0), hour(30)).where("atm_id = 'A'").collect()
    seen = {r.hour: (r.withdrawals_1h, r.withdrawals_24h) for r in rows}
    assert seen[D + timedelta(hours=3)] == (0, 0)
    assert seen[D + timedelta(hours=4)] == (1, 1)
    assert seen[D + timedelta(hours=27)] == (0, 1) and seen[D + timedelta(hours=28)] == (0, 0)


def city_days(spark, days, last):
    rows = [complaint(i, datetime(2024, 1, 1) + timedelta(days=d)) for i, d in enumerate(days)]
    c, _, _, centres = frames(spark, rows, [withdrawal(0, D)])
    step = lambda d: step_of(F.lit(datetime(2024, 1, 1) + timedelta(days=d)).cast("timestamp_ntz"), 24)
    return city_steps(c, centres, step(0), step(last), 24)


def test_hawkes_past_raises_future_does_not(spark):
    params = hawkes.hawkes_fit(city_days(spark, [0, 1, 1, 4, 4, 5, 9], 9), F.lit(10))
    fitted = params.first()
    assert 0 <= fitted.alpha < fitted.beta and fitted.mu == pytest.approx(0.7)
    params = spark.createDataFrame([("X", 0.5, 0.2, 0.4)], "city string, mu double, alpha double, beta double")
    value = lambda days: {i: r.hawkes_intensity_24h for i, r in enumerate(hawkes.hawkes_intensity(city_days(spark, days, 9), params).orderBy("step").collect())}
    base, future, past = value([0, 1, 4]), value([0, 1, 4, 6, 7]), value([0, 1, 2, 4])
    assert base[6] == future[6] and base[5] < past[5]
    assert base[4] == pytest.approx(0.5 + 0.2 * (2.718281828459 ** (-0.4 * 4) + 2.718281828459 ** (-0.4 * 3)))


def test_log_gamma(spark):
    import math

    xs = [0.01, 0.5, 1.0, 7.3, 150.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", hawkes._log_gamma(F.col("x")).alias("g"))
    for r in df.collect():
        assert r.g == pytest.approx(math.lgamma(r.x), abs=1e-9)


def test_enrich_without_columns_gives_zero(spark):
    df = spark.createDataFrame([(1,)], "x int")
    row = enrich.enrich(df).first()
    assert (row.complaint_surge_ratio, row.cross_city_mule_spread, row.atm_cold_start_flag, row.complaint_amount_cluster) == (0, 0, 0, 0)


def test_results_do_not_depend_on_partitions(spark):
    def rows(width):
        spark.conf.set("spark.sql.shuffle.partitions", str(width))
        inputs = frames(spark, BASE_C, BASE_W)
        out = daily.atm_day_features(*(df.repartition(width) for df in inputs))
        return sorted(map(tuple, out.select("atm_id", "day", *daily.FEATURES).collect()))

    try:
        assert rows(1) == rows(7)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
