import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from outflow.functions.ordering import exact_quantiles, numbered, previous_row, running_totals, top_share, value_ranks
from outflow.operators import joins, windows

T0 = datetime(2024, 1, 1)


def at(hours):
    return T0 + timedelta(hours=hours)


def ntz(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def events(spark):
    rows = [("a", at(1)), ("a", at(30)), ("a", at(30)), ("b", at(100)), ("a", at(49))]
    return ntz(spark, rows, "k string, e timestamp_ntz")


@pytest.mark.parametrize("strict", [False, True])
def test_asof_both_ways(spark, events, strict):
    asked = [("a", at(h)) for h in (0, 1, 2, 29, 30, 31, 200)] + [("b", at(3)), ("c", at(3))]
    left = ntz(spark, asked, "k string, t timestamp_ntz")
    data = [(r.k, r.e) for r in events.collect()]
    back = joins.asof_backward(left, events, ["k"], "t", "e", "m", strict)
    for k, t, m in back.select("k", "t", "m").collect():
        expected = [e for key, e in data if key == k and (e < t if strict else e <= t)]
        assert m == max(expected, default=None)
    ahead = joins.asof_forward(left, events, ["k"], "t", "e", "m", strict)
    for k, t, m in ahead.select("k", "t", "m").collect():
        expected = [e for key, e in data if key == k and (e > t if strict else e >= t)]
        assert m == min(expected, default=None)


def test_asof_with_one_key_for_all_rows(spark):
    """One hot key over many blocks: what lies before a block reaches into it."""
    right = ntz(spark, [(None if i % 7 == 6 else "k", at(i * 5)) for i in range(40)], "k string, e timestamp_ntz")
    left = ntz(spark, [("k", at(h)) for h in range(0, 210, 3)], "k string, t timestamp_ntz")
    times = [at(i * 5) for i in range(40) if i % 7 != 6]
    for t, m in joins.asof_backward(left, right, ["k"], "t", "e", "m").select("t", "m").collect():
        assert m == max(e for e in times if e <= t)
    for t, m in joins.asof_forward(left, right, ["k"], "t", "e", "m").select("t", "m").collect():
        assert m == min((e for e in times if e >= t), default=None)


def test_interval_is_closed(spark, events):
    left = ntz(spark, [("a", at(6)), ("a", at(29))], "k string, t timestamp_ntz")
    pairs = joins.interval_join(left, events, "k", "t", "e", 0, 24).collect()
    assert sorted((r.t, r.e) for r in pairs) == [(at(6), at(30))] * 2 + [(at(29), at(30))] * 2 + [(at(29), at(49))]


def test_exists_within_is_open(spark, events):
    left = ntz(spark, [("a", at(1)), ("a", at(6)), ("a", at(49))], "k string, t timestamp_ntz")
    got = {r.t: (r.y_24, r.y_48) for r in joins.exists_within(left, events, "k", "t", "e", [24, 48]).collect()}
    assert got == {at(1): (0, 1), at(6): (0, 1), at(49): (0, 0)}


def _km(a, b):
    p = math.pi / 180
    h = math.sin((b[0] - a[0]) * p / 2) ** 2 + math.cos(a[0] * p) * math.cos(b[0] * p) * math.sin((b[1] - a[1]) * p / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("km", [2.0, 60.0])
def test_near_equals_brute_force(spark, km):
    base = [(12.0, 77.0), (0.0, 0.0), (60.0, 179.999), (-45.5, -179.999), (89.9, 10.0), (89.95, -170.0), (60.0, -179.99)]
    shifts = [(0, 0), (0.009, 0.009), (-0.02, 0.01), (0.3, -0.2), (0.0, 0.017)]
    wrap = lambda lon: (lon + 180) % 360 - 180
    pts = [(f"p{i}{j}", min(lat + dy, 90.0), wrap(lon + dx)) for i, (lat, lon) in enumerate(base) for j, (dy, dx) in enumerate(shifts)]
    points = spark.createDataFrame(pts, "p string, la double, lo double")
    centres = spark.createDataFrame([(n.replace("p", "c"), a, o) for n, a, o in pts], "c string, cla double, clo double")
    got = {(r.p, r.c) for r in joins.near(points, centres, km, "la", "lo", "cla", "clo").collect()}
    want = {(n, m.replace("p", "c")) for n, a, o in pts for m, b, q in pts if _km((a, o), (b, q)) <= km}
    assert got == want


def test_near_ignores_missing_places(spark):
    points = spark.createDataFrame([("p", None, 1.0)], "p string, la double, lo double")
    centres = spark.createDataFrame([("c", 1.0, 1.0)], "c string, cla double, clo double")
    assert joins.near(points, centres, 5.0, "la", "lo", "cla", "clo").count() == 0


def test_amount_cluster_brute_force(spark):
    amounts = [0.0, 0.05, 0.5, 1.0, 1.1, 90.0, 100.0, 100.0, 109.99, 110.0, 110.01, 121.0, 5000.0]
    rows = [(i, "x" if i % 4 else "y", a) for i, a in enumerate(amounts)]
    df = spark.createDataFrame(rows, "i int, g string, a double")
    got = {r.i: r.amount_cluster for r in joins.amount_cluster(df, ["g"], "a").collect()}
    cents = lambda a: round(a * 100)
    want = {i: sum(abs(cents(a) - cents(b)) * 10 <= max(abs(cents(a)), 100) for _, h, b in rows if h == g) for i, g, a in rows}
    assert got == want


def test_lookup_falls_back_to_the_mean(spark):
    table = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "k string, v double")
    df = spark.createDataFrame([("a",), ("z",)], "k string")
    assert {r.k: r.o for r in joins.lookup(df, table, "k", "v", "o").collect()} == {"a": 1.0, "z": 2.0}


def test_running_totals_spans_blocks_for_a_hot_key(spark):
    rows = [("hot" if i % 10 else "cold", i, i % 7) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, o int, v bigint")
    got = {(r.k, r.o): r.s for r in running_totals(df, ["k"], [F.col("o")], {"s": "v"}).collect()}
    total = {}
    for k, o, v in rows:
        total[k] = total.get(k, 0) + v
        assert got[(k, o)] == total[k]


def test_numbered_and_share(spark):
    df = spark.createDataFrame([(i, (i * 37) % 101) for i in range(101)], "i int, v int")
    placed = {r.v: r.position for r in numbered(df, [], [F.col("v").desc()]).collect()}
    assert placed == {v: 101 - v for v in range(101)}
    assert sorted(r.v for r in top_share(df, [F.col("v").desc()], 0.05).collect()) == [96, 97, 98, 99, 100]


def test_mid_ranks_and_quantiles_with_ties(spark):
    values = [1.0, 2.0, 2.0, 2.0, 5.0, 9.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert {r.v: r.mid_rank for r in value_ranks(df, [], "v").collect()} == {1.0: 1.0, 2.0: 3.0, 5.0: 5.0, 9.0: 6.0}
    row = exact_quantiles(df, [], "v", [0.0, 0.25, 0.5, 0.9, 1.0]).first()
    assert row.q == pytest.approx([1.0, 2.0, 2.0, 7.0, 9.0]) and row.rows == 6


def test_previous_row_across_blocks(spark):
    keys = [0, 1, 2, 5, 6, 14, 15]
    df = spark.createDataFrame([(k, f"v{k}") for k in keys], "k bigint, v string")
    got = {r.k: r.previous_v for r in previous_row(df, "k", ["v"]).collect()}
    assert got == {k: (f"v{keys[i - 1]}" if i else None) for i, k in enumerate(keys)}


def test_surge_ratio_and_cold_start(spark):
    days = [datetime(2024, 1, d).date() for d in (1, 2, 4, 13)]
    rows = [("c", d) for d, n in zip(days, (4, 2, 9, 1)) for _ in range(n)]
    df = spark.createDataFrame(rows, "city string, day date")
    got = {r.day: r.surge_ratio for r in windows.surge_ratio(df, "city", "day").collect()}
    assert got == {days[0]: 1.0, days[1]: 0.5, days[2]: 3.0, days[3]: pytest.approx(0.2)}
    flags = {r.day: r.cold_start_flag for r in windows.cold_start_days(df, "city", "day", 2).collect()}
    assert flags == {days[0]: 1.0, days[1]: 1.0, days[2]: 0.0, days[3]: 0.0}


def test_cap_rounds_half_to_even_with_minimum_one(spark):
    population = spark.createDataFrame([("a", 1), ("b", 3), ("c", 5), ("d", 1)], "state string, n bigint")
    got = {r.state: r.budget for r in windows.state_budgets(population, F.lit(5)).collect()}
    assert got == {"a": 1, "b": 2, "c": 2, "d": 1}


def test_cap_demotes_action_only(spark):
    population = spark.createDataFrame([("a", 1), ("b", 1)], "state string, n bigint")
    rows = [(f"m{i}", "a", 0.9 - i / 100, "dispatch" if i < 2 else "action") for i in range(5)]
    alerts = spark.createDataFrame(rows, "atm_id string, state string, risk_score double, tier string")
    got = {r.atm_id: r.effective_tier for r in windows.fairness_cap(alerts, population, F.lit(6)).collect()}
    assert got == {"m0": "dispatch", "m1": "dispatch", "m2": "action", "m3": "monitor", "m4": "monitor"}
