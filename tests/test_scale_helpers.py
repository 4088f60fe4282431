"""Recurrences, quantiles and joins whose keys, cells or blocks are hot."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from outflow.functions.quantiles import cell_counts, exact_cuts
from outflow.functions.recurrence import decayed_before
from outflow.operators import joins
from outflow.plans import reports


def test_decayed_sum_over_many_blocks_and_gaps(spark):
    rng = random.Random(3)
    rows = [("hot", d, rng.randrange(5)) for d in range(-40, 10_000) if rng.random() < 0.9 and not 3000 <= d < 4200]
    rows += [("cold", 7, 2), ("none", 1, None), ("none", 2, 1)]
    rates = {"hot": 0.05, "cold": 1.5, "none": 0.4}
    df = spark.createDataFrame([(k, d, n, rates[k]) for k, d, n in rows], "k string, d bigint, n bigint, r double").repartition(5)
    got = {(r.k, r.d): r.s for r in decayed_before(df, ["k"], "d", "n", "r", "s").collect()}
    total, last = {}, {}
    for k, d, n in sorted(rows, key=lambda x: (x[0], x[1])):
        before = total.get(k, 0.0) * math.exp(-rates[k] * (d - last.get(k, d)))
        assert got[k, d] == pytest.approx(before, rel=1e-9, abs=1e-12)
        total[k], last[k] = before + (n or 0), d
    assert len(got) == len(rows)


def numpy_like(values, q):
    at = (len(values) - 1) * q
    low, high = values[math.floor(at)], values[math.ceil(at)]
    return low + (high - low) * (at - math.floor(at))


@pytest.mark.parametrize("gather", [100_000, 20])
def test_cuts_are_exact_with_ties_outliers_and_nulls(spark, gather):
    rng = random.Random(5)
    n = 30_000
    columns = {
        "even": [rng.random() for _ in range(n)],
        "tied": [float(rng.choice([0, 0, 0, 1, 2])) for _ in range(n)],
        "wide": [rng.random() * 10.0 ** rng.randrange(-300, 300) for _ in range(n)],
        "holes": [None if i % 3 else float(i) for i in range(n)],
        "flat": [4.0] * n, "none": [None] * n,
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns))
    at = [0.0, 0.1, 1 / 3, 0.5, 0.9, 0.999, 1.0]
    got = exact_cuts(df, list(columns), at, gather=gather)
    for c, values in columns.items():
        held = sorted(v for v in values if v is not None)
        assert got[c][0] == len(held)
        assert got[c][1] == ([pytest.approx(numpy_like(held, q), rel=1e-12) for q in at] if held else [])


def test_cells_between_and_at_edges(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.0, 0.5, 1.0, 2.0, None)], "v double")
    assert cell_counts(df, {"v": [0.0, 1.0]})["v"].tolist() == [1, 2, 1, 1, 1]


HOUR = datetime(2024, 1, 1, 10)


def test_interval_join_on_one_key_and_one_hour(spark):
    rng = random.Random(8)
    left = [(i, "k", HOUR + timedelta(seconds=rng.randrange(3600))) for i in range(300)] + [(900, "cold", HOUR)]
    events = [(i, "k", HOUR + timedelta(seconds=rng.randrange(3600) if i % 3 else 7)) for i in range(600)] + [(901, "cold", HOUR + timedelta(minutes=5))]
    a = spark.createDataFrame(left, "i int, key string, t timestamp_ntz")
    b = spark.createDataFrame(events, "j int, key string, e timestamp_ntz")
    want = sorted((i, j) for i, k, t in left for j, q, e in events if k == q and t - timedelta(minutes=6) <= e <= t + timedelta(minutes=30))
    for bound in (40, 100_000):
        out = joins.interval_join(a, b, "key", "t", "e", -0.1, 0.5, bound=bound)
        assert sorted((r.i, r.j) for r in out.select("i", "j").collect()) == want


def test_no_group_of_a_bounded_join_exceeds_the_bound(spark):
    left = spark.createDataFrame([("hot", i) for i in range(500)] + [("x", 1)], "key string, i int")
    right = spark.createDataFrame([("hot", j // 2) for j in range(600)] + [("x", 2)], "key string, j int")
    seen = []
    plain = type(left).join

    def spy(self, other, on=None, how=None):
        if on is not None and list(on) == ["key", "_row", "_col"]:
            seen.extend(max(r["count"] for r in side.groupBy(*on).count().collect()) for side in (self, other))
        return plain(self, other, on, how)

    type(left).join = spy
    try:
        out = joins.bounded_join(left, right, ["key"], bound=50)
    finally:
        type(left).join = plain
    assert out.count() == 500 * 600 + 1 and len(seen) == 2 and max(seen) <= 100


def test_counts_around_a_dense_place(spark):
    rng = random.Random(9)
    places = [(12.0 + rng.gauss(0, 0.004), 77.0 + rng.gauss(0, 0.02)) for _ in range(2500)]
    places += [(rng.uniform(-89, 89), rng.choice([-179.995, 179.995, rng.uniform(-180, 180)])) for _ in range(300)]
    machines = [("m0", 12.001, 77.003), ("m1", 12.02, 77.0), ("m2", 0.0, 0.0)] + [(f"r{i}", la, lo) for i, (la, lo) in enumerate(places[2500:2540])]
    atms = spark.createDataFrame(machines, "atm_id string, latitude double, longitude double")
    rows = [(la, lo, datetime(2024, 1, 1 + i % 2)) for i, (la, lo) in enumerate(places)] * 2 + [(None, 1.0, HOUR)]
    complaints = spark.createDataFrame(rows, "victim_lat double, victim_lon double, filing_timestamp timestamp_ntz")

    def km(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))

    want = {}
    for name, la, lo in machines:
        for x, y, when in rows[:-1]:
            if km(la, lo, x, y) <= 2.0:
                for day in (when.date(), when.date() + timedelta(days=1)):
                    want[name, day] = want.get((name, day), 0) + 1
    for leaf in (16, 100_000):
        got = {(r.atm_id, r.day): r.complaints_nearby for r in joins.proximity_counts(atms, complaints, leaf=leaf).collect()}
        assert got == want


def test_the_next_event_of_a_hot_key_takes_one_pass(spark):
    rng = random.Random(17)
    start = datetime(2024, 1, 1)
    at = lambda: start + timedelta(seconds=rng.randrange(20_000))
    asked = [(k, at()) for k in ["hot"] * 1500 + ["cold"] * 5 + [None]] + [("hot", None)]
    events = [(k, at()) for k in ["hot"] * 700 + ["cold"] * 2 + [None]]
    left = spark.createDataFrame(asked, "k string, t timestamp_ntz")
    right = spark.createDataFrame(events, "k string, u timestamp_ntz")
    found = joins.asof_forward(left, right, ["k"], "t", "u", "n")
    want = [(k, t, min((u for j, u in events if k is not None and t is not None and j == k and u >= t), default=None)) for k, t in asked]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    # A frame that shrinks towards the end is computed anew for every row: the square of a block's rows.
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_a_split_by_day_sends_the_days_to_the_rows(spark):
    from outflow.plans import splits

    rows = spark.range(400).selectExpr("id", "date_add(date'2024-01-01', cast(id % 20 as int)) AS day")
    split = splits.chrono_split(rows, "day")
    assert "strategy=broadcast" in plan_of(split)
    assert {(r.split, r.n) for r in split.groupBy("split").count().toDF("split", "n").collect()} == {("train", 240), ("val", 40), ("test", 120)}


def test_machines_are_dealt_out_before_their_calendar(spark, tmp_path):
    from pyspark.sql import functions as F

    from outflow import schemas
    from outflow.plans import steps
    from outflow.sources.views import Tables

    atms = spark.createDataFrame([(f"A{i}", "b", "br", "X", "DX", "S", "1", "ps", 1.0, 2.0) for i in range(9)], schemas.ATMS).coalesce(1)
    none = lambda schema: spark.createDataFrame([], schema)
    account = steps.account_steps(none(schemas.WITHDRAWALS), 24)
    grid = steps.machine_steps(account, none(schemas.COMPLAINTS), atms, F.lit(1).cast("bigint"), F.lit(40).cast("bigint"), 24, {"l": steps.Linked(1)})
    assert "REPARTITION_BY_NUM" in plan_of(grid) and grid.count() == 360
    spark.range(9).selectExpr("id AS s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    events = spark.range(30).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01' + make_dt_interval(cast(id % 5 as int)) AS ts", "id AS user_id", "'error' AS event_type", "200.0D AS value", "'' AS props")
    events.write.parquet(str(tmp_path / "events.parquet"))
    scores = Tables(spark, str(tmp_path)).scores
    assert "REPARTITION_BY_NUM" in plan_of(scores) and scores.count() == 45


def hotspot_tables(spark):
    """Machines and complaints around two towns; with rows that come twice, places and ids that are missing and an alert of an unknown machine."""
    rng, as_of = random.Random(7), datetime(2024, 1, 10)
    spot = lambda: (rng.choice([12.0, 40.0]) + rng.uniform(-0.03, 0.03), rng.choice([77.0, 179.99]) + rng.uniform(-0.03, 0.009))
    atms = [(f"A{i}", *spot()) for i in range(40)] + [("A3", *spot()), ("A4", None, 77.0), ("A50", None, 1.0), (None, 12.0, 77.0)]
    alerts = [(f"L{i}-{k}", f"A{i}", 0.7 + i / 200) for i in [*range(0, 40, 2), 3, 50, 99] for k in range(1 + i % 3)] + [("L", None, 0.9), ("L0-0", "A0", 0.7)]
    filed = lambda i: as_of - timedelta(hours=rng.choice([0, 1, 1, 5, 23, 24, 25]), seconds=rng.choice([0, 0, i]))
    complaints = [(None if i == 5 else f"C{i}", filed(i), f"k{i % 3}", *spot(), i + 0.5, f"AC{i % 4}" if i % 3 else None) for i in range(300)]
    complaints += [complaints[7], ("C900", None, "k0", 12.0, 77.0, 1.0, None), ("C901", as_of, "k0", None, 77.0, 1.0, None)]
    place = "'S' state, 'D' district, 'B' bank_name, 'P' police_station_area"
    return (
        spark.createDataFrame(alerts, "alert_id string, atm_id string, risk_score double").selectExpr("*", *place.split(", ")),
        spark.createDataFrame(atms, "atm_id string, latitude double, longitude double"),
        spark.createDataFrame(complaints, "complaint_id string, filing_timestamp timestamp_ntz, complaint_type string, victim_lat double, victim_lon double, "
                              "amount_lost double, linked_account_token string"),
        spark.createDataFrame([("A0", "AC1", as_of, 1.0)], "atm_id string, account_token string, timestamp timestamp_ntz, amount double"),
        as_of, alerts, atms, complaints,
    )


@pytest.mark.parametrize(("most", "bound"), [(None, 20), (3, 200_000)])
def test_hotspot_lists_equal_brute_force(spark, monkeypatch, most, bound):
    monkeypatch.setattr(reports, "ALERTS_A_ROW", 1)
    alerts, atms, complaints, withdrawals, as_of, raised, machines, filed = hotspot_tables(spark)
    p = math.pi / 180
    km = lambda a, b, c, d: 2 * 6371.0 * math.asin(min(1, math.sqrt(
        math.sin((c - a) * p / 2) ** 2 + math.cos(a * p) * math.cos(c * p) * math.sin((d - b) * p / 2) ** 2)))
    recent = [c for c in filed if c[1] and as_of - timedelta(hours=24) <= c[1] <= as_of and c[3] is not None]
    want = []
    for alert, machine, score in raised:
        near = [c for m, la, lo in machines if machine and m == machine and la is not None for c in recent if km(la, lo, c[3], c[4]) <= 2.0]
        near.sort(key=lambda c: (as_of - c[1], c[0] or ""))
        listed = [(i + 1, c[0], c[2], c[5], c[6]) for i, c in enumerate(near[:most])]
        want.append((alert, machine, score, len(near), listed or None, ["AC1"] if machine == "A0" else None))
    assert sum(n for *_, n, _, _ in want) > 200
    report = reports.hotspot_report(alerts, atms, complaints, withdrawals, as_of, most, bound=bound)
    got = [(r.case_ref, r.atm_id, r.risk_score, r.complaints_near, r.linked_complaints and [tuple(x) for x in r.linked_complaints], r.mule_account_tokens)
           for r in report.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_hotspot_lists_stay_where_they_are_made(spark):
    alerts, atms, complaints, withdrawals, as_of, *_ = hotspot_tables(spark)
    once = atms.where("atm_id IS NOT NULL").dropDuplicates(["atm_id"])
    plan = plan_of(reports.hotspot_report(alerts, once, complaints, withdrawals, as_of, None)).split("== Physical Plan ==")[1].splitlines()
    made = next(i for i, line in enumerate(plan) if "filter(" in line and "lambda" in line)
    assert not any("Exchange" in line or "Sort " in line for line in plan[:made])


def test_a_busy_cell_is_shared_out(spark):
    points = spark.range(200).selectExpr("id p", "12.0D + id / 10000 la", "77.0D lo")
    centres = spark.range(50).selectExpr("id c", "12.0D cla", "77.0D clo")
    got = joins.lists_near(centres, points, 1.0, "cla", "clo", "la", "lo", F.struct("p"), "found", share=5)
    assert {r.c: [x.p for x in r.found] for r in got.collect()} == {c: list(range(90)) for c in range(50)}
    assert joins.crowded(centres, points, 1.0, "cla", "clo", "la", "lo", 10).count() == 50
    assert joins.crowded(centres, points, 1.0, "cla", "clo", "la", "lo", 200).count() == 0


def test_arrays_are_gathered_by_as_many_tasks_as_they_need(spark):
    points = spark.range(400).selectExpr("id p", "12.0D + id / 1000 la", "77.0D + id / 1000 lo").coalesce(1)
    centres = spark.range(40).selectExpr("id c", "12.0D + id / 100 cla", "77.0D + id / 100 clo")
    got = joins.lists_near(centres, points, 1.0, "cla", "clo", "la", "lo", F.struct("p"), "found", gathered=100)
    # 400 points in nine copies each, and none is gathered before it is dealt out.
    assert plan_of(got).count(", 36), REPARTITION_BY_NUM") == 2
    pairs = joins.near(points, centres, 1.0, "la", "lo", "cla", "clo").groupBy("c").agg(F.sort_array(F.collect_list("p")).alias("found"))
    assert {r.c: [x.p for x in r.found] for r in got.where("found IS NOT NULL AND size(found) > 0").collect()} == {r.c: r.found for r in pairs.collect()}
