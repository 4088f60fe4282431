from datetime import datetime, timedelta

import pytest

from outflow import schemas
from outflow.operators import alerts as al
from outflow.streaming import jobs, stateful
from outflow.streaming.cycle import AlertCycle

T0 = datetime(2024, 1, 1)


def at(hours):
    return T0 + timedelta(hours=hours)


def arrivals(spark, folder, batches, schema):
    """One file per batch, read one at a time."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/f{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False)
    return stream.parquet(f"{folder}/f*")


WITHDRAWAL = "transaction_id string, timestamp timestamp_ntz, atm_id string, amount double, is_fraud_withdrawal boolean"


def test_duplicates_and_late_rows(spark, tmp_path):
    row = lambda i, h: (f"w{i}", at(h), "A", 100.0, False)
    batches = [[row(1, 0), row(2, 5)], [row(1, 0.5), row(3, 30)], [row(6, 31)], [row(4, 1), row(5, 40)]]
    stream = arrivals(spark, str(tmp_path), batches, WITHDRAWAL)
    out = jobs.drained(jobs.stream_dedup(stream, "transaction_id", "timestamp", "6 hours"))
    # Row 1 comes twice; row 4 is behind the watermark of the batch before it.
    assert sorted(r.transaction_id for r in out.collect()) == ["w1", "w2", "w3", "w5", "w6"]


def test_tumbling_equals_batch_on_closed_windows(spark, tmp_path):
    batches = [[(f"w{i}", at(i), "A", 100.0, i % 3 == 0) for i in range(k, k + 10)] for k in (0, 10, 20)]
    stream = arrivals(spark, str(tmp_path), batches, WITHDRAWAL)
    got = {r.bucket: (r.withdrawals, r.fraud_withdrawals) for r in jobs.drained(jobs.stream_activity(stream)).collect()}
    assert got == {at(h): (6, 2) for h in (0, 6, 12, 18)}


def plain_rule(rows):
    last, out = {}, []
    for atm, t, risk in sorted(rows, key=lambda r: (r[1], r[2])):
        if risk < 0.70:
            continue
        seen = last.get(atm)
        if seen and t - seen[0] <= timedelta(hours=6) and risk - seen[1] <= 0.1:
            out.append((atm, t, "reobserved"))
        else:
            out.append((atm, t, "new"))
            last[atm] = (t, risk)
    return sorted(out)


def test_alert_state_equals_plain_rule_across_batches(spark, tmp_path):
    rows = [("A", at(0), 0.72), ("A", at(1), 0.80), ("A", at(2), 0.85), ("A", at(7), 0.72), ("A", at(9), 0.72)]
    rows += [("B", at(h), 0.60 + (h * 7 % 40) / 100) for h in range(24)]
    hours = lambda r: (r[1] - T0) / timedelta(hours=1)
    batches = [[r for r in rows if lo <= hours(r) < lo + 8] for lo in (0, 8, 16)]
    # Rows of one batch come late, out of order, but ahead of the watermark; the last batch only moves it.
    late = [r for r in batches[0] if hours(r) in (2, 6)]
    batches = [[r for r in batches[0] if r not in late], late[::-1] + batches[1][::-1], batches[2], [("Z", at(100), 0.9)]]
    stream = arrivals(spark, str(tmp_path), batches, "atm_id string, at timestamp, risk_score double").withWatermark("at", "6 hours")
    got = sorted((r.atm_id, r.at, r.outcome) for r in jobs.drained(stateful.stream_alerts(stream)).collect())
    assert got == plain_rule(rows)


def test_escalation_needs_two_quiet_hours(spark, tmp_path):
    batches = [
        # The action on v arrives a batch before its creation; the one on u came before its creation and does not count.
        [("x", at(0), "created"), ("y", at(0), "created"), ("v", at(1), "action"), ("u", at(0), "action")],
        [("y", at(1), "action"), ("v", at(0.95), "created"), ("u", at(0.9), "created")], [("z", at(9), "created")],
    ]
    stream = arrivals(spark, str(tmp_path), batches, "alert_id string, at timestamp, kind string")
    out = jobs.drained(stateful.stream_escalate(stream.withWatermark("at", "10 minutes")))
    assert sorted((r.alert_id, r.escalated_at) for r in out.collect()) == [("u", at(2.9)), ("x", at(2))]


def test_activity_of_both_streams_waits_for_the_later_one(spark, tmp_path):
    drawn = [[(f"w{i}", at(i), "A", 100.0, i % 3 == 0) for i in range(k, k + 10)] for k in (0, 10, 20)]
    filed = [[(f"c{i}", at(i)) for i in (0, 1, 7, 13)], [("c9", at(14))]]
    stream = arrivals(spark, str(tmp_path / "w"), drawn, WITHDRAWAL)
    other = arrivals(spark, str(tmp_path / "c"), filed, "complaint_id string, filing_timestamp timestamp_ntz")
    got = {r.bucket: (r.withdrawals, r.complaints, r.fraud_rate) for r in jobs.drained(jobs.stream_activity(stream, other)).collect()}
    assert got == {at(0): (6, 2, 0.3333), at(6): (6, 1, 0.3333)}


def test_a_repeated_or_failed_batch_changes_nothing(spark, tmp_path, monkeypatch):
    atms = spark.createDataFrame([(f"A{i}", "B", "x", "C", "D", "S", "1", "P", 1.0, 2.0) for i in range(3)], schemas.ATMS)
    cycle = AlertCycle(str(tmp_path / "cycle"), atms, {"withdrawals_24h": 1.0}, -3.0)
    batch = lambda n, h: spark.createDataFrame([(f"w{h}.{i}", at(h), "A1", 100.0, False) for i in range(n)], WITHDRAWAL)
    state = lambda: (sorted(map(tuple, cycle.alerts(spark).collect()), key=str), sorted(map(tuple, cycle.ledger(spark).collect())))
    cycle.run(batch(5, 0), 0)
    first = state()
    assert [a[2] for a in first[0]] == ["A1"] and len(first[1]) == 1
    cycle.run(batch(5, 0), 0)
    assert state() == first

    def broken(*_):
        raise RuntimeError("lost before the ledger")

    with monkeypatch.context() as patch:
        patch.setattr(al, "alert_cycle_summary", broken)
        with pytest.raises(RuntimeError):
            cycle.run(batch(1, 2), 1)
    assert state() == first
    cycle.run(batch(1, 2), 1)
    (alert,) = cycle.alerts(spark).collect()
    # Seen again by the second cycle, whose day holds all six rows, and not yet two hours old.
    assert (alert.reobservation_count, alert.status) == (1, "new")
    cycle.run(batch(1, 9), 2)
    rows = {r.created_at: r.status for r in cycle.alerts(spark).collect()}
    assert rows == {at(1): "escalated", at(10): "new"}
    assert [r.created for r in cycle.ledger(spark).orderBy("batch").collect()] == [1, 0, 1]


def test_escalation_keeps_no_python_state_per_alert(spark, tmp_path):
    batches = [[(f"a{i}", at(0), "created") for i in range(20)] + [("a3", at(0.5), "action"), ("a4", at(0.25), "created")], [("z", at(9), "created")]]
    stream = arrivals(spark, str(tmp_path), batches, "alert_id string, at timestamp, kind string")
    escalated = stateful.stream_escalate(stream.withWatermark("at", "10 minutes"))
    assert "TransformWithState" not in escalated._jdf.queryExecution().analyzed().toString()
    got = {r.alert_id: r.escalated_at for r in jobs.drained(escalated).collect()}
    assert got == {f"a{i}": at(2) for i in range(20) if i != 3}


class FakeState:
    """The calls of a state handle, counted."""

    def __init__(self):
        self.timers, self.calls, self.values, self.one = set(), 0, {}, None

    def getValueState(self, *_):
        return self

    getMapState = getValueState

    def registerTimer(self, due):
        self.calls += 1
        self.timers.add(due)

    def deleteTimer(self, due):
        self.timers.remove(due)

    def containsKey(self, key):
        return key in self.values

    def getValue(self, key):
        return self.values[key]

    def updateValue(self, key, value):
        self.calls += 1
        self.values[key] = value

    def removeKey(self, key):
        del self.values[key]

    def exists(self):
        return self.one is not None

    def get(self):
        return self.one

    def update(self, value):
        self.one = value


def test_waiting_rows_of_an_hour_share_one_timer(spark):
    import pandas as pd

    state, rule = FakeState(), stateful.AlertProcessor()
    rule.init(state)
    rows = [(f"M{i % 7}", at(0) + timedelta(seconds=(i * 977) % 3500), 0.7 + (i * 31 % 29) / 100) for i in range(500)]
    for part in (rows[:200], rows[200:]):
        list(rule.handleInputRows((1,), iter([pd.DataFrame(part, columns=["atm_id", "at", "risk_score"])]), None))
    assert len(state.timers) == 1 and state.calls <= 6
    out, watermark = [], 0
    clock = type("Clock", (), {"getCurrentWatermarkInMs": lambda self: watermark, "getExpiryTimeInMs": lambda self: due})()
    zero = int((T0 - datetime(1970, 1, 1)) / timedelta(milliseconds=1))
    for minutes in (20, 40, 120):
        watermark = zero + minutes * 60_000
        while due := min((t for t in state.timers if t <= watermark), default=None):
            state.timers.remove(due)
            for frame in rule.handleExpiredTimer((1,), clock, clock):
                out += [(r.atm_id, r.at.to_pydatetime(), r.outcome) for r in frame.itertuples()]
    assert not state.timers and sorted(out) == plain_rule(rows)
