"""Stateful alerting: the duplicate rule per machine and the escalation of alerts that nobody acts on.

The state is one session per open alert, and for the duplicate rule the machines' last alerts within the cooldown and the rows that
the watermark has not passed. Input is read frame by frame; no step joins the frames of a key's batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from outflow.functions.scalar import HIGH
from outflow.operators.alerts import COOLDOWN_HOURS, MATERIAL_RISE

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

ALERT_OUT = "atm_id string, at timestamp, risk_score double, outcome string, risk_delta_vs_last double"
#: Waiting rows of one bucket of machines are kept by the hour.
SLOT_MS = 3_600_000
#: Keys of the alert state; a machine is in one of them.
BUCKETS = 64


def micros(times: pd.Series) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


class AlertProcessor(StatefulProcessor):
    """Remembers each machine's last alert (time, risk); later flags become new alerts or re-observations.

    A row waits until the watermark has passed it, so rows are judged in the order of their times whatever batch they come in.
    A key is a bucket of machines. Its waiting rows lie in a map by the hour in which they are due, each hour with one timer at its
    earliest row: an arrival and a timer touch the rows of their own hour, and all rows of an hour that are due are judged in one call.
    """

    def __init__(self, cooldown_hours: float = COOLDOWN_HOURS, rise: float = MATERIAL_RISE):
        self.cooldown, self.rise = int(cooldown_hours * 3_600_000_000), rise

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        rows = "atm_id array<string>, at_us array<long>, risk array<double>"
        self.last = handle.getValueState("last", rows)
        self.pending = handle.getMapState("pending", "slot long", rows)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived: dict[int, list[tuple[str, int, float]]] = {}
        for frame in rows:
            for atm, at, risk in zip(frame["atm_id"].tolist(), micros(frame["at"]), map(float, frame["risk_score"])):
                arrived.setdefault(_due(at) // SLOT_MS, []).append((atm, at, risk))
        for slot, new in arrived.items():
            due = min(_due(at) for _, at, _ in new)
            if self.pending.containsKey((slot,)):
                held = [*zip(*self.pending.getValue((slot,)))]
                first = min(_due(int(at)) for _, at, _ in held)
                if due < first:
                    self.handle.deleteTimer(first)
                    self.handle.registerTimer(due)
                new = held + new
            else:
                self.handle.registerTimer(due)
            self.pending.updateValue((slot,), _columns(new))
        yield self._out([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Timers of one key expire in the order of their times.
        due, passed = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        slot = (due // SLOT_MS,)
        held = [*zip(*self.pending.getValue(slot))] if self.pending.containsKey(slot) else []
        rows = [(atm, int(at), float(risk)) for atm, at, risk in held]
        ready = [r for r in rows if _due(r[1]) <= max(due, passed)]
        later = [r for r in rows if _due(r[1]) > max(due, passed)]
        if later:
            self.pending.updateValue(slot, _columns(later))
            self.handle.registerTimer(min(_due(at) for _, at, _ in later))
        elif rows:
            self.pending.removeKey(slot)
        last = {atm: (int(at), float(risk)) for atm, at, risk in zip(*self.last.get())} if self.last.exists() else {}
        out = []
        for atm, at, risk in sorted(ready, key=lambda r: r[1:]):
            state = last.get(atm)
            recent = state is not None and at - state[0] <= self.cooldown
            delta = risk - state[1] if recent else None
            if recent and delta <= self.rise:
                out.append((atm, at, risk, "reobserved", delta))
                continue
            out.append((atm, at, risk, "new", delta))
            last[atm] = (at, risk)
        if out:
            # What comes later is later than these rows, so an alert out of the cooldown bears on nothing.
            newest = max(at for _, at, _, _, _ in out)
            self.last.update(_columns([(atm, at, risk) for atm, (at, risk) in last.items() if newest - at <= self.cooldown]))
            yield self._out(out)

    @staticmethod
    def _out(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["atm_id", "at", "risk_score", "outcome", "risk_delta_vs_last"])
        out["at"] = pd.to_datetime(out["at"].astype("int64"), unit="us")
        return out.astype({"risk_delta_vs_last": "float64", "risk_score": "float64", "atm_id": "object", "outcome": "object"})

    def close(self) -> None:
        pass


def _due(at_us: int) -> int:
    return -(-at_us // 1000)


def _columns(rows: list[tuple]) -> tuple[list, ...]:
    return tuple(map(list, zip(*rows)))


def use_rocksdb(df: DataFrame) -> None:
    """Timers and typed state need the RocksDB provider; it also keeps large state off the heap."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def stream_alerts(scores: DataFrame, threshold: float = HIGH, **rule) -> DataFrame:
    """(atm_id, at, risk_score) stream with a watermark on ``at`` to alert outcomes; rows below the threshold never leave Spark."""
    use_rocksdb(scores)
    dealt = scores.where(scores["risk_score"] >= threshold).withColumn("bucket", F.pmod(F.xxhash64("atm_id"), F.lit(BUCKETS)))
    return dealt.groupBy("bucket").transformWithStateInPandas(
        AlertProcessor(**rule), outputStructType=ALERT_OUT, outputMode="append", timeMode="eventTime"
    )


def stream_escalate(events: DataFrame, timeout_minutes: int = 120) -> DataFrame:
    """(alert_id, at, kind = created or action) stream with a watermark on ``at`` to escalations.

    An alert is a session that ends when nothing has happened to it for the timeout. An action counts from the alert's creation on, in
    whatever order and batch the two arrive.
    """
    use_rocksdb(events)
    created = F.col("kind").eqNullSafe("created")
    seen = events.groupBy("alert_id", F.session_window("at", f"{timeout_minutes} minutes")).agg(
        F.min(F.when(created, F.col("at"))).alias("created"), F.max(F.when(~created, F.col("at"))).alias("acted")
    )
    unanswered = seen.where(F.col("created").isNotNull() & (F.col("acted").isNull() | (F.col("acted") < F.col("created"))))
    return unanswered.select(
        "alert_id", (F.col("created") + F.expr(f"interval {timeout_minutes} minutes")).alias("escalated_at"),
        F.lit(f"Auto-escalated after {timeout_minutes} min without acknowledgement").alias("decision_reason"),
    )
