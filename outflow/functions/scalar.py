"""Column expressions: bands, texts, geography, calendar. All native, none needs a shuffle."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds of the risk bands.
CRITICAL, HIGH, MEDIUM = 0.85, 0.70, 0.40
HOLD_BELOW = 0.78

# Advice texts by level, and the text of the weak-evidence band.
ADVICE = {
    "CRITICAL": "Review recommended — verify evidence, then coordinate branch + police station",
    "HIGH": "Review recommended — enhanced monitoring + notify local police station",
}
ADVICE_DEFAULT = "Review recommended — monitor ATM activity and CCTV"
CONFIDENCE_HOLD = "INSUFFICIENT CONFIDENCE — HOLD ACTION for horizon-based recommendations"
ADVICE_HOLD = "INSUFFICIENT EVIDENCE — HOLD ACTION (review recommended; evidence below strength threshold)"

# Graded response steps (step, action, owner, lowest score).
RESPONSE_STEPS = [
    (1, "Notify branch — flag ATM to branch manager + cash-in-charge", "Bank", HIGH),
    (2, "Heighten transaction monitoring at the ATM (linked accounts, chunking, velocity)", "Bank", HIGH),
    (3, "CCTV review + pre-position request near the ATM window", "Police (SHO)", CRITICAL),
    (4, "Tighten withdrawal verification for flagged linked-account tokens (CFCFRMS path)", "Bank + I4C", CRITICAL),
]

# Days of the month on which salaries arrive, and the festival calendar.
SALARY_DAYS = [1, 5, 10, 15]
FESTIVALS = [
    "2026-01-14", "2026-02-14", "2026-02-19", "2026-03-04", "2026-04-14", "2026-04-19", "2026-05-27", "2026-07-27",
    "2026-08-16", "2026-08-24", "2026-09-05", "2026-11-09", "2026-11-16", "2026-12-11", "2026-12-25",
]

# Night hours of the trailing night ratio, and of the evidence text.
NIGHT_RATIO_HOURS = [22, 23, 0, 1, 2, 3]
NIGHT_HOURS = [19, 20, 21, 22, 23, 0, 1, 2, 3, 4]

EARTH_RADIUS_KM = 6371.0
EPOCH_DAY = "2024-01-01"


def rounded(value: Column, places: int = 4) -> Column:
    """Half-up rounding that is not thrown off by the last bits of a double."""
    return F.round(F.round(value, 10), places)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), 2
    )
    angle = F.when(half >= 1, math.pi / 2).otherwise(F.asin(F.sqrt(half)))
    return F.lit(2 * EARTH_RADIUS_KM) * angle


def risk_level(score: Column) -> Column:
    return (
        F.when(score >= CRITICAL, "CRITICAL").when(score >= HIGH, "HIGH").when(score >= MEDIUM, "MEDIUM").otherwise("LOW")
    )


def alert_tier(score: Column) -> Column:
    return F.when(score >= CRITICAL, "dispatch").when(score >= HIGH, "action").otherwise("monitor")


def recommend_action(level: Column) -> Column:
    chosen = F.when(level == "CRITICAL", ADVICE["CRITICAL"]).when(level == "HIGH", ADVICE["HIGH"])
    return chosen.otherwise(ADVICE_DEFAULT)


def alert_advice(score: Column) -> Column:
    """The advice of the score's level, replaced by the hold text just above the threshold."""
    held = (score >= HIGH) & (score < HOLD_BELOW)
    return F.when(held, ADVICE_HOLD).otherwise(recommend_action(risk_level(score)))


def graded_actions(score: Column) -> Column:
    steps = F.array(
        *[
            F.when(
                score >= lowest, F.struct(F.lit(n).alias("step"), F.lit(what).alias("action"), F.lit(who).alias("owner"))
            )
            for n, what, who, lowest in RESPONSE_STEPS
        ]
    )
    return F.array_compact(steps)


def horizon_confidence(precision: Column) -> Column:
    return F.when(precision >= 0.70, "HIGH").when(precision >= 0.45, "MEDIUM").otherwise(CONFIDENCE_HOLD)


def percentile_label(value: Column, quantiles: Sequence[Column]) -> Column:
    """Place a value against the .50, .90, .95 and .99 quantiles of a reference."""
    q50, q90, q95, q99 = quantiles
    return (
        F.when(value >= q99, "99th percentile").when(value >= q95, "95th percentile")
        .when(value >= q90, "90th percentile").when(value >= q50, "above median").otherwise("below median")
    )


def evidence_confidence(score: Column, contributions: Column, freezes: Column) -> Column:
    """Struct (strength, confidence, insufficient)."""
    strength = F.least(F.lit(1) + contributions + freezes, F.lit(5))
    confidence = (
        F.when((score >= CRITICAL) & (strength >= 4), "High")
        .when((score >= HIGH) | (strength >= 3), "Medium").otherwise("Low")
    )
    return F.struct(
        strength.alias("strength"), confidence.alias("confidence"), (strength < 3).alias("insufficient_evidence")
    )


def day_part(ts: Column) -> Column:
    """Label such as 2024-01-03 06-12."""
    first = F.floor(F.hour(ts) / 6) * 6
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(F.date_format(ts, "yyyy-MM-dd"), F.lit(" "), pad(first), F.lit("-"), pad(first + 6))


def six_hour_start(ts: Column) -> Column:
    return F.make_timestamp_ntz(
        F.year(ts), F.month(ts), F.dayofmonth(ts), (F.floor(F.hour(ts) / 6) * 6).cast("int"), F.lit(0), F.lit(0)
    )


def hour_start(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def hour_index(ts: Column) -> Column:
    """Whole hours since 1970, an integer axis for range windows."""
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / 3600).cast("bigint")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def hours_between(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / 3_600_000_000.0


def is_night(hour: Column) -> Column:
    return hour.isin(NIGHT_RATIO_HOURS)


def nearest_event_distance(day: Column, calendar: Sequence[str] = FESTIVALS) -> Column:
    """Days to the nearest date of a short fixed list."""
    dates = F.array(*[F.lit(date.fromisoformat(d)) for d in calendar])
    return F.array_min(F.transform(dates, lambda d: F.abs(F.datediff(day, d))))


def refill_cycle_flag(days_since_epoch: Column, period: float = 3.0) -> Column:
    return F.when((days_since_epoch % period) / period < 0.08, 1.0).otherwise(0.0)


def argmax_name(columns: Mapping[str, Column]) -> Column:
    """Name of the largest column; the first one wins a tie."""
    top = F.greatest(*columns.values())
    chosen = None
    for name, column in columns.items():
        chosen = F.when(column == top, name) if chosen is None else chosen.when(column == top, name)
    return chosen


def emerging_risk(f: Mapping[str, Column]) -> Column:
    surge = F.least(f["n_complaints_city_24h"] / F.greatest(f["n_complaints_city_7d"] / 7.0, F.lit(1.0)), F.lit(2.0)) / 2.0
    mules = F.least(
        f["counterparty_count_24h"] / F.greatest(f["distinct_accounts_24h"].cast("double"), F.lit(1.0)), F.lit(1.0)
    )
    velocity = F.least(f["withdrawals_6h"] / F.greatest(f["withdrawals_24h"] / 4.0, F.lit(1.0)), F.lit(2.0)) / 2.0
    return rounded(F.least(0.4 * surge + 0.35 * mules + 0.25 * velocity, F.lit(1.0)), 4)


def intervention_priority(f: Mapping[str, Column], p: Column) -> Column:
    exposure = F.least(f["amount_sum_24h"] / 1_000_000.0, F.lit(1.0))
    evidence = F.least(
        F.lit(1.0),
        0.25
        + 0.25 * F.least(f["counterparty_count_24h"] / 8.0, F.lit(1.0))
        + 0.25 * f["linked_proportion_24h"]
        + 0.25 * F.least(f["n_complaints_city_24h"] / 40.0, F.lit(1.0)),
    )
    weight = F.when(p >= 0.80, 1.0).when(p >= 0.70, 0.7).otherwise(0.4)
    return rounded((0.40 * p + 0.25 * exposure + 0.15 * emerging_risk(f) + 0.20 * evidence) * weight, 4)
