"""The daily feature matrix: one row per machine and day, 44 features, and its label."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outflow.functions import scalar as fx
from outflow.operators.aggregates import first_value_per
from outflow.operators.joins import lookup
from outflow.operators.windows import decayed_sum, ordered, rows_before
from outflow.plans.hawkes import hawkes_intensity
from outflow.plans.steps import Linked, account_steps, before, city_daily, city_steps, data_span, hours_since_last, machine_steps, step_of, step_start
from outflow.schemas import FEATURE_TYPES

__all__ = ["FEATURES", "Lookups", "atm_day_features", "atm_day_label", "city_daily", "city_features", "machine_features"]

HOURS = 24

# The feature columns in their published order.
FEATURES = [
    "n_complaints_city_24h", "n_complaints_city_7d", "hours_since_last_complaint_city", "n_complaints_district_24h",
    "t_phishing_7d", "t_investment_fraud_7d", "t_job_fraud_7d", "t_upi_fraud_7d",
    "withdrawals_1h", "withdrawals_6h", "withdrawals_24h", "amount_sum_24h", "distinct_accounts_24h",
    "linked_proportion_24h", "transaction_frequency_24h", "counterparty_count_24h", "fund_velocity_24h",
    "activity_spike_flag", "hawkes_intensity_24h", "dist_to_complaint_centroid_km", "dist_to_city_center_km",
    "day_of_week", "is_weekend", "days_since_epoch", "complaint_decay_5km", "complaint_surge_velocity",
    "cash_refill_cycle_flag", "med_fraud_latency_type_days", "mule_reuse_count_7d", "pin_corridor_dist_km",
    "is_salary_day", "days_to_festival", "prior_alert_fraud_flag", "upi_to_atm_transition_flag",
    "bank_fraud_rate_hist", "night_ratio_24h", "amount_mean_7d", "amount_max_7d", "round_count_7d", "large_count_7d",
    "heavy_count_7d", "amount_max_1d", "large_count_1d", "fraud_decay_7d",
]
META = ["atm_id", "bank_name", "branch_name", "city", "district", "state", "pin", "police_station_area", "latitude", "longitude", "day"]

LINKED = {
    "linked_withdrawals_24h": Linked(1),
    "counterparty_count_24h": Linked(2, per_account=True),
    "mule_reuse_count_7d": Linked(8, per_account=True, fraud_only=True),
}


@dataclass(frozen=True)
class Lookups:
    """Tables learned from the training period; a missing one leaves its feature at 0."""

    latency: DataFrame | None = None  # complaint_type, latency_days
    bank_rate: DataFrame | None = None  # bank_name, fraud_rate
    hawkes: DataFrame | None = None  # city, mu, alpha, beta


def city_features(complaints: DataFrame, centres: DataFrame, first: Column, last: Column) -> DataFrame:
    """Complaint features per city and day. ``centres`` lists the cities (city, cc_lat, cc_lon)."""
    spec = ordered(["city"], "step")
    steps = city_steps(complaints, centres, first, last, HOURS)
    # Windows first, each once; everything derived from them in the next projection.
    rolled = steps.select(
        "city", "step", "n",
        before("n", spec, 2).alias("n_complaints_city_24h"), before("n", spec, 8).alias("n_complaints_city_7d"),
        hours_since_last(spec, HOURS).alias("hours_since_last_complaint_city"),
        *[before(t, spec, 8).alias(f"t_{t}_7d") for t in FEATURE_TYPES],
        before("lat_sum", spec, 8).alias("_lat"), before("lon_sum", spec, 8).alias("_lon"),
    )
    some = F.col("n_complaints_city_7d") > 0
    rolled = rolled.withColumns(
        {"clat": F.when(some, F.col("_lat") / F.col("n_complaints_city_7d")), "clon": F.when(some, F.col("_lon") / F.col("n_complaints_city_7d"))}
    )
    previous = F.lag("n_complaints_city_24h", 1).over(spec)
    velocity = (F.col("n_complaints_city_24h") - previous) / F.greatest(previous, F.lit(1))
    rolled = rolled.withColumn("complaint_surge_velocity", F.coalesce(velocity, F.lit(0.0)))

    home = first_value_per(complaints, "victim_city", "victim_district", ["filing_timestamp", "victim_district"])
    home = home.select(F.col("victim_city").alias("city"), F.col("victim_district").alias("complaint_district"))
    filed = complaints.groupBy(
        F.col("victim_district").alias("complaint_district"), step_of(F.col("filing_timestamp"), HOURS).alias("filed")
    ).agg(F.count("*").alias("c"))
    # Two trailing days: a count of day x belongs to the rows of the next two days.
    district = filed.withColumn("step", F.explode(F.sequence(F.col("filed") + 1, F.col("filed") + 2))).groupBy(
        "complaint_district", "step"
    ).agg(F.sum("c").alias("n_complaints_district_24h"))
    out = rolled.join(home, "city", "left").join(district, ["complaint_district", "step"], "left")
    return out.join(centres, "city").select(
        "city", "step", "n", "n_complaints_city_24h", "n_complaints_city_7d", "hours_since_last_complaint_city",
        F.coalesce("n_complaints_district_24h", F.lit(0)).alias("n_complaints_district_24h"),
        *[f"t_{t}_7d" for t in FEATURE_TYPES], "complaint_surge_velocity",
        F.coalesce("clat", "cc_lat").alias("clat"), F.coalesce("clon", "cc_lon").alias("clon"), "cc_lat", "cc_lon",
    )


def machine_features(per_account: DataFrame, complaints: DataFrame, atms: DataFrame, first: Column, last: Column,
                     compat: bool = False) -> DataFrame:
    """Withdrawal features per machine and day from ``account_steps``; every window shares one sort by machine and day."""
    steps = machine_steps(per_account, complaints, atms, first, last, HOURS, LINKED, compat)
    spec = ordered(["atm_id"], "step")
    steps = steps.withColumn("amount_mean", F.when(F.col("n") > 0, F.col("cents") / F.col("n") / 100.0).otherwise(0.0))
    # Windows first, each once; everything derived from them in the next projection.
    rolled = steps.select(
        "atm_id", "step", "linked_withdrawals_24h", "counterparty_count_24h", "mule_reuse_count_7d",
        before("w1", spec, 1).alias("withdrawals_1h"), before("w6", spec, 1).alias("withdrawals_6h"),
        before("n", spec, 1).alias("withdrawals_24h"), (before("cents", spec, 1) / 100.0).alias("amount_sum_24h"),
        before("accounts", spec, 2).alias("distinct_accounts_24h"), before("night_n", spec, 1).alias("_night"),
        before("amount_mean", spec, 7, F.avg).alias("amount_mean_7d"), before("amount_max", spec, 7, F.max).alias("amount_max_7d"),
        before("round_n", spec, 7).alias("round_count_7d"), before("large_n", spec, 7).alias("large_count_7d"),
        before("heavy_n", spec, 7).alias("heavy_count_7d"),
        before("amount_max", spec, 1, F.max).alias("amount_max_1d"), before("large_n", spec, 1).alias("large_count_1d"),
        decayed_sum("fraud_n", spec, 7, 2.0, first_lag=1).alias("fraud_decay_7d"),
        F.when(F.max("fraud_n").over(rows_before(spec, 7)) > 0, 1.0).otherwise(0.0).alias("prior_alert_fraud_flag"),
        F.when(F.col("fraud_n") > 0, 1).otherwise(0).alias("label"),
    )
    w1, w24 = F.col("withdrawals_1h"), F.col("withdrawals_24h")
    return rolled.withColumns(
        {
            "linked_proportion_24h": F.when(w24 > 0, F.col("linked_withdrawals_24h") / w24).otherwise(0.0),
            "transaction_frequency_24h": F.when(w24 > 0, w24 / F.greatest("distinct_accounts_24h", F.lit(1))).otherwise(0.0),
            "fund_velocity_24h": F.col("amount_sum_24h") / 24.0,
            "activity_spike_flag": F.when((w1 >= 3) & (w1 >= 2.0 * w24 / 24.0), 1.0).otherwise(0.0),
            "night_ratio_24h": F.when(w24 > 0, F.col("_night") / w24).otherwise(0.0),
        }
    ).drop("linked_withdrawals_24h", "_night")


def calendar_features(day: Column) -> dict[str, Column]:
    epoch = F.datediff(day, F.lit(fx.EPOCH_DAY).cast("date"))
    weekday = F.weekday(day)
    return {
        "day_of_week": weekday,
        "is_weekend": (weekday >= 5).cast("int"),
        "days_since_epoch": epoch,
        "cash_refill_cycle_flag": fx.refill_cycle_flag(epoch),
        "is_salary_day": F.dayofmonth(day).isin(fx.SALARY_DAYS).cast("double"),
        "days_to_festival": fx.nearest_event_distance(day),
    }


def atm_day_features(
    complaints: DataFrame, withdrawals: DataFrame | None, atms: DataFrame, centres: DataFrame, lookups: Lookups = Lookups(),
    first_day: Column | None = None, last_day: Column | None = None, span: tuple[Column, Column] | None = None,
    compat: bool = False, per_account: DataFrame | None = None,
) -> DataFrame:
    """The matrix with meta columns and the label, for [first_day, last_day] (default: the days with data).

    Of the withdrawals only the days that a row can look back on are read: eight before the first day. ``per_account`` gives them
    already summed up (``plans/summary.py``); then a span must be given too.
    """
    start, end = span or data_span(complaints, withdrawals, HOURS)
    as_step = lambda d: step_of(d.cast("timestamp_ntz"), HOURS)
    last = end if last_day is None else as_step(last_day)
    begin = start if first_day is None else F.greatest(start, as_step(first_day) - 8)
    if per_account is None:
        read = withdrawals if first_day is None else withdrawals.where(F.col("timestamp") >= step_start(begin, HOURS))
        per_account = account_steps(read, HOURS)
    machines = machine_features(per_account, complaints, atms, begin, last, compat)
    cities = city_features(complaints, centres, start, last)
    if lookups.hawkes is not None:
        cities = hawkes_intensity(cities, lookups.hawkes)
    else:
        cities = cities.withColumn("hawkes_intensity_24h", F.lit(0.0))
    if first_day is not None:
        machines = machines.where(F.col("step") >= as_step(first_day))

    wide = machines.join(atms, "atm_id").join(cities.drop("n"), ["city", "step"], "left")
    wide = wide.withColumn("day", F.to_date(step_start(F.col("step"), HOURS)))
    to_centroid = fx.haversine_km(F.col("latitude"), F.col("longitude"), F.col("clat"), F.col("clon"))
    to_centre = fx.haversine_km(F.col("latitude"), F.col("longitude"), F.col("cc_lat"), F.col("cc_lon"))
    wide = wide.withColumns(
        {
            "dist_to_complaint_centroid_km": F.coalesce(to_centroid, F.lit(0.0)),
            "dist_to_city_center_km": F.coalesce(to_centre, F.lit(0.0)),
            "complaint_decay_5km": F.coalesce(F.exp(-to_centroid / 5.0), F.lit(0.0)),
            "pin_corridor_dist_km": F.coalesce(to_centroid, F.lit(0.0)),
            "upi_to_atm_transition_flag": F.when(
                (F.col("t_upi_fraud_7d") > 0) & (F.col("withdrawals_24h") > 0), 1.0
            ).otherwise(0.0),
            **calendar_features(F.col("day")),
        }
    )
    wide = with_learned(wide, lookups)
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURES]
    return wide.select(*META, *filled, "label")


def with_learned(wide: DataFrame, lookups: Lookups) -> DataFrame:
    """Add the two looked-up features."""
    if lookups.bank_rate is not None:
        wide = lookup(wide, lookups.bank_rate, "bank_name", "fraud_rate", "bank_fraud_rate_hist")
    else:
        wide = wide.withColumn("bank_fraud_rate_hist", F.lit(0.0))
    if lookups.latency is not None:
        top = fx.argmax_name({t: F.col(f"t_{t}_7d") for t in FEATURE_TYPES})
        wide = lookup(
            wide.withColumn("complaint_type", top), lookups.latency, "complaint_type", "latency_days",
            "med_fraud_latency_type_days",
        ).drop("complaint_type")
    else:
        wide = wide.withColumn("med_fraud_latency_type_days", F.lit(0.0))
    return wide


def atm_day_label(withdrawals: DataFrame, atms: DataFrame, first: Column, last: Column) -> DataFrame:
    """(atm_id, day, label): 1 if a fraud withdrawal happens at the machine on the day."""
    fraud = withdrawals.where("is_fraud_withdrawal").select("atm_id", F.to_date("timestamp").alias("day")).distinct()
    grid = atms.select("atm_id", F.explode(F.sequence(first, last)).alias("day"))
    return grid.join(fraud.withColumn("label", F.lit(1)), ["atm_id", "day"], "left").select(
        "atm_id", "day", F.coalesce("label", F.lit(0)).alias("label")
    )
