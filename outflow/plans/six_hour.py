"""The six-hour feature matrix: one row per machine and aligned six-hour window, 33 features, and its label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outflow.functions import scalar as fx
from outflow.operators.windows import ordered
from outflow.plans.daily import Lookups, with_learned
from outflow.plans.steps import Linked, account_steps, before, city_steps, data_span, hours_since_last, machine_steps, step_of, step_start
from outflow.schemas import FEATURE_TYPES

HOURS = 6

# The feature columns in their published order.
FEATURES = [
    "withdrawals_1h", "withdrawals_6h", "withdrawals_24h", "amount_sum_6h", "distinct_accounts_6h",
    "linked_proportion_6h", "fund_velocity_6h", "activity_spike_flag_6h", "night_ratio_6h", "n_complaints_city_6h",
    "n_complaints_city_24h", "hours_since_last_complaint_city", "t_phishing_7d", "t_investment_fraud_7d",
    "t_job_fraud_7d", "t_upi_fraud_7d", "complaint_decay_5km", "complaint_surge_velocity", "cash_refill_cycle_flag",
    "med_fraud_latency_type_days", "mule_reuse_count_7d", "pin_corridor_dist_km", "is_salary_day", "days_to_festival",
    "prior_alert_fraud_flag", "upi_to_atm_transition_flag", "bank_fraud_rate_hist", "day_of_week", "is_weekend",
    "days_since_epoch", "hawkes_intensity_24h", "dist_to_complaint_centroid_km", "dist_to_city_center_km",
]
META = ["atm_id", "bank_name", "district", "state", "pin", "police_station_area", "latitude", "longitude", "city", "window_start"]


def six_hour_windows(complaints: DataFrame, withdrawals: DataFrame) -> DataFrame:
    """The aligned windows that cover the data."""
    first, last = data_span(complaints, withdrawals, HOURS)
    span = complaints.sparkSession.range(1).select(F.explode(F.sequence(first, last)).alias("step"))
    return span.select(step_start(F.col("step"), HOURS).alias("window_start"))


def atm_6h_features(complaints: DataFrame, withdrawals: DataFrame, atms: DataFrame, centres: DataFrame,
                    lookups: Lookups = Lookups(), compat: bool = False) -> DataFrame:
    """Counts named 6h / 24h cover 2 / 5 windows, kinds cover 28; three features are fixed at 0 in this set."""
    first, last = data_span(complaints, withdrawals, HOURS)
    # A window counts as night by its start hour, so only the one from midnight does.
    per_account = account_steps(withdrawals, HOURS, F.hour("timestamp") < 6)
    steps = machine_steps(per_account, complaints, atms, first, last, HOURS, {"linked_6h": Linked(2)}, compat)
    spec = ordered(["atm_id"], "step")
    rolled = steps.select(
        "atm_id", "step", "linked_6h", before("n", spec, 1).alias("withdrawals_1h"), before("n", spec, 2).alias("withdrawals_6h"),
        before("n", spec, 5).alias("withdrawals_24h"), (before("cents", spec, 2) / 100.0).alias("amount_sum_6h"),
        before("accounts", spec, 1).alias("distinct_accounts_6h"), before("night_n", spec, 5).alias("_night"),
        F.when(F.col("fraud_n") > 0, 1).otherwise(0).alias("label"),
    )
    w1, w6, w24 = F.col("withdrawals_1h"), F.col("withdrawals_6h"), F.col("withdrawals_24h")
    machines = rolled.withColumns(
        {
            "linked_proportion_6h": F.when(w6 > 0, F.col("linked_6h") / w6).otherwise(0.0),
            "fund_velocity_6h": F.col("amount_sum_6h") / 6.0,
            "activity_spike_flag_6h": F.when((w1 >= 3) & (w1 >= 2.0 * w6 / 6.0), 1.0).otherwise(0.0),
            "night_ratio_6h": F.when(w24 > 0, F.col("_night") / w24).otherwise(0.0),
        }
    ).drop("linked_6h", "_night")

    by_city = ordered(["city"], "step")
    cities = city_steps(complaints, centres, first, last, HOURS).select(
        "city", "step", before("n", by_city, 2).alias("n_complaints_city_6h"),
        before("n", by_city, 5).alias("n_complaints_city_24h"),
        hours_since_last(by_city, HOURS).alias("hours_since_last_complaint_city"),
        *[before(t, by_city, 28).alias(f"t_{t}_7d") for t in FEATURE_TYPES],
    )
    previous = F.lag("n_complaints_city_24h", 1).over(by_city)
    velocity = (F.col("n_complaints_city_6h") - previous) / F.greatest(previous, F.lit(1))
    cities = cities.withColumn("complaint_surge_velocity", F.coalesce(velocity, F.lit(0.0))).join(centres, "city")

    wide = machines.join(atms, "atm_id").join(cities, ["city", "step"], "left")
    start = step_start(F.col("step"), HOURS)
    day = F.to_date(start)
    epoch = F.datediff(day, F.lit(fx.EPOCH_DAY).cast("date")) + F.hour(start) / 24.0
    distance = fx.haversine_km(F.col("latitude"), F.col("longitude"), F.col("cc_lat"), F.col("cc_lon"))
    zero = F.lit(0.0)
    wide = wide.withColumns(
        {
            "window_start": start,
            "dist_to_complaint_centroid_km": distance, "dist_to_city_center_km": distance,
            "pin_corridor_dist_km": distance, "complaint_decay_5km": F.exp(-distance / 5.0),
            "cash_refill_cycle_flag": fx.refill_cycle_flag(epoch),
            "is_salary_day": F.dayofmonth(day).isin(fx.SALARY_DAYS).cast("double"),
            "days_to_festival": fx.nearest_event_distance(day),
            "day_of_week": F.weekday(day), "is_weekend": (F.weekday(day) >= 5).cast("int"), "days_since_epoch": epoch,
            "upi_to_atm_transition_flag": F.when(
                (F.col("t_upi_fraud_7d") > 0) & (F.col("withdrawals_24h") > 0), 1.0
            ).otherwise(0.0),
            "mule_reuse_count_7d": zero, "prior_alert_fraud_flag": zero, "hawkes_intensity_24h": zero,
        }
    )
    wide = with_learned(wide, lookups)
    return wide.select(*META, *[F.coalesce(F.col(c).cast("double"), zero).alias(c) for c in FEATURES], "label")


def atm_6h_label(withdrawals: DataFrame, atms: DataFrame, first: Column, last: Column) -> DataFrame:
    """(atm_id, window_start, label) for window numbers first to last."""
    fraud = withdrawals.where("is_fraud_withdrawal").select("atm_id", step_of(F.col("timestamp"), HOURS).alias("step")).distinct()
    grid = atms.select("atm_id", F.explode(F.sequence(first, last)).alias("step"))
    return grid.join(fraud.withColumn("label", F.lit(1)), ["atm_id", "step"], "left").select(
        "atm_id", step_start(F.col("step"), HOURS).alias("window_start"), F.coalesce("label", F.lit(0)).alias("label")
    )
