"""The hourly feature matrix: one row per machine and hour, 13 features, and its 24-hour label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outflow.operators.windows import ordered
from outflow.plans.steps import Linked, account_steps, before, city_steps, machine_steps, step_of, step_start

HOURS = 1

# The feature columns in their published order.
FEATURES = [
    "withdrawals_1h", "withdrawals_6h", "withdrawals_24h", "amount_sum_24h", "amount_mean_24h",
    "distinct_accounts_24h", "counterparty_count_24h", "linked_proportion_24h", "transaction_frequency_24h",
    "n_complaints_city_24h", "n_complaints_city_7d", "hour_of_day", "is_night",
]


def hour_number(day: Column) -> Column:
    return step_of(day.cast("timestamp_ntz"), HOURS)


def atm_hour_features(complaints: DataFrame, withdrawals: DataFrame, atms: DataFrame, centres: DataFrame,
                      first: Column, last: Column, history_hours: int = 7 * 24, compat: bool = False) -> DataFrame:
    """Features of the hours first to last (hour numbers), from activity up to ``history_hours`` before.

    Trailing hours end where the row's hour begins. The label says whether fraud follows within 24 hours.
    """
    begin = first - history_hours
    per_account = account_steps(withdrawals, HOURS, F.lit(False))
    steps = machine_steps(per_account, complaints, atms, begin, last + 23, HOURS, {"linked_24h": Linked(24)}, compat)
    spec = ordered(["atm_id"], "step")
    rolled = steps.select(
        "atm_id", "step", "linked_24h", before("n", spec, 1).alias("withdrawals_1h"), before("n", spec, 6).alias("withdrawals_6h"),
        before("n", spec, 24).alias("withdrawals_24h"), (before("cents", spec, 24) / 100.0).alias("amount_sum_24h"),
        before("accounts", spec, 24).alias("distinct_accounts_24h"), F.max("fraud_n").over(spec.rowsBetween(0, 23)).alias("_ahead"),
    ).where(F.col("step").between(first, last))
    n24, accounts = F.col("withdrawals_24h"), F.col("distinct_accounts_24h")
    machines = rolled.withColumns(
        {
            "amount_mean_24h": F.col("amount_sum_24h") / F.greatest(n24, F.lit(1)), "counterparty_count_24h": accounts,
            "linked_proportion_24h": F.col("linked_24h") / F.greatest(accounts, F.lit(1)),
            "transaction_frequency_24h": n24 / 24.0, "label": F.when(F.col("_ahead") > 0, 1).otherwise(0),
        }
    ).drop("linked_24h", "_ahead")

    by_city = ordered(["city"], "step")
    cities = city_steps(complaints, centres, begin, last, HOURS).select(
        "city", "step", before("n", by_city, 24).alias("n_complaints_city_24h"),
        before("n", by_city, 168).alias("n_complaints_city_7d"),
    ).where(F.col("step") >= first)
    wide = machines.join(atms.select("atm_id", "city"), "atm_id").join(cities, ["city", "step"], "left")
    hour = step_start(F.col("step"), HOURS)
    wide = wide.withColumns(
        {"hour": hour, "hour_of_day": F.hour(hour), "is_night": ((F.hour(hour) >= 19) | (F.hour(hour) < 5)).cast("int")}
    )
    return wide.select("atm_id", "hour", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURES], "label")


def atm_hour_label(withdrawals: DataFrame, atms: DataFrame, first: Column, last: Column) -> DataFrame:
    """(atm_id, hour, label): 1 if fraud happens in [hour, hour + 24 h).

    Each distinct (machine, hour) with fraud marks the 24 hours it can be seen from; nothing else is expanded.
    """
    fraud = withdrawals.where("is_fraud_withdrawal").select("atm_id", step_of(F.col("timestamp"), HOURS).alias("at")).distinct()
    seen = fraud.select("atm_id", F.explode(F.sequence(F.col("at") - 23, F.col("at"))).alias("step")).distinct()
    grid = atms.select("atm_id", F.explode(F.sequence(first, last)).alias("step"))
    return grid.join(seen.withColumn("label", F.lit(1)), ["atm_id", "step"], "left").select(
        "atm_id", step_start(F.col("step"), HOURS).alias("hour"), F.coalesce("label", F.lit(0)).alias("label")
    )
