"""Five engineered columns for a raw complaint or withdrawal frame; a column whose inputs are missing is 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outflow.operators.joins import amount_cluster
from outflow.operators.windows import cold_start_days, surge_ratio, time_to_withdrawal

CITY = ["victim_city", "city"]
TOKEN = ["linked_account_token", "victim_account_token", "account_token"]
AMOUNT = ["amount_lost", "amount"]


def _first_of(df: DataFrame, names: list[str]) -> str | None:
    return next((n for n in names if n in df.columns), None)


def enrich(df: DataFrame) -> DataFrame:
    """Surge ratio, city spread of the account, time to withdrawal, cold-start flag and amount cluster."""
    city, token, amount = _first_of(df, CITY), _first_of(df, TOKEN), _first_of(df, AMOUNT)
    has_day = "day" in df.columns
    zero = F.lit(0.0)
    out = df
    if city and has_day:
        ratios = surge_ratio(df, city, "day").withColumnRenamed("surge_ratio", "complaint_surge_ratio")
        out = out.join(ratios, [city, "day"], "left")
    else:
        out = out.withColumn("complaint_surge_ratio", zero)
    if city and token:
        spread = df.where(F.col(token).isNotNull()).groupBy(token).agg(
            F.countDistinct(city).cast("double").alias("cross_city_mule_spread")
        )
        out = out.join(spread, token, "left").na.fill(0.0, ["cross_city_mule_spread"])
    else:
        out = out.withColumn("cross_city_mule_spread", zero)
    if {"filing_timestamp", "withdrawal_timestamp"} <= set(df.columns):
        out = time_to_withdrawal(out, "filing_timestamp", "withdrawal_timestamp", "time_to_withdrawal_hist")
    else:
        out = out.withColumn("time_to_withdrawal_hist", zero)
    if "atm_id" in df.columns and has_day:
        flags = cold_start_days(df, "atm_id", "day").withColumnRenamed("cold_start_flag", "atm_cold_start_flag")
        out = out.join(flags, ["atm_id", "day"], "left").na.fill(0.0, ["atm_cold_start_flag"])
    else:
        out = out.withColumn("atm_cold_start_flag", zero)
    if city and has_day and amount:
        out = amount_cluster(out, [city, "day"], amount, out="complaint_amount_cluster")
    elif city and has_day:
        sizes = df.groupBy(city, "day").agg(F.count("*").alias("complaint_amount_cluster"))
        out = out.join(sizes, [city, "day"], "left")
    else:
        out = out.withColumn("complaint_amount_cluster", zero)
    return out.withColumn("complaint_amount_cluster", F.coalesce(F.col("complaint_amount_cluster").cast("double"), zero))
