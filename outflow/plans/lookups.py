"""Small lookup tables learned from the training period and joined to the feature matrix."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outflow.functions import scalar as fx
from outflow.functions.ordering import exact_quantiles
from outflow.operators import aggregates as agg
from outflow.operators.joins import asof_forward
from outflow.operators.listing import at


def city_frauds(withdrawals: DataFrame, atms: DataFrame) -> DataFrame:
    return withdrawals.where("is_fraud_withdrawal").select("atm_id", "timestamp").join(
        atms.select("atm_id", "city"), "atm_id"
    ).select("city", "timestamp")


def latency_by_type(
    complaints: DataFrame, withdrawals: DataFrame, atms: DataFrame, before: datetime | None = None
) -> DataFrame:
    """Median days from a complaint to the next fraud in its city, per kind, over positive latencies."""
    filed, fraud = complaints, city_frauds(withdrawals, atms)
    if before is not None:
        filed = filed.where(F.col("filing_timestamp") < at(before))
        fraud = fraud.where(F.col("timestamp") < at(before))
    asked = filed.select(F.col("victim_city").alias("city"), "filing_timestamp", "complaint_type")
    matched = asof_forward(asked, fraud, ["city"], "filing_timestamp", "timestamp", "next_fraud")
    days = fx.hours_between(F.col("filing_timestamp"), F.col("next_fraud")) / 24.0
    positive = matched.select("complaint_type", days.alias("d")).where(F.col("d") > 0)
    medians = exact_quantiles(positive, ["complaint_type"], "d", [0.5])
    return medians.select("complaint_type", F.element_at("q", 1).alias("latency_days"))


def bank_fraud_rate(withdrawals: DataFrame, atms: DataFrame, before: datetime | None = None) -> DataFrame:
    return agg.fraud_rate_by(withdrawals, atms, "bank_name", before)
