"""How alerts and errors are spread over jurisdictions, complaint areas and kinds of machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outflow.functions import scalar as fx
from outflow.operators.aggregates import terciles


def group_labels(scored: DataFrame, complaints: DataFrame, withdrawals: DataFrame, atms: DataFrame) -> DataFrame:
    """One row per (scored row, group it belongs to): all, city, and terciles of complaints, volume and age."""
    cities = complaints.groupBy(F.col("victim_city").alias("city")).agg(F.count("*").alias("_c"))
    areas = terciles(cities, "_c", "_area").select("city", "_area")
    per_atm = withdrawals.groupBy("atm_id").agg(
        F.count("*").alias("_n"), F.unix_micros(F.min("timestamp").cast("timestamp")).alias("_first")
    )
    volume = terciles(per_atm.select("atm_id", "_n"), "_n", "_volume").select("atm_id", "_volume")
    age = terciles(per_atm.select("atm_id", "_first"), "_first", "_age").select("atm_id", "_age")
    wide = (
        scored.join(atms.select("atm_id", "city"), "atm_id").join(areas, "city", "left")
        .join(volume, "atm_id", "left").join(age, "atm_id", "left")
    )
    named = lambda prefix, column: F.when(F.col(column).isNotNull(), F.concat(F.lit(prefix), F.col(column)))
    groups = F.array_compact(
        F.array(
            F.lit("all"), named("jurisdiction:", "city"), named("complaint_area:", "_area"),
            named("atm_volume:", "_volume"), named("atm_age:", "_age"),
        )
    )
    return wide.select(F.explode(groups).alias("group"), "score", "label")


def group_fairness(labelled: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Per group: rows, base rate, alert rate, false positives over all rows, precision and recall."""
    flagged, fraud = F.col("score") >= threshold, F.col("label") == 1
    share = lambda c: fx.rounded(F.avg(c.cast("double")))
    return labelled.groupBy("group").agg(
        F.count("*").alias("rows"), share(fraud).alias("positive_rate"), share(flagged).alias("alert_rate_0p7"),
        share(flagged & ~fraud).alias("false_positive_rate_0p7"),
        fx.rounded(F.avg(F.when(flagged, F.col("label")))).alias("precision_0p7"),
        fx.rounded(F.avg(F.when(fraud, flagged.cast("double")))).alias("recall_0p7"),
    )
