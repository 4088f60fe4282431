"""What visiting the top k machines per day would have caught, for several strategies, seeds and k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outflow.functions import scalar as fx
from outflow.operators.aggregates import exact_sum
from outflow.operators.joins import proximity_counts


def with_proximity(scores: DataFrame, atms: DataFrame, complaints: DataFrame, km: float = 2.0) -> DataFrame:
    """Add the number of nearby complaints of the last two days as the ranking column of a strategy."""
    counts = proximity_counts(atms, complaints, km)
    return scores.join(counts, ["atm_id", "day"], "left").na.fill(0, ["complaints_nearby"])


def _normal(*keys) -> Column:
    """Standard normal deviate from the row's key: the same whatever the partitioning."""
    uniform = lambda salt: (F.abs(F.xxhash64(*keys, F.lit(salt)) % 1_000_003) + 1) / 1_000_005.0
    return F.sqrt(-2 * F.ln(uniform(1))) * F.cos(2 * 3.141592653589793 * uniform(2))


def intervention_sim(scores: DataFrame, fraud: DataFrame, ks: Sequence[int], seeds: Sequence[int] = (0,),
                     rank_by: str = "score", jitter: float = 0.0) -> DataFrame:
    """Per (seed, k): captured events and amounts, interventions, misses, hours to the first fraud, efficiency.

    ``scores`` has atm_id, day and the ranking column, ``fraud`` atm_id, timestamp and amount. Per seed and day
    only the largest k rows are kept, before the shuffle where k allows it.
    """
    seeded = scores.select("atm_id", "day", F.col(rank_by).cast("double").alias("_s"), F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"))
    noise = _normal("atm_id", "day", "seed") * jitter if jitter else F.lit(0.0)
    order = Window.partitionBy("seed", "day").orderBy((F.col("_s") + noise).desc(), "atm_id")
    best = seeded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(ks))
    visits = best.select("seed", "atm_id", "day", F.explode(F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: k >= F.col("rank"))).alias("k"))

    per_day = fraud.groupBy("atm_id", F.to_date("timestamp").alias("day")).agg(
        F.count("*").alias("n"), F.sum(F.round(F.col("amount") * 100).cast("bigint")).alias("cents"), F.min("timestamp").alias("first")
    )
    totals = fraud.agg(F.struct(F.count("*").alias("n"), exact_sum("amount").alias("amount"))).scalar()
    hours = fx.hours_between(F.col("day").cast("timestamp_ntz"), F.col("first"))
    met = visits.join(per_day, ["atm_id", "day"], "left").groupBy("seed", "k").agg(
        F.count("*").alias("interventions_total"), F.coalesce(F.sum("n"), F.lit(0)).alias("fraud_events_captured"),
        (F.coalesce(F.sum("cents"), F.lit(0)) / 100.0).alias("exposure_captured_inr"),
        F.count_if(F.col("n").isNull()).alias("false_interventions"),
        # At most k values per day and group.
        F.percentile(hours, F.lit(0.5)).alias("_median"),
    ).withColumn("_t", totals)
    n, amount = F.col("_t.n"), F.col("_t.amount")
    return met.select(
        "seed", "k", n.alias("fraud_events_total"), "fraud_events_captured",
        fx.rounded(F.col("fraud_events_captured") / F.greatest(n, F.lit(1))).alias("capture_rate"),
        "exposure_captured_inr",
        fx.rounded(100 * F.col("exposure_captured_inr") / F.greatest(amount, F.lit(1e-9)), 2).alias("loss_prevented_pct"),
        "interventions_total", "false_interventions", (n - F.col("fraud_events_captured")).alias("missed_events"),
        fx.rounded(F.col("_median"), 1).alias("time_to_intervention_median_h"),
        fx.rounded(F.col("exposure_captured_inr") / F.greatest(F.col("interventions_total"), F.lit(1)), 2).alias("efficiency_inr_per_intervention"),
    )


def simulation_summary(runs: DataFrame) -> DataFrame:
    """Per k: mean and central 95 % range over the seeds."""
    band = lambda c: [
        fx.rounded(F.avg(c), 3).alias(f"{c}_mean"), fx.rounded(F.percentile(c, F.lit(0.025)), 3).alias(f"{c}_low"),
        fx.rounded(F.percentile(c, F.lit(0.975)), 3).alias(f"{c}_high"),
    ]
    return runs.groupBy("k").agg(
        *band("capture_rate"), *band("loss_prevented_pct"),
        fx.rounded(F.avg("false_interventions"), 1).alias("false_interventions_mean"),
        fx.rounded(F.avg("missed_events"), 1).alias("missed_events_mean"),
        fx.rounded(F.avg("efficiency_inr_per_intervention"), 2).alias("efficiency_inr_per_intervention_mean"),
        fx.rounded(F.percentile("time_to_intervention_median_h", F.lit(0.5)), 1).alias("time_to_intervention_median_h"),
    )
