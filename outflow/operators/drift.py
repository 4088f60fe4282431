"""Population stability of features against a reference period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outflow.functions import scalar as fx
from outflow.functions.quantiles import cell_counts, exact_cuts

# The monitored features and the two alarm levels.
DRIFT_FEATURES = [
    "n_complaints_city_24h", "n_complaints_city_7d", "n_complaints_district_24h", "t_phishing_7d", "withdrawals_1h",
    "withdrawals_6h", "withdrawals_24h", "amount_sum_24h", "distinct_accounts_24h", "linked_proportion_24h",
    "transaction_frequency_24h", "counterparty_count_24h", "fund_velocity_24h", "hawkes_intensity_24h",
    "dist_to_complaint_centroid_km", "dist_to_city_center_km", "complaint_decay_5km", "complaint_surge_velocity",
    "mule_reuse_count_7d", "pin_corridor_dist_km", "bank_fraud_rate_hist", "night_ratio_24h", "amount_mean_7d",
    "amount_max_7d",
]
RED, YELLOW = 0.20, 0.10
BINS = 10
FLOOR = 1e-6


def _shares(df: DataFrame, edges: dict[str, list[float]]) -> dict[str, list[float]]:
    """Per feature the share of rows in each bin between consecutive edges, the last closed; values outside are dropped.

    A feature with one edge has one bin, which holds every row.
    """
    out = {}
    for feature, cells in cell_counts(df, edges).items():
        at, between = cells[1::2], cells[2::2]
        bins = [int(cells.sum())] if len(at) == 1 else [int(n) for n in at[:-1] + between[:-1]]
        if len(at) > 1:
            bins[-1] += int(at[-1])
        total = max(sum(bins), 1)
        out[feature] = [n / total for n in bins]
    return out


def psi_reference(df: DataFrame, features: Sequence[str] = tuple(DRIFT_FEATURES), bins: int = BINS) -> DataFrame:
    """(feature, edges, expected): distinct decile edges and the share of rows in each bin."""
    filled = df.na.fill(0.0, list(features))
    cuts = exact_cuts(filled, features, [i / bins for i in range(bins + 1)])
    edges = {f: sorted(set(values)) for f, (rows, values) in cuts.items() if rows}
    shares = _shares(filled, edges) if edges else {}
    profile = [(f, [float(e) for e in edges[f]], shares[f]) for f in edges]
    return df.sparkSession.createDataFrame(profile, "feature string, edges array<double>, expected array<double>")


def psi(df: DataFrame, reference: DataFrame, features: Sequence[str] = tuple(DRIFT_FEATURES)) -> DataFrame:
    """(feature, psi): sum of (a - e) ln(a / e) over the bins, shares floored."""
    # One row per monitored feature.
    profile = {r.feature: r for r in reference.where(F.col("feature").isin(list(features))).collect()}
    shares = _shares(df.na.fill(0.0, list(profile)), {f: r.edges for f, r in profile.items()}) if profile else {}
    rows = [(f, list(r.expected), shares[f]) for f, r in profile.items()]
    both = df.sparkSession.createDataFrame(rows, "feature string, expected array<double>, actual array<double>")
    floored = lambda c: F.greatest(c, F.lit(FLOOR))
    term = F.zip_with("actual", "expected", lambda a, e: (floored(a) - floored(e)) * F.ln(floored(a) / floored(e)))
    return both.select("feature", fx.rounded(F.aggregate(term, F.lit(0.0), lambda total, x: total + x)).alias("psi"))


def drift_level(value: Column, threshold: float = RED) -> Column:
    return F.when(value > threshold, "red").when(value > YELLOW, "yellow").otherwise("green")


def drift_status(scored: DataFrame | None, spark: SparkSession | None = None, threshold: float = RED) -> DataFrame:
    """One row: overall state, number of features, flagged and warned features with their values, largest value."""
    if scored is None:
        return spark.range(1).select(F.lit("PENDING_REFERENCE").alias("status"))
    level = drift_level(F.col("psi"), threshold)
    chosen = lambda name: F.map_from_entries(
        F.array_sort(F.collect_list(F.when(level == name, F.struct("feature", "psi"))))
    )
    one = scored.agg(
        F.count("*").alias("n_features"), chosen("red").alias("flagged"), chosen("yellow").alias("warned"),
        F.max("psi").alias("max_psi"),
    )
    status = F.when(F.size("flagged") > 0, "red").when(F.size("warned") > 0, "yellow").otherwise("green")
    return one.select(
        status.alias("status"), "n_features", F.size("flagged").alias("n_flagged"), "flagged", "warned", "max_psi",
        (F.size("flagged") > 0).alias("retrain_triggered"),
    )


def append_history(report: DataFrame, path: str, run: str) -> None:
    """Add a report under the name of its run; a run that is repeated replaces its own report."""
    report.write.mode("overwrite").parquet(f"{path}/run={run}")


def drift_history(spark: SparkSession, path: str, order: str, keep: int | None = None) -> DataFrame:
    """The reports of the history, newest first; the ``keep`` newest if asked for."""
    reports = spark.read.parquet(path).orderBy(F.col(order).desc())
    return reports if keep is None else reports.limit(keep)
