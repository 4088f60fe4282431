"""A kept daily summary of withdrawals, so that the features of one day read the few days they look back on.

The summary is one row per machine, day and account in folders by day. A day is added by writing its folder, and written again when it
is delivered again; days before the window are left out by their folder names alone.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outflow.plans import daily
from outflow.plans.steps import account_steps, step_of

#: The longest look back of a daily feature, in days before the row's own.
LOOK_BACK = 8


class DailySummary:
    """The summary in a shared folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def add(self, withdrawals: DataFrame) -> None:
        """Write the days of these withdrawals, which must be whole days; days that are there already are replaced."""
        rows = account_steps(withdrawals, daily.HOURS).repartition("step")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("step").parquet(self.folder)

    def days(self, first: Column | int, last: Column | int) -> DataFrame:
        """The rows of the days from first to last; no other folder is read."""
        rows = self.spark.read.parquet(self.folder).withColumn("step", F.col("step").cast("bigint"))
        return rows.where(F.col("step").between(first, last))

    def day_features(self, day: date, complaints: DataFrame, atms: DataFrame, centres: DataFrame, lookups: daily.Lookups, span: tuple[Column, Column]) -> DataFrame:
        """The matrix rows of one day, from the summary of that day and the eight before it."""
        last = step_of(F.lit(day).cast("timestamp_ntz"), daily.HOURS)
        kept = self.days(last - LOOK_BACK, last)
        return daily.atm_day_features(complaints, None, atms, centres, lookups, F.lit(day), F.lit(day), span, per_account=kept)
