"""The periodic cycle: each batch of new withdrawals is scored, alerted on and escalated, once.

A ledger holds one row per finished batch. The state is two tables, written anew under the number of the batch: the withdrawals per
machine and hour of the trailing day, and the alerts that can still change. An alert that no later cycle can touch is
appended to the closed ones under the same number. A batch counts from its ledger row on: one that failed before it is written over when it
is repeated, and one that comes again after it changes nothing.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outflow.functions import scalar as fx
from outflow.operators import aggregates as agg
from outflow.operators import alerts as al
from outflow.operators.listing import at
from outflow.schemas import ALERTS
from outflow.session import durable
from outflow.streaming.jobs import hourly_cycle

OPEN = ("new", "acknowledged")
LEDGER = "batch bigint, as_of timestamp_ntz, checked bigint, flagged bigint, created bigint, reobserved bigint, escalated bigint"
HOURS = "atm_id string, hour timestamp_ntz, n bigint, n_fraud bigint, amount decimal(28,2)"


def logistic_risk(coefficients: Mapping[str, float], intercept: float) -> Column:
    """A score between 0 and 1 from given coefficients; missing features count as 0."""
    z = F.lit(float(intercept))
    for name, weight in coefficients.items():
        z = z + F.lit(float(weight)) * F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    return F.round(1 / (1 + F.exp(-z)), 6)


class AlertCycle:
    """State and steps of the cycle in a shared folder. ``coefficients`` weigh withdrawals_24h, fraud_24h and amount_24h."""

    def __init__(self, folder: str, atms: DataFrame, coefficients: Mapping[str, float], intercept: float, threshold: float = fx.HIGH,
                 cooldown_hours: int = al.COOLDOWN_HOURS, timeout_minutes: int = 120, trailing_hours: int = 24):
        self.folder, self.atms, self.threshold = folder, atms, threshold
        self.coefficients, self.intercept = coefficients, intercept
        self.cooldown, self.timeout, self.trailing = cooldown_hours, timeout_minutes, trailing_hours

    def start(self, withdrawals: DataFrame, every: str | None = None):
        """Run over a stream of withdrawals; see ``jobs.hourly_cycle`` for the trigger."""
        return hourly_cycle(withdrawals, self.run, f"{self.folder}/stream", every)

    def ledger(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "ledger/*", LEDGER)

    def alerts(self, spark: SparkSession) -> DataFrame:
        """All alerts as the last finished batch left them."""
        last = self._last(spark)
        finished = self.ledger(spark).select("batch")
        closed = self._read(spark, "closed/*", f"{_ddl(ALERTS)}, batch bigint").join(finished, "batch", "left_semi").drop("batch")
        return self._version(spark, "open", last, _ddl(ALERTS)).unionByName(closed)

    def run(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if not self.ledger(spark).where(F.col("batch") == number).isEmpty():
            return
        before = self._last(spark)
        hour = F.date_trunc("hour", "timestamp").cast("timestamp_ntz")
        arrived = durable(batch.groupBy("atm_id", hour.alias("hour")).agg(
            F.count("*").alias("n"), F.count_if("is_fraud_withdrawal").alias("n_fraud"), F.sum(F.col("amount").cast("decimal(18,2)")).alias("amount")
        ))
        newest = arrived.agg(F.max("hour")).first()[0]
        if newest is None:
            return
        as_of = newest + timedelta(hours=1)
        held = self._version(spark, "hours", before, HOURS).unionByName(arrived).where(F.col("hour") >= at(as_of - timedelta(hours=self.trailing)))
        held.groupBy("atm_id", "hour").agg(
            F.sum("n").alias("n"), F.sum("n_fraud").alias("n_fraud"), F.sum("amount").cast("decimal(28,2)").alias("amount")
        ).write.mode("overwrite").parquet(
            f"{self.folder}/hours/version={number}"
        )
        scores = self._scores(self._version(spark, "hours", number, HOURS))
        known = self._version(spark, "open", before, _ddl(ALERTS))
        cycle = durable(al.alert_cycle(scores, known, as_of, self.threshold, self.cooldown))
        seen = al.reobserve(known, cycle, as_of)
        kept = durable(al.escalate_stale(seen, as_of, self.timeout))
        fresh = al.build_alerts(cycle, agg.atm_population_by_state(self.atms), as_of)
        missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in ALERTS.fields if f.name not in fresh.columns]
        every = kept.unionByName(fresh.select("*", *missing).withColumn("reobservation_count", F.lit(0)).select(ALERTS.fieldNames()))
        # Past the cooldown and out of the reach of escalation nothing changes any more.
        over = ~F.col("status").isin(*OPEN) & (F.col("created_at") < at(as_of - timedelta(hours=self.cooldown)))
        every = durable(every)
        every.where(over).withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{self.folder}/closed/batch={number}")
        every.where(~over).write.mode("overwrite").parquet(f"{self.folder}/open/version={number}")
        newly = kept.alias("k").join(known.alias("b"), "alert_id").where("k.status = 'escalated' AND b.status <> 'escalated'").agg(F.count("*")).scalar()
        al.alert_cycle_summary(scores, cycle).select(
            F.lit(number).cast("bigint").alias("batch"), at(as_of).cast("timestamp_ntz").alias("as_of"), "checked", "flagged", "created", "reobserved", newly.alias("escalated")
        ).write.mode("overwrite").parquet(f"{self.folder}/ledger/batch={number}")

    def _scores(self, hours: DataFrame) -> DataFrame:
        day = hours.groupBy("atm_id").agg(
            F.sum("n").alias("withdrawals_24h"), F.sum("n_fraud").alias("fraud_24h"), F.sum("amount").cast("double").alias("amount_24h")
        )
        return self.atms.join(day, "atm_id", "left").withColumn("risk_score", logistic_risk(self.coefficients, self.intercept))

    def _last(self, spark: SparkSession) -> int | None:
        return self.ledger(spark).agg(F.max("batch")).first()[0]

    def _version(self, spark: SparkSession, table: str, version: int | None, schema: str) -> DataFrame:
        return spark.createDataFrame([], schema) if version is None else spark.read.schema(schema).parquet(f"{self.folder}/{table}/version={version}")

    def _read(self, spark: SparkSession, pattern: str, schema: str) -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(f"{self.folder}/{pattern}")
        except AnalysisException as absent:
            if absent.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)


def _ddl(schema) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)

