"""Structured Streaming versions of the windowed operators.

Sources are declared-schema file streams; the same functions take any streaming frame. Rows behind the watermark
are dropped from state, as Spark does; there is no other late-data rule.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outflow.operators.aggregates import exact_sum
from outflow.session import ensure_checkpoint_dir
from outflow.sources.views import Tables


class StreamTables(Tables):
    """The domain views with the event table arriving as a stream."""

    def raw(self, name: str) -> DataFrame:
        if name != "events":
            return super().raw(name)
        schema = super().raw(name).schema
        return self.spark.readStream.schema(schema).parquet(f"{self.folder}/{name}*.parquet")


def stream_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Complaints and withdrawals as they arrive."""
    tables = StreamTables(spark, path)
    return tables.complaints, tables.withdrawals


def event_time(df: DataFrame, column: str, delay: str) -> DataFrame:
    """Watermarks need an instant, so the zone-less time becomes one (session zone UTC)."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def stream_dedup(df: DataFrame, id_column: str, ts: str, delay: str = "1 hour") -> DataFrame:
    return event_time(df, ts, delay).dropDuplicatesWithinWatermark([id_column])


def stream_activity(withdrawals: DataFrame, complaints: DataFrame | None = None, window: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """Tumbling activity of both streams in one window state: emitted when the window is closed; windows need a withdrawal.

    Each stream has its own watermark, and the query's is the lower one (``spark.sql.streaming.multipleWatermarkPolicy`` at its default),
    so a stream that lags loses nothing. A row carries its kind as columns that are null for the other kind.
    """
    none = lambda kind: F.lit(None).cast(kind)
    drawn = event_time(withdrawals.select(F.col("timestamp").alias("at"), F.lit(1).alias("drawn"), "is_fraud_withdrawal", F.col("amount").cast("double").alias("amount")), "at", delay)
    both = drawn.withColumn("filed", none("int"))
    if complaints is not None:
        filed = event_time(complaints.select(F.col("filing_timestamp").alias("at")), "at", delay)
        both = both.unionByName(filed.select(
            "at", none("int").alias("drawn"), none("boolean").alias("is_fraud_withdrawal"), none("double").alias("amount"), F.lit(1).alias("filed")
        ))
    fraud = F.col("is_fraud_withdrawal")
    grouped = both.groupBy(F.window("at", window)).agg(
        F.count("drawn").alias("withdrawals"), F.count_if(fraud).alias("fraud_withdrawals"), F.count("filed").alias("complaints"),
        exact_sum("amount").alias("amount_total"), exact_sum(F.when(fraud, F.col("amount"))).alias("amount_fraud"),
    ).where("withdrawals > 0")
    rate = F.round(F.col("fraud_withdrawals") / F.col("withdrawals"), 4).alias("fraud_rate")
    return grouped.select(
        F.col("window.start").cast("timestamp_ntz").alias("bucket"), "withdrawals", "fraud_withdrawals", "complaints", "amount_total", "amount_fraud", rate
    )


def stream_trailing(withdrawals: DataFrame, length: str = "24 hours", slide: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Trailing counts per machine, one row per slide: the window ending at t covers [t - length, t)."""
    grouped = event_time(withdrawals, "timestamp", delay).groupBy("atm_id", F.window("timestamp", length, slide)).agg(
        F.count("*").alias("withdrawals"), exact_sum("amount").alias("amount_total")
    )
    return grouped.select("atm_id", F.col("window.end").cast("timestamp_ntz").alias("t"), "withdrawals", "amount_total")


def stream_bursts(withdrawals: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Bursts: withdrawals at one machine no further apart than the gap."""
    grouped = event_time(withdrawals, "timestamp", delay).groupBy("atm_id", F.session_window("timestamp", gap)).agg(
        F.count("*").alias("withdrawals"), exact_sum("amount").alias("amount_total")
    )
    return grouped.select(
        "atm_id", F.col("session_window.start").cast("timestamp_ntz").alias("burst_start"), "withdrawals", "amount_total"
    )


def stream_linked(complaints: DataFrame, withdrawals: DataFrame, hours: int = 72, delay: str = "1 hour") -> DataFrame:
    """Withdrawals by a named account within the hours after the complaint; both sides' state is bounded by time."""
    named = event_time(
        complaints.where(F.col("linked_account_token").isNotNull()).select("complaint_id", "linked_account_token", "filing_timestamp"),
        "filing_timestamp", delay,
    )
    drawn = event_time(withdrawals.select("transaction_id", "account_token", "atm_id", "amount", "timestamp"), "timestamp", delay)
    in_time = (
        (F.col("account_token") == F.col("linked_account_token")) & (F.col("timestamp") >= F.col("filing_timestamp"))
        & (F.col("timestamp") <= F.col("filing_timestamp") + F.expr(f"interval {hours} hours"))
    )
    return named.join(drawn, in_time).select("complaint_id", "transaction_id", "atm_id", "amount")


def run_available(df: DataFrame, checkpoint: str, target: str, trigger: dict | None = None):
    """Start the stream into files; by default it ends once the available data is processed."""
    writer = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target)
    return writer.outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def stream_folder(spark: SparkSession) -> str:
    """A new folder for one run under the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    shared = spark.sparkContext.getCheckpointDir()
    return f"{shared}/stream-{uuid.uuid4().hex}"


def drained(df: DataFrame) -> DataFrame:
    """Process what is available and read back what was emitted."""
    spark = df.sparkSession
    base = stream_folder(spark)
    run_available(df, f"{base}/state", f"{base}/out").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def hourly_cycle(df: DataFrame, cycle: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Hand each batch of new data and its number to ``cycle``; ``every`` keeps it running on a period."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return df.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint).trigger(**trigger).start()
