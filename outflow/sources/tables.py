"""Readers for the domain tables: declared schema, explicit projection, filters left to the scan."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outflow import schemas

COMPLAINT_COLUMNS = [
    "filing_timestamp", "complaint_type", "victim_city", "victim_district", "victim_lat", "victim_lon",
    "linked_account_token", "amount_lost", "victim_pin",
]
ATM_COLUMNS = [
    "atm_id", "bank_name", "branch_name", "city", "district", "state", "pin", "police_station_area",
    "latitude", "longitude",
]
WITHDRAWAL_COLUMNS = ["timestamp", "atm_id", "account_token", "amount", "is_fraud_withdrawal"]
TRANSFER_COLUMNS = ["from_token", "to_token", "amount", "timestamp"]


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def complaint_features_input(complaints: DataFrame) -> DataFrame:
    return complaints.select(COMPLAINT_COLUMNS)


def atm_features_input(atms: DataFrame) -> DataFrame:
    return atms.select(ATM_COLUMNS)


def withdrawal_features_input(withdrawals: DataFrame) -> DataFrame:
    return withdrawals.select(WITHDRAWAL_COLUMNS).withColumn(
        "is_fraud_withdrawal", F.coalesce("is_fraud_withdrawal", F.lit(False))
    )


def read_complaints(spark: SparkSession, path: str) -> DataFrame:
    return complaint_features_input(read_table(spark, path, schemas.COMPLAINTS))


def read_atms(spark: SparkSession, path: str) -> DataFrame:
    return atm_features_input(read_table(spark, path, schemas.ATMS))


def read_withdrawals(spark: SparkSession, path: str) -> DataFrame:
    return withdrawal_features_input(read_table(spark, path, schemas.WITHDRAWALS))


def read_transfers(transfers: DataFrame, as_of: datetime, window_days: int = 30) -> DataFrame:
    """Edges in [as_of - window, as_of): strictly past, so a graph built from them cannot leak."""
    start = as_of - timedelta(days=window_days)
    return transfers.select(TRANSFER_COLUMNS).where(
        (F.col("timestamp") >= F.lit(start).cast("timestamp_ntz"))
        & (F.col("timestamp") < F.lit(as_of).cast("timestamp_ntz"))
    )


def tokenise(df: DataFrame, column: str, salt: str, prefix: str) -> tuple[DataFrame, DataFrame]:
    """Replace a raw identifier by a salted token; the second frame is the token-to-raw vault."""
    digest = F.sha2(F.concat(F.lit(f"{salt}|"), F.col(column).cast("string")), 256)
    token = F.concat(F.lit(f"{prefix}_"), F.substring(digest, 1, 12))
    tokenised = df.withColumn("token", token)
    vault = tokenised.select("token", F.lit(prefix).alias("entity_type"), F.col(column).cast("string").alias("raw_value"))
    return tokenised.drop(column), vault.distinct()


def latest_timestamp(complaints: DataFrame, withdrawals: DataFrame) -> DataFrame:
    """One row: the newest event time over both tables."""
    newest = complaints.agg(F.max("filing_timestamp").alias("t")).unionByName(
        withdrawals.agg(F.max("timestamp").alias("t"))
    )
    return newest.agg(F.max("t").alias("latest"))


def resolve_as_of(
    complaints: DataFrame, withdrawals: DataFrame, explicit: datetime | None = None, configured: datetime | None = None
) -> DataFrame:
    """One row: explicit time, else configured time, else the newest event time."""
    chosen = explicit or configured
    if chosen is not None:
        return complaints.sparkSession.range(1).select(F.lit(chosen).cast("timestamp_ntz").alias("as_of"))
    return latest_timestamp(complaints, withdrawals).select(F.col("latest").alias("as_of"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    total = counts[0]
    for one in counts[1:]:
        total = total.unionByName(one)
    return total


def data_stamp(tables: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """One row: a 16-digit fingerprint of row counts and newest times, to tell whether inputs changed."""
    parts = None
    for name, (df, ts_col) in sorted(tables.items()):
        newest = F.max(F.col(ts_col)).cast("string") if ts_col else F.lit("")
        one = df.agg(F.concat_ws("=", F.lit(name), F.count("*").cast("string"), F.coalesce(newest, F.lit(""))).alias("part"))
        parts = one if parts is None else parts.unionByName(one)
    joined = F.concat_ws("|", F.array_sort(F.collect_list("part")))
    return parts.agg(F.substring(F.sha2(joined, 256), 1, 16).alias("stamp"))
