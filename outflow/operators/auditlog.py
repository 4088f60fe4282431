"""Verification and listing of hash-linked logs. The log lies in range blocks, never sorted in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outflow.functions.ordering import previous_row
from outflow.operators.listing import page
from outflow.sources.views import block_hash, log_hash

GENESIS = "0" * 64


def log_checks(log: DataFrame) -> DataFrame:
    """Every record with two verdicts: its own hash is right, its link to the record before is right."""
    linked = previous_row(log, "index", ["hash"])
    return linked.select(
        "index", (F.col("hash") == log_hash(F.col("prev_hash"))).alias("hash_ok"),
        (F.col("prev_hash") == F.coalesce("previous_hash", F.lit(GENESIS))).alias("link_ok"),
    )


def verify_log(log: DataFrame) -> DataFrame:
    """One row: intact, first broken index, number of records."""
    checks = log_checks(log)
    broken = F.min(F.when(~(F.col("hash_ok") & F.col("link_ok")), F.col("index")))
    return checks.agg(broken.isNull().alias("intact"), broken.alias("broken_at_index"), F.count("*").alias("records"))


def verify_blocks(blocks: DataFrame, difficulty: int = 2, genesis: str = GENESIS) -> DataFrame:
    """(block_index, issue) rows; the first block is only checked for being a proper first block."""
    own = blocks.select(
        "block_index", "data", F.col("previous_hash").alias("link"), F.col("hash").alias("stored"), block_hash().alias("computed")
    )
    linked = previous_row(own, "block_index", ["stored"])
    before = F.col("previous_stored")
    issue = lambda condition, name: F.when(condition, F.lit(name))
    first = F.array(issue((F.col("block_index") != 0) | (F.col("link") != genesis), "BAD_GENESIS"))
    later = F.array(
        issue(F.try_parse_json("data").isNull(), "INVALID_DATA"),
        issue(F.col("stored") != F.col("computed"), "HASH_MISMATCH"),
        issue(F.col("link") != before, "CHAIN_BROKEN"),
        issue(~F.col("stored").startswith("0" * difficulty), "INVALID_POW"),
    )
    issues = F.array_compact(F.when(before.isNull(), first).otherwise(later))
    return linked.select("block_index", F.explode(issues).alias("issue"))


def log_statistics(blocks: DataFrame) -> DataFrame:
    """One row: size, latest record and a map of counts per record type."""
    by_type = blocks.groupBy("record_type").agg(
        F.count("*").alias("n"), F.max("block_index").alias("last"), F.max_by("hash", "block_index").alias("hash")
    )
    # One row per record type.
    return by_type.agg(
        F.sum("n").alias("total_blocks"), F.max("last").alias("latest_index"), F.max_by("hash", "last").alias("latest_hash"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("record_type", "n")))).alias("records_by_type"),
    )


def entity_history(blocks: DataFrame, text: str) -> DataFrame:
    """Records whose payload mentions the text, in log order."""
    return blocks.where(F.col("data").contains(text)).orderBy("block_index")


def records_by_type(blocks: DataFrame, record_type: str, limit: int = 100) -> DataFrame:
    return page(blocks.where(F.col("record_type") == record_type), [F.col("block_index").desc()], limit)


def log_page(log: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of the log, newest first, hashes cut to 16 characters."""
    short = lambda c: F.substring(c, 1, 16).alias(c)
    rows = page(log, [F.col("index").desc()], limit, offset)
    return rows.select("index", "created_at", "actor", "event_type", "entity_id", short("payload_hash"), short("prev_hash"), short("hash"))


def payload_hash(columns: list[str]) -> Column:
    """SHA-256 over the JSON of the columns in name order."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)
