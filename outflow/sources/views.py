"""The cash-out domain seen through the given star-schema tables.

Every view is a deterministic row-by-row mapping (plus dimension joins) of whole tables, so the amount of
work follows the input. ``VIEW_SQL`` states the same mappings as plain SQL for the side-by-side checks.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outflow.session import prepare, shuffle_width

RAW_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def spread_hash(column: str) -> Column:
    """Multiplicative hash of a non-negative integer key to 24 bits."""
    return F.expr(f"(({column} % 2147483648) * 2654435761L % 4294967296L) div 256")


class Tables:
    """Lazily defined domain views over one folder of parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def places(self) -> DataFrame:
        """The 25 nations with their regions, used as cities and states."""
        return self.raw("nation").join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
            F.col("n_nationkey").cast("bigint").alias("place"),
            F.col("n_name").alias("city"),
            F.expr("concat('D', n_nationkey div 2)").alias("district"),
            F.col("r_name").alias("state"),
            F.expr("8.0D + n_nationkey").alias("centre_lat"),
            F.expr("70.0D + (3 * n_nationkey) % 25").alias("centre_lon"),
        )

    @cached_property
    def city_centres(self) -> DataFrame:
        return self.places.select("city", F.col("centre_lat").alias("cc_lat"), F.col("centre_lon").alias("cc_lon"))

    @cached_property
    def atms(self) -> DataFrame:
        return self.raw("supplier").join(self.places, F.col("s_nationkey") == F.col("place")).select(
            F.expr("concat('A', s_suppkey)").alias("atm_id"),
            F.expr("concat('BANK_', s_suppkey % 8)").alias("bank_name"),
            F.col("s_name").alias("branch_name"),
            "city", "district", "state",
            F.expr("cast(400000 + place * 10 + s_suppkey % 10 as string)").alias("pin"),
            F.expr("concat('PS_', s_suppkey % 40)").alias("police_station_area"),
            F.expr("centre_lat + ((s_suppkey * 37) % 240 - 120) / 1000.0D").alias("latitude"),
            F.expr("centre_lon + ((s_suppkey * 53) % 240 - 120) / 1000.0D").alias("longitude"),
        )

    @cached_property
    def withdrawals(self) -> DataFrame:
        """One withdrawal per event row."""
        # One number, read from the file footers.
        machines = F.lit(self.raw("supplier").count())
        return self.raw("events").select(
            F.expr("concat('W', event_id)").alias("transaction_id"),
            F.col("ts").alias("timestamp"),
            F.concat(F.lit("A"), spread_hash("event_id") % machines).alias("atm_id"),
            F.expr("concat('AC', user_id)").alias("account_token"),
            F.round(F.col("value") * 1000.0, 2).alias("amount"),
            F.col("event_type").alias("channel"),
            F.expr("event_type = 'error' and value > 100").alias("is_fraud_withdrawal"),
        )

    @cached_property
    def complaints(self) -> DataFrame:
        """One complaint per event; about a third name an account."""
        filed = self.raw("events").select(
            "event_id", "ts", "user_id", "value", spread_hash("event_id").alias("h")
        )
        return filed.withColumn("place", F.col("h") % 25).join(self.places, "place").select(
            F.expr("concat('C', event_id)").alias("complaint_id"),
            F.col("ts").alias("filing_timestamp"),
            F.expr(
                "element_at(array('phishing', 'investment_fraud', 'job_fraud', 'upi_fraud', 'digital_arrest',"
                " 'sextortion'), cast((h div 25) % 6 as int) + 1)"
            ).alias("complaint_type"),
            F.col("city").alias("victim_city"),
            F.col("district").alias("victim_district"),
            F.col("state").alias("victim_state"),
            F.expr("cast(400000 + place * 10 + event_id % 10 as string)").alias("victim_pin"),
            F.expr("centre_lat + ((event_id * 41) % 240 - 120) / 1000.0D").alias("victim_lat"),
            F.expr("centre_lon + ((event_id * 59) % 240 - 120) / 1000.0D").alias("victim_lon"),
            F.round(F.col("value") * 500.0, 2).alias("amount_lost"),
            F.expr("case when user_id % 3 = 0 then concat('AC', user_id) end").alias("linked_account_token"),
            F.expr("concat('PH', user_id div 4)").alias("linked_phone_token"),
            F.expr(
                "element_at(array('under_investigation', 'funds_frozen', 'funds_partially_recovered'),"
                " cast(event_id % 3 as int) + 1)"
            ).alias("status"),
        )

    @cached_property
    def order_withdrawals(self) -> DataFrame:
        """The large withdrawal table: one row per order line."""
        lines = self.raw("lineitem").join(
            self.raw("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")
        )
        return lines.select(
            F.expr(
                "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as bigint))"
            ).alias("transaction_id"),
            F.expr("l_shipdate + make_dt_interval(0, cast(l_partkey % 24 as int))").alias("timestamp"),
            F.expr("concat('A', l_suppkey)").alias("atm_id"),
            F.expr("concat('AC', o_custkey)").alias("account_token"),
            F.col("l_extendedprice").alias("amount"),
            F.col("l_linestatus").alias("channel"),
            F.expr("l_returnflag = 'R' and l_linestatus = 'F' and l_partkey % 4 = 0").alias("is_fraud_withdrawal"),
        )

    @cached_property
    def order_complaints(self) -> DataFrame:
        """The large complaint table: one row per order."""
        filed = self.raw("orders").join(
            self.raw("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")
        )
        return filed.join(self.places, F.col("c_nationkey") == F.col("place")).select(
            F.expr("concat('O', o_orderkey)").alias("complaint_id"),
            F.expr("o_orderdate + make_dt_interval(0, cast(o_orderkey % 24 as int))").alias("filing_timestamp"),
            F.expr(
                "element_at(array('phishing', 'investment_fraud', 'job_fraud', 'upi_fraud', 'digital_arrest'),"
                " cast(substring(o_orderpriority, 1, 1) as int))"
            ).alias("complaint_type"),
            F.col("city").alias("victim_city"),
            F.col("district").alias("victim_district"),
            F.col("state").alias("victim_state"),
            F.col("o_totalprice").alias("amount_lost"),
            F.expr("concat('AC', o_custkey)").alias("linked_account_token"),
            F.expr("concat('PH', o_custkey div 4)").alias("linked_phone_token"),
            F.col("o_orderstatus").alias("status"),
        )

    @cached_property
    def accounts(self) -> DataFrame:
        first = self.raw("orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_seen"))
        return self.raw("customer").join(first, F.col("c_custkey") == F.col("o_custkey"), "left").select(
            F.expr("concat('AC', c_custkey)").alias("account_token"),
            F.expr("concat('BANK_', c_custkey % 8)").alias("home_bank"),
            "first_seen",
            F.expr("c_custkey % 10 = 0").alias("is_mule"),
        )

    @cached_property
    def transfers(self) -> DataFrame:
        """Two layers of money movement: account to collector, collector to cash-out point."""
        lines = self.raw("lineitem").join(
            self.raw("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")
        )
        both = lines.select(
            F.expr("l_shipdate + make_dt_interval(0, cast(l_partkey % 24 as int))").alias("timestamp"),
            F.expr(
                "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as bigint))"
            ).alias("line"),
            F.inline(
                F.array(
                    F.struct(
                        F.lit("T1").alias("layer"),
                        F.expr("concat('AC', o_custkey)").alias("from_token"),
                        F.expr("concat('S', l_suppkey)").alias("to_token"),
                        F.col("l_extendedprice").alias("amount"),
                    ),
                    F.struct(
                        F.lit("T2").alias("layer"),
                        F.expr("concat('S', l_suppkey)").alias("from_token"),
                        F.expr("concat('P', l_partkey)").alias("to_token"),
                        F.col("l_extendedprice").alias("amount"),
                    ),
                )
            ),
        )
        return both.select(
            F.concat_ws("-", "layer", "line").alias("transfer_id"), "timestamp", "from_token", "to_token", "amount"
        )

    @cached_property
    def days(self) -> DataFrame:
        """The calendar covered by the event table: one row per day."""
        return self.raw("events").agg(
            F.min(F.to_date("ts")).alias("first_day"), F.max(F.to_date("ts")).alias("last_day")
        ).select(F.explode(F.sequence("first_day", "last_day")).alias("day"))

    @cached_property
    def scores(self) -> DataFrame:
        """Every machine and day with a deterministic score and the true label of that day."""
        events = self.raw("events")
        first = events.agg(F.min(F.to_date("ts"))).scalar()
        last = events.agg(F.max(F.to_date("ts"))).scalar()
        # Dealt out before each machine becomes its calendar: as read, they lie in few tasks.
        machines = self.raw("supplier").select("s_suppkey").repartition(shuffle_width(self.spark), "s_suppkey")
        grid = machines.select(
            "s_suppkey", F.explode(F.sequence(first, last)).alias("day")
        )
        fraud = (
            self.withdrawals.where("is_fraud_withdrawal")
            .select("atm_id", F.to_date("timestamp").alias("day")).distinct().withColumn("label", F.lit(1))
        )
        return (
            grid.withColumn("mix", F.expr("s_suppkey * 400 + datediff(day, date'2024-01-01')"))
            .select(
                F.expr("concat('A', s_suppkey)").alias("atm_id"), "day",
                (((spread_hash("mix") * 31 + 7) % 10007) / 10007.0).alias("score"),
            )
            .join(fraud, ["atm_id", "day"], "left")
            .select("atm_id", "day", "score", F.coalesce("label", F.lit(0)).alias("label"))
        )

    @cached_property
    def latest_scores(self) -> DataFrame:
        """Scores of the last day with the machine attributes: what the ranking and alert operators read."""
        last = self.raw("events").agg(F.max(F.to_date("ts"))).scalar()
        return self.scores.where(F.col("day") == last).select(
            "atm_id", F.col("score").alias("risk_score")
        ).join(self.atms, "atm_id")

    @cached_property
    def alerts(self) -> DataFrame:
        """Past alerts: every score of at least 0.70, raised in the small hours of its day."""
        raised = self.scores.where(F.col("score") >= 0.70).select(
            "atm_id", "day", F.round("score", 4).alias("risk_score"),
            F.expr("cast(substring(atm_id, 2) as bigint) * 7 + day(day)").alias("n"),
        )
        return raised.join(self.atms, "atm_id").select(
            F.expr("concat_ws('-', 'ALT', atm_id, date_format(day, 'yyyyMMdd'))").alias("alert_id"),
            F.expr("cast(day as timestamp_ntz) + make_dt_interval(0, cast(n % 24 as int), cast(n % 60 as int))").alias(
                "created_at"
            ),
            "atm_id", "bank_name", "city", "district", "state", "police_station_area", "risk_score",
            F.expr("case when risk_score >= 0.85 then 'dispatch' else 'action' end").alias("tier"),
            F.expr(
                "element_at(array('new', 'acknowledged', 'actioned', 'dismissed'), cast(n % 4 as int) + 1)"
            ).alias("status"),
            F.lit("").alias("decision_reason"),
            F.lit(None).cast("timestamp_ntz").alias("acknowledged_at"),
            F.lit(None).cast("timestamp_ntz").alias("actioned_at"),
            F.lit(0).alias("reobservation_count"),
            F.lit(None).cast("timestamp_ntz").alias("last_reobserved_at"),
            F.lit(None).cast("double").alias("risk_delta_vs_last"),
        )

    @cached_property
    def outcomes(self) -> DataFrame:
        """Checked alerts: the actual label of the alert day."""
        truth = self.scores.select(
            F.expr("concat_ws('-', 'ALT', atm_id, date_format(day, 'yyyyMMdd'))").alias("alert_id"), "label"
        )
        checked = self.alerts.where("status in ('actioned', 'dismissed')").join(truth, "alert_id")
        return checked.select(
            "alert_id", "atm_id", F.col("risk_score").alias("predicted_risk"),
            F.expr("case when label = 1 then 'yes' else 'no' end").alias("actual_fraud_happened"),
            F.round(F.abs(F.col("label") - F.col("risk_score")), 4).alias("prediction_error"),
            F.expr("label = 0 and risk_score >= 0.5").alias("is_false_positive"),
            F.expr("label = 1 and risk_score < 0.5").alias("is_false_negative"),
            F.expr("created_at + interval 25 hours").alias("evaluated_at"),
        )

    @cached_property
    def handoffs(self) -> DataFrame:
        """Cross-state hand-offs: alerts of odd machines go to the state of the bank's head office."""
        return self.alerts.where("status <> 'dismissed'").select(
            F.concat_ws("-", F.lit("HO"), "alert_id").alias("handoff_id"), "alert_id", "atm_id",
            F.expr(
                "element_at(array('AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'),"
                " cast(cast(substring(bank_name, 6) as int) % 5 as int) + 1)"
            ).alias("origin_state"),
            F.col("state").alias("receiving_state"),
            F.expr("case when status = 'actioned' then 'complete' else 'queued' end").alias("status"),
            F.lit("cross-state").alias("reason"), "created_at",
        )

    @cached_property
    def recovery(self) -> DataFrame:
        """Fund-block recommendations: one per large fraud line."""
        return self.order_withdrawals.where("is_fraud_withdrawal").select(
            F.concat_ws("-", F.lit("REC"), "transaction_id").alias("rec_id"),
            F.col("timestamp").alias("created_at"),
            "account_token",
            F.expr("concat('BANK_', cast(substring(account_token, 3) as bigint) % 8)").alias("home_bank"),
            F.col("amount").alias("amount_at_risk"),
            F.col("atm_id").alias("suspected_atm"),
            F.expr("case when amount > 50000 then 'freeze' else 'hold' end").alias("recommended_action"),
            F.expr("case when amount > 50000 then 'held' else 'freeze_requested' end").alias("status"),
            F.expr("case when amount > 50000 then amount else 0.0D end").alias("amount_held"),
            F.expr("case when amount > 70000 then amount else 0.0D end").alias("amount_recovered"),
        )

    @cached_property
    def audit_log(self) -> DataFrame:
        """A hash-linked log with one record per event.

        Odd records link to the even record before them, even records start a new segment, and record 7 of every
        hundred was altered after the fact, so verification has something to find.
        """
        entry = self.raw("events").select(
            F.col("event_id").alias("index"),
            F.col("ts").alias("created_at"),
            F.expr("concat('user', user_id)").alias("actor"),
            "event_type",
            F.expr("concat('E', user_id)").alias("entity_id"),
            F.expr("sha2(props, 256)").alias("payload_hash"),
            F.col("props").alias("payload"),
        )
        start = F.repeat(F.lit("0"), 64)
        first = entry.select(
            (F.col("index") + 1).alias("index"), log_hash(start).alias("linked_hash")
        )
        linked = entry.join(first, "index", "left").withColumn(
            "prev_hash", F.when(F.col("index") % 2 == 0, start).otherwise(F.coalesce("linked_hash", start))
        )
        return linked.withColumn(
            "hash", F.when(F.col("index") % 100 == 7, F.repeat(F.lit("f"), 64)).otherwise(log_hash(F.col("prev_hash")))
        ).drop("linked_hash")

    @cached_property
    def blocks(self) -> DataFrame:
        """The same log in block form; every 50th payload is cut off and so is no valid JSON."""
        cut = F.when(F.col("index") % 50 == 9, F.substring("payload", 1, 4)).otherwise(F.col("payload"))
        return self.audit_log.select(
            F.col("index").alias("block_index"), cut.alias("data"), F.col("prev_hash").alias("previous_hash"),
            (F.col("index") * 7).alias("nonce"), F.col("event_type").alias("record_type"),
            F.col("actor").alias("created_by"),
        ).withColumn("hash", block_hash())


def log_hash(prev_hash: Column) -> Column:
    """Record hash: SHA-256 over the pipe-joined fields and the predecessor's hash."""
    return F.sha2(
        F.concat_ws(
            "|", F.col("index").cast("string"), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), "actor",
            "event_type", "payload_hash", prev_hash,
        ),
        256,
    )


def block_hash() -> Column:
    return F.sha2(
        F.concat_ws(
            "|", F.col("block_index").cast("string"), "data", "previous_hash", F.col("nonce").cast("string")
        ),
        256,
    )


def _h(column: str) -> str:
    return f"((({column} % 2147483648) * 2654435761 % 4294967296) // 256)"


LINE_ID = (
    "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as bigint))"
)
LINE_TS = "l_shipdate + to_hours(cast(l_partkey % 24 as integer))"


def _log_hash(prev: str) -> str:
    return (
        "sha256(concat_ws('|', index::VARCHAR, strftime(created_at, '%Y-%m-%d %H:%M:%S'), actor, event_type,"
        f" payload_hash, {prev}))"
    )


VIEW_SQL: dict[str, tuple[list[str], str]] = {
    "places": ([], """
        SELECT n_nationkey::BIGINT AS place, n_name AS city, 'D' || (n_nationkey // 2) AS district, r_name AS state,
               8.0::DOUBLE + n_nationkey AS centre_lat, 70.0::DOUBLE + (3 * n_nationkey) % 25 AS centre_lon
        FROM nation JOIN region ON n_regionkey = r_regionkey"""),
    "atms": (["places"], """
        SELECT 'A' || s_suppkey AS atm_id, 'BANK_' || (s_suppkey % 8) AS bank_name, s_name AS branch_name, city,
               district, state, (400000 + place * 10 + s_suppkey % 10)::VARCHAR AS pin,
               'PS_' || (s_suppkey % 40) AS police_station_area,
               centre_lat + ((s_suppkey * 37) % 240 - 120) / 1000.0::DOUBLE AS latitude,
               centre_lon + ((s_suppkey * 53) % 240 - 120) / 1000.0::DOUBLE AS longitude
        FROM supplier JOIN places ON s_nationkey = place"""),
    "withdrawals": ([], f"""
        SELECT 'W' || event_id AS transaction_id, ts AS timestamp,
               'A' || ({_h('event_id')} % (SELECT count(*) FROM supplier)) AS atm_id,
               'AC' || user_id AS account_token, round(value * 1000.0::DOUBLE, 2) AS amount, event_type AS channel,
               event_type = 'error' AND value > 100 AS is_fraud_withdrawal
        FROM events"""),
    "complaints": (["places"], f"""
        SELECT 'C' || event_id AS complaint_id, ts AS filing_timestamp,
               ['phishing', 'investment_fraud', 'job_fraud', 'upi_fraud', 'digital_arrest', 'sextortion'
               ][({_h('event_id')} // 25) % 6 + 1] AS complaint_type,
               city AS victim_city, district AS victim_district, state AS victim_state,
               (400000 + place * 10 + event_id % 10)::VARCHAR AS victim_pin,
               centre_lat + ((event_id * 41) % 240 - 120) / 1000.0::DOUBLE AS victim_lat,
               centre_lon + ((event_id * 59) % 240 - 120) / 1000.0::DOUBLE AS victim_lon,
               round(value * 500.0::DOUBLE, 2) AS amount_lost,
               CASE WHEN user_id % 3 = 0 THEN 'AC' || user_id END AS linked_account_token,
               'PH' || (user_id // 4) AS linked_phone_token,
               ['under_investigation', 'funds_frozen', 'funds_partially_recovered'][event_id % 3 + 1] AS status
        FROM events JOIN places ON {_h('event_id')} % 25 = place"""),
    "order_withdrawals": ([], f"""
        SELECT {LINE_ID} AS transaction_id, {LINE_TS} AS timestamp, 'A' || l_suppkey AS atm_id,
               'AC' || o_custkey AS account_token, l_extendedprice AS amount, l_linestatus AS channel,
               l_returnflag = 'R' AND l_linestatus = 'F' AND l_partkey % 4 = 0 AS is_fraud_withdrawal
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "order_complaints": (["places"], """
        SELECT 'O' || o_orderkey AS complaint_id,
               o_orderdate + to_hours(cast(o_orderkey % 24 as integer)) AS filing_timestamp,
               ['phishing', 'investment_fraud', 'job_fraud', 'upi_fraud', 'digital_arrest'
               ][substring(o_orderpriority, 1, 1)::INTEGER] AS complaint_type,
               city AS victim_city, district AS victim_district, state AS victim_state, o_totalprice AS amount_lost,
               'AC' || o_custkey AS linked_account_token, 'PH' || (o_custkey // 4) AS linked_phone_token,
               o_orderstatus AS status
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN places ON c_nationkey = place"""),
    "accounts": ([], """
        SELECT 'AC' || c_custkey AS account_token, 'BANK_' || (c_custkey % 8) AS home_bank, first_seen,
               c_custkey % 10 = 0 AS is_mule
        FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_seen FROM orders GROUP BY 1)
             ON c_custkey = o_custkey"""),
    "transfers": ([], f"""
        SELECT 'T1-' || {LINE_ID} AS transfer_id, {LINE_TS} AS timestamp, 'AC' || o_custkey AS from_token,
               'S' || l_suppkey AS to_token, l_extendedprice AS amount
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        UNION ALL
        SELECT 'T2-' || {LINE_ID}, {LINE_TS}, 'S' || l_suppkey, 'P' || l_partkey,
               l_extendedprice
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "days": ([], """
        SELECT unnest(generate_series((SELECT min(ts)::DATE FROM events), (SELECT max(ts)::DATE FROM events),
               INTERVAL 1 DAY))::DATE AS day"""),
    "scores": (["withdrawals", "days"], f"""
        SELECT g.atm_id, g.day, g.score, CASE WHEN f.atm_id IS NULL THEN 0 ELSE 1 END AS label
        FROM (SELECT 'A' || s_suppkey AS atm_id, day,
                     (({_h("(s_suppkey * 400 + (day - DATE '2024-01-01'))")} * 31 + 7) % 10007) / 10007.0::DOUBLE AS score
              FROM supplier CROSS JOIN days) g
        LEFT JOIN (SELECT DISTINCT atm_id, timestamp::DATE AS day FROM withdrawals WHERE is_fraud_withdrawal) f
             ON g.atm_id = f.atm_id AND g.day = f.day"""),
    "latest_scores": (["scores", "atms"], """
        SELECT a.*, s.score AS risk_score FROM scores s JOIN atms a ON s.atm_id = a.atm_id
        WHERE s.day = (SELECT max(ts)::DATE FROM events)"""),
    "alerts": (["scores", "atms"], """
        SELECT 'ALT-' || s.atm_id || '-' || strftime(day, '%Y%m%d') AS alert_id,
               day::TIMESTAMP + to_hours(cast(n % 24 as integer)) + to_minutes(cast(n % 60 as integer)) AS created_at,
               s.atm_id, bank_name, city, district, state, police_station_area, risk_score,
               CASE WHEN risk_score >= 0.85 THEN 'dispatch' ELSE 'action' END AS tier,
               ['new', 'acknowledged', 'actioned', 'dismissed'][n % 4 + 1] AS status, '' AS decision_reason,
               NULL::TIMESTAMP AS acknowledged_at, NULL::TIMESTAMP AS actioned_at, 0 AS reobservation_count,
               NULL::TIMESTAMP AS last_reobserved_at, NULL::DOUBLE AS risk_delta_vs_last
        FROM (SELECT atm_id, day, round(score, 4) AS risk_score,
                     substring(atm_id, 2)::BIGINT * 7 + day(day) AS n FROM scores WHERE score >= 0.70) s
        JOIN atms a ON s.atm_id = a.atm_id"""),
    "outcomes": (["alerts", "scores"], """
        SELECT alert_id, a.atm_id, risk_score AS predicted_risk,
               CASE WHEN label = 1 THEN 'yes' ELSE 'no' END AS actual_fraud_happened,
               round(abs(label - risk_score), 4) AS prediction_error,
               label = 0 AND risk_score >= 0.5 AS is_false_positive, label = 1 AND risk_score < 0.5 AS is_false_negative,
               created_at + INTERVAL 25 HOUR AS evaluated_at
        FROM alerts a JOIN scores s ON a.alert_id = 'ALT-' || s.atm_id || '-' || strftime(s.day, '%Y%m%d')
        WHERE status IN ('actioned', 'dismissed')"""),
    "handoffs": (["alerts"], """
        SELECT 'HO-' || alert_id AS handoff_id, alert_id, atm_id,
               ['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'
               ][substring(bank_name, 6)::INTEGER % 5 + 1] AS origin_state,
               state AS receiving_state, CASE WHEN status = 'actioned' THEN 'complete' ELSE 'queued' END AS status,
               'cross-state' AS reason, created_at
        FROM alerts WHERE status <> 'dismissed'"""),
    "recovery": (["order_withdrawals"], """
        SELECT 'REC-' || transaction_id AS rec_id, timestamp AS created_at, account_token,
               'BANK_' || (substring(account_token, 3)::BIGINT % 8) AS home_bank, amount AS amount_at_risk,
               atm_id AS suspected_atm, CASE WHEN amount > 50000 THEN 'freeze' ELSE 'hold' END AS recommended_action,
               CASE WHEN amount > 50000 THEN 'held' ELSE 'freeze_requested' END AS status,
               CASE WHEN amount > 50000 THEN amount ELSE 0.0::DOUBLE END AS amount_held,
               CASE WHEN amount > 70000 THEN amount ELSE 0.0::DOUBLE END AS amount_recovered
        FROM order_withdrawals WHERE is_fraud_withdrawal"""),
    "audit_log": ([], f"""
        WITH entry AS (
            SELECT event_id AS index, ts AS created_at, 'user' || user_id AS actor, event_type,
                   'E' || user_id AS entity_id, sha256(props) AS payload_hash, props AS payload FROM events),
        linked AS (
            SELECT e.*, CASE WHEN e.index % 2 = 0 THEN repeat('0', 64)
                             ELSE coalesce(p.linked_hash, repeat('0', 64)) END AS prev_hash
            FROM entry e LEFT JOIN (SELECT index + 1 AS index, {_log_hash("repeat('0', 64)")} AS linked_hash FROM entry) p
                 ON e.index = p.index)
        SELECT *, CASE WHEN index % 100 = 7 THEN repeat('f', 64) ELSE {_log_hash('prev_hash')} END AS hash
        FROM linked"""),
    "blocks": (["audit_log"], """
        SELECT *, sha256(concat_ws('|', block_index::VARCHAR, data, previous_hash, nonce::VARCHAR)) AS hash
        FROM (SELECT index AS block_index,
                     CASE WHEN index % 50 = 9 THEN substring(payload, 1, 4) ELSE payload END AS data,
                     prev_hash AS previous_hash, index * 7 AS nonce, event_type AS record_type, actor AS created_by
              FROM audit_log)"""),
}


def with_views(body: str, *names: str) -> str:
    """Prefix a statement with the views it needs, dependencies first."""
    if not names:
        return body.strip()
    ordered: list[str] = []

    def visit(name: str) -> None:
        for parent in VIEW_SQL[name][0]:
            visit(parent)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    ctes = [f"{name} AS ({VIEW_SQL[name][1]})" for name in ordered]
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body
