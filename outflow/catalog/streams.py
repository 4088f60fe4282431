"""Streaming jobs drained over the event table and compared with the batch definition of the same result."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outflow.catalog.registry import money, query, r4, r6, ts
from outflow.operators.listing import at
from outflow.sources.views import Tables
from outflow.streaming import cycle, jobs

# Appended results are final, so only windows closed by the watermark (newest event less one hour) appear.
CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


# Actions come half an hour after the events and move the watermark.
ACTED_CLOSED = """(SELECT max(timestamp + CASE WHEN regexp_extract(account_token, '[0-9]+$')::BIGINT % 3 = 0 THEN INTERVAL 30 MINUTE ELSE INTERVAL 0 MINUTE END)
                   - INTERVAL 1 HOUR FROM withdrawals)"""
SPREAD = "regexp_extract(account_token, '[0-9]+$')::BIGINT"


def streams(t: Tables) -> tuple[DataFrame, DataFrame]:
    return jobs.stream_tables(t.spark, t.folder)


@query("k01_stream_tables", f"""
    SELECT transaction_id, {ts('timestamp')} AS timestamp, atm_id, amount FROM withdrawals""", ("withdrawals",))
def _(t: Tables) -> DataFrame:
    return jobs.drained(streams(t)[1].select("transaction_id", "timestamp", "atm_id", "amount"))


@query("k02_stream_dedup", "SELECT transaction_id, atm_id FROM withdrawals", ("withdrawals",))
def _(t: Tables) -> DataFrame:
    arriving = streams(t)[1]
    # Everything arrives twice.
    return jobs.drained(jobs.stream_dedup(arriving.union(arriving), "transaction_id", "timestamp").select("transaction_id", "atm_id"))


# The later of two streams waits for the earlier one.
BOTH_CLOSED = "(SELECT least((SELECT max(filing_timestamp) FROM complaints), (SELECT max(timestamp) FROM withdrawals)) - INTERVAL 1 HOUR)"


@query("k03_stream_activity", f"""
    SELECT {ts('b')} AS bucket, withdrawals, fraud_withdrawals, coalesce(complaints, 0) AS complaints, amount_total, amount_fraud,
           {r4('fraud_withdrawals / withdrawals')} AS fraud_rate
    FROM (SELECT b, count(*) AS withdrawals, count(*) FILTER (is_fraud_withdrawal) AS fraud_withdrawals, {money('amount')} AS amount_total,
                 {money('CASE WHEN is_fraud_withdrawal THEN amount END')} AS amount_fraud
          FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, withdrawals.timestamp) AS b FROM withdrawals) GROUP BY b)
    LEFT JOIN (SELECT time_bucket(INTERVAL 6 HOUR, filing_timestamp) AS b, count(*) AS complaints FROM complaints GROUP BY 1) USING (b)
    WHERE b + INTERVAL 6 HOUR <= {BOTH_CLOSED}""", ("withdrawals", "complaints"))
def _(t: Tables) -> DataFrame:
    complaints, withdrawals = streams(t)
    return jobs.drained(jobs.stream_activity(withdrawals, complaints))


@query("k04_stream_trailing", f"""
    SELECT atm_id, {ts('e')} AS t, count(*) AS withdrawals, {money('amount')} AS amount_total FROM (
        SELECT atm_id, amount, time_bucket(INTERVAL 1 HOUR, withdrawals.timestamp) + to_hours(k::INT) AS e FROM withdrawals, (SELECT unnest(range(1, 25)) AS k))
    WHERE e <= {CLOSED} GROUP BY atm_id, e""", ("withdrawals",))
def _(t: Tables) -> DataFrame:
    return jobs.drained(jobs.stream_trailing(streams(t)[1]))


@query("k05_stream_bursts", f"""
    SELECT atm_id, {ts('min(x)')} AS burst_start, count(*) AS withdrawals, {money('amount')} AS amount_total FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY atm_id ORDER BY x, transaction_id) AS b FROM (
            SELECT atm_id, transaction_id, amount, withdrawals.timestamp AS x, CASE WHEN lag(withdrawals.timestamp) OVER w >= withdrawals.timestamp - INTERVAL 30 MINUTE
                   THEN 0 ELSE 1 END AS fresh FROM withdrawals WINDOW w AS (PARTITION BY atm_id ORDER BY withdrawals.timestamp, transaction_id)))
    GROUP BY atm_id, b HAVING max(x) + INTERVAL 30 MINUTE <= {CLOSED}""", ("withdrawals",))
def _(t: Tables) -> DataFrame:
    return jobs.drained(jobs.stream_bursts(streams(t)[1]))


@query("k06_stream_linked", """
    SELECT complaint_id, transaction_id, atm_id, amount FROM complaints c JOIN withdrawals w ON w.account_token = c.linked_account_token
    AND w.timestamp >= c.filing_timestamp AND w.timestamp <= c.filing_timestamp + INTERVAL 72 HOUR""", ("complaints", "withdrawals"))
def _(t: Tables) -> DataFrame:
    complaints, withdrawals = streams(t)
    return jobs.drained(jobs.stream_linked(complaints, withdrawals))


# The filter runs ahead of the watermark, which so follows the flagged rows.
# The rule row by row: a flag within six hours of the last alert, and no more than 0.1 above it, is a re-observation.
@query("k07_stream_alerts", f"""
    WITH replayed AS (WITH RECURSIVE flags AS (
        SELECT atm_id, timestamp AS moment, amount / 100000.0 AS risk, row_number() OVER (PARTITION BY atm_id ORDER BY timestamp, amount) AS n
        FROM withdrawals WHERE amount / 100000.0 >= 0.70
          AND timestamp <= (SELECT date_trunc('milliseconds', max(timestamp)) - INTERVAL 1 HOUR FROM withdrawals WHERE amount / 100000.0 >= 0.70)),
    walk AS (
        SELECT atm_id, n, moment, risk, 'new' AS outcome, NULL::DOUBLE AS delta, moment AS last_at, risk AS last_risk FROM flags WHERE n = 1
        UNION ALL
        SELECT f.atm_id, f.n, f.moment, f.risk, CASE WHEN recent AND f.risk - w.last_risk <= 0.1 THEN 'reobserved' ELSE 'new' END,
               CASE WHEN recent THEN f.risk - w.last_risk END,
               CASE WHEN recent AND f.risk - w.last_risk <= 0.1 THEN w.last_at ELSE f.moment END,
               CASE WHEN recent AND f.risk - w.last_risk <= 0.1 THEN w.last_risk ELSE f.risk END
        FROM walk w JOIN flags f ON f.atm_id = w.atm_id AND f.n = w.n + 1, LATERAL (SELECT f.moment - w.last_at <= INTERVAL 6 HOUR AS recent))
    SELECT atm_id, {ts('walk.moment')} AS "at", {r6('risk')} AS risk_score, outcome, {r6('delta')} AS risk_delta_vs_last FROM walk)
    SELECT * FROM replayed""", ("withdrawals",))
def _(t: Tables) -> DataFrame:
    from outflow.streaming import stateful

    # Each withdrawal reports a risk for its machine.
    arriving = streams(t)[1].select("atm_id", F.col("timestamp").cast("timestamp").alias("at"), (F.col("amount") / 100000.0).alias("risk_score"))
    return jobs.drained(stateful.stream_alerts(arriving.withWatermark("at", "1 hour")))


@query("k08_stream_escalate", f"""
    SELECT transaction_id AS alert_id, {ts("withdrawals.timestamp + INTERVAL 2 HOUR")} AS escalated_at,
           'Auto-escalated after 120 min without acknowledgement' AS decision_reason
    FROM withdrawals WHERE {SPREAD} % 3 <> 0 AND withdrawals.timestamp + INTERVAL 2 HOUR <= {ACTED_CLOSED}""", ("withdrawals",))
def _(t: Tables) -> DataFrame:
    from outflow.streaming import stateful

    # A withdrawal opens an alert; every third account acts on it within the hour.
    opened = streams(t)[1].select(F.col("transaction_id").alias("alert_id"), F.col("timestamp").cast("timestamp").alias("at"), "account_token")
    acted = F.when(F.expr("cast(regexp_extract(account_token, '[0-9]+$', 0) as bigint) % 3") == 0, F.array(F.lit("created"), F.lit("action"))).otherwise(F.array(F.lit("created")))
    events = opened.select("alert_id", "at", F.explode(acted).alias("kind")).withColumn(
        "at", F.when(F.col("kind") == "action", F.col("at") + F.expr("interval 30 minutes")).otherwise(F.col("at"))
    )
    return jobs.drained(stateful.stream_escalate(events.withWatermark("at", "1 hour")))


# The weights of the cycle's score, and its arrivals: all but the last eight hours, then two hours at a time.
WEIGHTS, INTERCEPT = {"withdrawals_24h": 0.35, "fraud_24h": 0.9, "amount_24h": 0.000004}, -2.6
CUTS = [8, 6, 4, 2, 0]
LOGIT = " + ".join([str(INTERCEPT), *(f"{w} * {c}" for c, w in WEIGHTS.items())])


@query("k09_hourly_cycle", f"""
    WITH cuts AS (SELECT date_trunc('hour', max(timestamp)) + INTERVAL 1 HOUR - to_hours(h) AS upto FROM withdrawals, (SELECT unnest({CUTS}) AS h) GROUP BY h),
    cycles AS (SELECT DISTINCT date_trunc('hour', max(w.timestamp)) + INTERVAL 1 HOUR AS as_of FROM cuts JOIN withdrawals w ON w.timestamp < upto GROUP BY upto),
    day AS (SELECT as_of, atm_id, count(*) AS withdrawals_24h, count(*) FILTER (is_fraud_withdrawal) AS fraud_24h, sum(amount::DECIMAL(18,2))::DOUBLE AS amount_24h
            FROM cycles JOIN withdrawals w ON w.timestamp < as_of AND w.timestamp >= as_of - INTERVAL 24 HOUR GROUP BY 1, 2),
    latest_scores AS (SELECT as_of, a.*, round(1 / (1 + exp(-({LOGIT}))), 6) AS risk_score FROM day JOIN atms a USING (atm_id)),
    flags AS (SELECT *, row_number() OVER (PARTITION BY atm_id ORDER BY as_of) AS i FROM latest_scores WHERE risk_score >= 0.70),
    walk AS (WITH RECURSIVE w AS (
        SELECT atm_id, i, as_of, risk_score, 'new' AS outcome, NULL::DOUBLE AS delta, as_of AS last_at, risk_score AS last_risk FROM flags WHERE i = 1
        UNION ALL
        SELECT f.atm_id, f.i, f.as_of, f.risk_score, CASE WHEN again THEN 'reobserved' ELSE 'new' END, CASE WHEN recent THEN {r4('f.risk_score - w.last_risk')} END,
               CASE WHEN again THEN w.last_at ELSE f.as_of END, CASE WHEN again THEN w.last_risk ELSE f.risk_score END
        FROM w JOIN flags f ON f.atm_id = w.atm_id AND f.i = w.i + 1, LATERAL (SELECT f.as_of - w.last_at <= INTERVAL 6 HOUR AS recent),
             LATERAL (SELECT recent AND f.risk_score - {r4('w.last_risk')} <= 0.1 AS again)) SELECT * FROM w),
    cycle AS (SELECT w.*, f.state FROM walk w JOIN flags f USING (atm_id, as_of)),
    budget AS (SELECT as_of, state, greatest(1, round_even(n_flagged::DOUBLE * n / (SELECT count(*) FROM atms), 0)::BIGINT) AS b
               FROM (SELECT as_of, count(*) AS n_flagged FROM cycle GROUP BY 1), (SELECT state, count(*) AS n FROM atms GROUP BY 1)),
    made AS (SELECT *, CASE WHEN risk_score >= 0.85 THEN 'dispatch' ELSE 'action' END AS t, row_number() OVER (PARTITION BY as_of, state ORDER BY risk_score DESC, atm_id) AS p
             FROM cycle WHERE outcome = 'new'),
    again AS (SELECT atm_id, last_at, count(*) AS times, max(as_of) AS latest FROM walk WHERE outcome = 'reobserved' GROUP BY 1, 2)
    SELECT 'ALT-' || m.atm_id || '-' || strftime(m.as_of, '%Y%m%d%H%M%S') AS alert_id, m.atm_id, {ts('m.as_of')} AS created_at, {r4('m.risk_score')} AS risk_score,
           CASE WHEN t = 'action' AND p > b THEN 'monitor' ELSE t END AS tier, delta AS risk_delta_vs_last, coalesce(times, 0)::INT AS reobservation_count,
           {ts('latest')} AS last_reobserved_at, CASE WHEN late THEN 'escalated' ELSE 'new' END AS status,
           CASE WHEN late THEN 'Auto-escalated after 120 min without acknowledgement' END AS decision_reason
    FROM made m JOIN budget USING (as_of, state) LEFT JOIN again g ON g.atm_id = m.atm_id AND g.last_at = m.as_of,
         LATERAL (SELECT m.as_of < (SELECT max(as_of) FROM cycles) - INTERVAL 120 MINUTE AS late)""", ("withdrawals", "atms"))
def _(t: Tables) -> DataFrame:
    base = jobs.stream_folder(t.spark)
    arrived = cycle.AlertCycle(f"{base}/cycle", t.atms, WEIGHTS, INTERCEPT)
    end = t.withdrawals.agg(F.date_trunc("hour", F.max("timestamp")) + F.expr("interval 1 hour")).first()[0].replace(tzinfo=None)
    cuts = [end - timedelta(hours=h) for h in CUTS]
    stream = None
    for i, upto in enumerate(cuts):
        new = t.withdrawals.where(F.col("timestamp") < at(upto))
        (new.where(F.col("timestamp") >= at(cuts[i - 1])) if i else new).write.parquet(f"{base}/arrivals/part={i}")
        stream = stream or t.spark.readStream.schema(t.withdrawals.schema).parquet(f"{base}/arrivals/*")
        arrived.start(stream).awaitTermination()
    return arrived.alerts(t.spark).select(
        "alert_id", "atm_id", "created_at", "risk_score", "tier", "risk_delta_vs_last", "reobservation_count", "last_reobserved_at", "status", "decision_reason"
    )
