"""Alerts and response, log verification, reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outflow.catalog.features import MATRIX_CTES, VIEWS, matrix
from outflow.catalog.joins_windows import HAVERSINE
from outflow.catalog.registry import money, query, r4, r6, ts
from outflow.catalog.sources_listing import ACTION_SQL, LEVEL_SQL
from outflow.functions import scalar as fx
from outflow.operators import aggregates as agg
from outflow.operators import alerts as al
from outflow.operators import auditlog
from outflow.plans import reports
from outflow.sources.views import Tables

AS_OF, AS_OF_SQL = datetime(2024, 1, 30, 6), "TIMESTAMP '2024-01-30 06:00:00'"

# ---------------------------------------------------------------- alerts

CYCLE = f"""
    cycle AS (
        SELECT s.*, last_alert_id, {r4('s.risk_score - last_risk')} AS risk_delta_vs_last,
               CASE WHEN s.risk_score - last_risk <= 0.1 THEN 'reobserved' ELSE 'new' END AS outcome
        FROM latest_scores s LEFT JOIN (
            SELECT atm_id, alert_id AS last_alert_id, risk_score AS last_risk FROM alerts
            WHERE created_at <= {AS_OF_SQL} AND created_at >= {AS_OF_SQL} - INTERVAL 6 HOUR
            QUALIFY row_number() OVER (PARTITION BY atm_id ORDER BY alerts.created_at DESC, alert_id DESC) = 1) r ON s.atm_id = r.atm_id
        WHERE s.risk_score >= 0.70)"""
CYCLE_VIEWS = ("latest_scores", "alerts")
TIER = "CASE WHEN risk_score >= 0.85 THEN 'dispatch' WHEN risk_score >= 0.70 THEN 'action' ELSE 'monitor' END"
ADVICE = f"CASE WHEN risk_score >= 0.70 AND risk_score < 0.78 THEN '{fx.ADVICE_HOLD}' ELSE {ACTION_SQL.format('(' + LEVEL_SQL.format('risk_score') + ')')} END"
BUILT = f"""
    pop AS (SELECT state, count(*) AS n FROM atms GROUP BY 1),
    budget AS (SELECT state, greatest(1, round_even((SELECT count(*) FROM cycle)::DOUBLE * n / (SELECT sum(n) FROM pop), 0)::BIGINT) AS b FROM pop),
    built AS (
        SELECT 'ALT-' || atm_id || '-20240130060000' AS alert_id, atm_id, state, {r4('risk_score')} AS risk_score,
               CASE WHEN capped THEN 'monitor' ELSE t END AS tier,
               CASE WHEN capped THEN '{al.CAPPED_PREFIX}' ELSE '' END || advice AS recommended_action,
               CASE WHEN last_alert_id IS NOT NULL THEN risk_delta_vs_last END AS risk_delta_vs_last
        FROM (SELECT *, t = 'action' AND p > b AS capped FROM (
            SELECT c.*, {TIER} AS t, {ADVICE} AS advice, row_number() OVER (PARTITION BY state ORDER BY risk_score DESC, atm_id) AS p
            FROM cycle c WHERE outcome = 'new') JOIN budget USING (state)))"""


def cycle(t: Tables) -> DataFrame:
    return al.alert_cycle(t.latest_scores, t.alerts, AS_OF)


@query("i01_alert_cycle", f"WITH {CYCLE} SELECT atm_id, outcome, last_alert_id, risk_delta_vs_last FROM cycle", CYCLE_VIEWS)
def _(t: Tables) -> DataFrame:
    return cycle(t).select("atm_id", "outcome", "last_alert_id", "risk_delta_vs_last")


@query("i02_reobserve", f"""
    WITH {CYCLE} SELECT alert_id, CASE WHEN h THEN 1 ELSE 0 END AS reobservation_count,
        CASE WHEN h THEN {ts(AS_OF_SQL)} END AS last_reobserved_at
    FROM (SELECT alert_id, alert_id IN (SELECT last_alert_id FROM cycle WHERE outcome = 'reobserved') AS h FROM alerts)""", CYCLE_VIEWS)
def _(t: Tables) -> DataFrame:
    return al.reobserve(t.alerts, cycle(t), AS_OF).select("alert_id", "reobservation_count", "last_reobserved_at")


@query("i03_build_alerts", f"WITH {CYCLE}, {BUILT} SELECT * FROM built", (*CYCLE_VIEWS, "atms"))
def _(t: Tables) -> DataFrame:
    built = al.build_alerts(cycle(t), agg.atm_population_by_state(t.atms), AS_OF)
    return built.select("alert_id", "atm_id", "state", "risk_score", "tier", "recommended_action", "risk_delta_vs_last")


@query("i04_alert_cycle_summary", f"""
    WITH {CYCLE} SELECT (SELECT count(*) FROM latest_scores) AS checked, count(*) AS flagged, count(*) FILTER (outcome = 'new') AS created,
        count(*) FILTER (outcome = 'reobserved') AS reobserved FROM cycle""", CYCLE_VIEWS)
def _(t: Tables) -> DataFrame:
    return al.alert_cycle_summary(t.latest_scores, cycle(t))


@query("i05_escalate_stale", f"""
    SELECT alert_id, CASE WHEN s THEN 'escalated' ELSE status END AS status,
           CASE WHEN s THEN 'Auto-escalated after 120 min without acknowledgement' ELSE decision_reason END AS decision_reason
    FROM (SELECT *, status IN ('new', 'acknowledged') AND created_at < {AS_OF_SQL} - INTERVAL 120 MINUTE AS s FROM alerts)""", ("alerts",))
def _(t: Tables) -> DataFrame:
    return al.escalate_stale(t.alerts, AS_OF).select("alert_id", "status", "decision_reason")


DECISIONS = """
    decisions AS (
        SELECT alert_id, created_at + to_hours(k::INT) AS decided_at, ['acknowledged', 'dismissed', 'actioned', 'unknown'][k] AS status,
               CASE WHEN tier = 'dispatch' THEN 'seen ' || k ELSE '' END AS reason
        FROM alerts, (SELECT unnest([1, 2, 3, 4]) AS k))"""


def _decisions(t: Tables) -> DataFrame:
    """Four decisions per alert: an acknowledgement, a dismissal that needs a reason, an action, an unknown status."""
    k = F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k")
    return t.alerts.select("alert_id", "created_at", "tier", k).select(
        "alert_id", (F.col("created_at") + F.make_dt_interval(F.lit(0), F.col("k"))).alias("decided_at"),
        F.element_at(F.array(*[F.lit(s) for s in ("acknowledged", "dismissed", "actioned", "unknown")]), F.col("k")).alias("status"),
        F.when(F.col("tier") == "dispatch", F.concat(F.lit("seen "), F.col("k"))).otherwise("").alias("reason"),
    )


@query("i06_apply_decisions", f"""
    WITH {DECISIONS}, v AS (SELECT * FROM decisions WHERE status <> 'unknown' AND (status <> 'dismissed' OR reason <> ''))
    SELECT alert_id, max_by(v.status, decided_at) AS status, coalesce(max_by(v.reason, decided_at) FILTER (v.reason <> ''), '') AS decision_reason,
           {ts("min(decided_at) FILTER (v.status = 'acknowledged')")} AS acknowledged_at,
           {ts("max(decided_at) FILTER (v.status = 'actioned')")} AS actioned_at FROM v GROUP BY 1""", ("alerts",))
def _(t: Tables) -> DataFrame:
    return al.apply_decisions(t.alerts, _decisions(t)).select("alert_id", "status", "decision_reason", "acknowledged_at", "actioned_at")


ORIGIN = """
    links AS (SELECT w.atm_id, c.victim_state, count(*) AS n
              FROM (SELECT DISTINCT atm_id, account_token FROM order_withdrawals WHERE order_withdrawals.timestamp >= TIMESTAMP '2001-03-01' - INTERVAL 45 DAY) w
              JOIN order_complaints c ON c.linked_account_token = w.account_token AND filing_timestamp >= TIMESTAMP '2001-03-01' - INTERVAL 45 DAY
              GROUP BY 1, 2),
    crossing AS (SELECT l.atm_id, victim_state AS s FROM links l JOIN atms a ON l.atm_id = a.atm_id WHERE victim_state <> a.state
                 QUALIFY row_number() OVER (PARTITION BY l.atm_id ORDER BY n DESC, victim_state) = 1),
    recent AS (SELECT * FROM order_complaints WHERE filing_timestamp >= TIMESTAMP '2001-03-01' - INTERVAL 45 DAY),
    byd AS (SELECT victim_district AS d, victim_state AS s FROM recent GROUP BY 1, 2
            QUALIFY row_number() OVER (PARTITION BY victim_district ORDER BY count(*) DESC, victim_state) = 1),
    byc AS (SELECT victim_city AS c, victim_state AS s FROM recent GROUP BY 1, 2
            QUALIFY row_number() OVER (PARTITION BY victim_city ORDER BY count(*) DESC, victim_state) = 1),
    origins AS (SELECT a.atm_id, coalesce(x.s, byd.s, (SELECT min(victim_state) FROM recent WHERE victim_state = a.state), byc.s, '') AS origin_state
                FROM atms a LEFT JOIN crossing x ON a.atm_id = x.atm_id LEFT JOIN byd ON byd.d = a.district LEFT JOIN byc ON byc.c = a.city)"""
ORIGIN_VIEWS = ("atms", "order_withdrawals", "order_complaints")
ORDERS_AS_OF = datetime(2001, 3, 1)


def origins(t: Tables) -> DataFrame:
    return al.origin_state(t.atms, t.order_withdrawals, t.order_complaints, ORDERS_AS_OF)


@query("i07_origin_state", f"WITH {ORIGIN} SELECT * FROM origins", ORIGIN_VIEWS)
def _(t: Tables) -> DataFrame:
    return origins(t)


@query("i08_route_alerts", f"""
    WITH {ORIGIN} SELECT 'HO-' || alert_id AS handoff_id, alert_id, a.atm_id, origin_state, state AS receiving_state, 'queued' AS status
    FROM alerts a JOIN origins o ON a.atm_id = o.atm_id WHERE origin_state <> '' AND origin_state <> state
    AND alert_id NOT IN (SELECT alert_id FROM handoffs)""", (*ORIGIN_VIEWS, "alerts", "handoffs"))
def _(t: Tables) -> DataFrame:
    return al.route_alerts(t.alerts, origins(t), t.handoffs, AS_OF).drop("reason", "created_at")


def _acks(t: Tables) -> DataFrame:
    """Every queued hand-off is acknowledged an hour later, dispatch alerts are also completed."""
    queued = t.handoffs.where("status = 'queued'").join(t.alerts.select("alert_id", "tier"), "alert_id")
    return queued.select(
        "handoff_id", F.concat(F.lit("officer "), F.col("receiving_state")).alias("actor"),
        (F.col("created_at") + F.expr("interval 1 hour")).alias("acked_at"), (F.col("tier") == "dispatch").alias("complete"),
    )


ACKED = """
    acked AS (SELECT h.handoff_id, h.alert_id, CASE WHEN h.status <> 'queued' THEN h.status WHEN tier = 'dispatch' THEN 'complete' ELSE 'ack' END AS status,
              CASE WHEN h.status = 'queued' THEN 'officer ' || receiving_state END AS ack_by FROM handoffs h JOIN alerts a ON h.alert_id = a.alert_id)"""


@query("i09_ack_handoffs", f"WITH {ACKED} SELECT * FROM acked", ("handoffs", "alerts"))
def _(t: Tables) -> DataFrame:
    return al.ack_handoffs(t.handoffs, _acks(t)).select("handoff_id", "alert_id", "status", "ack_by")


@query("i09_mirror_routing", f"""
    WITH {ACKED} SELECT a.alert_id, CASE WHEN k.alert_id IS NULL THEN CASE WHEN tier = 'dispatch' THEN 'intra' ELSE 'none' END WHEN k.status = 'complete' THEN 'handoff_complete'
           WHEN k.status = 'ack' THEN 'handoff_ack' ELSE 'handoff' END AS routing_status
    FROM alerts a LEFT JOIN acked k ON a.alert_id = k.alert_id""", ("handoffs", "alerts"))
def _(t: Tables) -> DataFrame:
    alerts = t.alerts.withColumn("routing_status", F.when(F.col("tier") == "dispatch", "intra"))
    return al.mirror_routing(alerts, al.ack_handoffs(t.handoffs, _acks(t))).select("alert_id", "routing_status")


@query("i10_fund_block", f"""
    WITH act AS (SELECT atm_id, account_token, count(*) AS n, {money('amount')} AS amount FROM withdrawals
                 WHERE timestamp <= {AS_OF_SQL} AND account_token IN (SELECT linked_account_token FROM complaints) GROUP BY 1, 2
                 QUALIFY row_number() OVER (PARTITION BY atm_id ORDER BY n DESC, account_token) <= 3),
    ids AS (SELECT account_token, string_agg(complaint_id, ',' ORDER BY p) AS ids FROM (
                SELECT linked_account_token AS account_token, complaint_id, row_number() OVER (
                    PARTITION BY linked_account_token ORDER BY filing_timestamp DESC, complaint_id) AS p FROM complaints) GROUP BY 1)
    SELECT alert_id, act.account_token, coalesce(home_bank, a.bank_name) AS home_bank, ids AS linked_complaint_ids, amount AS amount_at_risk,
           CASE WHEN risk_score >= 0.85 THEN 'freeze' ELSE 'hold' END AS recommended_action
    FROM alerts a JOIN act ON a.atm_id = act.atm_id LEFT JOIN ids ON ids.account_token = act.account_token
    LEFT JOIN accounts c ON c.account_token = act.account_token""", ("alerts", "withdrawals", "complaints", "accounts"))
def _(t: Tables) -> DataFrame:
    blocks = al.fund_block(t.alerts, t.withdrawals, t.complaints, t.accounts, AS_OF, None, hours=None)
    return blocks.select(
        "alert_id", "account_token", "home_bank", F.array_join("linked_complaint_ids", ",").alias("linked_complaint_ids"),
        "amount_at_risk", "recommended_action",
    )


@query("i11_update_recovery", """
    SELECT rec_id, CASE WHEN amount_at_risk > 60000 THEN 'recovered' WHEN amount_at_risk > 30000 THEN 'held' ELSE status END AS status,
           CASE WHEN amount_at_risk > 30000 THEN amount_at_risk ELSE amount_held END AS amount_held,
           CASE WHEN amount_at_risk > 60000 THEN amount_at_risk ELSE amount_recovered END AS amount_recovered FROM recovery""", ("recovery",))
def _(t: Tables) -> DataFrame:
    at_risk, zero = F.col("amount_at_risk"), F.lit(0.0)
    held = t.recovery.where(at_risk > 30000).select(
        "rec_id", F.col("created_at").alias("at"), F.lit("held").alias("status"), at_risk.alias("amount_held"), zero.alias("amount_recovered")
    )
    back = t.recovery.where(at_risk > 60000).select(
        "rec_id", (F.col("created_at") + F.expr("interval 1 day")).alias("at"), F.lit("recovered").alias("status"),
        zero.alias("amount_held"), at_risk.alias("amount_recovered"),
    )
    return al.update_recovery(t.recovery, held.unionByName(back)).select("rec_id", "status", "amount_held", "amount_recovered")


@query("i12_evaluate_outcomes", f"""
    SELECT alert_id, predicted_risk, CASE WHEN y THEN 'yes' ELSE 'no' END AS actual_fraud_happened, {r4('abs(y::INT - predicted_risk)')} AS prediction_error,
           NOT y AND predicted_risk >= 0.5 AS is_false_positive, y AND predicted_risk < 0.5 AS is_false_negative
    FROM (SELECT alert_id, risk_score AS predicted_risk, EXISTS (SELECT 1 FROM withdrawals w WHERE w.atm_id = a.atm_id AND is_fraud_withdrawal
              AND w.timestamp >= a.created_at AND w.timestamp <= a.created_at + INTERVAL 24 HOUR) AS y
          FROM alerts a WHERE created_at <= {AS_OF_SQL} - INTERVAL 24 HOUR AND alert_id NOT IN (SELECT alert_id FROM outcomes))""",
    ("alerts", "outcomes", "withdrawals"))
def _(t: Tables) -> DataFrame:
    return al.evaluate_outcomes(t.alerts, t.outcomes, t.withdrawals, AS_OF).drop("atm_id", "evaluated_at")


@query("i13_outcome_monitor", f"""
    SELECT count(*) AS evaluated, count(*) FILTER (y = 1 AND predicted_risk >= 0.5) AS true_positives, count(*) FILTER (is_false_positive) AS false_positives,
           count(*) FILTER (y = 0 AND predicted_risk < 0.5) AS true_negatives, count(*) FILTER (is_false_negative) AS false_negatives,
           {r4('avg(prediction_error)')} AS mean_abs_error,
           (SELECT {r4('sum(n * abs(m - o)) / (SELECT count(*) FROM outcomes)')} FROM (
               SELECT floor(predicted_risk * 10) AS b, count(*) AS n, avg(predicted_risk) AS m, avg((actual_fraud_happened = 'yes')::INT) AS o
               FROM outcomes WHERE predicted_risk < 1 GROUP BY 1) WHERE n >= 2) AS outcome_ece_10_bins
    FROM (SELECT *, (actual_fraud_happened = 'yes')::INT AS y FROM outcomes)""", ("outcomes",))
def _(t: Tables) -> DataFrame:
    return al.outcome_monitor(t.outcomes)


DIST = HAVERSINE.format("latitude", "longitude", "victim_lat", "victim_lon")


@query("i14_evidence", f"""
    WITH nearby AS (SELECT atm_id, complaint_type, count(*) AS n FROM atms, complaints WHERE filing_timestamp BETWEEN {AS_OF_SQL} - INTERVAL 240 HOUR
                    AND {AS_OF_SQL} AND {DIST} <= 2.0 GROUP BY 1, 2),
    filed AS (SELECT atm_id, sum(n) AS n, string_agg(complaint_type || ' ' || n, ', ' ORDER BY complaint_type) AS d FROM nearby GROUP BY 1),
    drawn AS (SELECT atm_id, count(*) AS n, count(DISTINCT account_token) AS k FROM withdrawals
              WHERE withdrawals.timestamp BETWEEN {AS_OF_SQL} - INTERVAL 72 HOUR AND {AS_OF_SQL} GROUP BY 1),
    act AS (SELECT atm_id, account_token, row_number() OVER (PARTITION BY atm_id ORDER BY count(*) DESC, account_token) AS p FROM withdrawals
            WHERE withdrawals.timestamp BETWEEN {AS_OF_SQL} - INTERVAL 24 HOUR AND {AS_OF_SQL}
            AND account_token IN (SELECT linked_account_token FROM complaints) GROUP BY 1, 2)
    SELECT alert_id, coalesce(f.n, 0)::BIGINT || ' complaint(s) in the last 240h within 2km of this ATM (' || coalesce(f.d, 'none') || ').' AS complaint_activity,
           coalesce(w.n, 0) || ' withdrawal(s) from ' || coalesce(w.k, 0) || ' distinct account(s) at this ATM in the last 72h.' AS withdrawal_activity,
           false AS is_night, coalesce((SELECT string_agg(account_token, ',' ORDER BY p) FROM act WHERE act.atm_id = a.atm_id AND p <= 3), '') AS freeze_accounts
    FROM alerts a LEFT JOIN filed f ON a.atm_id = f.atm_id LEFT JOIN drawn w ON w.atm_id = a.atm_id""", ("alerts", "atms", "complaints", "withdrawals"))
def _(t: Tables) -> DataFrame:
    rows = al.evidence(t.alerts, t.atms, t.complaints, t.withdrawals, AS_OF, 240, 72)
    return rows.select(
        "alert_id", "complaint_activity", "withdrawal_activity", "is_night", F.array_join("freeze_accounts", ",").alias("freeze_accounts")
    )


@query("i15_evidence_signals", f"""
    WITH {MATRIX_CTES}, j AS (SELECT alert_id, a.risk_score, m.* FROM alerts a JOIN matrix m ON a.atm_id = m.atm_id AND a.created_at::DATE = m.day)
    SELECT alert_id, 'Recent complaint surge' AS signal, n_complaints_city_24h || ' complaint(s)' AS value,
           CASE WHEN n_complaints_city_24h > 0 THEN 'up' ELSE 'flat' END AS direction FROM j
    UNION ALL SELECT alert_id, 'Transaction velocity increase', printf('withdrawals_6h=%.1f, withdrawals_24h=%.1f', withdrawals_6h::DOUBLE, withdrawals_24h::DOUBLE),
           CASE WHEN withdrawals_6h > withdrawals_24h / 6 THEN 'up' ELSE 'flat' END FROM j
    UNION ALL SELECT alert_id, 'Mule-account concentration', printf('counterparty_count_24h=%.1f, linked_share=%.2f', counterparty_count_24h::DOUBLE, round(round(linked_proportion_24h, 10), 2)),
           CASE WHEN linked_proportion_24h >= 0.4 THEN 'up' ELSE 'flat' END FROM j
    UNION ALL SELECT alert_id, 'Geographic proximity', printf('dist_to_complaint_centroid_km=%.1f', round(round(dist_to_complaint_centroid_km, 10), 1)),
           CASE WHEN dist_to_complaint_centroid_km <= 10 THEN 'near' ELSE 'far' END FROM j
    UNION ALL SELECT alert_id, 'Temporal similarity (Hawkes intensity)', printf('hawkes_intensity_24h=%.3f', round(round(hawkes_intensity_24h, 10), 3)),
           CASE WHEN hawkes_intensity_24h > 15 THEN 'up' ELSE 'flat' END FROM j
    UNION ALL SELECT alert_id, 'Forecast risk', printf('%.2f (threshold >= 0.70)', round(round(risk_score, 10), 2)),
           CASE WHEN risk_score >= 0.7 THEN 'flagged' ELSE 'not-flagged' END FROM j""", (*VIEWS, "alerts"))
def _(t: Tables) -> DataFrame:
    alerts = t.alerts.select("alert_id", "atm_id", "risk_score", F.to_date("created_at").alias("day"))
    rows = alerts.join(matrix(t).drop("label"), ["atm_id", "day"])
    return al.evidence_signals(rows.withColumn("n_complaints", F.col("n_complaints_city_24h").cast("bigint")))


NEARBY_KM = HAVERSINE.format("12.0", "83.0", "latitude", "longitude")


@query("i16_nearby", f"""
    SELECT atm_id, round(round(km, 10), 2) AS distance_km, {r4('0.6 * greatest(risk_score, 0) + 0.4 / (1 + km)')} AS mobile_score
    FROM (SELECT *, {NEARBY_KM} AS km FROM latest_scores) WHERE km <= 800 ORDER BY mobile_score DESC, atm_id LIMIT 25""", ("latest_scores",))
def _(t: Tables) -> DataFrame:
    return al.nearby(t.latest_scores, 12.0, 83.0, 800.0, 25).select("atm_id", "distance_km", "mobile_score")


@query("i17_score_summary_by_level", f"SELECT {LEVEL_SQL.format('score')} AS risk_level, count(*) AS n FROM scores GROUP BY 1", ("scores",))
def _(t: Tables) -> DataFrame:
    return al.score_summary_by_level(t.scores.select(F.col("score").alias("risk_score")))


# ---------------------------------------------------------------- log verification

LOG_HASH = ("sha256(concat_ws('|', index::VARCHAR, strftime(created_at, '%Y-%m-%d %H:%M:%S'), actor, event_type, payload_hash, prev_hash))")
CHECKS = f"""
    checks AS (SELECT index, hash = {LOG_HASH} AS hash_ok, prev_hash = coalesce(lag(hash) OVER (ORDER BY index), repeat('0', 64)) AS link_ok FROM audit_log)"""


@query("j01_log_checks", f"WITH {CHECKS} SELECT * FROM checks", ("audit_log",))
def _(t: Tables) -> DataFrame:
    return auditlog.log_checks(t.audit_log)


@query("j01_verify_log", f"""
    WITH {CHECKS} SELECT count(*) FILTER (NOT (hash_ok AND link_ok)) = 0 AS intact, min(index) FILTER (NOT (hash_ok AND link_ok)) AS broken_at_index,
        count(*) AS records FROM checks""", ("audit_log",))
def _(t: Tables) -> DataFrame:
    return auditlog.verify_log(t.audit_log)


@query("j02_verify_blocks", """
    WITH b AS (SELECT *, lag(hash) OVER (ORDER BY block_index) AS before,
                      sha256(concat_ws('|', block_index::VARCHAR, data, previous_hash, nonce::VARCHAR)) AS computed FROM blocks)
    SELECT block_index, 'INVALID_DATA' AS issue FROM b WHERE before IS NOT NULL AND NOT json_valid(data)
    UNION ALL SELECT block_index, 'HASH_MISMATCH' FROM b WHERE before IS NOT NULL AND hash <> computed
    UNION ALL SELECT block_index, 'CHAIN_BROKEN' FROM b WHERE before IS NOT NULL AND previous_hash <> before
    UNION ALL SELECT block_index, 'INVALID_POW' FROM b WHERE before IS NOT NULL AND NOT starts_with(hash, '00')
    UNION ALL SELECT block_index, 'BAD_GENESIS' FROM b WHERE before IS NULL AND (block_index <> 0 OR previous_hash <> repeat('0', 64))""", ("blocks",))
def _(t: Tables) -> DataFrame:
    return auditlog.verify_blocks(t.blocks, 2)


@query("j03_log_statistics", """
    SELECT count(*) AS total_blocks, max(block_index) AS latest_index, max_by(hash, block_index) AS latest_hash,
           (SELECT string_agg(record_type || '=' || n, ',' ORDER BY record_type) FROM (SELECT record_type, count(*) AS n FROM blocks GROUP BY 1)) AS records_by_type
    FROM blocks""", ("blocks",))
def _(t: Tables) -> DataFrame:
    text = F.transform(F.map_entries("records_by_type"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return auditlog.log_statistics(t.blocks).withColumn("records_by_type", F.array_join(F.array_sort(text), ","))


@query("j04_entity_history", """SELECT block_index, data, record_type FROM blocks WHERE contains(data, '"k": 42') ORDER BY block_index""", ("blocks",))
def _(t: Tables) -> DataFrame:
    return auditlog.entity_history(t.blocks, '"k": 42').select("block_index", "data", "record_type")


@query("j05_records_by_type", "SELECT block_index, hash FROM blocks WHERE record_type = 'error' ORDER BY block_index DESC LIMIT 100", ("blocks",))
def _(t: Tables) -> DataFrame:
    return auditlog.records_by_type(t.blocks, "error").select("block_index", "hash")


@query("j06_log_page", f"""
    SELECT index, {ts('created_at')} AS created_at, actor, event_type, entity_id, substring(payload_hash, 1, 16) AS payload_hash,
           substring(prev_hash, 1, 16) AS prev_hash, substring(hash, 1, 16) AS hash FROM audit_log ORDER BY index DESC LIMIT 50 OFFSET 25""", ("audit_log",))
def _(t: Tables) -> DataFrame:
    return auditlog.log_page(t.audit_log, 50, 25)


@query("j07_payload_hash", """
    SELECT index, sha256('{"actor":"' || actor || '","event_type":"' || event_type || '","index":' || index || '}') AS h FROM audit_log""", ("audit_log",))
def _(t: Tables) -> DataFrame:
    return t.audit_log.select("index", auditlog.payload_hash(["event_type", "actor", "index"]).alias("h"))


# ---------------------------------------------------------------- reports


def _text(column: str):
    """A map as sorted key=value text."""
    entries = F.transform(F.map_entries(column), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return F.array_join(entries, ",").alias(column)


def _text_sql(source: str, key: str, where: str = "true") -> str:
    return f"(SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM (SELECT {key} AS k, count(*) AS n FROM {source} WHERE {where} GROUP BY 1))"


H24, D7 = f"filing_timestamp >= {AS_OF_SQL} - INTERVAL 24 HOUR", f"filing_timestamp >= {AS_OF_SQL} - INTERVAL 7 DAY"


@query("d31_summary_stats", f"""
    SELECT (SELECT count(*) FROM complaints) AS total_complaints, (SELECT count(*) FROM complaints WHERE {H24}) AS complaints_24h,
           (SELECT count(*) FROM complaints WHERE {D7}) AS complaints_7d, (SELECT count(*) FROM atms) AS total_atms,
           (SELECT count(*) FROM latest_scores WHERE risk_score >= 0.7) AS high_risk_atms, (SELECT count(*) FROM withdrawals) AS total_withdrawals,
           (SELECT count(*) FROM withdrawals WHERE is_fraud_withdrawal AND timestamp >= {AS_OF_SQL} - INTERVAL 7 DAY) AS fraud_withdrawals_7d,
           (SELECT count(*) FROM alerts) AS alerts_total, (SELECT count(*) FROM alerts WHERE status = 'new') AS alerts_new,
           (SELECT count(*) FROM alerts WHERE status = 'actioned') AS alerts_actioned,
           {_text_sql('complaints', 'victim_city', H24)} AS complaints_by_city_24h, {_text_sql('complaints', 'victim_city', D7)} AS complaints_by_city_7d,
           {_text_sql('complaints', 'complaint_type', H24)} AS complaints_by_type_24h,
           (SELECT string_agg(city || '=' || '{{' || kinds || '}}', ',' ORDER BY city) FROM (SELECT city, string_agg('"' || k || '":' || n, ',' ORDER BY k) AS kinds
            FROM (SELECT victim_city AS city, complaint_type AS k, count(*) AS n FROM complaints WHERE {H24} GROUP BY 1, 2) GROUP BY 1)) AS complaints_by_city_type_24h,
           {_text_sql('latest_scores', 'city', 'risk_score >= 0.7')} AS high_risk_atms_by_city,
           (SELECT string_agg(atm_id, ',' ORDER BY risk_score DESC, atm_id) FROM (SELECT atm_id, risk_score FROM latest_scores ORDER BY risk_score DESC, atm_id LIMIT 20)) AS hotspots""",
    ("complaints", "withdrawals", "atms", "alerts", "latest_scores"))
def _(t: Tables) -> DataFrame:
    row = reports.summary_stats(t.complaints, t.withdrawals, t.atms, t.alerts, t.latest_scores, AS_OF)
    maps = ["complaints_by_city_24h", "complaints_by_city_7d", "complaints_by_type_24h", "complaints_by_city_type_24h", "high_risk_atms_by_city"]
    plain = [c for c in row.columns if c not in (*maps, "hotspots")]
    return row.select(*plain, *[_text(m) for m in maps], F.array_join("hotspots", ",").alias("hotspots"))


@query("d32_city_brief", f"""
    SELECT s.city, count(*) AS atms_scored, count(*) FILTER (risk_score >= 0.7) AS high_risk_atms,
           (SELECT count(*) FROM complaints WHERE victim_city = s.city AND {H24}) AS complaints_24h,
           (SELECT count(*) FROM complaints WHERE victim_city = s.city AND {D7}) AS complaints_7d,
           (SELECT string_agg(atm_id, ',' ORDER BY p) FROM (SELECT city, atm_id, row_number() OVER (PARTITION BY city ORDER BY risk_score DESC, atm_id) AS p
            FROM latest_scores) x WHERE x.city = s.city) AS hotspots,
           coalesce((SELECT string_agg(alert_id, ',' ORDER BY p) FROM (SELECT city, alert_id, row_number() OVER (PARTITION BY city ORDER BY alerts.created_at DESC, alert_id) AS p
            FROM alerts WHERE status IN ('new', 'acknowledged')) x WHERE x.city = s.city), '') AS open_alerts
    FROM latest_scores s GROUP BY 1""", ("complaints", "alerts", "latest_scores"))
def _(t: Tables) -> DataFrame:
    brief = reports.city_brief(t.complaints, t.alerts, t.latest_scores, AS_OF, None, None)
    return brief.select(
        "city", "atms_scored", "high_risk_atms", "complaints_24h", "complaints_7d", F.array_join("hotspots.atm_id", ",").alias("hotspots"),
        F.coalesce(F.array_join("open_alerts.alert_id", ","), F.lit("")).alias("open_alerts"),
    )


@query("d33_situational_report", f"""
    SELECT 'situational' AS report_type, count(*) AS alerts_total, count(*) FILTER (status = 'new') AS alerts_new, count(*) FILTER (status = 'actioned') AS alerts_actioned,
           {_text_sql('complaints', 'victim_city', H24)} AS complaints_per_city_24h, {_text_sql('complaints', 'victim_city', D7)} AS complaints_per_city_7d,
           {_text_sql('complaints', 'complaint_type', H24)} AS complaints_by_type_24h,
           {_text_sql('alerts', 'district', 'risk_score >= 0.7')} AS high_risk_atms_per_district,
           (SELECT {money('amount_at_risk')} FROM recovery) AS flagged, (SELECT {money('amount_recovered')} FROM recovery) AS recovered,
           (SELECT {money('amount_held')} FROM recovery) AS held, (SELECT {r6(f"round(100 * {money('amount_recovered')} / {money('amount_at_risk')}, 2)")} FROM recovery) AS recovery_rate_pct
    FROM alerts""", ("complaints", "alerts", "recovery"))
def _(t: Tables) -> DataFrame:
    row = reports.situational_report(t.complaints, t.alerts, t.recovery, AS_OF, recovery_days=None)
    maps = ["complaints_per_city_24h", "complaints_per_city_7d", "complaints_by_type_24h", "high_risk_atms_per_district"]
    return row.select(
        "report_type", "alerts_total", "alerts_new", "alerts_actioned", *[_text(m) for m in maps],
        *[F.col(f"recovery_funnel.{c}").alias(c) for c in ("flagged", "held", "recovered", "recovery_rate_pct")],
    )


@query("d34_hotspot_report", f"""
    WITH close AS (SELECT atm_id, complaint_id, complaint_type, amount_lost, linked_account_token,
                          row_number() OVER (PARTITION BY atm_id ORDER BY filing_timestamp DESC, complaint_id) AS p
                   FROM atms, complaints WHERE filing_timestamp BETWEEN {AS_OF_SQL} - INTERVAL 240 HOUR AND {AS_OF_SQL} AND {DIST} <= 2.0),
    active AS (SELECT atm_id, string_agg(account_token, ',' ORDER BY p) AS accounts FROM (
        SELECT atm_id, account_token, row_number() OVER (PARTITION BY atm_id ORDER BY count(*) DESC, account_token) AS p FROM withdrawals
        WHERE timestamp BETWEEN {AS_OF_SQL} - INTERVAL 240 HOUR AND {AS_OF_SQL} AND account_token IN (SELECT linked_account_token FROM complaints) GROUP BY 1, 2)
        WHERE p <= 3 GROUP BY 1),
    listed AS (SELECT atm_id, count(*) AS n, string_agg(concat_ws(':', p, complaint_id, complaint_type, printf('%.2f', amount_lost), coalesce(linked_account_token, '-')), ',' ORDER BY p) AS found
               FROM close GROUP BY 1)
    SELECT 'hotspot' AS report_type, alert_id AS case_ref, a.atm_id, state, district, bank_name, police_station_area, {r6('risk_score')} AS risk_score,
           coalesce(n, 0) AS complaints_near, coalesce(found, '') AS linked_complaints, coalesce(accounts, '') AS mule_account_tokens, {ADVICE} AS recommended_action
    FROM alerts a LEFT JOIN listed USING (atm_id) LEFT JOIN active USING (atm_id)""",
    ("alerts", "atms", "complaints", "withdrawals"))
def _(t: Tables) -> DataFrame:
    entry = lambda c: F.concat_ws(
        ":", c["rank"].cast("string"), c["complaint_id"], c["complaint_type"], F.format_string("%.2f", c["amount_lost"]), F.coalesce(c["linked_account_token"], F.lit("-"))
    )
    text = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    # The text of a machine's list is made once for all its alerts.
    report = reports.hotspot_report(t.alerts, t.atms, t.complaints, t.withdrawals, AS_OF, None, 240, lambda c: F.array_join(F.transform(c, entry), ","))
    return report.select(
        "report_type", "case_ref", "atm_id", "jurisdiction.*", "risk_score", "complaints_near", F.coalesce("linked_complaints", F.lit("")).alias("linked_complaints"),
        text(F.col("mule_account_tokens")).alias("mule_account_tokens"), "recommended_action",
    )
