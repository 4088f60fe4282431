"""The alert workflow as set operations: one plan per step over all machines or alerts at once."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outflow.functions import scalar as fx
from outflow.operators import aggregates as agg
from outflow.operators.joins import asof_forward, link_atm_accounts_complaints, near, pending_alerts
from outflow.operators.listing import at, complaint_ids_for_account
from outflow.operators.metrics import ece10
from outflow.operators.windows import fairness_cap, latest_per_key
from outflow.schemas import DECISION_STATUS, REASON_REQUIRED

# Cooldown and material rise of the duplicate rule, and the texts of the workflow.
COOLDOWN_HOURS = 6
MATERIAL_RISE = 0.1
CAPPED_PREFIX = "FAIRNESS-CAPPED (per-jurisdiction cap) — MONITOR + review; "


def alert_cycle(scores: DataFrame, alerts: DataFrame, as_of: datetime, threshold: float = fx.HIGH,
                cooldown_hours: int = COOLDOWN_HOURS, rise: float = MATERIAL_RISE) -> DataFrame:
    """Every flagged score with its outcome: ``new`` (with the rise over the last alert, if any) or ``reobserved``."""
    flagged = scores.where(F.col("risk_score") >= threshold)
    recent = alerts.where(F.col("created_at") <= at(as_of)).select("atm_id", "alert_id", "created_at", "risk_score")
    recent = latest_per_key(recent, "atm_id", "created_at", as_of - timedelta(hours=cooldown_hours), "alert_id")
    last = recent.select("atm_id", F.col("alert_id").alias("last_alert_id"), F.col("risk_score").alias("last_risk"))
    joined = flagged.join(last, "atm_id", "left")
    delta = F.col("risk_score") - F.col("last_risk")
    return joined.withColumn("risk_delta_vs_last", fx.rounded(delta)).withColumn(
        "outcome", F.when(delta <= rise, "reobserved").otherwise("new")
    ).drop("last_risk")


def reobserve(alerts: DataFrame, cycle: DataFrame, as_of: datetime) -> DataFrame:
    """The alert table with counter and last-seen time of re-observed alerts brought up to date."""
    hits = cycle.where(F.col("outcome") == "reobserved").select(F.col("last_alert_id").alias("alert_id"), F.lit(True).alias("_hit"))
    joined = alerts.join(hits, "alert_id", "left")
    return joined.withColumns(
        {
            "reobservation_count": F.coalesce("reobservation_count", F.lit(0)) + F.when(F.col("_hit"), 1).otherwise(0),
            "last_reobserved_at": F.when(F.col("_hit"), at(as_of)).otherwise(F.col("last_reobserved_at")),
        }
    ).select(alerts.columns)


def build_alerts(cycle: DataFrame, population: DataFrame, as_of: datetime) -> DataFrame:
    """Alert rows for the new outcomes. The budget counts all flagged machines, the cap only new alerts."""
    flagged = cycle.agg(F.count("*")).scalar()
    fresh = cycle.where(F.col("outcome") == "new").withColumn("tier", fx.alert_tier(F.col("risk_score")))
    capped = fairness_cap(fresh, population, flagged)
    advice = fx.alert_advice(F.col("risk_score"))
    text = F.when(F.col("capped"), F.concat(F.lit(CAPPED_PREFIX), advice)).otherwise(advice)
    return capped.select(
        F.concat_ws("-", F.lit("ALT"), "atm_id", F.lit(as_of.strftime("%Y%m%d%H%M%S"))).alias("alert_id"),
        at(as_of).alias("created_at"), "atm_id", "bank_name", "city", "district", "state", "police_station_area",
        fx.rounded(F.col("risk_score")).alias("risk_score"), F.col("effective_tier").alias("tier"),
        F.lit("new").alias("status"), text.alias("recommended_action"),
        # No earlier alert in the cooldown means no rise to report.
        F.when(F.col("last_alert_id").isNotNull(), F.col("risk_delta_vs_last")).alias("risk_delta_vs_last"),
    )


def alert_cycle_summary(scores: DataFrame, cycle: DataFrame) -> DataFrame:
    checked = scores.agg(F.count("*")).scalar()
    return cycle.agg(
        checked.alias("checked"), F.count("*").alias("flagged"), F.count_if(F.col("outcome") == "new").alias("created"),
        F.count_if(F.col("outcome") == "reobserved").alias("reobserved"),
    )


def escalate_stale(alerts: DataFrame, as_of: datetime, timeout_minutes: int = 120) -> DataFrame:
    """Alerts without human action for too long become escalated, with the reason recorded."""
    stale = F.col("status").isin("new", "acknowledged") & (F.col("created_at") < at(as_of - timedelta(minutes=timeout_minutes)))
    reason = f"Auto-escalated after {timeout_minutes} min without acknowledgement"
    return alerts.withColumn("decision_reason", F.when(stale, reason).otherwise(F.col("decision_reason"))).withColumn(
        "status", F.when(stale, "escalated").otherwise(F.col("status"))
    )


def valid_decisions(decisions: DataFrame) -> DataFrame:
    """Decisions with a permitted status and, where one is needed, a reason."""
    reasoned = ~F.col("status").isin(REASON_REQUIRED) | (F.trim(F.coalesce("reason", F.lit(""))) != "")
    return decisions.where(F.col("status").isin(DECISION_STATUS) & reasoned)


def apply_decisions(alerts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply (alert_id, decided_at, status, reason): latest valid one wins, the first acknowledgement time stays."""
    valid = valid_decisions(decisions)
    when = lambda status, pick: pick(F.when(F.col("status") == status, F.col("decided_at")))
    text = F.coalesce(F.col("reason"), F.lit(""))
    per_alert = valid.groupBy("alert_id").agg(
        F.max_by("status", F.struct("decided_at", "status")).alias("_status"),
        # An empty reason leaves the earlier one in place.
        F.max_by(F.when(text != "", text), F.when(text != "", F.struct("decided_at", "status"))).alias("_reason"),
        when("acknowledged", F.min).alias("_ack"), when("actioned", F.max).alias("_act"),
    )
    joined = alerts.join(per_alert, "alert_id", "left")
    return joined.withColumns(
        {
            "status": F.coalesce("_status", "status"), "decision_reason": F.coalesce("_reason", "decision_reason"),
            "acknowledged_at": F.coalesce("acknowledged_at", "_ack"), "actioned_at": F.coalesce("_act", "actioned_at"),
        }
    ).select(alerts.columns)


def origin_state(atms: DataFrame, withdrawals: DataFrame, complaints: DataFrame, as_of: datetime, days: int = 45) -> DataFrame:
    """(atm_id, origin_state): where the complaints behind a machine's risk were filed.

    The most frequent other state among complaints naming accounts that withdrew at the machine wins; else the most
    frequent state of complaints in its district, state or city, in that order; else ''.
    """
    cutoff = as_of.replace(hour=0, minute=0, second=0, microsecond=0) - timedelta(days=days)
    filed = complaints.where(F.col("filing_timestamp") >= at(cutoff))
    drawn = withdrawals.where(F.col("timestamp") >= at(cutoff))
    place = atms.select("atm_id", "city", "district", "state")
    linked = link_atm_accounts_complaints(drawn, filed).join(place.select("atm_id", "state"), "atm_id")
    others = linked.where(F.col("victim_state") != F.col("state"))
    best = F.min_by("victim_state", F.struct(-F.col("n"), F.col("victim_state"))).alias("cross_state")
    cross = others.groupBy("atm_id").agg(best)

    out = place.join(cross, "atm_id", "left")
    for level in ("district", "state", "city"):
        mode = agg.modal_value(filed, [f"victim_{level}"], "victim_state") if level != "state" else filed.select(
            "victim_state"
        ).distinct()
        if level == "state":
            mode = mode.select(F.col("victim_state").alias("state"), F.col("victim_state").alias("_by_state"))
        else:
            mode = mode.select(F.col(f"victim_{level}").alias(level), F.col("victim_state").alias(f"_by_{level}"))
        out = out.join(mode, level, "left")
    return out.select("atm_id", F.coalesce("cross_state", "_by_district", "_by_state", "_by_city", F.lit("")).alias("origin_state"))


def route_alerts(alerts: DataFrame, origins: DataFrame, handoffs: DataFrame, as_of: datetime) -> DataFrame:
    """New hand-offs: alerts whose origin lies in another state and that have none yet."""
    crossing = alerts.join(origins, "atm_id").where((F.col("origin_state") != "") & (F.col("origin_state") != F.col("state")))
    return crossing.join(handoffs.select("alert_id"), "alert_id", "left_anti").select(
        F.concat_ws("-", F.lit("HO"), "alert_id").alias("handoff_id"), "alert_id", "atm_id", "origin_state",
        F.col("state").alias("receiving_state"), F.lit("queued").alias("status"),
        F.lit("cross-state origin").alias("reason"), at(as_of).alias("created_at"),
    )


def ack_handoffs(handoffs: DataFrame, acks: DataFrame) -> DataFrame:
    """Apply (handoff_id, actor, acked_at, complete)."""
    marks = acks.groupBy("handoff_id").agg(F.max_by(F.struct("actor", "acked_at", "complete"), "acked_at").alias("_a"))
    joined = handoffs.join(marks, "handoff_id", "left")
    status = F.when(F.col("_a").isNull(), F.col("status")).when(F.col("_a.complete"), "complete").otherwise("ack")
    return joined.select(
        *[c for c in handoffs.columns if c not in ("status", "ack_by", "ack_at")], status.alias("status"),
        F.col("_a.actor").alias("ack_by"), F.col("_a.acked_at").alias("ack_at"),
    )


def mirror_routing(alerts: DataFrame, handoffs: DataFrame) -> DataFrame:
    """Alerts with the routing status of their newest hand-off; those without one keep theirs, or none."""
    mirrored = F.when(F.col("status") == "complete", "handoff_complete").when(F.col("status") == "ack", "handoff_ack").otherwise("handoff")
    newest = F.struct("created_at", "handoff_id") if "created_at" in handoffs.columns else F.col("handoff_id")
    marks = handoffs.groupBy("alert_id").agg(F.max_by(mirrored, newest).alias("_mirrored"))
    own = F.col("routing_status") if "routing_status" in alerts.columns else F.lit(None)
    joined = alerts.join(marks, "alert_id", "left").withColumn("routing_status", F.coalesce("_mirrored", own, F.lit("none")))
    return joined.drop("_mirrored")


def fund_block(alerts: DataFrame, withdrawals: DataFrame, complaints: DataFrame, accounts: DataFrame, as_of: datetime,
               linked_ids: int | None, hours: int | None = 24, top: int = 3) -> DataFrame:
    """Recommendations to hold funds: the most active complaint-named accounts at each alerted machine, with their newest complaints."""
    active = agg.account_activity_at_atm(withdrawals, complaints, as_of, hours, top).drop("rank")
    ids = complaint_ids_for_account(complaints, linked_ids).select(
        F.col("linked_account_token").alias("account_token"), F.col("complaint_ids").alias("linked_complaint_ids")
    )
    banks = accounts.select("account_token", "home_bank")
    joined = alerts.select("alert_id", "atm_id", "bank_name", "risk_score").join(active, "atm_id").join(ids, "account_token", "left")
    return joined.join(banks, "account_token", "left").select(
        F.concat_ws("-", F.lit("REC"), "alert_id", "account_token").alias("rec_id"), at(as_of).alias("created_at"), "alert_id",
        "account_token", F.coalesce("home_bank", "bank_name").alias("home_bank"), "linked_complaint_ids", "amount_at_risk",
        F.col("atm_id").alias("suspected_atm"),
        F.when(F.col("risk_score") >= fx.CRITICAL, "freeze").otherwise("hold").alias("recommended_action"),
        F.lit("freeze_requested").alias("status"),
    )


def update_recovery(recovery: DataFrame, events: DataFrame) -> DataFrame:
    """Apply (rec_id, at, status, amount_held, amount_recovered): latest status, latest non-zero amounts."""
    nonzero = lambda c: F.max_by(F.when(F.col(c) != 0, F.col(c)), F.when(F.col(c) != 0, F.col("at"))).alias(f"_{c}")
    latest = events.groupBy("rec_id").agg(F.max_by("status", "at").alias("_status"), nonzero("amount_held"), nonzero("amount_recovered"))
    joined = recovery.join(latest, "rec_id", "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in ("status", "amount_held", "amount_recovered")}).select(recovery.columns)


def evaluate_outcomes(alerts: DataFrame, outcomes: DataFrame, withdrawals: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    """Outcome rows for alerts past their horizon: did fraud follow within [created, created + 24 h]?

    The next fraud at the machine answers it, so an alert meets one time, not all of its withdrawals.
    """
    due = pending_alerts(alerts, outcomes, as_of, hours)
    fraud = withdrawals.where("is_fraud_withdrawal").select("atm_id", "timestamp")
    seen = asof_forward(due, fraud, ["atm_id"], "created_at", "timestamp", "_next")
    hit = F.coalesce(fx.hours_between(F.col("created_at"), F.col("_next")) <= hours, F.lit(False))
    risk = F.col("risk_score")
    return seen.select(
        "alert_id", "atm_id", risk.alias("predicted_risk"), F.when(hit, "yes").otherwise("no").alias("actual_fraud_happened"),
        fx.rounded(F.abs(hit.cast("double") - risk)).alias("prediction_error"),
        (~hit & (risk >= 0.5)).alias("is_false_positive"), (hit & (risk < 0.5)).alias("is_false_negative"),
        at(as_of).alias("evaluated_at"),
    )


def outcome_monitor(outcomes: DataFrame) -> DataFrame:
    """One row: confusion counts, mean error and calibration error of the decided outcomes."""
    decided = outcomes.where(F.col("actual_fraud_happened").isin("yes", "no"))
    yes, high = F.col("actual_fraud_happened") == "yes", F.col("predicted_risk") >= 0.5
    rows = decided.select(F.col("predicted_risk").alias("score"), yes.cast("int").alias("label"))
    ece = ece10(rows, "half_open", 2).scalar()
    return decided.agg(
        F.count("*").alias("evaluated"), F.count_if(yes & high).alias("true_positives"), F.count_if("is_false_positive").alias("false_positives"),
        F.count_if(~yes & ~high).alias("true_negatives"), F.count_if("is_false_negative").alias("false_negatives"),
        fx.rounded(F.avg("prediction_error")).alias("mean_abs_error"),
    ).withColumn("outcome_ece_10_bins", fx.rounded(ece))


#: How far from a machine a complaint still counts as near it.
ALERT_KM = 2.0


def recent_complaints(complaints: DataFrame, as_of: datetime, hours: int) -> DataFrame:
    return complaints.where((F.col("filing_timestamp") >= at(as_of - timedelta(hours=hours))) & (F.col("filing_timestamp") <= at(as_of)))


def alerted_machines(alerts: DataFrame, atms: DataFrame) -> DataFrame:
    return atms.join(alerts.select("atm_id"), "atm_id", "left_semi").select("atm_id", "latitude", "longitude")


def complaints_near_atms(alerts: DataFrame, atms: DataFrame, complaints: DataFrame, as_of: datetime, hours: int, km: float = ALERT_KM) -> DataFrame:
    """(atm_id, complaint columns): complaints of the last hours within ``km`` of alerted machines."""
    return near(
        alerted_machines(alerts, atms), recent_complaints(complaints, as_of, hours), km, "latitude", "longitude", "victim_lat", "victim_lon"
    )


def evidence(alerts: DataFrame, atms: DataFrame, complaints: DataFrame, withdrawals: DataFrame, as_of: datetime,
             complaint_hours: int = 6, withdrawal_hours: int = 3) -> DataFrame:
    """Per alert: complaint, withdrawal and context sentences and the accounts to look at first."""
    kinds = complaints_near_atms(alerts, atms, complaints, as_of, complaint_hours).groupBy("atm_id", "complaint_type").agg(F.count("*").alias("n"))
    # As many entries as there are kinds.
    detail = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("complaint_type", "n"))), lambda s: F.concat_ws(" ", s["complaint_type"], s["n"].cast("string"))), ", "
    )
    filed = kinds.groupBy("atm_id").agg(F.sum("n").alias("n_complaints"), detail.alias("detail"))
    recent = withdrawals.where((F.col("timestamp") >= at(as_of - timedelta(hours=withdrawal_hours))) & (F.col("timestamp") <= at(as_of)))
    drawn = recent.groupBy("atm_id").agg(F.count("*").alias("n_withdrawals"), F.countDistinct("account_token").alias("n_accounts"))
    # At most three accounts per machine.
    freeze = agg.account_activity_at_atm(withdrawals, complaints, as_of, 24, 3).groupBy("atm_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "account_token"))), lambda s: s["account_token"]).alias("freeze_accounts")
    )
    joined = alerts.select("alert_id", "atm_id", "risk_score").join(filed, "atm_id", "left").join(drawn, "atm_id", "left").join(freeze, "atm_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    night = as_of.hour in fx.NIGHT_HOURS
    clause = (
        "Forecast time is in the night window (19:00–05:00)." if night
        else "Forecast time is outside the night window; no night weighting applies."
    )
    return joined.select(
        "alert_id", "atm_id", "risk_score",
        F.concat(
            n("n_complaints"), F.lit(f" complaint(s) in the last {complaint_hours}h within 2km of this ATM ("), F.coalesce("detail", F.lit("none")), F.lit(").")
        ).alias("complaint_activity"),
        F.concat(
            n("n_withdrawals"), F.lit(" withdrawal(s) from "), n("n_accounts"), F.lit(f" distinct account(s) at this ATM in the last {withdrawal_hours}h.")
        ).alias("withdrawal_activity"),
        F.lit(clause).alias("context_signal"), F.lit(night).alias("is_night"),
        F.coalesce("freeze_accounts", F.array().cast("array<string>")).alias("freeze_accounts"),
        F.coalesce("n_complaints", F.lit(0)).alias("n_complaints"),
    )


def evidence_signals(rows: DataFrame) -> DataFrame:
    """Six (signal, value, direction) rows per alert from its feature row and complaint count."""
    f = lambda c: F.col(c).cast("double")
    text = lambda pattern, *cols: F.format_string(pattern, *cols)
    up = lambda condition: F.when(condition, "up").otherwise("flat")
    signal = lambda name, value, direction: F.struct(F.lit(name).alias("signal"), value.alias("value"), direction.alias("direction"))
    signals = F.array(
        signal("Recent complaint surge", text("%d complaint(s)", F.col("n_complaints")), up(F.col("n_complaints") > 0)),
        signal(
            "Transaction velocity increase",
            text("withdrawals_6h=%.1f, withdrawals_24h=%.1f", f("withdrawals_6h"), f("withdrawals_24h")),
            up(f("withdrawals_6h") > f("withdrawals_24h") / 6.0),
        ),
        signal(
            "Mule-account concentration",
            text("counterparty_count_24h=%.1f, linked_share=%.2f", f("counterparty_count_24h"), fx.rounded(f("linked_proportion_24h"), 2)),
            up(f("linked_proportion_24h") >= 0.4),
        ),
        signal(
            "Geographic proximity", text("dist_to_complaint_centroid_km=%.1f", fx.rounded(f("dist_to_complaint_centroid_km"), 1)),
            F.when(f("dist_to_complaint_centroid_km") <= 10, "near").otherwise("far"),
        ),
        signal(
            "Temporal similarity (Hawkes intensity)", text("hawkes_intensity_24h=%.3f", fx.rounded(f("hawkes_intensity_24h"), 3)),
            up(f("hawkes_intensity_24h") > 15),
        ),
        signal(
            "Forecast risk", text("%.2f (threshold >= 0.70)", fx.rounded(f("risk_score"), 2)),
            F.when(f("risk_score") >= fx.HIGH, "flagged").otherwise("not-flagged"),
        ),
    )
    return rows.select("alert_id", F.inline(signals))


def nearby(scores: DataFrame, lat: float, lon: float, max_km: float, limit: int) -> DataFrame:
    """The best machines around a point by 0.6 risk + 0.4 / (1 + km). One pass, then a top-k."""
    km = fx.haversine_km(F.lit(lat), F.lit(lon), F.col("latitude"), F.col("longitude"))
    rated = scores.withColumn("_km", km).where(F.col("_km") <= max_km).withColumn(
        "mobile_score", fx.rounded(0.6 * F.greatest(F.col("risk_score"), F.lit(0.0)) + 0.4 / (1 + F.col("_km")))
    )
    return rated.withColumn("distance_km", fx.rounded(F.col("_km"), 2)).withColumn("risk_level", fx.risk_level(F.col("risk_score"))).drop("_km").orderBy(
        F.col("mobile_score").desc(), "atm_id"
    ).limit(limit)


def score_summary_by_level(scores: DataFrame) -> DataFrame:
    return scores.groupBy(fx.risk_level(F.col("risk_score")).alias("risk_level")).agg(F.count("*").alias("n"))
