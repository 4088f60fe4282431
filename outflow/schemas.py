"""Declared schemas of the domain tables and the enumerations they use."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, B, I, L = T.StringType(), T.DoubleType(), T.BooleanType(), T.IntegerType(), T.LongType()
TS = T.TimestampNTZType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


COMPLAINTS = _struct(
    complaint_id=S, filing_timestamp=TS, complaint_type=S, victim_city=S, victim_district=S, victim_state=S,
    victim_pin=S, victim_lat=D, victim_lon=D, amount_lost=D, linked_account_token=S, linked_phone_token=S, status=S,
)
ATMS = _struct(
    atm_id=S, bank_name=S, branch_name=S, city=S, district=S, state=S, pin=S, police_station_area=S,
    latitude=D, longitude=D,
)
WITHDRAWALS = _struct(
    transaction_id=S, timestamp=TS, atm_id=S, account_token=S, amount=D, channel=S, is_fraud_withdrawal=B,
)
ACCOUNTS = _struct(
    account_token=S, home_bank=S, first_seen=TS, is_mule=B, txn_frequency_7d=D, counterparty_count_7d=I,
    fund_velocity_inr_h=D, activity_spike_flag=B,
)
TRANSFERS = _struct(transfer_id=S, timestamp=TS, from_token=S, to_token=S, amount=D)
ALERTS = _struct(
    alert_id=S, created_at=TS, atm_id=S, bank_name=S, city=S, district=S, state=S, police_station_area=S,
    risk_score=D, tier=S, status=S, recommended_action=S, decision_reason=S, origin_state=S, routing_status=S,
    acknowledged_at=TS, actioned_at=TS, reobservation_count=I, last_reobserved_at=TS, risk_delta_vs_last=D,
)
OUTCOMES = _struct(
    alert_id=S, atm_id=S, predicted_risk=D, actual_fraud_happened=S, prediction_error=D, is_false_positive=B,
    is_false_negative=B, evaluated_at=TS,
)
HANDOFFS = _struct(
    handoff_id=S, alert_id=S, atm_id=S, origin_state=S, receiving_state=S, status=S, reason=S, created_at=TS,
    ack_by=S, ack_at=TS,
)
RECOVERY = T.StructType(
    _struct(rec_id=S, created_at=TS, alert_id=S, account_token=S, home_bank=S).fields
    + [T.StructField("linked_complaint_ids", T.ArrayType(S), True)]
    + _struct(amount_at_risk=D, suspected_atm=S, recommended_action=S, status=S, amount_held=D, amount_recovered=D).fields
)
AUDIT_LOG = _struct(
    index=L, created_at=TS, actor=S, event_type=S, entity_id=S, payload_hash=S, prev_hash=S, hash=S,
)
BLOCKS = _struct(
    block_index=L, timestamp=D, data=S, previous_hash=S, nonce=L, hash=S, record_type=S, created_by=S,
)

# The kinds of complaint, and the four that have their own feature columns.
COMPLAINT_TYPES = ["phishing", "investment_fraud", "job_fraud", "upi_fraud", "digital_arrest", "sextortion"]
FEATURE_TYPES = ["phishing", "investment_fraud", "job_fraud", "upi_fraud"]

# Complaint status.
COMPLAINT_STATUS = ["under_investigation", "funds_frozen", "funds_partially_recovered"]

# Statuses a reviewer may set on an alert, and those that need a reason.
DECISION_STATUS = ["acknowledged", "actioned", "dismissed", "escalated", "monitoring", "review_requested"]
REASON_REQUIRED = ["dismissed", "escalated"]

# Roles of the row-scoping matrix.
ADMIN, BANK, DISTRICT, STATE = "I4C_ADMIN", "BANK", "POLICE_DISTRICT", "POLICE_STATE"
