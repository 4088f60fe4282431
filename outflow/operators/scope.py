"""Row scoping by role: which rows of each table a user may see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outflow.schemas import ADMIN, BANK, DISTRICT, STATE

# The scoping column per table and role; None means no row is visible.
SCOPE_COLUMNS: dict[str, dict[str, str | None]] = {
    "alerts": {BANK: "bank_name", DISTRICT: "district", STATE: "state"},
    "atms": {BANK: "bank_name", DISTRICT: "district", STATE: "state"},
    "complaints": {BANK: None, DISTRICT: "victim_district", STATE: "victim_state"},
    "accounts": {BANK: "home_bank"},
}


def scope_predicate(entity: str, role: str, scope: str) -> Column:
    if role == ADMIN:
        return F.lit(True)
    columns = SCOPE_COLUMNS[entity]
    if role not in columns:
        return F.lit(True)
    column = columns[role]
    return F.lit(False) if column is None else F.col(column) == scope


def apply_scope(df: DataFrame, entity: str, role: str = ADMIN, scope: str = "") -> DataFrame:
    return df.where(scope_predicate(entity, role, scope))


def at_visible_atms(df: DataFrame, atms: DataFrame, role: str, scope: str) -> DataFrame:
    """Keep rows whose machine is in scope: used for scores, alert rows and withdrawals alike."""
    if role == ADMIN:
        return df
    return df.join(apply_scope(atms, "atms", role, scope).select("atm_id"), "atm_id", "left_semi")


scope_scores = at_visible_atms
scope_alert_rows = at_visible_atms


def scope_handoffs(handoffs: DataFrame, role: str, scope: str) -> DataFrame:
    """Banks see none; police see hand-offs whose origin or receiving state contains their scope."""
    if role == BANK:
        return handoffs.where(F.lit(False))
    if role == ADMIN:
        return handoffs
    holds = lambda c: F.lower(c).contains(scope.lower())
    return handoffs.where(holds("origin_state") | holds("receiving_state"))


def scope_reports(reports: DataFrame, role: str, scope: str) -> DataFrame:
    """Reports with a JSON payload: national ones for the administrator, hot-spot ones by place or bank."""
    if role == ADMIN:
        return reports
    field = {BANK: "$.jurisdiction.bank_name", DISTRICT: "$.jurisdiction.district", STATE: "$.jurisdiction.state"}[role]
    return reports.where((F.col("report_type") == "hotspot") & (F.get_json_object("payload", field) == scope))
