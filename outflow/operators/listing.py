"""Filtered, scoped, ordered and paged listings. Order plus limit is the feature here, so the plan is a top-k."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outflow.operators.scope import apply_scope, at_visible_atms, scope_handoffs
from outflow.schemas import ADMIN, BANK


def at(moment: datetime) -> Column:
    return F.lit(moment).cast("timestamp_ntz")


def page(df: DataFrame, order: list[Column], limit: int | None, offset: int = 0) -> DataFrame:
    ordered = df.orderBy(*order)
    if offset:
        ordered = ordered.offset(offset)
    return ordered.limit(limit) if limit is not None else ordered


def equal_to(df: DataFrame, **values: object) -> DataFrame:
    for column, value in values.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def between(df: DataFrame, column: str, from_: datetime | None, to: datetime | None) -> DataFrame:
    if from_ is not None:
        df = df.where(F.col(column) >= at(from_))
    if to is not None:
        df = df.where(F.col(column) <= at(to))
    return df


def list_complaints(
    df: DataFrame, city: str | None = None, district: str | None = None, state: str | None = None,
    type: str | None = None, status: str | None = None, from_: datetime | None = None, to: datetime | None = None,
    limit: int | None = None, offset: int = 0, role: str = ADMIN, scope: str = "",
) -> DataFrame:
    rows = equal_to(
        df, victim_city=city, victim_district=district, victim_state=state, complaint_type=type, status=status
    )
    rows = apply_scope(between(rows, "filing_timestamp", from_, to), "complaints", role, scope)
    return page(rows, [F.col("filing_timestamp").desc(), F.col("complaint_id")], limit, offset)


def list_atms(
    df: DataFrame, city: str | None = None, bank: str | None = None, limit: int | None = None, offset: int = 0,
    role: str = ADMIN, scope: str = "",
) -> DataFrame:
    rows = apply_scope(equal_to(df, city=city, bank_name=bank), "atms", role, scope)
    return page(rows, [F.col("atm_id")], limit, offset)


def list_withdrawals(
    df: DataFrame, atms: DataFrame, atm_id: str | None = None, account: str | None = None, fraud: bool | None = None,
    from_: datetime | None = None, to: datetime | None = None, limit: int | None = None, offset: int = 0,
    role: str = ADMIN, scope: str = "",
) -> DataFrame:
    rows = equal_to(df, atm_id=atm_id, account_token=account, is_fraud_withdrawal=fraud)
    rows = between(rows, "timestamp", from_, to)
    if role == BANK:
        rows = at_visible_atms(rows, atms, role, scope)
    return page(rows, [F.col("timestamp").desc(), F.col("transaction_id")], limit, offset)


def recent_withdrawals(df: DataFrame, atm_id: str, since: datetime, limit: int | None = None) -> DataFrame:
    rows = between(equal_to(df, atm_id=atm_id), "timestamp", since, None)
    return page(rows, [F.col("timestamp").desc(), F.col("transaction_id")], limit)


def list_alerts(
    df: DataFrame, status: str | None = None, atm_id: str | None = None, city: str | None = None,
    limit: int | None = None, offset: int = 0, role: str = ADMIN, scope: str = "",
) -> DataFrame:
    rows = apply_scope(equal_to(df, status=status, atm_id=atm_id, city=city), "alerts", role, scope)
    return page(rows, [F.col("created_at").desc(), F.col("alert_id")], limit, offset)


def get_alert(df: DataFrame, alert_id: str, role: str = ADMIN, scope: str = "") -> DataFrame:
    return apply_scope(equal_to(df, alert_id=alert_id), "alerts", role, scope)


def get_atm(df: DataFrame, atm_id: str, role: str = ADMIN, scope: str = "") -> DataFrame:
    return apply_scope(equal_to(df, atm_id=atm_id), "atms", role, scope)


def list_accounts(df: DataFrame, limit: int | None = None, role: str = ADMIN, scope: str = "") -> DataFrame:
    return page(apply_scope(df, "accounts", role, scope), [F.col("account_token")], limit)


def accounts_in_scope(df: DataFrame, role: str = ADMIN, scope: str = "") -> DataFrame:
    return apply_scope(df, "accounts", role, scope).select("account_token").distinct()


def list_handoffs(df: DataFrame, status: str | None, role: str, scope: str, limit: int | None = None) -> DataFrame:
    rows = scope_handoffs(equal_to(df, status=status), role, scope)
    return page(rows, [F.col("created_at").desc(), F.col("handoff_id")], limit)


def list_recovery(df: DataFrame, since: datetime | None = None, bank: str | None = None, limit: int | None = None) -> DataFrame:
    rows = between(equal_to(df, home_bank=bank), "created_at", since, None)
    return page(rows, [F.col("created_at").desc(), F.col("rec_id")], limit)


def list_outcomes(df: DataFrame, limit: int | None = None) -> DataFrame:
    return page(df, [F.col("evaluated_at").desc(), F.col("alert_id")], limit)


def complaint_ids_for_account(complaints: DataFrame, per_account: int | None) -> DataFrame:
    """The newest ``per_account`` complaint ids of every named account, or all; a limit is applied before the shuffle."""
    newest = Window.partitionBy("linked_account_token").orderBy(F.col("filing_timestamp").desc(), "complaint_id")
    kept = (
        complaints.where(F.col("linked_account_token").isNotNull())
        .select("linked_account_token", "filing_timestamp", "complaint_id")
        .withColumn("n", F.row_number().over(newest))
    )
    if per_account is not None:
        kept = kept.where(F.col("n") <= per_account)
    listed = F.array_sort(F.collect_list(F.struct("n", "complaint_id")))
    return kept.groupBy("linked_account_token").agg(
        F.transform(listed, lambda s: s["complaint_id"]).alias("complaint_ids")
    )


def distinct_banks(atms: DataFrame) -> DataFrame:
    return atms.select("bank_name").distinct().orderBy("bank_name")


def named_accounts(complaints: DataFrame) -> DataFrame:
    """Distinct accounts named in complaints."""
    return complaints.where(F.col("linked_account_token").isNotNull()).select(
        F.col("linked_account_token").alias("account_token")
    ).distinct()


distinct_mule_tokens = named_accounts


def cities_for_category(complaints: DataFrame, type: str, since: datetime | None = None) -> DataFrame:
    rows = between(equal_to(complaints, complaint_type=type), "filing_timestamp", since, None)
    return rows.select("victim_city").distinct()


def hotspots(
    scores: DataFrame, k: int, city: str | None = None, complaints: DataFrame | None = None,
    category: str | None = None, as_of: datetime | None = None, window_days: int = 7,
) -> DataFrame:
    """The k riskiest machines, optionally of one city or of the cities with recent complaints of one kind."""
    rows = equal_to(scores, city=city)
    if category is not None:
        since = as_of - timedelta(days=window_days) if as_of else None
        cities = cities_for_category(complaints, category, since).select(F.col("victim_city").alias("city"))
        rows = rows.join(cities, "city", "left_semi")
    return page(rows, [F.col("risk_score").desc(), F.col("atm_id")], k)
