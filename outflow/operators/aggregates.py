"""Counts, roll-ups, distributions and concentration measures.

Everything here combines on the map side first. Per-key top lists are limited before their shuffle, and
rank-based measures work on distinct values, so a hot key or a hot value costs no more than a cold one.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outflow.functions import scalar as fx
from outflow.functions.ordering import exact_quantiles, running_totals, value_ranks
from outflow.functions.quantiles import exact_cuts
from outflow.operators.listing import at, named_accounts, page
from outflow.operators.scope import apply_scope, at_visible_atms
from outflow.schemas import ADMIN, BANK


def exact_sum(amount: Column | str) -> Column:
    """Sum of two-decimal amounts in whole cents: exact whatever the order of addition."""
    column = F.col(amount) if isinstance(amount, str) else amount
    return F.coalesce(F.sum(F.round(column * 100).cast("bigint")), F.lit(0)) / 100.0


def since_filter(df: DataFrame, column: str, since: datetime | None) -> DataFrame:
    return df if since is None else df.where(F.col(column) >= at(since))


def complaints_by_city(df: DataFrame, since: datetime | None = None) -> DataFrame:
    return since_filter(df, "filing_timestamp", since).groupBy("victim_city").agg(F.count("*").alias("n"))


def complaints_by_type(df: DataFrame, city: str | None = None, since: datetime | None = None) -> DataFrame:
    rows = since_filter(df, "filing_timestamp", since)
    if city is not None:
        rows = rows.where(F.col("victim_city") == city)
    return rows.groupBy("complaint_type").agg(F.count("*").alias("n"))


def complaints_by_city_type(df: DataFrame, since: datetime | None = None) -> DataFrame:
    """One row per city with a map from kind to count; the map has as many entries as there are kinds."""
    counts = since_filter(df, "filing_timestamp", since).groupBy("victim_city", "complaint_type").agg(
        F.count("*").alias("n")
    )
    entries = F.array_sort(F.collect_list(F.struct("complaint_type", "n")))
    return counts.groupBy("victim_city").agg(F.map_from_entries(entries).alias("by_type"))


def complaint_drilldown(df: DataFrame, since: datetime | None = None) -> DataFrame:
    """Totals by city, by kind and by both, from one scan."""
    rows = since_filter(df, "filing_timestamp", since)
    level = F.expr("case grouping_id() when 0 then 'city_type' when 1 then 'city' else 'type' end")
    return rows.groupingSets(
        [[F.col("victim_city")], [F.col("complaint_type")], [F.col("victim_city"), F.col("complaint_type")]],
        "victim_city", "complaint_type",
    ).agg(level.alias("level"), F.count("*").alias("n"))


def count_since(df: DataFrame, ts_col: str, since: datetime | None, **conditions: Column) -> DataFrame:
    """One row of conditional counts since a time."""
    aggregates = [F.count("*").alias("n")] + [F.count_if(c).alias(name) for name, c in conditions.items()]
    return since_filter(df, ts_col, since).agg(*aggregates)


def atm_population_by_state(atms: DataFrame) -> DataFrame:
    return atms.groupBy("state").agg(F.count("*").alias("n"))


def high_risk_atm_count(alerts: DataFrame, threshold: float = fx.HIGH) -> DataFrame:
    return alerts.where(F.col("risk_score") >= threshold).agg(F.countDistinct("atm_id").alias("n"))


def high_risk_by_district(alerts: DataFrame, threshold: float = fx.HIGH) -> DataFrame:
    return alerts.where(F.col("risk_score") >= threshold).groupBy("district").agg(F.count("*").alias("n"))


# Bucket expressions of the activity report.
BUCKETS = {
    "hour": lambda ts: F.date_format(ts, "yyyy-MM-dd HH:00"),
    "6h": fx.day_part,
    "day": lambda ts: F.date_format(ts, "yyyy-MM-dd"),
}


def activity_by_bucket(
    withdrawals: DataFrame, complaints: DataFrame, window: str, as_of: datetime, hours: int | None = None,
    atm_id: str | None = None,
) -> DataFrame:
    """Withdrawals, fraud, amounts and complaints per hour, day part or day; buckets need a withdrawal."""
    since = as_of - timedelta(hours=hours) if hours else None
    rows = since_filter(withdrawals, "timestamp", since)
    if atm_id is not None:
        rows = rows.where(F.col("atm_id") == atm_id)
    fraud = F.col("is_fraud_withdrawal")
    activity = rows.groupBy(BUCKETS[window](F.col("timestamp")).alias("bucket")).agg(
        F.count("*").alias("withdrawals"),
        F.count_if(fraud).alias("fraud_withdrawals"),
        exact_sum("amount").alias("amount_total"),
        exact_sum(F.when(fraud, F.col("amount"))).alias("amount_fraud"),
    )
    filed = since_filter(complaints, "filing_timestamp", since).groupBy(
        BUCKETS[window](F.col("filing_timestamp")).alias("bucket")
    ).agg(F.count("*").alias("complaints"))
    return activity.join(filed, "bucket", "left").select(
        "bucket", "withdrawals", "fraud_withdrawals", F.coalesce("complaints", F.lit(0)).alias("complaints"),
        "amount_total", "amount_fraud",
        F.round(F.col("fraud_withdrawals") / F.col("withdrawals"), 4).alias("fraud_rate"),
    )


def high_risk_days(
    withdrawals: DataFrame, complaints: DataFrame, atms: DataFrame, limit: int = 5, role: str = ADMIN, scope: str = ""
) -> DataFrame:
    """The days with most fraud, each with the reference time under which the forecast covers it."""
    fraud = F.col("is_fraud_withdrawal")
    per_day = at_visible_atms(withdrawals, atms, role, scope).groupBy(F.to_date("timestamp").alias("date")).agg(
        F.count_if(fraud).alias("fraud_withdrawals"),
        F.count("*").alias("total_withdrawals"),
        exact_sum(F.when(fraud, F.col("amount"))).alias("fraud_amount_inr"),
    )
    top = page(per_day, [F.col("fraud_withdrawals").desc(), F.col("fraud_amount_inr").desc(), F.col("date")], limit)
    filed = apply_scope(complaints, "complaints", role, scope) if role != BANK else complaints.where(F.lit(False))
    filed = filed.groupBy(F.to_date("filing_timestamp").alias("date")).agg(F.count("*").alias("complaints_filed"))
    return top.join(filed, "date", "left").select(
        "date",
        (F.col("date").cast("timestamp_ntz") - F.expr("interval 1 second")).alias("as_of"),
        "fraud_withdrawals", "total_withdrawals", "fraud_amount_inr",
        F.coalesce("complaints_filed", F.lit(0)).alias("complaints_filed"),
    )


def daily_counts(df: DataFrame, key: str, ts_col: str) -> DataFrame:
    return df.groupBy(F.col(key), F.to_date(ts_col).alias("day")).agg(F.count("*").alias("n"))


def daily_type_pivot(df: DataFrame, types: Sequence[str]) -> DataFrame:
    kind = F.col("complaint_type")
    return df.groupBy("victim_city", F.to_date("filing_timestamp").alias("day")).agg(
        *[F.count_if(kind == t).alias(t) for t in types]
    )


def daily_distinct_accounts(withdrawals: DataFrame, named: DataFrame) -> DataFrame:
    """Per machine and day: distinct accounts, those named in complaints, and those named and fraudulent.

    Rows are first reduced to one per (machine, day, account), so a hot machine is spread over its accounts
    and the join with the named accounts sees each account once per machine and day.
    """
    pairs = withdrawals.groupBy("atm_id", F.to_date("timestamp").alias("day"), "account_token").agg(
        F.max("is_fraud_withdrawal").alias("fraud")
    )
    flagged = pairs.join(named.withColumn("named", F.lit(True)), "account_token", "left")
    return flagged.groupBy("atm_id", "day").agg(
        F.count("*").alias("accounts"),
        F.count_if("named").alias("linked_accounts"),
        F.count_if(F.col("named") & F.col("fraud")).alias("linked_fraud_accounts"),
    )


def daily_amount_shape(withdrawals: DataFrame) -> DataFrame:
    """Per machine and day: mean, max, round, large, heavy and fraud counts."""
    a = F.col("amount")
    return withdrawals.groupBy("atm_id", F.to_date("timestamp").alias("day")).agg(
        (exact_sum("amount") / F.count("*")).alias("amount_mean"), F.max(a).alias("amount_max"),
        F.count_if(a % 1000 == 0).alias("round_count"), F.count_if(a > 20000).alias("large_count"),
        F.count_if(a > 50000).alias("heavy_count"), F.count_if("is_fraud_withdrawal").alias("fraud_count"),
    )


def modal_value(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """The most frequent value per key; the smaller value wins a tie."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("n"))
    best = F.min_by(F.struct(F.col(column), F.col("n")), F.struct(-F.col("n"), F.col(column))).alias("best")
    return counts.groupBy(*keys).agg(best).select(*keys, F.col(f"best.{column}").alias(column), F.col("best.n").alias("n"))


def fraud_rate_by(withdrawals: DataFrame, atms: DataFrame, dim: str, before: datetime | None = None) -> DataFrame:
    """Share of fraud per value of a machine attribute, counted per machine before the join."""
    rows = withdrawals if before is None else withdrawals.where(F.col("timestamp") < at(before))
    per_atm = rows.groupBy("atm_id").agg(F.count("*").alias("n"), F.count_if("is_fraud_withdrawal").alias("f"))
    return per_atm.join(atms.select("atm_id", dim), "atm_id").groupBy(dim).agg(
        (F.sum("f") / F.sum("n")).alias("fraud_rate")
    )


def unpivoted(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(*keep, feature, value): one row per row and column."""
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns]
    return df.select(*keep, F.inline(F.array(*pairs)))


def quantiles(df: DataFrame, columns: Sequence[str], at_: Sequence[float] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """(feature, q): exact interpolated quantiles of each column."""
    rows = [(c, q or None) for c, (_, q) in exact_cuts(df, columns, at_).items()]
    return df.sparkSession.createDataFrame(rows, "feature string, q array<double>")


def score_status(scores: DataFrame, threshold: float = fx.HIGH) -> DataFrame:
    """One row describing a set of scores: size, median, nearest-rank p90, level counts, calm flag.

    The p90 is the score at the rounded (half to even) position of 0.9 (n - 1) in the ascending order, read
    from the running counts of distinct scores.
    """
    s = F.col("risk_score")
    level = fx.risk_level(s)
    row = scores.agg(
        F.count("*").alias("atms_scored"), F.max(s).alias("max_risk"),
        F.count_if(s >= threshold).alias("above_threshold"),
        *[F.count_if(level == name).alias(name.lower()) for name in ("CRITICAL", "HIGH", "MEDIUM", "LOW")],
    )
    upto = running_totals(scores.groupBy("risk_score").agg(F.count("*").alias("n")), [], [s], {"upto": "n"})
    n = scores.agg(F.count("*")).scalar()
    p90 = upto.where(F.col("upto") > F.bround(0.9 * (n - 1), 0)).agg(F.min("risk_score")).scalar()
    median = exact_quantiles(scores, [], "risk_score", [0.5]).select(F.element_at("q", 1)).scalar()
    return row.select(
        "atms_scored", fx.rounded(F.col("max_risk")).alias("max_risk"), fx.rounded(median).alias("median_risk"),
        fx.rounded(p90).alias("p90_risk"), "above_threshold",
        ((F.col("atms_scored") > 0) & (F.col("max_risk") < threshold)).alias("calm_day"),
        "critical", "high", "medium", "low",
    )


def first_event(withdrawals: DataFrame) -> DataFrame:
    """First fraud time per machine and day."""
    return withdrawals.where("is_fraud_withdrawal").groupBy("atm_id", F.to_date("timestamp").alias("day")).agg(
        F.min("timestamp").alias("first_fraud")
    )


def terciles(df: DataFrame, column: str, name: str = "tercile") -> DataFrame:
    """low / mid / high by exact third quantiles, right-closed, so equal values share a group."""
    _, cuts = exact_cuts(df, [column], [1 / 3, 2 / 3])[column]
    low, mid = cuts or (None, None)
    c = F.col(column)
    return df.withColumn(name, F.when(c <= F.lit(low), "low").when(c <= F.lit(mid), "mid").otherwise("high"))


def gini(df: DataFrame, column: str) -> DataFrame:
    """Rank-weighted concentration. Tied values are taken together at their mean rank."""
    ranked = value_ranks(df, [], column)
    x, n = F.col(column), F.col("copies")
    sums = ranked.agg(
        F.sum(F.col("mid_rank") * n * x).alias("weighted"), F.sum(n * x).alias("total"), F.sum(n).alias("rows")
    )
    value = F.when(
        F.col("total") > 0,
        2 * F.col("weighted") / (F.col("rows") * F.col("total")) - (F.col("rows") + 1) / F.col("rows"),
    ).otherwise(0.0)
    return sums.select(F.coalesce(value, F.lit(0.0)).alias("gini"))


def concentration(alerts: DataFrame) -> DataFrame:
    """One row: alerts, share of the busiest district, Gini over districts."""
    per_district = alerts.groupBy("district").agg(F.count("*").alias("alerts"))
    g = gini(per_district, "alerts").scalar()
    return per_district.agg(
        F.sum("alerts").alias("alerts_total"),
        F.round(100 * F.max("alerts") / F.sum("alerts"), 1).alias("top_district_share_pct"),
    ).withColumn("gini_concentration", F.round(g, 4))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks on ties."""
    rx = value_ranks(df, [], x).select(x, F.col("mid_rank").alias("rx"))
    ry = value_ranks(df, [], y).select(y, F.col("mid_rank").alias("ry"))
    ranked = df.groupBy(x, y).agg(F.count("*").alias("n")).join(rx, x).join(ry, y)
    n = F.col("n")
    m = ranked.agg(
        F.sum(n).alias("n"), F.sum(n * F.col("rx")).alias("sx"), F.sum(n * F.col("ry")).alias("sy"),
        F.sum(n * F.col("rx") * F.col("rx")).alias("sxx"), F.sum(n * F.col("ry") * F.col("ry")).alias("syy"),
        F.sum(n * F.col("rx") * F.col("ry")).alias("sxy"),
    )
    top = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    bottom = F.sqrt(F.col("n") * F.col("sxx") - F.col("sx") ** 2) * F.sqrt(F.col("n") * F.col("syy") - F.col("sy") ** 2)
    return m.select(F.when(bottom > 0, top / bottom).otherwise(0.0).alias("spearman"))


def hotspot_density(scores: DataFrame, threshold: float = fx.HIGH) -> DataFrame:
    return scores.groupBy("district").agg(
        F.avg((F.col("risk_score") >= threshold).cast("double")).alias("hotspot_density")
    )


def validate_external(scores: DataFrame, external: DataFrame, threshold: float = fx.HIGH) -> DataFrame:
    """Rank agreement between hotspot density and outside complaint counts, null below three shared districts."""
    density = hotspot_density(scores, threshold)
    counts = external.groupBy("district").agg(F.sum("complaint_count").alias("complaint_count"))
    both = density.join(counts, "district")
    shared = both.agg(F.count("*")).scalar()
    return spearman(both, "hotspot_density", "complaint_count").select(
        shared.alias("districts"), F.when(shared >= 3, F.col("spearman")).alias("spearman")
    )


def category_share_diff(a: DataFrame, b: DataFrame, threshold: float = 8.0) -> DataFrame:
    """Percent of each category in two (category, n) tables and whether they differ too much."""
    share = lambda df, name: df.select(
        "category", (100.0 * F.col("n") / F.greatest(df.agg(F.sum("n")).scalar(), F.lit(1))).alias(name)
    )
    joined = share(a, "pct_a").join(share(b, "pct_b"), "category", "full")
    diff = F.abs(F.coalesce("pct_a", F.lit(0.0)) - F.coalesce("pct_b", F.lit(0.0)))
    return joined.select(
        "category", F.round(F.coalesce("pct_a", F.lit(0.0)), 4).alias("pct_a"),
        F.round(F.coalesce("pct_b", F.lit(0.0)), 4).alias("pct_b"), F.round(diff, 4).alias("abs_diff"),
        F.when(diff <= threshold, "OK").otherwise("FAIL").alias("verdict"),
    )


def recovery_funnel(recovery: DataFrame, as_of: datetime, days: int | None = None) -> DataFrame:
    rows = since_filter(recovery, "created_at", as_of - timedelta(days=days) if days else None)
    sums = rows.agg(
        F.count("*").alias("recommendations"), exact_sum("amount_at_risk").alias("flagged"),
        exact_sum("amount_held").alias("held"), exact_sum("amount_recovered").alias("recovered"),
    )
    rate = F.when(F.col("flagged") > 0, F.round(100 * F.col("recovered") / F.col("flagged"), 2)).otherwise(0.0)
    return sums.withColumn("recovery_rate_pct", rate)


def linked_activity(withdrawals: DataFrame, complaints: DataFrame, as_of: datetime, hours: int | None = 24) -> DataFrame:
    """Per machine and complaint-named account: withdrawals and amount in the hours before as_of."""
    rows = withdrawals.where(F.col("timestamp") <= at(as_of))
    if hours is not None:
        rows = rows.where(F.col("timestamp") >= at(as_of - timedelta(hours=hours)))
    per_pair = rows.groupBy("atm_id", "account_token").agg(
        F.count("*").alias("recent_withdrawals"), exact_sum("amount").alias("amount_at_risk")
    )
    return per_pair.join(named_accounts(complaints), "account_token", "left_semi")


def account_activity_at_atm(
    withdrawals: DataFrame, complaints: DataFrame, as_of: datetime, hours: int | None = 24, top: int = 3
) -> DataFrame:
    """The most active complaint-named accounts of each machine."""
    busiest = Window.partitionBy("atm_id").orderBy(F.col("recent_withdrawals").desc(), "account_token")
    ranked = linked_activity(withdrawals, complaints, as_of, hours).withColumn("rank", F.row_number().over(busiest))
    return ranked.where(F.col("rank") <= top)


def account_city_spread(withdrawals: DataFrame, atms: DataFrame) -> DataFrame:
    """Distinct cities per account, from one row per (account, machine)."""
    pairs = withdrawals.select("account_token", "atm_id").distinct()
    return pairs.join(atms.select("atm_id", "city"), "atm_id").groupBy("account_token").agg(
        F.countDistinct("city").alias("cities")
    )


def first_value_per(df: DataFrame, key: str, column: str, order: Sequence[str]) -> DataFrame:
    return df.groupBy(key).agg(F.min_by(column, F.struct(*order)).alias(column))


def data_freshness(as_of: Column, data_through: Column, stale_after: float = 48.0) -> Column:
    """Struct (hours since the last data, stale flag)."""
    age = F.greatest(F.round(fx.hours_between(data_through, as_of), 1), F.lit(0.0))
    return F.struct(age.alias("data_freshness_hours"), (age > stale_after).alias("stale"))


def report_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """SHA-256 over the JSON of the columns in name order, 32 hex characters."""
    names = sorted(columns or df.columns)
    return F.substring(F.sha2(F.to_json(F.struct(*[F.col(c) for c in names])), 256), 1, 32)
