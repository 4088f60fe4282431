"""Aggregations."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outflow.catalog.registry import day, money, query, r6, ts
from outflow.operators import aggregates as agg
from outflow.schemas import STATE
from outflow.sources.views import Tables

AS_OF = datetime(2024, 1, 29)
SINCE = datetime(2024, 1, 14)
SINCE_SQL = "TIMESTAMP '2024-01-14'"
ORDERS_AS_OF = datetime(2001, 6, 1)


@query("d01_complaints_by_city", f"""
    SELECT victim_city, count(*) AS n FROM complaints WHERE filing_timestamp >= {SINCE_SQL} GROUP BY 1""", ("complaints",))
def _(t: Tables) -> DataFrame:
    return agg.complaints_by_city(t.complaints, SINCE)


@query("d02_complaints_by_type", """
    SELECT complaint_type, count(*) AS n FROM order_complaints WHERE victim_city = 'NATION_7' GROUP BY 1""",
    ("order_complaints",))
def _(t: Tables) -> DataFrame:
    return agg.complaints_by_type(t.order_complaints, city="NATION_7")


@query("d03_complaints_by_city_type", """
    SELECT victim_city, string_agg(complaint_type || '=' || n, ',' ORDER BY complaint_type) AS by_type
    FROM (SELECT victim_city, complaint_type, count(*) AS n FROM order_complaints GROUP BY 1, 2) GROUP BY 1""",
    ("order_complaints",))
def _(t: Tables) -> DataFrame:
    nested = agg.complaints_by_city_type(t.order_complaints)
    text = F.transform(F.map_entries("by_type"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return nested.select("victim_city", F.array_join(F.array_sort(text), ",").alias("by_type"))


@query("d04_complaint_drilldown", """
    SELECT victim_city, complaint_type, CASE WHEN grouping(victim_city) = 1 THEN 'type'
           WHEN grouping(complaint_type) = 1 THEN 'city' ELSE 'city_type' END AS level, count(*) AS n
    FROM order_complaints GROUP BY GROUPING SETS ((victim_city), (complaint_type), (victim_city, complaint_type))""",
    ("order_complaints",))
def _(t: Tables) -> DataFrame:
    return agg.complaint_drilldown(t.order_complaints)


@query("d05_count_since", f"""
    SELECT count(*) AS n, count(*) FILTER (is_fraud_withdrawal) AS fraud, count(*) FILTER (amount > 50000) AS large
    FROM withdrawals WHERE timestamp >= {SINCE_SQL}""", ("withdrawals",))
def _(t: Tables) -> DataFrame:
    return agg.count_since(
        t.withdrawals, "timestamp", SINCE, fraud=F.col("is_fraud_withdrawal"), large=F.col("amount") > 50000
    )


@query("d05_alerts_by_status", """
    SELECT count(*) AS n, count(*) FILTER (status = 'new') AS new, count(*) FILTER (status = 'actioned') AS actioned
    FROM alerts""", ("alerts",))
def _(t: Tables) -> DataFrame:
    return agg.count_since(
        t.alerts, "created_at", None, new=F.col("status") == "new", actioned=F.col("status") == "actioned"
    )


@query("d06_atm_population_by_state", "SELECT state, count(*) AS n FROM atms GROUP BY 1", ("atms",))
def _(t: Tables) -> DataFrame:
    return agg.atm_population_by_state(t.atms)


@query("d07_high_risk_atm_count", "SELECT count(DISTINCT atm_id) AS n FROM alerts WHERE risk_score >= 0.85", ("alerts",))
def _(t: Tables) -> DataFrame:
    return agg.high_risk_atm_count(t.alerts, 0.85)


@query("d08_high_risk_by_district", """
    SELECT district, count(*) AS n FROM alerts WHERE risk_score >= 0.70 GROUP BY 1""", ("alerts",))
def _(t: Tables) -> DataFrame:
    return agg.high_risk_by_district(t.alerts)


def _activity_sql(bucket: str) -> str:
    w, c = bucket.format("timestamp"), bucket.format("filing_timestamp")
    return f"""
    SELECT w.*, coalesce(c.complaints, 0) AS complaints,
           {r6('round(fraud_withdrawals / withdrawals, 4)')} AS fraud_rate
    FROM (SELECT {w} AS bucket, count(*) AS withdrawals, count(*) FILTER (is_fraud_withdrawal) AS fraud_withdrawals,
                 {money('amount')} AS amount_total,
                 {money('CASE WHEN is_fraud_withdrawal THEN amount END')} AS amount_fraud
          FROM withdrawals GROUP BY 1) w
    LEFT JOIN (SELECT {c} AS bucket, count(*) AS complaints FROM complaints GROUP BY 1) c ON w.bucket = c.bucket"""


PART = (
    "strftime({0}, '%Y-%m-%d ') || lpad((hour({0}) // 6 * 6)::VARCHAR, 2, '0') || '-'"
    " || lpad((hour({0}) // 6 * 6 + 6)::VARCHAR, 2, '0')"
)


@query("d09_activity_by_hour", _activity_sql("strftime({0}, '%Y-%m-%d %H:00')"), ("withdrawals", "complaints"))
def _(t: Tables) -> DataFrame:
    return agg.activity_by_bucket(t.withdrawals, t.complaints, "hour", AS_OF)


@query("d09_activity_by_six_hours", _activity_sql(PART), ("withdrawals", "complaints"))
def _(t: Tables) -> DataFrame:
    return agg.activity_by_bucket(t.withdrawals, t.complaints, "6h", AS_OF)


@query("d09_activity_by_day", _activity_sql("strftime({0}, '%Y-%m-%d')"), ("withdrawals", "complaints"))
def _(t: Tables) -> DataFrame:
    return agg.activity_by_bucket(t.withdrawals, t.complaints, "day", AS_OF)


@query("d10_day_part", f"SELECT transaction_id, {PART.format('timestamp')} AS part FROM order_withdrawals", ("order_withdrawals",))
def _(t: Tables) -> DataFrame:
    return t.order_withdrawals.select("transaction_id", agg.fx.day_part(F.col("timestamp")).alias("part"))


@query("d11_high_risk_days", f"""
    SELECT {day('w.date')} AS date, {ts("w.date::TIMESTAMP - INTERVAL 1 SECOND")} AS as_of, fraud_withdrawals,
           total_withdrawals, fraud_amount_inr, coalesce(complaints_filed, 0) AS complaints_filed
    FROM (SELECT timestamp::DATE AS date, count(*) FILTER (is_fraud_withdrawal) AS fraud_withdrawals,
                 count(*) AS total_withdrawals, {money('CASE WHEN is_fraud_withdrawal THEN amount END')} AS fraud_amount_inr
          FROM withdrawals WHERE atm_id IN (SELECT atm_id FROM atms WHERE state = 'ASIA') GROUP BY 1
          ORDER BY 2 DESC, 4 DESC, 1 LIMIT 5) w
    LEFT JOIN (SELECT filing_timestamp::DATE AS date, count(*) AS complaints_filed FROM complaints
               WHERE victim_state = 'ASIA' GROUP BY 1) c ON w.date = c.date""", ("withdrawals", "complaints", "atms"))
def _(t: Tables) -> DataFrame:
    return agg.high_risk_days(t.withdrawals, t.complaints, t.atms, 5, STATE, "ASIA")


@query("m04_two_key_order", f"""
    SELECT {day('date')} AS date, fraud_withdrawals, fraud_amount_inr FROM (
        SELECT timestamp::DATE AS date, count(*) FILTER (is_fraud_withdrawal) AS fraud_withdrawals,
               {money('CASE WHEN is_fraud_withdrawal THEN amount END')} AS fraud_amount_inr
        FROM order_withdrawals GROUP BY 1) ORDER BY 2 DESC, 3 DESC, 1 LIMIT 20""", ("order_withdrawals",))
def _(t: Tables) -> DataFrame:
    return agg.high_risk_days(t.order_withdrawals, t.order_complaints, t.atms, 20).select(
        "date", "fraud_withdrawals", "fraud_amount_inr"
    )


@query("d12_daily_counts", f"""
    SELECT atm_id, {day('timestamp')} AS day, count(*) AS n FROM order_withdrawals GROUP BY 1, 2""", ("order_withdrawals",))
def _(t: Tables) -> DataFrame:
    return agg.daily_counts(t.order_withdrawals, "atm_id", "timestamp")


@query("d13_daily_type_pivot", f"""
    SELECT victim_city, {day('filing_timestamp')} AS day,
           count(*) FILTER (complaint_type = 'phishing') AS phishing,
           count(*) FILTER (complaint_type = 'investment_fraud') AS investment_fraud,
           count(*) FILTER (complaint_type = 'job_fraud') AS job_fraud,
           count(*) FILTER (complaint_type = 'upi_fraud') AS upi_fraud
    FROM complaints GROUP BY 1, 2""", ("complaints",))
def _(t: Tables) -> DataFrame:
    return agg.daily_type_pivot(t.complaints, ["phishing", "investment_fraud", "job_fraud", "upi_fraud"])


@query("d14_daily_distinct_accounts", f"""
    SELECT atm_id, {day('timestamp')} AS day, count(DISTINCT account_token) AS accounts,
           count(DISTINCT CASE WHEN linked THEN account_token END) AS linked_accounts,
           count(DISTINCT CASE WHEN linked AND is_fraud_withdrawal THEN account_token END) AS linked_fraud_accounts
    FROM (SELECT *, account_token IN (SELECT linked_account_token FROM complaints
                                      WHERE linked_account_token IS NOT NULL) AS linked FROM withdrawals) GROUP BY 1, 2""",
    ("withdrawals", "complaints"))
def _(t: Tables) -> DataFrame:
    return agg.daily_distinct_accounts(t.withdrawals, agg.named_accounts(t.complaints))


@query("d15_daily_amount_shape", f"""
    SELECT atm_id, {day('timestamp')} AS day, {r6(f"{money('amount')} / count(*)")} AS amount_mean,
           max(amount) AS amount_max, count(*) FILTER (amount % 1000 = 0) AS round_count,
           count(*) FILTER (amount > 20000) AS large_count, count(*) FILTER (amount > 50000) AS heavy_count,
           count(*) FILTER (is_fraud_withdrawal) AS fraud_count
    FROM order_withdrawals GROUP BY 1, 2""", ("order_withdrawals",))
def _(t: Tables) -> DataFrame:
    return agg.daily_amount_shape(t.order_withdrawals)


@query("d16_modal_value", """
    SELECT victim_city, complaint_type, n FROM (
        SELECT *, row_number() OVER (PARTITION BY victim_city ORDER BY n DESC, complaint_type) AS p FROM (
            SELECT victim_city, complaint_type, count(*) AS n FROM order_complaints GROUP BY 1, 2)) WHERE p = 1""",
    ("order_complaints",))
def _(t: Tables) -> DataFrame:
    return agg.modal_value(t.order_complaints, ["victim_city"], "complaint_type")


@query("d17_fraud_rate_by_bank", f"""
    SELECT bank_name, {r6('avg(is_fraud_withdrawal::INT)')} AS fraud_rate FROM withdrawals JOIN atms USING (atm_id)
    WHERE withdrawals.timestamp < TIMESTAMP '2024-01-22' GROUP BY 1""", ("withdrawals", "atms"))
def _(t: Tables) -> DataFrame:
    return agg.fraud_rate_by(t.withdrawals, t.atms, "bank_name", datetime(2024, 1, 22))


@query("d19_quantiles", f"""
    SELECT feature, string_agg(printf('%.4f', v), '|' ORDER BY i) AS q FROM (
        SELECT 'amount' AS feature, unnest([1, 2, 3, 4]) AS i,
               unnest(quantile_cont(amount, [0.5, 0.9, 0.95, 0.99])) AS v FROM order_withdrawals) GROUP BY 1""",
    ("order_withdrawals",))
def _(t: Tables) -> DataFrame:
    q = agg.quantiles(t.order_withdrawals, ["amount"])
    text = F.transform("q", lambda v: F.format_string("%.4f", v))
    return q.select("feature", F.array_join(text, "|").alias("q"))


@query("d20_score_status", """
    SELECT count(*) AS atms_scored, round(max(risk_score), 4) AS max_risk,
           round(quantile_cont(risk_score, 0.5), 4) AS median_risk,
           round(list_sort(list(risk_score))[round_even(0.9 * (count(*) - 1), 0)::BIGINT + 1], 4) AS p90_risk,
           count(*) FILTER (risk_score >= 0.7) AS above_threshold, max(risk_score) < 0.7 AS calm_day,
           count(*) FILTER (risk_score >= 0.85) AS critical,
           count(*) FILTER (risk_score >= 0.7 AND risk_score < 0.85) AS high,
           count(*) FILTER (risk_score >= 0.4 AND risk_score < 0.7) AS medium, count(*) FILTER (risk_score < 0.4) AS low
    FROM (SELECT score AS risk_score FROM scores)""", ("scores",))
def _(t: Tables) -> DataFrame:
    return agg.score_status(t.scores.select(F.col("score").alias("risk_score")))


@query("d21_first_event", f"""
    SELECT atm_id, {day('timestamp')} AS day, {ts('min(timestamp)')} AS first_fraud FROM withdrawals
    WHERE is_fraud_withdrawal GROUP BY 1, 2""", ("withdrawals",))
def _(t: Tables) -> DataFrame:
    return agg.first_event(t.withdrawals)


@query("d22_terciles", """
    SELECT atm_id, n, CASE WHEN n <= a THEN 'low' WHEN n <= b THEN 'mid' ELSE 'high' END AS tercile
    FROM (SELECT atm_id, count(*) AS n FROM withdrawals GROUP BY 1) x,
         (SELECT quantile_cont(n, 1.0 / 3) AS a, quantile_cont(n, 2.0 / 3) AS b
          FROM (SELECT count(*) AS n FROM withdrawals GROUP BY atm_id))""", ("withdrawals",))
def _(t: Tables) -> DataFrame:
    return agg.terciles(t.withdrawals.groupBy("atm_id").agg(F.count("*").alias("n")), "n")


@query("d23_gini", f"""
    SELECT {r6('2 * sum(i * n)::DOUBLE / (count(*) * sum(n)) - (count(*) + 1)::DOUBLE / count(*)')} AS gini FROM (
        SELECT n, row_number() OVER (ORDER BY n) AS i FROM (
            SELECT account_token, count(*) AS n FROM order_withdrawals GROUP BY 1))""", ("order_withdrawals",))
def _(t: Tables) -> DataFrame:
    return agg.gini(t.order_withdrawals.groupBy("account_token").agg(F.count("*").alias("n")), "n")


@query("d24_concentration", """
    SELECT sum(n)::BIGINT AS alerts_total, round(100 * max(n) / sum(n), 1) AS top_district_share_pct,
           round(2 * sum(i * n)::DOUBLE / (count(*) * sum(n)) - (count(*) + 1)::DOUBLE / count(*), 4) AS gini_concentration
    FROM (SELECT n, row_number() OVER (ORDER BY n) AS i FROM (SELECT district, count(*) AS n FROM alerts GROUP BY 1))""",
    ("alerts",))
def _(t: Tables) -> DataFrame:
    return agg.concentration(t.alerts)


@query("d25_spearman", f"""
    SELECT {r6('corr(rx, ry)')} AS spearman FROM (
        SELECT rank() OVER (ORDER BY amount) + (count(*) OVER (PARTITION BY amount) - 1) / 2.0 AS rx,
               rank() OVER (ORDER BY h) + (count(*) OVER (PARTITION BY h) - 1) / 2.0 AS ry
        FROM (SELECT amount, hour(timestamp) AS h FROM withdrawals))""", ("withdrawals",))
def _(t: Tables) -> DataFrame:
    return agg.spearman(t.withdrawals.select("amount", F.hour("timestamp").alias("h")), "amount", "h")


@query("d26_hotspot_density", f"""
    SELECT district, {r6('avg(CASE WHEN risk_score >= 0.7 THEN 1.0 ELSE 0.0 END)')} AS hotspot_density
    FROM latest_scores GROUP BY 1""", ("latest_scores",))
def _(t: Tables) -> DataFrame:
    return agg.hotspot_density(t.latest_scores)


@query("d27_validate_external", f"""
    SELECT count(*) AS districts, {r6('corr(rx, ry)')} AS spearman FROM (
        SELECT rank() OVER (ORDER BY d) + (count(*) OVER (PARTITION BY d) - 1) / 2.0 AS rx,
               rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2.0 AS ry
        FROM (SELECT district, avg(CASE WHEN risk_score >= 0.7 THEN 1.0 ELSE 0.0 END) AS d FROM latest_scores GROUP BY 1)
        JOIN (SELECT victim_district AS district, count(*) AS c FROM order_complaints GROUP BY 1) USING (district))""",
    ("latest_scores", "order_complaints"))
def _(t: Tables) -> DataFrame:
    external = t.order_complaints.select(F.col("victim_district").alias("district"), F.lit(1).alias("complaint_count"))
    return agg.validate_external(t.latest_scores, external)


@query("d28_category_share_diff", f"""
    SELECT category, {r6('round(pa, 4)')} AS pct_a, {r6('round(pb, 4)')} AS pct_b, {r6('round(abs(pa - pb), 4)')} AS abs_diff,
           CASE WHEN abs(pa - pb) <= 8 THEN 'OK' ELSE 'FAIL' END AS verdict
    FROM (SELECT coalesce(a.c, b.c) AS category, coalesce(a.p, 0) AS pa, coalesce(b.p, 0) AS pb
          FROM (SELECT complaint_type AS c, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM complaints) AS p
                FROM complaints GROUP BY 1) a
          FULL JOIN (SELECT complaint_type AS c, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM order_complaints) AS p
                     FROM order_complaints GROUP BY 1) b ON a.c = b.c)""", ("complaints", "order_complaints"))
def _(t: Tables) -> DataFrame:
    count = lambda df: df.groupBy(F.col("complaint_type").alias("category")).agg(F.count("*").alias("n"))
    return agg.category_share_diff(count(t.complaints), count(t.order_complaints))


@query("d29_recovery_funnel", f"""
    SELECT recommendations, flagged, held, recovered, {r6('round(100 * recovered / flagged, 2)')} AS recovery_rate_pct
    FROM (SELECT count(*) AS recommendations, {money('amount_at_risk')} AS flagged, {money('amount_held')} AS held,
                 {money('amount_recovered')} AS recovered FROM recovery)""", ("recovery",))
def _(t: Tables) -> DataFrame:
    return agg.recovery_funnel(t.recovery, ORDERS_AS_OF)


@query("d30_account_activity_at_atm", f"""
    SELECT atm_id, account_token, recent_withdrawals, amount_at_risk, rank::INT AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY atm_id ORDER BY recent_withdrawals DESC, account_token) AS rank FROM (
            SELECT atm_id, account_token, count(*) AS recent_withdrawals, {money('amount')} AS amount_at_risk
            FROM withdrawals WHERE timestamp <= TIMESTAMP '2024-01-29' AND account_token IN (
                SELECT linked_account_token FROM complaints) GROUP BY 1, 2)) WHERE rank <= 3""",
    ("withdrawals", "complaints"))
def _(t: Tables) -> DataFrame:
    return agg.account_activity_at_atm(t.withdrawals, t.complaints, AS_OF, None, 3)


@query("d35_report_fingerprint", """
    SELECT alert_id, substring(sha256('{"alert_id":"' || alert_id || '","atm_id":"' || atm_id || '","status":"' || status
           || '"}'), 1, 32) AS fingerprint FROM alerts""", ("alerts",))
def _(t: Tables) -> DataFrame:
    return t.alerts.select(
        "alert_id", agg.report_fingerprint(t.alerts, ["status", "alert_id", "atm_id"]).alias("fingerprint")
    )


@query("d36_account_city_spread", """
    SELECT account_token, count(DISTINCT city) AS cities FROM order_withdrawals JOIN atms USING (atm_id) GROUP BY 1""",
    ("order_withdrawals", "atms"))
def _(t: Tables) -> DataFrame:
    return agg.account_city_spread(t.order_withdrawals, t.atms)


@query("d37_first_value_per", """
    SELECT victim_city, min_by(victim_district, (filing_timestamp, complaint_id)) AS victim_district FROM complaints
    GROUP BY 1""", ("complaints",))
def _(t: Tables) -> DataFrame:
    return agg.first_value_per(t.complaints, "victim_city", "victim_district", ["filing_timestamp", "complaint_id"])


@query("d38_data_freshness", """
    SELECT alert_id, CASE WHEN h > 0 THEN h ELSE 0 END AS hours, h > 48 AS stale FROM (
        SELECT alert_id, round(date_diff('microsecond', created_at, TIMESTAMP '2024-01-29') / 3600000000.0::DOUBLE, 1) AS h
        FROM alerts)""", ("alerts",))
def _(t: Tables) -> DataFrame:
    fresh = agg.data_freshness(agg.at(AS_OF), F.col("created_at"))
    return t.alerts.select("alert_id", fresh.alias("f")).select(
        "alert_id", F.col("f.data_freshness_hours").alias("hours"), F.col("f.stale").alias("stale")
    )
