"""Joins and window functions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outflow.catalog.registry import day, query, r6, ts
from outflow.functions import scalar as fx
from outflow.operators import joins, windows
from outflow.operators import aggregates as agg
from outflow.plans import lookups
from outflow.sources.views import Tables

AS_OF = datetime(2024, 1, 29)

# (machine, day) grid with daily amounts, zero-filled: the base of most window checks.
DAILY = """
    daily AS (
        SELECT g.atm_id, g.day, coalesce(n, 0) AS n, coalesce(fraud, 0) AS fraud, coalesce(amax, 0) AS amax,
               coalesce(asum, 0) AS asum
        FROM (SELECT atm_id, day FROM atms CROSS JOIN days) g
        LEFT JOIN (SELECT atm_id, timestamp::DATE AS day, count(*) AS n, count(*) FILTER (is_fraud_withdrawal) AS fraud,
                          max(amount) AS amax, sum(amount::DECIMAL(18,2))::DOUBLE AS asum
                   FROM withdrawals GROUP BY 1, 2) d ON g.atm_id = d.atm_id AND g.day = d.day)"""
DAILY_VIEWS = ("atms", "days", "withdrawals")


def atm_days(t: Tables) -> DataFrame:
    first, last = _calendar(t)
    return joins.dense_grid(t.atms.select("atm_id"), "day", first, last)


def _calendar(t: Tables):
    events = t.raw("events").select(F.to_date("ts").alias("d"))
    return events.agg(F.min("d")).scalar(), events.agg(F.max("d")).scalar()


def daily(t: Tables) -> DataFrame:
    counted = t.withdrawals.groupBy("atm_id", F.to_date("timestamp").alias("day")).agg(
        F.count("*").alias("n"), F.count_if("is_fraud_withdrawal").alias("fraud"), F.max("amount").alias("amax"),
        agg.exact_sum("amount").alias("asum"),
    )
    return atm_days(t).join(counted, ["atm_id", "day"], "left").na.fill(0, ["n", "fraud"]).na.fill(0.0, ["amax", "asum"])


# ---------------------------------------------------------------- joins


@query("c01_assemble", f"""
    WITH {DAILY} SELECT d.atm_id, {day('d.day')} AS day, d.n, a.bank_name, coalesce(c.n, 0) AS city_complaints
    FROM daily d LEFT JOIN atms a ON d.atm_id = a.atm_id
    LEFT JOIN (SELECT victim_city AS city, filing_timestamp::DATE AS day, count(*) AS n FROM complaints GROUP BY 1, 2) c
         ON a.city = c.city AND d.day = c.day""", (*DAILY_VIEWS, "complaints"))
def _(t: Tables) -> DataFrame:
    per_city = agg.daily_counts(t.complaints, "victim_city", "filing_timestamp").select(
        F.col("victim_city").alias("city"), "day", F.col("n").alias("city_complaints")
    )
    wide = daily(t).select("atm_id", "day", "n").join(t.atms.select("atm_id", "city", "bank_name"), "atm_id", "left")
    return wide.join(per_city, ["city", "day"], "left").select(
        "atm_id", "day", "n", "bank_name", F.coalesce("city_complaints", F.lit(0)).alias("city_complaints")
    )


@query("c02_dense_grid", f"SELECT atm_id, {day('day')} AS day FROM atms CROSS JOIN days", ("atms", "days"))
def _(t: Tables) -> DataFrame:
    return atm_days(t)


@query("c03_asof_backward", f"""
    SELECT w.transaction_id, {ts('max(c.filing_timestamp)')} AS last_filed FROM withdrawals w
    LEFT JOIN complaints c ON w.account_token = c.linked_account_token AND c.filing_timestamp <= w.timestamp
    GROUP BY 1""", ("withdrawals", "complaints"))
def _(t: Tables) -> DataFrame:
    right = t.complaints.select(F.col("linked_account_token").alias("account_token"), "filing_timestamp").dropna()
    return joins.asof_backward(
        t.withdrawals.select("transaction_id", "account_token", "timestamp"), right, ["account_token"], "timestamp",
        "filing_timestamp", "last_filed",
    ).select("transaction_id", "last_filed")


@query("c04_asof_forward", f"""
    SELECT c.complaint_id, {ts('min(w.timestamp)')} AS next_withdrawal FROM complaints c
    LEFT JOIN withdrawals w ON w.account_token = c.linked_account_token AND w.timestamp >= c.filing_timestamp
    GROUP BY 1""", ("withdrawals", "complaints"))
def _(t: Tables) -> DataFrame:
    left = t.complaints.select("complaint_id", F.col("linked_account_token").alias("account_token"), "filing_timestamp")
    return joins.asof_forward(
        left, t.withdrawals.select("account_token", "timestamp"), ["account_token"], "filing_timestamp", "timestamp",
        "next_withdrawal",
    ).select("complaint_id", "next_withdrawal")


@query("c05_flag_linked", """
    SELECT transaction_id, account_token IN (SELECT linked_account_token FROM complaints
           WHERE linked_account_token IS NOT NULL) AS linked FROM order_withdrawals""", ("order_withdrawals", "complaints"))
def _(t: Tables) -> DataFrame:
    return joins.flag_linked(t.order_withdrawals, t.complaints).select("transaction_id", "linked")


@query("c05_linked_only", """
    SELECT transaction_id FROM order_withdrawals WHERE account_token IN (SELECT linked_account_token FROM complaints)""",
    ("order_withdrawals", "complaints"))
def _(t: Tables) -> DataFrame:
    return joins.linked_only(t.order_withdrawals, t.complaints).select("transaction_id")


@query("c06_pending_alerts", """
    SELECT alert_id FROM alerts WHERE created_at <= TIMESTAMP '2024-01-28'
    AND alert_id NOT IN (SELECT alert_id FROM outcomes)""", ("alerts", "outcomes"))
def _(t: Tables) -> DataFrame:
    return joins.pending_alerts(t.alerts, t.outcomes, AS_OF).select("alert_id")


@query("c07_interval_join", """
    SELECT alert_id, transaction_id FROM alerts a JOIN withdrawals w ON a.atm_id = w.atm_id
    AND w.timestamp >= a.created_at AND w.timestamp <= a.created_at + INTERVAL 24 HOUR""", ("alerts", "withdrawals"))
def _(t: Tables) -> DataFrame:
    return joins.interval_join(
        t.alerts.select("alert_id", "atm_id", "created_at"), t.withdrawals.select("transaction_id", "atm_id", "timestamp"),
        "atm_id", "created_at", "timestamp", 0, 24,
    ).select("alert_id", "transaction_id")


def _exists_sql(h: int) -> str:
    return (
        f"CASE WHEN EXISTS (SELECT 1 FROM withdrawals w WHERE w.atm_id = g.atm_id AND w.is_fraud_withdrawal AND"
        f" w.timestamp > g.day AND w.timestamp < g.day::TIMESTAMP + INTERVAL {h} HOUR) THEN 1 ELSE 0 END AS y_{h}"
    )


@query("c08_exists_within", f"""
    SELECT atm_id, {day('day')} AS day, {_exists_sql(2)}, {_exists_sql(24)}, {_exists_sql(72)}
    FROM (SELECT atm_id, day FROM atms CROSS JOIN days) g""", ("atms", "days", "withdrawals"))
def _(t: Tables) -> DataFrame:
    grid = atm_days(t).withColumn("t", F.col("day").cast("timestamp_ntz"))
    fraud = t.withdrawals.where("is_fraud_withdrawal").select("atm_id", "timestamp")
    return joins.exists_within(grid, fraud, "atm_id", "t", "timestamp", [2, 24, 72]).drop("t")


HAVERSINE = """2 * 6371.0 * asin(least(sqrt(power(sin(radians({2} - {0}) / 2), 2)
    + cos(radians({0})) * cos(radians({2})) * power(sin(radians({3} - {1}) / 2), 2)), 1.0))"""


@query("c09_near", f"""
    SELECT atm_id, complaint_id, {r6('d')} AS distance_km FROM (
        SELECT atm_id, complaint_id, {HAVERSINE.format('latitude', 'longitude', 'victim_lat', 'victim_lon')} AS d
        FROM atms CROSS JOIN complaints) WHERE d <= 2.0""", ("atms", "complaints"))
def _(t: Tables) -> DataFrame:
    return joins.near(
        t.atms.select("atm_id", "latitude", "longitude"), t.complaints.select("complaint_id", "victim_lat", "victim_lon"),
        2.0, "latitude", "longitude", "victim_lat", "victim_lon",
    ).select("atm_id", "complaint_id", "distance_km")


@query("c10_lookup", f"""
    WITH means AS (SELECT atm_id, avg(amount) AS mean_fraud FROM withdrawals WHERE is_fraud_withdrawal GROUP BY 1)
    SELECT atm_id, {r6('coalesce(mean_fraud, (SELECT avg(mean_fraud) FROM means))')} AS mean_fraud_amount
    FROM atms LEFT JOIN means USING (atm_id)""", ("withdrawals", "atms"))
def _(t: Tables) -> DataFrame:
    # Machines without any fraud take the mean over the others.
    means = t.withdrawals.where("is_fraud_withdrawal").groupBy("atm_id").agg(F.avg("amount").alias("mean_fraud"))
    return joins.lookup(t.atms.select("atm_id"), means, "atm_id", "mean_fraud", "mean_fraud_amount")


@query("c11_link_atm_accounts_complaints", """
    SELECT atm_id, victim_state, sum(n)::BIGINT AS n
    FROM (SELECT DISTINCT atm_id, account_token FROM order_withdrawals)
    JOIN (SELECT linked_account_token AS account_token, victim_state, count(*) AS n FROM order_complaints GROUP BY 1, 2)
         USING (account_token) GROUP BY 1, 2""", ("order_withdrawals", "order_complaints"))
def _(t: Tables) -> DataFrame:
    return joins.link_atm_accounts_complaints(t.order_withdrawals, t.order_complaints)


@query("c12_amount_cluster", """
    WITH x AS (SELECT complaint_id, victim_city, filing_timestamp::DATE AS day, round(amount_lost * 100)::BIGINT AS c
               FROM complaints)
    SELECT a.complaint_id, count(*) AS amount_cluster FROM x a JOIN x b ON a.victim_city = b.victim_city AND a.day = b.day
    AND abs(a.c - b.c) * 10 <= greatest(abs(a.c), 100) GROUP BY 1""", ("complaints",))
def _(t: Tables) -> DataFrame:
    rows = t.complaints.select("complaint_id", "victim_city", F.to_date("filing_timestamp").alias("day"), "amount_lost")
    return joins.amount_cluster(rows, ["victim_city", "day"], "amount_lost").select("complaint_id", "amount_cluster")


@query("c13_proximity_counts", f"""
    SELECT atm_id, {day('day')} AS day, count(*) AS complaints_nearby FROM (
        SELECT atm_id, unnest([filing_timestamp::DATE, filing_timestamp::DATE + 1]) AS day FROM atms, complaints
        WHERE {HAVERSINE.format('latitude', 'longitude', 'victim_lat', 'victim_lon')} <= 2.0) GROUP BY 1, 2""",
    ("atms", "complaints"))
def _(t: Tables) -> DataFrame:
    return joins.proximity_counts(t.atms, t.complaints)


@query("c14_nearest_event_distance", f"""
    SELECT {day('d')} AS day, min(abs(d - f)) AS days_to_festival
    FROM (SELECT DISTINCT timestamp::DATE AS d FROM order_withdrawals),
         (SELECT unnest({fx.FESTIVALS!r})::DATE AS f) GROUP BY 1""", ("order_withdrawals",))
def _(t: Tables) -> DataFrame:
    distinct_days = t.order_withdrawals.select(F.to_date("timestamp").alias("day")).distinct()
    return distinct_days.select("day", fx.nearest_event_distance(F.col("day")).cast("bigint").alias("days_to_festival"))


@query("d18_latency_by_type", f"""
    SELECT complaint_type, {r6('quantile_cont(d, 0.5)')} AS latency_days FROM (
        SELECT c.complaint_id, c.complaint_type,
               date_diff('microsecond', c.filing_timestamp, min(w.timestamp)) / 86400000000.0::DOUBLE AS d
        FROM complaints c JOIN (SELECT city, timestamp FROM withdrawals JOIN atms USING (atm_id)
                                WHERE is_fraud_withdrawal) w
             ON c.victim_city = w.city AND w.timestamp >= c.filing_timestamp
        GROUP BY c.complaint_id, c.complaint_type, c.filing_timestamp) WHERE d > 0 GROUP BY 1""",
    ("complaints", "withdrawals", "atms"))
def _(t: Tables) -> DataFrame:
    return lookups.latency_by_type(t.complaints, t.withdrawals, t.atms)


# ---------------------------------------------------------------- windows

W = "OVER (PARTITION BY atm_id ORDER BY day ROWS BETWEEN {0} PRECEDING AND CURRENT ROW)"


@query("e01_trailing_sum", f"""
    WITH {DAILY} SELECT atm_id, {day('day')} AS day, (sum(n) {W.format(1)})::BIGINT AS n2, (sum(n) {W.format(6)})::BIGINT AS n7,
        (sum(n) {W.format(7)})::BIGINT AS n8, (sum(n) {W.format(27)})::BIGINT AS n28 FROM daily""", DAILY_VIEWS)
def _(t: Tables) -> DataFrame:
    spec = windows.ordered(["atm_id"], "day")
    return daily(t).select("atm_id", "day", *[windows.trailing_sum("n", spec, k).alias(f"n{k}") for k in (2, 7, 8, 28)])


@query("e02_trailing_mean_max", f"""
    WITH {DAILY} SELECT atm_id, {day('day')} AS day, {r6(f'avg(n) {W.format(6)}')} AS mean7, max(amax) {W.format(6)} AS max7
    FROM daily""", DAILY_VIEWS)
def _(t: Tables) -> DataFrame:
    spec = windows.ordered(["atm_id"], "day")
    return daily(t).select(
        "atm_id", "day", windows.trailing_mean("n", spec, 7).alias("mean7"), windows.trailing_max("amax", spec, 7).alias("max7")
    )


def _hours_sql(h: int) -> str:
    where = f"w.timestamp < g.day AND w.timestamp >= g.day::TIMESTAMP - INTERVAL {h} HOUR"
    return f"count(*) FILTER ({where}) AS n_{h}h, coalesce(sum(amount::DECIMAL(18,2)) FILTER ({where}), 0)::DOUBLE AS sum_{h}h"


@query("e03_trailing_hours", f"""
    SELECT g.atm_id, {ts('g.day::TIMESTAMP')} AS t, {_hours_sql(1)}, {_hours_sql(6)}, {_hours_sql(24)}
    FROM (SELECT atm_id, day FROM atms CROSS JOIN days) g LEFT JOIN withdrawals w ON w.atm_id = g.atm_id
    AND w.timestamp >= g.day::TIMESTAMP - INTERVAL 24 HOUR AND w.timestamp < g.day GROUP BY g.atm_id, g.day""",
    ("atms", "days", "withdrawals"))
def _(t: Tables) -> DataFrame:
    anchors = atm_days(t).select("atm_id", F.col("day").cast("timestamp_ntz").alias("t"))
    return windows.trailing_hours(t.withdrawals, anchors, "atm_id", "timestamp", "t", [1, 6, 24], "amount")


@query("e04_night_ratio", f"""
    SELECT atm_id, {day('timestamp::DATE + 1')} AS day,
           {r6('avg(CASE WHEN hour(timestamp) IN (22, 23, 0, 1, 2, 3) THEN 1.0 ELSE 0.0 END)')} AS night_ratio_24h
    FROM withdrawals GROUP BY atm_id, timestamp::DATE""", ("withdrawals",))
def _(t: Tables) -> DataFrame:
    return windows.night_ratio(t.withdrawals, "atm_id", "timestamp")


@query("e05_decayed_sum", f"""
    WITH {DAILY} SELECT a.atm_id, {day('a.day')} AS day, {r6('sum(b.fraud * exp(-(a.day - b.day) / 2.0))')} AS fraud_decay
    FROM daily a JOIN daily b ON a.atm_id = b.atm_id AND b.day BETWEEN a.day - 6 AND a.day GROUP BY a.atm_id, a.day""",
    DAILY_VIEWS)
def _(t: Tables) -> DataFrame:
    return daily(t).select(
        "atm_id", "day", windows.decayed_sum("fraud", windows.ordered(["atm_id"], "day")).alias("fraud_decay")
    )


@query("e06_shift_forward", f"""
    WITH {DAILY} SELECT atm_id, {day('day + 1')} AS day, n FROM daily""", DAILY_VIEWS)
def _(t: Tables) -> DataFrame:
    return windows.shift_forward(daily(t), "day", days=1).select("atm_id", "day", "n")


@query("e07_lag_value", f"""
    WITH {DAILY} SELECT atm_id, {day('day')} AS day, lag(amax, 1, 0) OVER (PARTITION BY atm_id ORDER BY day) AS amax_1d
    FROM daily""", DAILY_VIEWS)
def _(t: Tables) -> DataFrame:
    return daily(t).select(
        "atm_id", "day", F.lag("amax", 1, 0.0).over(windows.ordered(["atm_id"], "day")).alias("amax_1d")
    )


@query("e08_surge_velocity", f"""
    WITH {DAILY} SELECT atm_id, {day('day')} AS day, {r6('coalesce((n - p)::DOUBLE / greatest(p, 1), 0)')} AS velocity
    FROM (SELECT *, lag(n) OVER (PARTITION BY atm_id ORDER BY day) AS p FROM daily)""", DAILY_VIEWS)
def _(t: Tables) -> DataFrame:
    return daily(t).select(
        "atm_id", "day", windows.surge_velocity("n", windows.ordered(["atm_id"], "day")).alias("velocity")
    )


@query("e09_surge_ratio", f"""
    SELECT victim_city, {day('day')} AS day, {r6('CASE WHEN b IS NULL THEN 1 ELSE n / greatest(b, 1) END')} AS surge_ratio FROM (
        SELECT *, avg(n) OVER (PARTITION BY victim_city ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS b FROM (
            SELECT victim_city, filing_timestamp::DATE AS day, count(*) AS n FROM complaints GROUP BY 1, 2))""",
    ("complaints",))
def _(t: Tables) -> DataFrame:
    return windows.surge_ratio(
        t.complaints.select("victim_city", F.to_date("filing_timestamp").alias("day")), "victim_city", "day"
    )


@query("e10_cold_start_flag", f"""
    SELECT atm_id, {day('day')} AS day, (row_number() OVER (PARTITION BY atm_id ORDER BY day) <= 7)::INT::DOUBLE AS cold_start_flag
    FROM (SELECT DISTINCT atm_id, timestamp::DATE AS day FROM withdrawals)""", ("withdrawals",))
def _(t: Tables) -> DataFrame:
    return windows.cold_start_days(t.withdrawals.select("atm_id", F.to_date("timestamp").alias("day")), "atm_id", "day")


@query("e11_rank_pct", f"""
    SELECT transaction_id, {r6('(rank() OVER (ORDER BY amount) + (count(*) OVER (PARTITION BY amount) - 1) / 2.0) / count(*) OVER ()')}
           AS pct FROM withdrawals""", ("withdrawals",))
def _(t: Tables) -> DataFrame:
    return windows.rank_pct(t.withdrawals.select("transaction_id", "amount"), "amount", "pct").select("transaction_id", "pct")


@query("e12_latest_per_key", f"""
    SELECT atm_id, alert_id, {ts('created_at')} AS created_at, risk_score FROM alerts
    QUALIFY row_number() OVER (PARTITION BY atm_id ORDER BY alerts.created_at DESC, alert_id DESC) = 1""", ("alerts",))
def _(t: Tables) -> DataFrame:
    return windows.latest_per_key(
        t.alerts.select("atm_id", "alert_id", "created_at", "risk_score"), "atm_id", "created_at", tie="alert_id"
    )


@query("e13_fairness_cap", """
    WITH pop AS (SELECT state, count(*) AS n FROM atms GROUP BY 1),
    budget AS (SELECT state, greatest(1, round_even(50.0::DOUBLE * n / (SELECT sum(n) FROM pop), 0)::BIGINT) AS b FROM pop),
    placed AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY risk_score DESC, alert_id) AS p FROM alerts)
    SELECT alert_id, tier = 'action' AND p > b AS capped,
           CASE WHEN tier = 'action' AND p > b THEN 'monitor' ELSE tier END AS effective_tier
    FROM placed JOIN budget USING (state)""", ("alerts", "atms"))
def _(t: Tables) -> DataFrame:
    return windows.fairness_cap(
        t.alerts.select("alert_id", "state", "risk_score", "tier"), agg.atm_population_by_state(t.atms), F.lit(50),
        [F.col("risk_score").desc(), F.col("alert_id")],
    ).select("alert_id", "capped", "effective_tier")


@query("e14_top_k_per_day", f"""
    SELECT atm_id, {day('day')} AS day, rank::INT AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, atm_id) AS rank FROM scores) WHERE rank <= 10""",
    ("scores",))
def _(t: Tables) -> DataFrame:
    return windows.top_k_per_group(t.scores, ["day"], [F.col("score").desc(), F.col("atm_id")], 10).select(
        "atm_id", "day", "rank"
    )


@query("m03_top_k_per_group", """
    SELECT atm_id, transaction_id, amount FROM order_withdrawals
    QUALIFY row_number() OVER (PARTITION BY atm_id ORDER BY amount DESC, transaction_id) <= 5""", ("order_withdrawals",))
def _(t: Tables) -> DataFrame:
    rows = t.order_withdrawals.select("atm_id", "transaction_id", "amount")
    return windows.top_k_per_group(rows, ["atm_id"], [F.col("amount").desc(), F.col("transaction_id")], 5).drop("rank")


@query("m05_top_share", """
    SELECT atm_id, n FROM (SELECT *, row_number() OVER (ORDER BY n DESC, atm_id) AS p, count(*) OVER () AS total FROM (
        SELECT atm_id, count(*) AS n FROM withdrawals GROUP BY 1)) WHERE p <= floor(0.2 * total)""", ("withdrawals",))
def _(t: Tables) -> DataFrame:
    from outflow.functions.ordering import top_share

    volume = t.withdrawals.groupBy("atm_id").agg(F.count("*").alias("n"))
    return top_share(volume, [F.col("n").desc(), F.col("atm_id")], 0.2)


@query("e15_argmax_type", f"""
    SELECT victim_city, {day('day')} AS day, CASE WHEN p = m THEN 'phishing' WHEN i = m THEN 'investment_fraud'
           WHEN j = m THEN 'job_fraud' ELSE 'upi_fraud' END AS top_type
    FROM (SELECT *, greatest(p, i, j, u) AS m FROM (
        SELECT victim_city, filing_timestamp::DATE AS day, count(*) FILTER (complaint_type = 'phishing') AS p,
               count(*) FILTER (complaint_type = 'investment_fraud') AS i,
               count(*) FILTER (complaint_type = 'job_fraud') AS j, count(*) FILTER (complaint_type = 'upi_fraud') AS u
        FROM complaints GROUP BY 1, 2))""", ("complaints",))
def _(t: Tables) -> DataFrame:
    kinds = ["phishing", "investment_fraud", "job_fraud", "upi_fraud"]
    pivoted = agg.daily_type_pivot(t.complaints, kinds)
    return pivoted.select("victim_city", "day", fx.argmax_name({k: F.col(k) for k in kinds}).alias("top_type"))


@query("e16_rolling_centroid", f"""
    WITH d AS (SELECT city, day, count(c.complaint_id) AS n, coalesce(sum(victim_lat), 0) AS la, coalesce(sum(victim_lon), 0) AS lo
               FROM (SELECT city, centre_lat, centre_lon, day FROM places CROSS JOIN days) g
               LEFT JOIN complaints c ON c.victim_city = g.city AND c.filing_timestamp::DATE = g.day GROUP BY 1, 2),
    w AS (SELECT city, day, sum(n) OVER k AS n, sum(la) OVER k AS la, sum(lo) OVER k AS lo FROM d
          WINDOW k AS (PARTITION BY city ORDER BY day ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))
    SELECT city, {day('day')} AS day, {r6('CASE WHEN n > 0 THEN la / n ELSE centre_lat END')} AS clat,
           {r6('CASE WHEN n > 0 THEN lo / n ELSE centre_lon END')} AS clon FROM w JOIN places USING (city)""",
    ("places", "days", "complaints"))
def _(t: Tables) -> DataFrame:
    from outflow.plans.daily import city_daily

    first, last = _calendar(t)
    dense = city_daily(t.complaints, t.city_centres.select("city"), first, last)
    return windows.rolling_centroid(dense, t.city_centres)


@query("e17_trailing_flag", f"""
    WITH {DAILY} SELECT atm_id, {day('day')} AS day, least(max(fraud) {W.format(6)}, 1) AS flag FROM daily""", DAILY_VIEWS)
def _(t: Tables) -> DataFrame:
    return daily(t).select("atm_id", "day", windows.trailing_flag("fraud", windows.ordered(["atm_id"], "day"), 7).alias("flag"))


@query("e18_time_to_withdrawal", f"""
    WITH x AS (SELECT c.complaint_id, date_diff('microsecond', c.filing_timestamp, min(w.timestamp)) / 3600000000.0::DOUBLE AS h
               FROM complaints c LEFT JOIN withdrawals w ON w.account_token = c.linked_account_token
                    AND w.timestamp >= c.filing_timestamp GROUP BY c.complaint_id, c.filing_timestamp)
    SELECT complaint_id, {r6('CASE WHEN h BETWEEN 0 AND 168 THEN h ELSE (SELECT avg(h) FROM x WHERE h BETWEEN 0 AND 168) END')}
           AS time_to_withdrawal FROM x""", ("complaints", "withdrawals"))
def _(t: Tables) -> DataFrame:
    left = t.complaints.select("complaint_id", F.col("linked_account_token").alias("account_token"), "filing_timestamp")
    pairs = joins.asof_forward(
        left, t.withdrawals.select("account_token", "timestamp"), ["account_token"], "filing_timestamp", "timestamp",
        "withdrawal_timestamp",
    )
    return windows.time_to_withdrawal(pairs, "filing_timestamp", "withdrawal_timestamp").select(
        "complaint_id", "time_to_withdrawal"
    )
