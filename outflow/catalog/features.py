"""Feature matrices, labels and the point process, each against one statement of the same definitions in SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outflow.catalog.joins_windows import HAVERSINE
from outflow.catalog.registry import day, query, r6, ts
from outflow.functions import scalar as fx
from outflow.operators.joins import asof_forward
from outflow.operators.listing import hotspots
from outflow.plans import daily, enrich, hawkes, hourly, lookups, six_hour
from outflow.plans.steps import city_steps, data_span
from outflow.plans.summary import DailySummary
from outflow.schemas import FEATURE_TYPES
from outflow.sources.views import Tables
from outflow.streaming.jobs import stream_folder

# First day after the training period of the event calendar.
TRAIN_END, TRAIN_END_SQL = datetime(2024, 1, 22), "DATE '2024-01-22'"


def span(t: Tables):
    return data_span(t.complaints, t.withdrawals, 24)


def learned(t: Tables, days=None, only: tuple[str, ...] = ("latency", "bank_rate", "hawkes")) -> daily.Lookups:
    """Lookup tables from the training days; those that are not asked for are not fitted."""
    end = daily.step_of(F.lit(TRAIN_END).cast("timestamp_ntz"), 24)

    def fitted() -> DataFrame:
        first, _last = days or span(t)
        return hawkes.hawkes_fit(city_steps(t.complaints, t.city_centres, first, end - 1, 24), end - first)

    return daily.Lookups(
        latency=lookups.latency_by_type(t.complaints, t.withdrawals, t.atms, TRAIN_END) if "latency" in only else None,
        bank_rate=lookups.bank_fraud_rate(t.withdrawals, t.atms, TRAIN_END) if "bank_rate" in only else None,
        hawkes=fitted() if "hawkes" in only else None,
    )


def matrix(t: Tables, only: tuple[str, ...] = ("latency", "bank_rate", "hawkes"), **days_of) -> DataFrame:
    days = span(t)
    return daily.atm_day_features(t.complaints, t.withdrawals, t.atms, t.city_centres, learned(t, days, only), span=days, **days_of)


VIEWS = ("atms", "days", "withdrawals", "complaints", "places")

CITY_CTES = f"""
    first_day AS (SELECT min(day) AS d0 FROM days),
    city_grid AS (SELECT city, centre_lat, centre_lon, day FROM places CROSS JOIN days),
    comp AS (SELECT *, filing_timestamp::DATE AS fd FROM complaints),
    home AS (SELECT victim_city AS city, min_by(victim_district, (filing_timestamp, victim_district)) AS district
             FROM complaints GROUP BY 1),
    city8 AS (
        SELECT g.city, g.day, count(*) FILTER (fd >= g.day - 2) AS c24, count(fd) AS c7,
               {', '.join(f"count(*) FILTER (complaint_type = '{k}') AS t_{k}_7d" for k in FEATURE_TYPES)},
               sum(victim_lat::DECIMAL(12,6))::DOUBLE / count(fd) AS la, sum(victim_lon::DECIMAL(12,6))::DOUBLE / count(fd) AS lo
        FROM city_grid g LEFT JOIN comp c ON c.victim_city = g.city AND fd BETWEEN g.day - 8 AND g.day - 1 GROUP BY 1, 2),
    city_last AS (SELECT g.city, g.day, max(filing_timestamp) AS newest FROM city_grid g
                  JOIN comp c ON c.victim_city = g.city AND fd < g.day GROUP BY 1, 2),
    dist AS (SELECT h.city, g.day, count(c.fd) AS cd FROM home h JOIN days g ON true
             LEFT JOIN comp c ON c.victim_district = h.district AND fd BETWEEN g.day - 2 AND g.day - 1 GROUP BY 1, 2),
    city_f AS (
        SELECT g.city, g.day, c24 AS n_complaints_city_24h, c7 AS n_complaints_city_7d,
               coalesce(date_diff('microsecond', newest, g.day::TIMESTAMP) / 3600000000.0::DOUBLE, 8784.0)
                   AS hours_since_last_complaint_city,
               coalesce(cd, 0) AS n_complaints_district_24h, {', '.join(f't_{k}_7d' for k in FEATURE_TYPES)},
               coalesce(la, centre_lat) AS clat, coalesce(lo, centre_lon) AS clon, centre_lat, centre_lon,
               coalesce((c24 - lag(c24) OVER w)::DOUBLE / greatest(lag(c24) OVER w, 1), 0) AS complaint_surge_velocity
        FROM city_grid g JOIN city8 USING (city, day) LEFT JOIN city_last USING (city, day)
        LEFT JOIN dist USING (city, day) WINDOW w AS (PARTITION BY g.city ORDER BY g.day))"""

MACHINE_CTES = """
    named AS (SELECT linked_account_token AS account_token, min(filing_timestamp)::DATE AS m FROM complaints
              WHERE linked_account_token IS NOT NULL GROUP BY 1),
    wd AS (SELECT w.*, w.timestamp::DATE AS d, hour(w.timestamp) AS h FROM withdrawals w),
    grid AS (SELECT atm_id, day FROM atms CROSS JOIN days),
    dw AS (SELECT atm_id, d, count(*) AS n, count(*) FILTER (h >= 23) AS w1, count(*) FILTER (h >= 18) AS w6,
                  sum(amount::DECIMAL(18,2))::DOUBLE AS s, max(amount) AS mx, count(*) FILTER (amount % 1000 = 0) AS rn,
                  count(*) FILTER (amount > 20000) AS ln, count(*) FILTER (amount > 50000) AS hn,
                  count(*) FILTER (is_fraud_withdrawal) AS fn, count(*) FILTER (h IN (22, 23, 0, 1, 2, 3)) AS nn
           FROM wd GROUP BY 1, 2),
    ac AS (SELECT atm_id, d, account_token, any_value(m) AS m, count(*) AS n, bool_or(is_fraud_withdrawal) AS f
           FROM wd LEFT JOIN named USING (account_token) GROUP BY 1, 2, 3),
    m1 AS (
        SELECT g.atm_id, g.day, coalesce(sum(w1) FILTER (d = g.day - 1), 0)::BIGINT AS withdrawals_1h,
               coalesce(sum(w6) FILTER (d = g.day - 1), 0)::BIGINT AS withdrawals_6h,
               coalesce(sum(n) FILTER (d = g.day - 1), 0)::BIGINT AS withdrawals_24h,
               coalesce(sum(s) FILTER (d = g.day - 1), 0) AS amount_sum_24h,
               coalesce(sum(nn) FILTER (d = g.day - 1), 0) AS nn,
               coalesce(sum(s / n), 0) / greatest(least(7, g.day - (SELECT min(day) FROM days)), 1) AS amount_mean_7d,
               coalesce(max(mx), 0) AS amount_max_7d, coalesce(sum(rn), 0)::BIGINT AS round_count_7d,
               coalesce(sum(ln), 0)::BIGINT AS large_count_7d, coalesce(sum(hn), 0)::BIGINT AS heavy_count_7d,
               coalesce(max(mx) FILTER (d = g.day - 1), 0) AS amount_max_1d,
               coalesce(sum(ln) FILTER (d = g.day - 1), 0)::BIGINT AS large_count_1d,
               coalesce(sum(fn * exp(-((g.day - 1) - d) / 2.0)), 0) AS fraud_decay_7d,
               CASE WHEN sum(fn) > 0 THEN 1.0 ELSE 0.0 END AS prior_alert_fraud_flag
        FROM grid g LEFT JOIN dw ON dw.atm_id = g.atm_id AND d BETWEEN g.day - 7 AND g.day - 1 GROUP BY 1, 2),
    m2 AS (
        SELECT g.atm_id, g.day, count(*) FILTER (d >= g.day - 2) AS distinct_accounts_24h,
               count(*) FILTER (d >= g.day - 2 AND m < g.day) AS counterparty_count_24h,
               count(*) FILTER (f AND m < g.day) AS mule_reuse_count_7d,
               coalesce(sum(n) FILTER (d = g.day - 1 AND m < g.day), 0) AS linked24
        FROM grid g LEFT JOIN ac ON ac.atm_id = g.atm_id AND d BETWEEN g.day - 8 AND g.day - 1 GROUP BY 1, 2),
    machine_f AS (
        SELECT m1.atm_id, m1.day, withdrawals_1h, withdrawals_6h, withdrawals_24h, amount_sum_24h, distinct_accounts_24h,
               CASE WHEN withdrawals_24h > 0 THEN linked24::DOUBLE / withdrawals_24h ELSE 0 END AS linked_proportion_24h,
               CASE WHEN withdrawals_24h > 0 THEN withdrawals_24h::DOUBLE / greatest(distinct_accounts_24h, 1) ELSE 0 END
                   AS transaction_frequency_24h,
               counterparty_count_24h, amount_sum_24h / 24 AS fund_velocity_24h,
               CASE WHEN withdrawals_1h >= 3 AND withdrawals_1h >= 2.0 * withdrawals_24h / 24 THEN 1.0 ELSE 0.0 END
                   AS activity_spike_flag,
               mule_reuse_count_7d, CASE WHEN withdrawals_24h > 0 THEN nn::DOUBLE / withdrawals_24h ELSE 0 END AS night_ratio_24h,
               amount_mean_7d, amount_max_7d, round_count_7d, large_count_7d, heavy_count_7d, amount_max_1d,
               large_count_1d, fraud_decay_7d, prior_alert_fraud_flag
        FROM m1 JOIN m2 ON m1.atm_id = m2.atm_id AND m1.day = m2.day)"""

HAWKES_CTES = f"""
    hd AS (SELECT g.city, (g.day - d0)::INTEGER AS i, count(c.fd) AS n FROM city_grid g CROSS JOIN first_day
           LEFT JOIN comp c ON c.victim_city = g.city AND c.fd = g.day GROUP BY 1, 2),
    ht AS (SELECT city, i, n FROM hd CROSS JOIN first_day WHERE d0 + i < {TRAIN_END_SQL}),
    hs AS (SELECT city, sum(n)::DOUBLE AS ev, ({TRAIN_END_SQL} - (SELECT d0 FROM first_day))::DOUBLE AS hor FROM ht GROUP BY 1),
    hg AS (SELECT row_number() OVER () AS ord, b AS beta, f * b AS alpha FROM
           (SELECT unnest({hawkes.BETAS})::DOUBLE AS b), (SELECT unnest({hawkes.ALPHA_FRACTIONS})::DOUBLE AS f)),
    ha AS (SELECT a.city, a.i, a.n, beta, coalesce(sum(b.n * exp(-beta * (a.i - b.i))), 0) AS s
           FROM ht a CROSS JOIN (SELECT DISTINCT beta FROM hg) LEFT JOIN ht b ON a.city = b.city AND b.i < a.i
           GROUP BY 1, 2, 3, 4),
    hl AS (SELECT ha.city, ord, hg.beta, hg.alpha, any_value(greatest(ev / hor, 1e-6)) AS mu, any_value(ev) AS ev, any_value(hor) AS hor,
                  sum(coalesce(list_sum(list_transform(range(n), lambda k: ln(greatest(ev / hor, 1e-6) + hg.alpha * (s + k)))), 0))
                  - any_value(greatest(ev / hor, 1e-6) * hor)
                  - hg.alpha / hg.beta * sum(n * (1 - exp(-hg.beta * (hor - i)))) AS ll
           FROM ha JOIN hg ON ha.beta = hg.beta JOIN hs ON ha.city = hs.city GROUP BY 1, 2, 3, 4),
    hp AS (SELECT city, CASE WHEN ev >= 2 THEN mu ELSE ev / hor END AS mu, CASE WHEN ev >= 2 THEN alpha ELSE 0 END AS alpha,
                  CASE WHEN ev >= 2 THEN beta ELSE 0.1 END AS beta
           FROM hl QUALIFY row_number() OVER (PARTITION BY city ORDER BY ll DESC, ord) = 1),
    hawkes_f AS (SELECT a.city, d0 + a.i AS day, mu + alpha * coalesce(sum(b.n * exp(-beta * (a.i - b.i))), 0) AS hawkes_intensity_24h
                 FROM hd a CROSS JOIN first_day JOIN hp ON a.city = hp.city
                 LEFT JOIN hd b ON a.city = b.city AND b.i < a.i GROUP BY a.city, a.i, d0, mu, alpha)"""

LEARNED_CTES = f"""
    rates AS (SELECT bank_name, avg(is_fraud_withdrawal::INT) AS fraud_rate FROM withdrawals JOIN atms USING (atm_id)
              WHERE withdrawals.timestamp < {TRAIN_END_SQL} GROUP BY 1),
    next_fraud AS (SELECT c.complaint_id, c.complaint_type,
                          date_diff('microsecond', c.filing_timestamp, min(w.timestamp)) / 86400000000.0::DOUBLE AS dd
                   FROM complaints c JOIN (SELECT city, timestamp FROM withdrawals JOIN atms USING (atm_id)
                                           WHERE is_fraud_withdrawal AND withdrawals.timestamp < {TRAIN_END_SQL}) w
                        ON c.victim_city = w.city AND w.timestamp >= c.filing_timestamp
                   WHERE c.filing_timestamp < {TRAIN_END_SQL} GROUP BY c.complaint_id, c.complaint_type, c.filing_timestamp),
    latency AS (SELECT complaint_type, quantile_cont(dd, 0.5) AS latency_days FROM next_fraud WHERE dd > 0 GROUP BY 1)"""

TOP_TYPE = """CASE WHEN t_phishing_7d = m THEN 'phishing' WHEN t_investment_fraud_7d = m THEN 'investment_fraud'
    WHEN t_job_fraud_7d = m THEN 'job_fraud' ELSE 'upi_fraud' END"""

MATRIX_CTES = f"""{CITY_CTES}, {MACHINE_CTES}, {HAWKES_CTES}, {LEARNED_CTES},
    wide AS (
        SELECT mf.*, a.bank_name, a.branch_name, a.city, a.district, a.state, a.pin, a.police_station_area, a.latitude,
               a.longitude, cf.* EXCLUDE (city, day), hawkes_intensity_24h,
               greatest(t_phishing_7d, t_investment_fraud_7d, t_job_fraud_7d, t_upi_fraud_7d) AS m,
               {HAVERSINE.format('latitude', 'longitude', 'clat', 'clon')} AS dist_to_complaint_centroid_km,
               {HAVERSINE.format('latitude', 'longitude', 'centre_lat', 'centre_lon')} AS dist_to_city_center_km,
               (isodow(mf.day) - 1) AS day_of_week, CASE WHEN isodow(mf.day) >= 6 THEN 1 ELSE 0 END AS is_weekend,
               mf.day - DATE '2024-01-01' AS days_since_epoch,
               CASE WHEN day(mf.day) IN (1, 5, 10, 15) THEN 1.0 ELSE 0.0 END AS is_salary_day,
               list_min(list_transform({fx.FESTIVALS!r}, lambda f: abs(mf.day - f::DATE))) AS days_to_festival
        FROM machine_f mf JOIN atms a ON mf.atm_id = a.atm_id JOIN city_f cf ON a.city = cf.city AND mf.day = cf.day
        JOIN hawkes_f hf ON a.city = hf.city AND mf.day = hf.day),
    matrix AS (
        SELECT w.*, exp(-greatest(dist_to_complaint_centroid_km, 0) / 5) AS complaint_decay_5km,
               CASE WHEN days_since_epoch % 3 = 0 THEN 1.0 ELSE 0.0 END AS cash_refill_cycle_flag,
               dist_to_complaint_centroid_km AS pin_corridor_dist_km,
               CASE WHEN t_upi_fraud_7d > 0 AND withdrawals_24h > 0 THEN 1.0 ELSE 0.0 END AS upi_to_atm_transition_flag,
               coalesce(fraud_rate, (SELECT avg(fraud_rate) FROM rates)) AS bank_fraud_rate_hist,
               coalesce(latency_days, (SELECT avg(latency_days) FROM latency)) AS med_fraud_latency_type_days,
               CASE WHEN EXISTS (SELECT 1 FROM wd WHERE wd.atm_id = w.atm_id AND wd.d = w.day AND is_fraud_withdrawal)
                    THEN 1 ELSE 0 END AS label
        FROM wide w LEFT JOIN rates ON w.bank_name = rates.bank_name LEFT JOIN latency ON latency.complaint_type = {TOP_TYPE})"""


def matrix_sql(select: str) -> str:
    return f"WITH {MATRIX_CTES} {select}"


@query("f01_atm_day_features", matrix_sql(f"""
    SELECT atm_id, {day('day')} AS day, city, bank_name, label, {', '.join(f'{r6(c)} AS {c}' for c in daily.FEATURES)}
    FROM matrix"""), VIEWS)
def _(t: Tables) -> DataFrame:
    return matrix(t).select("atm_id", "day", "city", "bank_name", "label", *daily.FEATURES)


@query("f01_city_features", f"""
    WITH {CITY_CTES} SELECT city, {day('day')} AS day, {r6('hours_since_last_complaint_city')} AS hours_since,
        n_complaints_city_24h, n_complaints_city_7d, n_complaints_district_24h, {r6('clat')} AS clat, {r6('clon')} AS clon,
        {r6('complaint_surge_velocity')} AS velocity FROM city_f""", VIEWS)
def _(t: Tables) -> DataFrame:
    first, last = span(t)
    features = daily.city_features(t.complaints, t.city_centres, first, last)
    return features.select(
        "city", F.to_date(daily.step_start(F.col("step"), 24)).alias("day"),
        F.col("hours_since_last_complaint_city").alias("hours_since"), "n_complaints_city_24h", "n_complaints_city_7d",
        "n_complaints_district_24h", "clat", "clon", F.col("complaint_surge_velocity").alias("velocity"),
    )


@query("f02_atm_day_label", f"""
    SELECT g.atm_id, {day('g.day')} AS day, CASE WHEN count(w.transaction_id) > 0 THEN 1 ELSE 0 END AS label
    FROM (SELECT atm_id, day FROM atms CROSS JOIN days) g LEFT JOIN withdrawals w
         ON w.atm_id = g.atm_id AND w.timestamp::DATE = g.day AND is_fraud_withdrawal GROUP BY 1, 2""",
    ("atms", "days", "withdrawals"))
def _(t: Tables) -> DataFrame:
    span = t.withdrawals.select(F.to_date("timestamp").alias("d"))
    return daily.atm_day_label(t.withdrawals, t.atms, span.agg(F.min("d")).scalar(), span.agg(F.max("d")).scalar())


@query("f03_six_hour_windows", f"""
    SELECT {ts('unnest(generate_series(a, b, INTERVAL 6 HOUR))')} AS window_start
    FROM (SELECT time_bucket(INTERVAL 6 HOUR, min(ts)) AS a, time_bucket(INTERVAL 6 HOUR, max(ts)) AS b FROM events)""",
    ("withdrawals",))
def _(t: Tables) -> DataFrame:
    return six_hour.six_hour_windows(t.complaints, t.withdrawals)


H6 = "INTERVAL 6 HOUR"
SIX_CTES = f"""
    steps AS (SELECT unnest(generate_series((SELECT time_bucket({H6}, min(ts)) FROM events),
                     (SELECT time_bucket({H6}, max(ts)) FROM events), {H6})) AS t),
    wd6 AS (SELECT *, time_bucket({H6}, withdrawals.timestamp) AS x FROM withdrawals),
    comp6 AS (SELECT *, time_bucket({H6}, filing_timestamp) AS x FROM complaints),
    named6 AS (SELECT linked_account_token AS account_token, time_bucket({H6}, min(filing_timestamp)) AS m FROM complaints
               WHERE linked_account_token IS NOT NULL GROUP BY 1),
    ma AS (SELECT g.atm_id, g.t, count(*) FILTER (x = g.t - {H6}) AS withdrawals_1h,
                  count(*) FILTER (x >= g.t - INTERVAL 12 HOUR) AS withdrawals_6h, count(x) AS withdrawals_24h,
                  coalesce(sum(amount::DECIMAL(18,2)) FILTER (x >= g.t - INTERVAL 12 HOUR), 0)::DOUBLE AS amount_sum_6h,
                  count(DISTINCT w.account_token) FILTER (x = g.t - {H6}) AS distinct_accounts_6h,
                  count(*) FILTER (x >= g.t - INTERVAL 12 HOUR AND m < g.t) AS linked6, count(*) FILTER (hour(x) = 0) AS night
           FROM (SELECT atm_id, t FROM atms CROSS JOIN steps) g
           LEFT JOIN wd6 w ON w.atm_id = g.atm_id AND x >= g.t - INTERVAL 30 HOUR AND x < g.t
           LEFT JOIN named6 ON named6.account_token = w.account_token GROUP BY 1, 2),
    ca AS (SELECT g.city, g.t, count(*) FILTER (x >= g.t - INTERVAL 12 HOUR) AS n_complaints_city_6h,
                  count(*) FILTER (x >= g.t - INTERVAL 30 HOUR) AS n_complaints_city_24h,
                  {', '.join(f"count(*) FILTER (complaint_type = '{k}') AS t_{k}_7d" for k in FEATURE_TYPES)}
           FROM (SELECT city, t FROM places CROSS JOIN steps) g
           LEFT JOIN comp6 c ON c.victim_city = g.city AND x >= g.t - INTERVAL 168 HOUR AND x < g.t GROUP BY 1, 2),
    cl AS (SELECT g.city, g.t, max(filing_timestamp) AS newest FROM (SELECT city, t FROM places CROSS JOIN steps) g
           JOIN comp6 c ON c.victim_city = g.city AND x < g.t GROUP BY 1, 2),
    cv AS (SELECT ca.*, coalesce(date_diff('microsecond', newest, ca.t) / 3600000000.0::DOUBLE, 8784.0)
                      AS hours_since_last_complaint_city,
                  coalesce((n_complaints_city_6h - lag(n_complaints_city_24h) OVER k)::DOUBLE
                      / greatest(lag(n_complaints_city_24h) OVER k, 1), 0) AS complaint_surge_velocity
           FROM ca LEFT JOIN cl ON ca.city = cl.city AND ca.t = cl.t WINDOW k AS (PARTITION BY ca.city ORDER BY ca.t)),
    six AS (SELECT ma.*, cv.* EXCLUDE (city, t), a.city, a.bank_name,
                   {HAVERSINE.format('latitude', 'longitude', 'centre_lat', 'centre_lon')} AS dist,
                   greatest(t_phishing_7d, t_investment_fraud_7d, t_job_fraud_7d, t_upi_fraud_7d) AS m,
                   (ma.t::DATE - DATE '2024-01-01') + hour(ma.t) / 24.0::DOUBLE AS epoch
            FROM ma JOIN atms a ON ma.atm_id = a.atm_id JOIN cv ON a.city = cv.city AND ma.t = cv.t
            JOIN places p ON p.city = a.city)"""
SIX_COLUMNS = {
    "linked_proportion_6h": "CASE WHEN withdrawals_6h > 0 THEN linked6::DOUBLE / withdrawals_6h ELSE 0 END",
    "fund_velocity_6h": "amount_sum_6h / 6",
    "activity_spike_flag_6h": "CASE WHEN withdrawals_1h >= 3 AND withdrawals_1h >= 2.0 * withdrawals_6h / 6 THEN 1 ELSE 0 END",
    "night_ratio_6h": "CASE WHEN withdrawals_24h > 0 THEN night::DOUBLE / withdrawals_24h ELSE 0 END",
    "complaint_decay_5km": "exp(-greatest(dist, 0) / 5)",
    "cash_refill_cycle_flag": "CASE WHEN (epoch % 3) / 3 < 0.08 THEN 1 ELSE 0 END",
    "med_fraud_latency_type_days": "coalesce(latency_days, (SELECT avg(latency_days) FROM latency))",
    "mule_reuse_count_7d": "0", "prior_alert_fraud_flag": "0", "hawkes_intensity_24h": "0",
    "pin_corridor_dist_km": "dist", "dist_to_complaint_centroid_km": "dist", "dist_to_city_center_km": "dist",
    "is_salary_day": "CASE WHEN day(t) IN (1, 5, 10, 15) THEN 1 ELSE 0 END",
    "days_to_festival": f"list_min(list_transform({fx.FESTIVALS!r}, lambda f: abs(t::DATE - f::DATE)))",
    "upi_to_atm_transition_flag": "CASE WHEN t_upi_fraud_7d > 0 AND withdrawals_24h > 0 THEN 1 ELSE 0 END",
    "bank_fraud_rate_hist": "coalesce(fraud_rate, (SELECT avg(fraud_rate) FROM rates))",
    "day_of_week": "isodow(t) - 1", "is_weekend": "CASE WHEN isodow(t) >= 6 THEN 1 ELSE 0 END", "days_since_epoch": "epoch",
}


@query("f04_atm_6h_features", f"""
    WITH {SIX_CTES}, {LEARNED_CTES}
    SELECT atm_id, {ts('t')} AS window_start, {', '.join(f'{r6(SIX_COLUMNS.get(c, c))} AS {c}' for c in six_hour.FEATURES)}
    FROM six LEFT JOIN rates ON six.bank_name = rates.bank_name LEFT JOIN latency ON latency.complaint_type = {TOP_TYPE}""",
    VIEWS)
def _(t: Tables) -> DataFrame:
    lookup = learned(t, only=("latency", "bank_rate"))
    features = six_hour.atm_6h_features(t.complaints, t.withdrawals, t.atms, t.city_centres, lookup)
    return features.select("atm_id", "window_start", *six_hour.FEATURES)


@query("f05_atm_6h_label", f"""
    WITH {SIX_CTES} SELECT g.atm_id, {ts('g.t')} AS window_start, CASE WHEN count(x) > 0 THEN 1 ELSE 0 END AS label
    FROM (SELECT atm_id, t FROM atms CROSS JOIN steps) g
    LEFT JOIN wd6 ON wd6.atm_id = g.atm_id AND x = g.t AND is_fraud_withdrawal GROUP BY 1, 2, g.t""", VIEWS)
def _(t: Tables) -> DataFrame:
    first, last = data_span(t.complaints, t.withdrawals, 6)
    return six_hour.atm_6h_label(t.withdrawals, t.atms, first, last)


H1 = "INTERVAL 1 HOUR"
HOUR_CTES = f"""
    steps AS (SELECT unnest(generate_series((SELECT min(ts)::DATE::TIMESTAMP FROM events),
                     (SELECT max(ts)::DATE::TIMESTAMP + INTERVAL 23 HOUR FROM events), {H1})) AS t),
    named AS (SELECT linked_account_token AS account_token, date_trunc('hour', min(filing_timestamp)) AS m FROM complaints
              WHERE linked_account_token IS NOT NULL GROUP BY 1),
    ah AS (SELECT atm_id, date_trunc('hour', withdrawals.timestamp) AS x, account_token, any_value(m) AS m, count(*) AS n,
                  sum(amount::DECIMAL(18,2)) AS s, count(*) FILTER (is_fraud_withdrawal) AS f
           FROM withdrawals LEFT JOIN named USING (account_token) GROUP BY 1, 2, 3),
    ma AS (SELECT g.atm_id, g.t, coalesce(sum(n) FILTER (x = g.t - {H1}), 0)::DOUBLE AS w1,
                  coalesce(sum(n) FILTER (x >= g.t - INTERVAL 6 HOUR), 0)::DOUBLE AS w6, coalesce(sum(n), 0)::DOUBLE AS w24,
                  coalesce(sum(s), 0)::DOUBLE AS a24, count(x)::DOUBLE AS nacc,
                  coalesce(sum(n) FILTER (m < g.t), 0)::DOUBLE AS lnk
           FROM (SELECT atm_id, t FROM atms CROSS JOIN steps) g
           LEFT JOIN ah ON ah.atm_id = g.atm_id AND x >= g.t - INTERVAL 24 HOUR AND x < g.t GROUP BY 1, 2),
    ca AS (SELECT g.city, g.t, count(*) FILTER (filing_timestamp >= g.t - INTERVAL 24 HOUR) AS c24, count(complaint_id) AS c7
           FROM (SELECT city, t FROM places CROSS JOIN steps) g LEFT JOIN complaints c
           ON c.victim_city = g.city AND filing_timestamp >= g.t - INTERVAL 168 HOUR AND filing_timestamp < g.t GROUP BY 1, 2)"""


def _hour_bounds(t: Tables):
    span = t.raw("events").select(F.to_date("ts").alias("d"))
    first, last = span.agg(F.min("d")).scalar(), span.agg(F.max("d")).scalar()
    return hourly.hour_number(first), hourly.hour_number(last) + 23


@query("f06_atm_hour_features", f"""
    WITH {HOUR_CTES} SELECT ma.atm_id, {ts('ma.t')} AS hour, w1 AS withdrawals_1h, w6 AS withdrawals_6h,
        w24 AS withdrawals_24h, a24 AS amount_sum_24h, {r6('a24 / greatest(w24, 1)')} AS amount_mean_24h,
        nacc AS distinct_accounts_24h, nacc AS counterparty_count_24h, {r6('lnk / greatest(nacc, 1)')} AS linked_proportion_24h,
        {r6('w24 / 24')} AS transaction_frequency_24h, c24::DOUBLE AS n_complaints_city_24h, c7::DOUBLE AS n_complaints_city_7d,
        hour(ma.t)::DOUBLE AS hour_of_day, CASE WHEN hour(ma.t) >= 19 OR hour(ma.t) < 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_night
    FROM ma JOIN atms USING (atm_id) JOIN ca ON ca.city = atms.city AND ca.t = ma.t""", VIEWS)
def _(t: Tables) -> DataFrame:
    first, last = _hour_bounds(t)
    features = hourly.atm_hour_features(t.complaints, t.withdrawals, t.atms, t.city_centres, first, last)
    return features.drop("label")


@query("f07_atm_hour_label", f"""
    WITH {HOUR_CTES} SELECT g.atm_id, {ts('g.t')} AS hour, CASE WHEN count(x) > 0 THEN 1 ELSE 0 END AS label
    FROM (SELECT atm_id, t FROM atms CROSS JOIN steps) g
    LEFT JOIN ah ON ah.atm_id = g.atm_id AND x >= g.t AND x < g.t + INTERVAL 24 HOUR AND f > 0 GROUP BY 1, 2, g.t""", VIEWS)
def _(t: Tables) -> DataFrame:
    return hourly.atm_hour_label(t.withdrawals, t.atms, *_hour_bounds(t))


@query("f08_enrich", f"""
    WITH x AS (SELECT c.complaint_id, victim_city, linked_account_token, filing_timestamp::DATE AS day,
                      round(amount_lost * 100)::BIGINT AS cents,
                      date_diff('microsecond', c.filing_timestamp, min(w.timestamp)) / 3600000000.0::DOUBLE AS h
               FROM complaints c LEFT JOIN withdrawals w ON w.account_token = c.linked_account_token
                    AND w.timestamp >= c.filing_timestamp
               GROUP BY c.complaint_id, victim_city, linked_account_token, filing_timestamp, amount_lost),
    surge AS (SELECT victim_city, day, n / greatest(coalesce(avg(n) OVER (PARTITION BY victim_city ORDER BY day
                     ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), n), CASE WHEN row_number() OVER (PARTITION BY victim_city
                     ORDER BY day) = 1 THEN n ELSE 1 END) AS r
              FROM (SELECT victim_city, day, count(*) AS n FROM x GROUP BY 1, 2)),
    spread AS (SELECT linked_account_token, count(DISTINCT victim_city)::DOUBLE AS s FROM x GROUP BY 1),
    cluster AS (SELECT a.complaint_id, count(*)::DOUBLE AS k FROM x a JOIN x b ON a.victim_city = b.victim_city AND a.day = b.day
                AND abs(a.cents - b.cents) * 10 <= greatest(abs(a.cents), 100) GROUP BY 1)
    SELECT x.complaint_id, {r6('r')} AS complaint_surge_ratio,
           CASE WHEN x.linked_account_token IS NULL THEN 0.0::DOUBLE ELSE s END AS cross_city_mule_spread,
           {r6('CASE WHEN h BETWEEN 0 AND 168 THEN h ELSE (SELECT avg(h) FROM x WHERE h BETWEEN 0 AND 168) END')}
               AS time_to_withdrawal_hist, 0.0::DOUBLE AS atm_cold_start_flag, k AS complaint_amount_cluster
    FROM x JOIN surge USING (victim_city, day) JOIN cluster ON cluster.complaint_id = x.complaint_id
    LEFT JOIN spread ON spread.linked_account_token = x.linked_account_token""", ("complaints", "withdrawals"))
def _(t: Tables) -> DataFrame:
    left = t.complaints.select(
        "complaint_id", "victim_city", "linked_account_token", "amount_lost", "filing_timestamp",
        F.to_date("filing_timestamp").alias("day"),
    )
    right = t.withdrawals.select(F.col("account_token").alias("linked_account_token"), "timestamp")
    frame = asof_forward(left, right, ["linked_account_token"], "filing_timestamp", "timestamp", "withdrawal_timestamp")
    return enrich.enrich(frame).select(
        "complaint_id", "complaint_surge_ratio", "cross_city_mule_spread", "time_to_withdrawal_hist",
        "atm_cold_start_flag", "complaint_amount_cluster",
    )


@query("f09_hawkes_fit", f"""
    WITH {CITY_CTES}, {HAWKES_CTES} SELECT city, {r6('mu')} AS mu, {r6('alpha')} AS alpha, {r6('beta')} AS beta FROM hp""", VIEWS)
def _(t: Tables) -> DataFrame:
    return learned(t, only=("hawkes",)).hawkes


@query("f10_hawkes_intensity", f"""
    WITH {CITY_CTES}, {HAWKES_CTES} SELECT city, {day('day')} AS day, {r6('hawkes_intensity_24h')} AS hawkes_intensity_24h
    FROM hawkes_f""", VIEWS)
def _(t: Tables) -> DataFrame:
    first, last = span(t)
    dense = city_steps(t.complaints, t.city_centres, first, last, 24)
    return hawkes.hawkes_intensity(dense, learned(t, only=("hawkes",)).hawkes).select(
        "city", F.to_date(daily.step_start(F.col("step"), 24)).alias("day"), "hawkes_intensity_24h"
    )


EMERGING = """round(round(least(0.4 * (least(n_complaints_city_24h / greatest(n_complaints_city_7d / 7.0, 1.0), 2.0) / 2.0)
    + 0.35 * least(counterparty_count_24h / greatest(distinct_accounts_24h::DOUBLE, 1.0), 1.0)
    + 0.25 * (least(withdrawals_6h / greatest(withdrawals_24h / 4.0, 1.0), 2.0) / 2.0), 1.0), 10), 4)"""
# A transparent risk score: the emerging-risk signal and past fraud at the machine, equally weighted.
TRANSPARENT = f"round(round(0.5 * ({EMERGING}) + 0.5 * least(fraud_decay_7d, 1.0), 10), 4)"


def transparent_scores(t: Tables, **days_of) -> DataFrame:
    # The score reads none of the features that are looked up.
    features = matrix(t, (), **days_of)
    columns = {c: F.col(c) for c in daily.FEATURES}
    score = fx.rounded(0.5 * fx.emerging_risk(columns) + 0.5 * F.least(F.col("fraud_decay_7d"), F.lit(1.0)))
    return features.withColumn("risk_score", score)


@query("b24_hotspots_by_features", matrix_sql(f"""
    SELECT atm_id, {day('day')} AS day, city, {r6(TRANSPARENT)} AS risk_score FROM matrix
    WHERE day = (SELECT max(day) FROM days) ORDER BY risk_score DESC, atm_id LIMIT 20"""), VIEWS)
def _(t: Tables) -> DataFrame:
    last = F.lit(t.raw("events").agg(F.max(F.to_date("ts"))).first()[0])
    today = transparent_scores(t, first_day=last, last_day=last)
    return hotspots(today, 20).select("atm_id", "day", "city", "risk_score")


@query("g10_emerging_risk", matrix_sql(f"SELECT atm_id, {day('day')} AS day, {r6(EMERGING)} AS emerging_risk FROM matrix"), VIEWS)
def _(t: Tables) -> DataFrame:
    columns = {c: F.col(c) for c in daily.FEATURES}
    return matrix(t).select("atm_id", "day", fx.emerging_risk(columns).alias("emerging_risk"))


@query("g11_intervention_priority", matrix_sql(f"""
    SELECT atm_id, {day('day')} AS day, {r6(f'''round(round((0.40 * p + 0.25 * least(amount_sum_24h / 1000000.0, 1.0) + 0.15 * ({EMERGING})
        + 0.20 * least(1.0, 0.25 + 0.25 * least(counterparty_count_24h / 8.0, 1.0) + 0.25 * linked_proportion_24h
                       + 0.25 * least(n_complaints_city_24h / 40.0, 1.0)))
        * CASE WHEN p >= 0.8 THEN 1.0 WHEN p >= 0.7 THEN 0.7 ELSE 0.4 END, 10), 4)''')} AS intervention_priority
    FROM matrix JOIN (SELECT atm_id, day, score AS p FROM scores) USING (atm_id, day)"""), (*VIEWS, "scores"))
def _(t: Tables) -> DataFrame:
    columns = {c: F.col(c) for c in daily.FEATURES}
    scored = matrix(t).drop("label").join(t.scores.select("atm_id", "day", "score"), ["atm_id", "day"])
    return scored.select("atm_id", "day", fx.intervention_priority(columns, F.col("score")).alias("intervention_priority"))


@query("f01_day_from_summary", matrix_sql(
    f"SELECT atm_id, {day('day')} AS day, {', '.join(f'{r6(c)} AS {c}' for c in daily.FEATURES)}, label FROM matrix WHERE day = (SELECT max(day) FROM days)"), VIEWS)
def _(t: Tables) -> DataFrame:
    """The last day from the kept summary, which is filled in two deliveries that overlap by two days."""
    last = t.raw("events").agg(F.max(F.to_date("ts"))).first()[0]
    kept = DailySummary(t.spark, f"{stream_folder(t.spark)}/summary")
    drawn = F.to_date("timestamp")
    kept.add(t.withdrawals.where(drawn < F.date_sub(F.lit(last), 3)))
    kept.add(t.withdrawals.where(drawn >= F.date_sub(F.lit(last), 5)))
    days = span(t)
    return kept.day_features(last, t.complaints, t.atms, t.city_centres, learned(t, days), days).select("atm_id", "day", *daily.FEATURES, "label")
