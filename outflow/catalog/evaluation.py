"""Metrics, evaluation studies, drift and fairness on the deterministic score of every machine and day."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outflow.catalog.features import MATRIX_CTES, VIEWS, matrix, matrix_sql
from outflow.catalog.joins_windows import HAVERSINE
from outflow.catalog.registry import day, money, query, r4, r6
from outflow.functions import scalar as fx
from outflow.operators import drift, fairness, metrics
from outflow.plans import daily, simulation, splits
from outflow.session import durable
from outflow.sources.views import Tables
from outflow.streaming.jobs import stream_folder

TIE = ["atm_id", "day"]
SPLIT = date(2024, 1, 22)
SPLIT_SQL = "DATE '2024-01-22'"

AUC = """(sum(CASE WHEN label = 1 THEN mid END) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0)
    / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0))"""


def mid_rank(value: str, part: str = "") -> str:
    by = f"PARTITION BY {part}" if part else ""
    both = f"PARTITION BY {part}, {value}" if part else f"PARTITION BY {value}"
    return f"rank() OVER ({by} ORDER BY {value}) + (count(*) OVER ({both}) - 1) / 2.0"


def auc_sql(table: str, value: str = "score") -> str:
    return f"(SELECT {AUC} FROM (SELECT label, {mid_rank(value)} AS mid FROM {table}))"


def ap_sql(table: str) -> str:
    return f"""(SELECT sum(pos / total * tp / n) FROM (
        SELECT pos::DOUBLE AS pos, sum(pos) OVER () AS total, sum(pos) OVER w AS tp, sum(c) OVER w AS n FROM (
            SELECT score, sum(label) AS pos, count(*) AS c FROM {table} GROUP BY 1) WINDOW w AS (ORDER BY score DESC)))"""


@query("g01_chrono_split", f"""
    WITH d AS (SELECT day, row_number() OVER (ORDER BY day) AS p, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM scores)),
    c AS (SELECT *, floor(0.7 * n) AS cut, greatest(floor(0.15 * floor(0.7 * n)), 2) AS v FROM d)
    SELECT atm_id, {day('s.day')} AS day, CASE WHEN p > cut THEN 'test' WHEN p > cut - v THEN 'val' ELSE 'train' END AS split
    FROM scores s JOIN c ON s.day = c.day""", ("scores",))
def _(t: Tables) -> DataFrame:
    return splits.chrono_split(t.scores, "day").select("atm_id", "day", "split")


@query("g04_rank_ensemble", f"""
    SELECT atm_id, {day('day')} AS day, {r6(f"0.5 * ({mid_rank('score')}) / count(*) OVER () + 0.5 * ({mid_rank('other')}) / count(*) OVER ()")} AS ensemble
    FROM (SELECT *, round(1 - score * score, 3) AS other FROM scores)""", ("scores",))
def _(t: Tables) -> DataFrame:
    second = t.scores.withColumn("other", F.round(1 - F.col("score") * F.col("score"), 3))
    return splits.rank_ensemble(second, "score", "other").select("atm_id", "day", "ensemble")


@query("g06_select_active", f"""
    SELECT 'a' AS candidate, {r6(auc_sql('scores'))} AS auc
    WHERE {auc_sql('scores')} >= {auc_sql('(SELECT label, 1 - score AS score FROM scores)')}
    UNION ALL SELECT 'b', {r6(auc_sql('(SELECT label, 1 - score AS score FROM scores)'))}
    WHERE {auc_sql('scores')} < {auc_sql('(SELECT label, 1 - score AS score FROM scores)')}""", ("scores",))
def _(t: Tables) -> DataFrame:
    both = t.scores.withColumns({"a": F.col("score"), "b": 1 - F.col("score")})
    return splits.select_active(both, ["a", "b"])


@query("g12_roc_auc", f"SELECT {r6(auc_sql('scores'))} AS roc_auc", ("scores",))
def _(t: Tables) -> DataFrame:
    return metrics.roc_auc(t.scores)


@query("g13_pr_auc", f"SELECT {r6(ap_sql('scores'))} AS pr_auc", ("scores",))
def _(t: Tables) -> DataFrame:
    return metrics.pr_auc(t.scores)


RANKED = "(SELECT *, row_number() OVER (ORDER BY score DESC, atm_id, day) AS rk FROM scores)"


@query("g14_precision_recall_at_k", f"""
    SELECT k, {r4('avg(label)')} AS precision, {r4('sum(label) / (SELECT sum(label) FROM scores)')} AS recall
    FROM {RANKED} JOIN (SELECT unnest([20, 50, 100, 200, 500, 1000]) AS k) ON rk <= k GROUP BY k""", ("scores",))
def _(t: Tables) -> DataFrame:
    return metrics.precision_recall_at(t.scores, metrics.PRECISION_RANKS, TIE)


PRF = f"""
    SELECT threshold, alerts, {r4('tp / greatest(alerts, 1)')} AS precision, {r4('tp / greatest(p, 1)')} AS recall,
           {r4('CASE WHEN tp > 0 THEN 2.0 * tp / (alerts + p) ELSE 0 END')} AS f1, (alerts - tp)::BIGINT AS false_alerts,
           {r4('(alerts - tp) / greatest(alerts, 1)')} AS false_alert_rate, total
    FROM (SELECT threshold, count(*) FILTER (score >= threshold) AS alerts,
                 count(*) FILTER (score >= threshold AND label = 1) AS tp, sum(label) AS p, count(*) AS total
          FROM scores, (SELECT unnest({{0}})::DOUBLE AS threshold) GROUP BY 1)"""


@query("g15_prf_at", f"SELECT * EXCLUDE (total) FROM ({PRF.format([0.5, 0.6, 0.7, 0.85])})", ("scores",))
def _(t: Tables) -> DataFrame:
    return metrics.prf_at(t.scores, [0.5, 0.6, 0.7, 0.85])


@query("g16_brier", f"SELECT {r6('avg(power(score - label, 2))')} AS brier FROM scores", ("scores",))
def _(t: Tables) -> DataFrame:
    return metrics.brier(t.scores)


@query("g16_accuracy", f"SELECT {r6('avg(((score >= 0.5)::INT = label)::INT)')} AS accuracy FROM scores", ("scores",))
def _(t: Tables) -> DataFrame:
    return metrics.accuracy(t.scores)


BINS = "SELECT least(floor(score * 10)::INT, 9) AS bin, count(*) AS n, avg(score) AS m, avg(label) AS o FROM scores GROUP BY 1"


@query("g17_ece10", f"SELECT {r6('sum(n * abs(m - o)) / sum(n)')} AS ece FROM ({BINS})", ("scores",))
def _(t: Tables) -> DataFrame:
    return metrics.ece10(t.scores)


@query("g17_ece10_closed_bins", f"""
    SELECT {r6('sum(n * abs(m - o)) / (SELECT count(*) FROM scores)')} AS ece FROM (
        SELECT lo, count(*) AS n, avg(score) AS m, avg(label) AS o FROM scores, (SELECT unnest(range(10)) AS lo)
        WHERE score * 10 >= lo AND score * 10 <= lo + 1 GROUP BY 1)""", ("scores",))
def _(t: Tables) -> DataFrame:
    return metrics.ece10(t.scores, "closed")


@query("g18_calibration_curve", f"SELECT {r6('(bin + 0.5) / 10')} AS centre, {r6('o')} AS observed, n FROM ({BINS}) WHERE n >= 5", ("scores",))
def _(t: Tables) -> DataFrame:
    return metrics.calibration_curve(t.scores)


@query("g19_confusion", "SELECT (score >= 0.5)::INT AS predicted, label, count(*) AS n FROM scores GROUP BY 1, 2", ("scores",))
def _(t: Tables) -> DataFrame:
    return metrics.confusion(t.scores)


def _prf_columns() -> str:
    parts = ["alerts", "precision", "recall", "f1", "false_alert_rate"]
    return ", ".join(
        f"max({p}) FILTER (threshold = {v}) AS {p}_at_{n}"
        for n, v in {"0p50": 0.5, "0p60": 0.6, "0p70": 0.7, "0p85": 0.85}.items() for p in parts
    )


@query("g20_metric_block", f"""
    SELECT b.*, k.*, p.* FROM
    (SELECT count(*) AS rows, {r4('avg(((score >= 0.5)::INT = label)::INT)')} AS accuracy, {r4(auc_sql('scores'))} AS roc_auc FROM scores) b,
    (SELECT {', '.join(f"{r4(f'avg(label) FILTER (rk <= {k})')} AS precision_at_{k}" for k in metrics.PRECISION_RANKS)},
            {', '.join(f"{r4(f'sum(label) FILTER (rk <= {k}) / sum(label)')} AS recall_at_{k}" for k in metrics.RECALL_RANKS)} FROM {RANKED}) k,
    (SELECT {_prf_columns()} FROM ({PRF.format([0.5, 0.6, 0.7, 0.85])})) p""", ("scores",))
def _(t: Tables) -> DataFrame:
    return metrics.metric_block(t.scores, TIE)


@query("g20_std_block", f"""
    SELECT {r4('avg(label) FILTER (score >= 0.7)')} AS threshold_precision_0p7, count(*) FILTER (score >= 0.7) AS alert_volume_0p7,
           {r4('avg(1 - label) FILTER (score >= 0.7)')} AS false_alert_rate_0p7, {r4('avg(power(score - label, 2))')} AS brier,
           {r4(auc_sql('scores'))} AS roc_auc, {r4(ap_sql('scores'))} AS pr_auc,
           {', '.join(f"{r4(f'avg(label) FILTER (rk <= {k})')} AS precision_at_{k}" for k in (100, 500, 1000))},
           {r4('sum(label) FILTER (rk <= 1000) / sum(label)')} AS capture_rate_top1000 FROM {RANKED}""", ("scores",))
def _(t: Tables) -> DataFrame:
    return metrics.std_block(t.scores, TIE)


@query("g21_threshold_curve", f"""
    SELECT threshold, alerts AS alert_volume, {r4('alerts / total')} AS alert_rate, precision, recall, false_alerts, false_alert_rate,
           CASE WHEN threshold < 0.7 THEN 'monitor' WHEN threshold < 0.85 THEN 'action' ELSE 'dispatch' END AS tier_hint
    FROM ({PRF.format(metrics.CURVE_THRESHOLDS)})""", ("scores",))
def _(t: Tables) -> DataFrame:
    return metrics.threshold_curve(t.scores)


@query("g22_youden_threshold", f"""
    WITH b AS (SELECT min(score) AS a, max(score) AS z FROM scores),
    g AS (SELECT i, CASE WHEN i = 100 THEN z ELSE a + i * ((z - a) / 100) END AS t FROM b, (SELECT unnest(range(101)) AS i)),
    j AS (SELECT i, t, round(count(*) FILTER (score >= t AND label = 1)::DOUBLE / sum(label)
                 + count(*) FILTER (score < t AND label = 0)::DOUBLE / count(*) FILTER (label = 0) - 1, 12) AS j
          FROM scores, g GROUP BY 1, 2)
    SELECT {r6('t')} AS threshold, {r6('j')} AS youden_j FROM j ORDER BY j DESC, i LIMIT 1""", ("scores",))
def _(t: Tables) -> DataFrame:
    return metrics.youden_threshold(t.scores)


CHECKED = daily.FEATURES


@query("g23_per_feature_auc", matrix_sql(f"""
    SELECT feature, {r6('auc')} AS auc, {r6('abs(2 * (auc - 0.5))')} AS strength FROM (
        SELECT feature, CASE WHEN count(DISTINCT value) > 1 THEN {r4(AUC)} END AS auc FROM (
            SELECT feature, label, value, {mid_rank('value', 'feature')} AS mid FROM (
                {' UNION ALL '.join(f"SELECT '{c}' AS feature, label, round({c}::DOUBLE, 9) AS value FROM matrix" for c in CHECKED)}))
        GROUP BY 1)"""), VIEWS)
def _(t: Tables) -> DataFrame:
    # Nine places keep values tied that differ only by the order of addition.
    features = matrix(t).select("label", *[F.round(c, 9).alias(c) for c in CHECKED])
    return metrics.per_feature_auc(features, CHECKED)


@query("g24_baseline_scores", matrix_sql(f"""
    SELECT m.atm_id, {day('m.day')} AS day, n_complaints_city_7d::DOUBLE AS complaint_volume, withdrawals_24h::DOUBLE AS withdrawal_volume,
           {r6('n_complaints_city_7d / (1 + dist_to_complaint_centroid_km)')} AS proximity, coalesce(h, 0) AS historical_hotspot,
           {r6('coalesce(s.score, 0)')} AS persistence
    FROM matrix m LEFT JOIN (SELECT atm_id, count(*) AS h FROM withdrawals WHERE is_fraud_withdrawal
                             AND timestamp::DATE < {SPLIT_SQL} GROUP BY 1) f ON m.atm_id = f.atm_id
    LEFT JOIN scores s ON s.atm_id = m.atm_id AND s.day = m.day - 1"""), (*VIEWS, "scores"))
def _(t: Tables) -> DataFrame:
    train_fraud = t.withdrawals.where(F.col("is_fraud_withdrawal") & (F.to_date("timestamp") < F.lit(SPLIT)))
    return metrics.baseline_scores(matrix(t), train_fraud, t.scores).select(
        "atm_id", "day", "complaint_volume", "withdrawal_volume", "proximity", "historical_hotspot", "persistence"
    )


@query("g25_lift", f"""
    SELECT atm_id, CASE WHEN b > 0 THEN {r6('round(round(a / b, 10), 3)')} END AS lift FROM (
        SELECT atm_id, avg(score) AS a, avg(label) AS b FROM scores GROUP BY 1)""", ("scores",))
def _(t: Tables) -> DataFrame:
    rates = t.scores.groupBy("atm_id").agg(F.avg("score").alias("a"), F.avg("label").alias("b"))
    return rates.select("atm_id", metrics.lift(F.col("a"), F.col("b")).alias("lift"))


@query("g26_exposure_top_k", f"""
    SELECT count(*) AS events, {money('amount')} AS exposure_inr FROM {RANKED} s JOIN withdrawals w ON s.atm_id = w.atm_id
    AND is_fraud_withdrawal AND w.timestamp >= s.day AND w.timestamp <= s.day::TIMESTAMP + INTERVAL 24 HOUR WHERE rk <= 1000""",
    ("scores", "withdrawals"))
def _(t: Tables) -> DataFrame:
    return metrics.exposure_top_k(t.scores, t.withdrawals, 1000)


@query("g27_lead_time", f"""
    SELECT count(*) AS n, {r6('quantile_cont(h, 0.25)')} AS p25, {r6('quantile_cont(h, 0.5)')} AS median, {r6('quantile_cont(h, 0.75)')} AS p75
    FROM (SELECT date_diff('microsecond', s.day::TIMESTAMP, min(w.timestamp)) / 3600000000.0::DOUBLE AS h
          FROM scores s JOIN withdrawals w ON s.atm_id = w.atm_id AND w.timestamp::DATE = s.day AND is_fraud_withdrawal
          WHERE label = 1 AND score >= 0.5 GROUP BY s.atm_id, s.day)""", ("scores", "withdrawals"))
def _(t: Tables) -> DataFrame:
    return metrics.lead_time(t.scores, t.withdrawals)


@query("g28_horizon_eval", f"""
    WITH e AS (SELECT s.atm_id, s.day, s.score, h, CASE WHEN min(w.timestamp) < s.day::TIMESTAMP + to_hours(h) THEN 1 ELSE 0 END AS label
               FROM scores s CROSS JOIN (SELECT unnest({metrics.HORIZONS}) AS h) LEFT JOIN withdrawals w
                    ON s.atm_id = w.atm_id AND is_fraud_withdrawal AND w.timestamp > s.day GROUP BY 1, 2, 3, 4),
    auc AS (SELECT h, {AUC} AS auc FROM (SELECT h, label, {mid_rank('score', 'h')} AS mid FROM e) GROUP BY 1),
    ap AS (SELECT h, sum(pos / total * tp / n) AS ap FROM (
               SELECT h, pos::DOUBLE AS pos, sum(pos) OVER (PARTITION BY h) AS total, sum(pos) OVER w AS tp, sum(c) OVER w AS n
               FROM (SELECT h, score, sum(label) AS pos, count(*) AS c FROM e GROUP BY 1, 2)
               WINDOW w AS (PARTITION BY h ORDER BY score DESC)) GROUP BY 1),
    top AS (SELECT h, {r4('avg(label)')} AS pk, sum(label) AS hits FROM (
                SELECT *, row_number() OVER (PARTITION BY h ORDER BY score DESC, atm_id, day) AS rk FROM e) WHERE rk <= 1000 GROUP BY 1)
    SELECT h AS horizon_hours, {r4('avg(label)')} AS horizon_event_rate, {r4('any_value(auc)')} AS roc_auc, {r4('any_value(ap)')} AS pr_auc,
           {r4('avg(power(score - label, 2))')} AS brier, any_value(pk) AS precision_at_k,
           {r4('any_value(hits) / greatest(sum(label), 1)')} AS capture_rate,
           CASE WHEN any_value(pk) >= 0.7 THEN 'HIGH' WHEN any_value(pk) >= 0.45 THEN 'MEDIUM' ELSE '{fx.CONFIDENCE_HOLD}' END AS confidence
    FROM e JOIN auc USING (h) JOIN ap USING (h) JOIN top USING (h) GROUP BY h""", ("scores", "withdrawals"))
def _(t: Tables) -> DataFrame:
    return metrics.horizon_eval(t.scores, t.withdrawals)


@query("g30_holdout_membership", f"""
    WITH v AS (SELECT atm_id, row_number() OVER (ORDER BY count(*) DESC, atm_id) AS p FROM withdrawals
               WHERE withdrawals.timestamp < {SPLIT_SQL} GROUP BY 1),
    hot AS (SELECT atm_id FROM v WHERE p <= floor(0.2 * (SELECT count(*) FROM v))),
    x AS (SELECT s.atm_id, s.day, city, district, s.day < {SPLIT_SQL} AS past, s.atm_id IN (SELECT atm_id FROM hot) AS held_hot
          FROM scores s JOIN atms USING (atm_id))
    SELECT 'time_forward' AS study, count(*) FILTER (past) AS train, count(*) FILTER (NOT past) AS test FROM x
    UNION ALL SELECT 'cold_city', count(*) FILTER (past AND city <> 'NATION_3'), count(*) FILTER (NOT past AND city = 'NATION_3') FROM x
    UNION ALL SELECT 'cold_district', count(*) FILTER (past AND district <> 'D1'), count(*) FILTER (NOT past AND district = 'D1') FROM x
    UNION ALL SELECT 'new_hotspot', count(*) FILTER (past AND NOT held_hot), count(*) FILTER (NOT past AND held_hot) FROM x""",
    ("scores", "withdrawals", "atms"))
def _(t: Tables) -> DataFrame:
    rows = t.scores.join(t.atms.select("atm_id", "city", "district"), "atm_id")
    studies = {
        "time_forward": splits.time_forward(rows, SPLIT),
        "cold_city": splits.cold_value(rows, "city", "NATION_3", SPLIT),
        "cold_district": splits.cold_value(rows, "district", "D1", SPLIT),
        "new_hotspot": splits.new_hotspot(rows, t.withdrawals, SPLIT),
    }
    return splits.membership_counts(studies)


@query("g35_disagreement", f"""
    SELECT count(*) FILTER (g > 0.35) AS hold, count(*) FILTER (g > 0.20 AND g <= 0.35) AS downgrade,
           {r4('quantile_cont(g, 0.5)')} AS median_abs_disagreement, {r4('quantile_cont(g, 0.95)')} AS p95_abs_disagreement
    FROM (SELECT abs(score - round(score * score, 6)) AS g FROM scores)""", ("scores",))
def _(t: Tables) -> DataFrame:
    second = t.scores.withColumn("other", F.round(F.col("score") * F.col("score"), 6))
    return metrics.disagreement(second, "score", "other")


@query("g36_evidence_confidence", f"""
    SELECT atm_id, {day('day')} AS day, strength, CASE WHEN score >= 0.85 AND strength >= 4 THEN 'High'
           WHEN score >= 0.70 OR strength >= 3 THEN 'Medium' ELSE 'Low' END AS confidence, strength < 3 AS insufficient_evidence
    FROM (SELECT *, least(1 + day(day) % 4 + label, 5) AS strength FROM scores)""", ("scores",))
def _(t: Tables) -> DataFrame:
    verdict = fx.evidence_confidence(F.col("score"), (F.dayofmonth("day") % 4).cast("bigint"), F.col("label").cast("bigint"))
    return t.scores.select("atm_id", "day", verdict.alias("e")).select("atm_id", "day", "e.*")


def _tercile_sql(source: str, key: str, value: str, prefix: str) -> str:
    return f"""SELECT {key}, '{prefix}' || CASE WHEN v <= a THEN 'low' WHEN v <= b THEN 'mid' ELSE 'high' END AS g
        FROM (SELECT {key}, {value} AS v FROM {source} GROUP BY 1) x,
             (SELECT quantile_cont(v, 1.0 / 3) AS a, quantile_cont(v, 2.0 / 3) AS b FROM (SELECT {value} AS v FROM {source} GROUP BY {key}))"""


@query("g37_group_fairness", f"""
    WITH s AS (SELECT s.*, city FROM scores s JOIN atms USING (atm_id)),
    area AS ({_tercile_sql('(SELECT victim_city AS city FROM complaints)', 'city', 'count(*)', 'complaint_area:')}),
    vol AS ({_tercile_sql('withdrawals', 'atm_id', 'count(*)', 'atm_volume:')}),
    age AS ({_tercile_sql('withdrawals', 'atm_id', 'epoch_us(min(withdrawals.timestamp))', 'atm_age:')}),
    l AS (SELECT 'all' AS g, score, label FROM s UNION ALL SELECT 'jurisdiction:' || city, score, label FROM s
          UNION ALL SELECT g, score, label FROM s JOIN area USING (city) UNION ALL SELECT g, score, label FROM s JOIN vol USING (atm_id)
          UNION ALL SELECT g, score, label FROM s JOIN age USING (atm_id))
    SELECT g AS "group", count(*) AS rows, {r4('avg(label)')} AS positive_rate, {r4('avg((score >= 0.7)::INT)')} AS alert_rate_0p7,
           {r4('avg((score >= 0.7 AND label = 0)::INT)')} AS false_positive_rate_0p7, {r4('avg(label) FILTER (score >= 0.7)')} AS precision_0p7,
           {r4('avg((score >= 0.7)::INT) FILTER (label = 1)')} AS recall_0p7 FROM l GROUP BY 1""",
    ("scores", "atms", "complaints", "withdrawals"))
def _(t: Tables) -> DataFrame:
    return fairness.group_fairness(fairness.group_labels(t.scores, t.complaints, t.withdrawals, t.atms))


def _sim_sql(rank: str) -> str:
    return f"""
    WITH f AS (SELECT atm_id, timestamp::DATE AS day, count(*) AS n, sum(amount::DECIMAL(18,2)) AS a, min(timestamp) AS first
               FROM withdrawals WHERE is_fraud_withdrawal GROUP BY 1, 2),
    tot AS (SELECT sum(n)::BIGINT AS n, sum(a)::DOUBLE AS a FROM f),
    v AS (SELECT k, s.atm_id, s.day FROM (SELECT s.*, row_number() OVER (PARTITION BY s.day ORDER BY {rank} DESC, s.atm_id) AS rk
          FROM scores s LEFT JOIN prox p ON s.atm_id = p.atm_id AND s.day = p.day) s JOIN (SELECT unnest([10, 20, 50]) AS k) ON rk <= k),
    m AS (SELECT k, count(*) AS it, coalesce(sum(n), 0)::BIGINT AS c, coalesce(sum(a), 0)::DOUBLE AS x, count(*) FILTER (n IS NULL) AS fi,
                 quantile_cont(date_diff('microsecond', v.day::TIMESTAMP, first) / 3600000000.0::DOUBLE, 0.5) AS md
          FROM v LEFT JOIN f ON v.atm_id = f.atm_id AND v.day = f.day GROUP BY 1)
    SELECT 0 AS seed, k, tot.n AS fraud_events_total, c AS fraud_events_captured, {r4('c / tot.n')} AS capture_rate, x AS exposure_captured_inr,
           round(round(100 * x / tot.a, 10), 2) AS loss_prevented_pct, it AS interventions_total, fi AS false_interventions,
           tot.n - c AS missed_events, round(round(md, 10), 1) AS time_to_intervention_median_h,
           round(round(x / it, 10), 2) AS efficiency_inr_per_intervention FROM m, tot"""


PROX = """WITH prox AS (SELECT atm_id, day, count(*) AS c FROM (
    SELECT atm_id, unnest([filing_timestamp::DATE, filing_timestamp::DATE + 1]) AS day FROM atms, complaints
    WHERE {0} <= 2.0) GROUP BY 1, 2),"""


def _with_prox(sql: str) -> str:
    distance = HAVERSINE.format("latitude", "longitude", "victim_lat", "victim_lon")
    return PROX.format(distance) + sql.strip()[5:]


@query("g38_intervention_sim", _with_prox(_sim_sql("s.score")), ("scores", "withdrawals", "atms", "complaints"))
def _(t: Tables) -> DataFrame:
    fraud = t.withdrawals.where("is_fraud_withdrawal").select("atm_id", "timestamp", "amount")
    return simulation.intervention_sim(t.scores, fraud, [10, 20, 50])


@query("g38_intervention_sim_summary")
def _(t: Tables) -> DataFrame:
    fraud = t.withdrawals.where("is_fraud_withdrawal").select("atm_id", "timestamp", "amount")
    runs = simulation.intervention_sim(t.scores, fraud, [10, 20, 50], list(range(10)), jitter=0.01)
    return simulation.simulation_summary(runs)


@query("g39_intervention_sim_proximity", _with_prox(_sim_sql("coalesce(c, 0)")), ("scores", "withdrawals", "atms", "complaints"))
def _(t: Tables) -> DataFrame:
    fraud = t.withdrawals.where("is_fraud_withdrawal").select("atm_id", "timestamp", "amount")
    ranked = simulation.with_proximity(t.scores, t.atms, t.complaints)
    return simulation.intervention_sim(ranked, fraud, [10, 20, 50], rank_by="complaints_nearby")


DRIFT_CHECKED = drift.DRIFT_FEATURES


def _drift_ctes(current: str | None = None) -> str:
    long = lambda name, where: f"{name} AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round({c}::DOUBLE, 6) AS v FROM matrix WHERE {where}" for c in DRIFT_CHECKED
    ) + ")"
    return f"""{MATRIX_CTES}, {long('ref', f'day < {SPLIT_SQL}')}, {long('cur', current or f'day >= {SPLIT_SQL}')},
    q AS (SELECT feature, unnest(quantile_cont(v, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS e FROM ref GROUP BY 1),
    e AS (SELECT feature, e, row_number() OVER (PARTITION BY feature ORDER BY e) AS b, count(*) OVER (PARTITION BY feature) AS ne
          FROM (SELECT DISTINCT feature, e FROM q)),
    bins AS (SELECT a.feature, a.b, a.e AS lo, c.e AS hi, a.b = a.ne - 1 AS last FROM e a JOIN e c ON a.feature = c.feature AND c.b = a.b + 1),
    sh AS (SELECT bins.feature, b, count(r.v) AS n FROM bins LEFT JOIN ref r ON r.feature = bins.feature AND r.v >= lo
           AND (r.v < hi OR (last AND r.v = hi)) GROUP BY 1, 2),
    sa AS (SELECT bins.feature, b, count(r.v) AS n FROM bins LEFT JOIN cur r ON r.feature = bins.feature AND r.v >= lo
           AND (r.v < hi OR (last AND r.v = hi)) GROUP BY 1, 2),
    se AS (SELECT feature, b, n / sum(n) OVER (PARTITION BY feature) AS p FROM sh),
    sc AS (SELECT feature, b, n / greatest(sum(n) OVER (PARTITION BY feature), 1) AS p FROM sa),
    psi AS (SELECT feature, {r4('sum((greatest(sc.p, 1e-6) - greatest(se.p, 1e-6)) * ln(greatest(sc.p, 1e-6) / greatest(se.p, 1e-6)))')} AS psi
            FROM se JOIN sc USING (feature, b) GROUP BY 1)"""


def _drift_parts(t: Tables) -> tuple[DataFrame, DataFrame]:
    # Read three times: for the reference cuts, the reference shares and the current shares.
    features = durable(matrix(t).select("day", *[F.round(c, 6).alias(c) for c in DRIFT_CHECKED]))
    return features.where(F.col("day") < F.lit(SPLIT)), features.where(F.col("day") >= F.lit(SPLIT))


@query("g40_psi_reference", f"""
    WITH {_drift_ctes()} SELECT se.feature, string_agg(printf('%.4f', p), '|' ORDER BY b) AS expected,
        any_value(edges) AS edges FROM se JOIN (SELECT feature, string_agg(printf('%.4f', e), '|' ORDER BY e) AS edges FROM e GROUP BY 1) x
        USING (feature) GROUP BY 1""", VIEWS)
def _(t: Tables) -> DataFrame:
    reference = drift.psi_reference(_drift_parts(t)[0], DRIFT_CHECKED)
    text = lambda c: F.array_join(F.transform(c, lambda v: F.format_string("%.4f", v)), "|").alias(c)
    return reference.select("feature", text("expected"), text("edges"))


@query("g41_psi", f"WITH {_drift_ctes()} SELECT feature, psi FROM psi", VIEWS)
def _(t: Tables) -> DataFrame:
    before, after = _drift_parts(t)
    return drift.psi(after, drift.psi_reference(before, DRIFT_CHECKED), DRIFT_CHECKED)


@query("g42_drift_status", f"""
    WITH {_drift_ctes()} SELECT CASE WHEN max(psi) > 0.2 THEN 'red' WHEN max(psi) > 0.1 THEN 'yellow' ELSE 'green' END AS status,
        count(*) AS n_features, (count(*) FILTER (psi > 0.2))::INT AS n_flagged, max(psi) AS max_psi, max(psi) > 0.2 AS retrain_triggered,
        coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (psi > 0.2), '') AS flagged,
        coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (psi > 0.1 AND psi <= 0.2), '') AS warned FROM psi""", VIEWS)
def _(t: Tables) -> DataFrame:
    before, after = _drift_parts(t)
    status = drift.drift_status(drift.psi(after, drift.psi_reference(before, DRIFT_CHECKED), DRIFT_CHECKED))
    names = lambda c: F.array_join(F.array_sort(F.map_keys(c)), ",").alias(c)
    return status.select("status", "n_features", "n_flagged", "max_psi", "retrain_triggered", names("flagged"), names("warned"))


# The periods of the history, by their first day after the split.
PERIODS = {"early": (0, 4), "late": (4, 60)}


def _history_sql(name: str, lo: int, hi: int) -> str:
    return f"""SELECT '{name}' AS run, count(*) AS n_features, max(psi) AS max_psi, count(*) FILTER (psi > 0.2) AS n_flagged
        FROM (WITH {_drift_ctes(f'day >= {SPLIT_SQL} + {lo} AND day < {SPLIT_SQL} + {hi}')} SELECT psi FROM psi)"""


@query("g43_drift_history", " UNION ALL ".join(_history_sql(name, *days) for name, days in PERIODS.items()), VIEWS)
def _(t: Tables) -> DataFrame:
    before, after = _drift_parts(t)
    reference = drift.psi_reference(before, DRIFT_CHECKED)
    path = f"{stream_folder(t.spark)}/history"
    # The first period is reported twice: the second report takes the place of the first.
    for name in (*PERIODS, "early"):
        lo, hi = PERIODS[name]
        part = after.where((F.col("day") >= F.date_add(F.lit(SPLIT), lo)) & (F.col("day") < F.date_add(F.lit(SPLIT), hi)))
        scored = drift.psi(part, reference, DRIFT_CHECKED)
        report = scored.agg(F.count("*").alias("n_features"), F.max("psi").alias("max_psi"), F.count_if(F.col("psi") > drift.RED).alias("n_flagged"))
        drift.append_history(report, path, name)
    return drift.drift_history(t.spark, path, "run")
