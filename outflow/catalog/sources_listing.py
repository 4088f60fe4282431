"""Sources, projections, filters, listings, set operations and ordering."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outflow.catalog.registry import day, query, r6, ts
from outflow.functions import scalar as fx
from outflow.functions.ordering import exact_quantiles
from outflow.operators import listing, scope
from outflow.schemas import ADMIN, BANK, DISTRICT, STATE
from outflow.sources import files, tables
from outflow.sources.views import Tables
from outflow.streaming.jobs import stream_folder
from outflow.streaming.jobs import stream_folder

AS_OF = datetime(2024, 1, 21)
SINCE = datetime(2024, 1, 14)

COMPLAINT_OUT = f"complaint_id, {ts('filing_timestamp')} AS filing_timestamp, complaint_type, victim_city"
WITHDRAWAL_OUT = f"transaction_id, {ts('timestamp')} AS timestamp, atm_id, account_token, amount"
ALERT_OUT = f"alert_id, {ts('created_at')} AS created_at, atm_id, risk_score, status"


def complaint_out(df: DataFrame) -> DataFrame:
    return df.select("complaint_id", "filing_timestamp", "complaint_type", "victim_city")


def withdrawal_out(df: DataFrame) -> DataFrame:
    return df.select("transaction_id", "timestamp", "atm_id", "account_token", "amount")


def alert_out(df: DataFrame) -> DataFrame:
    return df.select("alert_id", "created_at", "atm_id", "risk_score", "status")


# ---------------------------------------------------------------- sources


@query("a01_read_complaints", f"""
    SELECT {ts('filing_timestamp')} AS filing_timestamp, complaint_type, victim_city, victim_district,
           {r6('victim_lat')} AS victim_lat, {r6('victim_lon')} AS victim_lon, linked_account_token, amount_lost, victim_pin
    FROM complaints""", ("complaints",))
def _(t: Tables) -> DataFrame:
    return tables.complaint_features_input(t.complaints)


@query("a02_read_atms", f"""
    SELECT atm_id, bank_name, branch_name, city, district, state, pin, police_station_area,
           {r6('latitude')} AS latitude, {r6('longitude')} AS longitude FROM atms""", ("atms",))
def _(t: Tables) -> DataFrame:
    return tables.atm_features_input(t.atms)


@query("a03_read_withdrawals", f"""
    SELECT {ts('timestamp')} AS timestamp, atm_id, account_token, amount,
           coalesce(is_fraud_withdrawal, false) AS is_fraud_withdrawal FROM withdrawals""", ("withdrawals",))
def _(t: Tables) -> DataFrame:
    return tables.withdrawal_features_input(t.withdrawals)


@query("a04_read_transfers", f"""
    SELECT from_token, to_token, amount, {ts('timestamp')} AS timestamp FROM transfers
    WHERE timestamp >= TIMESTAMP '1998-05-02' AND timestamp < TIMESTAMP '1998-06-01'""", ("transfers",))
def _(t: Tables) -> DataFrame:
    return tables.read_transfers(t.transfers, datetime(1998, 6, 1), 30)


@query("a06_category_shares", f"""
    SELECT category, n, {r6('round(100.0 * n / sum(n) OVER (), 4)')} AS pct
    FROM (SELECT complaint_type AS category, count(*) AS n FROM order_complaints GROUP BY 1)""", ("order_complaints",))
def _(t: Tables) -> DataFrame:
    counts = t.order_complaints.groupBy(F.col("complaint_type").alias("category")).agg(F.count("*").alias("n"))
    return files.category_shares(counts)


@query("a06_category_files", f"""
    SELECT category, n, {r6('round(100.0 * n / sum(n) OVER (), 4)')} AS pct, 2 AS bad_files
    FROM (SELECT complaint_type AS category, 2 * count(*) AS n FROM order_complaints GROUP BY 1)""", ("order_complaints",))
def _(t: Tables) -> DataFrame:
    """Every count once in a file per state and once in a list, with padded names and both spellings, beside two files of neither shape."""
    counts = t.order_complaints.groupBy("victim_state", "complaint_type").agg(F.count("*").alias("n"))
    padded = F.concat(F.lit(" "), "complaint_type", F.lit("\t"))
    maps = counts.groupBy("victim_state").agg(F.map_from_entries(F.collect_list(F.struct(padded, "n"))).alias("kinds"))
    maps = maps.select(F.to_json(F.create_map("victim_state", "kinds")).alias("value"))
    totals = counts.groupBy("complaint_type").agg(F.sum("n").alias("n"))
    rows = F.when(F.col("n") % 2 == 0, F.to_json(F.struct(padded.alias("Category"), F.col("n").alias("Count")))).otherwise(
        F.to_json(F.struct(F.col("complaint_type").alias("category"), F.col("n").alias("count")))
    )
    lists = totals.agg(F.concat(F.lit("["), F.array_join(F.collect_list(rows), ","), F.lit("]")).alias("value"))
    bad = t.spark.createDataFrame([("{broken",), ("17",)], "value string")
    folder = f"{stream_folder(t.spark)}/categories"
    # One document a file.
    maps.unionByName(lists).unionByName(bad).write.option("maxRecordsPerFile", 1).text(folder)
    bad_files = files.rejected_category_files(t.spark, folder).count()
    return files.read_category_counts_json(t.spark, folder).withColumn("bad_files", F.lit(bad_files))


@query("a09_json_safe", """
    SELECT account_token, atm_id, CASE WHEN amount = 0 THEN NULL ELSE 1000.0::DOUBLE / amount END IS NULL AS unusable
    FROM withdrawals""", ("withdrawals",))
def _(t: Tables) -> DataFrame:
    ratio = F.when(F.col("amount") == 0, F.lit(float("nan"))).otherwise(1000.0 / F.col("amount"))
    return files.json_safe(t.withdrawals.select("account_token", "atm_id", ratio.alias("r"))).select(
        "account_token", "atm_id", F.col("r").isNull().alias("unusable")
    )


@query("a10_data_stamp", f"""
    SELECT substring(sha256(
        'complaints=' || (SELECT count(*) || '=' || {ts('max(filing_timestamp)')} FROM complaints) || '|' ||
        'withdrawals=' || (SELECT count(*) || '=' || {ts('max(timestamp)')} FROM withdrawals)), 1, 16) AS stamp""",
    ("complaints", "withdrawals"))
def _(t: Tables) -> DataFrame:
    # Seconds are enough to notice a change, and print alike in both engines.
    second = lambda df, c: df.select(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias("t"))
    return tables.data_stamp(
        {
            "complaints": (second(t.complaints, "filing_timestamp"), "t"),
            "withdrawals": (second(t.withdrawals, "timestamp"), "t"),
        }
    )


@query("a12_tokenise", """
    SELECT 'CUS_' || substring(sha256('pepper|' || c_name), 1, 12) AS token, c_custkey AS customer FROM customer""")
def _(t: Tables) -> DataFrame:
    tokenised, _vault = tables.tokenise(t.raw("customer").select("c_name", F.col("c_custkey").alias("customer")), "c_name", "pepper", "CUS")
    return tokenised


@query("a12_token_vault", """
    SELECT DISTINCT 'SEG_' || substring(sha256('pepper|' || c_mktsegment), 1, 12) AS token, 'SEG' AS entity_type,
           c_mktsegment AS raw_value FROM customer""")
def _(t: Tables) -> DataFrame:
    return tables.tokenise(t.raw("customer"), "c_mktsegment", "pepper", "SEG")[1]


@query("a13_latest_timestamp", f"""
    SELECT {ts('max(t)')} AS latest FROM (
        SELECT max(filing_timestamp) AS t FROM complaints UNION ALL SELECT max(timestamp) FROM withdrawals)""",
    ("complaints", "withdrawals"))
def _(t: Tables) -> DataFrame:
    return tables.latest_timestamp(t.complaints, t.withdrawals)


@query("a14_table_counts", """
    SELECT 'atms' AS table_name, count(*) AS n FROM atms
    UNION ALL SELECT 'complaints', count(*) FROM complaints
    UNION ALL SELECT 'transfers', count(*) FROM transfers
    UNION ALL SELECT 'withdrawals', count(*) FROM withdrawals
    UNION ALL SELECT 'order_complaints', count(*) FROM order_complaints
    UNION ALL SELECT 'accounts', count(*) FROM accounts""",
    ("atms", "complaints", "transfers", "withdrawals", "order_complaints", "accounts"))
def _(t: Tables) -> DataFrame:
    return tables.table_counts(
        {
            "atms": t.atms, "complaints": t.complaints, "transfers": t.transfers, "withdrawals": t.withdrawals,
            "order_complaints": t.order_complaints, "accounts": t.accounts,
        }
    )


@query("a15_contract_rejects", """
    SELECT complaint_id, CASE WHEN linked_account_token IS NULL THEN 'linked_account_token is null' ELSE '' END
           || CASE WHEN linked_account_token IS NULL AND complaint_type NOT IN ('phishing', 'job_fraud') THEN ',' ELSE '' END
           || CASE WHEN complaint_type NOT IN ('phishing', 'job_fraud') THEN 'complaint_type not in list' ELSE '' END AS problems
    FROM complaints WHERE linked_account_token IS NULL OR complaint_type NOT IN ('phishing', 'job_fraud')""",
    ("complaints",))
def _(t: Tables) -> DataFrame:
    _good, bad = files.check_contract(
        t.complaints, ["complaint_id", "linked_account_token"], {"complaint_type": ["phishing", "job_fraud"]}
    )
    return bad.select("complaint_id", F.array_join("problems", ",").alias("problems"))


@query("a05_read_dropzone_csv", f"""
    SELECT victim_district AS district, {day('filing_timestamp')} AS date, count(*)::INT AS complaint_count FROM order_complaints
    GROUP BY 1, 2""", ("order_complaints",))
def _(t: Tables) -> DataFrame:
    folder = stream_folder(t.spark)
    counts = t.order_complaints.groupBy(
        F.col("victim_district").alias("district"), F.to_date("filing_timestamp").alias("date")
    ).agg(F.count("*").alias("complaint_count"))
    # Half of the files have their columns in another order.
    odd = F.dayofmonth("date") % 2 == 1
    files.export_tables({"dropzone/odd": counts.where(odd), "dropzone/even": counts.where(~odd).select("complaint_count", "date", "district")}, folder, "csv")
    return files.read_dropzone_csv(
        t.spark, f"{folder}/dropzone/*", {"district": "string", "date": "date", "complaint_count": "int"}
    )


@query("a07_write_sample", """
    SELECT transaction_id, atm_id FROM withdrawals ORDER BY withdrawals.timestamp DESC, transaction_id DESC LIMIT 100""", ("withdrawals",))
def _(t: Tables) -> DataFrame:
    folder = stream_folder(t.spark)
    files.write_sample(t.withdrawals, folder, ["timestamp", "transaction_id"], 100)
    return t.spark.read.option("header", True).csv(folder).select("transaction_id", "atm_id")


@query("a08_export_tables", """
    SELECT atm_id AS id, city FROM atms UNION ALL SELECT complaint_id, victim_city FROM complaints""", ("atms", "complaints"))
def _(t: Tables) -> DataFrame:
    folder = stream_folder(t.spark)
    files.export_tables({"atms": t.atms, "complaints": t.complaints}, folder)
    atms, complaints = t.spark.read.parquet(f"{folder}/atms"), t.spark.read.parquet(f"{folder}/complaints")
    return atms.select(F.col("atm_id").alias("id"), "city").unionByName(
        complaints.select(F.col("complaint_id").alias("id"), F.col("victim_city").alias("city"))
    )


@query("a11_cached_matrix", f"SELECT atm_id, {day('day')} AS day, {r6('score')} AS score, label FROM scores", ("scores",))
def _(t: Tables) -> DataFrame:
    folder = stream_folder(t.spark)
    stamp = tables.data_stamp({"withdrawals": (t.withdrawals, "timestamp")}).first()["stamp"]
    current = t.scores.select("atm_id", "day", F.col("label").alias("current"))
    fresh = lambda matrix: matrix.join(current, ["atm_id", "day"]).withColumn("label", F.col("current"))
    files.cached_matrix(t.spark, stamp, lambda: t.scores.withColumn("label", 1 - F.col("label")), folder, fresh)
    # The second call finds the stamp and reads the written matrix, whose labels are out of date.
    return files.cached_matrix(t.spark, stamp, lambda: t.scores, folder, fresh).select("atm_id", "day", "score", "label")


# ---------------------------------------------------------------- listings


@query("b01_list_complaints", f"""
    SELECT {COMPLAINT_OUT} FROM complaints
    WHERE victim_city = 'NATION_3' AND filing_timestamp BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'
    ORDER BY filing_timestamp DESC, complaint_id LIMIT 100 OFFSET 5""", ("complaints",))
def _(t: Tables) -> DataFrame:
    return complaint_out(
        listing.list_complaints(
            t.complaints, city="NATION_3", from_=datetime(2024, 1, 5), to=datetime(2024, 1, 25), limit=100, offset=5
        )
    )


@query("b02_list_atms", "SELECT atm_id, city, bank_name FROM atms WHERE bank_name = 'BANK_2' ORDER BY atm_id", ("atms",))
def _(t: Tables) -> DataFrame:
    return listing.list_atms(t.atms, bank="BANK_2").select("atm_id", "city", "bank_name")


@query("b03_list_withdrawals_bank", f"""
    SELECT {WITHDRAWAL_OUT} FROM withdrawals
    WHERE is_fraud_withdrawal AND atm_id IN (SELECT atm_id FROM atms WHERE bank_name = 'BANK_2')
    ORDER BY withdrawals.timestamp DESC, transaction_id""", ("withdrawals", "atms"))
def _(t: Tables) -> DataFrame:
    return withdrawal_out(listing.list_withdrawals(t.withdrawals, t.atms, fraud=True, role=BANK, scope="BANK_2"))


@query("b04_recent_withdrawals", f"""
    SELECT {WITHDRAWAL_OUT} FROM withdrawals WHERE atm_id = 'A3' AND timestamp >= TIMESTAMP '2024-01-14'
    ORDER BY withdrawals.timestamp DESC, transaction_id""", ("withdrawals",))
def _(t: Tables) -> DataFrame:
    return withdrawal_out(listing.recent_withdrawals(t.withdrawals, "A3", SINCE))


@query("b05_list_alerts", f"""
    SELECT {ALERT_OUT} FROM alerts WHERE status = 'new' AND state = 'ASIA'
    ORDER BY alerts.created_at DESC, alert_id""", ("alerts",))
def _(t: Tables) -> DataFrame:
    return alert_out(listing.list_alerts(t.alerts, status="new", role=STATE, scope="ASIA"))


@query("b06_get_alert", f"""
    SELECT {ALERT_OUT} FROM alerts WHERE alert_id = (SELECT min(alert_id) FROM alerts)""", ("alerts",))
def _(t: Tables) -> DataFrame:
    first = t.alerts.agg(F.min("alert_id")).scalar()
    return alert_out(listing.get_alert(t.alerts, first))


@query("b07_list_accounts", "SELECT account_token, home_bank FROM accounts WHERE home_bank = 'BANK_1' ORDER BY account_token", ("accounts",))
def _(t: Tables) -> DataFrame:
    return listing.list_accounts(t.accounts, role=BANK, scope="BANK_1").select("account_token", "home_bank")


@query("b07_accounts_in_scope", "SELECT DISTINCT account_token FROM accounts", ("accounts",))
def _(t: Tables) -> DataFrame:
    return listing.accounts_in_scope(t.accounts, role=STATE, scope="ASIA")


@query("b08_list_handoffs", f"""
    SELECT handoff_id, origin_state, receiving_state, status, {ts('created_at')} AS created_at FROM handoffs
    WHERE lower(origin_state) LIKE '%asia%' OR lower(receiving_state) LIKE '%asia%'
    ORDER BY handoffs.created_at DESC, handoff_id""", ("handoffs",))
def _(t: Tables) -> DataFrame:
    return listing.list_handoffs(t.handoffs, None, STATE, "Asia").select(
        "handoff_id", "origin_state", "receiving_state", "status", "created_at"
    )


@query("b09_list_recovery", f"""
    SELECT rec_id, {ts('created_at')} AS created_at, amount_at_risk, status FROM recovery WHERE home_bank = 'BANK_3'
    ORDER BY recovery.created_at DESC, rec_id""", ("recovery",))
def _(t: Tables) -> DataFrame:
    return listing.list_recovery(t.recovery, bank="BANK_3").select("rec_id", "created_at", "amount_at_risk", "status")


@query("b10_list_outcomes", f"""
    SELECT alert_id, {ts('evaluated_at')} AS evaluated_at, actual_fraud_happened FROM outcomes
    ORDER BY outcomes.evaluated_at DESC, alert_id""", ("outcomes",))
def _(t: Tables) -> DataFrame:
    return listing.list_outcomes(t.outcomes).select("alert_id", "evaluated_at", "actual_fraud_happened")


@query("b11_complaint_ids_for_account", """
    SELECT linked_account_token, string_agg(complaint_id, ',' ORDER BY n) AS complaint_ids FROM (
        SELECT linked_account_token, complaint_id, row_number() OVER (
            PARTITION BY linked_account_token ORDER BY filing_timestamp DESC, complaint_id) AS n FROM order_complaints)
    GROUP BY 1""", ("order_complaints",))
def _(t: Tables) -> DataFrame:
    return listing.complaint_ids_for_account(t.order_complaints, None).select(
        "linked_account_token", F.array_join("complaint_ids", ",").alias("complaint_ids")
    )


@query("b12_distinct_banks", "SELECT DISTINCT bank_name FROM atms ORDER BY bank_name", ("atms",))
def _(t: Tables) -> DataFrame:
    return listing.distinct_banks(t.atms)


@query("b12_distinct_mule_tokens", """
    SELECT DISTINCT linked_account_token AS account_token FROM complaints WHERE linked_account_token IS NOT NULL""",
    ("complaints",))
def _(t: Tables) -> DataFrame:
    return listing.distinct_mule_tokens(t.complaints)


@query("b13_cities_for_category", """
    SELECT DISTINCT victim_city FROM complaints
    WHERE complaint_type = 'upi_fraud' AND filing_timestamp >= TIMESTAMP '2024-01-14'""", ("complaints",))
def _(t: Tables) -> DataFrame:
    return listing.cities_for_category(t.complaints, "upi_fraud", SINCE)


@query("b14_apply_scope_counts", """
    SELECT 'atms bank' AS what, count(*) AS n FROM atms WHERE bank_name = 'BANK_1'
    UNION ALL SELECT 'atms district', count(*) FROM atms WHERE district = 'D4'
    UNION ALL SELECT 'atms state', count(*) FROM atms WHERE state = 'ASIA'
    UNION ALL SELECT 'complaints bank', 0::BIGINT
    UNION ALL SELECT 'complaints district', count(*) FROM complaints WHERE victim_district = 'D4'
    UNION ALL SELECT 'complaints state', count(*) FROM complaints WHERE victim_state = 'ASIA'
    UNION ALL SELECT 'accounts bank', count(*) FROM accounts WHERE home_bank = 'BANK_1'
    UNION ALL SELECT 'accounts state', count(*) FROM accounts
    UNION ALL SELECT 'alerts admin', count(*) FROM alerts""", ("atms", "complaints", "accounts", "alerts"))
def _(t: Tables) -> DataFrame:
    cases = [
        ("atms", BANK, "BANK_1"), ("atms", DISTRICT, "D4"), ("atms", STATE, "ASIA"), ("complaints", BANK, "BANK_1"),
        ("complaints", DISTRICT, "D4"), ("complaints", STATE, "ASIA"), ("accounts", BANK, "BANK_1"),
        ("accounts", STATE, "ASIA"), ("alerts", ADMIN, ""),
    ]
    label = {BANK: "bank", DISTRICT: "district", STATE: "state", ADMIN: "admin"}
    counts = [
        scope.apply_scope(getattr(t, entity), entity, role, value)
        .agg(F.count("*").alias("n")).select(F.lit(f"{entity} {label[role]}").alias("what"), "n")
        for entity, role, value in cases
    ]
    out = counts[0]
    for one in counts[1:]:
        out = out.unionByName(one)
    return out


@query("b15_scope_scores", f"""
    SELECT atm_id, {day('day')} AS day, {r6('score')} AS score FROM scores
    WHERE atm_id IN (SELECT atm_id FROM atms WHERE district = 'D4')""", ("scores", "atms"))
def _(t: Tables) -> DataFrame:
    return scope.scope_scores(t.scores, t.atms, DISTRICT, "D4").select("atm_id", "day", "score")


@query("b16_scope_alert_rows", f"""
    SELECT {ALERT_OUT} FROM alerts WHERE atm_id IN (SELECT atm_id FROM atms WHERE bank_name = 'BANK_5')""",
    ("alerts", "atms"))
def _(t: Tables) -> DataFrame:
    return alert_out(scope.scope_alert_rows(t.alerts, t.atms, BANK, "BANK_5"))


@query("b17_scope_reports", """
    SELECT alert_id, district FROM alerts WHERE district = 'D4'""", ("alerts",))
def _(t: Tables) -> DataFrame:
    jurisdiction = F.struct("state", "district", "bank_name")
    reports = t.alerts.select(
        F.lit("hotspot").alias("report_type"),
        F.to_json(F.struct("alert_id", jurisdiction.alias("jurisdiction"))).alias("payload"),
    )
    return scope.scope_reports(reports, DISTRICT, "D4").select(
        F.get_json_object("payload", "$.alert_id").alias("alert_id"),
        F.get_json_object("payload", "$.jurisdiction.district").alias("district"),
    )


LEVEL_SQL = "CASE WHEN {0} >= 0.85 THEN 'CRITICAL' WHEN {0} >= 0.70 THEN 'HIGH' WHEN {0} >= 0.40 THEN 'MEDIUM' ELSE 'LOW' END"
ACTION_SQL = (
    f"CASE {{0}} WHEN 'CRITICAL' THEN '{fx.ADVICE['CRITICAL']}' WHEN 'HIGH' THEN '{fx.ADVICE['HIGH']}'"
    f" ELSE '{fx.ADVICE_DEFAULT}' END"
)


@query("b18_risk_level", f"SELECT atm_id, {day('day')} AS day, {LEVEL_SQL.format('score')} AS risk_level FROM scores", ("scores",))
def _(t: Tables) -> DataFrame:
    return t.scores.select("atm_id", "day", fx.risk_level(F.col("score")).alias("risk_level"))


@query("b19_alert_tier", f"""
    SELECT atm_id, {day('day')} AS day,
           CASE WHEN score >= 0.85 THEN 'dispatch' WHEN score >= 0.70 THEN 'action' ELSE 'monitor' END AS tier
    FROM scores""", ("scores",))
def _(t: Tables) -> DataFrame:
    return t.scores.select("atm_id", "day", fx.alert_tier(F.col("score")).alias("tier"))


@query("b20_recommend_action", f"""
    SELECT atm_id, {day('day')} AS day, CASE WHEN score >= 0.70 AND score < 0.78 THEN '{fx.ADVICE_HOLD}'
           ELSE {ACTION_SQL.format('(' + LEVEL_SQL.format('score') + ')')} END AS action FROM scores""", ("scores",))
def _(t: Tables) -> DataFrame:
    return t.scores.select("atm_id", "day", fx.alert_advice(F.col("score")).alias("action"))


@query("b21_graded_actions", f"""
    SELECT atm_id, {day('day')} AS day,
           CASE WHEN score >= 0.85 THEN '1,2,3,4' WHEN score >= 0.70 THEN '1,2' ELSE '' END AS steps,
           CASE WHEN score >= 0.85 THEN 'Bank|Bank|Police (SHO)|Bank + I4C' WHEN score >= 0.70 THEN 'Bank|Bank' ELSE ''
           END AS owners FROM scores""", ("scores",))
def _(t: Tables) -> DataFrame:
    graded = t.scores.withColumn("g", fx.graded_actions(F.col("score")))
    return graded.select(
        "atm_id", "day", F.array_join(F.col("g.step").cast("array<string>"), ",").alias("steps"),
        F.array_join("g.owner", "|").alias("owners"),
    )


@query("b22_horizon_confidence", f"""
    SELECT atm_id, {day('day')} AS day, CASE WHEN score >= 0.70 THEN 'HIGH' WHEN score >= 0.45 THEN 'MEDIUM'
           ELSE '{fx.CONFIDENCE_HOLD}' END AS confidence FROM scores""", ("scores",))
def _(t: Tables) -> DataFrame:
    return t.scores.select("atm_id", "day", fx.horizon_confidence(F.col("score")).alias("confidence"))


@query("b23_percentile_label", """
    SELECT transaction_id, CASE WHEN amount >= q99 THEN '99th percentile' WHEN amount >= q95 THEN '95th percentile'
           WHEN amount >= q90 THEN '90th percentile' WHEN amount >= q50 THEN 'above median' ELSE 'below median' END AS label
    FROM withdrawals, (SELECT quantile_cont(amount, 0.5) AS q50, quantile_cont(amount, 0.9) AS q90,
                              quantile_cont(amount, 0.95) AS q95, quantile_cont(amount, 0.99) AS q99 FROM withdrawals)""",
    ("withdrawals",))
def _(t: Tables) -> DataFrame:
    q = exact_quantiles(t.withdrawals, [], "amount", [0.5, 0.9, 0.95, 0.99]).select("q").scalar()
    label = fx.percentile_label(F.col("amount"), [F.element_at("q", i) for i in (1, 2, 3, 4)])
    return t.withdrawals.withColumn("q", q).select("transaction_id", label.alias("label"))


@query("b24_hotspots", f"""
    SELECT atm_id, city, {r6('risk_score')} AS risk_score FROM latest_scores
    ORDER BY latest_scores.risk_score DESC, atm_id LIMIT 20""", ("latest_scores",))
def _(t: Tables) -> DataFrame:
    return listing.hotspots(t.latest_scores, 20).select("atm_id", "city", "risk_score")


@query("b24_hotspots_by_category", f"""
    SELECT atm_id, city, {r6('risk_score')} AS risk_score FROM latest_scores
    WHERE city IN (SELECT victim_city FROM complaints
                   WHERE complaint_type = 'sextortion' AND filing_timestamp >= TIMESTAMP '2024-01-20')
    ORDER BY latest_scores.risk_score DESC, atm_id LIMIT 20""", ("latest_scores", "complaints"))
def _(t: Tables) -> DataFrame:
    return listing.hotspots(
        t.latest_scores, 20, complaints=t.complaints, category="sextortion", as_of=datetime(2024, 1, 27)
    ).select("atm_id", "city", "risk_score")


# ---------------------------------------------------------------- set operations and ordering


@query("l01_union", """
    SELECT 'event' AS origin, complaint_id, victim_city FROM complaints
    UNION ALL SELECT 'order', complaint_id, victim_city FROM order_complaints""", ("complaints", "order_complaints"))
def _(t: Tables) -> DataFrame:
    cols = lambda df, name: df.select(F.lit(name).alias("origin"), "complaint_id", "victim_city")
    return cols(t.complaints, "event").unionByName(cols(t.order_complaints, "order"))


@query("l02_distinct_union", "SELECT from_token AS node FROM transfers UNION SELECT to_token FROM transfers", ("transfers",))
def _(t: Tables) -> DataFrame:
    # Each side is reduced before the union so that only distinct ids are shuffled again.
    one = t.transfers.select(F.col("from_token").alias("node")).distinct()
    return one.union(t.transfers.select("to_token").distinct()).distinct()


@query("l03_intersect", """
    SELECT district FROM atms INTERSECT SELECT victim_district FROM complaints""", ("atms", "complaints"))
def _(t: Tables) -> DataFrame:
    return t.atms.select("district").intersect(t.complaints.select("victim_district"))


@query("l04_difference", """
    SELECT account_token FROM accounts EXCEPT SELECT linked_account_token FROM complaints""", ("accounts", "complaints"))
def _(t: Tables) -> DataFrame:
    named = listing.named_accounts(t.complaints)
    return t.accounts.select("account_token").distinct().join(named, "account_token", "left_anti")


@query("m01_order_page", f"""
    SELECT {COMPLAINT_OUT} FROM order_complaints ORDER BY order_complaints.filing_timestamp DESC, complaint_id
    LIMIT 50 OFFSET 100""", ("order_complaints",))
def _(t: Tables) -> DataFrame:
    return complaint_out(
        listing.page(t.order_complaints, [F.col("filing_timestamp").desc(), F.col("complaint_id")], 50, 100)
    )


@query("m02_global_top_k", f"""
    SELECT transaction_id, amount FROM order_withdrawals ORDER BY amount DESC, transaction_id LIMIT 100""",
    ("order_withdrawals",))
def _(t: Tables) -> DataFrame:
    return listing.page(
        t.order_withdrawals.select("transaction_id", "amount"), [F.col("amount").desc(), F.col("transaction_id")], 100
    )
