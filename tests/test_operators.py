import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from outflow import schemas
from outflow.operators import aggregates as agg
from outflow.operators import alerts as al
from outflow.operators import auditlog, drift, graph, metrics, network, scope
from outflow.sources import files, tables
from outflow.sources.views import log_hash

T0 = datetime(2024, 1, 1)


def at(hours):
    return T0 + timedelta(hours=hours)


# ---------------------------------------------------------------- files


def test_dropzone_reports_what_is_missing(spark, tmp_path):
    need = {"district": "string", "complaint_count": "int"}
    assert files.read_dropzone_csv(spark, str(tmp_path / "none"), need).first().status == "PENDING_REAL_DATA"
    (tmp_path / "a.csv").write_text("district,other\nx,1\n")
    assert files.read_dropzone_csv(spark, str(tmp_path), need).first().note == "missing columns: complaint_count"
    (tmp_path / "a.csv").write_text("district,complaint_count\nx,1\n")
    (tmp_path / "b.csv").write_text("complaint_count,other,district\n2,5,y\n,5,z\nbad,5,u\n")
    got = {r.district: r.complaint_count for r in files.read_dropzone_csv(spark, str(tmp_path), need).collect()}
    assert got == {"x": 1, "y": 2, "z": None, "u": None}


def test_category_counts_from_both_shapes(spark, tmp_path):
    nested, listed = tmp_path / "m.json", tmp_path / "l.json"
    nested.write_text(json.dumps({"S1": {"upi": 3, "job": 1}, "S2": {"upi": 4}}))
    listed.write_text(json.dumps([{"category": "upi", "n": 7}, {"category": "job", "n": 1}]))
    for path in (nested, listed):
        got = {r.category: (r.n, r.pct) for r in files.read_category_counts_json(spark, str(path)).collect()}
        assert got == {"upi": (7, 87.5), "job": (1, 12.5)}


def test_sample_export_and_stamp_cache(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "i int, v double")
    files.write_sample(df, str(tmp_path / "s"), ["i"], 3)
    assert sorted(int(r.i) for r in spark.read.option("header", True).csv(str(tmp_path / "s")).collect()) == [7, 8, 9]
    files.export_tables({"t": df}, str(tmp_path / "x"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "x/t")).count() == 10
    built = []
    make = lambda: built.append(1) or df
    for stamp in ("a", "a", "b"):
        assert files.cached_matrix(spark, stamp, make, str(tmp_path / "c")).count() == 10
    assert len(built) == 2
    doubled = files.cached_matrix(spark, "a", make, str(tmp_path / "c"), lambda m: m.withColumn("v", F.col("v") * 2))
    assert doubled.agg(F.max("v")).first()[0] == 18.0
    # Without its success mark the folder is what a broken write left.
    (tmp_path / "c/stamp=a/_SUCCESS").unlink()
    assert files.cached_matrix(spark, "a", make, str(tmp_path / "c")).count() == 10 and len(built) == 3


def test_json_safe(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (float("-inf"),)], "v double")
    assert [r.v for r in files.json_safe(df).collect()] == [1.0, None, None, None]


def test_contract_sets_rows_aside(spark):
    df = spark.createDataFrame([("a", "x"), (None, "x"), ("b", "q")], "id string, kind string")
    good, bad = files.check_contract(df, ["id"], {"kind": ["x"]})
    assert [r.id for r in good.collect()] == ["a"]
    assert sorted(r.problems[0] for r in bad.collect()) == ["id is null", "kind not in list"]
    with pytest.raises(ValueError):
        files.check_contract(df, ["nope"], {})


def test_stamp_changes_with_data(spark):
    df = spark.createDataFrame([(at(0),)], "t timestamp_ntz")
    one = tables.data_stamp({"x": (df, "t")}).first().stamp
    assert len(one) == 16 and one != tables.data_stamp({"x": (df.union(df), "t")}).first().stamp


def test_as_of_precedence(spark):
    c = spark.createDataFrame([(at(1),)], "filing_timestamp timestamp_ntz")
    w = spark.createDataFrame([(at(5),)], "timestamp timestamp_ntz")
    assert tables.resolve_as_of(c, w).first().as_of == at(5)
    assert tables.resolve_as_of(c, w, None, at(3)).first().as_of == at(3)
    assert tables.resolve_as_of(c, w, at(2), at(3)).first().as_of == at(2)


# ---------------------------------------------------------------- metrics


def scored(spark, rows):
    return spark.createDataFrame([(i, s, y) for i, (s, y) in enumerate(rows)], "id int, score double, label int")


def test_auc_ties_and_single_class(spark):
    assert metrics.roc_auc(scored(spark, [(0.5, 1), (0.5, 0), (0.5, 0)])).first().roc_auc == 0.5
    assert metrics.roc_auc(scored(spark, [(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0)])).first().roc_auc == 0.875
    assert metrics.roc_auc(scored(spark, [(0.9, 1), (0.5, 1)])).first().roc_auc == 0.5


def test_average_precision(spark):
    assert metrics.pr_auc(scored(spark, [(0.9, 1), (0.8, 0), (0.7, 1)])).first().pr_auc == pytest.approx((1 + 2 / 3) / 2)


def test_calibration_bins_count_each_row_once(spark):
    df = scored(spark, [(0.0, 0), (0.1, 0), (0.2, 1), (1.0, 1)])
    bins = {r.bin: r.n for r in metrics.calibration_bins(df).collect()}
    assert bins == {0: 1, 1: 1, 2: 1, 9: 1}
    assert {r.bin: r.n for r in metrics.calibration_bins(df, "closed").collect()} == {0: 2, 1: 2, 2: 1, 9: 1}
    assert sum(r.n for r in metrics.calibration_bins(df, "half_open").collect()) == 3


def test_psi_zero_inflated_and_outside(spark):
    ref = spark.createDataFrame([(0.0,)] * 80 + [(float(i),) for i in range(1, 21)], "x double")
    profile = drift.psi_reference(ref, ["x"])
    edges = profile.first().edges
    assert edges == sorted(set(edges)) and sum(profile.first().expected) == pytest.approx(1.0)
    assert drift.psi(ref, profile, ["x"]).first().psi == 0.0
    far = spark.createDataFrame([(1000.0,)] * 50 + [(0.0,)] * 50, "x double")
    assert drift.psi(far, profile, ["x"]).first().psi > 0.2
    constant = spark.createDataFrame([(3.0,)] * 10, "x double")
    assert drift.psi(constant, drift.psi_reference(constant, ["x"]), ["x"]).first().psi == 0.0
    assert drift.drift_status(None, spark).first().status == "PENDING_REFERENCE"


def test_drift_history_keeps_the_newest(spark, tmp_path):
    for i in range(4):
        drift.append_history(spark.createDataFrame([(i,)], "n int"), str(tmp_path / "h"), f"day{i}")
    drift.append_history(spark.createDataFrame([(3,)], "n int"), str(tmp_path / "h"), "day3")
    assert [r.n for r in drift.drift_history(spark, str(tmp_path / "h"), "n", 2).collect()] == [3, 2]


def test_terciles_keep_ties_together(spark):
    df = spark.createDataFrame([(v,) for v in (1, 1, 1, 1, 2, 3)], "v int")
    got = {(r.v, r.tercile) for r in agg.terciles(df, "v").collect()}
    assert got == {(1, "low"), (2, "mid"), (3, "high")} or len({t for v, t in got if v == 1}) == 1


def test_gini_and_mode(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (5,)], "v int")
    assert agg.gini(df, "v").first().gini == pytest.approx(2 * (1 + 2 + 3 + 20) / (4 * 8) - 5 / 4)
    pairs = spark.createDataFrame([("k", "b"), ("k", "a"), ("k", None)], "k string, v string")
    assert agg.modal_value(pairs, ["k"], "v").first().v == "a"


# ---------------------------------------------------------------- alerts


def test_duplicate_rule_sequence(spark):
    from outflow.schemas import ALERTS

    alerts = spark.createDataFrame([], ALERTS)
    outcomes = []
    for hour, risk in ((0, 0.72), (1, 0.80), (2, 0.85), (7, 0.72), (9, 0.72)):
        scores = spark.createDataFrame([("A", "b", "c", "d", "s", "p", risk)], "atm_id string, bank_name string, city string, district string, state string, police_station_area string, risk_score double")
        cycle = al.alert_cycle(scores, alerts, at(hour))
        row = cycle.first()
        outcomes.append((row.outcome, row.risk_delta_vs_last))
        pop = spark.createDataFrame([("s", 1)], "state string, n bigint")
        fresh = al.build_alerts(cycle, pop, at(hour))
        alerts = spark.createDataFrame(
            [(*r,) for r in alerts.unionByName(fresh, allowMissingColumns=True).collect()], ALERTS
        )
    # The last alert is of hour 2; at hour 9 it is seven hours old.
    assert outcomes == [("new", None), ("reobserved", 0.08), ("new", 0.13), ("reobserved", -0.13), ("new", None)]


def test_outcome_bounds_are_closed(spark):
    alerts = spark.createDataFrame([(f"x{i}", f"A{i}", at(0), 0.9) for i in range(3)], "alert_id string, atm_id string, created_at timestamp_ntz, risk_score double")
    none = spark.createDataFrame([], "alert_id string")
    w = spark.createDataFrame(
        [("A0", at(0), True), ("A1", at(24), True), ("A2", at(24) + timedelta(seconds=1), True)],
        "atm_id string, timestamp timestamp_ntz, is_fraud_withdrawal boolean",
    )
    got = {r.atm_id: r.actual_fraud_happened for r in al.evaluate_outcomes(alerts, none, w, at(48)).collect()}
    assert got == {"A0": "yes", "A1": "yes", "A2": "no"}


def test_routing_is_cross_state_and_idempotent(spark):
    alerts = spark.createDataFrame([("intra", "a1", "State-A"), ("cross", "a2", "State-C")], "alert_id string, atm_id string, state string")
    origins = spark.createDataFrame([("a1", "State-A"), ("a2", "State-B")], "atm_id string, origin_state string")
    empty = spark.createDataFrame([], "alert_id string")
    first = al.route_alerts(alerts, origins, empty, at(0))
    assert [(r.alert_id, r.status) for r in first.collect()] == [("cross", "queued")]
    assert al.route_alerts(alerts, origins, first, at(1)).count() == 0
    acks = spark.createDataFrame([("HO-cross", "me", at(2), False)], "handoff_id string, actor string, acked_at timestamp_ntz, complete boolean")
    done = al.ack_handoffs(first, acks)
    assert done.first().status == "ack"
    assert {r.alert_id: r.routing_status for r in al.mirror_routing(alerts, done).collect()} == {"intra": "none", "cross": "handoff_ack"}
    told = alerts.withColumn("routing_status", F.lit("intra"))
    assert {r.alert_id: r.routing_status for r in al.mirror_routing(told, done.unionByName(done)).collect()} == {"intra": "intra", "cross": "handoff_ack"}


def test_decisions_need_reasons(spark):
    rows = [("a", at(1), "dismissed", " "), ("a", at(2), "escalated", "why"), ("a", at(3), "nonsense", "x")]
    df = spark.createDataFrame(rows, "alert_id string, decided_at timestamp_ntz, status string, reason string")
    assert [r.status for r in al.valid_decisions(df).collect()] == ["escalated"]


def test_recovery_update(spark):
    recs = spark.createDataFrame([("r", "freeze_requested", 0.0, 0.0)], "rec_id string, status string, amount_held double, amount_recovered double")
    events = spark.createDataFrame([("r", at(1), "held", 40000.0, 0.0)], "rec_id string, at timestamp_ntz, status string, amount_held double, amount_recovered double")
    assert tuple(al.update_recovery(recs, events).first()) == ("r", "held", 40000.0, 0.0)


def test_foreign_alert_is_hidden(spark):
    alerts = spark.createDataFrame([("x", "BANK_1", "D1", "S1")], "alert_id string, bank_name string, district string, state string")
    assert scope.apply_scope(alerts, "alerts", schemas.DISTRICT, "D2").count() == 0
    assert scope.apply_scope(alerts, "alerts", schemas.DISTRICT, "D1").count() == 1
    complaints = spark.createDataFrame([("x", "D1", "S1")], "complaint_id string, victim_district string, victim_state string")
    assert scope.apply_scope(complaints, "complaints", schemas.BANK, "BANK_1").count() == 0


# ---------------------------------------------------------------- log


def good_log(spark, n=5):
    rows, prev = [], "0" * 64
    for i in range(n):
        df = spark.createDataFrame([(i, at(i), "me", "e", "x", f"p{i}", prev)], "index bigint, created_at timestamp_ntz, actor string, event_type string, entity_id string, payload_hash string, prev_hash string")
        own = df.select(log_hash(F.col("prev_hash"))).first()[0]
        rows.append((i, at(i), "me", "e", "x", f"p{i}", prev, own))
        prev = own
    return rows


def test_log_break_is_found(spark):
    rows = good_log(spark)
    frame = lambda r: spark.createDataFrame(r, schemas.AUDIT_LOG)
    assert auditlog.verify_log(frame(rows)).first().intact
    changed = [r if r[0] != 2 else (*r[:5], "other", *r[6:]) for r in rows]
    assert auditlog.verify_log(frame(changed)).first().broken_at_index == 2
    relinked = [r if r[0] != 3 else (*r[:6], "1" * 64, r[7]) for r in rows]
    assert auditlog.verify_log(frame(relinked)).first().broken_at_index == 3


# ---------------------------------------------------------------- graphs


def money(spark, pairs):
    return graph.weighted_edges(spark.createDataFrame([(a, b, 10.0) for a, b in pairs], "from_token string, to_token string, amount double"))


def reference_ranks(pairs, d=0.85, rounds=40):
    nodes = sorted({x for p in pairs for x in p})
    out = {v: sum(a == v for a, _ in pairs) for v in nodes}
    r = {v: 1 / len(nodes) for v in nodes}
    for _ in range(rounds):
        lost = sum(r[v] for v in nodes if not out[v])
        r = {v: (1 - d) / len(nodes) + d * (sum(r[a] / out[a] for a, b in pairs if b == v) + lost / len(nodes)) for v in nodes}
    return {v: x / max(r.values()) for v, x in r.items()}


DAG = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "x"), ("a", "y"), ("x", "z"), ("y", "z"), ("a", "b"), ("p", "q")]
CYCLE = [("s", "u"), ("u", "v"), ("v", "w"), ("w", "u"), ("m", "n"), ("n", "m")]


@pytest.mark.parametrize("pairs, hot", [(DAG, 1), (CYCLE, 1_000_000)])
def test_pagerank_matches_plain_iteration(spark, pairs, hot):
    got = {r.node: r.page_rank for r in graph.pagerank(money(spark, pairs), hot_edges=hot).collect()}
    assert got == pytest.approx(reference_ranks(pairs), abs=1e-9)


def test_depth_on_dag_and_cycle(spark):
    assert {r.node: r.depth for r in graph.chain_depth(money(spark, DAG)).collect()} == {
        "a": 0, "p": 0, "b": 1, "x": 1, "y": 1, "q": 1, "c": 2, "z": 2, "d": 3
    }
    # A ring counts as one node; what no source reaches is 0.
    ringed = {r.node: r.depth for r in graph.chain_depth(money(spark, [*CYCLE, ("w", "t1"), ("t1", "t2"), ("n", "o"), ("k", "k")])).collect()}
    assert ringed == {"s": 0, "u": 1, "v": 1, "w": 1, "t1": 2, "t2": 3, "m": 0, "n": 0, "o": 0, "k": 0}


def test_depth_of_a_long_chain_with_branches(spark):
    pairs = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(200)] + [("c100", "side"), ("side", "c199"), ("x", "c150")]
    got = {r.node: r.depth for r in graph.chain_depth(money(spark, pairs)).collect()}
    assert got == {**{f"c{i:03d}": i for i in range(201)}, "side": 101, "x": 0}


def test_cycle_groups(spark):
    pairs = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("d", "e"), ("e", "f"), ("f", "g"), ("g", "e"), ("z", "a")]
    got = {r.node: r.cycle for r in graph.cycle_groups(spark.createDataFrame(pairs, "src string, dst string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "e", "f": "e", "g": "e", "z": "z"}


def test_terminal_risk_survives_pure_cycles(spark):
    rows = graph.terminal_risk(money(spark, [("m", "n"), ("n", "m")])).collect()
    assert len(rows) == 2 and all(0 <= r.terminal_risk <= 1 for r in rows)


def test_terminal_risk_moves_its_edges_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "durable", lambda df, keep=graph.durable: written.append(set(df.columns)) or keep(df))
    rows = graph.terminal_risk(money(spark, DAG)).collect()
    assert {r.account_token: r.chain_depth for r in rows} == {"a": 0, "p": 0, "b": 1, "x": 1, "y": 1, "q": 1, "c": 2, "z": 2, "d": 3}
    # No copy of the edges is written; nodes, hot nodes and the steps over runs are.
    assert not [c for c in written if {"src", "dst"} <= c and "steps" not in c]


def test_depth_ignores_missing_ends(spark):
    rows = [("a", "b", 1), ("b", None, 1), (None, "c", 1), ("a", "c", 1), ("c", "d", 1), ("a", "d", 1)]
    edges = spark.createDataFrame(rows, "src string, dst string, w bigint")
    assert {r.node: r.depth for r in graph.chain_depth(edges, hot_edges=1).collect()} == {None: 0, "a": 0, "b": 1, "c": 1, "d": 2}


def test_trail_is_depth_first(spark):
    pairs = [("s1", "h1"), ("s2", "h1"), ("h1", "t"), ("s3", "t")]
    trail = graph.money_trail(money(spark, pairs), "t")
    assert [r.chain for r in trail.orderBy("chain_no").collect()] == [["s1", "h1", "t"], ["s2", "h1", "t"], ["s3", "t"]]


def trail_money(spark):
    return money(spark, [("s1", "h1"), ("s2", "h1"), ("h1", "t"), ("s3", "t"), ("t", "out")] + [(f"u{i}", f"v{i}") for i in range(50)])


@pytest.fixture
def no_small_tables(spark):
    """The planner takes no table for small, as with large ones."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_trail_edges_lie_still(spark, monkeypatch, no_small_tables):
    written = []
    monkeypatch.setattr(graph, "durable", lambda df, keep=graph.durable: written.append(keep(df)) or written[-1])
    edges = trail_money(spark)
    touching = graph.trail_edges(edges, graph.money_trail(edges, "t"))
    assert "SortMergeJoin" not in touching._jdf.queryExecution().executedPlan().toString()
    # Of the edges only those of one step are written.
    assert [d.count() for d in written if {"src", "dst"} <= set(d.columns)] == [2, 2, 0]
    want = {("s1", "h1"), ("s2", "h1"), ("h1", "t"), ("s3", "t"), ("t", "out")}
    joined = graph.trail_edges(edges, graph.money_trail(edges, "t", few=0), few=0)
    assert {(r.src, r.dst) for r in touching.collect()} == {(r.src, r.dst) for r in joined.collect()} == want


def test_trail_graph_edges_lie_still(spark, monkeypatch, no_small_tables):
    written = []
    monkeypatch.setattr(graph, "durable", lambda df, keep=graph.durable: written.append(set(df.columns)) or keep(df))
    edges = trail_money(spark)
    found = graph.trail_graph(edges, "t")
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert not [c for c in written if {"src", "dst"} <= c]
    want = {("s1", "h1"): 2, ("s2", "h1"): 2, ("h1", "t"): 1, ("s3", "t"): 1}
    assert {(r.src, r.dst): r.hops for r in found.collect()} == {(r.src, r.dst): r.hops for r in graph.trail_graph(edges, "t", few=0).collect()} == want


def test_trail_graph_ends_on_cycles(spark):
    # Every account pays every other: too many chains to list, and one account that only receives.
    names = [f"a{i:02d}" for i in range(30)]
    pairs = [(a, b) for a in names for b in names if a != b] + [("far", "a07"), ("a03", "out"), ("a00", "a00"), ("x", "y")]
    got = {(r.src, r.dst): r.hops for r in graph.trail_graph(money(spark, pairs), "a00").collect()}
    want = {(a, b): 1 if b == "a00" else 2 for a, b in pairs if a != "a00" and b in names} | {("far", "a07"): 2}
    assert got == want
    assert set(graph.trail_graph(money(spark, pairs), "a00", hops=1).toPandas()["dst"]) == {"a00"}
    assert graph.trail_graph(money(spark, pairs), "far").count() == 0
    chain = [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(12)] + [("c05", "c01")]
    got = {(r.src, r.dst): r.hops for r in graph.trail_graph(money(spark, chain), "c12", compact=3).collect()}
    assert got == {(a, b): 13 - int(b[1:]) for a, b in chain}


def test_components_and_betweenness(spark):
    path = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(12)] + [("z1", "z2")]
    edges = spark.createDataFrame(path, "src string, dst string")
    got = {r.node: r.component for r in network.connected_components(edges).collect()}
    assert {c for n, c in got.items() if n.startswith("n")} == {"n00"} and got["z2"] == "z1"
    star = spark.createDataFrame([("c", "1"), ("c", "2"), ("c", "3"), ("3", "4")], "src string, dst string")
    value = {r.node: r.betweenness for r in network.betweenness(star).collect()}
    # Five nodes, six pairs not counting the node itself: the centre lies on five of them, node 3 on three.
    assert value["c"] == pytest.approx(5 / 6) and value["3"] == pytest.approx(3 / 6) and value["1"] == 0
    assert {r.node: r.betweenness for r in network.betweenness(star, batch_nodes=2).collect()} == pytest.approx(value)
    long = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(400)], "src string, dst string")
    assert {r.component for r in network.connected_components(long).collect()} == {"n000"}


def test_network_scope_keeps_touching_nodes(spark):
    nodes = spark.createDataFrame([("a1", "account"), ("a2", "account"), ("c1", "complaint"), ("c2", "complaint")], "id string, type string")
    edges = spark.createDataFrame([("c1", "a1", "r"), ("c2", "a2", "r")], "src string, dst string, rel string")
    visible = spark.createDataFrame([("a1",)], "account_token string")
    shares = spark.createDataFrame([("a1", 0.5)], "account_token string, fraud_share double")
    kept, wired = network.scope_network(nodes, edges, visible, shares)
    assert sorted(r.id for r in kept.collect()) == ["a1", "c1"] and wired.count() == 1
