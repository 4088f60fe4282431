"""Transfer graph and network."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outflow.catalog.registry import money, query, r4, r6
from outflow.functions.ordering import numbered
from outflow.operators import graph, network
from outflow.operators.aggregates import exact_sum
from outflow.operators.listing import accounts_in_scope
from outflow.schemas import BANK
from outflow.session import durable
from outflow.sources.views import Tables

ITERATIONS = 40

EDGES = f"""
    e AS MATERIALIZED (SELECT from_token AS src, to_token AS dst, count(*) AS w, {money('amount')} AS amount FROM transfers GROUP BY 1, 2),
    n AS MATERIALIZED (
        SELECT node, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, {money('a')} AS inflow FROM (
            SELECT src AS node, 0 AS i, w AS o, 0.0::DOUBLE AS a FROM e UNION ALL SELECT dst, w, 0, amount FROM e) GROUP BY 1)"""


def _rank_ctes(iterations: int) -> str:
    steps = ["r0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM n) AS r FROM n)"]
    for i in range(1, iterations + 1):
        steps.append(f"""r{i} AS MATERIALIZED (
            SELECT n.node, 0.15::DOUBLE / (SELECT count(*) FROM n) + 0.85::DOUBLE * (coalesce(c, 0) + (
                       SELECT sum(r) FROM r{i - 1} JOIN n USING (node) WHERE out_degree = 0) / (SELECT count(*) FROM n)) AS r
            FROM n LEFT JOIN (SELECT dst AS node, sum(r * w / out_degree) AS c FROM e JOIN r{i - 1} p ON p.node = e.src
                              JOIN n o ON o.node = e.src GROUP BY 1) s ON s.node = n.node)""")
    return ", ".join(steps) + f", ranks AS (SELECT node, r / (SELECT max(r) FROM r{iterations}) AS page_rank FROM r{iterations})"


DEPTH = """
    depth AS (WITH RECURSIVE walk(node, d) AS (
        SELECT node, 0 FROM n WHERE in_degree = 0 UNION SELECT dst, d + 1 FROM walk JOIN e ON e.src = walk.node)
        SELECT n.node, coalesce(max(d), 0) AS depth FROM n LEFT JOIN walk ON walk.node = n.node GROUP BY 1)"""
RISK = f"""
    risk AS (
        SELECT n.node AS account_token, in_degree, out_degree, inflow AS inflow_inr, depth AS chain_depth, page_rank, {r4('''least(
               0.30 * in_degree / (SELECT max(in_degree) FROM n)
               + 0.25 * CASE WHEN out_degree = 0 THEN least(in_degree::DOUBLE / (in_degree + out_degree) + 0.15, 1.0)
                             ELSE in_degree::DOUBLE / (in_degree + out_degree) END
               + 0.15 * depth / (SELECT max(depth) FROM depth) + 0.15 * page_rank + 0.15 * inflow / (SELECT max(inflow) FROM n), 1.0)''')} AS terminal_risk
        FROM n JOIN ranks ON ranks.node = n.node JOIN depth ON depth.node = n.node)"""
ALL = f"{EDGES}, {_rank_ctes(ITERATIONS)}, {DEPTH}, {RISK}"


def edges(t: Tables) -> DataFrame:
    return graph.fixed_edges(t.transfers)


@query("h01_transfer_nodes", f"WITH {EDGES} SELECT * FROM n", ("transfers",))
def _(t: Tables) -> DataFrame:
    return graph.transfer_nodes(graph.weighted_edges(t.transfers))


@query("h02_pagerank", f"WITH {EDGES}, {_rank_ctes(ITERATIONS)} SELECT node, {r6('page_rank')} AS page_rank FROM ranks", ("transfers",))
def _(t: Tables) -> DataFrame:
    return graph.pagerank(edges(t), iterations=ITERATIONS)


@query("h03_chain_depth", f"WITH {EDGES}, {DEPTH} SELECT node, depth FROM depth", ("transfers",))
def _(t: Tables) -> DataFrame:
    return graph.chain_depth(edges(t))


@query("h04_terminal_risk", f"""
    WITH {ALL} SELECT account_token, in_degree, out_degree, inflow_inr, chain_depth, {r6('page_rank')} AS page_rank, terminal_risk FROM risk""",
    ("transfers",))
def _(t: Tables) -> DataFrame:
    return graph.terminal_risk(edges(t))


@query("h05_top_terminal", f"""
    WITH {ALL} SELECT account_token, terminal_risk, in_degree FROM risk WHERE in_degree >= 1 ORDER BY terminal_risk DESC, account_token LIMIT 50""",
    ("transfers",))
def _(t: Tables) -> DataFrame:
    return graph.top_terminal(graph.terminal_risk(edges(t)), 50).select("account_token", "terminal_risk", "in_degree")


def _busiest_target(e: DataFrame) -> str:
    """The cash-out point with the greatest inflow: the account the trail is asked for."""
    last = e.where(F.col("dst").startswith("P")).groupBy("dst").agg(exact_sum("amount").alias("a"))
    return last.orderBy(F.col("a").desc(), "dst").first()["dst"]


TRAIL = f"""{EDGES}, t AS (SELECT node FROM n WHERE starts_with(node, 'P') ORDER BY inflow DESC, node LIMIT 1),
    a AS (SELECT src, dst, row_number() OVER (ORDER BY amount DESC, src) AS b FROM e WHERE dst = (SELECT node FROM t)),
    c AS (SELECT a.b AS b1, coalesce(row_number() OVER (PARTITION BY a.src ORDER BY e.amount DESC, e.src), 0) AS b2,
                 CASE WHEN e.src IS NULL THEN [a.src, a.dst] ELSE [e.src, a.src, a.dst] END AS chain
          FROM a LEFT JOIN e ON e.dst = a.src)"""


@query("h06_money_trail", f"""
    WITH {TRAIL} SELECT (row_number() OVER (ORDER BY b1, b2))::INT AS chain_no, array_to_string(chain, '>') AS chain, false AS cut FROM c""", ("transfers",))
def _(t: Tables) -> DataFrame:
    e = edges(t)
    trail = graph.money_trail(e, _busiest_target(e))
    return trail.select("chain_no", F.array_join("chain", ">").alias("chain"), "cut")


@query("h06_trail_edges", f"""
    WITH {TRAIL}, touched AS (SELECT DISTINCT unnest(chain) AS node FROM c)
    SELECT src, dst, w, amount FROM e WHERE src IN (SELECT node FROM touched) OR dst IN (SELECT node FROM touched)""", ("transfers",))
def _(t: Tables) -> DataFrame:
    e = edges(t)
    return graph.trail_edges(e, graph.money_trail(e, _busiest_target(e))).select("src", "dst", "w", "amount")


@query("h06_trail_graph", f"""
    WITH {EDGES}, t AS (SELECT node FROM n WHERE starts_with(node, 'P') ORDER BY inflow DESC, node LIMIT 1),
    direct AS (SELECT * FROM e WHERE dst = (SELECT node FROM t))
    SELECT src, dst, w, amount, 1 AS hops FROM direct
    UNION ALL SELECT src, dst, w, amount, 2 FROM e WHERE dst IN (SELECT src FROM direct)""", ("transfers",))
def _(t: Tables) -> DataFrame:
    e = edges(t)
    return graph.trail_graph(e, _busiest_target(e)).select("src", "dst", "w", "amount", "hops")


# Suppliers of lines that follow each other in an order: a dense graph, full of cycles.
RELAYS = """
    lines AS (SELECT l_suppkey AS src, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS dst FROM lineitem),
    relays AS (SELECT 'S' || src AS src, 'S' || dst AS dst, count(*) AS w FROM lines WHERE dst IS NOT NULL GROUP BY ALL)"""


def relays(t: Tables) -> DataFrame:
    after = F.lead("l_suppkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey"))
    lines = t.raw("lineitem").select(F.concat(F.lit("S"), "l_suppkey").alias("src"), F.concat(F.lit("S"), after).alias("dst"))
    return lines.where("dst IS NOT NULL").groupBy("src", "dst").agg(F.count("*").alias("w"))


@query("h06_trail_graph_cyclic", f"""
    WITH RECURSIVE {RELAYS}, inward AS (SELECT * FROM relays WHERE src <> 'S1'),
    ways(node, far) AS (
        SELECT 'S1', 0 UNION SELECT i.src, ways.far + 1 FROM ways JOIN inward i ON i.dst = ways.node
        WHERE ways.far < (SELECT least(count(DISTINCT src), 12) FROM inward)),
    reached AS (SELECT node, min(far) AS far FROM ways GROUP BY 1)
    SELECT src, dst, w, (far + 1)::INT AS hops FROM inward JOIN reached ON dst = node""")
def _(t: Tables) -> DataFrame:
    return graph.trail_graph(durable(relays(t)), "S1")


# Orders in a row, every seventh link left out: chains longer than any fixed number of rounds, and a ring with a tail for each supplier.
LONG_CHAINS = """
    long_chains AS (
        SELECT 'O' || o_orderkey AS src, 'O' || lead(o_orderkey) OVER (ORDER BY o_orderkey) AS dst, o_orderkey FROM orders
        QUALIFY lead(o_orderkey) OVER (ORDER BY o_orderkey) IS NOT NULL AND o_orderkey % 700 <> 7)"""


def long_chains(t: Tables) -> DataFrame:
    placed = numbered(t.raw("orders").select("o_orderkey"), [], [F.col("o_orderkey")])
    here = placed.select(F.concat(F.lit("O"), "o_orderkey").alias("src"), "o_orderkey", "position")
    after = placed.select(F.concat(F.lit("O"), "o_orderkey").alias("dst"), (F.col("position") - 1).alias("position"))
    linked = here.join(after, "position").where("o_orderkey % 700 <> 7")
    return linked.select("src", "dst")


@query("h03_chain_depth_long", f"""
    WITH {LONG_CHAINS}, firsts AS (SELECT src, o_orderkey FROM long_chains WHERE src NOT IN (SELECT dst FROM long_chains)),
    placed AS (SELECT dst AS node, o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS p FROM long_chains),
    heads AS (SELECT o_orderkey AS first, p AS begins FROM placed WHERE o_orderkey IN (SELECT o_orderkey FROM firsts))
    SELECT node, (p - begins + 1)::INT AS depth FROM placed ASOF JOIN heads ON placed.o_orderkey >= heads.first
    UNION ALL SELECT src, 0 FROM firsts""")
def _(t: Tables) -> DataFrame:
    return graph.chain_depth(long_chains(t).withColumn("w", F.lit(1)))


@query("h11_connected_components_long", f"""
    WITH {LONG_CHAINS}, firsts AS (SELECT src AS name, o_orderkey AS first FROM long_chains WHERE src NOT IN (SELECT dst FROM long_chains)),
    ends AS (SELECT src AS node, o_orderkey FROM long_chains UNION SELECT dst, o_orderkey FROM long_chains),
    grouped AS (SELECT DISTINCT node, first FROM ends ASOF JOIN firsts ON ends.o_orderkey >= firsts.first)
    SELECT node, min(node) OVER (PARTITION BY first) AS component FROM grouped""")
def _(t: Tables) -> DataFrame:
    return network.connected_components(long_chains(t))


SEED = """
    seed AS (SELECT account_token FROM order_withdrawals WHERE is_fraud_withdrawal GROUP BY 1)"""


@query("h07_network_seed", f"WITH {SEED} SELECT * FROM seed", ("order_withdrawals",))
def _(t: Tables) -> DataFrame:
    return network.network_seed(t.order_withdrawals)


NODES = f"""{SEED},
    f AS (SELECT complaint_id AS c, linked_account_token AS a, linked_phone_token AS p FROM order_complaints),
    c1 AS (SELECT * FROM f WHERE a IN (SELECT account_token FROM seed)),
    p1 AS (SELECT DISTINCT p FROM c1),
    c2 AS (SELECT * FROM f WHERE p IN (SELECT p FROM p1) OR a IN (SELECT account_token FROM seed)),
    nodes AS (SELECT DISTINCT c AS id, 'complaint' AS type FROM c2 UNION SELECT a, 'account' FROM c2
              UNION SELECT account_token, 'account' FROM seed UNION SELECT p, 'phone' FROM c2)"""
NETWORK = f"""{NODES},
    ne AS (SELECT complaint_id AS src, linked_account_token AS dst, 'complaint->account' AS rel FROM order_complaints WHERE complaint_id IN (SELECT id FROM nodes)
           UNION SELECT complaint_id, linked_phone_token, 'complaint->phone' FROM order_complaints WHERE complaint_id IN (SELECT id FROM nodes)
           UNION SELECT account_token, atm_id, 'account->atm' FROM order_withdrawals WHERE account_token IN (SELECT id FROM nodes WHERE type = 'account'))"""
NETWORK_VIEWS = ("order_withdrawals", "order_complaints")


def nodes(t: Tables) -> DataFrame:
    return network.network_expand(network.network_seed(t.order_withdrawals), t.order_complaints)


@query("h08_network_expand", f"WITH {NODES} SELECT * FROM nodes", NETWORK_VIEWS)
def _(t: Tables) -> DataFrame:
    return nodes(t)


@query("h09_network_edges", f"WITH {NETWORK} SELECT * FROM ne", NETWORK_VIEWS)
def _(t: Tables) -> DataFrame:
    return network.network_edges(nodes(t), t.order_complaints, t.order_withdrawals)


@query("h10_account_fraud_share", f"""
    SELECT account_token, {r6('avg(is_fraud_withdrawal::INT)')} AS fraud_share FROM order_withdrawals GROUP BY 1""", ("order_withdrawals",))
def _(t: Tables) -> DataFrame:
    return network.account_fraud_share(t.order_withdrawals)


# Complaints tied to accounts and phones: many components of different sizes.
LINKS = """
    lk AS (SELECT complaint_id AS src, linked_account_token AS dst FROM complaints WHERE linked_account_token IS NOT NULL
           UNION SELECT complaint_id, linked_phone_token FROM complaints)"""
def links(t: Tables) -> DataFrame:
    pair = lambda c: t.complaints.where(F.col(c).isNotNull()).select(F.col("complaint_id").alias("src"), F.col(c).alias("dst"))
    return pair("linked_account_token").unionByName(pair("linked_phone_token"))


# Every phone joins its complaints directly, so the smallest complaint or account around a phone names its component.
PHONE_COMPONENTS = """
    x AS (SELECT complaint_id, linked_account_token AS a, linked_phone_token AS p FROM complaints),
    lab AS (SELECT p, least(min(complaint_id), min(a), p) AS component FROM x GROUP BY 1),
    comp AS (SELECT DISTINCT complaint_id AS node, component FROM x JOIN lab USING (p) UNION SELECT a, component FROM x JOIN lab USING (p) WHERE a IS NOT NULL
             UNION SELECT p, component FROM lab)"""


@query("h11_connected_components", f"WITH {PHONE_COMPONENTS} SELECT * FROM comp", ("complaints",))
def _(t: Tables) -> DataFrame:
    return network.connected_components(links(t))


@query("h12_degree_centrality", f"""
    WITH {LINKS}, nb AS (SELECT src AS node, dst AS o FROM lk UNION SELECT dst, src FROM lk)
    SELECT node, {r6('count(*) / ((SELECT count(DISTINCT node) FROM nb) - 1)')} AS degree_centrality FROM nb GROUP BY 1""", ("complaints",))
def _(t: Tables) -> DataFrame:
    return network.degree_centrality(links(t))


@query("h13_betweenness")
def _(t: Tables) -> DataFrame:
    # Cities tied to the banks that serve them and the kinds of complaint filed there.
    served = t.atms.select(F.col("city").alias("src"), F.col("bank_name").alias("dst"))
    filed = t.complaints.select(F.col("victim_city").alias("src"), F.col("complaint_type").alias("dst"))
    return network.betweenness(served.unionByName(filed).distinct())


@query("h14_cluster_risk", f"""
    WITH {PHONE_COMPONENTS}, sh AS (SELECT account_token, avg(is_fraud_withdrawal::INT) AS s FROM withdrawals GROUP BY 1)
    SELECT component, {r6('sum(s)')} AS cluster_risk, count(*) FILTER (is_mule) AS flagged_mules
    FROM comp JOIN sh ON comp.node = sh.account_token LEFT JOIN accounts ON accounts.account_token = comp.node GROUP BY 1""",
    ("complaints", "withdrawals", "accounts"))
def _(t: Tables) -> DataFrame:
    components = network.connected_components(links(t))
    return network.cluster_risk(components, network.account_fraud_share(t.withdrawals), t.accounts)


@query("h15_scope_network_edges", f"""
    WITH {NETWORK}, own AS (SELECT id FROM nodes JOIN accounts ON id = account_token WHERE home_bank = 'BANK_1'),
    other AS (SELECT id FROM nodes WHERE type = 'account' AND id NOT IN (SELECT id FROM own))
    SELECT src, dst, rel FROM ne WHERE (src IN (SELECT id FROM own) OR dst IN (SELECT id FROM own))
    AND src NOT IN (SELECT id FROM other) AND dst NOT IN (SELECT id FROM other)""", (*NETWORK_VIEWS, "accounts"))
def _(t: Tables) -> DataFrame:
    found = nodes(t)
    wired = network.network_edges(found, t.order_complaints, t.order_withdrawals)
    visible = accounts_in_scope(t.accounts, BANK, "BANK_1")
    return network.scope_network(found, wired, visible, network.account_fraud_share(t.order_withdrawals))[1]


SPLIT = datetime(2001, 1, 1)


@query("h16_graph_backtest", f"""
    WITH {ALL}, pos AS (SELECT DISTINCT 'P' || l_partkey AS a FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'
                        AND l_shipdate > TIMESTAMP '2001-01-01' AND l_shipdate <= TIMESTAMP '2001-01-06'),
    m AS (SELECT *, CASE WHEN account_token IN (SELECT a FROM pos) THEN 1 ELSE 0 END AS label FROM risk),
    x AS (SELECT 'terminal_risk' AS ranking, label, row_number() OVER (ORDER BY terminal_risk DESC, account_token) AS p FROM m
          UNION ALL SELECT 'inflow', label, row_number() OVER (ORDER BY inflow_inr DESC, account_token) FROM m
          UNION ALL SELECT 'in_degree', label, row_number() OVER (ORDER BY in_degree DESC, account_token) FROM m
          UNION ALL SELECT 'random', label, row_number() OVER (ORDER BY ('0x' || substr(md5('7:' || account_token), 1, 13))::BIGINT DESC, account_token) FROM m)
    SELECT ranking, k, {r4('avg(label)')} AS precision, {r4('sum(label) / greatest((SELECT count(*) FROM pos), 1)')} AS recall
    FROM x JOIN (SELECT unnest([10, 50, 100]) AS k) ON p <= k GROUP BY 1, 2""", ("transfers",))
def _(t: Tables) -> DataFrame:
    cashouts = t.raw("lineitem").select(
        F.concat(F.lit("P"), F.col("l_partkey")).alias("account_token"), F.col("l_shipdate").alias("timestamp"),
        F.expr("l_returnflag = 'R' and l_linestatus = 'F'").alias("is_fraud_withdrawal"),
    )
    return graph.graph_backtest(graph.terminal_risk(edges(t)), graph.fraud_cashout_accounts(cashouts, SPLIT))
