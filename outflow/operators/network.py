"""The network of accounts, complaints, phones and machines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outflow.session import durable


def network_seed(withdrawals: DataFrame, atm_id: str | None = None, k: int | None = None) -> DataFrame:
    """Accounts seen at a machine, or all accounts with fraud withdrawals (the k with most, if asked for)."""
    if atm_id is not None:
        return withdrawals.where(F.col("atm_id") == atm_id).select("account_token").distinct()
    fraud = withdrawals.where("is_fraud_withdrawal").groupBy("account_token").agg(F.count("*").alias("n"))
    return (fraud if k is None else fraud.orderBy(F.col("n").desc(), "account_token").limit(k)).select("account_token")


def network_expand(seed: DataFrame, complaints: DataFrame, rounds: int = 2, include_phone: bool = True) -> DataFrame:
    """(id, type): accounts, complaints and phones within a number of hops over shared accounts and phones.

    Each round joins only the newest accounts and phones and keeps ids not seen before. No neighbour is left out.
    """
    facts = complaints.select("complaint_id", "linked_account_token", "linked_phone_token")
    nodes = durable(seed.select(F.col("account_token").alias("id"), F.lit("account").alias("type")).distinct())
    frontier = nodes
    for _ in range(rounds):
        by_account = facts.join(
            frontier.where("type = 'account'").select(F.col("id").alias("linked_account_token")), "linked_account_token", "left_semi"
        ).select(facts.columns)
        touched = by_account
        if include_phone:
            by_phone = facts.join(
                frontier.where("type = 'phone'").select(F.col("id").alias("linked_phone_token")), "linked_phone_token", "left_semi"
            ).select(facts.columns)
            touched = by_account.unionByName(by_phone)
        named = [
            F.struct(F.col("complaint_id").alias("id"), F.lit("complaint").alias("type")),
            F.struct(F.col("linked_account_token").alias("id"), F.lit("account").alias("type")),
        ]
        if include_phone:
            named.append(F.struct(F.col("linked_phone_token").alias("id"), F.lit("phone").alias("type")))
        found = touched.select(F.inline(F.array(*named))).where(F.col("id").isNotNull()).distinct()
        frontier = durable(found.join(nodes, ["id", "type"], "left_anti"))
        nodes = durable(nodes.unionByName(frontier))
        if frontier.isEmpty():
            break
    return nodes


def network_edges(nodes: DataFrame, complaints: DataFrame, withdrawals: DataFrame, include_phone: bool = True) -> DataFrame:
    """(src, dst, rel): complaint to account, complaint to phone, account to machine, for the given nodes."""
    ids = lambda kind, name: nodes.where(F.col("type") == kind).select(F.col("id").alias(name))
    inside = complaints.join(ids("complaint", "complaint_id"), "complaint_id", "left_semi")
    rel = lambda df, a, b, name: df.where(F.col(b).isNotNull()).select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(name).alias("rel")).distinct()
    edges = rel(inside, "complaint_id", "linked_account_token", "complaint->account")
    if include_phone:
        edges = edges.unionByName(rel(inside, "complaint_id", "linked_phone_token", "complaint->phone"))
    drawn = withdrawals.select("account_token", "atm_id").distinct().join(ids("account", "account_token"), "account_token", "left_semi")
    return edges.unionByName(rel(drawn, "account_token", "atm_id", "account->atm"))


def account_fraud_share(withdrawals: DataFrame) -> DataFrame:
    return withdrawals.groupBy("account_token").agg(F.avg(F.col("is_fraud_withdrawal").cast("double")).alias("fraud_share"))


def neighbours(edges: DataFrame) -> DataFrame:
    """Both directions of every distinct edge, without loops: (node, other)."""
    pair = lambda a, b: F.struct(F.col(a).alias("node"), F.col(b).alias("other"))
    both = edges.select(F.inline(F.array(pair("src", "dst"), pair("dst", "src"))))
    return both.where(F.col("node") != F.col("other")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the component is named by its smallest node id.

    Alternating star contractions: the neighbours of a node move to the smallest of its neighbourhood, first those
    above the node, then those below it, until nothing moves. A long path takes about the logarithm of its length in rounds, of
    which each fetches two numbers. There is no limit of rounds.
    """
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    links = durable(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a <> b").distinct())
    mark = None
    while True:
        links = durable(_contract(_contract(links, True), False))
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == mark:
            break
        mark = now
    named = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _contract(links: DataFrame, above: bool) -> DataFrame:
    """Links (a, b) from nodes to the smallest node of a neighbourhood; ``above``: of the nodes above its centre, else of the others."""
    if above:
        sides = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        sides = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    moved = sides.join(least, "a").where("b > a" if above else "b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not above:
        moved = moved.union(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def degree_centrality(edges: DataFrame) -> DataFrame:
    """(node, degree_centrality): distinct neighbours over the number of other nodes."""
    near = neighbours(edges)
    n = near.agg(F.countDistinct("node")).scalar()
    return near.groupBy("node").agg((F.count("*") / F.greatest(n - 1, F.lit(1))).alias("degree_centrality"))


def betweenness(edges: DataFrame, batch_nodes: int = 400) -> DataFrame:
    """(node, betweenness): normalised shortest-path betweenness, unweighted.

    The sources of a batch advance together, level by level; path counts go forward, dependencies come back. The state
    has a row per (source, node) of one batch of about ``batch_nodes`` sources; the batches' sums are added up. The work is that of
    a breadth-first search from every node.
    """
    near = durable(neighbours(edges))
    ids = durable(near.select("node").distinct())
    n = ids.count()
    batches = max(1, -(-n // batch_nodes))
    total = None
    for batch in range(batches):
        part = _dependencies(near, ids.where(F.pmod(F.xxhash64("node"), F.lit(batches)) == batch))
        total = part if total is None else durable(total.unionByName(part).groupBy("node").agg(F.sum("delta").alias("delta")))
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return ids.join(total, "node", "left").select("node", (F.coalesce("delta", F.lit(0.0)) * scale).alias("betweenness"))


def _dependencies(near: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, delta): the sources' dependencies on every other node they reach, added up."""
    level = 0
    seen = durable(sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("level"), F.lit(1.0).alias("paths")))
    while True:
        at_level = seen.where(F.col("level") == level)
        stepped = at_level.join(near, "node").groupBy("source", F.col("other").alias("node")).agg(F.sum("paths").alias("paths"))
        fresh = stepped.join(seen.select("source", "node"), ["source", "node"], "left_anti")
        fresh = durable(fresh.select("source", "node", F.lit(level + 1).alias("level"), "paths"))
        if fresh.isEmpty():
            break
        seen = durable(seen.unionByName(fresh))
        level += 1
    dependency = seen.where(F.col("level") == level).select("source", "node", "paths", F.lit(0.0).alias("delta"))
    collected = dependency
    for back in range(level, 0, -1):
        # Each node hands (1 + its dependency) back to its predecessors in proportion to their path counts.
        handed = dependency.join(near, "node").select("source", F.col("other").alias("node"), ((1 + F.col("delta")) / F.col("paths")).alias("part"))
        summed = handed.groupBy("source", "node").agg(F.sum("part").alias("part"))
        above = seen.where(F.col("level") == back - 1)
        dependency = durable(
            above.join(summed, ["source", "node"], "left").select(
                "source", "node", "paths", (F.col("paths") * F.coalesce("part", F.lit(0.0))).alias("delta")
            )
        )
        collected = collected.unionByName(dependency)
    return durable(collected.where(F.col("source") != F.col("node")).groupBy("node").agg(F.sum("delta").alias("delta")))


def cluster_risk(components: DataFrame, shares: DataFrame, accounts: DataFrame) -> DataFrame:
    """(component, cluster_risk, flagged_mules): summed fraud share and flagged accounts per component."""
    members = components.select("component", F.col("node").alias("account_token"))
    rows = members.join(shares, "account_token").join(accounts.select("account_token", "is_mule"), "account_token", "left")
    return rows.groupBy("component").agg(F.sum("fraud_share").alias("cluster_risk"), F.count_if("is_mule").alias("flagged_mules"))


def scope_network(nodes: DataFrame, edges: DataFrame, visible: DataFrame, shares: DataFrame, max_nodes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Keep accounts in scope, the other nodes they touch, and the edges between kept nodes.

    ``max_nodes`` limits what is drawn: nodes with the greatest fraud share, then degree, come first.
    """
    allowed = nodes.where("type = 'account'").join(visible.select(F.col("account_token").alias("id")), "id", "left_semi").select("id", "type")
    own = allowed.select("id")
    touching = edges.join(own.select(F.col("id").alias("src")), "src", "left_semi").select(edges.columns).unionByName(
        edges.join(own.select(F.col("id").alias("dst")), "dst", "left_semi").select(edges.columns)
    ).distinct()
    foreign = nodes.where("type = 'account'").join(own, "id", "left_anti").select("id")
    for side in ("src", "dst"):
        touching = touching.join(foreign.select(F.col("id").alias(side)), side, "left_anti").select(edges.columns)
    ends = touching.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    kept = allowed.unionByName(nodes.where("type <> 'account'").join(ends, "id", "left_semi").select("id", "type"))
    if max_nodes is not None:
        degree = touching.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("_d"))
        ranked = kept.join(shares.select(F.col("account_token").alias("id"), "fraud_share"), "id", "left").join(degree, "id", "left")
        ranked = ranked.na.fill(0.0, ["fraud_share"]).na.fill(0, ["_d"])
        kept = ranked.orderBy(F.col("fraud_share").desc(), F.col("_d").desc(), "id").limit(max_nodes).select("id", "type")
        for side in ("src", "dst"):
            touching = touching.join(kept.select(F.col("id").alias(side)), side, "left_semi").select(edges.columns)
    return kept, touching
