"""The transfer graph: degrees, rank, chain depth, terminal risk, money trails, and a backtest.

Parallel transfers are merged into weighted edges first. The iterative operators keep one small row per node
between rounds, written to the checkpoint folder, and fetch at most one flag per round.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outflow.functions import scalar as fx
from outflow.functions.ordering import numbered
from outflow.operators.aggregates import exact_sum
from outflow.operators.listing import at
from outflow.operators.metrics import top_rows
from outflow.session import durable, shuffle_width

# Weights of in-degree, terminal ratio, depth, rank and inflow in the terminal risk.
RISK_WEIGHTS = (0.30, 0.25, 0.15, 0.15, 0.15)
HOT_EDGES = 1_000_000  # out-edges of one node per slice before its edges are spread over several slices
HOT_GROUPS = 100_000  # such nodes that are sent to every task; beyond, the planner joins them
SENT_NODES = 100_000  # accounts of a trail that are sent to the edges, which then lie still; beyond, the planner joins them


def weighted_edges(transfers: DataFrame) -> DataFrame:
    """(src, dst, w, amount): one row per ordered pair, with the number of transfers and their total."""
    return transfers.groupBy(F.col("from_token").alias("src"), F.col("to_token").alias("dst")).agg(
        F.count("*").alias("w"), exact_sum("amount").alias("amount")
    )


def fixed_edges(transfers: DataFrame) -> DataFrame:
    """Weighted edges written down once, for the operators that read them many times."""
    return durable(weighted_edges(transfers))


def node_stats(edges: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree, inflow, n_in, n_out, pairs) from one pass over the edges.

    Degrees count parallel transfers; n_in and n_out count the edges from and to other nodes, pairs all edges out.
    """
    none, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    other = F.when(F.col("src") != F.col("dst"), one).otherwise(none)
    amount = F.col("amount") if "amount" in edges.columns else F.lit(0.0)
    end = lambda **c: F.struct(*[v.alias(k) for k, v in c.items()])
    ends = edges.select(
        F.inline(
            F.array(
                end(node=F.col("src"), i=none, o=F.col("w"), a=F.lit(0.0), x=none, y=other, p=one),
                end(node=F.col("dst"), i=F.col("w"), o=none, a=amount, x=other, y=none, p=none),
            )
        )
    )
    return ends.groupBy("node").agg(
        F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), exact_sum("a").alias("inflow"),
        F.sum("x").alias("n_in"), F.sum("y").alias("n_out"), F.sum("p").alias("pairs"),
    )


def transfer_nodes(edges: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree, inflow): degrees count parallel transfers."""
    return node_stats(edges).select("node", "in_degree", "out_degree", "inflow")


class Placed(NamedTuple):
    """A graph whose edges lie still, partitioned and sorted by source, while the nodes' values come to them.

    The edges of a node with very many of them lie in several slices, and the node sends its value to each.
    """

    nodes: DataFrame
    links: DataFrame
    hot: DataFrame | None

    def sent(self, senders: DataFrame) -> DataFrame:
        """The links out of the senders, with the senders' other columns."""
        rows = senders.withColumnRenamed("node", "src")
        if self.hot is None:
            return self.links.join(rows, "src")
        each = F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1))
        return self.links.join(rows.join(self.hot, "src", "left").withColumn("slice", each).drop("slices"), ["src", "slice"])


def place(edges: DataFrame, hot_edges: int = HOT_EDGES) -> Placed:
    """The edges (src, dst, w) moved once, for all rounds of the operators that follow them; ``links`` is to be unpersisted by the caller."""
    nodes = durable(node_stats(edges))
    hot = durable(nodes.where((F.col("pairs") > hot_edges) & F.col("node").isNotNull()).select(
        F.col("node").alias("src"), F.ceil(F.col("pairs") / hot_edges).cast("int").alias("slices")
    ))
    links, keys, groups = edges.select("src", "dst", "w").where("src IS NOT NULL"), ["src"], hot.count()
    if groups:
        hot, keys = F.broadcast(hot) if groups <= HOT_GROUPS else hot, ["src", "slice"]
        of = F.pmod(F.xxhash64("dst"), F.coalesce("slices", F.lit(1))).cast("int")
        links = links.join(hot, "src", "left").withColumn("slice", of).drop("slices")
    links = links.repartition(shuffle_width(edges.sparkSession), *keys).sortWithinPartitions(*keys).persist(StorageLevel.MEMORY_AND_DISK)
    return Placed(nodes, links, hot if groups else None)


def pagerank(
    edges: DataFrame, damping: float = 0.85, iterations: int = 40, hot_edges: int = HOT_EDGES, placed: Placed | None = None
) -> DataFrame:
    """(node, page_rank) after a fixed number of iterations, dangling mass spread evenly, largest rank = 1.

    With M the transition matrix, an iteration is x' = d M x + c 1, where c depends only on the dangling mass of x.
    So x is a combination of the vectors u_k = M^k 1, and only those need the graph: u_k is made from u_(k-1) by
    one join, keeps only its non-zero rows and, where money cannot flow on in circles, soon has none. The
    coefficients follow from one number per k, the dangling sum of u_k.
    """
    graph = place(edges, hot_edges) if placed is None else placed
    pays = F.col("node").isNotNull() & (F.col("out_degree") > 0)
    nodes = graph.nodes.select("node", F.when(pays, F.col("out_degree")).alias("out_w"))
    n, sinks = nodes.agg(F.count("*"), F.count_if(F.col("out_w").isNull())).first()
    if n == 0:
        return nodes.select("node", F.lit(0.0).alias("page_rank"))

    current = nodes.withColumn("u", F.lit(1.0))
    powers: list[DataFrame] = []
    dangling = [float(sinks)]
    for _ in range(iterations):
        received = graph.sent(current.where(F.col("out_w").isNotNull())).groupBy(F.col("dst").alias("node")).agg(
            F.sum(F.col("u") * (F.col("w") / F.col("out_w"))).alias("u")
        )
        current = durable(received.join(nodes, "node", "left"))
        rows, paying, lost = current.agg(F.count("*"), F.count("out_w"), F.sum(F.when(F.col("out_w").isNull(), F.col("u")))).first()
        if rows == 0:
            break
        powers.append(current)
        dangling.append(lost or 0.0)
        if paying == 0:
            # Nothing flows on: the next vector has no rows.
            break

    weights = [1.0 / n]
    for _ in range(iterations):
        mass = sum(w * s for w, s in zip(weights, dangling))
        weights = [(1.0 - damping) / n + damping * mass / n, *[damping * w for w in weights]]
    total = nodes.select("node", F.lit(weights[0]).alias("x"))
    for power, weight in zip(powers, weights[1:]):
        total = total.unionByName(power.select("node", (F.col("u") * weight).alias("x")))
    ranks = durable(total.groupBy("node").agg(F.sum("x").alias("rank")))
    if placed is None:
        graph.links.unpersist()
    return ranks.select("node", (F.col("rank") / ranks.agg(F.max("rank")).scalar()).alias("page_rank"))


def chain_depth(edges: DataFrame, hot_edges: int = HOT_EDGES, placed: Placed | None = None) -> DataFrame:
    """(node, depth) from weighted edges: longest path from any source, 0 where no source reaches.

    Nodes on a common cycle count as one, at the depth at which the longest path enters it. There is no limit of depth:
    runs of nodes with one way in and one way out are shortened by jumps, and the rest is peeled off by in-degree; what
    is left then lies on cycles or behind them, so the cycles are contracted and the peeling starts anew.
    """
    graph = placed
    if graph is None:
        graph = place(durable(edges.select("src", "dst").distinct().withColumn("w", F.lit(1).cast("bigint"))), hot_edges)
    # A source has no way in, not even from itself.
    nodes = graph.nodes.select("node", "n_in", "n_out", (F.col("in_degree") == 0).alias("root"))
    found, left = _peel(graph, nodes)
    if not left.isEmpty():
        pairs = graph.links.select("src", "dst").where("src <> dst")
        inner = pairs.join(left.select(F.col("node").alias("src")), "src", "left_semi").join(left.select(F.col("node").alias("dst")), "dst", "left_semi")
        groups = cycle_groups(inner.select("src", "dst"))
        named = durable(nodes.join(groups, "node", "left").select("node", F.coalesce("cycle", "node").alias("cycle"), "root"))
        ends = lambda c: named.select(F.col("node").alias(c), F.col("cycle").alias(f"{c}_cycle"))
        contracted = pairs.join(ends("src"), "src").join(ends("dst"), "dst").where("src_cycle <> dst_cycle")
        contracted = durable(contracted.select(F.col("src_cycle").alias("src"), F.col("dst_cycle").alias("dst")).distinct().withColumn("w", F.lit(1).cast("bigint")))
        inside = place(contracted, hot_edges)
        # The node that names a cycle is on it, so a source keeps its own name.
        whole = named.where("node = cycle").select("node", "root").join(inside.nodes.select("node", "n_in", "n_out"), "node", "left").na.fill(0, ["n_in", "n_out"])
        found, _ = _peel(inside, durable(whole))
        inside.links.unpersist()
        found = named.join(found.withColumnRenamed("node", "cycle"), "cycle").select("node", "depth")
    depths = durable(nodes.join(found, "node", "left").select("node", F.coalesce("depth", F.lit(0)).cast("int").alias("depth")))
    if placed is None:
        graph.links.unpersist()
    return depths


def _peel(graph: Placed, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Depths of the nodes (node, n_in, n_out, root) that no cycle leads to (null where no root does), and the nodes left over."""
    runners = nodes.where("n_in = 1 AND n_out = 1").select("node")
    # A run as a step from its head to the node behind it.
    steps = inside = None
    if not runners.isEmpty():
        into = graph.links.where("src <> dst").join(runners.select(F.col("node").alias("dst")), "dst")
        run = durable(into.select(F.col("dst").alias("node"), F.col("src").alias("head"), F.lit(1).cast("bigint").alias("steps"), F.lit(True).alias("open")))
        # Nodes in a run jump to the node that the run hangs on; a run that is a ring never gets there.
        reach, size = 0, run.count()
        while True:
            ahead = run.select(F.col("node").alias("head"), F.col("head").alias("next"), F.col("steps").alias("more"))
            run = durable(run.join(ahead, "head", "left").select(
                "node", F.coalesce("next", "head").alias("head"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("next").isNotNull().alias("open")
            ))
            still = run.where("open").count()
            # After as many doublings as the longest possible run has, only rings are open.
            reach += 1
            if still == 0 or 2**reach > size:
                break
        inside = run.where("NOT open").select("node", "head", "steps")
        out = graph.sent(inside).where("src <> dst").select("head", "dst", "steps").join(run.select(F.col("node").alias("dst")), "dst", "left_anti")
        steps = durable(out.select(F.col("head").alias("src"), "dst", (F.col("steps") + 1).alias("steps")))

    plain = nodes if inside is None else nodes.join(run.select("node"), "node", "left_anti")
    none = F.lit(None).cast("bigint")
    waiting = durable(plain.select("node", F.col("n_in").alias("missing"), "n_out", F.when(F.col("root"), F.lit(0).cast("bigint")).otherwise(none).alias("depth")))
    ready, waiting = waiting.where("missing = 0"), waiting.where("missing > 0")
    done = [ready]
    while not (going := ready.where("n_out > 0").select("node", "depth")).isEmpty():
        # Offers to nodes on runs find nobody waiting.
        offers = graph.sent(going).where("src <> dst").select("dst", (F.col("depth") + 1).alias("offer"))
        if steps is not None:
            offers = offers.unionByName(steps.join(going.withColumnRenamed("node", "src"), "src").select("dst", (F.col("depth") + F.col("steps")).alias("offer")))
        sent = offers.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("came"), F.max("offer").alias("offer"))
        waiting = durable(waiting.join(sent, "node", "left").select(
            "node", (F.col("missing") - F.coalesce("came", F.lit(0))).alias("missing"), "n_out", F.greatest("depth", "offer").alias("depth")
        ))
        ready, waiting = waiting.where("missing = 0"), waiting.where("missing > 0")
        done.append(ready)
    heads = done[0].select("node", "depth")
    for more in done[1:]:
        heads = heads.unionByName(more.select("node", "depth"))
    if inside is not None:
        heads = durable(heads)
        on_run = inside.join(heads.withColumnRenamed("node", "head"), "head").select("node", (F.col("depth") + F.col("steps")).alias("depth"))
        heads = heads.unionByName(on_run)
    found = durable(heads)
    return found, nodes.where("node IS NOT NULL").select("node").join(found.select("node"), "node", "left_anti")


def cycle_groups(pairs: DataFrame) -> DataFrame:
    """(node, cycle): for every node of the pairs the smallest node that it can reach and that can reach it.

    Each pass drops the nodes without a way in or out, which are on no cycle; colours the rest by the largest node that reaches them; and
    settles, for each colour, what reaches its own name back.
    """
    alone = pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct().select("node", F.col("node").alias("cycle"))
    edges, settled = durable(pairs), []
    while not edges.isEmpty():
        both = edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_semi")
        trimmed = _within(edges, both)
        size = edges.count()
        edges = durable(trimmed)
        if edges.count() < size:
            continue
        colours = _spread(edges, edges.select(F.col("src").alias("node")).distinct().select("node", F.col("node").alias("colour")))
        tint = lambda c: colours.select(F.col("node").alias(c), F.col("colour").alias(f"{c}_colour"))
        same = durable(edges.join(tint("src"), "src").join(tint("dst"), "dst").where("src_colour = dst_colour"))
        # Back from the node that named the colour.
        reached = durable(colours.where("node = colour"))
        fresh = reached
        while not fresh.isEmpty():
            back = same.join(fresh.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node"), F.col("src_colour").alias("colour"))
            fresh = durable(back.distinct().join(reached.select("node"), "node", "left_anti"))
            reached = durable(reached.unionByName(fresh))
        settled.append(reached)
        rest = colours.join(reached.select("node"), "node", "left_anti").select("node")
        edges = durable(_within(edges, rest))
    if not settled:
        return alone
    found = settled[0]
    for more in settled[1:]:
        found = found.unionByName(more)
    names = found.groupBy("colour").agg(F.min("node").alias("cycle"))
    named = found.join(names, "colour").select("node", F.col("cycle").alias("name"))
    return durable(alone.join(named, "node", "left").select("node", F.coalesce("name", "cycle").alias("cycle")))


def _within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    kept = edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    return kept.select("src", "dst")


def _spread(edges: DataFrame, colours: DataFrame) -> DataFrame:
    """The largest colour that reaches each node along the edges."""
    colours = durable(colours)
    fresh = colours
    while not fresh.isEmpty():
        sent = edges.join(fresh.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("offer"))
        moved = durable(colours.join(sent, "node", "left").select("node", F.greatest("colour", "offer").alias("colour"), (F.col("offer") > F.col("colour")).alias("rose")))
        colours, fresh = moved.select("node", "colour"), moved.where("rose").select("node", "colour")
    return colours


def terminal_risk(edges: DataFrame, ranks: DataFrame | None = None, depths: DataFrame | None = None) -> DataFrame:
    """One row per account: degrees, inflow, depth, rank and the terminal cash-out risk in [0, 1]."""
    # Ranks and depths follow the same edges, which are moved once for both.
    graph = place(edges)
    ranks = pagerank(edges, placed=graph) if ranks is None else ranks
    depths = chain_depth(edges, placed=graph) if depths is None else depths
    graph.links.unpersist()
    rows = graph.nodes.select("node", "in_degree", "out_degree", "inflow").join(ranks, "node").join(depths, "node")
    tops = rows.agg(
        F.struct(F.max("in_degree").alias("i"), F.max("inflow").alias("a"), F.max("depth").alias("d"))
    ).scalar()
    known = rows.withColumn("_m", tops)
    safe = lambda c, floor: F.greatest(F.col(c).cast("double"), F.lit(floor))
    ratio = F.col("in_degree") / F.greatest(F.col("in_degree") + F.col("out_degree"), F.lit(1))
    ratio = F.when(F.col("out_degree") == 0, F.least(ratio + 0.15, F.lit(1.0))).otherwise(ratio)
    a, b, c, d, e = RISK_WEIGHTS
    inflow = F.when(F.col("_m.a") > 0, F.col("inflow") / F.col("_m.a")).otherwise(0.0)
    score = (
        a * F.col("in_degree") / safe("_m.i", 1.0) + b * ratio + c * F.least(F.col("depth") / safe("_m.d", 1.0), F.lit(1.0))
        + d * F.col("page_rank") + e * inflow
    )
    return known.select(
        F.col("node").alias("account_token"), "in_degree", "out_degree", F.col("inflow").alias("inflow_inr"),
        F.col("depth").alias("chain_depth"), "page_rank", fx.rounded(F.least(score, F.lit(1.0))).alias("terminal_risk"),
    )


def top_terminal(risk: DataFrame, k: int = 50, min_in_degree: int = 1, visible: DataFrame | None = None) -> DataFrame:
    """The k riskiest accounts, optionally only those in scope."""
    rows = risk.where(F.col("in_degree") >= min_in_degree)
    if visible is not None:
        rows = rows.join(visible.select("account_token"), "account_token", "left_semi")
    return rows.orderBy(F.col("terminal_risk").desc(), "account_token").limit(k)


def _meeting(edges: DataFrame, nodes: DataFrame, end: str, few: int = SENT_NODES) -> DataFrame:
    """The edges with one of the nodes (node), written down before, at the end named: a few nodes go to the edges, and only what meets them moves on."""
    named = nodes.select(F.col("node").alias(end))
    return edges.join(F.broadcast(named) if nodes.count() <= few else named, end, "left_semi").select(edges.columns)


def money_trail(edges: DataFrame, account: str, branches: int | None = None, hops: int | None = None, chains: int | None = None, few: int = SENT_NODES) -> DataFrame:
    """(chain_no, chain, cut): the chains of senders that lead to an account, source first.

    The edges are read once per step, so they should be written down; those that go on a step are written down for it.

    Senders are followed by falling amount; an account that is already on the chain is not entered again. All chains are returned unless a
    display asks for less (on graphs of many cycles ask for ``chains``, or take the whole as ``trail_graph``): at most ``branches`` senders per account, ``hops`` steps, ``chains`` chains in depth-first order. ``cut`` marks a
    chain that ended at the limit of steps.
    """
    spark = edges.sparkSession
    paths = durable(spark.range(1).select(
        F.array().cast("array<int>").alias("key"), F.array(F.lit(account)).alias("path"), F.lit(False).alias("done")
    ))
    step = 0
    while hops is None or step < hops:
        step += 1
        open_ = paths.where(~F.col("done"))
        tips = open_.select("key", "path", F.element_at("path", -1).alias("dst"))
        ends = durable(tips.select(F.col("dst").alias("node")).distinct())
        step_edges = durable(_meeting(edges.select("src", "dst", "amount"), ends, "dst", few))
        into = step_edges.join(tips, "dst").where(~F.array_contains("path", F.col("src")))
        # The senders of one account: a chain has a group of its own.
        order = Window.partitionBy("key").orderBy(F.col("amount").desc(), "src")
        followed = into.withColumn("b", F.row_number().over(order))
        if branches is not None:
            followed = followed.where(F.col("b") <= branches)
        longer = followed.select(
            F.concat("key", F.array("b")).alias("key"), F.concat("path", F.array("src")).alias("path"), F.lit(False).alias("done")
        )
        ended = open_.join(into.select("key").distinct(), "key", "left_anti").withColumn("done", F.lit(True))
        grown = paths.where("done").unionByName(longer).unionByName(ended)
        # Any open chain yields a full one in its place, so the first ``chains`` are enough.
        paths = durable(grown.orderBy("key").limit(chains) if chains is not None else grown)
        if paths.where(~F.col("done")).isEmpty():
            break
    placed = numbered(paths, [], [F.col("key")], "chain_no")
    return placed.select(F.col("chain_no").cast("int").alias("chain_no"), F.reverse("path").alias("chain"), (~F.col("done")).alias("cut"))


def trail_graph(edges: DataFrame, account: str, hops: int | None = None, compact: int = 16, few: int = SENT_NODES) -> DataFrame:
    """The transfers whose receiver is the account or passes money on to it, with ``hops``: the fewest steps from the sender, by this transfer, to the account.

    The whole sub-graph in as many rounds as its longest shortest way, however many chains and cycles it holds; ``money_trail`` lists single
    chains. Transfers out of the account itself are left out. An account that nothing leads to has no rows. ``hops`` ends the search there;
    found accounts lie in one file per round, put together every ``compact`` rounds. The edges are read once per round, so they should be
    written down; no copy of them is made.
    """
    links = edges.where(F.col("src") != account).select("src", "dst").where("src <> dst")
    found = frontier = durable(edges.sparkSession.range(1).select(F.lit(account).alias("node"), F.lit(0).alias("far")))
    step = 0
    while hops is None or step < hops - 1:
        step += 1
        senders = _meeting(links, frontier, "dst", few).select(F.col("src").alias("node")).distinct()
        frontier = durable(senders.join(found, "node", "left_anti").select("node", F.lit(step).alias("far")))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
        if step % compact == 0:
            found = durable(found)
    reached = found.select(F.col("node").alias("dst"), (F.col("far") + 1).alias("hops"))
    reached = F.broadcast(reached) if found.count() <= few else reached
    inward = edges.where(F.col("src") != account).join(reached, "dst")
    return inward.select(*[edges[c] if c != "dst" else F.col("dst") for c in edges.columns if c != "hops"], reached["hops"])


def trail_edges(edges: DataFrame, trail: DataFrame, limit: int | None = None, few: int = SENT_NODES) -> DataFrame:
    """Transfers touching the accounts of a trail, largest first; all of them unless a display asks for less."""
    nodes = durable(trail.select(F.explode("chain").alias("node")).distinct())
    touching = _meeting(edges, nodes, "src", few).unionByName(_meeting(edges, nodes, "dst", few)).distinct().orderBy(F.col("amount").desc(), "src", "dst")
    return touching if limit is None else touching.limit(limit)


def fraud_cashout_accounts(withdrawals: DataFrame, split: datetime, days: int = 5) -> DataFrame:
    """Accounts with a fraud withdrawal in (split, split + days]."""
    ts = F.col("timestamp")
    return withdrawals.where(
        F.col("is_fraud_withdrawal") & (ts > at(split)) & (ts <= at(split + timedelta(days=days)))
    ).select("account_token").distinct()


def graph_backtest(risk: DataFrame, positives: DataFrame, ks: Sequence[int] = (10, 50, 100), seed: int = 7) -> DataFrame:
    """(ranking, k, precision, recall) of terminal risk, inflow, in-degree and a seeded random order."""
    total = positives.agg(F.count("*")).scalar()
    marked = risk.join(positives.withColumn("label", F.lit(1)), "account_token", "left").na.fill(0, ["label"])
    rankings = {
        "terminal_risk": F.col("terminal_risk"), "inflow": F.col("inflow_inr"), "in_degree": F.col("in_degree").cast("double"),
        # A digest, so that any engine can repeat the order.
        "random": F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "account_token")), 1, 13), 16, 10).cast("double"),
    }
    out = None
    for name, value in rankings.items():
        best = top_rows(marked.select("account_token", "label", value.alias("score")), max(ks), ["account_token"])
        each = best.select("rank", "label", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")).where(F.col("rank") <= F.col("k"))
        one = each.groupBy("k").agg(F.avg("label").alias("p"), F.sum("label").alias("hits")).select(
            F.lit(name).alias("ranking"), "k", fx.rounded(F.col("p")).alias("precision"),
            fx.rounded(F.col("hits") / F.greatest(total, F.lit(1))).alias("recall"),
        )
        out = one if out is None else out.unionByName(one)
    return out
