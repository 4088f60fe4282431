"""Shards by a hierarchical weighted hash tree (operator 11).

Method: a row goes down from the root by regions, racks and shards. At every node each child draws a number from the
row's key, the child's path and the seed, -ln(u) / weight, and the smallest draw takes the row; a child's weight is the
sum of the shards below it. A draw depends on nothing but key, path and weight. So after a change of weights a row can
change its child only at a node where some child's weight has changed, to or from that child: rows that choose another
region before and after keep their shard, and inside a changed region so do the rows of all other racks. A shard that
comes as a region of its own (``grown``) takes rows only into itself.

Shards are numbered without a global sort in one task: rows lie in range blocks over (shard, order), and each block adds
the number of the shard's rows in the blocks before.

Native: DataFrame functions only. Draws come from the MD5 digest, so that any SQL engine can repeat them.

Defined cases: a null key is a key like any other (the text ``null`` after a sign of its own); rows with one key share a shard; rows that tie in
the whole order of slots are numbered in any order among themselves. Extra columns come along, except those named like a
result column or like a column of the order's own (``_block``). Texts of any length only ride along. An empty table gives an
empty result. Leaves of weight 0 get no rows; a tree needs one weight above 0.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outflow.functions.ordering import BLOCK, numbered

DRAW_BITS = 52


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def uniform(shards: int, racks: int = 2, per_rack: int = 2) -> list[Leaf]:
    """Shards 0 to ``shards - 1`` of weight 1, ``per_rack`` to a rack and ``racks`` racks to a region."""
    return [Leaf(i // (racks * per_rack), i // per_rack % racks, i) for i in range(shards)]


def grown(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one shard more, as a region of its own."""
    return [*tree, Leaf(max(x.region for x in tree) + 1, 0, max(x.shard for x in tree) + 1, weight)]


def draw(key: Column, path: str, weight: float) -> Column:
    """-ln(u) / weight with u in (0, 1) from the digest of seed, path and key; the digest's text is ``path:key``."""
    digits = F.substring(F.md5(F.concat(F.lit(path + ":"), key)), 1, DRAW_BITS // 4)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << DRAW_BITS)
    return -F.ln(u) / F.lit(float(weight))


def key_text(key: Column) -> Column:
    return F.when(key.isNull(), F.lit("-null")).otherwise(F.concat(F.lit("+"), key.cast("string")))


def descend(rows: DataFrame, key: str, tree: list[Leaf], name: str, seed: int = 11) -> DataFrame:
    """Add the shard of every row as ``name``; the column ``key`` holds the key's text.

    One column per level, so that a row draws at the nodes of its own path only, and each draw once.
    """
    if len({x.shard for x in tree}) < len(tree) or not any(x.weight > 0 for x in tree) or any(x.weight < 0 for x in tree):
        raise ValueError("a tree needs distinct shards, no negative weight and one above 0")
    nodes: dict[tuple[int, ...], dict[int, float]] = defaultdict(lambda: defaultdict(float))
    for leaf in tree:
        if leaf.weight > 0:
            path = (leaf.region, leaf.rack, leaf.shard)
            for depth in range(3):
                nodes[path[:depth]][path[depth]] += leaf.weight
    levels = [f"_{name}_{level}" for level in ("region", "rack")] + [name]
    for depth, level in enumerate(levels):
        choice = None
        for path, children in sorted(nodes.items()):
            if len(path) != depth:
                continue
            drawn = [
                F.struct(draw(F.col(key), "/".join(map(str, (seed, *path, child))), weight).alias("draw"), F.lit(child).alias("child"))
                for child, weight in sorted(children.items())
            ]
            least = F.array_min(F.array(*drawn))["child"] if len(drawn) > 1 else F.lit(min(children))
            here = F.lit(True)
            for upper, node in zip(levels, path):
                here &= F.col(upper) == node
            choice = F.when(here, least) if choice is None else choice.when(here, least)
        rows = rows.withColumn(level, choice)
    return rows.drop(*levels[:2])


def place(
    rows: DataFrame, tree: list[Leaf], key: str = "doc_id", order: tuple[str, ...] = ("doc_id",), after: list[Leaf] | None = None, seed: int = 11
) -> DataFrame:
    """The rows with their shard, their slot in it (from 0, in the order given, nulls first) and, if a tree ``after`` is given, their ``grown_shard``."""
    own = {"shard", "slot", "grown_shard", BLOCK}
    kept = [c for c in rows.columns if c not in own]
    named = {f"_c{i}": c for i, c in enumerate(kept)}
    dealt = rows.select(
        *[F.col(f"`{c}`").alias(n) for n, c in named.items()], key_text(F.col(f"`{key}`")).alias("_key"), F.monotonically_increasing_id().alias("_row")
    )
    dealt = descend(dealt, "_key", tree, "shard", seed)
    dealt = (descend(dealt, "_key", after, "grown_shard", seed) if after else dealt).drop("_key")
    name_of = {c: n for n, c in named.items()}
    # The row number comes last, so that any number of equal rows may lie in many blocks.
    laid = numbered(dealt, ["shard"], [*[F.col(name_of[c]).asc_nulls_first() for c in order], F.col("_row")], "slot")
    return laid.select(
        *[F.col(n).alias(c) for n, c in named.items()], "shard", (F.col("slot") - 1).alias("slot"), *(["grown_shard"] if after else [])
    )


def write_shards(placed: DataFrame, path: str) -> None:
    """Parquet folders ``shard=N``, rows in the order of their slots inside a file; a shard is as many files as it has range blocks."""
    parts = placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    parts.write.mode("overwrite").partitionBy("shard").parquet(path)
