"""Documents linked by the Jaccard similarity of their word shingles (operator 7).

Method: vertical partitioning. A sketch of document frequencies (see exchange.py) puts all shingles into one global
order, rare ones first: by the logarithm of the estimated frequency, then by hash. The order is cut into fragments,
and every document into one segment per fragment. The overlap of a pair of documents is counted fragment by fragment,
as separate rows, and summed per pair; so a hot document is spread over its fragments.

Which pairs are counted:

* A shingle estimated to occur in one document does so (the sketch never counts too low). A document with too few
  other shingles for the threshold links with nothing and is done.
* Documents of equal shingle sets form one class; only one of them goes on.
* Linked documents share a shingle among the first few of either in the global order (prefix filter). Of each such
  list, every member is first paired with one centre only, whatever the length of the list. Members that end up in
  the centre's component need no further pairs, as only reachability is asked for. Those that do not are paired with
  the list's members of other components, where both have enough shingles left, shared with any document, for the
  threshold (positional filter). No linked pair is left out: it is counted, or already connected.

Defined cases: null and empty texts have no shingles and link with nothing; texts shorter than a shingle have one, the
whole sequence; rows with one id are separate documents that share the id; a null id never names a component of
documents with ids. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outflow.llm import exchange as X
from outflow.llm.words import split, window_starts, windows
from outflow.operators.network import connected_components
from outflow.session import durable

BASE = "doc_id bigint, uid bigint, n_shingles bigint, set_id binary, shared bigint, weight double, prefix array<bigint>, segments array<struct<frag:int,tokens:array<bigint>>>"
CUTS_LOG2 = 2
SEGMENTS = pa.list_(pa.struct([("frag", pa.int32()), ("tokens", pa.list_(pa.int64()))]))


def shingle_sets(table: pa.Table, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    words = split(table.column("text"), lower=True)
    (hashes,) = words.hashes(11)
    shingles = windows(hashes, width, 12)
    inside = window_starts(words.first, width, len(hashes))
    sets = []
    for a, b in zip(words.first[:-1], words.first[1:]):
        if b - a >= width:
            sets.append(np.unique(shingles[a : b - width + 1]))
        else:
            sets.append(windows(hashes[a:b], b - a, 12) if b > a else np.zeros(0, np.uint64))
    assert not len(inside) or inside.sum() == sum(max(0, b - a - width + 1) for a, b in zip(words.first[:-1], words.first[1:]))
    return sets


def link_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90, spare: int = 16) -> DataFrame:
    """(doc_id, n_shingles, component_id): linked when 100 * intersection >= percent * union of the shingle sets."""
    narrow = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = X.text_bytes(narrow, "text")
    narrow = narrow.withColumn("uid", F.coalesce("doc_id", F.lit(-(1 << 63))))
    dealt = narrow.withColumn("grp", X.hash_group(X.group_count(size), "uid", "text"))
    sketch = X.Sketch(size / 6, 1, spare)

    def sketched(table: pa.Table) -> pa.Table:
        sets = shingle_sets(table, width)
        return X.to_table(list(sketch.lists(table.column("grp")[0].as_py(), np.concatenate(sets))), X.LIST_NAMES, X.LIST_TYPES)

    def judged(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = table.sort_by("uid")
        sets = shingle_sets(table, width)
        cells = sketch.cells(np.concatenate(sets) if sets else np.zeros(0, np.uint64), 0)
        known = np.unique(cells)
        level = sketch.answers(known, 0, answers, lambda blob, n: np.frombuffer(zlib.decompress(blob), np.uint8))
        levels = level[np.searchsorted(known, cells)] if len(cells) else np.zeros(0, np.uint8)
        set_ids, prefixes, segments, shared_counts, weights, seen, at = [], [], [], [], [], set(), 0
        for own in sets:
            n, rank = len(own), levels[at : at + len(own)]
            at += n
            need = (percent * n + 99) // 100
            shared = int(np.count_nonzero(rank))
            shared_counts.append(shared)
            weights.append(float(rank.mean()) if n else 0.0)
            if n == 0 or shared < need:
                set_ids.append(None)
                prefixes.append(None)
                segments.append(None)
                continue
            name = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
            set_ids.append(name)
            if name in seen:
                prefixes.append(None)
                segments.append(None)
                continue
            seen.add(name)
            own, rank = own[rank > 0], rank[rank > 0]
            order = np.argsort(rank, kind="stable")
            own, rank = own[order], rank[order]
            prefixes.append(own[: n - need + 1 - (n - shared)].view(np.int64))
            frag = (rank.astype(np.int32) << CUTS_LOG2) + (own >> np.uint64(64 - CUTS_LOG2)).astype(np.int32)
            cut = np.flatnonzero(np.diff(frag, prepend=-1))
            segments.append([{"frag": int(frag[c]), "tokens": part} for c, part in zip(cut, np.split(own.view(np.int64), cut[1:]))])
        return pa.table({
            "doc_id": table.column("doc_id").combine_chunks(), "uid": table.column("uid").combine_chunks(),
            "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "set_id": pa.array(set_ids, pa.binary()),
            "shared": pa.array(shared_counts, pa.int64()), "weight": pa.array(weights, pa.float64()),
            "prefix": pa.array(prefixes, pa.list_(pa.int64())), "segments": pa.array(segments, SEGMENTS),
        })

    lists = dealt.groupBy("grp").applyInArrow(sketched, X.LISTS)
    logs = lambda n: zlib.compress(np.log2(np.maximum(n, 1)).astype(np.uint8).tobytes(), 1)
    answers = lists.groupBy("shard").applyInArrow(sketch.merger(logs), X.ANSWERS)
    base = durable(dealt.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(lambda left, right: judged(left, right), BASE))

    alive = base.where("set_id IS NOT NULL")
    first = alive.where("prefix IS NOT NULL").groupBy("set_id").agg(F.min("uid").alias("uid"))
    nodes = alive.where("prefix IS NOT NULL").join(first, ["set_id", "uid"], "left_semi")
    # What a pair can still share from a place of the list on.
    lists = nodes.select("set_id", F.col("n_shingles").alias("n"), "weight", "shared", F.posexplode("prefix").alias("pos", "token"))
    lists = lists.select("token", "set_id", "n", "weight", (F.col("shared") - F.col("pos")).alias("left"))
    segments = nodes.select("set_id", F.explode("segments").alias("s")).select("set_id", "s.frag", "s.tokens")

    def may_link(n: str, left: str, other_n: str, other_left: str) -> Column:
        """At the first shingle that a linked pair has in common, each has enough left."""
        return (100 + percent) * F.least(left, other_left) >= percent * (F.col(n) + F.col(other_n))

    # The member with the most frequent shingles is nearest to what the list's members have in common.
    head = F.min(F.struct((-F.col("weight")).alias("w"), "set_id", "n", "left"))
    centres = lists.groupBy("token").agg(head.alias("c"), F.count("*").alias("k")).where("k > 1").select(
        "token", F.col("c.set_id").alias("a"), F.col("c.n").alias("na"), F.col("c.left").alias("la")
    )
    pairs = lists.join(centres, "token").where(F.col("set_id") != F.col("a")).where(may_link("n", "left", "na", "la"))
    pairs = durable(pairs.select("a", F.col("set_id").alias("b"), "na", F.col("n").alias("nb")).distinct())
    edges = durable(_linked(pairs, segments, percent))
    groups = durable(connected_components(edges.toDF("src", "dst")))

    # Members of a list that are not in its centre's component.
    placed = lists.join(groups.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    head = F.min(F.struct((-F.col("weight")).alias("w"), "set_id", "component"))
    heads = placed.groupBy("token").agg(head.alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    open_lists = placed.join(heads.select("token", F.col("c.set_id").alias("a"), F.col("c.component").alias("ca")), "token")
    odd = open_lists.where("component <> ca").select(
        "token", F.col("set_id").alias("x"), F.col("n").alias("nx"), F.col("left").alias("lx"), F.col("component").alias("cx")
    )
    # The centre has been paired with all members. Two odd members meet twice: the distinct rows are the same.
    rest = open_lists.where("set_id <> a").select("token", "set_id", "n", "left", "component")
    more = rest.join(odd, "token").where("component <> cx").where(may_link("n", "left", "nx", "lx"))
    first_is_x = F.col("x") < F.col("set_id")
    more = durable(
        more.select(
            F.least("set_id", "x").alias("a"), F.greatest("set_id", "x").alias("b"), F.when(first_is_x, F.col("nx")).otherwise(F.col("n")).alias("na"),
            F.when(first_is_x, F.col("n")).otherwise(F.col("nx")).alias("nb"),
        ).distinct()
    )
    more = durable(_linked(more, segments, percent))
    if not more.isEmpty():
        groups = durable(connected_components(edges.union(more).toDF("src", "dst")))

    members = alive.select("set_id", "doc_id").join(groups.withColumnRenamed("node", "set_id"), "set_id", "left")
    members = members.withColumn("component", F.coalesce("component", "set_id"))
    named = members.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_set = members.select("set_id", "component").distinct().join(named, "component").select("set_id", "component_id")
    return base.join(of_set, "set_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _linked(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose overlap, summed over the fragments, reaches the threshold."""
    own = pairs.join(segments.withColumnRenamed("set_id", "b"), "b")
    other = segments.select(F.col("set_id").alias("a"), "frag", F.col("tokens").alias("tokens_a"))
    partial: Column = F.size(F.array_intersect("tokens", "tokens_a"))
    counted = own.join(other, ["a", "frag"]).select("a", "b", "na", "nb", partial.alias("part"))
    total = counted.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("shared"))
    return total.where(100 * F.col("shared") >= percent * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b")
