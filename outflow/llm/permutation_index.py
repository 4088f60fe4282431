"""Nearest neighbours by permutations of pivots (operator 6).

Method: a vector is represented by its nearest pivots in order. Every shard of the vectors posts them in one inverted
file per pivot. A query reads the files of its own nearest pivots, ranks what it finds by the footrule distance of the
two orders (a pivot missing from one counts as in the place after its last), and the best share of the shard is ranked again by the exact
distance on the original vectors. Each shard gives its best ten, and the best of all shards are the result.

Pivots are a sample of at most ``pivots`` vectors by the hash of their ids; everything else covers all rows. Shards
and blocks of queries have bounded numbers of vectors, and a task holds one of each.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, take no part, nor do those of another
length than the most frequent one (the smaller of equals); of rows with one id the smallest vector counts; equal distances go to the smaller
id; with fewer candidates than asked for all are given. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOUND = "query_id bigint, vec_id bigint, score double"


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if column.num_chunks else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def orders(vectors: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the nearest pivots of every vector, nearest first."""
    far = (pivots**2).sum(1)[None, :] - 2 * vectors @ pivots.T
    near = np.argpartition(far, length - 1, axis=1)[:, :length] if length < len(pivots) else np.tile(np.arange(len(pivots)), (len(vectors), 1))
    return np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, 1), axis=1, kind="stable"), 1)


def unique(table: pa.Table) -> pa.Table:
    """One row per id."""
    ids = table.column("vec_id").to_numpy()
    _, first, times = np.unique(ids, return_index=True, return_counts=True)
    if (times > 1).any():
        rows = table.select(["vec_id", "v"]).to_pylist()
        best: dict = {}
        for i, r in enumerate(rows):
            if r["vec_id"] not in best or r["v"] < rows[best[r["vec_id"]]]["v"]:
                best[r["vec_id"]] = i
        first = np.array([best[i] for i in sorted(best)])
    return table.take(pa.array(first))


def search(
    vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 10, pivots: int = 512, length: int = 64,
    share: float = 0.2, shard_rows: int = 4096, block_rows: int = 2048,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of every query, itself left out. ``share``: of a shard, ranked exactly."""
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("is_query"))
    rows = rows.where("vec_id IS NOT NULL").where(usable(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count(F.when(F.col("is_query"), 1)).alias("q"))
    main = lengths.orderBy(F.desc("n"), "d").first()
    dim, n, n_queries = (main["d"], main["n"], main["q"]) if main else (1, 0, 0)
    rows = rows.where(F.size("v") == dim)
    sample = rows.orderBy(F.xxhash64("vec_id"), "v").limit(4 * pivots).select("v").collect()
    centres = np.unique(np.array([r[0] for r in sample], np.float64).reshape(-1, dim), axis=0)
    # Of a sample by hash any part is one too; sorting by value must not choose.
    centres = centres[np.argsort(np.random.default_rng(5).random(len(centres)))][:pivots]
    length = min(length, max(1, len(centres)))
    shards, blocks = max(1, math.ceil(n / shard_rows)), max(1, math.ceil(n_queries / block_rows))

    def answer(table: pa.Table, asked: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if table.num_rows and asked.num_rows:
            table, asked = unique(table), unique(asked)
            ids, x = table.column("vec_id").to_numpy(), matrix(table.column("v"), dim)
            query_ids, queries = asked.column("vec_id").to_numpy(), matrix(asked.column("v"), dim)
            own, theirs = orders(x, centres, length), orders(queries, centres, length)
            # One inverted file per pivot: who has it, and in which place.
            order = np.argsort(own.reshape(-1), kind="stable")
            member, place = order // length, order % length
            edge = np.searchsorted(own.reshape(-1)[order], np.arange(len(centres) + 1))
            take = min(len(ids), max(20 * k, math.ceil(share * len(ids))))
            for query_id, q, nearest in zip(query_ids, queries, theirs):
                # Footrule is a constant less twice this sum over the shared pivots.
                shared = np.zeros(len(ids), np.int64)
                for at, pivot in enumerate(nearest):
                    a, b = edge[pivot], edge[pivot + 1]
                    shared[member[a:b]] += length - np.maximum(place[a:b], at)
                best = np.lexsort((ids, -shared))[:take] if take < len(ids) else np.arange(len(ids))
                best = best[ids[best] != query_id]
                score = np.sqrt(((x[best] - q) ** 2).sum(1))
                top = np.lexsort((ids[best], score))[:k]
                out_q.append(np.full(len(top), query_id))
                out_v.append(ids[best][top])
                out_s.append(score[top])
        whole = [np.concatenate(c) if c else np.zeros(0) for c in (out_q, out_v, out_s)]
        return pa.table({"query_id": pa.array(whole[0].astype(np.int64)), "vec_id": pa.array(whole[1].astype(np.int64)), "score": pa.array(whole[2].astype(np.float64))})

    key = F.xxhash64("vec_id")
    index = rows.select("vec_id", "v", F.pmod(key, F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = rows.where("is_query").select(
        "vec_id", "v", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))).alias("shard"), F.pmod(key, F.lit(blocks)).cast("int").alias("block")
    )
    found = index.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(answer, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
