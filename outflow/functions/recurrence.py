"""Decaying sums over long step axes as a parallel prefix of affine maps.

S(d) = sum over j < d of jump(j) exp(-rate (d - j)) follows S(d) = exp(-rate) (S(d - 1) + jump(d - 1)): each step is an affine
map of the sum before it, and maps of neighbouring stretches compose. The axis is cut into blocks of a fixed number of steps. Inside a block
the sum is a running total of rescaled jumps; a block as a whole is one map, and the maps of all blocks before are composed
by doubling: 1, 2, 4, ... blocks back. So a key of any length is many groups of one block each, and one short row per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: exp(rate * BLOCK) must be a finite number: rates up to 2.7 a step.
BLOCK = 256


def decayed_before(df: DataFrame, by: Sequence[str], step: str, jump: str, rate: str, out: str, block: int = BLOCK) -> DataFrame:
    """Add ``out``: the jumps of the strictly earlier steps of a key, each weighted by exp(-rate * age).

    Steps are integers, with or without gaps, one row each; the rate is one per key.
    """
    number = F.floor(F.col(step) / block).cast("bigint")
    rows = df.withColumn("_b", number).withColumn("_o", (F.col(step) - F.col("_b") * block).cast("int"))
    weight: Column = F.exp(F.col(rate) * F.col("_o"))
    jumps = F.coalesce(F.col(jump), F.lit(0)).cast("double")
    before = Window.partitionBy(*by, "_b").orderBy("_o").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("_s", F.coalesce(F.sum(jumps * weight).over(before), F.lit(0.0)) / weight)
    ends = rows.groupBy(*by, "_b").agg(
        F.sum(jumps * F.exp(-F.col(rate) * (block - F.col("_o")))).alias("_t"), F.first(F.exp(-F.col(rate) * block)).alias("_fade")
    )
    line = Window.partitionBy(*by).orderBy("_b")
    gap = F.col("_b") - F.lag("_b").over(line)
    # What a block takes from the one before it: S -> a S + c. The first takes nothing.
    maps = ends.select(
        *by, "_b", F.coalesce(F.pow("_fade", gap), F.lit(0.0)).alias("_a"), F.coalesce(F.lag("_t").over(line) * F.pow("_fade", gap - 1), F.lit(0.0)).alias("_c")
    )
    span = rows.agg(F.max("_b") - F.min("_b")).first()[0] or 0
    back = 1
    while back <= span:
        a, c = F.lag("_a", back).over(line), F.lag("_c", back).over(line)
        maps = maps.select(
            *by, "_b", (F.col("_a") * F.coalesce(a, F.lit(1.0))).alias("_a"), (F.col("_a") * F.coalesce(c, F.lit(0.0)) + F.col("_c")).alias("_c")
        )
        back *= 2
    joined = inside.join(maps.select(*by, "_b", F.col("_c").alias("_carry")), [*by, "_b"])
    return joined.select(*df.columns, (F.col("_s") + F.col("_carry") / weight).alias(out))
