"""Order-dependent totals over whole tables without gathering a table, or a hot key, in one task.

A plain window without partitions sorts everything in a single task, and a window partitioned by a hot key
does the same to that key. Here rows are range-partitioned on the full order instead, so each block is a
contiguous slice of the order. A block's own running values come from a window inside the block, and what
lies before it comes from one small row per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outflow.session import durable, shuffle_width

BLOCK = "_block"


def range_blocks(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Range-partition by the order and fix the block of every row.

    The frame is read once for the block totals and once for the rows, and the range bounds come from a
    sample, so the placement is written down before either use.
    """
    parts = shuffle_width(df.sparkSession)
    return durable(df.repartitionByRange(parts, *order).withColumn(BLOCK, F.spark_partition_id()))


def running_totals(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], sums: dict[str, str]
) -> DataFrame:
    """Add for each ``new: column`` the inclusive running sum of the column in the order, within ``by``.

    Rows that tie on the order must have been aggregated beforehand.
    """
    keys = [F.col(c) for c in by]
    blocks = range_blocks(df, [*keys, *order])
    totals = blocks.groupBy(*by, BLOCK).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    # At most one row per block and key: the number of blocks is the shuffle width.
    before = Window.partitionBy(*by).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, BLOCK, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    inside = Window.partitionBy(*by, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = blocks.select("*", *[F.sum(c).over(inside).alias(f"_l_{n}") for n, c in sums.items()])
    joined = local.join(offsets, [*by, BLOCK])
    kept = [c for c in df.columns if c not in sums]
    return joined.select(*kept, *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums])


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "position") -> DataFrame:
    """row_number() within ``by``, safe for hot keys. The order must be unique within a key."""
    return running_totals(df.withColumn("_one", F.lit(1).cast("bigint")), by, order, {name: "_one"}).drop("_one")


def value_ranks(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Per distinct value: how many rows have it (``copies``) and its average-tie rank (``mid_rank``)."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("copies"))
    ranked = running_totals(counts, by, [F.col(value)], {"__upto": "copies"})
    return ranked.select(
        *by, value, "copies", (F.col("__upto") - F.col("copies") + (F.col("copies") + 1) / 2.0).alias("mid_rank")
    )


def nearest_value(df: DataFrame, by: Sequence[str], order: Sequence[Column], value: str, name: str, forward: bool) -> DataFrame:
    """Add the last non-null ``value`` at or before each row of the order within ``by`` (``forward``: the first at or after).

    The value must rise with the order. No window holds more than one block, however hot a key.
    """
    blocks = range_blocks(df, [*[F.col(c) for c in by], *order])
    edge = F.min if forward else F.max
    edges = blocks.groupBy(*by, BLOCK).agg(edge(value).alias("_edge"))
    # Forward is backward in the reversed order: a frame that grows from the front is one pass, one that shrinks towards the end is made anew per row.
    turned = (lambda c: c.desc()) if forward else (lambda c: c.asc())
    # At most one row per block and key.
    over = Window.partitionBy(*by).orderBy(turned(F.col(BLOCK))).rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(*by, BLOCK, edge("_edge").over(over).alias("_far"))
    inside = Window.partitionBy(*by, BLOCK).orderBy(*[turned(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    local = blocks.withColumn("_near", edge(value).over(inside))
    same = None
    for c in [*by, BLOCK]:
        equal = local[c].eqNullSafe(carried[c])
        same = equal if same is None else same & equal
    joined = local.join(carried, same)
    return joined.select(*[local[c] for c in df.columns], F.coalesce("_near", "_far").alias(name))


def previous_row(df: DataFrame, order: str, columns: Sequence[str]) -> DataFrame:
    """lag(column) over the whole table ordered by one key.

    Inside a block it is an ordinary lag; the first row of a block takes the last row of the nearest earlier block.
    """
    blocks = range_blocks(df, [F.col(order)])
    packed = F.struct(F.col(order).alias("_k"), *[F.col(c) for c in columns])
    tails = blocks.groupBy(BLOCK).agg(F.max_by(packed, F.col(order)).alias("_tail"))
    # One row per block.
    tails = tails.select(BLOCK, F.lag("_tail").over(Window.orderBy(BLOCK)).alias("_tail"))
    inside = Window.partitionBy(BLOCK).orderBy(order)
    with_lag = blocks.withColumn("_before", F.lag(packed).over(inside)).join(tails, BLOCK)
    before = F.coalesce("_before", "_tail")
    return with_lag.select(*df.columns, *[before[c].alias(f"previous_{c}") for c in columns])


def top_share(df: DataFrame, order: Sequence[Column], share: float) -> DataFrame:
    """The first floor(share * rows) rows of the order, which must be unique."""
    total = df.agg(F.count("*")).scalar()
    return numbered(df, [], order).where(F.col("position") <= F.floor(total * share)).drop("position")


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, at: Sequence[float]) -> DataFrame:
    """(*by, rows, q): linearly interpolated quantiles as an array, from running counts of distinct values.

    The built-in exact percentile keeps every distinct value of a group in one buffer; this spreads them out.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    run = running_totals(counts, by, [F.col(value)], {"__upto": "__n"})
    rows = run.groupBy(*by).agg(F.max("__upto").alias("rows"))
    sized = run.join(rows, list(by)) if by else run.withColumn("rows", rows.scalar())
    picks = []
    for i, q in enumerate(at):
        place = (F.col("rows") - 1) * F.lit(float(q))
        low = F.min(F.when(F.col("__upto") > F.floor(place), F.col(value)))
        high = F.min(F.when(F.col("__upto") > F.ceil(place), F.col(value)))
        picks += [low.alias(f"__l{i}"), high.alias(f"__h{i}")]
    found = sized.groupBy(*by, "rows").agg(*picks)
    part = lambda i, q: (F.col("rows") - 1) * F.lit(float(q)) - F.floor((F.col("rows") - 1) * F.lit(float(q)))
    values = [F.col(f"__l{i}") + (F.col(f"__h{i}") - F.col(f"__l{i}")) * part(i, q) for i, q in enumerate(at)]
    return found.select(*by, "rows", F.array(*values).alias("q"))
