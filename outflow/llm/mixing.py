"""Mixing sources to target weights (operator 10).

Method: Sainte-Lague apportionment. The words of the mix are cut into equal blocks. Sources get whole blocks in
proportion to their targets, by the highest quotients target / (2 k + 1); the blocks of a source are shared out to its
shards in the same way. Inside a shard the documents lie in a seeded order, one after the other, and are cut into
blocks; a seeded choice takes as many of them as the shard's quota says, and from the second round on every block
once more.

The highest quotients are found without listing them: a source has floor(target / d + 1/2) seats for the divisor d at
which the seats add up, and d is searched with a grid of candidates per pass. Sources are rows of a table and shards
hold about ``shard_words`` words each, so neither many sources nor one hot source meets in one task.

Defined cases: a null or empty text has no words and is taken zero times; a null source is a source, the last one;
sources of no words get nothing; rows with one id are separate documents. Extra columns are ignored. An empty table
gives an empty result. The same rows and seed give the same mix, whatever their order and partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outflow.functions.ordering import numbered
from outflow.session import durable

WORD = r"[^\x20\x09-\x0D]+"
GRID = 16


def apportion(items: DataFrame, key: str, unit: str, weight: str, seats: str) -> DataFrame:
    """(key, unit, quota): the key's seats given to its units by highest quotients weight / (2 k + 1).

    Equal quotients at the last seat go to the smaller units first. A key whose weights are all zero gives none.
    """
    rows = items.select(key, unit, F.col(weight).cast("double").alias("w"), F.col(seats).cast("bigint").alias("seats"))
    span = rows.groupBy(key).agg(F.sum("w").alias("total"), F.count("*").alias("n"), F.first("seats").alias("seats"))
    # floor(w / d + 1/2) summed lies within n / 2 of total / d.
    span = durable(span.where("seats > 0 AND total > 0").select(
        key, "seats", (F.col("total") / (F.col("seats") + F.col("n") / 2.0 + 1)).alias("lo"),
        F.when(F.col("seats") > F.col("n") / 2.0, F.col("total") / (F.col("seats") - F.col("n") / 2.0)).otherwise(2 * F.col("total") + 1).alias("hi"),
    ))
    seats_at = lambda d: F.floor(F.col("w") / d + 0.5)
    while True:
        # lo gives at least the seats, hi at most.
        open_keys = span.where("hi - lo > lo * 4e-16 AND NOT hi <= lo")
        points = [F.col("lo") + (F.col("hi") - F.col("lo")) * ((i + 1) / (GRID + 1)) for i in range(GRID)]
        probed = rows.select(key, "w").join(open_keys, key).groupBy(key, "lo", "hi", "seats").agg(
            *[F.sum(seats_at(p)).alias(f"s{i}") for i, p in enumerate(points)]
        )
        low, high = F.col("lo"), F.col("hi")
        for i, p in enumerate(points):
            low = F.when(F.col(f"s{i}") >= F.col("seats"), p).otherwise(low)
        for i, p in reversed(list(enumerate(points))):
            high = F.when(F.col(f"s{i}") <= F.col("seats"), p).otherwise(high)
        exact = F.coalesce(*[F.when(F.col(f"s{i}") == F.col("seats"), p) for i, p in enumerate(points)])
        moved = probed.select(key, "seats", F.coalesce(exact, low).alias("lo"), F.coalesce(exact, high).alias("hi"))
        done = span.join(open_keys.select(key), key, "left_anti").select(key, "seats", "lo", "hi")
        before = span
        span = durable(done.union(moved))
        if not span.where("hi - lo > lo * 4e-16 AND NOT hi <= lo").join(before.select(key, F.col("lo").alias("l0"), F.col("hi").alias("h0")), key).where(
            "lo <> l0 OR hi <> h0"
        ).limit(1).count():
            break
    sat = rows.join(span.drop("seats"), key, "left").select(
        key, unit, "seats", F.coalesce(F.floor(F.col("w") / F.col("hi") + 0.5), F.lit(0)).alias("sure"),
        F.coalesce(F.floor(F.col("w") / F.col("lo") + 0.5), F.lit(0)).alias("most"),
    )
    sat = durable(sat)
    left = sat.groupBy(key).agg((F.first("seats") - F.sum("sure")).alias("left"))
    tied = numbered(sat.where("most > sure").select(key, unit), [key], [F.col(unit)], "turn").join(left, key)
    extra = tied.where("turn <= left").select(key, unit, F.lit(1).alias("extra"))
    return sat.join(extra, [key, unit], "left").select(key, unit, (F.col("sure") + F.coalesce("extra", F.lit(0))).cast("bigint").alias("quota"))


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5, most: float = 2.0, block: int = 64, shard_words: int = 1 << 19, seed: int = 17, row: str | None = None,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, passes, ranges, taken) of every document.

    ``passes`` whole copies of the document are in the mix, and after them the words [from, to) of each of ``ranges``.
    ``row`` names a column that numbers the rows; it is then returned too, as ``uid``.
    """
    name = F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))
    sized = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), name.alias("s"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        *([F.col(row).alias("uid")] if row else []),
    )
    sized = durable(sized if row else sized.withColumn("uid", F.monotonically_increasing_id()))
    sources = sized.groupBy("s").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    places = numbered(sources, [], [F.col("s")])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("position") - 1) % len(weights) + 1).cast("int"))
    # A column of its own, not a literal, so that joins on it are joins on a key.
    sources = durable(places.withColumn("weight", weight).withColumn("all", F.lit(0)))
    level = _level(sources, share, most)
    sources = sources.withColumn("target", F.least(most * F.col("source_size"), F.lit(level) * F.col("weight")))
    whole = sources.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    shared = apportion(sources.withColumn("seats", F.lit(round(whole / block))), "all", "s", "target", "seats")
    sources = durable(
        sources.join(shared.select("s", "quota"), "s").withColumn(
            "shards", F.greatest(F.lit(1), F.ceil((F.col("source_size") + 32 * F.col("n_docs")) / shard_words)).cast("bigint")
        )
    )
    placed = sized.join(sources.select("s", "shards"), "s").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("shards")))
    lengths = placed.groupBy("s", "shard").agg(F.sum("size").alias("words"))
    # Written down, as every pass of the search for the divisor reads it.
    lengths = durable(lengths.join(sources.select("s", "source_size", "target", "quota"), "s"))
    quotas = apportion(lengths, "s", "shard", "words", "quota").withColumnRenamed("quota", "seats")
    plan = lengths.join(quotas, ["s", "shard"]).withColumn("blocks", F.ceil(F.col("words") / block).cast("bigint"))
    # The quota in words: whole passes first, then the number of blocks that comes nearest to the rest, as the last block is short.
    plan = plan.withColumn("quota_words", F.least(F.col("seats") * block, F.floor(most * F.col("words"))).cast("bigint"))
    plan = plan.withColumn("passes", F.expr("CASE WHEN words > 0 THEN quota_words div words ELSE 0 END").cast("bigint"))
    rest = F.col("quota_words") - F.col("passes") * F.col("words")
    picks = F.when(F.col("words") > 0, F.round(rest * F.col("blocks") / F.col("words"))).otherwise(0)
    plan = plan.select("s", "shard", "source_size", "target", "passes", picks.cast("bigint").alias("picks"))
    # A shard's rows meet in one group of bounded size: about shard_words words, at 32 for a document at least.
    by_shard = Window.partitionBy("s", "shard")
    order = by_shard.orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "size", "uid").rowsBetween(Window.unboundedPreceding, 0)
    laid = placed.join(plan, ["s", "shard"]).withColumn("end", F.sum("size").over(order)).withColumn("start", F.col("end") - F.col("size"))
    last = F.greatest(F.col("end") - 1, F.col("start"))
    pieces = laid.withColumn("block", F.explode(F.sequence(F.expr(f"start div {block}"), _div(last, block))))
    turn = F.dense_rank().over(by_shard.orderBy(F.xxhash64(F.lit(seed + 2), "s", "shard", "block"), "block"))
    pieces = pieces.withColumn("picked", turn <= F.col("picks"))
    begin = F.greatest(F.col("start"), F.col("block") * block) - F.col("start")
    stop = F.least(F.col("end"), (F.col("block") + 1) * block) - F.col("start")
    span = F.when(F.col("picked") & (stop > begin), F.struct(begin.alias("from"), stop.alias("to")))
    out = pieces.groupBy("uid", "s", "shard", "doc_id", "source", "size", "source_size", "target", "passes").agg(
        F.sort_array(F.collect_list(span)).alias("ranges")
    )
    picked: Column = F.aggregate("ranges", F.lit(0).cast("bigint"), lambda total, r: total + r["to"] - r["from"])
    return out.select(
        "doc_id", "source", "size", "source_size", "target", "passes", "ranges", (F.col("passes") * F.col("size") + picked).alias("taken"),
        *(["uid"] if row else []),
    )


def _div(c: Column, by: int) -> Column:
    return F.floor(c / by).cast("bigint")


def _level(sources: DataFrame, share: float, most: float) -> float:
    """The words per unit of weight at which all targets, stopped at ``most`` times the size, add up to the mix."""
    level = 0.0
    while True:
        stopped = F.col("weight") * level > most * F.col("source_size")
        total, fixed, free = sources.agg(
            F.sum("source_size"), F.sum(F.when(stopped, most * F.col("source_size"))), F.sum(F.when(~stopped, F.col("weight")))
        ).first()
        if not total or not free:
            return level
        again = (share * total - (fixed or 0.0)) / free
        if again <= level:
            return level
        level = again
