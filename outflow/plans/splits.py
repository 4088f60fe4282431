"""Train / validation / test splits, held-out studies, rank ensembles and model selection."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outflow.functions.ordering import numbered, top_share
from outflow.operators.metrics import roc_auc
from outflow.operators.windows import rank_pct


def chrono_split(df: DataFrame, day: str, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """Add split: the last ``validation`` share (at least two) of the train days validate, later days test."""
    days = df.select(day).distinct()
    # One row per calendar day.
    placed = days.select(day, F.row_number().over(Window.orderBy(day)).alias("_p"))
    total = days.agg(F.count("*")).scalar()
    cut = F.floor(total * train)
    held = F.greatest(F.floor(cut * validation), F.lit(2))
    label = F.when(F.col("_p") > cut, "test").when(F.col("_p") > cut - held, "val").otherwise("train")
    return df.join(F.broadcast(placed.select(day, label.alias("split"))), day)


def rank_ensemble(df: DataFrame, a: str, b: str, out: str = "ensemble") -> DataFrame:
    """Half the rank share of each score."""
    ranked = rank_pct(rank_pct(df, a, "_ra"), b, "_rb")
    return ranked.withColumn(out, 0.5 * F.col("_ra") + 0.5 * F.col("_rb")).drop("_ra", "_rb")


def select_active(df: DataFrame, candidates: Sequence[str], label: str = "label") -> DataFrame:
    """(candidate, auc) of the best candidate score column; the first listed wins a tie."""
    pairs = [F.struct(F.lit(c).alias("candidate"), F.lit(i).alias("place"), F.col(c).alias("score")) for i, c in enumerate(candidates)]
    long = df.select(F.col(label).alias("label"), F.inline(F.array(*pairs)))
    scored = roc_auc(long, ["candidate", "place"])
    best = F.max_by(F.struct("candidate", F.col("roc_auc").alias("auc")), F.struct("roc_auc", -F.col("place"))).alias("b")
    return scored.agg(best).select("b.*")


def time_forward(df: DataFrame, split: date) -> DataFrame:
    past = F.col("day") < F.lit(split)
    return df.withColumn("role", F.when(past, "train").otherwise("test"))


def _held_out(df: DataFrame, held: Column, split: date) -> DataFrame:
    past = F.col("day") < F.lit(split)
    return df.withColumn("role", F.when(past & ~held, "train").when(~past & held, "test"))


def cold_value(df: DataFrame, column: str, value: str, split: date) -> DataFrame:
    """Train without one city or district, test on it."""
    return _held_out(df, F.col(column) == value, split)


def cold_atm(df: DataFrame, split: date, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Hold out a share of the machines chosen by a seeded hash of their id."""
    chosen = F.pmod(F.xxhash64("atm_id", F.lit(seed)), F.lit(10_000)) < int(share * 10_000)
    return _held_out(df, chosen, split)


def new_hotspot(df: DataFrame, withdrawals: DataFrame, split: date, share: float = 0.2) -> DataFrame:
    """Hold out the machines with most withdrawals before the split."""
    volume = withdrawals.where(F.to_date("timestamp") < F.lit(split)).groupBy("atm_id").agg(F.count("*").alias("_n"))
    busy = top_share(volume, [F.col("_n").desc(), F.col("atm_id")], share).select("atm_id", F.lit(True).alias("_held"))
    joined = df.join(busy, "atm_id", "left").withColumn("_held", F.coalesce("_held", F.lit(False)))
    return _held_out(joined, F.col("_held"), split).drop("_held")


def random_split(df: DataFrame, keys: Sequence[str], train: float = 0.7, seed: int = 42) -> DataFrame:
    place = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(10_000))
    return df.withColumn("role", F.when(place < int(train * 10_000), "train").otherwise("test"))


def membership_counts(studies: dict[str, DataFrame]) -> DataFrame:
    """Rows per role of every study."""
    out = None
    for name, df in studies.items():
        one = df.agg(F.count_if(F.col("role") == "train").alias("train"), F.count_if(F.col("role") == "test").alias("test"))
        one = one.select(F.lit(name).alias("study"), "train", "test")
        out = one if out is None else out.unionByName(one)
    return out


def stratified_folds(df: DataFrame, label: str, keys: Sequence[str], folds: int = 5, seed: int = 42) -> DataFrame:
    """Add fold 0..folds-1, each class dealt out evenly in a seeded random order."""
    order = [F.xxhash64(*keys, F.lit(seed)), *[F.col(k) for k in keys]]
    return numbered(df, [label], order, "_p").withColumn("fold", (F.col("_p") % folds).cast("int")).drop("_p")


def permuted(df: DataFrame, columns: Sequence[str], keys: Sequence[str], seed: int) -> DataFrame:
    """The same rows with the given columns dealt to other rows in a seeded random order."""
    ids = [F.col(k) for k in keys]
    numbered_rows = numbered(df.drop(*columns), [], ids, "_p")
    shuffled = numbered(df.select(*keys, *columns), [], [F.xxhash64(*keys, F.lit(seed)), *ids], "_p")
    return numbered_rows.join(shuffled.select("_p", *columns), "_p").drop("_p")
