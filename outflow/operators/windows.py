"""Window features over dense, pre-aggregated grids.

A grid has one row per key and calendar step, so a window group holds as many rows as the calendar has steps,
however many raw rows the key had.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from outflow.functions import scalar as fx
from outflow.functions.ordering import numbered, value_ranks
from outflow.operators.listing import at


def ordered(keys: Sequence[str], order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def last_rows(spec: WindowSpec, n: int) -> WindowSpec:
    """The current row and the n - 1 before it, fewer at the start."""
    return spec.rowsBetween(-(n - 1), 0)


def rows_before(spec: WindowSpec, n: int) -> WindowSpec:
    """The n rows before the current one: a trailing window that already excludes the current step."""
    return spec.rowsBetween(-n, -1)


def trailing_sum(column: str, spec: WindowSpec, n: int) -> Column:
    return F.sum(column).over(last_rows(spec, n))


def trailing_mean(column: str, spec: WindowSpec, n: int) -> Column:
    return F.avg(column).over(last_rows(spec, n))


def trailing_max(column: str, spec: WindowSpec, n: int) -> Column:
    return F.max(column).over(last_rows(spec, n))


def trailing_flag(column: str, spec: WindowSpec, n: int) -> Column:
    return F.least(F.max(column).over(last_rows(spec, n)), F.lit(1))


def decayed_sum(column: str, spec: WindowSpec, n: int = 7, tau: float = 2.0, first_lag: int = 0) -> Column:
    """Sum of the last n values, each weighted by exp(-age / tau)."""
    terms = [
        F.coalesce(F.lag(column, first_lag + age).over(spec) if first_lag + age else F.col(column), F.lit(0))
        * math.exp(-age / tau)
        for age in range(n)
    ]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def shift_forward(df: DataFrame, column: str, days: int = 0, hours: int = 0) -> DataFrame:
    """Re-key a step to the one it may inform: a value of day x is known from day x + 1 on."""
    if hours:
        return df.withColumn(column, F.col(column) + F.make_dt_interval(F.lit(0), F.lit(hours)))
    return df.withColumn(column, F.date_add(column, days))


def surge_velocity(column: str, spec: WindowSpec) -> Column:
    before = F.lag(column, 1).over(spec)
    return F.coalesce((F.col(column) - before) / F.greatest(before, F.lit(1)), F.lit(0.0))


def trailing_hours(events: DataFrame, anchors: DataFrame, key: str, event_ts: str, anchor_ts: str,
                   hours: Sequence[int], amount: str | None = None) -> DataFrame:
    """Counts (and sums) of a key's events in [t - h, t) for whole-hour anchors t.

    Events are counted per key and hour first; anchors join the same hour axis and a range window adds up.
    """
    hour = fx.hour_index(F.col(event_ts))
    value = F.sum(F.round(F.col(amount) * 100).cast("bigint")) if amount else F.lit(0).cast("bigint")
    per_hour = events.groupBy(key, hour.alias("_h")).agg(F.count("*").alias("_n"), value.alias("_v"))
    nothing = F.lit(0).cast("bigint")
    asked = anchors.select(key, F.col(anchor_ts), fx.hour_index(F.col(anchor_ts)).alias("_h"))
    axis = per_hour.select(key, F.lit(None).cast("timestamp_ntz").alias(anchor_ts), "_h", "_n", "_v").unionByName(
        asked.select(key, anchor_ts, "_h", nothing.alias("_n"), nothing.alias("_v"))
    )
    spec = Window.partitionBy(key).orderBy("_h")
    zero = F.lit(0).cast("bigint")
    out = [F.coalesce(F.sum("_n").over(spec.rangeBetween(-h, -1)), zero).alias(f"n_{h}h") for h in hours]
    if amount:
        out += [(F.coalesce(F.sum("_v").over(spec.rangeBetween(-h, -1)), zero) / 100.0).alias(f"sum_{h}h") for h in hours]
    return axis.select(key, anchor_ts, *out).where(F.col(anchor_ts).isNotNull())


def night_ratio(events: DataFrame, key: str, ts: str) -> DataFrame:
    """Per key and day: the share of the previous day's events that fell in the night band, 0 if there were none."""
    night = fx.is_night(F.hour(ts))
    per_day = events.groupBy(key, F.to_date(ts).alias("day")).agg(
        (F.count_if(night) / F.count("*")).alias("night_ratio_24h")
    )
    return shift_forward(per_day, "day", days=1)


def surge_ratio(df: DataFrame, key: str, day: str) -> DataFrame:
    """Per key and observed day: rows against the mean of the up to seven observed days before, 1 without any."""
    counts = df.groupBy(key, day).agg(F.count("*").alias("n"))
    base = F.avg("n").over(rows_before(ordered([key], day), 7))
    ratio = F.when(base.isNull(), 1.0).otherwise(F.col("n") / F.greatest(base, F.lit(1.0)))
    return counts.select(key, day, ratio.alias("surge_ratio"))


def cold_start_days(df: DataFrame, key: str, day: str, first: int = 7) -> DataFrame:
    """Per key and observed day: 1 while within the key's first observed days."""
    seen = df.select(key, day).distinct()
    flag = (F.row_number().over(ordered([key], day)) <= first).cast("double")
    return seen.select(key, day, flag.alias("cold_start_flag"))


def rank_pct(df: DataFrame, column: str, out: str) -> DataFrame:
    """Add the average-tie rank divided by the number of rows."""
    ranks = value_ranks(df, [], column)
    total = df.agg(F.count("*")).scalar()
    return df.join(ranks.select(column, (F.col("mid_rank") / total).alias(out)), column)


def latest_per_key(df: DataFrame, key: str, ts: str, since: datetime | None = None, tie: str | None = None) -> DataFrame:
    """The newest row of each key: a max_by, so hot keys combine before the shuffle."""
    rows = df if since is None else df.where(F.col(ts) >= at(since))
    order = F.struct(ts, tie) if tie else F.col(ts)
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), order).alias("_row")).select(
        key, "_row.*"
    )


def state_budgets(population: DataFrame, cycle_budget: Column) -> DataFrame:
    """(state, budget): a share of the cycle's alerts by machine population, rounded half to even, at least 1."""
    total = F.greatest(population.agg(F.sum("n")).scalar(), F.lit(1))
    budget = F.greatest(F.bround(cycle_budget * F.col("n") / total, 0).cast("bigint"), F.lit(1))
    return population.select("state", budget.alias("budget"))


def fairness_cap(alerts: DataFrame, population: DataFrame, cycle_budget: Column | None = None,
                 order: Sequence[Column] | None = None) -> DataFrame:
    """Demote action alerts beyond their state's budget to monitor; dispatch alerts are exempt but use budget.

    ``alerts`` needs state, risk_score, tier and a unique atm_id; the position in a state is taken by falling risk.
    """
    order = list(order or [F.col("risk_score").desc(), F.col("atm_id")])
    size = cycle_budget if cycle_budget is not None else alerts.agg(F.count("*")).scalar()
    placed = numbered(alerts, ["state"], order).join(state_budgets(population, size), "state", "left")
    over = F.col("position") > F.coalesce("budget", F.lit(1))
    capped = over & (F.col("tier") == "action")
    return placed.withColumn("effective_tier", F.when(capped, "monitor").otherwise(F.col("tier"))).withColumn(
        "capped", capped
    ).drop("position", "budget")


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | None) -> DataFrame:
    """The first k rows per group with their rank, or all. Spark limits each group before the shuffle, so hot groups shrink early."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def rolling_centroid(daily: DataFrame, centres: DataFrame, n: int = 8) -> DataFrame:
    """Per city and day: the mean complaint position of the n days before, else the city centre.

    ``daily`` is dense with city, day, n, lat_sum and lon_sum.
    """
    spec = rows_before(ordered(["city"], "day"), n)
    total = F.sum("n").over(spec)
    rolled = daily.select(
        "city", "day", total.alias("_n"), F.sum("lat_sum").over(spec).alias("_lat"), F.sum("lon_sum").over(spec).alias("_lon")
    ).join(centres, "city", "left")
    some = F.col("_n") > 0
    return rolled.select(
        "city", "day", F.when(some, F.col("_lat") / F.col("_n")).otherwise(F.col("cc_lat")).alias("clat"),
        F.when(some, F.col("_lon") / F.col("_n")).otherwise(F.col("cc_lon")).alias("clon"),
    )


def time_to_withdrawal(df: DataFrame, filed: str, withdrawn: str, out: str = "time_to_withdrawal") -> DataFrame:
    """Hours from filing to withdrawal where within a week, elsewhere the mean of the valid ones (0 if none)."""
    hours = fx.hours_between(F.col(filed), F.col(withdrawn))
    valid = F.when(hours.between(0, 168), hours)
    mean = df.agg(F.avg(F.round(valid, 6).cast("decimal(18,6)")).cast("double")).scalar()
    return df.withColumn(out, F.coalesce(valid, mean, F.lit(0.0)))


