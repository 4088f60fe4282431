"""Per-step activity of machines and cities on a dense calendar: the common base of all feature matrices.

A step is a day, six hours or one hour, numbered from 1970. Raw rows are aggregated to one row per machine and
step before any window runs, and all trailing windows end before the current step, so a row keyed t holds only
what was known at t.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outflow.functions import scalar as fx
from outflow.operators.windows import ordered, rows_before
from outflow.schemas import FEATURE_TYPES
from outflow.session import shuffle_width

NEVER_HOURS = 24 * 366  # fixed value: hours since the last complaint where there is none


def step_of(ts: Column, hours: int) -> Column:
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / (hours * 3600)).cast("bigint")


def step_start(step: Column, hours: int) -> Column:
    return F.timestamp_seconds(step * (hours * 3600)).cast("timestamp_ntz")


@dataclass(frozen=True)
class Linked:
    """A trailing count over complaint-linked activity.

    ``window`` steps back, withdrawals or (``per_account``) distinct accounts per step, all or only fraud.
    """

    window: int
    per_account: bool = False
    fraud_only: bool = False


def data_span(complaints: DataFrame, withdrawals: DataFrame, hours: int) -> tuple[Column, Column]:
    """First and last step with data, as literals: one row is fetched so that every plan sees a fixed calendar."""
    filed, drawn = F.col("filing_timestamp"), F.col("timestamp")
    both = complaints.agg(F.min(filed).alias("a"), F.max(filed).alias("b")).unionByName(
        withdrawals.agg(F.min(drawn).alias("a"), F.max(drawn).alias("b"))
    )
    row = both.agg(step_of(F.min("a"), hours).alias("first"), step_of(F.max("b"), hours).alias("last")).first()
    return F.lit(row["first"]).cast("bigint"), F.lit(row["last"]).cast("bigint")


def first_named(complaints: DataFrame, hours: int, compat: bool = False) -> DataFrame:
    """The step in which a complaint first names an account; with ``compat`` links apply to all of time."""
    named = complaints.where(F.col("linked_account_token").isNotNull())
    when = F.lit(-(2**40)).cast("bigint") if compat else step_of(F.min("filing_timestamp"), hours)
    return named.groupBy(F.col("linked_account_token").alias("account_token")).agg(when.alias("named_step"))


ADDED = ["n", "w1", "w6", "cents", "round_n", "large_n", "heavy_n", "fraud_n", "night_n", "accounts"]


def account_steps(withdrawals: DataFrame, hours: int, night: Column | None = None) -> DataFrame:
    """One row per machine, step and account with the plain sums of the step."""
    ts, amount = F.col("timestamp"), F.col("amount")
    hour = F.hour(ts)
    night = fx.is_night(hour) if night is None else night
    count = lambda condition: F.count_if(condition).cast("bigint")
    return withdrawals.groupBy("atm_id", step_of(ts, hours).alias("step"), "account_token").agg(
        F.count("*").alias("n"), count(hour >= 23).alias("w1"), count(hour >= 18).alias("w6"),
        F.sum(F.round(amount * 100).cast("bigint")).alias("cents"), count(amount % 1000 == 0).alias("round_n"),
        count(amount > 20000).alias("large_n"), count(amount > 50000).alias("heavy_n"),
        count(F.col("is_fraud_withdrawal")).alias("fraud_n"), count(night).alias("night_n"),
        F.max(amount).alias("amount_max"),
    ).withColumn("accounts", F.lit(1).cast("bigint"))


def machine_steps(
    per_account: DataFrame, complaints: DataFrame, atms: DataFrame, first: Column, last: Column, hours: int,
    linked: dict[str, Linked], compat: bool = False,
) -> DataFrame:
    """One row per machine and step: plain sums of the step, and the linked counts known at its start, from ``account_steps``.

    A linked withdrawal of step x, by an account first named in step m, belongs to every row t with
    x < t <= x + window and m < t. It is entered as +1 at the first such row and -1 after the last, so the
    count is a running sum, and neither the window nor the accounts are ever expanded.
    """
    # A row before the calendar would leave it without having entered it.
    per_account = per_account.where(F.col("step").between(first, last))
    known = per_account.join(first_named(complaints, hours, compat), "account_token", "left")

    zero, none = F.lit(0).cast("bigint"), F.lit(0.0)

    def contribution(step: Column, own: bool, name: str | None = None, value: Column | None = None) -> Column:
        fields = [step.alias("step")]
        fields += [(F.col(c) if own else zero).alias(c) for c in ADDED]
        fields += [(F.col("amount_max") if own else none).alias("amount_max")]
        fields += [(value if key == name else zero).cast("bigint").alias(key) for key in linked]
        return F.struct(*fields)

    x, m = F.col("step"), F.col("named_step")
    parts = [contribution(x, True)]
    for name, spec in linked.items():
        begin, end = F.greatest(x, m) + 1, x + spec.window + 1
        applies = m.isNotNull() & (begin < end)
        if spec.fraud_only:
            applies = applies & (F.col("fraud_n") > 0)
        weight = F.lit(1) if spec.per_account else F.col("n")
        parts.append(F.when(applies, contribution(begin, False, name, weight)))
        parts.append(F.when(applies, contribution(end, False, name, -weight)))
    # Only rows of named accounts fan out; parts that do not apply come out null and fail the range filter.
    fan = F.when(m.isNull(), F.array(parts[0])).otherwise(F.array(*parts))
    entries = known.select("atm_id", F.inline(fan)).where(F.col("step").between(first, last))

    # The machines are dealt out before each becomes its calendar: as they are read, they lie in few tasks.
    dealt = atms.select("atm_id").repartition(shuffle_width(atms.sparkSession), "atm_id")
    blank = dealt.select("atm_id", F.explode(F.sequence(first, last)).alias("step")).select(
        "atm_id", "step", *[zero.alias(c) for c in ADDED], none.alias("amount_max"), *[zero.alias(c) for c in linked]
    )
    sums = [F.sum(c).alias(c) for c in [*ADDED, *linked]]
    dense = entries.unionByName(blank).groupBy("atm_id", "step").agg(*sums, F.max("amount_max").alias("amount_max"))
    so_far = ordered(["atm_id"], "step").rowsBetween(Window.unboundedPreceding, 0)
    return dense.select(
        "atm_id", "step", *ADDED, "amount_max", *[F.sum(c).over(so_far).alias(c) for c in linked]
    )


def exact_degrees(column: str) -> Column:
    """Sum of coordinates in whole millionths of a degree: the same whatever the order of addition."""
    return F.sum(F.round(F.col(column) * 1e6).cast("bigint")) / 1e6


def city_daily(complaints: DataFrame, cities: DataFrame, first: Column, last: Column) -> DataFrame:
    """Dense (city, day) counts and coordinate sums."""
    counted = complaints.groupBy(F.col("victim_city").alias("city"), F.to_date("filing_timestamp").alias("day")).agg(
        F.count("*").alias("n"), exact_degrees("victim_lat").alias("lat_sum"), exact_degrees("victim_lon").alias("lon_sum")
    )
    dense = cities.select("city", F.explode(F.sequence(first, last)).alias("day"))
    return dense.join(counted, ["city", "day"], "left").na.fill(0, ["n"]).na.fill(0.0, ["lat_sum", "lon_sum"])


def city_steps(complaints: DataFrame, cities: DataFrame, first: Column, last: Column, hours: int) -> DataFrame:
    """Dense (city, step): counts, counts per kind, coordinate sums and the newest filing time of the step."""
    zero = F.lit(0).cast("bigint")
    counted = complaints.groupBy(F.col("victim_city").alias("city"), step_of(F.col("filing_timestamp"), hours).alias("step")).agg(
        F.count("*").alias("n"), *[F.count_if(F.col("complaint_type") == t).alias(t) for t in FEATURE_TYPES],
        exact_degrees("victim_lat").alias("lat_sum"), exact_degrees("victim_lon").alias("lon_sum"),
        F.max("filing_timestamp").alias("newest"),
    )
    blank = cities.select("city", F.explode(F.sequence(first, last)).alias("step")).select(
        "city", "step", zero.alias("n"), *[zero.alias(t) for t in FEATURE_TYPES], F.lit(0.0).alias("lat_sum"),
        F.lit(0.0).alias("lon_sum"), F.lit(None).cast("timestamp_ntz").alias("newest"),
    )
    sums = [F.sum(c).alias(c) for c in ["n", *FEATURE_TYPES, "lat_sum", "lon_sum"]]
    within = counted.where(F.col("step").between(first, last))
    return within.unionByName(blank).groupBy("city", "step").agg(*sums, F.max("newest").alias("newest"))


def before(column: str, spec, n: int, how=F.sum) -> Column:
    """Aggregate of the n steps before the current one, 0 at the start of the calendar."""
    return F.coalesce(how(column).over(rows_before(spec, n)), F.lit(0))


def hours_since_last(spec, hours: int) -> Column:
    newest = F.max("newest").over(spec.rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(fx.hours_between(newest, step_start(F.col("step"), hours)), F.lit(float(NEVER_HOURS)))
