"""Self-exciting complaint intensity per city on a daily axis: grid-search fit and evaluation.

The decayed sum of past events, S(d) = (S(d-1) + n(d-1)) exp(-beta), is a prefix of affine maps over blocks of days
(``functions/recurrence.py``): no day is paired with another, and no city is gathered in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outflow.functions.recurrence import decayed_before

# The search grid.
BETAS = [0.05, 0.1, 0.2, 0.4, 0.8, 1.5]
ALPHA_FRACTIONS = [0.1, 0.25, 0.5, 0.75, 0.95]


def _log_gamma(x: Column) -> Column:
    """ln Gamma for x > 0: ten recurrence steps up, then the Stirling series."""
    shift = F.lit(0.0)
    for j in range(10):
        shift = shift + F.ln(x + j)
    y = x + 10
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5))) - 1 / (1680 * F.pow(y, F.lit(7)))
    return (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + series - shift


def hawkes_fit(daily: DataFrame, horizon: Column) -> DataFrame:
    """(city, mu, alpha, beta) of greatest likelihood over the grid, from dense (city, step, n).

    Events of one day count as simultaneous: the k-th of them sees alpha * (S + k), and the sum of their
    logarithms is a difference of log-gamma values, so large days cost nothing extra. Cities with fewer than
    two events get (n / horizon, 0, 0.1).
    """
    cities = daily.groupBy("city").agg(F.sum(F.col("n").cast("double")).alias("events"), F.min("step").alias("first_step"))
    cities = cities.withColumn("horizon", F.greatest(horizon.cast("double"), F.lit(1.0)))
    cities = cities.withColumn("mu", F.greatest(F.col("events") / F.col("horizon"), F.lit(1e-6)))
    betas = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(b).alias("beta")) for i, b in enumerate(BETAS)]))
    # One pass per decay rate; the excitation sizes share it.
    tried = daily.select("city", "step", F.col("n").cast("double").alias("n"), betas.alias("b")).select("city", "step", "n", "b.place", "b.beta")
    tried = decayed_before(tried, ["city", "place"], "step", "n", "beta", "s").join(cities, "city")
    n, beta = F.col("n"), F.col("beta")

    def log_term(fraction: float) -> Column:
        alpha = F.lit(fraction) * beta
        base = F.col("mu") / alpha + F.col("s")
        return F.when(n > 0, n * F.ln(alpha) + _log_gamma(base + n) - _log_gamma(base)).otherwise(0.0)

    age = F.col("horizon") - (F.col("step") - F.col("first_step"))
    sums = tried.groupBy("city", "events", "mu", "horizon", "place", "beta").agg(
        F.sum(n * (1 - F.exp(-beta * age))).alias("spent"), *[F.sum(log_term(f)).alias(f"l{i}") for i, f in enumerate(ALPHA_FRACTIONS)]
    )
    choices = F.array(*[
        F.struct(
            # alpha / beta is the fraction.
            (F.col(f"l{i}") - F.col("mu") * F.col("horizon") - F.lit(f) * F.col("spent")).alias("ll"),
            (-(F.col("place") * len(ALPHA_FRACTIONS) + i)).alias("order"), (F.lit(f) * beta).alias("alpha"), beta.alias("beta"),
        )
        for i, f in enumerate(ALPHA_FRACTIONS)
    ])
    best = F.max(F.array_max(choices)).alias("best")
    fitted = sums.groupBy("city", "events", "mu", "horizon").agg(best)
    enough = F.col("events") >= 2
    return fitted.select(
        "city", F.when(enough, F.col("mu")).otherwise(F.col("events") / F.col("horizon")).alias("mu"),
        F.when(enough, F.col("best.alpha")).otherwise(0.0).alias("alpha"),
        F.when(enough, F.col("best.beta")).otherwise(0.1).alias("beta"),
    )


def hawkes_intensity(daily: DataFrame, params: DataFrame, out: str = "hawkes_intensity_24h") -> DataFrame:
    """Add mu + alpha * sum over strictly earlier days of n exp(-beta age); 0 for cities without parameters."""
    known = params.select("city", F.col("mu").alias("_mu"), F.col("alpha").alias("_alpha"), F.col("beta").alias("_beta"))
    summed = decayed_before(daily.join(known, "city", "left"), ["city"], "step", "n", "_beta", "_decayed")
    return summed.select(*daily.columns, F.coalesce(F.col("_mu") + F.col("_alpha") * F.col("_decayed"), F.lit(0.0)).alias(out))
