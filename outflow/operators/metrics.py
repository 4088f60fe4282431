"""Ranking and calibration metrics over (score, label) rows.

Nearly everything is computed from one table with a row per distinct score: positives, negatives and their
running counts. Only the top-k metrics go back to the rows, through a top-k plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outflow.functions import scalar as fx
from outflow.functions.ordering import exact_quantiles, running_totals
from outflow.operators.aggregates import exact_sum, first_event, unpivoted
from outflow.operators.joins import exists_within, interval_join

# Thresholds of the curve, evaluation horizons, ranks of the metric block.
CURVE_THRESHOLDS = [0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95]
HORIZONS = [2, 6, 12, 24, 48, 72]
PRECISION_RANKS = [20, 50, 100, 200, 500, 1000]
RECALL_RANKS = [20, 50, 100]


def score_table(df: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """Per distinct score: pos, neg, and how many of either have that score or a lower one."""
    y = F.col(label)
    counts = df.groupBy(*by, F.col(score).alias("score")).agg(
        F.sum(y.cast("bigint")).alias("pos"), F.sum((1 - y).cast("bigint")).alias("neg")
    )
    return running_totals(counts, list(by), [F.col("score")], {"pos_upto": "pos", "neg_upto": "neg"})


def _ratio(top: Column, bottom: Column) -> Column:
    """top / max(bottom, 1)."""
    return top / F.greatest(bottom, F.lit(1))


def auc_from(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mann-Whitney with half credit for ties; 0.5 when a class is missing."""
    won = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") + F.col("neg") / 2.0))
    pairs = F.sum("pos") * F.sum("neg")
    auc = F.when(pairs > 0, won / F.greatest(pairs, F.lit(1))).otherwise(0.5).alias("roc_auc")
    return table.groupBy(*by).agg(auc) if by else table.agg(auc)


def average_precision_from(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum over distinct thresholds of the recall gained times the precision there."""
    totals = [F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg")]
    if by:
        sized = table.join(table.groupBy(*by).agg(*totals), list(by))
    else:
        whole = table.agg(F.struct(*totals)).scalar()
        sized = table.withColumn("_all", whole).select("*", "_all.*")
    tp = F.col("all_pos") - F.col("pos_upto") + F.col("pos")
    fp = F.col("all_neg") - F.col("neg_upto") + F.col("neg")
    ap = F.coalesce(F.sum(_ratio(F.col("pos"), F.col("all_pos")) * tp / F.greatest(tp + fp, F.lit(1))), F.lit(0.0))
    return sized.groupBy(*by).agg(ap.alias("pr_auc")) if by else sized.agg(ap.alias("pr_auc"))


def roc_auc(df: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    return auc_from(score_table(df, by, score, label), by)


def pr_auc(df: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    return average_precision_from(score_table(df, by, score, label), by)


def top_rows(df: DataFrame, k: int, tie: Sequence[str], score: str = "score") -> DataFrame:
    """The k best rows with their rank; the window runs over those k rows only."""
    order = [F.col(score).desc(), *[F.col(c) for c in tie]]
    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def precision_recall_at(df: DataFrame, ks: Sequence[int], tie: Sequence[str]) -> DataFrame:
    """(k, precision, recall) over the k best rows."""
    positives = df.agg(F.sum("label")).scalar()
    hits = top_rows(df, max(ks), tie).select("rank", "label", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    return hits.where(F.col("rank") <= F.col("k")).groupBy("k").agg(
        fx.rounded(F.avg("label")).alias("precision"),
        fx.rounded(_ratio(F.sum("label"), positives)).alias("recall"),
    )


def _prf(alerts: Column, tp: Column, positives: Column) -> dict[str, Column]:
    precision, recall = _ratio(tp, alerts), _ratio(tp, positives)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-12))).otherwise(0.0)
    return {
        "alerts": alerts, "precision": fx.rounded(precision), "recall": fx.rounded(recall), "f1": fx.rounded(f1),
        "false_alerts": alerts - tp, "false_alert_rate": fx.rounded(_ratio(alerts - tp, alerts)),
    }


def prf_at(df: DataFrame, thresholds: Sequence[float], score: str = "score", label: str = "label") -> DataFrame:
    """Alerts, precision, recall, F1 and false alerts per threshold, from one row of conditional counts."""
    s, y = F.col(score), F.col(label)
    wide = df.agg(
        F.sum(y).alias("positives"),
        *[F.count_if(s >= t).alias(f"n{i}") for i, t in enumerate(thresholds)],
        *[F.count_if((s >= t) & (y == 1)).alias(f"tp{i}") for i, t in enumerate(thresholds)],
    )
    rows = [
        F.struct(
            F.lit(float(t)).alias("threshold"),
            *[c.alias(name) for name, c in _prf(F.col(f"n{i}"), F.col(f"tp{i}"), F.col("positives")).items()],
        )
        for i, t in enumerate(thresholds)
    ]
    return wide.select(F.inline(F.array(*rows)))


def threshold_curve(df: DataFrame, thresholds: Sequence[float] = tuple(CURVE_THRESHOLDS)) -> DataFrame:
    total = df.agg(F.count("*")).scalar()
    tier = F.when(F.col("threshold") < 0.7, "monitor").when(F.col("threshold") < 0.85, "action").otherwise("dispatch")
    return prf_at(df, thresholds).select(
        "threshold", F.col("alerts").alias("alert_volume"), fx.rounded(F.col("alerts") / F.greatest(total, F.lit(1))).alias("alert_rate"),
        "precision", "recall", "false_alerts", "false_alert_rate", tier.alias("tier_hint"),
    )


def brier(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(score) - F.col(label), F.lit(2))).alias("brier"))


def accuracy(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    right = (F.col("score") >= threshold).cast("int") == F.col("label")
    return df.agg(F.avg(right.cast("double")).alias("accuracy"))


def confusion(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    return df.groupBy(predicted, "label").agg(F.count("*").alias("n"))


def calibration_bins(df: DataFrame, edges: str = "last_closed") -> DataFrame:
    """(bin, n, mean_score, observed) over ten equal bins.

    ``last_closed``: half-open, the last one closed, so each row counts once. ``half_open`` leaves out a score
    of 1. ``closed`` counts a score on an inner edge in both bins.
    """
    s = F.col("score")
    low = F.floor(s * 10).cast("int")
    if edges == "last_closed":
        placed = df.withColumn("bin", F.least(low, F.lit(9)))
    elif edges == "half_open":
        placed = df.withColumn("bin", low).where(F.col("bin") <= 9)
    elif edges == "closed":
        on_edge = (s * 10 == low) & (low >= 1)
        both = F.when(low == 10, F.array(F.lit(9))).when(on_edge, F.array(low - 1, low)).otherwise(F.array(low))
        placed = df.withColumn("bin", F.explode(both))
    else:
        raise ValueError(edges)
    return placed.groupBy("bin").agg(
        F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg("label").alias("observed")
    )


def ece10(df: DataFrame, edges: str = "last_closed", at_least: int = 1) -> DataFrame:
    total = df.agg(F.count("*")).scalar()
    bins = calibration_bins(df, edges).where(F.col("n") >= at_least)
    gap = F.col("n") / F.greatest(total, F.lit(1)) * F.abs(F.col("mean_score") - F.col("observed"))
    return bins.agg(F.coalesce(F.sum(gap), F.lit(0.0)).alias("ece"))


def calibration_curve(df: DataFrame, at_least: int = 5) -> DataFrame:
    bins = calibration_bins(df).where(F.col("n") >= at_least)
    return bins.select(((F.col("bin") + 0.5) / 10.0).alias("centre"), "observed", "n")


def metric_block(df: DataFrame, tie: Sequence[str]) -> DataFrame:
    """One row: precision and recall at the fixed ranks, AUC, accuracy and PRF at four thresholds."""
    ranked = precision_recall_at(df, PRECISION_RANKS, tie)
    at_k = ranked.agg(
        F.struct(
            *[F.max(F.when(F.col("k") == k, F.col("precision"))).alias(f"precision_at_{k}") for k in PRECISION_RANKS],
            *[F.max(F.when(F.col("k") == k, F.col("recall"))).alias(f"recall_at_{k}") for k in RECALL_RANKS],
        )
    ).scalar()
    points = {"0p50": 0.5, "0p60": 0.6, "0p70": 0.7, "0p85": 0.85}
    curve = prf_at(df, list(points.values()))
    parts = ["alerts", "precision", "recall", "f1", "false_alert_rate"]
    prf = curve.agg(
        F.struct(
            *[
                F.max(F.when(F.col("threshold") == t, F.col(p))).alias(f"{p}_at_{name}")
                for name, t in points.items() for p in parts
            ]
        )
    ).scalar()
    auc = roc_auc(df).scalar()
    right = (F.col("score") >= 0.5).cast("int") == F.col("label")
    base = df.agg(F.count("*").alias("rows"), F.avg(right.cast("double")).alias("accuracy"))
    return base.select("rows", fx.rounded(F.col("accuracy")).alias("accuracy"), fx.rounded(auc).alias("roc_auc"),
                       at_k.alias("k"), prf.alias("p")).select("rows", "accuracy", "roc_auc", "k.*", "p.*")


def std_block(df: DataFrame, tie: Sequence[str], threshold: float = 0.7) -> DataFrame:
    """One row: AUC, average precision, precision at 100 / 500 / 1000, threshold metrics, capture, Brier."""
    table = score_table(df)
    ranked = precision_recall_at(df, [100, 500, 1000], tie)
    at_k = ranked.agg(
        F.struct(
            *[F.max(F.when(F.col("k") == k, F.col("precision"))).alias(f"precision_at_{k}") for k in (100, 500, 1000)],
            F.max(F.when(F.col("k") == 1000, F.col("recall"))).alias("capture_rate_top1000"),
        )
    ).scalar()
    flagged = F.col("score") >= threshold
    base = df.agg(
        fx.rounded(F.avg(F.when(flagged, F.col("label")))).alias("threshold_precision_0p7"),
        F.count_if(flagged).alias("alert_volume_0p7"),
        fx.rounded(F.avg(F.when(flagged, 1 - F.col("label")))).alias("false_alert_rate_0p7"),
        fx.rounded(F.avg(F.pow(F.col("score") - F.col("label"), F.lit(2)))).alias("brier"),
    )
    return base.select(
        "*", fx.rounded(auc_from(table).scalar()).alias("roc_auc"),
        fx.rounded(average_precision_from(table).scalar()).alias("pr_auc"), at_k.alias("k"),
    ).select("*", "k.*").drop("k")


def youden_threshold(df: DataFrame, steps: int = 101) -> DataFrame:
    """(threshold, youden_j): the first of the equally spaced thresholds that maximises sens + spec - 1.

    Each distinct score is given the number of thresholds it reaches; sums over at most steps + 1 groups follow.
    """
    y = F.col("label")
    counts = df.groupBy("score").agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    span = counts.agg(F.struct(F.min("score").alias("a"), F.max("score").alias("b"))).scalar()
    spaced = counts.withColumn("_s", span)
    grid = F.transform(
        F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.col("_s.a") + i * ((F.col("_s.b") - F.col("_s.a")) / (steps - 1))
    )
    # The last point is the maximum itself, whatever the spacing rounds to.
    grid = F.concat(F.slice(grid, 1, steps - 1), F.array(F.col("_s.b")))
    reached = spaced.withColumn("_g", grid).withColumn("reached", F.size(F.filter("_g", lambda t: t <= F.col("score"))))
    groups = reached.groupBy("reached").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.first("_g").alias("_g"))
    totals = counts.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n"))).scalar()
    entry = F.struct(F.col("reached"), F.col("pos"), F.col("neg"))
    one = groups.agg(F.collect_list(entry).alias("e"), F.first("_g").alias("g")).withColumn("t", totals)
    points = one.select(F.posexplode("g").alias("i", "threshold"), "e", "t")
    add = lambda name: F.aggregate(
        F.filter("e", lambda x: x["reached"] > F.col("i")), F.lit(0).cast("bigint"), lambda acc, x: acc + x[name]
    )
    points = points.withColumn("tp", add("pos")).withColumn("fp", add("neg"))
    sens = F.when(F.col("t.p") > 0, F.col("tp") / F.greatest(F.col("t.p"), F.lit(1))).otherwise(0.0)
    spec = F.when(F.col("t.n") > 0, 1 - F.col("fp") / F.greatest(F.col("t.n"), F.lit(1))).otherwise(0.0)
    scored = points.select("i", "threshold", F.round(sens + spec - 1, 12).alias("j"))
    best = F.max_by(F.struct("threshold", "j"), F.struct("j", -F.col("i"))).alias("best")
    return scored.agg(best).select("best.threshold", F.col("best.j").alias("youden_j"))


def per_feature_auc(df: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """(feature, auc, strength): single-feature AUC, null for a constant feature."""
    long = unpivoted(df, features, [label])
    table = score_table(long, ["feature"], "value", label)
    distinct = table.groupBy("feature").agg(F.count("*").alias("values"))
    joined = auc_from(table, ["feature"]).join(distinct, "feature")
    auc = F.when(F.col("values") > 1, fx.rounded(F.col("roc_auc")))
    return joined.select("feature", auc.alias("auc"), F.abs(2 * (auc - 0.5)).alias("strength"))


def baseline_scores(features: DataFrame, train_fraud: DataFrame, volume_before: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """Add the simple rankings a model has to beat.

    ``train_fraud`` holds the fraud withdrawals of the training days only.
    """
    history = train_fraud.groupBy("atm_id").agg(F.count("*").alias("historical_hotspot"))
    out = features.join(history, "atm_id", "left").withColumns(
        {
            "historical_hotspot": F.coalesce("historical_hotspot", F.lit(0)),
            "random": F.abs(F.xxhash64("atm_id", "day", F.lit(seed)) % 1_000_003) / 1_000_003.0,
            "complaint_volume": F.col("n_complaints_city_7d"),
            "withdrawal_volume": F.col("withdrawals_24h"),
            "proximity": F.col("n_complaints_city_7d") / (1.0 + F.col("dist_to_complaint_centroid_km")),
        }
    )
    if volume_before is not None:
        # Yesterday's ranking is today's: the score of the previous day at the same machine.
        yesterday = volume_before.select("atm_id", F.date_add("day", 1).alias("day"), F.col("score").alias("persistence"))
        out = out.join(yesterday, ["atm_id", "day"], "left").na.fill(0.0, ["persistence"])
    return out


def lift(active: Column, baseline: Column) -> Column:
    return F.when(baseline > 0, F.round(active / F.when(baseline > 0, baseline), 3))


def exposure_top_k(df: DataFrame, withdrawals: DataFrame, k: int = 1000, hours: int = 24) -> DataFrame:
    """One row: fraud amount within 24 h at the k best (machine, day) rows."""
    best = top_rows(df, k, ["atm_id", "day"]).select("atm_id", F.col("day").cast("timestamp_ntz").alias("_t"))
    fraud = withdrawals.where("is_fraud_withdrawal").select("atm_id", "timestamp", "amount")
    pairs = interval_join(best, fraud, "atm_id", "_t", "timestamp", 0, hours)
    return pairs.agg(F.count("*").alias("events"), exact_sum("amount").alias("exposure_inr"))


def lead_time(df: DataFrame, withdrawals: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(n, p25, median, p75) hours from day start to first fraud over flagged true positives."""
    hits = df.where((F.col("label") == 1) & (F.col("score") >= threshold)).select("atm_id", "day")
    joined = hits.join(first_event(withdrawals), ["atm_id", "day"])
    hours = joined.select(fx.hours_between(F.col("day").cast("timestamp_ntz"), F.col("first_fraud")).alias("h"))
    q = exact_quantiles(hours, [], "h", [0.25, 0.5, 0.75])
    return q.select(F.col("rows").alias("n"), *[F.element_at("q", i + 1).alias(n) for i, n in enumerate(("p25", "median", "p75"))])


def horizon_eval(df: DataFrame, withdrawals: DataFrame, horizons: Sequence[int] = tuple(HORIZONS), k: int = 1000) -> DataFrame:
    """Per horizon: event rate, AUC, average precision, Brier, precision and capture in the top k, confidence."""
    fraud = withdrawals.where("is_fraud_withdrawal").select("atm_id", "timestamp")
    grid = df.select("atm_id", "day", "score", F.col("day").cast("timestamp_ntz").alias("_t"))
    flagged = exists_within(grid, fraud, "atm_id", "_t", "timestamp", horizons)
    pair = lambda h: F.struct(F.lit(h).alias("horizon_hours"), F.col(f"y_{h}").alias("label"))
    spread = lambda rows: rows.select("score", F.inline(F.array(*[pair(h) for h in horizons])))
    by = ["horizon_hours"]
    table = score_table(spread(flagged), by)
    rates = table.groupBy(*by).agg(
        F.sum("pos").alias("events"), (F.sum("pos") / F.sum(F.col("pos") + F.col("neg"))).alias("rate"),
        (
            F.sum(F.col("pos") * F.pow(F.col("score") - 1, F.lit(2)) + F.col("neg") * F.pow(F.col("score"), F.lit(2)))
            / F.sum(F.col("pos") + F.col("neg"))
        ).alias("brier"),
    )
    best = spread(top_rows(flagged, k, ["atm_id", "day"])).groupBy(*by).agg(
        F.avg("label").alias("precision"), F.sum("label").alias("hits")
    )
    joined = rates.join(auc_from(table, by), by).join(average_precision_from(table, by), by).join(best, by)
    precision = fx.rounded(F.col("precision"))
    return joined.select(
        "horizon_hours", fx.rounded(F.col("rate")).alias("horizon_event_rate"), fx.rounded(F.col("roc_auc")).alias("roc_auc"),
        fx.rounded(F.col("pr_auc")).alias("pr_auc"), fx.rounded(F.col("brier")).alias("brier"),
        precision.alias("precision_at_k"), fx.rounded(_ratio(F.col("hits"), F.col("events"))).alias("capture_rate"),
        fx.horizon_confidence(precision).alias("confidence"),
    )


def disagreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: median and 95th percentile of the difference of two scores, and the downgrade / hold counts."""
    gap = df.select(F.abs(F.col(a) - F.col(b)).alias("gap"))
    q = exact_quantiles(gap, [], "gap", [0.5, 0.95]).select("q").scalar()
    counts = gap.agg(F.count_if(F.col("gap") > 0.35).alias("hold"), F.count_if((F.col("gap") > 0.20) & (F.col("gap") <= 0.35)).alias("downgrade"))
    return counts.withColumn("_q", q).select(
        "hold", "downgrade", fx.rounded(F.element_at("_q", 1)).alias("median_abs_disagreement"),
        fx.rounded(F.element_at("_q", 2)).alias("p95_abs_disagreement"),
    )


def disagreement_verdict(a: Column, b: Column) -> Column:
    gap = F.abs(a - b)
    return F.when(gap > 0.35, "hold").when(gap > 0.20, "downgrade").otherwise("agree")
