"""Fitted models and their studies. Fitting has no SQL twin; what follows from the scores is checked elsewhere."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outflow.catalog.features import learned, matrix, span
from outflow.catalog.registry import query
from outflow.operators import metrics
from outflow.plans import daily, hourly, model, splits
from outflow.session import durable
from outflow.sources.views import Tables

SPLIT = date(2024, 1, 22)


def split_matrix(t: Tables) -> DataFrame:
    return durable(splits.chrono_split(matrix(t), "day"))


@query("g02_fit_risk_model")
def _(t: Tables) -> DataFrame:
    rows = split_matrix(t)
    return model.evaluate(model.train(rows, daily.FEATURES), rows)


@query("g03_platt")
def _(t: Tables) -> DataFrame:
    rows = durable(splits.chrono_split(t.scores, "day").withColumnRenamed("score", "raw_score"))
    fitted = model.platt(rows.where("split = 'val'"))
    return model.calibrate(fitted, rows.where("split = 'test'"), "raw_score", "score").select("atm_id", "day", "score")


@query("g05_stack")
def _(t: Tables) -> DataFrame:
    rows = split_matrix(t)
    families = [[c for f in ("A_complaint_only", "B_plus_geography") for c in model.FAMILIES[f]], model.FAMILIES["C_plus_financial"]]
    for i, columns in enumerate(families):
        rows = durable(model.train(rows, columns).score(rows, f"p{i}"))
    stacked = model.stack(rows, ["p0", "p1"]).where("split = 'test'")
    return metrics.roc_auc(stacked, score="stacked")


@query("g07_two_stage")
def _(t: Tables) -> DataFrame:
    scored = model.two_stage(split_matrix(t), daily.FEATURES)
    return scored.select("atm_id", "day", "city_risk", "score")


@query("g08_calibrated_model")
def _(t: Tables) -> DataFrame:
    rows = split_matrix(t)
    return model.calibrated_model(rows, daily.FEATURES).score(rows).select("atm_id", "day", "score")


@query("g09_score_next_day")
def _(t: Tables) -> DataFrame:
    rows = split_matrix(t)
    fitted = model.train(rows, daily.FEATURES)
    # The day after the last data day.
    tomorrow = t.raw("events").agg(F.date_add(F.max(F.to_date("ts")), 1)).first()[0]
    features = daily.atm_day_features(
        t.complaints, t.withdrawals, t.atms, t.city_centres, learned(t), F.lit(tomorrow), F.lit(tomorrow), span(t)
    )
    return model.score_next_day(fitted, features).select("atm_id", "day", "risk_score", "risk_level", "emerging_risk", "intervention_priority")


@query("g29_ablation")
def _(t: Tables) -> DataFrame:
    return model.ablation(split_matrix(t), daily.FEATURES).select("model", "n_features", "roc_auc", "pr_auc", "brier", "precision_at_100")


@query("g30_holdout_study")
def _(t: Tables) -> DataFrame:
    rows = durable(matrix(t))
    studies = {
        "random": splits.random_split(rows, ["atm_id", "day"]),
        "time_forward": splits.time_forward(rows, SPLIT),
        "cold_atm": splits.cold_atm(rows, SPLIT),
        "cold_city": splits.cold_value(rows, "city", "NATION_3", SPLIT),
        "new_hotspot": splits.new_hotspot(rows, t.withdrawals, SPLIT),
    }
    kept = {name: df.where(F.col("role").isNotNull()) for name, df in studies.items()}
    return model.holdout_study(kept, daily.FEATURES).select("study", "roc_auc", "pr_auc", "brier")


@query("g31_permutation_tests")
def _(t: Tables) -> DataFrame:
    return model.permutation_tests(split_matrix(t), daily.FEATURES)


@query("g32_cross_validate")
def _(t: Tables) -> DataFrame:
    return model.cross_validate(matrix(t), daily.FEATURES)


@query("g33_seed_stability")
def _(t: Tables) -> DataFrame:
    return model.seed_stability(split_matrix(t), daily.FEATURES)


@query("g34_counterfactual")
def _(t: Tables) -> DataFrame:
    rows = split_matrix(t)
    fitted = model.train(rows, daily.FEATURES)
    tested = rows.where("split = 'test'")
    one = lambda factor: model.counterfactual(fitted, tested, factor=factor).withColumn("factor", F.lit(factor))
    return one(1.5).unionByName(one(0.5)).unionByName(one(0.0))


@query("g44_recalibrate")
def _(t: Tables) -> DataFrame:
    return model.recalibrate(t.outcomes)


@query("g45_feature_contributions")
def _(t: Tables) -> DataFrame:
    rows = split_matrix(t)
    fitted = model.train(rows, daily.FEATURES)
    tested = rows.where("split = 'test'")
    return model.feature_contributions(tested, fitted.importances(t.spark), rows.where("split = 'train'"), ["atm_id", "day"])


@query("g46_hourly_eval")
def _(t: Tables) -> DataFrame:
    first, last = span(t)
    to_hour = lambda day_step: day_step * 24
    features = hourly.atm_hour_features(
        t.complaints, t.withdrawals, t.atms, t.city_centres, to_hour(first), to_hour(last) + 23
    )
    return model.hourly_eval(features, hourly.FEATURES)
