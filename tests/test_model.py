"""The model family against plain re-statements on small data."""

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from outflow.plans import model

RNG = random.Random(12)
COLUMNS = ["a", "b"]


def logistic(x, y, rounds=50):
    """Newton's method on columns and a constant."""
    x = np.column_stack([x, np.ones(len(y))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (p - y))
    return w


@pytest.fixture(scope="module")
def rows(spark):
    """Forty machines on twenty days; the label follows column a, b is noise."""
    out = []
    for d in range(20):
        for m in range(40):
            a = RNG.random()
            split = "train" if d < 12 else "val" if d < 15 else "test"
            out.append((f"A{m}", date(2024, 1, 1) + timedelta(days=d), a, RNG.random(), int(RNG.random() < (0.9 if a > 0.6 else 0.1)), split, f"C{m % 4}"))
    return spark.createDataFrame(out, "atm_id string, day date, a double, b double, label int, split string, city string").cache()


@pytest.fixture(scope="module")
def fitted(rows):
    return model.train(rows, COLUMNS, rounds=5, depth=2)


def test_platt_is_the_logistic_fit(spark):
    data = [(x / 40, int(RNG.random() < x / 40)) for x in range(40)]
    df = spark.createDataFrame(data, "raw_score double, label int")
    slope, offset = logistic(np.array([d[0] for d in data]), np.array([d[1] for d in data]))
    calibrator = model.platt(df)
    assert (calibrator.coefficients[0], calibrator.intercept) == (pytest.approx(slope, rel=1e-2), pytest.approx(offset, rel=1e-2, abs=1e-2))
    got = {r["raw_score"]: r["p"] for r in model.calibrate(calibrator, df, "raw_score", "p").collect()}
    assert got == pytest.approx({s: 1 / (1 + np.exp(-(slope * s + offset))) for s, _ in data}, abs=2e-2)
    assert model.platt(df.where("label = 1")) is None


def test_trees_find_the_step(rows, fitted):
    scores = fitted.score(rows).agg(
        F.min("score").alias("lo"), F.max("score").alias("hi"), F.avg(F.when(F.col("a") > 0.6, F.col("score"))).alias("high"),
        F.avg(F.when(F.col("a") <= 0.6, F.col("score"))).alias("low"),
    ).first()
    assert 0 <= scores["lo"] and scores["hi"] <= 1
    assert scores["high"] > 0.75 and scores["low"] < 0.25
    weights = {r["feature"]: r["importance"] for r in fitted.importances(rows.sparkSession).collect()}
    assert set(weights) == {"a", "b"} and weights["a"] > 0.8


def test_calibration_keeps_the_order(rows, fitted):
    both = model.raw_scores(fitted.trees, rows).select("atm_id", "day", "raw_score").join(fitted.score(rows).select("atm_id", "day", "score"), ["atm_id", "day"])
    pairs = sorted((r["raw_score"], r["score"]) for r in both.collect())
    assert [p[1] for p in pairs] == sorted(p[1] for p in pairs)


def test_stack_is_the_logistic_fit_on_validation_rows(rows):
    scored = rows.withColumns({"p0": F.col("a"), "p1": F.col("b")})
    val = scored.where("split = 'val'").toPandas()
    w = logistic(val[["p0", "p1"]].to_numpy(), val["label"].to_numpy())
    for r in model.stack(scored, ["p0", "p1"]).limit(50).collect():
        assert r["stacked"] == pytest.approx(1 / (1 + np.exp(-(w[0] * r["p0"] + w[1] * r["p1"] + w[2]))), abs=2e-2)


def test_calibrated_model_sets_the_last_days_aside(rows):
    found = model.calibrated_model(rows, COLUMNS, rounds=3, depth=2)
    late = rows.where(F.col("day") > date(2024, 1, 16))
    raw = model.raw_scores(found.trees, late).toPandas()
    slope, offset = logistic(raw["raw_score"].to_numpy(), raw["label"].to_numpy())
    assert found.calibrator.coefficients[0] == pytest.approx(slope, rel=2e-2) and found.calibrator.intercept == pytest.approx(offset, rel=2e-2, abs=2e-2)


def test_two_stage_gives_every_row_its_citys_risk(rows):
    cities = rows.withColumn("hawkes_intensity_24h", F.col("a"))
    out = model.two_stage(cities, ["a", "b", "hawkes_intensity_24h"], rounds=2, depth=2).collect()
    assert len(out) == rows.count() and all(0 <= r["score"] <= 1 for r in out)
    by_city = {}
    for r in out:
        by_city.setdefault((r["city"], r["day"]), set()).add(r["city_risk"])
    assert len(by_city) == 80 and all(len(v) == 1 for v in by_city.values())


def test_folds_seeds_and_permutations_count(rows):
    folds = model.cross_validate(rows, COLUMNS, rounds=2, depth=2).first()
    assert folds["folds"] == 5 and folds["ci_low"] <= folds["mean_auc"] <= folds["ci_high"] and folds["mean_auc"] > 0.8
    seeds = model.seed_stability(rows, COLUMNS, (1, 2), rounds=2, depth=2).first()
    assert seeds["spread"] == pytest.approx(seeds["max_auc"] - seeds["min_auc"]) and seeds["min_auc"] <= seeds["mean_auc"] <= seeds["max_auc"]
    wide = rows.withColumn("day_of_week", F.lit(1.0)).withColumn("n_city", F.col("b"))
    got = {r["test"]: r["roc_auc"] for r in model.permutation_tests(wide, [*COLUMNS, "n_city", "day_of_week"], rounds=2, depth=2).collect()}
    assert set(got) == {"baseline", "labels", "row_order", "city_columns", "day_of_week"}
    assert got["baseline"] > 0.8 > got["labels"] and got["row_order"] == pytest.approx(got["baseline"], abs=0.05)


def test_counterfactual_by_scoring_twice(rows, fitted):
    changed = {r["atm_id"] + str(r["day"]): r["score"] for r in fitted.score(rows.withColumn("a", F.col("a") * 0.0)).collect()}
    base = {r["atm_id"] + str(r["day"]): r["score"] for r in fitted.score(rows).collect()}
    got = model.counterfactual(fitted, rows, ["a"], 0.0).first()
    assert got["n_rows"] == len(base)
    assert got["mean_score_baseline"] == pytest.approx(np.mean(list(base.values())), abs=1e-4)
    assert got["delta"] == pytest.approx(np.mean([changed[k] - base[k] for k in base]), abs=1e-4)


def test_recalibration_by_newton(spark):
    data = [("yes" if RNG.random() < s / 60 else "no", s / 60) for s in range(60)] + [("unknown", 0.5)]
    df = spark.createDataFrame(data, "actual_fraud_happened string, predicted_risk double")
    known = [(s, int(a == "yes")) for a, s in data if a != "unknown"]
    slope, offset = logistic(np.array([k[0] for k in known]), np.array([k[1] for k in known]))
    got = model.recalibrate(df).first()
    assert (got["status"], got["rows"]) == ("OK", 60)
    assert got["slope"] == pytest.approx(slope, rel=1e-2) and got["intercept"] == pytest.approx(offset, rel=1e-2, abs=1e-2)
    assert model.recalibrate(df.limit(10)).first()["status"] == "REFUSED"


def test_contributions_name_the_percentile(rows, fitted):
    importances = fitted.importances(rows.sparkSession)
    out = model.feature_contributions(rows.where("split = 'test'"), importances, rows.where("split = 'train'"), ["atm_id", "day"], top=1)
    assert out.select("feature").distinct().collect()[0][0] == "a" and out.count() == 200
    order = sorted({(r["value"], r["percentile"]) for r in out.collect()})
    labels = [p for _, p in order]
    assert len(set(labels)) > 2 and labels == sorted(labels, key=labels.index)
