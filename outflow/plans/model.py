"""Risk models on the feature matrix: fitting with spark.ml, calibration, scoring and model studies."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outflow.functions import scalar as fx
from outflow.operators.aggregates import quantiles, unpivoted
from outflow.operators.metrics import ece10, roc_auc, std_block, youden_threshold
from outflow.plans import splits
from outflow.session import durable

# The feature families of the ablation study, and the columns of the counterfactuals.
FAMILIES = {
    "A_complaint_only": [
        "n_complaints_city_24h", "n_complaints_city_7d", "hours_since_last_complaint_city", "n_complaints_district_24h",
        "t_phishing_7d", "t_investment_fraud_7d", "t_job_fraud_7d", "t_upi_fraud_7d",
    ],
    "B_plus_geography": ["dist_to_complaint_centroid_km", "dist_to_city_center_km"],
    "C_plus_financial": [
        "withdrawals_1h", "withdrawals_6h", "withdrawals_24h", "amount_sum_24h", "distinct_accounts_24h",
        "linked_proportion_24h", "transaction_frequency_24h", "counterparty_count_24h", "fund_velocity_24h",
        "activity_spike_flag",
    ],
    "D_plus_temporal": ["hawkes_intensity_24h", "day_of_week", "is_weekend", "days_since_epoch"],
}
SURGE_COLUMNS = [
    "n_complaints_city_24h", "n_complaints_city_7d", "t_phishing_7d", "t_investment_fraud_7d", "t_job_fraud_7d",
    "t_upi_fraud_7d", "hawkes_intensity_24h",
]
# An outcome table needs this many rows before it may change a model.
ENOUGH_OUTCOMES = 20


@dataclass
class RiskModel:
    """Fitted trees, and the calibrator if both classes were there to fit one."""

    features: list[str]
    trees: PipelineModel
    calibrator: LogisticRegressionModel | None = None

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        raw = raw_scores(self.trees, df)
        calibrated = calibrate(self.calibrator, raw, "raw_score", out) if self.calibrator else raw.withColumn(out, F.col("raw_score"))
        return calibrated.drop("raw_score")

    def importances(self, spark) -> DataFrame:
        """(feature, importance), one row per feature of the model."""
        values = self.trees.stages[-1].featureImportances.toArray().tolist()
        return spark.createDataFrame(list(zip(self.features, values)), "feature string, importance double")


def _positive(column: str) -> Column:
    return vector_to_array(F.col(column))[1]


def raw_scores(trees: PipelineModel, df: DataFrame) -> DataFrame:
    scored = trees.transform(df).withColumn("raw_score", _positive("probability"))
    return scored.drop("features", "rawPrediction", "probability", "prediction")


def fit_risk_model(df: DataFrame, features: Sequence[str], rounds: int = 20, depth: int = 4, seed: int = 42,
                   positive_weight: float = 1.0, step: float = 0.1) -> PipelineModel:
    """Boosted trees on the train rows; rows of split 'val' stop the boosting early where there are any."""
    used = df.where(F.col("split").isin("train", "val")).withColumns(
        {"_weight": F.when(F.col("label") == 1, float(positive_weight)).otherwise(1.0), "_val": F.col("split") == "val"}
    )
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    trees = GBTClassifier(
        labelCol="label", featuresCol="features", weightCol="_weight", maxIter=rounds, maxDepth=depth, stepSize=step,
        subsamplingRate=0.85, seed=seed,
    )
    if not used.where("_val").isEmpty():
        trees = trees.setValidationIndicatorCol("_val")
    vectors = assembler.transform(used)
    return PipelineModel([assembler, trees.fit(vectors)])


def platt(validation: DataFrame, score: str = "raw_score", label: str = "label") -> LogisticRegressionModel | None:
    """A one-dimensional logistic fit on validation scores, or nothing if only one class is present."""
    if validation.select(label).distinct().count() < 2:
        return None
    vectors = VectorAssembler(inputCols=[score], outputCol="_v").transform(validation)
    return LogisticRegression(featuresCol="_v", labelCol=label).fit(vectors)


def calibrate(calibrator: LogisticRegressionModel, df: DataFrame, score: str, out: str) -> DataFrame:
    slope, intercept = float(calibrator.coefficients[0]), float(calibrator.intercept)
    return df.withColumn(out, 1 / (1 + F.exp(-(slope * F.col(score) + intercept))))


def stack(df: DataFrame, base_scores: Sequence[str], label: str = "label", out: str = "stacked") -> DataFrame:
    """A logistic combination of base scores fitted on the validation rows, applied to all."""
    assembler = VectorAssembler(inputCols=list(base_scores), outputCol="_v")
    model = LogisticRegression(featuresCol="_v", labelCol=label).fit(assembler.transform(df.where("split = 'val'")))
    z = F.lit(float(model.intercept))
    for name, weight in zip(base_scores, model.coefficients.toArray().tolist()):
        z = z + weight * F.col(name)
    return df.withColumn(out, 1 / (1 + F.exp(-z)))


def train(df: DataFrame, features: Sequence[str], **knobs) -> RiskModel:
    """Trees on the train days, calibration on the validation days."""
    trees = fit_risk_model(df, features, **knobs)
    return RiskModel(list(features), trees, platt(raw_scores(trees, df.where("split = 'val'"))))


def calibrated_model(df: DataFrame, features: Sequence[str], tail: float = 0.2, day: str = "day", **knobs) -> RiskModel:
    """Trees on the earlier days, calibration on the last share of days."""
    days = df.select(day).distinct()
    cut = splits.numbered(days, [], [F.col(day)], "_p").withColumn("_late", F.col("_p") > F.floor(days.agg(F.count("*")).scalar() * (1 - tail)))
    marked = durable(df.drop("split").join(F.broadcast(cut.select(day, "_late")), day).withColumn("split", F.when(F.col("_late"), "tail").otherwise("train")).drop("_late"))
    trees = fit_risk_model(marked, features, **knobs)
    late = raw_scores(trees, marked.where("split = 'tail'"))
    both = marked.where("split = 'train'").select("label").distinct().count() == 2
    return RiskModel(list(features), trees, platt(late) if both else None)


def two_stage(df: DataFrame, features: Sequence[str], **knobs) -> DataFrame:
    """Stage one scores city-days for any fraud, stage two ranks machines with that score as a further feature."""
    city_columns = [c for c in features if "city" in c or c.startswith("t_") or c == "hawkes_intensity_24h"]
    cities = durable(
        df.groupBy("city", "day").agg(*[F.max(c).alias(c) for c in city_columns], F.max("label").alias("label"), F.max("split").alias("split"))
    )
    surge = train(cities, city_columns, **knobs)
    scored = surge.score(cities, "city_risk").select("city", "day", "city_risk")
    rows = durable(df.join(scored, ["city", "day"]))
    ranker = calibrated_model(rows, [*features, "city_risk"], **knobs)
    return ranker.score(rows)


def score_next_day(model: RiskModel, features: DataFrame) -> DataFrame:
    """The rows of one day scored, riskiest first, with the derived columns of the score list."""
    columns = {c: F.col(c) for c in features.columns}
    scored = model.score(features, "risk_score")
    return scored.withColumns(
        {
            "risk_level": fx.risk_level(F.col("risk_score")), "emerging_risk": fx.emerging_risk(columns),
            "intervention_priority": fx.intervention_priority(columns, F.col("risk_score")),
        }
    ).orderBy(F.col("risk_score").desc(), "atm_id")


def evaluate(model: RiskModel, df: DataFrame) -> DataFrame:
    """The standard metric row on the test days."""
    return std_block(model.score(df.where("split = 'test'")).select("atm_id", "day", "score", "label"), ["atm_id", "day"])


def _labelled(rows: dict[str, DataFrame], name: str) -> DataFrame:
    out = None
    for key, df in rows.items():
        one = df.withColumn(name, F.lit(key))
        out = one if out is None else out.unionByName(one)
    return out


def ablation(df: DataFrame, full: Sequence[str], **knobs) -> DataFrame:
    """One metric row per feature family and one for the full set."""
    sets = {**FAMILIES, "E_full_model": list(full)}
    return _labelled({name: evaluate(train(df, cols, **knobs), df).withColumn("n_features", F.lit(len(cols))) for name, cols in sets.items()}, "model")


def holdout_study(studies: dict[str, DataFrame], features: Sequence[str], **knobs) -> DataFrame:
    """One metric row per held-out split; roles train and test become the split, the last train days validate."""
    rows = {}
    for name, df in studies.items():
        days = splits.chrono_split(df.where("role = 'train'").drop("split"), "day", 1.0, 0.15)
        whole = durable(days.drop("role").unionByName(df.where("role = 'test'").drop("split", "role").withColumn("split", F.lit("test"))))
        rows[name] = evaluate(train(whole, features, **knobs), whole)
    return _labelled(rows, "study")


def permutation_tests(df: DataFrame, features: Sequence[str], seed: int = 42, **knobs) -> DataFrame:
    """(test, auc): the model on the data as it is, with labels, city columns or the weekday dealt out anew."""
    keys = ["atm_id", "day"]
    auc = lambda rows: roc_auc(train(rows, features, **knobs).score(rows.where("split = 'test'")).select("score", "label"))
    in_train = df.where("split = 'train'")
    rest = df.where("split <> 'train'")
    city = [c for c in features if "city" in c or "district" in c]
    variants = {
        "baseline": df,
        "labels": splits.permuted(in_train, ["label"], keys, seed).select(df.columns).unionByName(rest),
        "row_order": df.repartition(F.xxhash64(*keys, F.lit(seed))),
        "city_columns": splits.permuted(df, city, keys, seed + 1).select(df.columns),
        "day_of_week": splits.permuted(df, ["day_of_week"], keys, seed + 2).select(df.columns),
    }
    return _labelled({name: auc(durable(rows)) for name, rows in variants.items()}, "test")


def cross_validate(df: DataFrame, features: Sequence[str], folds: int = 5, seed: int = 42, **knobs) -> DataFrame:
    """One row: mean AUC over stratified folds, its deviation and a 95 % interval."""
    dealt = durable(splits.stratified_folds(df.drop("split"), "label", ["atm_id", "day"], folds, seed))
    aucs = {}
    for k in range(folds):
        model = calibrated_model(dealt.where(F.col("fold") != k), features, **knobs)
        aucs[str(k)] = roc_auc(model.score(dealt.where(F.col("fold") == k)).select("score", "label"))
    per_fold = _labelled(aucs, "fold")
    spread = F.coalesce(F.stddev("roc_auc"), F.lit(0.0))
    return per_fold.agg(F.count("*").alias("folds"), F.avg("roc_auc").alias("mean_auc"), spread.alias("sd_auc")).withColumns(
        {"ci_low": F.col("mean_auc") - 1.96 * F.col("sd_auc") / F.sqrt("folds"), "ci_high": F.col("mean_auc") + 1.96 * F.col("sd_auc") / F.sqrt("folds")}
    )


def seed_stability(df: DataFrame, features: Sequence[str], seeds: Sequence[int] = (0, 1, 2, 3, 4), **knobs) -> DataFrame:
    """One row: smallest, largest, spread and mean AUC over model seeds."""
    runs = {str(s): roc_auc(train(df, features, seed=s, **knobs).score(df.where("split = 'test'")).select("score", "label")) for s in seeds}
    low, high = F.min("roc_auc"), F.max("roc_auc")
    return _labelled(runs, "seed").agg(low.alias("min_auc"), high.alias("max_auc"), (high - low).alias("spread"), F.avg("roc_auc").alias("mean_auc"))


def counterfactual(model: RiskModel, df: DataFrame, columns: Sequence[str] = tuple(SURGE_COLUMNS), factor: float = 1.5, threshold: float = 0.7) -> DataFrame:
    """One row: mean score as is and with the columns scaled (0 removes them), and the share that crosses the threshold."""
    base = model.score(df, "base")
    kept = {f"_{c}": F.col(c) for c in columns}
    changed = model.score(base.withColumns(kept).withColumns({c: F.col(c) * factor for c in columns}), "changed")
    return changed.agg(
        F.count("*").alias("n_rows"), fx.rounded(F.avg("base")).alias("mean_score_baseline"), fx.rounded(F.avg("changed")).alias("mean_score_changed"),
        fx.rounded(F.avg(F.col("changed") - F.col("base"))).alias("delta"),
        fx.rounded(F.avg(((F.col("base") < threshold) & (F.col("changed") >= threshold)).cast("double"))).alias("share_crossing"),
    )


def recalibrate(outcomes: DataFrame, score: str = "predicted_risk") -> DataFrame:
    """One row: slope, intercept, best threshold and calibration error before and after; refused on thin outcomes."""
    decided = durable(
        outcomes.where(F.col("actual_fraud_happened").isin("yes", "no")).select(
            F.col(score).alias("score"), (F.col("actual_fraud_happened") == "yes").cast("int").alias("label")
        )
    )
    rows, positives = decided.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if rows < ENOUGH_OUTCOMES or positives in (0, rows):
        return decided.sparkSession.range(1).select(F.lit("REFUSED").alias("status"), F.lit(rows).alias("rows"))
    model = platt(decided, "score")
    after = calibrate(model, decided, "score", "calibrated").select(F.col("calibrated").alias("score"), "label")
    best = youden_threshold(decided)
    return best.select(
        F.lit("OK").alias("status"), F.lit(rows).alias("rows"), "threshold", "youden_j", F.lit(float(model.coefficients[0])).alias("slope"),
        F.lit(float(model.intercept)).alias("intercept"), ece10(decided).scalar().alias("ece_before"), ece10(after).scalar().alias("ece_after"),
    )


def feature_contributions(rows: DataFrame, importances: DataFrame, reference: DataFrame, key: Sequence[str], top: int = 3) -> DataFrame:
    """(key, feature, value, percentile, importance) of the globally most important features for every row."""
    # At most ``top`` rows, the features of one model.
    best = importances.orderBy(F.col("importance").desc(), "feature").limit(top).collect()
    names = [r["feature"] for r in best]
    weights = F.create_map(*[F.lit(x) for r in best for x in (r["feature"], r["importance"])])
    cuts = quantiles(reference, names).agg(F.map_from_entries(F.collect_list(F.struct("feature", "q")))).scalar()
    long = unpivoted(rows, names, list(key)).withColumn("_q", F.element_at(cuts, F.col("feature")))
    label = fx.percentile_label(F.col("value"), [F.element_at("_q", i) for i in (1, 2, 3, 4)])
    return long.select(*key, "feature", fx.rounded(F.col("value")).alias("value"), label.alias("percentile"), fx.rounded(weights[F.col("feature")]).alias("importance"))


def hourly_eval(features: DataFrame, columns: Sequence[str], **knobs) -> DataFrame:
    """The standard metric row of an hourly model: first 70 % of days train, the last three of them validate."""
    dated = features.withColumn("day", F.to_date("hour"))
    days = dated.select("day").distinct()
    placed = splits.numbered(days, [], [F.col("day")], "_p")
    cut = F.floor(days.agg(F.count("*")).scalar() * 0.7)
    split = F.when(F.col("_p") > cut, "test").when(F.col("_p") > cut - 3, "val").otherwise("train")
    # One row per calendar day: sent to the rows, as a join by day would bring all rows of a day into one task.
    whole = durable(dated.join(F.broadcast(placed.select("day", split.alias("split"))), "day"))
    model = train(whole, columns, **knobs)
    tested = model.score(whole.where("split = 'test'")).select("atm_id", "hour", "score", "label")
    return std_block(tested, ["atm_id", "hour"])


