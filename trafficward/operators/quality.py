"""Channel quality: rule labels, scaling, supervised and propagated models, ensemble."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.common import hash01, right_closed
from ..session import compact, settle, side_by_side
from .boosting import BoostedTrees, SecondOrderBoosting
from .ranks import quantile_struct

# Score bands and their names; class centres of the propagated labels.
BAND_EDGES = [0, 3, 5, 7, 10]
BANDS = ["Low", "Medium-Low", "Medium-High", "High"]
CLASS_EDGES = [0, 2.5, 5, 7.5, 10]
CLASS_SCORES = {1: 1.25, 2: 3.75, 3: 6.25, 4: 8.75}
UNLABELLED_SCORE = 5.0

# Names of the channel metrics and of the features the models read.
METRICS = [
    "bot_rate",
    "fraud_flags_avg",
    "fraud_score_avg",
    "ip_diversity",
    "country_diversity",
    "browser_diversity",
    "ua_suspicious_rate",
    "volume",
    "business_hours_rate",
    "weekend_rate",
    "time_pattern_diversity",
    "commercial_intent_rate",
    "ad_network_rate",
]
FEATURES = [*METRICS, "requests_per_ip", "combined_fraud_risk", "log_volume"]


def label_band(metrics: DataFrame) -> Column:
    """Name of the rule band of a channel: low beats medium-low, then high, good, medium."""
    c = F.col
    # The thresholds of the bands.
    low = (
        (c("bot_rate") > 0.5)
        | (c("fraud_score_avg") > 3.0)
        | (c("ua_suspicious_rate") > 0.3)
        | ((c("ip_diversity") == 1) & (c("volume") > 100))
    )
    below_medium = (
        ((c("bot_rate") > 0.25) & (c("bot_rate") <= 0.5))
        | ((c("fraud_score_avg") > 1.5) & (c("fraud_score_avg") <= 3.0))
        | (c("ip_diversity") < 3)
        | (c("time_pattern_diversity") < 1.0)
    )
    high = (
        (c("bot_rate") < 0.05)
        & (c("fraud_score_avg") < 0.5)
        & (c("ip_diversity") >= 10)
        & (c("country_diversity") >= 2)
        & (c("business_hours_rate") > 0.3)
        & (c("volume") >= 50)
    )
    good = (c("bot_rate") < 0.15) & (c("fraud_score_avg") < 1.0) & (c("ip_diversity") >= 5) & (c("volume") >= 20)
    medium = (c("bot_rate") <= 0.25) & (c("fraud_score_avg") <= 1.5) & (c("ip_diversity") >= 3)
    return (
        F.when(low, "low")
        .when(below_medium, "medium_low")
        .when(high, "high")
        .when(good, "good")
        .when(medium, "medium")
    )


# Score range of each rule band.
LABEL_RANGES = {
    "low": (1.0, 3.0),
    "medium_low": (3.0, 5.0),
    "medium": (5.0, 7.0),
    "good": (7.0, 8.5),
    "high": (8.5, 10.0),
}


def quality_labels(metrics: DataFrame, label_fraction: float = 1.0) -> DataFrame:
    """Metrics with `label_band` and `original_label`, a repeatable draw inside the band.

    Every channel matches a band; `label_fraction` below 1 hides some labels (hash of the
    channel) so that propagation has channels to label.
    """
    banded = metrics.withColumn("label_band", label_band(metrics))
    draw = hash01(F.col("channelId"))
    value = None
    for band, (low, high) in LABEL_RANGES.items():
        score = F.lit(low) + F.lit(high - low) * draw
        test = F.col("label_band") == band
        value = F.when(test, score) if value is None else value.when(test, score)
    if label_fraction < 1.0:
        shown = hash01(F.concat(F.lit("label:"), F.col("channelId"))) < label_fraction
        value = F.when(shown, value)
    return banded.withColumn("original_label", value)


def derived_features(metrics: DataFrame) -> DataFrame:
    """Requests per address, combined fraud risk and log volume."""
    return metrics.withColumns(
        {
            "requests_per_ip": F.col("volume") / (F.col("ip_diversity") + 1),
            "combined_fraud_risk": F.col("bot_rate") * 0.6 + F.col("fraud_score_avg") * 0.4,
            "log_volume": F.log1p(F.col("volume")),
        }
    )


def robust_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x − median) / IQR with exact quantiles; a zero IQR divides by 1."""
    q = quantile_struct(df, columns, [0.25, 0.5, 0.75])
    spread = lambda c: F.col("_q")[c][2] - F.col("_q")[c][0]
    divisor = lambda c: F.when(spread(c) == 0, F.lit(1.0)).otherwise(spread(c))
    scaled = {c: (F.col(c).cast("double") - F.col("_q")[c][1]) / divisor(c) for c in columns}
    return df.withColumn("_q", q).withColumns(scaled).drop("_q")


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x − mean) / population deviation; a constant column becomes 0."""
    moments = df.agg(
        F.struct(
            *[
                F.struct(F.avg(F.col(c).cast("double")).alias("m"), F.stddev_pop(F.col(c).cast("double")).alias("s")).alias(c)
                for c in columns
            ]
        ).alias("_m")
    ).scalar()
    scaled = {
        c: F.coalesce(
            F.try_divide(F.col(c).cast("double") - F.col("_m")[c]["m"], F.col("_m")[c]["s"]), F.lit(0.0)
        )
        for c in columns
    }
    return df.withColumn("_m", moments).withColumns(scaled).drop("_m")


def category(score: Column) -> Column:
    return right_closed(score, BAND_EDGES, BANDS)


def high_risk(score: Column) -> Column:
    return (F.col("bot_rate") > 0.3) | (F.col("fraud_score_avg") > 2.0) | (score < 3.0)


def score_class(score: Column) -> Column:
    """Class 1–4 of a score (0 included in class 1); null for unlabelled channels."""
    return right_closed(score, CLASS_EDGES, ["1", "2", "3", "4"], include_lowest=True).cast("int")


def class_score(label: Column) -> Column:
    chain = None
    for value, score in CLASS_SCORES.items():
        chain = F.when(label == value, F.lit(score)) if chain is None else chain.when(label == value, F.lit(score))
    return chain.otherwise(F.lit(UNLABELLED_SCORE))


def split(df: DataFrame, test_share: float = 0.2, key: str = "channelId") -> DataFrame:
    """Adds `is_test`, drawn by hash so that every run and every partitioning agrees."""
    return df.withColumn("is_test", hash01(F.concat(F.lit("split:"), F.col(key))) < test_share)


def regressor(name: str, trees: int) -> GBTRegressor | SecondOrderBoosting:
    """`gbt_a`: first-order trees of depth 6, rate 0.1; `gbt_b`: second-order ones with regularised leaves."""
    common = dict(
        featuresCol="features",
        labelCol="original_label",
        predictionCol=name,
        maxIter=trees,
        stepSize=0.1,
        maxDepth=6,
        maxBins=32,
    )
    if name == "gbt_a":
        return GBTRegressor(seed=42, **common)
    return SecondOrderBoosting("features", "original_label", name, trees=trees, rate=0.1, depth=6)


def assemble(df: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features").transform(df)


@dataclass
class Scorer:
    """Fitted quality models and their test metrics."""

    models: dict
    metrics: list[tuple]
    features: list[str]

    def metric_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.metrics, "model string, mse double, mae double, r2 double")

    def importance(self, spark: SparkSession) -> DataFrame:
        """(model, feature, importance) of every tree model."""
        rows = [
            (name, feature, float(model.featureImportances[i]))
            for name, model in self.models.items()
            for i, feature in enumerate(self.features)
        ]
        return spark.createDataFrame(rows, "model string, feature string, importance double")

    def save(self, path: str) -> None:
        for name, model in self.models.items():
            if isinstance(model, BoostedTrees):
                model.save(SparkSession.active(), f"{path}/{name}")
            else:
                PipelineModel([model]).write().overwrite().save(f"{path}/{name}")

    @staticmethod
    def load(path: str, names: list[str], features: list[str] = FEATURES) -> "Scorer":
        own = lambda n: BoostedTrees.load(SparkSession.active(), f"{path}/{n}")
        return Scorer({n: own(n) if n == "gbt_b" else PipelineModel.load(f"{path}/{n}").stages[0] for n in names}, [], features)


def evaluate(predictions: DataFrame, label: str, prediction: str) -> tuple[float, float, float]:
    """(mse, mae, r2)."""
    pairs = predictions.select(F.col(label).alias("label"), F.col(prediction).alias("prediction"))
    read = lambda m: float(RegressionEvaluator(metricName=m).evaluate(pairs))
    return read("mse"), read("mae"), read("r2")


def fit_supervised(
    prepared: DataFrame, trees: int = 100, names: tuple[str, ...] = ("gbt_a", "gbt_b", "random_forest")
) -> Scorer:
    """Fit the models on the labelled training share; `prepared` has scaled features assembled."""
    labelled = compact(settle(split(prepared.where(F.col("original_label").isNotNull())))).persist()
    try:
        train, test = labelled.where(~F.col("is_test")), labelled.where(F.col("is_test"))

        def fit(name: str) -> tuple:
            if name == "random_forest":
                banded = train.withColumn(
                    "band", F.array_position(F.array(*[F.lit(b) for b in BANDS]), category(F.col("original_label"))) - 1
                )
                forest = RandomForestClassifier(
                    featuresCol="features", labelCol="band", numTrees=trees, maxDepth=10, seed=42
                )
                return forest.fit(banded.withColumn("band", F.col("band").cast("double"))), None
            model = regressor(name, trees).fit(train)
            return model, (name, *evaluate(model.transform(test), "original_label", name))

        fitted = dict(zip(names, side_by_side(prepared.sparkSession, [partial(fit, name) for name in names])))
        return Scorer({name: model for name, (model, _) in fitted.items()}, [m for _, m in fitted.values() if m], FEATURES)
    finally:
        labelled.unpersist()


def ensemble(predictions: dict[str, Column]) -> Column:
    """Weighted mean of the available predictions, each clipped to [1,10]."""
    # Weight of supervised and of propagated scores.
    weights = {"gbt_a": 0.4, "gbt_b": 0.4, "label_propagation": 0.3, "label_spreading": 0.3}
    used = {n: c for n, c in predictions.items() if n in weights}
    if not used:
        return F.lit(None).cast("double")
    mass = sum(weights[n] for n in used)
    clip = lambda c: F.least(F.greatest(c, F.lit(1.0)), F.lit(10.0))
    out = F.lit(0.0)
    for name, column in used.items():
        out = out + clip(column) * F.lit(weights[name] / mass)
    return out


def result_table(scored: DataFrame, score: Column) -> DataFrame:
    """The channel score table: score, label, key metrics, category and risk flag."""
    return scored.select(
        "channelId",
        score.alias("quality_score"),
        "original_label",
        "volume",
        "bot_rate",
        "fraud_score_avg",
        "ip_diversity",
        "country_diversity",
        category(score).alias("quality_category"),
        high_risk(score).alias("high_risk"),
    )


def rule_scores(metrics: DataFrame) -> DataFrame:
    """Score table that uses the rule label as the score: no model, fully repeatable."""
    return result_table(quality_labels(metrics), F.col("original_label"))


def prepare(metrics: DataFrame, label_fraction: float = 1.0) -> DataFrame:
    """Labelled metrics with robustly scaled features, assembled for the models."""
    labelled = derived_features(quality_labels(metrics, label_fraction))
    return assemble(robust_scale(labelled, FEATURES)).select("channelId", "original_label", "features", *FEATURES)


def score_channels(
    metrics: DataFrame,
    trees: int = 100,
    label_fraction: float = 1.0,
    approximate: bool = False,
    scorer: Scorer | None = None,
) -> tuple[DataFrame, Scorer]:
    """Label, scale, fit, propagate and combine: the score table and the fitted models.

    `approximate` halves the number of trees; a fitted `scorer` is used as it is.
    """
    from .propagation import propagate

    trees = trees // 2 if approximate else trees
    scaled = settle(prepare(metrics, label_fraction))
    scorer = scorer or fit_supervised(scaled, trees, ("gbt_a", "gbt_b"))
    predicted = scorer.models["gbt_b"].transform(scorer.models["gbt_a"].transform(scaled))
    spread = propagate(
        scaled.select(
            F.col("channelId").alias("id"),
            F.array(*FEATURES).alias("vec"),
            score_class(F.col("original_label")).alias("label"),
        ),
        method="propagation",
    ).select(F.col("id").alias("channelId"), class_score(F.col("label")).alias("label_propagation"))
    raw = ["channelId", "volume", "bot_rate", "fraud_score_avg", "ip_diversity", "country_diversity"]
    joined = (
        metrics.select(*raw)
        .join(predicted.select("channelId", "original_label", "gbt_a", "gbt_b"), "channelId")
        .join(spread, "channelId")
    )
    score = ensemble({n: F.col(n) for n in ["gbt_a", "gbt_b", "label_propagation"]})
    return result_table(joined, score), scorer
