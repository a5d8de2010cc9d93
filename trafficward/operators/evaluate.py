"""Evaluation of scores, clusters and anomalies; cross validation and drift."""

from __future__ import annotations

import math
import uuid
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.common import correlation, hash01
from ..session import compact, settle
from ..schema import ANOMALY_FLAGS, numeric_columns
from .quality import category, evaluate as regression_errors, regressor
from .ranks import cumulative, melt, quantile_struct
from .tables import align


def score_distribution(scores: DataFrame) -> DataFrame:
    """One row: channels, mean, deviation, range, quartiles, high-risk count and percentage."""
    quartiles = quantile_struct(scores, ["quality_score"], [0.25, 0.5, 0.75])
    base = scores.agg(
        F.count("*").alias("n_channels"),
        F.avg("quality_score").alias("mean"),
        F.stddev_samp("quality_score").alias("std"),
        F.min("quality_score").alias("min"),
        F.max("quality_score").alias("max"),
        F.count_if("high_risk").alias("high_risk_count"),
        (F.count_if("high_risk") * 100.0 / F.count("*")).alias("high_risk_pct"),
    ).withColumn("_q", quartiles)
    picked = {f"q{i + 1}": F.col("_q.quality_score")[i] for i in range(3)}
    return base.withColumns(picked).drop("_q")


def category_distribution(scores: DataFrame) -> DataFrame:
    return scores.where(F.col("quality_category").isNotNull()).groupBy("quality_category").agg(F.count("*").alias("n"))


def regression_metrics(pairs: DataFrame, truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    """mse, mae, r2 and correlation in one aggregate."""
    t, p = F.col(truth).cast("double"), F.col(prediction).cast("double")
    error = F.avg((t - p) * (t - p))
    return pairs.where(t.isNotNull() & p.isNotNull()).agg(
        F.count("*").alias("n"),
        error.alias("mse"),
        F.avg(F.abs(t - p)).alias("mae"),
        (F.lit(1.0) - F.try_divide(error, F.var_pop(t))).alias("r2"),
        correlation(t, p).alias("correlation"),
    )


def macro_metrics(pairs: DataFrame, truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    """Accuracy and macro precision, recall and F1 over the labels seen on either side."""
    cells = (
        pairs.where(F.col(truth).isNotNull() & F.col(prediction).isNotNull())
        .groupBy(F.col(truth).cast("string").alias("t"), F.col(prediction).cast("string").alias("p"))
        .agg(F.count("*").alias("n"))
    )
    sides = cells.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.lit(1).alias("is_t")), F.struct(F.col("p").alias("label"), F.lit(0).alias("is_t")))).alias("s"), "n", (F.col("t") == F.col("p")).alias("hit"))
    per = sides.groupBy("s.label").agg(
        F.sum(F.when(F.col("s.is_t") == 1, F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("s.is_t") == 0, F.col("n")).otherwise(0)).alias("predicted"),
        F.sum(F.when((F.col("s.is_t") == 1) & F.col("hit"), F.col("n")).otherwise(0)).alias("right"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    scored = per.withColumns(
        {
            "precision": zero(F.try_divide(F.col("right").cast("double"), F.col("predicted").cast("double"))),
            "recall": zero(F.try_divide(F.col("right").cast("double"), F.col("support").cast("double"))),
            "f1": zero(F.try_divide(2.0 * F.col("right"), F.col("support") + F.col("predicted"))),
        }
    )
    return scored.agg(
        (F.sum("right") / F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
    )


def band_metrics(pairs: DataFrame, truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    """Classification metrics of two score columns after banding both."""
    banded = pairs.select(category(F.col(truth)).alias("truth"), category(F.col(prediction)).alias("prediction"))
    return macro_metrics(banded)


def cluster_sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("cluster").agg(F.count("*").alias("size"))


def cluster_size_stats(labelled: DataFrame) -> DataFrame:
    """Clusters, mean / deviation / range of their sizes, and the outlier percentage."""
    sizes = cluster_sizes(labelled)
    kept = F.col("cluster") >= 0
    return sizes.agg(
        F.count_if(kept).alias("n_clusters"),
        F.avg(F.when(kept, F.col("size"))).alias("mean_size"),
        F.stddev_samp(F.when(kept, F.col("size"))).alias("std_size"),
        F.min(F.when(kept, F.col("size"))).alias("min_size"),
        F.max(F.when(kept, F.col("size"))).alias("max_size"),
        (F.sum(F.when(~kept, F.col("size")).otherwise(0)) * 100.0 / F.sum("size")).alias("outlier_pct"),
    )


def anomaly_counts(flags: DataFrame) -> DataFrame:
    """Counts per family, channels with any and with three or more."""
    return flags.agg(
        F.count("*").alias("n_entities"),
        *[F.count_if(F.col(c)).alias(c) for c in ANOMALY_FLAGS],
        F.count_if(F.col("overall_anomaly_count") > 0).alias("total_anomalies"),
        F.count_if(F.col("overall_anomaly_count") >= 3).alias("high_anomaly_entities"),
    )


def anomaly_distribution(flags: DataFrame) -> DataFrame:
    return flags.groupBy("overall_anomaly_count").agg(F.count("*").alias("n"))


def validation(flags: DataFrame, known: DataFrame, key: str = "channelId", flag: str = "overall_anomaly_flag") -> DataFrame:
    """Confusion counts and precision / recall / F1 / accuracy against known anomalous keys."""
    marked = flags.join(known.select(key).distinct().withColumn("_truth", F.lit(True)), key, "left")
    truth, guess = F.coalesce("_truth", F.lit(False)), F.coalesce(F.col(flag), F.lit(False))
    cells = marked.agg(
        F.count_if(truth & guess).alias("tp"),
        F.count_if(~truth & guess).alias("fp"),
        F.count_if(truth & ~guess).alias("fn"),
        F.count_if(~truth & ~guess).alias("tn"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ["tp", "fp", "fn", "tn"])
    return cells.withColumns(
        {
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1_score": ratio(2 * tp, 2 * tp + fp + fn),
            "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        }
    )


def cross_validate(prepared: DataFrame, folds: int = 5, trees: int = 100, names: tuple[str, ...] = ("gbt_a", "gbt_b")) -> DataFrame:
    """Mean and deviation of mse, mae and r2 over hashed folds, per regressor.

    A fit is many small steps one after the other, so several fits run side by side; when one
    fails, the jobs of the others are cancelled and the error is raised.
    """
    spark = prepared.sparkSession
    tag = f"cross-validation-{uuid.uuid4().hex}"
    fold = F.floor(hash01(F.concat(F.lit("fold:"), F.col("channelId"))) * folds)
    data = compact(settle(prepared.where(F.col("original_label").isNotNull()).withColumn("fold", fold))).persist()
    rows = []

    def held_out(name: str, i: int):
        spark.addTag(tag)
        model = regressor(name, trees).fit(data.where(F.col("fold") != i))
        return regression_errors(model.transform(data.where(F.col("fold") == i)), "original_label", name)

    try:
        with ThreadPoolExecutor(max_workers=folds) as pool:
            waiting = {name: [pool.submit(held_out, name, i) for i in range(folds)] for name in names}
            done, late = wait([f for futures in waiting.values() for f in futures], return_when=FIRST_EXCEPTION)
            if any(f.exception() for f in done):
                pool.shutdown(wait=False, cancel_futures=True)
                spark.interruptTag(tag)
            found = {name: [f.result() for f in futures] for name, futures in waiting.items()}
        for name, scores in found.items():
            summary = []
            for j in range(3):
                values = [s[j] for s in scores]
                mean = sum(values) / folds
                summary += [mean, math.sqrt(sum((v - mean) ** 2 for v in values) / folds)]
            rows.append((name, *summary))
    finally:
        data.unpersist()
    return spark.createDataFrame(
        rows,
        "model string, mse_mean double, mse_std double, mae_mean double, mae_std double, r2_mean double, r2_std double",
    )


def _kolmogorov(x):
    """Survival function of the Kolmogorov distribution as a column (100 terms of its series)."""
    terms = F.sequence(F.lit(1), F.lit(100))
    tail = F.aggregate(
        terms,
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(F.lit(-2.0) * k * k * x * x),
    )
    return F.when(x < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(tail, F.lit(0.0)), F.lit(1.0)))


def exact_ks(n: Column, m: Column, statistic: Column) -> Column:
    """The chance of a two-sample statistic at least this large when both samples share a distribution.

    Orders of the n + m values are lattice paths from (0, 0) to (n, m), all equally likely. A fold
    over the rows of the lattice counts the paths that stay where |i/n − j/m| is smaller than the
    statistic; the rest is the p-value. Counts are doubles, so n + m may reach about 1,000.
    """
    n, m = n.cast("long"), m.cast("long")
    bound = F.round(statistic * n * m).cast("long")

    def row(above: Column, i: Column) -> Column:
        def step(done: Column, j: Column) -> Column:
            ways = F.when((i == 0) & (j == 0), F.lit(1.0)).otherwise(F.get(above, j.cast("int")) + done["last"])
            inside = F.when(F.abs(i * m - j * n) < bound, ways).otherwise(F.lit(0.0))
            return F.struct(F.concat(done["row"], F.array(inside)).alias("row"), inside.alias("last"))

        start = F.struct(F.array().cast("array<double>").alias("row"), F.lit(0.0).alias("last"))
        return F.aggregate(F.sequence(F.lit(0).cast("long"), m), start, step, lambda done: done["row"])

    last = F.aggregate(F.sequence(F.lit(0).cast("long"), n), F.array_repeat(F.lit(0.0), (m + 1).cast("int")), row)
    inside = F.element_at(last, -1)
    every = F.aggregate(F.sequence(F.lit(1).cast("long"), n), F.lit(1.0), lambda c, k: c * (m + k) / k)
    return F.when(bound <= 0, F.lit(1.0)).otherwise(F.least(F.greatest(1.0 - inside / every, F.lit(0.0)), F.lit(1.0)))


def drift(
    current: DataFrame, baseline: DataFrame, features: list[str] | None = None, alpha: float = 0.05, exact_cells: int = 10_000
) -> DataFrame:
    """Two-sample Kolmogorov–Smirnov statistic per common numeric feature, with means and mean shift.

    All features go through one pass in long form; the cumulative shares are exact (see
    `ranks.cumulative`). The p-value is exact (`exact_ks`) while the product of the sample sizes is
    at most `exact_cells`, and asymptotic beyond.
    """
    if features is None:
        there = set(numeric_columns(baseline))
        features = [c for c in numeric_columns(current) if c in there]
    side = lambda df, a, b: melt(df, features).select("column", "value", F.lit(a).alias("a"), F.lit(b).alias("b"))
    both = side(current, 1, 0).unionByName(side(baseline, 0, 1))
    ranked = cumulative(both, ["column"], "value", {"a": F.col("a"), "b": F.col("b")})
    share = lambda s: (F.col(f"before_{s}") + F.col(s)) / F.col(f"total_{s}")
    statistic = ranked.groupBy("column").agg(
        F.max(F.abs(share("a") - share("b"))).alias("ks_statistic"),
        F.max("total_a").alias("_n"),
        F.max("total_b").alias("_m"),
    )
    moments = both.groupBy("column").agg(
        F.avg(F.when(F.col("a") == 1, F.col("value"))).alias("current_mean"),
        F.avg(F.when(F.col("b") == 1, F.col("value"))).alias("baseline_mean"),
        F.stddev_samp(F.when(F.col("b") == 1, F.col("value"))).alias("_std"),
    )
    small = (F.col("_n") > 0) & (F.col("_m") > 0) & (F.col("_n") * F.col("_m") <= exact_cells)
    root = F.sqrt(F.col("_n") * F.col("_m") / (F.col("_n") + F.col("_m")))
    return (
        statistic.join(moments, "column")
        .withColumn(
            "p_value",
            F.when(small, exact_ks(F.col("_n"), F.col("_m"), F.col("ks_statistic"))).otherwise(_kolmogorov(root * F.col("ks_statistic"))),
        )
        .select(
            F.col("column").alias("feature"),
            "ks_statistic",
            "p_value",
            (F.col("p_value") < alpha).alias("drift_detected"),
            "current_mean",
            "baseline_mean",
            F.try_divide(F.abs(F.col("current_mean") - F.col("baseline_mean")), F.col("_std")).alias("mean_shift"),
        )
    )


def drift_summary(drifts: DataFrame, limit: float = 0.1) -> DataFrame:
    share = F.avg(F.col("drift_detected").cast("double"))
    return drifts.agg(share.alias("drift_score"), (share > limit).alias("drift_detected"))


def fast_metrics(scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.avg("quality_score").alias("mean_score"),
        F.stddev_samp("quality_score").alias("std_score"),
        F.avg(F.col("high_risk").cast("double")).alias("high_risk_ratio"),
    )


def compare_scores(scores: DataFrame, truth: DataFrame, key: str = "channelId") -> DataFrame:
    """Predictions aligned with the truth for the channels both know."""
    return align(scores.select(key, F.col("quality_score").alias("prediction")), truth, key)


def explained_variance(components: DataFrame) -> DataFrame:
    """Total variance of projected components."""
    long = components.select(F.posexplode("components").alias("axis", "x"))
    return long.groupBy("axis").agg(F.var_pop("x").alias("v")).agg(F.sum("v").alias("variance_explained"))

