"""Evaluation, drift and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import channels as ch, evaluate as ev, quality as ql, report as rp
from ..operators.classify import classification_summary
from ..session import new_folder, settle
from ..sources.sinks import write_document
from .base import band, query
from .channel_queries import classified, flags, metrics, scores

_FLAGS = ["temporal_anomaly", "geographic_anomaly", "device_anomaly", "behavioral_anomaly", "volume_anomaly"]
_JOINED = "(SELECT scores.*, coalesce(overall_anomaly_count, 0) AS a FROM scores LEFT JOIN flags USING (channelId))"


@query("M01_score_distribution", "n_channels:i mean:f std:f min:f max:f q1:f q2:f q3:f high_risk_count:i high_risk_pct:f", """SELECT count(*) AS n_channels, avg(quality_score) AS mean, stddev_samp(quality_score) AS std,
    min(quality_score) AS min, max(quality_score) AS max, quantile_cont(quality_score, 0.25) AS q1, quantile_cont(quality_score, 0.5) AS q2, quantile_cont(quality_score, 0.75) AS q3,
    count(*) FILTER (WHERE high_risk) AS high_risk_count, 100.0 * count(*) FILTER (WHERE high_risk) / count(*) AS high_risk_pct FROM scores""")
def _(t):
    return ev.score_distribution(scores(t))


@query("M01_category_distribution", "quality_category:s n:i", "SELECT quality_category, count(*) AS n FROM scores WHERE quality_category IS NOT NULL GROUP BY quality_category")
def _(t):
    return ev.category_distribution(scores(t))


_PAIRS = "(SELECT s.quality_score AS truth, c.quality_score / 10 AS prediction FROM closed c JOIN scores s USING (channelId))"


def _pairs(t):
    predicted = ch.closed_form_quality(t.rows).withColumn("quality_score", F.col("quality_score") / 10)
    return ev.compare_scores(predicted, scores(t).select("channelId", F.col("quality_score").alias("truth")))


@query("M02_regression_metrics", "n:i mse:f mae:f r2:f correlation:f", f"""SELECT count(*) AS n, avg((truth - prediction) ** 2) AS mse, avg(abs(truth - prediction)) AS mae,
    1 - avg((truth - prediction) ** 2) / var_pop(truth) AS r2, corr(truth, prediction) AS correlation FROM {_PAIRS}""")
def _(t):
    return ev.regression_metrics(_pairs(t))


_MACRO = """SELECT sum(hit) / sum(support) AS accuracy, avg(CASE WHEN predicted > 0 THEN hit / predicted ELSE 0 END) AS precision_macro,
    avg(CASE WHEN support > 0 THEN hit / support ELSE 0 END) AS recall_macro, avg(2 * hit / (support + predicted)) AS f1_macro FROM
    (SELECT label, sum((t = label)::INT) AS support, sum((p = label)::INT) AS predicted, sum((t = label AND p = label)::INT) AS hit FROM {pairs} CROSS JOIN
      (SELECT DISTINCT label FROM (SELECT t AS label FROM {pairs} UNION SELECT p FROM {pairs})) GROUP BY label)"""


@query("M03_band_metrics", "accuracy:f precision_macro:f recall_macro:f f1_macro:f", _MACRO.format(pairs=f"(SELECT {band('truth')} AS t, {band('prediction')} AS p FROM {_PAIRS})"))
def _(t):
    return ev.band_metrics(_pairs(t))


@query("M03_label_metrics", "accuracy:f precision_macro:f recall_macro:f f1_macro:f", _MACRO.format(pairs="(SELECT quality::VARCHAR AS t, (n_chars > 1000)::INT::VARCHAR AS p FROM documents JOIN labels USING (doc_id))"))
def _(t):
    docs = t.read("documents").select("doc_id", (F.col("n_chars") > 1000).cast("int").alias("prediction"))
    return ev.macro_metrics(docs.join(t.read("labels").select("doc_id", F.col("quality").alias("truth")), "doc_id"))


@query("M05_anomaly_counts", "n_entities:i " + " ".join(f"{f}:i" for f in _FLAGS) + " total_anomalies:i high_anomaly_entities:i", "SELECT count(*) AS n_entities, "
       + ", ".join(f"sum({f}::INT) AS {f}" for f in _FLAGS) + ", count(*) FILTER (WHERE overall_anomaly_count > 0) AS total_anomalies, count(*) FILTER (WHERE overall_anomaly_count >= 3) AS high_anomaly_entities FROM flags")
def _(t):
    return ev.anomaly_counts(flags(t))


@query("M05_anomaly_distribution", "overall_anomaly_count:i n:i", "SELECT overall_anomaly_count, count(*) AS n FROM flags GROUP BY ALL")
def _(t):
    return ev.anomaly_distribution(flags(t))


@query("M06_validation", "tp:i fp:i fn:i tn:i precision:f recall:f f1_score:f accuracy:f", """SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
    coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1_score, (tp + tn) / (tp + fp + fn + tn) AS accuracy FROM (SELECT count(*) FILTER (WHERE k AND f) AS tp, count(*) FILTER (WHERE NOT k AND f) AS fp,
    count(*) FILTER (WHERE k AND NOT f) AS fn, count(*) FILTER (WHERE NOT k AND NOT f) AS tn FROM (SELECT high_risk AS k, coalesce(temporal_anomaly OR geographic_anomaly, false) AS f FROM scores LEFT JOIN flags USING (channelId)))""")
def _(t):
    marked = flags(t).withColumn("overall_anomaly_flag", F.col("temporal_anomaly") | F.col("geographic_anomaly"))
    return ev.validation(marked, scores(t).where("high_risk"))


@query("M07_cross_validation", "model:s mse_mean:f mse_std:f mae_mean:f mae_std:f r2_mean:f r2_std:f")
def _(t):
    labelled = ql.derived_features(ql.quality_labels(t.stored("metrics", lambda: metrics(t))))
    return ev.cross_validate(ql.assemble(ql.robust_scale(labelled, ql.FEATURES)), folds=5, trees=100)


_DRIFT = ["browserMajorVersion", "weighted_fraud_score", "ip_entropy"]


def _drift_sql(c: str) -> str:
    return f"""SELECT '{c}' AS feature, max(abs(fa - fb)) AS ks_statistic, (SELECT avg({c}) FROM hits WHERE month = 1 AND day_of_month <= 15) AS current_mean,
    (SELECT avg({c}) FROM hits WHERE NOT (month = 1 AND day_of_month <= 15)) AS baseline_mean FROM (SELECT v, sum(sum(a)) OVER (ORDER BY v) / sum(sum(a)) OVER () AS fa, sum(sum(b)) OVER (ORDER BY v) / sum(sum(b)) OVER () AS fb
      FROM (SELECT round({c}, 9) AS v, (month = 1 AND day_of_month <= 15)::INT AS a, 1 - (month = 1 AND day_of_month <= 15)::INT AS b FROM hits) GROUP BY v)"""


@query("M08_drift", "feature:s ks_statistic:f current_mean:f baseline_mean:f", " UNION ALL ".join(_drift_sql(c) for c in _DRIFT))
def _(t):
    # equal entropies may differ in the last bit between engines: compare at nine places
    rows = t.rows.withColumn("ip_entropy", F.round("ip_entropy", 9)).withColumn("weighted_fraud_score", F.round("weighted_fraud_score", 9))
    first = (F.col("month") == 1) & (F.col("day_of_month") <= 15)
    return ev.drift(rows.where(first).select(*_DRIFT), rows.where(~first).select(*_DRIFT))


_FIRST = "(month = 1 AND day_of_month <= 15)"
_SIZES = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, (count({c}) FILTER ({_FIRST}))::DOUBLE AS n, (count({c}) FILTER (NOT {_FIRST}))::DOUBLE AS m FROM hits" for c in _DRIFT
)


@query("M08_drift_summary", "drift_score:f drift_detected:b", f"""SELECT avg((p < 0.05)::INT) AS drift_score, avg((p < 0.05)::INT) > 0.1 AS drift_detected FROM (
    SELECT feature, CASE WHEN any_value(x) < 0.2 THEN 1.0 ELSE least(greatest(sum(CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0::DOUBLE * k * k * x * x)), 0.0), 1.0) END AS p FROM (
      SELECT feature, ks_statistic * sqrt(n * m / (n + m)) AS x FROM ({" UNION ALL ".join(map(_drift_sql, _DRIFT))}) JOIN ({_SIZES}) USING (feature)), range(1, 101) t(k)
    GROUP BY feature)""")
def _(t):
    first = (F.col("month") == 1) & (F.col("day_of_month") <= 15)
    return ev.drift_summary(ev.drift(t.rows.where(first).select(*_DRIFT), t.rows.where(~first).select(*_DRIFT)))


@query("M09_fast_metrics", "mean_score:f std_score:f high_risk_ratio:f", "SELECT avg(quality_score) AS mean_score, stddev_samp(quality_score) AS std_score, avg(high_risk::INT) AS high_risk_ratio FROM scores")
def _(t):
    return ev.fast_metrics(scores(t))


@query("N01_best_and_worst", "side:s channelId:s quality_score:f quality_category:s volume:i bot_rate:f high_risk:b", """(SELECT 'top' AS side, * FROM scores ORDER BY quality_score DESC, channelId LIMIT 20) UNION ALL
    (SELECT 'bottom', * FROM scores ORDER BY quality_score, channelId LIMIT 20)""")
def _(t):
    return rp.best_and_worst(scores(t))


@query("N01_high_risk", "channelId:s quality_score:f quality_category:s volume:i bot_rate:f", "SELECT * FROM scores WHERE high_risk ORDER BY quality_score DESC, channelId LIMIT 50")
def _(t):
    return rp.high_risk_channels(scores(t))


@query("N01_most_anomalous", "channelId:s overall_anomaly_count:i", "SELECT * FROM flags ORDER BY overall_anomaly_count DESC, channelId LIMIT 20")
def _(t):
    return rp.most_anomalous(flags(t))


@query("N01_summary_stats", "total_channels:i high_risk_count:i avg_quality_score:f processing_mode:s", "SELECT count(*) AS total_channels, count(*) FILTER (WHERE high_risk) AS high_risk_count, avg(quality_score) AS avg_quality_score, 'full' AS processing_mode FROM scores")
def _(t):
    return rp.summary_stats(scores(t))


@query("A09_result_document", "n_top:i n_bottom:i n_risky:i best:s total_channels:i fraud_rows:i")
def _(t):
    path = new_folder(t.spark, "results-json")
    document = rp.final_document(settle(scores(t)), settle(flags(t)), classification_summary(classified(t)))
    write_document(document, path)
    back = t.spark.read.json(path)
    return back.select(
        F.size("top_quality_channels").alias("n_top"), F.size("bottom_quality_channels").alias("n_bottom"), F.size("high_risk_channels").alias("n_risky"),
        F.col("top_quality_channels")[0]["channelId"].alias("best"), F.col("summary_stats.total_channels").alias("total_channels"),
        F.col("fraud_classification_summary.fraud_rows").alias("fraud_rows"),
    )


@query("N02_kpis", "total_channels:i high_risk_channels:i high_risk_pct:f anomalous_channels:i anomalous_pct:f avg_quality_score:f avg_bot_rate:f total_volume:i", f"""SELECT count(*) AS total_channels,
    count(*) FILTER (WHERE high_risk) AS high_risk_channels, 100.0 * count(*) FILTER (WHERE high_risk) / count(*) AS high_risk_pct, count(*) FILTER (WHERE a > 0) AS anomalous_channels,
    100.0 * count(*) FILTER (WHERE a > 0) / count(*) AS anomalous_pct, avg(quality_score) AS avg_quality_score, avg(bot_rate) AS avg_bot_rate, sum(volume) AS total_volume FROM {_JOINED}""")
def _(t):
    return rp.kpis(scores(t), flags(t))


@query("N03_score_statistics", "n:i mean:f std:f min:f q1:f median:f q3:f max:f iqr:f outliers:i high_quality:i medium_quality:i low_quality:i", """SELECT count(*) AS n, avg(s) AS mean, stddev_samp(s) AS std, min(s) AS min,
    max(a) AS q1, max(b) AS median, max(c) AS q3, max(s) AS max, max(c - a) AS iqr, count(*) FILTER (WHERE s < a - 1.5 * (c - a) OR s > c + 1.5 * (c - a)) AS outliers,
    count(*) FILTER (WHERE s > 6.5) AS high_quality, count(*) FILTER (WHERE s BETWEEN 3.5 AND 6.5) AS medium_quality, count(*) FILTER (WHERE s < 3.5) AS low_quality FROM
    (SELECT quality_score AS s, quantile_cont(quality_score, 0.25) OVER () AS a, median(quality_score) OVER () AS b, quantile_cont(quality_score, 0.75) OVER () AS c FROM scores)""")
def _(t):
    return rp.score_statistics(scores(t))


_RISK = f"(SELECT *, (10 - quality_score) * 0.4 + a * 0.3 + bot_rate * 10 * 0.3 AS composite_risk, log10(volume + 1) AS log_volume FROM {_JOINED})"


@query("N04_trends", "line:s slope:f intercept:f correlation:f", " UNION ALL ".join(
    f"SELECT '{y}~{x}' AS line, regr_slope({y}, {x}) AS slope, regr_intercept({y}, {x}) AS intercept, corr({y}, {x}) AS correlation FROM {_RISK}"
    for y, x in [("bot_rate", "quality_score"), ("quality_score", "ip_diversity"), ("composite_risk", "log_volume")]))
def _(t):
    return rp.trends(scores(t), flags(t))


@query("N05_flag_correlations", "column_a:s column_b:s corr:f", " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, CASE WHEN stddev_pop({a}::INT) > 0 AND stddev_pop({b}::INT) > 0 THEN corr({a}::INT, {b}::INT) END AS corr FROM flags" for i, a in enumerate(_FLAGS) for b in _FLAGS[i + 1:]))
def _(t):
    return rp.flag_correlations(flags(t))


@query("N06_anomalies_by_type", "anomaly_type:s n:i", " UNION ALL ".join(f"SELECT '{f}' AS anomaly_type, count(*) FILTER (WHERE {f}) AS n FROM flags" for f in _FLAGS))
def _(t):
    return rp.anomalies_by_type(flags(t))


@query("N07_composite_risk", "channelId:s composite_risk:f", f"SELECT * FROM {_RISK}")
def _(t):
    return rp.with_composite_risk(scores(t), flags(t))


_BOT = "CASE WHEN bot_rate <= 0.1 THEN '0-10%' WHEN bot_rate <= 0.3 THEN '10-30%' WHEN bot_rate <= 0.5 THEN '30-50%' WHEN bot_rate <= 0.7 THEN '50-70%' ELSE '70-100%' END"


@query("N08_risk_matrix", "bot_rate_band:s 0-10:i 10-100:i 100-1K:i 1K-10K:i 10K+:i", f"""SELECT {_BOT} AS bot_rate_band, count(*) FILTER (WHERE volume <= 10) AS "0-10", count(*) FILTER (WHERE volume > 10 AND volume <= 100) AS "10-100",
    count(*) FILTER (WHERE volume > 100 AND volume <= 1000) AS "100-1K", count(*) FILTER (WHERE volume > 1000 AND volume <= 10000) AS "1K-10K", count(*) FILTER (WHERE volume > 10000) AS "10K+" FROM scores GROUP BY 1""")
def _(t):
    return rp.risk_matrix(scores(t))


@query("N09_anomaly_matrix", "channelId:s " + " ".join(f"{f}:i" for f in _FLAGS), "SELECT channelId, " + ", ".join(f"{f}::INT AS {f}" for f in _FLAGS) + " FROM flags WHERE overall_anomaly_count > 0 ORDER BY overall_anomaly_count DESC, channelId LIMIT 20")
def _(t):
    return rp.anomaly_matrix(flags(t))


@query("N10_score_clusters", "cluster:i avg_quality:f size:i")
def _(t):
    return rp.quality_by_cluster(rp.score_clusters(settle(scores(t))))


@query("N10_quality_by_quantile", "cluster:i avg_quality:f size:i", """SELECT cluster, avg(quality_score) AS avg_quality, count(*) AS size FROM (SELECT quality_score, len(list_filter(e[2:len(e) - 1], lambda x: x < quality_score)) AS cluster FROM scores,
    (SELECT list_sort(list_distinct(quantile_cont(quality_score, [0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e FROM scores)) GROUP BY cluster""")
def _(t):
    return rp.quality_by_quantile(scores(t))


@query("N11_quality_trend", "period:i mean:f std:f", "SELECT period, avg(quality_score) AS mean, stddev_samp(quality_score) AS std FROM (SELECT quality_score, ntile(10) OVER (ORDER BY quality_score DESC, channelId) AS period FROM scores) GROUP BY period")
def _(t):
    return rp.quality_trend(scores(t))


@query("N12_bot_rate_boxes", "quality_category:s low:f q1:f median:f q3:f high:f n:i", """SELECT quality_category, min(bot_rate) AS low, quantile_cont(bot_rate, 0.25) AS q1, median(bot_rate) AS median, quantile_cont(bot_rate, 0.75) AS q3,
    max(bot_rate) AS high, count(*) AS n FROM scores WHERE quality_category IS NOT NULL GROUP BY quality_category""")
def _(t):
    return rp.bot_rate_boxes(scores(t))


@query("N13_risk_factors", "channelId:s quality_score:f bot_rate:f volume:i risk_factors:s", """SELECT *, concat_ws(', ', CASE WHEN bot_rate > 0.5 THEN 'High bot rate' END, CASE WHEN volume < 10 THEN 'Low volume' END,
    CASE WHEN fraud_score_avg > 0.5 THEN 'High fraud score' END) AS risk_factors FROM scores WHERE high_risk ORDER BY quality_score, channelId LIMIT 5""")
def _(t):
    return rp.risk_factors(scores(t))


@query("N13_strengths", "channelId:s quality_score:f bot_rate:f volume:i strengths:s", """SELECT *, concat_ws(', ', CASE WHEN bot_rate < 0.05 THEN 'Low bot rate' END, CASE WHEN volume > 100 THEN 'High volume' END,
    CASE WHEN ip_diversity > 0.5 THEN 'Diverse IPs' END) AS strengths FROM scores ORDER BY quality_score DESC, channelId LIMIT 5""")
def _(t):
    return rp.strengths(scores(t))


@query("N14_recommendations", "block_or_investigate:i high_risk_bot_rate:f revenue_at_risk:f review_anomalous:i improve_medium_low:i consider_removal:i", f"""SELECT count(*) FILTER (WHERE high_risk) AS block_or_investigate,
    avg(bot_rate) FILTER (WHERE high_risk) AS high_risk_bot_rate, 0.1 * sum(volume) FILTER (WHERE high_risk) AS revenue_at_risk, count(*) FILTER (WHERE a > 0) AS review_anomalous,
    count(*) FILTER (WHERE quality_category = 'Medium-Low') AS improve_medium_low, count(*) FILTER (WHERE quality_category = 'Low') AS consider_removal FROM {_JOINED}""")
def _(t):
    return rp.recommendations(scores(t), flags(t))


def _histogram_sql(column: str, bins: int) -> str:
    return f"""SELECT least(floor((x - lo) * {bins} / (hi - lo)), {bins - 1})::BIGINT AS bin, count(*) AS n FROM (SELECT {column}::DOUBLE AS x FROM scores),
    (SELECT min({column})::DOUBLE AS lo, max({column})::DOUBLE AS hi FROM scores) GROUP BY 1"""


@query("N15_score_histogram", "bin:i n:i", _histogram_sql("quality_score", 30))
def _(t):
    return rp.histogram(scores(t), "quality_score", 30)


@query("N15_volume_histogram", "bin:i n:i", _histogram_sql("log10(volume + 1)", 20))
def _(t):
    return rp.histogram(scores(t).withColumn("log_volume", F.log10(F.col("volume") + 1)), "log_volume", 20)
