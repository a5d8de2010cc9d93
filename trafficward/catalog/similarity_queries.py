"""Neighbours, clusters, embeddings and similarity, over channel tables and the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import channels as ch, density as dn, detectors as det, hierarchy as hi, neighbours as nb, quality as ql, similarity as sm
from ..operators.evaluate import cluster_size_stats, explained_variance
from ..session import settle
from .base import query
from .channel_queries import metrics

_POINTS = "SELECT 'v' || vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings"
_RANKED = f"""WITH p AS ({_POINTS}) SELECT a.id AS id, b.id AS neighbour, list_distance(a.v, b.v) AS distance,
    row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS rank FROM p a JOIN p b ON a.id <> b.id"""

_PROFILES = "SELECT channelId, " + ", ".join(f"count(*) FILTER (WHERE hour = {h}) AS hour_{h}" for h in range(24)) + """,
    avg(coalesce(device = 'mobile', false)::INT) AS m, count(DISTINCT country) AS c, avg(is_weekend) AS w, avg(ip_risk_points) AS r, avg(isLikelyBot::INT) AS b FROM hits GROUP BY channelId"""
_COLS = [f"hour_{h}" for h in range(24)] + ["m", "c", "w", "r", "b"]
_UNIT = f"""SELECT id, [x / n FOR x IN v] AS u FROM (SELECT id, v, sqrt(list_sum([x * x FOR x IN v])) AS n FROM (SELECT channelId AS id,
    [{', '.join(f'coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0)::DOUBLE' for c in _COLS)}] AS v FROM ({_PROFILES}))) WHERE n > 0"""


def _profiles(t):
    return t.stored("profiles", lambda: sm.scaled_profiles(settle(ch.profiles(t.rows))))


@query("F10_nearest_neighbours", "id:s neighbour:s distance:f rank:i", f"SELECT * FROM ({_RANKED}) WHERE rank <= 5")
def _(t):
    return nb.nearest_neighbours(t.points, 5)


@query("F09_similar_pairs", "id_a:s id_b:s similarity:f", f"WITH u AS MATERIALIZED ({_UNIT}) SELECT a.id AS id_a, b.id AS id_b, list_dot_product(a.u, b.u) AS similarity FROM u a JOIN u b ON a.id < b.id WHERE list_dot_product(a.u, b.u) >= 0.5")
def _(t):
    return sm.cosine_pairs(_profiles(t), 0.5)


@query("J13_cosine_similarity", "id_a:s id_b:s similarity:f copies_a:i", f"WITH u AS MATERIALIZED ({_UNIT}) SELECT a.id AS id_a, b.id AS id_b, list_dot_product(a.u, b.u) AS similarity, 1 AS copies_a FROM u a JOIN u b ON a.id < b.id WHERE list_dot_product(a.u, b.u) >= 0.3")
def _(t):
    return sm.cosine_pairs(_profiles(t), 0.3)


@query("G11_most_similar", "id:s neighbour:s similarity:f rank:i", f"""WITH u AS MATERIALIZED ({_UNIT}) SELECT * FROM (SELECT a.id AS id, b.id AS neighbour, list_dot_product(a.u, b.u) AS similarity,
    row_number() OVER (PARTITION BY a.id ORDER BY list_dot_product(a.u, b.u) DESC, b.id) AS rank FROM u a JOIN u b ON a.id <> b.id) WHERE rank <= 10""")
def _(t):
    return sm.most_similar(_profiles(t), 10)


@query("B10_analysis_summary", "total_records:i channels:i min_score:f avg_score:f max_score:f anomalous:i mean_similarity:f", f"""WITH u AS MATERIALIZED ({_UNIT}) SELECT (SELECT count(*) FROM hits) AS total_records, count(*) AS channels,
    min(quality_score) AS min_score, avg(quality_score) AS avg_score, max(quality_score) AS max_score, count(*) FILTER (WHERE quality_score < 30) AS anomalous,
    (SELECT avg(list_dot_product(a.u, b.u)) FROM u a JOIN u b ON true) AS mean_similarity FROM closed""")
def _(t):
    scored = ch.closed_form_quality(t.rows)
    mean = sm.mean_similarity(_profiles(t)).select("mean_similarity").scalar()
    return scored.agg(
        F.sum("traffic_volume").alias("total_records"), F.count("*").alias("channels"), F.min("quality_score").alias("min_score"),
        F.avg("quality_score").alias("avg_score"), F.max("quality_score").alias("max_score"),
        F.count_if(F.col("quality_score") < 30).alias("anomalous"),
    ).withColumn("mean_similarity", mean)


_PREP = ["bot_rate", "fraud_score_avg", "ip_diversity", "country_diversity", "volume", "time_pattern_diversity"]


@query("J01_selected_features", "feature:s", f"""SELECT feature FROM (SELECT * FROM (VALUES {', '.join(f"({i}, '{c}')" for i, c in enumerate(_PREP))}) f(i, feature)) JOIN
    (UNPIVOT (SELECT {', '.join(f'var_samp({c}) AS {c}' for c in _PREP)} FROM metrics) ON COLUMNS(*) INTO NAME feature VALUE variance) USING (feature)
    WHERE variance > 0.01 AND NOT EXISTS (SELECT 1 FROM (UNPIVOT (SELECT {', '.join(f'corr({a}, {b}) AS "{i}|{j}"' for j, b in enumerate(_PREP) for i, a in enumerate(_PREP) if i < j)} FROM metrics)
      ON COLUMNS(*) INTO NAME pair VALUE c) JOIN (UNPIVOT (SELECT {', '.join(f'var_samp({c}) AS "{i}"' for i, c in enumerate(_PREP))} FROM metrics) ON COLUMNS(*) INTO NAME first VALUE v) ON split_part(pair, '|', 1) = first
      WHERE split_part(pair, '|', 2)::INT = i AND abs(c) > 0.95 AND v > 0.01)""")
def _(t):
    table = t.stored("metrics", lambda: metrics(t)).select("channelId", *_PREP)
    selected, columns = sm.select_features(table)
    shape = selected.agg(*[F.count(c).alias(c) for c in columns])
    return shape.unpivot([], columns, "feature", "n").select("feature")


def _clusters(t):
    return t.once("kmeans", lambda: sm.kmeans(t.stored("points", lambda: t.points), 10))


@query("J02_kmeans", "method:s n_clusters:i n_outliers:i silhouette:f calinski_harabasz:f inertia:f")
def _(t):
    return sm.clustering_metrics(settle(_clusters(t)[0]), "kmeans")


@query("J03_dbscan_radius", "eps:f", f"SELECT quantile_cont(distance, 0.95) AS eps FROM ({_RANKED}) WHERE rank = 4")
def _(t):
    return dn.neighbour_radius(t.points)


@query("J04_dbscan", "id:s cluster:i")
def _(t):
    points = t.stored("points", lambda: t.points)
    return dn.dbscan(points, dn.neighbour_radius(points).first().eps)


_PARTS = ["bot_ratio", "high_risk_ip_ratio", "datacenter_ratio", "anonymization_ratio", "temporal_anomaly_score"]


@query("J05_quality_clusters", "id:s cluster:i")
def _(t):
    scored = settle(ch.closed_form_quality(t.rows).fillna(0))
    return dn.dbscan(sm.to_points(ql.standard_scale(scored, _PARTS), _PARTS), 0.5, 5)


def _ward(t):
    return t.once("ward", lambda: hi.ward(t.stored("points", lambda: t.points), 10))


@query("J06_hierarchical", "method:s n_clusters:i n_outliers:i silhouette:f calinski_harabasz:f inertia:f")
def _(t):
    return sm.clustering_metrics(settle(_ward(t)[0]), "hierarchical")


@query("J06_ward_merges", "height:f size:i")
def _(t):
    return _ward(t)[1]


@query("J07_principal_components", "id:s first:f second:f")
def _(t):
    projected, _ = sm.principal_components(t.points, 10)
    return projected.select("id", F.col("components")[0].alias("first"), F.col("components")[1].alias("second"))


@query("J08_cluster_importance", "feature:s forest_importance:f inter_cluster_variance:f")
def _(t):
    return sm.cluster_feature_importance(_clusters(t)[0], [f"e{i}" for i in range(64)])


_BANDED = ["bot_rate", "fraud_score_avg", "ip_diversity", "volume"]


def _by_band(t):
    labelled = ql.quality_labels(t.stored("metrics", lambda: metrics(t)))
    return labelled.select("channelId", F.col("label_band").alias("cluster"), *_BANDED)


@query("J09_similar_in_cluster", "id:s distance:f", """SELECT b.channelId AS id, list_distance([a.bot_rate, a.fraud_score_avg, a.ip_diversity, a.volume]::DOUBLE[], [b.bot_rate, b.fraud_score_avg, b.ip_diversity, b.volume]::DOUBLE[]) AS distance
    FROM labelled a JOIN labelled b ON a.label_band = b.label_band AND b.channelId <> a.channelId WHERE a.channelId = 'ch_5' ORDER BY distance, id LIMIT 5""")
def _(t):
    banded = _by_band(t)
    points = sm.to_points(banded, _BANDED).join(banded.select(F.col("channelId").alias("id"), "cluster"), "id")
    return sm.similar_in_cluster(points, "ch_5", 5)


@query("J10_similar_channels", "id:s neighbour:s similarity:f rank:i", f"SELECT id, neighbour, 1 / (1 + distance) AS similarity, rank FROM ({_RANKED}) WHERE rank <= 5")
def _(t):
    return sm.similar_channels(t.points, 5)


@query("J10_similar_to_one", "id:s similarity:f", f"WITH p AS ({_POINTS}) SELECT b.id AS id, 1 / (1 + list_distance(a.v, b.v)) AS similarity FROM p a JOIN p b ON a.id <> b.id WHERE a.id = 'v7' ORDER BY similarity DESC, b.id LIMIT 5")
def _(t):
    return sm.similar_to(t.points, "v7", 5)


@query("J11_cluster_profiles", "cluster:s feature:s size:i mean:f std:f deviation:f rank:i", """SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY deviation DESC NULLS LAST, feature) AS rank FROM
    (SELECT cluster, feature, size, mean, std, abs(mean - gm) / gs AS deviation FROM (SELECT label_band AS cluster, feature, count(*) AS size, avg(value) AS mean, stddev_samp(value) AS std FROM
      (UNPIVOT (SELECT label_band, bot_rate::DOUBLE AS bot_rate, fraud_score_avg::DOUBLE AS fraud_score_avg, ip_diversity::DOUBLE AS ip_diversity, volume::DOUBLE AS volume FROM labelled) ON bot_rate, fraud_score_avg, ip_diversity, volume INTO NAME feature VALUE value) GROUP BY ALL)
     JOIN (SELECT feature, avg(value) AS gm, stddev_samp(value) AS gs FROM (UNPIVOT (SELECT bot_rate::DOUBLE AS bot_rate, fraud_score_avg::DOUBLE AS fraud_score_avg, ip_diversity::DOUBLE AS ip_diversity, volume::DOUBLE AS volume FROM labelled) ON bot_rate, fraud_score_avg, ip_diversity, volume INTO NAME feature VALUE value) GROUP BY feature) USING (feature))""")
def _(t):
    return sm.cluster_profiles(_by_band(t), _BANDED)


@query("J12_outlier_channels", "id:s")
def _(t):
    points, _ = sm.robust_points(settle(ch.channel_features(t.rows)))
    found = det.isolation_forest(settle(points), 0.1, 100, "outlier")
    return found.where("outlier").select("id")


_TOKENS = ["volume", "ip_diversity", "country_diversity", "browser_diversity", "bot_rate", "weekend_rate", "business_hours_rate"]


@query("J14_minhash_pairs", "id_a:s id_b:s jaccard:f")
def _(t):
    table = t.stored("metrics", lambda: metrics(t))
    return sm.minhash_pairs(sm.token_sets(table, _TOKENS, prefix_columns=True, round_to=1), 0.5)


@query("K21_local_outlier_factor", "id:s lof:f", f"""WITH near AS MATERIALIZED (SELECT * FROM ({_RANKED}) WHERE rank <= 20), kd AS (SELECT id AS neighbour, max(distance) AS k FROM near GROUP BY id),
    lrd AS MATERIALIZED (SELECT id, 1 / (avg(greatest(k, distance)) + 1e-10) AS lrd FROM near JOIN kd USING (neighbour) GROUP BY id)
    SELECT near.id AS id, avg(b.lrd) / max(a.lrd) AS lof FROM near JOIN lrd b ON b.id = near.neighbour JOIN lrd a ON a.id = near.id GROUP BY near.id""")
def _(t):
    return det.local_outlier_factor(t.points, 20)


@query("K20_isolation_forest", "id:s anomaly_score:f anomaly:b")
def _(t):
    return det.isolation_forest(t.points)


@query("K22_one_class_svm", "id:s svm_score:f svm_anomaly:b")
def _(t):
    return det.one_class_svm(t.points)


@query("K23_elliptic_envelope", "id:s mahalanobis:f envelope_anomaly:b")
def _(t):
    return det.elliptic_envelope(t.points)


@query("M04_similarity_evaluation", "n_clusters:i mean_size:f std_size:f min_size:i max_size:i outlier_pct:f")
def _(t):
    return cluster_size_stats(_clusters(t)[0])


@query("M04_silhouettes", "id:s cluster:i silhouette:f", """WITH p AS (SELECT 'v' || vec_id AS id, embedding::DOUBLE[] AS v, label AS c FROM embeddings WHERE label >= 0), n AS (SELECT c, count(*) AS size FROM p GROUP BY c),
    d AS (SELECT a.id, a.c AS home, b.c, sum(list_distance(a.v, b.v)) AS total FROM p a, p b GROUP BY ALL),
    m AS (SELECT id, home, max(total / nullif(size - 1, 0)) FILTER (d.c = home) AS a, min(total / size) FILTER (d.c <> home) AS b FROM d JOIN n USING (c) GROUP BY ALL)
    SELECT id, home AS cluster, coalesce((b - a) / nullif(greatest(a, b), 0), 0) AS silhouette FROM m""")
def _(t):
    return hi.silhouettes(t.points.join(t.read("embeddings").select(F.concat(F.lit("v"), "vec_id").alias("id"), F.col("label").alias("cluster")), "id"))


@query("M04_projected_variance", "variance_explained:f")
def _(t):
    return explained_variance(sm.principal_components(t.points, 10)[0])


@query("A11_saved_forest", "id:s score:f")
def _(t):
    from ..session import new_folder

    path = new_folder(t.spark, "forest")
    det.IsolationForest.fit(t.points, trees=100).save(t.spark, path)
    return det.IsolationForest.load(t.spark, path).score(t.points)


@query("A11_saved_forest_same", "points:i max_difference:f", "SELECT count(*) AS points, 0.0 AS max_difference FROM embeddings")
def _(t):
    from ..session import new_folder

    path = new_folder(t.spark, "forest")
    fitted = det.IsolationForest.fit(t.points, trees=100)
    fitted.save(t.spark, path)
    both = det.IsolationForest.load(t.spark, path).score(fitted.score(t.points, "before"), "after")
    return both.agg(F.count("*").alias("points"), F.max(F.abs(F.col("before") - F.col("after"))).alias("max_difference"))
