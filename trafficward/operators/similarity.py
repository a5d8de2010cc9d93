"""Similar channels: feature selection, clusterings, embeddings, cosine and token similarity."""

from __future__ import annotations

import math
from functools import partial

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.common import correlation
from ..schema import numeric_columns
from ..session import side_by_side
from .hierarchy import mean_silhouette
from .neighbours import collapse, nearest_neighbours, pairs_within
from .quality import robust_scale, standard_scale
from .ranks import quantile_struct


def to_points(df: DataFrame, columns: list[str], key: str = "channelId") -> DataFrame:
    """(id, vec) from numeric columns."""
    return df.select(
        F.col(key).cast("string").alias("id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("vec")
    )


def select_features(df: DataFrame, key: str = "channelId", variance: float = 0.01, max_correlation: float = 0.95) -> tuple[DataFrame, list[str]]:
    """Median-filled numeric features that vary and are not near copies of an earlier one.

    Columns with variance above the limit stay (all of them if none does); the later column
    of every pair with |correlation| above the limit goes (the first stays if all would go).
    Returns an empty list for tables without usable columns or with fewer than two rows.
    """
    columns = numeric_columns(df, skip=(key,))
    if not columns:
        return df.select(key), []
    medians = quantile_struct(df, columns, [0.5])
    filled = (
        df.withColumn("_q", medians)
        .select(key, *[F.coalesce(F.col(c).cast("double"), F.col("_q")[c][0]).alias(c) for c in columns])
    )
    spread = filled.agg(F.count("*").alias("_n"), *[F.var_samp(c).alias(c) for c in columns]).first()
    if spread["_n"] < 2:
        return filled, []
    kept = [c for c in columns if (spread[c] or 0.0) > variance] or columns
    if len(kept) > 1:
        vectors = VectorAssembler(inputCols=kept, outputCol="_v").transform(filled).select("_v")
        matrix = abs(Correlation.corr(vectors, "_v").first()[0].toArray())
        independent = [c for j, c in enumerate(kept) if not any(matrix[i, j] > max_correlation for i in range(j))]
        kept = independent or kept[:1]
    return filled.select(key, *kept), kept


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long (column_a, column_b, corr) for every ordered pair a before b, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[correlation(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs])
    split = F.split("pair", r"\|")
    return row.unpivot([], row.columns, "pair", "corr").select(
        split[0].alias("column_a"), split[1].alias("column_b"), "corr"
    )


def _vectors(points: DataFrame) -> DataFrame:
    return points.select("id", "vec", array_to_vector("vec").alias("features"))


def kmeans(points: DataFrame, k: int = 10, tries: int = 10, seed: int = 42) -> tuple[DataFrame, object]:
    """(id, vec, cluster) of the cheapest of several seeded K-means fits, and its model."""
    data = _vectors(points).persist()
    try:
        fit = lambda i: KMeans(k=k, seed=seed + i, initSteps=2).fit(data)
        data.count()  # cached before the tries, which run side by side
        fits = side_by_side(points.sparkSession, [partial(fit, i) for i in range(tries)])
        best = min(fits, key=lambda m: m.summary.trainingCost)
        labelled = best.transform(data).select("id", "vec", F.col("prediction").alias("cluster"))
        return labelled, best
    finally:
        data.unpersist()


def bisecting(points: DataFrame, k: int = 10, seed: int = 42) -> tuple[DataFrame, object]:
    """Hierarchical clustering by repeated two-way splits under the variance criterion."""
    data = _vectors(points)
    model = BisectingKMeans(k=k, seed=seed).fit(data)
    return model.transform(data).select("id", "vec", F.col("prediction").alias("cluster")), model


def within_sum(labelled: DataFrame) -> DataFrame:
    """One row: points, clusters, within-cluster and total squared deviation."""
    long = labelled.select("cluster", F.posexplode("vec").alias("axis", "x"))
    per = long.groupBy("cluster", "axis").agg(F.count("*").alias("n"), F.var_pop("x").alias("v"))
    inside = per.agg(F.sum(F.col("n") * F.col("v")).alias("inside"), F.count_distinct("cluster").alias("k"))
    whole = long.groupBy("axis").agg(F.count("*").alias("n"), F.var_pop("x").alias("v"))
    outside = whole.agg(F.struct(F.max("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("t"))).scalar()
    return inside.withColumn("_t", outside).select(
        F.col("_t.n").alias("n"), "k", "inside", F.col("_t.t").alias("total")
    )


def clustering_metrics(labelled: DataFrame, name: str) -> DataFrame:
    """(method, n_clusters, n_outliers, silhouette, calinski_harabasz, inertia); noise excluded.

    The silhouette is exact, with plain Euclidean distances (see `hierarchy.silhouettes`).
    """
    kept = labelled.where(F.col("cluster") >= 0)
    sums = within_sum(kept)
    noise = labelled.agg(F.count_if(F.col("cluster") < 0)).scalar()
    shape = mean_silhouette(kept)
    between = (F.col("total") - F.col("inside")) / (F.col("k") - 1)
    return sums.select(
        F.lit(name).alias("method"),
        F.col("k").cast("bigint").alias("n_clusters"),
        noise.alias("n_outliers"),
        F.lit(shape).alias("silhouette"),
        F.when(F.col("k") > 1, F.try_divide(between, F.col("inside") / (F.col("n") - F.col("k")))).alias("calinski_harabasz"),
        F.col("inside").alias("inertia"),
    )


def principal_components(points: DataFrame, k: int = 10) -> tuple[DataFrame, list[float]]:
    """(id, components) on at most k axes and the variance share of each axis."""
    head = points.select(F.size("vec")).first()
    if head is None:
        return points.select("id", F.array().cast("array<double>").alias("components")), []
    width = head[0]
    model = PCA(k=min(k, width), inputCol="features", outputCol="_pca").fit(_vectors(points))
    projected = model.transform(_vectors(points)).select("id", vector_to_array("_pca").alias("components"))
    return projected, [float(v) for v in model.explainedVariance]


def cluster_feature_importance(labelled: DataFrame, columns: list[str], trees: int = 100) -> DataFrame:
    """(feature, forest_importance, inter_cluster_variance) of the features that shape the clusters."""
    spark = labelled.sparkSession
    data = labelled.select(array_to_vector("vec").alias("features"), F.col("cluster").cast("double").alias("label"))
    forest = RandomForestClassifier(numTrees=trees, seed=42).fit(data)
    forest_rows = [(c, float(forest.featureImportances[i])) for i, c in enumerate(columns)]
    importance = spark.createDataFrame(forest_rows, "feature string, forest_importance double")
    return importance.join(inter_cluster_variance(labelled, columns), "feature")


def inter_cluster_variance(labelled: DataFrame, columns: list[str]) -> DataFrame:
    """Population variance of the cluster means, per feature."""
    means = labelled.select("cluster", F.posexplode("vec").alias("axis", "x")).groupBy("cluster", "axis").agg(
        F.avg("x").alias("m")
    )
    names = F.array(*[F.lit(c) for c in columns])
    return means.groupBy("axis").agg(F.var_pop("m").alias("inter_cluster_variance")).select(
        F.get(names, F.col("axis")).alias("feature"), "inter_cluster_variance"
    )


def _gap(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def similar_in_cluster(labelled: DataFrame, target: str, n: int = 5) -> DataFrame:
    """(id, distance): the nearest members of the target's own cluster."""
    chosen = labelled.where(F.col("id") == target).agg(
        F.struct(F.first("vec").alias("vec"), F.first("cluster").alias("cluster"))
    ).scalar()
    return (
        labelled.withColumn("_t", chosen)
        .where((F.col("cluster") == F.col("_t.cluster")) & (F.col("id") != target))
        .select("id", _gap(F.col("vec"), F.col("_t.vec")).alias("distance"))
        .orderBy("distance", "id")
        .limit(n)
    )


def similar_channels(points: DataFrame, n: int = 5) -> DataFrame:
    """(id, neighbour, similarity = 1/(1+distance), rank) for every channel."""
    near = nearest_neighbours(points, n)
    return near.select("id", "neighbour", (1.0 / (1.0 + F.col("distance"))).alias("similarity"), "rank")


def similar_to(points: DataFrame, target: str, n: int = 5) -> DataFrame:
    """The n channels most similar to one channel: a single pass, no join."""
    vec = points.where(F.col("id") == target).agg(F.first("vec")).scalar()
    return (
        points.where(F.col("id") != target)
        .withColumn("_t", vec)
        .select("id", (1.0 / (1.0 + _gap(F.col("vec"), F.col("_t")))).alias("similarity"))
        .orderBy(F.desc("similarity"), "id")
        .limit(n)
    )


def cluster_profiles(labelled: DataFrame, columns: list[str], key: str = "channelId", top: int = 5) -> DataFrame:
    """Per cluster and feature: size, mean, deviation, standardised difference and its rank.

    `labelled` has the key, the features and `cluster`; members stay in that table.
    """
    long = labelled.select("cluster", *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        ["cluster"], columns, "feature", "value"
    )
    whole = long.groupBy("feature").agg(F.avg("value").alias("_mean"), F.stddev_samp("value").alias("_std"))
    parts = long.groupBy("cluster", "feature").agg(
        F.count("*").alias("size"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")
    )
    apart = parts.join(whole, "feature").withColumn(
        "deviation", F.try_divide(F.abs(F.col("mean") - F.col("_mean")), F.col("_std"))
    )
    order = Window.partitionBy("cluster").orderBy(F.desc_nulls_last("deviation"), "feature")
    ranked = apart.withColumn("rank", F.row_number().over(order))
    return ranked.select(
        "cluster", "feature", "size", "mean", "std", "deviation", "rank", (F.col("rank") <= top).alias("distinguishing")
    )


def unit_vectors(points: DataFrame) -> DataFrame:
    """Vectors of length 1; zero vectors have no direction and are left out."""
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    return (
        points.withColumn("_norm", norm)
        .where(F.col("_norm") > 0)
        .select("id", F.transform("vec", lambda x: x / F.col("_norm")).alias("vec"))
    )


def cosine_pairs(points: DataFrame, threshold: float, cell_size: int = 1024) -> DataFrame:
    """(id_a, id_b, similarity, copies_a, copies_b): every two ids with cosine at or above the threshold, copies too.

    On unit vectors cosine ≥ t is the same as distance ≤ sqrt(2 − 2t), so the exact radius
    join applies and no all-pairs product is formed.
    """
    radius = math.sqrt(max(0.0, 2.0 - 2.0 * threshold)) + 1e-9
    near = pairs_within(unit_vectors(points), radius, cell_size)
    similarity = 1.0 - F.col("distance") * F.col("distance") / 2.0
    return near.select("id_a", "id_b", similarity.alias("similarity"), "copies_a", "copies_b").where(
        F.col("similarity") >= threshold - 1e-12
    )


def most_similar(points: DataFrame, k: int = 10) -> DataFrame:
    """(id, neighbour, similarity, rank): the k highest cosines of every channel."""
    near = nearest_neighbours(unit_vectors(points), k)
    return near.select(
        "id", "neighbour", (1.0 - F.col("distance") * F.col("distance") / 2.0).alias("similarity"), "rank"
    )


def mean_similarity(points: DataFrame) -> DataFrame:
    """Mean of the full cosine matrix (diagonal included) from one vector sum: |Σu|² / n²."""
    long = unit_vectors(points).select(F.posexplode("vec").alias("axis", "x"))
    sums = long.groupBy("axis").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    return sums.agg(
        (F.sum(F.col("s") * F.col("s")) / (F.max("n") * F.max("n"))).alias("mean_similarity"),
        F.max("n").alias("channels"),
    )


def scaled_profiles(profiles: DataFrame, key: str = "channelId") -> DataFrame:
    """Standardised channel profiles as points."""
    columns = numeric_columns(profiles, skip=(key,))
    return to_points(standard_scale(profiles, columns), columns, key)


def robust_points(df: DataFrame, key: str = "channelId") -> tuple[DataFrame, list[str]]:
    """Selected, robustly scaled features as points."""
    selected, columns = select_features(df, key)
    if not columns:
        return df.select(F.col(key).cast("string").alias("id"), F.array().cast("array<double>").alias("vec")).limit(0), []
    return to_points(robust_scale(selected, columns), columns, key), columns


def token_sets(df: DataFrame, columns: list[str], key: str = "channelId", prefix_columns: bool = False, round_to: int | None = None) -> DataFrame:
    """(id, tokens): the distinct feature values of a channel as text.

    Bare values by default, as the similarity sketch uses them; `prefix_columns` keeps equal
    values of different columns apart, `round_to` lets near-equal numbers meet.
    """
    def token(c: str) -> Column:
        value = F.round(F.col(c).cast("double"), round_to) if round_to is not None else F.col(c)
        text = F.coalesce(value.cast("string"), F.lit("nan"))
        return F.concat(F.lit(f"{c}="), text) if prefix_columns else text

    return df.select(
        F.col(key).cast("string").alias("id"), F.array_sort(F.array_distinct(F.array(*[token(c) for c in columns]))).alias("tokens")
    )


def minhash_pairs(sets: DataFrame, threshold: float = 0.5, bands: int = 32, rows: int = 4) -> DataFrame:
    """(id_a, id_b, jaccard, copies_a, copies_b) from a 128-hash MinHash sketch with banding.

    Equal token sets are collapsed first, so a group of copies meets nothing but itself once.
    Candidates share a whole band; each is verified, so every reported pair is right. A pair
    with Jaccard s is found with probability 1 − (1 − s^rows)^bands (87 % at 0.5).
    """
    points = sets.withColumnRenamed("tokens", "vec")
    distinct, _ = collapse(points)
    distinct = distinct.select(F.col("rep").alias("id"), F.col("vec").alias("tokens"), F.col("weight").alias("copies"))
    slot = lambda i: F.array_min(F.transform("tokens", lambda t: F.xxhash64(t, F.lit(i))))
    band = lambda b: F.xxhash64(*[slot(b * rows + r) for r in range(rows)])
    keyed = distinct.select("id", F.posexplode(F.array(*[band(b) for b in range(bands)])).alias("band", "key"))
    left = keyed.select(F.col("id").alias("id_a"), "band", "key")
    right = keyed.select(F.col("id").alias("id_b"), "band", "key")
    candidates = left.join(right, ["band", "key"]).where("id_a < id_b").select("id_a", "id_b").distinct()
    side = lambda s: distinct.select(
        F.col("id").alias(f"id_{s}"), F.col("tokens").alias(f"tokens_{s}"), F.col("copies").alias(f"copies_{s}")
    )
    shared = F.size(F.array_intersect("tokens_a", "tokens_b"))
    jaccard = shared / (F.size("tokens_a") + F.size("tokens_b") - shared)
    return (
        candidates.join(side("a"), "id_a")
        .join(side("b"), "id_b")
        .withColumn("jaccard", jaccard)
        .where(F.col("jaccard") >= threshold)
        .select("id_a", "id_b", "jaccard", "copies_a", "copies_b")
    )
