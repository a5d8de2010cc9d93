"""Outlier detectors over (id, vec) tables; every fit is a set of Spark jobs over the rows.

Only models of fixed size come to the driver: tree arrays, a weight vector, a mean and a
covariance matrix.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .neighbours import nearest_neighbours
from .ranks import quantile


def flag_lowest(df: DataFrame, score: str, share: float, name: str) -> DataFrame:
    """Flag the rows whose score lies below the `share` quantile."""
    return df.withColumn(name, F.col(score) < quantile(df, score, share))


def _average_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a random binary tree of n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _grow(points: np.ndarray, rng: np.random.Generator) -> dict:
    """One isolation tree as flat arrays; leaves hold the depth corrected by their size."""
    limit = int(math.ceil(math.log2(max(len(points), 2))))
    feature, cut, left, right, path = [], [], [], [], []

    def add(rows: np.ndarray, depth: int) -> int:
        at = len(feature)
        for column, value in zip((feature, cut, left, right, path), (-1, 0.0, -1, -1, 0.0)):
            column.append(value)
        span = np.ptp(rows, axis=0) if len(rows) else np.zeros(points.shape[1])
        usable = np.flatnonzero(span > 0)
        if depth >= limit or len(rows) <= 1 or len(usable) == 0:
            path[at] = depth + _average_path(len(rows))
            return at
        f = int(rng.choice(usable))
        c = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
        feature[at], cut[at] = f, c
        goes_left = rows[:, f] <= c
        left[at] = add(rows[goes_left], depth + 1)
        right[at] = add(rows[~goes_left], depth + 1)
        return at

    add(points, 0)
    return {"feature": feature, "cut": cut, "left": left, "right": right, "path": path}


@dataclass
class IsolationForest:
    """Trees on hashed samples of at most 256 rows; scores in (0,1], higher is more unusual."""

    trees: list[dict]
    sample: int

    @staticmethod
    def fit(df: DataFrame, trees: int = 100, sample: int = 256, seed: int = 42) -> "IsolationForest":
        """Each tree draws its rows by its own hash over all rows, and grows in its own task.

        A tree's threshold lets about 1.5 samples pass, of which the `sample` lowest hashes stay,
        so a task holds a few hundred rows whatever the table's size. No rows, no trees.
        """
        size = df.count()
        psi = min(sample, size)
        share = min(1.0, 1.5 * sample / max(size, 1) + 10.0 * math.sqrt(sample) / max(size, 1))
        rows = df.select(F.col("id").cast("string").alias("id"), "vec")
        mark = lambda t: F.pmod(F.xxhash64(t, F.col("id"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
        turn = Window.partitionBy("tree").orderBy(F.xxhash64("tree", "id", F.lit(seed)), "id")
        chosen = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: mark(t) < share)
        drawn = (
            rows.withColumn("tree", F.explode(chosen)).withColumn("_turn", F.row_number().over(turn)).where(F.col("_turn") <= psi)
        )

        def build(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("id")
            tree = int(rows.tree.iloc[0])
            grown = _grow(np.stack(rows.vec.to_numpy()).astype(float), np.random.default_rng([seed, tree]))
            return pd.DataFrame([{"tree": tree, **grown}])

        schema = (
            "tree int, feature array<int>, cut array<double>, left array<int>, "
            "right array<int>, path array<double>"
        )
        # at most 2·256 nodes per tree
        grown = drawn.groupBy("tree").applyInPandas(build, schema).orderBy("tree").collect()
        return IsolationForest([r.asDict() for r in grown], psi)

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """Adds 2^(−mean path / expected path)."""
        forest = [
            tuple(np.array(t[k]) for k in ("feature", "cut", "left", "right", "path")) for t in self.trees
        ]
        norm = _average_path(self.sample) or 1.0

        @F.pandas_udf("double")
        def isolate(vec: pd.Series) -> pd.Series:
            x = np.stack(vec.to_numpy()).astype(float)
            depth = np.zeros(len(x))
            every = np.arange(len(x))
            for feature, cut, left, right, path in forest:
                at = np.zeros(len(x), dtype=int)
                while True:
                    inner = feature[at] >= 0
                    if not inner.any():
                        break
                    rows = every[inner]
                    node = at[inner]
                    lower = x[rows, feature[node]] <= cut[node]
                    at[inner] = np.where(lower, left[node], right[node])
                depth += path[at]
            return pd.Series(np.power(2.0, -depth / len(forest) / norm))

        return df.withColumn(name, isolate("vec"))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [
            (t["tree"], self.sample, t["feature"], t["cut"], t["left"], t["right"], t["path"]) for t in self.trees
        ]
        spark.createDataFrame(
            rows,
            "tree int, sample int, feature array<int>, cut array<double>, left array<int>, "
            "right array<int>, path array<double>",
        ).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "IsolationForest":
        rows = [r.asDict() for r in spark.read.parquet(path).orderBy("tree").collect()]
        return IsolationForest(rows, rows[0]["sample"])


def isolation_forest(
    df: DataFrame, contamination: float = 0.1, trees: int = 100, name: str = "anomaly", seed: int = 42
) -> DataFrame:
    """(id, vec, <name>_score, <name>): decision score below 0 marks the unusual share."""
    scored = IsolationForest.fit(df, trees, seed=seed).score(df, "_raw")
    scored = scored.withColumn("_raw", -F.col("_raw"))
    offset = quantile(scored, "_raw", contamination)
    return (
        scored.withColumn(f"{name}_score", F.col("_raw") - offset)
        .withColumn(name, F.col(f"{name}_score") < 0)
        .drop("_raw")
    )


def local_outlier_factor(df: DataFrame, k: int = 20, contamination: float = 0.1, cell_size: int = 1024) -> DataFrame:
    """(id, lof, lof_anomaly): neighbour density over own density; the highest share is flagged."""
    size = df.count()
    if size < 2:
        return df.select(F.col("id").cast("string").alias("id"), F.lit(1.0).alias("lof"), F.lit(False).alias("lof_anomaly"))
    links = nearest_neighbours(df, min(k, size - 1), cell_size)
    reach_of = links.groupBy(F.col("id").alias("neighbour")).agg(F.max("distance").alias("k_distance"))
    reach = links.join(reach_of, "neighbour").withColumn("reach", F.greatest("k_distance", "distance"))
    density = reach.groupBy("id").agg((1.0 / (F.avg("reach") + F.lit(1e-10))).alias("lrd"))
    around = density.select(F.col("id").alias("neighbour"), F.col("lrd").alias("neighbour_lrd"))
    factor = (
        links.join(around, "neighbour")
        .groupBy("id")
        .agg(F.avg("neighbour_lrd").alias("_around"))
        .join(density, "id")
        .select("id", (F.col("_around") / F.col("lrd")).alias("lof"))
    )
    return factor.withColumn("_neg", -F.col("lof")).transform(
        lambda d: flag_lowest(d, "_neg", contamination, "lof_anomaly")
    ).drop("_neg")


def _sum_arrays(df: DataFrame, make, width: int) -> np.ndarray:
    """Sum of `make(matrix of vec)` (a flat array) over all rows: partial per batch, then per position."""

    def partial(batches):
        acc = np.zeros(width)
        for batch in batches:
            if len(batch):
                acc += make(np.stack(batch.vec.to_numpy()).astype(float))
        yield pd.DataFrame({"s": [acc]})

    sums = (
        df.select("vec")
        .mapInPandas(partial, "s array<double>")
        .select(F.posexplode("s"))
        .groupBy("pos")
        .agg(F.sum("col").alias("s"))
        .collect()  # one row per array position
    )
    out = np.zeros(width)
    for row in sums:
        out[row.pos] = row.s
    return out


def one_class_svm(
    df: DataFrame, nu: float = 0.1, features: int = 256, rounds: int = 20, seed: int = 42
) -> DataFrame:
    """(id, svm_score, svm_anomaly): one-class machine with an approximated RBF kernel.

    The kernel (gamma = 1 / (d · variance)) is replaced by random Fourier features of fixed
    seed. The dual is solved by conditional gradient steps: the best vertex is the mean feature
    of the nu share of rows with the lowest score, which one distributed sum yields per round.
    An approximation of the exact machine: ranks agree, values do not.
    """
    df = df.select(F.col("id").cast("string").alias("id"), "vec").persist()
    try:
        moments = df.agg(
            F.first(F.size("vec")).alias("d"),
            F.count("*").alias("n"),
            F.sum(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)).alias("s"),
            F.sum(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("q"),
        ).first()
        if not moments.n:
            return df.select("id", F.lit(None).cast("double").alias("svm_score"), F.lit(False).alias("svm_anomaly")).limit(0)
        d, cells = moments.d, moments.d * moments.n
        variance = moments.q / cells - (moments.s / cells) ** 2
        gamma = 1.0 / (d * variance) if variance > 0 else 1.0
        rng = np.random.default_rng(seed)
        omega = rng.normal(scale=math.sqrt(2.0 * gamma), size=(d, features))
        phase = rng.uniform(0, 2 * math.pi, size=features)
        lift = lambda x: math.sqrt(2.0 / features) * np.cos(x @ omega + phase)

        def scorer(weights: np.ndarray) -> Column:
            @F.pandas_udf("double")
            def margin(vec: pd.Series) -> pd.Series:
                return pd.Series(lift(np.stack(vec.to_numpy()).astype(float)) @ weights)

            return margin("vec")

        total = lambda rows: _sum_arrays(rows, lambda x: np.append(lift(x).sum(axis=0), len(x)), features + 1)
        first = total(df)
        weights = first[:-1] / first[-1]
        for t in range(rounds):
            scored = df.withColumn("_score", scorer(weights))
            cut = scored.agg(F.percentile_approx("_score", nu, 10000)).first()[0]
            vertex = total(scored.where(F.col("_score") <= cut))
            step = 2.0 / (t + 3.0)
            weights = (1 - step) * weights + step * vertex[:-1] / vertex[-1]
        scored = df.select("id", scorer(weights).alias("svm_score"))
        # cut the tie with the cached input before it is released
        from ..session import settle

        return flag_lowest(settle(scored), "svm_score", nu, "svm_anomaly")
    finally:
        df.unpersist()


def chi2_cdf(x: float, d: int) -> float:
    """Chi-square distribution function: the lower incomplete gamma function by series or continued fraction."""
    a, x = d / 2, x / 2
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return front * total
    b, c = x + 1 - a, 1e300
    h = f = 1 / b
    for i in range(1, 10_000):
        b += 2
        f = 1 / (b - i * (i - a) * f)
        c = b - i * (i - a) / c
        h *= f * c
        if abs(f * c - 1) < 1e-16:
            break
    return 1.0 - front * h


def chi2_quantile(p: float, d: int) -> float:
    """The value that a chi-square variable stays below with probability `p`, by halving."""
    low, high = 0.0, float(d)
    while chi2_cdf(high, d) < p:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, d) < p else (low, middle)
    return (low + high) / 2


@dataclass
class RobustCovariance:
    """Location and covariance of the bulk of the rows, and the log determinant of the raw fit."""

    mean: np.ndarray
    cov: np.ndarray
    raw_log_det: float

    @property
    def inverse(self) -> np.ndarray:
        return np.linalg.pinv(self.cov, hermitian=True)


def _squared_distance(x: np.ndarray, mean: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    away = x - mean
    return np.einsum("ij,jk,ik->i", away, inverse, away)


def robust_covariance(df: DataFrame, rounds: int = 30, starts: int = 12, finalists: int = 3, seed: int = 1) -> RobustCovariance | None:
    """Minimum covariance determinant: the half of the rows whose covariance is smallest, then reweighted.

    The search starts at the coordinate-wise median and at `starts` small subsets (dimensions + 1 rows
    each, by a hash of the id: the only rows that reach the driver). A concentration takes, for
    every start at once, the half of the rows nearest to its mean in its own metric: one pass finds
    the radii, one sums moments. After two of them the `finalists` of the smallest determinant go
    on until nothing changes. The winner's covariance is scaled so that the median distance is
    that of a normal sample, and mean and covariance are taken again over all rows within the
    97.5 % ellipse. The result does not depend on the order of the rows, rounding aside. None
    without rows.
    """
    n = df.count()
    if not n:
        return None
    d = df.select(F.size("vec")).first()[0]
    half = min(n, (n + d + 1) // 2)
    fine = 1_000_000
    middle = lambda c: F.percentile_approx(c, 0.5, fine)
    centre = np.array(df.agg(F.array(*[middle(F.col("vec")[i]) for i in range(d)])).first()[0], float)
    spread = np.array(df.agg(F.array(*[middle(F.abs(F.col("vec")[i] - F.lit(float(centre[i])))) for i in range(d)])).first()[0], float)
    spread = np.where(spread > 0, spread, 1.0)
    units = lambda x: (x - centre) / spread

    def radii(fits: list[tuple[np.ndarray, np.ndarray]], share: float) -> list[float]:
        @F.pandas_udf("array<double>")
        def away(vec: pd.Series) -> pd.Series:
            x = units(np.stack(vec.to_numpy()).astype(float))
            return pd.Series(list(np.stack([_squared_distance(x, m, i) for m, i in fits], axis=1)))

        scored = df.select(away("vec").alias("d"))
        return list(scored.agg(F.array(*[F.percentile_approx(F.col("d")[s], share, fine) for s in range(len(fits))])).first()[0])

    def within(fits: list[tuple[np.ndarray, np.ndarray]], cuts: list[float]) -> list[tuple[np.ndarray, np.ndarray]]:
        def flat(x: np.ndarray) -> np.ndarray:
            x, out = units(x), []
            for (m, i), cut in zip(fits, cuts):
                near = x[_squared_distance(x, m, i) <= cut * (1 + 1e-12)]
                out.append(np.concatenate([[len(near)], near.sum(axis=0), (near.T @ near).ravel()]))
            return np.concatenate(out)

        sums = _sum_arrays(df, flat, len(fits) * (1 + d + d * d)).reshape(len(fits), -1)
        found = []
        for row in sums:
            mean = row[1 : 1 + d] / row[0]
            found.append((mean, row[1 + d :].reshape(d, d) / row[0] - np.outer(mean, mean)))
        return found

    def log_det(cov: np.ndarray) -> float:
        sign, value = np.linalg.slogdet(cov)
        return value if sign > 0 else -np.inf

    metric = lambda fit: (fit[0], np.linalg.pinv(fit[1], hermitian=True))
    size = d + 1
    name = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
    drawn = units(np.array([r.vec for r in df.orderBy(name, "id", "vec").limit(starts * size).collect()], float))
    groups = [drawn[i : i + size] for i in range(0, len(drawn) - size + 1, size)] or [drawn]
    fits = [(np.zeros(d), np.eye(d))] + [metric((g.mean(axis=0), np.cov(g.T, bias=True).reshape(d, d))) for g in groups]
    # a subset spans few directions: along the others distance is taken as it is
    fits = [(m, i if np.linalg.matrix_rank(i) == d else i + np.eye(d)) for m, i in fits]
    found, last = [], None
    for turn in range(rounds):
        cuts = radii(fits, half / n)
        found = within(fits, cuts)
        if turn == 1 and len(found) > finalists:
            found = sorted(found, key=lambda f: log_det(f[1]))[:finalists]
        fits = [metric(f) for f in found]
        dets = [log_det(f[1]) for f in found]
        if turn > 1 and last is not None and np.allclose(dets, last, rtol=0, atol=1e-9):
            break
        last = dets if turn >= 1 else None
    best = min(range(len(found)), key=lambda s: log_det(found[s][1]))
    raw = log_det(found[best][1])
    scale = radii([fits[best]], 0.5)[0] / chi2_quantile(0.5, d) or 1.0
    mean, cov = within([fits[best]], [chi2_quantile(0.975, d) * scale])[0]
    return RobustCovariance(centre + spread * mean, cov * np.outer(spread, spread), raw + 2 * float(np.log(spread).sum()))


def elliptic_envelope(df: DataFrame, contamination: float = 0.1, rounds: int = 30) -> DataFrame:
    """(id, mahalanobis, envelope_anomaly): distance in the metric of `robust_covariance`, the farthest rows flagged."""
    from ..session import settle

    df = settle(df.select(F.col("id").cast("string").alias("id"), "vec"))
    fit = robust_covariance(df, rounds)
    if fit is None:
        return df.select("id", F.lit(None).cast("double").alias("mahalanobis"), F.lit(False).alias("envelope_anomaly"))
    mean, inverse = fit.mean, fit.inverse

    @F.pandas_udf("double")
    def away(vec: pd.Series) -> pd.Series:
        return pd.Series(np.sqrt(np.maximum(_squared_distance(np.stack(vec.to_numpy()).astype(float), mean, inverse), 0.0)))

    scored = settle(df.select("id", away("vec").alias("mahalanobis")))
    return flag_lowest(scored.withColumn("_neg", -F.col("mahalanobis")), "_neg", contamination, "envelope_anomaly").drop("_neg")
