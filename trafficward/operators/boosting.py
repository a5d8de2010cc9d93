"""Second-order boosted trees: gradient and hessian histograms, one pass over the rows per level.

Rows are coded once into bins. A pass sends every row down the unfinished tree and adds its
gradient and hessian to its (node, feature, bin); tasks hand on these sums alone, whose size is
fixed by depth, features and bins. The split of a level and, after the last one, the leaf
weights follow from the sums, so a tree costs `depth` jobs and no more.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import parts_for, written

_MIX = 0x9E3779B97F4A7C15


def _squared(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return margin - y, np.ones(len(y))


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1.0 / (1.0 + np.exp(-margin))
    return p - y, p * (1.0 - p)


LOSSES = {"squared": _squared, "logistic": _logistic}


@dataclass
class Tree:
    """A full binary tree in heap order: node i has the children 2i+1 and 2i+2; a leaf has feature −1.

    Rows with bin ≤ `cut` go left; bin 0 is a missing value and goes where `missing_left` says.
    """

    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(depth: int) -> "Tree":
        n = 2 ** (depth + 1) - 1
        return Tree(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n, bool), np.zeros(n))

    def place(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node each row of bins reaches after at most `levels` steps."""
        node = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        for _ in range(levels):
            f = self.feature[node]
            b = bins[rows, np.maximum(f, 0)]
            left = np.where(b == 0, self.missing_left[node], b <= self.cut[node])
            node = np.where(f >= 0, 2 * node + 2 - left, node)
        return node


@dataclass
class BoostedTrees:
    """A fitted model; `edges` are the upper bounds of the bins of each feature."""

    features_column: str
    prediction_column: str
    base: float
    edges: list[np.ndarray]
    trees: list[Tree]
    depth: int
    gains: np.ndarray
    jobs: int = 0

    @property
    def featureImportances(self) -> np.ndarray:  # noqa: N802 — as the other tree models name it
        total = self.gains.sum()
        return self.gains / total if total else self.gains

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.base + _grown(self.trees, _bins(x, self.edges), self.depth)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds the prediction (the margin) of each row; NaN features count as missing, null ones give null."""

        @F.pandas_udf("double")
        def predict(vec: pd.Series) -> pd.Series:
            out = np.full(len(vec), np.nan)
            there = vec.notna().to_numpy()
            if there.any():
                out[there] = self.margins(np.stack(vec[there].to_numpy()).astype(float))
            return pd.Series(out).where(there, None)

        return df.withColumn(self.prediction_column, predict(_as_array(df, self.features_column)))

    def save(self, spark: SparkSession, path: str) -> None:
        trees = [[t.feature.tolist(), t.cut.tolist(), t.missing_left.tolist(), t.value.tolist()] for t in self.trees]
        head = [self.features_column, self.prediction_column, self.base, [e.tolist() for e in self.edges], self.depth, self.gains.tolist()]
        spark.createDataFrame([(json.dumps([head, trees]),)], "model string").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "BoostedTrees":
        (features, prediction, base, edges, depth, gains), trees = json.loads(spark.read.parquet(path).first()[0])
        grown = [Tree(np.array(f, np.int32), np.array(c, np.int32), np.array(m, bool), np.array(v)) for f, c, m, v in trees]
        return BoostedTrees(features, prediction, base, [np.array(e) for e in edges], grown, depth, np.array(gains))


def _as_array(df: DataFrame, column: str) -> Column:
    """The features as an array; a null vector stays null."""
    if df.schema[column].dataType.simpleString() != "vector":
        return F.col(column)
    return F.when(F.col(column).isNotNull(), vector_to_array(column))


def _bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin numbers from 1 on (value ≤ upper bound of the bin; above all: the last one + 1), 0 for missing."""
    out = np.empty(x.shape, np.int16)
    for j, e in enumerate(edges):
        out[:, j] = np.where(np.isnan(x[:, j]), 0, np.searchsorted(e, x[:, j], "left") + 1)
    return out


def _grown(trees: list[Tree], bins: np.ndarray, depth: int) -> np.ndarray:
    total = np.zeros(len(bins))
    for tree in trees:
        total += tree.value[tree.place(bins, depth)]
    return total


@dataclass
class SecondOrderBoosting:
    """Settings of a fit. Defaults besides trees, rate and depth: penalty 1 on leaf weights, hessian 1 in a child.

    `subsample` draws the rows of each tree by a hash of `key`, so runs and partitionings agree.
    Every `keep` trees the margins are written, so that a pass walks through `keep` trees at most.
    """

    features_column: str = "features"
    label_column: str = "original_label"
    prediction_column: str = "gbt_b"
    trees: int = 100
    rate: float = 0.1
    depth: int = 6
    bins: int = 64
    penalty: float = 1.0
    least_gain: float = 0.0
    least_hessian: float = 1.0
    subsample: float = 1.0
    key: str = "channelId"
    loss: str = "squared"
    keep: int = 5
    rows_per_partition: int = 10_000
    jobs: int = field(default=0, init=False)

    def _edges(self, rows: DataFrame, width: int) -> list[np.ndarray]:
        """Upper bounds of the bins: approximate quantiles of each feature, in one aggregate."""
        shares = [i / self.bins for i in range(1, self.bins)]
        value = lambda j: F.when(~F.isnan(F.col("x")[j]), F.col("x")[j])
        found = rows.agg(*[F.percentile_approx(value(j), shares, 10_000).alias(str(j)) for j in range(width)]).first()
        return [np.unique(np.array(found[str(j)] or [], float)) for j in range(width)]

    def fit(self, df: DataFrame) -> BoostedTrees:
        """Rows with a null label or null features are left out; without rows the model predicts 0."""
        rows = df.select(
            _as_array(df, self.features_column).cast("array<double>").alias("x"), F.col(self.label_column).cast("double").alias("y"),
            F.xxhash64(F.col(self.key)).alias("key"),
        ).where("x IS NOT NULL AND y IS NOT NULL")
        head = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width"), F.avg("y").alias("mean")).first()
        width = head["width"] or 0
        if not head["n"]:
            return BoostedTrees(self.features_column, self.prediction_column, 0.0, [], [], self.depth, np.zeros(0))
        edges = self._edges(rows, width)
        base = head["mean"] if self.loss == "squared" else float(np.log(max(head["mean"], 1e-6) / max(1 - head["mean"], 1e-6)))
        parts = parts_for(df.sparkSession, head["n"], self.rows_per_partition)
        data = written(self._coded(rows.repartition(parts), edges, width, base), "boosting-rows").persist()
        model = BoostedTrees(self.features_column, self.prediction_column, base, edges, [], self.depth, np.zeros(width))
        fresh: list[Tree] = []
        for number in range(self.trees):
            if len(fresh) == self.keep:
                done, data = data, written(self._advanced(data, fresh, width), "boosting-rows").persist()
                done.unpersist()
                fresh = []
            tree = Tree.empty(self.depth)
            for level in range(self.depth):
                sums = self._sums(data, fresh, tree, level, number, width, max(map(len, edges)) + 2, parts)
                if not self._split(tree, level, sums, model.gains):
                    break
            tree.value *= self.rate
            fresh.append(tree)
            model.trees.append(tree)
        data.unpersist()
        model.jobs = self.jobs
        return model

    def _coded(self, rows: DataFrame, edges: list[np.ndarray], width: int, base: float) -> DataFrame:
        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = pc.list_flatten(batch.column("x")).to_numpy(zero_copy_only=False).reshape(-1, width)
                packed = [b.tobytes() for b in _bins(x.astype(float), edges)]
                margin = np.full(len(x), base)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(packed, pa.binary()), batch.column("y"), batch.column("key"), pa.array(margin)], ["bins", "y", "key", "margin"]
                )

        return rows.mapInArrow(code, "bins binary, y double, key long, margin double")

    def _advanced(self, data: DataFrame, fresh: list[Tree], width: int) -> DataFrame:
        depth = self.depth

        def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                margin = batch.column("margin").to_numpy() + _grown(fresh, _unpacked(batch, width), depth)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(margin)], batch.schema.names)

        return data.mapInArrow(advance, data.schema)

    def _sums(self, data: DataFrame, fresh: list[Tree], tree: Tree, level: int, number: int, width: int, bins: int, parts: int) -> np.ndarray:
        """(node of the level, feature, bin, 2): summed gradients and hessians."""
        nodes, first, loss, depth, share = 2**level, 2**level - 1, LOSSES[self.loss], self.depth, self.subsample
        shape = (nodes, width, bins, 2)
        salt = np.uint64((number + 1) * _MIX % 2**64)

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((nodes * width * bins, 2))
            for batch in batches:
                coded = _unpacked(batch, width)
                y = batch.column("y").to_numpy()
                chosen = np.ones(len(y), bool)
                if share < 1:
                    mixed = (batch.column("key").to_numpy().view(np.uint64) ^ salt) * np.uint64(_MIX)
                    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(_MIX)
                    chosen = (mixed >> np.uint64(11)) < share * 2.0**53
                place = tree.place(coded, level) - first
                chosen &= place >= 0  # rows in leaves of earlier levels are done
                g, h = loss(batch.column("margin").to_numpy() + _grown(fresh, coded, depth), y)
                cell = ((place[:, None] * width + np.arange(width)) * bins + coded)[chosen].ravel()
                for i, w in enumerate((g, h)):
                    total[:, i] += np.bincount(cell, np.repeat(w[chosen], width), len(total))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(nodes * width * bins * 2)
            for batch in batches:
                for raw in batch.column("sums"):
                    total += np.frombuffer(raw.as_buffer(), float)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        found = data.mapInArrow(add_up, "sums binary")
        while parts > 16:  # sums of many tasks are added in tasks, sixteen or so at a time
            parts = -(-parts // 16)
            found = found.repartition(parts).mapInArrow(merge, "sums binary")
        self.jobs += 1
        total = np.zeros(nodes * width * bins * 2)
        for row in found.collect():
            total += np.frombuffer(row["sums"], float)
        return total.reshape(shape)

    def _split(self, tree: Tree, level: int, sums: np.ndarray, gains: np.ndarray) -> bool:
        """Split the nodes of a level where that gains most, and give the children their weights."""
        weight = lambda s: -s[..., 0] / (s[..., 1] + self.penalty)
        score = lambda s: s[..., 0] ** 2 / (s[..., 1] + self.penalty)
        first, again = 2**level - 1, False
        for i, node in enumerate(range(first, 2 * first + 1)):
            whole = sums[i, 0].sum(axis=0)
            if whole[1] <= 0:
                continue
            tree.value[node] = weight(whole)
            missing = sums[i, :, :1]
            below = np.cumsum(sums[i, :, 1:], axis=1)
            best = (self.least_gain, None)
            for to_left in (False, True):
                left = below + missing * to_left
                right = whole - left
                allowed = (left[..., 1] >= self.least_hessian) & (right[..., 1] >= self.least_hessian)
                gain = np.where(allowed, 0.5 * (score(left) + score(right) - score(whole)), -np.inf)
                f, b = np.unravel_index(gain.argmax(), gain.shape)
                if gain[f, b] > best[0] + 1e-12:
                    best = (gain[f, b], (f, b, to_left, left[f, b], right[f, b]))
            if best[1] is None:
                continue
            f, b, to_left, left, right = best[1]
            tree.feature[node], tree.cut[node], tree.missing_left[node] = f, b + 1, to_left
            tree.value[2 * node + 1], tree.value[2 * node + 2] = weight(left), weight(right)
            gains[f] += best[0]
            again = True
        return again


def _unpacked(batch: pa.RecordBatch, width: int) -> np.ndarray:
    column = batch.column("bins")
    return np.frombuffer(b"".join(column.to_pylist()), np.int16).reshape(-1, width)
