"""Isolation forest (Liu, Ting, Zhou 2008) as Spark jobs.

Training draws ``psi`` rows per tree by hash, so one narrow pass over the features is all that touches
the data; each tree then grows from its small sample in a task of its own.  Scoring sends Arrow
batches through the trees, whose total size is bounded by ``n_trees * (2 * psi - 1)`` nodes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.operators.quantile import exact_quantile
from riskloom.schemas import FOREST_NODES, FOREST_PARAMS, FOREST_PSI, FOREST_SEED, FOREST_TREES
from riskloom.session import settle

OVERSAMPLING = 1.5
AUTO_OFFSET = -0.5
_EULER = 0.5772156649015329


def average_path(n: int) -> float:
    """Mean depth of an unsuccessful search among ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + _EULER) - 2.0 * (n - 1) / n


@dataclass(frozen=True)
class Forest:
    """Nodes in heap order (children of ``i`` are ``2i+1`` and ``2i+2``) and the parameters."""

    nodes: DataFrame
    n_trees: int
    psi: int
    seed: int
    contamination: float | None
    offset: float

    def _score_udf(self):
        depth = _height_limit(self.psi)
        size = 2 ** (depth + 1) - 1
        feature = np.zeros((self.n_trees, size), dtype=np.int64)
        split = np.full((self.n_trees, size), np.inf)
        path = np.zeros((self.n_trees, size))
        # Bounded by n_trees * (2 * psi - 1) rows, whatever the training data's size.
        for row in self.nodes.collect():
            if row["feature"] >= 0:
                feature[row["tree"], row["node"]] = row["feature"]
                split[row["tree"], row["node"]] = row["split"]
                continue
            # Below a leaf every row keeps going left, so all end on the lowest level.
            bottom = row["node"]
            for _ in range(depth - row["depth"]):
                bottom = 2 * bottom + 1
            path[row["tree"], bottom] = row["depth"] + average_path(row["size"])
        trees = self.nodes.sparkSession.sparkContext.broadcast((feature, split, path))
        scale = self.n_trees * max(average_path(self.psi), 1e-12)

        @F.pandas_udf("double")
        def anomaly(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            features, splits, paths = trees.value
            for columns in batches:
                matrix = np.vstack([column.to_numpy(dtype=np.float64) for column in columns])
                rows = np.arange(matrix.shape[1])
                total = np.zeros(matrix.shape[1])
                for tree in range(features.shape[0]):
                    at = np.zeros(matrix.shape[1], dtype=np.int64)
                    for _ in range(depth):
                        right = matrix[features[tree][at], rows] > splits[tree][at]
                        at = 2 * at + 1 + right
                    total += paths[tree][at]
                yield pd.Series(-np.exp2(-total / scale))

        return anomaly

    def add_scores(self, df: DataFrame, features: Sequence[Column], name: str = "anomaly") -> DataFrame:
        """``name``: negated anomaly score in [-1, 0); lower is more anomalous."""
        return df.withColumn(name, self._score_udf()(*features))

    def calibrated(self, scores: DataFrame, contamination: float) -> Forest:
        """The forest with the offset that makes this share of ``scores(anomaly)`` anomalies."""
        return replace(self, contamination=contamination, offset=exact_quantile(scores, "anomaly", contamination))

    def add_decision(self, df: DataFrame, features: Sequence[Column], name: str = "decision") -> DataFrame:
        """``name``: score minus offset; negative means anomaly."""
        return self.add_scores(df, features, name).withColumn(name, F.col(name) - self.offset)


def predict_anomaly(decision: Column) -> Column:
    return F.when(decision < 0, 1).otherwise(0)


def contamination(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """One row: share of labelled rows."""
    return df.agg(F.try_divide(F.sum(label).cast("double"), F.count(F.lit(1))).alias("contamination"))


def _height_limit(psi: int) -> int:
    return math.ceil(math.log2(max(psi, 2)))


def draw_samples(df: DataFrame, row_id: str, n: int, n_trees: int, psi: int, seed: int) -> DataFrame:
    """``psi`` rows per tree, chosen by hash: independent of partitioning, without a full shuffle.

    Every row is a candidate of every tree with the same chance, which lets about ``1.5 * psi`` rows per tree pass; the
    ``psi`` lowest hashes are kept. A row walks from one of its trees to the next by geometric steps, so that a row of
    a large table, which mostly has none, costs one hash, and one scheme serves tables of any size.
    """
    share = min(1.0, OVERSAMPLING * psi / n)
    miss = math.log1p(-share) if share < 1.0 else -math.inf

    def hashed(*salt) -> Column:
        return F.xxhash64(F.col(row_id), *[F.lit(x) if isinstance(x, int) else x for x in salt])

    def step(i) -> Column:
        """Trees passed over before the next one: a geometric number, from 53 bits of a hash, in the open unit interval."""
        unit = (F.shiftrightunsigned(hashed(seed, i), 11).cast("double") + 0.5) / 2.0**53
        return F.floor(F.least(F.log(unit) / F.lit(miss), F.lit(float(n_trees)))).cast("int")

    def walk(state, i):
        at = state["at"] + 1 + step(i)
        trees = F.when(at < n_trees, F.concat(state["trees"], F.array(at))).otherwise(state["trees"])
        return F.when(state["at"] < n_trees, F.struct(at.alias("at"), trees.alias("trees"))).otherwise(state)

    chosen = df.withColumn("__first", step(0)).filter(F.col("__first") < n_trees)
    start = F.struct(F.col("__first").alias("at"), F.array("__first").alias("trees"))
    trees = F.aggregate(F.sequence(F.lit(1), F.lit(n_trees)), start, walk)["trees"]
    candidates = chosen.withColumn("tree", F.explode(trees)).drop("__first")
    candidates = candidates.withColumn("__draw", hashed(seed, F.col("tree"), 7))
    # About 1.5 * psi rows per tree; trees are spread over tasks by number, not merged by size.
    tasks = min(n_trees, df.sparkSession.sparkContext.defaultParallelism)
    candidates = candidates.repartition(tasks, "tree")
    order = Window.partitionBy("tree").orderBy("__draw", row_id)
    return candidates.withColumn("__place", F.row_number().over(order)).filter(F.col("__place") <= psi)


def _grow(seed: int, limit: int, width: int):
    def grow(sample: pd.DataFrame) -> pd.DataFrame:
        tree = int(sample["tree"].iloc[0])
        sample = sample.sort_values("__place")
        data = sample[[f"f{i}" for i in range(width)]].to_numpy(dtype=np.float64)
        rng = np.random.default_rng([seed, tree])
        rows, todo = [], [(0, 0, np.arange(len(data)))]
        while todo:
            node, depth, members = todo.pop()
            low, high = data[members].min(axis=0), data[members].max(axis=0)
            varying = np.flatnonzero(low < high)
            if depth == limit or len(varying) == 0:
                rows.append((tree, node, -1, None, depth, len(members)))
                continue
            feature = int(rng.choice(varying))
            split = min(float(rng.uniform(low[feature], high[feature])), float(np.nextafter(high[feature], -np.inf)))
            right = data[members, feature] > split
            rows.append((tree, node, feature, split, depth, len(members)))
            todo += [(2 * node + 2, depth + 1, members[right]), (2 * node + 1, depth + 1, members[~right])]
        return pd.DataFrame(rows, columns=FOREST_NODES.names)

    return grow


def fit_forest(
    df: DataFrame,
    features: Sequence[Column],
    *,
    row_id: str = "transaction_id",
    n_trees: int = FOREST_TREES,
    psi: int = FOREST_PSI,
    seed: int = FOREST_SEED,
    contamination: float | None = None,
    n_rows: int | None = None,
) -> Forest:
    """Grow the trees; with a ``contamination`` the offset is that quantile of the training scores.

    ``n_rows`` is the number of rows, if already known.
    """
    named = [column.cast("double").alias(f"f{i}") for i, column in enumerate(features)]
    matrix = df.select(F.col(row_id), *named)
    n = df.count() if n_rows is None else n_rows
    psi = min(psi, n)
    samples = draw_samples(matrix, row_id, n, n_trees, psi, seed)
    grown = samples.groupBy("tree").applyInPandas(_grow(seed, _height_limit(psi), len(named)), FOREST_NODES)
    forest = Forest(settle(grown), n_trees, psi, seed, None, AUTO_OFFSET)
    if contamination is None:
        return forest
    scores = settle(forest.add_scores(matrix, [F.col(f"f{i}") for i in range(len(named))]).select("anomaly"))
    return forest.calibrated(scores, contamination)


def save_forest(forest: Forest, path: str) -> None:
    """Node table and a one-row parameter table."""
    spark = forest.nodes.sparkSession
    forest.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    row = (forest.n_trees, forest.psi, forest.seed, forest.contamination, forest.offset)
    spark.createDataFrame([row], FOREST_PARAMS).write.mode("overwrite").parquet(f"{path}/params")


def load_forest(spark: SparkSession, path: str) -> Forest | None:
    """The saved forest, or None if there is none: scoring without a model yields 0."""
    try:
        params = spark.read.schema(FOREST_PARAMS).parquet(f"{path}/params").first()
        nodes = spark.read.schema(FOREST_NODES).parquet(f"{path}/nodes")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return Forest(nodes, params["n_trees"], params["psi"], params["seed"], params["contamination"], params["offset"])
