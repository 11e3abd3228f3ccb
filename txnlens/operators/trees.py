"""The fitted trees as tables: scoring by one expression, and what each feature adds to a row's score.

A saved model holds its trees as rows, one for each node. From them a row's margin is a sum of nested
conditions, which Spark and any other SQL engine evaluate alike, and without the model's classes.

What a feature adds to a row is its Shapley value, where a tree that doesn't know a feature follows both
branches in proportion to the training rows that took them. A leaf's part in that depends only on
which features of its path the row agrees with. So each leaf has a small table: for every set of
agreeing features (64 at depth 6) what each of them adds. A row looks up one line per leaf.

Both take in the whole model, whose size is set by its numbers of trees and levels, not by the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial, inf

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from txnlens.constants import FEATURES
from txnlens.operators.evaluate import PREDICTION, PROBABILITY
from txnlens.operators.model import scaled_name

BASE, MARGIN = "base", "margin"


def node_table(spark: SparkSession, path: str, features: list[str] = FEATURES) -> DataFrame:
    """(tree, weight, node, feature, threshold, left, right, value, rows) of a model saved at ``path``.

    Leaves have no feature; ``rows`` is the number of training rows that reached the node.
    """
    stage = f"{path.rstrip('/')}/stages/*GBTClassifier*"
    weights = spark.read.parquet(f"{stage}/treesMetadata").toDF("tree", "metadata", "weight")
    nodes = spark.read.parquet(f"{stage}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    split = F.col("split.featureIndex") >= 0
    names = F.array(*map(F.lit, features))
    return nodes.join(F.broadcast(weights.select("tree", "weight")), "tree").select(
        "tree",
        "weight",
        F.col("id").alias("node"),
        F.when(split, F.get(names, F.col("split.featureIndex"))).alias("feature"),
        F.when(split, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        F.when(split, F.col("leftChild")).alias("left"),
        F.when(split, F.col("rightChild")).alias("right"),
        F.col("prediction").alias("value"),
        F.col("rawCount").alias("rows"),
    )


def by_tree(nodes: DataFrame) -> list[dict[int, Row]]:
    """The nodes of each tree by number."""
    trees: dict[int, dict[int, Row]] = {}
    for row in nodes.collect():
        trees.setdefault(row["tree"], {})[row["node"]] = row
    return [trees[t] for t in sorted(trees)]


def tree_sql(tree: dict[int, Row], quote: str = "`", literal: str = "{!r}D") -> str:
    """One tree as SQL over the scaled features; ``literal`` is how the engine writes a double."""

    def branch(at: int) -> str:
        node = tree[at]
        if node["feature"] is None:
            return f"({literal.format(node['value'] * node['weight'])})"
        name = f"{quote}{scaled_name(node['feature'])}{quote}"
        return f"CASE WHEN {name} <= {literal.format(node['threshold'])} THEN {branch(node['left'])} ELSE {branch(node['right'])} END"

    return branch(0)


def margin(trees: list[dict[int, Row]]) -> Column:
    """The weighted sum of the leaves that a row reaches."""
    parts = F.array(*[F.expr(tree_sql(t)) for t in trees])
    return F.aggregate(parts, F.lit(0.0), lambda total, x: total + x)


def score(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows with scaled features, with the class and the probability that the model gives them."""
    scored = rows.withColumn(MARGIN, margin(by_tree(nodes)))
    return scored.withColumns(
        {
            PREDICTION: (F.col(MARGIN) > 0).cast("int"),
            PROBABILITY: 1 / (1 + F.exp(-2 * F.col(MARGIN))),
        }
    )


@dataclass(frozen=True)
class Leaf:
    """A leaf's path: for each feature on it the interval (low, high] and the share of rows that stay.

    ``adds`` has a line for each set of features that a row agrees with (bit j for feature j).
    """

    features: list[str]
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: float
    adds: np.ndarray


def subset_table(share: np.ndarray, value: float) -> np.ndarray:
    """What each feature of a path adds, for each set of features that a row agrees with.

    Feature i adds the mean, over all orders in which features become known, of the change that
    knowing i makes: a known feature counts 1 or 0, an unknown one its share. Products over the others
    are grouped by the number of known ones, as coefficients of a polynomial.
    """
    m = len(share)
    agrees = (np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(float)
    out = np.zeros((1 << m, m))
    for i in range(m):
        known = np.zeros((1 << m, m))  # coefficient k: products with k known features
        known[:, 0] = 1
        for j in range(m):
            if j != i:
                more = known * agrees[:, j : j + 1]
                known = known * share[j]
                known[:, 1:] += more[:, :-1]
        weights = [factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)]
        out[:, i] = value * (agrees[:, i] - share[i]) * (known @ weights)
    return out


def leaves(tree: dict[int, Row]) -> list[Leaf]:
    out = []

    def walk(at: int, path: dict[str, tuple[float, float, float]]) -> None:
        node = tree[at]
        if node["feature"] is None:
            names = list(path)
            low, high, share = (np.array([path[n][k] for n in names]) for k in range(3))
            value = node["value"] * node["weight"]
            out.append(Leaf(names, low, high, share, value, subset_table(share, value)))
            return
        low, high, share = path.get(node["feature"], (-inf, inf, 1.0))
        for child, bounds in [
            (node["left"], (low, min(high, node["threshold"]))),
            (node["right"], (max(low, node["threshold"]), high)),
        ]:
            part = share * tree[child]["rows"] / node["rows"]
            walk(child, {**path, node["feature"]: (*bounds, part)})

    walk(0, {})
    return out


def leaf_paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, value, feature, low, high, share): one row for each feature on the way to a leaf."""
    rows = [
        (t, k, leaf.value, *each)
        for t, tree in enumerate(by_tree(nodes))
        for k, leaf in enumerate(leaves(tree))
        for each in zip(leaf.features, leaf.low.tolist(), leaf.high.tolist(), leaf.share.tolist())
    ]
    schema = "tree int, leaf int, value double, feature string, low double, high double, share double"
    return nodes.sparkSession.createDataFrame(rows, schema)


def added(name: str) -> str:
    return f"adds_{name}"


def attribution(nodes: DataFrame, rows: DataFrame, key: str = "transaction_id", features: list[str] = FEATURES) -> DataFrame:
    """Key, base, margin, and what each feature adds; base and parts make up the margin.

    ``rows`` has the scaled features. Arrow batches: a lookup per leaf and batch.
    """
    paths = [leaves(tree) for tree in by_tree(nodes)]
    base = sum(leaf.value * leaf.share.prod() for tree in paths for leaf in tree)
    place = {name: i for i, name in enumerate(features)}
    sent = nodes.sparkSession.sparkContext.broadcast(
        [
            [
                ([place[n] for n in leaf.features], leaf.low.tolist(), leaf.high.tolist(), np.ascontiguousarray(leaf.adds.T))
                for leaf in tree
                if leaf.features
            ]
            for tree in paths
        ]
    )
    names, out = [scaled_name(n) for n in features], [key, BASE, MARGIN, *map(added, features)]

    # nothing of this module is used inside: workers needn't have it
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.ascontiguousarray(batch.column(n).to_numpy(zero_copy_only=False)) for n in names]
            total = np.zeros((len(x), batch.num_rows))
            for tree in sent.value:
                inside: dict[tuple[int, float, float], np.ndarray] = {}  # rows in an interval: leaves share them
                for own, lows, highs, adds in tree:
                    agrees = np.zeros(batch.num_rows, np.int64)
                    for j, (at, low, high) in enumerate(zip(own, lows, highs)):
                        if (at, low, high) not in inside:
                            inside[at, low, high] = ((x[at] > low) & (x[at] <= high)).astype(np.int64)
                        agrees += inside[at, low, high] << j
                    for at, part in zip(own, adds):
                        total[at] += part.take(agrees)
            margin = base + np.ascontiguousarray(total.T).sum(axis=1)
            columns = [np.full(batch.num_rows, base), margin, *total]
            yield pa.record_batch([batch.column(key), *(pa.array(c) for c in columns)], out)

    parts = ", ".join(f"`{added(n)}` double" for n in features)
    kind = dict(rows.dtypes)[key]
    return rows.select(key, *[F.col(f"`{n}`").cast("double").alias(n) for n in names]).mapInArrow(
        run, f"`{key}` {kind}, {BASE} double, {MARGIN} double, {parts}"
    )


def mean_size(attributed: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """feature, mean_size, mean: how much each feature moves the score, and which way, over all rows."""
    parts = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"`{added(n)}`").alias("adds")) for n in features])
    return attributed.select(F.inline(parts)).groupBy("feature").agg(
        F.avg(F.abs("adds")).alias("mean_size"), F.avg("adds").alias("mean")
    )
