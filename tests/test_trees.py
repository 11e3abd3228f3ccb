"""Scores and attributions from the tables of a saved model."""

from itertools import combinations
from math import factorial

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from txnlens.constants import FEATURES
from txnlens.operators import inject, model, trees
from txnlens.operators.model import scaled_name
from txnlens.plans import train
from txnlens.sources import tables


@pytest.fixture(scope="module")
def fitted(spark, tmp_path_factory):
    txn = inject.inject_accidents(tables.txn_events(spark, "/root/testdata/sf0.001"))
    made, scored = train.fit(txn, trees=6, depth=3)
    path = str(tmp_path_factory.mktemp("model") / "model")
    made.write().save(path)
    return trees.node_table(spark, path).cache(), model.scaled(made, scored).cache(), made


def test_nodes_score_like_the_model(fitted):
    nodes, rows, made = fitted
    theirs = {r.transaction_id: r for r in rows.collect()}
    ours = trees.score(nodes, rows.drop("predicted_accident", "accident_probability")).collect()
    assert len(ours) == len(theirs) > 50
    for row in ours:
        assert row.predicted_accident == theirs[row.transaction_id].predicted_accident
        assert row.accident_probability == pytest.approx(theirs[row.transaction_id].accident_probability, abs=1e-9)
    assert nodes.where("left IS NULL").count() == nodes.where("left IS NOT NULL").count() + 6
    assert made.stages[-1].getNumTrees == 6


def test_another_engine_can_score(fitted):
    nodes, rows, _ = fitted
    text = " + ".join(trees.tree_sql(t, '"', "CAST({!r} AS DOUBLE)") for t in trees.by_tree(nodes))
    scaled = rows.select("transaction_id", *[scaled_name(c) for c in FEATURES]).toPandas()  # noqa: F841
    theirs = dict(duckdb.connect().execute(f"SELECT transaction_id, {text} FROM scaled").fetchall())
    for row in trees.score(nodes, rows).select("transaction_id", trees.MARGIN).collect():
        assert row[1] == pytest.approx(theirs[row[0]], abs=1e-12)


def expected(tree, at, known, x):
    """A tree's mean value where only the features in ``known`` are looked at."""
    node = tree[at]
    if node["feature"] is None:
        return node["value"] * node["weight"]
    left, right = node["left"], node["right"]
    if node["feature"] in known:
        return expected(tree, left if x[node["feature"]] <= node["threshold"] else right, known, x)
    part = tree[left]["rows"] / node["rows"]
    return part * expected(tree, left, known, x) + (1 - part) * expected(tree, right, known, x)


def shapley(forest, x, names):
    out = {}
    for name in names:
        others = [n for n in names if n != name]
        total = 0.0
        for k in range(len(others) + 1):
            weight = factorial(k) * factorial(len(others) - k) / factorial(len(names))
            for known in combinations(others, k):
                for tree in forest:
                    total += weight * (expected(tree, 0, {*known, name}, x) - expected(tree, 0, {*known}, x))
        out[name] = total
    return out


def test_attribution_against_all_subsets(fitted):
    nodes, rows, _ = fitted
    forest = trees.by_tree(nodes)[1:2]
    few = nodes.where("tree = 1")
    used = sorted({n["feature"] for t in forest for n in t.values() if n["feature"]})
    assert 2 <= len(used) <= 10
    some = rows.orderBy("transaction_id").limit(12)
    got = {r.transaction_id: r for r in trees.attribution(few, some).collect()}
    for row in some.collect():
        x = {n: row[scaled_name(n)] for n in used}
        want = shapley(forest, x, used)
        ours = got[row.transaction_id]
        for name in FEATURES:
            assert ours[trees.added(name)] == pytest.approx(want.get(name, 0.0), abs=1e-9)
        assert ours[trees.BASE] == pytest.approx(sum(expected(t, 0, set(), x) for t in forest), abs=1e-9)
        assert ours[trees.MARGIN] == pytest.approx(sum(expected(t, 0, set(used), x) for t in forest), abs=1e-9)


def test_a_feature_twice_on_a_path(spark):
    """Cuts at 0 and 2 by one feature leave an interval, and the shares of both are multiplied."""
    keys = ["tree", "weight", "node", "feature", "threshold", "left", "right", "value", "rows"]
    raw = [
        (0, 0.5, 0, "a", 2.0, 1, 4, 0.0, 10), (0, 0.5, 1, "a", 0.0, 2, 3, 0.0, 8),
        (0, 0.5, 2, None, None, None, None, 1.0, 2), (0, 0.5, 3, None, None, None, None, 4.0, 6),
        (0, 0.5, 4, None, None, None, None, -3.0, 2), (1, 1.0, 0, None, None, None, None, 0.25, 10),
    ]
    nodes = spark.createDataFrame(raw, "tree int, weight double, node int, feature string, threshold double, left int, right int, value double, rows bigint")
    assert nodes.columns == keys
    rows = spark.createDataFrame([("x", 0.0), ("y", 1.0), ("z", 2.5)], "transaction_id string, scaled_a double")
    got = {r.transaction_id: r for r in trees.attribution(nodes, rows, features=["a"]).collect()}
    base = 0.5 * (0.2 * 1 + 0.6 * 4 + 0.2 * -3) + 0.25
    for key, value in [("x", 1.0), ("y", 4.0), ("z", -3.0)]:
        assert got[key].margin == pytest.approx(0.5 * value + 0.25)
        assert got[key].base == pytest.approx(base)
        assert got[key].adds_a == pytest.approx(0.5 * value + 0.25 - base)
    paths = {(r.tree, r.leaf): r for r in trees.leaf_paths(nodes).collect()}
    assert len(paths) == 3  # the tree of one leaf has no path
    middle = paths[0, 1]
    assert (middle.low, middle.high, middle.share) == (0.0, 2.0, pytest.approx(0.6))
    summary = trees.mean_size(trees.attribution(nodes, rows, features=["a"]), ["a"]).first()
    assert summary.mean == pytest.approx(np.mean([0.5, 2.0, -1.5]) + 0.25 - base)
    assert trees.attribution(nodes, rows.where("false"), features=["a"]).count() == 0


def test_attribution_of_many_leaves_is_quick(spark):
    """Time goes into leaves times rows: 2,048 leaves, 100,000 rows in one task."""
    import time

    rng = np.random.default_rng(3)
    names = [f"f{i}" for i in range(6)]
    raw = []
    for tree in range(32):
        for node in range(63):
            raw.append((tree, 0.1, node, names[(tree + (node + 1).bit_length()) % 6], float(rng.normal()), 2 * node + 1, 2 * node + 2, 0.0, 1 << (7 - (node + 1).bit_length())))
        raw += [(tree, 0.1, node, None, None, None, None, float(rng.normal()), 1) for node in range(63, 127)]
    nodes = spark.createDataFrame(raw, "tree int, weight double, node int, feature string, threshold double, left int, right int, value double, rows bigint")
    scaled = spark.range(100_000).select(
        F.col("id").cast("string").alias("transaction_id"), *[(F.rand(i) * 4 - 2).alias(scaled_name(n)) for i, n in enumerate(names)]
    )
    rows = scaled.coalesce(1).localCheckpoint()
    began = time.time()
    got = trees.attribution(nodes, rows, features=names)
    off = F.abs(F.col(trees.MARGIN) - F.col(trees.BASE) - sum(F.col(trees.added(n)) for n in names))
    assert got.agg(F.max(off)).first()[0] < 1e-9
    assert time.time() - began < 20


def test_training_rows_are_dealt_evenly(spark):
    """A table of one large file and small ones would leave most slots waiting for one at every level."""
    rows = spark.range(0, 4000, numPartitions=1).unionAll(spark.range(0, 40, numPartitions=3))
    slots = spark.sparkContext.defaultParallelism
    even = model.dealt(rows, part_rows=200).withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()
    assert len(even) == slots * -(-4040 // (slots * 200))
    sizes = [r["count"] for r in even]
    assert sum(sizes) == 4040 and max(sizes) - min(sizes) <= 4
    assert model.dealt(rows) is rows  # one wave holds them
