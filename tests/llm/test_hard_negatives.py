"""Hard negatives against all scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnlens.llm import hard_negatives
from txnlens.llm.queries import op12_hard_negatives

SCHEMA = "vec_id bigint, q array<bigint>, label bigint, `a.b` int, uid string"


def brute(rows, step, positives=5, negatives=3):
    """Rows of (anchor, positive, rank, negative, scores) as often as they come."""
    rows = [(v, q, lab) for v, q, lab in rows if q is not None and lab is not None and None not in q]
    dims = max([len(q) for _, q, _ in rows], default=0)
    full = [list(q) + [0] * (dims - len(q)) for _, q, _ in rows]
    last = lambda v: (v is None, v)
    out = []
    for i, (anchor, _, label) in enumerate(rows):
        if anchor is None or anchor % step:
            continue
        scored = [(sum(x * y for x, y in zip(full[i], full[j])), v, lab) for j, (v, _, lab) in enumerate(rows) if j != i]
        scored.sort(key=lambda s: (-s[0], last(s[1])))
        for p, pid, _ in [s for s in scored if s[2] == label][:positives]:
            near = [s for s in scored if s[2] != label and 50 * p <= 100 * s[0] <= 95 * p][:negatives]
            out += [(anchor, pid, k, v, p, n) for k, (n, v, _) in enumerate(near, 1)]
    return sorted(map(str, out))


def run(spark, rows, step, **more):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    found = hard_negatives.mine(df, F.col("vec_id") % step == 0, **more).collect()
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(str(tuple(r[n] for n in names)) for r in found)


@pytest.mark.parametrize("seed, dims, spread", [(1, 64, 300), (2, 3, 4), (3, 17, 2), (4, 1, 5)])
def test_against_all_scores(spark, monkeypatch, seed, dims, spread):
    """Close clusters, and small numbers, so that scores tie."""
    monkeypatch.setattr(hard_negatives, "TILE_ROWS", 37)
    monkeypatch.setattr(hard_negatives, "TILE_ANCHORS", 11)
    rng = np.random.default_rng(seed)
    centres = rng.integers(-spread, spread + 1, dims) + rng.integers(-spread // 2, spread // 2 + 1, (4, dims))
    rows = []
    for v in range(260):
        label = int(rng.integers(0, 4))
        q = centres[label] * int(rng.integers(2, 5)) + rng.integers(-spread // 2, spread // 2 + 1, dims)
        rows.append((v, q.tolist(), label))
    want = brute(rows, 10)
    assert run(spark, rows, 10) == want and (len(want) > 30 or dims < 4)
    # several passes
    assert run(spark, rows, 10, slice_bytes=16 * dims * 7) == want


def test_rows_left_out_and_ties(spark):
    rows = [
        (0, [4, 4], 1), (0, [4, 4], 1), (None, [4, 4], 1), (1, None, 1), (2, [1, None], 1), (3, [3, 3], None), (4, [], 2),
        (5, [5], 1), (6, [4, 3, 0], 2), (6, [4, 3], 2), (8, [3, 3, 9], 3), (None, [4, 3], 2), (10, [-4, -4], 1), (20, [0, 0], 7),
    ]
    want = brute(rows, 10)
    assert run(spark, rows, 10) == want and len(want) > 6
    assert run(spark, [], 10) == []
    assert run(spark, [(0, [1], 1)], 1) == []
    assert run(spark, [(0, [], 1), (1, [], 1), (2, [], 2)], 1) == brute([(0, [], 1), (1, [], 1), (2, [], 2)], 1)


def test_large_numbers(spark):
    big = 2**29
    rows = [(v, [big + v, big - 3 * v, big], v % 2) for v in range(12)]
    assert run(spark, rows, 3) == brute(rows, 3)
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [(v, [2**40, 2**40], 1) for v in range(3)], 1)


def test_bounds_hold():
    rng = np.random.default_rng(0)
    for dims in (1, 2, 5, 8, 64, 100):
        a, b = rng.integers(-1000, 1000, (2, 40, dims))
        (ma, da), (mb, db) = hard_negatives.summaries(a), hard_negatives.summaries(b)
        ends = np.cumsum([0, *(len(s) for s in hard_negatives.level_starts(dims))])
        reach = []
        for x, y in zip(ends, ends[1:]):
            middle, dev = ma[:, x:y] @ mb[:, x:y].T, da[:, x:y] @ db[:, x:y].T
            assert (np.abs(a @ b.T - middle) <= dev + 1e-6 * np.abs(middle) + 1e-6).all()
            reach.append(dev.mean())
        assert reach == sorted(reach, reverse=True)  # finer segments bound closer


def test_infinite_components_take_no_part(spark, tmp_path):
    rows = [(v, [0.1 * v, float("nan") if v == 3 else 1.0, float("inf") if v == 4 else -0.5], v % 3) for v in range(60)]
    rows += [(61, [1.0, None, 1.0], 1), (62, None, 1), (63, [1.0, 1.0, 1.0], None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    whole = [(v, [int(np.floor(np.float64(np.float32(x)) * 256)) for x in e], (c + 1) % 10 if v % 7 == 0 else c)
             for v, e, c in rows if e and c is not None and None not in e and np.isfinite(e).all()]
    found = op12_hard_negatives(spark, str(tmp_path)).collect()
    got = sorted(str(tuple(r)) for r in found)
    assert got == brute(whole, 50) and got
