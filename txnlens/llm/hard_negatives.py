"""Hard-negative mining by segment summary filtering.

For each anchor, its positives are the rows of the same label with the highest inner products. Hard
negatives of a positive are the rows of other labels that score next best below it: between two shares of the
positive's score. Vectors are of integers, so scores and their order are exact.

Each vector is cut into 1, 4, 16, ... segments, and the mean and the deviation of every segment are stored
with it. By the inequality of Cauchy and Schwarz the inner product of two segments of n components is n times
the product of their means plus or minus at most n times the product of their deviations. So bounds of all
scores of a tile (anchors x rows) come from its summaries, first of whole vectors; pairs whose bounds
can't reach the scores found so far, or lie outside the band wanted, are left out, the others are judged by
the next finer segments, and what is left after the finest is scored exactly.

Anchors go to all tasks in slices of bounded size, each pass over the rows keeps the best of each anchor in
every task and writes them, and the next slice follows. A task's state follows the slice, not the rows.

Defined results: rows with a null label, a null vector or a null component take no part, nor do those with NaN
or infinite ones; of vectors of different lengths the shorter ones end in zeros; repeated rows are rows of
their own, and equal scores are ordered by vec_id, a null one last (an id of 2^63 - 1 counts as none); a row
without vec_id is no anchor; an anchor without positives, and an empty table, give no rows; further columns
are not read. A score that doesn't fit into 64 bits is an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnlens.llm.tables import shared_folder, stage

# Of the anchors' vectors in one pass, for all tasks.
SLICE_BYTES = 16 << 20

TILE_ANCHORS, TILE_ROWS = 1024, 2048
NO_ID = 2**63 - 1
EXACT = 2.0**53  # up to here sums of integers are exact as doubles

STORED = "uid bigint, id bigint, label bigint, q array<bigint>, means array<double>, devs array<double>"
FOUND = "anchor bigint, band int, score bigint, id bigint, uid bigint"


def level_starts(dims: int) -> list[np.ndarray]:
    """Where the segments of each level start: 1, 4, 16, ... segments of two components or more."""
    counts = [4**k for k in range(12) if k == 0 or 2 * 4**k <= dims]
    return [np.arange(n) * dims // n for n in counts] if dims else []


def summaries(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of all segments, level after level; both times the root of the segment's length."""
    x = q.astype(np.float64)
    means, devs = [np.zeros((len(x), 0))], [np.zeros((len(x), 0))]
    for starts in level_starts(x.shape[1]):
        sizes = np.diff(np.append(starts, x.shape[1]))
        mean = np.add.reduceat(x, starts, axis=1) / sizes
        spread = np.add.reduceat((x - np.repeat(mean, sizes, axis=1)) ** 2, starts, axis=1)
        means.append(mean * np.sqrt(sizes))
        devs.append(np.sqrt(spread))
    return np.concatenate(means, axis=1), np.concatenate(devs, axis=1)


def matrix(column: pa.Array, dims: int, kind: type) -> np.ndarray:
    """Lists as rows, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dims).all():
        return values.astype(kind).reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), kind)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


class Vectors:
    """Rows of a stored table, side by side."""

    def __init__(self, table: pa.Table | pa.RecordBatch, dims: int):
        if isinstance(table, pa.Table):
            table = table.combine_chunks()
            column = lambda name: table.column(name).combine_chunks()
        else:
            column = table.column
        self.uid, self.id, self.label = (column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("uid", "id", "label"))
        self.q = matrix(column("q"), dims, np.int64)
        n = sum(len(s) for s in level_starts(dims))
        self.means, self.devs = (matrix(column(c), n, np.float64) for c in ("means", "devs"))
        self.size = np.abs(self.q.astype(np.float64)).max(axis=1, initial=0)
        self.norm = np.sqrt((self.q.astype(np.float64) ** 2).sum(axis=1))

    def __len__(self) -> int:
        return len(self.uid)


def exact_scores(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Inner products of rows of a with rows of b, ``most`` being a bound of them."""
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    scores = a.astype(object) @ b.astype(object).T
    if scores.size and max(abs(scores.max()), abs(scores.min())) >= 2**63:
        raise OverflowError("a score doesn't fit into 64 bits")
    return scores.astype(np.int64)


class Best:
    """The k best rows of each (anchor, band) so far; a band is a range of scores, ends included."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k  # anchors x bands
        self.least = low.copy()  # scores below can't come in any more
        self.rows = [[np.zeros(0, np.int64)] * 4 for _ in range(low.shape[1])]  # anchor, score, id, uid

    def add(self, band: int, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray, uid: np.ndarray) -> None:
        a, s, i, u = (np.concatenate(x) for x in zip(self.rows[band], (anchor, score, ids, uid)))
        order = np.lexsort((u, i, -s, a))
        a = a[order]
        nth = np.arange(len(a)) - np.searchsorted(a, a)
        order, a, nth = order[nth < self.k], a[nth < self.k], nth[nth < self.k]
        self.rows[band] = [a, s[order], i[order], u[order]]
        full = nth == self.k - 1
        self.least[a[full], band] = s[order][full]


def search(anchors: Vectors, rows: Vectors, best: Best, same_label: bool) -> None:
    """Let the rows compete for the places of all anchors, tile by tile."""
    levels = np.cumsum([0, *(len(s) for s in level_starts(rows.q.shape[1]))])
    for a0 in range(0, len(anchors), TILE_ANCHORS):
        for r0 in range(0, len(rows), TILE_ROWS):
            ai, ri = np.arange(a0, min(a0 + TILE_ANCHORS, len(anchors))), np.arange(r0, min(r0 + TILE_ROWS, len(rows)))
            alive = (anchors.label[ai][:, None] == rows.label[ri]) == same_label
            alive &= anchors.uid[ai][:, None] != rows.uid[ri]
            # the loosest bounds of the anchor's bands, as far as those can be met
            open_band = best.least[ai] <= best.high[ai]
            floor = np.where(open_band, best.least[ai], NO_ID).min(axis=1).astype(np.float64)
            ceiling = np.where(open_band, best.high[ai], -NO_ID).max(axis=1).astype(np.float64)
            floor[floor <= -NO_ID], ceiling[ceiling >= NO_ID] = -np.inf, np.inf  # no bound
            for a, b in zip(levels, levels[1:]):
                keep_a, keep_r = alive.any(axis=1), alive.any(axis=0)
                ai, ri, floor, ceiling, alive = ai[keep_a], ri[keep_r], floor[keep_a], ceiling[keep_a], alive[np.ix_(keep_a, keep_r)]
                if not alive.size:
                    break
                middle = anchors.means[ai, a:b] @ rows.means[ri, a:b].T
                reach = anchors.devs[ai, a:b] @ rows.devs[ri, a:b].T
                reach += 1e-6 + 1e-9 * anchors.norm[ai][:, None] * rows.norm[ri]  # rounding
                alive &= middle + reach >= floor[:, None]
                alive &= middle - reach <= ceiling[:, None]
            keep_a, keep_r = alive.any(axis=1), alive.any(axis=0)
            ai, ri, alive = ai[keep_a], ri[keep_r], alive[np.ix_(keep_a, keep_r)]
            if not alive.size:
                continue
            most = anchors.size[ai].max() * rows.size[ri].max() * rows.q.shape[1]
            scores = exact_scores(anchors.q[ai], rows.q[ri], most)
            for band in range(best.low.shape[1]):
                hits = alive & (scores >= best.least[ai, band][:, None]) & (scores <= best.high[ai, band][:, None])
                if hits.sum() > 8 * best.k * len(ai) and hits.shape[1] > best.k:
                    # none below the k-th best of the tile
                    own = np.where(hits, scores, -NO_ID)
                    hits &= scores >= np.partition(own, -best.k, axis=1)[:, -best.k][:, None]
                x, y = np.nonzero(hits)
                if len(x):
                    best.add(band, ai[x], scores[x, y], rows.id[ri[y]], rows.uid[ri[y]])


def stored(vectors: DataFrame) -> tuple[DataFrame, int]:
    """The rows that take part with their summaries, written; the longest vector's length."""
    rows = vectors.select(
        F.monotonically_increasing_id().alias("uid"),
        F.coalesce(F.col("vec_id").cast("bigint"), F.lit(NO_ID)).alias("id"),
        F.col("label").cast("bigint").alias("label"),
        F.col("q").cast("array<bigint>").alias("q"),
    ).where(F.col("label").isNotNull() & F.col("q").isNotNull() & F.forall("q", lambda x: x.isNotNull()))
    rows = stage(rows, "vectors")
    dims = rows.agg(F.max(F.size("q"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            means, devs = summaries(matrix(batch.column("q"), dims, np.int64))
            lists = [pa.array(list(x), pa.list_(pa.float64())) for x in (means, devs)]
            yield pa.record_batch([*batch.columns, *lists], [*batch.schema.names, "means", "devs"])

    return stage(rows.mapInArrow(run, STORED), "summaries"), dims


def best_rows(rows: DataFrame, dims: int, anchors: Vectors, low: np.ndarray, high: np.ndarray, k: int, same_label: bool) -> DataFrame:
    """One pass: (anchor, band, score, id, uid, rank) of the k best rows of every anchor and band."""
    sent = rows.sparkSession.sparkContext.broadcast((anchors, low, high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, low, high = sent.value
        best = Best(low, high, k)
        for batch in batches:
            if batch.num_rows:
                search(anchors, Vectors(batch, dims), best, same_label)
        for band, (a, score, ids, uid) in enumerate(best.rows):
            columns = [anchors.uid[a], np.full(len(a), band, np.int32), score, ids, uid]
            yield pa.record_batch([pa.array(c) for c in columns], ["anchor", "band", "score", "id", "uid"])

    places = Window.partitionBy("anchor", "band").orderBy(F.desc("score"), "id", "uid")
    return rows.mapInArrow(run, FOUND).withColumn("rank", F.row_number().over(places)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of vectors (vec_id, label, q).

    ``anchors`` is a condition on ``vec_id``. A negative of a positive with score p scores from
    ``low`` to ``high`` hundredths of p; the first ``negatives`` are returned.
    """
    spark = vectors.sparkSession
    rows, dims = stored(vectors)
    chosen = rows.withColumn("vec_id", F.when(F.col("id") != NO_ID, F.col("id"))).where(anchors).drop("vec_id")
    # in each pass; the summaries take about as much as the vectors
    per_pass = max(1, slice_bytes // (16 * max(1, dims)))
    passes = max(1, -(-chosen.count() // per_pass))
    of_pass = F.pmod(F.xxhash64("uid"), F.lit(passes))
    path = f"{shared_folder(spark).rstrip('/')}/hard_negatives-{uuid.uuid4().hex}"
    for k in range(passes):
        own = Vectors(chosen.where(of_pass == k).toArrow(), dims)
        n = len(own)
        first = best_rows(rows, dims, own, np.full((n, 1), -NO_ID), np.full((n, 1), NO_ID), positives, True)
        first = stage(first, "positives")
        score = np.full((n, positives), -1, np.int64)  # none: no score fits
        found = first.select("anchor", "rank", "score").toArrow()
        order = np.argsort(own.uid)
        at = order[np.searchsorted(own.uid[order], found["anchor"].to_numpy())]
        score[at, found["rank"].to_numpy() - 1] = found["score"].to_numpy()
        # 100 n from low * p to high * p; with p < 0 no number does
        least = np.array([-(-low * p // 100) for p in score.ravel().tolist()], np.int64).reshape(score.shape)
        most = np.array([high * p // 100 for p in score.ravel().tolist()], np.int64).reshape(score.shape)
        second = best_rows(rows, dims, own, least, most, negatives, False)
        pairs = second.select("anchor", (F.col("band") + 1).alias("place"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        of = first.select("anchor", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        names = chosen.where(of_pass == k).select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id"))
        real = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
        result = pairs.join(of, ["anchor", "place"]).join(names, "anchor")
        result.select(
            "anchor_id", real("positive_id"), "rank", real("negative_id"), "positive_score", "negative_score"
        ).write.mode("append").parquet(path)
    return spark.read.parquet(path)
