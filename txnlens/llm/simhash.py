"""SimHash near-dedup with bit-sliced comparison.

A fingerprint has a bit set if more than half of the document's shingle hashes have it set.
Documents with the same fingerprint are one node. Different fingerprints within ``RADIUS`` bits agree
in at least two of four 16-bit blocks, so each goes to six keys, one per pair of blocks, and only
fingerprints that share a key are compared. There they are stored as bit planes, one machine word per
plane for 64 fingerprints; carry-save counters add up a query's differing bits for all 64 at once,
and words in which every distance exceeds the radius are abandoned. A key that holds more than
``TILE_ROWS`` fingerprints is cut into tiles and every pair of tiles is a task of its own, so no
group is compared in one task. What leaves a task is a spanning forest of the links found there.

Defined results: a null or empty text has fingerprint zero, linked like any other; repeated rows are
kept; a row without ``doc_id`` gets its fingerprint, but takes no part in the grouping unless its
fingerprint is that of other rows; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.llm.components import connected_components
from txnlens.llm.tables import default_parts, release, row_blocks, stage

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
BLOCKS = 4  # of 16 bits; two different bits leave two of them alone
TILE_ROWS = 2048
HASHES = 65_536  # of one document, held at once


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """SimHash of a text: lower-cased A-Z, words cut at ASCII white space, shingles of ``words``."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, n, HASHES):
        some = tokens[start : start + HASHES + words - 1]
        if n == 1:
            shingles = [b" ".join(some)]
        else:
            shingles = map(b" ".join, zip(*(some[k:] for k in range(words))))
        hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # counts of up to 255 rows fit a byte, which adds far faster than a wide sum
        full = len(bits) // 255 * 255
        if full:
            ones += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[full:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long); written, since it is read several times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for block in row_blocks(batches):
            fps = [fingerprint(t, words) for t in block.column("text").to_pylist()]
            signed = np.array(fps, np.uint64).view(np.int64)
            yield pa.record_batch([block.column("doc_id"), pa.array(signed)], ["doc_id", "fp"])

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text)
    return stage(rows.mapInArrow(run, "doc_id bigint, fp bigint"), "fingerprints")


def planes_of(fps: np.ndarray) -> np.ndarray:
    """64 planes of the fingerprints' bits, 64 fingerprints to a word; the last word is padded."""
    words = -(-len(fps) // 64)
    padded = np.zeros(words * 64, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    return packed.view("<u8")


def near_lanes(planes: np.ndarray, word: np.ndarray, query: np.ndarray, radius: int) -> np.ndarray:
    """For each (word of the planes, query fingerprint): the lanes within ``radius`` as a bit mask.

    Two carry-save counters hold the distance modulo 4 and a third mask what went beyond; pairs are
    abandoned as soon as all their lanes exceed the radius.
    """
    if radius > 2:
        raise ValueError("the counters hold distances up to 2")
    alive = np.arange(len(word))
    full = ~np.uint64(0)
    one, two, over = (np.zeros(len(word), np.uint64) for _ in range(3))
    for plane in range(64):
        mask = np.where((query >> np.uint64(plane)) & np.uint64(1), full, np.uint64(0))
        differ = planes[plane][word] ^ mask
        carry = one & differ
        one ^= differ
        over |= two & carry
        two ^= carry
        if plane % 8 == 7:
            beyond = over | [one | two, two, one & two][radius]
            keep = beyond != full
            if not keep.all():
                alive, word, query = alive[keep], word[keep], query[keep]
                one, two, over = one[keep], two[keep], over[keep]
    out = np.zeros(alive.max() + 1 if len(alive) else 0, np.uint64)
    out[alive] = ~(over | [one | two, two, one & two][radius])
    return out


def links_in(keys: np.ndarray, side: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints of the same key, as a spanning forest per key.

    ``keys`` are sorted. Rows with side 0 are compared with all rows of their key, those with side 1
    only with rows of side 0 (they have been compared with each other elsewhere).
    """
    edges = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(edges, len(keys)))
    several = sizes > 1
    edges, sizes = edges[several], sizes[several]
    if not len(edges):
        return fps[:0], fps[:0]
    words = -(-sizes // 64)
    place = np.repeat(np.concatenate([[0], np.cumsum(words * 64)[:-1]]) - edges, sizes)
    rows = np.concatenate([np.arange(a, a + n) for a, n in zip(edges, sizes)])
    lanes = np.zeros(int(words.sum()) * 64, np.uint64)
    lane_row = np.full(len(lanes), -1)
    lanes[place + rows], lane_row[place + rows] = fps[rows], rows
    planes = planes_of(lanes)
    first_word = np.concatenate([[0], np.cumsum(words)[:-1]])
    asked = side[rows] == 0
    query_row = rows[asked]
    group = np.repeat(np.arange(len(edges)), sizes)[asked]
    left, right = [], []
    # queries in slabs, so that the counters stay within the processor's cache
    load = np.cumsum(words[group])
    for a, b in slabs(load, 1 << 16):
        w = words[group[a:b]]
        query = np.repeat(query_row[a:b], w)
        begin = np.repeat(first_word[group[a:b]] - (np.cumsum(w) - w), w)
        word = begin + np.arange(len(query))
        hits = near_lanes(planes, word, fps[query], radius)
        some = np.flatnonzero(hits)
        bits = np.unpackbits(hits[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at, lane = np.nonzero(bits)
        other = lane_row[word[some[at]] * 64 + lane]
        mine = query[some[at]]
        ok = (other >= 0) & (other != mine)
        left.append(mine[ok])
        right.append(other[ok])
    a, b = forest(np.concatenate(left), np.concatenate(right))
    return fps[a], fps[b]


def slabs(load: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose load, given as a running sum, is about ``most``."""
    start = 0
    while start < len(load):
        done = load[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(load, done + most, "right")))
        yield start, end
        start = end


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links: each node with the root of its tree."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
    pairs = [(x, root(x)) for x in parent]
    pairs = [p for p in pairs if p[0] != p[1]]
    return (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))


def near_links(nodes: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(a, b): links between different fingerprints of ``nodes`` (fp), enough to connect all that are near."""
    spark = nodes.sparkSession
    width = 64 // BLOCKS
    block = [F.shiftrightunsigned("fp", width * k).bitwiseAND((1 << width) - 1) for k in range(BLOCKS)]
    pairs = list(combinations(range(BLOCKS), BLOCKS - RADIUS))
    keys = [
        F.struct(
            F.lit(n).alias("pair"),
            reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(block[k], width * i) for i, k in enumerate(p)]).alias("bits"),
        )
        for n, p in enumerate(pairs)
    ]
    keyed = nodes.select("fp", F.inline(F.array(*keys)))
    sizes = keyed.groupBy("pair", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = stage(sizes, "block_sizes")
    # keys shared by several fingerprints, with a tile number; large keys meet tile by tile
    shared = keyed.join(sizes, ["pair", "bits"]).withColumn(
        "tiles", F.ceil(F.col("n") / tile_rows).cast("int")
    )
    tile = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    shared = shared.select("fp", "pair", "bits", "tiles", tile.alias("tile"))
    # pair of tiles (i, j), i <= j, is task i * tiles + j; a row is on side 0 in tile i, on side 1 in tile j > i
    meets = F.transform(
        F.sequence(F.lit(0), F.col("tiles") - 1),
        lambda o: F.struct(
            (F.least("tile", o) * F.col("tiles") + F.greatest("tile", o)).alias("task"),
            F.when(F.col("tile") > o, 1).otherwise(0).alias("side"),
        ),
    )
    rows = shared.select("fp", "pair", "bits", F.inline(meets))
    parts = default_parts(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got)
        fp, pair, bits, task, side = (rows.column(c).to_numpy() for c in ("fp", "pair", "bits", "task", "side"))
        order = np.lexsort((fp, task, bits, pair))
        new = np.zeros(len(order), bool)
        for c in (pair, bits, task):
            c = c[order]
            new[1:] |= c[1:] != c[:-1]
        a, b = links_in(np.cumsum(new), side[order], fp[order].view(np.uint64), radius)
        yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return rows.repartition(parts, "pair", "bits", "task").mapInArrow(run, "a bigint, b bigint")


def near_dedup(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links of at most ``radius`` bits reach."""
    prints = fingerprints(docs, words)
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    named = nodes.where("first IS NOT NULL")
    links = near_links(named.select("fp"), radius)
    # links in terms of the smallest doc_id of each fingerprint, so that labels are doc_ids
    a = named.select(F.col("fp").alias("a"), F.col("first").alias("x"))
    b = named.select(F.col("fp").alias("b"), F.col("first").alias("y"))
    edges = stage(links, "near_links").join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    labels = connected_components(edges)
    of_print = nodes.join(labels, nodes["first"] == labels["node"], "left").select(
        "fp", F.coalesce("label", "first").alias("component_id")
    )
    return prints.join(stage(of_print, "components"), "fp").select("doc_id", "fp", "component_id")
