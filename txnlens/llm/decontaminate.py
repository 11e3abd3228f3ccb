"""Benchmark decontamination by a distributed positional inverted index.

The index is a table with one row per shard, a block of whole documents of some megabytes (or one
longer document). A shard has the posting list of every term in it: the term's 64-bit hash and its
positions in the shard, where documents lie one after another with a gap of one, so that no phrase
crosses from one to the next. A search runs in each shard by itself: a phrase starts from its rarest
term there and intersects the offset-adjusted lists of the others, rarest first. Nothing is shuffled
and no task holds more than a shard. Test items are sent to all tasks in blocks of ``ITEM_WORDS``
words, one pass over the index for each.

Two words count as the same if their 64-bit hashes are equal. Defined results: null and empty texts
have no words and no hits; repeated rows are documents of their own; items without words are never
found; items that share an id are one item, also those without one, which are named ""; an empty table of either kind gives no hits; further
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlens.llm.tables import release, row_blocks, stage
from txnlens.llm.words import word_codes

WINDOW = 13
ITEM_WORDS = 2_000_000
NO_ID = ""  # name of items without an id
SHARD_BYTES = 3 << 20  # of text

INDEX_SCHEMA = (
    "shard bigint, doc_ids array<bigint>, n_words array<bigint>, terms binary, counts binary, gaps binary"
)
SPANS = "array<struct<item:string,start:bigint,end:bigint>>"
HIT_SCHEMA = f"shard bigint, at int, doc_id bigint, n_words bigint, spans {SPANS}"


def build_index(docs: DataFrame) -> DataFrame:
    """Write the index of all words of all documents to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        part = TaskContext.get().partitionId()
        release()
        for seq, block in enumerate(row_blocks(batches, most=SHARD_BYTES)):
            codes, n_words, hashes = word_codes(block.column("text").to_pylist())
            rank = np.empty(len(hashes), np.int32)
            order = np.argsort(hashes)
            rank[order] = np.arange(len(hashes))
            position = np.arange(len(codes)) + np.repeat(np.arange(len(n_words)), n_words)
            ranks = rank[codes]
            by_term = np.argsort(ranks, kind="stable")
            counts = np.bincount(ranks, minlength=len(hashes))
            lists = position[by_term]
            gaps = np.diff(lists, prepend=0)
            first = np.cumsum(counts) - counts
            gaps[first] = lists[first]
            yield pa.record_batch(
                {
                    "shard": pa.array([part << 32 | seq], pa.int64()),
                    "doc_ids": pa.array([block.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    "n_words": pa.array([n_words.tolist()], pa.list_(pa.int64())),
                    "terms": pa.array([hashes[order].tobytes()], pa.binary()),
                    "counts": pa.array([squeeze(counts.astype("<u4").tobytes())], pa.binary()),
                    "gaps": pa.array([squeeze(gaps.astype("<u4").tobytes())], pa.binary()),
                }
            )
            del block  # and with it the batch that it was cut from

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return stage(rows.mapInArrow(run, INDEX_SCHEMA), "positional_index")


class Shard:
    """The posting lists of one index row."""

    def __init__(self, row: dict):
        expand = zstandard.ZstdDecompressor().decompress
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.counts = np.frombuffer(expand(row["counts"]), "<u4").astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.gaps = np.frombuffer(expand(row["gaps"]), "<u4")
        self.n_words = np.array(row["n_words"], np.int64)
        self.doc_start = np.cumsum(self.n_words + 1) - self.n_words - 1
        self.lists: dict[int, np.ndarray] = {}

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each term in this shard, -1 if it isn't there."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def positions(self, term: int) -> np.ndarray:
        if term not in self.lists:
            a = self.first[term]
            self.lists[term] = np.cumsum(self.gaps[a : a + self.counts[term]], dtype=np.int64)
        return self.lists[term]

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Where the terms stand one after another."""
        rarest = np.argsort(self.counts[terms], kind="stable").tolist()
        at = self.positions(int(terms[rarest[0]])) - rarest[0]
        for k in rarest[1:]:
            if not len(at):
                break
            at = at[contains(self.positions(int(terms[k])), at + k)]
        return at

    def near(self, terms: np.ndarray, slop: int) -> np.ndarray:
        """Positions of the rarest term with every other term at most ``slop`` words away."""
        rarest = np.argsort(self.counts[terms], kind="stable").tolist()
        at = self.positions(int(terms[rarest[0]]))
        doc = np.searchsorted(self.doc_start, at, "right") - 1
        low = np.maximum(at - slop, self.doc_start[doc])
        high = np.minimum(at + slop, self.doc_start[doc] + self.n_words[doc] - 1)
        ok = np.ones(len(at), bool)
        for k in rarest[1:]:
            other = self.positions(int(terms[k]))
            nearest = np.searchsorted(other, low)
            ok &= np.append(other, np.iinfo(np.int64).max)[nearest] <= high
        return at[ok]


def contains(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    return sorted_values[at] == wanted


def item_windows(items: list[tuple[str, bytes]], window: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(words, windows, item number of each window) by the number of words in the windows."""
    by_size: dict[int, tuple[list, list]] = {}
    for number, (_, raw) in enumerate(items):
        hashes = np.frombuffer(raw, np.uint64)
        size = min(window, len(hashes))
        if size:
            rows, owner = by_size.setdefault(size, ([], []))
            rows.append(np.lib.stride_tricks.sliding_window_view(hashes, size))
            owner += [number] * len(rows[-1])
    return [(size, np.concatenate(rows), np.array(owner)) for size, (rows, owner) in by_size.items()]


def hashed_items(items: DataFrame) -> DataFrame:
    """(item, hashes, n) of items with words: the 64-bit hashes of their words in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for block in row_blocks(batches):
            codes, counts, hashes = word_codes(block.column("text").to_pylist())
            raw, ends = hashes[codes].tobytes(), np.cumsum(counts).tolist()
            rows = [raw[8 * (e - n) : 8 * e] for e, n in zip(ends, counts.tolist())]
            yield pa.record_batch(
                [block.column("item"), pa.array(rows, pa.binary()), pa.array(counts, pa.int64())],
                ["item", "hashes", "n"],
            )

    name = F.coalesce(F.col("item_id").cast("string"), F.lit(NO_ID))
    rows = items.select(name.alias("item"), F.col("text").cast("binary").alias("text"))
    return stage(rows.mapInArrow(run, "item string, hashes binary, n bigint"), "items").where("n > 0")


def item_blocks(items: DataFrame, most: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items in blocks of about ``most`` words; only one block is on the driver at a time."""
    total = items.agg(F.sum("n")).first()[0] or 0
    blocks = -(-total // most)
    for k in range(blocks):
        here = items.where(F.pmod(F.xxhash64("item", "hashes"), F.lit(blocks)) == k)
        yield [(r["item"], r["hashes"]) for r in here.select("item", "hashes").toLocalIterator()]


def phrase_hits(index: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = ITEM_WORDS) -> DataFrame:
    """One row per indexed document: shard, at, doc_id, n_words, spans.

    ``spans`` are the stretches of words (end exclusive) that windows of an item cover.
    """
    hashed = hashed_items(items)
    passes = [search(index, block, window) for block in item_blocks(hashed, block_words)]
    if not passes:
        passes = [search(index, [], window)]
    found = passes[0]
    if len(passes) > 1:
        for other in passes[1:]:
            found = found.unionByName(other)
        found = found.groupBy("shard", "at").agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_words").alias("n_words"),
            F.flatten(F.collect_list("spans")).alias("spans"),
        )
    return found


def search(index: DataFrame, items: list[tuple[str, bytes]], window: int) -> DataFrame:
    sent = index.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [name for name, _ in sent.value]
        groups = item_windows(sent.value, window)
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                spans: list[list[dict]] = [[] for _ in row["doc_ids"]]
                for doc, item, start, end in shard_spans(shard, groups):
                    spans[doc].append({"item": names[item], "start": start, "end": end})
                yield pa.record_batch(
                    {
                        "shard": pa.array([row["shard"]] * len(spans), pa.int64()),
                        "at": pa.array(range(len(spans)), pa.int32()),
                        "doc_id": pa.array(row["doc_ids"], pa.int64()),
                        "n_words": pa.array(row["n_words"], pa.int64()),
                        "spans": pa.array(
                            spans,
                            pa.list_(pa.struct({"item": pa.string(), "start": pa.int64(), "end": pa.int64()})),
                        ),
                    }
                )

    return index.mapInArrow(run, HIT_SCHEMA)


def shard_spans(shard: Shard, groups: list) -> Iterator[tuple[int, int, int, int]]:
    """(document in the shard, item, start, end) of what each item's windows cover together."""
    for size, windows, owner in groups:
        terms = shard.find(windows.ravel()).reshape(windows.shape)
        hits: dict[int, list[np.ndarray]] = {}
        for k in np.flatnonzero((terms >= 0).all(axis=1)).tolist():
            at = shard.phrase(terms[k])
            if len(at):
                hits.setdefault(int(owner[k]), []).append(at)
        for item, lists in hits.items():
            at = np.unique(np.concatenate(lists))
            new = np.flatnonzero(np.append(True, np.diff(at) > size))
            starts, ends = at[new], at[np.append(new[1:], len(at)) - 1] + size
            docs = np.searchsorted(shard.doc_start, starts, "right") - 1
            base = shard.doc_start[docs]
            yield from zip(docs.tolist(), [item] * len(docs), (starts - base).tolist(), (ends - base).tolist())


def proximity_hits(index: DataFrame, items: DataFrame, slop: int, block_words: int = ITEM_WORDS) -> DataFrame:
    """(doc_id, item, at): words of documents that have all words of an item within ``slop`` words.

    ``at`` is the place of the item's rarest word in the shard.
    """
    out = None
    for block in item_blocks(hashed_items(items), block_words):
        sent = index.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    shard, rows = Shard(row), []
                    for name, raw in sent.value:
                        terms = shard.find(np.unique(np.frombuffer(raw, np.uint64)))
                        at = shard.near(terms, slop) if (terms >= 0).all() else []
                        if len(at):
                            docs = np.searchsorted(shard.doc_start, at, "right") - 1
                            places = (at - shard.doc_start[docs]).tolist()
                            rows += [(row["doc_ids"][d], name, p) for d, p in zip(docs.tolist(), places)]
                    ids, names, places = zip(*rows) if rows else ((), (), ())
                    yield pa.record_batch(
                        [pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(places, pa.int64())],
                        ["doc_id", "item", "at"],
                    )

        found = index.mapInArrow(run, "doc_id bigint, item string, at bigint")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return index.sparkSession.createDataFrame([], "doc_id bigint, item string, at bigint")
    return out


def covered(spans: Column) -> Column:
    """How many words the spans cover together."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"], s["end"])))
    zero = F.lit(0).cast("bigint")
    return F.aggregate(
        ordered,
        F.struct(zero.alias("n"), zero.alias("to")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(zero, x["end"] - F.greatest(x["start"], s["to"]))).alias("n"),
            F.greatest(s["to"], x["end"]).alias("to"),
        ),
        lambda s: s["n"],
    )


def judged(hits: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, items, contaminated: hit words make up a twentieth or more."""
    items = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["item"])))
    return hits.select("doc_id", "n_words", covered(F.col("spans")).alias("n_hit"), items.alias("items")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    )


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    return judged(phrase_hits(build_index(docs), items))
