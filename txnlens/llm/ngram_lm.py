"""Stupid-backoff language-model scores of every document, from counts over all documents.

With n-grams of up to ``order`` words, a word scores the share of its longest n-gram, which ends with
it, among the occurrences of the n-gram's words before it. If that n-gram doesn't occur, BACKOFF times
the score with one word less before it; without words before it that is the word's share of all words,
and if the word doesn't occur either, BACKOFF over the number of words. An n-gram that would start before
its document doesn't occur. Counts are those of all *other* documents: a document's own n-grams are taken
out, else nothing would ever back off.

Documents are packed into blocks of some megabytes, written once in the partitions in which answers meet
them again, so that only requests and answers are shuffled. The most frequent words of a bounded sample of blocks are
numbered. Each block asks for its different n-grams, split by key into as many buckets as the data needs: the key is
made of the numbers if all words have one, else a hash. In a bucket
the blocks' own counts of a key are added up and every request is answered in its own order, so answers carry
no keys; there is no lasting count table. Back at its block, a document's n-grams are
looked up and summed. A frequent n-gram is one request per block, so no bucket is hot.

Defined results: a null or empty text has no words and a null score; repeated rows are documents of
their own; an empty table gives an empty result; further columns are not read. Words are told apart
by 64-bit hashes, n-grams by numbers of words or 63-bit hashes. Which words have numbers doesn't change a result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.llm.tables import default_parts, row_blocks, shared_folder, trim
from txnlens.llm.words import word_codes

BACKOFF = 0.4
ORDER = 3  # words in the longest n-grams of the production run
BUCKET_WORDS = 4_000_000

# The words that get numbers: the most frequent ones of the blocks in the sample, in each of which some are looked at.
SAMPLE_BLOCKS = 64
BLOCK_SAMPLE = 32_768
NUMBERED_WORDS = 1 << 18
WORD_BITS = 20  # of a key
PACKED_WORDS = 3  # in one key, at most
HASHED = np.uint64(1 << 63)  # marks keys that are hashes

BLOCKS = "block bigint, doc_ids array<bigint>, n_words array<bigint>, hashes binary, codes binary, words bigint"


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two hashes, in order."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def squeezed(values: np.ndarray) -> bytes:
    """Integers with all first bytes before all second ones and so on, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expanded(raw: bytes, dtype: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def pack(docs: DataFrame) -> DataFrame:
    """Blocks of documents as word codes, written to the shared folder, partitioned by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for seq, block in enumerate(row_blocks(batches)):
            codes, n_words, hashes = word_codes(block.column("text").to_pylist())
            # frequent words first: most codes are small
            by_count = np.argsort(-np.bincount(codes, minlength=len(hashes)), kind="stable")
            rank = np.empty(len(hashes), np.int64)
            rank[by_count] = np.arange(len(hashes))
            yield pa.record_batch(
                {
                    "block": pa.array([part << 32 | seq], pa.int64()),
                    "doc_ids": pa.array([block.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    "n_words": pa.array([n_words.tolist()], pa.list_(pa.int64())),
                    "hashes": pa.array([hashes[by_count].tobytes()], pa.binary()),
                    "codes": pa.array([squeezed(rank[codes].astype("<u4"))], pa.binary()),
                    "words": pa.array([len(codes)], pa.int64()),
                }
            )

    spark, name = docs.sparkSession, f"lm_blocks_{uuid.uuid4().hex}"
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    spark.sql(
        f"CREATE TABLE {name} ({BLOCKS}) USING parquet CLUSTERED BY (block) INTO {default_parts(spark)} BUCKETS "
        f"LOCATION '{shared_folder(spark).rstrip('/')}/{name}'"
    )
    rows.mapInArrow(run, BLOCKS).write.insertInto(name)
    return spark.table(name)


def numbered_words(blocks: DataFrame, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, number of each): frequent words of some blocks, the most frequent have the smallest numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes, codes in zip(batch.column("hashes").to_pylist(), batch.column("codes").to_pylist()):
                counts = np.bincount(expanded(codes, "<u4"))[:BLOCK_SAMPLE]
                words = np.frombuffer(hashes, np.int64)[: len(counts)]
                yield pa.record_batch({"word": pa.array(words), "n": pa.array(counts, pa.int64())})

    every = max(1, n_blocks // SAMPLE_BLOCKS)
    some = blocks.where(F.pmod(F.xxhash64("block"), F.lit(every)) == 0).select("hashes", "codes")
    counts = some.mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(NUMBERED_WORDS).select("word").toArrow()
    words = top.column("word").to_numpy().view(np.uint64)
    order = np.argsort(words)
    return words[order], order.astype(np.uint64)


class Block:
    """The n-grams of a block: words, and up to ``order`` words in a row within a document.

    ``grams`` has for each n from 1 up (places, n-gram of each place, number of n-grams): the places
    of words that have n - 1 words before them, and which n-gram ends there. ``numbered`` is what
    ``numbered_words`` gives.
    """

    def __init__(self, row: dict, order: int, numbered: tuple[np.ndarray, np.ndarray]):
        self.codes = expanded(row["codes"], "<u4").astype(np.int64)
        self.hashes = np.frombuffer(row["hashes"], np.uint64)
        self.n_words = np.array(row["n_words"], np.int64)
        self.doc = np.repeat(np.arange(len(self.n_words)), self.n_words)
        before = np.arange(len(self.doc)) - np.repeat(np.cumsum(self.n_words) - self.n_words, self.n_words)
        self.grams = [(np.arange(len(self.codes)), self.codes, len(self.hashes))]
        words, numbers = numbered
        at = np.searchsorted(words, self.hashes)
        known = np.append(words, np.uint64(0))[at] == self.hashes
        known &= at < len(words)
        number = np.append(numbers, np.uint64(0))[at]
        named, packed, hashed = known, number, self.hashes  # of n-grams: all words have numbers; both kinds of keys
        keys, counts = [np.where(named, packed, hashed | HASHED)], [np.bincount(self.codes, minlength=len(self.hashes))]
        last = self.codes  # the n-gram that ends at each place
        for n in range(2, order + 1):
            places = np.flatnonzero(before >= n - 1)
            both, gram = np.unique(last[places - 1] << 32 | self.codes[places], return_inverse=True)
            self.grams.append((places, gram, len(both)))
            front, word = both >> 32, both & 0xFFFFFFFF
            hashed = mixed(hashed[front], self.hashes[word])
            named = named[front] & known[word] if n <= PACKED_WORDS else np.zeros(len(both), bool)
            packed = packed[front] << np.uint64(WORD_BITS) | number[word]
            size = np.uint64((n - 1) << PACKED_WORDS * WORD_BITS & (1 << 63) - 1)
            keys.append(np.where(named, size | packed, hashed | HASHED))
            counts.append(np.bincount(gram, minlength=len(both)))
            last = np.zeros(len(self.codes), np.int64)
            last[places] = gram
        # all n-grams of the block, the shortest first
        self.keys, self.counts = np.concatenate(keys), np.concatenate(counts)

    def buckets(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(order, bucket of each n-gram in that order): by bucket, then key."""
        bucket = (mixed(self.keys, np.zeros(1, np.uint64)) >> np.uint64(32)) % np.uint64(n)
        order = np.lexsort((self.keys, bucket))
        return order, bucket[order]


def requests(blocks: DataFrame, buckets: int, ngram_order: int, numbered: Broadcast) -> DataFrame:
    """(bucket, block, keys, counts): what a block asks of each bucket, and how often it has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, ngram_order, numbered.value)
                order, bucket = block.buckets(buckets)
                cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(order))
                if not len(order):
                    continue
                spans = list(zip(cuts.tolist(), cuts[1:].tolist()))
                keys, counts = block.keys[order], block.counts[order]
                # sorted keys as differences: the high bytes are mostly zero
                packed = [squeezed(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in spans]
                yield pa.record_batch(
                    {
                        "bucket": pa.array([int(bucket[a]) for a, _ in spans], pa.int32()),
                        "block": pa.array([row["block"]] * len(spans), pa.int64()),
                        "keys": pa.array(packed, pa.binary()),
                        "counts": pa.array([squeezed(counts[a:b].astype("<u4")) for a, b in spans], pa.binary()),
                    }
                )
        trim()

    return blocks.mapInArrow(run, "bucket int, block bigint, keys binary, counts binary")


def answer(bucket: pa.Table) -> pa.Table:
    """Add up all blocks' counts of each key; give every block the totals of its keys in its order."""
    keys = [np.cumsum(expanded(raw, "<u8"), dtype=np.uint64) for raw in bucket.column("keys").to_pylist()]
    counts = np.concatenate([expanded(c, "<u4") for c in bucket.column("counts").to_pylist()])
    _, place = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(place, weights=counts).astype(np.int64)[place]
    cuts = np.cumsum([0, *map(len, keys)]).tolist()
    return pa.table(
        {
            "block": bucket.column("block"),
            "bucket": bucket.column("bucket"),
            "totals": pa.array([squeezed(totals[a:b].astype("<u8")) for a, b in zip(cuts, cuts[1:])], pa.binary()),
        }
    )


def document_scores(block: Block, totals: np.ndarray, all_words: int) -> np.ndarray:
    """Sum of the log scores of each document's words."""

    def own(items: np.ndarray, docs: np.ndarray, size: int) -> np.ndarray:
        """How often the document at hand has each item."""
        _, place, counts = np.unique(docs * size + items, return_inverse=True, return_counts=True)
        return counts[place]

    others = np.maximum(1, all_words - block.n_words[block.doc])
    score, shorter, start = np.zeros(len(block.doc)), np.zeros(0, np.int64), 0
    for n, (places, gram, size) in enumerate(block.grams, 1):
        there = totals[start : start + size][gram] - own(gram, block.doc[places], max(1, size))
        start += size
        if n == 1:
            score = np.log(np.where(there > 0, there, BACKOFF) / others)
            shorter = there
            continue
        score += np.log(BACKOFF)
        seen = there > 0
        score[places[seen]] = np.log(there[seen] / shorter[places[seen] - 1])
        shorter = np.zeros(len(score), np.int64)
        shorter[places] = there
    return np.bincount(block.doc, weights=score, minlength=len(block.n_words))


def score(docs: DataFrame, bucket_words: int = BUCKET_WORDS, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, log_score: the sum over the document's words, null without words.

    ``order`` is the number of words in the longest n-grams.
    """
    blocks = pack(docs)
    n_blocks, all_words = blocks.agg(F.count("words"), F.coalesce(F.sum("words"), F.lit(0))).first()
    numbered = docs.sparkSession.sparkContext.broadcast(numbered_words(blocks, n_blocks))
    # a word adds an n-gram for each further order
    buckets = max(default_parts(docs.sparkSession), -(-all_words * max(1, order - 1) // bucket_words))
    answers = (
        requests(blocks, buckets, order, numbered)
        .groupBy("bucket")
        .applyInArrow(answer, "block bigint, bucket int, totals binary")
    )

    def finish(own: pa.Table, totals: pa.Table) -> pa.Table:
        row = own.to_pylist()[0]
        block = Block(row, order, numbered.value)
        sent, _ = block.buckets(buckets)
        parts = sorted((r["bucket"], r["totals"]) for r in totals.to_pylist())  # none without words
        counts = np.empty(len(sent), np.int64)
        counts[sent] = np.concatenate([np.zeros(0, np.int64), *(expanded(t, "<u8") for _, t in parts)])
        scores = document_scores(block, counts, all_words).astype(float)  # of no words: integers
        return pa.table(
            {
                "doc_id": pa.array(row["doc_ids"], pa.int64()),
                "n_words": pa.array(block.n_words, pa.int64()),
                "log_score": pa.array(scores, mask=block.n_words == 0),
            }
        )

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        finish, "doc_id bigint, n_words bigint, log_score double"
    )
