"""Best-fit packing of documents into sequences of fixed length by large-item matching.

Every document is encoded, closed with an end id, and cut only where it is longer than a sequence. How
the pieces are placed depends on their lengths alone, and there are no more lengths than a sequence has
tokens. So the driver plans from one count for each length: pieces above a third of a sequence, of which at
most two fit into one, are matched greedily, the longest with the longest that fits beside it, which
leaves as few of them alone as possible; shorter ones go, longest first, into the smallest gap that takes
them, and new sequences are opened when no gap does. The plan says for runs of equal pieces (by their number
among the pieces of that length) in which sequence and where they lie. Its rows are bounded by the
length of a sequence: a run of gaps at least halves when a length has been put in, so it is met a logarithmic
number of times.

Tasks number their own pieces within each length, the counts of earlier tasks are added, and each piece
finds its place by a search in the plan. One shuffle brings the pieces of a sequence together.

Defined results: a null text counts as empty and gives the end id alone; rows that share a doc_id, or have
none, are documents of their own; an empty table gives no sequences; further columns are not read. One
document's ids must fit into memory.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from txnlens.llm.bpe import WORDS, BpeEncoder, is_space
from txnlens.llm.tables import default_parts, held, row_blocks, stage
from txnlens.llm.vocab import WordIds, byte_symbols

CAPACITY = 4096

# Counts by task and length are sent to all tasks up to this many rows; beyond, they are joined by shuffle.
BROADCAST_ROWS = 1_000_000

# Tokens of the sequences that one task puts together.
TASK_TOKENS = 16_000_000

BLOCK_BYTES = 4 << 20

PIECES = "doc_id bigint, piece int, start bigint, length int, ids binary, part int, nth bigint"
SEQUENCES = (
    "sequence_id bigint, ids binary, pieces array<struct<doc_id:bigint,piece:int,start:bigint,length:int,offset:bigint>>"
)


class LibraryEncoder(BpeEncoder):
    """The library's ids of whole texts; words that occur again are taken from a cache."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != WORDS:
            raise ValueError("the words of this tokenizer are cut by another pattern")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        marks = sorted(map(regex.escape, self.special), key=len, reverse=True)
        self.marks = regex.compile(f"({'|'.join(marks)})") if marks else None
        self.byte_of = {c: b for b, c in enumerate(byte_symbols())}
        self.symbol_of = dict(enumerate(byte_symbols()))
        self.model = self.library.model
        self.words = WordIds(self.word_ids, space_leads=False)

    def word_ids(self, word: bytes) -> list[int]:
        if is_space(word):
            return []
        return [t.id for t in self.model.tokenize(word.decode("latin-1").translate(self.symbol_of))]


def encoder(path: str) -> LibraryEncoder:
    return held((LibraryEncoder.__name__, path), lambda: LibraryEncoder(path))


def squeezed(ids: np.ndarray) -> bytes:
    """Ids as compressed byte planes; the high planes are nearly constant."""
    planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expanded(data: bytes) -> bytes:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).tobytes()


def cut(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """The pieces of all documents, written: their ids, compressed, and a number among the task's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, part = encoder(path), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        seen = np.zeros(capacity + 1, np.int64)
        for block in row_blocks(batches, most=BLOCK_BYTES):
            rows: list[tuple] = []
            texts = block.column("text").to_pylist()
            for doc_id, raw in zip(block.column("doc_id").to_pylist(), model.encode(texts)):
                ids = np.frombuffer(raw + end, "<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start : start + capacity]
                    rows.append((doc_id, piece, start, len(own), squeezed(own), part, int(seen[len(own)])))
                    seen[len(own)] += 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids", "part", "nth"]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text)
    return stage(rows.mapInArrow(run, PIECES), "pieces")


class Plan:
    """Where runs of equal pieces go.

    Row (length, first, n, per, sequence, offset): of the pieces of this length, the n from number ``first``
    on go into sequences from ``sequence`` on, ``per`` into each, from ``offset`` on.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {length: n for length, n in counts.items() if n}
        self.used = dict.fromkeys(self.left, 0)
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0
        self.gaps: list[int] = []  # sizes of the gaps there are, ascending
        self.runs: dict[int, list[tuple[int, int]]] = {}  # (first sequence, n) by size of the gap
        self.match([x for x in sorted(self.left) if 3 * x > capacity])
        self.fill([x for x in sorted(self.left, reverse=True) if 3 * x <= capacity])

    def put(self, length: int, n: int, per: int, sequence: int, offset: int) -> None:
        self.rows.append((length, self.used[length], n, per, sequence, offset))
        self.used[length] += n
        self.left[length] -= n

    def open_gap(self, gap: int, sequence: int, n: int) -> None:
        if gap and n:
            if not self.runs.get(gap):
                insort(self.gaps, gap)
            self.runs.setdefault(gap, []).append((sequence, n))

    def match(self, large: list[int]) -> None:
        """Pair the longest with the longest that fits beside it."""
        while large:
            length = large[-1]
            if not self.left[length]:
                large.pop()
                continue
            most = min(length if self.left[length] > 1 else length - 1, self.capacity - length)
            at = bisect_right(large, most) - 1
            mate = large[at] if at >= 0 else 0
            if mate == length:
                n = self.left[length] // 2
            else:
                n = min(self.left[length], self.left[mate]) if mate else self.left[length]
            self.put(length, n, 1, self.sequences, 0)
            if mate:
                self.put(mate, n, 1, self.sequences, length)
                if not self.left[mate] and mate != length:
                    del large[at]
            self.open_gap(self.capacity - length - mate, self.sequences, n)
            self.sequences += n

    def fill(self, small: list[int]) -> None:
        """Put the longest first, each into the smallest gap that takes it."""
        for length in small:
            while n := self.left[length]:
                at = bisect_left(self.gaps, length)
                if at == len(self.gaps):
                    fresh = -(-n // (self.capacity // length))
                    self.open_gap(self.capacity, self.sequences, fresh)
                    self.sequences += fresh
                    continue
                gap = self.gaps[at]
                first, there = self.runs[gap].pop()
                if not self.runs[gap]:
                    del self.gaps[at]
                per = gap // length
                full = min(there, n // per)
                offset = self.capacity - gap
                if full:
                    self.put(length, full * per, per, first, offset)
                    self.open_gap(gap - per * length, first, full)
                if full < there:  # the rest of the pieces goes into one sequence
                    if rest := n - full * per:
                        self.put(length, rest, rest, first + full, offset)
                        self.open_gap(gap - rest * length, first + full, 1)
                    kept = full + bool(rest)
                    self.open_gap(gap, first + kept, there - kept)

    def arrays(self) -> np.ndarray:
        """Rows by length, then by the number of the first piece."""
        return np.array(sorted(self.rows), np.int64).reshape(-1, 6)


def places(plan: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of the pieces with these lengths and numbers."""
    starts = np.searchsorted(plan[:, 0], np.arange(plan[:, 0].max(initial=0) + 2))
    at = np.empty(len(length), np.int64)
    order = np.argsort(length, kind="stable")
    cuts = np.flatnonzero(np.diff(length[order], prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        own = order[a:b]
        low, high = starts[length[own[0]]], starts[length[own[0]] + 1]
        at[own] = low + np.searchsorted(plan[low:high, 1], rank[own], "right") - 1
    rows = plan[at]
    nth = rank - rows[:, 1]
    return rows[:, 4] + nth // rows[:, 3], rows[:, 5] + nth % rows[:, 3] * length


def placed(pieces: DataFrame, capacity: int) -> DataFrame:
    """The pieces with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = stage(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece_counts")
    plan = Plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    sent = spark.sparkContext.broadcast(plan.arrays())
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    if counts.count() <= BROADCAST_ROWS:
        bases = F.broadcast(bases)
    names = ["doc_id", "piece", "start", "length", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                length = batch.column("length").to_numpy().astype(np.int64)
                sequence, offset = places(sent.value, length, batch.column("rank").to_numpy())
                yield pa.record_batch(
                    [*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"]
                )

    ranked = pieces.join(bases, ["part", "length"]).select(*names, (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(
        run, "doc_id bigint, piece int, start bigint, length int, ids binary, sequence_id bigint, offset bigint"
    )


def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Put together the sequences of rows sorted by (sequence_id, offset)."""
    kept: list[dict] = []

    def sequences(rows: list[dict]) -> pa.RecordBatch:
        out: list[list] = [[], [], []]
        for row in rows:
            if not out[0] or out[0][-1] != row["sequence_id"]:
                for column, value in zip(out, (row["sequence_id"], [], [])):
                    column.append(value)
            out[1][-1].append(expanded(row["ids"]))
            out[2][-1].append({k: row[k] for k in ("doc_id", "piece", "start", "length", "offset")})
        fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("offset", pa.int64())]
        return pa.record_batch(
            [pa.array(out[0], pa.int64()), pa.array([b"".join(x) for x in out[1]], pa.binary()), pa.array(out[2], pa.list_(pa.struct(fields)))],
            ["sequence_id", "ids", "pieces"],
        )

    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            rows = kept + batch.slice(start, 1024).to_pylist()
            last = next((i for i in range(len(rows) - 1, 0, -1) if rows[i]["sequence_id"] != rows[i - 1]["sequence_id"]), 0)
            kept = rows[last:]
            if last:
                yield sequences(rows[:last])
    if kept:
        yield sequences(kept)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """sequence_id, its ids as little-endian unsigned 32-bit integers, and the pieces that lie in it in order."""
    pieces = cut(docs, path, capacity, end_id)
    tokens = pieces.agg(F.sum(F.col("length").cast("bigint"))).first()[0] or 0
    tasks = max(default_parts(docs.sparkSession), -(-tokens // TASK_TOKENS))
    rows = placed(pieces, capacity).repartition(tasks, "sequence_id").sortWithinPartitions("sequence_id", "offset")
    return rows.mapInArrow(assemble, SEQUENCES)
