"""Token ids in plane files: fixed-size blocks of ids, transposed and compressed plane by plane.

A file row is a chunk: the ids of consecutive documents in ascending doc_id order, cut into blocks
of ``BLOCK_IDS``. A block is transposed into 4 byte planes or 32 bit planes, so that the high planes,
which are nearly constant, compress to nothing; each plane is compressed with zstandard. The chunk
index beside it has the documents, their lengths, the chunk's place among the ids, and the size of
every compressed plane, so a reader can fetch one document's blocks without the others. Spark writes
the rows, so a lost executor's files never count.

Defined results: a null text counts as empty and gives the end id alone; documents are in the order
of doc_id with null ids first, those of one doc_id in the order of their texts' hashes, and repeated rows
are kept; an empty table gives no files and an empty result; further columns are not read. Rows are told
apart by their place in the table, so however many share an id and a text they go to several parts; a
table that isn't read from files should be written first. One document's ids must fit into memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from txnlens.llm.tables import held, row_blocks, stage
from txnlens.llm.vocab import WordIds, byte_symbols, is_exotic

BLOCK_IDS = 65_536
PART_BYTES = 128 << 20  # of text in one part, about
PLANES = {"byte": 4, "bit": 32}
LEVEL = 3
FILE_SCHEMA = (
    "part int, seq int, part_start bigint, n_ids bigint, doc_ids array<bigint>, "
    "doc_sizes array<bigint>, plane_sizes array<int>, payload binary"
)


class WordEncoder:
    """The library's encoding, with words that occur again taken from a cache."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        to_symbol = dict(enumerate(byte_symbols()))
        model = self.library.model

        def ids(word: bytes) -> list[int]:
            return [t.id for t in model.tokenize(word.decode("latin-1").translate(to_symbol))]

        self.words = WordIds(ids, space_leads=True)

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [not is_exotic(t) and not any(s in t for s in self.special) for t in texts]
        found = iter(self.words.of_texts([t.encode() for t, p in zip(texts, plain) if p]))
        return [next(found) if p else self.whole(t) for t, p in zip(texts, plain)]

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def encoder(path: str) -> WordEncoder:
    return held((WordEncoder.__name__, path), lambda: WordEncoder(path))


def to_planes(ids: np.ndarray, planes: str) -> tuple[bytes, list[int]]:
    """Compressed planes of all blocks put end to end, and their sizes."""
    squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
    out = []
    for start in range(0, len(ids), BLOCK_IDS):
        block = ids[start : start + BLOCK_IDS].astype("<u4").view(np.uint8).reshape(-1, 4)
        if planes == "byte":
            rows = np.ascontiguousarray(block.T)
        else:
            bits = np.unpackbits(block, axis=1, bitorder="little")
            rows = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
        out += [squeeze(row.tobytes()) for row in rows]
    return b"".join(out), [len(x) for x in out]


def from_planes(payload: bytes, sizes: list[int], n_ids: int, planes: str) -> np.ndarray:
    expand = zstandard.ZstdDecompressor().decompress
    cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
    out = np.empty(n_ids, "<u4")
    per = PLANES[planes]
    view = memoryview(payload)
    for k, start in enumerate(range(0, n_ids, BLOCK_IDS)):
        n = min(BLOCK_IDS, n_ids - start)
        rows = np.stack(
            [
                np.frombuffer(expand(view[cuts[i] : cuts[i + 1]]), np.uint8)
                for i in range(k * per, (k + 1) * per)
            ]
        )
        if planes == "bit":
            bits = np.unpackbits(rows, axis=1, count=n, bitorder="little")
            rows = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").T
        out[start : start + n] = np.ascontiguousarray(rows.T).view("<u4").ravel()
    return out


def write_files(docs: DataFrame, path: str, parts: int, end_id: int, planes: str = "byte") -> DataFrame:
    """Encode, append ``end_id`` to each document, write; returns the files' rows.

    There are ``parts`` parts, or more if these would hold more than ``PART_BYTES`` each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, part = encoder(path), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        start = 0
        for seq, block in enumerate(row_blocks(batches)):
            rows = [ids + end for ids in model.encode(block.column("text").to_pylist())]
            ids = np.frombuffer(b"".join(rows), "<u4")
            payload, sizes = to_planes(ids, planes)
            yield pa.record_batch(
                {
                    "part": pa.array([part], pa.int32()),
                    "seq": pa.array([seq], pa.int32()),
                    "part_start": pa.array([start], pa.int64()),
                    "n_ids": pa.array([len(ids)], pa.int64()),
                    "doc_ids": pa.array([block.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    "doc_sizes": pa.array([[len(r) // 4 for r in rows]], pa.list_(pa.int64())),
                    "plane_sizes": pa.array([sizes], pa.list_(pa.int32())),
                    "payload": pa.array([payload], pa.binary()),
                }
            )
            start += len(ids)

    return stage(ordered(docs, parts).mapInArrow(run, FILE_SCHEMA), "token_planes")


def ordered(docs: DataFrame, parts: int) -> DataFrame:
    """(doc_id, text) in order, in ranges of about equal numbers of rows whatever ids and texts repeat."""
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    keys = ["doc_id", "hash", "place"]  # samples of these go to the driver, no texts
    return (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text)
        .select("*", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place"))
        .repartitionByRange(max(parts, -(-volume // PART_BYTES)), *keys)
        .sortWithinPartitions(*keys)
        .select("doc_id", "text")
    )


def read_files(files: DataFrame, planes: str = "byte") -> DataFrame:
    """doc_id, start, n_tokens, ids of every document, from the files.

    Where a part starts is a running sum over parts: one row for each, as many as were written.
    """
    sums = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.to_pylist():
                ids = from_planes(chunk["payload"], chunk["plane_sizes"], chunk["n_ids"], planes)
                sizes = np.array(chunk["doc_sizes"], np.int64)
                cuts = np.concatenate([[0], np.cumsum(sizes)])
                raw = ids.tobytes()
                spans = zip((cuts * 4).tolist(), (cuts[1:] * 4).tolist())
                yield pa.record_batch(
                    {
                        "doc_id": pa.array(chunk["doc_ids"], pa.int64()),
                        "start": pa.array(cuts[:-1] + chunk["base"], pa.int64()),
                        "n_tokens": pa.array(sizes, pa.int64()),
                        "ids": pa.array([raw[a:b] for a, b in spans], pa.binary()),
                    }
                )

    rows = files.join(F.broadcast(bases), "part").select(
        (F.col("base") + F.col("part_start")).alias("base"),
        "n_ids",
        "doc_ids",
        "doc_sizes",
        "plane_sizes",
        "payload",
    )
    return rows.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
