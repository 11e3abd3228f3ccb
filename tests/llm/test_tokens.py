"""BPE by backtracking and token plane files, against the library."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from txnlens.llm import bpe, token_planes
from txnlens.llm.queries import BYTE_BPE, WORD_BPE

rng = random.Random(1)
POOL = [chr(c) for c in range(0x250)] + [chr(c) for c in (0x300, 0x301, 0x3A3, 0x4E2D, 0x1F600, 0x2028, 0x3000, 0x378, 0xE000)]
TEXTS = ["".join(rng.choices(POOL, k=rng.randint(0, 30))) for _ in range(3000)]
TEXTS += ["".join(rng.choices("abcdeinthr'sELLvm \n\t0é", k=rng.randint(0, 150))) for _ in range(2000)]
TEXTS += ["", " ", "x<|endoftext|>y<|startoftext|>", "it's we'll 'sS ''s 're\n'd", "a" * 5000, "thethe" * 900, "\x85 \xa0a", "Ⱥ İstanbul ΣΑΣ"]


def packed(ids):
    return np.array(ids, "<u4").tobytes()


@pytest.mark.parametrize("name, make", [(WORD_BPE, bpe.BpeEncoder), (BYTE_BPE, token_planes.WordEncoder)])
def test_ids_equal_the_library(name, make):
    library, ours = Tokenizer.from_file(name), make(name)
    want = [packed(e.ids) for e in library.encode_batch(TEXTS, add_special_tokens=False)]
    assert ours.encode(TEXTS) == want
    assert [ours.encode([t])[0] for t in TEXTS[-300:]] == want[-300:]


def test_decoded_text_equals_the_library(documents, by_doc):
    library = Tokenizer.from_file(WORD_BPE)
    rows = [*enumerate(TEXTS[-400:]), (1000, None), (1001, "w" * 60_000), (1001, "again"), (None, "no id")]
    got = by_doc(bpe.with_digests(bpe.decode(bpe.encode(documents(rows), WORD_BPE), WORD_BPE)))
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        match = [r for r in got[doc] if bytes(r["ids"]) == packed(ids)]
        assert match and match[0]["n_tokens"] == len(ids)
        assert match[0]["text"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(documents([]), WORD_BPE).collect() == []


def test_encoder_equals_merging_by_rank():
    """A small vocabulary in which longest matches are often wrong."""
    ours = bpe.BpeEncoder(WORD_BPE)
    library = Tokenizer.from_file(WORD_BPE)
    local = random.Random(9)
    for _ in range(2000):
        word = "".join(local.choices("aeinorst", k=local.randint(1, 40)))
        assert ours.word_ids(word.encode()) == library.encode(word, add_special_tokens=False).ids


@pytest.mark.parametrize("planes", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 65_536, 150_001])
def test_planes_round_trip(planes, n):
    ids = np.random.default_rng(n).integers(0, 2**32 if n == 7 else 50_257, n).astype("<u4")
    payload, sizes = token_planes.to_planes(ids, planes)
    assert len(sizes) == -(-n // token_planes.BLOCK_IDS) * token_planes.PLANES[planes]
    assert (token_planes.from_planes(payload, sizes, n, planes) == ids).all()


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_files_keep_order_and_ids(documents, planes):
    library = Tokenizer.from_file(BYTE_BPE)
    rows = [*enumerate(TEXTS[-500:]), (600, None), (601, "long " * 50_000), (602, "dup"), (602, "dup"), (None, "first")]
    files = token_planes.write_files(documents(rows), BYTE_BPE, 4, 0, planes)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in token_planes.read_files(files, planes).collect())
    start = 0
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for (doc, text), (at, id_, n, ids) in zip(ordered, got, strict=True):
        want = packed([*library.encode(text or "", add_special_tokens=False).ids, 0])
        assert (at, id_, n, zlib.crc32(ids)) == (start, doc, len(want) // 4, zlib.crc32(want))
        start += n


def test_parts_are_even_whatever_repeats(spark, monkeypatch):
    rows = spark.range(30_000).selectExpr(
        "if(id % 3 = 0, NULL, if(id % 3 = 1, 7, id)) AS doc_id", "if(id % 6 = 0, '', if(id % 6 = 1, 'again', concat('t', id))) AS text"
    )
    sizes = [r["count"] for r in token_planes.ordered(rows, 8).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 30_000 and len(sizes) == 8 and max(sizes) < 2 * 30_000 / 8
    monkeypatch.setattr(token_planes, "PART_BYTES", 4_000)
    assert token_planes.ordered(rows, 1).rdd.getNumPartitions() > 20


def test_files_with_repeated_rows(documents):
    rows = [(None, "")] * 40 + [(None, "x y")] * 40 + [(5, "x y")] * 40 + [(6, None), (4, "z")]
    files = token_planes.write_files(documents(rows), BYTE_BPE, 6, 0)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in token_planes.read_files(files).collect())
    assert [d for _, d, _ in got] == [None] * 80 + [4] + [5] * 40 + [6]
    assert [s for s, _, _ in got] == [sum(n for _, _, n in got[:i]) for i in range(len(got))]


def test_no_documents(documents):
    assert token_planes.read_files(token_planes.write_files(documents([]), BYTE_BPE, 2, 0)).collect() == []
