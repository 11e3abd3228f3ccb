"""The numbered queries against SQL, and the pipeline against a brute-force version."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from test_corpus import brute_hits
from test_similar import brute_lines, brute_print, roots
from tools.check import TABLES, frame_text
from txnlens.llm.queries import QUERIES, WORD_BPE
from txnlens.llm.sql import SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == [*range(1, 14)]
    assert {*QUERIES, "pipeline"} <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    ours = frame_text(QUERIES[name](spark, SF).toPandas())
    theirs = frame_text(db.execute(SQL[name]).df())
    assert list(ours.columns) == list(theirs.columns)
    assert ours.equals(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"op11_best_fit_packing"}))
def test_one_row_for_each_document(spark, db, name):
    ids = [r[0] for r in db.execute("SELECT doc_id FROM documents ORDER BY 1").fetchall()]
    assert sorted(r["doc_id"] for r in QUERIES[name](spark, SF).select("doc_id").collect()) == ids


def test_pieces_of_each_document(spark, db):
    """op11: whole documents with the ids and the sums that the library gives, and few sequences."""
    library = Tokenizer.from_file(WORD_BPE)
    library.no_truncation()
    want = []
    for doc, text in db.execute("SELECT doc_id, text FROM documents").fetchall():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            own = np.array(ids[start : start + 4096], "<u4").tobytes()
            want.append((doc, piece, start, len(own) // 4, zlib.crc32(own)))
    rows = QUERIES["op11_best_fit_packing"](spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    held = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == held.get(r.sequence_id, 0)
        held[r.sequence_id] = r.offset + r.length
    assert max(held.values()) <= 4096 and len(held) <= 1 + -(-sum(w[3] for w in want) // 4096)


def brute_pipeline(docs, items):
    docs = [(d, t) for d, t in docs if any(c.isalpha() for c in t or "")]
    kept = brute_lines(docs)
    docs = [(d, kept[d][0]) for d, _ in docs]
    prints = {d: brute_print(t) for d, t in docs}
    ids = sorted(prints)
    near = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2]
    label = roots(ids, near)
    docs = [(d, t) for d, t in docs if label[d] == d]
    bad = {r[0] for r in brute_hits(docs, items, 13) if r[4]}
    library = Tokenizer.from_file(WORD_BPE)
    out = {}
    for d, t in docs:
        if d not in bad:
            ids = library.encode(t or "", add_special_tokens=False).ids
            text = library.decode(ids, skip_special_tokens=False)
            out[d] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    return out


def test_pipeline_against_brute_force(spark, db, documents, tmp_path):
    docs = db.execute("SELECT doc_id, text, lang FROM documents WHERE doc_id < 120 AND length(text) < 4000").fetchall()
    items = db.execute("SELECT item_id, text FROM benchmark").fetchall()
    docs += [(1001, None, None), (1002, "", "en"), (1003, "12 34", "en"), (1004, docs[0][1], "en"), (1005, items[0][1], "en"), (1006, "no lang here", None)]
    frame = documents(docs)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == brute_pipeline([d[:2] for d in docs], items)
    for _, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, frame, str(tmp_path)).columns == frame.columns


def test_pipeline_of_nothing(spark, documents):
    docs = documents([])
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, SF)
    assert docs.collect() == []
