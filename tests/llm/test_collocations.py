"""Phrases against counts of all phrases, and the graph against its definition."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from txnlens.llm import collocations


def pieces_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in (re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower)) if w]


def brute(docs, least, top=2000):
    counts = {}
    for _, text, lang in docs:
        own = counts.setdefault(lang or "und", Counter())
        for words in pieces_of(text):
            for k in (1, 2, 3):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        covered = {g[i : i + 2] for g, c in f.items() if len(g) == 3 and c >= least for i in (0, 1) if 2 * c >= f[g[i : i + 2]]}
        rows = []
        for g, a in f.items():
            if len(g) > 1 and a >= least and g not in covered:
                score, _, left, right = min((10**6 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
                rows.append((lang, " ".join(g), a, left, right, n, score))
        rows.sort(key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(r[0], i, *r[1:]) for i, r in enumerate(rows[:top], 1)]
    return sorted(out)


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "ça", "x\x00y", "Été", "日本", *(f"w{i}" for i in range(12))]
    fixed = ["once upon a time in the west", "of the of the of", "aa aa aa aa aa", "p q r s t u v"]
    docs = []
    for i in range(n):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 9))) if rng.random() < 0.6 else rng.choice(fixed) for _ in range(12)]
        text = "".join(p + rng.choice([". ", ", ", "\n", "\t", " ", "!?", "\x0b", "  "]) for p in parts)
        docs.append((i, text, rng.choice(["en", "fr", None, "und"])))
    return docs + [(None, None, "en"), (5, "", "de"), (5, docs[0][1], "en"), (6, "... ,,, ", "nl")]


def found(df):
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r[c] for c in names) for r in df.collect())


@pytest.mark.parametrize("seed, least", [(1, 10), (2, 3), (3, 2)])
def test_against_all_counts(documents, seed, least):
    docs = corpus(seed)
    want = brute(docs, least)
    assert found(collocations.mine(documents(docs), least)) == want and len(want) > 30
    assert found(collocations.mine(documents(docs), least, top=4)) == brute(docs, least, 4)


def test_hot_words_are_dealt_in_parts(documents, monkeypatch):
    """With tiny tasks nearly every word and pair is hot, and sums of many tasks are added."""
    monkeypatch.setattr(collocations, "TASK_BYTES", 400)
    monkeypatch.setattr(collocations, "MERGE_EDGES", 50)
    docs = corpus(4)
    assert len(collocations.hot_words(collocations_docs := documents(docs), 0, 60)[1]) > 5
    assert found(collocations.mine(collocations_docs, 3)) == brute(docs, 3)


def test_words_with_one_hash_are_counted_again(documents, monkeypatch):
    """A second word under a phrase's hash: the next hashes are taken."""
    vocabulary, seeds = collocations.vocabulary, []

    def clash(docs, needed, seed):
        words, totals = vocabulary(docs, needed, seed)
        seeds.append(seed)
        other = words.where("word = 'two'").withColumn("word", F.lit("twice"))
        return (words.unionByName(other) if seed == 0 else words), totals

    monkeypatch.setattr(collocations, "vocabulary", clash)
    docs = [(i, "one two three. four five", "en") for i in range(12)]
    assert found(collocations.mine(documents(docs), 10)) == brute(docs, 10)
    assert seeds == [0, 1]
    block = pa.record_batch({"text": pa.array([b"one two"] * 2), "lang": pa.array(["en", "fr"])})
    names = [collocations.names_of(collocations.words_of(block), seed).tolist() for seed in (0, 1)]
    assert len(set(names[0] + names[1])) == 8 and min(names[0] + names[1]) > 0


def test_nothing(documents):
    assert found(collocations.mine(documents([]))) == []
    assert found(collocations.mine(documents([(1, None, None), (2, "a b", "en")]))) == []


def test_paths_and_flow(documents):
    """A phrase that always occurs whole is one path; a ring has no start and stays in single edges."""
    docs = [(i, "alpha beta gamma delta epsilon. " + "x y z " * 4, "en") for i in range(10)]
    table = collocations.phrase_table(documents(docs), 10)
    word = {r["name"]: r["word"] for r in table.words.collect()}
    paths = {" ".join(word[w] for w in r["names"]): r["n"] for r in table.paths.collect()}
    assert paths["alpha beta gamma delta epsilon"] == 10
    counts = {(word[r.x], word[r.y]): r.n for r in collocations.pairs(table.paths, table.nodes).collect()}
    assert counts == {("alpha", "beta"): 10, ("beta", "gamma"): 10, ("gamma", "delta"): 10, ("delta", "epsilon"): 10,
                      ("x", "y"): 40, ("y", "z"): 40, ("z", "x"): 30}
    threes = {(word[r.x], word[r.y], word[r.z]): r.n for r in collocations.triples(table.paths).collect()}
    assert threes[("x", "y", "z")] == 40 and threes[("y", "z", "x")] == threes[("z", "x", "y")] == 30 and len(threes) == 6


def test_a_ring_of_equal_edges(spark):
    """Three edges that go round with the same weight, beside a chain of four."""
    ring = [(1, 2, 3), (2, 3, 1), (3, 1, 2)]
    chain = [(10, 11, 12), (11, 12, 13), (12, 13, 14), (13, 14, 15)]
    nodes = {(a, b) for e in ring + chain for a, b in (e[:2], e[1:])}
    rows = [(2, x, y, 0, 20) for x, y in nodes] + [(3, *e, 20) for e in ring + chain]
    grams = spark.createDataFrame(rows, "size int, x bigint, y bigint, z bigint, n bigint")
    paths, rest = collocations.compact(grams)
    assert sorted(r["names"] for r in paths.collect()) == [[1, 2, 3], [2, 3, 1], [3, 1, 2], [10, 11, 12, 13, 14, 15]]
    assert {(r.x, r.y) for r in rest.collect()} == {(10, 11), (14, 15)}
    assert collocations.triples(paths).where(F.col("n") == 20).count() == 7
