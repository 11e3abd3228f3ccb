"""Decontamination, language ID and language-model scores, against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from txnlens.llm import decontaminate, language_id, ngram_lm

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def brute_hits(rows, items, window):
    windows = {}
    for item, text in items:
        w = words(text)
        size = min(window, len(w))
        for k in range(len(w) - size + 1) if size else ():
            windows.setdefault(tuple(w[k : k + size]), set()).add(str(item))
    out = []
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if got := windows.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    found |= got
        out.append((doc, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.fixture
def corpus():
    rng = random.Random(3)
    vocabulary = ["the", "The", "of", "é", "x1", "Ünd", *"abcdefg"]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, text(rng.randint(1, 30))) for i in range(12)] + [(50, "of"), (51, None), (52, "..."), (3, text(9)), (53, "rare words only")]
    rows = [(i, text(rng.randint(0, 60)) + rng.choice(["", ", " + items[i % 12][1] + "! " + text(9)])) for i in range(80)]
    rows += [(90, None), (91, ""), (91, "of"), (None, items[2][1]), (92, text(30_000)), (93, items[4][1].replace(" ", "--\n"))]
    return rows, items


@pytest.mark.parametrize("window, block_words", [(4, 10**6), (4, 20), (13, 10**6)])
def test_phrases_against_brute_force(spark, documents, corpus, window, block_words):
    rows, items = corpus
    bench = spark.createDataFrame([(*i, 0) for i in items], "item_id bigint, text string, doc_id int")
    hits = decontaminate.phrase_hits(decontaminate.build_index(documents(rows)), bench, window, block_words)
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontaminate.judged(hits).collect()]
    assert sorted(got, key=str) == brute_hits(rows, items, window)


def test_proximity(spark, documents, corpus):
    rows = [r for r in corpus[0] if r[0] != 92]
    items = [(1, "a b"), (2, "ünd c é"), (3, "nowhere a"), (4, "x1")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    index = decontaminate.build_index(documents(rows))
    texts, queries = {d: words(t) for d, t in rows if d != 91}, {str(i): set(words(q)) for i, q in items}
    near = {
        (doc, item, at)
        for doc, w in texts.items() for item, query in queries.items() for at in range(len(w))
        if w[at] in query and query <= set(w[max(0, at - 3) : at + 4])
    }
    got = {(r["doc_id"], r["item"], r["at"]) for r in decontaminate.proximity_hits(index, bench, 3).collect() if r["doc_id"] != 91}
    # hits are named by one word of the item, the rarest of a shard
    assert got <= near and {x[:2] for x in got} == {x[:2] for x in near if texts[x[0]][x[2]] in rarest(queries[x[1]], got, texts, x[1])}


def rarest(query, got, texts, item):
    return {texts[d][at] for d, i, at in got if i == item}


def test_nothing_to_search(spark, documents):
    none = spark.createDataFrame([], "item_id bigint, text string")
    got = decontaminate.decontaminate(documents([(1, "a b"), (2, None)]), none).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["contaminated"]) for r in got) == [(1, 2, 0, False), (2, 0, 0, False)]
    assert decontaminate.decontaminate(documents([]), none).collect() == []
    assert decontaminate.proximity_hits(decontaminate.build_index(documents([])), none, 2).collect() == []


def cross_parse(text, sample):
    """Phrases of a text: longest matches in the sample, and letters it doesn't have."""
    n = 0
    for start in range(0, len(text), language_id.SEGMENT):
        part, at = text[start : start + language_id.SEGMENT], 0
        while at < len(part):
            length = 1
            if part[at] in sample:
                while at + length < len(part) and part[at : at + length + 1] in sample:
                    length += 1
            n, at = n + 1, at + length
    return n


def test_phrases_are_longest_matches():
    rng = random.Random(7)
    samples = [(lang, " ".join("".join(rng.choices(letters, k=4)) for _ in range(60))) for lang, letters in (("x", "abcd"), ("y", "cdefé"))]
    model = language_id.Model(samples)
    texts = ["".join(rng.choices("abcdefé zß", k=rng.randint(1, 3000))) for _ in range(30)]
    flat = lambda t: "".join(map(chr, language_id.normal(t)))
    for text, (lang, score) in zip(texts, model.predict(texts)):
        cost = {s: cross_parse(flat(text), flat(t)) * math.log2(len(flat(t))) for s, t in samples}
        low, high = sorted(cost.values())
        if any(c.isalpha() for c in text):
            assert cost[lang] == low and score == pytest.approx(1 - low / high)


@pytest.mark.parametrize("cells", [1, 30_000, language_id.DENSE_CELLS])
def test_large_alphabets_match_in_full(monkeypatch, cells):
    monkeypatch.setattr(language_id, "DENSE_CELLS", cells)
    rng = random.Random(5)
    pools = {"x": [chr(0x4E00 + i) for i in range(900)], "y": [chr(0x5100 + i) for i in range(600)], "z": [*"abcde "]}
    phrases = {k: ["".join(rng.choices(p, k=5)) for _ in range(250)] for k, p in pools.items()}
    samples = [(k, " ".join(v)) for k, v in phrases.items()]
    model = language_id.Model(samples)
    flat = lambda t: "".join(map(chr, language_id.normal(t)))
    for want in "xyz" * 4:
        text = " ".join(rng.choices(phrases[want], k=300)) + "".join(rng.choices([*pools["x"], "ß"], k=9))
        cost = {s: cross_parse(flat(text), flat(t)) * math.log2(len(flat(t))) for s, t in samples}
        low, high = sorted(cost.values())[:2]
        assert model.predict([text]) == [(want, pytest.approx(1 - low / high))] and cost[want] == low


def test_language_edges(documents, by_doc):
    rows = [(i, "the cat and the dog", "en") for i in range(40)] + [(i, "der hund und die katze", "de") for i in range(40, 80)]
    rows += [(90, None, "en"), (91, "", None), (92, "123 !!", "de"), (93, "the dog", None), (None, "der hund", "de"), (94, "und die katze " * 20_000, None), (94, "cat and", None)]
    docs = documents(rows)
    samples = language_id.learn(docs)
    assert [lang for lang, _ in samples] == ["de", "en"]
    assert max(len(t) for _, t in samples) <= language_id.SAMPLE_SLOTS * (language_id.SLOT_CHARS + 1)
    got = by_doc(language_id.predict(docs, samples).selectExpr("row.doc_id", "row.`a.b`", "lang_pred", "score"))
    assert [(got[i][0]["lang_pred"], got[i][0]["score"]) for i in (90, 91, 92)] == [("und", 0.0)] * 3
    assert [got[i][0]["lang_pred"] for i in (93, None)] == ["en", "de"]
    assert sorted(r["lang_pred"] for r in got[94]) == ["de", "en"]
    assert all(0 <= r["score"] <= 1 for rs in got.values() for r in rs)
    assert language_id.learn(documents([])) == []
    assert {r["lang_pred"] for r in language_id.predict(docs, []).collect()} == {"und"}


def test_held_out_rows_teach_nothing(documents):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert language_id.learn(documents([(i, "text", "en") for i in held])) == []


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = language_id.predict(docs.withColumn("held", language_id.held_out()), language_id.learn(docs))
    rows = found.where("row.held").selectExpr("lang_pred = row.lang AS ok").collect()
    assert len(rows) > 40 and sum(r["ok"] for r in rows) / len(rows) > 0.97


def brute_scores(rows):
    docs = [words(t) for _, t in rows]
    single = Counter(w for d in docs for w in d)
    pairs = Counter(p for d in docs for p in zip(d, d[1:]))
    total = sum(single.values())
    out = []
    for (doc, _), d in zip(rows, docs):
        own, own_pairs, s = Counter(d), Counter(zip(d, d[1:])), 0.0
        for k, w in enumerate(d):
            pair = (d[k - 1], w)
            if k and pairs[pair] > own_pairs[pair]:
                s += math.log((pairs[pair] - own_pairs[pair]) / (single[pair[0]] - own[pair[0]]))
            else:
                left = single[w] - own[w]
                s += math.log((0.4 * left if left else 0.16) / max(1, total - len(d)))
        out.append((str(doc), len(d), round(s, 6) if d else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket_words", [50, 10**6])
def test_scores_against_brute_force(documents, corpus, bucket_words):
    rows, _ = corpus
    got = ngram_lm.score(documents(rows), bucket_words, 2).collect()
    seen = [(str(r["doc_id"]), r["n_words"], None if r["log_score"] is None else round(r["log_score"], 6)) for r in got]
    for ours, theirs in zip(sorted(seen, key=str), brute_scores(rows), strict=True):
        assert ours[:2] == theirs[:2] and (ours[2] is theirs[2] or ours[2] == pytest.approx(theirs[2], rel=1e-6))


def test_scores_of_little(documents):
    assert ngram_lm.score(documents([])).collect() == []
    got = ngram_lm.score(documents([(1, "alone alone"), (2, None)]), order=2).collect()
    assert {r["doc_id"]: r["log_score"] for r in got} == {1: pytest.approx(2 * math.log(0.16)), 2: None}


def brute_backoff(rows, order):
    """Stupid backoff by its definition, over n-grams of up to ``order`` words."""
    docs = [words(t) for _, t in rows]
    grams = lambda d: Counter(tuple(d[k : k + n]) for n in range(1, order + 1) for k in range(len(d) - n + 1))
    everything, total, out = sum(map(grams, docs), Counter()), sum(map(len, docs)), []
    for (doc, _), d in zip(rows, docs):
        own = grams(d)
        others = lambda g: everything[g] - own[g]

        def share(k, n):
            if n == 1:
                return (others((d[k],)) or 0.4) / max(1, total - len(d))
            gram = tuple(d[k - n + 1 : k + 1]) if k >= n - 1 else ()
            return others(gram) / others(gram[:-1]) if gram and others(gram) else 0.4 * share(k, n - 1)

        out.append((str(doc), len(d), sum(math.log(share(k, order)) for k in range(len(d))) if d else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("order", [1, 3, 4])
def test_longer_contexts_against_brute_force(documents, corpus, order):
    rows = [r for r in corpus[0] if r[0] not in (91, 92)]
    got = ngram_lm.score(documents(rows), 50, order).collect()
    seen = sorted(((str(r["doc_id"]), r["n_words"], r["log_score"]) for r in got), key=str)
    for ours, theirs in zip(seen, brute_backoff(rows, order), strict=True):
        assert ours[:2] == theirs[:2] and (ours[2] is theirs[2] or ours[2] == pytest.approx(theirs[2], rel=1e-9))


@pytest.mark.parametrize("most", [0, 3, 40])
def test_scores_are_the_same_whichever_words_have_numbers(documents, corpus, monkeypatch, most):
    monkeypatch.setattr(ngram_lm, "NUMBERED_WORDS", most)
    rows = [r for r in corpus[0] if r[0] not in (91, 92)]
    got = ngram_lm.score(documents(rows), 50, 3).collect()
    seen = sorted(((str(r["doc_id"]), r["n_words"], r["log_score"]) for r in got), key=str)
    for ours, theirs in zip(seen, brute_backoff(rows, 3), strict=True):
        assert ours[:2] == theirs[:2] and (ours[2] is theirs[2] or ours[2] == pytest.approx(theirs[2], rel=1e-9))


def test_blocks_are_not_shuffled_again(documents):
    scores = ngram_lm.score(documents([(1, "a b c"), (2, "a b d")]))
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # requests and answers


def test_requests_take_four_bytes_an_ngram(documents):
    rng = np.random.default_rng(1)
    words = np.minimum(rng.zipf(1.4, 200_000), 5_000).astype(str)
    blocks = ngram_lm.pack(documents([(k, " ".join(words[k::20])) for k in range(20)]).coalesce(1))
    numbered = blocks.sparkSession.sparkContext.broadcast(ngram_lm.numbered_words(blocks, 1))
    sent = ngram_lm.requests(blocks, 1, 3, numbered).collect()
    n = sum(len(ngram_lm.expanded(r["counts"], "<u4")) for r in sent)
    assert sum(len(r["keys"]) + len(r["counts"]) for r in sent) < 4 * n


def test_query_scores_contexts_of_two_words(spark, documents, tmp_path):
    from txnlens.llm.queries import op6_lm_score

    rows = [(1, "a b c"), (2, "a b c"), (3, "x b d"), (4, "x b d")]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["log_score"] for r in op6_lm_score(spark, str(tmp_path)).collect()}
    assert got == {int(d): round(s, 4) for d, _, s in brute_backoff(rows, 3)}
