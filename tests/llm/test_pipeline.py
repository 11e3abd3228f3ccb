"""Stages of the corpus pipeline on rows that documents of a crawl can have."""

import numpy as np

import corpus_pipeline


def test_documents_stay_if_there_is_no_language_to_learn(spark, documents):
    rows = [(1, "a text"), (2, "12 !"), (3, None), (None, "\u00e9")]
    got = corpus_pipeline.known_language(spark, documents(rows), "").collect()
    assert sorted(r["text"] for r in got) == ["a text", "\u00e9"]


def test_rows_that_share_an_id_are_judged_by_themselves(spark, documents, tmp_path):
    bad, good, copied = "the benchmark passage itself", "clean words of another kind", "one text that is there many times"
    spark.createDataFrame([(None, bad)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for doc in (None, 5):
        docs = documents([(doc, bad), (doc, good), (1, "x y z")])
        got = corpus_pipeline.clean(spark, docs, str(tmp_path)).collect()
        assert sorted(r["text"] for r in got) == [good, "x y z"] and "a.b" in got[0].asDict()
        docs = documents([(doc, copied), (doc, copied), (3, copied), (doc, good)])
        got = corpus_pipeline.one_of_each(spark, docs, "").collect()
        assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted([(3, copied), (doc or 0, good)])


def test_stages_set_the_size_of_batches_unless_the_user_did(spark, documents):
    key, read = corpus_pipeline.BATCH_ROWS, lambda: spark.conf.get(corpus_pipeline.BATCH_ROWS, None)
    stages, docs, before = dict(corpus_pipeline.STAGES), documents([(1, "a text")]), read()
    try:
        spark.conf.unset(key)
        stages["bpe"](spark, docs, "")
        assert int(read()) <= 2_500
        stages["line_dedup"](spark, docs, "")
        assert read() is None
        spark.conf.set(key, "7")
        stages["bpe"](spark, docs, "")
        assert read() == "7"
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def test_the_encoder_has_no_second_vocabulary():
    from txnlens.llm import bpe
    from txnlens.llm.queries import WORD_BPE

    model = bpe.BpeEncoder(WORD_BPE)
    whole = bpe.Tokenizer.from_file(WORD_BPE)
    assert model.library.get_vocab_size() == 0
    text = "\u00c9\u0301 \uff21bc \u4e2d\u6587\u3000it's 12 <|x|> \u0130 e\u0301\u2028\U0001f600a"
    assert np.frombuffer(model.encode([text])[0], "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_decoding_takes_a_few_times_the_memory_of_its_text():
    import tracemalloc

    from txnlens.llm import bpe
    from txnlens.llm.queries import WORD_BPE

    model, library = bpe.BpeEncoder(WORD_BPE), bpe.Tokenizer.from_file(WORD_BPE)
    texts = ["nineteen committees of the international federation of architecture " * 20_000, "", "nineteen"]
    rows = model.encode(texts)
    tracemalloc.start()
    try:
        decoded = model.decode(rows)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 12 * len(decoded[0])
    for ids, text in zip(rows, decoded):
        assert text.decode() == library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
