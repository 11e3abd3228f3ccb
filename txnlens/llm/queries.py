"""The numbered queries: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlens.llm import bpe, chat, collocations, decontaminate, exact_dedup, hard_negatives, language_id, line_dedup, ngram_lm, packing, secrets, simhash, token_planes
from txnlens.llm.tables import default_parts, table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_lines(table(spark, sf_dir, "documents")).select(
        "row.doc_id",
        "n_lines",
        "n_dropped",
        "n_linked",
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.with_digests(bpe.round_trip(docs, WORD_BPE)).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    buckets = max(default_parts(spark), -(-docs.count() // exact_dedup.BUCKET_ROWS))
    return exact_dedup.dedup(docs, exact_dedup.DigestIndex(spark, buckets))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["rank"] == k)).cast("bigint")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(secrets.BASE)],
        F.sha2(secrets.as_text("base").cast("binary"), 256).alias("base_sha256"),
        secrets.as_text("spans").alias("spans"),
        F.size(F.filter("spans", lambda s: s["rank"] > 2)).cast("bigint").alias("n_linked"),
    )


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(table(spark, sf_dir, "documents"), order=ngram_lm.ORDER).select(
        "doc_id",
        "n_words",
        F.round("log_score", 4).alias("log_score"),
        F.round(F.col("log_score") / F.col("n_words"), 6).alias("per_word"),
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    samples = language_id.learn(docs)
    rows = docs.select("doc_id", "text", language_id.held_out().alias("held_out"))
    return language_id.predict(rows, samples).select("row.doc_id", "row.held_out", "lang_pred", "score")


def op8_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = token_planes.write_files(docs, BYTE_BPE, default_parts(spark), end_id=0)
    return token_planes.read_files(files).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = chat.Template()
    extra = spark.sql(
        "SELECT -7L AS conv_id, id AS turn, if(id = 0, 'user', 'assistant') AS role, "
        "'</s>[INST] ok [/INST]' AS text FROM range(2)"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    chats = chat.format_chats(rows.unionByName(extra), template)
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return chats.select(
        "conv_id",
        "valid",
        chat.read_turns(F.col("formatted"), template).alias("turns"),
        chat.loss_text(template).alias("loss"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    ).select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sequences = packing.pack(table(spark, sf_dir, "documents"), WORD_BPE)
    at = (F.col("p.offset") * 4 + 1).cast("int")
    return sequences.select("sequence_id", "ids", F.explode("pieces").alias("p")).select(
        "p.doc_id",
        "p.piece",
        "p.start",
        F.col("p.length").cast("bigint").alias("length"),
        F.crc32(F.substring("ids", at, F.col("p.length") * 4)).alias("ids_crc32"),
        "sequence_id",
        "p.offset",
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    label = F.col("label").cast("bigint")
    vectors = rows.where(finite).select(
        "vec_id",
        F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("q"),
    )
    return hard_negatives.mine(vectors, F.col("vec_id") % 50 == 0)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_bpe,
        op3_decontaminate,
        op4_exact_dedup,
        op5_secret_scan,
        op6_lm_score,
        op7_language_id,
        op8_token_planes,
        op9_simhash_dedup,
        op10_chat_format,
        op11_best_fit_packing,
        op12_hard_negatives,
        op13_collocations,
    )
}
