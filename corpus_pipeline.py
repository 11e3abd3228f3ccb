"""The corpus pipeline: documents through five stages, each written and read again.

Each stage takes (spark, docs, folder of the tables) and returns a DataFrame; all but the last return
the columns of documents. Every row is judged by itself, whether it has a ``doc_id``, shares it or not:
stages that drop documents number the rows first.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlens.llm import bpe, decontaminate, language_id, line_dedup, simhash
from txnlens.llm.queries import WORD_BPE
from txnlens.llm.tables import columns_of, stage, table
from txnlens.operators.skew import tidied

Step = Callable[[SparkSession, DataFrame, str], DataFrame]

# Ids of documents that go are sent to all tasks up to this many; beyond, both sides are shuffled.
BROADCAST_IDS = 1_000_000


# Rows that are sent to a worker at once, where a stage says so: executor and worker hold them both, each more than once.
# A setting of the session's user goes first.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
OURS = "txnlens.pipeline.batchRows"  # what was set here


def numbered(docs: DataFrame) -> DataFrame:
    """(row, uid, text): every row as a struct and its number; written, so that numbers hold."""
    rows = stage(docs.select(F.struct(*columns_of(docs)).alias("row"), F.monotonically_increasing_id().alias("uid")), "rows")
    return rows.select("row", "uid", F.col("row.text").alias("text"))


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose uid isn't in ``gone``, as documents."""
    gone = stage(gone.select("uid"), "gone")
    few = gone.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(gone) if few else gone, "uid", "left_anti").select("row.*")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; those without a letter go."""
    samples = language_id.learn(docs)
    if not samples:  # nothing to tell languages by
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language_id.predict(docs, samples)
    return found.where(F.col("lang_pred") != language_id.UNKNOWN).select("row.*")


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that came before; one that loses all its lines stays, empty."""
    rows = line_dedup.drop_lines(docs)
    new = {"text": F.col("text"), "n_chars": F.coalesce(F.length("text"), F.lit(0)).cast("bigint")}
    return rows.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with near fingerprints, the one with the smallest doc_id; those without one come last."""
    rows = numbered(docs)
    groups = simhash.near_dedup(rows.select(F.col("uid").alias("doc_id"), "text"))
    ids = rows.select("uid", F.col("row.doc_id").alias("id_of"))
    members = groups.select(F.col("doc_id").alias("uid"), "component_id").join(ids, "uid")
    members = stage(members.select("uid", "component_id", F.struct(F.isnull("id_of").alias("none"), "id_of", "uid").alias("place")), "members")
    # minima are taken before the shuffle, and the rest goes by row: no task holds a group of any size
    stays = stage(members.groupBy("component_id").agg(F.min("place").alias("keeper")).select("keeper.uid"), "stays")
    gone = members.select("uid").join(stays, "uid", "left_anti")
    return without(rows, gone)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages don't make up a twentieth of."""
    rows = numbered(docs)
    judged = decontaminate.decontaminate(rows.select(F.col("uid").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return without(rows, judged.where("contaminated").select(F.col("doc_id").alias("uid")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and digests of the ids and of the text decoded from them."""
    return bpe.with_digests(bpe.round_trip(docs, WORD_BPE)).drop("text")


def send(spark: SparkSession, batch_rows: int | None) -> None:
    """Let batches have so many rows from here on, or as many as Spark lets them have."""
    given = spark.conf.get(BATCH_ROWS, None)
    if given is not None and given != spark.conf.get(OURS, None):
        return
    for key in (BATCH_ROWS, OURS):
        spark.conf.set(key, str(batch_rows)) if batch_rows else spark.conf.unset(key)


def tidy(step: Step, batch_rows: int | None = None) -> Step:
    """The same step; of the tables written on the way those stay that its result reads.

    Its result is to be written before the next step begins: ``batch_rows`` holds until then.
    """

    @wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        send(spark, batch_rows)
        return tidied(lambda: step(spark, docs, sf_dir))

    return run_step


STAGES = [
    ("language_id", tidy(known_language, batch_rows=5_000)),
    ("line_dedup", tidy(new_lines)),
    ("simhash_dedup", tidy(one_of_each)),
    ("decontamination", tidy(clean)),
    ("bpe", tidy(tokens, batch_rows=2_500)),
]

# Language ID, fingerprints and tokenizers are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    send(spark, None)
    return docs
