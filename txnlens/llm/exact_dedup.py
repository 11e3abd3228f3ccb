"""Exact dedup against a persistent digest index, with DataFrame functions only.

The index is a table of one row per different text, bucketed and sorted by the text's SHA-256. New
data is reduced to its different texts, those the index has are taken out by a sort-merge anti-join,
which reads the index without a shuffle, and the rest is appended.

Defined results: a null text counts as empty; of equal texts the row with the largest ``doc_id``
stays (a null ``doc_id`` only if there is no other), and if that row is repeated, one of its copies;
an empty table gives an empty result; further columns of the input are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlens.llm.tables import default_parts, shared_folder, stage

SCHEMA = "digest binary, keep_id bigint, group_size bigint"

# A text with more than this share of all rows is joined by broadcast; at most 1 / HOT_SHARE can be.
HOT_SHARE = 1e-4

# Different texts that a bucket should hold at most.
BUCKET_ROWS = 2_000_000

# Rows of one text and doc_id that one task lists; more are dealt to several.
MANY = 65_536


class DigestIndex:
    """A digest table in the shared folder. ``path`` opens an earlier one, with as many buckets as it has."""

    def __init__(self, spark: SparkSession, buckets: int, path: str | None = None):
        self.spark, self.buckets = spark, buckets
        self.name = f"digest_index_{uuid.uuid4().hex}"
        self.path = path or f"{shared_folder(spark).rstrip('/')}/{self.name}"
        facts = f"{self.path}_facts"
        if path:
            written = spark.read.schema("buckets int").parquet(facts).first()["buckets"]
            if written != buckets:
                raise ValueError(f"the index has {written} buckets, not {buckets}")
        else:
            spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(facts)
        spark.sql(
            f"CREATE TABLE {self.name} ({SCHEMA}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, members: DataFrame) -> None:
        """Add the texts of ``members`` (see ``members_of``) that the index doesn't have."""
        # written first: the planner would put the join below the grouping and shuffle every copy
        groups = stage(
            members.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")),
            "digest_groups",
        )
        fresh = groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        fresh = stage(fresh, "fresh_digests")  # a table can't be read and appended to in one job
        fresh.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(
            self.name
        )
        self.spark.catalog.refreshTable(self.name)

    def lookup(self, members: DataFrame) -> DataFrame:
        """One row per row of the data behind ``members``, with what the index says of its text.

        ``group_size`` counts the rows of the batch that brought the text in.
        """
        index = self.rows()
        total = index.agg(F.sum("group_size")).first()[0] or 0
        hot = index.where(F.col("group_size") > max(1.0, HOT_SHARE * total))
        members = dealt(members)
        cold = members.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
        found = members.join(F.broadcast(hot), "digest").unionByName(
            cold.join(index.hint("merge"), "digest")
        )
        copy = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
        return found.select("doc_id", "keep_id", "group_size", "digest", "lead", copy).select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("lead") & (F.col("copy") == 1)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )


def dealt(members: DataFrame) -> DataFrame:
    """``members`` with at most ``MANY`` copies in a row; ``lead`` marks one row of each text and doc_id.

    Only rows with more copies than that are taken apart and moved.
    """
    few = members.where(F.col("copies") <= MANY).withColumn("lead", F.lit(True))
    many = members.where(F.col("copies") > MANY)
    pieces = many.withColumn("piece", F.explode(F.expr(f"sequence(0L, (copies - 1) div {MANY})")))
    pieces = pieces.repartition(default_parts(members.sparkSession), "digest", "doc_id", "piece")
    return few.unionByName(
        pieces.select(
            "digest",
            "doc_id",
            F.least(F.lit(MANY), F.col("copies") - F.col("piece") * MANY).alias("copies"),
            (F.col("piece") == 0).alias("lead"),
        )
    )


def members_of(docs: DataFrame) -> DataFrame:
    """(digest, doc_id, copies) of documents, written once so that texts are hashed once."""
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    counted = (
        docs.select(digest.alias("digest"), F.col("doc_id").cast("bigint").alias("doc_id"))
        .groupBy("digest", "doc_id")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    return stage(counted, "digests")


def dedup(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """Append ``docs`` to the index and return every row with its keeper."""
    members = members_of(docs)
    index.append(members)
    return index.lookup(members)
