"""Keep one customer with a huge share of the rows from landing in one task.

Most customers are small and their rows go to one task each, by a plain window. A *crowded*
customer, one with more rows than a task should hold, is cut into chunks of its history instead:
the rows are range-partitioned and sorted by (customer, time, id), each partition is cut into
chunks, and operators work chunk by chunk and carry small summaries from one chunk to the next.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlens.functions.calendar import micros

# A moving time frame costs rows x frame length, so a window task holds at most this many rows
# of one customer: some millions of steps.
CROWDED_ROWS = 2_000

# Rows of one chunk of a crowded customer's history.
CHUNK_ROWS = 1_000_000

# Chunks of one table; with more rows than that makes, chunks grow instead.
MOST_CHUNKS = 20_000

# Rows of one partition that is cut into chunks, at least. The driver is sent a sample of each
# partition and a report of each task, so partitions follow the rows and not the size of a chunk.
PART_ROWS = 100_000

# Keys that may be broadcast. Longer lists are joined by shuffle.
BROADCAST_KEYS = 10_000

CHUNK = "_chunk"
ORDER = ["_us", "transaction_id"]


def shared_folder(spark: SparkSession) -> str:
    """Where intermediate tables go: the cluster's checkpoint folder, or a local one in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="txnlens-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


# What is being staged inside ``tidied``, innermost last.
_owned: list[list[str]] = []


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, so its rows are fixed from here on."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for paths in _owned:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidied(build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` gives; the tables that it staged and that its result doesn't read are removed."""
    _owned.append([])
    try:
        result = build()
    finally:
        paths = _owned.pop()
    read = {file.rsplit("/", 2)[-2] for file in result.inputFiles()}
    jvm, conf = result.sparkSession._jvm, result.sparkSession._jsc.hadoopConfiguration()
    for path in paths:
        if path.rsplit("/", 1)[-1] not in read:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)
    return result


def crowded_customers(df: DataFrame, limit: int) -> tuple[DataFrame, int, int]:
    """Customers with more than ``limit`` rows as a staged table; how many, and their rows.

    One pass over the customer column alone; counts are summed before the shuffle. Callers that use
    a table several times find them once and pass them on.
    """
    counts = df.groupBy("customer_id").count().where(F.col("count") > limit)
    names = stage(counts, "crowded")
    customers, rows = names.agg(F.count("count"), F.sum("count")).first()
    return names.select("customer_id"), customers, rows or 0


def chunked(df: DataFrame, rows: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Cut the history of every customer into chunks, numbered in time order.

    A chunk's number is the id of its first row: partition, and place in the sorted partition. It is
    only stable once written, hence the staged table.
    """
    chunk_rows = max(chunk_rows, -(-rows // MOST_CHUNKS))
    parts = max(2, -(-rows // max(chunk_rows, PART_ROWS)))
    ranged = df.repartitionByRange(parts, "customer_id", *ORDER).sortWithinPartitions("customer_id", *ORDER)
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = ranged.withColumn("_id", F.monotonically_increasing_id())
    chunk = F.col("_id") - F.pmod(place, F.lit(chunk_rows))
    return stage(numbered.withColumn(CHUNK, chunk).drop("_id"), "chunks")


def by_customer(
    df: DataFrame,
    build: Callable[[DataFrame], DataFrame],
    crowded_rows: int = CROWDED_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Apply a per-customer operator, with crowded customers cut into chunks.

    ``build`` gets rows with ``_us``; those of crowded customers carry ``_chunk`` too. The
    operators it is made of look at that column and choose their plan.
    """
    missing = F.raise_error(F.lit("a payment has no timestamp")).cast("bigint")
    timed = df.withColumn("_us", F.coalesce(micros(), missing))
    names, customers, rows = crowded_customers(df, crowded_rows)
    if not customers:
        return build(timed).drop("_us")
    if customers <= BROADCAST_KEYS:
        names = F.broadcast(names)
    calm = timed.join(names, "customer_id", "left_anti")
    dense = timed.join(names, "customer_id", "left_semi")
    split = build(chunked(dense, rows, chunk_rows)).drop(CHUNK)
    return build(calm).unionByName(split).drop("_us")
