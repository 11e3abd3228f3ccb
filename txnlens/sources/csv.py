"""CSV in and out, JSON out. Paths may be local or on any Hadoop file system, ``s3a://`` too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlens.schema import canonical

# Rows of a day that one task writes to a file.
FILE_ROWS = 2_000_000


def read_raw(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Read CSV files with a header, every column as text; a folder, a file or a list of files.

    Types are not inferred: that would take a second pass, and an all-digit recipient column
    would lose its leading zeros. Files whose header differs from the first one's stop the job
    instead of being read with columns mixed up.
    """
    for name in [path] if isinstance(path, str) else path:
        if name.lower().endswith(".csv"):
            continue
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if files.isFile(hadoop):
            raise ValueError(f"not a CSV file: {name}")
    return (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .option("escape", '"')
        .option("recursiveFileLookup", True)  # folders by day give no column
        .option("pathGlobFilter", "*.[cC][sS][vV]")
        .csv(path)
    )


def read_transactions(
    spark: SparkSession, path: str, strict: bool = True, timestamp_format: str | None = None
) -> DataFrame:
    """Read CSV files as canonical transactions, filling in columns they lack."""
    return canonical(read_raw(spark, path), strict, timestamp_format)


def write_csv(df: DataFrame, path: str, by_day: bool = False, mode: str = "error") -> None:
    """Write CSV with a header and no index, in folders by day if asked."""
    text = df.withColumns(
        {
            name: F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS")
            for name, kind in df.dtypes
            if kind == "timestamp"
        }
    )
    if by_day:
        # one task per day and slice, so a day is a few files however many tasks there are; slices are
        # found by the rows themselves, so a task that is run again deals them out alike
        text = text.withColumn("day", F.substring("timestamp", 1, 10))
        sizes = text.groupBy(F.col("day").alias("_day")).agg(F.ceil(F.count(F.lit(1)) / FILE_ROWS).alias("_slices"))
        columns = [F.col(f"`{c}`") for c in text.columns]
        # broadcast: no more rows than the calendar has days
        text = text.join(F.broadcast(sizes), F.col("day").eqNullSafe(F.col("_day")))
        text = text.repartition("day", F.pmod(F.xxhash64(*columns), F.col("_slices"))).drop("_day", "_slices")
    writer = text.write.mode(mode).option("header", True).option("escape", '"')
    if by_day:
        writer = writer.partitionBy("day")
    writer.csv(path)


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)
