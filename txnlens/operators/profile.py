"""Counts, shares and summaries of a payment table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnlens.constants import CATEGORICAL_COLUMNS, FLAGS, LABEL
from txnlens.operators.skew import stage


def _rows(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def txn_per_day(txn: DataFrame) -> DataFrame:
    return txn.groupBy(F.to_date("timestamp").alias("day")).agg(_rows("n"))


def txn_per_week(txn: DataFrame) -> DataFrame:
    """Weeks run from Monday to Sunday and are named by their Monday."""
    week = F.to_date(F.date_trunc("week", "timestamp"))
    return txn.groupBy(week.alias("week")).agg(_rows("n"))


def txn_per_customer(txn: DataFrame) -> DataFrame:
    return txn.groupBy("customer_id").agg(_rows("n")).orderBy(F.desc("n"), "customer_id")


def top_values(txn: DataFrame, column: str, count: int) -> DataFrame:
    """The most frequent values; equal counts in the order of their names."""
    return txn.groupBy(column).agg(_rows("n")).orderBy(F.desc("n"), column).limit(count)


def top_customers(txn: DataFrame, count: int = 20) -> DataFrame:
    return top_values(txn, "customer_id", count)


def top_entity_types(txn: DataFrame, count: int = 5) -> DataFrame:
    return top_values(txn, "entity_type", count)


def flag_distribution(txn: DataFrame, flags: list[str] = FLAGS) -> DataFrame:
    """How often each flag is 0 and 1. Rows are counted per combination of flags first."""
    combined = txn.groupBy(*flags).agg(_rows("_n"))
    return (
        combined.unpivot("_n", flags, "metric", "value")
        .groupBy("metric", F.col("value").cast("int").alias("value"))
        .agg(F.sum("_n").alias("n"))
        .orderBy("metric", "value")
    )


def accident_totals(txn: DataFrame) -> DataFrame:
    """Sum of each flag, accidents of any kind and their share in percent."""
    any_kind = F.greatest(*[F.col(flag).cast("int") for flag in FLAGS])
    sums = [F.coalesce(F.sum(F.col(flag).cast("int")), F.lit(0)).alias(flag) for flag in FLAGS]
    return txn.agg(
        *sums, F.coalesce(F.sum(any_kind), F.lit(0)).alias("accidents"), _rows("rows")
    ).withColumn(
        "accident_percent",
        F.round(F.coalesce(F.try_divide(F.col("accidents") * 100.0, "rows"), F.lit(0.0)), 2),
    )


def filter_accidents(txn: DataFrame, flag: str) -> DataFrame:
    return txn.where(F.col(flag) == 1)


def distinct_customers(txn: DataFrame) -> DataFrame:
    return txn.select("customer_id").distinct()


def preview_txn(txn: DataFrame, count: int = 10, last: bool = False) -> DataFrame:
    """The first or last rows in time."""
    keys = ["timestamp", "transaction_id"]
    return txn.orderBy(*[F.desc(k) if last else F.asc(k) for k in keys]).limit(count)


def null_profile(df: DataFrame) -> DataFrame:
    """Type, filled and missing rows of every column, in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in df.columns])
    kinds = F.create_map(*[F.lit(part) for item in df.dtypes for part in item])
    return counts.unpivot("_rows", df.columns, "column_name", "non_null").select(
        "column_name",
        kinds[F.col("column_name")].alias("data_type"),
        "non_null",
        (F.col("_rows") - F.col("non_null")).alias("missing"),
    )


def home_city_share(txn: DataFrame, homes: DataFrame) -> DataFrame:
    """Percentage of each customer's payments made in the home city.

    Payments are counted per customer and city before the join, so a busy customer brings a few
    rows to it and not all payments.
    """
    visits = txn.groupBy("customer_id", "city").agg(_rows("_n"))
    at_home = F.col("city") == F.col("home_city")
    return (
        visits.join(homes, "customer_id", "left")
        .groupBy("customer_id")
        .agg(
            F.sum(F.when(at_home, F.col("_n")).otherwise(0)).alias("_home"),
            F.sum("_n").alias("n"),
        )
        .select(
            "customer_id",
            "n",
            F.round(F.col("_home") * 100.0 / F.col("n"), 2).alias("home_city_percent"),
        )
    )


def home_city_overall(txn: DataFrame, homes: DataFrame) -> DataFrame:
    visits = txn.groupBy("customer_id", "city").agg(_rows("_n"))
    at_home = F.when(F.col("city") == F.col("home_city"), F.col("_n")).otherwise(0)
    return (
        visits.join(homes, "customer_id", "left")
        .agg(F.sum(at_home).alias("_home"), F.sum("_n").alias("n"))
        .select(
            "n", F.round(F.try_divide(F.col("_home") * 100.0, "n"), 2).alias("home_city_percent")
        )
    )


def drop_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows before and after dropping those with a null in one of the columns."""
    complete = F.lit(True)
    for column in columns:
        complete = complete & F.col(column).isNotNull()
    return df.agg(_rows("rows_before"), F.count_if(complete).alias("rows_after"))


def amount_gap_bins(
    featured: DataFrame, amount_step: float = 50.0, gap_step: float = 21_600.0
) -> DataFrame:
    """Amount against time since the last payment by label, counted in rectangular bins."""
    return featured.groupBy(
        F.floor(F.col("amount") / amount_step).alias("amount_bin"),
        F.floor(F.col("time_since_last_txn") / gap_step).alias("gap_bin"),
        F.col(LABEL),
    ).agg(_rows("n"))


Bracket = tuple[float, float] | None


def _bracket_edges(place: float, accuracy: int) -> list[float]:
    """Two fractions a little below and above one: what a sketch returns for them encloses its value.

    The sketch is off by less than 1/accuracy, and quartiles need the two ranks next to the fraction.
    """
    return [max(place - 4 / accuracy, 0.0), min(place + 4 / accuracy, 1.0)]


def order_statistics(df: DataFrame, column: str, brackets: list[Bracket], ranks: list[list[int]]) -> DataFrame:
    """(bracket, rank, value): the exact values with 0-based ranks, given brackets that should hold them.

    Reads the table twice. The first time it counts, and a bracket that doesn't hold its ranks, or None, takes
    in everything. The second time it groups the values inside. Those are dealt in ranges, and only the ranges with
    the ranks are sorted.
    """
    value = F.col(column)
    inside = [F.lit(True) if b is None else value.between(*b) for b in brackets]
    below = [F.lit(False) if b is None else value < b[0] for b in brackets]
    filled = df.where(value.isNotNull())
    counts = filled.agg(*map(F.count_if, below), *map(F.count_if, inside)).first()
    asked = []
    for i, wanted in enumerate(ranks):
        under, within = counts[i], counts[len(brackets) + i]
        if not all(under <= rank < under + within for rank in wanted):
            inside[i], under = F.lit(True), 0
        asked += [(i, rank, rank - under) for rank in wanted]

    of = F.array_compact(F.array(*[F.when(test, F.lit(i)) for i, test in enumerate(inside)]))
    ties = (
        filled.select(value.alias("value"), F.explode(of).alias("bracket"))
        .groupBy("bracket", "value")
        .agg(_rows("_n"))
        .repartitionByRange("bracket", "value")
    )
    near = stage(ties.withColumn("_part", F.spark_partition_id()), "near_ranks")
    ahead = Window.partitionBy("bracket").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = near.groupBy("bracket", "_part").agg(F.sum("_n").alias("_size"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_size").over(ahead), F.lit(0)))  # a row for each range
    each = F.array(
        *[
            F.struct(F.lit(i).alias("_of"), F.lit(rank).cast("bigint").alias("rank"), F.lit(place).cast("bigint").alias("_place"))
            for i, rank, place in asked
        ]
    )
    hit = starts.select("*", F.inline(each)).where("_of = bracket AND _place >= _start AND _place < _start + _size")
    upto = F.col("_start") + F.sum("_n").over(Window.partitionBy("bracket", "rank").orderBy("value"))
    return (
        near.join(F.broadcast(hit.select("bracket", "_part", "_start", "rank", "_place")), ["bracket", "_part"])
        .withColumn("_upto", upto)
        .where(F.col("_upto") > F.col("_place"))
        .groupBy("bracket", "rank")
        .agg(F.min("value").alias("value"))
    )


def order_statistic(df: DataFrame, column: str, total: int, rank: int, accuracy: int = 10_000) -> DataFrame:
    """The exact value with a 0-based rank, without sorting the table: one row, ``value``."""
    edges = _bracket_edges(rank / total, accuracy)
    bracket = df.agg(F.percentile_approx(column, edges, accuracy)).first()[0]
    return order_statistics(df, column, [tuple(bracket)], [[rank]]).select("value")


QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def number_summary(df: DataFrame, column: str = "amount", accuracy: int = 10_000) -> DataFrame:
    """Count, mean, deviation, minimum, exact quartiles (linear between neighbours), maximum.

    Three reads at any size: one for everything else and a sketch that brackets all quartiles, and two
    that find these (``order_statistics``).
    """
    edges = [e for q in QUARTILES.values() for e in _bracket_edges(q, accuracy)]
    basics = df.agg(
        F.count(column).cast("bigint").alias("count"),
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
        F.min(column).cast("double").alias("min"),
        F.max(column).cast("double").alias("max"),
        F.percentile_approx(column, edges, accuracy).alias("_edges"),
    )
    known = stage(basics, "number_summary")
    facts = known.first()
    total, ends = facts["count"], facts["_edges"]
    if not total:
        nothing = [F.lit(None).cast("double").alias(name) for name in QUARTILES]
        return known.select("count", "mean", "std", "min", *nothing, "max")
    places = [q * (total - 1) for q in QUARTILES.values()]
    ranks = [sorted({int(p), min(int(p) + 1, total - 1)}) for p in places]
    pairs = [(ends[2 * i], ends[2 * i + 1]) for i in range(len(places))]
    values = order_statistics(df, column, pairs, ranks)
    quartiles = []
    for i, (name, place) in enumerate(zip(QUARTILES, places)):
        own = F.when(F.col("bracket") == i, F.col("value").cast("double"))
        low, high = F.min(own), F.max(own)
        quartiles.append((low + (high - low) * (place - int(place))).alias(name))
    found = values.agg(F.struct(*quartiles)).scalar()
    return known.select("count", "mean", "std", "min", *[found[name].alias(name) for name in QUARTILES], "max")


def category_levels(df: DataFrame, column: str, most: int = 1000) -> list[str]:
    """The values of a categorical column in order; an error if there are too many."""
    levels = [row[0] for row in df.select(column).distinct().limit(most + 1).collect()]
    if len(levels) > most:
        raise ValueError(f"{column} has more than {most} values and cannot be one-hot encoded")
    return sorted(level for level in levels if level is not None)


def one_hot(df: DataFrame, columns: list[str] = CATEGORICAL_COLUMNS) -> DataFrame:
    """Replace categorical columns by 0/1 columns, one per value but the first."""
    encoded = {
        f"{column}_{level}": (F.col(column).eqNullSafe(F.lit(level))).cast("int")
        for column in columns
        for level in category_levels(df, column)[1:]
    }
    return df.withColumns(encoded).drop(*columns)
