"""Aggregates over a moving span of time: the last 24 hours, 7 days, 30 days.

The frame is (t - span, t]: the row itself and its peers belong to it, a row exactly one span
earlier does not. Time is whole microseconds, so the open end is ``span - 1``.

A moving window frame is right for a customer with a few thousand rows and hopeless for one with
billions. For rows cut into chunks the frame is taken apart instead. Every span is a whole number
of days, so t and t - span lie at the same offset in their second and in their day, and the frame
is made of five pieces:

    moments of t's second up to t          | moments of the other second after t - span
    seconds of t's day before t's second   | seconds of the other day after the other second
    whole days between

A piece on the right becomes a piece on the left once its rows are moved forward by the span. So
each level needs nothing but running totals among siblings: the moments of one second (at most a
million) or the seconds of one day (86,400).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnlens.functions.calendar import DAY, SECOND
from txnlens.operators.skew import CHUNK

SPANS = {"mean_24hr": 1, "max_amount_7day": 7, "stddev_30day": 30}  # days

_ROWS = {"mean_24hr": F.avg, "max_amount_7day": F.max, "stddev_30day": F.stddev_samp}

# What a set of amounts is known by: how many, a pivot close to them, the mean's distance from the
# pivot, the sum of squares around the mean, the smallest and the largest. Differences from a pivot
# keep the digits that squares of the amounts themselves would lose.
PARTS = ["n", "p", "d", "v", "lo", "hi"]


def span_columns(
    df: DataFrame, names: list[str] | None = None, base: DataFrame | None = None
) -> DataFrame:
    """Add the named span aggregates of ``amount``, all by default.

    ``base`` is as in ``before``.
    """
    names = names or list(SPANS)
    if CHUNK in df.columns:
        return _split(df, names, base or df)
    # The row order used by the history features is finer and saves this window its sort.
    order = Window.partitionBy("customer_id").orderBy("_us")
    return df.withColumns(
        {
            name: _ROWS[name]("amount").over(order.rangeBetween(-(SPANS[name] * DAY - 1), 0))
            for name in names
        }
    )


def _offset(pivot: Column) -> Column:
    """How far the mean of a part lies from a pivot."""
    return (F.col("p") - pivot) + F.col("d")


def _merge(df: DataFrame, keys: list[str]) -> DataFrame:
    """Put parts with the same keys together; the pivot is their smallest amount."""
    group = Window.partitionBy(*keys)
    off = _offset(F.col("_pivot"))
    return (
        df.withColumn("_pivot", F.min("lo").over(group))
        .withColumn("_off", F.coalesce(off, F.lit(0.0)))
        .withColumn("_mean", F.try_divide(F.sum(F.col("n") * F.col("_off")).over(group), F.sum("n").over(group)))
        .groupBy(*keys)
        .agg(
            F.sum("n").alias("n"),
            F.min("lo").alias("p"),
            F.max("_mean").alias("d"),
            F.sum(F.col("v") + F.col("n") * F.pow(F.col("_off") - F.col("_mean"), 2)).alias("v"),
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
        )
    )


def _siblings(
    df: DataFrame, width: int, names: list[str], inclusive: bool, letter: str
) -> DataFrame:
    """Parts among siblings: those before a row, and for each span those after t - span."""
    moves = [F.struct(F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("shift"))]
    moves += [
        F.struct(F.lit(i).alias("kind"), F.lit(SPANS[name] * DAY).cast("bigint").alias("shift"))
        for i, name in enumerate(names, 1)
    ]
    moved = (
        df.select("customer_id", "_pos", *PARTS, F.inline(F.array(*moves)))
        .withColumn("_pos", F.col("_pos") + F.col("shift"))
        .withColumn("_parent", F.col("_pos") - F.pmod("_pos", F.lit(width)))
    )
    group = Window.partitionBy("customer_id", "_parent")
    start = Window.unboundedPreceding
    ahead = group.orderBy("_pos", "kind").rowsBetween(start, 0 if inclusive else -1)
    behind = group.orderBy(F.desc("_pos"), "kind").rowsBetween(start, -1)

    pivots = {
        f"_pivot{i}": F.min(F.when(F.col("kind") == i, F.col("lo"))).over(group)
        for i in range(len(names) + 1)
    }
    moved = moved.withColumns(pivots)
    sums = {}
    for i in range(len(names) + 1):
        frame = behind if i else ahead
        own = F.col("kind") == i
        off = F.coalesce(_offset(F.col(f"_pivot{i}")), F.lit(0.0))
        n = F.col("n")
        sums |= {
            f"_n{i}": F.coalesce(F.sum(F.when(own, n)).over(frame), F.lit(0)),
            f"_s{i}": F.sum(F.when(own, n * off)).over(frame),
            f"_q{i}": F.sum(F.when(own, F.coalesce("v", F.lit(0.0)) + n * off * off)).over(frame),
            f"_lo{i}": F.min(F.when(own, F.col("lo"))).over(frame),
            f"_hi{i}": F.max(F.when(own, F.col("hi"))).over(frame),
        }

    def part(i: int) -> Column:
        n, s, q = (F.col(f"_{c}{i}") for c in "nsq")
        mean = F.try_divide(s, n)
        left = F.greatest(q - s * mean, F.lit(0.0))
        return F.struct(
            n.cast("bigint").alias("n"),
            F.col(f"_pivot{i}").alias("p"),
            mean.alias("d"),
            F.when(F.col(f"_lo{i}") == F.col(f"_hi{i}"), 0.0).otherwise(left).alias("v"),
            F.col(f"_lo{i}").alias("lo"),
            F.col(f"_hi{i}").alias("hi"),
        ).alias(f"{letter}{i}")

    return (
        moved.withColumns(sums)
        .where("kind = 0")
        .select("customer_id", "_pos", *[part(i) for i in range(len(names) + 1)])
    )


def _split(df: DataFrame, names: list[str], base: DataFrame) -> DataFrame:
    amount = F.col("amount").cast("double")
    zero = F.when(amount.isNotNull(), 0.0)
    single = base.select(
        "customer_id",
        "_us",
        CHUNK,
        amount.isNotNull().cast("bigint").alias("n"),
        amount.alias("p"),
        zero.alias("d"),
        zero.alias("v"),
        amount.alias("lo"),
        amount.alias("hi"),
    )
    by_chunk = _merge(single, ["customer_id", "_us", CHUNK])
    moments = _merge(by_chunk, ["customer_id", "_us"]).withColumnRenamed("_us", "_pos")
    start_of = {
        level: F.col("_pos") - F.pmod("_pos", F.lit(level)) for level in (SECOND, DAY)
    }
    seconds = _merge(
        moments.withColumn("_pos", start_of[SECOND]), ["customer_id", "_pos"]
    )
    days = _merge(seconds.withColumn("_pos", start_of[DAY]), ["customer_id", "_pos"])

    order = Window.partitionBy("customer_id").orderBy("_pos")
    # at most a month of days stands in a frame, so its days are listed
    whole_days = days.select(
        "customer_id",
        F.col("_pos").alias("_day"),
        *[
            F.collect_list(F.struct(*PARTS)).over(order.rangeBetween(-(SPANS[name] - 1) * DAY, -DAY)).alias(f"d{i}")
            for i, name in enumerate(names, 1)
            if SPANS[name] > 1
        ],
    )
    at_second = _siblings(seconds, DAY, names, False, "s").withColumnRenamed("_pos", "_second")
    at_moment = _siblings(moments, SECOND, names, True, "m").withColumnRenamed("_pos", "_us")
    day_of = F.col("_second") - F.pmod("_second", F.lit(DAY))
    second_of = F.col("_us") - F.pmod("_us", F.lit(SECOND))
    # days meet seconds first: a day has 86,400 of them, but any number of moments
    by_second = at_second.withColumn("_day", day_of).join(whole_days, ["customer_id", "_day"])
    pieces = at_moment.withColumn("_second", second_of).join(by_second, ["customer_id", "_second"])

    finished = {}
    for i, name in enumerate(names, 1):
        near = F.array("m0", f"m{i}", "s0", f"s{i}")
        finished[name] = _finish(name, F.concat(near, F.col(f"d{i}")) if SPANS[name] > 1 else near)
    results = pieces.select(
        "customer_id", "_us", *[value.alias(name) for name, value in finished.items()]
    )
    # Rows at one instant may span chunks, so go through (instant, chunk): no group of rows that
    # meets in one task is larger than a chunk.
    spread = by_chunk.select("customer_id", "_us", CHUNK).join(results, ["customer_id", "_us"])
    return df.join(spread, ["customer_id", "_us", CHUNK], "left")


def _finish(name: str, parts: Column) -> Column:
    """The aggregate of several parts, put together two at a time."""
    if name.startswith("max"):
        return F.array_max(F.transform(parts, lambda x: x["hi"]))
    full = F.filter(parts, lambda x: x["n"] > 0)

    def join(a: Column, b: Column) -> Column:
        pivot = F.least(a["p"], b["p"])
        left, right = (a["p"] - pivot) + a["d"], (b["p"] - pivot) + b["d"]
        n = a["n"] + b["n"]
        share = b["n"] / n
        return F.struct(
            n.alias("n"),
            pivot.alias("p"),
            (left + (right - left) * share).alias("d"),
            (a["v"] + b["v"] + F.pow(right - left, 2) * a["n"] * share).alias("v"),
            F.least(a["lo"], b["lo"]).alias("lo"),
            F.greatest(a["hi"], b["hi"]).alias("hi"),
        )

    rest = F.slice(full, F.lit(2), F.greatest(F.size(full) - 1, F.lit(0)))
    whole = F.aggregate(rest, F.get(full, F.lit(0)), join)
    if name.startswith("mean"):
        return whole["p"] + whole["d"]
    spread = F.sqrt(F.try_divide(whole["v"], whole["n"] - 1))
    return F.when(whole["n"] > 1, F.when(whole["lo"] == whole["hi"], 0.0).otherwise(spread))
