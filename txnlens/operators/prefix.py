"""Aggregates over everything a customer did before a row.

Nearly all history features are of one kind: an aggregate over the earlier rows with the same key
(the customer, plus recipient, amount or city) in (time, id) order. ``before`` computes it with a
growing window frame, one step per row.

If the rows are cut into chunks the frame stays within the chunk. What earlier chunks add up to
comes as one more row per key and chunk, ahead of the others: the frame takes it in like a row.
That way the rows are shuffled once, by chunk and customer, for any number of keys.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnlens.operators.skew import CHUNK, ORDER

_EARLIER = (Window.unboundedPreceding, -1)

# How results of parts are put together.
_MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
_AGGREGATE = {**_MERGE, "count": F.count}


@dataclass(frozen=True)
class Earlier:
    """Aggregates over earlier rows with the same keys; the customer is the first key.

    ``aggregates`` maps a new column to (count | sum | min | max, expression). Without earlier
    rows a count is 0 and the others are null.
    """

    keys: list[str]
    aggregates: dict[str, tuple[str, Column]]


def before(df: DataFrame, *groups: Earlier) -> DataFrame:
    """Add the aggregates of all groups."""
    if CHUNK in df.columns:
        return _before_in_chunks(df, groups)
    for group in groups:
        frame = Window.partitionBy(*group.keys).orderBy(*ORDER).rowsBetween(*_EARLIER)
        df = df.withColumns(
            {
                name: _AGGREGATE[kind](expr).over(frame)
                for name, (kind, expr) in group.aggregates.items()
            }
        )
    return df


def _carried(df: DataFrame, group: Earlier) -> DataFrame:
    """What the chunks before each chunk add up to, one row per key and chunk."""
    totals = df.groupBy(CHUNK, *group.keys).agg(
        *[_AGGREGATE[kind](expr).alias(name) for name, (kind, expr) in group.aggregates.items()]
    )
    chunks = Window.partitionBy(*group.keys).orderBy(CHUNK).rowsBetween(*_EARLIER)
    carried = {
        f"_carried{name}": _MERGE[kind](name).over(chunks)
        for name, (kind, _) in group.aggregates.items()
    }
    return (
        totals.withColumns(carried)
        .select(CHUNK, *group.keys, *carried)
        .where(F.coalesce(*[F.col(c).cast("double") for c in carried]).isNotNull())
    )


def _before_in_chunks(df: DataFrame, groups: tuple[Earlier, ...]) -> DataFrame:
    rows = df.withColumn("_carries", F.lit(None).cast("int"))
    for i, group in enumerate(groups):
        extra = _carried(df, group).withColumn("_carries", F.lit(i))
        rows = rows.unionByName(extra, allowMissingColumns=True)
    is_row = F.col("_carries").isNull()
    for i, group in enumerate(groups):
        # Carried rows have neither time nor id, so they sort first.
        frame = Window.partitionBy(CHUNK, *group.keys).orderBy(*ORDER).rowsBetween(*_EARLIER)
        columns = {}
        for name, (kind, expr) in group.aggregates.items():
            own = F.when(expr.isNotNull(), 1) if kind == "count" else expr
            value = F.when(is_row, own).when(F.col("_carries") == i, F.col(f"_carried{name}"))
            merged = _MERGE[kind](value).over(frame)
            columns[name] = F.coalesce(merged, F.lit(0)) if kind == "count" else merged
        rows = rows.withColumns(columns)
    return rows.where(is_row).select(
        *df.columns, *[name for group in groups for name in group.aggregates]
    )


def _moments(value: Column, over: Callable[[Column], Column] = lambda agg: agg) -> tuple[Column, Column, Column]:
    """Number, mean and sum of squares around the mean, as aggregates or over a window."""
    n = over(F.count(value))
    return n, over(F.avg(value)), over(F.var_pop(value)) * n


def moments_before(df: DataFrame, value: str, groups: dict[str, list[str]]) -> DataFrame:
    """Add ``_n_<name>``, ``_mean_<name>`` and ``_squares_<name>`` of ``value`` over earlier rows with the same keys.

    Squares are around the mean, so small differences of large values keep their digits. Without earlier
    values the number is 0 and the others are null. The moments of earlier chunks come as one more row per
    key and chunk, all keys in one shuffle, and are put together with those of the chunk.
    """
    names = {name: (f"_n_{name}", f"_mean_{name}", f"_squares_{name}") for name in groups}
    if CHUNK not in df.columns:
        for name, keys in groups.items():
            frame = Window.partitionBy(*keys).orderBy(*ORDER).rowsBetween(*_EARLIER)
            own = _moments(F.col(value), lambda agg, frame=frame: agg.over(frame))
            df = df.withColumns(dict(zip(names[name], own)))
        return df
    rows = df.withColumn("_carries", F.lit(None).cast("string"))
    for name, keys in groups.items():
        extra = _carried_moments(df, keys, value).withColumn("_carries", F.lit(name))
        rows = rows.unionByName(extra, allowMissingColumns=True)
    is_row = F.col("_carries").isNull()
    for name, keys in groups.items():
        frame = Window.partitionBy(CHUNK, *keys).orderBy(*ORDER).rowsBetween(*_EARLIER)
        own = F.when(is_row, F.col(value))
        n1, mean1, squares1 = _moments(own, lambda agg, frame=frame: agg.over(frame))
        n0, mean0, squares0 = (
            F.max(F.when(F.col("_carries") == name, F.col(c))).over(frame) for c in ("_n0", "_mean0", "_squares0")
        )
        n0, squares0, squares1 = F.coalesce(n0, F.lit(0)), F.coalesce(squares0, F.lit(0.0)), F.coalesce(squares1, F.lit(0.0))
        off = F.when((n0 > 0) & (n1 > 0), mean1 - mean0).otherwise(F.lit(0.0))
        n, mean, squares = names[name]
        part = F.try_divide(n1.cast("double"), (n0 + n1).cast("double"))
        rows = rows.withColumns(
            {
                n: n0 + n1,
                mean: F.when(n0 == 0, mean1).otherwise(mean0 + off * part),
                squares: F.when(n0 + n1 > 0, squares0 + squares1 + off * off * part * n0),
            }
        )
    return rows.where(is_row).select(*df.columns, *[c for name in groups for c in names[name]])


def _carried_moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Moments of the chunks before each chunk, one row per key and chunk.

    Means are taken as differences from that of the key's first chunk.
    """
    totals = df.where(F.col(value).isNotNull()).groupBy(CHUNK, *keys).agg(
        *[agg.alias(c) for c, agg in zip(("_n", "_mean", "_squares"), _moments(F.col(value)))]
    )
    chunks = Window.partitionBy(*keys).orderBy(CHUNK)
    earlier = chunks.rowsBetween(*_EARLIER)
    pivot = F.first("_mean").over(chunks.rowsBetween(Window.unboundedPreceding, 0))
    off = F.col("_mean") - F.col("_pivot")
    n, shift = F.sum("_n").over(earlier), F.sum(F.col("_n") * off).over(earlier)
    around = F.sum(F.col("_squares") + F.col("_n") * off * off).over(earlier)
    return totals.withColumn("_pivot", pivot).select(
        CHUNK, *keys, n.alias("_n0"), (F.col("_pivot") + shift / n).alias("_mean0"),
        F.greatest(around - shift * shift / n, F.lit(0.0)).alias("_squares0"),
    ).where("_n0 > 0")


def recent(
    df: DataFrame,
    keys: list[str],
    rows: int,
    position: str,
    aggregates: dict[str, Column],
    block_rows: int = 1_000_000,
) -> DataFrame:
    """Add aggregates over the last ``rows`` earlier rows with the same keys.

    ``position`` is the number of earlier rows with those keys. Crowded keys are cut into blocks
    by it; the last rows of a block are copied into the next one, where the frame needs them.
    """
    if CHUNK not in df.columns:
        frame = Window.partitionBy(*keys).orderBy(*ORDER).rowsBetween(-rows, -1)
        return df.withColumns({name: agg.over(frame) for name, agg in aggregates.items()})

    block_rows = max(block_rows, rows)
    block = F.floor(F.col(position) / block_rows)
    needed_next = F.pmod(F.col(position), F.lit(block_rows)) >= block_rows - rows
    copies = df.withColumn(
        "_block",
        F.explode(F.when(needed_next, F.array(block, block + 1)).otherwise(F.array(block))),
    )
    frame = Window.partitionBy(*keys, "_block").orderBy(position).rowsBetween(-rows, -1)
    return (
        copies.withColumns({name: agg.over(frame) for name, agg in aggregates.items()})
        .where(F.col("_block") == block)
        .drop("_block")
    )
