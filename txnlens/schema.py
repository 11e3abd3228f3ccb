"""The canonical transaction table and how other tables are brought to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnlens.constants import FLAGS, PLACEHOLDERS

TXN = T.StructType(
    [
        T.StructField("customer_id", T.StringType(), False),
        T.StructField("transaction_id", T.StringType(), False),
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("transaction_type", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("is_accident_burst", T.BooleanType()),
        T.StructField("is_high_amount_accident", T.BooleanType()),
        T.StructField("is_mistyped_entity_accident", T.BooleanType()),
        T.StructField("city", T.StringType()),
        T.StructField("entity_type", T.StringType()),
        T.StructField("recipient_entity", T.StringType(), False),
        T.StructField("original_recipient_entity", T.StringType()),
    ]
)


def ensure_columns(df: DataFrame) -> DataFrame:
    """Add what a scoring file may leave out.

    Missing flags become 0 and missing key columns their placeholder. A null key gets the same
    placeholder, so its row stays. A missing transaction id becomes a digest of the row; only
    exact copies of a row share one.
    """
    if "amount" not in df.columns:
        raise ValueError("the table has no amount column")
    added: dict[str, Column] = {
        flag: F.lit(0) for flag in FLAGS if flag not in df.columns
    }
    for name, value in PLACEHOLDERS.items():
        if name not in df.columns:
            value = F.lit(value)
            added[name] = value.cast("timestamp") if name == "timestamp" else value
        elif name != "timestamp":
            added[name] = F.coalesce(F.col(name).cast("string"), F.lit(value))
    if "transaction_id" not in df.columns:
        text = F.to_json(F.struct(*[F.col(c) for c in df.columns]))
        added["transaction_id"] = F.md5(text)
    return df.withColumns(added)


def normalize(
    df: DataFrame, strict: bool = True, timestamp_format: str | None = None
) -> DataFrame:
    """Give known columns their types: flags 0/1, time as timestamp, amount as double.

    NaN amounts become null, since Spark's aggregates would take NaN for a value. With
    ``strict=False`` text that cannot be parsed becomes null instead of stopping the job. Times are
    ISO text unless ``timestamp_format`` gives a pattern.
    """
    columns: dict[str, Column] = {}
    for flag in FLAGS:
        if flag in df.columns:
            value = F.col(flag)
            if isinstance(df.schema[flag].dataType, T.StringType):
                value = F.when(F.lower(F.trim(value)).isin("true", "1", "1.0"), 1).otherwise(0)
            columns[flag] = F.coalesce(value.cast("int"), F.lit(0))
    if "timestamp" in df.columns:
        ts = F.col("timestamp")
        if isinstance(df.schema["timestamp"].dataType, T.StringType):
            pattern = [] if timestamp_format is None else [timestamp_format]
            if strict:
                ts = F.to_timestamp(ts, *pattern)
            else:
                ts = F.try_to_timestamp(ts, *map(F.lit, pattern))
        columns["timestamp"] = ts.cast("timestamp")
    if "amount" in df.columns:
        amount = F.col("amount")
        amount = amount.cast("double") if strict else amount.try_cast("double")
        columns["amount"] = F.nanvl(amount, F.lit(None).cast("double"))
    for field in TXN.fields:
        if field.name in df.columns and isinstance(field.dataType, T.StringType):
            columns[field.name] = F.col(field.name).cast("string")
    return df.withColumns(columns)


def canonical(
    df: DataFrame, strict: bool = True, timestamp_format: str | None = None
) -> DataFrame:
    """``ensure_columns`` and ``normalize`` in one."""
    return normalize(ensure_columns(df), strict, timestamp_format)
