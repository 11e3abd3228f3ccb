"""Predictions by a fixed rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.operators.evaluate import PREDICTION, PROBABILITY
from txnlens.operators.model import complete_rows


def rule_scores(featured: DataFrame) -> DataFrame:
    """A fixed rule in place of a model: fast repeats and amounts far off the usual.

    It keeps the columns of a model's result, for checks that need known predictions.
    """
    off = F.col("amount_deviation_rolling")
    probability = (
        F.when(F.col("time_since_last_txn").between(0, 5), 0.9)
        .when(off >= 4, 0.7)
        .when(off >= 2.5, 0.5)
        .otherwise(0.1)
    )
    return (
        complete_rows(featured)
        .withColumn(PROBABILITY, probability)
        .withColumn(PREDICTION, (F.col(PROBABILITY) >= 0.5).cast("int"))
    )
