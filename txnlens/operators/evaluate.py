"""How good predictions are, and the reports made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlens.constants import FLAGS, LABEL, OUTPUT_COLUMNS
from txnlens.functions.calendar import iso_text
from txnlens.functions.text import dollar_text, percent_text, risk_band, short_date_text

PREDICTION = "predicted_accident"
PROBABILITY = "accident_probability"


def _cells(scored: DataFrame, label: str, prediction: str) -> DataFrame:
    """The four cells of the confusion matrix in one row, 0 where empty."""

    def cell(actual: int, predicted: int) -> Column:
        return F.count_if((F.col(label) == actual) & (F.col(prediction) == predicted))

    return scored.agg(
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def confusion_matrix(
    scored: DataFrame, label: str = LABEL, prediction: str = PREDICTION
) -> DataFrame:
    """Rows per actual and predicted class; all four are listed."""
    rows = F.array(
        *[
            F.struct(
                F.lit(actual).alias("actual"),
                F.lit(predicted).alias("predicted"),
                F.col(name).alias("n"),
            )
            for actual, predicted, name in [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
        ]
    )
    return _cells(scored, label, prediction).select(F.inline(rows))


def classification_report(
    scored: DataFrame, label: str = LABEL, prediction: str = PREDICTION
) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy and both averages.

    A ratio with an empty denominator is 0.
    """
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    total = tn + fp + fn + tp
    measures = {}
    for name, hit, wrong, missed in [("0", tn, fn, fp), ("1", tp, fp, fn)]:
        measures[name] = (
            _ratio(hit, hit + wrong),
            _ratio(hit, hit + missed),
            _ratio(2 * hit, 2 * hit + wrong + missed),
            hit + missed,
        )
    accuracy = _ratio(tn + tp, total)
    lines = dict(measures)
    lines["accuracy"] = (accuracy, accuracy, accuracy, total)
    zero, one = measures["0"], measures["1"]
    lines["macro avg"] = (*[(zero[i] + one[i]) / 2 for i in range(3)], total)
    lines["weighted avg"] = (
        *[_ratio(zero[i] * zero[3] + one[i] * one[3], total) for i in range(3)],
        total,
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("class"),
                F.round(precision, 4).alias("precision"),
                F.round(recall, 4).alias("recall"),
                F.round(f1, 4).alias("f1"),
                support.cast("bigint").alias("support"),
            )
            for name, (precision, recall, f1, support) in lines.items()
        ]
    )
    return _cells(scored, label, prediction).select(F.inline(rows))


def recall(scored: DataFrame, label: str = LABEL, prediction: str = PREDICTION) -> DataFrame:
    """Actual accidents, those found, and the share found; 0 if there are none."""
    return _cells(scored, label, prediction).select(
        (F.col("tp") + F.col("fn")).alias("actual"),
        F.col("tp").alias("found"),
        F.round(_ratio(F.col("tp"), F.col("tp") + F.col("fn")), 4).alias("recall"),
    )


def flagged(scored: DataFrame) -> DataFrame:
    """The predicted accidents with the columns of a scoring result."""
    return scored.where(F.col(PREDICTION) == 1).select(*OUTPUT_COLUMNS)


def flagged_json(scored: DataFrame) -> DataFrame:
    """The predicted accidents as JSON records with ISO times."""
    record = F.struct(
        iso_text("timestamp").alias("timestamp"), *[F.col(c) for c in OUTPUT_COLUMNS[1:]]
    )
    return flagged(scored).select(F.to_json(record).alias("record"))


def flagged_report(scored: DataFrame) -> DataFrame:
    """The predicted accidents as text for people."""
    return flagged(scored).select(
        "customer_id",
        "recipient_entity",
        "city",
        dollar_text("amount").alias("amount_text"),
        short_date_text("timestamp").alias("date_text"),
        percent_text(F.col(PROBABILITY)).alias("probability_text"),
        risk_band(PROBABILITY).alias("risk"),
    )


def risk_summary(scored: DataFrame) -> DataFrame:
    """Predicted accidents by risk band and in all; every band is listed."""
    band = risk_band(PROBABILITY)
    names = ["High", "Medium", "Low"]
    counts = flagged(scored).agg(
        F.count(F.lit(1)).alias("Total"), *[F.count_if(band == n).alias(n) for n in names]
    )
    return counts.unpivot([], ["Total", *names], "risk", "n")


def validation_view(scored: DataFrame) -> DataFrame:
    """Truth and prediction side by side."""
    return scored.select(
        "timestamp",
        "customer_id",
        "amount",
        "recipient_entity",
        "city",
        *FLAGS,
        LABEL,
        F.col(PREDICTION).cast("int").alias(PREDICTION),
        PROBABILITY,
    )
