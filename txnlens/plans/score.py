"""Score payments with a saved model: ``spark-submit txnlens/plans/score.py IN MODEL OUT``.

The predicted accidents are written, not the whole table. With ``--recall`` the input has to be
labelled, and the share of accidents found is printed.
"""

from __future__ import annotations

import argparse

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from txnlens.operators import evaluate, model
from txnlens.operators.features import add_features
from txnlens.operators.skew import stage
from txnlens.session import job_session
from txnlens.sources.csv import write_csv, write_json
from txnlens.sources.files import add_input_options, load


def score(txn: DataFrame, fitted: PipelineModel, na_policy: str = "drop") -> DataFrame:
    """Every row a model can take, with prediction and probability."""
    return model.score(fitted, model.model_rows(add_features(txn), na_policy))


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("input")
    parser.add_argument("model")
    parser.add_argument("output")
    add_input_options(parser)
    parser.add_argument("--output-format", choices=["json", "csv", "parquet"], default="json")
    parser.add_argument("--na-policy", choices=["drop", "impute"], default="drop")
    parser.add_argument("--recall", action="store_true")
    args = parser.parse_args()
    spark = job_session("txnlens-score")
    scored = score(
        load(spark, args.input, args.format, not args.lenient, args.timestamp_format), PipelineModel.load(args.model), args.na_policy
    )
    if args.recall:  # read twice below
        scored = stage(evaluate.validation_view(scored), "scored")
    flagged = evaluate.flagged(scored)
    if args.output_format == "json":
        write_json(flagged, args.output, mode="overwrite")
    elif args.output_format == "csv":
        write_csv(flagged, args.output, mode="overwrite")
    else:
        flagged.write.mode("overwrite").parquet(args.output)
    if args.recall:
        evaluate.recall(scored).show()


if __name__ == "__main__":
    main()
