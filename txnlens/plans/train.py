"""Train a model from labelled payments: ``spark-submit txnlens/plans/train.py IN MODEL``."""

from __future__ import annotations

import argparse

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.constants import FEATURES, LABEL, LEARNING_RATE, SEED, TREE_DEPTH, TREES
from txnlens.operators import evaluate, model
from txnlens.operators.features import add_features
from txnlens.operators.sampling import stratified_split
from txnlens.operators.skew import stage
from txnlens.session import job_session
from txnlens.sources.files import add_input_options, load


def split_rows(featured: DataFrame, na_policy: str = "drop") -> DataFrame:
    """The rows to train and test with, written once: fitting reads them again and again."""
    slim = model.model_rows(featured, na_policy).select("transaction_id", LABEL, *FEATURES)
    return stratified_split(stage(slim, "rows"))


def fit(
    txn: DataFrame,
    na_policy: str = "drop",
    trees: int = TREES,
    depth: int = TREE_DEPTH,
    rate: float = LEARNING_RATE,
) -> tuple[PipelineModel, DataFrame]:
    """A model fitted on the training rows, and the scored test rows."""
    split = stage(split_rows(add_features(txn), na_policy), "split")
    fitted = model.train(split.where(~F.col("is_test")), trees, depth, rate, SEED)
    return fitted, model.score(fitted, split.where("is_test"))


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("input")
    parser.add_argument("model")
    add_input_options(parser)
    parser.add_argument("--na-policy", choices=["drop", "impute"], default="drop")
    parser.add_argument("--trees", type=int, default=TREES)
    parser.add_argument("--depth", type=int, default=TREE_DEPTH)
    parser.add_argument("--rate", type=float, default=LEARNING_RATE)
    args = parser.parse_args()
    spark = job_session("txnlens-train")
    txn = load(spark, args.input, args.format, not args.lenient, args.timestamp_format)
    fitted, scored = fit(txn, args.na_policy, args.trees, args.depth, args.rate)
    fitted.write().overwrite().save(args.model)
    evaluate.classification_report(scored).show(truncate=False)
    evaluate.confusion_matrix(scored).show()
    model.feature_importance(fitted, spark).orderBy(F.desc("importance")).show(truncate=False)


if __name__ == "__main__":
    main()
