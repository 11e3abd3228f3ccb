"""Train, apply and judge the boosted-tree classifier."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.constants import FEATURES, LABEL, LEARNING_RATE, SEED, TREE_DEPTH, TREES
from txnlens.functions.draws import hash_number
from txnlens.operators.evaluate import PREDICTION, PROBABILITY


def complete_rows(featured: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """Rows without a null in any of the columns."""
    return featured.na.drop(subset=columns)


def model_rows(featured: DataFrame, na_policy: str = "drop") -> DataFrame:
    """Rows a model can take.

    ``drop`` leaves out rows with an undefined feature, which are the first two payments to each
    recipient. ``impute`` keeps them with 0.
    """
    if na_policy == "drop":
        return complete_rows(featured)
    if na_policy == "impute":
        return featured.na.fill(0.0, FEATURES).na.fill(0, FEATURES)
    raise ValueError(f"unknown na_policy: {na_policy}")


def scaled_name(feature: str) -> str:
    return f"scaled_{feature}"


@dataclass(frozen=True)
class Scale:
    """Mean and population deviation of each column, learnt from training rows."""

    mean: dict[str, float]
    std: dict[str, float]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                name: (F.col(name).cast("double") - self.mean[name]) / (self.std[name] or 1.0)
                for name in self.mean
            }
        )

    def stage(self) -> SQLTransformer:
        """The same as a stage of a model, which is saved with it; scaled columns are added."""
        columns = [
            f"(CAST(`{name}` AS DOUBLE) - ({self.mean[name]!r}D)) / {self.std[name] or 1.0!r}D AS `{scaled_name(name)}`"
            for name in self.mean
        ]
        return SQLTransformer(statement=f"SELECT *, {', '.join(columns)} FROM __THIS__")


def fit_scale(train: DataFrame, columns: list[str] = FEATURES) -> Scale:
    """Learn the scale in one pass; a constant column is only centred."""
    row = train.agg(
        *[F.avg(c).alias(f"mean_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"std_{c}") for c in columns],
    ).first()
    return Scale(
        {c: row[f"mean_{c}"] or 0.0 for c in columns}, {c: row[f"std_{c}"] or 0.0 for c in columns}
    )


# Rows of a partition that trees are fitted on, at most; a table that one wave of tasks holds is left as it is.
FIT_ROWS = 400_000


def dealt(rows: DataFrame, part_rows: int = FIT_ROWS) -> DataFrame:
    """Rows in even partitions, as many as fill all task slots some times over.

    Each level of each tree is a pass over the rows, which lasts as long as its slowest slot.
    """
    slots = rows.sparkSession.sparkContext.defaultParallelism
    waves = -(-rows.count() // (slots * part_rows))
    return rows.repartition(slots * waves) if waves > 1 else rows


def train(
    rows: DataFrame,
    trees: int = TREES,
    depth: int = TREE_DEPTH,
    rate: float = LEARNING_RATE,
    seed: int = SEED,
) -> PipelineModel:
    """Fit scale, assembler and boosted trees.

    The rows are read a few times before the trees keep them, so they should be persisted by the caller.
    """
    stages = [
        fit_scale(rows).stage(),
        VectorAssembler(inputCols=[scaled_name(c) for c in FEATURES], outputCol="features", handleInvalid="error"),
        GBTClassifier(
            featuresCol="features",
            labelCol=LABEL,
            maxIter=trees,
            maxDepth=depth,
            stepSize=rate,
            seed=seed,
        ),
    ]
    return Pipeline(stages=stages).fit(dealt(rows))


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Add the predicted class and the probability of an accident."""
    given = [F.col(f"`{c}`") for c in rows.columns if c not in (PREDICTION, PROBABILITY)]
    return (
        model.transform(rows)
        .withColumns(
            {
                PREDICTION: F.col("prediction").cast("int"),
                PROBABILITY: vector_to_array("probability")[1],
            }
        )
        .select(*given, PREDICTION, PROBABILITY)
    )


def scaled(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Rows with the scaled features, as the trees see them."""
    return model.stages[0].transform(rows)


def feature_importance(model: PipelineModel, spark) -> DataFrame:
    """How much each feature contributed to the trees' splits."""
    weights = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(
        list(zip(FEATURES, weights, strict=True)), "feature string, importance double"
    )


def permutation_importance(
    model: PipelineModel, rows: DataFrame, features: list[str] = FEATURES
) -> DataFrame:
    """How much log loss grows when one feature's values are exchanged between rows.

    All features are scored in one pass over the rows, each row once per feature. The exchanged
    value is that of the next row in a hashed order within a hashed bucket of rows, so no task
    sorts more than a bucket.
    """
    from pyspark.sql import Window

    size = 10_000
    buckets = max(1, rows.count() // size)
    spread = rows.select("transaction_id", LABEL, *FEATURES).withColumn(
        "_hash", hash_number("permute", "transaction_id")
    )
    group = Window.partitionBy(F.pmod("_hash", F.lit(buckets)))
    order = group.orderBy(F.col("_hash"), F.col("transaction_id"))
    whole = group.orderBy(F.col("_hash"), F.col("transaction_id")).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    swapped = spread.withColumns(
        {
            f"_other_{c}": F.coalesce(F.lead(c).over(order), F.first(c).over(whole))
            for c in features
        }
    )
    copies = swapped.withColumn(
        "feature", F.explode(F.array(*map(F.lit, ["", *features])))
    ).withColumns(
        {
            c: F.when(F.col("feature") == c, F.col(f"_other_{c}")).otherwise(F.col(c))
            for c in features
        }
    )
    p = F.greatest(F.least(F.col(PROBABILITY), F.lit(1 - 1e-9)), F.lit(1e-9))
    loss = F.avg(-F.when(F.col(LABEL) == 1, F.log(p)).otherwise(F.log(1 - p)))
    losses = score(model, copies).groupBy("feature").agg(loss.alias("loss"))
    base = F.max(F.when(F.col("feature") == "", F.col("loss"))).over(Window.partitionBy(F.lit(0)))
    return (
        losses.withColumn("loss_increase", F.col("loss") - base)
        .where("feature <> ''")
        .drop("loss")
    )
