"""Fitted models as SQL text: the same rule runs in Spark, in DuckDB or in any other database.

A forest is stored as a table of its nodes, as Spark ML saves it, and compiled from there to nested ``CASE``; a regression to the
sign of its margin. Scoring is then a column expression, compiled with the scan, without vectors and without Spark ML.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegressionModel, RandomForestClassificationModel
from pyspark.ml.tuning import CrossValidatorModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelytics.operators.models import FEATURES
from panelytics.session import stage_folder


def number(value: float) -> str:
    """A double that every parser reads back to the same bits, and none as a decimal."""
    return f"({value:.17e})" if value < 0 else f"{value:.17e}"


def best_model(model):
    return model.bestModel if isinstance(model, CrossValidatorModel) else model


def forest_table(spark: SparkSession, model: RandomForestClassificationModel | CrossValidatorModel) -> DataFrame:
    """Stored nodes of a forest of two classes: split (feature, threshold, left, right) or, for leaves, the share of each class."""
    folder = stage_folder(spark, "forest")
    best_model(model).write().save(folder)
    node, stats = F.col("nodeData"), F.col("nodeData.impurityStats")
    total = F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
    return spark.read.parquet(f"{folder}/data").select(
        F.col("treeID").alias("tree"),
        node["id"].alias("node"),
        node["leftChild"].alias("left"),
        node["rightChild"].alias("right"),
        node["split"]["featureIndex"].alias("feature"),
        F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        *[(F.get(stats, F.lit(i)) / total).alias(f"share_{i}") for i in (0, 1)],
    )


def forest_sql(table: DataFrame, features: Sequence[str] = FEATURES) -> str:
    """The predicted class (0 or 1) of a stored forest: more of the trees' summed shares; equal sums are class 0.

    The table of a model is read to the driver; its size is that of the model, not of the data.
    """
    trees: dict[int, dict[int, object]] = {}
    for row in table.collect():
        trees.setdefault(row["tree"], {})[row["node"]] = row

    def text(nodes: dict[int, object], at: int, share: str) -> str:
        row = nodes[at]
        if row["left"] < 0:
            return number(row[share])
        test = f"{features[row['feature']]} <= {number(row['threshold'])}"
        return f"CASE WHEN {test} THEN {text(nodes, row['left'], share)} ELSE {text(nodes, row['right'], share)} END"

    sums = [" + ".join(f"({text(trees[t], 0, f'share_{i}')})" for t in sorted(trees)) for i in (0, 1)]
    return f"CASE WHEN {sums[1]} > {sums[0]} THEN 1 ELSE 0 END"


def logistic_sql(model: LogisticRegressionModel | CrossValidatorModel, features: Sequence[str] = FEATURES) -> str:
    """The predicted class (0 or 1) of a regression: one if its margin is above that of the threshold one half."""
    best = best_model(model)
    terms = [f"{number(float(c))} * {f}" for f, c in zip(features, best.coefficients.toArray(), strict=True)]
    return f"CASE WHEN {' + '.join([*terms, number(float(best.intercept))])} > 0 THEN 1 ELSE 0 END"


def predict(rows: DataFrame, rule: str) -> DataFrame:
    """``rows`` with ``prediction`` by a compiled rule."""
    return rows.withColumn("prediction", F.expr(rule).cast("double"))
