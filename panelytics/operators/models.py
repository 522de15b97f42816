"""Models of core membership with Spark ML."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelytics.operators.filters import SLOTS, key_slot

# Grids and shares of the published models.
FEATURES = ["age_in_months", "is_orphan", "is_bot_created", "pred_qual", "in_main", "out_main"]
SEED = 2023
TRAIN_SHARE = 0.7
METRICS = ["accuracy", "f1", "weightedPrecision", "weightedRecall"]


def feature_table(
    labelled: DataFrame, meta: DataFrame, at: dt.date, features: Sequence[str] = FEATURES
) -> DataFrame:
    """One row per entity and volume row: ``is_core`` and its features, complete rows only."""
    plain = [f for f in features if f != "age_in_months"]
    joined = labelled.join(meta.select("page_id", "creation_date", *plain), "page_id")
    return joined.select(
        "page_id",
        (F.col("volume") == "core").cast("int").alias("is_core"),
        F.months_between(F.lit(at), "creation_date").alias("age_in_months"),
        *plain,
    ).dropna()


def assembled(table: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Features as one vector."""
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(table)


def split(table: DataFrame, train: float = TRAIN_SHARE, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the entity.

    Rows of an entity stay together and lost executors cannot change the
    split, which a random draw over unordered partitions does not promise.
    """
    spot, cut = key_slot(F.col("page_id"), seed), int(train * SLOTS)
    return table.where(spot < cut), table.where(spot >= cut)


def with_class_weight(table: DataFrame, label: str = "is_core") -> DataFrame:
    """Each class weighs the inverse of twice its share, as one aggregate row."""
    share = table.agg(F.avg(F.col(label)).alias("_s")).select("_s").scalar()
    one = F.try_divide(F.lit(0.5), share)
    zero = F.try_divide(F.lit(0.5), 1 - share)
    return table.withColumn("weight", F.when(F.col(label) == 1, one).otherwise(zero))


def fit_forest(
    train: DataFrame, depths: Sequence[int] = (5, 10, 15), trees: Sequence[int] = (5, 20, 50), folds: int = 3
) -> CrossValidatorModel:
    """Random forest chosen by cross-validated f1."""
    model = RandomForestClassifier(labelCol="is_core", featuresCol="features", weightCol="weight", seed=SEED)
    grid = ParamGridBuilder().addGrid(model.maxDepth, list(depths)).addGrid(model.numTrees, list(trees)).build()
    return _validated(model, grid, folds).fit(train)


def fit_logistic(
    train: DataFrame,
    penalties: Sequence[float] = (0.0, 0.01, 0.1),
    mixing: Sequence[float] = (0.0, 0.01, 0.1),
    folds: int = 3,
) -> CrossValidatorModel:
    """Logistic regression chosen by cross-validated f1."""
    model = LogisticRegression(labelCol="is_core", featuresCol="features", weightCol="weight")
    grid = (
        ParamGridBuilder()
        .addGrid(model.regParam, list(penalties))
        .addGrid(model.elasticNetParam, list(mixing))
        .build()
    )
    return _validated(model, grid, folds).fit(train)


def _validated(model, grid, folds: int) -> CrossValidator:
    f1 = MulticlassClassificationEvaluator(labelCol="is_core", predictionCol="prediction", metricName="f1")
    return CrossValidator(
        estimator=model, estimatorParamMaps=grid, evaluator=f1, numFolds=folds, seed=SEED, parallelism=8
    )


def evaluate(predictions: DataFrame, label: str = "is_core") -> DataFrame:
    """Accuracy, f1, weighted precision and recall from the confusion counts.

    One aggregate over the predictions gives all measures.
    """
    cells = confusion(predictions, label)
    tp, fn, fp, tn = (F.col(c).cast("double") for c in ("tp", "fn", "fp", "tn"))
    n = tp + fn + fp + tn
    pos, neg = (tp + fn) / n, (tn + fp) / n
    zero = F.lit(0.0)

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), zero)

    p1, r1, p0, r0 = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fn), ratio(tn, tn + fp)
    f1, f0 = ratio(2 * p1 * r1, p1 + r1), ratio(2 * p0 * r0, p0 + r0)
    return cells.select(
        ((tp + tn) / n).alias("accuracy"),
        (pos * f1 + neg * f0).alias("f1"),
        (pos * p1 + neg * p0).alias("weightedPrecision"),
        (pos * r1 + neg * r0).alias("weightedRecall"),
    )


def confusion(predictions: DataFrame, label: str = "is_core") -> DataFrame:
    """The four counts and their rates; ``npv`` is what is sometimes called TNR."""
    y, p = F.col(label) == 1, F.col("prediction") == 1
    counts = predictions.agg(
        F.count_if(y & p).alias("tp"), F.count_if(y & ~p).alias("fn"),
        F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"),
    )
    return counts.select(
        "*",
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("tpr"),
        F.try_divide(F.col("tn"), F.col("tn") + F.col("fp")).alias("tnr"),
        F.try_divide(F.col("tn"), F.col("tn") + F.col("fn")).alias("npv"),
    )


def importances(model, table: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Importance or coefficient per feature, one short row each."""
    best = model.bestModel if isinstance(model, CrossValidatorModel) else model
    vector = best.featureImportances if hasattr(best, "featureImportances") else best.coefficients
    rows = [(f, float(v)) for f, v in zip(features, vector.toArray(), strict=True)]
    return table.sparkSession.createDataFrame(rows, "feature string, value double")


def deviance_test(train: DataFrame, weight: str | None = "weight") -> tuple[object, DataFrame]:
    """Binomial GLM of the training rows, weighted by class, with the drop in deviance against the null model."""
    glm = GeneralizedLinearRegression(family="binomial", link="logit", labelCol="is_core", featuresCol="features")
    glm = (glm.setWeightCol(weight) if weight else glm).fit(train)
    s = glm.summary
    row = [(float(s.nullDeviance), float(s.deviance), float(s.nullDeviance - s.deviance), int(s.residualDegreeOfFreedomNull - s.residualDegreeOfFreedom))]
    return glm, train.sparkSession.createDataFrame(
        row, "null_deviance double, deviance double, chi2 double, degrees bigint"
    )
