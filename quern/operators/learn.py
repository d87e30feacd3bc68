"""Page-type and change classifiers on pyspark.ml, and offline embeddings of descriptions."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import HashingTF, IndexToString, Normalizer, RegexTokenizer, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, functions as F


def embed(rows: DataFrame, text: str, dims: int = 384) -> DataFrame:
    """`rows` with `embedding`: hashed words of a text, unit length. A stand-in for a language model's embedding."""
    out = RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"\W+").transform(rows)
    out = HashingTF(inputCol="_w", outputCol="_tf", numFeatures=dims).transform(out)
    out = Normalizer(inputCol="_tf", outputCol="_v").transform(out)
    return out.withColumn("embedding", vector_to_array("_v")).drop("_w", "_tf", "_v")


def boosted(rounds: int) -> OneVsRest:
    """Gradient-boosted trees, one set against the rest for each class."""
    return OneVsRest(labelCol="_y", parallelism=4, classifier=GBTClassifier(labelCol="_y", maxIter=rounds, maxDepth=6, stepSize=0.1, seed=7))


def train(rows: DataFrame, label: str, kind: str = "logistic", folds: int = 0, rounds: int = 100) -> tuple[PipelineModel, float]:
    """`kind` is logistic, forest or boosted (with so many `rounds`). A classifier of `embedding` and its cross-validated accuracy (training accuracy without folds). Classes of fewer rows
    than folds can't be validated; folds then fall to the smallest class, at least two."""
    data = rows.select(label, array_to_vector("embedding").alias("features"))
    index = StringIndexer(inputCol=label, outputCol="_y", handleInvalid="error" if kind == "boosted" else "keep").fit(data)
    make = {"logistic": lambda: LogisticRegression(labelCol="_y", maxIter=100), "forest": lambda: RandomForestClassifier(labelCol="_y", numTrees=50, maxDepth=6, seed=7), "boosted": lambda: boosted(rounds)}
    classifier = make[kind]()
    names = IndexToString(inputCol="prediction", outputCol="predicted", labels=index.labels)
    score = MulticlassClassificationEvaluator(labelCol="_y", metricName="accuracy")
    ready = index.transform(data)
    if folds:
        least = rows.groupBy(label).count().agg(F.min("count")).first()[0]
        cv = CrossValidator(estimator=classifier, evaluator=score, estimatorParamMaps=ParamGridBuilder().build(), numFolds=max(2, min(folds, least, 5)), seed=7).fit(ready)
        fitted, accuracy = cv.bestModel, cv.avgMetrics[0]
    else:
        fitted = classifier.fit(ready)
        accuracy = score.evaluate(fitted.transform(ready))
    return PipelineModel([fitted, names]), accuracy


def save(model: PipelineModel, path: str) -> None:
    """A trained model under a path, in place of one that is there."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def importances(model: PipelineModel) -> list[float]:
    """What each dimension counts in a model: a forest's importances, their mean over boosted classes, or the mean size of a
    regression's weights."""
    fitted = model.stages[0]
    if hasattr(fitted, "models"):
        return (sum(m.featureImportances.toArray() for m in fitted.models) / len(fitted.models)).tolist()
    if hasattr(fitted, "featureImportances"):
        return fitted.featureImportances.toArray().tolist()
    return abs(fitted.coefficientMatrix.toArray()).mean(axis=0).tolist()


def train_changes(pairs: DataFrame, label: str, kind: str = "logistic") -> tuple[PipelineModel, float]:
    """A classifier of what a change does, from pairs of embeddings (old, new) and a label."""
    return train(change_features(pairs), label, kind)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """`rows` with `predicted` and `confidence`."""
    out = model.transform(rows.withColumn("features", array_to_vector("embedding")))
    if "probability" not in out.columns:  # boosted trees: margins of each class against the rest
        each = F.transform(vector_to_array("rawPrediction"), lambda m: 1 / (1 + F.exp(-2 * m)))
        shares = F.transform(each, lambda p: p / F.aggregate(each, F.lit(0.0), lambda a, x: a + x))
        out = out.withColumn("probability", array_to_vector(shares))
    return out.withColumn("confidence", F.array_max(vector_to_array("probability"))).drop("features", "rawPrediction", "probability", "prediction")


def change_features(pairs: DataFrame) -> DataFrame:
    """`pairs` (old, new arrays) with `embedding` for a change classifier: both, their difference and cosine."""
    from quern.functions import text as T
    both = F.concat("old", "new", F.zip_with("new", "old", lambda a, b: a - b), F.array(T.cosine(F.col("old"), F.col("new"))))
    return pairs.withColumn("embedding", both.cast("array<double>"))
