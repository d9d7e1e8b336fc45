"""TF-IDF + random-forest relabelling (F6, M7, M8, A25) and partial relabelling
(T2, T3).

Train on rows whose label is not 'outros' (null labels excluded -- the reference
trains on null as a class, a defect), predict the 'outros' rows, write back.
Spark MLlib trains the forest distributed; depth is capped at 30 (MLlib's limit,
the reference asks for 50).
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import CountVectorizer, ElementwiseProduct, IDF, IndexToString, Normalizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, functions as F

from .. import schema as S
from ..functions import text as X
from ..session import written
from .features import ngrams, tokens
from .sampling import stratified_sample_b

FOREST_PARAMS = dict(numTrees=200, maxDepth=30, minInstancesPerNode=2, seed=42, maxMemoryInMB=1024)
#: Training rows, drawn by W8: the trees live on the driver, so their size must not follow the data.
MAX_TRAIN_ROWS = 5000


def split_for_training(df: DataFrame, label: str = S.SUBCATEGORY) -> tuple[DataFrame, DataFrame]:
    """(training rows: label present and not 'outros', rows to classify: 'outros')."""
    flag = X.has_outro(label)
    return df.where(~flag & F.col(label).isNotNull()), df.where(flag)


def _grams(df: DataFrame, text) -> DataFrame:
    """Token 1..3-grams of the forest text as ``_grams``."""
    return df.withColumn("_grams", ngrams(tokens(text), 3))


class Forest:
    """Fitted vocabulary, weights (sklearn's idf, ``ln((1 + n) / (1 + df)) + 1``, L2 rows) and trees."""

    def __init__(self, stages: list, labels: list[str]):
        self.stages, self.labels = stages, labels

    def predict(self, df: DataFrame, key: str = S.KEY) -> DataFrame:
        """M7: ``(key, predicted, confidence)``; confidence is the largest class probability."""
        t = _grams(df, X.forest_text(df.columns)).select(key, "_grams")
        for stage in self.stages:
            t = stage.transform(t)
        t = IndexToString(inputCol="_pred", outputCol="predicted", labels=self.labels).transform(t)
        return t.select(key, "predicted", F.array_max(vector_to_array("_prob")).alias("confidence"))


def fit_forest(df: DataFrame, key: str = S.KEY, label: str = S.SUBCATEGORY, max_features: int = 5000,
               max_train_rows: int = MAX_TRAIN_ROWS, **forest) -> Forest:
    """M6 + M7: train on a stratified draw (W8) of the rows whose label is not 'outros'."""
    text = X.forest_text(df.columns)
    train, _ = split_for_training(df, label)
    drawn = stratified_sample_b(train.select(key, F.col(label).alias("_label"), text.alias("_text")),
                                "_label", key, max_train_rows).orderBy("_label")
    drawn = written(df.sparkSession, _grams(drawn, F.col("_text")).drop("_text"), "forest-rows")
    counts = CountVectorizer(inputCol="_grams", outputCol="_tf", vocabSize=max_features, minDF=2.0, maxDF=0.95).fit(drawn)
    idf = IDF(inputCol="_tf", outputCol="_idf").fit(counts.transform(drawn)).idf.toArray() + 1.0
    scale = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_tf", outputCol="_tfidf")
    norm = Normalizer(inputCol="_tfidf", outputCol="_x", p=2.0)
    index = StringIndexer(inputCol="_label", outputCol="_y", stringOrderType="alphabetAsc").fit(drawn)
    rows = index.transform(norm.transform(scale.transform(counts.transform(drawn)))).select("_x", "_y")
    rows = written(df.sparkSession, rows, "forest-features")
    trees = RandomForestClassifier(featuresCol="_x", labelCol="_y", predictionCol="_pred", probabilityCol="_prob",
                                   rawPredictionCol="_raw", **{**FOREST_PARAMS, **forest}).fit(rows)
    return Forest([counts, scale, norm, trees], index.labels)


def forest_predict(df: DataFrame, key: str = S.KEY, label: str = S.SUBCATEGORY, model: Forest | None = None,
                   **forest) -> DataFrame:
    """M7: predictions for the 'outros' rows, by ``model`` or one fitted here."""
    model = model or fit_forest(df, key, label, **forest)
    return model.predict(split_for_training(df, label)[1], key)


def relabel(df: DataFrame, predictions: DataFrame, key: str = S.KEY, label: str = S.SUBCATEGORY,
            top_n: int | None = None, first_n: int | None = None, candidates=None) -> DataFrame:
    """M8 + J3: write predictions back onto every row.

    ``top_n`` (T2): only the ``n`` most confident predictions are written.
    ``first_n`` (T3): only the first ``n`` rows in key order are considered.
    Both are top-k selections (per-partition top-k, then merge). Predictions with an
    ``accepted`` column are written only where it holds (T3; the forest, T2, has none).
    ``candidates`` (a boolean Column): only rows that can have a prediction are
    joined; the others are unioned back without a shuffle."""
    if candidates is not None:
        flagged = df.withColumn("_cand", candidates)
        rest = flagged.where(~F.col("_cand")).drop("_cand").withColumn(
            "relabel_confidence", F.lit(None).cast("double"))
        todo = flagged.where(F.col("_cand")).drop("_cand")
        return rest.unionByName(relabel(todo, predictions, key, label, top_n, first_n))
    p = predictions
    if top_n is not None:
        p = p.orderBy(F.col("confidence").desc(), F.col(key)).limit(top_n)
    elif first_n is not None:
        p = p.orderBy(F.col(key)).limit(first_n)
    if "accepted" in p.columns:
        p = p.where(F.col("accepted"))
    p = p.select(F.col(key).alias("_k"), F.col("predicted").alias("_p"),
                 F.col("confidence").alias("_c"))
    j = df.join(p, df[key].eqNullSafe(p["_k"]), "left")
    return j.withColumn(label, F.coalesce(F.col("_p").cast(dict(df.dtypes)[label]), F.col(label))) \
            .withColumn("relabel_confidence", F.col("_c")).drop("_k", "_p", "_c")


def confidence_summary(predictions: DataFrame) -> DataFrame:
    """Mean / min / max prediction confidence."""
    return predictions.agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"),
                           F.min("confidence").alias("min_confidence"),
                           F.max("confidence").alias("max_confidence"))
