"""Baseline classifiers on spark.ml."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import CountVectorizer, ElementwiseProduct, Normalizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_ngrams
from . import metrics


class MacroF1(Evaluator):
    """Unweighted mean of both classes' F1."""

    def __init__(self, label: str = "label", prediction: str = "prediction"):
        super().__init__()
        self.label, self.prediction = label, prediction

    def _evaluate(self, dataset: DataFrame) -> float:
        return metrics.evaluate(dataset, gold=self.label, pred=self.prediction).first()["macro_f1"]

    def isLargerBetter(self) -> bool:
        return True


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """Adds weight = n / (classes * n of the label)."""
    g = rows.groupBy(F.col(label).alias("l")).agg(F.count("*").alias("c"))
    t = g.agg(F.sum("c").alias("n"), F.count("*").alias("k"))
    w = g.join(t).select("l", (F.col("n") / (F.col("k") * F.col("c"))).alias("weight"))  # a row a label
    return rows.join(F.broadcast(w), F.col(label) == F.col("l")).drop("l")


def word_features(rows: DataFrame, text: str = "text", out: str = "terms", lo: int = 1, hi: int = 2) -> DataFrame:
    """Word lo- to hi-grams of tokens of two or more word characters."""
    toks = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    return rows.withColumn(out, word_ngrams(toks, lo, hi))


def tfidf_features(train: DataFrame, rows: DataFrame, min_df: int = 1, vocab: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Unit tf-idf vectors (raw counts times smooth idf + 1) for training rows and others; idf of the training rows.

    vocab is the models' own max_features: of more terms the most frequent stay.
    """
    cv = CountVectorizer(inputCol="terms", outputCol="tf", minDF=min_df, vocabSize=vocab).fit(train)
    n = train.count()
    df = cv.copy({cv.getParam("binary"): True}).transform(train)
    present = df.select(Summarizer.metrics("numNonZeros").summary(F.col("tf")).alias("s")).first()["s"]["numNonZeros"].toArray()
    idf = np.log((1 + n) / (1 + present)) + 1

    scale = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="tf", outputCol="scaled")
    norm = Normalizer(inputCol="scaled", outputCol="features")
    both = [norm.transform(scale.transform(cv.transform(x))) for x in (train, rows)]
    return both[0], both[1]


def text_model(kind: str = "lr", reg: float = 0.01, label: str = "label") -> Estimator:
    """Logistic regression or linear SVM on features with weights (an RBF kernel has no spark.ml counterpart)."""
    if kind == "lr":
        return LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight", regParam=reg, maxIter=50)
    return LinearSVC(featuresCol="features", labelCol=label, weightCol="weight", regParam=reg, maxIter=50)


def grid(train: DataFrame, kind: str = "lr", regs=(0.001, 0.01, 0.1), fold: str = "fold", label: str = "label") -> DataFrame:
    """(reg, mean_macro_f1, rank) over the rows' folds."""
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    est = text_model(kind, label=label)
    params = ParamGridBuilder().addGrid(est.regParam, list(regs)).build()
    k = train.select(F.max(fold)).first()[0] + 1
    cv = CrossValidator(estimator=est, estimatorParamMaps=params, evaluator=MacroF1(label), numFolds=k, foldCol=fold, parallelism=4).fit(train)
    rows = sorted(zip(regs, cv.avgMetrics, strict=True), key=lambda r: -r[1])
    return train.sparkSession.createDataFrame([(float(r), float(m), i + 1) for i, (r, m) in enumerate(rows)], "reg double, mean_macro_f1 double, rank int")


def search(train: DataFrame, kind: str = "svm", ngrams=((1, 2),), vocabs=(10_000,), cs=(1.0, 10.0), text: str = "text", label: str = "label", fold: str = "fold") -> DataFrame:
    """(lo, hi, vocab, c, mean_macro_f1, rank): a grid search over the rows' folds, best first, ties to the earlier point.

    Features are fitted anew on each fold's training part. c weighs the sum of losses
    against half the squared weights, as in regParam = 1 / (c * rows) without
    standardising. The defaults are the linear SVM's grid; that of logistic regression
    is ngrams ((1, 1), (1, 2)), vocabs (1000, 5000, 10000), cs (0.1, 0.5, 1, 2, 10).
    """
    k = train.select(F.max(fold)).first()[0] + 1
    scores: dict[tuple, list[float]] = {}
    for lo, hi in ngrams:
        terms = word_features(train, text, lo=lo, hi=hi).select(label, fold, "terms").cache()
        for vocab in vocabs:
            for f in range(k):
                fit = class_weights(terms.where(F.col(fold) != f), label)
                a, b = (x.select(label, "features", *(["weight"] if "weight" in x.columns else [])).cache() for x in tfidf_features(fit, terms.where(F.col(fold) == f), vocab=vocab))
                n = a.count()

                def one(c, a=a, b=b, n=n):
                    est = text_model(kind, 1.0 / (c * max(1, n)), label).setStandardization(False)
                    return MacroF1(label).evaluate(est.fit(a).transform(b))

                with ThreadPoolExecutor(len(cs)) as pool:
                    for c, s in zip(cs, pool.map(one, cs), strict=True):
                        scores.setdefault((lo, hi, vocab, float(c)), []).append(s)
                a.unpersist(), b.unpersist()
        terms.unpersist()
    order = sorted(((p, float(np.mean(s))) for p, s in scores.items()), key=lambda x: -x[1])
    rows = [(*p, m, i + 1) for i, (p, m) in enumerate(order)]
    return train.sparkSession.createDataFrame(rows, "lo int, hi int, vocab int, c double, mean_macro_f1 double, rank int")


def length_models(train: DataFrame, test: DataFrame, label: str = "label", chars: str = "chars", toks: str = "toks") -> DataFrame:
    """(model, doc_id, gold, pred, score) of every length-only model: majority, logistic regression on one or both lengths, a shallow tree."""
    sides = [x.select("doc_id", F.col(label).cast("int").alias("gold"), F.log1p(F.col(chars).cast("double")).alias("c"), F.log1p(F.col(toks).cast("double")).alias("t")) for x in (train, test)]
    train, test = sides[0].cache(), sides[1].cache()
    out = test.join(metrics.majority(train, "gold").toDF("pred")).select(F.lit("majority").alias("model"), "doc_id", "gold", "pred", F.lit(None).cast("double").alias("score"))
    for name, cols in (("lr_chars", ["c"]), ("lr_tokens", ["t"]), ("lr_both", ["c", "t"])):
        pipe = Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(labelCol="gold", maxIter=100)])
        out = out.unionByName(_scored(pipe.fit(train).transform(test), name))
    tree = Pipeline(stages=[VectorAssembler(inputCols=["c", "t"], outputCol="features"), DecisionTreeClassifier(labelCol="gold", maxDepth=3, minInstancesPerNode=20, maxBins=256, seed=42)])
    return out.unionByName(_scored(tree.fit(train).transform(test), "tree"))


def _scored(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.lit(name).alias("model"), "doc_id", "gold", F.col("prediction").cast("int").alias("pred"), vector_to_array("probability")[1].alias("score"))


def lookup_vectors(tokens: DataFrame, vectors: DataFrame, token: str = "token") -> DataFrame:
    """One row: vocabulary words with and without a vector in (token, vector)."""
    v = tokens.select(token).distinct().join(vectors.select(F.col(token).alias("vt"), F.lit(1).alias("hit")), F.col(token) == F.col("vt"), "left")
    return v.agg(F.count_if(F.col("hit").isNotNull()).alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses"))
