"""Deterministic stratified splits and folds.

Rows of a label are ordered by the SHA-256 of 'seed:id'. The test share of each
label follows from largest remainders of ceil(share * n). Ranks within a label
come from a two-level count: rows are dealt to buckets by the hash's start, buckets
counted, and rows ranked within their bucket, so no label is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(doc_id: str, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(doc_id).cast("string")), 256)


def ranked(rows: DataFrame, label: str, doc_id: str = "doc_id", seed: int = 42) -> DataFrame:
    """Adds rank, from 1 within label by order_key."""
    h = rows.withColumn("__h", order_key(doc_id, seed)).withColumn("__b", F.substring("__h", 1, 3))
    sizes = h.groupBy(F.col(label).alias("__l"), F.col("__b").alias("__sb")).agg(F.count("*").alias("__n"))  # at most 4096 a label
    before = Window.partitionBy("__l").orderBy("__sb").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).select("__l", "__sb", "__before")
    h = h.join(sizes, F.col(label).eqNullSafe(F.col("__l")) & (F.col("__b") == F.col("__sb")))
    inside = F.row_number().over(Window.partitionBy(label, "__b").orderBy("__h"))
    return h.withColumn("rank", (inside + F.col("__before")).cast("long")).drop("__h", "__b", "__l", "__sb", "__before")


def test_sizes(rows: DataFrame, label: str, share: float = 0.2) -> DataFrame:
    """(label, n, n_test): ceil(share * all) dealt to labels by largest remainder, ties to the smaller label."""
    per = rows.groupBy(label).agg(F.count("*").alias("n"))
    one = Window.partitionBy(F.lit(0))  # a row a label
    total = F.sum("n").over(one)
    want = F.ceil(total * share)
    exact = F.col("n") * want / total
    per = per.withColumn("low", F.floor(exact)).withColumn("part", exact - F.col("low")).withColumn("left", want - F.sum("low").over(one))
    per = per.withColumn("place", F.row_number().over(one.orderBy(F.desc("part"), label)))
    return per.select(label, "n", (F.col("low") + (F.col("place") <= F.col("left")).cast("int")).cast("long").alias("n_test"))


def stratified_split(rows: DataFrame, label: str, doc_id: str = "doc_id", share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds split, 'test' or 'train'."""
    sizes = F.broadcast(test_sizes(rows, label, share).select(F.col(label).alias("__sl"), "n_test"))  # a row a label
    r = ranked(rows, label, doc_id, seed).join(sizes, F.col(label).eqNullSafe(F.col("__sl")))
    return r.withColumn("split", F.when(F.col("rank") <= F.col("n_test"), "test").otherwise("train")).drop("rank", "n_test", "__sl")


def validation_split(rows: DataFrame, label: str, doc_id: str = "doc_id", share: float = 0.125, seed: int = 43) -> DataFrame:
    """Cuts validation rows out of the training rows."""
    train = rows.where("split = 'train'").drop("split")
    inner = stratified_split(train, label, doc_id, share, seed).withColumn("split", F.when(F.col("split") == "test", "validation").otherwise("train"))
    return inner.unionByName(rows.where("split <> 'train'"))


def folds(rows: DataFrame, label: str, doc_id: str = "doc_id", k: int = 5, seed: int = 44) -> DataFrame:
    """Adds fold, 0 to k - 1, even within every label."""
    return ranked(rows, label, doc_id, seed).withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).drop("rank")
