"""Coded passages, topics and annotations side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def theme_frequencies(codes: DataFrame, total: int | None = None, theme: str = "theme", doc_id: str = "doc_id") -> DataFrame:
    """(theme, passages, documents, share): most passages first, then by name; share of total documents."""
    n = F.lit(total) if total is not None else F.col("n_docs")
    g = codes.groupBy(theme).agg(F.count("*").alias("passages"), F.count_distinct(doc_id).alias("documents"))
    g = g if total is not None else g.join(codes.agg(F.count_distinct(doc_id).alias("n_docs")))  # one row
    return g.select(theme, "passages", "documents", F.try_divide(F.col("documents") * 100.0, n).alias("share")).orderBy(F.desc("passages"), theme)


def rate_matrix(codes: DataFrame, row: str, col: str, sizes: DataFrame) -> DataFrame:
    """(row, col, n, rate): counts and 100 * n over the column's size; sizes is (col, size)."""
    g = codes.groupBy(row, col).agg(F.count("*").alias("n"))
    return g.join(sizes.select(F.col(col).alias("c2"), "size"), F.col(col) == F.col("c2")).select(row, col, "n", F.try_divide(F.col("n") * 100.0, F.col("size")).alias("rate"))


def modes(rows: DataFrame, group: str, value: str, doc_id: str) -> DataFrame:
    """Each group's most frequent value (ties by name), its records, all records and distinct documents."""
    g = rows.groupBy(group, value).agg(F.count("*").alias("records"))
    w = Window.partitionBy(group).orderBy(F.desc("records"), value)
    top = g.withColumn("r", F.row_number().over(w)).where("r = 1").select(group, F.col(value).alias("most_common"), F.col("records").alias("topic_records"))
    n = rows.groupBy(F.col(group).alias("g2")).agg(F.count("*").alias("records"), F.count_distinct(doc_id).alias("documents"))
    return top.join(n, F.col(group) == F.col("g2")).drop("g2")


def records_histogram(rows: DataFrame, doc_id: str) -> DataFrame:
    """(records, documents): how many documents have how many records."""
    return rows.groupBy(doc_id).agg(F.count("*").alias("records")).groupBy("records").agg(F.count("*").alias("documents"))


def two_shares(rows: DataFrame, theme: str, themes: list[str], doc_id: str, first: int, second: int) -> DataFrame:
    """Documents with each of some themes, over two denominators."""
    g = rows.where(F.col(theme).isin(themes)).groupBy(theme).agg(F.count_distinct(doc_id).alias("documents"))
    return g.select(theme, "documents", F.try_divide(F.col("documents") * 100.0, F.lit(first)).alias("share_first"), F.try_divide(F.col("documents") * 100.0, F.lit(second)).alias("share_second"))


def joint_display(topics: DataFrame, themes: DataFrame, annotations: DataFrame) -> DataFrame:
    """One row a topic: its size, its leading theme and its leading annotation; each input has topic first."""
    t, a = themes.withColumnRenamed("topic", "t2"), annotations.withColumnRenamed("topic", "t3")
    return topics.join(t, F.col("topic") == F.col("t2"), "left").join(a, F.col("topic") == F.col("t3"), "left").drop("t2", "t3").orderBy("topic")


def name_codes(spans: DataFrame, codes: DataFrame) -> DataFrame:
    """Spans (code, ...) with the codes' names; codes is (guid, name), a bounded code book."""
    return spans.join(codes.select(F.col("guid").alias("g"), "name"), F.col("code") == F.col("g"), "left").drop("g")
