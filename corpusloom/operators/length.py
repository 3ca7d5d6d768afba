"""Length descriptives and length-matched subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import log_bin


def descriptives(rows: DataFrame, *by: str, chars: str = "chars", toks: str = "toks") -> DataFrame:
    """n, mean, median and interpolated tenths of characters; mean and median of tokens."""
    q = F.percentile(chars, [0.5, 0.1, 0.9])
    g = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(chars).alias("chars_mean"), q.alias("q"), F.avg(toks).alias("tokens_mean"), F.median(toks).alias("tokens_median"))
    return g.select(*by, "n", "chars_mean", *[F.col("q")[i].alias(c) for i, c in enumerate(("chars_median", "chars_p10", "chars_p90"))], "tokens_mean", "tokens_median")


def match(rows: DataFrame, ratio: float, label: str = "label", doc_id: str = "doc_id", chars: str = "chars") -> DataFrame:
    """(id0, id1, abs_log_difference): pairs of a label 0 and a label 1 document in the same bin of log length.

    In a bin with m0 and m1 documents, min(m0, m1) are taken from each at equal
    quantile positions of (length, id).
    """
    t = rows.select(F.col(doc_id).alias("id"), F.col(label).alias("l"), F.log1p(F.col(chars).cast("double")).alias("log_chars"), log_bin(F.col(chars), ratio).alias("bin"))
    sizes = t.groupBy("bin").agg(F.count_if(F.col("l") == 0).alias("m0"), F.count_if(F.col("l") == 1).alias("m1")).where("m0 > 0 AND m1 > 0").withColumnRenamed("bin", "sbin")
    t = t.withColumn("rank", F.row_number().over(Window.partitionBy("bin", "l").orderBy("log_chars", "id")) - 1).join(sizes, F.col("bin") == F.col("sbin"))
    n, m = F.least("m0", "m1"), F.when(F.col("l") == 0, F.col("m0")).otherwise(F.col("m1"))
    # row r is the place j with floor((j + 0.5) * m / n) = r, if there is one
    j = F.ceil(F.col("rank") * n / m - 0.5)
    t = t.withColumn("j", F.greatest(j, F.lit(0)).cast("long"))
    t = t.where((F.floor((F.col("j") + 0.5) * m / n) == F.col("rank")) & (F.col("j") < n))
    a, b = t.where("l = 0").select("bin", "j", F.col("id").alias("id0"), F.col("log_chars").alias("c0")), t.where("l = 1").select("bin", "j", F.col("id").alias("id1"), F.col("log_chars").alias("c1"))
    return a.join(b, ["bin", "j"]).select("id0", "id1", F.abs(F.col("c0") - F.col("c1")).alias("abs_log_difference"))


def matched(rows: DataFrame, pairs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of matched documents."""
    ids = pairs.select(F.explode(F.array("id0", "id1")).alias("mid"))
    return rows.join(ids, F.col(doc_id) == F.col("mid"), "left_semi")


def balance(rows: DataFrame, pairs: DataFrame, label: str = "label", chars: str = "chars", doc_id: str = "doc_id") -> DataFrame:
    """One row: coverage and the standardised mean difference of log length after matching."""
    sub = matched(rows, pairs, doc_id).withColumn("lc", F.log1p(F.col(chars).cast("double")))
    of = lambda v, k: F.when(F.col(label) == k, v)
    s = sub.agg(
        F.count("*").alias("matched_n"),
        ((F.avg(of(F.col("lc"), 1)) - F.avg(of(F.col("lc"), 0))) / F.sqrt((F.var_samp(of(F.col("lc"), 1)) + F.var_samp(of(F.col("lc"), 0))) / 2)).alias("matched_log_char_smd"),
        F.median(of(F.col(chars), 0)).alias("matched_label0_median_chars"),
        F.median(of(F.col(chars), 1)).alias("matched_label1_median_chars"),
    )
    p = pairs.agg(F.count("*").alias("matched_pairs"), F.max("abs_log_difference").alias("max_abs_log_char_diff"))
    return rows.agg(F.count("*").alias("test_n")).join(p).join(s).withColumn("test_coverage", F.try_divide("matched_n", "test_n"))  # one row each
