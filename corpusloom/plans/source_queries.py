"""Queries of sources and sinks: tables written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import io
from .base import query, raw_documents
from .session import table, work_dir


@query("s1_csv", "SELECT doc_id, sha256(text) AS text_sha256 FROM documents")
def s1(spark, sf):
    """Whole texts, quotes and line breaks too, through a gzipped CSV."""
    path = work_dir(spark, "csv")
    io.write_csv(raw_documents(spark, sf).select("doc_id", "text"), path, gzip=True)
    return io.read_csv(spark, path, "doc_id long, text string").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query("s5_json_lines", "SELECT conv_id * 1000 + turn AS id, role, sha256(text) AS text_sha256 FROM conversations")
def s5(spark, sf):
    """JSON lines out and in, with the guard against repeated ids."""
    path = work_dir(spark, "jsonl")
    rows = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", "text")
    io.write_jsonl(rows.select(F.to_json(F.struct("id", "role", "text")).alias("value")), path)
    return io.read_jsonl(spark, path, "id long, role string, text string", "id").select("id", "role", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query("s10_json", "SELECT n_nationkey, n_name FROM nation")
def s10(spark, sf):
    path = work_dir(spark, "json")
    io.write_json(table(spark, sf, "nation").select("n_nationkey", "n_name"), path)
    return spark.read.schema(table(spark, sf, "nation").select("n_nationkey", "n_name").schema).json(path)


@query("s12_checksums", "SELECT sha256(n_name || chr(10)) AS sha256, CAST(length(n_name) + 1 AS BIGINT) AS length FROM nation")
def s12(spark, sf):
    """One file a nation, and the files' checksums."""
    path = work_dir(spark, "files")
    n = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("value"))
    n.repartitionByRange(25, "n_nationkey").write.partitionBy("n_nationkey").text(path)
    return io.checksums(spark, path).select("sha256", "length")


@query("s14_stop_words", "SELECT DISTINCT role AS word FROM conversations")
def s14(spark, sf):
    path = work_dir(spark, "words")
    table(spark, sf, "conversations").select(F.concat(F.lit(" "), F.col("role"), F.lit("  ")).alias("value")).write.text(path)
    return io.read_stopwords(spark, path)


@query("s21_prediction_rows", "SELECT doc_id, quality AS gold, toxic AS pred FROM labels")
def s21(spark, sf):
    path = work_dir(spark, "predictions")
    l = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("gold"), F.col("toxic").alias("pred"))
    io.write_predictions(l, path, l.count())
    return io.read_csv(spark, path, "doc_id long, gold int, pred int")
