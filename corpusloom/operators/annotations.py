"""Structured annotations in JSON lines: requests, parsing, validation, distributions and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed

CONTENT = "array<struct<content:array<struct<type:string,text:string>>>>"
USAGE = "struct<input_tokens:long,output_tokens:long,input_tokens_details:struct<cached_tokens:long,cache_write_tokens:long>>"
BODY = f"struct<model:string,output_text:string,output:{CONTENT},usage:{USAGE}>"
OUTPUT = f"custom_id string, error struct<code:string,message:string>, response struct<status_code:int,body:{BODY}>"
KEYS = ["predicted_label", "primary_topic", "secondary_topic"]


def request(custom_id: Column, text: Column, model: str = "annotator", instructions: str = "", max_output_tokens: int = 96) -> Column:
    """One request line as JSON; it holds the text and nothing of its label."""
    body = F.struct(F.lit(model).alias("model"), F.lit(instructions).alias("instructions"), text.alias("input"), F.struct(F.lit("none").alias("effort")).alias("reasoning"), F.lit(max_output_tokens).alias("max_output_tokens"), F.lit(False).alias("store"))
    return F.to_json(F.struct(custom_id.alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/responses").alias("url"), body.alias("body")))


def output_text(body: Column) -> Column:
    """output_text unless blank, else the output_text parts of output[].content[] joined; trimmed."""
    parts = F.flatten(F.transform(F.coalesce(body["output"], F.array().cast(CONTENT)), lambda o: F.coalesce(o["content"], F.array().cast("array<struct<type:string,text:string>>"))))
    joined = F.array_join(F.transform(F.filter(parts, lambda c: c["type"] == "output_text"), lambda c: F.coalesce(c["text"], F.lit(""))), "")
    direct = F.trim(body["output_text"])
    return F.when(F.length(direct) > 0, direct).otherwise(F.trim(F.coalesce(joined, F.lit(""))))


def parse(raw: Column) -> tuple[Column, Column]:
    """(struct of the three fields, first reason to reject or null)."""
    keys = F.array_sort(F.json_object_keys(raw))
    rec = F.from_json(raw, "predicted_label string, primary_topic string, secondary_topic string")
    label, first, second = rec["predicted_label"], rec["primary_topic"], rec["secondary_topic"]
    no = lambda c: ~F.coalesce(c, F.lit(False))
    reason = (
        F.when(F.try_parse_json(raw).isNull() | keys.isNull(), "invalid_json")
        .when(no(keys == F.array(*[F.lit(k) for k in KEYS])), "unexpected_keys")
        .when(no(label.isin("0", "1", "0.0", "1.0", "false", "true")), "invalid_label")
        .when(no(first.isin(fixed.TOPICS)), "invalid_primary_topic")
        .when(no(second.isin([fixed.NO_SECONDARY, *fixed.TOPICS[1:]])), "invalid_secondary_topic")
        .when((first == fixed.FALLBACK_TOPIC) & (second != fixed.NO_SECONDARY), "t00_requires_no_secondary")
        .when((second != fixed.NO_SECONDARY) & (first == second), "duplicate_primary_secondary")
    )
    value = F.struct(F.when(label.isin("1", "1.0", "true"), 1).otherwise(0).alias("predicted_label"), first.alias("primary_topic"), second.alias("secondary_topic"))
    return F.when(reason.isNull(), value), reason


def evaluate(manifest: DataFrame, outputs: DataFrame) -> DataFrame:
    """One row a manifest row: status, annotation fields, token usage (missing counts are 0).

    outputs: custom_id and response (see OUTPUT), unique by custom_id (check with
    validate.repeated_keys). Rows without an output are 'missing_output_line'.
    """
    o = outputs.select(F.col("custom_id").alias("oid"), F.col("response.body").alias("body"))
    j = manifest.join(o, F.col("custom_id") == F.col("oid"), "left").withColumn("raw", F.when(F.col("body").isNotNull(), output_text(F.col("body"))))
    value, reason = parse(F.col("raw"))
    u = lambda p: F.coalesce(F.col(f"body.usage.{p}"), F.lit(0)).cast("long")
    j = j.withColumn("status", F.when(F.col("oid").isNull(), "missing_output_line").when(F.col("body").isNull(), "missing_response_body").otherwise(F.coalesce(reason, F.lit("ok")))).withColumn("a", value)
    return j.select(*manifest.columns, "status", F.col("a.predicted_label"), F.col("a.primary_topic"), F.col("a.secondary_topic"), u("input_tokens").alias("input_tokens"), u("output_tokens").alias("output_tokens"), u("input_tokens_details.cached_tokens").alias("cached_tokens"), u("input_tokens_details.cache_write_tokens").alias("cache_write_tokens"))


def codebook(spark, topics: list[str]) -> DataFrame:
    return spark.createDataFrame([(t,) for t in topics], "topic_id string")


def distribution(valid: DataFrame, col: str, topics: list[str]) -> DataFrame:
    """(topic_id, count, percent of all valid rows), zero-filled over topics."""
    n = valid.agg(F.count("*").alias("n"))
    g = valid.groupBy(F.col(col).alias("t")).agg(F.count("*").alias("c"))
    j = codebook(valid.sparkSession, topics).join(g, F.col("topic_id") == F.col("t"), "left").join(n)  # one row
    return j.select("topic_id", F.coalesce("c", F.lit(0)).alias("count"), F.coalesce(F.try_divide(F.coalesce("c", F.lit(0)) * 100.0, F.col("n")), F.lit(0.0)).alias("percent"))


def crosstab(valid: DataFrame, row: str, label: str, topics: list[str], labels: tuple = (0, 1)) -> DataFrame:
    """Counts of topics by label, and percentages within each label."""
    g = valid.groupBy(F.col(row).alias("t")).agg(*[F.count_if(F.col(label) == k).alias(f"label_{k}") for k in labels])
    j = codebook(valid.sparkSession, topics).join(g, F.col("topic_id") == F.col("t"), "left").drop("t").fillna(0)
    whole = Window.partitionBy(F.lit(0))  # a row a topic
    return j.select("topic_id", *[f"label_{k}" for k in labels], *[F.coalesce(F.try_divide(F.col(f"label_{k}") * 100.0, F.sum(f"label_{k}").over(whole)), F.lit(0.0)).alias(f"percent_{k}") for k in labels])


def topic_pairs(valid: DataFrame) -> DataFrame:
    """Primary and secondary topics that occur together, most frequent first, then by name."""
    return valid.where(F.col("secondary_topic") != fixed.NO_SECONDARY).groupBy("primary_topic", "secondary_topic").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "primary_topic", "secondary_topic")


def rates(valid: DataFrame) -> DataFrame:
    fallback, second = F.col("primary_topic") == fixed.FALLBACK_TOPIC, F.col("secondary_topic") != fixed.NO_SECONDARY
    return valid.agg(F.count("*").alias("n_valid"), F.count_if(fallback).alias("t00_count"), F.avg(fallback.cast("double")).alias("t00_rate"), F.count_if(second).alias("secondary_count"), F.avg(second.cast("double")).alias("secondary_rate"))


def usage(results: DataFrame, input_rate: float, output_rate: float) -> DataFrame:
    """Token totals, and their cost at rates per million tokens with all input uncached."""
    s = results.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "cached_tokens", "cache_write_tokens")])
    return s.withColumn("cost_usd", F.col("input_tokens") / 1e6 * input_rate + F.col("output_tokens") / 1e6 * output_rate)


def estimate(docs: DataFrame, text: str, input_rate: float, output_rate: float, fixed_tokens: int = 96, max_output: int = 96) -> DataFrame:
    """Requests, estimated input tokens (half the characters, up, plus a fixed share each) and the cost bound."""
    tok = F.ceil(F.length(F.coalesce(F.col(text), F.lit(""))) / 2.0) + fixed_tokens
    s = docs.agg(F.count("*").alias("requests"), F.coalesce(F.sum(tok), F.lit(0)).cast("long").alias("input_tokens_estimate"))
    return s.withColumn("cost_bound_usd", F.col("input_tokens_estimate") / 1e6 * input_rate + F.col("requests") * max_output / 1e6 * output_rate)


def upsert(registry: DataFrame, news: DataFrame, key: str, recency: str) -> DataFrame:
    """Rows of both, the most recent of each key (of equal recency the new one)."""
    both = registry.withColumn("__new", F.lit(0)).unionByName(news.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc(recency), F.desc("__new"))
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__new")


def failures(outputs: DataFrame, cause: str) -> DataFrame:
    """One row: failed requests, and whether all of them failed for the one known cause."""
    bad = outputs.where("error IS NOT NULL OR response.status_code <> 200")
    return bad.agg(F.count("*").alias("n_failed"), F.coalesce(F.bool_and(F.coalesce(F.col("error.code") == cause, F.lit(False))), F.lit(True)).alias("one_cause"))
