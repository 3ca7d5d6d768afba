"""The corpus pipeline: five stages over documents, each calling one operator.

Each stage is (spark, docs, sf_dir) -> DataFrame; all but the last return the
columns of docs. run() writes every stage's result to the shared folder and
reads it back for the next one.

- language: documents without any language (null text or no letter) go; if no row
  is labelled, nothing can be learned and all stay.
- near_duplicates: of each group of linked documents, which share at least four
  fifths of their five-word shingles, the one with the smallest id stays. Rows with
  a null id always stay; rows with equal ids are one document.
- repeated_text: byte strings of 50 that a document with a smaller id also has
  are cut; n_chars, where there is one, follows the text. Characters that a cut
  leaves broken go.
- benchmark: documents of whose words at least one in twenty lies in a benchmark
  passage go.
- tokens: ids of the text left, with digests of them and of their decoding.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import bpe, decontam, langid, simhash, suffixdedup
from corpusloom.llm.common import Store, add_columns, local_path, store_rows, tasks
from corpusloom.plans.session import created, materialize, remove, table, work_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs)
    if not model["langs"]:
        return docs
    marked = langid.identify(_beside(docs), model)
    return _back(marked.where(F.col("lang_pred") != langid.UNKNOWN), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids to drop go to a store that a pass over the documents looks up, so texts aren't shuffled."""
    groups = simhash.similar_groups(docs.select("doc_id", "text"))
    drop = groups.where(F.col("doc_id") > F.col("component_id")).select(F.col("doc_id").alias("key")).distinct()
    where, shards = local_path(work_dir(spark, "near-drop")), max(16, tasks(docs))
    store_rows(drop, where, shards, {})

    def make():
        store = Store(where, shards, {})

        def fn(batch):
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            hit = store.find(np.array([0 if i is None else i for i in ids], np.int64).view(np.uint64))[0]
            return [[i is None or not h for i, h in zip(ids, hit.tolist(), strict=True)]]

        return fn

    marked = add_columns(_beside(docs), [T.StructField("stays", T.BooleanType())], make)
    return _back(marked.where("stays"), docs)


def repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = [*suffixdedup.FIELDS[:3], T.StructField("text", T.StringType())]
    kept = _back(suffixdedup.remove_repeats(_beside(docs), fields=cut, finish=lambda b: b.decode("utf-8", "ignore")), docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    marked = decontam.find_contamination(_beside(docs), table(spark, sf_dir, "benchmark"))
    return _back(marked.where(~decontam.is_contaminated()), docs)


TOKENS = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = bpe.default_path("word_bpe_49k.json")

    def make():
        tok = bpe.word_tokenizer(path)

        def fn(batch):
            out = [[], [], [], []]
            for t in batch.column(batch.schema.get_field_index("text")).to_pylist():
                ids = tok.encode(t)
                for o, x in zip(out, (ids.astype(np.int32), len(ids), hashlib.sha256(tok.decimal(ids)).hexdigest(), hashlib.sha256(tok.decode(ids)).hexdigest()), strict=True):
                    o.append(x)
            return out

        return fn

    return add_columns(docs, TOKENS, make, [c for c in docs.columns if c != "text"])


def _beside(docs: DataFrame) -> DataFrame:
    """Columns other than doc_id and text under names that no operator uses."""
    return docs.select(*[F.col(c) if c in ("doc_id", "text") else F.col(c).alias(f"__{c}") for c in docs.columns])


def _back(marked: DataFrame, docs: DataFrame) -> DataFrame:
    return marked.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"__{c}").alias(c) for c in docs.columns])


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_text", repeated_text), ("benchmark", benchmark), ("tokens", tokens)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Once a stage is written, what it made on the way and the stage before go."""
    docs, last = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with created() as made:
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        for path in last + made[:-1]:
            remove(spark, path)
        last = made[-1:]  # the stage's own table is written last
    return docs
