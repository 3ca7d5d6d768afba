"""Readers and writers."""

from __future__ import annotations

import io
import platform
import zipfile
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOM = "\ufeff"
NO_VALUE = "\ufdd0\ufdd1\ufdd0"  # noncharacters; with the default, a quoted empty text would be read as null too


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A CSV with header and quoted line breaks; a byte-order mark before the first name is dropped.

    Columns are found by name; missing ones are an error, others are left out. An
    empty field is null, a quoted empty one an empty text; white space is kept.
    """
    want = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False, nullValue=NO_VALUE)
    raw = raw.toDF(*[c.removeprefix(BOM) for c in raw.columns])
    if missing := [f.name for f in want if f.name not in raw.columns]:
        raise ValueError(f"{path}: no columns {missing}")
    value = lambda f: F.col(f"`{f.name}`") if isinstance(f.dataType, T.StringType) else F.nullif(F.col(f"`{f.name}`"), F.lit("")).cast(f.dataType)
    return raw.select(*[value(f).alias(f.name) for f in want])


def read_nonempty(df: DataFrame, text: str) -> DataFrame:
    """Rows whose text is neither null nor blank."""
    return df.where(F.coalesce(F.trim(text), F.lit("")) != "")


def read_predictions(spark: SparkSession, pattern: str) -> DataFrame:
    """All .../<model>/d<dataset>/predictions.csv below a glob, with model and dataset from the path."""
    raw = spark.read.csv(pattern, header=True)
    raw = raw.toDF(*[c.removeprefix(BOM) for c in raw.columns])
    path = F.col("_metadata.file_path")
    named = spark.read.schema(", ".join(f"`{c}` string" for c in raw.columns)).csv(pattern, header=True, enforceSchema=True)
    return named.select(F.regexp_extract(path, r"/([^/]+)/d\d+/[^/]+$", 1).alias("model"), F.regexp_extract(path, r"/d(\d+)/[^/]+$", 1).cast("int").alias("dataset"), *[F.col(c).cast("long") for c in raw.columns])


def read_metrics(spark: SparkSession, pattern: str) -> DataFrame:
    """Metrics of finished runs, one JSON object a file."""
    fields = "model string, dataset int, n_test int, accuracy double, precision_class1 double, recall_class1 double, f1_class1 double, macro_f1 double, elapsed_seconds double"
    return spark.read.schema(fields).option("multiLine", True).json(pattern).orderBy("model", "dataset")


def read_jsonl(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """JSON lines; rows of a key that occurs more than once fail when they are read."""
    df = spark.read.schema(schema).json(path)
    n = df.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("__n"))
    j = df.join(n, F.col(key).eqNullSafe(F.col("__k")))
    return j.where(F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit(f"duplicate {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))).otherwise(F.lit("")).isNotNull()).select(df.columns)


def write_jsonl(lines: DataFrame, path: str, column: str = "value") -> None:
    lines.select(F.col(column).alias("value")).write.text(path)


def write_csv(df: DataFrame, path: str, gzip: bool = False) -> None:
    """With header; texts as they are, white space at their ends too."""
    df.write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, compression="gzip" if gzip else "none")


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_predictions(preds: DataFrame, path: str, expected: int) -> None:
    """Ids and labels without texts; the number of rows must be as expected."""
    if (n := preds.count()) != expected:
        raise ValueError(f"{n} predictions, expected {expected}")
    write_csv(preds.select("doc_id", "gold", "pred"), path)


def checksums(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, length, sha256) of files."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(pattern)
    return f.select("path", "length", F.sha2("content", 256).alias("sha256"))


def read_stopwords(spark: SparkSession, path: str) -> DataFrame:
    """(word): distinct non-blank lines."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''").distinct()


def read_project(spark: SparkSession, pattern: str) -> DataFrame:
    """Coded spans of zipped XML projects: (file, document, code, name, start, end, text)."""
    out = T.StructType.fromDDL("file string, document string, code string, name string, start int, end int, text string")

    def local(e) -> str:
        return e.tag.rpartition("}")[2]

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                z = zipfile.ZipFile(io.BytesIO(content))
                root = ElementTree.fromstring(z.read(next(n for n in z.namelist() if n.endswith(".qde"))))
                names = {e.get("guid"): e.get("name") for e in root.iter() if local(e) == "Code"}
                for src in (e for e in root.iter() if local(e) == "TextSource"):
                    ref = (src.get("plainTextPath") or "").removeprefix("internal://")
                    member = next((n for n in z.namelist() if ref and n.endswith(ref)), None)
                    text = z.read(member).decode("utf-8-sig") if member else ""
                    for sel in (e for e in src.iter() if local(e) == "PlainTextSelection"):
                        a, b = int(sel.get("startPosition", 0)), int(sel.get("endPosition", 0))
                        rows += [(path, src.get("name"), r.get("targetGUID"), names.get(r.get("targetGUID")), a, b, text[a:b]) for r in sel.iter() if local(r) == "CodeRef"]
            if rows:
                kinds = [pa.int32() if f in ("start", "end") else pa.string() for f in out.names]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=out.names)

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInArrow(run, out)


def read_word2vec(spark: SparkSession, path: str, rows: int = 4096) -> DataFrame:
    """(token, vector) of a binary word2vec file on a mounted path: a header "n dim", then a word, a space and dim 32-bit floats each.

    The format has no index, so one task streams the file, rows words at a time.
    """

    def run(_):
        with open(path, "rb") as f:
            n, dim = map(int, f.readline().split())
            words, vectors = [], []
            for i in range(n):
                w = bytearray()
                while (c := f.read(1)) not in (b" ", b""):
                    if c != b"\n":  # some writers end each vector with one
                        w += c
                raw = f.read(4 * dim)
                if len(raw) < 4 * dim:
                    raise ValueError(f"{path} ends in word {i} of {n}")
                words.append(w.decode("utf-8", "replace"))
                vectors.append(np.frombuffer(raw, "<f4"))
                if len(words) == rows or i == n - 1:
                    flat = pa.array(np.concatenate(vectors))
                    yield pa.RecordBatch.from_arrays([pa.array(words), pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1) * dim, pa.int32()), flat)], names=["token", "vector"])
                    words, vectors = [], []

    return spark.range(0, 1, 1, 1).mapInArrow(run, "token string, vector array<float>")


def save_model(model, path: str) -> None:
    """A fitted spark.ml model or pipeline, replacing an earlier one."""
    model.write().overwrite().save(path)


def load_model(cls, path: str):
    return cls.load(path)


def runtime(spark: SparkSession) -> dict:
    """Versions and settings for a run's record."""
    conf = spark.sparkContext.getConf()
    return {"spark": spark.version, "python": platform.python_version(), "platform": platform.platform(), "master": spark.sparkContext.master, "parallelism": spark.sparkContext.defaultParallelism, "app": conf.get("spark.app.name")}


def manifest(records: DataFrame, digits: int = 6) -> DataFrame:
    """One row: all records as a JSON array in order, doubles rounded (for a few result rows)."""
    cols = [F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in records.dtypes]
    return records.select(F.struct(*cols).alias("r")).agg(F.to_json(F.array_sort(F.collect_list("r"))).alias("records"))


def report(rows: DataFrame, title: str) -> str:
    """A Markdown table of all result rows, fetched partition by partition."""
    got = rows.toLocalIterator()
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    lines += ["| " + " | ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in got]
    return "\n".join(lines) + "\n"
