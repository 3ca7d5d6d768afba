"""Common inputs of the queries, in DataFrames and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize, token_count
from ..operators.splits import stratified_split
from .session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL where there is one."""

    def put(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return put


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, text, lang, source, norm, chars."""
    d = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    return d.withColumns({"norm": normalize(F.col("text")), "chars": F.length("text").cast("long")})


def raw_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The same without the normal form."""
    return table(spark, sf, "documents").select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("chars"))


def labelled(spark: SparkSession, sf: str, norm: bool = False) -> DataFrame:
    """Labelled documents: quality plays the label; pred is 1 from 1000 characters on, toks counts tokens."""
    d = documents(spark, sf) if norm else raw_documents(spark, sf)
    lab = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"), "toxic")
    return d.join(lab, "doc_id").withColumns({"pred": (F.col("chars") >= 1000).cast("int"), "toks": token_count(F.col("text"))})


def split_rows(spark: SparkSession, sf: str, norm: bool = False) -> DataFrame:
    return stratified_split(labelled(spark, sf, norm), "label")


def with_all(spark: SparkSession, sf: str) -> DataFrame:
    """All documents with their label, null where there is none."""
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("l_id"), F.col("quality").alias("label"), "toxic")
    return documents(spark, sf).join(lab, F.col("doc_id") == F.col("l_id"), "left").drop("l_id")


WORD = r"[\p{L}\p{N}\p{M}_]"
NORM = (
    r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), "
    r"'(?:https?://\S+|www\.\S+|\bhttps?\b\s*(?:[:/._-]\s*|\s+)[a-z0-9][a-z0-9\s._/-]{2,})', ' ', 'gi'), "
    r"'\b[\p{L}\p{N}\p{M}_.+-]+@[\p{L}\p{N}\p{M}_.-]+\.[a-zA-Z]{2,}\b', ' ', 'g'), "
    r"'(^|[^\p{L}\p{N}\p{M}_])@[\p{L}\p{N}\p{M}_.-]+', '\1 ', 'g'), '[\p{P}\p{S}]', ' ', 'g'), '\s+', ' ', 'g'))"
)
TOKS = r"list_filter(string_split(trim(regexp_replace({}, '\s+', ' ', 'g')), ' '), lambda t: t <> '')"
D = f"d AS (SELECT doc_id, text, lang, source, {NORM} AS norm, CAST(length(text) AS BIGINT) AS chars FROM documents)"
RAW = "d AS (SELECT doc_id, text, lang, source, CAST(length(text) AS BIGINT) AS chars FROM documents)"
LAB = f"lab AS (SELECT d.*, quality AS label, toxic, CASE WHEN chars >= 1000 THEN 1 ELSE 0 END AS pred, CAST(len({TOKS.format('text')}) AS BIGINT) AS toks FROM d JOIN labels USING (doc_id))"
SPLIT = """
per AS (SELECT label, count(*) AS n FROM lab GROUP BY label), tot AS (SELECT sum(n) AS t, ceil(sum(n) * CAST(0.2 AS DOUBLE)) AS want FROM per),
ex AS (SELECT label, n, n * want / t AS e, floor(n * want / t) AS low, want FROM per, tot),
pl AS (SELECT *, row_number() OVER (ORDER BY e - low DESC, label) AS place, want - (SELECT sum(low) FROM ex) AS lft FROM ex),
sz AS (SELECT label, n, CAST(low + (CASE WHEN place <= lft THEN 1 ELSE 0 END) AS BIGINT) AS n_test FROM pl),
sp AS (SELECT lab.*, CASE WHEN row_number() OVER (PARTITION BY lab.label ORDER BY sha256('42:' || doc_id)) <= n_test THEN 'test' ELSE 'train' END AS split FROM lab JOIN sz USING (label))"""
VECS = """
tk AS (SELECT doc_id, ' ' || t || ' ' AS p, count(*) AS c FROM (SELECT doc_id, unnest(string_split(norm, ' ')) AS t FROM d) WHERE t <> '' GROUP BY ALL),
g AS (SELECT doc_id, substr(p, i, n) AS term, c FROM tk, (VALUES (3), (4), (5)) AS s(n), unnest(range(1, greatest(1, len(p) - n + 2))) AS r(i) WHERE n <= len(p)),
tf AS (SELECT doc_id, term, sum(c) AS tf FROM g GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 2),
w0 AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1.0::DOUBLE + (SELECT count(*) FROM d)) / (1.0::DOUBLE + df)) + 1) AS w FROM tf JOIN df USING (term)),
nm AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM w0 GROUP BY 1), v AS MATERIALIZED (SELECT doc_id, term, w / n AS w FROM w0 JOIN nm USING (doc_id))"""


def cells_sql(gold: str, pred: str, where: str = "true") -> str:
    return ", ".join(f"count(*) FILTER (WHERE {gold} = {g} AND {pred} = {p} AND {where}) AS {n}" for n, g, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1)))


def ratio_sql(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0)"


def metric_sql(p: str = "") -> dict[str, str]:
    tn, fp, fn, tp = (f"{p}{c}" for c in ("tn", "fp", "fn", "tp"))
    f1, f0 = ratio_sql(f"2*{tp}", f"2*{tp}+{fp}+{fn}"), ratio_sql(f"2*{tn}", f"2*{tn}+{fp}+{fn}")
    return {"accuracy": ratio_sql(f"{tp}+{tn}", f"{tp}+{tn}+{fp}+{fn}"), "precision_class1": ratio_sql(tp, f"{tp}+{fp}"), "recall_class1": ratio_sql(tp, f"{tp}+{fn}"), "f1_class1": f1, "macro_f1": f"({f1} + {f0}) / 2", "balanced_accuracy": f"({ratio_sql(tp, f'{tp}+{fn}')} + {ratio_sql(tn, f'{tn}+{fp}')}) / 2"}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
