"""Checks of tables. Each returns a DataFrame or figure; require() turns a failed one into an error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


def require_columns(df: DataFrame, names: list[str], exact: bool = False) -> None:
    """The columns are just these in this order (exact), or include them."""
    require(df.columns == names if exact else set(names) <= set(df.columns), f"columns {df.columns}, wanted {names}")


def missing_columns(df: DataFrame, names: list[str]) -> list[str]:
    return sorted(set(names) - set(df.columns))


def null_counts(df: DataFrame) -> DataFrame:
    """One row: nulls of each column."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def domain(df: DataFrame, col: str, allowed: list) -> DataFrame:
    """One row: n, n_outside (values not allowed, nulls too) and ok."""
    out = F.count_if(~F.coalesce(F.col(col).isin(allowed), F.lit(False)))
    return df.agg(F.count("*").alias("n"), out.alias("n_outside"), (out == 0).alias("ok"))


def label_counts(df: DataFrame, label: str, expected: dict) -> DataFrame:
    """(label, n, expected, ok) for every expected or present label; a label that isn't expected should have no rows."""
    want = df.sparkSession.createDataFrame([(k, v) for k, v in expected.items()], f"want {df.schema[label].dataType.simpleString()}, expected long")
    got = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    j = got.join(want, F.col("label").eqNullSafe(F.col("want")), "full").select(F.coalesce("label", "want").alias("label"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "expected")])
    return j.withColumn("ok", F.col("n") == F.col("expected"))


def one_to_one(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: rows of both sides, keys repeated on either, rows of a without a partner, and ok if a left join keeps every row once."""
    count = lambda d, n: d.groupBy(F.col(key).alias("k")).agg(F.count("*").alias(n))
    j = count(a, "na").join(count(b, "nb"), "k", "full")
    of = lambda c: F.coalesce(F.sum(c), F.lit(0))
    g = j.agg(of("na").alias("left_rows"), of("nb").alias("right_rows"), F.count_if(F.col("na") > 1).alias("repeated_left"), F.count_if(F.col("nb") > 1).alias("repeated_right"), of(F.when(F.col("nb").isNull(), F.col("na"))).alias("unmatched"))
    return g.withColumn("ok", (F.col("repeated_left") == 0) & (F.col("repeated_right") == 0))


def frozen(entries: DataFrame, count: int, sha256: str) -> DataFrame:
    """One row for a code book (key, value) that must not change: n, its canonical JSON's hash (keys in order), and ok if both are as frozen."""
    pair = F.concat(F.to_json(F.struct(F.col("key").alias("k"))), F.lit("|"), F.to_json(F.struct(F.col("value").alias("v"))))
    body = F.transform(F.array_sort(F.collect_list(F.struct("key", pair.alias("p")))), lambda x: F.regexp_replace(F.regexp_replace(x["p"], r'\}\|\{"v":', ":"), r'^\{"k":|\}$', ""))
    g = entries.agg(F.count("*").alias("n"), F.sha2(F.concat(F.lit("{"), F.array_join(body, ","), F.lit("}")).cast("binary"), 256).alias("sha256"))  # a bounded code book
    return g.withColumn("ok", (F.col("n") == count) & (F.col("sha256") == sha256))


def assemble(parts: list[DataFrame], *keys: str) -> DataFrame:
    """All parts' rows with repeats, how many rows have the row's keys (1 in a sound record set)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    n = out.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.count("*").alias("repeats"))
    return out.join(n, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]).select(*out.columns, "repeats")


def misaligned(a: DataFrame, b: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """One row: n_misaligned of a full outer join on key; nulls are equal."""
    x, y = a.select(key, F.struct(*cols).alias("x")), b.select(F.col(key).alias("k2"), F.struct(*cols).alias("y"))
    bad = F.count_if(~F.col("x").eqNullSafe(F.col("y")))
    return x.join(y, F.col(key).eqNullSafe(F.col("k2")), "full").agg(bad.alias("n_misaligned"))


def set_difference_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: distinct rows only in a, only in b, and whether the sets are equal."""
    x, y = a.exceptAll(a.limit(0)).distinct(), b.distinct().toDF(*a.columns)
    both = x.withColumn("s", F.lit(1)).unionByName(y.withColumn("s", F.lit(2))).groupBy(*a.columns).agg(F.sum("s").alias("s"))
    return both.agg(F.count_if(F.col("s") == 1).alias("only_a"), F.count_if(F.col("s") == 2).alias("only_b"), (F.count_if(F.col("s") != 3) == 0).alias("equal"))


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows whose numbers differ, with both numbers."""
    x = a.withColumns({"na": F.lit(1), "nb": F.lit(0)})
    y = b.toDF(*a.columns).withColumns({"na": F.lit(0), "nb": F.lit(1)})
    return x.unionByName(y).groupBy(*a.columns).agg(F.sum("na").alias("n_a"), F.sum("nb").alias("n_b")).where("n_a <> n_b")


def map_conflicts(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of both whose values differ."""
    y = b.select(F.col(key).alias("k2"), F.col(value).alias("v2"))
    return a.join(y, F.col(key) == F.col("k2")).where(~F.col(value).eqNullSafe(F.col("v2"))).select(key, F.col(value).alias("value_a"), F.col("v2").alias("value_b"))


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys with more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def rates_match(df: DataFrame, count: str, total: str, rate: str, tolerance: float = 1e-8) -> DataFrame:
    """One row: the largest distance of rate from count / total, and ok."""
    gap = F.coalesce(F.max(F.abs(F.try_divide(count, total) - F.col(rate))), F.lit(0.0))
    return df.agg(gap.alias("max_gap"), (gap < tolerance).alias("ok"))


def leaks(df: DataFrame, payload: str, words: list[str]) -> DataFrame:
    """Rows whose payload names one of the words (a label that must not be sent)."""
    return df.where(reduce(lambda x, y: x | y, [F.col(payload).contains(w) for w in words]))


def bad_spans(df: DataFrame, start: str, end: str, size: str) -> DataFrame:
    """Rows without 0 <= start < end <= size."""
    ok = (F.col(start) >= 0) & (F.col(start) < F.col(end)) & (F.col(end) <= F.col(size))
    return df.where(~F.coalesce(ok, F.lit(False)))


def over_budget(df: DataFrame, group: str, cost: str, requests: int, total: float, each: float) -> DataFrame:
    """One row a group: n, cost, whether it, and whether all together, exceed a limit."""
    from pyspark.sql import Window

    g = df.groupBy(group).agg(F.count("*").alias("n"), F.sum(cost).alias("cost"))
    w = Window.partitionBy(F.lit(0))  # a row a group
    return g.select(group, "n", "cost", (F.col("cost") > each).alias("over_each"), ((F.sum("cost").over(w) > total) | (F.sum("n").over(w) > requests)).alias("over_all"))
