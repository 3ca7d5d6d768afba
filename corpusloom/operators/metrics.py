"""Metrics of binary predictions, as aggregates over any grouping."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cells(gold: Column, pred: Column, where: Column | None = None) -> dict[str, Column]:
    """tn, fp, fn, tp of the rows where the condition holds."""
    ok = F.lit(True) if where is None else where
    one = lambda g, p: F.count_if((gold == g) & (pred == p) & ok)
    return {"tn": one(0, 0), "fp": one(0, 1), "fn": one(1, 0), "tp": one(1, 1)}


def _ratio(a: Column, b: Column) -> Column:
    """Zero where there is nothing to divide by."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def from_cells(prefix: str = "", empty_null: bool = False) -> dict[str, Column]:
    """Metrics of columns tn, fp, fn, tp (prefixed). Divisions by zero give 0; with empty_null no rows give null."""
    tn, fp, fn, tp = (F.col(f"{prefix}{c}") for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    f1, f0 = _ratio(2 * tp, 2 * tp + fp + fn), _ratio(2 * tn, 2 * tn + fp + fn)
    out = {
        "accuracy": _ratio(tp + tn, n), "precision_class1": _ratio(tp, tp + fp), "recall_class1": _ratio(tp, tp + fn), "f1_class1": f1, "macro_f1": (f1 + f0) / 2,
        "recall_class0": _ratio(tn, tn + fp), "precision_class0": _ratio(tn, tn + fn), "f1_class0": f0, "balanced_accuracy": (_ratio(tp, tp + fn) + _ratio(tn, tn + fp)) / 2,
    }
    return {f"{prefix}{k}": F.when(n > 0, v) if empty_null else v for k, v in out.items()}


MAIN = ["accuracy", "precision_class1", "recall_class1", "f1_class1", "macro_f1"]


def evaluate(preds: DataFrame, *by: str, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """One row a group: n, the four cells and all metrics."""
    c = cells(F.col(gold), F.col(pred))
    g = preds.groupBy(*by).agg(F.count("*").alias("n"), *[v.alias(k) for k, v in c.items()])
    return g.select(*by, "n", *c, *[v.alias(k) for k, v in from_cells().items()])


def report(preds: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Rows '0', '1', 'macro avg' and 'weighted avg': precision, recall, f1, support."""
    e = evaluate(preds, gold=gold, pred=pred)
    s0, s1 = F.col("tn") + F.col("fp"), F.col("fn") + F.col("tp")
    pair = lambda m: (F.col(f"{m}_class0"), F.col(f"{m}_class1"))
    row = lambda name, f, s: F.struct(F.lit(name).alias("name"), *[f(*pair(m)).alias(a) for m, a in (("precision", "precision"), ("recall", "recall"), ("f1", "f1_score"))], s.alias("support"))
    rows = F.array(row("0", lambda a, b: a, s0), row("1", lambda a, b: b, s1), row("macro avg", lambda a, b: (a + b) / 2, s0 + s1), row("weighted avg", lambda a, b: _ratio(a * s0 + b * s1, s0 + s1), s0 + s1))
    return e.select(F.inline(rows))


def roc_auc(preds: DataFrame, score: str, *by: str, gold: str = "gold") -> DataFrame:
    """Area under the curve by average ranks; null with a single class.

    Equal scores are aggregated first, so only distinct scores are ranked.
    """
    per = preds.groupBy(*by, F.col(score).alias("s")).agg(F.count("*").alias("m"), F.count_if(F.col(gold) == 1).alias("p"))
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("avg_rank", F.coalesce(F.sum("m").over(w), F.lit(0)) + (F.col("m") + 1) / 2.0)
    g = per.groupBy(*by).agg(F.sum("m").alias("n"), F.sum("p").alias("n1"), F.sum(F.col("avg_rank") * F.col("p")).alias("r"))
    return g.select(*by, "n", "n1", F.try_divide(F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2.0, F.col("n1") * (F.col("n") - F.col("n1"))).alias("auc"))


def majority(train: DataFrame, label: str) -> DataFrame:
    """One row: the most frequent label, ties to the smaller."""
    return train.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(1).select(label)


def sensitivity(preds: DataFrame, flagged: str, *by: str, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Metrics over all rows, over clean rows and over flagged ones in one pass, and clean minus all."""
    parts = {"all_": None, "clean_": ~F.col(flagged), "flagged_": F.col(flagged)}
    aggs = [v.alias(p + k) for p, w in parts.items() for k, v in cells(F.col(gold), F.col(pred), w).items()]
    g = preds.groupBy(*by).agg(F.count("*").alias("n_test_all"), F.count_if(~F.col(flagged)).alias("n_test_clean"), F.count_if(flagged).alias("n_test_flagged"), *aggs)
    m = {k: v for p in parts for k, v in from_cells(p, empty_null=True).items() if k.removeprefix(p) in MAIN}
    g = g.select(*by, "n_test_all", "n_test_clean", "n_test_flagged", *[v.alias(k) for k, v in m.items()])
    return g.withColumns({f"clean_minus_all_{k}": F.col(f"clean_{k}") - F.col(f"all_{k}") for k in ("accuracy", "macro_f1")})


def bootstrap_ci(preds: DataFrame, *by: str, gold: str = "gold", pred: str = "pred", n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """Percentile intervals (2.5, 97.5) of accuracy, f1_class1, macro_f1.

    A resample of n rows is a multinomial draw over the four cells, so the work
    doesn't grow with the rows; its random stream is this library's own.
    """
    c = preds.groupBy(*by).agg(*[v.alias(k) for k, v in cells(F.col(gold), F.col(pred)).items()])

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                k = np.array([row[x] for x in ("tn", "fp", "fn", "tp")], float)
                n = int(k.sum())
                if not n:
                    continue
                tn, fp, fn, tp = np.random.default_rng(seed).multinomial(n, k / n, n_boot).T.astype(float)
                ratio = lambda a, b: np.divide(a, b, out=np.zeros_like(a), where=b > 0)
                f1, f0 = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fp + fn)
                for name, v in (("accuracy", (tp + tn) / n), ("f1_class1", f1), ("macro_f1", (f1 + f0) / 2)):
                    lo, hi = np.percentile(v, [2.5, 97.5])
                    out.append({**{b: row[b] for b in by}, "metric": name, "low": float(lo), "high": float(hi)})
            if out:
                yield pd.DataFrame(out)

    keys = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in c.schema if f.name in by)
    return c.mapInPandas(run, keys + "metric string, low double, high double")


def deltas_pp(published: DataFrame, reproduced: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Left join of reproduced figures to published ones, and differences in percentage points."""
    r = reproduced.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(c).alias(f"reproduced_{c}") for c in cols])
    j = published.join(r, [F.col(k) == F.col(f"__{k}") for k in keys], "left")
    return j.select(*keys, *cols, *[f"reproduced_{c}" for c in cols], *[((F.col(f"reproduced_{c}") - F.col(c)) * 100).alias(f"delta_{c}_pp") for c in cols])
