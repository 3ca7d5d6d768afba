"""Queries of metrics, matching, ordering and classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import length, metrics, validate
from .base import LAB, RAW, SPLIT, cells_sql, labelled, metric_sql, query, ratio_sql, rounded, split_rows
from .session import table

M = metric_sql()
CORE = ["accuracy", "precision_class1", "recall_class1", "f1_class1", "macro_f1", "balanced_accuracy"]
METRICS = ", ".join(f"round({M[k]}, 6) AS {k}" for k in CORE)


@query("a1_label_counts", "SELECT quality AS label, count(*) AS n FROM labels GROUP BY 1")
def a1(spark, sf):
    return table(spark, sf, "labels").groupBy(F.col("quality").alias("label")).agg(F.count("*").alias("n"))


@query("a6_confusion_cells", f"WITH {RAW}, {LAB} SELECT lang, count(*) AS n, {cells_sql('label', 'pred')} FROM lab GROUP BY 1")
def a6(spark, sf):
    return metrics.evaluate(labelled(spark, sf), "lang", gold="label").select("lang", "n", "tn", "fp", "fn", "tp")


@query("a7_metrics", f"WITH {RAW}, {LAB}, c AS (SELECT lang, {cells_sql('label', 'pred')} FROM lab GROUP BY 1) SELECT lang, {METRICS} FROM c")
def a7(spark, sf):
    return rounded(metrics.evaluate(labelled(spark, sf), "lang", gold="label").select("lang", *CORE))


@query("a8_class_report", f"""WITH {RAW}, {LAB}, c AS (SELECT {cells_sql('label', 'pred')} FROM lab),
r AS (SELECT tn + fp AS s0, fn + tp AS s1, {ratio_sql('tn', 'tn+fn')} AS p0, {ratio_sql('tp', 'tp+fp')} AS p1, {ratio_sql('tn', 'tn+fp')} AS r0, {ratio_sql('tp', 'tp+fn')} AS r1, {ratio_sql('2*tn', '2*tn+fp+fn')} AS f0, {ratio_sql('2*tp', '2*tp+fp+fn')} AS f1 FROM c)
SELECT '0' AS name, round(p0, 6) AS "precision", round(r0, 6) AS recall, round(f0, 6) AS f1_score, s0 AS support FROM r UNION ALL SELECT '1', round(p1, 6), round(r1, 6), round(f1, 6), s1 FROM r
UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), s0 + s1 FROM r
UNION ALL SELECT 'weighted avg', round((p0 * s0 + p1 * s1) / (s0 + s1), 6), round((r0 * s0 + r1 * s1) / (s0 + s1), 6), round((f0 * s0 + f1 * s1) / (s0 + s1), 6), s0 + s1 FROM r""")
def a8(spark, sf):
    return rounded(metrics.report(labelled(spark, sf), gold="label"))


@query("a9_balanced_accuracy", f"WITH {RAW}, {LAB}, c AS (SELECT source, {cells_sql('label', 'pred')} FROM lab GROUP BY 1) SELECT source, round({M['balanced_accuracy']}, 6) AS balanced_accuracy, round({ratio_sql('tn', 'tn+fp')}, 6) AS recall_class0, round({ratio_sql('tp', 'tp+fn')}, 6) AS recall_class1 FROM c")
def a9(spark, sf):
    return rounded(metrics.evaluate(labelled(spark, sf), "source", gold="label").select("source", "balanced_accuracy", "recall_class0", "recall_class1"))


@query("a10_roc_auc", f"""WITH {RAW}, {LAB}, k AS (SELECT lang, label, chars, rank() OVER (PARTITION BY lang ORDER BY chars) + (count(*) OVER (PARTITION BY lang, chars) - 1) / 2.0 AS r FROM lab)
SELECT lang, count(*) AS n, count(*) FILTER (WHERE label = 1) AS n1, round((sum(CASE WHEN label = 1 THEN CAST(r AS DOUBLE) ELSE 0 END) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0::DOUBLE) / nullif(count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0), 0), 6) AS auc FROM k GROUP BY 1""")
def a10(spark, sf):
    return rounded(metrics.roc_auc(labelled(spark, sf), "chars", "lang", gold="label"))


@query("a12_length_descriptives", f"WITH {RAW}, {LAB} SELECT label, count(*) AS n, round(avg(chars), 6) AS chars_mean, round(quantile_cont(chars, 0.5), 6) AS chars_median, round(quantile_cont(chars, 0.1), 6) AS chars_p10, round(quantile_cont(chars, 0.9), 6) AS chars_p90, round(avg(toks), 6) AS tokens_mean, round(quantile_cont(toks, 0.5), 6) AS tokens_median FROM lab GROUP BY 1")
def a12(spark, sf):
    return rounded(length.descriptives(labelled(spark, sf), "label"))


MATCH = """
t AS (SELECT doc_id, label, chars, ln(1 + chars) AS lc, CAST(floor(ln(1 + chars) / ln(CAST({ratio} AS DOUBLE))) AS BIGINT) AS bin FROM {src}),
rk AS (SELECT *, row_number() OVER (PARTITION BY bin, label ORDER BY lc, doc_id) - 1 AS r, count(*) OVER (PARTITION BY bin, label) AS m FROM t),
bn AS (SELECT bin, count(*) FILTER (WHERE label = 0) AS m0, count(*) FILTER (WHERE label = 1) AS m1 FROM t GROUP BY 1),
js AS (SELECT bin, least(m0, m1) AS n, unnest(range(0, least(m0, m1))) AS j FROM bn WHERE m0 > 0 AND m1 > 0),
ps AS (SELECT a.doc_id AS id0, b.doc_id AS id1, abs(a.lc - b.lc) AS diff FROM js JOIN rk a ON a.bin = js.bin AND a.label = 0 AND a.r = floor((j + CAST(0.5 AS DOUBLE)) * a.m / n) JOIN rk b ON b.bin = js.bin AND b.label = 1 AND b.r = floor((j + CAST(0.5 AS DOUBLE)) * b.m / n))"""


@query("x5_length_match", f"WITH {RAW}, {LAB}, {MATCH.format(ratio=1.25, src='lab')} SELECT id0, id1, round(diff, 6) AS abs_log_difference FROM ps")
def x5(spark, sf):
    return rounded(length.match(labelled(spark, sf), 1.25))


@query("a13_matched_balance", f"""WITH {RAW}, {LAB}, {MATCH.format(ratio=1.25, src='lab')}, sub AS (SELECT *, ln(1 + chars) AS lc FROM lab WHERE doc_id IN (SELECT id0 FROM ps UNION SELECT id1 FROM ps))
SELECT (SELECT count(*) FROM lab) AS test_n, (SELECT count(*) FROM ps) AS matched_pairs, round((SELECT max(diff) FROM ps), 6) AS max_abs_log_char_diff, count(*) AS matched_n,
round((avg(lc) FILTER (WHERE label = 1) - avg(lc) FILTER (WHERE label = 0)) / sqrt((var_samp(lc) FILTER (WHERE label = 1) + var_samp(lc) FILTER (WHERE label = 0)) / 2), 6) AS matched_log_char_smd,
round(quantile_cont(chars, 0.5) FILTER (WHERE label = 0), 6) AS matched_label0_median_chars, round(quantile_cont(chars, 0.5) FILTER (WHERE label = 1), 6) AS matched_label1_median_chars,
round(count(*) / CAST((SELECT count(*) FROM lab) AS DOUBLE), 6) AS test_coverage FROM sub""")
def a13(spark, sf):
    rows = labelled(spark, sf)
    return rounded(length.balance(rows, length.match(rows, 1.25)))


@query("a14_match_sensitivity", " UNION ALL ".join(f"(WITH {RAW}, {LAB}, {MATCH.format(ratio=r, src='lab')} SELECT CAST({r} AS DOUBLE) AS bin_width_ratio, count(*) AS matched_pairs, 2 * count(*) AS matched_documents, round(2 * count(*) / CAST((SELECT count(*) FROM lab) AS DOUBLE), 6) AS test_coverage FROM ps)" for r in fixed.MATCH_RATIOS))
def a14(spark, sf):
    rows = labelled(spark, sf)
    out = None
    for r in fixed.MATCH_RATIOS:
        one = length.match(rows, r).agg(F.lit(r).alias("bin_width_ratio"), F.count("*").alias("matched_pairs"), (2 * F.count("*")).alias("matched_documents")).join(rows.agg(F.count("*").alias("n")))
        one = one.select("bin_width_ratio", "matched_pairs", "matched_documents", F.try_divide("matched_documents", "n").alias("test_coverage"))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query("j10_matched_metrics", f"""WITH {RAW}, {LAB}, {MATCH.format(ratio=1.25, src='lab')}, sub AS (SELECT * FROM lab WHERE doc_id IN (SELECT id0 FROM ps UNION SELECT id1 FROM ps)),
f AS (SELECT source, count(*) AS n, {cells_sql('label', 'pred')} FROM lab GROUP BY 1), m AS (SELECT source, count(*) AS n, {cells_sql('label', 'pred')} FROM sub GROUP BY 1),
ff AS (SELECT source, n, {M['balanced_accuracy']} AS ba, {M['macro_f1']} AS mf FROM f), mm AS (SELECT source, n, {M['balanced_accuracy']} AS ba, {M['macro_f1']} AS mf FROM m)
SELECT source, ff.n AS n_full, mm.n AS n_matched, round(mm.ba - ff.ba, 6) AS delta_balanced_accuracy, round(mm.mf - ff.mf, 6) AS delta_macro_f1 FROM ff JOIN mm USING (source)""")
def j10(spark, sf):
    rows = labelled(spark, sf)
    sub = length.matched(rows, length.match(rows, 1.25))
    cols = ["n", "balanced_accuracy", "macro_f1"]
    full = metrics.evaluate(rows, "source", gold="label").select("source", *[F.col(c).alias(f"{c}_full") for c in cols])
    part = metrics.evaluate(sub, "source", gold="label").select("source", *[F.col(c).alias(f"{c}_matched") for c in cols])
    j = full.join(part, "source")
    return rounded(j.select("source", "n_full", "n_matched", *[(F.col(f"{c}_matched") - F.col(f"{c}_full")).alias(f"delta_{c}") for c in cols[1:]]))


@query("j11_reference_deltas", f"""WITH {RAW}, {LAB}, c AS (SELECT lang, {cells_sql('label', 'pred')} FROM lab GROUP BY 1), r AS (SELECT lang, {M['accuracy']} AS accuracy FROM c), p AS (SELECT DISTINCT lang, CAST(0.75 AS DOUBLE) AS accuracy FROM documents)
SELECT p.lang, p.accuracy, round(r.accuracy, 6) AS reproduced_accuracy, round((r.accuracy - p.accuracy) * 100, 6) AS delta_accuracy_pp FROM p LEFT JOIN r USING (lang)""")
def j11(spark, sf):
    pub = table(spark, sf, "documents").select("lang").distinct().withColumn("accuracy", F.lit(0.75))
    rep = metrics.evaluate(labelled(spark, sf), "lang", gold="label").select("lang", "accuracy")
    return rounded(metrics.deltas_pp(pub, rep, ["lang"], ["accuracy"]))


@query("a43_record_set", f"WITH {RAW}, {LAB}, a AS (SELECT lang, {cells_sql('label', 'pred')} FROM lab GROUP BY 1), b AS (SELECT lang, {cells_sql('label', 'toxic')} FROM lab GROUP BY 1) SELECT 'length' AS model, lang, round({M['accuracy']}, 6) AS accuracy, round({M['f1_class1']}, 6) AS f1_class1, CAST(1 AS BIGINT) AS repeats FROM a UNION ALL SELECT 'toxic', lang, round({M['accuracy']}, 6), round({M['f1_class1']}, 6), CAST(1 AS BIGINT) FROM b")
def a43(spark, sf):
    """Records of all models and languages, each once."""
    one = lambda model, pred: metrics.evaluate(labelled(spark, sf), "lang", gold="label", pred=pred).select(F.lit(model).alias("model"), "lang", "accuracy", "f1_class1")
    return rounded(validate.assemble([one("length", "pred"), one("toxic", "toxic")], "model", "lang"))


@query("a38_majority", f"WITH {RAW}, {LAB}, {SPLIT} SELECT label FROM sp WHERE split = 'train' GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 1")
def a38(spark, sf):
    return metrics.majority(split_rows(spark, sf).where("split = 'train'"), "label")


@query("a39_metrics_from_cells", f"WITH c(name, tn, fp, fn, tp) AS (VALUES ('a', 424, 5, 35, 721), ('b', 0, 0, 3, 0), ('c', 10, 0, 0, 0)) SELECT name, {METRICS} FROM c")
def a39(spark, sf):
    c = spark.createDataFrame([("a", 424, 5, 35, 721), ("b", 0, 0, 3, 0), ("c", 10, 0, 0, 0)], "name string, tn long, fp long, fn long, tp long")
    return rounded(c.select("name", *[v.alias(k) for k, v in metrics.from_cells().items() if k in CORE]))


@query("a33_bootstrap_ci")
def a33(spark, sf):
    return metrics.bootstrap_ci(labelled(spark, sf), "lang", gold="label")


@query("w3_best_row", "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_shipdate) AS r FROM lineitem) WHERE r = 1")
def w3(spark, sf):
    l = table(spark, sf, "lineitem")
    # an aggregate instead of a window: nothing is sorted
    return l.groupBy("l_suppkey").agg(F.min_by(F.struct("l_orderkey", "l_linenumber"), F.struct(-F.col("l_extendedprice"), "l_orderkey", "l_linenumber", "l_shipdate")).alias("x")).select("l_suppkey", "x.*")


@query("o11_nulls_last", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality ASC NULLS LAST, doc_id")
def o11(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left").orderBy(F.asc_nulls_last("quality"), "doc_id")


@query("o7_ordered_results", "SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2 ORDER BY 1, 2")
def o7(spark, sf):
    return table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n")).orderBy("lang", "source")


@query("o10_test_rows_by_id", f"WITH {RAW}, {LAB}, {SPLIT} SELECT doc_id, label FROM sp WHERE split = 'test' ORDER BY doc_id")
def o10(spark, sf):
    return split_rows(spark, sf).where("split = 'test'").select("doc_id", "label").orderBy("doc_id")


@query("l4_length_models")
def l4(spark, sf):
    from ..operators.classify import length_models

    s = split_rows(spark, sf).cache()
    return length_models(s.where("split = 'train'"), s.where("split = 'test'"))


@query("l1_text_classifier")
def l1(spark, sf):
    """Metrics of the text models on the held-out fifth."""
    from ..operators import classify
    from ..operators.splits import folds

    s = classify.word_features(folds(split_rows(spark, sf), "label")).select("doc_id", "label", "split", "fold", "terms").cache()
    train = classify.class_weights(s.where("split = 'train'"))
    a, b = classify.tfidf_features(train, s.where("split = 'test'"))
    out = None
    for kind in ("lr", "svm"):
        p = classify.text_model(kind).fit(a).transform(b).select(F.lit(kind).alias("model"), "label", F.col("prediction").cast("int").alias("pred"))
        out = p if out is None else out.unionByName(p)
    return rounded(metrics.evaluate(out, "model", gold="label"))


@query("l3_macro_f1", f"WITH {RAW}, {LAB}, c AS (SELECT {cells_sql('label', 'pred')} FROM lab) SELECT round({M['macro_f1']}, 6) AS macro_f1 FROM c")
def l3(spark, sf):
    """The scorer that the searches use."""
    from ..operators.classify import MacroF1

    return spark.createDataFrame([(round(MacroF1("label", "pred").evaluate(labelled(spark, sf)), 6),)], "macro_f1 double")


@query("a42_prediction_table")
def a42(spark, sf):
    p = l4(spark, sf)
    return p.groupBy("model").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"), F.count("score").alias("scored"))
