"""Queries of annotations, themes, dictionaries and topic models.

Annotation lines are made from labelled documents by rules of the id, so that
every reason to reject one occurs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import tokens
from ..operators import annotations as an
from ..operators import topics, triangulate, validate
from ..sources import io
from .base import LAB, RAW, TOKS, D, labelled, query, raw_documents, rounded
from .session import table


def lines(spark, sf):
    """(manifest, outputs): what was asked and what came back."""
    m = labelled(spark, sf).select(F.concat(F.lit("row-"), F.col("doc_id")).alias("custom_id"), "doc_id", F.col("label").alias("gold_label"), "toxic", "chars")
    p = F.col("doc_id") % 13
    name = lambda c: F.concat(F.lit("T"), F.lpad(c.cast("string"), 2, "0"))
    second = F.when((p == 0) | (F.col("doc_id") % 3 == 0), "NONE").otherwise(name(p % 12 + 1))
    ann = lambda label, a, b: F.to_json(F.struct(label.alias("predicted_label"), F.lit(a).alias("primary_topic") if isinstance(a, str) else a.alias("primary_topic"), F.lit(b).alias("secondary_topic") if isinstance(b, str) else b.alias("secondary_topic")))
    one, k = F.lit(1), F.col("doc_id") % 11
    raw = (
        F.when(k == 0, "not json").when(k == 1, '{"predicted_label":1,"primary_topic":"T01"}').when(k == 2, ann(F.lit(7), "T01", "NONE")).when(k == 3, ann(one, "T99", "NONE"))
        .when(k == 4, ann(one, "T01", "T77")).when(k == 5, ann(one, "T00", "T01")).when(k == 6, ann(one, "T02", "T02")).otherwise(ann(F.col("toxic"), name(p), second))
    )
    part = F.array(F.struct(F.array(F.struct(F.lit("output_text").alias("type"), raw.alias("text"))).alias("content")))
    use = F.struct(F.col("chars").alias("input_tokens"), F.lit(32).cast("long").alias("output_tokens"))
    body = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(raw.alias("output_text"), use.alias("usage")))).otherwise(F.to_json(F.struct(F.lit(" ").alias("output_text"), part.alias("output"), use.alias("usage"))))
    out = m.where(k != 10).select(F.concat(F.lit('{"custom_id":"'), "custom_id", F.lit('","response":{"status_code":200,"body":'), body, F.lit("}}")).alias("value"))
    return m, out.select(F.from_json("value", an.OUTPUT).alias("o")).select("o.*")


def results(spark, sf):
    return an.evaluate(*lines(spark, sf))


RES = """res AS (SELECT *, 'row-' || doc_id AS custom_id, CASE doc_id % 11 WHEN 10 THEN 'missing_output_line' WHEN 0 THEN 'invalid_json' WHEN 1 THEN 'unexpected_keys' WHEN 2 THEN 'invalid_label' WHEN 3 THEN 'invalid_primary_topic' WHEN 4 THEN 'invalid_secondary_topic' WHEN 5 THEN 't00_requires_no_secondary' WHEN 6 THEN 'duplicate_primary_secondary' ELSE 'ok' END AS status FROM lab),
val AS (SELECT *, toxic AS predicted_label, 'T' || lpad(CAST(doc_id % 13 AS VARCHAR), 2, '0') AS primary_topic, CASE WHEN doc_id % 13 = 0 OR doc_id % 3 = 0 THEN 'NONE' ELSE 'T' || lpad(CAST(doc_id % 13 % 12 + 1 AS VARCHAR), 2, '0') END AS secondary_topic FROM res WHERE status = 'ok')"""
W = f"WITH {RAW}, {LAB}, {RES}"
BOOK = "(SELECT 'T' || lpad(CAST(i AS VARCHAR), 2, '0') AS topic_id FROM unnest(range({}, 13)) AS r(i)) b"


@query("f17_annotation_status", f"{W} SELECT r.custom_id, r.status, v.predicted_label, v.primary_topic, v.secondary_topic, CASE WHEN r.status = 'missing_output_line' THEN 0 ELSE r.chars END AS input_tokens FROM res r LEFT JOIN val v USING (custom_id)")
def f17(spark, sf):
    return results(spark, sf).select("custom_id", "status", "predicted_label", "primary_topic", "secondary_topic", "input_tokens")


GUARDED = ["gold_label", "quality", "license"]


@query("f16_label_leaks", f"SELECT count(*) FILTER (WHERE {' OR '.join(f"contains(text, '{w}')" for w in GUARDED)}) AS n_leaks, count(*) AS n FROM documents")
def f16(spark, sf):
    """Requests whose line, text and all, names a guarded word."""
    r = raw_documents(spark, sf).select(an.request(F.concat(F.lit("row-"), F.col("doc_id")), F.col("text")).alias("line"))
    return validate.leaks(r, "line", GUARDED).agg(F.count("*").alias("n_leaks")).join(r.agg(F.count("*").alias("n")))


@query("f20_failures", f"{W}, fl AS (SELECT CASE WHEN doc_id % 10 = 0 THEN 'rate_limit' ELSE 'billing_hard_limit_reached' END AS code, doc_id FROM res WHERE status <> 'missing_output_line' AND doc_id % 5 = 0) SELECT 'all' AS part, count(*) AS n_failed, coalesce(bool_and(code = 'billing_hard_limit_reached'), true) AS one_cause FROM fl UNION ALL SELECT 'odd', count(*), coalesce(bool_and(code = 'billing_hard_limit_reached'), true) FROM fl WHERE doc_id % 2 = 1")
def f20(spark, sf):
    """Every fifth output failed, every tenth for another cause; over all outputs and over those of odd ids."""
    i = F.regexp_extract("custom_id", r"(\d+)$", 1).cast("long")
    code = F.when(i % 5 == 0, F.when(i % 10 == 0, "rate_limit").otherwise("billing_hard_limit_reached"))
    o = lines(spark, sf)[1].withColumns({"i": i, "error": F.when(code.isNotNull(), F.struct(code.alias("code"), F.lit("").alias("message")))})
    one = lambda part, rows: an.failures(rows, "billing_hard_limit_reached").select(F.lit(part).alias("part"), "*")
    return one("all", o).unionByName(one("odd", o.where("i % 2 = 1")))


@query("j15_missing_outputs", f"{W} SELECT status, count(*) AS n FROM res GROUP BY 1")
def j15(spark, sf):
    return results(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


@query("j21_union_recovered", f"{W} SELECT count(*) AS n, count(*) = count(DISTINCT custom_id) AS all_unique FROM res WHERE status <> 'missing_output_line'")
def j21(spark, sf):
    o = lines(spark, sf)[1]
    both = o.where(F.xxhash64("custom_id") % 2 == 0).unionByName(o.where(F.xxhash64("custom_id") % 2 != 0))
    again = validate.repeated_keys(both, "custom_id").agg((F.count("*") == 0).alias("all_unique"))
    return both.agg(F.count("*").alias("n")).join(again)


def ok(spark, sf):
    return results(spark, sf).where("status = 'ok'")


@query("a26_primary_distribution", f"{W} SELECT topic_id, count(v.custom_id) AS count, round(count(v.custom_id) * 100.0 / (SELECT count(*) FROM val), 6) AS percent FROM {BOOK.format(0)} LEFT JOIN val v ON primary_topic = topic_id GROUP BY 1")
def a26(spark, sf):
    return rounded(an.distribution(ok(spark, sf), "primary_topic", fixed.TOPICS))


@query("a27_secondary_distribution", f"{W} SELECT topic_id, count(v.custom_id) AS count, round(count(v.custom_id) * 100.0 / (SELECT count(*) FROM val), 6) AS percent FROM {BOOK.format(1)} LEFT JOIN val v ON secondary_topic = topic_id GROUP BY 1")
def a27(spark, sf):
    return rounded(an.distribution(ok(spark, sf), "secondary_topic", fixed.TOPICS[1:]))


@query("a28_topic_by_label", f"{W} SELECT topic_id, count(*) FILTER (WHERE label = 0) AS label_0, count(*) FILTER (WHERE label = 1) AS label_1, round(count(*) FILTER (WHERE label = 0) * 100.0 / (SELECT count(*) FROM val WHERE label = 0), 6) AS percent_0, round(count(*) FILTER (WHERE label = 1) * 100.0 / (SELECT count(*) FROM val WHERE label = 1), 6) AS percent_1 FROM {BOOK.format(0)} LEFT JOIN val v ON primary_topic = topic_id GROUP BY 1")
def a28(spark, sf):
    return rounded(an.crosstab(ok(spark, sf), "primary_topic", "gold_label", fixed.TOPICS))


@query("a29_topic_pairs", f"{W} SELECT primary_topic, secondary_topic, count(*) AS count FROM val WHERE secondary_topic <> 'NONE' GROUP BY 1, 2")
def a29(spark, sf):
    return an.topic_pairs(ok(spark, sf))


@query("a30_topic_rates", f"{W} SELECT count(*) AS n_valid, count(*) FILTER (WHERE primary_topic = 'T00') AS t00_count, round(avg(CASE WHEN primary_topic = 'T00' THEN 1.0 ELSE 0 END), 6) AS t00_rate, count(*) FILTER (WHERE secondary_topic <> 'NONE') AS secondary_count, round(avg(CASE WHEN secondary_topic <> 'NONE' THEN 1.0 ELSE 0 END), 6) AS secondary_rate FROM val")
def a30(spark, sf):
    return rounded(an.rates(ok(spark, sf)))


@query("a31_token_usage", f"{W} SELECT CAST(sum(chars) AS BIGINT) AS input_tokens, CAST(32 * count(*) AS BIGINT) AS output_tokens, CAST(0 AS BIGINT) AS cached_tokens, CAST(0 AS BIGINT) AS cache_write_tokens, round(sum(chars) / 1e6 * 2 + 32 * count(*) / 1e6 * 10, 6) AS cost_usd FROM res WHERE status <> 'missing_output_line'")
def a31(spark, sf):
    return rounded(an.usage(results(spark, sf), 2.0, 10.0))


@query("a32_cost_estimate", "SELECT count(*) AS requests, CAST(sum(ceil(length(text) / 2.0) + 96) AS BIGINT) AS input_tokens_estimate, round(sum(ceil(length(text) / 2.0) + 96) / 1e6 * 2 + count(*) * 96 / 1e6 * 10, 6) AS cost_bound_usd FROM documents")
def a32(spark, sf):
    return rounded(an.estimate(raw_documents(spark, sf), "text", 2.0, 10.0))


@query("a34_theme_frequencies", "SELECT role AS theme, count(*) AS passages, count(DISTINCT conv_id) AS documents, round(count(DISTINCT conv_id) * 100.0 / (SELECT count(DISTINCT conv_id) FROM conversations), 6) AS share FROM conversations GROUP BY 1")
def a34(spark, sf):
    return rounded(triangulate.theme_frequencies(table(spark, sf, "conversations").select(F.col("role").alias("theme"), F.col("conv_id").alias("doc_id"))))


@query("a35_rate_matrix", "WITH s AS (SELECT turn, count(*) AS size FROM conversations GROUP BY 1) SELECT role, turn, count(*) AS n, round(count(*) * 100.0 / size, 6) AS rate FROM conversations JOIN s USING (turn) GROUP BY role, turn, size")
def a35(spark, sf):
    c = table(spark, sf, "conversations").select("role", "turn")
    return rounded(triangulate.rate_matrix(c, "role", "turn", c.groupBy("turn").agg(F.count("*").alias("size"))))


@query("a36_modes", "WITH g AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS k FROM g) SELECT r.source, r.lang AS most_common, r.n AS topic_records, a.records, a.documents FROM r JOIN (SELECT source, count(*) AS records, count(DISTINCT doc_id) AS documents FROM documents GROUP BY 1) a USING (source) WHERE k = 1")
def a36(spark, sf):
    return triangulate.modes(table(spark, sf, "documents"), "source", "lang", "doc_id")


@query("a37_records_histogram", "SELECT records, count(*) AS documents FROM (SELECT conv_id, count(*) AS records FROM conversations GROUP BY 1) GROUP BY 1")
def a37(spark, sf):
    return triangulate.records_histogram(table(spark, sf, "conversations"), "conv_id")


@query("a44_two_shares", "SELECT role, count(DISTINCT conv_id) AS documents, round(count(DISTINCT conv_id) * 100.0 / 231, 6) AS share_first, round(count(DISTINCT conv_id) * 100.0 / 245, 6) AS share_second FROM conversations WHERE role IN ('user', 'assistant') GROUP BY 1")
def a44(spark, sf):
    return rounded(triangulate.two_shares(table(spark, sf, "conversations"), "role", ["user", "assistant"], "conv_id", 231, 245))


@query("j20_code_names", "SELECT l_orderkey, l_linenumber, n_name AS name FROM lineitem LEFT JOIN nation ON n_nationkey = l_suppkey % 30")
def j20(spark, sf):
    s = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 30).alias("code"))
    return triangulate.name_codes(s, table(spark, sf, "nation").select(F.col("n_nationkey").alias("guid"), F.col("n_name").alias("name"))).select("l_orderkey", "l_linenumber", "name")


@query("j19_joint_display", "WITH t AS (SELECT source AS topic, count(*) AS n FROM documents GROUP BY 1), g AS (SELECT source, lang, count(*) AS c, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS k FROM documents GROUP BY 1, 2) SELECT topic, n, lang AS theme, c AS theme_documents, c AS annotation_records FROM t LEFT JOIN g ON g.source = topic AND k = 1")
def j19(spark, sf):
    d = table(spark, sf, "documents")
    t = d.groupBy(F.col("source").alias("topic")).agg(F.count("*").alias("n"))
    m = triangulate.modes(d, "source", "lang", "doc_id")
    return triangulate.joint_display(t, m.select(F.col("source").alias("topic"), F.col("most_common").alias("theme"), F.col("topic_records").alias("theme_documents")), m.select(F.col("source").alias("topic"), F.col("topic_records").alias("annotation_records")))


# dictionary and topic reports

TOPIC_TOKS = f"tt AS (SELECT doc_id, list_transform(list_filter({TOKS.format('text')}, lambda t: NOT (length(t) < 2 OR regexp_full_match(t, '[+-]?\\d+([.,]\\d+)*') OR lower(t) IN ('http', 'https', 'www', 'com'))), lambda t: lower(t)) AS k FROM documents)"
DICT = f"{TOPIC_TOKS}, df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(k) AS term FROM tt) GROUP BY 1), di AS (SELECT term, df, df / CAST((SELECT count(*) FROM tt WHERE len(k) > 0) AS DOUBLE) AS share FROM df), dd AS (SELECT *, CASE WHEN df < 5 THEN 'remove_low_df' WHEN share > CAST(0.4 AS DOUBLE) THEN 'remove_high_df' ELSE 'keep' END AS action FROM di)"


@query("a19_dictionary", f"WITH {DICT} SELECT term, df, round(share, 6) AS share, action FROM dd")
def a19(spark, sf):
    return rounded(topics.dictionary(topics.cleaned(raw_documents(spark, sf))))


@query("o2_dictionary_audit", f"WITH {DICT} SELECT term, df, action FROM dd ORDER BY df DESC, term")
def o2(spark, sf):
    return topics.dictionary_audit(topics.cleaned(raw_documents(spark, sf))).select("term", "df", "action")


@query("a41_action_counts", f"WITH {DICT} SELECT action, count(*) AS n FROM dd GROUP BY 1")
def a41(spark, sf):
    return topics.dictionary(topics.cleaned(raw_documents(spark, sf))).groupBy("action").agg(F.count("*").alias("n"))


@query("a21_corpus_flow", f"WITH {D}, {LAB}, f AS (SELECT count(*) AS a, count(*) FILTER (WHERE label = 1) AS b, count(*) FILTER (WHERE label = 1 AND length(norm) >= 30) AS c, count(*) FILTER (WHERE label = 1 AND length(norm) >= 30 AND toxic = 0) AS e FROM lab) SELECT 1 AS position, 'labelled' AS stage, a AS documents FROM f UNION ALL SELECT 2, 'positive', b FROM f UNION ALL SELECT 3, 'long enough', c FROM f UNION ALL SELECT 4, 'not flagged', e FROM f")
def a21(spark, sf):
    return topics.corpus_flow(labelled(spark, sf, norm=True), [("labelled", F.lit(True)), ("positive", F.col("label") == 1), ("long enough", F.length("norm") >= 30), ("not flagged", F.col("toxic") == 0)])


def probs(spark, sf):
    """Topic distributions of whole texts: five shares, of the tokens whose length leaves 0 to 4 when divided by five (and one more each)."""
    toks = raw_documents(spark, sf).select("doc_id", tokens(F.col("text")).alias("k"))
    left = lambda j: lambda t: F.length(t) % 5 == j
    raw = [(F.size(F.filter("k", left(j))) + 1).cast("double") for j in range(5)]
    return toks.select("doc_id", F.array(*raw).alias("r")).select("doc_id", F.transform("r", lambda x: x / F.aggregate("r", F.lit(0.0), lambda a, y: a + y)).alias("p"))


PROBS = f"rt AS (SELECT doc_id, {TOKS.format('text')} AS k FROM documents), r AS (SELECT doc_id, [{', '.join(f'CAST(1 + len(list_filter(k, lambda t: length(t) % 5 = {j})) AS DOUBLE)' for j in range(5))}] AS r FROM rt), pp AS (SELECT doc_id, list_transform(r, lambda x: x / list_sum(r)) AS p FROM r), dt AS (SELECT doc_id, p, list_position(p, list_max(p)) AS dominant_topic, list_max(p) AS mx, list_reverse_sort(p) AS s, list_sum(list_transform(p, lambda x: -x * ln(x + 1e-12))) / ln(CAST(5 AS DOUBLE)) AS ent FROM pp)"


@query("w6_document_topics", f"WITH {PROBS} SELECT doc_id, CAST(dominant_topic AS INTEGER) AS dominant_topic, round(mx, 6) AS dominant_probability, round(s[1] - s[2], 6) AS margin, round(ent, 6) AS normalized_entropy FROM dt")
def w6(spark, sf):
    return rounded(topics.document_topics(probs(spark, sf)).drop("p"))


LONG = "lg AS (SELECT doc_id, dominant_topic, unnest(range(1, 6)) AS topic_id, unnest(p) AS x FROM dt)"


@query("a22_prevalence", f"WITH {PROBS}, {LONG} SELECT CAST(topic_id AS INTEGER) AS topic_id, round(avg(x), 6) AS mean_topic_probability, count(*) FILTER (WHERE dominant_topic = topic_id) AS dominant_document_count, round(avg(CASE WHEN dominant_topic = topic_id THEN 1.0 ELSE 0 END), 6) AS dominant_document_share, round(sum(x * (doc_id % 4 + 1)) / sum(doc_id % 4 + 1), 6) AS weighted_mean FROM lg GROUP BY 1")
def a22(spark, sf):
    d = topics.document_topics(probs(spark, sf)).withColumn("family_size", F.col("doc_id") % 4 + 1)
    return rounded(topics.prevalence(d, 5, "family_size"))


@query("a24_diagnostics", f"WITH {PROBS}, {LONG}, pv AS (SELECT topic_id, avg(x) AS m, count(*) FILTER (WHERE dominant_topic = topic_id) AS n, avg(CASE WHEN dominant_topic = topic_id THEN 1.0 ELSE 0 END) AS s FROM lg GROUP BY 1) SELECT round(max(s), 6) AS max_dominant_share, count(*) FILTER (WHERE n = 0) AS zero_dominant_topics, round(exp(-sum(m * ln(m + 1e-12))), 6) AS effective_topics, round(max(m), 6) AS max_mean_topic_probability, max(s) <= 0.7 AND count(*) FILTER (WHERE n = 0) = 0 AS quality_gate_pass FROM pv")
def a24(spark, sf):
    return rounded(topics.quality_gate(topics.diagnostics(topics.prevalence(topics.document_topics(probs(spark, sf)), 5))))


@query("w2_representatives", f"WITH {PROBS}, {LONG} SELECT CAST(topic_id AS INTEGER) AS topic_id, CAST(rank AS INTEGER) AS rank, doc_id, round(x, 6) AS probability FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY x DESC, doc_id) AS rank FROM lg) WHERE rank <= 10")
def w2(spark, sf):
    return rounded(topics.representatives(probs(spark, sf)))


@query("o4_ambiguous", f"WITH {PROBS} SELECT doc_id FROM (SELECT doc_id, round(ent, 9) AS e, round(s[1] - s[2], 9) AS m FROM dt) ORDER BY e DESC, m, doc_id LIMIT 100")
def o4(spark, sf):
    d = topics.document_topics(probs(spark, sf)).withColumns({"normalized_entropy": F.round("normalized_entropy", 9), "margin": F.round("margin", 9)})
    return topics.ambiguous(d).select("doc_id")


TERMS = "SELECT CAST(length(k.term) % 5 + 1 AS INTEGER) AS topic_id, k.term, count(*) / CAST(1000 AS DOUBLE) AS probability FROM (SELECT unnest(k) AS term FROM tt) k GROUP BY ALL"


def weights(spark, sf):
    t = topics.cleaned(raw_documents(spark, sf)).select(F.explode("tokens").alias("term"))
    return t.groupBy((F.length("term") % 5 + 1).alias("topic_id"), "term").agg((F.count("*") / 1000).alias("probability"))


@query("w1_ranked_terms", f"WITH {TOPIC_TOKS}, w AS ({TERMS}) SELECT topic_id, term, round(probability, 6) AS probability, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY probability DESC, term) AS rank FROM w) WHERE rank <= 15")
def w1(spark, sf):
    return rounded(topics.ranked_terms(weights(spark, sf)))


@query("a40_term_lists", f"WITH {TOPIC_TOKS}, w AS ({TERMS}) SELECT topic_id, string_agg(term, ', ' ORDER BY rank) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY probability DESC, term) AS rank FROM w) WHERE rank <= 15 GROUP BY 1")
def a40(spark, sf):
    return topics.term_lists(topics.ranked_terms(weights(spark, sf)))


@query("a25_diversity", f"WITH {TOPIC_TOKS}, w AS ({TERMS}) SELECT round(count(DISTINCT term) / CAST(count(term) AS DOUBLE), 6) AS topic_diversity FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY probability DESC, term) AS rank FROM w) WHERE rank <= 10")
def a25(spark, sf):
    return rounded(topics.diversity(topics.ranked_terms(weights(spark, sf))))


def runs(spark, sf):
    """Made-up search runs: (k, seed) with figures from the parts table."""
    p = table(spark, sf, "part")
    k, s = (F.floor(F.col("p_partkey") / 5) + 4).cast("int"), (F.col("p_partkey") % 5 * 10 + 42).cast("int")
    return p.select(k.alias("k"), s.alias("seed"), (0.4 + F.col("p_size") / 1000).alias("coherence_cv"), (0.5 + (F.col("p_partkey") * 7 % 11) / 100).alias("topic_diversity"), (-7 - (F.col("p_partkey") % 3) / 10).alias("log_perplexity"))


def seed_sims(spark, sf):
    return topics.seed_pairs(runs(spark, sf)).withColumn("similarity", 0.3 + (F.col("k") * F.col("seed_a") + F.col("seed_b")) % 37 / 100)


RUNS = "ru AS (SELECT CAST(p_partkey // 5 + 4 AS INTEGER) AS k, CAST(p_partkey % 5 * 10 + 42 AS INTEGER) AS seed, CAST(0.4 AS DOUBLE) + p_size / CAST(1000 AS DOUBLE) AS coherence_cv, CAST(0.5 AS DOUBLE) + (p_partkey * 7 % 11) / CAST(100 AS DOUBLE) AS topic_diversity, -7 - (p_partkey % 3) / CAST(10 AS DOUBLE) AS log_perplexity FROM part), sm AS (SELECT k, coherence_mean, coherence_sd, coherence_sd / sqrt(n_seeds) AS coherence_se, n_seeds, diversity_mean, diversity_sd, lp_mean, lp_sd FROM (SELECT k, count(*) AS n_seeds, avg(coherence_cv) AS coherence_mean, stddev_samp(coherence_cv) AS coherence_sd, avg(topic_diversity) AS diversity_mean, stddev_samp(topic_diversity) AS diversity_sd, avg(log_perplexity) AS lp_mean, stddev_samp(log_perplexity) AS lp_sd FROM ru GROUP BY 1)), sp AS (SELECT a.k, a.seed AS seed_a, b.seed AS seed_b, CAST(0.3 AS DOUBLE) + (a.k * a.seed + b.seed) % 37 / CAST(100 AS DOUBLE) AS similarity FROM ru a JOIN ru b ON a.k = b.k AND a.seed < b.seed), st AS (SELECT k, avg(similarity) AS stability_mean, stddev_samp(similarity) AS stability_sd, min(similarity) AS stability_min FROM sp GROUP BY 1), ss AS (SELECT k, seed, avg(similarity) AS mean_similarity FROM (SELECT k, seed_a AS seed, similarity FROM sp UNION ALL SELECT k, seed_b, similarity FROM sp) GROUP BY 1, 2)"


@query("a15_k_summary", f"WITH {RUNS} SELECT k, n_seeds, round(coherence_mean, 6) AS coherence_mean, round(coherence_sd, 6) AS coherence_sd, round(diversity_mean, 6) AS diversity_mean, round(diversity_sd, 6) AS diversity_sd, round(lp_mean, 6) AS log_perplexity_mean, round(lp_sd, 6) AS log_perplexity_sd, round(coherence_se, 6) AS coherence_se FROM sm")
def a15(spark, sf):
    return rounded(topics.run_summary(runs(spark, sf)))


@query("j18_seed_pairs", f"WITH {RUNS} SELECT k, seed_a, seed_b FROM sp")
def j18(spark, sf):
    return topics.seed_pairs(runs(spark, sf))


@query("a16_seed_stability", f"WITH {RUNS} SELECT k, seed, round(mean_similarity, 6) AS mean_similarity FROM ss")
def a16(spark, sf):
    return rounded(topics.seed_stability(seed_sims(spark, sf)))


@query("j12_k_stability", f"WITH {RUNS} SELECT k, round(stability_mean, 6) AS stability_mean, round(stability_sd, 6) AS stability_sd, round(stability_min, 6) AS stability_min FROM st")
def j12(spark, sf):
    return rounded(topics.k_stability(seed_sims(spark, sf)))


@query("l15_selection", f"WITH {RUNS}, fl AS (SELECT coherence_mean - coherence_se AS f FROM sm ORDER BY coherence_mean DESC, k LIMIT 1), sk AS (SELECT sm.k FROM sm JOIN st USING (k), fl WHERE coherence_mean >= f ORDER BY stability_mean DESC, diversity_mean DESC, sm.k LIMIT 1) SELECT ru.k AS selected_k, ru.seed AS selected_seed FROM ru JOIN ss USING (k, seed) WHERE ru.k = (SELECT k FROM sk) ORDER BY mean_similarity DESC, coherence_cv DESC, ru.seed LIMIT 1")
def l15(spark, sf):
    return topics.select_k(runs(spark, sf), seed_sims(spark, sf))


@query("l10_lda")
def l10(spark, sf):
    """Prevalence of a fitted model of four topics."""
    toks = topics.cleaned(raw_documents(spark, sf)).where(F.size("tokens") > 0)
    _, p = topics.fit_lda(toks, 4, 42)
    return rounded(topics.prevalence(topics.document_topics(p), 4))


@query("s22_manifest", "SELECT '[' || string_agg('{\"lang\":\"' || lang || '\",\"n\":' || n || '}', ',' ORDER BY lang) || ']' AS records FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)")
def s22(spark, sf):
    return io.manifest(table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n")))
