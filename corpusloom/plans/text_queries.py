"""Queries of text functions, sources and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import families, topics, validate
from .base import D, LAB, RAW, SPLIT, TOKS, documents, labelled, query, raw_documents, rounded, split_rows, with_all
from .session import table


@query("t1_normalize", f"WITH {D} SELECT doc_id, sha256(norm) AS norm_sha256, CAST(length(norm) AS BIGINT) AS norm_chars, sha256(coalesce(text, '')) AS text_sha256 FROM d")
def t1(spark, sf):
    d = documents(spark, sf)
    return d.select("doc_id", text.sha256(F.col("norm")).alias("norm_sha256"), F.length("norm").cast("long").alias("norm_chars"), text.sha256(F.coalesce("text", F.lit(""))).alias("text_sha256"))


@query("t2_unescape_nfkc")
def t2(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", text.sha256(text.unescape_nfkc(F.col("html"))).alias("clean_sha256"))


@query("t6_remove_addresses", r"""SELECT page_id, trim(regexp_replace(regexp_replace(lower('see ' || url || ' or mail a.b@x.org, @me'), '(?:https?://\S+|www\.\S+|\bhttps?\b\s*(?:[:/._-]\s*|\s+)[a-z0-9][a-z0-9\s._/-]{2,})', ' ', 'gi'), '\b[\w.+-]+@[\w.-]+\.[a-zA-Z]{2,}\b', ' ', 'g').regexp_replace('(^|[^\w])@[\w.-]+', '\1 ', 'g').regexp_replace('\s+', ' ', 'g')) AS cleaned FROM pages""")
def t6(spark, sf):
    c = F.lower(F.concat(F.lit("see "), F.col("url"), F.lit(" or mail a.b@x.org, @me")))
    return table(spark, sf, "pages").select("page_id", text.collapse_space(text.remove_mentions(text.remove_emails(text.remove_urls(c)))).alias("cleaned"))


@query("t13_token_jaccard", f"""WITH t AS (SELECT conv_id, turn, text, list_distinct({TOKS.format("coalesce(text, '')")}) AS k FROM conversations)
SELECT a.conv_id, a.turn, round(CASE WHEN len(a.k) = 0 AND len(b.k) = 0 THEN 1.0 ELSE len(list_intersect(a.k, b.k)) / CAST(len(list_distinct(list_concat(a.k, b.k))) AS DOUBLE) END, 6) AS jaccard,
round(CASE WHEN greatest(length(a.text), length(b.text)) = 0 THEN 1.0 ELSE least(length(a.text), length(b.text)) / CAST(greatest(length(a.text), length(b.text)) AS DOUBLE) END, 6) AS length_ratio FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def t13(spark, sf):
    c = table(spark, sf, "conversations")
    b = c.select(F.col("conv_id").alias("c2"), (F.col("turn") - 1).alias("t2"), F.col("text").alias("next"))
    j = c.join(b, (F.col("conv_id") == F.col("c2")) & (F.col("turn") == F.col("t2")))
    return rounded(j.select("conv_id", "turn", text.token_jaccard(F.col("text"), F.col("next")).alias("jaccard"), text.length_ratio(F.col("text"), F.col("next")).alias("length_ratio")))


@query("t14_clean_legacy")
def t14(spark, sf):
    return raw_documents(spark, sf).select("doc_id", text.sha256(text.clean_legacy(F.col("text"))).alias("clean_sha256"))


@query("t20_keep_words", f"WITH {D}, k AS (SELECT doc_id, list_filter(list_filter(string_split(norm, ' '), lambda t: t <> ''), lambda t: regexp_full_match(replace(t, '_', ''), '\\p{{L}}+') AND length(t) > 1) AS k FROM d) SELECT doc_id, CAST(len(k) AS BIGINT) AS n_words, sha256(array_to_string(k, ' ')) AS words_sha256 FROM k")
def t20(spark, sf):
    k = text.keep_words(text.tokens(F.col("norm")))
    return documents(spark, sf).select("doc_id", F.size(k).cast("long").alias("n_words"), text.sha256(F.array_join(k, " ")).alias("words_sha256"))


REASON = r"CASE WHEN length(t) < 2 THEN 'one_character' WHEN regexp_full_match(t, '[+-]?\d+([.,]\d+)*') THEN 'pure_number' WHEN lower(t) IN ('http', 'https', 'www', 'com') THEN 'web_residue' ELSE 'kept' END"


@query("t21_topic_token_cleanup", f"WITH t AS (SELECT unnest({TOKS.format('text')}) AS t FROM documents) SELECT {REASON} AS reason, count(*) AS n FROM t GROUP BY 1")
def t21(spark, sf):
    return topics.cleanup_counts(raw_documents(spark, sf))


@query("t22_token_count", f"SELECT doc_id, CAST(len({TOKS.format('text')}) AS BIGINT) AS n_tokens FROM documents")
def t22(spark, sf):
    return raw_documents(spark, sf).select("doc_id", text.token_count(F.col("text")).alias("n_tokens"))


@query("t24_word_ngrams", f"WITH {D}, k AS (SELECT doc_id, list_filter(string_split(norm, ' '), lambda t: t <> '') AS k FROM d) SELECT doc_id, CAST(len(k) + greatest(len(k) - 1, 0) AS BIGINT) AS n_grams, CAST(len(list_distinct(list_concat(k, list_transform(range(1, greatest(len(k), 1)), lambda i: k[i] || ' ' || k[i + 1])))) AS BIGINT) AS n_distinct FROM k")
def t24(spark, sf):
    g = text.word_ngrams(text.tokens(F.col("norm")))
    return documents(spark, sf).select("doc_id", F.size(g).cast("long").alias("n_grams"), F.size(F.array_distinct(g)).cast("long").alias("n_distinct"))


@query("t27_slug", "SELECT p_partkey, replace(replace(replace(replace(replace(lower(p_name || ' + (' || p_brand || '-x)'), '+', 'plus'), ' ', '_'), '-', '_'), '(', ''), ')', '') AS slug FROM part")
def t27(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.slug(F.concat("p_name", F.lit(" + ("), "p_brand", F.lit("-x)"))).alias("slug"))


@query("t29_number_in_header", "SELECT doc_id, CAST(regexp_extract('T1 (n=' || chars || ')', 'n=(\\d+)', 1) AS BIGINT) AS n FROM (SELECT doc_id, length(text) AS chars FROM documents)")
def t29(spark, sf):
    return raw_documents(spark, sf).select("doc_id", F.regexp_extract(F.concat(F.lit("T1 (n="), F.col("chars"), F.lit(")")), r"n=(\d+)", 1).cast("long").alias("n"))


@query("t32_corpus_fingerprint", f"WITH {D} SELECT sha256(string_agg(doc_id || chr(9) || sha256(norm), chr(10) ORDER BY doc_id)) AS corpus_sha256 FROM d")
def t32(spark, sf):
    d = documents(spark, sf).withColumn("sha", text.sha256(F.col("norm")))
    return topics.fingerprint(d, "doc_id", "sha")


@query("t34_pad_ids", f"WITH k AS (SELECT doc_id, list_transform({TOKS.format('text')}, lambda t: CAST(length(t) AS BIGINT)) AS k FROM documents) SELECT doc_id, array_to_string(list_resize(k, 150, CAST(0 AS BIGINT)), ',') AS ids FROM k")
def t34(spark, sf):
    ids = F.transform(text.tokens(F.col("text")), lambda t: F.length(t).cast("long"))
    return raw_documents(spark, sf).select("doc_id", F.array_join(text.pad_ids(ids).cast("array<string>"), ",").alias("ids"))


@query("t35_span_text", "SELECT item_id, substring(text, 6, 14) AS span FROM benchmark")
def t35(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", text.span_text(F.col("text"), F.lit(5), F.lit(19)).alias("span"))


@query("m2_log_bins", "SELECT CAST(floor(ln(1 + length(text)) / ln(CAST(1.25 AS DOUBLE))) AS BIGINT) AS bin, count(*) AS n FROM documents GROUP BY 1")
def m2(spark, sf):
    return raw_documents(spark, sf).groupBy(text.log_bin(F.col("chars"), 1.25).alias("bin")).agg(F.count("*").alias("n"))


@query("m8_iso_time", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso, CAST(epoch(ts) AS BIGINT) AS epoch FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def m8(spark, sf):
    ts = F.date_trunc("second", "ts")
    return table(spark, sf, "events").select("event_id", F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("iso"), F.unix_timestamp(ts).alias("epoch"))


@query("m10_json_number", "SELECT event_type, CAST(sum(coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0)) AS BIGINT) AS k_total, CAST(sum(coalesce(CAST(json_extract_string(props, '$.none') AS BIGINT), 0)) AS BIGINT) AS none_total FROM events GROUP BY 1")
def m10(spark, sf):
    v = lambda p: F.sum(F.coalesce(F.get_json_object("props", p).cast("long"), F.lit(0)))
    return table(spark, sf, "events").groupBy("event_type").agg(v("$.k").alias("k_total"), v("$.none").alias("none_total"))


# checks


@query("f1_label_filter", f"WITH {RAW}, {LAB} SELECT doc_id, chars FROM lab WHERE label = 1")
def f1(spark, sf):
    return labelled(spark, sf).where("label = 1").select("doc_id", "chars")


@query("f2_eligible", f"WITH {D} SELECT doc_id FROM d WHERE length(norm) >= 30")
def f2(spark, sf):
    from ..operators.similarity import eligible

    return eligible(documents(spark, sf)).select("doc_id")


@query("f3_nonempty", "SELECT count(*) AS n FROM documents WHERE trim(text) <> ''")
def f3(spark, sf):
    from ..sources.io import read_nonempty

    return read_nonempty(raw_documents(spark, sf), "text").agg(F.count("*").alias("n"))


@query("f4_tolerant_threshold", "SELECT count(*) AS n FROM lineitem WHERE l_discount >= CAST(0.05 AS DOUBLE) - 1e-8")
def f4(spark, sf):
    return table(spark, sf, "lineitem").where(F.col("l_discount") >= 0.05 - fixed.TOLERANCE).agg(F.count("*").alias("n"))


@query("f5_project_rename", "SELECT doc_id AS source_row_id, lang AS language FROM documents")
def f5(spark, sf):
    return raw_documents(spark, sf).select("doc_id", "lang").withColumnsRenamed({"doc_id": "source_row_id", "lang": "language"})


@query("f6_null_safe_equal", "SELECT coalesce(quality = toxic, false) AS same, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def f6(spark, sf):
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.groupBy(F.coalesce(F.col("quality") == F.col("toxic"), F.lit(False)).alias("same")).agg(F.count("*").alias("n"))


@query("f7_missing_columns", "SELECT 'nothing' AS missing")
def f7(spark, sf):
    validate.require_columns(table(spark, sf, "documents"), ["doc_id", "text"])
    got = validate.missing_columns(table(spark, sf, "documents"), ["doc_id", "nothing"])
    return spark.createDataFrame([(c,) for c in got], "missing string")


@query("f8_null_counts", "SELECT count(*) - count(doc_id) AS doc_id, count(*) - count(text) AS text, count(*) - count(lang) AS lang FROM documents")
def f8(spark, sf):
    return validate.null_counts(table(spark, sf, "documents").select("doc_id", "text", "lang"))


@query("f9_domain", "SELECT count(*) AS n, count(*) FILTER (WHERE NOT coalesce(quality IN (0, 1), false)) AS n_outside, count(*) FILTER (WHERE NOT coalesce(quality IN (0, 1), false)) = 0 AS ok FROM labels")
def f9(spark, sf):
    return validate.domain(table(spark, sf, "labels"), "quality", [0, 1])


@query("f11_misaligned", "SELECT count(*) AS n_misaligned FROM documents a FULL JOIN documents b ON a.doc_id = b.doc_id WHERE lower(a.lang) IS DISTINCT FROM CASE WHEN b.doc_id % 7 = 0 THEN 'xx' ELSE b.lang END")
def f11(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    other = d.withColumn("lang", F.when(F.col("doc_id") % 7 == 0, "xx").otherwise(F.col("lang")))
    return validate.misaligned(d.withColumn("lang", F.lower("lang")), other, "doc_id", ["lang"])


@query("f12_id_sets", "SELECT count(*) FILTER (WHERE l.doc_id IS NULL) AS only_a, count(*) FILTER (WHERE d.doc_id IS NULL) AS only_b, count(*) FILTER (WHERE l.doc_id IS NULL OR d.doc_id IS NULL) = 0 AS equal FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def f12(spark, sf):
    return validate.set_difference_counts(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id"))


@query("f13_multiset", "SELECT lang, sum(na)::BIGINT AS n_a, sum(nb)::BIGINT AS n_b FROM (SELECT lang, 1 AS na, 0 AS nb FROM documents UNION ALL SELECT lang, 0, 1 FROM documents WHERE doc_id % 5 <> 0) GROUP BY 1 HAVING sum(na) <> sum(nb)")
def f13(spark, sf):
    d = table(spark, sf, "documents")
    return validate.multiset_difference(d.select("lang"), d.where("doc_id % 5 <> 0").select("lang"))


@query("f14_map_conflicts", "SELECT a.doc_id, a.quality AS value_a, b.toxic AS value_b FROM labels a JOIN labels b ON a.doc_id = b.doc_id WHERE a.quality IS DISTINCT FROM b.toxic")
def f14(spark, sf):
    l = table(spark, sf, "labels")
    return validate.map_conflicts(l.select("doc_id", "quality"), l.select("doc_id", F.col("toxic").alias("quality")), "doc_id", "quality")


@query("f15_repeated_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def f15(spark, sf):
    return validate.repeated_keys(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query("f18_budget", "SELECT lang, n, round(cost, 6) AS cost, cost > 0.05 AS over_each, sum(cost) OVER () > 0.2 OR sum(n) OVER () > 500 AS over_all FROM (SELECT lang, count(*) AS n, sum(length(text) / CAST(2e6 AS DOUBLE)) AS cost FROM documents GROUP BY 1)")
def f18(spark, sf):
    d = raw_documents(spark, sf).withColumn("c", F.col("chars") / 2e6)
    return rounded(validate.over_budget(d, "lang", "c", 500, 0.2, 0.05))


@query("f19_bad_spans", "SELECT doc_id FROM documents WHERE NOT coalesce(length(text) - 2000 >= 0 AND length(text) - 2000 < 1500 AND 1500 <= length(text), false)")
def f19(spark, sf):
    d = raw_documents(spark, sf).withColumns({"s": F.col("chars") - 2000, "e": F.lit(1500)})
    return validate.bad_spans(d, "s", "e", "chars").select("doc_id")


@query("f21_rates_match", "WITH g AS (SELECT toxic, count(*) FILTER (WHERE quality = 1) / CAST(count(*) AS DOUBLE) AS x FROM labels GROUP BY 1) SELECT digits, round(max(abs(x - CASE WHEN digits = 3 THEN round(x, 3) ELSE x END)), 9) AS max_gap, max(abs(x - CASE WHEN digits = 3 THEN round(x, 3) ELSE x END)) < 1e-8 AS ok FROM g, (VALUES (3), (15)) AS v(digits) GROUP BY 1")
def f21(spark, sf):
    """Rates stored with three digits against counts, and with all digits."""
    g = table(spark, sf, "labels").groupBy("toxic").agg(F.count_if(F.col("quality") == 1).alias("n"), F.count("*").alias("t")).withColumn("x", F.col("n") / F.col("t"))
    one = lambda digits, x: validate.rates_match(g.withColumn("r", x), "n", "t", "r").select(F.lit(digits).alias("digits"), F.round("max_gap", 9).alias("max_gap"), "ok")
    return one(3, F.round("x", 3)).unionByName(one(15, F.col("x")))


@query("f10_label_counts", "SELECT quality AS label, count(*) AS n, CAST(CASE quality WHEN 0 THEN 150 ELSE 249 END AS BIGINT) AS expected, count(*) = CASE quality WHEN 0 THEN 150 ELSE 249 END AS ok FROM labels GROUP BY 1")
def f10(spark, sf):
    return validate.label_counts(table(spark, sf, "labels"), "quality", {0: 150, 1: 249})


@query("j3_one_to_one", "SELECT (SELECT count(*) FROM documents) AS left_rows, (SELECT count(*) FROM labels) AS right_rows, (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)) AS repeated_left, (SELECT count(*) FROM (SELECT doc_id FROM labels GROUP BY 1 HAVING count(*) > 1)) AS repeated_right, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS unmatched, (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT doc_id FROM labels GROUP BY 1 HAVING count(*) > 1)) = 0 AS ok")
def j3(spark, sf):
    return validate.one_to_one(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("t31_canonical_json", """SELECT n_nationkey, '{"n_name":' || to_json(n_name) || ',"n_regionkey":' || n_regionkey || '}' AS canonical, sha256('{"n_name":' || to_json(n_name) || ',"n_regionkey":' || n_regionkey || '}') AS hash FROM nation""")
def t31(spark, sf):
    names = ["n_regionkey", "n_name"]
    return table(spark, sf, "nation").select("n_nationkey", text.canonical_json(names).alias("canonical"), text.canonical_hash(names).alias("hash"))


@query("f22_frozen_codes", """WITH j AS (SELECT '{' || string_agg(to_json(n_name) || ':' || to_json('region ' || n_regionkey), ',' ORDER BY n_name) || '}' AS j, count(*) AS n FROM nation) SELECT n, sha256(j) AS sha256, n = 25 AND sha256(j) = 'none' AS ok FROM j""")
def f22(spark, sf):
    """A code book whose hash isn't the frozen one."""
    e = table(spark, sf, "nation").select(F.col("n_name").alias("key"), F.concat(F.lit("region "), F.col("n_regionkey")).alias("value"))
    return validate.frozen(e, 25, "none")


@query("t28_alias_lists", "WITH l AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN ['u', 'a', 's'] ELSE [CASE role WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 's' END, 'a', 'u'] END AS l FROM conversations) SELECT conv_id, turn, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS names FROM l")
def t28(spark, sf):
    alias = {"user": "u", "human": "u", "assistant": "a", "bot": "a", "system": "s", "tool": "s"}
    c = table(spark, sf, "conversations")
    listed = F.when(F.col("turn") % 5 == 4, F.concat("role", F.lit(", ALL"))).otherwise(F.concat(F.upper("role"), F.lit(" ,, Bot,human"), F.lit(",assistant")))
    return c.select("conv_id", "turn", F.array_join(text.resolve_aliases(listed, alias, ["u", "a", "s"]), ",").alias("names"))


# duplicates and set operations


@query("a2_duplicate_rows", "SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS duplicate_rows, count(*) AS duplicate_texts FROM (SELECT text, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1)")
def a2(spark, sf):
    return families.duplicate_rows(table(spark, sf, "documents"), "text")


@query("a3_exact_duplicate_groups", f"WITH {D} SELECT sha256(norm) AS normalized_sha256, count(*) AS group_size, count(*) FILTER (WHERE quality = 0) AS label_0, count(*) FILTER (WHERE quality = 1) AS label_1, min(d.doc_id) AS min_doc_id, CASE WHEN count(*) FILTER (WHERE quality = 0) = 0 OR count(*) FILTER (WHERE quality = 1) = 0 THEN 1 ELSE 0 END AS label_pure FROM d LEFT JOIN labels USING (doc_id) WHERE norm <> '' GROUP BY 1 HAVING count(*) > 1")
def a3(spark, sf):
    return families.exact_groups(with_all(spark, sf))


@query("a3_group_members", f"WITH {D} SELECT normalized_sha256, doc_id FROM (SELECT sha256(norm) AS normalized_sha256, doc_id, count(*) OVER (PARTITION BY norm) AS n FROM d WHERE norm <> '') WHERE n > 1")
def a3m(spark, sf):
    return families.group_members(documents(spark, sf))


@query("t30_id_lists", "SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ';' ORDER BY l_linenumber) AS ids FROM lineitem GROUP BY 1")
def t30(spark, sf):
    return families.id_list(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber")


@query("t30_split_ids", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS doc_id FROM lineitem")
def t30s(spark, sf):
    return families.split_ids(t30(spark, sf))


def _sides(spark, sf):
    l = labelled(spark, sf, norm=True)
    return l.where("doc_id % 2 = 0"), l.where("doc_id % 2 = 1")


@query("a4_overlap", f"""WITH {D}, {LAB}, s AS (SELECT * FROM (VALUES ('all'), ('0'), ('1')) AS v(label_scope)), x AS (SELECT label_scope, lab.* FROM s JOIN lab ON label_scope = 'all' OR label_scope = CAST(label AS VARCHAR))
SELECT label_scope, count(*) FILTER (WHERE doc_id % 2 = 0) AS a_n, count(*) FILTER (WHERE doc_id % 2 = 1) AS b_n,
(SELECT count(*) FROM (SELECT text FROM x y WHERE y.label_scope = x.label_scope AND doc_id % 2 = 0 INTERSECT SELECT text FROM x y WHERE y.label_scope = x.label_scope AND doc_id % 2 = 1)) AS text_intersection,
(SELECT count(*) FROM (SELECT norm FROM x y WHERE y.label_scope = x.label_scope AND doc_id % 2 = 0 INTERSECT SELECT norm FROM x y WHERE y.label_scope = x.label_scope AND doc_id % 2 = 1)) AS norm_intersection FROM x GROUP BY label_scope""")
def a4(spark, sf):
    a, b = _sides(spark, sf)
    return families.overlap(a, b, "label", "text", "norm")


@query("u1_union_all", "SELECT source, count(*) AS n FROM (SELECT source FROM documents UNION ALL SELECT source FROM documents) GROUP BY 1")
def u1(spark, sf):
    d = table(spark, sf, "documents").select("source")
    return d.unionByName(d).groupBy("source").agg(F.count("*").alias("n"))


@query("u3_intersection", f"WITH {D} SELECT count(*) AS n FROM (SELECT norm FROM d WHERE doc_id % 2 = 0 INTERSECT SELECT norm FROM d WHERE doc_id % 2 = 1)")
def u3(spark, sf):
    d = documents(spark, sf)
    return d.where("doc_id % 2 = 0").select("norm").intersect(d.where("doc_id % 2 = 1").select("norm")).agg(F.count("*").alias("n"))


@query("u4_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u4(spark, sf):
    return table(spark, sf, "documents").select("doc_id").subtract(table(spark, sf, "labels").select("doc_id"))


@query("u5_distinct_pairs", "SELECT DISTINCT lang, source FROM documents")
def u5(spark, sf):
    return table(spark, sf, "documents").select("lang", "source", "text").dropDuplicates(["lang", "source"]).select("lang", "source")


@query("u6_upsert", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def u6(spark, sf):
    from ..operators.annotations import upsert

    e = table(spark, sf, "events").withColumn("at", F.struct("ts", "event_id"))
    return upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "at").select("user_id", "event_id", "value")


@query("j13_semi", f"WITH {RAW}, {LAB} SELECT doc_id, lang FROM d WHERE doc_id IN (SELECT doc_id FROM lab WHERE toxic = 1)")
def j13(spark, sf):
    return raw_documents(spark, sf).join(table(spark, sf, "labels").where("toxic = 1"), "doc_id", "left_semi").select("doc_id", "lang")


@query("j14_anti", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j14(spark, sf):
    return raw_documents(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


@query("j16_text_match", f"WITH {RAW}, {LAB} SELECT a.doc_id AS id_a, min(b.doc_id) AS id_b FROM lab a JOIN lab b ON a.text = b.text AND a.doc_id <> b.doc_id WHERE a.label = 1 AND b.label = 1 GROUP BY 1")
def j16(spark, sf):
    """The smallest other document of the same text, from the two smallest ids of each text."""
    l = labelled(spark, sf).where("label = 1").select("doc_id", text.sha256(F.col("text")).alias("h"))
    first = l.groupBy(F.col("h").alias("h1")).agg(F.min("doc_id").alias("m1"))
    l = l.join(first, F.col("h") == F.col("h1"))
    second = l.where("doc_id > m1").groupBy(F.col("h").alias("h2")).agg(F.min("doc_id").alias("m2"))
    return l.join(second, F.col("h") == F.col("h2")).select(F.col("doc_id").alias("id_a"), F.when(F.col("doc_id") == F.col("m1"), F.col("m2")).otherwise(F.col("m1")).alias("id_b"))


@query("x1_stratified_split", f"WITH {RAW}, {LAB}, {SPLIT} SELECT doc_id, label, split FROM sp")
def x1(spark, sf):
    return split_rows(spark, sf).select("doc_id", "label", "split")


@query("g10_canonical_corpus", f"WITH {D}, {LAB}, {SPLIT}, a AS (SELECT * FROM sp WHERE label = 1 AND doc_id % 2 = 0), b AS (SELECT text, max(doc_id) AS second_id FROM sp WHERE label = 1 GROUP BY 1) SELECT doc_id AS first_id, sha256(a.text) AS text_sha256, trim(a.norm) <> '' AS clean_nonempty, CAST(length(a.norm) AS BIGINT) AS norm_chars, sha256(a.norm) AS norm_sha256, second_id, a.split = 'test' AS in_first_test, second_id IN (SELECT doc_id FROM sp WHERE split = 'test') AS in_second_test FROM a JOIN b USING (text)")
def g10(spark, sf):
    s = split_rows(spark, sf, norm=True).where("label = 1").withColumn("clean", F.col("norm"))
    test = split_rows(spark, sf).where("split = 'test'").select("doc_id")
    return families.canonical(s.where("doc_id % 2 = 0"), s, [test, test])


@query("x1_split_sizes", f"WITH {RAW}, {LAB}, {SPLIT} SELECT label, n, n_test FROM sz")
def x1s(spark, sf):
    from ..operators.splits import test_sizes

    return test_sizes(labelled(spark, sf), "label")


@query("x2_validation_split", f"WITH {RAW}, {LAB}, {SPLIT}, tr AS (SELECT * FROM sp WHERE split = 'train'), p2 AS (SELECT label, count(*) AS n FROM tr GROUP BY 1), t2 AS (SELECT sum(n) AS t, ceil(sum(n) * CAST(0.125 AS DOUBLE)) AS want FROM p2), e2 AS (SELECT label, n * want / t AS e, floor(n * want / t) AS low, want FROM p2, t2), l2 AS (SELECT *, row_number() OVER (ORDER BY e - low DESC, label) AS place, want - (SELECT sum(low) FROM e2) AS lft FROM e2) SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY tr.label ORDER BY sha256('43:' || doc_id)) <= low + (CASE WHEN place <= lft THEN 1 ELSE 0 END) THEN 'validation' ELSE 'train' END AS split FROM tr JOIN l2 USING (label) UNION ALL SELECT doc_id, split FROM sp WHERE split = 'test'")
def x2(spark, sf):
    from ..operators.splits import validation_split

    return validation_split(split_rows(spark, sf), "label").select("doc_id", "split")


@query("x4_folds", f"WITH {RAW}, {LAB} SELECT doc_id, CAST((row_number() OVER (PARTITION BY label ORDER BY sha256('44:' || doc_id)) - 1) % 5 AS INTEGER) AS fold FROM lab")
def x4(spark, sf):
    from ..operators.splits import folds

    return folds(labelled(spark, sf), "label").select("doc_id", "fold")
