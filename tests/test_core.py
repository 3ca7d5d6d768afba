"""Unit tests of the core library on small inputs."""

import html
import json
import unicodedata
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import fixed, text
from corpusloom.operators import annotations, families, graph, length, metrics, similarity, splits, topics, validate
from corpusloom.sources import io


def column(spark, values, f):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


def test_normalize(spark):
    cases = ["A&amp;B", "ＡＢＣ", "a​b", "x http abc def ghi đ", "mail a.b@x.org now", "hi @you_2 a@b", "đ, k!", "", None, "https://x.y/z"]
    assert column(spark, cases, text.normalize) == ["a b", "abc", "ab", "x đ", "mail now", "hi a b", "đ k", "", "", ""]


def test_unescape_matches_library(spark):
    cases = ["&lt;é&gt; &nbsp;x", "ﬁ ½", "plain"]
    assert column(spark, cases, text.unescape_nfkc) == [unicodedata.normalize("NFKC", html.unescape(c)) for c in cases]


def test_legacy_cascade():
    assert text.clean_legacy_text("hnay") == "hôm hôm nay"
    assert text.clean_legacy_text("đk k") == "đk không"
    assert text.clean_legacy_text("a @x #y http://z 😀") == "anh"
    assert text.clean_legacy_text(None) == ""
    assert len(fixed.ABBREVIATIONS) == 179


def test_topic_tokens(spark):
    got = column(spark, ["a 12,5 7 www Wort"], text.topic_tokens)[0]
    assert [tuple(x) for x in got] == [("a", "one_character"), ("12,5", "pure_number"), ("7", "one_character"), ("www", "web_residue"), ("wort", "kept")]


def test_word_ngrams_and_pad(spark):
    assert column(spark, ["a b c", ""], lambda c: text.word_ngrams(text.tokens(c))) == [["a", "b", "c", "a b", "b c"], []]
    assert column(spark, ["x"], lambda c: text.pad_ids(F.array(F.lit(1).cast("long")), 3)) == [[1, 0, 0]]


def test_components_match_union_find(spark):
    rng = np.random.default_rng(1)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(500 + i, 501 + i) for i in range(40)] + [(None, 3), (7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in e:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r[0]: r[1] for r in graph.connected_components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_similarity_join_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    words = [f"word{i}" for i in range(40)]
    docs = [" ".join(rng.choice(words, 30)) for _ in range(40)]
    docs += [d.replace("word1 ", "other ") for d in docs[:15]] + docs[:3]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, norm string")
    vec = similarity.tfidf(df)
    rows = {r[0]: {e["term"]: e["w"] for e in r[1]} for r in vec.collect()}
    want = set()
    for a in rows:
        for b in rows:
            if a < b and sum(w * rows[b].get(t, 0) for t, w in rows[a].items()) >= 0.9 - 1e-8:
                want.add((a, b))
    assert {(r[0], r[1]) for r in similarity.similar_pairs(vec, 0.9).collect()} == want and want


def test_complete_link_splits_chains():
    sims = {(0, 1): 0.96, (1, 2): 0.97, (0, 2): 0.90}
    assert families.complete_link(3, sims, 0.95) == [[0], [1, 2]]
    assert families.complete_link(3, {**sims, (0, 2): 0.95}, 0.95) == [[0, 1, 2]]


def test_split_sizes_follow_largest_remainder(spark):
    rows = spark.range(5933).select(F.col("id").alias("doc_id"), (F.col("id") >= 2151).cast("int").alias("label"))
    got = {r["label"]: r["n_test"] for r in splits.test_sizes(rows, "label").collect()}
    assert got == {0: 430, 1: 757}
    s = splits.stratified_split(rows, "label").groupBy("split").count().collect()
    assert {r[0]: r[1] for r in s} == {"test": 1187, "train": 4746}


def test_metrics_edge_cases(spark):
    one = spark.createDataFrame([(0, 0), (0, 0)], "gold int, pred int")
    r = metrics.evaluate(one).first()
    assert (r["accuracy"], r["precision_class1"], r["f1_class1"], r["macro_f1"]) == (1.0, 0.0, 0.0, 0.5)
    assert metrics.roc_auc(one.withColumn("s", F.lit(1.0)), "s").first()["auc"] is None
    s = metrics.sensitivity(one.withColumn("x", F.lit(True)), "x").first()
    assert s["clean_accuracy"] is None and s["all_accuracy"] == 1.0


def test_bootstrap_holds_the_estimate(spark):
    df = spark.range(400).select((F.col("id") % 2).alias("gold"), F.when(F.col("id") % 10 == 0, 1 - F.col("id") % 2).otherwise(F.col("id") % 2).alias("pred"))
    for r in metrics.bootstrap_ci(df).collect():
        assert 0.8 < r["low"] < r["high"] < 1.0


def test_length_match_pairs_are_unique(spark):
    rows = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("label"), (F.col("id") * 37 % 91 + 10).alias("chars"))
    p = length.match(rows, 1.25).collect()
    assert p and len({r[0] for r in p}) == len(p) == len({r[1] for r in p})


def test_annotation_reasons(spark):
    raw = ["x", '{"a":1}', '{"predicted_label":2,"primary_topic":"T01","secondary_topic":"NONE"}', '{"predicted_label":1,"primary_topic":"T13","secondary_topic":"NONE"}', '{"predicted_label":1,"primary_topic":"T01","secondary_topic":"T00"}', '{"predicted_label":1,"primary_topic":"T00","secondary_topic":"T01"}', '{"predicted_label":1,"primary_topic":"T01","secondary_topic":"T01"}', '{"predicted_label":1,"primary_topic":"T01","secondary_topic":"T02"}', None]
    assert column(spark, raw, lambda c: annotations.parse(c)[1]) == ["invalid_json", "unexpected_keys", "invalid_label", "invalid_primary_topic", "invalid_secondary_topic", "t00_requires_no_secondary", "duplicate_primary_secondary", None, "invalid_json"]


def test_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k int, v string")
    assert validate.null_counts(df).first()["k"] == 1
    assert validate.repeated_keys(df, "k").count() == 1
    with pytest.raises(ValueError):
        validate.require_columns(df, ["v", "k"], exact=True)
    a, b = df.select("v"), df.where("v <> 'c'").select("v")
    assert tuple(validate.set_difference_counts(a, b).first()) == (1, 0, False)


def test_assignment_is_optimal():
    from itertools import permutations

    for seed in range(5):
        c = np.random.default_rng(seed).random((5, 5))
        got = topics.assignment(c)
        assert sorted(got) == list(range(5))
        assert sum(c[i, j] for i, j in enumerate(got)) == pytest.approx(min(sum(c[i, j] for i, j in enumerate(p)) for p in permutations(range(5))))


def test_coherence_prefers_words_that_occur_together(spark):
    toks = spark.createDataFrame([(i, ["a", "b", "x"] if i % 2 else ["c", "d", "y"]) for i in range(20)], "doc_id long, tokens array<string>")
    terms = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (2, 2, "d")], "topic_id int, rank int, term string")
    got = {r[0]: r[1] for r in topics.coherence(toks, terms).collect()}
    assert got[1] > got[2]


def test_sources(spark, tmp_path):
    p = tmp_path / "m" / "d2"
    p.mkdir(parents=True)
    (p / "predictions.csv").write_text("﻿source_row_id,gold_label,predicted_label\n1,0,1\n", encoding="utf-8")
    assert tuple(io.read_predictions(spark, f"{tmp_path}/*/*/predictions.csv").first()) == ("m", 2, 1, 0, 1)
    (tmp_path / "t.csv").write_text('﻿text,label\n"a\nb ""q""",1\n', encoding="utf-8")
    assert tuple(io.read_csv(spark, f"{tmp_path}/t.csv", "text string, label int").first()) == ('a\nb "q"', 1)
    (tmp_path / "o.jsonl").write_text('{"id":"a"}\n{"id":"a"}\n')
    with pytest.raises(Exception, match="duplicate id"):
        io.read_jsonl(spark, f"{tmp_path}/o.jsonl", "id string", "id").collect()
    assert io.checksums(spark, f"{tmp_path}/t.csv").count() == 1
    assert "| n |" in io.report(spark.range(1).toDF("n"), "x")


def test_project_archive(spark, tmp_path):
    qde = '<Project xmlns="urn:x"><CodeBook><Codes><Code guid="g1" name="Theme"/></Codes></CodeBook><Sources><TextSource name="D1" plainTextPath="internal://s.txt"><PlainTextSelection startPosition="1" endPosition="4"><Coding><CodeRef targetGUID="g1"/></Coding></PlainTextSelection></TextSource></Sources></Project>'
    with zipfile.ZipFile(tmp_path / "p.qdpx", "w") as z:
        z.writestr("project.qde", qde)
        z.writestr("sources/s.txt", "abcdef")
    r = io.read_project(spark, f"{tmp_path}/p.qdpx").first()
    assert (r["document"], r["name"], r["start"], r["end"], r["text"]) == ("D1", "Theme", 1, 4, "bcd")


def test_stream_ingest_is_idempotent(spark, tmp_path):
    from corpusloom.streaming import ingest

    src = tmp_path / "in"
    src.mkdir()
    line = lambda i, s: json.dumps({"custom_id": i, "response": {"status_code": s}})
    (src / "a.json").write_text(line("x", 200) + "\n" + line("y", 500) + "\n")
    for extra in (None, "b.json"):
        if extra:
            (src / extra).write_text(line("z", 200) + "\n")
        ingest.merge_into(ingest.stream_outputs(spark, str(src)), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    got = ingest.current(spark, str(tmp_path / "t"))
    assert sorted(r["custom_id"] for r in got.collect()) == ["x", "y", "z"]


def test_topic_model_uses_the_dictionary_and_every_document(spark, tmp_path):
    from corpusloom.registry import QUERIES

    rows = [(i, "common " + " ".join(f"{'ab'[i % 2]}word{(i + j) % 9}" for j in range(6))) for i in range(60)] + [(60, "common rare")]
    docs = spark.createDataFrame([(i, t.split(" ")) for i, t in rows], "doc_id long, tokens array<string>")
    model, p = topics.fit_lda(docs, 2, 42)
    assert sorted(model.stages[0].vocabulary) == sorted(f"{c}word{j}" for c in "ab" for j in range(9))
    lda = model.stages[1]
    assert (lda.getSubsamplingRate(), lda.getMaxIter()) == (1.0, 20)
    assert sorted(x["doc_id"] for x in p.collect()) == list(range(60))  # the last has no kept term
    spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sum(r["dominant_document_count"] for r in QUERIES["l10_lda"](spark, str(tmp_path)).collect()) == 60


def test_code_names_cover_every_row(spark, tmp_path):
    from corpusloom.registry import QUERIES

    rows = [(o, n, o * 7 + n) for o in range(1, 30) for n in range(1, 4)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, f"n{k}") for k in range(25)], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    got = {tuple(r) for r in QUERIES["j20_code_names"](spark, str(tmp_path)).collect()}
    assert got == {(o, n, f"n{c % 30}" if c % 30 < 25 else None) for o, n, c in rows}


def test_grid_search_ranks_points(spark):
    from corpusloom.operators import classify

    rows = [(" ".join(f"{'good' if i % 2 else 'poor'}word{(i * 7 + j) % 5} same{j}" for j in range(4)), i % 2, i // 2 % 3) for i in range(36)]
    df = spark.createDataFrame(rows, "text string, label int, fold int")
    got = classify.search(df, "lr", ((1, 1),), (2, 50), (1.0, 10.0)).collect()
    assert [r["rank"] for r in got] == [1, 2, 3, 4] and got[0]["mean_macro_f1"] == 1.0 and got[0]["vocab"] == 50
    assert min(r["mean_macro_f1"] for r in got) < 1.0


def test_registry_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "a3_exact_duplicate_groups" in e.queries()


def test_copies_are_one_class(spark):
    base = " ".join(f"token{i} other{i}" for i in range(30))
    rows = [(i, base) for i in range(3000)] + [(3000, base.replace("token7", "tokens7")), (3001, "nothing alike " * 5), (3002, ""), (3003, "")]
    df = spark.createDataFrame(rows, "doc_id long, norm string")
    docs = df.join(similarity.forms(df).withColumnRenamed("doc_id", "p"), F.col("doc_id") == F.col("p")).drop("p")
    pairs = similarity.similar_pairs(similarity.tfidf(similarity.classes(df), copies="copies"), 0.9)
    assert [(r["a"], r["b"]) for r in pairs.collect()] == [(0, 3000)]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in families.link_counts(docs, pairs).collect()}
    assert got[5] == (0, 3000) and got[3000] == (3000, 3000) and got[3001] == (3001, 0) and 3002 not in got
    fam = families.families(docs, pairs, 0.9)
    inner = families.family_pairs(fam, pairs)
    assert tuple(families.link_check(fam, inner, 0.9).first()) == (3001 * 3000 // 2, 0, True)
    m = families.medoids(fam, inner, docs, F.col("norm") != "").collect()
    assert [(r["family_size"], r["representative"]) for r in m] == [(3001, 0)]
    kept = families.retained(docs, fam, families.medoids(fam, inner, docs, F.col("norm") != "")).where("retained").select("doc_id").collect()
    assert sorted(r[0] for r in kept) == [0, 3001, 3002, 3003]


def test_leakage_by_forms_equals_pairs_of_documents(spark):
    rng = np.random.default_rng(8)
    base = [" ".join(rng.choice([f"word{i}" for i in range(60)], 25)) for _ in range(12)]
    texts = [base[i % 12] if i % 3 else base[i % 12].replace(" word1 ", " extra ") for i in range(60)] + ["short", "short", ""]
    rows = [(i, t, i % 2, "test" if i % 5 == 0 else "train") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, norm string, label int, split string")
    docs = df.join(similarity.forms(df).withColumnRenamed("doc_id", "p"), F.col("doc_id") == F.col("p")).drop("p")
    vec = similarity.tfidf(similarity.classes(df), copies="copies")
    w = {r[0]: {e["term"]: e["w"] for e in r[1]} for r in vec.collect()}
    form = {r["doc_id"]: r["form"] for r in docs.collect()}
    sim = lambda a, b: 1.0 if texts[a] == texts[b] else sum(x * w.get(form[b], {}).get(t, 0) for t, x in w.get(form[a], {}).items())
    ok = lambda a, b: (texts[a] == texts[b] and texts[a]) or (min(len(texts[a]), len(texts[b])) >= 30 and sim(a, b) >= 0.9 - 1e-8)
    test, train = [r[0] for r in rows if r[3] == "test"], [r[0] for r in rows if r[3] == "train"]
    want = {(a, b) for a in test for b in train if ok(a, b)}
    pairs = families.form_pairs(docs, vec)
    got = families.leakage_pairs(docs, pairs).collect()
    assert {(r["test_id"], r["train_id"]) for r in got} == want and len(got) == len(want) > 0
    assert [(-r["similarity"], r["test_id"], r["train_id"]) for r in got] == sorted((-r["similarity"], r["test_id"], r["train_id"]) for r in got)
    near = families.nearest_train(docs, pairs, families.nearest_forms(docs, vec, pairs))
    s = {r["threshold"]: r for r in families.leakage_summary(docs, near, pairs).collect()}
    assert s[0.9]["cross_split_pairs"] == len(want) and s[0.9]["cross_label_pair_count"] == sum((a + b) % 2 for a, b in want)
    for r in near.collect():
        a = r["doc_id"]
        if len(texts[a]) < 30 and not any(texts[a] == texts[b] for b in train):
            assert r["nearest_kind"] == "none" and r["max_train_similarity"] is None
        else:
            best = max(sim(a, b) for b in train if texts[a] == texts[b] or len(texts[b]) >= 30)
            assert abs(r["max_train_similarity"] - best) < 1e-9


def test_complete_link_equals_a_dense_version():
    def dense(n, sims, t):
        s = np.full((n, n), -1.0)
        for (i, j), v in sims.items():
            s[i, j] = s[j, i] = v
        groups = {i: [i] for i in range(n)}
        np.fill_diagonal(s, -2)
        while len(groups) > 1:
            i, j = sorted(divmod(int(np.argmax(s)), n))
            if s[i, j] < t - 1e-10:
                break
            groups[i] += groups.pop(j)
            s[i] = np.minimum(s[i], s[j])
            s[:, i] = s[i]
            s[j], s[:, j], s[i, i] = -2, -2, -2
        return sorted(sorted(g) for g in groups.values())

    rng = np.random.default_rng(3)
    for _ in range(40):
        n = int(rng.integers(2, 25))
        sims = {(i, j): float(np.round(rng.uniform(0.9, 1), 2)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.6}
        assert families.complete_link(n, sims, 0.93) == dense(n, sims, 0.93)


def test_word2vec_and_report(spark, tmp_path):
    with open(f"{tmp_path}/v.bin", "wb") as f:
        f.write(b"3 2\n")
        for w, v in (("một", [1, 2]), ("b", [3, 4]), ("c d", [5, 6])):
            f.write(w.replace(" ", "_").encode() + b" " + np.array(v, "<f4").tobytes() + b"\n")
    got = io.read_word2vec(spark, f"{tmp_path}/v.bin", rows=2).collect()
    assert [(r["token"], r["vector"]) for r in got] == [("một", [1, 2]), ("b", [3, 4]), ("c_d", [5, 6])]
    assert io.report(spark.range(1500).toDF("n"), "x").count("\n") == 1504


def test_aliases_frozen_codes_and_joins(spark):
    alias = {"a": "x", "b": "y", "c": "x"}
    assert column(spark, [" A ,b,c,,", "b, ALL", None], lambda c: text.resolve_aliases(c, alias, ["x", "y"])) == [["x", "y"], ["x", "y"], None]
    with pytest.raises(Exception, match="unknown name z"):
        column(spark, ["z"], lambda c: text.resolve_aliases(c, alias, ["x", "y"]))
    import hashlib

    book = {"k": 'v"1', "é": "w}"}
    sha = hashlib.sha256(json.dumps(book, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    df = spark.createDataFrame(list(book.items()), "key string, value string")
    assert tuple(validate.frozen(df, 2, sha).first()) == (2, sha, True)
    one, two = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(1,), (3,)], "k int")
    assert tuple(validate.one_to_one(one, two, "k").first()) == (3, 2, 1, 0, 2, False)
    assert {tuple(r) for r in validate.label_counts(one, "k", {1: 1, 2: 1, 5: 2}).collect()} == {(1, 1, 1, True), (2, 2, 1, False), (5, 0, 2, False)}
    assert sorted(r["repeats"] for r in validate.assemble([one, two], "k").collect()) == [1, 2, 2, 2, 2]


def test_corpus_fingerprint_is_the_sequential_hash(spark):
    import hashlib

    rows = [(i * 7 % 50, f"s{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, sha string").repartition(4)
    want = hashlib.sha256("\n".join(f"{i}\t{s}" for i, s in sorted(rows)).encode()).hexdigest()
    assert topics.fingerprint(df, "doc_id", "sha").first()[0] == want
    assert topics.fingerprint(df.limit(0), "doc_id", "sha").first()[0] is None


def test_similarity_join_writes_less_than_vectors(spark):
    """Vectors are many times their texts, so a join that writes them fills the disk; nor may a task hold all postings at once."""
    from pathlib import Path

    from corpusloom.plans import session

    rng = np.random.default_rng(5)
    words = ["".join(rng.choice([*"abcdefghijklmnopqrst"], 9)) for _ in range(1500)]
    docs = [" ".join(rng.choice(words, 400)) for _ in range(120)]
    docs += [d.replace(" ", " and ", 4) for d in docs[:30]] + docs[:5]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, norm string").repartition(2)
    with session.created() as made:
        pairs = similarity.similar_pairs(similarity.tfidf(similarity.classes(df), copies="copies"), 0.9).collect()
        written = sum(f.stat().st_size for p in made for f in Path(session.local_path(p)).rglob("*") if f.is_file())
    assert {(r["a"], r["b"]) for r in pairs} >= {(i, 120 + i) for i in range(30)} and written < 3 * sum(map(len, docs))


def test_similarity_join_by_sketches(spark, monkeypatch):
    """What the join writes at once follows the sketches, not the vectors' prefixes; pairs and figures equal brute force and the join by prefixes."""
    from pathlib import Path

    from corpusloom.plans import session

    rng = np.random.default_rng(11)
    words = ["".join(rng.choice([*"abcdefghijklmnop"], 7)) for _ in range(1500)]
    docs = [" ".join(rng.choice(words, n)) for n in rng.integers(1, 600, 50)]
    docs += [" ".join(w for w in d.split() if rng.random() > cut) or d for d in docs for cut in (0.02, 0.1, 0.2, 0.3)]  # from near copies to pairs around 0.9
    docs += [docs[0] + f" and{i}" for i in range(40)] + ["", "x"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, norm string").repartition(3)
    vec = similarity.tfidf(similarity.classes(df), copies="copies")
    sizes = []

    def remove(spark, path, drop=session.remove):
        sizes.append(sum(f.stat().st_size for f in Path(session.local_path(path)).rglob("*") if f.is_file()))
        drop(spark, path)

    monkeypatch.setattr(similarity, "remove", remove)
    got = {(r["a"], r["b"]): r["similarity"] for r in similarity.similar_pairs(vec, 0.9).collect()}
    assert sizes and sum(sizes) < 0.5 * sum(map(len, docs))
    rows = vec.collect()
    at = {t: i for i, t in enumerate({e["term"] for r in rows for e in r["vec"]})}
    x = np.zeros((len(docs), len(at)))
    for r in rows:
        x[r["doc_id"], [at[e["term"]] for e in r["vec"]]] = [e["w"] for e in r["vec"]]
    sims = x @ x.T
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(sims >= 0.9 - 1e-8, 1)), strict=True)}
    assert got.keys() == want and len(want) > 780 and all(abs(got[p] - sims[p]) < 1e-9 for p in want) and sum(sims[p] < 0.93 for p in want) > 15
    assert {(r["a"], r["b"]) for r in similarity.similar_pairs(vec, 0.9, certain=True).collect()} == want
    left, right = (spark.createDataFrame([(i,) for i in range(k, len(docs), 3)] + [(1,)], "doc_id long") for k in (0, 1))
    left, right = left.distinct(), right.distinct()
    ids = [{r[0] for r in d.collect()} for d in (left, right)]
    assert {(r["a"], r["b"]) for r in similarity.similar_pairs(vec, 0.9, left, right).collect()} == {p for a, b in want for p in ((a, b), (b, a)) if p[0] in ids[0] and p[1] in ids[1]}


def test_sketches_hold_their_limit():
    """Squared distances of sketches are those of the vectors on average, and stay within the limit; many near ones are found as well as few."""
    rng = np.random.default_rng(2)
    hashes = rng.integers(-(1 << 63), (1 << 63) - 1, 500)
    x = rng.random((400, 500)) * (rng.random((400, 500)) < 0.3)
    y = np.where(rng.random((400, 500)) < 0.9, x, 0)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    a, b = (similarity._sketches(400, *np.nonzero(v), v[np.nonzero(v)], hashes) for v in (x, y))
    far, near = ((x - y) ** 2).sum(1), ((a - b) ** 2).sum(1)
    assert abs((near / far).mean() - 1) < 0.05 and all(d <= similarity._limit(f, similarity.BITS) for f, d in zip(far, near, strict=True))
    assert similarity._limit(0.2, 64) > similarity._limit(0.2, 192) > 0.2
    assert np.allclose(similarity._sketches(400, *np.nonzero(x), x[np.nonzero(x)], hashes), a)


def test_postings_come_in_pieces_and_sizes_bound(monkeypatch):
    monkeypatch.setattr(similarity, "HELD", 100)
    n = np.array([90, 30, 250, 5, 5])
    data = {"doc_id": np.arange(n.sum()), "w": np.ones(n.sum(), np.float16), "need": np.zeros(n.sum(), np.uint8)}

    class One:
        def shard(self, _):
            return data

    got = list(similarity._postings(One(), [(0, np.arange(5), np.cumsum(n) - n, n)], np.arange(5), np.ones(5)))
    assert max(len(g[0]) for g in got) == 250 and sorted(np.concatenate([g[1] for g in got])) == [*range(n.sum())]
    rng = np.random.default_rng(1)
    x = rng.random((200, 60)) * (rng.random((200, 60)) < 0.5)
    x[100:] = np.where(rng.random((100, 60)) < 0.85, x[:100], 0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    doc, term = np.nonzero(x)
    need, have = similarity._sizes(200, doc, x[doc, term], 0.9)
    a, b = np.nonzero(x @ x.T >= 0.9)
    assert len(a) > 250 and (need[a] <= have[b]).all()
    w = rng.random(1000) * 0.1
    assert (similarity._up(w).astype(float) >= w).all()


def test_csv_keeps_texts_as_they_are(spark, tmp_path):
    odd = [" lead", "trail ", "\n\nx\n", "\r\n", "a\r\nb", "a\rb", "", None, " ", "\t", "\x00", "\x01z\x02", "a\n", '"', '""', '\\"', "\\", "a,b"]
    io.write_csv(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").coalesce(1), str(tmp_path / "c"), gzip=True)
    assert {r["doc_id"]: r["text"] for r in io.read_csv(spark, str(tmp_path / "c"), "doc_id long, text string").collect()} == dict(enumerate(odd))


def test_normal_form_skips_only_what_finds_nothing(spark):
    """Expressions that need a mark in the text are left out without it; the form is that of the whole chain."""
    c = F.col("t")
    s = F.lower(text.remove_zero_width(text.unescape_nfkc(F.coalesce(c, F.lit("")))))
    whole = text.collapse_space(text.punctuation_to_space(text.remove_mentions(text.remove_emails(text.remove_urls(s)))))
    odd = [None, "", " ", "HTTP://X.y/z abc", "Http abc def", "see http : //foo bar", "WWW.abc.de x", "ＷＷＷ.abc.de", "a@b.co @me x@y", "＠you ok", "&#64;you", "ht\u200btp://a.b c", "x\ufeffy\u200d", "\u017fhttp\u017f://q", "hTTpS foo bar baz", "www", "@", "\u2028 a \u00a0b\u3000", "http\u200b://b c"]
    rows = spark.createDataFrame([(t,) for t in odd], "t string").select("t", text.normalize(c).alias("x"), whole.alias("y")).collect()
    assert len(rows) == len(odd) and all(r["x"] == r["y"] for r in rows)


@pytest.mark.parametrize("name", ["a5_leakage_summary", "g4_complete_link_families", "g6_medoids"])
def test_join_disk_follows_packed_texts(spark, tmp_path, name):
    """What a similarity query leaves in the shared folder and shuffles: packed normal forms, and candidates' counts once."""
    from pathlib import Path

    from corpusloom import registry
    from corpusloom.plans import session

    rng = np.random.default_rng(8)
    words = ["".join(rng.choice([*"abcdefghijklmnop"], 5)) for _ in range(4000)]
    docs = [" ".join(rng.choice(words, 900)) for _ in range(150)]
    docs += [d + " and" for d in docs]  # a near copy each
    spark.createDataFrame([(i, t, "en", "web") for i, t in enumerate(docs)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(len(docs))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    def shuffled() -> dict[str, int]:
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName(): files.apply(i).length() for i in range(files.size())}

    before = shuffled().keys()
    with session.created() as made:
        rows = registry.QUERIES[name](spark, str(tmp_path)).collect()
        held = sum(f.stat().st_size for p in made for f in Path(session.local_path(p)).rglob("*") if f.is_file())
    disk = held + sum(n for k, n in shuffled().items() if k not in before)
    assert len(rows) == {"a5_leakage_summary": 3, "g4_complete_link_families": 300, "g6_medoids": 150}[name]
    assert disk < {"a5_leakage_summary": 1.6}.get(name, 2.4) * sum(map(len, docs))
