"""Duplicate groups, leakage between splits, clusters and complete-link families."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import ratio, sha256, token_jaccard
from ..plans.session import materialize
from .graph import connected_components
from .similarity import Vectors, best_match, both_ways, chars, eligible, forms, nearest, similar_pairs


def exact_groups(docs: DataFrame, norm: str = "norm", doc_id: str = "doc_id", label: str = "label") -> DataFrame:
    """Groups of two or more documents with equal non-empty normal form: hash, sizes by label, purity, smallest id."""
    g = docs.where(F.col(norm) != "").groupBy(sha256(F.col(norm)).alias("normalized_sha256"))
    g = g.agg(F.count("*").alias("group_size"), F.count_if(F.col(label) == 0).alias("label_0"), F.count_if(F.col(label) == 1).alias("label_1"), F.min(doc_id).alias("min_doc_id"))
    return g.where("group_size > 1").withColumn("label_pure", ((F.col("label_0") == 0) | (F.col("label_1") == 0)).cast("int"))


def group_members(docs: DataFrame, norm: str = "norm", doc_id: str = "doc_id") -> DataFrame:
    """(normalized_sha256, doc_id): a row a member of those groups, so that no group is gathered in one cell."""
    d = docs.where(F.col(norm) != "").select(sha256(F.col(norm)).alias("normalized_sha256"), F.col(doc_id).alias("doc_id"))
    many = d.groupBy(F.col("normalized_sha256").alias("h")).agg(F.count("*").alias("n")).where("n > 1").select("h")
    return d.join(many, F.col("normalized_sha256") == F.col("h"), "left_semi")


def id_list(rows: DataFrame, group: str, doc_id: str = "doc_id", sep: str = ";") -> DataFrame:
    """(group, ids): each group's ids in order, joined; for groups of a bounded size."""
    g = rows.groupBy(group).agg(F.sort_array(F.collect_list(doc_id)).alias("ids"))
    return g.withColumn("ids", F.array_join(F.transform("ids", lambda i: i.cast("string")), sep))


def split_ids(rows: DataFrame, ids: str = "ids", doc_id: str = "doc_id", sep: str = ";") -> DataFrame:
    """A row for each id of a joined list; blanks are left out."""
    each = F.explode(F.filter(F.transform(F.split(F.coalesce(F.col(ids), F.lit("")), sep), lambda x: F.trim(x)), lambda x: x != ""))
    return rows.select(*[c for c in rows.columns if c != ids], each.alias(doc_id)).withColumn(doc_id, F.col(doc_id).cast("long"))


def duplicate_rows(docs: DataFrame, text: str) -> DataFrame:
    """One row: rows that share their text with another, and the distinct texts shared."""
    g = docs.groupBy(text).agg(F.count("*").alias("n")).where("n > 1")
    return g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_rows"), F.count("*").alias("duplicate_texts"))


def overlap(a: DataFrame, b: DataFrame, label: str, *texts: str) -> DataFrame:
    """Rows for scope all, 0 and 1: sizes and distinct texts in common, for each text column."""
    rows = []
    for scope, cond in (("all", F.lit(True)), ("0", F.col(label) == 0), ("1", F.col(label) == 1)):
        x, y = a.where(cond), b.where(cond)
        one = x.agg(F.count("*").alias("a_n")).join(y.agg(F.count("*").alias("b_n")))  # one row each
        for t in texts:
            one = one.join(x.select(t).intersect(y.select(t)).agg(F.count("*").alias(f"{t}_intersection")))
        rows.append(one.select(F.lit(scope).alias("label_scope"), "*"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def form_pairs(docs: DataFrame, vectors: Vectors, threshold: float = min(fixed.THRESHOLDS), min_chars: int = fixed.MIN_CHARS) -> DataFrame:
    """Pairs of normal forms, one with test and one with train documents, at or over threshold; an equal non-empty form of any length counts as 1.

    docs has doc_id, form (see similarity.forms), label, split, and norm or its length
    chars; vectors are those of the forms. Columns: test_form, train_form, similarity,
    match_kind, and of both sides the form's length and text (if docs has norm), the
    documents by label (t0, t1, t_n; r0, r1, r_n) and the train form's smallest
    document with its label. Copies are counted, never paired.
    """
    text = ["norm"] if "norm" in docs.columns else []
    test, train = F.col("split") == "test", F.col("split") == "train"
    one = lambda side, k: F.count_if(side & (F.col("label") == k))
    g = docs.groupBy("form").agg(
        *[F.first(c).alias(c) for c in text], F.first(chars(docs)).cast("long").alias("chars"), F.count_if(test).alias("t_n"), one(test, 0).alias("t0"), one(test, 1).alias("t1"), F.count_if(train).alias("r_n"), one(train, 0).alias("r0"), one(train, 1).alias("r1"),
        F.min(F.when(train, F.struct("doc_id", "label"))).alias("least_train"),
    )
    g = materialize(g, "forms")
    long = F.col("chars") >= min_chars
    ids = lambda side: g.where(long & (F.col(side) > 0)).select(F.col("form").alias("doc_id"))
    fuzzy = similar_pairs(vectors, threshold, ids("t_n"), ids("r_n")).select(F.col("a").alias("test_form"), F.col("b").alias("train_form"), "similarity", F.lit("fuzzy").alias("match_kind"))
    same = g.where("chars > 0 AND t_n > 0 AND r_n > 0").select(F.col("form").alias("test_form"), F.col("form").alias("train_form"), F.lit(1.0).alias("similarity"), F.lit("normalized_exact").alias("match_kind"))
    own = lambda side: [F.col("form").alias(f"{side}_form"), F.col("chars").alias(f"{side}_chars"), *[F.col(c).alias(f"{side}_{c}") for c in text]]
    t, r = g.select(*own("test"), "t_n", "t0", "t1"), g.select(*own("train"), "r_n", "r0", "r1", "least_train")
    return fuzzy.unionByName(same).join(t, "test_form").join(r, "train_form")


def leakage_pairs(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """form_pairs() spelled out as pairs of documents, most similar first, then by test and train id.

    Columns: test_id, train_id, similarity, match_kind, both labels and lengths,
    same_label, length_ratio, and token_jaccard if the pairs have texts.
    """
    of = lambda side: docs.where(F.col("split") == side).select(F.col("form").alias(f"{side}_form"), F.col("doc_id").alias(f"{side}_id"), F.col("label").alias(f"{side}_label"))
    jaccard = [token_jaccard(F.col("test_norm"), F.col("train_norm")).alias("token_jaccard")] if "test_norm" in pairs.columns else []
    p = pairs.select(
        "test_form", "train_form", "similarity", "match_kind", F.col("test_chars").alias("test_norm_chars"), F.col("train_chars").alias("train_norm_chars"),
        ratio(F.col("test_chars"), F.col("train_chars")).alias("length_ratio"), *jaccard,
    )
    j = p.join(of("test"), "test_form").join(of("train"), "train_form").drop("test_form", "train_form")
    return j.withColumn("same_label", F.coalesce(F.col("test_label") == F.col("train_label"), F.lit(False))).orderBy(F.desc("similarity"), "test_id", "train_id")


def nearest_train(docs: DataFrame, pairs: DataFrame, best: DataFrame | None = None, min_chars: int = fixed.MIN_CHARS) -> DataFrame:
    """One row a test document: best similarity and train row, kind, labels, eligibility.

    An equal normal form comes first (similarity 1, smallest train id), then the most
    similar form at or over the pairs' threshold, then (if best, see nearest_forms, is
    given) the most similar one at any similarity; else the kind is 'none'.
    """
    kind = F.when(F.col("match_kind") == "normalized_exact", "normalized_exact").otherwise("fuzzy_nearest")
    got = pairs.select("test_form", F.struct("similarity", F.col("least_train.doc_id").alias("train_id"), kind.alias("kind"), F.col("least_train.label").alias("train_label")).alias("n"))
    if best is not None:
        got = got.unionByName(best.select("test_form", F.struct("similarity", "train_id", F.lit("fuzzy_nearest").alias("kind"), "train_label").alias("n")))
    got = got.groupBy("test_form").agg(F.min_by("n", F.struct(F.when(F.col("n.kind") == "normalized_exact", 0).otherwise(1), -F.round("n.similarity", 9), "n.train_id")).alias("n"))
    t = docs.where("split = 'test'").select("doc_id", "form", "label", (chars(docs) >= min_chars).alias("fuzzy_eligible"))
    j = t.join(got, F.col("form") == F.col("test_form"), "left")
    return j.select("doc_id", "label", "fuzzy_eligible", F.col("n.similarity").alias("max_train_similarity"), F.col("n.train_id").alias("nearest_train_id"), F.coalesce("n.kind", F.lit("none")).alias("nearest_kind"), F.coalesce(F.col("label") == F.col("n.train_label"), F.lit(False)).alias("same_label_as_nearest"))


def nearest_forms(docs: DataFrame, vectors: Vectors, pairs: DataFrame, min_chars: int = fixed.MIN_CHARS) -> DataFrame:
    """(test_form, train_id, train_label, similarity): the nearest train document at any similarity, of each eligible test form without a pair.

    The test rows that are left are a stated query set, compared with all train
    vectors in blocks.
    """
    long = eligible(docs, min_chars)
    train = long.where("split = 'train'").groupBy(F.col("form").alias("b")).agg(F.min(F.struct("doc_id", "label")).alias("least"))
    left = long.where("split = 'test'").select("form").distinct().join(pairs.select(F.col("test_form").alias("form")).distinct(), "form", "left_anti")
    got = best_match(vectors.only(left, "form"), vectors.only(train, "b"))
    return got.join(train, "b").select(F.col("a").alias("test_form"), F.col("least.doc_id").alias("train_id"), F.col("least.label").alias("train_label"), "similarity")


def leakage_summary(docs: DataFrame, near: DataFrame, pairs: DataFrame, thresholds=fixed.THRESHOLDS) -> DataFrame:
    """One row a threshold with the leakage counts and rates; rates of nothing are null. pairs are form_pairs()."""
    if not all(0 < t <= 1 for t in thresholds):
        raise ValueError(f"thresholds {thresholds}, wanted values over 0 and up to 1")
    thr = F.explode(F.array(*[F.lit(float(t)) for t in sorted(set(thresholds))])).alias("threshold")
    leaked = F.coalesce(F.col("max_train_similarity") >= F.col("threshold") - fixed.TOLERANCE, F.lit(False))
    n = near.select("*", thr).withColumn("leaked", leaked)
    same, is1, is0 = F.col("same_label_as_nearest"), F.col("label") == 1, F.col("label") == 0
    s = n.groupBy("threshold").agg(
        F.count("*").alias("n_test"), F.count_if("fuzzy_eligible").alias("n_test_fuzzy_eligible"), F.count_if(~F.col("fuzzy_eligible")).alias("n_test_short_fuzzy_excluded"),
        F.count_if("leaked").alias("test_rows_with_train_near_duplicate"), F.count_if(is1).alias("positive_test_rows"), F.count_if(is1 & F.col("leaked")).alias("positive_test_rows_leaked"),
        F.count_if(is0).alias("negative_test_rows"), F.count_if(is0 & F.col("leaked")).alias("negative_test_rows_leaked"),
        F.count_if(F.col("leaked") & same).alias("leaked_test_rows_same_label_nearest"), F.count_if(F.col("leaked") & ~same).alias("leaked_test_rows_cross_label_nearest"),
    )
    all_, agree = F.col("t_n") * F.col("r_n"), F.col("t0") * F.col("r0") + F.col("t1") * F.col("r1")
    p = pairs.select("*", thr).where(F.col("similarity") >= F.col("threshold") - fixed.TOLERANCE).groupBy(F.col("threshold").alias("pt"))
    p = p.agg(F.sum(all_).alias("cross_split_pairs"), F.sum(all_ - agree).alias("cross_label_pair_count"), F.sum(F.when(F.col("match_kind") == "normalized_exact", all_).otherwise(0)).alias("normalized_exact_pair_count"))
    train = docs.where("split = 'train'").agg(F.count("*").alias("n_train"))
    j = s.join(p, F.col("threshold") == F.col("pt"), "left").drop("pt").join(train)  # train: one row
    for c in ("cross_split_pairs", "cross_label_pair_count", "normalized_exact_pair_count"):
        j = j.withColumn(c, F.coalesce(c, F.lit(0)))
    rate = lambda a, b: F.try_divide(a, b)
    return j.withColumns({"test_leakage_rate": rate("test_rows_with_train_near_duplicate", "n_test"), "positive_test_leakage_rate": rate("positive_test_rows_leaked", "positive_test_rows"), "negative_test_leakage_rate": rate("negative_test_rows_leaked", "negative_test_rows")})


def link_counts(docs: DataFrame, pairs: DataFrame, min_chars: int = fixed.MIN_CHARS) -> DataFrame:
    """(doc_id, class_id, n_links): each eligible document's normal form and how many other documents are linked with it.

    docs has doc_id, form, and norm or chars; pairs are similar_pairs() of the forms.
    """
    d = eligible(docs, min_chars)
    copies = d.groupBy("form").agg(F.count("*").alias("copies"))
    linked = both_ways(pairs).join(copies.toDF("b", "c"), "b").groupBy(F.col("a").alias("f")).agg(F.sum("c").alias("others"))
    per = copies.join(linked, F.col("form") == F.col("f"), "left").select(F.col("form").alias("class_id"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return d.join(per, F.col("form") == F.col("class_id")).select("doc_id", "class_id", "n_links")


def canonical(first: DataFrame, second: DataFrame, tests: list[DataFrame]) -> DataFrame:
    """One row a document of first whose text second has too: both ids, hashes, lengths and frozen-test flags.

    first has doc_id, text, clean and norm; second has doc_id and text, and of equal
    texts the last id counts; tests are the test ids (doc_id) of both sides.
    """
    key = sha256(F.col("text"))
    other = second.groupBy(key.alias("k2")).agg(F.max("doc_id").alias("second_id"))
    j = first.select(F.col("doc_id").alias("first_id"), key.alias("text_sha256"), (F.trim(F.coalesce("clean", F.lit(""))) != "").alias("clean_nonempty"), F.length("norm").cast("long").alias("norm_chars"), sha256(F.col("norm")).alias("norm_sha256"))
    j = j.join(other, F.col("text_sha256") == F.col("k2")).drop("k2")
    for col, name, ids in zip(("first_id", "second_id"), ("in_first_test", "in_second_test"), tests, strict=True):
        t = ids.select(F.col("doc_id").alias("t")).distinct().withColumn(name, F.lit(True))
        j = j.join(t, F.col(col) == F.col("t"), "left").drop("t").withColumn(name, F.coalesce(name, F.lit(False)))
    return j


def star_edges(docs: DataFrame, norm: str = "norm", doc_id: str = "doc_id") -> DataFrame:
    """(a, b, similarity 1): each group of equal normal forms as a star around its smallest id."""
    f = docs.where("chars > 0") if {"form", "chars"} <= {*docs.columns} else forms(docs.where(F.col(norm) != ""), doc_id, norm)
    return f.where("form < doc_id").select(F.col("form").alias("a"), F.col("doc_id").alias("b"), F.lit(1.0).alias("similarity"))


def merge_edges(edges: DataFrame) -> DataFrame:
    """Undirected edges, once each, with the largest similarity."""
    return edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("similarity").alias("similarity"))


def cluster_edges(docs: DataFrame, vectors: Vectors, threshold: float = min(fixed.THRESHOLDS), neighbours: int = fixed.NEIGHBOURS, min_chars: int = fixed.MIN_CHARS) -> DataFrame:
    """Star edges of exact copies and each eligible normal form's nearest other forms at or over threshold; vectors are those of the forms."""
    near = nearest(both_ways(similar_pairs(vectors.only(eligible(docs, min_chars)), threshold)), neighbours).select("a", "b", "similarity")
    return merge_edges(star_edges(docs).unionByName(near))


def clusters(edges: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """(threshold, cluster_id, doc_id, label): components at threshold, numbered from 1 by smallest id."""
    comp = connected_components(edges.where(F.col("similarity") >= threshold - fixed.TOLERANCE))
    number = comp.select("component").distinct()
    number = number.withColumn("cluster_id", F.row_number().over(Window.orderBy("component")).cast("long"))  # a row a cluster
    j = comp.join(number.withColumnRenamed("component", "c"), F.col("component") == F.col("c"))
    d = docs.select("doc_id", "label")
    return j.join(d, F.col("node") == F.col("doc_id")).select(F.lit(threshold).alias("threshold"), "cluster_id", "doc_id", "label")


def cluster_summary(members: DataFrame) -> DataFrame:
    g = members.groupBy("threshold", "cluster_id").agg(F.count("*").alias("cluster_size"), F.count_if(F.col("label") == 0).alias("label_0"), F.count_if(F.col("label") == 1).alias("label_1"), F.min("doc_id").alias("min_doc_id"))
    return g.withColumn("label_pure", ((F.col("label_0") == 0) | (F.col("label_1") == 0)).cast("int"))


def complete_link(n: int, sims: dict[tuple[int, int], float], threshold: float) -> list[list[int]]:
    """Complete-link groups of items 0..n-1 cut at threshold; missing pairs are 0. Merges the closest groups first, ties to the lowest.

    Only pairs at or over the threshold are held, as two groups without one for each
    of their pairs never merge: memory and time follow the pairs given.
    """
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), v in sims.items():
        if v >= threshold - 1e-10:
            near[i][j] = near[j][i] = v
    heap = [(-v, i, j) for i, row in enumerate(near) for j, v in row.items() if i < j]
    heapq.heapify(heap)
    groups = {i: [i] for i in range(n)}
    while heap:
        v, i, j = heapq.heappop(heap)
        if i not in groups or j not in groups or near[i].get(j) != -v:
            continue
        groups[i] += groups.pop(j)
        for k in near[j]:
            near[k].pop(j, None)
        both = {k: min(s, near[j][k]) for k, s in near[i].items() if k != j and k in near[j]}
        for k in near[i].keys() - both.keys():
            near[k].pop(i, None)
        near[i], near[j] = both, {}
        for k, s in both.items():
            near[k][i] = s
            heapq.heappush(heap, (-s, min(i, k), max(i, k)))
    return sorted(sorted(g) for g in groups.values())


def families(docs: DataFrame, pairs: DataFrame, threshold: float = fixed.FAMILY_THRESHOLD) -> DataFrame:
    """(member, form, family): every pair of a family reaches threshold; family is its smallest member; two members or more.

    docs has doc_id and form; pairs: all pairs (a, b, similarity) of forms at or over
    threshold. Copies of one form have similarity 1 and are one point.
    """
    e = pairs.where(F.col("similarity") >= threshold - fixed.TOLERANCE).select("a", "b", "similarity")
    comp = connected_components(e)
    grouped = e.join(comp, F.col("a") == F.col("node")).select("component", "a", "b", "similarity")

    def refine(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted({*pdf["a"], *pdf["b"]})
        at = {v: i for i, v in enumerate(ids)}
        sims = {(at[a], at[b]): s for a, b, s in zip(pdf["a"], pdf["b"], pdf["similarity"], strict=True)}
        return pd.DataFrame([(ids[i], ids[g[0]]) for g in complete_link(len(ids), sims, threshold) for i in g], columns=["form", "family"])

    fam = grouped.groupBy("component").applyInPandas(refine, "form long, family long").withColumnRenamed("form", "f2")
    m = docs.select("doc_id", "form").join(fam, F.col("form") == F.col("f2"), "left").select(F.col("doc_id").alias("member"), "form", F.coalesce("family", "form").alias("family"))
    many = m.groupBy(F.col("family").alias("k")).agg(F.count("*").alias("size")).where("size > 1").select("k")
    return m.join(many, F.col("family") == F.col("k"), "left_semi")


def family_pairs(fam: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of forms within families: family, a, b, similarity, and n, how many pairs of members they stand for (a = b: copies, similarity 1)."""
    f = fam.groupBy("family", "form").agg(F.count("*").alias("copies"))
    p = pairs.select("a", "b", "similarity")
    x, y = f.toDF("family", "a", "ca"), f.toDF("f2", "b", "cb")
    inner = p.join(x, "a").join(y, "b").where("family = f2").select("family", "a", "b", "similarity", (F.col("ca") * F.col("cb")).alias("n"))
    own = f.where("copies > 1").select("family", F.col("form").alias("a"), F.col("form").alias("b"), F.lit(1.0).alias("similarity"), (F.col("copies") * (F.col("copies") - 1) / 2).cast("long").alias("n"))
    return inner.unionByName(own)


def link_check(fam: DataFrame, inner: DataFrame, threshold: float = fixed.FAMILY_THRESHOLD) -> DataFrame:
    """One row: pairs of members that families have, those that inner lacks or has under threshold, and ok."""
    size = fam.groupBy("family").agg(F.count("*").alias("s"))
    want = size.agg(F.coalesce(F.sum(F.col("s") * (F.col("s") - 1) / 2), F.lit(0)).cast("long").alias("n_pairs"))
    got = inner.agg(F.coalesce(F.sum(F.when(F.col("similarity") >= threshold - 1e-6, F.col("n")).otherwise(0)), F.lit(0)).alias("n_fine"))
    return want.join(got).select("n_pairs", (F.col("n_pairs") - F.col("n_fine")).alias("n_below"), (F.col("n_pairs") == F.col("n_fine")).alias("ok"))  # one row each


def medoids(fam: DataFrame, inner: DataFrame, docs: DataFrame, usable: Column) -> DataFrame:
    """One row a family: representative (a usable member first, then the largest mean similarity counting itself, then the lowest id), size, pair statistics."""
    f = fam.groupBy(F.col("family").alias("k"), F.col("form").alias("m")).agg(F.count("*").alias("copies"))
    two = inner.where("a <> b")
    each = two.select(F.col("a").alias("m1"), F.col("b").alias("o"), "similarity").unionByName(two.select(F.col("b").alias("m1"), F.col("a").alias("o"), "similarity"))
    each = each.join(f.select(F.col("m").alias("o"), F.col("copies").alias("co")), "o").groupBy("m1").agg(F.sum(F.col("similarity") * F.col("co")).alias("s"))
    size = fam.groupBy(F.col("family").alias("sf")).agg(F.count("*").alias("family_size"), F.min("member").alias("min_member"))
    j = fam.join(f, F.col("form") == F.col("m")).join(each, F.col("form") == F.col("m1"), "left").join(size, F.col("family") == F.col("sf")).join(docs.select(F.col("doc_id").alias("d"), usable.alias("usable")), F.col("member") == F.col("d"))
    mean = (F.coalesce("s", F.lit(0.0)) + F.col("copies")) / F.col("family_size")
    rep = j.groupBy(F.col("family").alias("f")).agg(F.min_by("member", F.struct((~F.col("usable")).alias("u"), -F.round(mean, 9), "member")).alias("representative"))
    stats = inner.groupBy("family").agg(F.min("similarity").alias("min_pair_similarity"), (F.sum(F.col("similarity") * F.col("n")) / F.sum("n")).alias("mean_pair_similarity"), F.max("similarity").alias("max_pair_similarity"))
    out = stats.join(rep, F.col("family") == F.col("f")).join(size, F.col("family") == F.col("sf"))
    number = F.row_number().over(Window.orderBy("family"))  # a row a family
    return out.select(F.concat(F.lit("F"), F.lpad(number.cast("string"), 4, "0")).alias("family_id"), "family", "family_size", "representative", "min_pair_similarity", "mean_pair_similarity", "max_pair_similarity")


def retained(docs: DataFrame, fam: DataFrame, reps: DataFrame) -> DataFrame:
    """docs with family_size (1 outside families) and retained: all but the non-representative members."""
    n = fam.groupBy(F.col("family").alias("k")).agg(F.count("*").alias("family_size"))
    size = fam.join(n, F.col("family") == F.col("k")).select(F.col("member").alias("fm"), "family_size")
    r = reps.select(F.col("representative").alias("rr"), F.lit(True).alias("is_rep"))
    j = docs.join(size, F.col("doc_id") == F.col("fm"), "left").join(r, F.col("doc_id") == F.col("rr"), "left")
    return j.withColumns({"retained": F.col("fm").isNull() | F.coalesce("is_rep", F.lit(False)), "family_size": F.coalesce("family_size", F.lit(1)).cast("long")}).drop("fm", "rr", "is_rep")
