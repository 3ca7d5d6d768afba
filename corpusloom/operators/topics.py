"""Dictionary filtering, topic models, their selection and their reports."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import topic_tokens
from ..plans.session import materialize


def cleaned(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, tokens): topic tokens kept, in order."""
    t = topic_tokens(F.col(text))
    return docs.select(F.col(doc_id).alias("doc_id"), F.transform(F.filter(t, lambda x: x["reason"] == "kept"), lambda x: x["token"]).alias("tokens"))


def cleanup_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Tokens by reason."""
    return docs.select(F.explode(topic_tokens(F.col(text))).alias("t")).groupBy(F.col("t.reason").alias("reason")).agg(F.count("*").alias("n"))


def dictionary(toks: DataFrame, no_below: int = fixed.NO_BELOW, no_above: float = fixed.NO_ABOVE) -> DataFrame:
    """(term, df, share, action): kept terms are in no_below documents or more, and in at most no_above of them."""
    n = toks.where(F.size("tokens") > 0).agg(F.count("*").alias("n_docs"))
    df = toks.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    d = df.join(n).withColumn("share", F.col("df") / F.col("n_docs"))  # one row
    return d.select("term", "df", "share", F.when(F.col("df") < no_below, "remove_low_df").when(F.col("share") > no_above, "remove_high_df").otherwise("keep").alias("action"))


def dictionary_audit(toks: DataFrame, no_below: int = fixed.NO_BELOW, no_above: float = fixed.NO_ABOVE) -> DataFrame:
    """dictionary(), most frequent terms first, then by term."""
    return dictionary(toks, no_below, no_above).orderBy(F.desc("df"), "term")


def bags(toks: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, term, n) over kept terms."""
    rows = toks.select("doc_id", F.explode("tokens").alias("t"))
    kept = terms.where("action = 'keep'").select("term")
    return rows.join(kept, F.col("t") == F.col("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


def corpus_flow(docs: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """(position, stage, documents): documents that meet all conditions so far, in one pass."""
    cond, cols = F.lit(True), []
    for i, (name, c) in enumerate(stages):
        cond = cond & F.coalesce(c, F.lit(False))
        cols.append(F.struct(F.lit(i + 1).alias("position"), F.lit(name).alias("stage"), F.count_if(cond).alias("documents")))
    return docs.agg(F.array(*cols).alias("a")).select(F.inline("a"))


def fit_lda(toks: DataFrame, k: int, seed: int, min_df: int = fixed.NO_BELOW, max_iter: int = 20, max_share: float = fixed.NO_ABOVE):
    """(pipeline model, document topics): online LDA with a learned document prior.

    Terms are those that dictionary() keeps, all of them; documents without any
    are left out. Each of the max_iter steps draws as many documents as there are
    (with replacement, as Spark does). The optimiser is Spark's; the topic prior is
    a scalar there, so figures differ from other implementations.
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizerModel
    from pyspark.ml.functions import vector_to_array

    kept = dictionary(toks, min_df, max_share).where("action = 'keep'").select("term", "df").collect()
    if not kept:
        raise ValueError("the dictionary keeps no term")
    words = CountVectorizerModel.from_vocabulary([r["term"] for r in sorted(kept, key=lambda r: (-r["df"], r["term"]))], inputCol="tokens", outputCol="bag")
    counts = materialize(words.transform(toks).where(F.size(F.unwrap_udt("bag")["indices"]) > 0).select("doc_id", "bag"), "lda-bags")
    model = LDA(k=k, seed=seed, maxIter=max_iter, optimizer="online", subsamplingRate=1.0, optimizeDocConcentration=True, featuresCol="bag", topicDistributionCol="p").fit(counts)
    return PipelineModel([words, model]), model.transform(counts).select("doc_id", vector_to_array("p").alias("p"))


def topic_terms(model, top: int = fixed.TOP_TERMS) -> DataFrame:
    """(topic_id, rank, term, probability) of a fit_lda model."""
    vocab = model.stages[0].vocabulary
    t = model.stages[1].describeTopics(top)
    t = t.select((F.col("topic") + 1).alias("topic_id"), F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("r", "x"))
    spark = t.sparkSession
    names = spark.createDataFrame(list(enumerate(vocab)), "i int, term string")  # the kept vocabulary, which the model holds on the driver as it is
    t = t.select("topic_id", (F.col("r") + 1).alias("rank"), F.col("x.termIndices").alias("i"), F.col("x.termWeights").alias("probability"))
    return t.join(names, "i").select("topic_id", "rank", "term", "probability")


def ranked_terms(weights: DataFrame, top: int = fixed.TOP_TERMS) -> DataFrame:
    """The top terms of each topic from (topic_id, term, probability); ties by term."""
    w = Window.partitionBy("topic_id").orderBy(F.desc("probability"), "term")
    return weights.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def term_lists(terms: DataFrame) -> DataFrame:
    """(topic_id, terms): terms in rank order, comma-joined."""
    g = terms.groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("a"))
    return g.select("topic_id", F.array_join(F.transform("a", lambda x: x["term"]), ", ").alias("terms"))


def diversity(terms: DataFrame, top: int = fixed.DIVERSITY_TERMS) -> DataFrame:
    """Distinct terms over all terms among each topic's first."""
    return terms.where(F.col("rank") <= top).agg((F.count_distinct("term") / F.count("term")).alias("topic_diversity"))


def document_topics(probs: DataFrame) -> DataFrame:
    """Adds dominant topic (from 1, first on ties), its probability, margin of the two best and normalised entropy."""
    k = F.size("p")
    s = F.sort_array("p", asc=False)
    ent = F.aggregate("p", F.lit(0.0), lambda a, x: a - x * F.log(x + 1e-12))
    return probs.withColumns(
        {
            "dominant_topic": F.array_position("p", F.array_max("p")).cast("int"),
            "dominant_probability": F.array_max("p"),
            "margin": F.when(k > 1, s[0] - F.get(s, F.lit(1))).otherwise(1.0),
            "normalized_entropy": F.try_divide(ent, F.log(k.cast("double"))),
        }
    )


def prevalence(dt: DataFrame, k: int, weight: str | None = None) -> DataFrame:
    """(topic_id, mean_topic_probability, dominant_document_count, dominant_document_share, weighted_mean), all topics."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    long = dt.select(F.posexplode("p").alias("i", "x"), "dominant_topic", w.alias("w"))
    g = long.groupBy((F.col("i") + 1).alias("topic_id")).agg(F.avg("x").alias("mean_topic_probability"), F.count_if(F.col("dominant_topic") == F.col("i") + 1).alias("dominant_document_count"), F.avg((F.col("dominant_topic") == F.col("i") + 1).cast("double")).alias("dominant_document_share"), (F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("weighted_mean"))
    ids = dt.sparkSession.range(1, k + 1).select(F.col("id").cast("int").alias("t"))
    return ids.join(g, F.col("t") == F.col("topic_id"), "left").select(F.col("t").alias("topic_id"), *[F.coalesce(c, F.lit(0)).alias(c) for c in g.columns[1:]])


def diagnostics(prev: DataFrame) -> DataFrame:
    """One row: largest dominant share, topics never dominant, effective number of topics."""
    m = F.col("mean_topic_probability")
    return prev.agg(F.max("dominant_document_share").alias("max_dominant_share"), F.count_if(F.col("dominant_document_count") == 0).alias("zero_dominant_topics"), F.exp(-F.sum(m * F.log(m + 1e-12))).alias("effective_topics"), F.max(m).alias("max_mean_topic_probability"))


def quality_gate(diag: DataFrame, limit: float = fixed.MAX_DOMINANT_SHARE) -> DataFrame:
    return diag.withColumn("quality_gate_pass", (F.col("max_dominant_share") <= limit) & (F.col("zero_dominant_topics") == 0))


def representatives(dt: DataFrame, top: int = fixed.REPRESENTATIVES) -> DataFrame:
    """Each topic's documents of highest probability; ties by id."""
    long = dt.select("doc_id", F.posexplode("p").alias("i", "probability"))
    w = Window.partitionBy("i").orderBy(F.desc("probability"), "doc_id")
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select((F.col("i") + 1).alias("topic_id"), "rank", "doc_id", "probability")


def ambiguous(dt: DataFrame, top: int = fixed.AMBIGUOUS) -> DataFrame:
    return dt.orderBy(F.desc("normalized_entropy"), "margin", "doc_id").limit(top)


def run_summary(runs: DataFrame) -> DataFrame:
    """One row a k over (k, seed, coherence_cv, topic_diversity, log_perplexity)."""
    g = runs.groupBy("k").agg(F.count("*").alias("n_seeds"), *[f(c).alias(f"{n}_{s}") for c, n in (("coherence_cv", "coherence"), ("topic_diversity", "diversity"), ("log_perplexity", "log_perplexity")) for f, s in ((F.avg, "mean"), (F.stddev_samp, "sd"))])
    return g.withColumn("coherence_se", F.col("coherence_sd") / F.sqrt("n_seeds"))


def seed_pairs(runs: DataFrame) -> DataFrame:
    """(k, seed_a, seed_b), seed_a < seed_b."""
    a, b = runs.select("k", F.col("seed").alias("seed_a")), runs.select(F.col("k").alias("k2"), F.col("seed").alias("seed_b"))
    return a.join(b, (F.col("k") == F.col("k2")) & (F.col("seed_a") < F.col("seed_b"))).select("k", "seed_a", "seed_b")


def seed_stability(pairs: DataFrame) -> DataFrame:
    """(k, seed, mean_similarity) to the other seeds."""
    both = pairs.select("k", F.col("seed_a").alias("seed"), "similarity").unionByName(pairs.select("k", F.col("seed_b").alias("seed"), "similarity"))
    return both.groupBy("k", "seed").agg(F.avg("similarity").alias("mean_similarity"))


def k_stability(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("k").agg(F.avg("similarity").alias("stability_mean"), F.stddev_samp("similarity").alias("stability_sd"), F.min("similarity").alias("stability_min"))


def select_k(runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: k within one standard error of the best coherence (first k on ties) with the best stability, then diversity, then the smallest; and its medoid seed."""
    s = run_summary(runs)
    best = s.orderBy(F.desc("coherence_mean"), "k").limit(1).select((F.col("coherence_mean") - F.col("coherence_se")).alias("floor"))
    k = s.join(best).where("coherence_mean >= floor").join(k_stability(pairs).withColumnRenamed("k", "k2"), F.col("k") == F.col("k2"))  # a row a k
    k = k.orderBy(F.desc("stability_mean"), F.desc("diversity_mean"), "k").limit(1).select(F.col("k").alias("selected_k"))
    seeds = runs.join(seed_stability(pairs).toDF("k3", "s3", "mean_similarity"), (F.col("k") == F.col("k3")) & (F.col("seed") == F.col("s3"))).join(k, F.col("k") == F.col("selected_k"))
    return seeds.orderBy(F.desc("mean_similarity"), F.desc("coherence_cv"), "seed").limit(1).select("selected_k", F.col("seed").alias("selected_seed"))


def medoid_seeds(runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(k, medoid_seed) for every k."""
    j = runs.join(seed_stability(pairs).toDF("k3", "s3", "mean_similarity"), (F.col("k") == F.col("k3")) & (F.col("seed") == F.col("s3")))
    w = Window.partitionBy("k").orderBy(F.desc("mean_similarity"), F.desc("coherence_cv"), "seed")
    return j.withColumn("r", F.row_number().over(w)).where("r = 1").select("k", F.col("seed").alias("medoid_seed"))


def assignment(cost: np.ndarray) -> list[int]:
    """Minimum-cost assignment of rows to columns of a square matrix, by shortest augmenting paths."""
    n = len(cost)
    u, v, owner = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        owner[0] = i
        least, back, done, j = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool), 0
        while True:
            done[j] = True
            r = owner[j]
            cur = cost[r - 1] - u[r] - v[1:]
            better = ~done[1:] & (cur < least[1:])
            least[1:][better], back[1:][better] = cur[better], j
            free = np.where(done[1:], np.inf, least[1:])
            k = int(np.argmin(free)) + 1
            step = least[k]
            u[owner[done]] += step
            v[done] -= step
            least[~done] -= step
            j = k
            if owner[j] == 0:
                break
        while j:
            owner[j] = owner[back[j]]
            j = back[j]
    out = [0] * n
    for j in range(1, n + 1):
        out[owner[j] - 1] = j - 1
    return out


def matched_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Mean cosine of topics under their best one-to-one matching."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    sim = unit(a) @ unit(b).T
    return float(np.mean([sim[i, j] for i, j in enumerate(assignment(1 - sim))]))


def coherence(toks: DataFrame, terms: DataFrame, window: int = 110) -> DataFrame:
    """(topic_id, coherence_cv): sliding-window co-occurrence, normalised PMI vectors, cosine with their sum.

    Only windows' counts of the topics' own terms are gathered: a bounded table.
    """
    words = sorted({r[0] for r in terms.select("term").distinct().collect()})
    at = {w: i for i, w in enumerate(words)}
    m = len(words)

    def count(batches):
        one, two, n = np.zeros(m, np.int64), np.zeros((m, m), np.int64), 0
        for pdf in batches:
            for ts in pdf["tokens"]:
                ids = [at.get(t, -1) for t in ts]
                for i in range(max(1, len(ids) - window + 1)):
                    s = np.unique([x for x in ids[i : i + window] if x >= 0]).astype(int)
                    n += 1
                    one[s] += 1
                    two[np.ix_(s, s)] += 1
        i, j = np.nonzero(np.triu(two, 1))
        rows = [(-1, -1, n), *[(int(x), -1, int(one[x])) for x in np.flatnonzero(one)], *[(int(x), int(y), int(two[x, y])) for x, y in zip(i, j, strict=True)]]
        yield pd.DataFrame(rows, columns=["i", "j", "n"])

    got = toks.select("tokens").mapInPandas(count, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    one, two, n = np.zeros(m), np.zeros((m, m)), 1
    for i, j, c in got:
        if i < 0:
            n = max(1, c)
        elif j < 0:
            one[i] = c
        else:
            two[i, j] = two[j, i] = c
    out = []
    by: dict[int, list[int]] = {}
    for t, w in terms.orderBy("topic_id", "rank").select("topic_id", "term").collect():
        by.setdefault(t, []).append(at[w])
    p1, p2 = one / n, two / n
    for t, ws in by.items():
        pij = p2[np.ix_(ws, ws)].copy()
        np.fill_diagonal(pij, p1[ws])
        npmi = np.log((pij + 1e-12) / np.maximum(np.outer(p1[ws], p1[ws]), 1e-300)) / -np.log(pij + 1e-12)
        total = npmi.sum(0)
        cos = [float(v @ total / max(np.linalg.norm(v) * np.linalg.norm(total), 1e-12)) for v in npmi]
        out.append((t, float(np.mean(cos))))
    return toks.sparkSession.createDataFrame(out, "topic_id int, coherence_cv double")


def search(toks: DataFrame, ks: list[int], seeds: list[int], **fit) -> DataFrame:
    """(k, seed, coherence_cv, topic_diversity, log_perplexity) of every run; the vectorised corpus is cached."""
    rows = []
    toks = toks.cache()
    for k in ks:
        for seed in seeds:
            model, _ = fit_lda(toks, k, seed, **fit)
            terms = topic_terms(model, fixed.DIVERSITY_TERMS)
            bag = model.stages[0].transform(toks)
            rows.append((k, seed, coherence(toks, terms).agg(F.avg("coherence_cv")).first()[0], diversity(terms).first()[0], -float(model.stages[1].logPerplexity(bag))))
    toks.unpersist()
    return toks.sparkSession.createDataFrame(rows, "k int, seed int, coherence_cv double, topic_diversity double, log_perplexity double")


def fingerprint(docs: DataFrame, doc_id: str, *cols: str) -> DataFrame:
    """One row: the SHA-256 over the rows' lines in order of id.

    The hash is sequential by definition, so one task reads the sorted lines; it holds
    one batch of them at a time (the sort spills).
    """
    line = F.concat_ws("\t", F.col(doc_id).cast("string"), *cols)

    def run(batches):
        h, any_ = hashlib.sha256(), False
        for batch in batches:
            for l in batch.column(1).to_pylist():
                h.update(("\n" if any_ else "").encode() + l.encode())
                any_ = True
        yield pa.RecordBatch.from_arrays([pa.array([h.hexdigest() if any_ else None], pa.string())], names=["corpus_sha256"])

    return docs.select(F.col(doc_id).alias("i"), line.alias("l")).repartition(1).sortWithinPartitions("i", "l").mapInArrow(run, "corpus_sha256 string").agg(F.max("corpus_sha256").alias("corpus_sha256"))
