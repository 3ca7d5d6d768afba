"""The pipeline operators against brute force, exact round trips and hard inputs."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import bpe, common, decontam, embdedup, langid, licenses, lmscore, simhash, suffixdedup, tokenbin, urlfilter

HARD = [(1, None), (2, ""), (3, "  \n"), (4, "a" * 3000), (5, "the mit license and the MIT Licence, apache license 2.0"), (5, "the mit license and the MIT Licence, apache license 2.0"), (6, "é ß 日本語 😀"), (None, "no id here but quite a long text that has words in it, yes"), (7, "word " * 5000)]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame([(i, t, "en", 1, "n") for i, t in HARD], "doc_id long, text string, lang string, score int, fp string").repartition(3)


def test_every_operator_takes_hard_rows(spark, hard):
    items = spark.createDataFrame([(1, "the mit license"), (1, "the mit license"), (2, None), (None, "x")], "item_id long, text string")
    path = bpe.default_path("word_bpe_49k.json")
    model = langid.train(hard)
    lm = lmscore.train(hard)
    for df in (hard, hard.limit(0)):
        n = df.count()
        assert licenses.scan(df).count() == n
        assert simhash.near_duplicates(df).count() == n
        assert langid.identify(df, model).count() == n
        assert lmscore.score(df, lm).count() == n
        assert bpe.digest(df, path).count() == n
        assert decontam.find_contamination(df, items).count() == n
        assert suffixdedup.remove_repeats(df).count() == n
        assert tokenbin.read_corpus(tokenbin.write_corpus(df, bpe.default_path("byte_bpe_50k.json"), 2)).count() == n
    assert langid.train(hard.limit(0))["langs"] == [] and lmscore.train(hard.limit(0))["words"] == 0
    assert langid.identify(hard, langid.train(hard.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_license_places(spark, hard):
    r = {x["doc_id"]: x for x in licenses.scan(hard).collect()}
    assert (r[5]["n_words"], r[5]["n_base"], r[5]["first_word"], r[5]["last_word"], r[5]["base_labels"]) == (11, 2, 1, 7, "apache,mit")
    assert r[5]["labels"] == "apache,apache-2.0,mit" and r[1]["n_words"] == 0 and r[1]["first_word"] is None
    assert len(licenses.RULES) > 300


def test_simhash_is_the_definition(spark):
    t = "One two three four five two three four."
    ws = t.lower().encode().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + 3]), 42) for i in range(len(ws) - 2)]
    want = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))
    assert simhash.fingerprint(t.encode()) & (2**64 - 1) == want
    assert simhash.fingerprint(None) == 0


@pytest.mark.parametrize("radius", [1, 2])
def test_ball_links_equal_all_pairs(spark, radius):
    r = random.Random(5)
    fps = [r.getrandbits(64) for _ in range(30)]
    for _ in range(60):
        f = r.choice(fps)
        for _ in range(r.randint(1, 3)):
            f ^= 1 << r.randrange(64)
        fps.append(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in set(fps)]
    from corpusloom.operators.graph import connected_components

    def comps(edges):
        return {x[0]: x[1] for x in connected_components(edges).collect()}

    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    m = 2**64 - 1
    pairs = [(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & m).count("1") <= radius]
    assert comps(simhash.links(df, "fp", radius)) == comps(spark.createDataFrame(pairs, "a long, b long"))


def test_token_files(spark, hard, tmp_path):
    from tokenizers import Tokenizer

    path = bpe.default_path("byte_bpe_50k.json")
    files = tokenbin.write_corpus(hard, path, 2, files=3)
    rows = sorted(tokenbin.read_corpus(files).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in rows] == np.cumsum([0, *[r["n_tokens"] for r in rows]])[:-1].tolist()
    tok = Tokenizer.from_file(path)
    listing = files.collect()
    for i, t in HARD:
        if i is None:
            continue
        want = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        got = [x.tolist() for f in listing for x in tokenbin.TokenFile(f["path"]).read(i)]
        assert want in got
    with open(listing[0]["path"], "r+b") as f:
        f.seek(12)
        b = f.read(1)
        f.seek(12)
        f.write(bytes([b[0] ^ 255]))
    with pytest.raises(Exception):
        [tokenbin.TokenFile(listing[0]["path"]).ids_at(k) for k in range(len(tokenbin.TokenFile(listing[0]["path"])))]


def test_encoders_equal_the_library():
    from tokenizers import Tokenizer

    word, ref = bpe.word_tokenizer(bpe.default_path("word_bpe_49k.json")), Tokenizer.from_file(bpe.default_path("word_bpe_49k.json"))
    byte, ref2 = tokenbin.byte_tokenizer(bpe.default_path("byte_bpe_50k.json")), Tokenizer.from_file(bpe.default_path("byte_bpe_50k.json"))
    r = random.Random(1)
    cases = [t for _, t in HARD if t] + ["İstanbul ΣΑΣ ΟΔΟΣ", "don't I'LL 12 ½", "abc" * 900, "<|endoftext|> x<|startoftext|>", "a\n\nb \n c  d\t\te ", " lead", "x\n y", "café́"]
    cases += ["".join(r.choice("aabcdeth inoé'.,!\n 12Σ") for _ in range(r.randint(0, 40))) for _ in range(300)]
    for t in cases:
        ids = word.encode(t)
        assert ids.tolist() == ref.encode(t, add_special_tokens=False).ids
        assert word.decode(ids).decode() == ref.decode(ids.tolist(), skip_special_tokens=False)
        assert np.frombuffer(byte.encode(t), "<u4").tolist() == ref2.encode(t, add_special_tokens=False).ids


def brute_repeats(docs):
    first = {}
    for i, t in docs:
        for k in range(len(t) - 49) if i is not None else ():
            first[t[k : k + 50]] = min(i, first.get(t[k : k + 50], i))
    out = []
    for i, t in docs:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 49) if i is not None else ():
            if first[t[k : k + 50]] < i:
                gone[k : k + 50] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [50_000, 3])
def test_repeats_equal_brute_force(spark, hot):
    r = random.Random(3)
    base = ["".join(r.choice("ab é") for _ in range(300)) for _ in range(5)]
    docs = []
    for _ in range(70):
        t = "".join(b[a : a + r.randint(20, 250)] + "".join(r.choice("abcdef") for _ in range(r.randint(0, 20))) for b, a in ((r.choice(base), r.randint(0, 250)) for _ in range(r.randint(0, 4))))
        docs.append((r.randint(0, 60) if r.random() < 0.9 else None, None if r.random() < 0.05 else "a" * r.randint(0, 200) if r.random() < 0.1 else t))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = suffixdedup.remove_repeats(df, hot_group=hot).collect()
    got = sorted(((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], hashlib.sha256(x["kept"]).hexdigest()) for x in got), key=str)
    assert got == brute_repeats([(i, (t or "").encode()) for i, t in docs])


def test_repeats_with_nul_runs_equal_brute_force(spark):
    r = random.Random(4)
    nul = "".join(r.choice("abc") for _ in range(30)) + "\0" * 30 + "".join(r.choice("abc") for _ in range(30))
    docs = [(i, "".join(r.choice("xyz") for _ in range(i)) + nul[a:b] + "\0" * (i % 3)) for i, (a, b) in enumerate([(0, 90), (0, 90), (10, 80), (5, 60), (30, 90), (0, 70)])]
    docs += [(10, "\0" * 60), (11, "\0" * 100), (12, "p" * 20 + "\0" * 49), (13, "\0" * 49 + "q" * 20)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = suffixdedup.remove_repeats(df).collect()
    got = sorted(((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], hashlib.sha256(x["kept"]).hexdigest()) for x in got), key=str)
    assert got == brute_repeats([(i, t.encode()) for i, t in docs])


def test_multikey_sort_is_lexicographic():
    rows = np.random.default_rng(0).integers(0, 3, (500, 20)).astype(np.uint8)
    o = suffixdedup.multikey_sort(suffixdedup._words(rows))
    assert [bytes(rows[i]) for i in o] == sorted(bytes(x) for x in rows)


def test_decontamination_blocks_agree(spark):
    r = random.Random(2)
    ws = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(r.choice(ws) for _ in range(r.choice([1, 5, 20, 40])))) for i in range(20)]
    docs = [(i, " ".join(r.choice([*ws, "zz"]) for _ in range(80)) + " " + r.choice(items)[1]) for i in range(30)]
    d, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted((x["doc_id"], x["n_hit"], tuple(x["item_ids"])) for x in decontam.find_contamination(d, it, block_words=b).collect()) for b in (10**6, 30))
    assert one == many
    for doc, hit, ids in one:
        w = docs[doc][1].split()
        cover, found = set(), set()
        for i, t in items:
            q = t.split()
            n = min(13, len(q))
            for a in range(len(q) - n + 1):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == q[a : a + n]:
                        cover.update(range(p, p + n))
                        found.add(i)
        assert (hit, set(ids)) == (len(cover), found)


def test_language_accuracy_and_ties(spark):
    r = random.Random(4)
    words = {"xx": ["alpha", "beta", "gamma"], "yy": ["omega", "sigma", "tau"]}
    docs = [(i, " ".join(r.choice(words[k]) for _ in range(12)), k) for i in range(200) for k in (["xx", "yy"][i % 2],)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = langid.identify(df.select("*", langid.held_out().alias("h")), langid.train(df)).where("h").collect()
    assert got and all(x["lang_pred"] == x["lang"] for x in got)
    odd = spark.createDataFrame([(1, "123 !!"), (2, None), (3, "omegas"), (4, "½ ² ①"), (5, "ª")], "doc_id long, text string")
    got = [x["lang_pred"] for x in langid.identify(odd, langid.train(df)).orderBy("doc_id").collect()]
    assert got[:4] == ["und", "und", "yy", "und"] and got[4] != "und"


def plain_kneser_ney(texts):
    """An interpolated modified Kneser-Ney pair model in dictionaries: prob(before, word)."""
    words, pairs = Counter(), Counter()
    for t in texts:
        ws = [*t.lower().split(), "\n"]
        words.update(ws)
        pairs.update(zip([None, *ws[:-1]], ws, strict=True))

    def loss(counts):
        n = [sum(c == k for c in counts) for k in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else 0.5
        out = [0.0]
        for k in (1, 2, 3):
            a, b = n[k], n[k + 1]
            out.append(min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) if a and b else (0.5, 1.0, 1.4)[k - 1])
        return out

    cont = Counter(w for _, w in pairs)
    d1, d2, v = loss(cont.values()), loss(pairs.values()), len(words)
    rest = sum(d1[min(c, 3)] for c in cont.values()) / len(pairs)

    def prob(before, w):
        low = max(cont[w] - d1[min(cont[w], 3)], 0) / len(pairs) + rest / (v + 1)
        after = {x: c for (b, x), c in pairs.items() if b == before}
        if not after:
            return low
        total, c = sum(after.values()), after.get(w, 0)
        return max(c - d2[min(c, 3)], 0) / total + sum(d2[min(x, 3)] for x in after.values()) / total * low

    return prob, words


def test_kneser_ney_equals_a_plain_model_and_sums_to_one(spark):
    r = random.Random(9)
    texts = [" ".join(r.choice("a b c d e f g".split()[: 1 + i % 7]) for _ in range(r.randint(0, 12))) for i in range(25)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    m = lmscore.train(df)
    prob, words = plain_kneser_ney(texts)
    assert m["tokens"] == sum(words.values()) and m["words"] == len(words)
    for before in [None, *words, "unseen"]:
        assert abs(sum(prob(before, w) for w in [*words, "unseen"]) - 1) < 1e-12
    probes = [*texts, "a unseen b", "G A unseen unseen c", ""]
    got = lmscore.score(spark.createDataFrame(list(enumerate(probes)), "doc_id long, text string"), m).collect()
    n, v = sum(words.values()), len(words)
    for x in got:
        ws = [*probes[x["doc_id"]].lower().split(), "\n"]
        assert x["score"] == pytest.approx(sum(math.log10(prob(b, w)) for b, w in zip([None, *ws[:-1]], ws, strict=True)))
        assert x["base_score"] == pytest.approx(sum(math.log10((words[w] + 1) / (n + v + 1)) for w in ws))
        assert (x["n_tokens"], x["n_known"]) == (len(ws), sum(w in words for w in ws))


def test_language_scores_equal_a_plain_version(spark):
    r = random.Random(6)
    alphabets = {"xx": "abcde", "yy": "cdefg", "zz": "éßabc"}
    word = lambda a: "".join(r.choice(a) for _ in range(r.randint(1, 6)))
    docs = [(i, " ".join(word(alphabets[k]) for _ in range(r.randint(1, 9))), k) for i in range(60) for k in (["xx", "yy", "zz"][i % 3],)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    langs, seen = sorted(alphabets), {}
    for i, t, k in docs:
        if zlib.crc32(str(i).encode()) % 5:
            for w in t.split():
                seen.setdefault(0, {}).setdefault(w, Counter())[k] += 1
                for o in langid.ORDERS:
                    for g in langid.grams(w, o):
                        seen.setdefault(o, {}).setdefault(g, Counter())[k] += 1
    total = {o: {k: sum(c[k] for c in items.values()) + 0.1 * len(items) for k in langs} for o, items in seen.items()}
    logs = lambda o, x: [math.log((seen[o][x][k] + 0.1) / total[o][k]) for k in langs]

    def row(w):
        if w in seen[0]:
            return logs(0, w)
        for o in langid.ORDERS:
            known = [logs(o, g) for g in langid.grams(w, o) if g in seen[o]]
            if known:
                return [sum(x) / len(known) for x in zip(*known, strict=True)]
        return [0.0] * len(langs)

    probes = [(i, " ".join(word("abcdefgéßq") for _ in range(r.randint(1, 8)))) for i in range(80)]
    got = langid.identify(spark.createDataFrame(probes, "doc_id long, text string"), langid.train(df)).collect()
    for x in got:
        sums = [sum(c) for c in zip(*map(row, x["text"].split()), strict=True)]
        best = max(sums)
        assert x["score"] == pytest.approx(1 / sum(math.exp(s - best) for s in sums))
        assert x["lang_pred"] == langs[sums.index(best)] or x["score"] < 0.51
    few = langid.Scorer(langid.train(df), limit=10)
    assert few.predict([t for _, t in probes])[0] == [x["lang_pred"] for x in sorted(got, key=lambda x: x["doc_id"])]


def slow_scan(text):
    """The license scan in plain loops: labels, score, and the base columns."""
    ws = re.findall(licenses.WORD, (text or "").translate({c: c + 32 for c in range(65, 91)}))
    places, base = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(ws) - len(p) + 1) if ws[i : i + len(p)] == p]
        places += found
        base |= {label} if found else set()
    line = re.sub(" licence(?= )", " license", " " + " ".join(ws) + " ")
    hits = []
    for i, rule in enumerate(licenses.RULES):
        if set(rule["keys"]) <= set(ws):
            hits += [(m.start(), m.end(), rule["level"], i, rule["label"], rule["weight"]) for m in re.finditer(rule["rx"], line)]
    order = sorted(hits, key=lambda h: (h[0], -h[1], -h[2], h[3]))
    kept = [h for k, h in enumerate(order) if not any(o[0] <= h[0] and o[1] >= h[1] and o[2] >= h[2] for o in order[:k])]
    return len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | {h[4] for h in kept})), max((h[5] for h in kept), default=0.0)


def test_license_scan_equals_a_slow_matcher(spark):
    r = random.Random(12)
    parts = ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "Redistribution and use in source and binary forms, with or without modification, are permitted", "GPLv3", "the GNU General Public License, version 2", "SPDX-License-Identifier: Apache-2.0", "MIT licence", "CC BY-SA 4.0", "licensed under the terms of the Mozilla Public License 2.0", "gnu lesser general public license", "all rights reserved", "www.apache.org/licenses/LICENSE-2.0", "cc by cc by", "plain words here", "apache license mit license", "é ß"]
    rows = [(i, None if i == 0 else r.choice([" ", ", ", ". "]).join(r.choice(parts) for _ in range(r.randint(0, 7)))) for i in range(150)]
    got = {x["doc_id"]: tuple(x)[2:] for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).drop("detections").collect()}
    for i, t in rows:
        assert got[i] == slow_scan(t), t
    one = lambda t: slow_scan(t)[5]
    assert (one(parts[0]), one(parts[1]), one("under GPLv3 now")) == ("mit", "bsd", "gpl-3.0")


def test_groups_of_fingerprints_equal_all_pairs(spark):
    r = random.Random(8)
    base = [[f"w{r.randrange(50)}" for _ in range(40)] for _ in range(10)]
    rows = []
    for _ in range(80):
        ws = list(r.choice(base))
        if r.random() < 0.5:
            ws[r.randrange(40)] = "x"
        rows.append((r.choice([None, *range(40)]), None if r.random() < 0.1 else " ".join(ws)))
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    fps = sorted({simhash.fingerprint(t.encode() if t else None) for _, t in rows})
    comp = {f: f for f in fps}
    for a in fps:
        for b in fps:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2 and comp[a] != comp[b]:
                old, new = comp[a], comp[b]
                comp = {f: new if c == old else c for f, c in comp.items()}
    least = {}
    for i, t in rows:
        if i is not None:
            c = comp[simhash.fingerprint(t.encode() if t else None)]
            least[c] = min(i, least.get(c, i))
    want = [(i, simhash.fingerprint(t.encode() if t else None)) for i, t in rows]
    assert sorted((str(x["doc_id"]), x["fp"], str(x["component_id"])) for x in got) == sorted((str(i), f, str(least.get(comp[f]))) for i, f in want)


def test_similar_groups_find_pairs_as_computed(spark):
    r = random.Random(10)
    rows, pairs = [], []
    for k in range(120):
        ws = [f"v{r.randrange(9000)}" for _ in range(r.randint(60, 300))]
        other = list(ws)
        for _ in range(max(1, len(ws) // 90)):
            other[r.randrange(len(ws))] = "changed"
        a, b = simhash.shingle_set(" ".join(ws).encode()), simhash.shingle_set(" ".join(other).encode())
        pairs.append(simhash.jaccard(a, b))
        rows += [(2 * k, " ".join(ws)), (2 * k + 1, " ".join(other))]
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    found = [got[2 * k + 1] == 2 * k for k in range(120)]
    assert not any(f for f, s in zip(found, pairs, strict=True) if s < 0.8)
    assert sum(f for f, s in zip(found, pairs, strict=True) if s >= 0.8) >= 0.96 * sum(s >= 0.8 for s in pairs) > 50


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 16))
    x = np.concatenate([x, x[:20] + 0.05 * rng.standard_normal((20, 16)), x[:5], np.repeat(x[:1], 30, 0) + 0.02 * rng.standard_normal((30, 16))]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    n = len(rows)
    rows += [(n, None), (n + 1, [0.0] * 16), (n + 2, [float("nan")] * 16), (n + 3, []), (None, x[0].tolist())]
    got = {r["vec_id"]: r for r in embdedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block=8).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    sim = u @ u.T >= 0.9
    np.fill_diagonal(sim, False)
    want, have = sim.sum(1), np.array([got[i]["n_links"] for i in range(n)])
    assert (have <= want).all() and have.sum() >= 0.97 * want.sum()
    assert all(got[n + k]["n_links"] == 0 and got[n + k]["kept"] for k in range(4))
    assert not got[None]["kept"]


@pytest.mark.parametrize("dim", [64, 768])
@pytest.mark.parametrize("common", [0.0, 1.5])
def test_embedding_recall_just_above_the_threshold(spark, dim, common):
    rng = np.random.default_rng(1)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(unit(rng.standard_normal((400, dim))) + common * unit(rng.standard_normal(dim)))
    side = rng.standard_normal((400, dim))
    side = unit(side - (side * x).sum(1, keepdims=True) * x)
    cos = rng.uniform(0.901, 0.92, (400, 1))
    v = np.concatenate([x, cos * x + np.sqrt(1 - cos**2) * side])
    sim = v @ v.T >= 0.9
    np.fill_diagonal(sim, False)
    df = spark.createDataFrame([(i, a) for i, a in enumerate(v.tolist())], "vec_id long, embedding array<double>").repartition(3)
    got = {r["vec_id"]: r["n_links"] for r in embdedup.near_duplicates(df).collect()}
    have = np.array([got[i] for i in range(len(v))])
    assert (have <= sim.sum(1)).all() and have.sum() >= 0.9 * sim.sum()


def test_url_rules_equal_plain_python(spark):
    r = random.Random(3)
    hosts = ["com", "Example.COM", "a.example.com", "net", "b.example.net", "xexample.net", "org", "c.org", "", "h.de"]
    urls = [None, "no host", "://", "a://b://example.com/en/7"]
    urls += ["http://" + r.choice(hosts) + r.choice(["", "/", "/en/", "/en/7", "/en/70", "/de/8", "/de/", "/es/x", "/EN/7", "/en?x=/de/", "#/es/", "/de/8/9?q#f"]) for _ in range(300)]
    got = urlfilter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)).collect()
    assert len(got) == len(urls)
    for x in got:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", urls[x["page_id"]] or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        best = None
        for kind, rule in urlfilter.RULES:
            h, _, p = rule.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
                best = (kind, rule)
        assert (x["host"], x["path"], x["rule"]) == (host, path, best and best[1])
        assert best is None or x["verdict"] == best[0]


def test_callers_columns_keep_their_values(spark):
    odd = ["shape", "ruled", "rejected", "th", "ts", "__w", "__k", "_", "kept_0", "a.b"]
    rows = [(i, "the mit license", f"http://a.net/de/{i}", [1.0, float(i)], *[f"{c}{i}" for c in odd]) for i in range(6)]
    df = spark.createDataFrame(rows, ["page_id", "text", "url", "embedding", *odd]).repartition(2)
    for out in (urlfilter.filter_urls(df), licenses.scan(df.drop("a.b"))):
        for x in out.collect():
            assert all(x[c] == f"{c}{x['page_id']}" for c in odd if c in out.columns)
    assert {"shape", "ruled"} <= set(urlfilter.filter_urls(df).columns)
    path = bpe.default_path("word_bpe_49k.json")
    items = spark.createDataFrame([(1, "the mit license")], "item_id long, text string")
    d = df.drop("a.b").withColumnRenamed("page_id", "doc_id")
    for out in (bpe.digest(d, path), decontam.find_contamination(d, items), langid.identify(d, {"langs": []}), suffixdedup.remove_repeats(d)):
        assert all(x["shape"] == f"shape{x['doc_id']}" for x in out.collect())
    assert embdedup.near_duplicates(df.withColumnRenamed("page_id", "vec_id").drop("a.b")).count() == 6


def test_hard_pages_and_vectors(spark):
    urls = [(1, None), (1, None), (2, "http://a.net/" + "x" * 5000), (2, "http://a.net/" + "x" * 5000), (None, "http://a.net/" + "/" * 300), (3, "http://a.net//" + "%20" * 900)]
    df = spark.createDataFrame(urls, "page_id long, url string")
    assert urlfilter.filter_urls(df).count() == 6 and urlfilter.filter_urls(df.limit(0)).count() == 0
    vecs = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [-1.0, 0.5]), (2, [2.0, 4.0]), (3, [1.0, None]), (4, None), (None, [1.0, 2.0]), (5, [0.0, -0.0]), (6, [1.0, 2.0, 0.0])]
    v = spark.createDataFrame(vecs, "vec_id long, embedding array<float>")
    got = sorted((str(x["vec_id"]), x["n_links"], str(x["component_id"])) for x in embdedup.near_duplicates(v).collect())
    assert got == sorted([("1", 2, "1"), ("1", 2, "1"), ("1", 0, "1"), ("2", 2, "1"), ("3", 0, "3"), ("4", 0, "4"), ("None", 0, "None"), ("5", 0, "5"), ("6", 0, "6")])
    assert embdedup.near_duplicates(v.limit(0)).count() == 0


def test_encoders_equal_the_library_on_the_documents(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r[0]: r[1] or "" for r in docs.collect()}
    word, byte = (Tokenizer.from_file(bpe.default_path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    for x in bpe.digest(docs, bpe.default_path("word_bpe_49k.json")).collect():
        ids = word.encode(texts[x["doc_id"]], add_special_tokens=False).ids
        assert x["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert x["decoded_sha256"] == hashlib.sha256(word.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    start = 0
    for x in sorted(tokenbin.read_corpus(tokenbin.write_corpus(docs, bpe.default_path("byte_bpe_50k.json"), 2, files=3)).collect(), key=lambda x: x["doc_id"]):
        ids = [*byte.encode(texts[x["doc_id"]], add_special_tokens=False).ids, 2]
        assert (x["start"], x["n_tokens"], x["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_url_rules_and_templates(spark):
    urls = [(i, f"http://a.example.net/de/{i}") for i in range(40)] + [(100, "https://A.example.net/de/80?x"), (101, "http://example.com/en/7x#y"), (102, "com/en/1"), (103, None), (104, "http://b.com/en/"), (105, "http://a.example.net/fr/5")]
    r = {x["page_id"]: x for x in urlfilter.filter_urls(spark.createDataFrame(urls, "page_id long, url string")).collect()}
    assert (r[1]["host"], r[1]["path"], r[1]["rule"], r[1]["verdict"]) == ("a.example.net", "/de/1", "net/de/", "block")
    assert r[100]["rule"] == "example.net/de/8" and r[101]["rule"] == "example.com/en/7" and r[101]["verdict"] == "allow"
    assert (r[102]["host"], r[102]["path"], r[102]["rule"], r[102]["verdict"]) == ("", "", None, "allow")
    assert r[103]["verdict"] == "allow" and r[104]["rule"] == "com/en/" and r[105]["verdict"] == "allow"


def test_url_templates_below_eight_segments(spark):
    top = "/a/b/c/d/e/f/g/h/i"
    urls = [(i, f"http://h.com{top}/{'bad' if i % 2 else 'good'}/{i}") for i in range(40)] + [(100, f"http://h.com{top}/bad/sub/7")]
    rules = [("block", f"h.com{top}/bad/{d}") for d in range(1, 10)] + [("allow", f"h.com{top}/good/{d}") for d in range(1, 10)]
    df = spark.createDataFrame([*urls, (101, f"http://h.com{top}/bad/0"), (102, f"http://h.com{top}/good/00")], "page_id long, url string")
    r = {x["page_id"]: x for x in urlfilter.filter_urls(df, rules=rules).collect()}
    assert (r[1]["template"], r[2]["template"], r[100]["template"]) == (f"{top}/bad/{{n}}", f"{top}/good/{{n}}", f"{top}/bad/sub/{{n}}")
    assert (r[101]["rule"], r[101]["verdict"], r[102]["rule"], r[102]["verdict"]) == (None, "block", None, "allow")


def test_store_roundtrip(tmp_path):
    keys = np.unique(np.random.default_rng(0).integers(0, 2**60, 5000)).astype(np.uint64)
    k, c = common.unpack_sorted(common.pack_sorted(keys, np.arange(len(keys))))
    assert (k == keys).all() and (c == np.arange(len(keys))).all()
    for s, pack in common.pack_shards(keys, None, 8):
        common.write_shard(str(tmp_path), s, {"key": common.unpack_sorted(pack)[0]})
    store = common.Store(str(tmp_path), 8, {})
    assert store.find(keys)[0].all() and not store.find(keys + np.uint64(1))[0].all()
    assert not [f for f in os.listdir(tmp_path) if f.startswith(".")]


def test_pipeline_drops_near_copies_with_edits(spark):
    import corpus_pipeline

    r = random.Random(7)
    rows = []
    for _ in range(25):
        ws = [f"w{r.randrange(4000)}" for _ in range(r.randint(40, 400))]
        rows.append(ws)
        for _ in range(r.randint(0, 4)):  # copies of copies, from equal to too far
            ws = list(ws)
            for _ in range(r.randint(0, len(ws) // 30)):
                ws[r.randrange(len(ws))] = f"x{r.randrange(4000)}"
            rows.append(ws)
    r.shuffle(rows)
    sets = [{tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} for ws in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                comp = [min(comp[i], comp[j]) if c in (comp[i], comp[j]) else c for c in comp]
    want = [i for i, c in enumerate(comp) if i == c]
    docs = spark.createDataFrame([(i, " ".join(ws), len(ws)) for i, ws in enumerate(rows)], "doc_id long, text string, n long").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(x["doc_id"] for x in got.select("doc_id").collect()) == want and 25 <= len(want) < len(rows)


def test_pipeline_on_hard_rows(spark, tmp_path):
    import corpus_pipeline

    d = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "extra") for i, t in HARD], "doc_id long, text string, lang string, source string, n_chars long, stays string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "the mit license and the mit licence apache license 2 0")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == d.columns
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((x["doc_id"] or 0) for x in out.select("doc_id").collect()) == [0, 4, 6, 7]
    assert out.where(F.size("ids") != F.col("n_tokens")).count() == 0


def test_pipeline_on_empty_and_unlabelled_tables(spark, tmp_path):
    import corpus_pipeline
    from corpusloom.plans.session import local_path, shared_dir

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, "the mit license")], "item_id long, text string").write.parquet(f"{tmp_path}/a/benchmark.parquet")
    spark.createDataFrame([(1, "some words without a label", None, "s", 26), (2, "other words here", None, "s", 16)], schema).write.parquet(f"{tmp_path}/a/documents.parquet")
    assert sorted(x["doc_id"] for x in corpus_pipeline.run(spark, f"{tmp_path}/a").collect()) == [1, 2]
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/b/benchmark.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/b/documents.parquet")
    before = set(os.listdir(local_path(shared_dir(spark))))
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
    assert [x.split("-")[:2] for x in set(os.listdir(local_path(shared_dir(spark)))) - before] == [["stage", "tokens"]]
