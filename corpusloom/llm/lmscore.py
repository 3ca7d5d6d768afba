"""Scoring by an interpolated modified Kneser-Ney model of word pairs.

Counted in Spark in two passes over the training texts: words, then pairs of
word numbers. Counts travel as sorted, difference-coded packs and are merged
shard by shard into a store (see common): the words' 64-bit hashes, sorted, with
their count, context total, back-off weight and continuation count; and the
pairs, sorted, with their counts. Scoring maps these files and searches them;
no worker or driver loads the model. Discounts follow from counts of counts,
for pairs and for continuation counts; words are interpolated with a uniform
distribution over the vocabulary and one unknown word.

Words are runs of anything but ASCII white space, A-Z folded; every text ends in
an end token and starts from a start context.

Defined results: a null or empty text is its end token alone; no training rows
give every word the unknown word's share; rows with a null id count as id ''.
"""

from __future__ import annotations

import json
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.session import materialize, table, work_dir
from .common import PACKS, KeyCounter, Store, add_columns, in_task, local_path, pack_sorted, slices, sum_sorted, tasks, texts_of, unpack_sorted, write_shard, write_store

U64 = np.uint64
END = xxhash.xxh64_intdigest(b"\n")  # no word holds a line feed
VOCAB = {"count": "<i8", "rank": "<u4"}
TOTAL, N1, N2, N3, CONT, TYPES = range(6)


class Hashes(dict):
    """Words to hashes, remembered up to a limit."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w)
        return h


def token_hashes(texts: list[bytes | None], known: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """All texts' token hashes in a row, and how many each has."""
    parts, sizes = [], []
    for t in texts:
        ws = t.lower().split() if t else []
        parts.append([known[w] for w in ws])
        sizes.append(len(ws) + 1)
    sizes = np.array(sizes, np.int64)
    out = np.zeros(int(sizes.sum()), U64)
    ends = np.cumsum(sizes) - 1
    body = np.ones(len(out), bool)
    body[ends] = False
    out[body] = np.fromiter(chain.from_iterable(parts), U64, int(body.sum()))
    out[ends] = END
    return out, sizes


def runs(texts: list, size: int = 2_000_000):
    """Slices of texts of bounded size."""
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n < size):
            n += len(texts[j] or b"")
            j += 1
        yield i, j
        i = j


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """What counts of 1, 2 and more lose; zero counts of counts give plain values."""
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    d = [0.0]
    for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)):
        d.append(float(np.clip(k - (k + 1) * y * b / a, 0.05, k - 0.05)) if a and b else 0.5 * k if k < 3 else 1.4)
    return d


class Vocabulary:
    """Read side of the words' store."""

    def __init__(self, model: dict, columns: dict[str, str]):
        self.store = Store(model["where"] + "/words", model["shards"], columns)
        self.offsets = np.array(model["offsets"], np.int64)

    def find(self, hashes: np.ndarray):
        from .common import shard_of

        hit, got = self.store.find(hashes)
        return hit, np.where(hit, self.offsets[shard_of(hashes, self.store.shards)] + got["rank"], -1), got


def train(docs: DataFrame, text: str = "text") -> dict:
    """Count the model over all rows; returns where it is and its figures."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text).alias("text"))
    shards = max(16, tasks(texts))
    where = local_path(work_dir(spark, "lm"))
    long = lambda *names: [T.StructField(n, T.LongType()) for n in names]

    def count_words(batches):
        counter, known = KeyCounter(shards), Hashes()
        for whole in batches:
            for batch in slices(whole):
                ts = texts_of(batch, "text")
                for i, j in runs(ts):
                    yield from counter.add(token_hashes(ts[i:j], known)[0])
        yield from counter.flush()

    def keep_words(shard, keys, counts):
        return {"key": keys, "count": counts.astype("<i8"), "rank": np.arange(len(keys), dtype="<u4")}, [[shard], [len(keys)], [int(counts.sum())]]

    sizes = {r[0]: (r[1], r[2]) for r in write_store(texts.mapInArrow(in_task(count_words), PACKS), f"{where}/words", shards, keep_words, long("shard", "words", "tokens")).collect()}
    n = [sizes.get(s, (0, 0))[0] for s in range(shards)]
    offsets = np.cumsum([0, *n]).tolist()
    v = offsets[-1]
    model = {"where": where, "shards": shards, "offsets": offsets, "words": v, "tokens": sum(x[1] for x in sizes.values())}

    def count_pairs(batches):
        counter, known, vocab = KeyCounter(shards), Hashes(), Vocabulary(model, VOCAB)
        for whole in batches:
            for batch in slices(whole):
                ts = texts_of(batch, "text")
                for i, j in runs(ts):
                    hashes, size = token_hashes(ts[i:j], known)
                    ids = vocab.find(hashes)[1]
                    yield from counter.add(pair_keys(ids, size, v))
        yield from counter.flush()

    stats = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("pack", T.BinaryType())])
    bounds = np.array(offsets[1:], np.int64)

    def merge_pairs(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for shard, pack in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(shard, []).append(pack)
        for shard in sorted(held):
            got = [unpack_sorted(p) for p in held.pop(shard)]
            keys, counts = sum_sorted(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]).astype(np.int64))
            del got
            write_shard(f"{where}/pairs", shard, {"key": keys, "count": np.minimum(counts, 2**32 - 1).astype("<u4")})
            left, right = (keys // U64(v + 1)).astype(np.int64), (keys % U64(v + 1)).astype(np.int64)
            one = np.ones(len(keys), np.int64)
            rows = [(TYPES, 0, pack_sorted(np.array([1, 2, 3, 4, 5], U64), np.array([*((counts == k).sum() for k in (1, 2, 3, 4)), len(keys)])))]
            for kind, ids, value in ((TOTAL, left, counts), (N1, left[counts == 1], one[counts == 1]), (N2, left[counts == 2], one[counts == 2]), (N3, left[counts > 2], one[counts > 2]), (CONT, right, one)):
                k, c = sum_sorted(ids.astype(U64), value)
                cut = np.searchsorted(k.astype(np.int64), bounds, "left")  # the words' shards; the start context comes after all
                for p, (a, b) in enumerate(zip([0, *cut], [*cut, len(k)], strict=True)):
                    # counts over 32 bits are split over several packs
                    part_k, part_c = k[a:b], c[a:b]
                    while len(part_k):
                        rows.append((kind, p, pack_sorted(part_k, np.minimum(part_c, 2**31))))
                        part_k, part_c = part_k[part_c > 2**31], (part_c - 2**31)[part_c > 2**31]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["kind", "part", "pack"])

    merged = materialize(texts.mapInArrow(in_task(count_pairs), PACKS).repartitionById(shards, "shard").mapInArrow(in_task(merge_pairs), stats), "lm-stats")
    cc = np.zeros(6, np.int64)  # one small pack a shard
    for (pack,) in merged.where(f"kind = {TYPES}").select("pack").collect():
        cc[1:] += unpack_sorted(pack)[1]
    model["pairs"], model["d2"] = int(cc[5]), discounts(*cc[1:5].tolist())

    def keep_stats(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for kind, part, pack in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(part, []).append((kind, pack))
        for part in sorted(held):
            start, size = (offsets[part], n[part]) if part < shards else (v, 1)
            sums = np.zeros((5, size), np.int64)
            for kind, pack in held.pop(part):
                k, c = unpack_sorted(pack)
                sums[kind, k.astype(np.int64) - start] += c
            gamma = (model["d2"][1] * sums[N1] + model["d2"][2] * sums[N2] + model["d2"][3] * sums[N3]) / np.maximum(sums[TOTAL], 1)
            write_shard(f"{where}/words", part, {"total": sums[TOTAL].astype("<i8"), "gamma": gamma.astype("<f8"), "cont": sums[CONT].astype("<i8")})
            c = sums[CONT] if part < shards else sums[CONT][:0]
            yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in (*((c == k).sum() for k in (1, 2, 3, 4)), (c > 2).sum(), part == shards and sums[TOTAL][0], part == shards and gamma[0] * 1e15)], names=["c1", "c2", "c3", "c4", "c3p", "start_total", "start_gamma"])

    done = merged.where(f"kind <> {TYPES}").repartitionById(shards + 1, "part").mapInArrow(in_task(keep_stats), T.StructType(long("c1", "c2", "c3", "c4", "c3p", "start_total", "start_gamma")))
    got = done.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("c1", "c2", "c3", "c4", "c3p", "start_total", "start_gamma")]).first()
    d = model["d1"] = discounts(got["c1"], got["c2"], got["c3"], got["c4"])
    model["start"] = [got["start_total"], got["start_gamma"] / 1e15]
    # what the discounts on continuation counts leave for the uniform share
    model["rest"] = (d[1] * got["c1"] + d[2] * got["c2"] + d[3] * got["c3p"]) / model["pairs"] if model["pairs"] else 1.0
    return model


def pair_keys(ids: np.ndarray, sizes: np.ndarray, v: int) -> np.ndarray:
    """Keys of all tokens' pairs with what comes before; v is the start context."""
    before = np.r_[v, ids[:-1]]
    before[(np.cumsum(sizes) - sizes)] = v
    return before.astype(U64) * U64(v + 1) + ids.astype(U64)


FIELDS = [T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known")] + [T.StructField(n, T.DoubleType()) for n in ("base_score", "score", "perplexity")]


def score(docs: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows of docs with token counts, the add-one word score, the model's log10 probability, and perplexity."""
    spec = json.dumps(model)

    def make():
        m = json.loads(spec)
        known, v = Hashes(), m["words"]
        vocab = Vocabulary(m, {**VOCAB, "total": "<i8", "gamma": "<f8", "cont": "<i8"})
        pairs = Store(m["where"] + "/pairs", m["shards"], {"count": "<u4"})
        d1, d2 = np.array(m["d1"]), np.array(m["d2"])

        def one(texts):
            hashes, sizes = token_hashes(texts, known)
            hit, ids, got = vocab.find(hashes)
            starts = np.cumsum(sizes) - sizes
            base = np.log10((got["count"] + 1) / (m["tokens"] + v + 1))
            uniform = m["rest"] / (v + 1)
            cont = got["cont"]
            p1 = np.maximum(cont - d1[np.minimum(cont, 3)], 0) / max(1, m["pairs"]) + uniform
            total, gamma, ok = np.r_[0, got["total"][:-1]], np.r_[0.0, got["gamma"][:-1]], np.r_[False, hit[:-1]]
            total[starts], gamma[starts], ok[starts] = m["start"][0], m["start"][1], m["start"][0] > 0
            both = np.flatnonzero(ok & hit)
            count = np.zeros(len(hashes), np.int64)
            if len(both):
                keys = pair_keys(ids, sizes, v)
                count[both] = pairs.find(keys[both])[1]["count"]
            p2 = np.maximum(count - d2[np.minimum(count, 3)], 0) / np.maximum(total, 1)
            p = np.where(ok & (total > 0), p2 + gamma * p1, p1)
            s = np.add.reduceat(np.log10(p), starts)
            return sizes.tolist(), np.add.reduceat(hit.astype(np.int64), starts).tolist(), np.add.reduceat(base, starts).tolist(), s.tolist(), (10 ** np.minimum(-s / sizes, 300)).tolist()

        def fn(batch):
            out = [[] for _ in FIELDS]
            ts = texts_of(batch, text)
            for i, j in runs(ts):
                for o, x in zip(out, one(ts[i:j]), strict=True):
                    o.extend(x)
            return out

        return fn

    return add_columns(docs, FIELDS, make, keep)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo 7, is 2."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on the documents that aren't held out, score all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.where(~held_out()))
    got = score(docs.select("doc_id", held_out().alias("held_out"), "text"), model, keep=["doc_id", "held_out"])
    return got.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")
