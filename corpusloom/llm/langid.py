"""Language identification: words first, then shorter and shorter character n-grams.

The model is counted in Spark over a bounded sample of the labelled rows
(about SAMPLE documents of each language, chosen by a hash of the id) and keeps
every word and every character n-gram of that sample. It is a store in the
shared folder: sorted 64-bit hashes of the items of each kind, and for each item
the languages that have it with their log frequencies. Workers map the files, so
all of them share one copy. A text's known words add their log frequency in each
language. An unseen word backs off to its character n-grams of length 5; if none
is known, to length 4, and so on to single characters; a word without any known
character adds nothing. The prediction sees the text alone.

Defined results: a null text or one without a letter (Unicode category L) is
'und' with score 0; so is everything if nothing was learned; ties go to the
language first in order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.session import table, work_dir
from .common import U64, Store, add_columns, in_task, local_path, shard_of, slices, sum_sorted, write_shard

SAMPLE, ORDERS, FOLDS = 2_000, (5, 4, 3, 2, 1), 5
SHARDS, SMOOTH = 16, 0.1
UNKNOWN = "und"
KEEP_ASCII = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
LETTER = regex.compile(r"\p{L}")


def tokens(text: str) -> list[bytes]:
    """Lower-case runs of ASCII letters and non-ASCII characters, as UTF-8."""
    return text.lower().encode("utf-8", "replace").translate(KEEP_ASCII).split()


def grams(word: str, n: int) -> list[str]:
    w = f" {word} "
    return [w[i : i + n] for i in range(len(w) - n + 1)] if n > 1 else list(word)


def hashed(items: list, kind: int) -> np.ndarray:
    """Keys of words (kind 0) or of n-grams of length kind."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x, kind) for x in items), U64, len(items))


def held_out(doc_id: str = "doc_id", folds: int = FOLDS) -> F.Column:
    """crc32 of the id as text, modulo folds, is 0."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == 0


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> dict:
    """Count the model over a sample of the rows whose id is not held out; returns where it is and its figures."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # a row a language
    langs = sorted(sizes)
    if not langs:
        return {"langs": []}
    at = {k: i for i, k in enumerate(langs)}
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, sample / sizes[k]))])[F.col("lang")]
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0
    where = local_path(work_dir(spark, "languages"))

    def count(batches):
        for batch in (part for whole in batches for part in slices(whole, 3_000_000)):
            by: dict[int, dict[bytes, int]] = {}
            for t, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = by.setdefault(at[k], {})
                for w in tokens(t):
                    c[w] = c.get(w, 0) + 1
            for k, c in by.items():
                n = np.fromiter(c.values(), np.int64, len(c))
                ws = [w.decode("utf-8", "ignore") for w in c]
                for kind in (0, *ORDERS):
                    if kind:
                        parts = [grams(w, kind) for w in ws]
                        keys, counts = sum_sorted(hashed([g for p in parts for g in p], kind), np.repeat(n, [len(p) for p in parts]))
                    else:
                        keys, counts = sum_sorted(hashed(list(c), 0), n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), k, np.int32)), pa.array(counts)], names=["kind", "key", "lang", "n"])

    def write(batches):
        got = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if got is None or not got.num_rows:
            return
        kind, lang_, n = (got.column(c).to_numpy() for c in ("kind", "lang", "n"))
        key, shard = got.column("key").to_numpy().view(U64), got.column("shard").to_numpy()
        for s in np.unique(shard):
            for k in np.unique(kind[shard == s]):
                some = np.flatnonzero((shard == s) & (kind == k))
                some = some[np.lexsort((lang_[some], key[some]))]
                first = np.flatnonzero(np.r_[True, key[some][1:] != key[some][:-1]])
                write_shard(f"{where}/{k}", int(s), {"key": key[some][first], "at": first.astype("<i8"), "langs": np.diff(np.r_[first, len(some)]).astype("<u4")})
                write_shard(f"{where}/{k}-values", int(s), {"lang": lang_[some].astype("<u4"), "n": n[some].astype("<i8")})
                total = np.bincount(lang_[some], n[some], len(langs)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([len(first)], pa.int64()), pa.array([total.tolist()], pa.list_(pa.int64()))], names=["kind", "items", "totals"])

    def place(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard_of(batch.column(1).to_numpy().view(U64), SHARDS))], names=[*batch.schema.names, "shard"])

    counts = rows.where(draw < share).select("text", "lang").mapInArrow(in_task(count), "kind int, key long, lang int, n long").groupBy("kind", "key", "lang").agg(F.sum("n").alias("n"))
    done = counts.mapInArrow(in_task(place), "kind int, key long, lang int, n long, shard int").repartitionById(SHARDS, "shard").mapInArrow(in_task(write), "kind int, items long, totals array<long>").collect()  # a row a shard and kind
    items, totals = [0] * (max(ORDERS) + 1), np.zeros((max(ORDERS) + 1, len(langs)), np.int64)
    for r in done:
        items[r["kind"]] += r["items"]
        totals[r["kind"]] += r["totals"]
    return {"langs": langs, "where": where, "items": items, "totals": totals.tolist()}


class Items:
    """Read side of one kind of items: log frequencies in every language."""

    def __init__(self, model: dict, kind: int):
        tot = np.array(model["totals"][kind], float) + SMOOTH * max(1, model["items"][kind])
        self.scale, self.base, self.kind = np.log(tot), np.log(SMOOTH / tot), kind
        self.index = Store(f"{model['where']}/{kind}", SHARDS, {"at": "<i8", "langs": "<u4"})
        self.values = f"{model['where']}/{kind}-values"
        self.open: dict[int, tuple] = {}

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is known, and a row of log frequencies for each."""
        hit, got = self.index.find(keys)
        out = np.tile(self.base, (len(keys), 1))
        known = np.flatnonzero(hit)
        shard = shard_of(keys[known], SHARDS)
        for s in np.unique(shard):
            if s not in self.open:
                self.open[s] = tuple(np.memmap(f"{self.values}/{s}.{c}", k, "r") for c, k in (("lang", "<u4"), ("n", "<i8")))
            lang, n = self.open[s]
            at = known[shard == s]
            many = got["langs"][at].astype(np.int64)
            from_ = np.repeat(got["at"][at] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            out[np.repeat(at, many), lang[from_]] = np.log(n[from_] + SMOOTH) - self.scale[lang[from_]]
        return hit, out


class Scorer:
    """Log frequencies by word; words once met are remembered, up to a limit."""

    def __init__(self, model: dict, limit: int = 60_000):
        self.langs, self.limit = model["langs"], limit
        self.items = [Items(model, k) for k in range(max(ORDERS) + 1)] if self.langs else []
        self.at: dict[bytes, int] = {}
        self.rows = np.zeros((limit + 1, len(self.langs)))

    def backoff(self, words: list[str]) -> np.ndarray:
        """Rows of unseen words: the mean over a word's known n-grams of the longest length that has any."""
        out, left = np.zeros((len(words), len(self.langs))), np.arange(len(words))
        for o in ORDERS:
            parts = [grams(words[i], o) for i in left]
            of = np.repeat(np.arange(len(left)), [len(p) for p in parts])
            hit, rows = self.items[o].find(hashed([g for p in parts for g in p], o))
            n = np.bincount(of[hit], minlength=len(left))
            total = np.zeros((len(left), len(self.langs)))
            np.add.at(total, of[hit], rows[hit])
            out[left[n > 0]] = total[n > 0] / n[n > 0, None]
            left = left[n == 0]
            if not len(left):
                break
        return out

    def learn(self, new: list[bytes]) -> None:
        """Rows for words not met yet; new holds at most limit words."""
        if len(self.at) + len(new) > self.limit:
            self.at.clear()
        hit, rows = self.items[0].find(hashed(new, 0))
        miss = np.flatnonzero(~hit)
        if len(miss):
            rows[miss] = self.backoff([new[i].decode("utf-8", "ignore") for i in miss])
        start = len(self.at)
        self.rows[start : start + len(new)] = rows
        self.at.update(zip(new, range(start, start + len(new)), strict=True))

    def totals(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Each text's sums over its words, None where it has no letter."""
        out, part = [np.zeros(len(self.langs)) if t and LETTER.search(t) else None for t in texts], self.limit // 2
        held: list[tuple[int, list[bytes]]] = []

        def add():
            some = {w for _, ws in held for w in ws}
            new = [w for w in some if w not in self.at]
            if len(self.at) + len(new) > self.limit:  # forgetting makes all of these words new
                new = list(some)
                self.at.clear()
            if new:
                self.learn(sorted(new))
            for i, ws in held:
                out[i] += self.rows[[self.at[w] for w in ws]].sum(0)
            held.clear()

        n = 0
        for i, t in enumerate(texts):
            ws = tokens(t) if out[i] is not None else []
            for k in range(0, len(ws), part):
                some = ws[k : k + part]
                if n + len(some) > self.limit:
                    add()
                    n = 0
                held.append((i, some))
                n += len(some)
        add()
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        names, scores = [], []
        for total in self.totals(texts):
            best = -1 if total is None else int(np.argmax(total))
            names.append(UNKNOWN if best < 0 else self.langs[best])
            scores.append(0.0 if best < 0 else float(1 / np.exp(np.clip(total - total[best], -700, 0)).sum()))
        return names, scores


def identify(docs: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows of docs with lang_pred and score (the winner's share of the likelihood)."""

    def make():
        scorer = Scorer(model)

        def fn(batch):
            return list(scorer.predict(batch.column(batch.schema.get_field_index(text)).to_pylist()))

        return fn

    return add_columns(docs, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], make, keep)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs)
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model, keep=["doc_id", "held_out"])
