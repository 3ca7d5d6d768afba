"""Benchmark decontamination by suffix arrays of the training text.

Words are what ASCII case folding leaves of runs of digits, letters and
non-ASCII bytes. Benchmark items are cut into windows of 13 words (a shorter
item is one window) and written, in blocks of bounded size, to the shared
folder. One pass over the documents then treats each slice of a batch as a shard: it
sorts a suffix array of the shard's word positions, binary-searches every test
suffix in it, and extends equal windows to verbatim matches. A position can
only start a window if as many words of the benchmark's vocabulary follow it as
the shortest window has, so other positions are left out of the array; no match
is lost by that. Documents are never shuffled, and of the benchmark a worker
holds blocks of HELD bytes, or one at a time if they are larger.

Defined results: a null or wordless text has no words and no hits; a null item
text has no windows; repeated item rows count once for each item id; a null
item id is ignored; an empty benchmark leaves everything uncontaminated.
"""

from __future__ import annotations

import hashlib
import os
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.session import table, work_dir
from .common import add_columns, in_task, local_path, texts_of

WINDOW = 13
BLOCK_WORDS = 500_000
HELD = 64_000_000
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

MATCHES = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("item_start", T.LongType()), T.StructField("n_words", T.LongType())]))
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("item_ids", T.ArrayType(T.LongType())),
    T.StructField("longest", T.LongType()),
    T.StructField("matches", MATCHES),
]


def words(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def _rows(ids: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """The window words from each position as fixed byte strings that sort word by word; nothing after a 0."""
    m = np.lib.stride_tricks.sliding_window_view(np.concatenate([ids, np.zeros(window, np.uint32)]), window)[at]
    live = np.cumprod(m != 0, axis=1).astype(np.uint32)
    return np.ascontiguousarray((m * live).astype(">u4")).view(f"S{4 * window}").ravel()


def _build(items: list[tuple[int, list[bytes]]], window: int) -> dict:
    """A block: vocabulary, distinct windows sorted, and who has them where."""
    vocab = {w: i + 1 for i, w in enumerate(sorted({w for _, ws in items for w in ws}))}
    seen: dict[bytes, tuple[int, dict[int, int]]] = {}
    for item, ws in items:
        ids = np.fromiter((vocab[w] for w in ws), np.uint32, len(ws))
        n = min(window, len(ws))
        for off, key in enumerate(_rows(ids, np.arange(len(ws) - n + 1), window)):
            seen.setdefault(bytes(key), (n, {}))[1].setdefault(item, off)
    keys = sorted(seen)
    lens = np.array([seen[k][0] for k in keys], np.int64)
    lo = np.array(keys, f"S{4 * window}") if keys else np.zeros(0, f"S{4 * window}")
    hi = np.array([k.ljust(4 * window, b"\0")[: 4 * n] + b"\xff" * (4 * (window - n)) for k, n in zip(keys, lens, strict=True)], f"S{4 * window}") if keys else lo
    owners = [list(seen[k][1].items()) for k in keys]
    return {
        "vocab": vocab, "lo": lo, "hi": hi, "len": lens, "least": int(lens.min()) if keys else 0,
        "own": np.cumsum([0, *map(len, owners)]), "item": np.array([i for o in owners for i, _ in o], np.int64), "off": np.array([p for o in owners for _, p in o], np.int64),
    }


def write_blocks(items: DataFrame, item_id: str, text: str, window: int, block_words: int) -> tuple[str, list[str]]:
    """The benchmark's blocks in the shared folder, and their names (one for each block_words words or partition)."""
    folder = work_dir(items.sparkSession, "benchmark")
    path = local_path(folder)

    def run(batches):
        held, n, part = [], 0, 0

        def put():
            nonlocal held, n, part
            blob = pickle.dumps(_build(held, window))
            name = f"{hashlib.sha256(blob).hexdigest()}.block"
            os.makedirs(path, exist_ok=True)
            tmp = f"{path}/.{name}-{os.getpid()}"
            with open(tmp, "wb") as f:
                f.write(blob)
            os.replace(tmp, f"{path}/{name}")
            held, n, part = [], 0, part + 1
            return pa.RecordBatch.from_arrays([pa.array([name])], names=["block"])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), texts_of(batch, "text"), strict=True):
                ws = words(t)
                if i is not None and ws:
                    held.append((i, ws))
                    n += len(ws)
                    if n >= block_words:
                        yield put()
        if held:
            yield put()

    got = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).mapInArrow(in_task(run), "block string").distinct()
    return path, sorted(r[0] for r in got.collect())


class _Shard:
    """One batch of documents as a suffix array, against one block."""

    def __init__(self, docs: list[list[bytes]], block: dict, window: int):
        get = block["vocab"].get
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        self.base = np.cumsum(np.r_[0, sizes + 1])
        ids = np.zeros(int(self.base[-1]) + 1, np.uint32)
        for b, ws in zip(self.base, docs, strict=False):
            ids[b : b + len(ws)] = np.fromiter((get(w, 0) for w in ws), np.uint32, len(ws))
        # how many vocabulary words follow each position
        stop = np.flatnonzero(ids == 0)
        run = stop[np.searchsorted(stop, np.arange(len(ids)))] - np.arange(len(ids))
        at = np.flatnonzero(run >= max(1, block["least"]))
        keys = _rows(ids, at, window)
        order = np.argsort(keys, kind="stable")
        self.at, keys = at[order], keys[order]
        self.lo, self.hi = np.searchsorted(keys, block["lo"], "left"), np.searchsorted(keys, block["hi"], "right")

    def occurrences(self) -> tuple[np.ndarray, np.ndarray]:
        """(window number, position) of every occurrence."""
        n = np.maximum(self.hi - self.lo, 0)
        w = np.repeat(np.arange(len(n)), n)
        pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.lo, n)
        return w, self.at[pos]


def _matches(block: dict, w: np.ndarray, pos: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Maximal verbatim matches as rows (doc, item, position, item position, words)."""
    n = block["own"][w + 1] - block["own"][w]
    own = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(block["own"][w], n)
    item, off, p, d, ln = block["item"][own], block["off"][own], np.repeat(pos, n), np.repeat(doc, n), np.repeat(block["len"][w], n)
    o = np.lexsort((p, p - off, item, d))
    item, off, p, d, ln = item[o], off[o], p[o], d[o], ln[o]
    new = np.r_[True, (d[1:] != d[:-1]) | (item[1:] != item[:-1]) | (p[1:] - off[1:] != p[:-1] - off[:-1]) | (p[1:] != p[:-1] + 1)] if len(p) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(p)] - 1 if len(first) else first
    return np.stack([d[first], item[first], p[first], off[first], p[last] + ln[last] - p[first]], 1) if len(first) else np.zeros((0, 5), np.int64)


def find_contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, keep: list[str] | None = None) -> DataFrame:
    """Rows of docs with n_words, n_hit, item_ids, longest and matches (see FIELDS).

    A word is hit if it lies in any occurrence of a window; matches are the
    maximal verbatim matches (positions count words from 0; of a window that
    recurs within an item the first place in the item counts), longest is the
    longest of them in words.
    """
    path, names = write_blocks(items, item_id, item_text, window, block_words)

    def make():
        cache: dict[str, dict] = {}
        held = 0

        def block_of(name: str) -> dict:
            nonlocal held
            if name not in cache:
                with open(f"{path}/{name}", "rb") as f:
                    raw = f.read()
                if held + len(raw) > HELD:
                    cache.clear()
                    held = 0
                cache[name] = pickle.loads(raw)
                held += len(raw)
            return cache[name]

        def fn(batch):
            out = [[], [], [], [], []]
            texts = texts_of(batch, text)
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size < 8_000_000):
                    size += len(texts[j] or b"")
                    j += 1
                for o, v in zip(out, one(texts[i:j]), strict=True):
                    o.extend(v)
                i = j
            return out

        def one(texts):
            docs = [words(t) for t in texts]
            n = len(docs)
            cover, items, found = None, [set() for _ in docs], [[] for _ in docs]
            for name in names:
                block = block_of(name)
                shard = _Shard(docs, block, window)
                if cover is None:
                    base = shard.base
                    cover = np.zeros(int(base[-1]) + 2, np.int64)
                w, pos = shard.occurrences()
                if len(w):
                    np.add.at(cover, pos, 1)
                    np.add.at(cover, pos + block["len"][w], -1)
                    for d, it, p, off, ln in _matches(block, w, pos, np.searchsorted(base, pos, "right") - 1).tolist():
                        items[d].add(it)
                        found[d].append((it, p - int(base[d]), off, ln))
            if cover is None:
                hit = [0] * n
            else:
                total = np.concatenate([[0], np.cumsum(np.cumsum(cover) > 0)])
                hit = (total[base[1:]] - total[base[:-1]]).tolist()
            return (
                [len(d) for d in docs], hit, [sorted(s) for s in items], [max((m[3] for m in f), default=0) for f in found],
                [[{"item_id": a, "start": b, "item_start": c, "n_words": e} for a, b, c, e in sorted(f)] for f in found],
            )

        return fn

    return add_columns(docs, FIELDS, make, keep)


def is_contaminated() -> F.Column:
    """At least one word in twenty is hit."""
    return (F.col("n_hit") > 0) & (F.lit(20) * F.col("n_hit") >= F.col("n_words"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of find_contamination over documents and benchmark."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = find_contamination(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return got.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))), ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
           FROM (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
     b AS (SELECT DISTINCT item_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
           FROM (SELECT item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM benchmark)),
     win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
             FROM b, unnest(range(1, greatest(0, len(w) - least(13, len(w)) + 1) + 1)) AS t(i) WHERE len(w) > 0),
     sizes AS (SELECT DISTINCT n FROM win),
     g AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, sizes, unnest(range(1, greatest(0, len(w) - n + 1) + 1)) AS t(i)),
     h AS (SELECT DISTINCT doc_id, n, i, item_id FROM g JOIN win USING (n, g)),
     hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
     its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""
