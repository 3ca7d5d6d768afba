"""Removal of repeated byte strings by sorted suffixes.

A byte goes if a string of WIDTH bytes over it also starts in a document with a
smaller id. Every such string holds an anchor: the place of its smallest 24-byte
hash. Equal strings hold it at the same offset, so it is enough to compare
suffixes at anchors (one byte in about fourteen).

1. Equal texts are one class; all but the one of the smallest id are repeats
   whole, and only that one goes on.
2. Anchor hashes are counted; those met once can't match and go no further.
3. The contexts of the others (26 bytes before, 50 from the anchor on) are
   range-partitioned by their suffixes' leading bytes with sampled splitters.
   A bucket sorts its suffixes, and its reversed left sides, by multikey
   quicksort over 8-byte words and takes the common prefixes of neighbours;
   strings around an anchor are equal where both common prefixes reach far
   enough. The splitters cut between different leading bytes, so equal strings
   never lie on both sides of a boundary; an anchor with very many contexts is
   the exception, whose strings are dealt out one by one and compared by a
   grouped minimum.
4. The result, a mask of repeated strings for each context, is stored as sorted
   arrays in the shared folder, and one more pass over the texts looks it up and
   removes the bytes. Texts are never shuffled.

Strings are compared byte by byte within a bucket; between passes a context is known
by a 64-bit key and a 32-bit check, so two different contexts of a corpus of n are
taken for one with a chance of n^2 / 2^97 (1e-9 for 10^10).

Defined results: a null text counts as empty; rows with a null id neither remove
nor lose anything; rows with equal ids don't remove from one another; strings are
judged on the input.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.session import materialize, table, work_dir
from .common import PACKS, KeyCounter, Store, add_columns, in_task, local_path, slices, store_rows, tasks, texts_of, write_store

WIDTH, GRAM = 50, 24
LEFT = WIDTH - GRAM  # an anchor lies at offsets 0 to LEFT of a string
CHUNK = 1_500_000  # bytes at a time
HOT_GROUP = 50_000  # contexts of one anchor that a bucket compares at once
U64 = np.uint64
C = [U64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _slide(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over all windows of w."""
    m, s = x, 1
    while 2 * s <= w:
        m = f(m[:-s], m[s:])
        s *= 2
    return f(m[: len(m) - (w - s)], m[w - s :]) if w > s else m


def _grams(buf: bytes) -> np.ndarray:
    """A 64-bit hash of the 24 bytes from each position."""
    n = len(buf)
    w = np.ndarray((n - 7,), "<u8", buf, strides=(1,)).astype(U64)
    h = w[: n - 23] * C[0]
    h ^= (w[8 : n - 15] * C[1]) >> U64(5)
    h += w[16:] * C[2]
    h ^= h >> U64(29)
    h *= C[3]
    h ^= h >> U64(32)
    return h


class Batch:
    """Texts joined in one buffer, with the anchors of each."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.base = np.cumsum(np.r_[0, self.sizes])[:-1]
        self.buf = b"".join(texts)
        n = len(self.buf)
        self.pos, self.hash = np.zeros(0, np.int64), np.zeros(0, U64)
        if n < WIDTH:
            self.doc = self.pos
            return
        parts = []
        for lo in range(0, n - WIDTH + 1, CHUNK):  # starts of strings
            hi = min(n - WIDTH + 1, lo + CHUNK)
            h = _grams(self.buf[lo : hi + WIDTH - 1])
            order = np.maximum((h >> U64(32)).astype(np.uint32), np.uint32(1))  # 0 is kept for windows across texts
            least = _slide(order, LEFT + 1, np.minimum)
            starts = np.arange(lo, hi)
            at = np.searchsorted(self.base, starts, "right") - 1
            least[starts + WIDTH > self.base[at] + self.sizes[at]] = 0  # across texts
            pad = np.zeros(LEFT, np.uint32)
            best = _slide(np.concatenate([pad, least, pad]), LEFT + 1, np.maximum)
            p = np.flatnonzero(best == order)
            p = p[best[p] > 0]
            parts.append((p + lo, h[p]))
        pos = np.concatenate([p for p, _ in parts])
        self.pos, first = np.unique(pos, return_index=True)
        self.hash = np.concatenate([h for _, h in parts])[first]
        self.doc = np.searchsorted(self.base, self.pos, "right") - 1

    def keys(self) -> np.ndarray:
        return self.hash >> U64(16)

    def contexts(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of anchors at: bytes (left side right-aligned, then the suffix; zero outside the text), and the sides' lengths."""
        pos, doc = self.pos[at], self.doc[at]
        nl = np.minimum(LEFT, pos - self.base[doc])
        nr = np.minimum(WIDTH, self.base[doc] + self.sizes[doc] - pos)
        raw = np.frombuffer(b"\0" * LEFT + self.buf + b"\0" * WIDTH, np.uint8)
        rows = np.lib.stride_tricks.sliding_window_view(raw, LEFT + WIDTH)[pos].copy()
        cols = np.arange(LEFT + WIDTH)
        rows[(cols < LEFT - nl[:, None]) | (cols >= LEFT + nr[:, None])] = 0
        return rows, nl, nr


def context_keys(rows: np.ndarray, nl: np.ndarray, nr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit key and a 32-bit check of each context."""
    n = len(rows)
    padded = np.zeros((n, 80), np.uint8)
    padded[:, : LEFT + WIDTH] = rows
    padded[:, 78], padded[:, 79] = nl, nr
    w = padded.view("<u8")
    a, b = np.zeros(n, U64), np.zeros(n, U64)
    for j in range(10):
        a = (a ^ w[:, j]) * C[0]
        a ^= a >> U64(31)
        b = (b + w[:, j]) * C[3]
        b ^= b >> U64(29)
    a *= C[1]
    a ^= a >> U64(33)
    b *= C[4]
    return a, (b >> U64(32)).astype(np.uint32)


def _some(texts, docs, size=2_000_000):
    """Runs of rows of bounded size."""
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= size):
            n += len(texts[j])
            j += 1
        yield i, texts[i:j], docs[i:j]
        i = j


def multikey_sort(words: list[np.ndarray]) -> np.ndarray:
    """Order of rows by their words: sort by the first, then only ties by the next, and so on."""
    order = np.argsort(words[0], kind="stable")
    k = words[0][order]
    seg = np.cumsum(np.r_[0, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    for w in words[1:]:
        tied = np.flatnonzero(np.bincount(seg)[seg] > 1) if len(seg) else seg
        if not len(tied):
            break
        sub = order[tied]
        o = np.lexsort((w[sub], seg[tied]))
        order[tied] = sub[o]
        v = w[order]
        new = np.r_[False, (seg[1:] != seg[:-1]) | (v[1:] != v[:-1])]
        seg = np.cumsum(new)
    return order


def _words(rows: np.ndarray) -> list[np.ndarray]:
    n, m = rows.shape
    padded = np.zeros((n, -(-m // 8) * 8), np.uint8)
    padded[:, :m] = rows
    return list(padded.view(">u8").astype(U64).T)


def _common(rows: np.ndarray, lens: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the one before it in order, within both lengths; first is -1."""
    a, n = rows[order], lens[order]
    out = np.full(len(order), -1, np.int64)
    if len(order) > 1:
        diff = a[1:] != a[:-1]
        out[1:] = np.minimum(np.where(diff.any(1), diff.argmax(1), rows.shape[1]), np.minimum(n[1:], n[:-1]))
    return out


def repeated(rows: np.ndarray, nl: np.ndarray, nr: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each context, the strings (bit d: the one starting d bytes before the anchor) that a smaller document also has."""
    n = len(rows)
    right, left = rows[:, LEFT:], rows[:, LEFT - 1 :: -1] if LEFT else rows[:, :0]
    ro = multikey_sort([*_words(right), nr.astype(U64)])
    lo = multikey_sort([*_words(left), nl.astype(U64)])
    rc, lc = _common(right, nr, ro), _common(left, nl, lo)
    mask = np.zeros(n, np.uint32)
    rid, lid = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for d in range(LEFT + 1):
        rid[ro] = np.cumsum(rc < WIDTH - d)
        lid[lo] = np.cumsum(lc < d)
        at = np.flatnonzero((nl >= d) & (nr >= WIDTH - d))
        if len(at) < 2:
            continue
        key = rid[at] * (n + 1) + lid[at]
        o = np.argsort(key, kind="stable")
        k = key[o]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        least = np.minimum.reduceat(doc[at][o], first)
        sizes = np.diff(np.r_[first, len(k)])
        mask[at[o]] |= (np.repeat(least, sizes) < doc[at][o]).astype(np.uint32) << np.uint32(d)
    return mask


# A context travels as its bytes and the two sides' lengths; many: several documents of the task have it.
CTX = T.StructType([T.StructField("doc", T.LongType()), T.StructField("many", T.BooleanType()), T.StructField("context", T.BinaryType())])
LEAD = f"substring(context, {LEFT + 1}, {GRAM})"
HELD = 150_000  # contexts that a task holds back to drop repeated ones
VERDICT = "key long, check long, doc long, mask long"


def _verdicts(key, check, doc, many, mask):
    """One row for each context that some document needs: its smallest document and that one's mask."""
    o = np.lexsort((doc, check, key))
    key, check, doc, many, mask = key[o], check[o], doc[o], many[o], mask[o]
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (check[1:] != check[:-1])])
    sizes = np.diff(np.r_[first, len(key)])
    need = (sizes > 1) | np.logical_or.reduceat(many, first) | (mask[first] > 0)
    at = first[need]
    return [pa.array(key[at]), pa.array(check[at]), pa.array(doc[at]), pa.array(mask[at].astype(np.int64))]


def _dedup_store(docs: DataFrame, hot_group: int) -> dict:
    """Steps 1 to 3; where the stores are."""
    spark = docs.sparkSession
    shards = max(16, tasks(docs))
    base = work_dir(spark, "suffix")
    where = local_path(base)
    # 1: equal texts
    h = docs.where("doc_id IS NOT NULL").select(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("m"), "doc_id")
    same = h.groupBy("m").agg(F.min("doc_id").alias("doc"), F.count("*").alias("n")).where("n > 1")
    half = lambda i: F.conv(F.substring("m", i, 8), 16, 10).cast("long")
    same = same.select(F.shiftleft(half(1), 32).bitwiseOR(half(9)).alias("key"), F.shiftleft(half(17), 32).bitwiseOR(half(25)).alias("check"), "doc")
    store_rows(same, f"{where}/same", shards, {"check": "<i8", "doc": "<i8"})
    spec = {"where": where, "shards": shards}

    def singles(batch):
        """Texts that are their class's own, with ids."""
        texts = [t or b"" for t in texts_of(batch, "text")]
        ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
        copies = _copies(spec, texts, ids)
        keep = [i for i in range(len(texts)) if ids[i] is not None and len(texts[i]) >= WIDTH and not copies[i]]
        return [texts[i] for i in keep], [ids[i] for i in keep]

    # 2: anchors met more than once
    def count(batches):
        counter = KeyCounter(shards)
        for whole in batches:
            for batch in slices(whole):
                for _, texts, _ in _some(*singles(batch)):
                    yield from counter.add(Batch(texts).keys())
        yield from counter.flush()

    def twice(shard, keys, counts):
        got = keys[counts > 1]
        return {"key": got}, [[len(got)]]

    n = write_store(docs.mapInArrow(in_task(count), PACKS), f"{where}/grams", shards, twice, [T.StructField("n", T.LongType())]).agg(F.sum("n")).first()[0]

    # 3: contexts of those
    def contexts(batches):
        seen = Store(f"{where}/grams", shards, {})
        held: list[tuple[np.ndarray, ...]] = []

        def put():
            doc, many, rows, key, check = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            o = np.lexsort((doc, check, key))
            first = np.flatnonzero(np.r_[True, (key[o][1:] != key[o][:-1]) | (check[o][1:] != check[o][:-1])])
            many = (np.diff(np.r_[first, len(o)]) > 1) | np.logical_or.reduceat(many[o], first)
            s = o[first]
            return doc[s], many, rows[s], key[s], check[s]

        def send(doc, many, rows, key, check):
            size = rows.shape[1]
            packed = pa.Array.from_buffers(pa.binary(size), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())]).cast(pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(many), packed], names=CTX.names)

        n = 0
        for whole in batches:
            for batch in slices(whole):
                for _, texts, ids in _some(*singles(batch)):
                    b = Batch(texts)
                    at = np.flatnonzero(seen.find(b.keys())[0])
                    if not len(at):
                        continue
                    rows, nl, nr = b.contexts(at)
                    key, check = context_keys(rows, nl, nr)
                    sides = np.stack([nl, nr], 1).astype(np.uint8)
                    held.append((np.array(ids, np.int64)[b.doc[at]], np.zeros(len(at), bool), np.concatenate([rows, sides], 1), key, check))
                    n += len(at)
                    if n > 2 * HELD:
                        merged = put()
                        n = len(merged[0])
                        if n > HELD:
                            yield send(*merged)
                            n = 0
                        else:
                            held.append(merged)
        if held:
            yield send(*put())

    ctx = materialize(docs.mapInArrow(in_task(contexts), CTX), "suffix-contexts")
    n = ctx.count()
    hot = ctx.groupBy(F.expr(LEAD).alias("hot")).count().where(F.col("count") > hot_group).select("hot")
    hot = materialize(hot, "suffix-hot")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 100_000 + 1)

    def compare(batches):
        got = list(batches)
        if not got:
            return
        t = pa.Table.from_batches(got)
        doc, many = t.column("doc").to_numpy(), t.column("many").to_numpy()
        rows, nl, nr = _unpack(t.column("context").to_pylist())
        mask = repeated(rows, nl, nr, doc)
        key, check = context_keys(rows, nl, nr)
        yield pa.RecordBatch.from_arrays(_verdicts(key.view(np.int64), check.astype(np.int64), doc, many, mask), names=["key", "check", "doc", "mask"])

    if hot.isEmpty():
        verdicts = ctx.repartitionByRange(parts, F.expr(LEAD)).mapInArrow(in_task(compare), VERDICT)
    else:
        lead = F.expr(LEAD) == F.col("hot")
        cold = ctx.join(hot, lead, "left_anti").repartitionByRange(parts, F.expr(LEAD)).mapInArrow(in_task(compare), VERDICT)
        verdicts = cold.unionByName(_hot_verdicts(ctx.join(hot, lead, "left_semi")))
    store_rows(verdicts, f"{where}/verdicts", shards, {"check": "<u4", "doc": "<i8", "mask": "<u4"})
    return spec


def _unpack(contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and the sides' lengths of packed contexts."""
    raw = np.frombuffer(b"".join(contexts), np.uint8).reshape(-1, LEFT + WIDTH + 2)
    return raw[:, :-2], raw[:, -2].astype(np.int64), raw[:, -1].astype(np.int64)


def _hot_verdicts(ctx: DataFrame) -> DataFrame:
    """The same verdicts for anchors with very many contexts: every string on its own row, the smallest document by a grouped minimum."""
    one = ctx.groupBy("context").agg(F.min("doc").alias("doc"), (F.count("*") > 1).alias("again"), F.max("many").alias("many"))
    side = lambda i: F.conv(F.hex(F.expr(f"substring(context, {i}, 1)")), 16, 10).cast("int")

    def keyed(batches):
        for batch in batches:
            if batch.num_rows:
                key, check = context_keys(*_unpack(batch.column(0).to_pylist()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key.view(np.int64)), pa.array(check.astype(np.int64))], names=["context", "doc", "again", "many", "key", "check"])

    one = one.mapInArrow(in_task(keyed), "context binary, doc long, again boolean, many boolean, key long, check long")
    one = materialize(one.withColumns({"nl": side(LEFT + WIDTH + 1), "nr": side(LEFT + WIDTH + 2)}), "suffix-hot-contexts")
    offsets = F.filter(F.sequence(F.lit(0), F.lit(LEFT)), lambda d: (d <= F.col("nl")) & (F.lit(WIDTH) - d <= F.col("nr")))
    strings = one.select("key", "check", "doc", F.explode(offsets).alias("d"), "context")
    strings = strings.select("key", "check", "doc", "d", F.expr(f"substring(context, {LEFT + 1} - d, {WIDTH})").alias("string"))
    least = strings.groupBy(F.col("d").alias("ld"), F.col("string").alias("ls")).agg(F.min("doc").alias("least"))
    hit = strings.join(least, (F.col("d") == F.col("ld")) & (F.col("string") == F.col("ls"))).where("least < doc")
    masks = hit.groupBy(F.col("key").alias("mk"), F.col("check").alias("mc")).agg(F.sum(F.expr("shiftleft(1L, d)")).alias("m"))
    out = one.join(masks, (F.col("key") == F.col("mk")) & (F.col("check") == F.col("mc")), "left")
    return out.where("again OR many OR m > 0").select("key", "check", "doc", F.coalesce("m", F.lit(0)).cast("long").alias("mask"))


def _md5(text: bytes) -> tuple[int, int]:
    d = hashlib.md5(text, usedforsecurity=False).digest()
    return int.from_bytes(d[:8], "big"), int.from_bytes(d[8:], "big", signed=True)


def _copies(spec: dict, texts: list[bytes], ids: list) -> list[bool]:
    """Whether each text is a whole copy of one in a document with a smaller id."""
    if "_same" not in spec:
        spec["_same"] = Store(f"{spec['where']}/same", spec["shards"], {"check": "<i8", "doc": "<i8"})
    h = [_md5(t) for t in texts]
    hit, got = spec["_same"].find(np.array([a for a, _ in h], U64))
    return [bool(x) and c == h[k][1] and ids[k] is not None and d < ids[k] for k, (x, c, d) in enumerate(zip(hit, got["check"].tolist(), got["doc"].tolist(), strict=True))]


FIELDS = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())]


def _covered(b: Batch, ids: np.ndarray, store: Store) -> np.ndarray:
    """Which bytes of the batch go."""
    n = len(b.buf)
    starts = np.zeros(n + 1, bool)
    if len(b.pos):
        rows, nl, nr = b.contexts(np.arange(len(b.pos)))
        key, check = context_keys(rows, nl, nr)
        hit, got = store.find(key)
        at = np.flatnonzero(hit & (got["check"] == check) & (ids[b.doc] >= got["doc"]))
        own = got["mask"][at]
        whole = ids[b.doc[at]] > got["doc"][at]
        for d in range(LEFT + 1):
            ok = (nl[at] >= d) & (nr[at] >= WIDTH - d) & (whole | ((own >> np.uint32(d)) & 1 > 0))
            starts[b.pos[at[ok]] - d] = True
    s = np.flatnonzero(starts[:n])
    edge = np.zeros(n + 1, np.int32)
    edge[s] += 1
    edge[s + WIDTH] -= 1
    return np.cumsum(edge[:n]) > 0


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fields: list[T.StructField] | None = None, finish=None, hot_group: int = HOT_GROUP) -> DataFrame:
    """Rows of docs with n_bytes, n_removed, n_spans and kept (the bytes left).

    finish(kept) may replace kept by something else for fields[3], in the same pass.
    """
    fields = fields or FIELDS
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    spec = _dedup_store(ids, hot_group)
    finish = finish or (lambda b: b)

    def make():
        store = Store(f"{spec['where']}/verdicts", spec["shards"], {"check": "<u4", "doc": "<i8", "mask": "<u4"})
        mine = dict(spec)

        def fn(batch):
            texts = [t or b"" for t in texts_of(batch, text)]
            ids = [None if i is None else int(i) for i in batch.column(batch.schema.get_field_index(doc_id)).to_pylist()]
            copies = _copies(mine, texts, ids)
            out = [[len(t) for t in texts], [0] * len(texts), [0] * len(texts), list(texts)]
            for i, copy in enumerate(copies):
                if copy and len(texts[i]) >= WIDTH:
                    out[1][i], out[2][i], out[3][i] = len(texts[i]), 1, b""
            at = [i for i in range(len(texts)) if ids[i] is not None and len(texts[i]) >= WIDTH and not copies[i]]
            for k, some, doc in _some([texts[i] for i in at], [ids[i] for i in at]):
                b = Batch(some)
                gone = _covered(b, np.array(doc, np.int64), store)
                if not gone.any():
                    continue
                raw = np.frombuffer(b.buf, np.uint8)
                for j, (lo, size) in enumerate(zip(b.base.tolist(), b.sizes.tolist(), strict=True)):
                    g = gone[lo : lo + size]
                    if n := int(g.sum()):
                        i = at[k + j]
                        out[1][i], out[2][i] = n, int(g[0]) + int((g[1:] & ~g[:-1]).sum())
                        out[3][i] = raw[lo : lo + size][~g].tobytes()
            out[3] = [finish(x) for x in out[3]]
            return out

        return fn

    return add_columns(docs, fields, make)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of remove_repeats over documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    digest = [*FIELDS[:3], T.StructField("kept_sha256", T.StringType())]
    return remove_repeats(docs, fields=digest, finish=lambda b: hashlib.sha256(b).hexdigest()).drop("text")
