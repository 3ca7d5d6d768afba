"""SimHash near-duplicate groups by meet-in-the-middle ball hashing.

A text is folded (A-Z to a-z), split at ASCII white space and cut into word
shingles, repeats included; a fingerprint bit is 1 if it is set in over half of
the shingles' XXH64 (seed 42). Equal fingerprints are one class, so any number
of copies costs one row from there on. Every class emits the variants of its
fingerprint within half the radius; two fingerprints within the radius share a
variant. A variant has at most as many distinct fingerprints as a ball has
points (65 at half radius 1), so no shuffle key is hot. Within a variant the
smallest fingerprint links to the others; links are deduplicated, verified by
counting differing bits and contracted to components.

similar_groups() is for a similarity instead of a radius: a set of five-word
shingles gets TABLES independent fingerprints of BITS bits, each with a ball of its
own, and colliding pairs are verified by the exact Jaccard similarity of their
sets. Two sets at similarity s differ in a bit with probability
p = arccos(2 s / (1 + s)) / pi, so a table brings them together with probability
P(Binomial(BITS, p) <= RADIUS), and one of TABLES does with 0.96 at 0.80, 0.995 at
0.85 and 0.9999 at 0.90; a group needs only some of its pairs. Unrelated sets meet
in a variant with density N (BITS + 1) / 2^BITS, which is what BITS is for: 0.025
for 240,000 sets; add two bits, and half as many tables again, for each four-fold
growth beyond tens of millions.

Defined results: a null or blank text has fingerprint zero and links like any
other; fewer words than a shingle are one shingle; rows with equal ids are
separate rows of one class; a null id keeps its row and is never a component's
id, which is null only if every id in the component is. In similar_groups() texts
without words have the empty set and are copies of one another.
"""

from __future__ import annotations

import os
from collections import OrderedDict
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import connected_components
from ..plans.session import materialize, table, work_dir
from .common import U64, add_columns, drop_folder, in_task, local_path, mix64, slices, texts_of

RADIUS = 2
CHUNK = 1 << 15
SHINGLE, SIMILARITY = 5, 0.8
BITS, TABLES = 28, 16
APART = 131  # of 448 bits: more than eight standard deviations from unrelated sets, and from similar ones
CACHE = 32_000_000
ROWS = 256  # sets of a variant that are compared with the others at once


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint as a signed integer."""
    ws = (text or b"").lower().split()
    if not ws:
        return 0
    joined = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(ws) > shingle:
        starts, ends = starts[: len(ws) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, ones, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(starts)
    for i in range(0, n, CHUNK):
        part = zip(starts[i : i + CHUNK].tolist(), ends[i : i + CHUNK].tolist(), strict=True)
        h = np.array([digest(joined[a:b], seed) for a, b in part], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, out: str = "fp", keep: list[str] | None = None) -> DataFrame:
    """Rows of docs with a long column of fingerprints."""

    def make():
        def fn(batch):
            return [[fingerprint(t, shingle) for t in texts_of(batch, text)]]

        return fn

    return add_columns(docs, [T.StructField(out, T.LongType())], make, keep)


def ball(half: int, bits: int = 64) -> list[int]:
    """All masks of at most half of bits bits, signed 64-bit integers."""
    masks = [sum(1 << b for b in some) for k in range(half + 1) for some in combinations(range(bits), k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame, fp: str = "fp", radius: int = RADIUS) -> DataFrame:
    """(a, b): links of distinct fingerprints that connect all pairs within the radius.

    Pairs that share a variant are joined through the variant's smallest
    fingerprint; for an odd radius a pair is verified before it counts.
    """
    masks = F.array(*[F.lit(m) for m in ball((radius + 1) // 2)])
    variants = fps.select(F.col(fp).alias("b")).distinct().select("b", F.explode(F.transform(masks, lambda m: F.col("b").bitwiseXOR(m))).alias("variant"))
    if radius % 2:
        # two points of one ball may be radius + 1 apart: link neighbours only
        pairs = variants.join(variants.toDF("a", "v"), F.col("variant") == F.col("v")).where("a < b").select("a", "b")
    else:
        pairs = variants.select("b", F.min("b").over(Window.partitionBy("variant")).alias("a")).where("a <> b").select("a", "b")
    return pairs.distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for every row."""
    fps = materialize(fingerprints(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "text", shingle, keep=["doc_id"]), "simhash")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    comp = connected_components(links(fps, "fp", radius))
    joined = classes.join(comp, classes["fp"] == comp["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    joined = materialize(joined, "simhash-classes")
    smallest = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = joined.join(smallest, "component").select(F.col("fp").alias("cfp"), "component_id")
    return fps.join(by_fp, F.col("fp") == F.col("cfp")).select("doc_id", "fp", "component_id")


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 32-bit hashes (the upper half of XXH64) of the text's word shingles.

    Two sets of n shingles have n^2 / 2^32 by chance in common: 5e-6 of them at 20,000.
    """
    ws = (text or b"").lower().split()
    if not ws:
        return np.zeros(0, np.uint32)
    joined = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(ws))
    digest = xxhash.xxh64_intdigest
    found = {digest(joined[a:b]) >> 32 for a, b in zip(starts[: len(ws) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)}
    return np.sort(np.fromiter(found, np.uint32, len(found)))


_MORE = [U64(0x9E3779B97F4A7C15 * (2 * j + 1) & (1 << 64) - 1) for j in range(-(-BITS * TABLES // 64))]


def short_prints(hashes: np.ndarray) -> list[int]:
    """A set's TABLES fingerprints of BITS bits; none of the empty set."""
    if not len(hashes):
        return []
    ones = np.zeros(64 * len(_MORE), np.int64)
    for i in range(0, len(hashes), 4096):
        h = np.stack([mix64(hashes[i : i + 4096].astype(U64) * m + m) for m in _MORE], axis=1)
        ones += np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1).sum(0, dtype=np.uint16)
    bits = (2 * ones > len(hashes))[: BITS * TABLES].reshape(TABLES, BITS)
    return (bits @ (1 << np.arange(BITS))).tolist()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common / (len(both) - common) if len(both) else 1.0


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    return min(len(a), len(b)) >= similarity * max(len(a), len(b)) and jaccard(a, b) >= similarity


def write_sets(docs: DataFrame, folder: str, shingle: int) -> DataFrame:
    """(doc_id, class, place, prints) of docs (doc_id, text); sets go to a file a task. Lazy."""

    def run(batches):
        part = TaskContext.get().partitionId()
        os.makedirs(folder, exist_ok=True)
        tmp, at = f"{folder}/.{part}-{os.getpid()}-{os.urandom(4).hex()}", 0
        with open(tmp, "wb") as f:
            for whole in batches:
                for batch in slices(whole):
                    classes, places, prints = [], [], []
                    for t in texts_of(batch, "text"):
                        s = shingle_set(t, shingle)
                        prints.append(short_prints(s))
                        f.write(np.array([len(s), *(prints[-1] or [0] * TABLES)], "<u4").tobytes() + s.astype("<u4").tobytes())
                        classes.append(xxhash.xxh64_intdigest(s.tobytes()))
                        places.append(part << 40 | at)
                        at += 1 + TABLES + len(s)
                    ids = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64())
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.array(classes, U64).view(np.int64)), pa.array(places, pa.int64()), pa.array(prints, pa.list_(pa.int32()))], names=["doc_id", "class", "place", "prints"])
        os.replace(tmp, f"{folder}/{part}")  # whole, and the same again from a repeated task

    return docs.mapInArrow(in_task(run), "doc_id long, class long, place long, prints array<int>")


class Sets:
    """Read side of write_sets: sets by place, the last CACHE bytes kept."""

    def __init__(self, folder: str):
        self.folder, self.files, self.held, self.size = folder, OrderedDict(), OrderedDict(), 0

    def file(self, part: int) -> int:
        if part not in self.files:
            if len(self.files) >= 128:
                os.close(self.files.popitem(last=False)[1])
            self.files[part] = os.open(f"{self.folder}/{part}", os.O_RDONLY)
        return self.files[part]

    def get(self, place: int) -> tuple[np.ndarray, np.ndarray]:
        """The set's fingerprints and its hashes."""
        if place in self.held:
            self.held.move_to_end(place)
            return self.held[place]
        fd, at = self.file(place >> 40), 4 * (place & ((1 << 40) - 1))
        raw = os.pread(fd, 4096, at)
        n = 4 * (1 + TABLES + int.from_bytes(raw[:4], "little"))
        raw = raw[:n]
        while len(raw) < n:
            raw += os.pread(fd, n - len(raw), at + len(raw))
        words = np.frombuffer(raw, "<u4", offset=4)
        s = self.held[place] = words[:TABLES], words[TABLES:]
        self.size += 300 + words.nbytes
        while self.size > CACHE and len(self.held) > 1:
            self.size -= 300 + self.held.popitem(last=False)[1][1].nbytes + 4 * TABLES
        return s

    def close(self) -> None:
        for fd in self.files.values():
            os.close(fd)


def verified(pairs: DataFrame, classes: DataFrame, folder: str, similarity: float) -> DataFrame:
    """The pairs (a, b) of classes, known by their sets' places, that reach the similarity."""

    def run(batches):
        sets = Sets(folder)
        try:
            for batch in batches:
                keep = []
                for p, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    keep.append(alike(sets.get(p)[1], sets.get(q)[1], similarity))
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in (0, 1)], names=["a", "b"])
        finally:
            sets.close()

    of = lambda n: classes.select(F.col("class").alias(n), F.col("prints").alias(f"{n}_prints"))
    apart = F.aggregate(F.zip_with("a_prints", "b_prints", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    close = pairs.join(of("a"), "a").join(of("b"), "b").where(apart <= APART).select("a", "b")
    return materialize(close.repartition("a").sortWithinPartitions("a", "b").mapInArrow(in_task(run), "a long, b long"), "simhash-links")


def _apart(met: DataFrame, links: DataFrame) -> DataFrame:
    """(variant, class, component) of the variants whose sets are in several components."""
    comp = materialize(connected_components(links), "simhash-components")
    placed = met.join(comp, F.col("class") == F.col("node"), "left").select("variant", "class", F.coalesce("component", "class").alias("component"))
    same = Window.partitionBy("variant")
    placed = placed.withColumns({"lo": F.min("component").over(same), "hi": F.max("component").over(same)})
    return placed.where("lo <> hi").select("variant", "class", "component")


def linked(met: DataFrame, folder: str, similarity: float) -> DataFrame:
    """(a, b): links between components, of sets that share a variant, from rows (variant, class, component).

    Pairs are compared where they are and never sent: each in the first variant of
    the first table that it shares, by fingerprints first, and only while its
    components aren't connected yet in this task.
    """

    def run(batches):
        sets, up = Sets(folder), {}

        def root(c: int) -> int:
            while (p := up.get(c, c)) != c:
                up[c] = up.get(p, p)
                c = p
            return c

        def pairs(variant: int, places, comp) -> list[tuple[int, int]]:
            t, v = variant >> 32, np.uint32(variant & 0xFFFFFFFF)
            prints, out = np.stack([sets.get(p)[0] for p in places.tolist()]), []
            for i in range(0, len(places), ROWS):
                x, y = prints[i : i + ROWS], prints[i:]
                ok = (comp[i : i + ROWS, None] != comp[None, i:]) & (np.arange(len(x))[:, None] < np.arange(len(y))[None])
                other = x[:, t, None] ^ y[None, :, t] ^ v  # of the two variants that a pair shares, or the same if it shares a ball
                ok &= (v < other) | ((v == other) & (x[:, t] == v)[:, None])
                r, c = np.nonzero(ok)
                for k in range(0, len(r), 1 << 16):
                    a, b = r[k : k + (1 << 16)], c[k : k + (1 << 16)]
                    apart = np.bitwise_count(x[a] ^ y[b])
                    fine = (apart.sum(1, dtype=np.int64) <= APART) & ~(apart[:, :t] <= RADIUS).any(1)
                    for a, b in zip((a[fine] + i).tolist(), (b[fine] + i).tolist(), strict=True):
                        p, q = root(int(comp[a])), root(int(comp[b]))
                        if p != q and alike(sets.get(int(places[a]))[1], sets.get(int(places[b]))[1], similarity):
                            up[max(p, q)] = min(p, q)
                            out.append((int(places[a]), int(places[b])))
            return out

        held = None
        try:
            for batch in _ended(batches):
                cols = np.stack([c.to_numpy() for c in batch.columns]) if batch is not None else np.zeros((3, 0), np.int64)
                cols = cols if held is None else np.concatenate([held, cols], 1)
                cut = np.flatnonzero(np.r_[True, cols[0, 1:] != cols[0, :-1], True]) if cols.shape[1] else np.zeros(1, int)
                whole = len(cut) - 1 if batch is None else max(0, len(cut) - 2)
                found = [x for s, e in zip(cut[:whole], cut[1 : whole + 1], strict=True) if e - s > 1 for x in pairs(int(cols[0, s]), *cols[1:, s:e])]
                held = cols[:, cut[whole] :]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])
        finally:
            sets.close()

    return materialize(met.repartition("variant").sortWithinPartitions("variant", "class").mapInArrow(in_task(run), "a long, b long"), "simhash-links")


def _ended(batches):
    """The batches, then None."""
    yield from batches
    yield None


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) for every row; see the module for what is found.

    Every set is first compared with the smallest one that it meets in any variant;
    then, within each variant, sets that are still in different components. So a large
    group of copies costs about a comparison a member, and no link is lost.
    """
    spark = docs.sparkSession
    folder = local_path(work_dir(spark, "shingles"))
    sets = materialize(write_sets(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), folder, shingle), "simhash-sets")
    classes = sets.groupBy("class").agg(F.min("doc_id").alias("least"), F.min("place").alias("place"), F.first("prints").alias("prints"))
    # from here on a class is the place of its set
    classes = materialize(classes.select(F.col("class").alias("hash"), F.col("place").alias("class"), "least", "prints"), "simhash-classes")
    masks = F.array(*[F.lit(m) for m in ball(RADIUS // 2, BITS)])
    spread = classes.select("class", "prints").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "class").select("class", F.posexplode("prints").alias("t", "f"))
    spread = spread.select("class", F.shiftleft(F.col("t").cast("long"), 32).bitwiseOR(F.col("f").cast("long")).alias("f")).select("class", F.explode(F.transform(masks, lambda m: F.col("f").bitwiseXOR(m))).alias("variant"))
    same = Window.partitionBy("variant")
    met = spread.withColumns({"first": F.min("class").over(same), "n": F.count("*").over(same)}).where("n > 1").select("variant", "class", "first")
    met = materialize(met, "simhash-met")
    # every set with the smallest one that it meets anywhere
    tried = materialize(met.groupBy(F.col("class").alias("b")).agg(F.min("first").alias("a")).where("a < b").select("a", "b"), "simhash-pairs")
    links = verified(tried, classes, folder, similarity)
    comp = connected_components(links.unionByName(linked(_apart(met, links), folder, similarity)))
    drop_folder(folder)
    joined = materialize(classes.join(comp, F.col("class") == F.col("node"), "left").select("hash", "least", F.coalesce("component", "class").alias("component")), "simhash-groups")
    smallest = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    by_class = joined.join(smallest, "component").select(F.col("hash").alias("c"), "component_id")
    return sets.join(by_class, F.col("class") == F.col("c")).select("doc_id", "component_id")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of near_duplicates over documents."""
    got = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
