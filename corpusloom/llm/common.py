"""What the operators share: Arrow passes over whole rows, and sorted stores.

A *store* is a folder below the shared folder that holds unsigned 64-bit keys
and value columns in numbered shards. A key's shard follows from a mix of the
key; within a shard keys are sorted, each column in a file of its own, so that
workers map the files and search them without loading them. The shared folder
must be a mounted file system (path or file: URI): memory mapping needs one.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re
import shutil
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

U64 = np.uint64
EMPTY = b""


def local_path(uri: str) -> str:
    """The mounted path of a shared-folder URI."""
    if m := re.match(r"file:(?://[^/]*)?(/.*)", uri):
        return m[1]
    if re.match(r"[a-zA-Z][\w+.-]+:", uri):
        raise ValueError(f"{uri}: stores are memory-mapped, so spark.checkpoint.dir must be a mounted path")
    return uri


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    col = batch.column(batch.schema.get_field_index(name))
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about size bytes, one row at least, so that Python holds few texts at a time."""
    rows = max(1, int(size * batch.num_rows / max(1, batch.nbytes)))
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


_held: dict = {}
_used: set = set()


def resident(key, build: Callable):
    """build(), kept in this worker for as long as its tasks ask for the same key."""
    _used.add(key)
    if key not in _held:
        _held[key] = build()
    return _held[key]


def settle() -> None:
    """Give free memory back, so that idle workers of an executor hold little."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def begin(make: Callable | None = None):
    """Start a task: make(), and drop what earlier tasks kept and this one didn't ask for."""
    _used.clear()
    fn = make() if make is not None else None
    if stale := set(_held) - _used:
        for k in stale:
            del _held[k]
        settle()
    return fn


def in_task(run: Callable) -> Callable:
    """run as a task's function that leaves its worker small."""

    def wrapped(batches):
        begin()
        yield from run(batches)
        settle()

    return wrapped


def add_columns(df: DataFrame, fields: list[T.StructField], make: Callable[[], Callable[[pa.RecordBatch], list]], keep: list[str] | None = None) -> DataFrame:
    """Rows of df (columns keep, all by default) with columns appended by Python.

    make() runs once in each task and returns the function that turns a batch
    into the new columns' values. A column of df with a new one's name is replaced.
    """
    names = {f.name for f in fields}
    base = [c for c in (df.columns if keep is None else keep) if c not in names]
    schema = T.StructType([df.schema[c] for c in base] + fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = begin(make)
        for whole in batches:
            for batch in slices(whole):
                new = [v if isinstance(v, pa.Array) else pa.array(v, arrow.field(f.name).type) for f, v in zip(fields, fn(batch), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)).cast(arrow.field(c).type) for c in base] + new, schema=arrow)
        del fn
        settle()

    return df.mapInArrow(run, schema)


def crc_mod(ids, n: int) -> np.ndarray:
    """crc32 of each id as decimal text, modulo n; a null id counts as empty text."""
    return np.fromiter((zlib.crc32(b"" if i is None else b"%d" % i) % n for i in ids), np.int64)


def tasks(df: DataFrame) -> int:
    return df.rdd.getNumPartitions()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mix64(keys) % U64(shards)).astype(np.int32)


def pack_sorted(keys: np.ndarray, counts: np.ndarray | None = None) -> bytes:
    """Sorted distinct keys (with counts) as differences, byte plane by byte plane, under zstandard."""
    d = np.diff(keys, prepend=U64(0)).astype("<u8")
    planes = [np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes()]
    if counts is not None:
        planes.append(np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())
    head = len(keys).to_bytes(8, "little") + bytes([counts is not None])
    return head + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack_sorted(blob: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    n, counted = int.from_bytes(blob[:8], "little"), blob[8]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[9:], max_output_size=n * (12 if counted else 8) or 1), np.uint8)
    d = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<u8").ravel()
    counts = np.ascontiguousarray(raw[8 * n :].reshape(4, n).T).view("<u4").ravel() if counted else None
    return np.cumsum(d, dtype=U64), counts


PACKS = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("pack", T.BinaryType())])


def pack_shards(keys: np.ndarray, counts: np.ndarray | None, shards: int) -> Iterator[tuple[int, bytes]]:
    """(shard, pack) rows of distinct keys, sorted or not."""
    if not len(keys):
        return
    s = shard_of(keys, shards)
    o = np.lexsort((keys, s))
    s, keys = s[o], keys[o]
    counts = None if counts is None else counts[o]
    cut = np.flatnonzero(np.r_[True, s[1:] != s[:-1], True])
    for i, j in zip(cut[:-1], cut[1:], strict=True):
        yield int(s[i]), pack_sorted(keys[i:j], None if counts is None else counts[i:j])


def sum_sorted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with their counts added up."""
    if not len(keys):
        return keys, counts
    o = np.argsort(keys, kind="stable")
    keys = keys[o]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts[o], first)


def pack_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "pack"])


class KeyCounter:
    """Counts 64-bit keys in bounded memory; flushes packs as it goes."""

    def __init__(self, shards: int, limit: int = 1_500_000):
        self.shards, self.limit, self.parts, self.n = shards, limit, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        keys, counts = (np.unique(keys, return_counts=True) if counts is None else (keys, counts))
        self.parts.append((keys, counts))
        self.n += len(keys)
        if self.n > self.limit:
            self._merge()
            if self.n > self.limit * 0.6:
                yield from self.flush()

    def _merge(self) -> None:
        if len(self.parts) > 1:
            self.parts = [sum_sorted(np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts]))]
        self.n = sum(len(p[0]) for p in self.parts)

    def flush(self) -> Iterator[pa.RecordBatch]:
        self._merge()
        if self.n:
            yield pack_batch(list(pack_shards(*self.parts[0], self.shards)))
        self.parts, self.n = [], 0


def write_shard(folder: str, shard: int, columns: dict[str, np.ndarray]) -> None:
    """One shard's columns. Files appear whole, and a repeated task writes the same again."""
    os.makedirs(folder, exist_ok=True)
    for name, values in columns.items():
        tmp = f"{folder}/.{shard}-{name}-{os.getpid()}-{os.urandom(4).hex()}"
        values.tofile(tmp)
        os.replace(tmp, f"{folder}/{shard}.{name}")


class Store:
    """Read side: maps shards when first used."""

    def __init__(self, folder: str, shards: int, columns: dict[str, str]):
        self.folder, self.shards, self.columns, self.open = folder, shards, columns, {}

    def shard(self, i: int) -> dict[str, np.ndarray]:
        if i not in self.open:
            got = {}
            for name, kind in {"key": "<u8", **self.columns}.items():
                path = f"{self.folder}/{i}.{name}"
                got[name] = np.memmap(path, kind, "r") if os.path.exists(path) and os.path.getsize(path) else np.zeros(0, kind)
            self.open[i] = got
        return self.open[i]

    def find(self, keys: np.ndarray, missing: dict | None = None) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Whether each key is there, and its values (zero, or missing[name], where not)."""
        keys = np.asarray(keys, U64)
        u, inv = np.unique(keys, return_inverse=True)
        hit = np.zeros(len(u), bool)
        vals = {n: np.full(len(u), (missing or {}).get(n, 0), k) for n, k in self.columns.items()}
        s = shard_of(u, self.shards)
        o = np.argsort(s, kind="stable")
        cut = np.flatnonzero(np.r_[True, s[o][1:] != s[o][:-1], True]) if len(o) else []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            at = o[a:b]  # sorted keys of one shard
            data = self.shard(int(s[at[0]]))
            if not len(data["key"]):
                continue
            pos = np.searchsorted(data["key"], u[at])
            pos[pos == len(data["key"])] = 0
            ok = data["key"][pos] == u[at]
            hit[at] = ok
            for n in self.columns:
                vals[n][at[ok]] = data[n][pos[ok]]
        return hit[inv], {n: v[inv] for n, v in vals.items()}


def write_store(packs: DataFrame, folder: str, shards: int, reduce: Callable, fields: list[T.StructField]) -> DataFrame:
    """Merge packs shard by shard and write each shard's files.

    packs: rows of PACKS. reduce(shard, keys, counts) gets all packs' keys, sorted
    and summed, and returns (columns to write, rows to return as a list of columns
    for fields). Lazy: an action on the result does the work.
    """
    arrow = to_arrow_schema(T.StructType(fields))

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for shard, pack in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(shard, []).append(pack)
        for shard in sorted(held):
            got = [unpack_sorted(p) for p in held.pop(shard)]
            keys = np.concatenate([g[0] for g in got])
            keys, counts = sum_sorted(keys, np.concatenate([g[1] for g in got]).astype(np.int64))
            del got
            columns, rows = reduce(shard, keys, counts)
            write_shard(folder, shard, columns)
            yield pa.RecordBatch.from_arrays([pa.array(r, f.type) for r, f in zip(rows, arrow, strict=True)], schema=arrow)

    return packs.repartitionById(shards, "shard").mapInArrow(in_task(run), T.StructType(fields))


def drop_folder(folder: str) -> None:
    shutil.rmtree(folder, ignore_errors=True)


def store_rows(rows: DataFrame, folder: str, shards: int, columns: dict[str, str], key: str = "key") -> int:
    """Write a store from rows (an action); columns gives each value column's numpy type. Rows in all.

    Of rows with equal keys one stays.
    """

    def place(batches):
        for batch in batches:
            k = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard_of(k, shards), pa.int32())], names=[*batch.schema.names, "shard"])

    schema = T.StructType([rows.schema[key], *[rows.schema[c] for c in columns], T.StructField("shard", T.IntegerType())])

    def run(batches):
        whole = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if whole is None or not whole.num_rows:
            return
        shard = whole.column("shard").to_numpy()
        k = whole.column(key).to_numpy().astype(np.int64).view(U64)
        for s in np.unique(shard):
            at = np.flatnonzero(shard == s)
            at = at[np.argsort(k[at], kind="stable")]
            at = at[np.r_[True, k[at][1:] != k[at][:-1]]]
            write_shard(folder, int(s), {"key": k[at], **{c: whole.column(c).to_numpy()[at].astype(t) for c, t in columns.items()}})
            yield pa.RecordBatch.from_arrays([pa.array([len(at)], pa.int64())], names=["n"])

    placed = rows.select(key, *columns).mapInArrow(in_task(place), schema).repartitionById(shards, "shard")
    from pyspark.sql import functions as F

    return placed.mapInArrow(in_task(run), "n long").agg(F.sum("n")).first()[0] or 0
