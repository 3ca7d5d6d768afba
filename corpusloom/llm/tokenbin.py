"""Token ids in seekable binary files.

A file is a run of independent zstandard frames, one for each document (its ids
as little-endian unsigned 32-bit integers), then two skippable frames, which
plain zstandard readers step over: the document table (doc_id, number of ids)
and the seek table in the public seekable layout, with each frame's compressed
and decompressed size and the low 32 bits of the XXH64 of its content. A reader
takes the footer, the seek table and the document table, and then decompresses
the frames of the documents asked for, each checked against its checksum.

The corpus is one file for each range of ids, in ascending order. Encoding
happens where the text is read; only compressed frames are shuffled, to the
file their id falls in by quantiles of the ids.

Defined results: a null or empty text is its end id alone; repeated ids are
written side by side in order of their compressed frames; a null id sorts first; an
empty table writes no file.
"""

from __future__ import annotations

import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.session import table, work_dir
from .bpe import FOREIGN, byte_chars, default_path
from .common import add_columns, in_task, local_path, resident, tasks

SKIPPABLE, DOC_TABLE, SEEK_MAGIC = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1
CACHE = 800_000
NULL_ID = -(1 << 63)  # how the document table writes a null id
# The byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE_RUN = re.compile(r" \s")


class ByteTokenizer:
    """The library's byte-level BPE model behind a bounded cache.

    The pre-tokenizer only ever looks across a space when white space follows it;
    text without such runs is cut at spaces, each chunk owning the space before
    it. Unknown chunks are cut into pre-tokens, unknown pre-tokens merged by the
    library's model, and both remembered. Text with such runs, with special
    tokens or with characters whose class the two regex engines may see
    differently goes to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.merge = self.tok.model.tokenize
        self.marks = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.pattern = regex.compile(PATTERN)
        self.table = {b: c for b, c in enumerate(byte_chars())}
        self.chunks: dict[str, bytes] = {}  # after a space, without it
        self.heads: dict[str, bytes] = {}  # pre-tokens that start without a space

    def merged(self, p: str) -> bytes:
        written = "\u0120" + p[1:] if p[0] == " " and p.isascii() else p.encode().decode("latin-1").translate(self.table)
        ids = [t.id for t in self.merge(written)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def piece(self, p: str) -> bytes:
        known, key = (self.chunks, p[1:]) if p[0] == " " else (self.heads, p)
        if (got := known.get(key)) is None:
            got = known[key] = self.merged(p)
        return got

    def chunk(self, c: str) -> bytes:
        """Ids of a chunk that follows a space and isn't remembered."""
        if c.isalpha():
            got = self.chunks[c] = self.merged(" " + c)
            return got
        first, *rest = self.pattern.findall(" " + c)
        known = first[1:] in self.chunks
        got = self.piece(first) + b"".join([self.piece(p) for p in rest])
        if known and len(rest) == 1:  # a word seen before with its punctuation; rarer combinations aren't worth remembering
            self.chunks[c] = got
        return got

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian 32-bit integers."""
        if not text:
            return b""
        if SPACE_RUN.search(text) or ("<|" in text and any(m in text for m in self.marks)) or not (text.isascii() or not FOREIGN.search(text)):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.chunks) + len(self.heads) > CACHE:
            self.chunks.clear()
            self.heads.clear()
        first, *rest = text.split(" ")
        ids = list(map(self.chunks.get, rest))
        if None in ids:
            chunk = self.chunk
            ids = [chunk(c) if g is None else g for c, g in zip(rest, ids, strict=True)]
        return b"".join([self.piece(p) for p in self.pattern.findall(first)]) + b"".join(ids)


def byte_tokenizer(path: str) -> ByteTokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return resident(("bytes", path), lambda: ByteTokenizer(path))


FRAME = [T.StructField("n_tokens", T.LongType()), T.StructField("frame", T.BinaryType()), T.StructField("check", T.LongType())]


def frames(docs: DataFrame, path: str, end_id: int, text: str = "text", keep: list[str] | None = None, level: int = 1) -> DataFrame:
    """Rows of docs with each document's ids as a compressed frame and its checksum."""

    def make():
        tok, end, comp = byte_tokenizer(path), np.array([end_id], "<u4").tobytes(), zstandard.ZstdCompressor(level=level)

        def fn(batch):
            out = [[], [], []]
            for t in batch.column(batch.schema.get_field_index(text)).to_pylist():
                ids = tok.encode(t) + end
                out[0].append(len(ids) // 4)
                out[1].append(comp.compress(ids))
                out[2].append(xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF)
            return out

        return fn

    return add_columns(docs, FRAME, make, keep)


def write_file(path: str, docs) -> tuple[int, int]:
    """Write (doc_id, n_tokens, frame, check) rows in order; documents and ids written. The file appears whole."""
    table, seek, n, total, tmp = [], [], 0, 0, f"{path}.{os.getpid()}-{os.urandom(4).hex()}"
    with open(tmp, "wb") as f:
        for doc_id, n_tokens, frame, check in docs:
            f.write(frame)
            table.append((NULL_ID if doc_id is None else doc_id, n_tokens))
            seek.append((len(frame), 4 * n_tokens, check))
            n, total = n + 1, total + n_tokens
        body = zstandard.ZstdCompressor(level=3).compress(np.array(table, "<i8").reshape(-1, 2).tobytes())
        f.write(struct.pack("<II", DOC_TABLE, len(body)) + body)
        seek.append((8 + len(body), 0, 0))
        body = np.array(seek, "<u4").tobytes() + struct.pack("<IBI", len(seek), 0x80, SEEK_MAGIC)
        f.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
    os.replace(tmp, path)
    return n, total


class TokenFile:
    """A reader. Opens with the tables alone; documents are decompressed when asked for."""

    def __init__(self, path: str):
        self.f = open(path, "rb")  # noqa: SIM115
        size = self.f.seek(0, 2)
        self.f.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", self.f.read(9))
        if magic != SEEK_MAGIC or flags != 0x80:
            raise ValueError(f"{path}: no seek table")
        self.f.seek(size - 9 - 12 * n)
        seek = np.frombuffer(self.f.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(seek[:, 0])])
        self.seek = seek
        self.f.seek(int(self.offsets[n - 1]) + 8)
        doc = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.f.read(int(seek[-1, 0]) - 8)), "<i8").reshape(-1, 2)
        self.doc_ids, self.n_tokens = doc[:, 0], doc[:, 1]
        self.starts = np.concatenate([[0], np.cumsum(self.n_tokens)])

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids_at(self, k: int) -> bytes:
        """The k-th document's ids, checked."""
        self.f.seek(int(self.offsets[k]))
        raw = zstandard.ZstdDecompressor().decompress(self.f.read(int(self.seek[k, 0])), max_output_size=int(self.seek[k, 1]))
        if len(raw) != self.seek[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.seek[k, 2]:
            raise ValueError(f"frame {k} doesn't match its checksum")
        return raw

    def read(self, doc_id: int) -> list[np.ndarray]:
        """Every document of that id."""
        lo, hi = np.searchsorted(self.doc_ids, doc_id, "left"), np.searchsorted(self.doc_ids, doc_id, "right")
        return [np.frombuffer(self.ids_at(k), "<u4") for k in range(lo, hi)]

    def close(self) -> None:
        self.f.close()


def write_corpus(docs: DataFrame, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text", files: int | None = None) -> DataFrame:
    """Write the files; (file, path, n_docs, n_tokens) in ascending ranges of ids, one row a file (materialised)."""
    spark = docs.sparkSession
    folder = work_dir(spark, "tokens")
    where = local_path(folder)
    files = files or max(1, tasks(docs))
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    cuts = sorted(set(ids.select(F.percentile_approx("doc_id", [i / files for i in range(1, files)] or [0.5], max(10_000, 20 * files))).first()[0] or []))
    bounds = np.array(cuts, np.int64)

    def deal():
        def fn(batch):
            doc = batch.column(batch.schema.get_field_index("doc_id"))
            at = np.searchsorted(bounds, doc.fill_null(0).to_numpy(), "left").astype(np.int32)
            return [pa.array(np.where(np.asarray(doc.is_valid()), at, 0).astype(np.int32))]

        return fn

    dealt = add_columns(frames(ids, path, end_id, keep=["doc_id"]), [T.StructField("file", T.IntegerType())], deal)
    dealt = dealt.select("file", "doc_id", "n_tokens", "frame", "check").repartitionById(files, "file").sortWithinPartitions("file", "doc_id", "frame")

    def run(batches):
        from itertools import chain, groupby

        rows = chain.from_iterable(zip(*(b.column(i).to_pylist() for i in range(5)), strict=True) for b in batches)
        for k, group in groupby(rows, key=lambda r: r[0]):
            os.makedirs(where, exist_ok=True)
            n, total = write_file(f"{where}/{k:08d}.tok", (r[1:] for r in group))
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([f"{where}/{k:08d}.tok"]), pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["file", "path", "n_docs", "n_tokens"])

    done = dealt.mapInArrow(in_task(run), "file int, path string, n_docs long, n_tokens long")
    out = f"{folder}-files"
    done.write.parquet(out)
    return spark.read.schema(done.schema).parquet(out)


def read_corpus(listing: DataFrame) -> DataFrame:
    """Read all files back: (doc_id, start, n_tokens, ids_crc32); start counts the ids of all documents before."""
    first = F.coalesce(F.sum("n_tokens").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = listing.withColumn("first", first).repartition(listing.sparkSession.sparkContext.defaultParallelism * 4, "file")  # one small row a file

    def run(batches):
        for batch in batches:
            for path, base in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("path", "first")), strict=True):
                f = TokenFile(path)
                for k in range(0, len(f), 4096):
                    part = range(k, min(len(f), k + 4096))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([None if d == NULL_ID else d for d in f.doc_ids[part.start : part.stop].tolist()], pa.int64()), pa.array(f.starts[part.start : part.stop] + base, pa.int64()), pa.array(f.n_tokens[part.start : part.stop], pa.int64()), pa.array([zlib.crc32(f.ids_at(i)) for i in part], pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                f.close()

    return placed.mapInArrow(in_task(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode, write and read back every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_corpus(write_corpus(docs, default_path("byte_bpe_50k.json"), 2))
