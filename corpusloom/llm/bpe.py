"""Exact byte-pair encoding by backtracking, and decoding by an offset table.

The vocabulary's tokens are strings of symbols, one character each (a byte, or
for vocabularies with word ends a byte that ends its word). An Aho-Corasick
automaton gives all tokens at every position of a word; the encoder takes the
longest, keeps it if the pair with the token before it is compatible (merging
the two tokens' symbols gives just that pair), else tries the next shorter, else
steps back. Positions found to be dead ends are marked, so the work is linear in
the word. Pair compatibility follows from undoing merges on either side of the
boundary in order of rank, and is kept in a table. Words are remembered in a
bounded cache. Decoding gathers slices of one blob through an offset table.

Defined results: a null text counts as empty and gives no ids; text of any
length is encoded whole; the special tokens' strings in a text become their ids,
as in the library.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..plans.session import table
from .common import add_columns, resident

CACHE = 120_000
END = 0x400  # added to a byte that ends its word


def byte_chars() -> list[str]:
    """How byte-level vocabularies write each byte: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {}, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], n = chr(n), n + 1
    return [out[b] for b in range(256)]


class Bpe:
    """Vocabulary, automaton and tables of one tokenizer file."""

    def __init__(self, spec: dict):
        m = spec["model"]
        suffix = m.get("end_of_word_suffix") or ""
        to_byte = {c: b for b, c in enumerate(byte_chars())}
        self.ends = bool(suffix)

        def symbols(token: str) -> str:
            if suffix and token.endswith(suffix):
                t = [to_byte[c] for c in token[: -len(suffix)]]
                return "".join(map(chr, t[:-1])) + chr(t[-1] + END)
            return "".join(chr(to_byte[c]) for c in token)

        self.vocab = {symbols(t): i for t, i in m["vocab"].items()}
        self.names = {i: t for t, i in m["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        split: dict[int, tuple[int, int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        for r, pair in enumerate(m["merges"]):
            a, b = (symbols(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            l, k = self.vocab[a], self.vocab[b]
            self.rank[(l, k)] = r
            split.setdefault(self.vocab[a + b], (r, l, k))
        self.split = split
        self.order = {i: split[i][0] if i in split else -1 for i in self.vocab.values()}
        self.size = {i: len(t) for t, i in self.vocab.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        # a token that its own symbols don't merge to is never the encoder's
        self.reachable = {i for i in self.vocab.values() if i not in split}
        for i, (r, l, k) in sorted(split.items(), key=lambda x: x[1]):
            if l in self.reachable and k in self.reachable and self.compatible(l, k, r):
                self.reachable.add(i)
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, i in self.vocab.items():
            if i in self.reachable:
                self.auto.add_word(t, i)
        self.auto.make_automaton()
        self.words: tuple[dict, dict] = ({}, {})

    def compatible(self, left: int, right: int, limit: int | None = None) -> bool:
        """No merge across the boundary comes before both sides are whole (limit: or before that rank)."""
        key = (left, right)
        if limit is None and (got := self.pairs.get(key)) is not None:
            return got
        rank, split, order = self.rank, self.split, self.order
        most = limit if limit is not None else 1 << 60
        a, b, ok = left, right, True
        while True:
            r = rank.get((a, b))
            if r is not None and r < most:
                ok = False
                break
            ra, rb = order[a], order[b]
            if ra < 0 and rb < 0:
                break
            if ra > rb:  # the left side's last merge came later: before it, its right part met b
                most = min(most, ra)
                a = split[a][2]
            else:  # of equal ranks the left one merges first
                most = min(most, rb + 1)
                b = split[b][1]
        if limit is None:
            if len(self.pairs) > 300_000:
                self.pairs.clear()
            self.pairs[key] = ok
        return ok

    def encode_symbols(self, s: str) -> list[int]:
        """The ids of one word."""
        if (i := self.vocab.get(s)) is not None and i in self.reachable:
            return [i]
        at: list[list[int]] = [[] for _ in s]  # tokens by start, short to long
        for end, i in self.auto.iter(s):
            at[end - self.size[i] + 1].append(i)
        out: list[int] = []
        dead = bytearray(len(s) + 1)
        pos, n = 0, len(s)
        tries = [len(at[0]) - 1]
        while pos < n:
            k, here = tries[-1], at[pos]
            while k >= 0:
                i = here[k]
                if not dead[pos + self.size[i]] and (not out or self.compatible(out[-1], i)):
                    break
                k -= 1
            if k >= 0:
                tries[-1] = k
                out.append(here[k])
                pos += self.size[here[k]]
                if pos < n:
                    tries.append(len(at[pos]) - 1)
            else:
                dead[pos] = 1
                tries.pop()
                if not out:
                    raise ValueError("a symbol is not in the vocabulary")
                pos -= self.size[out.pop()]
                tries[-1] -= 1
        return out

    def word(self, w: str) -> bytes:
        """One pre-token's ids as little-endian 32-bit integers."""
        new, old = self.words
        if (got := new.get(w)) is None:
            if (got := old.get(w)) is None:
                b = w.encode()
                s = "".join(map(chr, b[:-1])) + chr(b[-1] + END) if self.ends else "".join(map(chr, b))
                got = np.array(self.encode_symbols(s), "<u4").tobytes()
            if len(new) >= CACHE:
                self.words = ({}, new)
                new = self.words[0]
            new[w] = got
        return got


# The pattern of the word-level vocabulary's pre-tokenizer.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Below U+0558 and in General Punctuation up to U+206F this regex engine's classes and the library's agree; other text is cut by the library's own pre-tokenizer.
FOREIGN = re.compile(r"[^\x00-\u0557\u2000-\u206F]")


class WordTokenizer:
    """A lower-casing BPE tokenizer with word ends: NFC, white space, lower case, pattern, merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.bpe = Bpe(self.spec)
        self.pattern = regex.compile(WORD_PATTERN)
        special = sorted(self.bpe.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.library = None
        n = max(self.bpe.names) + 1
        names = [(self.bpe.names.get(i, "") + " ").encode() for i in range(n)]
        self.blob, self.offsets = np.frombuffer(b"".join(names), np.uint8), np.cumsum([0, *map(len, names)])
        digits = [b"%d " % i for i in range(n)]
        self.digits, self.digit_offsets = np.frombuffer(b"".join(digits), np.uint8), np.cumsum([0, *map(len, digits)])

    def pieces(self, text: str) -> list[str]:
        if text.isascii():
            return self.pattern.findall(text.lower())
        if FOREIGN.search(text):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_str(json.dumps(self.spec))
            norm = self.library.normalizer.normalize_str(text)
            return [norm[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(norm)]
        # lower-casing by character: no final sigma
        return self.pattern.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def encode(self, text: str | None) -> np.ndarray:
        """All ids of a text."""
        if not text:
            return np.zeros(0, "<u4")
        word, out = self.bpe.word, []
        for part in self.marks.split(text) if self.marks and "<|" in text else [text]:
            if part in self.bpe.special:
                out.append(self.bpe.special[part].to_bytes(4, "little"))
            elif part:
                got = list(map(self.bpe.words[0].get, ps := self.pieces(part)))
                if None in got:
                    got = [word(p) if g is None else g for g, p in zip(got, ps, strict=True)]
                out += got
        return np.frombuffer(b"".join(out), "<u4")

    @staticmethod
    def _gather(blob: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> bytes:
        parts = []
        for k in range(0, len(ids), 1 << 16):
            some = ids[k : k + (1 << 16)]
            n = offsets[some + 1] - offsets[some]
            parts.append(blob[np.repeat(offsets[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes())
        return b"".join(parts)

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' own strings, special ones too, joined by one space, as the library does without a decoder."""
        return self._gather(self.blob, self.offsets, ids.astype(np.int64))[:-1]

    def decimal(self, ids: np.ndarray) -> bytes:
        return self._gather(self.digits, self.digit_offsets, ids.astype(np.int64))[:-1]


def word_tokenizer(path: str) -> WordTokenizer:
    """One for each worker and file."""
    return resident(("words", path), lambda: WordTokenizer(path))


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows of docs with ids (array of int)."""

    def make():
        tok = word_tokenizer(path)

        def fn(batch):
            return [pa.array([tok.encode(t).astype(np.int32) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()], pa.list_(pa.int32()))]

        return fn

    return add_columns(docs, [T.StructField("ids", T.ArrayType(T.IntegerType()))], make, keep)


def decode(rows: DataFrame, path: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Rows with decoded, the text of the ids; null ids give the empty text."""

    def make():
        tok = word_tokenizer(path)

        def fn(batch):
            return [[tok.decode(np.array(x or [], np.int64)).decode() for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]]

        return fn

    return add_columns(rows, [T.StructField("decoded", T.StringType())], make, keep)


DIGEST = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


def digest(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows of docs with the digests of encoding and of decoding those ids again."""

    def make():
        tok = word_tokenizer(path)
        sha = lambda b: hashlib.sha256(b).hexdigest()

        def fn(batch):
            out = [[], [], []]
            for t in batch.column(batch.schema.get_field_index(text)).to_pylist():
                ids = tok.encode(t)
                out[0].append(len(ids))
                out[1].append(sha(tok.decimal(ids)))
                out[2].append(sha(tok.decode(ids)))
            return out

        return fn

    return add_columns(docs, DIGEST, make, keep)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digests for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(docs, default_path("word_bpe_49k.json"), keep=["doc_id"])
