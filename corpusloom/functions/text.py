"""Text functions as Column expressions; Python only for what the JVM has no function for."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed


@F.pandas_udf(T.StringType())
def unescape_nfkc(s: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """HTML entities resolved, then Unicode NFKC; null stays null."""
    for part in s:
        yield part.map(lambda t: t if t is None or (t.isascii() and "&" not in t) else unicodedata.normalize("NFKC", html.unescape(t)))


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def remove_zero_width(c: Column) -> Column:
    return F.translate(c, fixed.ZERO_WIDTH, "")


def remove_urls(c: Column) -> Column:
    """Whole addresses, and a bare 'http' with the ASCII words after it."""
    return F.regexp_replace(c, "(?iU)" + fixed.URL, " ")


def remove_emails(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)" + fixed.EMAIL, " ")


def remove_mentions(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)" + fixed.MENTION, " ")


def punctuation_to_space(c: Column) -> Column:
    """Every character of a Unicode P or S category."""
    return F.regexp_replace(c, r"[\p{P}\p{S}]", " ")


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def _where(c: Column, marks: Iterable[str], change: Callable[[Column], Column]) -> Column:
    """change(c) for texts with one of the marks, without which it has nothing to find; c stands once in the expression."""
    return F.transform(F.array(c), lambda x: F.when(reduce(Column.__or__, (x.contains(m) for m in marks)), change(x)).otherwise(x))[0]


def normalize(c: Column) -> Column:
    """The duplicate audit's normal form; null counts as empty text."""
    s = F.lower(_where(unescape_nfkc(F.coalesce(c, F.lit(""))), fixed.ZERO_WIDTH, remove_zero_width))
    s = _where(_where(s, ("http", "www."), remove_urls), "@", lambda x: remove_mentions(remove_emails(x)))
    return collapse_space(punctuation_to_space(s))


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def tokens(c: Column) -> Column:
    """White-space tokens; none for blank text."""
    return F.filter(F.split(collapse_space(c), " "), lambda t: t != "")


def token_count(c: Column) -> Column:
    return F.size(tokens(c)).cast("long")


def token_jaccard(a: Column, b: Column) -> Column:
    """Of token sets; 1 if both are empty."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def length_ratio(a: Column, b: Column) -> Column:
    """Shorter over longer; 1 if both are empty."""
    return ratio(F.length(a), F.length(b))


def ratio(x: Column, y: Column) -> Column:
    """Smaller over larger; 1 if both are 0."""
    return F.when(F.greatest(x, y) == 0, 1.0).otherwise(F.try_divide(F.least(x, y), F.greatest(x, y)))


_cascade = [(k, re.compile(rf"\b{re.escape(k)}\b"), v) for k, v in fixed.ABBREVIATIONS.items()]
_emoji = re.compile(fixed.EMOJI)


def clean_legacy_text(text: str | None) -> str:
    """NFC, lower case, abbreviations in order, links, tags, emoji and white space; empty for null."""
    if not text:
        return ""
    text = unicodedata.normalize("NFC", text).lower().strip()
    for key, pattern, value in _cascade:
        if key in text:
            text = pattern.sub(value, text)
    for pattern, value in ((r"http\S+", " "), (r"[@#]\w+", " "), (r"\bhttps\b", " "), (r"\bhttp\b", " "), (r"\bper\b", "")):
        text = re.sub(pattern, value, text)
    return re.sub(r"\s+", " ", _emoji.sub("", text)).strip()


@F.pandas_udf(T.StringType())
def clean_legacy(s: pd.Series) -> pd.Series:
    """One Python pass instead of a plan of 180 chained replacements."""
    return s.map(clean_legacy_text)


def keep_words(toks: Column, stopwords: Column | None = None) -> Column:
    """Tokens of letters (underscores apart) longer than one character, without stop words."""
    good = F.filter(toks, lambda t: F.regexp_replace(t, "_", "").rlike(r"^\p{L}+$") & (F.length(t) > 1))
    return good if stopwords is None else F.filter(good, lambda t: ~F.array_contains(stopwords, t))


def first_sentence(sentences: Column) -> Column:
    """What the tf-idf branch keeps of segmented text."""
    return F.coalesce(F.get(sentences, F.lit(0)), F.lit(""))


def topic_tokens(c: Column) -> Column:
    """Array of (token, reason): one_character, pure_number, web_residue or kept, the first that holds."""
    return F.transform(
        tokens(c),
        lambda t: F.struct(
            F.lower(t).alias("token"),
            F.when(F.length(t) < 2, "one_character").when(t.rlike("(?U)" + fixed.PURE_NUMBER), "pure_number").when(F.lower(t).isin(fixed.WEB_RESIDUE), "web_residue").otherwise("kept").alias("reason"),
        ),
    )


def word_ngrams(toks: Column, lo: int = 1, hi: int = 2) -> Column:
    """Runs of lo to hi tokens, joined by spaces, shorter ones first."""

    def build(ts):
        one = lambda n: F.when(F.size(ts) >= n, F.transform(F.sequence(F.lit(1), F.size(ts) - n + 1), lambda i: F.array_join(F.slice(ts, i, n), " "))).otherwise(F.array().cast("array<string>"))
        return F.concat(*[one(n) for n in range(lo, hi + 1)])

    # bound to a lambda's variable, the tokens are evaluated once and not for every run
    return F.get(F.transform(F.array(toks), build), F.lit(0))


def slug(c: Column) -> Column:
    """A model name as a folder name."""
    c = F.replace(F.lower(c), F.lit("+"), F.lit("plus"))
    return F.translate(c, " -()", "__")


def canonical_json(names: list[str]) -> Column:
    """The columns as a compact JSON object with its keys in order; nulls are written."""
    return F.to_json(F.struct(*[F.col(n) for n in sorted(names)]), {"ignoreNullFields": "false"})


def canonical_hash(names: list[str]) -> Column:
    return sha256(canonical_json(names))


def resolve_aliases(c: Column, aliases: dict[str, str], everything: list[str]) -> Column:
    """Names of a comma-separated list by their aliases, each once, in order of first mention; 'all' stands for everything.

    An unknown name fails the row.
    """
    known = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    pieces = F.filter(F.transform(F.split(F.lower(c), ","), lambda p: F.trim(p)), lambda p: p != "")
    named = F.transform(pieces, lambda p: F.coalesce(known[p], F.raise_error(F.concat(F.lit("unknown name "), p))))
    return F.when(F.array_contains(pieces, "all"), F.array(*[F.lit(e) for e in everything])).otherwise(F.array_distinct(named))


def pad_ids(ids: Column, size: int = 150) -> Column:
    """Cut at size, or zeros after."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(0).cast("long"), size)), 1, size)


def log_bin(chars: Column, ratio: float) -> Column:
    """floor(log1p(chars) / ln(ratio))."""
    return F.floor(F.log1p(chars.cast("double")) / F.log(F.lit(ratio))).cast("long")


def span_text(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)
