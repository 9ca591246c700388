"""Text functions as Column expressions; they fuse into one projection and never leave the JVM, but for rare characters."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from . import plain

#: One pattern for any of the endings at the end; alternatives that end alike stand with the longer first, as the fixed order has them.
SUFFIX_PATTERN = f"(?:{'|'.join(plain.SUFFIXES)})$"
#: Java's \s is ASCII only.
BLANK = r"[\s\u0085   -     　\x1c-\x1f]"


@lru_cache(maxsize=2)
def tables(lowercase: bool = True) -> tuple[str, str, str]:
    """(from, to) for translate(), and the characters that turn into several letters or digits.

    Made from a rule: each character above ASCII in lower case (if so switched), compatibility form, without combining marks, reduced to what
    normalisation keeps. Characters that turn into nothing stand last in `from`, beyond the end of `to`.
    """
    one, many, gone = {}, [], []
    kept = frozenset("abcdefghijklmnopqrstuvwxyz0123456789'- ")
    for o in range(0x80, 0x30000):
        c = chr(o)
        if 0xD800 <= o < 0xE000 or unicodedata.category(c) in ("Cn", "Co"):
            continue
        lower = c.lower() if lowercase else c
        form = plain.fold(lower)
        if form == c or "가" <= c <= "힣":
            continue
        reduced = "".join(x if x in kept else " " for x in form)
        if not form:
            gone.append(c)
        elif len(form) == 1 and reduced != " ":
            one[c] = reduced
        elif reduced.strip():
            many.append(c)
    return "".join((*one, *gone)), "".join(one.values()), "".join(many)


@arrow_udf(StringType())
def _normalize_rare(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([None if t is None else plain.normalize(t) for t in batch.to_pylist()], pa.string())


def unite(text: Column) -> Column:
    """Kinds of apostrophes and of dashes united."""
    return F.translate(text, plain.APOSTROPHES + plain.DASHES, "'" * len(plain.APOSTROPHES) + "-" * len(plain.DASHES))


def normalize(text: Column, lowercase: bool = True, strip_accents: bool = True, collapse_whitespace: bool = True, normalize_apostrophes: bool = True, normalize_dashes: bool = True, rare: bool = True) -> Column:
    """The normalised text; null gives the empty text. With all switches on, texts with a character that turns into several
    go through an Arrow function; rare=False leaves such characters to become blanks and stays in the JVM altogether."""
    value = F.coalesce(text, F.lit(""))
    source, target, many = tables(lowercase)
    every = lowercase and strip_accents and collapse_whitespace and normalize_apostrophes and normalize_dashes
    if normalize_apostrophes:
        value = F.translate(value, plain.APOSTROPHES, "'" * len(plain.APOSTROPHES))
    if normalize_dashes:
        value = F.translate(value, plain.DASHES, "-" * len(plain.DASHES))
    if lowercase:
        value = F.lower(value)
    if strip_accents:
        value = F.translate(value, source, target)
    value = F.regexp_replace(value, r"[^a-z0-9\s'-]+", " ")
    if collapse_whitespace:
        value = F.btrim(F.regexp_replace(value, r"\s+", " "))
    if every and rare:
        # Java tests a class of many characters one by one, so ASCII is ruled out first.
        value = F.coalesce(_normalize_rare(F.when(text.rlike(f"[\\x{{80}}-\\x{{10ffff}}&&[{many}]]"), text)), value)
    return value


def tokens(norm: Column) -> Column:
    return F.regexp_extract_all(norm, F.lit("([a-z0-9']+)"), F.lit(1))


def root(token: Column) -> Column:
    """See plain.root; the first 4 letters are beyond any ending's reach."""
    word = F.regexp_replace(token, "^'+|'+$", "")
    cut = F.concat(F.substring(word, 1, 4), F.regexp_replace(F.substring(word, 5, 1_000_000), SUFFIX_PATTERN, ""))
    return F.substring(cut, 1, plain.ROOT_LENGTH)


def roots(tokens_: Column) -> Column:
    return F.transform(tokens_, root)


def sentences(text: Column) -> Column:
    """Array of the non-blank sentences, stripped."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), rf"(?<=[.!?\n;]){BLANK}+"), strip)
    return F.filter(parts, lambda s: s != "")


@arrow_udf(ArrayType(StructType().add("start_char", IntegerType()).add("end_char", IntegerType())))
def _spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("start_char", pa.int32()), ("end_char", pa.int32())]))
    for batch in batches:
        yield pa.array([[{"start_char": a, "end_char": b} for a, b in plain.spans(t or "")] for t in batch.to_pylist()], kind)


def sentence_spans(text: Column) -> Column:
    """Array of (start_char, end_char) of the sentences; in one pass over the text, which array functions could not keep linear."""
    return _spans(text)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+$", "")


def ngrams(tokens_: Column, low: int, high: int) -> Column:
    """Array of (n, pos, gram) of all runs of low to high tokens."""
    def of(n: int) -> Column:
        count = F.size(tokens_) - (n - 1)
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(F.lit(n).alias("n"), i.alias("pos"), F.concat_ws(" ", F.slice(tokens_, i + 1, n)).alias("gram")))).otherwise(F.array())

    return F.concat(*(of(n) for n in range(low, high + 1)))


@lru_cache(maxsize=1)
def _ties() -> str:
    """For scores in steps of 0.0001: whether 0.qq50 is shown as 0.qq + 0.01, by exact binary value."""
    return "".join("1" if f"{(q * 100 + 50) / 10000:.2f}" != f"{q / 100:.2f}" else "0" for q in range(100)) + "0"


def two_places(score: Column) -> Column:
    """A score in [0, 1] of four places as text of two, rounded by its exact binary value."""
    n = F.round(score * 10_000).cast("int")
    q, r = F.floor(n / 100).cast("int"), n % 100
    up = F.when((r > 50) | ((r == 50) & (F.substring(F.lit(_ties()), q + 1, F.lit(1)) == "1")), 1).otherwise(0)
    v = q + up
    return F.concat(F.floor(v / 100).cast("string"), F.lit("."), F.lpad((v % 100).cast("string"), 2, "0"))
