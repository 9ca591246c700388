"""Weighted similarity ratio of short strings, and the bound that lets hopeless pairs stay in the JVM.

The definition is the public one of the usual string matching libraries: the Indel ratio, its partial form (best window of the
longer string), and both over sorted and shared tokens, weighted by how different the lengths are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType

from hushlens.config import Term


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & where.get(c, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200.0 * lcs(a, b) / total if total else 100.0


def partial(a: str, b: str) -> float:
    """Best ratio of the shorter string with a window of its length in the longer, windows cut off at the ends included."""
    if len(a) > len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if not n:
        return 0.0 if m else 100.0
    best = 0.0
    for i in range(1 - n, m):
        window = b[max(0, i) : min(m, i + n)]
        best = max(best, ratio(a, window))
        if best == 100.0:
            break
    if n == m and best < 100.0:
        for i in range(1 - n, n):
            best = max(best, ratio(b, a[max(0, i) : min(n, i + n)]))
    return best


def _split(a: str, b: str) -> tuple[str, str, str]:
    x, y = set(a.split()), set(b.split())
    return " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    both, only_a, only_b = _split(a, b)
    if both and (not only_a or not only_b):
        return 100.0
    first = f"{both} {only_a}".strip()
    second = f"{both} {only_b}".strip()
    best = ratio(first, second)
    if both:
        best = max(best, ratio(both, first), ratio(both, second))
    return best


def partial_tokens(a: str, b: str) -> float:
    both, only_a, only_b = _split(a, b)
    if both:
        return 100.0
    return max(partial(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), partial(only_a, only_b))


@lru_cache(maxsize=200_000)
def wratio(a: str, b: str) -> float:
    """Weighted ratio of two non-empty strings, 0 to 100."""
    if not a or not b:
        return 0.0
    longer, shorter = max(len(a), len(b)), min(len(a), len(b))
    best = ratio(a, b)
    if longer / shorter < 1.5:
        return max(best, 0.95 * max(token_sort(a, b), token_set(a, b)))
    scale = 0.9 if longer / shorter <= 8.0 else 0.6
    best = max(best, scale * partial(a, b))
    return max(best, 0.95 * scale * partial_tokens(a, b))


@arrow_udf(DoubleType())
def weighted_ratio(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for a, b in batches:
        yield pa.array([wratio(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())


#: Every character of normalised text but the blank; one bit each tells which occur in a string.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789'-"


def letters(text: Column) -> Column:
    """Bits of the characters that occur. Inserting or deleting a character changes one bit at most, so two strings differ in no
    more bits than their Indel distance, in whatever order their words stand."""
    out = F.lit(0).cast("long")
    for i, c in enumerate(ALPHABET):
        out = out.bitwiseOR(F.when(F.contains(text, F.lit(c)), F.lit(1 << i)).otherwise(F.lit(0).cast("long")))
    return out


def _letters(text: str) -> int:
    return sum(1 << i for i, c in enumerate(ALPHABET) if c in text)


def word_bits(words: Column) -> Column:
    """One of 64 bits for each word, by its hash: lists without a bit in common have no word in common."""
    bit = lambda w: F.lit(1).cast("long") * F.pow(F.lit(2.0), F.pmod(F.xxhash64(w), F.lit(62))).cast("long")
    return F.aggregate(words, F.lit(0).cast("long"), lambda s, w: s.bitwiseOR(bit(w)))


def possible_pairs(grams: DataFrame, terms: Sequence[Term], threshold: float, delta: int) -> DataFrame:
    """Runs joined to the terms with which their weighted ratio may reach the threshold: the columns of grams, term_id, norm.

    A pair is kept if its run has a length in tokens within delta of the term's and enough characters, and if one of these
    holds: the Indel ratio can reach the threshold (Levenshtein is at most the Indel distance); so can the token sort ratio
    after the weight 0.95; a token is shared; or the lengths differ by half and the partial ratio counts. Nothing that can
    reach the threshold is lost; for a threshold of 85.5 or less the last case is not narrowed at all. Distances are only
    computed for pairs that the bits of their letters let through, a few machine operations a pair.
    """
    spark = grams.sparkSession
    rows = [(k, t.norm, " ".join(sorted(t.tokens)), list(t.tokens), max(1, len(t.tokens)), len(t.norm), len(t.norm.replace(" ", "")), _letters(t.norm), len(" ".join(set(t.tokens)))) for k, t in enumerate(terms)]
    table = spark.createDataFrame(rows, "term_id int, norm string, _tsorted string, _twords array<string>, _size int, _tchars int, _tletters int, _tbits long, _tset int")
    table = table.withColumn("_thashed", word_bits(F.col("_twords")))
    sizes = table.select("*", F.explode(F.sequence(F.greatest(F.lit(1), F.col("_size") - delta), F.greatest(F.lit(1), F.col("_size") + delta))).alias("n"))
    g = grams.withColumn("_words", F.split("gram", " "))
    g = g.withColumns({
        "_chars": F.length("gram"), "_letters": F.length("gram") - (F.col("n") - 1), "_bits": letters(F.col("gram")), "_hashed": word_bits(F.col("_words")),
        "_sorted": F.array_join(F.array_sort("_words"), " "), "_set": F.length(F.array_join(F.array_distinct("_words"), " ")),
    })
    pairs = g.join(F.broadcast(sizes), "n").where(F.col("_letters") >= F.greatest(F.lit(4), F.col("_tletters") - 2))
    total = F.col("_chars") + F.col("_tchars")
    near = F.ceil(total * (1 - threshold / 100) + 1e-9).cast("int")
    near_sorted = F.ceil(total * (1 - min(1.0, threshold / 95)) + 1e-9).cast("int")
    apart = F.lit(True)
    if threshold > 85.5 and threshold / 0.9 > 95:
        # Only 0.9 * partial can count. A partial ratio of p needs 2 * lcs / (n + w) >= p for a window of w <= n characters;
        # with fewer than (2 - p) / (2 - 2p) characters, one missing is too many, so the shorter is a substring.
        short = F.least("_chars", "_tchars")
        inside = F.contains(F.col("gram"), F.col("norm")) | F.contains(F.col("norm"), F.col("gram"))
        p = threshold / 90
        apart = (inside | (short >= (2 - p) / (2 * (1 - p)) - 1e-9) if p < 1 else inside)
    # A bound on every distance that can count, so that the distance is only computed near the diagonal; beyond it is -1.
    bound = int(2.5 * max((len(t.norm) for t in terms), default=0) * (1 - min(1.0, threshold / 100)) + 2)
    distance = lambda x, y: F.pmod(F.levenshtein(x, y, bound), F.lit(10_000))
    gap = F.abs(F.col("_chars") - F.col("_tchars"))
    differ = F.bit_count(F.col("_bits").bitwiseXOR(F.col("_tbits")))
    several = (F.col("n") > 1) | (F.col("_size") > 1)
    same_order = (gap <= near) & (differ <= near) & (distance(F.col("gram"), F.col("norm")) <= near)
    alike = differ <= near_sorted
    any_order = alike & (gap <= near_sorted) & (distance(F.col("_sorted"), F.col("_tsorted")) <= near_sorted)
    # With words in common the rest may be as alike, or the common words may be nearly all of one side.
    common = F.length(F.array_join(F.array_intersect("_words", "_twords"), " "))
    least = F.lit(min(1.0, threshold / 95) - 1e-9)
    most = (2 * common >= least * (common + F.col("_set"))) | (2 * common >= least * (common + F.col("_tset")))
    shared = (F.col("_hashed").bitwiseAND(F.col("_thashed")) != 0) & F.arrays_overlap("_words", "_twords") & (alike | most)
    far = F.greatest("_chars", "_tchars") >= 1.5 * F.least("_chars", "_tchars")
    keep = (~far & (same_order | (several & (any_order | shared)))) | (far & apart)
    return pairs.where(keep).select(*grams.columns, "term_id", "norm")
