"""Splitting oversized items at natural boundaries.

Items longer than their limit are cut recursively: into sections, a section too large into paragraphs, these into sentences,
words and at last characters. What comes out fits into a piece beside the overlap; it is packed greedily to the limit, and
every piece but the first begins with the last `overlap` characters of the one before. A piece that would stay under a quarter
of its room takes parts of the next section, paragraph or sentence as well. Among ends of the same rank in the last quarter of
the reach the last one is taken whose overlap begins at a word. Pieces are slices of the original text, so they cover it in
order; neither end nor start of one stands inside a grapheme, unless the whole reach is one.

Defined results: null text gives one piece with null text; an empty text one empty piece; an item without a limit (no row
for its type, null or non-positive limit) one piece; of several limits of a type the lowest counts, with the least overlap
given for it; an overlap as large as the limit is lowered to limit - 1;
repeated rows give repeated pieces; an empty table gives no rows. Lengths are in code points.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, map_columns, small_side, transposed

#: The separator hierarchy, strongest first; a cut is allowed at the end of a match (before it for headings).
LEVELS = (
    re.compile(r"\n+(?=#{1,6} |row=|[=*_-]{3,}\s*(?:\n|$))|\f|\n{3,}"),
    re.compile(r"\n[^\S\n]*\n\s*"),
    re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？｡۔؟।]+[」』”’）)\]]*\s*|\n"),
    re.compile(r"\s+|[、，,;；]"),
)
_JOINERS = "\u200d\ufe0f\ufe0e"
#: The level of single characters.
LAST = len(LEVELS)


def _natural(text: str, at: int) -> bool:
    """Whether a cut before text[at] keeps combining marks and joiners with their base."""
    return not 0 < at < len(text) or not (unicodedata.combining(text[at]) or text[at] in _JOINERS or text[at - 1] == "\u200d")


def _word_start(text: str, at: int) -> bool:
    return at <= 0 or text[at - 1].isspace() or not (text[at].isalnum() and text[at - 1].isalnum())


class _Cutter:
    """The boundaries of one text, each level searched for only when a span is too large for the level above."""

    def __init__(self, text: str, limit: int, overlap: int):
        self.text, self.limit, self.overlap = text, limit, overlap
        self.room = limit - overlap
        self.ends: list[list[int] | None] = [None] * LAST

    def _allowed(self, at: int) -> bool:
        return _natural(self.text, at) and _natural(self.text, at - self.overlap)

    def parts(self, start: int, end: int, level: int) -> list[tuple[int, int]]:
        """A span cut at the boundaries of one level, but for those that part a grapheme there or at the overlap's start."""
        if self.ends[level] is None:
            self.ends[level] = [e for e in (m.end() for m in LEVELS[level].finditer(self.text)) if self._allowed(e)]
        found = self.ends[level]
        at = [start, *found[bisect_right(found, start) : bisect_right(found, end - 1)], end]
        return list(zip(at, at[1:]))

    def _character(self, low: int, high: int) -> int:
        """The last character cut in (low, high]."""
        for fits in (self._allowed, lambda at: _natural(self.text, at)):
            at = high
            while at > low and not fits(at):
                at -= 1
            if at > low:
                return at
        return high

    def pieces(self) -> list[tuple[int, int]]:
        """Greedy packing. The stack holds the spans to come, the next one on top: start, end, the level at which it is cut if it
        is too large, and the level of the boundary at its end."""
        stack = [(0, len(self.text), 0, 0)]
        out: list[tuple[int, int]] = []
        start, end = 0, 0  # the piece so far
        ranks: dict[int, int] = {}  # where it could end, and the level of the boundary there
        while stack:
            a, b, level, rank = stack.pop()
            if b - start <= self.limit:
                end = b
                ranks[b] = rank
                continue
            own = end - start - self.overlap  # what the piece would leave behind it
            if level < LAST and (b - a > self.room or own < self.room / 4):
                parts = self.parts(a, b, level)
                stack += [(x, y, level + 1, level if y < b else rank) for x, y in reversed(parts)]
                continue
            stack.append((a, b, level, rank))
            if own <= 0 or (own < self.room / 4 and b - a > self.room):
                end = self._character(max(a, start + self.overlap), start + self.limit)
                stack[-1] = (end, b, level, rank)
            else:
                at = self._with_natural_start(ranks, start, end)
                if at < end:
                    stack.append((at, end, LAST - 1, ranks[end]))
                    end = at
            out.append((start, end))
            start, ranks = end - self.overlap, {}
        out.append((start, end))
        return out

    def _with_natural_start(self, ranks: dict[int, int], start: int, end: int) -> int:
        """The end, or an end as strong in the last quarter of the reach whose overlap begins at a word."""
        if self.overlap and not _word_start(self.text, end - self.overlap):
            for at in reversed(ranks):
                if end - at > self.limit // 4 or at - start <= self.overlap + self.room // 4:
                    break
                if ranks[at] <= ranks[end] and _word_start(self.text, at - self.overlap):
                    return at
        return end


def spans(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """The (start, end) of the pieces of one text."""
    if len(text) <= limit:
        return [(0, len(text))]
    return _Cutter(text, limit, max(0, min(overlap, limit - 1))).pieces()


def split_oversized(df: DataFrame, limits: DataFrame, *, text: str = "text", key: str = "chunk_key", item_id: str = "chunk_id", kind: str = "file_type") -> DataFrame:
    """Pieces of every item: key, item id, piece_id, piece_ord, n_pieces, start_char, end_char, piece_text.

    limits has one row per kind (kind, max_chars, overlap_chars) and is broadcast after its size is checked. Items within
    the limit never leave the JVM; only oversized ones go through the Arrow stage.
    """
    lowest = F.min(F.struct(F.col("max_chars").alias("_limit"), F.col("overlap_chars").alias("_overlap")))
    lim = limits.where(F.col("max_chars") > 0).groupBy(F.lower(F.trim(kind)).alias("_kind")).agg(lowest.alias("_l")).select("_kind", "_l.*")
    rows = df.select(F.col(key).alias("_key"), F.col(item_id).alias("_id"), F.col(text).alias("_text"), F.lower(F.trim(F.col(kind))).alias("_k"))
    rows = rows.join(small_side(lim), F.col("_k") == F.col("_kind"), "left").drop("_k", "_kind")
    over = (F.length("_text") > F.col("_limit")) & (F.col("_limit") > 0)
    key_type, id_type = df.schema[key].dataType.simpleString(), df.schema[item_id].dataType.simpleString()

    def cut(keys: list, ids: list, texts: list, limits: list, overlaps: list) -> list:
        out = []
        for k, i, t, limit, overlap in zip(keys, ids, texts, limits, overlaps):
            cuts = spans(t, limit, overlap or 0)
            out += [(k, i, n, len(cuts), s, e, t[s:e]) for n, (s, e) in enumerate(cuts)]
        return transposed(out, 7)

    large = map_columns(rows.where(over), lambda: cut, f"_key {key_type}, _id {id_type}, piece_ord int, n_pieces int, start_char int, end_char int, piece_text string")
    whole = rows.where(~F.coalesce(over, F.lit(False))).select("_key", "_id", F.lit(0).alias("piece_ord"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start_char"), F.coalesce(F.length("_text"), F.lit(0)).alias("end_char"), F.col("_text").alias("piece_text"))
    both = large.unionByName(whole)
    return both.select(F.col("_key").alias(key), F.col("_id").alias(item_id), F.concat(F.col("_id").cast("string"), F.format_string("#%04d", "piece_ord")).alias(free_name(df, "piece_id")), "piece_ord", "n_pieces", "start_char", "end_char", "piece_text")


def rebuilt(pieces: DataFrame, *, key: str = "chunk_key") -> DataFrame:
    """The text of every item put together again from its pieces: key, n_pieces, text; overlaps are taken once.

    A task holds one item's pieces at a time, which are as long as the item. Rows of one key with the same piece number
    (repeated rows) count once.
    """
    listed = F.array_sort(F.collect_set(F.struct("piece_ord", "start_char", "end_char", "piece_text")))
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.element_at("_p", i)["end_char"])
    fresh = lambda p, i: F.substr(p["piece_text"], before(i) - p["start_char"] + 1)
    split = pieces.where("n_pieces > 1").groupBy(key).agg(listed.alias("_p"))
    split = split.select(key, F.size("_p").alias("n_pieces"), F.array_join(F.transform("_p", fresh), "").alias("text"))
    return pieces.where("n_pieces = 1").select(key, "n_pieces", F.col("piece_text").alias("text")).unionByName(split)
