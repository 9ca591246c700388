"""One consistent form for text that looks the same but differs in its characters.

A mapping is computed once from rules (compatibility forms of wide, half-wide, ligature and styled letters; kinds of blanks;
invisible characters; kinds of hyphens; characters with a canonical equal; letters with accents apart; look-alike letters) and
checked for conflicts: no key may map to two forms and no form may hold a key, so that applying it again changes nothing. It is
compiled into a transducer over grapheme clusters: one pattern finds words and signs that hold anything to map, each is read
cluster by cluster, and each cluster is rewritten by the longest entry that fits, what is left of it by the next. The entries of
clusters with accents follow from the rules when a cluster is first met and are kept.

Look-alike letters of another script are rewritten at the end of their word, when it is known whether the word also holds Latin
letters, or consists of nothing but look-alikes in a text with Latin letters and without other letters of that script; so real
Cyrillic or Greek is left alone. What a letter is, is judged by what it is rewritten to.

Kept apart: letter case, accents, line breaks, the number of blanks. Joiners are invisible and go; with joiners=True they stay
where they show, between letters of scripts that are written joined and inside emoji. Rows without anything to map never leave
the JVM.

Defined results: null stays null, empty stays empty; repeated rows with the same characters are no pair; an empty table gives
no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from .common import cut_lineage

BLANKS = "               　"
INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩︎️﻿"
HYPHENS = "‐‑‒–—―−⁃﹘﹣－"
# Letters that look like a Latin letter, each below the one it looks like, by script.
SCRIPTS = {
    "CYRILLIC": ("АВЕЅІЈКМНОРСТУХаеорсухіјѕһԁԛԝӏҮѵԌԚԜ", "ABESIJKMHOPCTYXaeopcyxijshdqwlYvGQW"),
    "GREEK": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιϲϳϹͿ", "ABEZHIKMNOPTYXovicjCJ"),
    "ARMENIAN": ("օսհոզցՕՍ", "ouhnqgOU"),
    "CHEROKEE": ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"),
}
#: The letters of each script.
BLOCKS = {"CYRILLIC": (*range(0x400, 0x530),), "GREEK": (*range(0x370, 0x400), *range(0x1F00, 0x2000)), "ARMENIAN": (*range(0x531, 0x590),), "CHEROKEE": (*range(0x13A0, 0x1400),)}
#: Blocks whose characters take their compatibility form.
COMPATIBLE = ((0xFF01, 0xFF60), (0xFF61, 0xFF9F), (0xFFE0, 0xFFE6), (0xFB00, 0xFB06), (0xFB13, 0xFB17), (0xFB50, 0xFDFB), (0xFE70, 0xFEFC), (0x1D400, 0x1D7FF), (0x2100, 0x214F), (0x2160, 0x217F), (0x2460, 0x24EA), (0x2F00, 0x2FD5), (0x3200, 0x33FF), (0x0132, 0x0133), (0x01C4, 0x01CC), (0x2024, 0x2026), (0x2033, 0x2034))


def compile_table() -> dict[str, str]:
    """Single characters and their form, apart from look-alikes; raises on a conflict."""
    table: dict[str, str] = {}

    def add(key: str, form: str) -> None:
        if table.setdefault(key, form) != form:
            raise ValueError(f"two forms for U+{ord(key):04X}")

    for c in HYPHENS:
        add(c, "-")
    for c in BLANKS:
        add(c, " ")
    for c in INVISIBLE:
        add(c, "")
    for first, last in COMPATIBLE:
        for o in range(first, last + 1):
            form = unicodedata.normalize("NFKC", chr(o))
            # A letter beside a sign, as in a/c, would part the word it stands in.
            parts_word = (form[0].isalnum() or form[-1].isalnum()) and not all(x.isalnum() or unicodedata.combining(x) for x in form)
            if form != chr(o) and chr(o) not in table and unicodedata.category(chr(o)) != "Cn" and not parts_word:
                add(chr(o), "".join(table.get(x, x) for x in form))
    for o in range(0x80, 0x30000):
        form = unicodedata.normalize("NFC", chr(o))
        if form != chr(o) and chr(o) not in table and not 0xD800 <= o < 0xE000:
            add(chr(o), "".join(table.get(x, x) for x in form))
    for key, form in table.items():
        if any(x in table for x in form):
            raise ValueError(f"U+{ord(key):04X} maps to something that is mapped again")
    return table


TABLE = compile_table()


def compile_alike() -> dict[str, dict[str, str]]:
    """By script its look-alikes: the listed letters, and each of them with accents."""
    out = {}
    for script, (letters, latin) in SCRIPTS.items():
        out[script] = dict(zip(letters, latin))
        for c in map(chr, BLOCKS[script]):
            base, *marks = unicodedata.normalize("NFD", c)
            if marks and base in letters and c not in TABLE:
                out[script][c] = unicodedata.normalize("NFC", out[script][base] + "".join(marks))
    return out


ALIKES = compile_alike()
ALIKE = {a: b for pairs in ALIKES.values() for a, b in pairs.items()}
if set(ALIKE) & set(TABLE) or set(ALIKE.values()) & (set(TABLE) | set(ALIKE)):
    raise ValueError("look-alikes conflict with the table")


def composing_marks() -> str:
    """Characters that can unite with the one before them."""
    out = set()
    for o in range(0xC0, 0x30000):
        parts = unicodedata.decomposition(chr(o))
        if parts and not parts.startswith("<") and " " in parts and not 0xAC00 <= o < 0xD7A4:
            first, second = (chr(int(x, 16)) for x in parts.split())
            if unicodedata.normalize("NFC", first + second) == chr(o):
                out.add(second)
    return "".join(sorted(out))


def ranges(chars) -> str:
    """The characters as the inside of a character class, in escapes that Python and Java both read."""
    esc = lambda o: f"\\u{o:04x}" if o < 0x10000 else None
    codes, out = sorted(set(map(ord, chars))), []
    start = previous = None
    for o in [*codes, None]:
        if o is not None and previous is not None and o == previous + 1:
            previous = o
            continue
        if start is not None:
            out.append(chr(start) + ("-" + chr(previous) if previous > start else "") if esc(start) is None else esc(start) + ("-" + esc(previous) if previous > start else ""))
        start = previous = o
    return "".join(out)


#: Marks that can unite with a letter, that a form ends in, or that are set on Latin letters.
MARKS = ranges(set(composing_marks()) | {x for form in TABLE.values() for x in form if unicodedata.category(x)[0] == "M"} | set(map(chr, [*range(0x300, 0x370), *range(0x1AB0, 0x1AFF), *range(0x20D0, 0x20F1)])))
_SPECIAL = ranges(set(TABLE) | set(ALIKE)) + MARKS
#: Whether a text holds anything to map; for the JVM ASCII is ruled out first, as it tests ranges one by one.
NEEDS = f"[{_SPECIAL}]"
NEEDS_JVM = f"[\\x{{80}}-\\x{{10ffff}}&&{NEEDS}]|\\p{{Mn}}\\p{{Mn}}|[\\x{{1100}}-\\x{{11ff}}]"
_BREAKS = ranges({c for c in TABLE if TABLE[c] and not TABLE[c][0].isalnum() and not unicodedata.combining(TABLE[c][0])})
_JAMO = "\u1100-\u1112\u1161-\u1175\u11a8-\u11c2"
#: Words with something to map, and single signs.
_RUN = re.compile(rf"[{_BREAKS}][{MARKS}]*|(?<![^\W_])(?:(?:(?![{_SPECIAL}])[^\W_])*+(?![{_BREAKS}])[{_SPECIAL}])+(?:(?![{_SPECIAL}])[^\W_])*+|[^\w\s]?[{MARKS}]+|[{_SPECIAL}]|[{_JAMO}]{{2,}}")
_INVISIBLE = ranges(INVISIBLE)
_CLUSTER = re.compile(rf"[{_JAMO}]+|.[{MARKS}{_INVISIBLE}]*", re.S)
_OTHER = {script: re.compile("[%s]" % ranges({chr(o) for o in BLOCKS[script] if chr(o).isalpha() and chr(o) not in pairs and chr(o) not in TABLE})) for script, pairs in ALIKES.items()}
_THERE = {script: re.compile(f"[{ranges(pairs)}]") for script, pairs in ALIKES.items()}
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]")
_FOREIGN = re.compile(f"[{ranges(ALIKE)}]")


class _Entries(dict):
    """What the transducer writes for a cluster; entries follow from the rules when first met, at most 100,000 are kept."""

    def __init__(self, letters: dict[str, str]):
        super().__init__()
        self.letters = letters

    def __missing__(self, cluster: str) -> str:
        out = unicodedata.normalize("NFC", "".join([self.letters.get(c, c) for c in cluster]))
        if len(self) < 100_000:
            self[cluster] = out
        return out


_FORMS = _Entries(TABLE)
_AS_LATIN = {script: _Entries(pairs) for script, pairs in ALIKES.items()}


def canonical(text: str, joiners: bool = False, alike: bool = True) -> str:
    """The consistent form of one text; with alike=False letters of other scripts stay."""
    if joiners and _SHOWN.search(text):
        return "".join([p if n % 2 else canonical(p, alike=alike) for n, p in enumerate(_SHOWN.split(text))])
    alone: dict[str, bool] = {}

    def only_alike(script: str) -> bool:
        """Whether the text has Latin letters and no other letters of the script, once its clusters are rewritten."""
        if script not in alone:
            if "" not in alone:
                plain = "".join(map(_FORMS.__getitem__, _CLUSTER.findall(text)))
                alone[""] = bool(_LATIN.search(plain))
                alone.update((s, alone[""] and not other.search(plain)) for s, other in _OTHER.items())
        return alone[script]

    def rewrite(m: re.Match) -> str:
        run = m.group()
        if len(run) == 1 and not _FOREIGN.search(TABLE.get(run, run)):
            return TABLE.get(run, run)
        forms = [_FORMS[c] for c in _CLUSTER.findall(run)]
        word = "".join(forms)
        if alike and _FOREIGN.search(word):
            pending = [s for s, there in _THERE.items() if there.search(word)]
            changed = True
            while changed and pending:
                changed = False
                for script in pending:
                    if not _OTHER[script].search(word) and (_LATIN.search(word) or only_alike(script)):
                        forms = [_AS_LATIN[script][c] for c in _CLUSTER.findall(word)]
                        word, changed = "".join(forms), True
                        pending.remove(script)
                        break
        return word

    out = _RUN.sub(rewrite, text)
    # Marks of several kinds after one letter can stand in another order than the canonical one.
    return out if out.isascii() or unicodedata.is_normalized("NFC", out) else unicodedata.normalize("NFC", out)


#: Joiners that show: between letters of joined scripts, and between the parts of an emoji.
_SHOWN = re.compile("((?<=[\u0600-\u06ff\u0900-\u0dff\u1780-\u17ff\u1800-\u18af])[\u200c\u200d](?=[\u0600-\u06ff\u0900-\u0dff\u1780-\u17ff\u1800-\u18af])|(?<=[\u2600-\u27bf\ufe0f\U0001f000-\U0001faff])\u200d(?=[\u2600-\u27bf\U0001f000-\U0001faff]))")


def _udf(joiners: bool, alike: bool) -> Callable[[Column], Column]:
    @arrow_udf(StringType())
    def form(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if t is None else canonical(t, joiners, alike) for t in batch.to_pylist()], pa.string())

    return form


def canonical_text(text: Column, joiners: bool = False, alike: bool = True) -> Column:
    """The consistent form of a column; only texts with something to map are sent to Python."""
    return F.coalesce(_udf(joiners, alike)(F.when(text.rlike(NEEDS_JVM), text)), text)


def look_alike_classes(df: DataFrame, *, key: str, text: str = "text") -> DataFrame:
    """The rows whose form occurs in several spellings: the key, class_id, spelling_id, and how many rows and spellings there are.

    class_id is the smallest key of the class, spelling_id the smallest key of the rows with the same characters: each spelling
    has one representative, all other rows of it are members, so that a class of any size has as many rows as the table. Rows
    are reduced to a key and two 128-bit hashes; spellings are counted with partial sums before anything is exchanged.
    """
    form = canonical_text(F.col(text))
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("_id"), form.alias("_form"), F.col(text).alias("_text"))
    rows = rows.select("_id", F.xxhash64("_form").alias("_f1"), F.xxhash64(F.lit(1), "_form").alias("_f2"), F.xxhash64("_text").alias("_s1"), F.xxhash64(F.lit(1), "_text").alias("_s2"))
    rows = cut_lineage(rows)
    ids = ["_f1", "_f2", "_s1", "_s2"]
    spellings = rows.groupBy(*ids).agg(F.min("_id").alias("spelling_id"), F.count(F.lit(1)).alias("_n"))
    classes = spellings.groupBy("_f1", "_f2").agg(F.min("spelling_id").alias("class_id"), F.count(F.lit(1)).alias("spellings"), F.sum("_n").alias("rows")).where("spellings > 1")
    named = spellings.join(classes, ["_f1", "_f2"]).select(*ids, "class_id", "spelling_id", "rows", "spellings")
    return rows.join(named, ids).select(F.col("_id").alias(key), "class_id", "spelling_id", "rows", "spellings")


def look_alikes(df: DataFrame, *, key: str, text: str = "text") -> DataFrame:
    """Pairs id_a < id_b of rows whose text has the same consistent form but not the same characters.

    The classes, spelt out: as many pairs as rows of different spellings meet. Where a class is large, use look_alike_classes,
    which loses no link and has one row per row. Copies with the same characters are never paired.
    """
    members = look_alike_classes(df, key=key, text=text).select(F.col(key).alias("_id"), F.col("class_id").alias("_class"), F.col("spelling_id").alias("_spelling"))
    members = cut_lineage(members)
    other = members.select("_class", F.col("_id").alias("_id2"), F.col("_spelling").alias("_spelling2"))
    pairs = members.join(other, "_class").where(F.col("_spelling") < F.col("_spelling2"))
    return pairs.select(F.least("_id", "_id2").alias("id_a"), F.greatest("_id", "_id2").alias("id_b"))
