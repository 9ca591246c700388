"""Text decoded with the wrong character encoding: finding and repairing it by minimum description length.

A chain is a guess of what went wrong: bytes of one encoding were read as another, once or twice. Undoing a chain gives a
candidate text. Every candidate is compressed with zstandard dictionaries, one per language, and costs its shortest length in
bits plus the cost of its chain; the text as it stands costs its own shortest length. The cheapest wins; ties and anything not
cheaper leave the text unchanged. Chains are undone token by token (tokens are parted by ASCII blanks, and where East Asian
writing, which has no blanks, begins or ends), and only in tokens that hold something unusual, so texts that are garbled in part
keep their sound parts.

A text is affected if a chain wins, or if it holds replacement characters (U+FFFD), whose original is lost.

Everything a Model has comes from all training texts. Usual characters and known words are exact counts over them. Dictionaries
are trained on blocks of texts, into which every text goes, and then on the dictionaries of up to `MERGED` blocks, level by level,
until each language has one: what is frequent in many blocks stays. A Model is a few hundred kB and is shipped to the workers.
Texts made of usual characters in usual places never leave the JVM.

Defined results: null and empty texts are not affected; a text whose original can't be wholly regained has restored = null;
repeated rows are judged alike; an empty table gives no rows; without any training text the dictionaries are empty.
"""

from __future__ import annotations

import codecs
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .canon import TABLE, canonical, ranges
from .common import arrow_schema, cut_lineage, map_columns, transposed

#: Encodings with one byte a character, by which bytes may have been read.
SINGLE = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1256", "cp1253", "koi8_r", "cp1250", "iso8859_15")
#: Encodings with several bytes a character, by which UTF-8 may have been read or in which CJK text may have been written.
MULTI = ("gb18030", "big5", "cp932", "euc_jp", "cp949")
#: What 8-bit text may really have been.
REAL = ("cp1252", "mac_roman", "cp850", "cp874", "cp1256", "cp1251", "iso8859_6", "koi8_r")
#: Bits a chain costs: a usual one, an unusual one, more than one odd character costs; a double chain both of its steps.
USUAL, UNUSUAL = 4, 12
#: Bits an unusual character, or letter case that changes inside a word at one, costs above its compressed length.
ODD = 8


@lru_cache(maxsize=None)
def to_bytes(name: str) -> dict[str, int]:
    """Characters above ASCII and their byte; bytes an encoding leaves undefined count as control characters, as readers do."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            out.setdefault(chr(b), b)
    for b in range(128, 160):
        out.setdefault(chr(b), b)
    return out


@lru_cache(maxsize=None)
def to_chars(name: str) -> dict[int, str]:
    out = {}
    for b in range(128, 256):
        try:
            out[b] = bytes([b]).decode(name)
        except UnicodeDecodeError:
            pass
    return out


@lru_cache(maxsize=None)
def decoding(name: str) -> str:
    """The 256 characters of an encoding, U+FFFE where there is none."""
    chars = to_chars(name)
    return "".join(chr(b) if b < 128 else chars.get(b, "\ufffe") for b in range(256))


@lru_cache(maxsize=None)
def encoding_map(name: str) -> dict[int, int]:
    return {**{b: b for b in range(128)}, **{ord(c): b for c, b in to_bytes(name).items()}}


@lru_cache(maxsize=4_096)
def as_bytes(name: str, text: str) -> bytes | None:
    """The bytes that would have been read as this text; the same for all encodings they may really be in."""
    try:
        return codecs.charmap_encode(text, "strict", encoding_map(name))[0]
    except UnicodeEncodeError:
        return None


_UTF8 = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


def _sequence(m: re.Match) -> str:
    try:
        return m.group().encode("latin-1").decode("utf-8")
    except UnicodeDecodeError:
        return m.group()


@dataclass(frozen=True)
class Step:
    """Bytes of `real` that were read as `read`; undo() gives the text back, or None if it can't be so."""

    read: str
    real: str
    cost: int

    def undo(self, text: str) -> str | None:
        try:
            if self.read in MULTI:
                if not _HAN.search(text):
                    return None
                raw = text.replace("�", "").encode(self.read)
                out = raw.decode(self.real, errors="ignore" if "�" in text else "strict")
                return out if out != text else None
            there = to_bytes(self.read)
            if self.real == "utf-8":
                # Sequences are undone one by one, what is no sequence stays: bytes may have been lost between.
                shifted = "".join([c if c < "\x80" else chr(there[c]) if c in there else c if c > "\xff" else "" + c for c in text])
                out = _UTF8.sub(_sequence, shifted)
                if out == shifted:
                    return None
                kept, i = [], 0
                for m in _UTF8.finditer(shifted):
                    kept += [shifted[i : m.start()].translate(_table(self.read)), _sequence(m)]
                    i = m.end()
                kept.append(shifted[i:].translate(_table(self.read)))
                return "".join(kept).replace("", "")
            raw = as_bytes(self.read, text)
            if raw is None:
                return None
            return raw.decode(self.real) if self.real in MULTI else codecs.charmap_decode(raw, "strict", decoding(self.real))[0]
        except (KeyError, UnicodeError):
            return None


@lru_cache(maxsize=None)
def _table(name: str) -> dict[int, str]:
    """Bytes above ASCII back to the characters they were read as."""
    out = {}
    for c, b in to_bytes(name).items():
        out.setdefault(b, c)
    return out


def steps() -> list[Step]:
    out = [Step(s, "utf-8", USUAL if s in ("cp1252", "latin-1") else UNUSUAL) for s in SINGLE]
    out += [Step(m, "utf-8", UNUSUAL) for m in MULTI]
    out += [Step(s, r, UNUSUAL) for s in SINGLE for r in (*REAL, *MULTI) if s != r and not (s in ("latin-1", "iso8859_15") and r == "cp1252")]
    return out


STEPS = steps()
_HAN = re.compile("[\u3040-\u9fff\uac00-\ud7a3\uff61-\uff9f]")
_SCRIPTS = (("th", re.compile("[ก-๛]")), ("ar", re.compile("[؀-ۿ]")), ("hi", re.compile("[ऀ-ॿ]")), ("ja", re.compile("[぀-ヿ]")), ("zh", re.compile("[一-鿿]")))


#: A capital above ASCII after a small letter.
_CASE = re.compile("[a-z\xdf-\xff][\xc0-\xde]")
#: Latin letters next to letters of a script that is not written so.
_MIXED = re.compile("[A-Za-zÀ-ɏ][\u0370-\u06ff]|[\u0370-\u06ff][A-Za-zÀ-ɏ]|[\u00c0-\u00ff][\u0900-\u9fff]|[\u0900-\u9fff][\u00c0-\u00ff]")
_SCRIPT_LANGS = frozenset(k for k, _ in _SCRIPTS)


@dataclass
class Model:
    """Per-language dictionaries and the usual characters."""

    dictionaries: dict[str, bytes] = field(default_factory=dict)
    usual: str = ""
    #: Latin words with letters above ASCII, in lower case.
    words: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        self._coders: dict | None = None

    def __getstate__(self) -> dict:
        return {"dictionaries": self.dictionaries, "usual": self.usual, "words": self.words, "_coders": None}

    def coders(self) -> dict:
        if self._coders is None:
            import zstandard as Z

            self._coders = {}
            for lang, raw in self.dictionaries.items():
                d = Z.ZstdCompressionDict(raw)
                params = Z.ZstdCompressionParameters.from_level(19, min_match=3, window_log=17, write_content_size=False, write_checksum=False, write_dict_id=False)
                self._coders[lang] = Z.ZstdCompressor(dict_data=d, compression_params=params).compress
            if not self._coders:
                self._coders[""] = Z.ZstdCompressor(level=9, write_content_size=False).compress
        return self._coders

    def nearest(self, text: str) -> list[str]:
        """The two languages of no script of their own that describe a text best, garbled or not."""
        coders = self.coders()
        raw = text.encode("utf-8", "surrogatepass")
        return sorted((k for k in coders if k not in _SCRIPT_LANGS), key=lambda k: len(coders[k](raw)))[:2]

    def bits(self, text: str, latin: list[str] | None = None) -> int:
        """Shortest description of a text: with the dictionaries of its script, or those of `latin` (all such languages) if it has
        none of these."""
        coders = self.coders()
        langs = []
        if not text.isascii():
            langs = [k for k, script in _SCRIPTS if k in coders and script.search(text)]
            if "ja" in langs and "zh" in langs:
                langs = ["ja"]
        raw = text.encode("utf-8", "surrogatepass")
        return 8 * min(len(coders[k](raw)) for k in (langs or latin or [k for k in coders if k not in _SCRIPT_LANGS] or coders)) + ODD * (len(_MIXED.findall(text)) + len(_CASE.findall(text))) + self._oddness(text)

    def _oddness(self, text: str) -> int:
        """Bits for unusual places; a capital among capitals may belong to a name in a language not trained, so it counts half."""
        bits = 0
        for m in self.odd().finditer(text):
            a, b = m.span()
            among = b - a == 1 and "\xc0" <= text[a] <= "\xde" and text[a - 1 : a].isupper() and text[b : b + 1].isupper()
            bits += ODD // 2 if among else ODD
        return bits

    def odd(self) -> re.Pattern:
        if not hasattr(self, "_odd"):
            self._odd = re.compile(self.odd_class())
        return self._odd

    def odd_class(self) -> str:
        """What makes a token unusual: characters above ASCII that are not usual, capitals of usual letters that stand between
        small ones, letter case that changes inside a word, and pairs that misread UTF-8 leaves."""
        esc = lambda chars: "".join(f"\\u{ord(c):04x}" for c in chars if ord(c) < 0x10000)
        capital = "".join(sorted({c.upper() for c in self.usual if "\xdf" < c < "\u0180" and len(c.upper()) == 1} - set(self.usual)))
        alone = f"(?<![A-Z\\u00c0-\\u00de])[{esc(capital)}](?![A-Z\\u00c0-\\u00de])|" if capital else ""
        return alone + f"[^\\u0000-\\u007f{esc(self.usual + capital)}]|[a-z\\u00df-\\u00ff][\\u00c0-\\u00de]|[\\u00c0-\\u00df][\\u0080-\\u00bf]|[\\u0080-\\u009f]|[A-Z\\u00c0-\\u00de][\\u00df-\\u00ff][A-Z]"

    def suspect(self, text: Column) -> Column:
        """Whether a text may be unusual: it holds a character that is not usual, or a capital above ASCII.

        Java tests a class of many ranges one by one, so ASCII is ruled out first and Chinese characters are left to texts
        that have any.
        """
        plain = "".join(c for c in self.usual if not "\u4e00" <= c <= "\u9fff" and not "\xc0" <= c <= "\xde")
        first = f"[\\x{{80}}-\\x{{10ffff}}&&[^{ranges(plain)}\\u4e00-\\u9fff]]"
        han = ranges("".join(c for c in self.usual if "\u4e00" <= c <= "\u9fff"))
        rare = f"[\\u4e00-\\u9fff&&[^{han}]]" if han else "[\\u4e00-\\u9fff]"
        return text.rlike(first) | (text.rlike("[\\u4e00-\\u9fff]") & text.rlike(rare))


def sound(text: str) -> bool:
    """Whether a training text shows no sign of a wrong encoding: nothing lost, no control characters, no capital above ASCII after
    a small letter, and what stands above ASCII is not to a third part sequences of UTF-8 that were read as single bytes (a few such
    pairs occur in sound text)."""
    above = len(text) - len(text.encode("ascii", "ignore"))
    if not above:
        return True
    if _BROKEN.search(text) or _CASE.search(text):
        return False
    runs = " ".join(_RUN.findall(text))  # no sequence is shorter or goes beyond one
    return not any(3 * sum(m.end() - m.start() - 1 for m in read.finditer(runs)) >= above for read in _read_as())


@lru_cache(maxsize=1)
def _read_as() -> list[re.Pattern]:
    """For each encoding of single bytes, what sequences of UTF-8 look like when read by it."""
    out = []
    for name in SINGLE:
        chars = to_bytes(name).items()
        of = lambda low, high: "[" + "".join(re.escape(c) for c, b in chars if low <= b < high) + "]"  # noqa: B023, E731
        out.append(re.compile(f"{of(0xC2, 0xE0)}{of(0x80, 0xC0)}|{of(0xE0, 0xF0)}{of(0x80, 0xC0)}{{2}}|{of(0xF0, 0xF5)}{of(0x80, 0xC0)}{{3}}"))
    return out


#: Dictionaries that are merged at once, and how much larger than the last one those to be merged are.
MERGED, ROOM = 32, 8
#: Longest piece of a text that a dictionary is trained on, in characters.
PIECE = 2_000


def pieces(text: str) -> list[bytes]:
    """A text's sentences, long ones cut."""
    return [p[i : i + PIECE].encode("utf-8", "surrogatepass") for p in _STOP.split(text) if p for i in range(0, len(p), PIECE)]


def dictionary(samples: list[bytes], size: int, **fixed: int) -> bytes:
    """A dictionary of at most `size` bytes; what is too little to train on is its own dictionary."""
    import zstandard as Z

    for step in (0, 64):  # few large samples are cut smaller
        cut = [p[i : i + step] for p in samples for i in range(0, len(p), step)] if step else samples
        try:
            if len(cut) < 200:
                raise Z.ZstdError
            return Z.train_dictionary(size, cut, split_point=1.0, **fixed).as_bytes()  # else a quarter only serves to compare settings
        except Z.ZstdError:
            whole = b"\n".join(dict.fromkeys(samples))
            if len(whole) <= size:
                break
    return whole[:size] or b"        "


_PARTS = "_lang string, kind string, item string, texts long, times long, _block long, dictionary binary"


def train(df: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", dict_bytes: int = 24_576, least: int = 3, share: float = 0.01, known: float = 0.0001, most: int = 16_000, chars: int = 4_000_000) -> Model:
    """A Model of all texts longer than 20 characters.

    Texts that show signs of a wrong encoding are left out. A character above ASCII is usual if, in some language, it stands in
    at least `share` of the texts, and `least` times at least; a word is known if it stands in at least `known` of them, which
    bounds the list: by the words above ASCII of a text, divided by `known`. A language is the first two letters of the code;
    texts without one are a group of their own. A block has about `most` texts or `chars` characters, whichever is less. The
    driver gets what passes these shares and one dictionary a language.
    """
    spark = df.sparkSession
    code = F.lower(F.regexp_extract(F.coalesce(F.trim(lang), F.lit("")), r"^(\p{L}{2})", 1))
    rows = df.where(F.col(text).isNotNull() & (F.length(F.trim(text)) > 20)).select(code.alias("_lang"), F.col(key).alias("_key"), F.col(text).alias("_text"))
    sizes = rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("_text")).alias("chars")).collect()
    blocks = {r["_lang"]: max(-(-r["n"] // most), -(-r["chars"] // chars)) for r in sizes}
    if not blocks:
        return Model()
    into = F.broadcast(spark.createDataFrame(list(blocks.items()), "_lang string, _blocks long"))
    placed = rows.join(into, "_lang").withColumn("_block", F.pmod(F.xxhash64("_key", "_text"), F.col("_blocks"))).select("_lang", "_block", "_blocks", "_text")

    schema = arrow_schema(_PARTS)

    def as_table(rows: list[tuple]) -> pa.Table:
        return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(transposed(rows, len(schema)), schema)], schema=schema)

    def trained(group: tuple, samples: list[bytes], last: bool) -> list[tuple]:
        # The last dictionary of a language is trained with the best of several settings.
        made = dictionary(samples, dict_bytes) if last else dictionary(samples, ROOM * dict_bytes, k=512, d=8)
        return [(group[0].as_py(), "dictionary", None, 0, 0, group[1].as_py(), made)]

    def count(group: tuple, table: pa.Table) -> pa.Table:
        texts = [t for t in sorted(table["_text"].to_pylist()) if sound(t)]
        holding, times, words = Counter(), Counter(), Counter()
        for t in texts:
            n = Counter("".join(_ABOVE.findall(t)))
            times.update(n)
            holding.update(n.keys())
            words.update({w.lower() for w in _LATIN_WORD.findall(t) if not w.isascii()})
        lang, block = group[0].as_py(), group[1].as_py()
        out = [(lang, "texts", None, len(texts), 0, block, None)]
        out += [(lang, "character", c, n, times[c], block, None) for c, n in holding.items()]
        out += [(lang, "word", w, n, 0, block, None) for w, n in words.items()]
        return as_table(out + trained(group, [p for t in texts for p in pieces(t)], table["_blocks"][0].as_py() == 1))

    def merge(group: tuple, table: pa.Table) -> pa.Table:
        samples = [p for raw in sorted(table["dictionary"].to_pylist()) for p in pieces(raw.decode("utf-8", "ignore"))]
        return as_table(trained(group, samples, table["_blocks"][0].as_py() == 1))

    parts = cut_lineage(placed.groupBy("_lang", "_block").applyInArrow(count, _PARTS))
    total = parts.where("kind = 'texts'").groupBy("_lang").agg(F.sum("texts").alias("_all"))
    counted = parts.where("kind in ('character', 'word')").groupBy("_lang", "kind", "item").agg(F.sum("texts").alias("texts"), F.sum("times").alias("times")).join(F.broadcast(total), "_lang")
    usual = (F.col("kind") == "character") & (F.col("texts") >= share * F.col("_all")) & (F.col("times") >= least)
    got = counted.where(usual | ((F.col("kind") == "word") & (F.col("texts") >= known * F.col("_all")))).select("kind", "item").distinct().collect()
    dictionaries = parts.where("kind = 'dictionary'")
    while max(blocks.values()) > 1:
        one = {k for k, n in blocks.items() if n == 1}
        blocks = {k: -(-n // MERGED) for k, n in blocks.items()}
        into = F.broadcast(spark.createDataFrame(list(blocks.items()), "_lang string, _blocks long"))
        several = dictionaries.where(~F.col("_lang").isin(*one)).join(into, "_lang").withColumn("_block", F.pmod("_block", "_blocks"))
        merged = several.groupBy("_lang", "_block").applyInArrow(merge, _PARTS)
        dictionaries = cut_lineage(dictionaries.where(F.col("_lang").isin(*one)).unionByName(merged))
    chosen = {r["_lang"]: bytes(r["dictionary"]) for r in dictionaries.orderBy("_lang").collect()}
    characters = sorted(r["item"] for r in got if r["kind"] == "character" and r["item"] != "�" and not "\x80" <= r["item"] <= "\x9f")
    return Model(chosen, "".join(characters), frozenset(r["item"] for r in got if r["kind"] == "word"))


_ABOVE = re.compile("[^\x00-\x7f]+")
_RUN = re.compile("[^\x00-\x7f]{2,}")
_STOP = re.compile(r"(?<=[.!?\n])\s+|(?<=[。！？])")
_BROKEN = re.compile("[\ufffd\x80-\x9f]")
_LATIN_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+")
_EAST = "\u3000-\u9fff\uac00-\ud7a3\uff00-\uff60\uffe0-\uffef"
_PART = re.compile(f"[\u201c\u2018]?[{_EAST}](?:[{_EAST}]|[\u201c\u201d\u2018\u2019](?=[{_EAST}]))*|[ \t\n\r]+|[\u201c\u2018]*[^ \t\n\r\u201c\u2018{_EAST}]+(?:[\u201c\u2018]+(?![{_EAST}])[^ \t\n\r\u201c\u2018{_EAST}]*)*|[\u201c\u2018]+")


def repair(text: str, model: Model) -> tuple[bool, str | None, str | None]:
    """(affected, restored text or None, chain) of one text."""
    odd = model.odd()
    lost = "�" in text
    if not lost and not odd.search(text):
        return False, text, None
    parts = _PART.findall(text)
    suspects = [i for i, p in enumerate(parts) if not p.isascii() and odd.search(p.translate(_TYPOGRAPHIC))]
    if not suspects:
        return lost, None if lost else text, None
    around = sorted({j for i in suspects for j in range(i - 4, i + 5) if 0 <= j < len(parts)})
    distinct = list(dict.fromkeys(parts[i] for i in suspects))

    latin = model.nearest("".join([parts[j] for j in around]))

    def cost(form: dict[str, str]) -> int:
        return model.bits("".join([form.get(parts[j], parts[j]) for j in around]), latin)

    def letters(form: dict[str, str]) -> int:
        return sum(c.isalpha() for v in form.values() for c in v)

    def evidence(form: dict[str, str]) -> int:
        """Bits for or against a change of single bytes, which any text admits: known words speak for it; unknown ones, one or
        two letters of another script and letters that turn into signs against it."""
        bits = 0
        for was, now in form.items():
            if was != now:
                found = [w.lower() for w in _LATIN_WORD.findall(now) if not w.isascii()]
                if found:
                    bits += -ODD if any(w in model.words for w in found) else ODD
                elif sum(c.isalpha() for c in now) in (1, 2):
                    bits += ODD
                if len(was) > 1 and sum(c.isalpha() for c in now) < sum(c.isalpha() for c in was):
                    bits += 2 * ODD  # a letter would turn into a sign
        return bits

    def undone(step: Step, form: dict[str, str]) -> dict[str, str]:
        out = {}
        for p in distinct:
            now = form.get(p, p)
            back = step.undo(now)
            out[p] = now if back is None else back
        return out

    # Blanks, invisible characters, wide forms and look-alike letters are another fault than a wrong encoding: the text may
    # also be described by its consistent form.
    forms = {p: canonical(p) for p in distinct}
    as_is = cost({})
    if any(p != form for p, form in forms.items()):
        as_is = min(as_is, cost(forms) + 1)
    best = (as_is, 0)
    chosen, name, form0 = None, None, {}
    tried: set = set()
    for step in STEPS:
        form = undone(step, form0)
        key = tuple(form.values())
        if key == tuple(distinct) or key in tried:
            continue
        tried.add(key)
        bits = cost(form) + step.cost
        if step.real in REAL:
            bits += evidence(form)
        if bits <= best[0] and (rank := (bits, -letters(form))) < best:  # of equal lengths the one with more letters
            best, chosen, name = rank, form, f"{step.real}>{step.read}"
        if step.real == "utf-8" and step.read not in MULTI and any("\x7f" < c < "Ā" or c in _C1252 for v in form.values() for c in v):
            # Twice the same way, or one of the usual ways before it.
            for second in dict.fromkeys((*STEPS[:2], step)):
                twice = undone(second, form)
                if twice != form:
                    bits = cost(twice) + step.cost + second.cost
                    if bits <= best[0] and (rank := (bits, -letters(twice))) < best:
                        best, chosen, name = rank, twice, f"{second.real}>{second.read}>{step.real}>{step.read}"
    if chosen is None or best[0] >= as_is:
        return lost, None if lost else text, None
    restored = "".join([chosen.get(p, p) for p in parts])
    return True, None if "�" in restored or lost else restored, name


#: What undoing a chain may begin with: characters of one byte, half-width katakana being those of cp932. In the other
#: encodings of MULTI no first two bytes of a UTF-8 sequence are read as a character that is passed over.
_READ = frozenset(c for s in SINGLE for c in to_chars(s).values()) | frozenset(map(chr, range(0xFF61, 0xFFA0)))
#: Kinds of blanks, invisible characters, wide forms and ligatures beyond Latin-1, and combining marks, that no chain leaves: alone
#: they are no sign of a wrong encoding.
_TYPOGRAPHIC = dict.fromkeys([ord(c) for c, form in TABLE.items() if c > "\xff" and c not in _READ and (form in ("", " ") or form.isalnum())] + list(range(0x300, 0x370)))
_C1252 = frozenset(to_bytes("cp1252"))


def restore(df: DataFrame, model: Model, *, key: str, text: str) -> DataFrame:
    """Affected rows: key, garbled text, restored text (null where it can't be regained), chain."""
    key_type = df.schema[key].dataType.simpleString()

    def fix() -> Callable[[list, list], list]:
        seen = lru_cache(maxsize=50_000)(lambda t: repair(t, model))  # excerpts repeat
        return lambda keys, texts: transposed([(k, t, r, c) for k, t in zip(keys, texts) for a, r, c in (seen(t),) if a], 4)

    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(model.suspect(F.col("_text")))
    return map_columns(rows, fix, f"_key {key_type}, garbled string, restored string, chain string").withColumnRenamed("_key", key)
