"""Sentence units across languages and scripts.

Boundary rules are compiled into a finite transducer over a small alphabet of events. A lexer turns a text into events: runs
of words; terminal marks, whose event a compiled table gives by the word before (abbreviation, initial, number) and by what
follows; opening and closing quotes and brackets; and hard breaks (blank lines, ends of headings and list items, blanks between
Thai clauses). The transducer's states tell whether a unit has begun, whether a
quote or bracket is open and whether it began the unit, and whether a terminal mark was just seen inside it; its output is 1
where a unit ends.

Long documents are cut into blocks of events. Each block becomes a state-transition function (for every state at its start,
the state at its end), the functions are composed by a parallel prefix scan, and all blocks then emit their ends at once from
their now known start states.

Defined results: null, empty and blank texts have no units; a text without any end is one unit; repeated rows give repeated
units; an empty table gives no rows. Offsets count code points; a unit runs from its first character to past its last, blanks
around it excluded.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .canon import ALIKE, TABLE
from .common import map_columns, spread, transposed

# Events
W, E, M, C, OPEN, K, FIN, G, BOPEN, BK, BFIN, X = range(12)
# States: unit not begun / begun / begun with a terminal mark before a closer; quote (bracket) open since the unit's start or
# since its middle, without and with a terminal mark just seen.
S0, S1, S1T, Q0, Q0T, Q1, Q1T, B0, B0T, B1, B1T = range(11)
N_STATES, N_EVENTS = 11, 12


def compile_rules() -> tuple[np.ndarray, np.ndarray]:
    """The transducer: next state and output (1: a unit ends after this event) for every state and event."""
    nxt, out = np.zeros((N_STATES, N_EVENTS), np.uint8), np.zeros((N_STATES, N_EVENTS), np.uint8)
    outside = {W: S1, E: S0, M: S1, C: S1T, K: S1, FIN: S1, G: S1, BK: S1, BFIN: S1, X: S0}
    for s in (S0, S1, S1T):
        for e, to in outside.items():
            nxt[s, e] = to
        nxt[s, OPEN], nxt[s, BOPEN] = (Q0, B0) if s == S0 else (Q1, B1)
        out[s, E] = 1
    for e in (FIN, G, BFIN):
        nxt[S1T, e], out[S1T, e] = S0, 1
    for q, qt in ((Q0, Q0T), (Q1, Q1T)):
        for s in (q, qt):
            nxt[s, :] = q
            nxt[s, C] = qt
            for e in (K, FIN, G):
                nxt[s, e] = S1
        nxt[qt, FIN], out[qt, FIN] = S0, 1
    nxt[Q0T, G], out[Q0T, G] = S0, 1
    for b, bt in ((B0, B0T), (B1, B1T)):
        for s in (b, bt):
            nxt[s, :] = b
            nxt[s, C] = bt
            nxt[s, BK] = nxt[s, BFIN] = S1
    nxt[B0T, BFIN], out[B0T, BFIN] = S0, 1
    nxt[:, X], out[:, X] = S0, 1
    return nxt, out


NEXT, OUT = compile_rules()
_NEXT, _OUT = NEXT.tolist(), OUT.tolist()


def run(events: np.ndarray, block: int = 2_048) -> np.ndarray:
    """The transducer's output for every event, by blocks, prefix scan and a second pass."""
    n = len(events)
    if n <= block:
        s, found = S0, np.zeros(n, np.uint8)
        for i, e in enumerate(events.tolist()):
            if _OUT[s][e]:
                found[i] = 1
            s = _NEXT[s][e]
        return found
    rows = -(-n // block)
    grid = np.full(rows * block, 255, np.uint8)
    grid[:n] = events
    grid = grid.reshape(rows, block)
    table = np.concatenate([NEXT, np.zeros((N_STATES, 256 - N_EVENTS), np.uint8)], axis=1)
    table[:, 255] = np.arange(N_STATES)  # padding changes nothing
    functions = np.tile(np.arange(N_STATES, dtype=np.uint8), (rows, 1))
    for j in range(block):
        functions = table[functions, grid[:, j, None]]
    step = 1
    while step < rows:  # after each step a row maps states over twice as many blocks
        functions[step:] = np.take_along_axis(functions[step:], functions[:-step].astype(np.intp), axis=1)
        step *= 2
    state = np.concatenate([[S0], functions[:-1, S0]]).astype(np.uint8)
    emit = np.concatenate([OUT, np.zeros((N_STATES, 256 - N_EVENTS), np.uint8)], axis=1)
    found = np.zeros((rows, block), np.uint8)
    for j in range(block):
        found[:, j] = emit[state, grid[:, j]]
        state = table[state, grid[:, j]]
    return found.reshape(-1)[:n]


# Words whose full stop never ends a unit.
NEVER = frozenset(
    "m mm mme mlle mgr me dr pr prof mr mrs ms st ste sr sra srta dra d hr fr herr frau rev hon capt "
    "art al cf vgl fig sec app p pp pág págs chap vol éd réf ref tél tel nr nº env max min_ approx aprox ca vs v bzw bspw evtl ggf inkl zzgl "
    "c.-à-d c.à.d i.e e.g z.b d.h u.a o.ä p.ej p.ex ex ej z.t s.o assur av bd boul rte imp pl ch univ éts ets डॉ श्री د अ प्रो".split()
)
#: Words whose full stop ends no unit before a digit (numbers, months, times).
BEFORE_DIGIT = frozenset("no num n.º nos jan feb mar apr jun jul aug sep sept oct nov dec janv févr avr juil déc ene abr ago dic jän mär okt dez stk abs ziff ed room ext".split())
#: Words whose full stop ends a unit only before a new start, which the general rule already asks for: etc., S.A., Inc., p.m.
COMPANY = frozenset(("corp", "inc", "co", "ltd", "sa", "cie"))
ORDINAL_BEFORE = frozenset("am die der das den dem des vom zum im zur bis seit ab beim ins dieser diese dieses jede jeder ihre seine".split())
MONTHS_DE = ("Jan", "Feb", "März", "Apr", "Mai", "Juni", "Juli", "Aug", "Sep", "Okt", "Nov", "Dez")

_PLAIN = str.maketrans({**TABLE, **ALIKE})
_BLANK = re.compile(r"\s*")
_WORD_BEFORE = re.compile(r"(?:[^\W_]|[.º°\-'’ऀ-ॿ])+$")
_TWO_BEFORE = re.compile(r"([^\W\d_]+)\s+\d{1,2}$")
_DIGIT_BEFORE = re.compile(r"\d\s*[A-Z]$")
_PARA = re.compile(r"\n[^\S\n]*\n\s*")
_ITEM = re.compile(r"[^\S\n]*(?:[-*•‣▪–‐‑‒−]|\d{1,3}[.)]|[a-z]\))[^\S\n]+\S")
_HEAD = re.compile(r"[^\S\n]*#{1,6}[^\S\n]+\S")
_EVENT = re.compile(r"[.!?…。！？｡।॥؟۔]+|[«»“”„\"「」『』‹›]|[(（\[［]|[)）\]］]|[^.!?…。！？｡।॥؟۔«»“”„\"「」『』‹›(（\[［)）\]］\s]+|\s+")
_FULL = frozenset("。！？｡।॥؟۔")
_CLOSERS = frozenset("»”』」)）]］›")
_SPEECH_ZH = re.compile(r"[^。！？“”\n]{0,16}(?:说|道|问|答|喊|表示|写道)[。！？，]")
_GO_ON = re.compile(r"(?:と|って|という|などと|の|は|を|が|に|も|然后|并|就|便|随后|接着|而|后|的|ثم|و|ف|और|फिर|तथा|ने|,|،|、|，|；|;|:|：)")
_THAI = re.compile(r"[ก-๛]")


def _next(text: str, at: int, end: int) -> tuple[int, str]:
    """Where the next character after blanks is, and which ('' at the end)."""
    k = _BLANK.match(text, at, end).end()
    return k, text[k] if k < end else ""


def _low_quote(text: str, start: int, at: int) -> bool:
    """Whether a low quote is open before text[at], which “ then closes."""
    return text.rfind("„", start, at) > text.rfind("“", start, at)


def _after(text: str, at: int, end: int, go: int, fin: int, caseless: int) -> int:
    """The event of a closer, by what follows it."""
    k, c = _next(text, at, end)
    if not c:
        return fin
    if c in ",;:.!?…)]»。、，；：！？" or c.islower() or _GO_ON.match(text, k):
        return go
    if "一" <= c <= "鿿" or "぀" <= c <= "ヿ":
        return go if k == at and _SPEECH_ZH.match(text, k, end) else fin
    return caseless if c.isalpha() and not c.isupper() else fin


# What stands before a full stop: nothing of note, an abbreviation that never ends a unit, a company's form, a word shortened
# before numbers, a single capital (or letter without case), one after a digit, a single small letter, a small number, an ordinal.
PLAIN, ABBREVIATED, COMPANIES, NUMBERED, CAPITAL, UNIT, SMALL, NUMBER, NTH = range(9)
# What follows a terminal mark: the end, a closer, something attached, what goes on a sentence, a digit, a capital, a further
# company's form, a month's name, anything else.
END, CLOSER, ATTACHED, GOES_ON, DIGIT, UPPER, FIRM, MONTH, ELSE = range(9)


def compile_marks() -> list[list[int]]:
    """The event of a single full stop, by what stands before it and what follows; other marks take the row of PLAIN."""
    rules = [[E, C, W, M, E, E, E, E, E] for _ in range(9)]
    for before in (ABBREVIATED, SMALL, NTH):
        rules[before] = [E, W, W, M, W, W, W, W, W]
    rules[COMPANIES][FIRM] = W
    rules[NUMBERED][DIGIT] = W
    for follows in (UPPER, FIRM, MONTH):
        rules[CAPITAL][follows] = W
    rules[NUMBER][MONTH] = W
    return rules


MARKS = compile_marks()
_FIRMS = ("Ltd", "Inc", "Corp", "Co.")
_CLASSES = {**dict.fromkeys(COMPANY, COMPANIES), **dict.fromkeys(BEFORE_DIGIT, NUMBERED), **dict.fromkeys(NEVER, ABBREVIATED)}


def _before(text: str, start: int, at: int) -> int:
    """The class of the word before the full stop at text[at]."""
    near = text[max(start, at - 28) : at]
    if not near.isascii():  # invisible characters, wide forms and look-alikes hide no abbreviation
        near = near.translate(_PLAIN)
    before = _WORD_BEFORE.search(near)
    if not before:
        return PLAIN
    word = before.group()
    low = word.lower().strip("-'’")
    for cut in ("’", "'", "-"):
        if cut in low and low not in NEVER:
            low = low.rpartition(cut)[2]
    found = _CLASSES.get(low)
    if found is not None:
        return found
    if len(low) == 1 and low.isalpha():
        return SMALL if word.islower() else UNIT if _DIGIT_BEFORE.search(near) else CAPITAL
    if word.isdigit() and len(word) <= 2:
        two = _TWO_BEFORE.search(near)
        return NTH if two and two.group(1).lower() in ORDINAL_BEFORE else NUMBER
    return PLAIN


def _follows(text: str, b: int, end: int, full: bool, straight: bool, start: int) -> int:
    """The class of what follows a mark that ends at b."""
    k, n = _next(text, b, end)
    if not n:
        return END
    if n in _CLOSERS or k == b and (n == '"' and straight or n == "“" and _low_quote(text, start, k)):
        return CLOSER
    if not full and k == b:
        return ATTACHED
    if n.islower() or n in ",;:،؛、，；：":
        return GOES_ON
    if n.isdigit():
        return DIGIT
    if text.startswith(_FIRMS, k):
        return FIRM
    if text.startswith(MONTHS_DE, k):
        return MONTH
    return UPPER if n.isupper() else ELSE


def _lex(text: str, start: int, end: int, thai: bool, events: list[int], at: list[int]) -> None:
    """Append the events of one paragraph and where each ends."""
    straight = False
    depth = 0
    token = start
    for m in _EVENT.finditer(text, start, end):
        a, b = m.span()
        c = text[a]
        if c.isspace():
            if thai and b < end:
                stop = _BLANK_END.search(text, b, end)
                if _THAI.search(text, token, a) and _THAI.search(text, b, stop.start() if stop else end) and (_THAI.match(text, b) or _THAI.match(text, a - 1)):
                    events.append(X)
                    at.append(a)
            token = b
            continue
        if c in ".!?…。！？｡।॥؟۔":
            follows = _follows(text, b, end, text[b - 1] in _FULL, straight, start)
            single = b - a == 1 and c == "." and follows not in (ATTACHED, GOES_ON, END)
            e = MARKS[_before(text, start, a) if single else PLAIN][follows]
        elif c == '"':
            if straight:
                straight, e = False, _after(text, b, end, K, FIN, G)
            elif (a == start or not text[a - 1].isalnum()) and b < end and not text[b].isspace() and text.find('"', b, end) > 0:
                straight, e = True, OPEN
            else:
                e = W
        elif c in "«“„「『‹":
            if c == "“" and depth and _low_quote(text, start, a):
                depth, e = 0, _after(text, b, end, K, FIN, G)
            elif any(text.find(x, b, end) > 0 for x in {"«": "»", "“": "”", "„": "“”", "「": "」", "『": "』", "‹": "›"}[c]):
                depth, e = 1, OPEN
            else:
                e = W
        elif c in "»”」』›":
            depth, e = 0, _after(text, b, end, K, FIN, G)
        elif c in "(（[［":
            e = BOPEN if any(text.find(x, b, end) > 0 for x in ")）]］") else W
        elif c in ")）]］":
            e = _after(text, b, end, BK, BFIN, BFIN)
        else:
            e = W
        events.append(e)
        at.append(b)


_BLANK_END = re.compile(r"\s")


def lex(text: str) -> tuple[list[int], list[int]]:
    """Events of a whole text and where each ends; structure first (paragraphs, headings, list items), then marks."""
    events: list[int] = []
    at: list[int] = []
    thai = bool(_THAI.search(text))

    def paragraph(start: int, end: int) -> None:
        item_open = False
        first = True
        plain = start
        line = start
        previous_end = ""
        while line < end:
            stop = text.find("\n", line, end)
            stop = end if stop < 0 else stop
            head = _HEAD.match(text, line, stop)
            item = not head and _ITEM.match(text, line, stop) and (first or item_open or previous_end in ":.!?")
            if head or item or item_open:
                if plain < line and (head or item):
                    if item_open:
                        events.append(W)
                        at.append(line)
                    else:
                        _lex(text, plain, line, thai, events, at)
                    events.append(X)
                    at.append(line)
                    plain = line
                if head:
                    events.extend((W, X))
                    at.extend((stop, stop))
                    plain, item_open = stop, False
                elif item:
                    item_open = True
            first = False
            previous_end = text[line:stop].rstrip()[-1:]
            line = stop + 1
        if plain < end:
            if item_open:
                events.append(W)
                at.append(end)
            else:
                _lex(text, plain, end, thai, events, at)
        events.append(X)
        at.append(end)

    start = 0
    for m in _PARA.finditer(text):
        paragraph(start, m.start())
        start = m.end()
    paragraph(start, len(text))
    return events, at


def units(text: str) -> list[tuple[int, int]]:
    """The (start, end) of every sentence unit of a text."""
    events, at = lex(text)
    out, start = [], 0
    for i in np.flatnonzero(run(np.array(events, np.uint8))).tolist():
        end = at[i]
        a = start
        while a < end and text[a].isspace():
            a += 1
        b = end
        while b > a and text[b - 1].isspace():
            b -= 1
        if b > a:
            out.append((a, b))
        start = max(start, end)
    return out


#: Texts longer than this are cut at blank lines and lexed by several tasks.
LONG = 200_000


def blocks(text: str, size: int = LONG) -> list[tuple[int, int]]:
    """A text as spans of about `size` characters that end at blank lines, where every unit ends and the transducer begins anew."""
    out, start = [], 0
    while len(text) - start > size:
        m = _PARA.search(text, start + size)
        if not m:
            break
        out.append((start, m.end()))
        start = m.end()
    return [*out, (start, len(text))]


def sentence_units(df: DataFrame, *, text: str = "text", key: str = "chunk_key") -> DataFrame:
    """The units of every row: key, unit_index, start_char, end_char, unit_text.

    A long text is spread over tasks in blocks of whole paragraphs, and its units are numbered in their order afterwards. A
    paragraph is lexed by one task, whose transducer runs in blocks of events by prefix scan.
    """
    key_type, size = df.schema[key].dataType.simpleString(), LONG
    ddl = "unit_index int, start_char int, end_char int, unit_text string"

    def cut(keys: list, texts: list) -> list:
        return transposed([(k, n, s, e, t[s:e]) for k, t in zip(keys, texts) for n, (s, e) in enumerate(units(t))], 5)

    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    short = map_columns(spread(rows.where(F.length("_text") <= size), F.xxhash64("_key", "_text")), lambda: cut, f"_key {key_type}, {ddl}")

    def part(keys: list, copies: list, texts: list) -> list:
        return transposed([(k, c, a, t[a:b]) for k, c, t in zip(keys, copies, texts) for a, b in blocks(t, size)], 4)

    def cut_part(keys: list, copies: list, offsets: list, texts: list) -> list:
        return transposed([(k, c, a + s, a + e, t[s:e]) for k, c, a, t in zip(keys, copies, offsets, texts) for s, e in units(t)], 5)

    # Rows are told apart by hash and, if they are repeated, by number.
    known = F.xxhash64("_key", "_text")
    whole = rows.where(F.length("_text") > size).withColumn("_id", F.concat_ws("-", known, F.row_number().over(Window.partitionBy(known).orderBy(F.lit(0))))).select("_key", "_id", "_text")
    parts = map_columns(whole, lambda: part, f"_key {key_type}, _id string, _at int, _text string")
    found = map_columns(spread(parts, F.xxhash64("_id", "_at")), lambda: cut_part, f"_key {key_type}, _id string, start_char int, end_char int, unit_text string")
    index = (F.row_number().over(Window.partitionBy("_id").orderBy("start_char")) - 1).alias("unit_index")
    long = found.select("_key", index, "start_char", "end_char", "unit_text")
    return short.unionByName(long).withColumnRenamed("_key", key)
