"""Personal information in free text: finding it and replacing it by typed placeholders.

E-mail addresses (also spelt out), telephone numbers, social insurance, passport and identity-card numbers, postal addresses
and names are found by one scan of each text. Numbers must fit a format, French social insurance numbers also their check
number. Names are words of the known persons, or words built like them: a word shape model (beginnings and endings of the
names) is trained on at most MAX_PERSONS persons; where there are more, the name words of all of them are looked up by a
distributed join. Titles, form labels and initials extend a name.
What overlaps is settled in the order e-mail, address, identity number, telephone, name, so a name in a street or an e-mail
address is none.

Replacement: [TYPE value]. Numbers keep their format but are permuted by a keyed Feistel network among the valid ones of their
kind, whichever way they are written; dates of birth inside them too, and all other dates if asked for. E-mail addresses, postal
addresses and names get a short keyed label. Equal values so stay linked across documents.

Text is scanned in a form with blanks, wide forms, hyphens and look-alikes united, with offsets mapped back to the original.

Defined results: null and empty texts have no items; repeated rows have their items each; an empty persons table leaves names
to titles, labels and initials; an empty table gives no rows. Offsets count code points.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Sequence
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import feistel
from .canon import ALIKE, NEEDS, TABLE
from .common import arrow_schema, map_columns, transposed

#: Persons the model is fitted on.
MAX_PERSONS = 100_000

_AT = r"(?:\s?@\s?|\s*[(\[{<]\s*(?:at|arobase|arroba|ät)\s*[)\]}>]\s*|\s+(?:arobase|arroba|at|ät)\s+)"
_DOT = r"(?:\.|\s*[(\[{<]\s*(?:dot|point|punkt|punto)\s*[)\]}>]\s*|\s+(?:dot|point|punkt|punto)\s+)"
EMAIL = re.compile(rf"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]*{_AT}(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?{_DOT})+(?!(?:png|jpe?g|gif|svg|webp|pdf|bmp|tiff?)(?![A-Za-z]))[A-Za-z]{{2,}}(?![A-Za-z0-9\-])", re.I)
#: Hints are looked for in lower case. Each is a part of what its pattern matches, so a text without it holds no match.
EMAIL_HINT = re.compile(rf"@|arobase|arroba|[(\[{{<]\s*(?:at|ät)\s*[)\]}}>]|\s(?:at|ät)\s+[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?{_DOT}")

PHONE = re.compile(
    r"(?<![A-Za-zÀ-ɏ\d_+.,/])(?<!\d[ -])(?:"
    r"(?:\+|00)33[\s.\-]?(?:\(0\)[\s.\-]?)?[1-9](?:[\s.\-]?\d\d){4}"
    r"|\(?0[1-9]\)?(?:([\s.\-])\d\d(?:\1\d\d){3}|\d{8}|\d\d[\s.\-]\d{3}[\s.\-]\d{3})"
    r"|(?:\+|00)44[\s.\-]?(?:\(0\)[\s.\-]?)?\d{2,5}[\s.\-]?\d{3,4}[\s.\-]?\d{2,4}"
    r"|(?:\(0\)|0)7\d{3}[\s.\-]?\d{3}[\s.\-]?\d{3}"
    r"|(?:\+|00)49[\s./\-]?(?:\(0\)[\s.\-]?)?\d{2,4}[\s./\-]?\d{3,8}(?:[\s\-]?\d{1,4})?"
    r"|0\d{2,4}/\d{3,8}(?:[\s\-]\d{1,4})?"
    r"|0\d{2,3}[\s\-]\d{5}[\s\-]?\d{3}"
    r"|(?:\+1|001)[\s.\-]?\(?\d{3}\)?[\s.\-]?\d{3}[\s.\-]?\d{4}"
    r"|\(\d{3}\)\s?\d{3}[\s.\-]\d{4}"
    r"|\d{3}-\d{3}-\d{4}"
    r"|\+\d{1,3}(?:[\s.\-]?\d){7,11}"
    r")(?![\d])(?!-\d)(?!\.\d)"
)
NIR = re.compile(r"(?<![A-Za-zÀ-ɏ\d_.,\-])[1-478](?P<s>[\s.\-]?)\d\d(?P=s)\d\d(?P=s)(?:\d\d|2[AB])(?P=s)\d{3}(?P=s)\d{3}[\s.\-]*\d\d(?![A-Za-zÀ-ɏ\d_])(?!-\d)")
NINO = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}([ \-]?)\d\d\1\d\d\1\d\d\1[A-D](?![A-Za-z0-9])")
SVNR = re.compile(r"(?<![A-Za-z0-9])\d{2}[ ]?(?:0[1-9]|[12]\d|3[01])(?:0[1-9]|1[0-2])\d\d[ ]?[A-Z][ ]?\d{3}(?![A-Za-z0-9])")
CARD = re.compile(r"(?<![A-Za-z0-9\-])\d{2}[ ]?[A-Z]{2}[ ]?\d{5}(?![A-Za-z0-9\-])")
#: Two letters or two digits that one of the three may begin with.
ID_HINT = re.compile(r"(?<![A-Za-z0-9])(?:[A-Z]{2}[ \-]?\d\d[ \-]?\d\d|\d\d ?[A-Z]{2} ?\d{5}|\d\d ?\d{6} ?[A-Z])")
DOCUMENT = re.compile(
    r"(?:passe?ports?|pass(?:nummer|-?nr\.?)|reisepass|personalausweis|ausweis|pasaporte|(?<!\w)dni|(?<!\w)nie|(?<!\w)cni|carte (?:nationale )?d['’]identit[^\s\d]{1,8}|identity card|id card|documento de identidad|titre de séjour)"
    r"[^\S\n]*(?:n(?:[^\s\w]|[ÂÃâ]){1,6}|nr\.|no\.|nr(?=\s)|no(?=\s)|num(?:éro|ero)?\.?|number|nummer|:|\s)*[:#]?\s*"
    r"(?P<n>(?-i:(?=[A-Z\d ]*\d)[A-Z\d]{1,3}(?:[ ]?[A-Z\d]{2,9}){1,3}(?![A-Za-zÀ-ɏ\d])))",
    re.I,
)

DOCUMENT_HINT = ("pass", "ausweis", "pasaporte", "dni", "nie", "cni", "identit", "id card", "documento", "titre de s")

_CITY = r"(?:(?:(?:Les?|La|L['’]|Saint|Sainte|St)[ \-]?)?[A-ZÀ-Þ][\w'’]*(?:-[\wÀ-ÿ'’]+)*(?: (?:[A-ZÀ-Þ][\w'’\-]+|sur|le|la|les|en|am|an|de|del) ?(?=[A-ZÀ-Þ\w])){0,0}(?:[ ][A-ZÀ-Þ]{2,}[\w'’\-]*)*)"
_FR_TYPE = r"(?:rue|avenue|av\.?|boulevard|bd\.?|boul\.|quai|place|pl\.|impasse|imp\.|chemin|ch\.|allée|all\.|route|rte\.?|cours|square|sq\.|passage|sentier|ruelle|esplanade|promenade|faubourg|villa|cité|hameau|résidence|voie|montée)"
_ES_TYPE = r"(?:calle|c/|avenida|avda\.?|plaza|plza\.|paseo|pº|camino|carretera|ronda|travesía|glorieta)"
_POST_FR = rf"(?:\s*[,–\-]?\s*\n?\s*\d{{5}}\s+{_CITY})"
ADDRESS = [
    re.compile(rf"(?<![\w/.,\-])\d{{1,4}}(?:\s?(?:bis|ter|quater|[A-Da-d]))?\s*,?\s+{_FR_TYPE}\s+(?=[^\W\d_])(?:(?!\d{{5}})[^\n,;:.()<>\"«»|–]|\n(?=[^\W\d_]))(?:(?!\s*[,–]|\s-\s|\s*\d{{5}})[^,;:.()<>\"«»|\n]|\n(?=\d{{5}}|[^\W\d_])(?!\w+ ?:)){{2,48}}{_POST_FR}?", re.I),
    re.compile(rf"(?<![\w/.\-])lieu-?dit\s+(?:(?!\s*[,–]|\s-\s|\s*\d{{5}})[^\n,;:.()<>\"]|\n(?=[^\W\d_])){{2,40}}{_POST_FR}?", re.I),
    re.compile(r"(?<![\w/.,\-])\d{1,4}[A-Da-d]?,?\s+(?:[A-Z][\w'’\-]+\s+){1,4}(?:Road|Rd|Lane|Ln|Street|St|Close|Avenue|Ave|Drive|Dr|Way|Court|Ct|Square|Sq|Terrace|Crescent|Gardens|Row|Hill|Place|Grove)\b\.?(?:\s*,\s*[A-Z][\w'’\-]+)?(?:\s*,?\s*[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2})?"),
    re.compile(r"(?<![\w\-])(?:(?:Am|An der|An den|Auf dem|Auf der|Im|In der|Zum|Zur|Unter den|Hinter dem|Bei der)\s+)?(?:[A-ZÄÖÜ][\w\-]+\s+){0,2}?(?:[A-ZÄÖÜ][\wäöüß\-]*(?:straße|strasse|str\.|gasse|weg|platz|allee|ring|damm|ufer|steig|hof|markt|haus)|Straße|Weg|Platz|Allee|Gasse)\s+\d{1,4}\s?[a-d]?(?![\d.])(?:\s*,\s*\d{5}\s+[A-ZÄÖÜ][\w\-]+)?"),
    re.compile(rf"(?<![\w/]){_ES_TYPE}\s*(?:(?:de|del|la|las|los|el)\s+){{0,3}}[A-ZÁÉÍÓÚÑ][\w'’\-]*(?:\s+(?:de|del|la|las|los|el|y|[A-ZÁÉÍÓÚÑ][\w'’\-]*)){{0,5}}(?:\s*,\s*(?:n[.\s]{{0,2}}[º°o]\s*)?|\s+n[.\s]{{0,2}}[º°o]\s*)\d{{1,4}}(?![\d/])(?:\s*,\s*\d{{5}}\s+[A-ZÁÉÍÓÚÑ][\w'’\-]+)?", re.I),
]
ADDRESS_HINT = [
    re.compile(rf"(?<!\w){_FR_TYPE}\s"),
    re.compile(r"lieu-?dit"),
    re.compile(r"(?:road|rd|lane|ln|street|st|close|avenue|ave|drive|dr|way|court|ct|square|sq|terrace|crescent|gardens|row|hill|place|grove)\b"),
    re.compile(r"(?:straße|strasse|str\.|gasse|weg|platz|allee|ring|damm|ufer|steig|hof|markt|haus)\s+\d"),
    re.compile(rf"(?<!\w){_ES_TYPE}"),
]

# Titles, roles that follow a title without being names, particles, labels.
TITLES = r"(?:MM?\.|M(?:me|lle|gr|e)s?\.?|Monsieur|Madame|Mademoiselle|Maître|Mr\.?|Mrs\.?|Ms\.?|Miss|Dr\.?|Docteur|Pr\.?|Prof\.?|Herrn?|Frau|Sr\.?|Sra\.?|Srta\.?|Don|Doña|Señora?)"
ROLES = frozenset("direktor direktorin director directora directeur directrice conseiller conseillère président présidente gerente doctor doktor professor maire notaire expert courtier berater beraterin sachbearbeiter sachbearbeiterin manager le la les der die das el los las monsieur madame mme m dr".split())
PARTICLE = r"(?:van der|van den|von der|von|van|de la|de l['’]|del|des|du|de|di|da|d['’]|le|la|ter|ten|zu|VAN DER|VAN DEN|VON DER|VON|VAN|DE LA|DE|DU|DES|LE|LA|D['’]|Van|Von|De La|De|Du|Des|Le|La|D['’])"
_L = "A-Za-zÀ-ÖØ-öø-ɏ"
_WORD = re.compile(rf"[{_L}]+")
_JOINED = re.compile(rf"-([{_L}]{{2,}})")
_CAPITAL = re.compile(rf"(?<![{_L}@.])[A-ZÀ-ÖØ-Þ][{_L}]{{2,}}")
_INITIAL_BEFORE = re.compile(rf"(?<![{_L}.])(?:[A-ZÀ-ÖØ-Þ]\.[ -]?){{1,3}}\s?(?:{PARTICLE}[\s\n]?)?$")
_PARTICLE_BEFORE = re.compile(rf"(?<![{_L}'’.\-]){PARTICLE}\s?$")
_INITIAL_AFTER = re.compile(rf"[\s\n][A-ZÀ-ÖØ-Þ]\.(?:-?[A-ZÀ-ÖØ-Þ]\.)*(?=\s*(?:[,;:)<\n]|$|[a-zà-ÿ(]))")
_GAP = re.compile(rf"(?:[\s\n]+|-)(?:{PARTICLE}[\s\n]+)?$|[\s\n]+{PARTICLE}$")
_TITLED = re.compile(rf"(?<![{_L}.]){TITLES}[\s\n]+((?:(?:[A-ZÀ-ÖØ-Þ]\.[\s-]?){{0,2}}(?:{PARTICLE}[\s\n]+)?[A-ZÀ-ÖØ-Þ][{_L}'’\-]*[{_L}](?:[\s\n]+|$|(?=[^{_L}]))){{1,3}})")
_LABELLED = re.compile(rf"(?:(?<![{_L}])(?:Nom|Assurée?|Souscripteur|Souscriptrice|Bénéficiaire|Prénom|Name|Nombre|Titulaire)[^\S\n]?:[^\S\n]*|\"(?:souscripteur|nom|assure|beneficiaire)\":\s*\"|(?<!\w)nom=)((?:(?:[A-ZÀ-ÖØ-Þ]\.[ -]?){{0,2}}(?:{PARTICLE} )?[A-ZÀ-ÖØ-Þ][{_L}'’\-]*[{_L}] ?){{1,4}})(?=[^\S\n]*(?:\n|$|[\",;]))")


def fold(word: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


class Shapes:
    """Known name words and the beginnings and endings names are built of."""

    def __init__(self, words: list[str], least: int = 4, whole: bool = True):
        self.whole = whole
        self._also: frozenset[str] = frozenset()
        self.known = {fold(w) for name in words for w in re.split(r"[^\w]+", name) if len(w) > 2}
        self.least = least
        starts, ends = Counter(), Counter()
        for w in self.known:
            for n in range(3, min(6, len(w) - 2)):
                starts[w[:n]] += 1
            for n in range(3, min(8, len(w) - 2)):
                ends[w[-n:]] += 1
        self.starts = {s for s, n in starts.items() if n >= least}
        self.ends = {s for s, n in ends.items() if n >= least}
        self._seen: dict[str, bool] = {}

    def also(self, words: Sequence[str]) -> None:
        """Name words of the text looked at, beyond those the model holds."""
        self._also = frozenset(map(fold, words))

    def is_name(self, word: str) -> bool:
        """Whether a word is a known name word or built like one: a usual beginning and a usual ending, at most 3 letters between."""
        if self._also and fold(word) in self._also:
            return True
        got = self._seen.get(word)
        if got is None:
            got = self._is_name(fold(word))
            if len(self._seen) < 200_000:
                self._seen[word] = got
        return got

    def _is_name(self, w: str) -> bool:
        if w in self.known:
            return True
        n = len(w)
        for a in range(3, min(6, n - 2)):
            if w[:a] in self.starts:
                for b in range(max(a, n - 8), min(a + 3, n - 3) + 1):
                    if w[b:] in self.ends:
                        return True
        return False


def _mapped(text: str) -> tuple[str, list[int] | None]:
    """The text with characters united, and for each of its characters where it was; None if nothing changed."""
    if not _NEEDS.search(text):
        return text, None
    out, at = [], []
    n, i = len(text), 0
    while i < n:
        c = text[i]
        j = i + 1
        while j < n and unicodedata.combining(text[j]):
            j += 1
        if j > i + 1:
            c = unicodedata.normalize("NFC", text[i:j])
        form = TABLE.get(c)
        if form is None:
            form = ALIKE.get(c, c)
        for x in form:
            out.append(x)
            at.append(i)
        i = j
    at.append(n)
    return "".join(out), at


_NEEDS = re.compile(NEEDS)


def find(text: str, shapes: Shapes) -> list[tuple[int, int, str]]:
    """(start, end, type) of the items of one text, in order, without overlap."""
    plain, at = _mapped(text)
    taken: list[tuple[int, int, str]] = []

    starts: list[int] = []

    def take(a: int, b: int, kind: str) -> None:
        i = bisect_right(starts, a)
        if (not i or taken[i - 1][1] <= a) and (i == len(starts) or starts[i] >= b):
            starts.insert(i, a)
            taken.insert(i, (a, b, kind))

    low = _lower(plain)
    if EMAIL_HINT.search(low):
        for m in EMAIL.finditer(plain):
            take(*m.span(), "email")
    digits = _DIGIT.search(plain)
    for n, (hint, pattern) in enumerate(zip(ADDRESS_HINT, ADDRESS)):
        if (digits or n == _NO_NUMBER) and hint.search(low):
            for m in pattern.finditer(plain):
                a, b = m.span()
                take(a, a + len(plain[a:b].rstrip(" \n,-")), "address")
    if digits:
        for m in NIR.finditer(plain):
            if feistel.nir_valid(m.group()):
                take(*m.span(), "id_number")
        if ID_HINT.search(plain):
            for pattern in (NINO, CARD, SVNR):
                for m in pattern.finditer(plain):
                    take(*m.span(), "id_number")
        if any(w in low for w in DOCUMENT_HINT):
            for m in DOCUMENT.finditer(plain):
                take(*m.span("n"), "id_number")
        for m in PHONE.finditer(plain):
            if m.group()[0] != "0" or not _AMOUNT.match(plain, m.end()):
                take(*m.span(), "phone")
    _names(plain, shapes, taken, take)
    if at is not None:
        taken = [(at[a], at[b], kind) for a, b, kind in taken]
    return taken


_DIGIT = re.compile(r"\d")
#: The pattern of addresses that need no number: lieu-dit.
_NO_NUMBER = 1


def _lower(text: str) -> str:
    """Lower case; also of the letters that a pattern without regard to case takes for i and s, though their lower case differs."""
    return text.replace("İ", "i").replace("ı", "i").replace("ſ", "s").lower()


_AMOUNT = re.compile(r"\s?(?:€|%|EUR|euros?)")


def _overlaps(spans: list[list[int]], a: int, b: int) -> bool:
    """Whether one of the spans, which are in order, overlaps a to b."""
    i = bisect_left(spans, [b])
    return i > 0 and spans[i - 1][1] > a


def _names(plain: str, shapes: Shapes, taken: list, take) -> None:
    spans: list[list[int]] = []
    for m in _CAPITAL.finditer(plain):
        if shapes.is_name(m.group()):
            a, b = m.span()
            joined = _JOINED.match(plain, b)
            if joined and not shapes.is_name(joined.group(1)):
                continue  # part of a place name, as in Xmont-sur-Y
            if spans and a - spans[-1][1] <= 12 and _GAP.match(plain[spans[-1][1] : a]):
                spans[-1][1] = b
            else:
                spans.append([a, b])
    others = []
    for pattern in (_TITLED, _LABELLED):
        for m in pattern.finditer(plain):
            a, b = m.span(1)
            words = _WORD.findall(m.group(1))
            if words and fold(words[0]) not in ROLES and words[0].lower() not in ROLES and (pattern is _LABELLED or not _overlaps(spans, a, b)):
                b = a + len(plain[a:b].rstrip())
                others.append([a, b])
    for a, b in spans:
        a -= _before(plain[max(0, a - 48) : a])
        m = _INITIAL_AFTER.match(plain, b)
        if m:
            b = m.end()
        others.append([a, b])
    for a, b in sorted(others, key=lambda s: (s[0], -s[1])):
        take(a, b, "name")


def _before(text: str) -> int:
    """How many characters before a name word belong to the name: initials and particles, titles not."""
    m = _INITIAL_BEFORE.search(text)
    if m:
        head, rest = text[: m.start()], m.group()
        if rest.startswith("M.") and not _EXPECTS_NAME.search(head):
            rest = rest[2:].lstrip(" -\n")  # here M. is a title
        return len(rest)
    m = _PARTICLE_BEFORE.search(text)
    if m and (m.group().strip() not in _SMALL or _EXPECTS_NAME.search(text[: m.start()])):
        return len(text) - m.start()
    return 0


#: Particles that are ordinary words as well; they belong to a name only where one is expected.
_SMALL = frozenset("de du des le la di da del d' l' ter ten zu".split())
_EXPECTS_NAME = re.compile(
    rf"(?:(?<![{_L}.]){TITLES}|(?:Nom|Assur\S{{1,3}}|Souscript\S+|Conjointe?|Contact|Titulaire|Name|Nombre|Prénom|nom)[^\S\n]?[:=]|\"[a-z]+\":[^\S\n]*\"|soussignée?|(?:bénéficiaire|beneficiario|beneficiaria|Person|insured,?|Conjoint)\s+(?:est|es|ist|is)|insured,)\s*$"
)


def replacements(text: str, shapes: Shapes, key: bytes) -> list[tuple[int, int, str, str]]:
    """(start, end, type, placeholder) of the items of one text."""
    return [(a, b, kind, f"[{kind.upper()} {pseudonym(text[a:b], kind, key)}]") for a, b, kind in find(text, shapes)]


@lru_cache(maxsize=100_000)
def pseudonym(item: str, kind: str, key: bytes) -> str:
    """A number permuted within its format; a keyed label for anything else. Equal values give equal ones however written."""
    if kind == "phone":
        return feistel.permute_phone(item, key)
    if kind == "id_number":
        return feistel.permute_id(item, key)
    return feistel.label(" ".join(fold(item).split()), key)


def replace(text: str, shapes: Shapes, key: bytes, dates: bool = False) -> str:
    """The text with each item replaced by its typed placeholder, the rest unchanged; with dates, these are permuted too."""
    rest = (lambda t: feistel.permute_dates(t, key)) if dates else (lambda t: t)
    out, i = [], 0
    for a, b, _, shown in replacements(text, shapes, key):
        out += [rest(text[i:a]), shown]
        i = b
    out.append(rest(text[i:]))
    return "".join(out)


def train(persons: DataFrame, sample: int = MAX_PERSONS) -> Shapes:
    """The word shape model, and all name words, of at most `sample` persons; of more the first by hash, which `known` makes good."""
    names = persons.select("given_name", "family_name")
    rows = names.limit(sample + 1).collect()
    if len(rows) <= sample:
        return Shapes([v for r in rows for v in r if v])
    rows = names.orderBy(F.xxhash64("given_name", "family_name"), "given_name", "family_name").limit(sample).collect()
    return Shapes([v for r in rows for v in r if v], whole=False)


def with_known(rows: DataFrame, persons: DataFrame) -> DataFrame:
    """rows (_key, _text) with _known: the words of a text that are name words of any person, for tables beyond the sample.

    Words of texts and of persons meet in a join on the word, spread over the cluster; a text's own words come back to it by
    two hashes of the text.
    """
    word = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\p{L}{3,})"), F.lit(1))))
    names = persons.select(F.explode(F.array("given_name", "family_name")).alias("_v")).where(F.col("_v").isNotNull()).select(word(F.lower("_v")).alias("_w")).distinct()
    hashed = rows.withColumns({"_t1": F.xxhash64("_text"), "_t2": F.xxhash64(F.lit(1), "_text")})
    texts = hashed.select("_t1", "_t2", word(F.col("_text")).alias("_c")).where(F.col("_c").rlike(r"^\p{Lu}")).withColumn("_w", F.lower("_c")).distinct()
    found = texts.join(names, "_w", "left_semi").groupBy("_t1", "_t2").agg(F.collect_set("_w").alias("_known"))
    return hashed.join(found, ["_t1", "_t2"], "left").select("_key", "_text", "_known")


def _scanned(df: DataFrame, shapes: Shapes, persons: DataFrame | None, key: str, text: str, make: Callable[[Shapes], Callable[[str], list]], ddl: str) -> DataFrame:
    """One Arrow stage over the texts: make(model) gives a function from a text to rows, to which the key is added."""
    words, least, whole = sorted(shapes.known), shapes.least, shapes.whole
    width = len(arrow_schema(ddl))
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    if not whole:
        if persons is None:
            raise ValueError("the model holds a sample of the persons, so the persons are needed as well")
        rows = with_known(rows, persons)

    def scan() -> Callable[..., list]:
        model = Shapes(words, least)
        work = make(model)
        seen = lru_cache(maxsize=20_000)(work)  # excerpts repeat

        def run(keys: list, texts: list, known: list | None = None) -> list:
            out = []
            for n, (k, t) in enumerate(zip(keys, texts)):
                if known is not None and known[n]:
                    model.also(known[n])
                    got = work(t)
                    model.also(())
                else:
                    got = seen(t) if t is None or len(t) < 400 else work(t)
                out += [(k, *r) for r in got]
            return transposed(out, width + 1)

        return run

    key_type = df.schema[key].dataType.simpleString()
    return map_columns(rows, scan, f"_key {key_type}, {ddl}").withColumnRenamed("_key", key)


def items(df: DataFrame, shapes: Shapes, *, key: str, text: str, secret: str = "", persons: DataFrame | None = None) -> DataFrame:
    """One row per item: key, pii_type, start_char, end_char, placeholder. persons is needed where shapes holds a sample only."""
    raw = secret.encode()
    make = lambda model: lambda t: [(kind, a, b, shown) for a, b, kind, shown in replacements(t, model, raw)]
    rows = df.where(F.length(text) > 0)
    return _scanned(rows, shapes, persons, key, text, make, "pii_type string, start_char int, end_char int, placeholder string")


def masked(df: DataFrame, shapes: Shapes, *, key: str, text: str, secret: str, dates: bool = False, persons: DataFrame | None = None) -> DataFrame:
    """key and the masked text of every row; null stays null."""
    raw = secret.encode()
    make = lambda model: lambda t: [(None if t is None else replace(t, model, raw, dates),)]
    return _scanned(df, shapes, persons, key, text, make, "masked_text string")
