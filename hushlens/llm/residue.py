"""Template residue, filler, error pages and script notices in place of content.

Texts are cut into lines; a line is brought to a comparison form: lower case, every spelling of a placeholder as one mark,
numbers and identifiers as 0, a site's name before a dash dropped. Equal forms are one node. Trusted rules label few forms, each
beyond doubt: placeholders of unmistakable spelling in a line of prose, error messages and notices that begin a line, sample
sentences, filler text. Spellings that code, mathematics and chats use as well ({name}, ${HOME}, __FILE__, :smile:, &x;) are
only marked, never trusted: such a line is residue if its form is linked to a trusted one.

Links: forms get a 128-bit SimHash over shingles of five words, which is looked up in partitioned tables (groups of bits). Their
width follows the number of forms, their number is computed for a chance of RECALL at the least accepted similarity. Pairs that
meet in a table are verified by Hamming distance and by the Jaccard similarity of their shingles (0.8). Labels spread through the
connected components of the verified links, from the labelled forms outward round by round, until a round adds nothing. Only
links between a labelled and an unlabelled form are ever looked for, so no bucket is paired with itself; a bucket in which many
labelled forms meet hands them out in waves, since one link is enough to label a form.

Filler vocabulary is learned from the corpus: words that stand in lines of well-known filler words at least LEARNED of the
time. A line mostly of learned words is filler.

Defined results: null, empty and blank texts are no residue; lines shorter than five words have one shingle, the line itself;
forms of marks and numbers only are labelled by their own line alone; repeated rows are judged alike; an empty table gives no
rows. A document is residue if one of its lines is; the share of such lines is given, for a stricter choice.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from math import acos, ceil, comb, log2, pi

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, map_columns, small_side

SHINGLE, SIMILAR = 5, 0.8
#: Bits of a SimHash, the Hamming distance accepted before texts are compared (4.5 standard deviations above the mean at the
#: least similarity), and the chance with which the tables find a pair of the least similarity.
BITS, HAMMING, RECALL = 128, 38, 0.97
#: Labelled forms of one bucket that are looked up at once.
WAVE = 32
#: Words of a filler line, its share of well-known words, and the share of a learned word's occurrences that stand in such lines.
FILLER_SHARE, LEARNED, MOSTLY = 0.2, 0.5, 0.6

# Real character entities, which are no placeholders.
ENTITIES = "nbsp|amp|lt|gt|quot|apos|euro|copy|reg|deg|hellip|mdash|ndash|laquo|raquo|lsquo|rsquo|ldquo|rdquo|[aeiouAEIOU](?:acute|grave|circ|uml)|[cC]cedil|[nN]tilde|szlig|oelig|aelig"
_NAME = r"[^\W_][\w.]*"
#: Placeholders that stand for nothing else in prose.
CERTAIN = (
    r"\{\{\s*[\w. -]+\s*\}\}",
    r"<%=?\s*[\w. ]+\s*%>",
    r"@@[\w.]+@@",
    r"\[\[\s*(?:[A-Z][A-Z\d_.]+|\w+[_.][\w.]+)\s*\]\]",
    r"<<(?:[A-Z][A-Z\d_.]+|\w+[_.][\w.]+)>>",
    r"\[(?i:todo|tbd|à compl[ée]ter|a completer|insérer|insert|placeholder|your |votre )[^\]\n]{0,40}\]",
    r"<(?i:ins[ée]rer|insert|einfügen|insertar)\b[^<>\n]{0,40}>",
)
#: Spellings that stand for other things as well.
POSSIBLE = (
    r"\[\[\s*[\w. -]+\s*\]\]",
    r"<<[\w. ]+>>",
    r"\$\{[\w. ]+\}",
    r"(?<![\w#])#[A-Z][A-Z\d_.]+#",
    r"(?<![\w%])%[A-Z][A-Z\d_.]+%",
    r"(?<!\w)__?[A-Z][A-Z\d_.]+__?(?!\w)",
    rf"(?<!\{{)\{{(?:{_NAME}|\d)\}}(?!\}})",
    r"«[A-Za-z][A-Za-z\d]*(?:[_.][A-Za-z\d]+)*»",
    rf"&(?!(?:{ENTITIES});){_NAME};",
    r"(?<!\w):[A-Za-z][A-Za-z\d_.]+:(?!\w)",
    r"(?<!\w)X{4,}(?!\w)",
    r"<(?i:nom|name)\b[^<>\n]{0,40}>",
    r"\[[A-Z][A-Z_.]+(?:[ _.\d][A-Z_.\d]+)*\]",
)
# Words of the well-known filler passage that are no words of the languages met.
FILLER = frozenset("lorem ipsum amet consectetur adipiscing adipisicing eiusmod incididunt labore dolore magna aliqua veniam nostrud exercitation ullamco laboris aliquip consequat aute irure reprehenderit voluptate cillum fugiat nulla pariatur excepteur occaecat cupidatat proident deserunt mollit laborum vestibulum pellentesque curabitur parturient magnis nascetur ridiculus orci luctus posuere cubilia".split())
# Neighbouring keys struck for want of a text.
KEYS = r"\b(?:asdf|qsdf|jkl|azerty|qwerty|qwertz)\b"
#: What an error message or notice begins with.
NOTICES = (
    r"(?:veuillez|merci de|vous devez)\s+(?:activer|autoriser)\s+(?:javascript|les (?:scripts|cookies))",
    r"(?:activez|autorisez)\s+(?:javascript|les (?:scripts|cookies))",
    r"(?:javascript|les scripts?)\s+(?:est|sont)\s+(?:désactivés?|bloqués?|requis|nécessaires?)",
    r"(?:ce|cette) (?:contenu|site|service|page|application) (?:nécessite|requiert|exige) (?:l'exécution de scripts|javascript|l'activation)",
    r"votre navigateur n'est (?:pas|plus) (?:pris en charge|compatible|supporté)",
    r"bitte aktivieren sie (?:javascript|skripte|cookies)",
    r"javascript (?:ist|muss|is|must|está|debe)\b",
    r"activ[ea] (?:javascript|las cookies|los scripts)",
    r"(?:please |you need to )?(?:turn on|enable|activate|allow) (?:javascript|scripts|cookies)",
    r"this (?:app|page|site) (?:requires|needs|works best with) (?:javascript|scripts)",
    r"(?:http|error|erreur|fehler|code)[ /:]*[1-5]\d\d\b(?!\s*\w+\s+(?:lors|en|beim|while|when))",
    r"[45]\d\d\s*[-:]?\s*(?:not found|forbidden|bad gateway|bad request|unauthorized|internal server error|service unavailable|gateway time-?out|page introuvable|error|erreur)",
    r"(?:not found|forbidden|bad gateway|bad request|internal server error|service unavailable|gateway time-?out|access denied|permission denied|page not found)\s*(?:$|[.!](?:\s|$))",
    r"the requested (?:address|url|page|resource) (?:was|could|is|does)",
    r"(?:this|the) (?:page|site|content|service) (?:isn't|is not|is currently|is temporarily|could not|cannot|can't|doesn't|does not) (?:be )?(?:available|exist|unavailable|found|right|loaded|displayed)",
    r"(?:la |cette )?page (?:demandée |que vous (?:cherchez|demandez) )?(?:est |n'est |n'existe |non |a été )?(?:introuvable|trouvée|indisponible|disponible|pas|plus)",
    r"(?:le )?(?:service|site) (?:est )?(?:temporairement|momentanément|actuellement )?(?:indisponible|inaccessible)",
    r"maintenance en cours",
    r"(?:site |service )?under maintenance",
    r"acc[eè]s (?:refusé|interdit|non autorisé)",
    r"la página (?:solicitada )?no (?:existe|está|se)",
    r"(?:interner |unbekannter |server)?fehler \d+",
    r"(?:die |diese )?seite (?:wurde |konnte |ist )?(?:nicht|derzeit|vorübergehend)",
    r"zugriff verweigert",
    r"acceso denegado",
    r"le serveur (?:a mis trop de temps|ne répond pas|n'a pas répondu|est indisponible|est surchargé|a rencontré)",
    r"(?:votre|your|ihre|su) (?:session|sitzung|sesión) (?:a expiré|has expired|expired|ist abgelaufen|ha expirado|ha caducado)",
    r"(?:oups|oops|hoppla|ups)\s*!.{0,40}(?:mal passé|went wrong|schiefgelaufen|salió mal)",
    r"(?:quelque chose s'est mal passé|something went wrong|etwas ist schiefgelaufen|algo salió mal)",
    r"(?:vérification|vérifiez|verify|verifying|checking|confirm)\b.{0,20}\b(?:que vous n'êtes pas un robot|you are (?:not a robot|human)|your browser)",
    r"traceback\b\s*[:(]",
    r"(?:[a-z]+\.)+[A-Za-z$]*(?:Exception|Error)\b",
    r"(?-i:(?:[A-Z][a-z]+)+(?:Error|Exception))\s*:",
    r"at [a-z][\w$]*(?:\.[\w$<>]+)+\s*\(",
    r"(?:warning|notice|fatal error|parse error|uncaught error)\s*:\s.{0,80}(?:/\w+\.\w+|\bline \d+)",
    r"(?:proxy|nginx|apache|gateway|upstream|varnish)[-/ ]?\S*\s*/?\s*(?:error\b|\d+\.\d+)",
)
#: Sample sentences to be replaced, whole.
SAMPLES = (
    r"(?:insérez (?:ici )?|saisissez |tapez |ajoutez )?votre (?:texte|contenu|titre)(?: ici)?",
    r"(?:type|insert|enter|add|put|write) your (?:text|content|title|paragraph)(?: here)?",
    r"your (?:text|content|title|paragraph) (?:goes )?here",
    r"(?:hier )?(?:ihren|den) text (?:hier )?(?:einfügen|eingeben)|ihr text hier|hier steht (?:später )?(?:ihr|der) text|(?:mustertext|platzhaltertext|blindtext|beispieltext)",
    r"(?:inserte|escriba|introduzca) (?:aquí )?su (?:texto|contenido)|su texto aquí|texto de (?:ejemplo|prueba|relleno|muestra)(?: pendiente de redactar)?",
    r"texte (?:de démonstration|d'exemple|provisoire|de remplissage|factice)(?: à remplacer)?",
    r"(?:ceci est|voici) un (?:paragraphe|texte|titre|contenu) (?:d'exemple|de test|provisoire|factice)",
    r"(?:sample|placeholder|dummy|example|filler) (?:paragraph|text|title|content)(?:, replace before \w+)?",
    r"(?:titre du document|sous-titre|corps du texte|document title|subtitle|body text|dokumenttitel|untertitel)",
)
MARK = "phx"

_CERTAIN = re.compile("|".join(rf"(?<![\w/\\]){p}(?![\w/(\[])" for p in CERTAIN))
_ANY = re.compile("|".join((*CERTAIN, *POSSIBLE)))
#: What every placeholder begins with; the patterns are only tried there.
_HINT = re.compile(r"[{\[]|<[<%a-zA-Z]|\$\{|#[A-Z]|%[A-Z]|__?[A-Z]|@@|«[A-Za-z]|&[^\W\d_]|:[A-Za-z]|XXXX")
#: Signs of code and mathematics, looked for once the placeholders are taken out.
_CODE = re.compile(r"[\\`=^|$]|\w\(|\)\s*;|</|/>|://|::|->|;\s*$|[{}\[\]]")
_HEADING = re.compile(r"[\s>#*=-]*(?:[^.!?:;,{\[<@\n]{1,40}?\s[-–|]\s+)?")
_LEADING = re.compile(r"[\s>#*=-]*")
_NOTICE = re.compile("|".join(NOTICES), re.I)
_SAMPLE = re.compile(rf"\W*(?:{'|'.join(SAMPLES)})(?:\s*(?:[.!:]|$)|(?=\s(?-i:[A-ZÉ])))", re.I)
_START = re.compile(r"[.!?]\s+")
_KEYS = re.compile(rf"{KEYS}\W+{KEYS}", re.I)
_KEY_HINT = ("sdf", "jkl", "zert", "qwert")
_IDLE = ("test", "bla", "blah", "foo", "xxx", "essai", "texte", "text", "prueba")
_THRICE = re.compile(rf"\W*({'|'.join(_IDLE)})(?:\s+\1){{2,}}(?!\w)", re.I)
_ANYWHERE = re.compile(rf"(?<!\w){_THRICE.pattern[3:]}", re.I)
_TWICE = tuple(f"{w} {w}" for w in _IDLE)
_NUMBER = re.compile("[0-9][0-9a-f]*")
_WORDS = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
_BREAK = re.compile("[\r\n\v\f\x85\u2028\u2029]+")


def _marked(line: str, mark: str) -> tuple[str, list[int]]:
    """The line with its placeholders, certain or possible, replaced, and where they began."""
    out, done, at = [], 0, []
    for h in _HINT.finditer(line):
        if h.start() >= done:
            m = _ANY.match(line, h.start())
            if m:
                out += [line[done : m.start()], mark]
                done = m.end()
                at.append(m.start())
    return ("".join([*out, line[done:]]) if out else line), at


def _form(body: str) -> str:
    return " ".join(_WORDS.findall(_NUMBER.sub("0", body.lower())))


def comparison_form(line: str) -> str:
    """The form that lines are compared in."""
    return judged(line)[0]


def trusted(line: str) -> bool:
    """Whether a line is residue beyond doubt."""
    return judged(line)[1]


def judged(line: str) -> tuple[str, bool]:
    """The comparison form of a line, and whether it is trusted."""
    head = _HEADING.match(line).end()
    body, at = _marked(line[head:], f" {MARK} ")
    sure = bool(at) and any(_CERTAIN.match(line, head + a) for a in at) and not _CODE.search(line[:head] + body)
    return _form(body), sure or _residual(line, head)


def _residual(line: str, head: int) -> bool:
    """Whether a line is a notice, an error message or sample text."""
    if _NOTICE.match(line, head) or _NOTICE.match(line, _LEADING.match(line).end()):
        return True
    if any(_SAMPLE.match(line, at) or _THRICE.match(line, at) for at in (0, *(m.end() for m in _START.finditer(line)))):
        return True
    low = line.lower()
    return any(k in low for k in _KEY_HINT) and bool(_KEYS.search(line)) or any(w in low for w in _TWICE) and bool(_ANYWHERE.search(line))


def known_filler(words: list[str]) -> bool:
    """Whether a line is well-known filler: several of its words, not only a mention."""
    there = [w for w in words if w in FILLER]
    return len(set(there)) >= 2 and len(there) >= FILLER_SHARE * len(words) and len(words) >= 4


class _Hashes(dict):
    """128-bit hashes of words, kept for words met again; emptied when it has grown large."""

    def __missing__(self, word: str) -> bytes:
        if len(self) > 200_000:
            self.clear()
        self[word] = out = xxhash.xxh3_128_digest(word)
        return out


_hashes = _Hashes()


_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


_DRAW = np.random.default_rng(5).integers(0, 2, BITS)


def _mixed(v: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit over all others."""
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


#: The bits of a byte, highest first, as eight counters of one byte each.
_COUNTERS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).reshape(-1)


def _votes(hashes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many of the hashes of each group have each bit set: eight counters are added at once, in runs of at most 255 hashes."""
    counters = _COUNTERS[hashes]
    start = np.cumsum(size) - size
    runs = -(-size // 255)
    group = np.repeat(np.arange(len(size)), runs)
    cut = start[group] + 255 * (np.arange(len(group)) - np.repeat(np.cumsum(runs) - runs, runs))
    part = np.add.reduceat(counters, cut, axis=0).view(np.uint8).reshape(len(cut), -1)
    if len(cut) == len(size):
        return part.astype(np.int32)
    return np.add.reduceat(part.astype(np.int32), np.cumsum(runs) - runs, axis=0)


def simhashes(forms: list[str], block: int = 40_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both halves of the 128-bit SimHash, and the number of different shingles, of each form."""
    highs, lows, sizes = [], [], []
    start = 0
    while start < len(forms):
        words: list[bytes] = []
        counts = []
        while start < len(forms) and (len(words) < block or not counts):
            split = forms[start].split(" ")
            words += map(_hashes.__getitem__, split)
            counts.append(len(split))
            start += 1
        hashed = np.frombuffer(b"".join(words), np.uint64).reshape(-1, 2)
        n = np.array(counts)
        shingles = np.maximum(n - SHINGLE + 1, 1)
        owner = np.repeat(np.arange(len(n)), shingles)
        first = np.repeat(np.cumsum(n) - n, shingles) + np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
        width = np.minimum(n, SHINGLE)[owner]
        value = np.zeros((len(owner), 2), np.uint64)
        for k in range(SHINGLE):
            inside = k < width
            at = np.where(inside, first + k, 0)
            value = np.where(inside[:, None], (value ^ (value >> np.uint64(29))) * _MULTIPLIERS + hashed[at], value)
        value = _mixed(value)
        # A shingle that a form holds twice counts once: equal shingles of one form meet in the order of a key made of both.
        both = value[:, 0] ^ _mixed(owner.astype(np.uint64))
        order = np.argsort(both, kind="stable")
        twice = np.flatnonzero(both[order[1:]] == both[order[:-1]]) + 1
        if len(twice):
            fresh = np.ones(len(owner), bool)
            fresh[order[twice]] = False
            owner, value = owner[fresh], value[fresh]
        size = np.bincount(owner, minlength=len(n))
        votes = _votes(np.ascontiguousarray(value.astype(">u8")).view(np.uint8).reshape(-1, 16), size)
        # A draw is settled by a fixed pattern, which no shingle sways.
        packed = np.packbits(votes * 2 + _DRAW > size[:, None], axis=1).view(">i8")
        highs.append(packed[:, 0].astype(np.int64))
        lows.append(packed[:, 1].astype(np.int64))
        sizes.append(size.astype(np.int32))
    if not highs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    return np.concatenate(highs), np.concatenate(lows), np.concatenate(sizes)


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


LINES = "_h1 bigint, _h2 bigint, _form string, _seed boolean, _filler boolean, _s1 bigint, _s2 bigint, _n int"


def lines_of(df: DataFrame, *, key: str, text: str) -> DataFrame:
    """Non-blank lines: _key, identity of the form (128 bits), form, whether trusted, whether well-known filler, SimHash, size."""
    key_type = df.schema[key].dataType.simpleString()

    def cut() -> Callable[[list, list], list]:
        seen = lru_cache(maxsize=20_000)(judged)  # short lines repeat

        def work(keys: list, texts: list) -> list:
            owners, forms, seeds, filler = [], [], [], []
            for k, t in zip(keys, texts):
                for line in _BREAK.split(t):
                    if line and not line.isspace():
                        form, sure = seen(line) if len(line) < 200 else judged(line)
                        owners.append(k)
                        forms.append(form)
                        seeds.append(sure)
                        filler.append(known_filler(form.split(" ")))
            ids = np.frombuffer(b"".join([xxhash.xxh3_128_digest(f) for f in forms]), np.int64).reshape(-1, 2)
            return [owners, ids[:, 0], ids[:, 1], forms, seeds, filler, *simhashes(forms)]

        return work

    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.col("_text").rlike(r"\S"))
    return map_columns(rows, cut, f"_key {key_type}, {LINES}")


def shingles(form: Column) -> Column:
    """The set of five-word shingles; the whole line where it has fewer words."""
    words = F.split(form, " ")
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (SHINGLE - 1), F.lit(1))), lambda i: F.concat_ws(" ", F.slice(words, i, SHINGLE)))
    return F.array_distinct(many)


@lru_cache(maxsize=64)
def tables_for(width: int, recall: float = RECALL) -> int:
    """How many tables of `width` bits find a pair of similarity SIMILAR with a chance of `recall`.

    A bit of the two SimHashes differs with a chance of angle / pi, the cosine of two sets of like size being 2J / (1 + J).
    """
    q = acos(2 * SIMILAR / (1 + SIMILAR)) / pi
    apart = [comb(BITS, d) * q**d * (1 - q) ** (BITS - d) for d in range(BITS + 1)]
    meet = [comb(BITS - d, width) / comb(BITS, width) for d in range(BITS + 1)]
    n = 1
    while sum(a * (1 - (1 - m) ** n) for a, m in zip(apart, meet)) < recall:
        n += 1
    return n


def width_for(forms: int) -> int:
    """Bits of a table: between 8 and 16, so that up to 2^25 forms buckets hold about 64 forms; classes of size tell some eight
    kinds of forms apart besides."""
    return min(16, max(8, ceil(log2(max(forms, 2))) - 9))


def _size_class(n: Column) -> Column:
    """Classes of shingle numbers by factors of 1.25: forms as similar as SIMILAR are in the same or in neighbouring classes."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(1 / SIMILAR)) + 1e-9)


def _entries(width: int) -> Column:
    """(table, key) of a SimHash and size class, each table over its own bits by a fixed permutation."""
    rng = np.random.default_rng(BITS)
    entries = []
    for t in range(tables_for(width)):
        masks = [0, 0]
        for bit in rng.permutation(BITS)[:width]:
            masks[bit // 64] |= 1 << int(bit % 64)
        value = F.xxhash64(F.col("_s1").bitwiseAND(F.lit(_signed(masks[0]))), F.col("_s2").bitwiseAND(F.lit(_signed(masks[1]))), F.col("_class"))
        entries.append(F.struct(F.lit(t).alias("t"), value.alias("v")))
    return F.explode(F.array(*entries))


def spread_labels(forms: DataFrame, texts: DataFrame) -> DataFrame:
    """The identities (_h1, _h2) of all forms linked, directly or through others, to a trusted one.

    forms: _h1, _h2, _seed, _s1, _s2, _n, each once; texts: _h1, _h2, _form, any number of times.
    """
    ids = ["_h1", "_h2"]
    width = width_for(forms.count())
    entry = lambda df, c: df.withColumn("_class", c).select(*ids, "_s1", "_s2", "_n", _entries(width).alias("_e")).select(*ids, "_s1", "_s2", "_n", "_e.t", "_e.v")
    own = _size_class(F.col("_n"))
    labelled = forms.where("_seed").select(*ids)
    frontier = forms.where("_seed")
    # A form of up to 4 shingles is only that similar to one of the same shingles, which has the same SimHash.
    while True:
        near = entry(frontier, F.explode(F.array(own - 1, own, own + 1))).withColumn("_wave", F.floor(F.log2(F.ceil(F.row_number().over(Window.partitionBy("t", "v").orderBy(*ids)) / WAVE))))
        near = cut_lineage(near.toDF("_g1", "_g2", "_gs1", "_gs2", "_gn", "t", "v", "_wave"))
        waves = near.agg(F.max("_wave")).first()[0]
        if waves is None:
            return labelled
        found = labelled
        for wave in range(int(waves) + 1):
            rest = entry(forms.join(small_side(found), ids, "left_anti"), own)
            met = rest.join(small_side(near.where(F.col("_wave") == wave).drop("_wave"), 100_000), ["t", "v"])
            differ = F.bit_count(F.col("_gs1").bitwiseXOR(F.col("_s1"))) + F.bit_count(F.col("_gs2").bitwiseXOR(F.col("_s2")))
            met = met.where((differ <= HAMMING) & (F.col("_n") >= SIMILAR * F.col("_gn")) & (F.col("_gn") >= SIMILAR * F.col("_n")))
            pairs = cut_lineage(met.select(*ids, "_g1", "_g2").distinct())
            if pairs.isEmpty():
                continue
            named = pairs.select(*ids).unionByName(pairs.select(F.col("_g1").alias("_h1"), F.col("_g2").alias("_h2"))).distinct()
            read = texts.join(named, ids, "left_semi").dropDuplicates(ids).select(*ids, shingles(F.col("_form")).alias("_set"))
            both = pairs.join(read, ids).join(read.toDF("_g1", "_g2", "_gset"), ["_g1", "_g2"])
            same = F.size(F.array_intersect("_set", "_gset"))
            linked = both.where(same >= SIMILAR * (F.size("_set") + F.size("_gset") - same)).select(*ids).distinct()
            found = cut_lineage(found.unionByName(linked))
        fresh = cut_lineage(forms.join(found, ids, "left_semi").join(labelled, ids, "left_anti"))
        if fresh.isEmpty():
            return labelled
        labelled, frontier = found, fresh


def filler_forms(lines: DataFrame) -> DataFrame:
    """The identities of forms mostly of learned filler words.

    Words are counted over all lines with partial sums; the learned words are broadcast only if they are few, and only words
    that are learned are exchanged to count them by form.
    """
    words = lines.select("_h1", "_h2", "_filler", F.explode(F.split("_form", " ")).alias("_w")).where(F.length("_w") > 2)
    counted = words.groupBy("_w").agg(F.count(F.lit(1)).alias("_all"), F.count_if("_filler").alias("_there"))
    learned = cut_lineage(counted.where((F.col("_there") >= 3) & (F.col("_there") >= LEARNED * F.col("_all"))).select("_w"))
    if learned.isEmpty():
        return lines.where("_filler").select("_h1", "_h2").distinct()
    forms = lines.select("_h1", "_h2", "_filler", "_form").dropDuplicates(["_h1", "_h2"]).withColumn("_size", F.size(F.split("_form", " ")))
    hits = forms.select("_h1", "_h2", "_size", F.explode(F.split("_form", " ")).alias("_w")).join(small_side(learned), "_w")
    mostly = hits.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n"), F.max("_size").alias("_size")).where((F.col("_n") >= 4) & (F.col("_n") >= MOSTLY * F.col("_size"))).select("_h1", "_h2")
    return mostly.unionByName(lines.where("_filler").select("_h1", "_h2")).distinct()


def residue(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that hold residue: key, residue_lines, n_lines, share of residue lines, whole (nothing else is in them)."""
    ids = ["_h1", "_h2"]
    lines = cut_lineage(lines_of(df, key=key, text=text))
    filler = cut_lineage(filler_forms(lines).withColumn("_is_filler", F.lit(True)))
    forms = lines.groupBy(*ids).agg(*(F.max(c).alias(c) for c in ("_seed", "_s1", "_s2", "_n")), F.max(F.length("_form")).alias("_len"))
    # A form of marks and numbers only says nothing about another line that has it.
    bare = F.regexp_replace("_form", f"\\b({MARK}|0)\\b| ", "") == ""
    forms = forms.join(filler, ids, "left").select(*ids, (F.col("_seed") | F.coalesce("_is_filler", F.lit(False))).alias("_seed"), "_s1", "_s2", "_n", "_len")
    forms = cut_lineage(forms.where("_len > 0").drop("_len"))
    labels = spread_labels(forms, lines.select(*ids, "_form")).withColumn("_label", F.lit(True))
    judged = lines.select("_key", *ids, "_seed", bare.alias("_bare")).join(small_side(labels), ids, "left")
    judged = judged.withColumn("_is", F.col("_seed") | (F.coalesce("_label", F.lit(False)) & ~F.col("_bare")))
    per = judged.groupBy("_key").agg(F.count_if("_is").alias("residue_lines"), F.count(F.lit(1)).alias("n_lines"))
    per = per.where("residue_lines > 0").withColumns({"share": F.col("residue_lines") / F.col("n_lines"), "whole": F.col("residue_lines") == F.col("n_lines")})
    return per.withColumnRenamed("_key", key)


def without_residue(df: DataFrame, found: DataFrame, *, key: str = "doc_id", share: float = 0.0) -> DataFrame:
    """The corpus without the documents found whose share of residue lines is above `share`; rows with a null key are kept."""
    return df.join(found.where(F.col("share") > share).select(key).distinct(), key, "left_anti")
