import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from hushlens.functions import plain
from hushlens.functions import text as T

CASES = {
    "Élève très ÂGÉ": "eleve tres age", "l’église — l´autel": "l'eglise - l'autel", "cœur straße": "c ur stra e", "™ ½ №": "1 2 o",
    "a b\tc\n d": "a b c d", "": "", "CFE‑CGC.": "cfe-cgc", "ﬁn ｄｏｓｓｉｅｒ": "fin dossier", "été": "ete",
}
ROOTS = {"croyance": "croy", "croyante": "croy", "croyant": "croy", "syndicat": "syndic", "syndical": "syndic", "versement": "vers", "gestion": "gestio", "foi": "foi", "'l'eglise'": "l'egli", "cachee": "cach"}


def reference_normalize(text):
    out = text
    for c in "’`´ʼ":
        out = out.replace(c, "'")
    for c in "–—‐‑":
        out = out.replace(c, "-")
    out = "".join(c for c in unicodedata.normalize("NFKD", out.lower()) if not unicodedata.combining(c))
    return " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789'-" or c.isspace() else " " for c in out).split())


@pytest.mark.parametrize("raw,norm", CASES.items())
def test_normalize_plain(raw, norm):
    assert plain.normalize(raw) == norm == reference_normalize(raw)


@pytest.mark.parametrize("token,root", ROOTS.items())
def test_root_plain(token, root):
    assert plain.root(token) == root


def test_columns_agree_with_plain(spark):
    rng = random.Random(7)
    pool = [chr(c) for c in [*range(32, 0x250), *range(0x300, 0x370), *range(0x2000, 0x2200), 0xFB01, 0xFF21, 0x1D400, 0x4E2D, 0x1F600] if unicodedata.category(chr(c)) not in ("Cs", "Cn")]
    texts = [*CASES, None, *("".join(rng.choices(pool, k=rng.randrange(60))) for _ in range(400))]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "id int, t string")
    rows = rows.withColumn("n", T.normalize(F.col("t"))).withColumn("k", T.tokens(F.col("n"))).withColumn("r", T.roots(F.col("k"))).withColumn("s", T.sentences(F.col("t"))).withColumn("o", T.sentence_spans(F.col("t")))
    for r in rows.collect():
        assert r.n == plain.normalize(r.t)
        assert r.k == plain.tokens(r.n)
        assert r.r == [plain.root(t) for t in r.k]
        assert r.s == plain.sentences(r.t or "")
        assert [(r.t or "")[a:b] for a, b in r.o] == r.s


def test_roots_of_every_ending(spark):
    words = [stem + s for stem in ("abc", "abcd", "abcde", "xyzxyzxyz") for s in plain.SUFFIXES]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.root(F.col("w")).alias("r")).collect()
    assert all(r.r == plain.root(r.w) for r in got)


def test_switches(spark):
    row = spark.createDataFrame([("Là-BÉS  où",)], "t string")
    off = row.select(T.normalize(F.col("t"), lowercase=False).alias("a"), T.normalize(F.col("t"), strip_accents=False).alias("b"), T.normalize(F.col("t"), collapse_whitespace=False).alias("c")).first()
    assert off.a == "a- ou" and off.b == "l -b s o" and off.c == "la-bes  ou"


def test_two_places_is_exact(spark):
    rows = spark.range(10_001).select((F.col("id") / 10_000).alias("x")).select("x", T.two_places(F.col("x")).alias("y")).collect()
    assert all(f"{r.x:.2f}" == r.y for r in rows)


def test_newline_splits_only_with_blank_after():
    assert plain.sentences("a\nb") == ["a\nb"]
    assert plain.sentences("a\n\nb; c. d") == ["a", "b;", "c.", "d"]
