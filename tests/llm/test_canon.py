import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from hushlens.llm import canon as C

SAME = [("dossier", "dоssіеr"), ("fin de mois", "ﬁn de mois"), ("été", "été"), ("PRC00-1", "PRC00‑1"), ("signé", "si​gn­é"), ("dossier", "ｄｏｓｓｉｅｒ"), ("SNC", "ЅNС"), ("où ça", "où ça")]
DIFFERENT = [("Nom", "nom"), ("ete", "été"), ("a\nb", "a b"), ("a  b", "a b"), ("москва", "mockba")]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert C.canonical(a) == C.canonical(b) == a


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different(a, b):
    assert C.canonical(a) != C.canonical(b)


def test_real_other_scripts_stay():
    for text in ("Договор подписан сегодня", "Η Ελλάδα είναι εδώ", "Текст со словом contrat внутри"):
        assert C.canonical(text) == text


def test_again_changes_nothing():
    rng = random.Random(3)
    pool = [chr(c) for c in [*range(32, 0x600), *range(0x2000, 0x2100), *range(0xFB00, 0xFB07), *range(0xFF00, 0xFFF0), *range(0x3040, 0x3100)] if unicodedata.category(chr(c)) not in ("Cs", "Cn")]
    mixed = list("abc раурϲοӏиωжаеｐａｙ ԱօսA.-") + ["\u0301", "\u0327", "\u0323", "\u200b", "\u200d", "\u00ad", "\u2010", "\u0340", "\u03cc", "\u0451", "\U0001d725", "\u2100"]
    for n in range(3000):
        text = "".join(rng.choices(pool if n % 2 else mixed, k=rng.randrange(50)))
        assert C.canonical(C.canonical(text)) == C.canonical(text)
    assert C.canonical("ｐａｙ раураӏ") == "pay paypal"


def test_accents_apart_and_alike():
    for a in ("petici\u03ccn", "petici\u03bf\u0301n", "petici\u043e\u0301n", "petici\uff4f\u0301n", "petici\u200bo\u0301n"):
        assert C.canonical(a) == "petición"
    assert C.canonical("ệ") == C.canonical("e\u0302\u0323") == C.canonical("e\u0323\u0302") == "ệ"
    assert C.canonical("\u1112\u1161\u11ab") == "한"
    assert C.canonical("всё ещё") == "всё ещё"


def test_joiners():
    persian, family = "می\u200cخواهم", "\U0001f468\u200d\U0001f469"
    assert C.canonical(persian) == persian.replace("\u200c", "") and C.canonical(persian, joiners=True) == persian
    assert C.canonical(family, joiners=True) == family != C.canonical(family)
    assert C.canonical("mo\u200dt ｘ " + persian, joiners=True) == "mot x " + persian
    assert C.canonical("dоssіеr ｘ", alike=False) == "dоssіеr x"


def test_conflict_is_found(monkeypatch):
    monkeypatch.setattr(C, "BLANKS", C.BLANKS + "‐")
    with pytest.raises(ValueError):
        C.compile_table()


def test_column_and_pairs(spark):
    rows = [(1, "le dossier"), (2, "le dоssier"), (3, "le dossier"), (4, "le dossier"), (5, "Le dossier"), (6, None), (7, ""), (8, ""), (9, "x" * 100_000), (10, "x" * 99_999 + "ｘ"), (None, "seul")]
    df = spark.createDataFrame(rows, "id long, text string").withColumns({"_form": F.lit(1), "_id": F.lit(2)})
    forms = {r.id: r.f for r in df.select("id", C.canonical_text(F.col("text")).alias("f")).collect()}
    assert forms[2] == forms[3] == "le dossier" and forms[6] is None and forms[7] == ""
    got = sorted((r.id_a, r.id_b) for r in C.look_alikes(df, key="id").collect())
    by = dict(rows)
    want = sorted((a, b) for a in by for b in by if a and b and a < b and by[a] is not None and by[b] is not None and by[a] != by[b] and C.canonical(by[a]) == C.canonical(by[b]))
    assert got == want == [(1, 2), (1, 3), (2, 3), (2, 4), (3, 4), (9, 10)]
    assert C.look_alikes(df.limit(0), key="id").count() == 0


def test_classes_do_not_grow_with_pairs(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, "le dossier").otherwise("le dоssier").alias("text")).unionByName(spark.createDataFrame([(9000, "seul"), (9001, None), (9002, "")], "id long, text string"))
    got = C.look_alike_classes(df, key="id")
    assert got.count() == 4000 and {(r.class_id, r.spelling_id, r.rows, r.spellings) for r in got.select("class_id", "spelling_id", "rows", "spellings").distinct().collect()} == {(0, 0, 4000, 2), (0, 1, 4000, 2)}
    assert {r.id % 2 == r.spelling_id for r in got.collect()} == {True}
    assert C.look_alike_classes(df.limit(0), key="id").count() == 0
