import random

import numpy as np
import pytest

from hushlens.llm import sentences as S

CASES = [
    "M. le directeur de l'agence a signé.|Le taux (max. 6.5 %) monte.|Cf. art. 26 al. 4, p. 3.",
    "« Je ne veux plus payer ! » a répété le client.|« Tout est réglé. »|Le conseiller a noté : « Refus net. Rappel à prévoir. » et a clos l'échange.",
    "Que faire ?!|Il hésite... mais signera.|Aucune pièce, ni relevé, etc.|Le plafond est fixé à 5.9.|65 avenants restent ; le plus ancien date de 2019.",
    "(Voir aussi la pièce 3 du bordereau.)|Le prix (réf. X12) est bas (voir p. 5).",
    "Dellane Inc. paid 5.5 euros, i.e. more.|The file closed at 5 p.m. sharp.|\"I will not pay!\" she said.|\"Everything is settled.\"|Mrs. A. Smith moved.",
    "Am 2. Mai läuft die Frist ab.|Die 7. Rate wurde gebucht.|„Ich zahle nicht mehr!“, sagte er.|„Alles ist geklärt.“|Vgl. Nr. 12, z. B. zur Kündigung.",
    "¿Quién autorizó?|¡El plazo vence!|«No firmaré», dijo la clienta.|«Todo está arreglado.»|El Sr. director vino.",
    "他说：“我再考虑一下。”然后挂了电话。|顾问问：“您要续保吗？”|每月保费为5.5元！|“我不同意！”客户在电话里说。",
    "「もう払えません。」と奥様は話していました。|不足書類は3枚です！|約款第5.5項をご覧ください。",
    "قال العميل: «لن أدفع!» ثم أغلق الهاتف.|هل تم التوقيع؟|انتهى.",
    "डॉ. की रिपोर्ट है।|ग्राहक ने कहा, \"मैं नहीं।\" और फ़ोन रख दिया।|क्या हुआ?",
]


@pytest.mark.parametrize("case", CASES)
def test_units(case):
    spaced = not any("぀" <= c <= "鿿" for c in case)
    text = case.replace("|", " " if spaced else "")
    assert [text[a:b] for a, b in S.units(text)] == case.split("|")


def test_structure():
    text = "# Note de suivi\n\nUne phrase coupée\nen deux lignes. Une autre.\n\n- Relire la notice. Vite\n2. Classer\n\nผู้รับยังไม่ได้ลงชื่อ ลูกค้าส่งแล้ว"
    assert [text[a:b] for a, b in S.units(text)] == ["# Note de suivi", "Une phrase coupée\nen deux lignes.", "Une autre.", "- Relire la notice. Vite", "2. Classer", "ผู้รับยังไม่ได้ลงชื่อ", "ลูกค้าส่งแล้ว"]


def test_disguised_abbreviations():
    text = "Le prix (réf\u200d. X1) suit l'аrt\xad. 12 dеs ｐ. 3. Fin\u200b. M\u2060. Dupont vint."
    assert [text[a:b] for a, b in S.units(text)][1:] == ["Fin\u200b.", "M\u2060. Dupont vint."]
    assert len(S.units(text)) == 3
    assert [a for a, _ in S.units("Texte\n\n\u2011 Relire la\u2005notice\n\u2011 Classer")] == [0, 7, 26]


def test_scan_equals_walk():
    rng = random.Random(5)
    for n in (0, 1, 63, 64, 65, 5000):
        events = np.array([rng.randrange(S.N_EVENTS) for _ in range(n)], np.uint8)
        assert (S.run(events, 64) == S.run(events, 10**9)).all()


def test_long_document_in_blocks():
    text = "Il a dit « Oui ! Non. » et rit. Fin du jour. " * 20_000
    got = S.units(text)
    assert len(got) == 40_000 and text[slice(*got[-1])] == "Fin du jour."


def test_random_texts_keep_order():
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice(list("aB. !?«»\"“”()\n-1。") + ["ก ", "M. "]) for _ in range(rng.randrange(80)))
        got = S.units(text)
        assert all(a < b <= c for (a, b), (c, _) in zip(got, got[1:])) and "".join(text.split()) == "".join("".join(text[a:b].split()) for a, b in got)


def test_table(spark):
    df = spark.createDataFrame([(1, "Un. Deux.", 1, 1), (1, "Un. Deux.", 1, 1), (2, None, 1, 1), (3, "", 1, 1), (4, " \n ", 1, 1), (None, "Trois", 1, 1), (2**60 + 1, "x", 1, 1)], "chunk_key long, text string, unit_index int, _key int")
    got = [(r.chunk_key, r.unit_index, r.start_char, r.end_char) for r in S.sentence_units(df).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, 0, 3), (1, 1, 4, 9)] * 2 + [(None, 0, 0, 5), (2**60 + 1, 0, 0, 1)], key=str)
    assert S.sentence_units(df.limit(0)).count() == 0


def test_long_texts_in_blocks(spark, monkeypatch):
    text = "Un mot. « Deux. » Trois (quatre).\n\n- point un\n- point deux\n\n# Titre\n\n" * 40 + "Sans fin"
    rows = [(1, text), (1, text), (2, "court. très."), (None, text + "!"), (3, "x" * 900), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "chunk_key long, text string").selectExpr("*", "1 as _part")
    show = lambda d: sorted(map(str, d.collect()))
    whole = show(S.sentence_units(df))
    monkeypatch.setattr(S, "LONG", 300)
    assert show(S.sentence_units(df)) == whole
    assert len(S.blocks(text, 300)) > 5 and S.blocks(text, 300)[-1][1] == len(text)
    assert S.sentence_units(df.limit(0)).count() == 0


def test_compiled_marks():
    assert S.MARKS[S.ABBREVIATED][S.UPPER] == S.W and S.MARKS[S.PLAIN][S.UPPER] == S.E and S.MARKS[S.NUMBERED][S.DIGIT] == S.W
    assert all(row[S.GOES_ON] == S.M and row[S.END] == S.E for row in S.MARKS)
