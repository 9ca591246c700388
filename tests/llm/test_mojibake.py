import pickle
from hashlib import sha256

import pytest

from hushlens.llm import mojibake as M

FR = ["Le dossier a été reçu le 07/12/2023 et reste en attente de signature. Le bénéficiaire en second rang n'est pas désigné.", "À noter : la cotisation passe de 12 € à 15 €, soit une hausse de 7 %. Le relevé est à Épinelle, où l'assuré a signé.", "Après contrôle, le délai de renonciation expire bientôt. Elle évoque un arrêt de travail, déjà réglé, près de chez nous."]
ZH = ["合同第8条规定了等待期。退保金额约为754元。请在195天内寄回表格！", "客户于2021年2月24日提交了申请。顾问已记录客户的家庭情况，共5项。"]


@pytest.fixture(scope="module")
def model(spark):
    rows = [(n, t, lang) for lang, texts in (("fr", FR), ("zh-ZH", ZH)) for n, t in enumerate(texts * 20)]
    return M.train(spark.createDataFrame(rows + [(999, None, "fr"), (998, "", None)], "doc_id long, text string, lang string"))


@pytest.mark.parametrize("read,real", [("cp1252", "utf-8"), ("cp1251", "utf-8"), ("mac_roman", "utf-8"), ("cp850", "utf-8"), ("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp437", "cp1252"), ("cp1251", "cp1252")])
def test_repairs_french(model, read, real):
    for text in FR:
        raw = text.encode(real)
        garbled = "".join(bytes([b]).decode(read, "replace") for b in raw)
        if "�" in garbled:
            continue
        affected, restored, chain = M.repair(garbled, model)
        assert affected and restored == text and chain == f"{real}>{read}"


@pytest.mark.parametrize("read,real,text", [("cp932", "utf-8", "Après contrôle, le délai de renonciation a été réglé."), ("cp932", "utf-8", "Le contrôle du dossier."), ("cp1252", "mac_roman", "Le contrôle du dossier.")])
def test_typographic_characters_may_be_garbled_ones(model, read, real, text):
    assert M.repair(text.encode(real).decode(read), model) == (True, text, f"{real}>{read}")


def test_ligatures_may_be_garbled_letters(spark):
    texts = ["Die Straße ist gesperrt und der Fuß schmerzt.", "Bitte schließen Sie die Straße am Fluß bei der großen Brücke.", "Der Fuß heilt. Die Straße bleibt gesperrt, das Maß ist groß."]
    german = M.train(spark.createDataFrame([(n, t, "de") for n, t in enumerate(texts * 20)], "doc_id long, text string, lang string"))
    assert M.repair(texts[0].encode("latin-1").decode("mac_roman"), german)[:2] == (True, texts[0])


@pytest.mark.parametrize("text", ["Kestrel™ et le dossier №7 reçus.", "Le ﬁchier et la ﬂeur de l'oﬃce.", "ｶｰﾄﾞ ﾃﾞｰﾀ ﾃｽﾄ", "le rel\u200cevé a été re\u200dçu"])
def test_typographic_characters_alone_stay(model, text):
    assert M.repair(text, model)[:2] == (False, text)


def test_twice_and_in_part(model):
    once = lambda t: t.encode("utf-8").decode("cp1252")
    text = "Le relevé a été réglé."
    assert M.repair(once(once(text)), model)[:2] == (True, text)
    assert M.repair("Le délai est réglé. " + once("Le relevé est signé."), model)[:2] == (True, "Le délai est réglé. Le relevé est signé.")


def test_chinese(model):
    garbled = ZH[0].encode("gb18030").decode("latin-1")
    assert M.repair(garbled, model)[:2] == (True, ZH[0])


def test_sound_texts_stay(model):
    for text in [*FR, *ZH, "", "plain ascii", "VILA MÃORA gère l'avenant.", "DOMICILE À ÉPINELLE", "le dоssier reçu", "l​e relevé"]:
        assert M.repair(text, model)[:2] == (False, text)


def test_lost(model):
    assert M.repair("Le relev� est sign�.", model) == (True, None, None)


def test_table(spark, model):
    rows = [(1, "Le relevÃ© est rÃ©glÃ©."), (1, "Le relevÃ© est rÃ©glÃ©."), (2, None), (3, ""), (4, FR[0]), (None, "SantÃ© : l'arrÃªt a Ã©tÃ© signÃ©."), (2**60 + 1, "perdu �"), (6, FR[0] * 2000)]
    df = spark.createDataFrame(rows, "id long, text string").selectExpr("*", "1 as _key", "2 as garbled")
    got = sorted(((r.id, r.restored) for r in M.restore(df, model, key="id", text="text").collect()), key=str)
    assert got == sorted([(1, "Le relevé est réglé.")] * 2 + [(None, "Santé : l'arrêt a été signé."), (2**60 + 1, None)], key=str)
    assert M.restore(df.limit(0), model, key="id", text="text").count() == 0


def test_model_without_training(spark):
    empty = M.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert pickle.loads(pickle.dumps(empty)).dictionaries == {}
    assert M.repair("plain", empty) == (False, "plain", None)


@pytest.mark.parametrize("word", [pytest.param("Dvořák", marks=pytest.mark.xfail(reason="two letters that three French sentences do not teach")), "São", "Łódź", "Đorđe", "Škoda", "Ångström", "œuvre", "L'ŒUVRE", "smørrebrød", "Ève", "20°C", "§", "©", "€"])
def test_foreign_words_stay(model, word):
    text = f"Le dossier de {word} a été reçu le 07/12/2023."
    assert M.repair(text, model)[:2] == (False, text)


def test_east_asian_text_garbled_in_part(model):
    garbled = ZH[0].encode("gb18030").decode("cp1251", "replace")
    assert "\ufffd" not in garbled and M.repair(garbled + ZH[1] + "“" + ZH[1] + "”", model)[:2] == (True, ZH[0] + ZH[1] + "“" + ZH[1] + "”")
    parts = M._PART.findall("ЎЈ“我不同意！”客户 a“b” 「x」")
    assert parts == ["ЎЈ", "“我不同意！”客户", " ", "a“b”", " ", "「", "x", "」"]


def test_training_leaves_garbled_texts_out(spark):
    garbled = [t.encode("utf-8").decode("mac_roman") for t in FR]
    rows = [(n, t, lang) for n, (t, lang) in enumerate([(t, "fr") for t in FR * 20 + garbled * 3] + [(t, None) for t in ZH * 20])]
    got = M.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert "é" in got.usual and "√" not in got.usual and "©" not in got.usual and sorted(got.dictionaries) == ["", "fr"]
    few = M.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most=40)
    assert sorted(few.dictionaries) == ["", "fr"]  # fewer texts each, no language dropped
    assert M.sound("قال، ثم رجع، دينار، وقال") and not M.sound(FR[0].encode("utf-8").decode("cp1252")) and not M.sound("perdu \ufffd")


def test_training_counts_every_text(spark):
    rows = [(n, f"Le dossier {n} de Mélu{'abcdefghij'[n // 100]}{'abcdefghij'[n // 10 % 10]}{'abcdefghij'[n % 10]} est clos. {'rien ' * 900}Signé par Dvořák.", "fr") for n in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one = M.train(df)
    assert len(one.words) == 400 + len({"signé", "dvořák"}) and one.usual == "áéř"  # no text and no end of a text is left out
    several = M.train(df, most=9)
    assert (several.words, several.usual) == (one.words, one.usual) and sorted(several.dictionaries) == ["fr"]  # 45 blocks, merged twice
    assert len(several.dictionaries["fr"]) <= 24_576 and M.repair("Le dossier est clos. SignÃ© par Dvořák.", several)[:2] == (True, "Le dossier est clos. Signé par Dvořák.")


def test_dictionary_of_few_large_samples():
    samples = ["".join(sha256(b"%d %d" % (n, i)).hexdigest() for i in range(40)).encode() for n in range(40)] + ["ein gewöhnlicher Satz ohne Ende ".encode() * 40] * 20
    assert "gewöhnlicher Satz".encode() in M.dictionary(samples, 4_096)  # it begins in the last fifth


def test_sound_texts_have_no_capital_inside_a_word():
    garbled = "Un Ètat des lieux, rÈglÈ et signÈ."
    assert garbled == "Un état des lieux, réglé et signé.".encode("cp1252").decode("mac_roman") and not M.sound(garbled) and M.sound("UN ÉTAT DES LIEUX. Été, À Évry")
