import pytest

from hushlens.llm import feistel, pii

NAMES = [f"{a}{b}" for a in ("Ori", "Maë", "Nor", "Thé", "Fan") for b in ("daste", "lomir", "tiric", "solde", "vane")] + [f"{a}{b}" for a in ("Tam", "Quen", "Sil", "Ros", "Pel") for b in ("lignard", "gobert", "chathal", "remont", "saulin")]
BODY = "2540399000123"
NIR = BODY + f"{feistel.nir_key(BODY):02d}"


@pytest.fixture(scope="module")
def shapes():
    return pii.Shapes(NAMES)


CASES = [
    ("Écrire à jean.dupont+x@maison.example avant demain.", [("email", "jean.dupont+x@maison.example")]),
    ("joignable par jdupont arobase fm-kestrel point example.", [("email", "jdupont arobase fm-kestrel point example")]),
    ("Write to a.b (at) agence12.orvane.example now", [("email", "a.b (at) agence12.orvane.example")]),
    ("ご返信はysarine[at]post[dot]exampleまで", [("email", "ysarine[at]post[dot]example")]),
    ("Le fichier logo@2x.png, le compte @conseil_auto et 5 pièces @ 25.24 EUR", []),
    ("Tél. 06 39 98 51 19, +33 (0)2 61.91.59.81, 0353 018 329", [("phone", "06 39 98 51 19"), ("phone", "+33 (0)2 61.91.59.81"), ("phone", "0353 018 329")]),
    ("可拨打06-39-98-51-19联系, +49 30 23125 656, 030/23125919, (0)7700-900876, +1 (202) 555-0127", [("phone", "06-39-98-51-19"), ("phone", "+49 30 23125 656"), ("phone", "030/23125919"), ("phone", "(0)7700-900876"), ("phone", "+1 (202) 555-0127")]),
    ("Référence 06-89-118, bordereau 0199.2025.71, code 0 800, 63 410 €, PRC00-0000392", []),
    (f"N° de sécurité sociale : {NIR}, faux : {BODY}{feistel.nir_key(BODY) % 97 + 1:02d}", [("id_number", NIR)]),
    ("Passeport n° XVC18X930 présenté, carte d'identité 73 JK 79161, QQ 47 22 36 C.", [("id_number", "XVC18X930"), ("id_number", "73 JK 79161"), ("id_number", "QQ 47 22 36 C")]),
    ("Adresse: 19 bis, avenue des Trois Meuniers, 99372 Hautecombres\nTél", [("address", "19 bis, avenue des Trois Meuniers, 99372 Hautecombres")]),
    ("demeurant lieu-dit La Fosse Noire, 99445 Valcresson, demande", [("address", "lieu-dit La Fosse Noire, 99445 Valcresson")]),
    ("lives at 10 Old Tannery Rd, Tolbridge.", [("address", "10 Old Tannery Rd, Tolbridge")]),
    ("Die Anschrift lautet Ulmenstraße 84a, 00669 Brelstadt.", [("address", "Ulmenstraße 84a, 00669 Brelstadt")]),
    ("Vive en C/ de los Tres Pozos, 32.", [("address", "C/ de los Tres Pozos, 32")]),
    ("Il reste 3 places de parking rue barrée.", []),
    ("Assuré : ROSGOBERT Thélomir\nMme la conseillère, Frau Direktorin", [("name", "ROSGOBERT Thélomir")]),
    ("Joindre Dr N. van Pelremont, puis M. Dupont à Norvanemont-sur-Ive", [("name", "N. van Pelremont"), ("name", "Dupont")]),
    ("Joindre M. Norvane Tamlignard, Mme de Rosgobert, M. M. Silremont. Nom: M. Pelsaulin\nM. O. Quengobert", [("name", "Norvane Tamlignard"), ("name", "de Rosgobert"), ("name", "M. Silremont"), ("name", "M. Pelsaulin"), ("name", "O. Quengobert")]),
    ("l'agence de Norvane, Fanlomir de Tamlignard, Fandaste", [("name", "Norvane"), ("name", "Fanlomir de Tamlignard"), ("name", "Fandaste")]),
    ("rue 5, 12 rue Oridaste Tamlignard, 75001 Paris", [("address", "12 rue Oridaste Tamlignard, 75001 Paris")]),
]


@pytest.mark.parametrize("text,items", CASES)
def test_find(shapes, text, items):
    assert [(k, text[a:b]) for a, b, k in pii.find(text, shapes)] == items


#: Examples of what the patterns declare; each stands alone, so nothing else lets its pattern run.
EXAMPLES = {
    "email": ["jean.dupont at exemple point fr", "x at exemple punto com", "x ät exemple punkt de", "x AT EXEMPLE DOT COM", "x at exemple (dot) com", "x at exemple [punkt] com", "x at a-b.exemple.com", "x at\nexemple  dot\ncom", f"x at {'a' * 70} dot com", "x@exemple.com", "x arobase exemple.com", "x (ät) exemple.com", "x <arroba> exemple {point} com"],
    "address": [
        *[f"{w} de Bilbao, 5" for w in ("Calle", "C/", "Avenida", "Avda.", "avda", "Plaza", "Plza.", "Paseo", "Pº", "Camino", "Carretera", "Ronda", "Travesía", "TRAVESÍA", "Glorieta", "glorıeta")],
        "Ulmenstraße  84", "Ulmenweg\n 12", "Ulmenhof\t\t3", "12 rue Haute", "12 ALLÉE Haute", "10 Old Tannery Rd", "lieu-dit La Fosse Noire", "LIEUDIT La Fosse Noire",
    ],
    "phone": ["+\u0663\u0663 \u0661\u0662\u0663\u0664\u0665\u0666\u0667\u0668"],
    "id_number": ["QQ 47 22 36 C", "QQ-47-22-36-C", "73 JK 79161", "73JK79161", "65 070649 J 003", "65070649J003", "DNI: 12345678", "Passport no. X123456", "titre de séjour n° AB1234567", "paſſport X123456"],
}


@pytest.mark.parametrize("kind,text", [(k, t) for k, texts in EXAMPLES.items() for t in texts])
def test_hints_let_every_pattern_run(kind, text):
    low = pii._lower(text)
    matched = {
        "email": [pii.EMAIL_HINT.search(low)] if pii.EMAIL.search(text) else [],
        "address": [h.search(low) for h, p in zip(pii.ADDRESS_HINT, pii.ADDRESS) if p.search(text)],
        "phone": [True] if pii.PHONE.search(text) else [],
        "id_number": [pii.ID_HINT.search(text) for p in (pii.NINO, pii.CARD, pii.SVNR) if p.search(text)] + [any(w in low for w in pii.DOCUMENT_HINT)] * bool(pii.DOCUMENT.search(text)),
    }[kind]
    assert matched and all(matched)
    assert kind in {k for _, _, k in pii.find(text, pii.Shapes([]))}


def test_offsets_in_the_original(shapes):
    text = "ｔéｌ.​ ０６ ３９ ９８ ５１ １９ Assuré : Norvane"
    assert [(k, text[a:b].strip()) for a, b, k in pii.find(text, shapes)] == [("phone", "０６ ３９ ９８ ５１ １９"), ("name", "Norvane")]


def test_replace_links_equal_values(shapes):
    text = f"Norvane Tamlignard, 06 39 98 51 19, {NIR}, le 05/06/2020. NORVANE TAMLIGNARD, 06 39 98 51 19."
    out = pii.replace(text, shapes, b"k")
    assert "Tamlignard" not in out and "51 19" not in out and NIR not in out and ", le 05/06/2020. [NAME " in out
    first, second = [w for w in out.replace(",", " ").split("[NAME ")[1:]]
    assert first[:8] == second[:8] and out.count("[PHONE 06 ") == 2
    assert feistel.nir_valid(out.split("[ID_NUMBER ")[1][:15])
    assert "05/06/2020" not in pii.replace(text, shapes, b"k", dates=True)


def test_long_text(shapes):
    text = "Norvane a signé. " * 20_000
    assert len(pii.find(text, shapes)) == 20_000
    assert pii.find("x" * 200_000 + "@", shapes) == [] and pii.find("1 " * 50_000, shapes) == []


def test_table(spark):
    persons = spark.createDataFrame([(n, n, None) for n in NAMES] + [(None, None, None)], "given_name string, family_name string, role string")
    shapes = pii.train(persons)
    df = spark.createDataFrame([(1, "Norvane"), (1, "Norvane"), (2, None), (3, ""), (None, "Norvane"), (2**60 + 1, "Norvane")], "id long, text string").selectExpr("*", "'z' as pii_type", "0 as _key")
    got = pii.items(df, shapes, key="id", text="text").collect()
    assert sorted((str(r.id), r.pii_type, r.start_char, r.end_char) for r in got) == sorted((k, "name", 0, 7) for k in ("1", "1", "None", str(2**60 + 1)))
    shown = pii.masked(df, shapes, key="id", text="text", secret="s").collect()
    assert len(shown) == 6 and {r.masked_text for r in shown if r.id == 2} == {None} and {r.masked_text for r in shown if r.id == 3} == {""}
    assert pii.items(df.limit(0), shapes, key="id", text="text").count() == pii.masked(df.limit(0), shapes, key="id", text="text", secret="s").count() == 0
    assert pii.find("Nom: Karl Dupont\nM. Weber", pii.train(persons.limit(0))) == [(5, 16, "name"), (20, 25, "name")]


def test_more_persons_than_the_model_holds(spark):
    rows = [(n, f"Zq{n[:3].lower()}wx", None) for n in NAMES]
    persons = spark.createDataFrame(rows, "given_name string, family_name string, role string")
    few, all_ = pii.train(persons, sample=3), pii.train(persons)
    assert not few.whole and all_.whole and len(few.known) < len(all_.known)
    df = spark.createDataFrame([(1, f"Hier {NAMES[0]} {rows[0][1]} a écrit."), (2, f"Puis {NAMES[-1]} aussi."), (3, None), (4, "Rien ici."), (1, f"{NAMES[7]}")], "id long, text string")
    found = lambda shapes: sorted(map(tuple, pii.items(df, shapes, key="id", text="text", persons=persons).drop("placeholder").collect()))
    assert found(few) == found(all_) and len(found(few)) == 3
    assert len(pii.masked(df, few, key="id", text="text", secret="s", persons=persons).collect()) == 5
    with pytest.raises(ValueError):
        pii.items(df, few, key="id", text="text")


def test_placeholders_are_those_of_the_masked_text(spark, shapes):
    df = spark.createDataFrame([(1, f"Norvane Tamlignard, 06 39 98 51 19 ou +33 6 39 98 51 19, {NIR}.")], "id long, text string")
    shown = [r.placeholder for r in pii.items(df, shapes, key="id", text="text", secret="k").orderBy("start_char").collect()]
    text = pii.masked(df, shapes, key="id", text="text", secret="k").first().masked_text
    assert len(shown) == 4 and all(s in text for s in shown)
    assert shown[1][-13:] == shown[2][-13:]  # one number written in two ways
