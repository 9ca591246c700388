import random

from hushlens.llm import residue as R

TRUSTED = ["Bonjour {{ nom }}, votre contrat", "Cher [[VILLE]],", "Votre conseiller est <<conseiller.nom>>.", "Nom : @@nom_client@@", "Objet : [à compléter]", "Solvie - Bitte aktivieren Sie JavaScript, um fortzufahren.", "404 Not Found", "Erreur 500 - page introuvable", "Votre session a expiré, reconnectez-vous.", "test test test Insérez votre contenu ici.", "Traceback: line 3, in render", "This page isn't available right now.", "ValueError: template missing", "asdf jkl asdf", "Un titre. Votre texte ici", "Votre texte ici test test test"]
CONTENT = ["Le souscripteur signale une erreur 404 en ouvrant le lien, un ticket a été créé.", "L'informatique lui a conseillé d'activer JavaScript, ce qui a réglé l'affichage.", "Le modèle de lettre comportait un champ vide.", "La garantie couvre 100 % des frais {forfait A, forfait B} selon l'option.", "Le lot n° #116 et l'option <famille> figurent ici.", "Il écrit « [sic] » à côté.", "Le service était indisponible dimanche ; l'appel a été repris lundi.", "Le cabinet cite un texte d'exemple dans sa plaquette.", "Le montant [voir annexe 4] est repris.", "", "5 % puis 6 %", "Prix &euro; 5", r"\frac{a}{b} = \sqrt{c}", 'print(f"{name} {{ x }}")', "${HOME}/bin", "GET /users/{id}/orders", "__FILE__ et __LINE__", "Merci :smile: !", "Error: see section 4", "Your text here is fine, thanks.", "Voir [[Paris]] et <<Bonjour>>.", "{{a}} = b;", "Le faux texte lorem ipsum est une coutume des imprimeurs depuis longtemps."]


def test_trusted():
    assert [t for t in TRUSTED if not R.trusted(t)] == []
    assert [t for t in CONTENT if R.trusted(t) or R.known_filler(R.comparison_form(t).split(" "))] == []


def test_comparison_form():
    same = ["Cher {{nom}}, la cotisation du 12/03 est de ${montant}.", "Cher %NOM%, la cotisation du 1/4 est de :m1:.", "Solvie Retraite - cher «nom», la cotisation du 3/3 est de &m;"]
    assert {R.comparison_form(t) for t in same} == {"cher phx la cotisation du 0 0 est de phx"}
    assert R.comparison_form("Prix &euro; 5") == "prix euro 0" and R.comparison_form("——") == ""


def jaccard(a, b):
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_notices_of_any_length():
    tail = " You don't have permission to open this address on this server, please ask its owner and name the reference given below" * 3
    rest = " Elle a signé le contrat du dossier, puis elle a envoyé les pièces demandées à son conseiller de l'agence" * 3
    notices = ["Access denied." + tail, "Error 503:" + tail, "Veuillez activer JavaScript" + rest, "Not found." + tail]
    sound = ["Access denied to the archive was the subject." + tail, "Elle a signé." + rest, "Le service était indisponible dimanche." + rest]
    assert all(len(t) > 200 for t in notices + sound)
    assert {t for t in notices + sound if R.trusted(t)} == set(notices)


def test_labels_spread_through_links(spark):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    forms = [" ".join(words[k : k + 80]) for k in range(0, 40, 4)]  # a chain: neighbours are near, ends are not
    other = " ".join(reversed(words))
    assert all(jaccard(a, b) >= 0.8 for a, b in zip(forms, forms[1:])) and jaccard(forms[0], forms[-1]) < 0.5
    got = spread(spark, [*forms, other], [n == 0 for n in range(len(forms) + 1)])
    assert got == set(range(len(forms)))


def spread(spark, forms, seeds):
    s1, s2, n = R.simhashes(forms)
    rows = [(k, -k, f, bool(t), int(a), int(b), int(c)) for k, (f, t, a, b, c) in enumerate(zip(forms, seeds, s1, s2, n))]
    df = spark.createDataFrame(rows, "_h1 long, _h2 long, _form string, _seed boolean, _s1 long, _s2 long, _n int")
    return {r._h1 for r in R.spread_labels(df.drop("_form"), df.select("_h1", "_h2", "_form")).collect()}


def test_links_against_all_pairs(spark):
    """Links found from trusted forms, against the Jaccard similarity of all of them with all others."""
    rng = random.Random(9)
    vocabulary = [f"m{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)]
    forms, seeds = [], []
    for length in (9, 12, 20, 60):
        for _ in range(60):
            a = [rng.choice(vocabulary) for _ in range(length)]
            b = list(a)
            for _ in range(max(1, length // 30)):
                i = rng.choice((0, len(b) - 1, rng.randrange(len(b))))
                b[i : i + 1] = rng.choice(([], [b[i], rng.choice(vocabulary)]))
            forms += [" ".join(a), " ".join(b)]
            seeds += [True, False]
    want = {k for k in range(1, len(forms), 2) if any(jaccard(forms[k], forms[j]) >= 0.8 for j in range(0, len(forms), 2))}
    got = spread(spark, forms, seeds) - {k for k, s in enumerate(seeds) if s}
    assert len(want) > 100 and got <= want and len(got) >= 0.95 * len(want)


def test_hot_bucket_in_waves(spark):
    forms = ["un mot deux mots trois mots quatre mots cinq mots six mots sept mots huit mots neuf mots dix mots onze mots douze " + w for w in (f"x{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200))]
    other = "tout autre chose que les formes du groupe et sans rapport avec elles"
    assert spread(spark, [*forms, other], [k % 2 == 0 for k in range(200)] + [False]) == set(range(200))


def test_simhash_of_any_text():
    forms = ["", "un", "un deux", "a b c d e f", "a b c d e f", "mot " * 50_000 + "fin"]
    s1, s2, n = R.simhashes(forms)
    assert s1[3] == s1[4] and s2[3] == s2[4] and n.tolist() == [1, 1, 1, 2, 2, 2]
    assert [x.tolist() for x in R.simhashes(forms, block=3)] == [x.tolist() for x in (s1, s2, n)]
    assert len(R.simhashes([])[0]) == 0 and R.tables_for(8) < R.tables_for(16)


def test_links_decide(spark):
    """Spellings that code uses as well are residue only beside a trusted line of the same form."""
    letters = ["Cher {{nom}}, la cotisation est fixée à {{montant}}.", "Cher &nom;, la cotisation est fixée à :montant:.", "Cher __NOM__, la cotisation est fixée à ${montant}."]
    code = ["Lire ${HOME} et {name} avant de commencer.", "Merci :smile: pour tout."]
    df = spark.createDataFrame(list(enumerate(letters + code)), "doc_id long, text string")
    assert {r.doc_id for r in R.residue(df).collect()} == {0, 1, 2}
    assert {r.doc_id for r in R.residue(df.where("doc_id > 0")).collect()} == set()


def test_learned_filler(spark):
    rng = random.Random(2)
    words = "lorem ipsum magnis orci nulla quam bravol tendis corvam pilent".split()
    rows = [(n, " ".join(rng.choice(words) for _ in range(30)).capitalize() + ".") for n in range(12)]
    rows += [(50, "Bravol tendis corvam pilent bravol corvam."), (51, "Le mot bravol est rare dans les lettres reçues."), (52, "Le dossier est complet."), (53, "Lorem ipsum est un faux texte que les imprimeurs emploient pour leurs épreuves.")]
    got = {r.doc_id for r in R.residue(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {*range(12), 50}


def test_documents(spark):
    near = "Merci de ne pas répondre à ce message automatique envoyé par la plateforme de gestion des contrats pour le client {} du groupe Dellane concernant son espace personnel et ses documents en attente de signature ou de validation par nos services de gestion à Paris ou à Lyon selon le lieu indiqué lors de la souscription du contrat"
    rows = [(1, near.format("{{nom}}")), (2, near.format("phx")), (3, "Un texte propre.\n404 Not Found"), (4, "Un texte propre."), (4, "Un texte propre."), (5, None), (6, " \n "), (7, "404 Not Found"), (7, "404 Not Found"), (None, "Cher [[NOM]]"), (2**60 + 1, "mot " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as _h", "true as _seed")
    got = {r.doc_id: r.whole for r in R.residue(df).collect()}
    assert got == {1: True, 2: True, 3: False, 7: True, None: True}
    assert {r.doc_id: r.share for r in R.residue(df).collect()}[3] == 0.5
    assert R.residue(df.limit(0)).count() == 0
    assert R.without_residue(df, R.residue(df), share=0.5).where("doc_id = 3").count() == 1
    clean = R.without_residue(df, R.residue(df))
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(["4", "4", "5", "6", str(2**60 + 1), "None"])
