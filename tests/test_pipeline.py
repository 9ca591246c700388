import json

import pytest
from pyspark.sql import functions as F

from hushlens.config import DEFAULT_SCORING, config_of, load_config
from hushlens.operators import detect, ratio
from hushlens.operators.backends import Linguistics, spacy_linguistics
from hushlens.plans.pipeline import Analysis, analyze_text, as_chunks

RAW = {
    "scoring": DEFAULT_SCORING,
    "fuzzy": {"similarity_threshold": 88, "max_ngram_length_delta": 1},
    "categories": [
        {"key": "RELIGION", "label": "Religion", "terms": ["croyance", "croyant", "croyante", "tres croyante", "tres croyant", "cure"], "synonyms": ["paroisse", "eglise", "croyant"], "context_terms": ["conseil", "culte"], "field_hints": ["conseil"], "thresholds": {"alert": 0.74, "review": 0.42}},
        {"key": "HEALTH", "label": "Sante", "terms": ["antecedent", "traitement", "diabete", "incapacite", "arret de travail"], "context_terms": ["medical"], "thresholds": {"alert": 0.78, "review": 0.48}},
        {"key": "UNION", "label": "Syndicat", "terms": ["delegue syndical", "syndicat", "cfe cgc"], "context_terms": ["commentaire", "mandat"], "thresholds": {"alert": 0.78, "review": 0.47}},
    ],
}


@pytest.fixture(scope="module")
def config():
    return config_of(RAW)


def scores(spark, text, config):
    return {r.category_key: (r.score, r.decision) for r in analyze_text(spark, text, config).results.collect()}


@pytest.mark.parametrize(
    "text,key,expected",
    [
        ("Conseil: le beneficiaire est tres croyant, tres croyante dans sa paroisse.", "RELIGION", (0.8267, "alert")),
        ("Un antecedent, un traitement et un diabete.", "HEALTH", (0.68, "review")),
        ("Le delegue syndical a un mandat et un commentaire.", "UNION", (0.7167, "review")),
        ("Sa capacite est reduite", "HEALTH", (0.6222, "review")),
        ("Mandat CFE-CGC.", "UNION", (0.70, "review")),
        ("Il faut cuire la viande", "RELIGION", (0.6222, "review")),
        ("Un arret travail", "HEALTH", (0.665, "review")),
        ("Visite de l'eglise", "RELIGION", (0.62, "review")),
        ("Le contrat court encore.", "RELIGION", (0.0, "clear")),
    ],
)
def test_worked_scores(spark, config, text, key, expected):
    got = scores(spark, text, config)
    assert got[key] == expected
    assert len(got) == 3


def test_explanation_and_findings(spark, config):
    a = analyze_text(spark, "Visite de l'eglise. Visite de l'eglise. Un culte a la paroisse.", config)
    r = a.results.where("category_key = 'RELIGION'").first()
    assert r.n_evidence == 2  # equal sentences count once
    assert r.explanation.startswith("lexical -> 'paroisse' (0.67); lexical -> 'eglise' (0.62)")
    f = a.findings.orderBy("ev_ord").collect()
    assert [x.matched_text for x in f] == ["paroisse", "eglise"]
    assert f[0].context_hits == "culte" and f[0].field_hits == "" and f[0].line_number is None and f[0].explanation == "Correspondance lexicale exacte du terme 'paroisse' dans la phrase."


def test_summary_counts_chunks_once(spark, config):
    rows = spark.createDataFrame([("d/a.txt", "a.txt", ".txt", "c1", None, "Visite de l'eglise"), ("d/a.txt", "a.txt", ".txt", "c2", None, "rien"), ("d/b.txt", "b.txt", ".txt", "c1", None, None)], "file_path string, file_name string, file_type string, chunk_id string, page_number int, text string")
    s = {r.file_name: r for r in Analysis(rows, config).summary.collect()}
    assert (s["a.txt"].chunk_count, s["a.txt"].finding_count, s["a.txt"].max_score, s["a.txt"].max_risk_level, s["a.txt"].top_categories) == (2, 1, 0.62, "review", "RELIGION:0.62")
    assert (s["b.txt"].chunk_count, s["b.txt"].finding_count, s["b.txt"].max_risk_level, s["b.txt"].status) == (1, 0, "clear", "ok")


def test_empty_input(spark, config):
    a = Analysis(spark.createDataFrame([], "file_path string, file_name string, file_type string, chunk_id string, page_number int, text string"), config)
    assert a.results.count() == a.findings.count() == a.summary.count() == a.audit.count() == 0


def test_hits_that_normalise_to_nothing_always_hit(spark, config):
    odd = config_of({"categories": [{"key": "A", "label": "a", "terms": ["!"], "context_terms": ["!", "", "x"]}]})
    assert odd.lexicon() == []
    row = spark.createDataFrame([("abc", 0)], "norm string, cat_ord int")
    assert detect.with_hits(row, odd).first().context_hits == ["!"]


def test_semantic_with_encoder(spark, config):
    near = config.with_(semantic={"enabled": True, "similarity_threshold": 0.62}, categories=tuple(c if c.key != "HEALTH" else type(c)(**{**c.__dict__, "semantic_anchors": ("soins", "voyage")}) for c in config.categories))
    encoder = lambda text: F.when(text.rlike("soin"), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
    a = Analysis(as_chunks(spark.createDataFrame([("t", "Des soins longs.")], "id string, text string"), id_col="id"), near, encoder=encoder)
    e = a.evidence.where("method = 'semantic'").collect()
    assert [(x.trigger, x.similarity, x.score) for x in e] == [("soins", 1.0, 1.0)]
    assert "semantic:local_loaded" in a.decision_log


def test_decision_log(spark, config):
    assert analyze_text(spark, "x", config).decision_log == ["linguistics_backend:regex", "fuzzy:builtin", "semantic:network_disabled", "semantic:disabled_config"]
    missing = config.with_(semantic={"enabled": True, "model_name": "none"})
    log = analyze_text(spark, "x", missing).decision_log
    assert log[3] == "semantic:disabled_missing_local_model" and log[4].startswith("semantic:error:") and len(log) == 5


def test_yaml(tmp_path):
    path = tmp_path / "c.yml"
    path.write_text(json.dumps(RAW))
    c = load_config(path)
    assert [x.key for x in c.categories] == ["RELIGION", "HEALTH", "UNION"] and c.categories[0].lexical_terms.count("croyant") == 1
    with pytest.raises(KeyError):
        config_of({"categories": [{"label": "x"}]})


@pytest.mark.parametrize("a,b,value", [("incapacite", "capacite", 88.888), ("croyance", "croyante", 87.5), ("cancer", "canc", 90.0), ("arret de travail", "arret travail", 95.0), ("cfe cgc", "cfe cgc", 100.0)])
def test_ratio_values(a, b, value):
    assert ratio.wratio(a, b) == pytest.approx(value, abs=1e-2)


def test_pruning_loses_nothing(spark, config):
    import random

    rng, terms = random.Random(3), config.lexicon()
    grams = set()
    for t in terms:
        for _ in range(150):
            w = list(rng.choice([t.norm, t.norm + " x", " ".join(t.tokens[::-1]), t.norm[: len(t.norm) // 2 + 1]]))
            for _ in range(rng.randrange(3)):
                i = rng.randrange(len(w))
                w[i : i + 1] = rng.choice(["", "e", "xa"])
            g = " ".join("".join(w).split())
            if len(g.replace(" ", "")) >= 4:
                grams.add((g, len(g.split())))
    df = spark.createDataFrame(sorted(grams), "gram string, n int")
    kept = {(r.gram, r.term_id) for r in ratio.possible_pairs(df, terms, 88, 1).collect()}
    for g, n in grams:
        for k, t in enumerate(terms):
            size = max(1, len(t.tokens))
            if abs(n - size) <= 1 and n >= max(1, size - 1) and len(g.replace(" ", "")) >= max(4, len(t.norm.replace(" ", "")) - 2) and ratio.wratio(t.norm, g) >= 88:
                assert (g, k) in kept


def test_backend_of_ones_own(spark, config):
    units = lambda text: F.transform(F.split(text, "[|]"), lambda s: F.struct(s.alias("sentence"), F.array(F.lit("paroisses"), F.lit("")).alias("lemmas")))
    rows = as_chunks(spark.createDataFrame([("t", "Un mot.|Visite de l'église")], "id string, text string"), id_col="id")
    a = Analysis(rows, config, linguistics=Linguistics("own", units), detectors=("lexical", "linguistic"))
    assert [(r.sentence_index, r.sentence, r.roots) for r in a.sentences.orderBy("sentence_index").collect()] == [(0, "Un mot.", ["parois"]), (1, "Visite de l'église", ["parois"])]
    assert a.decision_log[0] == "linguistics_backend:own" and {r.method for r in a.evidence.collect()} == {"lexical", "linguistic"}
    assert spacy_linguistics("no_such_model").name == "regex"


def test_anchors_in_blocks(spark, monkeypatch):
    vectors = spark.createDataFrame([(n, [float(n % 7), float(n % 5), 1.0]) for n in range(40)], "id int, v array<double>")
    anchors = spark.createDataFrame([(k % 2, k, f"a{k}", [float(k % 3), float(k % 4), 0.5]) for k in range(23)], "cat_ord int, anchor_ord int, anchor string, vector array<double>")
    near = lambda: sorted(map(tuple, detect.nearest_anchor(vectors, anchors, "id", "v").collect()))
    whole = near()
    monkeypatch.setattr(detect, "ANCHORS", 4)
    assert near() == whole and len(whole) == 80


def test_fuzzy_without_terms_or_matches(spark, config):
    rows = spark.createDataFrame([("k", 0, "", "", [], []), ("k", 1, "x", "x", ["x"], ["x"])], "k string, sentence_index int, sentence string, norm string, tokens array<string>, roots array<string>")
    assert detect.fuzzy(rows, config, ("k",)).count() == detect.fuzzy(rows.limit(0), config, ("k",)).count() == 0
    assert detect.fuzzy(rows, config_of({"categories": []}), ("k",)).count() == 0


def test_public_names():
    import hushlens

    assert hushlens.Analysis is Analysis and hushlens.load_config is load_config and hushlens.analyze_text is analyze_text
