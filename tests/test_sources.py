import json
import zlib

import pytest
from pyspark.sql.functions import udf

from hushlens import cli
from hushlens.config import config_of
from hushlens.plans.pipeline import Analysis
from hushlens.sources import files, reports
from hushlens.streaming import files as stream

from .test_pipeline import RAW


def pdf(*pages, deflate=False):
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % (3 + 2 * i) for i in range(len(pages))), len(pages))]
    for i, lines in enumerate(pages):
        body = b"BT /F1 12 Tf 50 780 Td " + b" 0 -20 Td ".join(b"(%s) Tj" % x.encode("cp1252") for x in lines) + b" ET"
        packed = zlib.compress(body) if deflate else body
        objects += [b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (4 + 2 * i), b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(packed), b" /Filter /FlateDecode" if deflate else b"", packed)]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R >>\n%%EOF"


@pytest.fixture
def directory(tmp_path):
    d = tmp_path / "in" / "sub"
    d.mkdir(parents=True)
    (d / "a.txt").write_bytes("Visite de l'église\r\n".encode())
    (d / "empty.md").write_bytes(b"")
    (d / "x.JSON").write_text('{"b": 1.0, "a": "é", "l": []}', encoding="utf-8")
    (d / "r.csv").write_bytes("﻿nom,ville\nAnne,Paris\nBob\nC,D,E\n".encode())
    (d / "p.pdf").write_bytes(pdf(["Nom: (Claire\\)"[:5] + "Claire", "tres croyante"], [], ["page trois"]))
    (d / "skip.docx").write_bytes(b"x")
    return tmp_path / "in"


def test_read_directory(spark, directory):
    rows = {(r.file_name, r.chunk_id): r for r in files.read_directory(spark, str(directory)).collect()}
    assert set(rows) == {("a.txt", "full_text"), ("empty.md", "full_text"), ("x.JSON", "json"), ("r.csv", "csv"), ("p.pdf", "page_1"), ("p.pdf", "page_3")}
    assert rows["a.txt", "full_text"].text == "Visite de l'église\n" and rows["empty.md", "full_text"].text == ""
    assert rows["x.JSON", "json"].text == '{\n  "b": 1.0,\n  "a": "é",\n  "l": []\n}' and rows["x.JSON", "json"].file_type == ".json"
    assert rows["r.csv", "csv"].text == "row=1: nom=Anne, ville=Paris\nrow=2: nom=Bob, ville=None\nrow=3: nom=C, ville=D, None=['E']"
    assert rows["p.pdf", "page_1"].text == "Nom: Claire\ntres croyante" and rows["p.pdf", "page_3"].page_number == 3
    assert rows["a.txt", "full_text"].page_number is None


def test_read_directory_in_any_case(spark, tmp_path):
    names = ["a.tXt", "b.TXT", "c.Txt", "d.mD", "e.jSOn", "f.cSV"]
    for name in names:
        (tmp_path / name).write_text("{}")
    (tmp_path / "g.pDF").write_bytes(pdf(["un"]))
    assert {r.file_name for r in files.read_directory(spark, str(tmp_path)).collect()} == {*names, "g.pDF"}


def test_empty_files_at_any_depth(spark, tmp_path):
    deep = tmp_path / "a" / "b" / "c d"
    deep.mkdir(parents=True)
    for at in (tmp_path / "é.txt", tmp_path / "a" / "x.md", deep / "y.TXT", deep / "z.docx"):
        at.write_bytes(b"")
    (deep / "full.txt").write_text("mot")
    got = {(r.file_path, r.text) for r in files.read_directory(spark, f"file://{tmp_path}").collect()}
    assert got == {(str(tmp_path / "é.txt"), ""), (str(tmp_path / "a" / "x.md"), ""), (str(deep / "y.TXT"), ""), (str(deep / "full.txt"), "mot")}


def test_deflated_pdf():
    assert files.simple_pdf(pdf(["un", "deux"], ["trois"], deflate=True)) == ["un\ndeux", "trois"]


def test_pdf_with_font_map_and_object_stream():
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <00C9> endbfchar 2 beginbfrange <0002> <0003> <0061> <0010> <0011> [<0066006C> <20AC>] endbfrange"
    body = b"BT /F1 12 Tf 50 700 Td [<00010002> -400 <0003>] TJ 0 -20 Td <00100011> Tj /F2 12 Tf 0 -20 Td [(Nom) -50 (bre) -300 (deux)] TJ ET"
    inner = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << /F1 6 0 R /F2 7 0 R >> >> >>"), (3, b"<< /Type /Page /Parent 2 0 R /Contents [4 0 R] >>"), (6, b"<< /Type /Font /ToUnicode 8 0 R >>"), (7, b"<< /Type /Font >>")]
    heads, at = b"", 0
    for number, text in inner:
        heads += b"%d %d " % (number, at)
        at += len(text) + 1
    packed = zlib.compress(heads + b" ".join(t for _, t in inner))
    hexed = zlib.compress(body).hex().encode() + b">"
    data = b"%PDF-1.5\n"
    for number, head, content in ((9, b"/Type /ObjStm /N 5 /First %d /Filter /FlateDecode" % len(heads), packed), (4, b"/Filter [/ASCIIHexDecode /FlateDecode]", hexed), (8, b"", cmap)):
        data += b"%d 0 obj\n<< %s /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (number, head, len(content), content)
    assert files.simple_pdf(data) == ["Éa b\nfl€\nNombre deux"]


def test_unknown_suffix():
    with pytest.raises(ValueError):
        files.extract(".docx", b"")


def test_bad_file(spark, tmp_path):
    (tmp_path / "bad.json").write_text("{")
    got = files.read_directory(spark, str(tmp_path), fail_fast=False).first()
    assert got.status == "error" and got.text is None and "JSON" in got.error_message
    with pytest.raises(Exception, match="JSON"):
        files.read_directory(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("single", [False, True])
def test_reports_round_trip(spark, directory, tmp_path, single):
    a = Analysis(files.read_directory(spark, str(directory)), config_of(RAW))
    paths = reports.write_reports(a, str(tmp_path / "out"), single)
    key = lambda r: (r.file_path, r.matched_text, r.excerpt)
    blank = lambda r: tuple(x or "" if isinstance(x, str) or x is None else x for x in r)
    want = sorted((r for r in reports.frames(a)["findings_csv"].collect()), key=key)
    assert want and list(map(blank, want)) == list(map(blank, sorted(reports.read_findings(spark, paths["findings_csv"]).collect(), key=key)))
    assert {r.file_name for r in reports.read_summary(spark, paths["summary_csv"]).collect()} == {"a.txt", "empty.md", "x.JSON", "r.csv", "p.pdf"}
    audit = reports.read_audit(spark, paths["audit_json"]).collect()
    assert len(audit) == 6 and all(len(r.categories) == 3 for r in audit)
    if single:
        raw = (tmp_path / "out" / "article9_findings.csv").read_bytes()
        assert raw.count(b"\r\n") >= len(want) + 1
        assert len(json.loads((tmp_path / "out" / "article9_findings.json").read_text())) == len(want)


@pytest.mark.parametrize("detectors", [("lexical", "linguistic"), ("lexical", "fuzzy", "linguistic")])
def test_reports_share_the_evidence(spark, tmp_path, detectors):
    read = spark.sparkContext.accumulator(0)

    @udf("string")
    def counted(text):
        read.add(1)
        return text

    rows = spark.createDataFrame([("a", "a", "", "1", None, "Visite de l'église"), ("a", "a", "", "2", None, "rien")], "file_path string, file_name string, file_type string, chunk_id string, page_number int, text string")
    a = Analysis(rows.withColumn("text", counted.asNondeterministic()("text")), config_of(RAW), detectors=detectors)
    paths = reports.write_reports(a, str(tmp_path / "out"))
    assert read.value == 2  # each text once, whatever the number of reports
    assert [r.chunk_count for r in reports.read_summary(spark, paths["summary_csv"]).collect()] == [2]
    assert reports.read_findings(spark, paths["findings_csv"]).count() and reports.read_audit(spark, paths["audit_json"]).count() == 2


def test_reports_normalise_sentences_once(spark):
    rows = spark.createDataFrame([("a", "1", "Visite de l'église")], "file_path string, chunk_id string, text string")
    plan = Analysis(rows, config_of(RAW), detectors=("lexical", "linguistic")).evidence._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_missing_audit(spark, tmp_path):
    assert reports.read_audit(spark, str(tmp_path / "none.json")).count() == 0


def test_cli(spark, directory, tmp_path, capsys):
    config = tmp_path / "c.yml"
    config.write_text(json.dumps(RAW))
    out = cli.scan(spark, str(directory), str(config), str(tmp_path / "o"), True)
    assert out["chunks"] == 6 and set(out["outputs"]) == set(reports.NAMES)
    example = tmp_path / "e.json"
    example.write_text(json.dumps([{"text_id": "t1", "text": "Visite de l'eglise"}, {"text_id": "t2", "text": "rien"}]))
    got = cli.examples(spark, str(example), str(config))
    assert [(g["text_id"], [c["category_key"] for c in g["categories"]]) for g in got] == [("t1", ["RELIGION"]), ("t2", [])]
    assert [(g["text"], [sorted(c) for c in g["categories"]]) for g in got] == [("Visite de l'eglise", [["category_key", "decision", "explanation", "label", "score"]]), ("rien", [])]
    capsys.readouterr()
    assert cli.main(["resources", "--config", str(config)]) == 1  # no model is installed here
    assert [r["status"] for r in json.loads(capsys.readouterr().out)] == ["failed"]


def test_stream(spark, directory, tmp_path):
    chunks = stream.stream_chunks(spark, str(directory))
    done = stream.stream_decisions(chunks, config_of(RAW), str(tmp_path / "o"), str(tmp_path / "c"))
    done.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "o"))
    assert got.where("file_name = 'p.pdf' and category_key = 'RELIGION' and decision <> 'clear'").count() == 1
    assert got.select("file_path", "chunk_id").distinct().count() == 5  # suffixes in any case; a file of no bytes is not read
