import random
import unicodedata

from hushlens.llm import split


def check(text, limit, overlap, pieces):
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (a, b), (c, d) in zip(pieces, pieces[1:]):
        assert c == b - overlap and d > b and c >= 0
    assert all(0 < b - a <= limit for a, b in pieces)
    marks = [p for p in pieces for at in p if 0 < at < len(text) and unicodedata.combining(text[at])]
    assert not marks or overlap and limit < 4 * overlap or limit < 12


def test_properties():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["mot ", "phrase. ", "\n\n", "\n# titre\n", "x" * rng.randrange(1, 90), "é", "あ。", "é"]) for _ in range(rng.randrange(80)))
        limit = rng.randrange(5, 120)
        overlap = rng.randrange(0, limit)
        check(text, limit, min(overlap, limit - 1), split.spans(text, limit, overlap)) if len(text) > limit else None


def test_strongest_boundary_wins():
    text = "Un. Deux trois.\n\nQuatre cinq six sept."
    assert [text[a:b] for a, b in split.spans(text, 30, 0)] == ["Un. Deux trois.\n\n", "Quatre cinq six sept."]
    text = "aaa bbb ccc"
    assert [text[a:b] for a, b in split.spans(text, 8, 0)] == ["aaa bbb ", "ccc"]
    assert [b - a for a, b in split.spans("x" * 10, 4, 1)] == [4, 4, 4]


def test_long_text():
    text = "mot " * 100_000
    check(text, 1000, 100, split.spans(text, 1000, 100))


def test_table(spark):
    limits = spark.createDataFrame([(".txt", 10, 3), (".pdf", None, 0), (".md", 4, 9)], "file_type string, max_chars int, overlap_chars int")
    rows = [(1, "c", ".TXT", "un deux trois quatre", 0), (1, "c", ".TXT", "un deux trois quatre", 0), (2, "d", ".txt", "court", 0), (3, None, ".pdf", "x" * 50, 0), (4, "e", ".new", "y" * 50, 0), (5, "f", None, "z", 0), (6, "g", ".txt", None, 0), (7, "h", ".txt", "", 0), (None, "i", ".md", "abcdefgh", 0), (2**60 + 1, "j", ".txt", "a" * 11, 0)]
    df = spark.createDataFrame(rows, "chunk_key long, chunk_id string, file_type string, text string, piece_id int")
    got = split.split_oversized(df, limits).collect()
    by = {}
    for r in got:
        by.setdefault(r.chunk_key, []).append(r)
    assert {k: len(v) for k, v in by.items()} == {1: 6, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, None: 5, 2**60 + 1: 2}
    assert by[6][0].piece_text is None and by[7][0].piece_text == "" and by[3][0].n_pieces == 1
    assert "_piece_id" in got[0].asDict()  # the caller's column of that name is left alone
    assert {r.asDict()["_piece_id"] for r in by[1]} == {"c#0000", "c#0001", "c#0002"}
    assert split.split_oversized(df.limit(0), limits).count() == 0
    assert split.split_oversized(df, limits.limit(0)).count() == len(rows)


def test_short_first_part_loses_nothing():
    for head in range(1, 60):
        text = "x" * head + "\n\n" + "mot " * 200
        pieces = split.spans(text, 100, 40)
        check(text, 100, 40, pieces)
        assert text == text[: pieces[0][1]] + "".join(text[p[1] : q[1]] for p, q in zip(pieces, pieces[1:]))


def test_pieces_are_filled():
    rng = random.Random(5)
    text = ""
    while len(text) < 60_000:
        text += " ".join("mot" * rng.randrange(1, 4) for _ in range(rng.randrange(3, 25))) + rng.choice([". ", ". ", ".\n\n", ".\n# t\n"])
    pieces = split.spans(text, 1000, 100)
    check(text, 1000, 100, pieces)
    assert all(b - a >= 250 for a, b in pieces[:-1])
    assert sum(a == 0 or not (text[a - 1].isalnum() and text[a].isalnum()) for a, _ in pieces) > 0.3 * len(pieces)


def test_rebuilt(spark):
    rows = [(1, "a", ".txt", "un deux trois quatre " * 20), (1, "a", ".txt", "un deux trois quatre " * 20), (2, "b", ".txt", None), (3, "c", ".txt", ""), (4, "d", ".txt", "court")]
    df = spark.createDataFrame(rows, "chunk_key long, chunk_id string, file_type string, text string")
    limits = spark.createDataFrame([(".txt", 50, 20), (".txt", 90, 3)], "file_type string, max_chars int, overlap_chars int")
    pieces = split.split_oversized(df, limits)
    assert pieces.agg({"end_char": "max"}).first()[0] == len(rows[0][3]) and pieces.where("end_char - start_char > 50").count() == 0
    assert {r.chunk_key: r.text for r in split.rebuilt(pieces).collect()} == {r[0]: r[3] for r in rows}
