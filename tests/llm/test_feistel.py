import random

from hushlens.llm import feistel as P

KEY = b"secret"


def test_permutations():
    for size in (1, 2, 7, 100, 365, 1000):
        assert sorted(P.permute(v, size, KEY, "t") for v in range(size)) == list(range(size))
    assert [P.permute(v, 1000, KEY, "t") for v in range(50)] != [P.permute(v, 1000, b"other", "t") for v in range(50)]


def test_digits_keep_their_format():
    got = P.permute_digits("+33 6 39 98 82 25", KEY, "phone", keep=2)
    assert got.startswith("+33 ") and [c.isdigit() for c in got] == [c.isdigit() for c in "+33 6 39 98 82 25"] and got != "+33 6 39 98 82 25"
    assert P.permute_digits("QQ 47 22 36 C", KEY, "id")[2] == " "


def test_nir():
    rng = random.Random(1)
    seen = set()
    for _ in range(300):
        body = f"{rng.choice('12')}{rng.randrange(100):02d}{rng.randrange(1, 13):02d}{rng.choice(['75', '2A', '99'])}{rng.randrange(10**6):06d}"
        number = body + f"{P.nir_key(body):02d}"
        assert P.nir_valid(number) and not P.nir_valid(body + f"{P.nir_key(body) % 97 + 1:02d}")
        shown = P.permute_nir(f"{number[0]} {number[1:3]} {number[3:5]} {number[5:7]} {number[7:10]} {number[10:13]} {number[13:]}", KEY)
        assert P.nir_valid(shown) and shown[0] == number[0] and 1 <= int(shown[5:7]) <= 12
        seen.add((number, shown))
    assert len({a for a, _ in seen}) == len({b for _, b in seen})


def test_dates():
    shown = P.permute_date("29/02/2024", KEY)
    assert shown != "29/02/2024" and shown == P.permute_date("29/02/2024", KEY) and shown[2] == shown[5] == "/"
    assert P.permute_date("31/02/2024", KEY) == "31/02/2024" and P.permute_date("x", KEY) == "x"


def test_written_forms_stay_linked():
    same = ["06 12 34 56 78", "+33 6 12 34 56 78", "0033612345678", "+33 (0)6.12.34.56.78", "06-12-34-56-78"]
    got = [P.permute_phone(t, KEY) for t in same]
    assert [[c for c in a if not c.isdigit()] for a in got] == [[c for c in a if not c.isdigit()] for a in same]
    assert {"".join(c for c in g if c.isdigit())[-9:] for g in got} == {"".join(c for c in got[0] if c.isdigit())[-9:]} and got[0] != same[0] and got[0].startswith("06 ")
    assert P.permute_phone("(202) 555-0127", KEY)[1:] == P.permute_phone("+1 202) 555-0127", KEY)[3:]
    assert P.permute_phone("030/23125919", KEY)[1:3] == "30" and P.permute_phone("+49 30 23125919", KEY)[7:] == P.permute_phone("030/23125919", KEY)[4:]
    assert P.permute_id("73 JK 79161", KEY).replace(" ", "") == P.permute_id("73JK79161", KEY)
    assert P.permute_id("QQ-47-22-36-C", KEY).replace("-", "") == P.permute_id("QQ472236C", KEY)


def test_phones_are_permuted():
    numbers = [f"06 {a:02d} {b:02d} 11 22" for a in range(40) for b in range(10)]
    assert len({P.permute_phone(n, KEY) for n in numbers}) == 400
    for n in range(200):
        assert "2" <= P.permute_phone(f"202-{200 + n}-0127", KEY)[4] <= "9"
    for odd in ("+", "12", "+33", "(0)", "٣٣"):
        assert len(P.permute_phone(odd, KEY)) == len(odd)


def test_ids_stay_valid():
    rng = random.Random(2)
    seen = set()
    for _ in range(200):
        digits = f"{rng.randrange(10**8):08d}"
        shown = P.permute_id(digits + P.dni_letter(digits), KEY)
        assert P.dni_letter(shown[:8]) == shown[8]
        seen.add((digits, shown))
        body = f"65{rng.randrange(1, 29):02d}{rng.randrange(1, 13):02d}{rng.randrange(100):02d}{rng.choice('AKZ')}{rng.randrange(100):02d}"
        number = f"{body[:2]} {body[2:8]} {body[8]} {body[9:]}{P.svnr_check(body)}"
        shown = P.permute_id(number, KEY)
        bare = shown.replace(" ", "")
        assert P.svnr_check(bare) == int(bare[11]) and 1 <= int(bare[2:4]) <= 31 and 1 <= int(bare[4:6]) <= 12 and bare[:2] == "65" and shown[2] == " "
    assert len({a for a, _ in seen}) == len({b for _, b in seen})
    assert P.svnr_check("15070649C10") == 3  # the published example 15 070649 C 103
    assert P.permute_id("Y1234567X", KEY)[0] == "Y" and P.permute_id("X", KEY) != ""


def test_dates_in_any_form():
    day = "05/06/2020"
    shown = P.permute_date(day, KEY)
    d, m, y = shown.split("/")
    assert P.permute_date("2020-06-05", KEY) == f"{y}-{m}-{d}"
    assert P.permute_date("5 juin 2020", KEY) == f"{int(d)} {P.MONTHS['fr'][int(m) - 1]} {y}"
    assert P.permute_date("5. Juni 2020", KEY) == f"{int(d)}. {P.MONTHS['de'][int(m) - 1]} {y}"
    assert P.permute_date("5 de junio de 2020", KEY) == f"{int(d)} de {P.MONTHS['es'][int(m) - 1]} de {y}"
    assert P.permute_dates("le 05.06.2020, v. 2.7.1, 31/02/2020, 12/2020 et 1er mai 1850", KEY) == f"le {d}.{m}.{y}, v. 2.7.1, 31/02/2020, 12/2020 et 1er mai 1850"


def test_large_ranges():
    assert sorted(P.permute(v, 1000, KEY, "t", lambda v: v % 7 == 0) for v in range(0, 1000, 7)) == list(range(0, 1000, 7))
    assert 0 <= P.permute(5, 10**17, KEY, "t") < 10**17 and P.permute(3, 10, KEY, "t", lambda v: v > 5) == 3
