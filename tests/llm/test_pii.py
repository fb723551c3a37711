import brute
import pytest
from newsgauge.llm import pii
from pyspark.sql import functions as F


@pytest.mark.parametrize("text", [
    "a@b.c x.y+z@d-e.fg.h. @x.y a@b", "1.2.3.4 256.1.1.1 1.2.3.4.5 0001.2.3.4", "4111 1111 1111 1111, 4111-1111-1111-1112",
    "+1 (555) 555-1234. +12 +1.2.3.4.5.6.7.8.9", "9" * 5000, "1." * 3000 + "1", "+" + "1 " * 4000 + "1",
    "\U0001f600 a@b.c", "no data", "", "1.2.3." + "0" * 4500 + "7",
])
def test_base_spans_match_plain_computation(text):
    if len(text) < 4400:
        assert [(s, k, e) for s, k, e, base in pii.find(text) if base] == brute.pii_base(text)
    else:
        assert all(base for *_, base in pii.find(text))


@pytest.mark.parametrize("text, kind, source", [
    ("mail jane.doe (at) example [dot] com now", "email", "jane.doe (at) example [dot] com"),
    ("mail jane at example dot com", "email", "jane at example dot com"),
    ("ｊａｎｅ＠example．com!", "email", "ｊａｎｅ＠example．com"),
    ("to аlice@еxаmple.com", "email", "аlice@еxаmple.com"),
    ("j​ane@exa​mple.com", "email", "j​ane@exa​mple.com"),
    ("call plus one five five five one two three four five six seven", "phone",
     "plus one five five five one two three four five six seven"),
    ("host 192 dot 168 dot 0 dot 1 up", "ip", "192 dot 168 dot 0 dot 1"),
    ("４１１１ 1111 1111 1111", "card", "４１１１ 1111 1111 1111"),
    ("٤١١١1111 11111111", "card", "٤١١١1111 11111111"),
])
def test_disguises_map_back_to_source(text, kind, source):
    found = [(pii.KINDS[k], text[s:e], base) for s, k, e, base in pii.find(text)]
    assert (kind, source, False) in found


@pytest.mark.parametrize("text", [
    "at the dot of a line", "look at this. dot com was", "one two three", "stand at ease (at) once",
    "zero one", "абв где", "five six at seven dot",
])
def test_plain_prose_has_no_spans(text):
    assert pii.find(text) == []


def test_redaction_and_awkward_tables(spark, awkward, nothing):
    rows = spark.createDataFrame([(1, "x a@b.c, 1.2.3.4 (at) y"), (2, None), (3, "")], "doc_id long, text string")
    out = rows.select("doc_id", pii.redacted("text", pii.spans("text")).alias("text")).collect()
    assert {r["doc_id"]: r["text"] for r in out} == {1: "x <EMAIL>, <IP> (at) y", 2: None, 3: ""}
    for docs in (awkward, nothing):
        found = docs.select(pii.spans("text").alias("s"))
        assert found.where(F.col("s").isNull()).count() == 0 and found.count() == docs.count()


@pytest.mark.parametrize("text, kind, source", [
    ("to jоhn.smith@example.com now", "email", "jоhn.smith@example.com"),
    ("to jane@mail.example．com now", "email", "jane@mail.example．com"),
    ("host 192.168.1.1５ up", "ip", "192.168.1.1５"),
    ("call +1 415 555 012３", "phone", "+1 415 555 012３"),
])
def test_a_base_fragment_does_not_hide_the_whole(text, kind, source):
    found = pii.find(text)
    assert (kind, source, False) in [(pii.KINDS[k], text[s:e], base) for s, k, e, base in found]
    assert [(s, k, e) for s, k, e, base in found if base] == brute.pii_base(text) != []


def test_a_base_fragment_leaves_nothing_behind(spark):
    rows = spark.createDataFrame(
        [(1, "to jоhn.smith@example.com, jane@mail.example．com."), (2, "a 192.168.1.1５ b +1 415 555 012３")],
        "doc_id long, text string")
    out = rows.select("doc_id", pii.redacted("text", pii.spans("text")).alias("text")).collect()
    assert {r["doc_id"]: r["text"] for r in out} == {1: "to <EMAIL>, <EMAIL>.", 2: "a <IP> b <PHONE>"}


@pytest.mark.parametrize("text, kind, source", [
    ("host 192 dot 168 dot zero dot one up", "ip", "192 dot 168 dot zero dot one"),
    ("host 192 dot 168 dot 0 dot one up", "ip", "192 dot 168 dot 0 dot one"),
    ("call +1 415 555 oh one two 3 now", "phone", "+1 415 555 oh one two 3"),
    ("plus 1 five 5 five 1 two 3 four 5 six 7", "phone", "plus 1 five 5 five 1 two 3 four 5 six 7"),
    ("card 4111 1111 1111 111 one", "card", "4111 1111 1111 111 one"),
    ("mail jane at example.com now", "email", "jane at example.com"),
    ("mail j.doe at mail.example.co.uk.", "email", "j.doe at mail.example.co.uk"),
])
def test_partly_spelled_runs_and_bare_at(text, kind, source):
    assert (kind, source, False) in [(pii.KINDS[k], text[s:e], base) for s, k, e, base in pii.find(text)]


@pytest.mark.parametrize("text", [
    "meet at example.com", "look at github.com today", "Exception at com.foo.Bar", "jane at noon.The rest", "one of 3 two",
    "from 10 to five, 3 dot one", "at 5 point two at 6.30", "at example.com", "works\nat www.example.org",
])
def test_prose_near_numbers_and_hosts_has_no_spans(text):
    assert pii.find(text) == []


def test_long_mixed_runs_stay_linear():
    for text in ("one 1 " * 30_000, "a at " * 30_000 + "b.c", "1" + " " * 100_000 + "x one 1", "x at " + "a." * 50_000 + "1"):
        assert all(e <= len(text) for _, _, e, _ in pii.find(text))


ZERO_TO_NINE = {
    "fr": ("zéro un deux trois quatre cinq six sept huit neuf", "arobase", "point", "plus"),
    "de": ("null eins zwei drei vier fünf sechs sieben acht neun", "at", "punkt", "plus"),
    "es": ("cero uno dos tres cuatro cinco seis siete ocho nueve", "arroba", "punto", "más"),
    "en": ("zero one two three four five six seven eight nine", "at", "dot", "plus"),
}


@pytest.mark.parametrize("lang", ZERO_TO_NINE)
def test_disguises_in_four_languages(lang):
    """Planted disguises of every kind, with random figures, are found whole."""
    import random
    rng = random.Random(lang)
    names, at, dot, plus = ZERO_TO_NINE[lang]
    digit = names.split()
    say = lambda number: " ".join(digit[int(c)] for c in str(number))
    for _ in range(200):
        number = "".join(rng.choices("0123456789", k=15))
        check = next(c for c in "0123456789" if pii.luhn(number + c))
        planted = {
            "email": rng.choice([
                f"marie.k {at} exemple {dot} fr", f"hans ({at}) beispiel [{dot}] de", f"ana {at} correo {dot} ejemplo {dot} es",
                f"lea@exemple {dot} org"]),
            "phone": f"{plus} {say(''.join(rng.choices('0123456789', k=rng.randint(9, 15))))}",
            "ip": f" {dot} ".join(say(rng.randint(0, 255)) for _ in range(4)),
            "card": say(number + check),
        }
        for kind, source in planted.items():
            for text in (f"xx, {source}; yy", f"Xx: {source.upper()}. Zz"):
                place = text.upper().index(source.upper())
                assert (place, pii.KINDS.index(kind), place + len(source), False) in pii.find(text), (text, pii.find(text))


@pytest.mark.parametrize("text", [
    "look at this point in time", "un point de vue", "le 14 juillet un 2 trois", "bob at work point out", "Punkt drei acht",
    "arroba y punto", "dos puntos", "(point) final", "ein Klammeraffe am Ende", "le signe arobase et le point final",
])
def test_prose_of_other_languages_has_no_spans(text):
    assert pii.find(text) == []


def test_an_article_is_no_digit_beside_figures():
    text = "appelez +33 155 550 123 un ami"
    assert [(s, k, e) for s, k, e, _ in pii.find(text)] == brute.pii_base(text)
