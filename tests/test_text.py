import pytest
from pyspark.sql import functions as F

from newsgauge import fixed_values as fixed
from newsgauge.functions.text import (
    fingerprint, join_text, matched_terms, normalize_text, present_words, search_query,
)
from newsgauge.lexicon import DEFAULT_LEXICON, Lexicon
from newsgauge.operators import tagging as tg

ARTICLE = "id string, title string, snippet string, source string, month string"


def matches(frame, text, terms):
    row = frame([(text,)], "t string").select(normalize_text(F.col("t")).alias("t"))
    row = row.withColumn("w", present_words(F.col("t"), terms))
    return row.select(matched_terms(F.col("t"), F.col("w"), terms).alias("m")).first()["m"]


@pytest.mark.parametrize("text, terms, expected", [
    ("A brisk market", ["risk"], []),
    ("The RISK, they say", ["risk"], ["risk"]),
    ("a clean   energy\nplan", ["clean energy"], ["clean energy"]),
    ("unclean energyx", ["clean energy"], ["clean energy"]),
    ("a phase-out plan", ["phase-out", "phase", "out"], ["phase-out", "phase", "out"]),
    ("prephase-out", ["phase-out"], []),
    ("érisk", ["risk"], []),
    ("snake_risk", ["risk"], []),
    ("EV sales and 45X", ["EV", "45x", "sale"], ["EV", "45x"]),
    ("délai prévu", ["délai", "prévu"], ["délai", "prévu"]),
    ("the u.s. market", ["u.s"], ["u.s"]),
    ("cost (net-zero)", ["net-zero"], ["net-zero"]),
])
def test_term_rules(frame, text, terms, expected):
    assert matches(frame, text, terms) == expected


def test_normalize_unicode_space(frame):
    rows = frame([("  A  b\t\nC ",), (None,), ("",)], "t string")
    assert [r[0] for r in rows.select(normalize_text(F.col("t"))).collect()] == ["a b c", "", ""]


def test_lexicon_rules():
    lexicon = Lexicon({"uncertainty": ["Maybe", "risk"], "reversal": []}, ("RISK",))
    assert lexicon.terms("uncertainty") == ["Maybe"]
    assert lexicon.terms("reversal") == fixed.REVERSAL_TERMS
    with pytest.raises(ValueError):
        lexicon.terms("nonsense")


def test_list_sizes():
    sizes = {c: len(DEFAULT_LEXICON.terms(c)) for c in ("climate", "policy", "uncertainty")}
    assert sizes == {"climate": 16, "policy": 22, "uncertainty": 9}
    assert len(fixed.IMPLEMENTATION_TERMS) == 36
    assert len(fixed.REVERSAL_TERMS) == 24
    assert len(fixed.UPSIDE_TERMS) == 62
    assert len(fixed.REGIME_IRA_TERMS) == 9


def test_classification_and_counts(frame):
    rows = frame([
        ("1", "Policy uncertainty and rollback risk", "Repeal of credits is uncertain", "a", "2024-01"),
        ("2", "Certain rollback", "The repeal is done", "a", "2024-01"),
        ("3", "Unclear guidance", "Inflation Reduction Act rules pending", "b", "2024-01"),
        ("4", None, None, "b", "2024-01"),
    ], ARTICLE)
    tagged = tg.classify_articles(rows, keep=["id", "month"])
    by_id = {r["id"]: r for r in tagged.collect()}
    assert by_id["1"]["has_uncertainty"] and by_id["1"]["has_reversal_terms"]
    assert by_id["1"]["matched_terms"]["uncertainty"] == ["uncertain", "uncertainty", "risk"]
    assert not by_id["2"]["has_uncertainty"] and by_id["2"]["has_reversal_terms"]
    assert by_id["3"]["has_ira_mention"] and by_id["3"]["has_implementation_terms"]
    assert not any(by_id["4"][f] for f in tg.FLAGS.values())
    gated = tg.index_counts(tagged).first()
    assert (gated["total_articles"], gated["cpu_count"], gated["cpu_reversal_count"]) == (4, 2, 1)
    opened = tg.index_counts(tagged, require_uncertainty=False).first()
    assert (opened["cpu_count"], opened["cpu_reversal_count"]) == (3, 2)


def test_placebo(frame):
    rows = frame([
        ("1", "Tariff policy uncertainty", "", "a", "2024-01"), ("2", "Tariff policy", "", "a", "2024-01"),
    ], ARTICLE)
    flags = {r["id"]: r["is_placebo_cpu"] for r in tg.placebo_flags(rows, "trade").collect()}
    assert flags == {"1": True, "2": False}
    with pytest.raises(ValueError):
        tg.placebo_flags(rows, "sports")


def test_unlabelled_articles_count_in_total_only(frame):
    articles = frame([("1", "", "", "a", "2024-01"), ("2", "", "", "a", "2024-01")], ARTICLE)
    tags = frame([("1", True, True, False, False, False, False)], "article_id string, " + ", ".join(
        f"{f} boolean" for f in tg.FLAGS.values()))
    row = tg.class_counts(articles, tags).first()
    assert (row["total_articles"], row["uncertainty_count"], row["reversal_uncertainty_count"]) == (2, 1, 1)


def test_query_text_and_fingerprint(frame):
    text = search_query(["climate", "net zero"], ["policy"], [])
    assert text == '(climate OR "net+zero") AND (policy)'
    row = frame([("q", "f")], "q string, f string").select(fingerprint(F.col("q"), F.col("f"))).first()
    import hashlib
    assert row[0] == hashlib.sha256(b"q|f").hexdigest()[:16]


def test_whole_text_is_read(frame):
    long = "filler " * 60_000 + "uncertain"
    rows = frame([("1", "t", long, "a", "2024-01")], ARTICLE)
    assert tg.classify_articles(rows).first()["has_uncertainty"]


def test_join_text_null_parts(frame):
    row = frame([(None, "B")], "a string, b string").select(join_text(F.col("a"), F.col("b")))
    assert row.first()[0] == "b"
