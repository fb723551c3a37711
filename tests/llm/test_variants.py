"""Spelling variants against all pairs of words."""

import random

import brute
import pytest
from newsgauge.llm import queries, variants


def vocabulary(rng, number):
    words = set()
    while len(words) < number:
        w = "".join(rng.choice("abcé") for _ in range(rng.randrange(4, 9)))
        words.add(w)
        at = rng.randrange(len(w))
        words.add(rng.choice([w[:at] + w[at + 1:], w[:at] + "d" + w[at:], w[:at] + "ß" + w[at + 1:]]) or "x")
    return {w: rng.randrange(3, 60) for w in words if len(w) >= 4}


@pytest.mark.parametrize("limit", [20_000, 40, 6])
def test_all_near_words_are_found(spark, limit):
    counts = vocabulary(random.Random(limit), 700)
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    got = {r["word"]: tuple(r) for r in variants.spelling_groups(words, limit=limit).collect()}
    assert got == brute.spelling_groups(counts)


def test_groups_are_divided_to_the_limit(spark):
    words = spark.createDataFrame(
        [(a + b + "ungen" * 3, 3) for a in "abcdefghijklm" for b in "abcdefghijklm"], "word string, n long")
    sizes = variants.groups(words, 10).groupBy("key", "m", "lead", "trail").count().collect()
    assert all(r["count"] <= 10 or r["m"] - r["lead"] - r["trail"] <= 1 for r in sizes)


def test_query_matches_plain_computation(spark, awkward, tmp_path):
    rng = random.Random(4)
    words = list(vocabulary(rng, 150))
    rows = [(k, " ".join(rng.choice(words).title() + rng.choice(["", ",", "1", "\n"]) for _ in range(60))) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").union(awkward.select("doc_id", "text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op13_spelling_variants"](spark, str(tmp_path))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    counts = brute.damaged_vocabulary([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["word"]: tuple(r) for r in got.collect()} == brute.spelling_groups(counts)


def test_long_chains_have_one_root(spark):
    chain = ["abcdefgh"]
    for k in range(8):
        chain.append(chain[-1][:k] + "z" + chain[-1][k + 1:])
    counts = {w: 3 * 2**k for k, w in enumerate(chain)}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r["word"]: r["root"] for r in variants.spelling_groups(words).collect()}
    assert set(got.values()) == {chain[-1]}


def test_empty_table(nothing):
    assert variants.spelling_groups(variants.vocabulary(nothing, damaged=("doc_id", 97))).count() == 0
