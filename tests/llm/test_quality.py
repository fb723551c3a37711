import math

import brute
from newsgauge.llm import quality
from pyspark.sql import functions as F

FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_figures_match_plain_computation(spark, awkward):
    texts = [
        "a b c d e x a b c d e", "a b c d e a b c d e f a b c", "x\nx\n x\n\n\nx", "# * $ % & | < >",
        "a a a a a a a", "one two three four five six seven eight nine ten", " nbsp \x0b vt\x0cff",
    ]
    rows = awkward.select("doc_id", "text").union(
        spark.createDataFrame([(100 + k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    for r in quality.base_figures(rows).collect():
        assert tuple(r[c] for c in FIGURES) == brute.quality(r["text"]), r["text"]


def test_binomial_tail_is_exact(spark):
    cases = [(0, 10, 0.1), (3, 40, 0.2), (1, 2000, 0.005), (25, 900, 0.05), (9, 10, 0.5), (0, 0, 0.1)]
    for k, n, risk in cases:
        tail = spark.range(1).select(
            quality.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), risk)).first()[0]
        want = sum(math.comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1))
        assert abs(tail - want) < 1e-9 or k >= n * risk and tail == 1


def figures(spark, rows):
    """rows: (id, stratum, share of symbols in percent)"""
    return spark.createDataFrame(
        [(i, s, 100, 100, share, 0, 10, 0, 0) for i, s, share in rows],
        "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_capitals long, "
        "n_lines long, n_dup_lines long, n_repeat_words long")


def test_cutoffs_stop_where_good_rows_would_go(spark):
    # stratum a: all good rows below 5 %, b: a tenth of the good rows at 25 %, c: too few rows
    rows = [(i, "a", 4) for i in range(3000)] + [(5000 + i, "b", 25 if i % 10 == 0 else 0) for i in range(3000)]
    rows += [(9000 + i, "c", 0) for i in range(20)] + [(9999, None, 0)]
    frame = figures(spark, rows)
    labels = frame.select("doc_id", F.lit(1).alias("quality"))
    chosen = {r["_stratum"]: r for r in quality.cutoffs(frame, labels, "lang").collect()}
    assert chosen["a"]["cut_symbols"] == 0.05 and chosen["b"]["cut_symbols"] == 0.3
    assert "c" not in chosen and "" not in chosen
    verdict = quality.apply_cutoffs(
        figures(spark, [(1, "a", 6), (2, "b", 6), (3, "b", 31), (4, "c", 99), (5, None, 99)]),
        quality.cutoffs(frame, labels, "lang"), "lang")
    assert {r["doc_id"]: r["kept"] for r in verdict.collect()} == {1: False, 2: True, 3: False, 4: True, 5: True}


def test_awkward_and_empty_tables(awkward, nothing, labels):
    for docs in (awkward, nothing):
        found = quality.base_figures(docs.select("doc_id", "text", "source"))
        out = quality.apply_cutoffs(found, quality.cutoffs(found, labels, "source"), "source")
        assert out.count() == docs.count()
        assert out.where("kept IS NULL OR base_failed IS NULL").count() == 0


def test_null_and_empty_strata_are_two(spark):
    """Rows of the null stratum lose nothing to the cutoff that rows of the empty one have proven."""
    rows = [(i, "", 4) for i in range(3000)] + [(5000 + i, None, 25 if i % 10 == 0 else 0) for i in range(3000)]
    frame = figures(spark, rows)
    labels = frame.select("doc_id", F.lit(1).alias("quality"))
    chosen = quality.cutoffs(frame, labels, "lang")
    assert {r["_stratum"]: r["cut_symbols"] for r in chosen.collect()} == {"": 0.05, None: 0.3}
    verdict = quality.apply_cutoffs(figures(spark, [(1, "", 6), (2, None, 6), (3, None, 31)]), chosen, "lang")
    assert {r["doc_id"]: r["kept"] for r in verdict.collect()} == {1: False, 2: True, 3: False}


def test_columns_named_like_results_and_working_columns(awkward, labels):
    names = (*quality.FIGURES, "_text", "_words", "_lines", "_id", "_good", "_n", "_m", "_stratum", "cut_lines", "kept",
             "base_failed")
    docs = awkward.select("doc_id", "text", "source", *[F.lit(f"own {n}").alias(n) for n in names])
    plain = quality.base_figures(awkward.select("doc_id", "text", "source"))
    found = quality.base_figures(docs)
    chosen = quality.cutoffs(found, labels, "source")
    out = quality.apply_cutoffs(found, chosen, "source")
    results = [*quality.FIGURES, "base_failed", "kept"]
    want = quality.apply_cutoffs(plain, quality.cutoffs(plain, labels, "source"), "source")
    assert sorted(map(str, out.select("doc_id", *results).collect())) == sorted(
        map(str, want.select("doc_id", *results).collect()))
    assert {r[0] for r in out.select("_text").distinct().collect()} == {"own _text"}
    assert {r[0] for r in out.select("_stratum").distinct().collect()} == {"own _stratum"}
