"""Keyword tagging of articles and the counts built on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgauge.functions.text import (
    any_term, join_text, matched_terms, present_words,
)
from newsgauge.lexicon import DEFAULT_LEXICON, FLAGS, Lexicon

TEXT, WORDS = "_text", "_words"


def with_tokens(articles: DataFrame, lexicon: Lexicon, categories: Sequence[str]) -> DataFrame:
    """Add the normalised text and the lexicon words found in it; both are computed once per row."""
    vocabulary = lexicon.vocabulary(*categories)
    return articles.withColumn(TEXT, join_text(F.col("title"), F.col("snippet"))).withColumn(
        WORDS, present_words(F.col(TEXT), vocabulary)
    )


def category_hit(lexicon: Lexicon, category: str) -> Column:
    return any_term(F.col(TEXT), F.col(WORDS), lexicon.terms(category))


def category_matches(lexicon: Lexicon, category: str) -> Column:
    return matched_terms(F.col(TEXT), F.col(WORDS), lexicon.terms(category))


def classify_articles(
    articles: DataFrame,
    lexicon: Lexicon = DEFAULT_LEXICON,
    include_matched_terms: bool = True,
    keep: Sequence[str] = ("id",),
) -> DataFrame:
    """Six boolean flags per article over title and snippet, optionally with the terms found."""
    rows = with_tokens(articles, lexicon, list(FLAGS))
    if not include_matched_terms:
        return rows.select(*keep, *[category_hit(lexicon, c).alias(f) for c, f in FLAGS.items()])
    matched = F.struct(*[category_matches(lexicon, c).alias(c) for c in FLAGS])
    rows = rows.select(*keep, matched.alias("matched_terms"))
    return rows.select(
        *keep,
        *[(F.size(F.col("matched_terms")[c]) > 0).alias(f) for c, f in FLAGS.items()],
        "matched_terms",
    )


def index_flags(classified: DataFrame, require_uncertainty: bool = True) -> DataFrame:
    """Which index each article counts toward.

    Direction terms count only next to an uncertainty term, unless the gate is opened; with the
    gate open an uncertainty, reversal or implementation term is enough for the main index.
    """
    uncertain = F.col("has_uncertainty")
    reversal = F.col("has_reversal_terms")
    implementation = F.col("has_implementation_terms")
    gate = uncertain if require_uncertainty else F.lit(True)
    main = uncertain if require_uncertainty else uncertain | reversal | implementation
    return classified.withColumns({
        "is_cpu": main,
        "is_cpu_reversal": gate & reversal,
        "is_cpu_impl": gate & implementation,
        "is_cpu_upside": gate & F.col("has_upside_terms"),
        "is_regime_ira": F.col("has_ira_mention"),
        "is_regime_obbba": F.col("has_obbba_mention"),
    })


def index_counts(
    classified: DataFrame, keys: Sequence[str] = ("month",), require_uncertainty: bool = True
) -> DataFrame:
    """Number of articles per key and how many of them count toward each index."""
    flagged = index_flags(classified, require_uncertainty)
    return flagged.groupBy(*keys).agg(
        F.count("*").alias("total_articles"),
        *[
            F.count_if(f"is_{name}").alias(f"{name}_count")
            for name in (
                "cpu", "cpu_reversal", "cpu_impl", "cpu_upside", "regime_ira", "regime_obbba",
            )
        ],
    )


def placebo_flags(
    articles: DataFrame,
    domain: str,
    lexicon: Lexicon = DEFAULT_LEXICON,
    keep: Sequence[str] = ("id",),
) -> DataFrame:
    """Control index: domain AND policy AND uncertainty, for 'trade' or 'monetary'."""
    if domain not in ("trade", "monetary"):
        raise ValueError(f"unknown placebo type: {domain}")
    rows = with_tokens(articles, lexicon, [domain, "policy", "uncertainty"])
    return rows.select(
        *keep,
        category_hit(lexicon, domain).alias("has_domain_terms"),
        category_hit(lexicon, "policy").alias("has_policy_terms"),
        category_hit(lexicon, "uncertainty").alias("has_uncertainty"),
    ).withColumn(
        "is_placebo_cpu",
        F.col("has_domain_terms") & F.col("has_policy_terms") & F.col("has_uncertainty"),
    )


HITS = "_hits"


def with_hits(articles: DataFrame, lexicon: Lexicon, categories: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``keep`` and a bitmap: bit n is set when the article holds a term of the n-th category."""
    rows = with_tokens(articles, lexicon, categories)
    bits = F.lit(0)
    for n, category in enumerate(categories):
        bits = bits + F.when(category_hit(lexicon, category), F.lit(1 << n)).otherwise(F.lit(0))
    return rows.select(*keep, bits.alias(HITS))


def bits_match(categories: Sequence[str], wanted: Sequence[str], unwanted: Sequence[str] = ()) -> Column:
    """Are all wanted bits set and none of the unwanted ones?"""
    place = {category: 1 << n for n, category in enumerate(categories)}
    yes, no = sum(place[c] for c in set(wanted)), sum(place[c] for c in set(unwanted))
    return F.col(HITS).bitwiseAND(F.lit(yes | no)) == yes


def corpus_query(
    articles: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON,
    categories: Sequence[str] = ("climate", "policy"), without: Sequence[str] = (),
) -> DataFrame:
    """Articles that hold at least one term of every category and none of the categories ``without``.

    The choice is a generator of no or one element, because a filter would be moved below the bitmap and
    search the text again for each category.
    """
    looked_up = list(dict.fromkeys([*categories, *without]))
    rows = with_hits(articles, lexicon, looked_up, articles.columns)
    chosen = F.when(bits_match(looked_up, categories, without), F.array(F.lit(1)))
    return rows.select(*articles.columns, F.explode(chosen).alias("_chosen")).drop("_chosen")


def boolean_counts(
    articles: DataFrame, queries: dict[str, tuple[Sequence[str], Sequence[str]]],
    lexicon: Lexicon = DEFAULT_LEXICON, keys: Sequence[str] = ("month",),
) -> DataFrame:
    """Counts per key of any number of boolean queries, name -> (wanted, unwanted categories).

    The text is searched once; articles are collapsed to bitmaps with counts before they meet the queries.
    """
    categories = list(dict.fromkeys(c for pair in queries.values() for side in pair for c in side))
    bitmaps = with_hits(articles, lexicon, categories, keys).groupBy(*keys, HITS).agg(F.count("*").alias("_n"))
    return bitmaps.groupBy(*keys).agg(*[
        F.sum(F.when(bits_match(categories, *pair), F.col("_n")).otherwise(F.lit(0))).alias(name)
        for name, pair in queries.items()
    ])


def monthly_counts(
    articles: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON, keys: Sequence[str] = ("month",)
) -> DataFrame:
    """The four boolean-query counts of every month in one pass over the corpus."""
    categories = ["climate", "policy", "uncertainty", "implementation", "reversal"]
    rows = with_tokens(articles, lexicon, categories).select(
        *keys, *[category_hit(lexicon, c).alias(c) for c in categories]
    )
    corpus = F.col("climate") & F.col("policy")
    uncertain = corpus & F.col("uncertainty")
    return rows.groupBy(*keys).agg(
        F.count_if(corpus).alias("denominator"),
        F.count_if(uncertain).alias("numerator_cpu"),
        F.count_if(uncertain & F.col("implementation")).alias("numerator_impl"),
        F.count_if(uncertain & F.col("reversal")).alias("numerator_reversal"),
    )


def count_tagged(
    tagged: DataFrame, keys: Sequence[str] = ("month",), by_outlet: bool = False
) -> DataFrame:
    """Filtered counts per key of articles that carry their flags (NULL where not classified).

    The outlet form has no upside or regime counts.
    """
    uncertain = F.col("has_uncertainty")
    counts = [
        F.count("*").alias("total_articles"),
        F.count_if(uncertain).alias("uncertainty_count"),
        F.count_if(uncertain & F.col("has_reversal_terms")).alias("reversal_uncertainty_count"),
        F.count_if(uncertain & F.col("has_implementation_terms"))
        .alias("implementation_uncertainty_count"),
    ]
    if not by_outlet:
        counts += [
            F.count_if(uncertain & F.col("has_upside_terms")).alias("upside_uncertainty_count"),
            F.count_if("has_ira_mention").alias("ira_count"),
            F.count_if("has_obbba_mention").alias("obbba_count"),
        ]
    return tagged.groupBy(*keys).agg(*counts)


def class_counts(
    articles: DataFrame, classifications: DataFrame, keys: Sequence[str] = ("month",),
    by_outlet: bool = False,
) -> DataFrame:
    """Filtered counts over articles left-joined with a stored classification.

    Articles without a classification count in the total only.
    """
    joined = articles.select("id", *keys).join(
        classifications.withColumnRenamed("article_id", "id"), "id", "left"
    )
    return count_tagged(joined, keys, by_outlet)
