"""Quality rules whose cutoffs are chosen under control of the risk of rejecting good text.

Base figures of a text come first. The rules then look at four shares; a text is rejected when a share
lies above its stratum's cutoff. Cutoffs come from labelled holdouts: on a fixed grid, from the loosest
cutoff to the strictest, the good rows a cutoff would reject are counted, and the exact binomial tail
P(X <= rejected | good rows, risk) tests whether its true rate of false rejection exceeds the risk. The
grid is walked until the first test that is not significant (fixed-sequence testing, which needs no
correction inside a grid); over rules and strata the level is divided by their number (Bonferroni), and the
risk is divided by the number of rules, as a text is rejected when any rule fires. So with probability
1 - level, every stratum loses at most the share ``risk`` of its good texts. The grid is fixed beforehand,
hence all labelled rows serve as holdout. A rule without a proven cutoff rejects nothing.

Defined cases: null text counts as empty; rows without words fail the base rule; a null stratum is a
stratum of its own; rows with null id or label are not evidence, several labels of an id count as their
minimum; no labels, or too few, leave the base rule alone; repeated rows stay. Other columns
stay, but those named like a result give way to it; working names avoid the table's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgauge.llm.words import SPACE, body, unused, without, words

SYMBOLS = "#*$%&|<>"
FIGURES = ("n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words")
WINDOW = 5
RISK = 0.02
LEVEL = 0.05
# rule: share of what (numerator, denominator), cutoffs from the loosest to the strictest
RULES = {
    "symbols": ("n_symbols", "word_chars", (0.6, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05, 0.02)),
    "lines": ("n_dup_lines", "n_lines", (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05)),
    "repeats": ("n_repeat_words", "n_words", (0.18, 0.15, 0.12, 0.1, 0.08, 0.06, 0.04, 0.02)),
    "capitals": ("n_capitals", "word_chars", (0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15)),
}


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used and wherever Spark moves it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeat_words(words: Column) -> Column:
    """Word places inside windows that occur twice or more."""
    def windows(ws: Column) -> Column:
        return F.when(F.size(ws) >= WINDOW, F.transform(
            F.slice(ws, 1, F.size(ws) - (WINDOW - 1)),
            lambda w, i: F.concat_ws(" ", F.slice(ws, i + 1, WINDOW)),
        )).otherwise(F.array().cast("array<string>"))

    def sorted_places(found: Column) -> Column:
        return F.when(
            F.size(F.array_distinct(found)) < F.size(found),
            F.sort_array(F.transform(found, lambda w, i: F.struct(w.alias("k"), i.alias("p")))),
        ).otherwise(F.array().cast("array<struct<k:string,p:int>>"))

    def covered(pairs: Column) -> Column:
        def twin(x: Column, j: Column) -> Column:
            near = [F.get(pairs, k)["k"] == x["k"] for k in (j - 1, j + 1)]
            return F.coalesce(near[0], F.lit(False)) | F.coalesce(near[1], F.lit(False))

        places = F.sort_array(F.transform(F.filter(pairs, twin), lambda x: x["p"]))
        state = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(
            places, state, lambda s, p: F.struct(
                (s["n"] + F.least(F.lit(WINDOW), p - s["last"])).alias("n"), p.alias("last")),
            lambda s: s["n"],
        )

    return bound(words, lambda ws: bound(windows(ws), lambda found: bound(sorted_places(found), covered)))


def base_figures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows with n_words, word_chars, n_symbols, n_capitals, n_lines, n_dup_lines, n_repeat_words."""
    long = lambda c: c.cast("long")
    whole, word_list, lines = unused(docs, "_text", "_words", "_lines")
    split = docs.withColumn(whole, body(text_col)).withColumn(word_list, words(F.col(whole))).withColumn(
        lines, F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(f"[^{SPACE[1:]}"))
    )
    figures = (
        F.size(word_list),
        F.length(F.regexp_replace(whole, SPACE + "+", "")),
        F.length(whole) - F.length(F.translate(whole, SYMBOLS, "")),
        F.length(whole) - F.length(F.regexp_replace(whole, "[A-Z]+", "")),
        F.size(lines),
        F.size(lines) - F.size(F.array_distinct(lines)),
        repeat_words(F.col(word_list)),
    )
    return split.select(*without(docs, *FIGURES), *[long(f).alias(n) for f, n in zip(figures, FIGURES)])


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def binomial_tail(k: Column, n: Column, risk: float) -> Column:
    """P(X <= k) of the binomial law with n trials at ``risk``, summed term by term in logarithms.

    From k at the mean on, the tail is at least about a half and is given as 1.
    """
    odds = F.lit(risk / (1 - risk))
    start = n.cast("double") * F.log1p(F.lit(-risk))
    state = F.struct(start.alias("term"), start.alias("total"))

    def add(s: Column, i: Column) -> Column:
        term = s["term"] + F.log((n - i + 1) / i * odds)
        high = F.greatest(s["total"], term)
        total = high + F.log(F.exp(s["total"] - high) + F.exp(term - high))
        return F.struct(term.alias("term"), total.alias("total"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k.cast("long"))) \
        .otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n * risk, 1.0).otherwise(
        F.least(F.lit(1.0), F.exp(F.aggregate(steps, state, add, lambda s: s["total"])))
    )


def cutoffs(figures: DataFrame, labels: DataFrame, stratum: str, id_col: str = "doc_id",
            label_col: str = "quality", risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """One row per stratum: cut_<rule> for each rule, null where no cutoff is proven."""
    # only these columns are needed, so no other one can share a working name
    good = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label")).dropna() \
        .groupBy("_id").agg(F.min("_label").alias("_good")).where(F.col("_good") == 1).select("_id")
    held = figures.where(~base_failed()).select(
        F.col(id_col).alias("_id"), F.col(stratum).alias("_stratum"), *FIGURES).join(good, "_id", "left_semi")
    sums = [F.sum((F.col(top) > F.lit(cut) * F.col(bottom)).cast("long")).alias(f"{rule}_{step}")
            for rule, (top, bottom, cuts) in RULES.items() for step, cut in enumerate(cuts)]
    counted = held.groupBy("_stratum") \
        .agg(F.count("*").alias("_n"), *sums)
    grid = F.explode(F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(step).alias("step"), F.lit(cut).alias("cut"),
                 F.col(f"{rule}_{step}").alias("lost"))
        for rule, (_, _, cuts) in RULES.items() for step, cut in enumerate(cuts)
    ]))
    # one row per stratum, so this window holds strata only
    strata = counted.withColumn("_m", F.count("*").over(Window.partitionBy(F.lit(0))))
    tests = strata.select("_stratum", "_n", "_m", grid.alias("g")).select("_stratum", "_n", "_m", "g.*")
    tail = binomial_tail(F.col("lost"), F.col("_n"), risk / len(RULES))
    # cutoffs of one rule walk from loose to strict until the first test that fails
    walk = Window.partitionBy("_stratum", "rule").orderBy("step")
    passed = tests.withColumn("_ok", tail <= F.lit(level / len(RULES)) / F.col("_m")) \
        .withColumn("_all", F.min(F.col("_ok").cast("int")).over(walk)).where(F.col("_all") == 1)
    return passed.groupBy("_stratum").agg(*[
        F.min(F.when(F.col("rule") == rule, F.col("cut"))).alias(f"cut_{rule}") for rule in RULES
    ])


def apply_cutoffs(figures: DataFrame, chosen: DataFrame, stratum: str) -> DataFrame:
    """The figures with base_failed, the stratum's cutoffs and kept."""
    results = (*[f"cut_{rule}" for rule in RULES], "base_failed", "kept")
    rows = figures.select(*without(figures, *results))
    mark, = unused(rows, "_stratum")
    joined = rows.join(chosen.withColumnRenamed("_stratum", mark), F.col(stratum).eqNullSafe(F.col(mark)), "left").drop(mark)
    fired = F.lit(False)
    for rule, (top, bottom, _) in RULES.items():
        fired = fired | F.coalesce(F.col(top) > F.col(f"cut_{rule}") * F.col(bottom), F.lit(False))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~fired)
