"""Secret scan: three exact patterns, and strings that read like random ones.

Strings of at least MIN_CHARS key characters that no pattern match covers and no assignment touches are scored
whole by two first-order character Markov models, one of random strings and one of ordinary identifiers. So a
key that holds a run of hex digits is found whole, beside the base span of the run. Both are trained from
labelled samples: what the patterns find is random, words of MIN_WORD to MIN_CHARS - 1 characters in texts without
pattern matches are ordinary. The sum over characters of log P(random) - log P(ordinary) decides.
Transitions are counted by Spark; a rare one backs off to the share of its second character; the ordinary sample comes from the at most
TRAIN_ROWS texts that are first by their hash. Each model has at most
(alphabet + 1)^2 transitions, so the table of ratios is bounded and enters the scan as one map.

Spans are code points, end exclusive. Defined cases: null text is empty and has no spans; without any
pattern match in the table the random model is uniform; without words the ordinary model is uniform;
repeated rows are scanned each; other columns stay, but those named ``base`` or ``spans`` give way to the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgauge.llm.words import body, unused, without

ASSIGN = (
    r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = "AKIA[A-Z0-9]++"
HEX = "[0-9a-f]{24,}+"
KINDS = ("assign", "access", "hex", "random")
KEY_CHARS = "A-Za-z0-9+/_=-"
ALPHABET = 66
BACKOFF = 5
MIN_CHARS = 20
MIN_WORD = 8
TRAIN_ROWS = 2_000
MIN_RATIO = 12.0
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def spans_of(text: Column, pattern: str, kind: int, found: Column | None = None) -> Column:
    """All matches, leftmost and non-overlapping, with their places.

    Matches and the pieces between them alternate, so places are running sums of lengths.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), 0)
    pieces = F.split(text, pattern, -1)
    state = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(s: Column, pair: Column) -> Column:
        start = s["at"] + F.length(pair["piece"])
        end = start + F.length(pair["match"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"),
                        pair["match"].alias("value"))
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(span)).alias("out"))

    pairs = F.zip_with(
        F.slice(pieces, 1, F.size(matches)), matches,
        lambda p, m: F.struct(F.coalesce(p, F.lit("")).alias("piece"), m.alias("match")),
    )
    return F.when(text.rlike(pattern), F.aggregate(pairs, state, step, lambda s: s["out"])) \
        .otherwise(F.array().cast(SPAN))


def pattern_spans(docs: DataFrame, text_col: str = "text", text_name: str = "_text",
                  base_name: str = "_base") -> DataFrame:
    """All rows and columns, with the whole text and the pattern matches by start, then kind, under the names given."""
    text = F.col(text_name)
    assign = F.filter(
        spans_of(text, ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 6
    )
    access = F.filter(spans_of(text, ACCESS, 1), lambda s: F.length(s["value"]) >= 20)
    return docs.withColumn(text_name, body(text_col)).withColumn(
        base_name, F.sort_array(F.concat(assign, access, spans_of(text, HEX, 2)))
    )


def _transitions(strings: DataFrame) -> DataFrame:
    """Counts of (from, to) over the characters of column s, the first coming from ''."""
    chars = F.split("s", "")
    steps = F.transform(
        F.filter(chars, lambda c: c != ""),
        lambda c, i: F.struct(F.coalesce(F.get(F.split(F.col("s"), ""), i - 1), F.lit("")).alias("a"),
                              c.alias("b")),
    )
    return strings.select(F.explode(steps).alias("t")).groupBy("t.a", "t.b").agg(F.count("*").alias("n"))


def train(scanned: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """One row with the map from two characters to the log-likelihood ratio of their transition."""
    random = scanned.select(F.explode("_base").alias("x")).select(
        F.when(F.col("x.kind") == 0, F.regexp_extract("x.value", ASSIGN, 2))
        .otherwise(F.col("x.value")).alias("s"))
    # only hashes are compared for the sample; its texts are picked by the last hash taken
    mark = F.xxhash64("_text")
    last = scanned.select(mark.alias("h")).distinct().orderBy("h").limit(rows) \
        .agg(F.max("h").alias("h")).scalar()
    sample = scanned.where(mark <= last).dropDuplicates(["_text"])
    ordinary = sample.where(F.size("_base") == 0).select(
        F.explode(F.regexp_extract_all("_text", F.lit(f"[{KEY_CHARS}]{{{MIN_WORD},}}+"), 0)).alias("s")
    ).where(F.length("s") < MIN_CHARS)  # longer ones are what the scan is to judge

    def totals(counts: DataFrame, side: str, name: str) -> DataFrame:
        return counts.groupBy(side).agg(F.sum("n").alias(name))

    # all tables here hold at most (alphabet + 1)^2 rows
    one, two = _transitions(random), _transitions(ordinary)
    firsts = totals(one, "a", "r_a").join(totals(two, "a", "o_a"), "a", "full_outer").fillna(0)
    seconds = totals(one, "b", "r_b").join(totals(two, "b", "o_b"), "b", "full_outer").fillna(0)
    all_of = lambda m: F.coalesce(m.agg(F.sum("n").alias("n")).scalar(), F.lit(0))
    lone = lambda name, m: (F.col(f"{name}_b") + 0.5) / (all_of(m) + 0.5 * ALPHABET)
    seconds = seconds.select("b", lone("r", one).alias("r_p"), lone("o", two).alias("o_p"))
    pairs = one.withColumnRenamed("n", "r_n").join(two.withColumnRenamed("n", "o_n"), ["a", "b"], "full_outer") \
        .fillna(0, ["r_n", "o_n"]).join(firsts, "a").join(seconds, "b")
    given = lambda c: F.log(
        (F.col(f"{c}_n") + BACKOFF * F.col(f"{c}_p")) / (F.col(f"{c}_a") + BACKOFF))
    entries = pairs.select(F.concat("a", F.lit(">"), "b").alias("k"), (given("r") - given("o")).alias("v"))
    # a pair that neither model has seen: the shares of its two characters
    entries = entries.union(firsts.select(
        F.concat("a", F.lit(">")), F.log((F.col("o_a") + BACKOFF) / (F.col("r_a") + BACKOFF))))
    entries = entries.union(seconds.select(F.concat(F.lit("<"), "b"), F.log(F.col("r_p") / F.col("o_p"))))
    return entries.agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("ratios"))


def scan(docs: DataFrame, text_col: str = "text", min_ratio: float = MIN_RATIO) -> DataFrame:
    """All rows and columns, with ``base`` and ``spans``: arrays of (start, kind, end, value)."""
    text, base, long, table = unused(docs, "_text", "_base", "_long", "_ratios")
    scanned = pattern_spans(docs, text_col, text, base)
    ratios = train(scanned.select(F.col(text).alias("_text"), F.col(base).alias("_base"))).scalar()

    def likely(value: Column, table: Column) -> Column:
        chars = F.filter(F.split(value, ""), lambda c: c != "")
        state = F.struct(F.lit("").alias("a"), F.lit(0.0).alias("sum"))
        return F.aggregate(chars, state, lambda s, c: F.struct(c.alias("a"), (
            s["sum"] + F.coalesce(
                F.try_element_at(table, F.concat(s["a"], F.lit(">"), c)),
                F.coalesce(F.try_element_at(table, F.concat(s["a"], F.lit(">"))), F.lit(0.0))
                + F.coalesce(F.try_element_at(table, F.concat(F.lit("<"), c)), F.lit(0.0)))
        ).alias("sum")), lambda s: s["sum"])

    def explained(c: Column, b: Column) -> Column:
        meets = (b["start"] < c["end"]) & (c["start"] < b["end"])
        return meets & ((b["kind"] == 0) | ((b["start"] <= c["start"]) & (c["end"] <= b["end"])))

    candidates = scanned.withColumn(
        long, spans_of(F.col(text), f"[{KEY_CHARS}]{{{MIN_CHARS},}}+", 3)
    ).withColumn(long, F.filter(long, lambda c: ~F.exists(base, lambda b: explained(c, b))))
    judged = candidates.withColumn(table, F.when(F.size(long) > 0, ratios)).withColumn(
        long, F.filter(long, lambda c: likely(c["value"], F.col(table)) >= min_ratio))
    return judged.select(
        *without(docs, "base", "spans"), F.col(base).alias("base"),
        F.sort_array(F.concat(base, long)).alias("spans"),
    )


def digest(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
