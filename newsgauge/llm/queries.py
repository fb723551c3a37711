"""The numbered queries: each applies one operator to its whole table."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from newsgauge.llm import (
    bpe, decontam, jaccard, line_dedup, periodic, pii, quality, quotes, secrets, sharding, token_counts, toxicity,
    variants,
)
from newsgauge.llm.registry import QUERIES, SQL, query, table  # noqa: F401
from newsgauge.llm.words import words as word_list
from newsgauge.session import cut_lineage

TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


@query("op7_sharding")
def op7(spark, sf_dir):
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "home",
    )


@query("op9_toxicity")
def op9(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    machine = toxicity.train(docs, labels.where(~held))
    return toxicity.score(docs.select("doc_id", "text"), machine).select(
        "doc_id", held.alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query("op1_quality_rules")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    # thin rows, wanted twice: for the cutoffs and for the verdicts
    figures = cut_lineage(quality.base_figures(docs).drop("text"))
    chosen = quality.cutoffs(figures, table(spark, sf_dir, "labels"), "lang")
    return quality.apply_cutoffs(figures, chosen, "lang").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


@query("op5_secret_scan")
def op5(spark, sf_dir):
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.digest(F.col("base")), 256).alias("base_sha256"),
        secrets.digest(F.col("spans")).alias("spans"),
    )


@query("op4_decontamination")
def op4(spark, sf_dir):
    found = decontam.decontaminate(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op10_personal_data")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", pii.spans(F.col("text")).alias("spans"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)],
        F.sha2(pii.digest(base), 256).alias("base_sha256"),
        pii.digest(F.col("spans")).alias("spans"),
    )


@query("op6_bpe")
def op6(spark, sf_dir):
    path = f"{TOKENIZERS}/word_bpe_49k.json"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = bpe.compile_lexicon(docs, path)
    return bpe.encode(docs, path, lexicon, keep_text=False, decoded="decoded").select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op8_token_counts")
def op8(spark, sf_dir):
    return token_counts.allot(
        table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken", rule="start")


def as_mail(turns):
    """Turns as mails in no order: each quotes the turn before it, which quotes the one before that."""
    first = turns.where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn") \
        .agg(F.min("text").alias("text"))
    earlier = lambda back: first.select(
        "conv_id", (F.col("turn") + back).alias("turn"), F.col("text").alias(f"text{back}"))
    quoted = lambda text, marks: F.when(
        text.isNotNull(), F.concat(F.lit(marks), F.replace(text, F.lit("\n"), F.lit("\n" + marks))))
    return turns.join(earlier(1), ["conv_id", "turn"], "left").join(earlier(2), ["conv_id", "turn"], "left") \
        .select("conv_id", "turn", F.concat_ws(":", "conv_id", "turn").alias("message_id"),
                F.col("turn").alias("sent"), F.concat_ws(
                    "\n", quoted(F.col("text2"), "> > "), quoted(F.col("text1"), "> "), "text").alias("text"))


OP3_SQL = """
WITH RECURSIVE m AS (
  SELECT conv_id, turn, conv_id || ':' || turn AS id, trim(text, E' \\t\\r\\n') AS body,
    trim(regexp_replace(text, '\\s+', ' ', 'g')) AS words
  FROM conversations),
original AS (
  SELECT words, arg_min(id, (turn, id)) AS id, min((turn, id)) AS place
  FROM m WHERE words <> '' GROUP BY words),
candidate AS (
  SELECT m.id, 1 AS level, o.id AS parent FROM m JOIN m AS q ON q.conv_id = m.conv_id AND q.turn = m.turn - 1
    JOIN original o ON o.words = q.words AND o.place < (m.turn, m.id)
  UNION ALL
  SELECT m.id, 2 AS level, o.id AS parent FROM m JOIN m AS q ON q.conv_id = m.conv_id AND q.turn = m.turn - 2
    JOIN original o ON o.words = q.words AND o.place < (m.turn, m.id)),
link AS (SELECT id, arg_min(parent, level) AS parent FROM candidate GROUP BY id),
tree AS (
  SELECT m.id, m.id AS root, 0 AS depth, CAST(NULL AS VARCHAR) AS parent
  FROM m WHERE id NOT IN (SELECT id FROM link)
  UNION ALL
  SELECT link.id, tree.root, tree.depth + 1, tree.id FROM tree JOIN link ON link.parent = tree.id)
SELECT m.conv_id, m.turn, m.id AS message_id, m.body, tree.root AS conversation, tree.depth, tree.parent,
  row_number() OVER (PARTITION BY tree.root ORDER BY tree.depth, m.turn, m.id) - 1 AS position
FROM m JOIN tree ON tree.id = m.id
"""


@query("op3_quotation_linking", OP3_SQL)
def op3(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    found = quotes.conversations(as_mail(turns))
    place = F.split("message_id", ":")
    return found.select(
        F.try_element_at(place, F.lit(1)).cast("long").alias("conv_id"),
        F.try_element_at(place, F.lit(2)).cast("long").alias("turn"),
        "message_id", "body", "conversation", "depth", "parent", "position")


OP2_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))) END
    AS grams FROM w),
n AS (SELECT doc_id, len(grams) AS size, list_sort(grams) AS grams FROM s),
node AS (SELECT min(doc_id) AS node, grams, any_value(size) AS size FROM n WHERE size > 0 GROUP BY grams),
g AS (SELECT node, size, unnest(grams) AS gram FROM node),
pair AS (
  SELECT a.node AS a, b.node AS b FROM g a JOIN g b ON a.gram = b.gram AND a.node < b.node
    AND 100 * least(a.size, b.size) >= 90 * greatest(a.size, b.size)
  GROUP BY a.node, b.node, a.size, b.size HAVING 100 * count(*) >= 90 * (a.size + b.size - count(*))),
edge AS (SELECT a, b FROM pair UNION SELECT b, a FROM pair),
reach AS (SELECT node, node AS other FROM node UNION SELECT reach.node, edge.b FROM reach JOIN edge ON edge.a = reach.other),
low AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT n.doc_id, CAST(n.size AS BIGINT) AS n_shingles, coalesce(low.component_id, n.doc_id) AS component_id
FROM n LEFT JOIN node ON node.grams = n.grams LEFT JOIN low ON low.node = node.node
"""


@query("op2_ngram_jaccard", OP2_SQL)
def op2(spark, sf_dir):
    found = jaccard.jaccard_components(table(spark, sf_dir, "documents"), jaccard.Limit(3, 90, 100))
    return found.select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))


OP11_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(range(len(lines))) AS pos, unnest(lines) AS line FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
v AS (SELECT k.*, coalesce(k.doc_id < often.last, false) AS gone FROM k LEFT JOIN often ON often.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM v GROUP BY r, doc_id
"""


@query("op11_line_dedup", OP11_SQL)
def op11(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def with_planted_runs(docs):
    """doc_id, text; every tenth text by crc32 of its id is made periodic from some word on."""
    words = word_list(F.coalesce(F.col("text"), F.lit("")))
    h = F.crc32(F.col("doc_id").cast("string"))
    cut = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    sized = cut.withColumn("n", F.size("words")).withColumn("g", F.floor(F.col("h") / 10))
    placed = sized.withColumn("a", (F.col("g") % F.col("n")).cast("int")) \
        .withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    repeat = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(
        F.get("words", F.col("a") + (i - F.col("a")) % F.col("p"))))
    return placed.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.array_join(repeat, " "))
                         .otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def op12(spark, sf_dir):
    found = periodic.find_runs(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    # runs come by (start, period): of equal exponents the first stays
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda held, r: F.when(
        r["length"] * held["period"] > held["length"] * r["period"], r).otherwise(held))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op13_spelling_variants")
def op13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return variants.spelling_groups(variants.vocabulary(docs, damaged=("doc_id", 97)))
