"""A pipeline over documents: toxicity, near-duplicates, benchmark passages, personal data, tokens.

Every stage takes all rows its predecessor kept and passes on the columns of documents; the last one
returns the tokens. Each stage's rows are written as Parquet and reread by the next.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgauge.llm import bpe, decontam, jaccard, pii, toxicity
from newsgauge.llm.registry import table
from newsgauge.llm.words import unused
from newsgauge.session import scratch_path

TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
TOXIC = 0.3
NEAR = jaccard.Limit(5, 80, 100)
# the last stage shares an executor with all that the stages before left in its heap
CHUNK_CHARS = 1 << 18
REMEMBERED = 100_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below TOXIC; it learns from all labels."""
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    name, = unused(docs, "_toxic_score")
    scored = toxicity.score(docs, machine, out=name)
    return scored.where(F.col(name) < TOXIC).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by similar sets of five-word shingles, the one with the smallest id."""
    return jaccard.keep_one(docs, NEAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage."""
    names = unused(docs, "_words", "_hit", "_items")
    found = decontam.decontaminate(
        docs, table(spark, sf_dir, "benchmark"), keep=tuple(c for c in docs.columns if c != "doc_id"),
        found=tuple(names))
    return found.where(F.col(names[1]) == 0).select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    out = docs.withColumn("text", pii.redact("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text that the ids decode to."""
    path = f"{TOKENIZERS}/word_bpe_49k.json"
    rows = docs.select("doc_id", "text")
    lexicon = bpe.compile_lexicon(rows, path)
    coded = bpe.encode(
        rows, path, lexicon, keep_text=False, decoded="decoded", chunk=CHUNK_CHARS, remembered=REMEMBERED)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact),
    ("bpe", tokenize),
]

# trained scores, deobfuscation and merges have no SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
