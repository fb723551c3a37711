"""The stages on awkward documents, and the queries of this subpackage on the smallest data."""

import os

import brute
import corpus_pipeline
import pandas as pd
import pytest
from newsgauge.llm import pii
from newsgauge.llm.queries import QUERIES, SQL
from pyspark.sql import functions as F
from suite.check import compare, oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id")["text"]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    frame = QUERIES[name](spark, SF)
    cursor = oracle(SF).execute(SQL[name])
    assert compare(frame.columns, frame.collect(), [d[0] for d in cursor.description], cursor.fetchall()) is None


def test_base_digests(spark, texts):
    rows = {n: QUERIES[n](spark, SF).collect() for n in (
        "op1_quality_rules", "op4_decontamination", "op5_secret_scan", "op10_personal_data")}
    assert all(len(r) == len(texts) for r in rows.values())
    items = pd.read_parquet(f"{SF}/benchmark.parquet")
    items = list(zip(items["item_id"], items["text"]))
    for r in rows["op1_quality_rules"]:
        n, *rest = brute.quality(texts[r["doc_id"]])
        assert [n, *rest] == [r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]]
        assert r["base_failed"] == (n < 10 or 100 * rest[-1] > 20 * n) and not (r["base_failed"] and r["kept"])
    for r in rows["op4_decontamination"]:
        n, hit, found = brute.decontaminate(texts[r["doc_id"]], items)
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, hit, len(found))
        assert r["items_sha256"] == brute.sha(",".join(sorted(map(str, found))))
    for r in rows["op5_secret_scan"]:
        base = brute.secret_base(texts[r["doc_id"]])
        assert r["base_sha256"] == brute.sha(brute.spans_text(base, ["assign", "access", "hex"]))
    for r in rows["op10_personal_data"]:
        base = brute.pii_base(texts[r["doc_id"]])
        assert r["base_sha256"] == brute.sha(brute.spans_text(base, ["email", "ip", "card", "phone"]))


def test_stages_decide_and_keep_columns(spark, texts, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        path = os.path.join(tmp_path, name)
        stage(spark, before, SF).write.parquet(path)
        after = spark.read.parquet(path)
        assert after.dtypes == docs.dtypes
        assert (after.count() < before.count()) == (name in ("toxicity", "ngram_jaccard", "decontamination"))
        before = after
    assert before.count() > 100
    kept = {r["doc_id"]: r["text"] for r in before.collect()}
    assert not any(brute.pii_base(t) for t in kept.values())
    last = corpus_pipeline.STAGES[-1][1](spark, before, SF).collect()
    assert {r["doc_id"] for r in last} == set(kept)
    assert all(r["n_tokens"] == len(r["ids"]) for r in last)


def test_stages_on_awkward_and_empty_documents(spark, awkward, nothing):
    for docs in (awkward, nothing):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert (out.count() > 0) == (docs is awkward)


def test_redaction_passes_texts_through_python_once_in_small_batches(spark):
    rows = spark.createDataFrame([
        (1, "to jane at example dot com, 192 dot 168 dot zero dot one"), (2, "192.168.1.1５ and a@b.org, c@d.org"),
        (2, "192.168.1.1５ and a@b.org, c@d.org"), (3, ""), (None, None), (4, "nothing here")], "doc_id long, text string")
    out = corpus_pipeline.redact(spark, rows.withColumn("n_chars", F.length("text")), SF)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython") == 1 and "ArrowEvalPython" not in plan
    in_two = rows.select("doc_id", pii.redacted("text", pii.spans("text")).alias("text"))
    found = [tuple(r) for r in out.select("doc_id", "text").collect()]
    assert sorted(found, key=repr) == sorted(map(tuple, in_two.collect()), key=repr)
    assert dict(found) == {1: "to <EMAIL>, <IP>", 2: "<IP> and <EMAIL>, <EMAIL>", 3: "", None: None, 4: "nothing here"}
    assert out.where(~F.col("n_chars").eqNullSafe(F.length("text"))).count() == 0


def test_stages_keep_columns_named_like_working_columns(spark, awkward):
    names = ("_toxic_score", "_row", "_words", "_hit", "_items", "_text", "_k0", "row", "group")
    docs = awkward.select("doc_id", "text", *[F.lit(f"own {n}").alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert {tuple(r) for r in out.select(*names).distinct().collect()} == {tuple(f"own {n}" for n in names)}
