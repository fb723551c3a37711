"""Line de-duplication against a plain computation, hot hashes included."""

import brute
import pytest
from newsgauge.llm import line_dedup
from pyspark.sql import functions as F

LINE = "a line that is long enough to count"


def check(docs, **options):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    out = line_dedup.drop_lines(docs, **options)
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in out.collect()), key=repr)
    assert got == sorted(brute.line_dedup(rows), key=repr)
    return out


@pytest.fixture
def few(spark):
    rows = [(k, f"{LINE}\n own text of document {k} here\n  {LINE.upper()}\t\nshort") for k in range(40)]
    rows += [(100, LINE), (100, "other text, same id\n" + LINE), (101, "\n".join([LINE] * 200)), (102, "x\n\n" + LINE),
             (7, "twice only, in two documents"), (8, "twice only, in two documents"), (None, LINE), (None, None),
             (103, f"Überlange Zeile mit Umlaut\n{LINE}\r"), (104, "\n".join(f"n{k} unique line here {k}" for k in range(150)))]
    rows += [(200 + k, "Überlange Zeile mit Umlaut") for k in range(3)] + [(210, "überlange Zeile mit Umlaut")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_matches_plain_computation(few):
    check(few)


def test_hot_lines_take_the_other_way_with_the_same_answer(few, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_LEAST", 3)
    lines = line_dedup.keyed_lines(few, "doc_id", "text", 20)
    assert line_dedup.hot_hashes(lines).count() >= 2
    check(few)


def test_bitmaps_are_compressed(spark):
    text = "\n".join([f"line number {k} of a long document" for k in range(1000)] + [LINE])
    docs = spark.createDataFrame([(1, text), (2, LINE), (3, LINE)], "doc_id long, text string")
    maps = {r["doc"]: r for r in line_dedup.line_bitmaps(docs).collect()}
    assert [tuple(e) for e in maps[1]["bitmap"]] == [(1000 // 64, ~(1 << 1000 % 64))] and set(maps) == {1, 2}


def test_awkward_and_empty_tables(awkward, nothing):
    out = check(awkward.select("doc_id", "text", "source", "n_words", "span", F.lit(1).alias("body"), F.lit(2).alias("pos"),
                               F.lit(3).alias("words"), F.lit(4).alias("row"), F.lit(5).alias("n_lines")))
    assert {"body", "pos", "words", "row"} <= set(out.columns)
    check(nothing)


def test_one_exchange_of_the_cold_lines(spark, few):
    lines = line_dedup.keyed_lines(few, "doc_id", "text", 20)
    plan = line_dedup.dropped_cold(lines, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and plan.count("hashpartitioning") == 0 and plan.count("Sort [") == 1
