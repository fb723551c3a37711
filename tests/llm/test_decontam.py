import random

import brute
from newsgauge.llm import decontam


def hits(docs, benchmark, **more):
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"])
            for r in decontam.decontaminate(docs, benchmark, **more).collect()}


def test_equals_sliding_search(spark):
    rng = random.Random(5)
    words = ["a", "B", "été", "x1", "the", "of", "9", "zz"]
    text = lambda n: rng.choice([" ", "-", ", "]).join(rng.choices(words, k=n))
    items = [(k, text(n)) for k, n in enumerate([1, 2, 3, 9, 10, 11, 30, 30, 45])]
    items += [(50, None), (51, ""), (52, "!?"), (53, items[6][1].upper()), (54, items[7][1])]
    docs = [(k, text(rng.choice([0, 1, 5, 20, 700]))) for k in range(40)]
    docs += [(100 + k, f"{text(30)} {t} {text(300)}. {t}") for k, (_, t) in enumerate(items) if t]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for part in (items, items[4:]):
        want = {i: brute.decontaminate(t, part) for i, t in docs}
        assert hits(frame, benchmark.where(f"item_id >= {part[0][0]}")) == want


def test_blocks_of_a_large_benchmark_add_up(spark, monkeypatch):
    items = [(k, " ".join(f"w{(k * 7 + j) % 90}" for j in range(14))) for k in range(30)]
    docs = [(k, " ".join(f"w{j % 90}" for j in range(k, k + 40))) for k in range(20)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = {i: brute.decontaminate(t, items) for i, t in docs}
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 500)
    monkeypatch.setattr(decontam, "CHUNK_BYTES", 300)
    assert hits(frame, benchmark) == want


def test_awkward_and_empty_tables(spark, awkward, nothing):
    benchmark = spark.createDataFrame([(1, "same row"), (2, None)], "item_id long, text string")
    assert decontam.decontaminate(nothing, benchmark).count() == 0
    assert decontam.decontaminate(awkward, benchmark.limit(0)).where("n_hit > 0").count() == 0
    out = decontam.decontaminate(awkward, benchmark, keep=("text", "n_words"), found=("w", "h", "i"))
    rows = out.collect()
    assert len(rows) == awkward.count() and sum(r["h"] for r in rows) == 4
    assert all(r["w"] == len(brute.bench_words(r["text"])) for r in rows)
