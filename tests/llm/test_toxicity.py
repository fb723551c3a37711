import random

import numpy as np
from newsgauge.llm import toxicity
from pyspark.sql import functions as F


def test_pairs_are_learned():
    """Toxic exactly when an insult stands beside a group's name: no additive score separates that."""
    rng = np.random.default_rng(1)
    x = (rng.random((2000, 6)) < 0.5).astype(float)
    y = x[:, 0] * x[:, 1]
    bias, w, v = toxicity.fit(x, y)
    machine = toxicity.Machine(list(range(6)), bias, w, v)
    rows, columns = np.nonzero(x)
    assert ((machine.score(rows, columns, len(x)) > 0.5) == (y > 0)).mean() > 0.99


def test_score_sums_all_pairs():
    rng = np.random.default_rng(2)
    m = toxicity.Machine([0, 1, 2], 0.3, rng.normal(size=3), rng.normal(size=(3, 4)))
    raw = 0.3 + m.weights[[0, 2]].sum() + m.factors[0] @ m.factors[2]
    got = m.score(np.array([1, 1]), np.array([0, 2]), 3)
    assert abs(got[1] - 1 / (1 + np.exp(-raw))) < 1e-12
    assert abs(got[0] - 1 / (1 + np.exp(-0.3))) < 1e-12


def test_held_out_accuracy(spark):
    rng = random.Random(3)
    vocabulary = [f"term{k}" for k in range(300)]
    rows = []
    for k in range(1200):
        words, toxic = rng.choices(vocabulary, k=40), k % 6 == 0
        if toxic:
            words[rng.randrange(40)] = rng.choice(["vileword", "Nastyword", "BADWORD"])
        rows.append((k, " ".join(words), int(toxic)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = frame.select("doc_id", "toxic")
    machine = toxicity.train(frame, labels.where("doc_id % 5 <> 0"))
    out = toxicity.score(frame, machine).where("doc_id % 5 = 0").collect()
    assert np.mean([(r["score"] >= 0.3) == r["toxic"] for r in out]) > 0.99


def test_awkward_empty_and_one_class(awkward, nothing, labels):
    for known, docs in ((labels, awkward), (labels, nothing), (labels.limit(0), awkward),
                        (labels.where("toxic = 1"), awkward)):
        out = toxicity.score(docs, toxicity.train(docs, known), out="_s")
        assert out.columns == [*docs.columns, "_s"] and out.count() == docs.count()
        assert out.where(F.col("_s").isNull() | (F.col("_s") < 0) | (F.col("_s") > 1)).count() == 0


def test_documents_toxic_only_through_a_pair(spark):
    """A group's name and a mild word, each little marked alone: train() has to keep both, score() to use them."""
    rng = random.Random(4)
    vocabulary = [f"term{k}" for k in range(300)]
    rows = []
    for k in range(4000):
        words, toxic, kind = rng.choices(vocabulary, k=40), k % 10 == 0, ""
        if toxic:
            words[0] = "vileword"
        elif k % 50 == 1:
            words[1:3], toxic, kind = ["groupname", "mildword"], True, "both"
        elif k % 10 in (3, 5) and k % 50 < 40:
            words[1], kind = ("groupname", "one") if k % 10 == 3 else ("mildword", "one")
        rng.shuffle(words)
        rows.append((k, " ".join(words), int(toxic), kind))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int, kind string")
    seen = [r for r in rows if r[0] // 50 % 4]
    n, pos = len(seen), sum(r[2] for r in seen)
    for word in ("groupname", "mildword"):
        with_word = [r[2] for r in seen if word in r[1].split()]
        a, m = sum(with_word), len(with_word)
        assert n * (a * (n - pos) - (m - a) * pos) ** 2 / (m * (n - m) * pos * (n - pos)) < toxicity.MIN_CHI2
    machine = toxicity.train(frame, frame.select("doc_id", "toxic").where("floor(doc_id / 50) % 4 <> 0"))
    out = toxicity.score(frame, machine).where("floor(doc_id / 50) % 4 = 0").collect()
    for kind, wanted in (("both", 1), ("one", 0)):
        hits = [(r["score"] >= 0.3) == wanted for r in out if r["kind"] == kind]
        assert len(hits) >= 20 and np.mean(hits) > 0.95
    assert np.mean([(r["score"] >= 0.3) == r["toxic"] for r in out]) > 0.98
