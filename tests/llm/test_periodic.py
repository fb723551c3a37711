"""Periodic runs against a scan of all periods."""

import random

import brute
import pyarrow as pa
import pytest
from newsgauge.llm import periodic, queries


def periodic_text(rng):
    n, v = rng.choice([0, 5, 23, 24, 30, 100, 400, 700]), rng.choice([1, 2, 3, 50])
    words = [f"w{rng.randrange(v)}" for _ in range(n)]
    for _ in range(rng.randrange(4)):
        if n > 30:
            start = rng.randrange(n)
            period = rng.choice([1, 8, 15, 16, 17, 18, 24, 25, 36, 37, 54, 55, 81, rng.randrange(1, n // 3)])
            for i in range(start, min(n, start + 3 * period + rng.randrange(-1, 40))):
                words[i] = words[start + (i - start) % period]
    return " ".join(words)


@pytest.mark.parametrize("seed", range(6))
def test_all_runs_are_found(seed):
    rng = random.Random(seed)
    texts = [periodic_text(rng) for _ in range(40)] + [None, "", " \n\t", "a", " a a\x1ca  a " * 30]
    runs, collapsed = periodic.answer(pa.array(texts, pa.string()))
    for text, found, rest in zip(texts, runs.to_pylist(), collapsed.to_pylist()):
        want, kept = brute.periodic_runs(text)
        assert [(r["start"], r["length"], r["period"]) for r in found] == want and rest == kept, text


def test_long_periods_across_scales():
    rng = random.Random(3)
    for period in (50, 333, 1000, 2500):
        base = [str(rng.randrange(10**6)) for _ in range(period)]
        words = ["x"] + base * 3 + base[:7] + ["y"]
        runs, _ = periodic.answer(pa.array(["filler text", " ".join(words)], pa.string()))
        assert runs.to_pylist()[1] == [{"start": 1, "length": 3 * period + 7, "period": period}]


def test_query_matches_plain_computation(spark, awkward, tmp_path):
    rng = random.Random(9)
    rows = [(1000 + k, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 10, 40, 300, 2000])))) for k in range(300)]
    docs = spark.createDataFrame(rows + [(1301, periodic_text(rng)), (1302, "é à " * 40)], "doc_id long, text string")
    docs = docs.union(awkward.select("doc_id", "text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = {(r["doc_id"], r["collapsed_sha256"]): tuple(r) for r in
           queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    # two very long texts repeat 997 words; the plain scan of all periods would take hours there
    want = [brute.periodic_digest(i, t) for i, t in rows if i not in (6, 7)]
    got = {k: v for k, v in out.items() if k[0] not in (6, 7)}
    assert sorted(got.values(), key=repr) == sorted(set(want), key=repr)
    assert [v[1:5] for k, v in out.items() if k[0] == 7] == [(1, 0, 60_000, 997)]
    assert sum(w[1] > 0 for w in want) > 20


def test_awkward_and_empty_tables(awkward, nothing):
    out = periodic.find_runs(awkward.withColumnRenamed("source", "runs").withColumnRenamed("kept", "collapsed"))
    assert out.count() == awkward.count() and dict(out.dtypes)["runs"].startswith("array")
    assert periodic.find_runs(nothing).count() == 0
