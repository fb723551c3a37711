import random

import brute
from newsgauge.llm import secrets
from pyspark.sql import functions as F


def test_base_spans_match_plain_computation(spark, awkward):
    texts = [
        "token=token:abcdef", 'PassWord" : "hunter22" api-key=x api_key=abcdef', "apikey==abc_def secret: abc",
        "AKIA" + "A" * 16, "AKIA" + "B" * 15, "AKIAAKIA" + "C" * 16, "x" + "a1" * 12, "0" * 23, "f" * 24 + "g" + "e" * 25,
        "\U0001f600 token = '" + "9" * 30 + "'", "passwd:=oops secret  =  \"long-enough\"", "token: abcde" ,
    ]
    rows = awkward.select("doc_id", "text").union(
        spark.createDataFrame([(100 + k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    for r in secrets.pattern_spans(rows).collect():
        assert [(s["start"], s["kind"], s["end"]) for s in r["_base"]] == brute.secret_base(r["text"]), r["text"]


def test_random_strings_are_told_from_identifiers(spark):
    rng = random.Random(4)
    chars = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    words = ["compute", "average", "document", "register", "transaction", "customer", "interval", "statement"]
    text = lambda: " ".join(rng.choice(words) + "_" + rng.choice(words) for _ in range(30))
    rows = [(k, text() + (f" token = {''.join(rng.choices(chars, k=32))}" if k % 4 == 0 else "")) for k in range(200)]
    hidden = [(1000 + k, f"{text()} {''.join(rng.choices(chars, k=30))} {text()}") for k in range(40)]
    plain = [(2000 + k, f"{text()} {'_'.join(rng.choices(words, k=4))} {text()}") for k in range(40)]
    frame = spark.createDataFrame(rows + hidden + plain, "doc_id long, text string")
    added = {r["doc_id"]: [s for s in r["spans"] if s["kind"] == 3] for r in secrets.scan(frame).collect()}
    assert sum(bool(added[i]) for i, _ in hidden) >= 38
    assert sum(bool(added[i]) for i, _ in plain) <= 1
    for i, t in hidden:
        assert all(t[s["start"]:s["end"]] == s["value"] for s in added[i])


def test_awkward_and_empty_tables(awkward, nothing):
    assert secrets.scan(nothing).count() == 0
    out = secrets.scan(awkward)
    assert out.count() == awkward.count()
    assert out.where(F.size("spans") > 0).count() == 0


def test_a_key_around_a_hex_run_is_found_whole(spark):
    rng = random.Random(5)
    chars = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    words = ["compute", "average", "document", "register", "transaction", "customer"]
    rows = [(k, " ".join(f"{rng.choice(words)}_{rng.choice(words)}" for _ in range(30)) + (
        f" token = {''.join(rng.choices(chars, k=32))}" if k % 4 == 0 else "")) for k in range(200)]
    run = "".join(rng.choices("0123456789abcdef", k=24))
    key = f"sk_live_Zq8RkT2v{run}Wm9XyPq3LtB7"
    rows += [(900, f"key {key} end"), (901, "my_token=Zq8RkT2vWm9XyPq3LtB7 end"), (902, f"sum {run} end")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: [(s["kind"], s["value"]) for s in r["spans"]] for r in secrets.scan(frame).collect()}
    assert (3, key) in found[900] and any(k == 2 for k, _ in found[900])  # the base span stays
    # an assignment or a whole hex run is explained by its base span
    assert [k for k, _ in found[901]] == [0] and found[902] == [(2, run)]


def test_columns_named_like_results_and_working_columns(awkward):
    names = ("_text", "_base", "_long", "_ratios", "base", "spans")
    out = secrets.scan(awkward.select("doc_id", "text", *[F.lit(f"own {n}").alias(n) for n in names]))
    assert out.count() == awkward.count() and out.where(F.size("spans") > 0).count() == 0
    assert {tuple(r) for r in out.select(*names[:4]).distinct().collect()} == {tuple(f"own {n}" for n in names[:4])}
