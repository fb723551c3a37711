from newsgauge.llm import quotes

SCHEMA = "message_id string, sent int, text string"


def threads(frame):
    return {r["message_id"]: (r["conversation"], r["position"], r["depth"], r["parent"], r["body"])
            for r in quotes.conversations(frame).collect()}


def test_nested_and_partial_quotations(spark):
    rows = [
        ("a", 1, "first line\n\nsecond paragraph here"),
        ("b", 2, "> second   paragraph here\nI agree"),
        ("c", 3, ">> second paragraph here\n> I agree\nSo do I\n> unknown words\nend"),
        ("d", 4, "> > I agree\nquoting only the older one"),
        ("e", 5, "> not sent by anybody\nalone"),
        ("f", 6, "first line"),
        ("g", 7, "> first line\nthe first one counts"),
        ("h", 1, "> I agree\nsent too early to answer"),
    ]
    got = threads(spark.createDataFrame(rows, SCHEMA))
    assert got["a"] == ("a", 0, 0, None, "first line\n\nsecond paragraph here")
    assert got["b"] == ("a", 1, 1, "a", "I agree")
    assert got["c"] == ("a", 3, 2, "b", "So do I\nend")
    assert got["d"] == ("a", 4, 2, "b", "quoting only the older one")
    assert got["e"][:4] == ("e", 0, 0, None) and got["f"][:4] == ("f", 0, 0, None)
    assert got["g"] == ("a", 2, 1, "a", "the first one counts") and got["h"][:4] == ("h", 0, 0, None)


def test_long_chain_and_wide_thread(spark):
    """Pointer doubling over a chain of 70 and a first message that 300 messages answer."""
    rows = [("c000", 0, "chain 0")] + [
        (f"c{k:03}", k, f"> chain {k - 1}\nchain {k}") for k in range(1, 70)]
    rows += [("w", 0, "wide")] + [(f"w{k:03}", 1 + k, f"> wide\nanswer {k}") for k in range(300)]
    got = threads(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert all(got[f"c{k:03}"][:3] == ("c000", k, k) for k in range(70))
    assert all(got[f"w{k:03}"][:3] == ("w", k + 1, 1) for k in range(300))


def test_awkward_and_empty_tables(spark):
    rows = [("a", 1, None), ("b", 1, ""), (None, 1, "words"), (None, 2, "> words\nx"), ("c", None, "> words\ny"),
            ("d", 2, "twice"), ("d", 2, "twice"), ("e", 3, "> twice\nz"), ("f", 3, ">"), ("g", 4, "> > \n>\n\x01\x02"),
            ("h", 9, "> " * 2000 + "deep\nline")]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS position", "2 AS body", "3 AS _id")
    out = quotes.conversations(frame)
    assert out.count() == len(rows)
    got = threads(frame)
    assert got["e"] == ("d", 1, 1, "d", "z") and got["a"] == ("a", 0, 0, None, "")
    assert got[None][0] is None and got["h"][4] == "line"
    assert quotes.conversations(frame.limit(0)).count() == 0
