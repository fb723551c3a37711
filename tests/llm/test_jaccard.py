import itertools
import random
import time
from collections import Counter

import pytest
from newsgauge.llm import jaccard
from newsgauge.llm.components import components


def brute_components(rows, limit):
    """id to (set size, smallest linked id) by comparing all pairs."""
    sets = {}
    for i, text in rows:
        words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
        grams = [tuple(words[j:j + limit.size]) for j in range(len(words) - limit.size + 1)]
        sets[i] = set(grams or ([tuple(words)] if words else []))
    low = {i: i for i in sets}

    def top(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        one, two = sets[a], sets[b]
        if one and two and len(one & two) * limit.den >= limit.num * len(one | two):
            x, y = top(a), top(b)
            low[max(x, y)] = min(x, y)
    return {i: (len(s), top(i)) for i, s in sets.items()}


def near_copies(seed, groups=10):
    """Groups of edited copies, some drifting, half of them around one passage."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    passage, rows = rng.choices(vocabulary, k=30), []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.choice([5, 12, 30, 60, 120, 200]))
        if rng.random() < 0.5:
            base[:0] = passage
        for _ in range(rng.choice([1, 2, 10, 30])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4, 6])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                base = words
            rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("seed, list_rows, limit", [
    (1, 2, jaccard.Limit(3, 90, 100)), (2, 100, jaccard.Limit(5, 80, 100)), (3, 1, jaccard.Limit(3, 70, 100)),
])
def test_equals_all_pairs(spark, monkeypatch, seed, list_rows, limit):
    monkeypatch.setattr(jaccard, "LIST_ROWS", list_rows)
    rows = near_copies(seed)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n"], r["component"]) for r in jaccard.jaccard_components(frame, limit).collect()}
    assert got == brute_components(rows, limit)


def test_two_stars_linked_only_through_members(spark, monkeypatch):
    """Pivots are not linked, a member of one links with a member of the other."""
    words = [f"w{k}" for k in range(400)]
    rows, low = [], list(words)
    for step in range(9):
        for copy in range(3):
            text = list(low)
            text[5 * copy] = f"c{step}-{copy}"
            rows.append((len(rows), " ".join(text)))
        low = list(low)
        for k in range(4):
            low[20 + 40 * step + 6 * k] = f"s{step}-{k}"
    limit = jaccard.Limit(3, 90, 100)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n"], r["component"]) for r in jaccard.jaccard_components(frame, limit).collect()}
    assert got == brute_components(rows, limit)


def test_large_group_meets_pivots_only(spark):
    """1,000 near copies meet in a few rows, not in half a million."""
    words = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(1000):
        text = list(words)
        text[k % 200] = f"x{k}"
        rows.append((k, " ".join(text)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    limit = jaccard.Limit(3, 90, 100)
    base = jaccard.base_rows(frame, limit, "doc_id", "text").where("n > 0")
    starred = jaccard.stars(jaccard.one_row_per_set(base), frame, limit, "text")
    found = jaccard.prefixes(starred, jaccard.frequent(starred, limit), limit)
    assert jaccard.list_pairs(jaccard.entries(found, limit), limit).count() < 20_000
    assert {r["component"] for r in jaccard.jaccard_components(frame, limit).collect()} == {0}


@pytest.mark.parametrize("copies, edits", [(150, 3), (300, 9), (600, 4)])
def test_links_grow_with_the_members(spark, copies, edits):
    """Near copies of one text, with few edits or with so many that most are not linked with each other."""
    rng = random.Random(copies + edits)
    words = [f"w{k}" for k in range(300)]
    limit, usual, sets = jaccard.Limit(3, 90, 100), set(), []
    for k in range(copies):
        text = list(words)
        for place in rng.sample(range(300), edits if k else 0):
            text[place] = f"x{k}-{place}"
        sets.append({hash(tuple(text[j:j + 3])) for j in range(298)})
    base = sets[copies // 2]
    deltas = spark.createDataFrame(
        [(-1, k, len(s), len(base), list(s ^ base)) for k, s in enumerate(sets) if k != copies // 2],
        "root long, node long, n int, root_n int, delta array<long>").repartition(4)
    links = jaccard.member_links(jaccard.recentred(deltas), limit)
    assert links.count() <= 2 * copies
    labels = {r["node"]: r["label"] for r in components(links).collect()}
    sizes = sorted(Counter(labels.get(-1 if k == copies // 2 else k, ("alone", k)) for k in range(copies)).values())
    low = list(range(copies))

    def top(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in itertools.combinations(range(copies), 2):
        if len(sets[a] & sets[b]) * limit.den >= limit.num * len(sets[a] | sets[b]):
            low[max(top(a), top(b))] = min(top(a), top(b))
    assert sizes == sorted(Counter(map(top, range(copies))).values())


def shuffle_files(spark):
    folder = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return sum(folder.apply(k).getName().startswith("shuffle_") for k in range(folder.size()))


def test_steps_leave_no_shuffle_files(spark):
    """Many rounds over few rows: what a step has shuffled goes with it, and few rows are in few partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        links = spark.createDataFrame([(k, k + 1) for k in range(300)], "a long, b long").repartition(40)
        there = shuffle_files(spark)
        labels = components(links)
        for _ in range(50):
            if (left := shuffle_files(spark) - there) <= 400:
                break
            time.sleep(0.2)
        assert left <= 400
        assert labels.rdd.getNumPartitions() == 1
        assert {r["label"] for r in labels.collect()} == {0}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_prefixes_take_batches_apart(spark, monkeypatch):
    """Short batches give the same prefixes, and no array is made of more rows than a batch has."""
    limit = jaccard.Limit(3, 80, 100)
    frame = spark.createDataFrame(near_copies(5), "doc_id long, text string").coalesce(1)
    nodes = jaccard.one_row_per_set(jaccard.base_rows(frame, limit, "doc_id", "text")).selectExpr(
        "*", "node AS star", "0.0D AS far", "false AS large")
    late = jaccard.frequent(nodes, limit)
    whole = {r["node"]: r["prefix"] for r in jaccard.prefixes(nodes, late, limit).collect()}
    monkeypatch.setattr(jaccard, "BATCH_ROWS", 7)
    assert {r["node"]: r["prefix"] for r in jaccard.prefixes(nodes, late, limit).collect()} == whole
    assert len(whole) > 30


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(0, 100)] + [(500, k) for k in range(501, 560)] + [(7, 7), (900, 800)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(101)}, **{k: 500 for k in range(500, 560)}, 800: 800, 900: 800}


def test_awkward_and_empty_tables(awkward, nothing):
    limit = jaccard.Limit(3, 90, 100)
    assert jaccard.jaccard_components(nothing, limit).count() == 0
    got = {(r["doc_id"], r["n"]): r["component"] for r in jaccard.jaccard_components(awkward, limit).collect()}
    assert got[(1, 0)] == 1 and got[(5, 1)] == 4 and got[(7, 998)] == 6 and got[(11, 2)] == 10
    assert got[(None, 1)] is None and got[(None, 0)] is None and got[(9, 1)] == 9
    kept = jaccard.keep_one(awkward, limit)
    assert kept.columns == awkward.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 6, 8, 9, 9, 10, 12]
    assert jaccard.keep_one(nothing, limit).count() == 0
