import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from newsgauge import fixed_values as fixed
from newsgauge.lexicon import Lexicon
from newsgauge.operators import agreement as ag
from newsgauge.operators import events as ev
from newsgauge.operators import sampling as sm
from newsgauge.operators import variants as va
from newsgauge.operators.collection import collection_status, pending_months
from newsgauge.streaming import incremental as inc

SERIES = "month string, value double"


def by_event(df, column):
    return {r["event"]: r[column] for r in df.collect()}


def test_calendar_rule(frame):
    series = frame([("2024-01", 100.0), ("2024-02", 111.0), ("2024-04", 80.0), ("2024-05", 70.0), ("2024-06", 0.0)], SERIES)
    events = [("2024-01", "no prior", "spike"), ("2024-02", "up", "spike"), ("2024-04", "gap", "drop"),
              ("2024-05", "down", "drop"), ("2030-01", "none", "spike")]
    got = ev.check_calendar(series, events)
    assert by_event(got, "result") == {"no prior": "FAIL", "up": "PASS", "gap": "FAIL", "down": "PASS", "none": "NO DATA"}
    assert by_event(got, "change_percent")["gap"] == 0.0 and by_event(got, "change_percent")["down"] == -12.5


def test_previous_row_rule(frame):
    series = frame([("2024-01", 100.0), ("2024-02", 106.0), ("2024-04", 105.0), ("2024-05", 105.0)], SERIES)
    events = [("2024-01", "first", "stable"), ("2024-02", "up", "spike_then_drop"), ("2024-04", "gap", "decrease"),
              ("2024-05", "flat", "stable"), ("2030-01", "none", "spike")]
    got = ev.check_previous(series, events)
    assert by_event(got, "status") == {"first": "failed", "up": "passed", "gap": "passed", "flat": "passed", "none": "no_data"}
    assert by_event(got, "actual") == {"first": "unknown", "up": "increase", "gap": "decrease", "flat": "stable", "none": None}
    row = ev.event_accuracy(got).first()
    assert (row["events_checked"], row["events_passed"], row["accuracy"]) == (4, 3, 0.75)
    nothing = ev.check_previous(series, [("2030-01", "none", "spike")])
    assert ev.event_accuracy(nothing).first()["accuracy"] is None
    assert ev.event_accuracy(nothing, 0.0).first()["accuracy"] == 0.0


def test_three_row_rule(frame):
    series = frame([("2024-01", 90.0), ("2024-02", 100.0), ("2024-03", 110.0), ("2024-04", 120.0), ("2024-05", 99.0)], SERIES)
    events = [("2024-01", "first", "decrease"), ("2024-04", "jump", "spike"), ("2024-05", "fall", "increase"), ("2030-01", "none", "spike")]
    got = ev.check_window(series, events)
    assert by_event(got, "actual") == {"first": "stable", "jump": "spiked", "fall": "decreased", "none": "No data"}
    assert by_event(got, "status") == {"first": "passed", "jump": "passed", "fall": "failed", "none": "unknown"}
    assert by_event(got, "change_pct")["jump"] == 20.0


def test_catalogue_size():
    names = [v.name for v in va.variant_list()]
    assert len(names) == len(set(names)) == 73
    assert collections.Counter(v.phase for v in va.variant_list()) == {1: 58, 2: 12, 3: 3}
    assert len(va.variant_list(phase=1)) == 58


LEX = Lexicon({"climate": ["solar"], "policy": ["law"], "uncertainty": ["risk", "doubt"], "reversal": ["repeal"],
               "implementation": ["delay"], "regime_ira": ["ira act"], "regime_obbba": ["big bill"], "trade": ["tariff"],
               "monetary": ["rates"]})
ROWS = [
    (1, "solar law risk", "repeal", "A"), (2, "solar law risk doubt", "delay", "A"), (3, "solar law", "repeal", "B"),
    (4, "tariff law risk", "", "B"), (5, "solar law doubt", "ira act", "B"),
]


def test_variant_counts(frame):
    articles = frame([(k, t, s, o, "2024-01") for k, t, s, o in ROWS],
                     "id bigint, title string, snippet string, source string, month string")
    labels = frame([(1, True, "reversal", 4), (2, False, "none", 5)],
                   "article_id bigint, is_climate_policy boolean, uncertainty_type string, certainty_level int")
    counts = va.variant_monthly_counts(articles, va.variant_list(LEX, ["A"]), LEX, labels, ["month", "outlet"])
    total = {r["variant"]: r for r in counts.groupBy("variant").agg(
        F.sum("denominator").alias("den"), F.sum("numerator_cpu").alias("cpu"),
        F.sum("numerator_reversal").alias("rev"), F.sum("numerator_impl").alias("impl"),
        F.sum("numerator_ira").alias("ira")).collect()}

    def row(name):
        r = total[name]
        return r["den"], r["cpu"], r["rev"], r["impl"], r["ira"]

    assert row("baseline") == (4, 3, 1, 1, 1)
    assert row("drop_uncertainty_risk") == (4, 2, 0, 1, 1)
    assert row("drop_climate_solar") == (0, 0, 0, 0, 0)
    assert row("drop_outlet_a") == (2, 1, 0, 0, 1)
    assert row("no_uncertainty_requirement") == (4, 4, 2, 1, 1)
    assert row("llm_validated") == (4, 1, 0, 0, 1)
    assert row("llm_threshold_70") == (4, 2, 1, 0, 1)
    assert row("placebo_trade_policy")[:2] == (5, 1)
    assert row("exclude_reversal_terms") == (4, 3, 0, 1, 1)
    assert row("exclude_regime_terms") == (4, 3, 1, 1, 0)


def test_variant_correlation(frame):
    rows = [("baseline", f"2024-0{m}", float(m)) for m in range(1, 5)]
    rows += [("same", f"2024-0{m}", 2.0 * m) for m in range(1, 5)] + [("flat", f"2024-0{m}", 1.0) for m in range(1, 5)]
    rows += [("one", "2024-01", 3.0)]
    got = va.variant_correlation(frame(rows, "variant string, month string, value double"))
    found = {r["variant"]: r["correlation"] for r in got.collect()}
    assert found["same"] == pytest.approx(1.0) and found["flat"] is None and found["one"] is None
    assert [r["variant"] for r in va.low_correlations(got).collect()] == []


def test_criteria(frame):
    rows = [("keyword_dropping", 0.96), ("placebo", 0.7), ("decomposition", 0.8), ("event_validation", None)]
    got = va.criteria_check(frame(rows, "criterion string, value double"))
    assert {r["criterion"]: r["passed"] for r in got.collect()} == {
        "keyword_dropping": True, "placebo": False, "decomposition": True, "event_validation": None}


def strata(frame, sizes):
    rows = [(f"{s}{k}", s) for s, n in sizes.items() for k in range(n)]
    return frame(rows, "id string, keyword_category string")


def test_stratified_sample(frame):
    df = strata(frame, {"none": 700, "reversal": 290, "implementation": 9, "rare": 1})
    got = sm.sample_stratified(df, "keyword_category", 100, seed=3)
    sizes = {r["keyword_category"]: r["n"] for r in got.groupBy("keyword_category").agg(F.count("*").alias("n")).collect()}
    assert sum(sizes.values()) == 100
    assert sizes["none"] >= 70 and sizes["reversal"] >= 28 and sizes["implementation"] >= 1 and sizes["rare"] == 1
    again = sm.sample_stratified(df.repartition(5), "keyword_category", 100, seed=3)
    assert {r["id"] for r in got.collect()} == {r["id"] for r in again.collect()}
    other = sm.sample_stratified(df, "keyword_category", 100, seed=4)
    assert {r["id"] for r in got.collect()} != {r["id"] for r in other.collect()}


def plain_sample(rows, n, seed):
    """Quotas, top-up and cut by a sort of everything."""
    order = {id: hashlib.md5(f"{seed}:{id}".encode()).hexdigest() for id, _ in rows}
    by = {}
    for id, stratum in sorted(rows, key=lambda row: order[row[0]]):
        by.setdefault(stratum, []).append(id)
    quota = {s: min(len(ids), max(1, int(n * (len(ids) / len(rows))))) for s, ids in by.items()}
    first = [id for s in sorted(by) for id in by[s][:quota[s]]]
    rest = sorted((id for s in by for id in by[s][quota[s]:]), key=order.get)
    return set((first + rest)[:n])


@pytest.mark.parametrize("margin", [6.0, -3.0])
@pytest.mark.parametrize("sizes", [{"hot": 9900, **{f"s{k}": 1 + k % 3 for k in range(50)}}, {f"s{k:05}": 1 for k in range(10000)}])
def test_stratified_sample_equals_a_sort_of_everything(frame, monkeypatch, sizes, margin):
    """Also when the margin is too narrow at first."""
    monkeypatch.setattr(sm, "MARGIN", margin)
    df = strata(frame, sizes)
    rows = [(f"{s}{k}", s) for s, n in sizes.items() for k in range(n)]
    assert {r["id"] for r in sm.stratified_ids(df, "keyword_category", 300, 5).collect()} == plain_sample(rows, 300, 5)


def test_stratified_sample_of_nothing(frame):
    assert sm.stratified_ids(strata(frame, {}), "keyword_category", 5).count() == 0


def test_sample_of_everything_and_surplus_strata(frame):
    small = strata(frame, {"a": 5, "b": 3})
    assert sm.sample_stratified(small, "keyword_category", 100).count() == 8
    many = frame([(str(k), f"s{k % 40}") for k in range(400)], "id string, keyword_category string")
    assert sm.sample_stratified(many, "keyword_category", 10).count() == 10


def test_expansion_is_nested_and_disjoint(frame):
    df = strata(frame, {"a": 200, "b": 100}).select("id")
    first = sm.sample_random(df, 50, seed=1)
    second = sm.sample_expand(df, first, 30, seed=2)
    ids = [r["id"] for r in second.collect()]
    assert len(ids) == len(set(ids)) == 80 and {r["id"] for r in first.collect()} <= set(ids)
    assert sm.sample_expand(df, df, 30).count() == 300


def test_unclassified(frame):
    df = frame([(k,) for k in range(10)], "id bigint")
    labels = frame([(k,) for k in range(7)], "article_id bigint")
    assert {r["id"] for r in sm.unclassified_sample(df, labels, 5).collect()} == {7, 8, 9}


ANSWERS = [
    ('{"is_climate_policy": true, "uncertainty_type": "reversal", "certainty_level": 5, "reasoning": "r"}',
     (True, "reversal", 5, "r"), False),
    ("{}", (False, "none", 3, None), False),
    ('{"uncertainty_type": "other"}', (None,) * 4, True),
    ('{"certainty_level": 6}', (None,) * 4, True),
    ('{"certainty_level": "high"}', (None,) * 4, True),
    ('{"certainty_level": 0}', (None,) * 4, True),
    ("nonsense", (None,) * 4, True),
    (None, (None,) * 4, True),
]


@pytest.mark.parametrize("answer, fields, bad", ANSWERS)
def test_parse(frame, answer, fields, bad):
    row = ag.parse_labels(frame([(answer,)], "answer string")).first()
    assert (row["is_climate_policy"], row["uncertainty_type"], row["certainty_level"], row["reasoning"]) == fields
    assert (row["error"] is not None) == bad


def test_agreement(frame):
    keywords = ag.keyword_labels(frame([(1, "reversal"), (2, "implementation"), (3, None), (4, "reversal"), (5, "none")],
                                       "id bigint, keyword_category string"))
    labels = frame([(1, True, "reversal"), (2, False, "none"), (3, True, "none"), (4, None, None)],
                   "article_id bigint, is_climate_policy boolean, uncertainty_type string")
    row = ag.agreement_metrics(keywords, labels).first()
    assert row["total_compared"] == 3
    assert row["climate_policy_accuracy"] == pytest.approx(2 / 3) and row["uncertainty_type_accuracy"] == pytest.approx(2 / 3)
    assert (row["reversal_accuracy"], row["implementation_accuracy"], row["none_accuracy"]) == (1.0, 0.0, 1.0)
    empty = ag.agreement_metrics(keywords, labels.limit(0)).first()
    assert (empty["overall"], empty["total_compared"], empty["none_accuracy"]) == (0.0, 0, None)


def test_adaptive_stops_early_or_at_the_limit(frame):
    rows = [(k, "none") for k in range(500)]
    articles = frame(rows, "id bigint, keyword_category string")
    schema = "article_id bigint, is_climate_policy boolean, uncertainty_type string"
    good = frame([(k, True, "none") for k, _ in rows], schema)
    row = ag.adaptive_validation(articles, good, n=50, expansion=20).first()
    assert (row["expansions"], row["sample_size"], row["overall"]) == (0, 50, 1.0)
    assert ag.validation_report(ag.adaptive_validation(articles, good, n=50)).first()["passed"]
    bad = frame([(k, False, "reversal") for k, _ in rows], schema)
    row = ag.adaptive_validation(articles, bad, n=50, expansion=20).first()
    assert (row["expansions"], row["sample_size"], row["overall"], row["total_compared"]) == (3, 110, 0.0, 110)
    report = ag.validation_report(ag.adaptive_validation(articles, bad, n=50, expansion=20)).collect()
    assert len(report) == 3 and not report[0]["passed"]


def test_prompt_keeps_the_limit(frame):
    df = frame([("T", "S", None, "x" * 3500), (None, None, None, None)], "title string, source string, date date, snippet string")
    long, empty = [r[0] for r in df.select(ag.prompt_column(limit=fixed.CONTENT_LIMIT)).collect()]
    assert "x" * 3000 + "..." in long and "x" * 3001 not in long and "Date: Unknown" in long
    assert "No title" in empty and "No content" in empty


def test_collection(frame):
    calendar = frame([(f"2024-0{m}",) for m in range(1, 5)], "month string")
    progress = frame([("2024-01", 10, True), ("2024-03", 5, False), ("2030-01", 99, True)], "month string, articles_fetched bigint, ok boolean")
    progress = progress.withColumn("completed_at", F.expr("if(ok, now(), null)"))
    assert [r["month"] for r in pending_months(calendar, progress.where("ok")).collect()] == ["2024-02", "2024-03", "2024-04"]
    row = collection_status(calendar, progress).first()
    assert (row["total_months"], row["completed_months"], row["pending_months"], row["percent_complete"],
            row["total_articles_collected"]) == (4, 1, 3, 0.25, 10)


def test_ingest_is_incremental_and_rerunnable(spark, frame, tmp_path):
    schema = "id string, title string, snippet string, source string, date date, month string, fetched_at timestamp"
    source, work = str(tmp_path / "in"), str(tmp_path / "work")

    def drop_in(rows):
        df = frame(rows, "id string, title string, month string").selectExpr(
            "id", "title", "'' as snippet", "'s' as source", "date'2024-01-01' as date", "month",
            "timestamp'2024-01-01 00:00:00' as fetched_at")
        df.write.mode("append").parquet(source)

    def counts():
        df = inc.ingest_folder(spark, source, inc.T.StructType.fromDDL(schema), work, Lexicon())
        return {r["month"]: (r["total_articles"], r["cpu_count"]) for r in df.collect()}

    drop_in([("1", "risk", "2024-01"), ("2", "calm", "2024-01")])
    assert counts() == {"2024-01": (2, 1)}
    assert counts() == {"2024-01": (2, 1)}
    drop_in([("2", "calm", "2024-01"), ("3", "doubt", "2024-02")])
    assert counts() == {"2024-01": (2, 1), "2024-02": (1, 1)}


def _ingest(spark, frame, tmp_path, waves, **options):
    """Monthly totals after each wave of (id, title, fetched_at) rows."""
    schema = "id string, title string, snippet string, source string, date date, month string, fetched_at timestamp"
    source, work = str(tmp_path / "in"), str(tmp_path / "work")
    for rows in waves:
        frame(rows, "id string, title string, fetched string").selectExpr(
            "id", "title", "'' as snippet", "'s' as source", "date'2024-01-01' as date", "'2024-01' as month",
            "timestamp(fetched) as fetched_at").write.mode("append").parquet(source)
        out = inc.ingest_folder(spark, source, inc.T.StructType.fromDDL(schema), work, Lexicon(), **options)
        yield [(r["total_articles"], r["cpu_count"]) for r in out.collect()]


def test_late_articles_are_kept(spark, frame, tmp_path):
    waves = [
        [(f"a{k}", "calm", "2024-06-01") for k in range(10)],
        [(f"b{k}", "calm", "2024-06-20") for k in range(5)],
        [(f"c{k}", "risk", "2024-01-05") for k in range(20)],
    ]
    assert list(_ingest(spark, frame, tmp_path, waves)) == [[(10, 0)], [(15, 0)], [(35, 20)]]


def test_waves_without_rows_have_empty_counts(spark, frame, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "id string, title string, snippet string, source string, date date, month string, fetched_at timestamp"
    folder = inc.ingest_folder(spark, str(tmp_path / "in"), inc.T.StructType.fromDDL(schema), str(tmp_path / "work"), Lexicon())
    assert folder.count() == 0 and "cpu_reversal_count" in folder.columns
    waves = [[], [], [("a", "risk", "2024-01-01")], [], [("a", "calm", "2024-02-01"), ("b", "risk", "2024-01-01")]]
    assert list(_ingest(spark, frame, tmp_path, waves)) == [[], [], [(1, 1)], [(1, 1)], [(2, 1)]]


def test_files_one_by_one_in_any_order(spark, frame, tmp_path):
    rows = [(f"d{k}", "calm", f"2024-0{1 + k * 5 % 9}-01") for k in range(16)]
    rows += [("d0", "risk", "2024-12-01"), ("d1", "risk", "2023-01-01")]
    for got in _ingest(spark, frame, tmp_path, [rows[:8], rows[8:16]], max_files=1):
        last = got
    assert last == [(16, 0)]
    again = list(_ingest(spark, frame, tmp_path, [[*rows[16:], ("d2", "risk", "2024-12-02"), ("d2", "calm", "2024-12-01")]]))
    assert again == [[(16, 3)]]


ARTICLE = "id string, title string, snippet string, source string, date date, month string, fetched_at timestamp"


def _counted(spark, frame, tmp_path, rows=None):
    """Counts kept up by changes, and counts of all rows, after another wave of (id, title, month, fetched)."""
    source, work = str(tmp_path / "in"), str(tmp_path / "work")
    if rows is not None:
        frame(rows, "id string, title string, month string, fetched string").selectExpr(
            "id", "title", "'' as snippet", "'s' as source", "date'2024-01-01' as date", "month",
            "timestamp(fetched) as fetched_at").write.mode("append").parquet(source)
    schema = inc.T.StructType.fromDDL(ARTICLE)
    kept, whole = (
        ingest(spark, source, schema, work + name, Lexicon())
        for name, ingest in (("-kept", inc.ingest_counted), ("-whole", inc.ingest_folder)))
    assert kept.columns == whole.columns
    found = [sorted(map(tuple, df.collect()), key=str) for df in (kept, whole)]
    assert found[0] == found[1]
    return {r[0]: r[1:3] for r in found[0]}


def test_counts_are_kept_up_by_changes(spark, frame, tmp_path):
    assert _counted(spark, frame, tmp_path, []) == {}
    wave = [("a", "risk", "2024-01", "2024-01-01"), ("b", "calm", "2024-01", "2024-01-01"), ("c", "risk", None, None)]
    assert _counted(spark, frame, tmp_path, wave) == {"2024-01": (2, 1), None: (1, 1)}
    # a changes its month, b its flags although it was fetched earlier; c comes twice, with and without a time
    wave = [("a", "risk", "2024-02", "2024-02-01"), ("b", "doubt", "2024-01", "2023-01-01"),
            ("c", "calm", "2024-03", "2024-01-02"), ("c", "risk", "2024-04", None)]
    want = {"2024-01": (1, 1), "2024-02": (1, 1), "2024-03": (1, 0)}
    assert _counted(spark, frame, tmp_path, wave) == want
    assert _counted(spark, frame, tmp_path) == want


def test_changes_of_many_ids_need_no_call_for_each(spark, frame, tmp_path, monkeypatch):
    """Batches meet the state in joins: no id goes through Python, and null ids are one id."""
    from pyspark.sql import GroupedData

    monkeypatch.setattr(GroupedData, "applyInPandasWithState", None)
    wave = [(f"d{k}", "risk" if k % 3 else "calm", f"2024-{1 + k % 4:02d}", "2024-01-01") for k in range(400)]
    assert _counted(spark, frame, tmp_path, wave + [(None, "risk", "2024-01", "2024-01-01")])["2024-01"][0] == 101
    moved = [(f"d{k}", "risk", "2024-05", "2024-02-01") for k in range(0, 400, 4)] + [(None, "calm", "2024-05", "2024-03-01")]
    assert _counted(spark, frame, tmp_path, moved + moved)["2024-05"] == (101, 100)
    back = _counted(spark, frame, tmp_path, wave[:4])
    assert back["2024-01"][0] == 1 and back["2024-05"] == (100, 99)


def test_changes_survive_a_break_before_the_commit(spark, frame, tmp_path):
    _counted(spark, frame, tmp_path, [("a", "risk", "2024-01", "2024-01-01"), ("b", "calm", "2024-01", "2024-01-01")])
    want = _counted(spark, frame, tmp_path, [("a", "calm", "2024-02", "2024-02-01")])
    commits = tmp_path / "work-kept" / "progress-changes" / "commits"
    last = max((p for p in commits.iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    for path in (last, commits / f".{last.name}.crc"):
        path.unlink(missing_ok=True)
    assert _counted(spark, frame, tmp_path) == want == {"2024-01": (1, 0), "2024-02": (1, 0)}


def test_outlet_rows_of_the_index_table(frame):
    from newsgauge.operators import index as ix

    rows = [("NYT", "2024-01", 100, 20), ("NYT", "2024-02", 100, 30), (None, "2024-01", 50, 5), ("WSJ", "2024-01", 10, 0)]
    counts = frame(rows, "outlet string, month string, total_articles bigint, uncertainty_count bigint")
    found = {(r["outlet"], r["month"]): r["normalized"] for r in ix.outlet_index_values(counts).collect()}
    assert found == {("NYT", "2024-01"): pytest.approx(80), ("NYT", "2024-02"): pytest.approx(120),
                     ("Unknown", "2024-01"): pytest.approx(100), ("WSJ", "2024-01"): 0.0}
    later = ix.index_scan(ix.outlet_index_values(counts, "2024-02", None, ["NYT"]), "CPU", "NYT").collect()
    assert [(r["month"], r["raw_ratio"], r["numerator"]) for r in later] == [("2024-01", 0.2, 20), ("2024-02", 0.3, 30)]
    assert later[0]["normalized"] == pytest.approx(100 * 0.2 / 0.3)


def test_boolean_queries(frame):
    from newsgauge.operators import tagging as tg

    rows = [(1, "solar policy risk"), (2, "solar policy"), (3, "risk"), (4, None)]
    df = frame(rows, "id int, title string").selectExpr("*", "'' as snippet", "'m' as month")
    lexicon = Lexicon()
    assert [r["id"] for r in tg.corpus_query(df, lexicon, ["uncertainty"], ["climate"]).collect()] == [3]
    found = tg.boolean_counts(df, {"one": (["climate", "policy"], []), "two": ([], ["uncertainty"]), "all": ([], [])}, lexicon)
    assert {k: found.first()[k] for k in ("one", "two", "all")} == {"one": 2, "two": 2, "all": 4}


def test_event_lists_are_complete():
    assert len(fixed.CALENDAR_EVENTS) == 4 and len(fixed.REGISTERED_EVENTS) == 8 and len(fixed.REPORT_EVENTS) == 7
