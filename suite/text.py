"""Queries over the documents: scans, tagging, counts, sampling, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsgauge import fixed_values as fixed
from newsgauge.functions.calendar import calendar_of, month_bounds
from newsgauge.functions.text import matched_terms, normalize_text, search_query
from newsgauge.lexicon import FLAGS
from newsgauge.operators import agreement as ag
from newsgauge.operators import collection as co
from newsgauge.operators import dedup as dd
from newsgauge.operators import index as ix
from newsgauge.operators import sampling as sm
from newsgauge.operators import tagging as tg
from newsgauge.sources import files
from newsgauge.sources import tables as tb
from suite import inputs as i
from suite.registry import query, r, rounded

W, ART, TXT, HITS = i.with_, i.ARTICLES, i.TEXT, i.HITS
ROWS = "id, title, source, date, month"


# --- scans ---------------------------------------------------------------------------------------


@query("articles_ordered", W(ART) + f"SELECT {ROWS} FROM articles ORDER BY date, id")
def _(spark, sf):
    return i.articles(spark, sf).drop("snippet").orderBy("date", "id")


@query("articles_by_month", W(ART) + f"SELECT {ROWS} FROM articles WHERE month = '2021-02'")
def _(spark, sf):
    return i.articles(spark, sf).where("month = '2021-02'").drop("snippet")


@query("articles_by_source", W(ART) + f"SELECT {ROWS} FROM articles WHERE source = 'src3'")
def _(spark, sf):
    return i.articles(spark, sf).where("source = 'src3'").drop("snippet")


@query("article_by_id", W(ART) + f"SELECT {ROWS}, length(snippet) AS n_chars FROM articles WHERE id = 7")
def _(spark, sf):
    return i.articles(spark, sf).where("id = 7").select(
        *ROWS.split(", "), F.length("snippet").cast("bigint").alias("n_chars")
    )


@query("label_by_id", W(i.LABELS) + "SELECT * FROM llm WHERE article_id = 7")
def _(spark, sf):
    return i.labels(spark, sf).where("article_id = 7")


def _pages(spark, sf):
    """Search pages of 50 articles per month, as JSON."""
    item = F.struct(
        F.col("id").cast("string").alias("ResultId"), F.col("title").alias("Title"),
        F.col("date").cast("string").alias("Date"),
        F.struct(F.col("source").alias("Name")).alias("Source"),
        F.col("snippet").alias("Overview"),
    )
    page = F.struct(F.count("*").alias("@odata.count"), F.collect_list(item).alias("value"))
    return i.articles(spark, sf).groupBy("month", F.expr("id div 50").alias("page")).agg(
        F.to_json(page).alias("response_json")
    )


@query("pages_flatten", W(ART) + """
SELECT CAST(id AS VARCHAR) AS id, title, CAST(date AS VARCHAR) AS date, source, md5(snippet) AS snippet_md5,
       month, id // 50 AS page FROM articles""")
def _(spark, sf):
    return files.flatten_pages(_pages(spark, sf)).withColumn("snippet_md5", F.md5("snippet")).drop("snippet")


@query("raw_responses_month", W(ART) + """
SELECT month, id // 50 AS page, count(*) AS articles, sha256('corpus query') AS query_hash
FROM articles WHERE month = '2021-02' GROUP BY 1, 2""")
def _(spark, sf):
    from newsgauge.session import scratch_path

    path = scratch_path(spark, "raw-responses")
    tb.append_raw_response(_pages(spark, sf).withColumn("query", F.lit("corpus query")), path)
    log = spark.read.parquet(path).where("month = '2021-02'").orderBy("fetched_at")
    answers = files.flatten_pages(log)
    return answers.groupBy(
        "month", F.expr("cast(id as bigint) div 50").alias("page"), "query_hash"
    ).agg(F.count("*").alias("articles"))


QUERY_TEXT = search_query(i.TERMS["climate"], i.TERMS["policy"])


@query("query_fingerprint", W(ART) + f"""
SELECT month, left(sha256('{QUERY_TEXT}' || '|Date ge ' || month || '-01 and Date le '
       || CAST(last_day(CAST(month || '-01' AS DATE)) AS VARCHAR)), 16) AS query_hash
FROM (SELECT DISTINCT month FROM articles)""")
def _(spark, sf):
    return co.query_fingerprints(i.articles(spark, sf).select("month").distinct(), QUERY_TEXT)


# --- text expressions ------------------------------------------------------------------------------


@query("text_normalize", W(ART) + f"""
SELECT id, {i.norm('title')} AS title, md5({i.norm('snippet')}) AS snippet_md5 FROM articles""")
def _(spark, sf):
    return i.articles(spark, sf).select(
        "id", normalize_text(F.col("title")).alias("title"),
        F.md5(normalize_text(F.col("snippet"))).alias("snippet_md5"),
    )


PROBES = ["the", "on the", "BY-NC", "WITH", "la"]


@query("term_match", W(ART, TXT) + f"SELECT id, array_to_string({i.matched_sql(PROBES)}, '|') AS matched FROM texts")
def _(spark, sf):
    from newsgauge.functions.text import join_text, present_words

    rows = i.articles(spark, sf).select("id", join_text(F.col("title"), F.col("snippet")).alias("t"))
    rows = rows.withColumn("w", present_words(F.col("t"), PROBES))
    return rows.select(
        "id", F.concat_ws("|", matched_terms(F.col("t"), F.col("w"), PROBES)).alias("matched")
    )


FLAG_SQL = ", ".join(f"{c} AS {f}" for c, f in FLAGS.items())
MATCH_SQL = ", ".join(
    f"array_to_string({i.matched_sql(i.TERMS[c])}, '|') AS {c}_terms" for c in FLAGS
)


@query("classify_articles", W(ART, TXT, HITS) + f"""
SELECT id, {FLAG_SQL}, {MATCH_SQL} FROM hits JOIN (SELECT id, txt FROM texts) USING (id)""")
def _(spark, sf):
    tagged = tg.classify_articles(i.articles(spark, sf), i.LEXICON)
    return tagged.select(
        "id", *FLAGS.values(),
        *[F.concat_ws("|", F.col("matched_terms")[c]).alias(f"{c}_terms") for c in FLAGS],
    )


def _classified(spark, sf, keep=("id", "month", "source")):
    return tg.classify_articles(i.articles(spark, sf), i.LEXICON, False, keep)


@query("index_flags", W(ART, TXT, HITS) + """
SELECT id, uncertainty AS is_cpu, uncertainty AND reversal AS is_cpu_reversal,
       uncertainty AND implementation AS is_cpu_impl, uncertainty AND upside AS is_cpu_upside,
       regime_ira AS is_regime_ira, regime_obbba AS is_regime_obbba FROM hits""")
def _(spark, sf):
    return tg.index_flags(_classified(spark, sf, ["id"])).drop(*FLAGS.values())


@query("index_flags_ungated", W(ART, TXT, HITS) + """
SELECT id, uncertainty OR reversal OR implementation AS is_cpu, reversal AS is_cpu_reversal,
       implementation AS is_cpu_impl, upside AS is_cpu_upside,
       regime_ira AS is_regime_ira, regime_obbba AS is_regime_obbba FROM hits""")
def _(spark, sf):
    return tg.index_flags(_classified(spark, sf, ["id"]), False).drop(*FLAGS.values())


EXCLUDED = ["FROM", "by", "des"]


def _kept(category):
    return [t for t in i.TERMS[category] if t.lower() not in {e.lower() for e in EXCLUDED}]


@query("terms_excluded", W(ART, TXT) + f"""
SELECT id, {i.any_sql(_kept('uncertainty'))} AS has_uncertainty,
       {i.any_sql(_kept('reversal'))} AS has_reversal_terms FROM texts""")
def _(spark, sf):
    lexicon = i.LEXICON.without(*EXCLUDED)
    tagged = tg.classify_articles(i.articles(spark, sf), lexicon, False)
    return tagged.select("id", "has_uncertainty", "has_reversal_terms")


@query("placebo_flags", W(ART, TXT, HITS) + """
SELECT id, d.domain, CASE d.domain WHEN 'trade' THEN trade ELSE monetary END AS has_domain_terms,
       policy AS has_policy_terms, uncertainty AS has_uncertainty,
       CASE d.domain WHEN 'trade' THEN trade ELSE monetary END AND policy AND uncertainty AS is_placebo_cpu
FROM hits, (VALUES ('trade'), ('monetary')) d(domain)""")
def _(spark, sf):
    articles = i.articles(spark, sf)
    trade, monetary = (
        tg.placebo_flags(articles, d, i.LEXICON).withColumn("domain", F.lit(d))
        for d in ("trade", "monetary")
    )
    return trade.unionByName(monetary)


@query("corpus_query", W(ART, TXT, HITS) + """
SELECT id, month, source FROM hits WHERE climate AND policy AND uncertainty AND reversal""")
def _(spark, sf):
    categories = ["climate", "policy", "uncertainty", "reversal"]
    return tg.corpus_query(i.articles(spark, sf), i.LEXICON, categories).select("id", "month", "source")


BOOLEAN = {
    "covered": (["climate", "policy"], []),
    "calm": (["climate", "policy"], ["uncertainty"]),
    "turning": (["reversal", "uncertainty"], ["implementation"]),
    "one_sided": (["implementation"], ["reversal", "trade", "monetary"]),
}


@query("boolean_counts", W(ART, TXT, HITS) + "SELECT month, " + ", ".join(
    f"count(*) FILTER (WHERE {' AND '.join([*yes, *[f'NOT {c}' for c in no]])}) AS {name}"
    for name, (yes, no) in BOOLEAN.items()) + " FROM hits GROUP BY month")
def _(spark, sf):
    return tg.boolean_counts(i.articles(spark, sf), BOOLEAN, i.LEXICON)


@query("month_bounds", W(ART) + """
SELECT month, min(date) AS first_seen, CAST(month || '-01' AS DATE) AS first_day,
       last_day(CAST(month || '-01' AS DATE)) AS last_day FROM articles GROUP BY month""")
def _(spark, sf):
    first, last = month_bounds(F.col("month"))
    months = i.articles(spark, sf).groupBy("month").agg(F.min("date").alias("first_seen"))
    return months.withColumns({"first_day": first, "last_day": last})


@query("month_calendar", """
SELECT strftime(unnest(generate_series(date_trunc('month', min(o_orderdate)), max(o_orderdate),
       INTERVAL 1 MONTH)), '%Y-%m') AS month FROM orders""")
def _(spark, sf):
    return calendar_of(i.table(spark, sf, "orders"), "o_orderdate")


@query("wire_service_flag", W(ART) + """
SELECT id, lower(CASE WHEN source = 'src1' THEN 'Reuters' WHEN source = 'src2' THEN 'AP' ELSE source END)
       IN ('associated press', 'ap', 'reuters', 'afp', 'agence france-presse', 'agence france presse',
           'united press international', 'upi') AS is_wire FROM articles""")
def _(spark, sf):
    source = F.when(F.col("source") == "src1", "Reuters").when(
        F.col("source") == "src2", "AP").otherwise(F.col("source"))
    return i.articles(spark, sf).select("id", dd.is_wire_service(source).alias("is_wire"))


# --- counts -----------------------------------------------------------------------------------------


@query("count_by_month", W(ART) + "SELECT month, count(*) AS n FROM articles GROUP BY month")
def _(spark, sf):
    return i.articles(spark, sf).groupBy("month").agg(F.count("*").alias("n")).orderBy("month")


@query("count_by_source", W(ART) + "SELECT source, count(*) AS n FROM articles GROUP BY source")
def _(spark, sf):
    return i.articles(spark, sf).groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query("count_total", "SELECT count(*) AS n FROM documents")
def _(spark, sf):
    return i.articles(spark, sf).agg(F.count("*").alias("n"))


@query("class_counts_month", W(ART, TXT, HITS, i.CLASS_COUNTS) + "SELECT * FROM class_counts")
def _(spark, sf):
    return tg.class_counts(i.articles(spark, sf), _classified(spark, sf, ["id"]))


@query("class_counts_outlet", W(ART, TXT, HITS) + """
SELECT source AS outlet, month, count(*) AS total_articles,
       count(*) FILTER (WHERE uncertainty) AS uncertainty_count,
       count(*) FILTER (WHERE uncertainty AND reversal) AS reversal_uncertainty_count,
       count(*) FILTER (WHERE uncertainty AND implementation) AS implementation_uncertainty_count
FROM hits GROUP BY 1, 2""")
def _(spark, sf):
    rows = i.articles(spark, sf).withColumnRenamed("source", "outlet")
    return tg.class_counts(rows, _classified(spark, sf, ["id"]), ["outlet", "month"], by_outlet=True)


COUNTED = ["cpu", "cpu_reversal", "cpu_impl", "cpu_upside", "regime_ira", "regime_obbba"]


@query("index_counts", W(ART, TXT, HITS) + """
SELECT month, count(*) AS total_articles, count(*) FILTER (WHERE uncertainty) AS cpu_count,
       count(*) FILTER (WHERE uncertainty AND reversal) AS cpu_reversal_count,
       count(*) FILTER (WHERE uncertainty AND implementation) AS cpu_impl_count,
       count(*) FILTER (WHERE uncertainty AND upside) AS cpu_upside_count,
       count(*) FILTER (WHERE regime_ira) AS regime_ira_count,
       count(*) FILTER (WHERE regime_obbba) AS regime_obbba_count FROM hits GROUP BY month""")
def _(spark, sf):
    return tg.index_counts(_classified(spark, sf, ["month"]))


@query("index_counts_ungated", W(ART, TXT, HITS) + """
SELECT month, count(*) AS total_articles,
       count(*) FILTER (WHERE uncertainty OR reversal OR implementation) AS cpu_count,
       count(*) FILTER (WHERE reversal) AS cpu_reversal_count,
       count(*) FILTER (WHERE implementation) AS cpu_impl_count,
       count(*) FILTER (WHERE upside) AS cpu_upside_count,
       count(*) FILTER (WHERE regime_ira) AS regime_ira_count,
       count(*) FILTER (WHERE regime_obbba) AS regime_obbba_count FROM hits GROUP BY month""")
def _(spark, sf):
    return tg.index_counts(_classified(spark, sf, ["month"]), require_uncertainty=False)


QUERY_COUNTS = """q AS (
  SELECT month, count(*) FILTER (WHERE climate AND policy) AS denominator,
         count(*) FILTER (WHERE climate AND policy AND uncertainty) AS numerator_cpu,
         count(*) FILTER (WHERE climate AND policy AND uncertainty AND implementation) AS numerator_impl,
         count(*) FILTER (WHERE climate AND policy AND uncertainty AND reversal) AS numerator_reversal
  FROM hits GROUP BY month)"""


@query("monthly_counts", W(ART, TXT, HITS, QUERY_COUNTS) + "SELECT * FROM q")
def _(spark, sf):
    return tg.monthly_counts(i.articles(spark, sf), i.LEXICON)


@query("raw_counts", W(ART, TXT, HITS, QUERY_COUNTS) + """
SELECT month, denominator AS total_articles, numerator_cpu AS uncertainty_count,
       numerator_impl AS implementation_uncertainty_count,
       numerator_reversal AS reversal_uncertainty_count,
       CAST(0 AS BIGINT) AS ira_count, CAST(0 AS BIGINT) AS obbba_count FROM q""")
def _(spark, sf):
    articles = i.articles(spark, sf)
    return ix.raw_counts(
        tg.monthly_counts(articles, i.LEXICON),
        tg.class_counts(articles, _classified(spark, sf, ["id"])),
    )


@query("raw_counts_articles", W(ART, TXT, HITS, i.CLASS_COUNTS) + """
SELECT * EXCLUDE (upside_uncertainty_count) FROM class_counts""")
def _(spark, sf):
    articles = i.articles(spark, sf)
    empty = i.counts(spark, sf).where("denominator < 0")
    return ix.raw_counts(empty, tg.class_counts(articles, _classified(spark, sf, ["id"])))


@query("placebo_index", W(ART, TXT, HITS) + f"""
SELECT month, domain, {r('100 * ratio / avg(ratio) OVER (PARTITION BY domain)')} AS value FROM (
  SELECT month, d.domain, count(*) FILTER (WHERE CASE d.domain WHEN 'trade' THEN trade ELSE monetary END
         AND policy AND uncertainty) / count(*) AS ratio
  FROM hits, (VALUES ('trade'), ('monetary')) d(domain) GROUP BY 1, 2)""")
def _(spark, sf):
    return rounded(_placebo_series(spark, sf))


def _placebo_series(spark, sf):
    rows = None
    for domain in ("trade", "monetary"):
        flagged = tg.placebo_flags(i.articles(spark, sf), domain, i.LEXICON, ["month"]).groupBy("month").agg(
            F.count("*").alias("n"), F.count_if("is_placebo_cpu").alias("k")
        ).select(F.lit(domain).alias("domain"), "month", (F.col("k") / F.col("n")).alias("ratio"))
        rows = flagged if rows is None else rows.unionByName(flagged)
    value = ix.mean_100(F.col("ratio"), ["domain"], None, None)
    return rows.select("domain", "month", value.alias("value"))


PLACEBO = """shares AS (
  SELECT month, count(*) FILTER (WHERE uncertainty) / count(*) AS cpu,
         count(*) FILTER (WHERE trade AND policy AND uncertainty) / count(*) AS tpu,
         count(*) FILTER (WHERE monetary AND policy AND uncertainty) / count(*) AS mpu
  FROM hits GROUP BY month)"""


@query("placebo_panel", W(ART, TXT, HITS, PLACEBO) + f"""
SELECT month, {r('100 * cpu / avg(cpu) OVER ()')} AS cpu, {r('100 * tpu / avg(tpu) OVER ()')} AS tpu,
       {r('100 * mpu / avg(mpu) OVER ()')} AS mpu FROM shares""")
def _(spark, sf):
    wide = _placebo_series(spark, sf).groupBy("month").pivot("domain", ["trade", "monetary"]).agg(
        F.first("value")
    ).withColumnsRenamed({"trade": "tpu", "monetary": "mpu"})
    cpu = i.article_index(spark, sf).withColumnRenamed("value", "cpu")
    return rounded(cpu.join(wide, "month").select("month", "cpu", "tpu", "mpu"))


@query("placebo_correlation", W(ART, TXT, HITS, PLACEBO) + f"""
SELECT 'trade' AS domain, {r('corr(cpu, tpu)')} AS correlation, corr(cpu, tpu) < 0.7 AS passed FROM shares
UNION ALL
SELECT 'monetary', {r('corr(cpu, mpu)')}, corr(cpu, mpu) < 0.7 FROM shares""")
def _(spark, sf):
    from newsgauge.functions.stats import pearson

    joined = _placebo_series(spark, sf).join(
        i.article_index(spark, sf).withColumnRenamed("value", "cpu"), "month"
    )
    result = joined.groupBy("domain").agg(pearson(F.col("value"), F.col("cpu")).alias("correlation"))
    return rounded(result.withColumn("passed", F.col("correlation") < 0.7))


# --- collection progress and upserts -------------------------------------------------------------------


DONE = """done AS (
  SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS articles_fetched,
         count(*) FILTER (WHERE o_orderstatus = 'F') > count(*) FILTER (WHERE o_orderstatus = 'O') AS ok
  FROM orders GROUP BY 1)"""


def _progress(spark, sf):
    orders = i.table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    closed = F.count_if(F.expr("o_orderstatus = 'F'")) > F.count_if(F.expr("o_orderstatus = 'O'"))
    return orders.agg(
        F.count("*").alias("articles_fetched"),
        F.when(closed, F.max("o_orderdate").cast("timestamp")).alias("completed_at"),
    )


def _ship_calendar(spark, sf):
    return calendar_of(i.table(spark, sf, "lineitem"), "l_shipdate")


SHIP = """cal AS (
  SELECT strftime(unnest(generate_series(date_trunc('month', min(l_shipdate)), max(l_shipdate),
         INTERVAL 1 MONTH)), '%Y-%m') AS month FROM lineitem)"""


@query("completed_months", W(DONE) + "SELECT month, articles_fetched FROM done WHERE ok")
def _(spark, sf):
    return _progress(spark, sf).where("completed_at is not null").select("month", "articles_fetched")


@query("pending_months", W(DONE, SHIP) + """
SELECT month FROM cal WHERE month NOT IN (SELECT month FROM done WHERE ok)""")
def _(spark, sf):
    completed = _progress(spark, sf).where("completed_at is not null")
    return co.pending_months(_ship_calendar(spark, sf), completed)


@query("collection_status", W(DONE, SHIP) + f"""
SELECT count(*) AS total_months, count(d.month) AS completed_months,
       count(*) - count(d.month) AS pending_months, {r('count(d.month) / count(*)')} AS percent_complete,
       CAST(coalesce(sum(articles_fetched), 0) AS BIGINT) AS total_articles_collected
FROM cal LEFT JOIN (SELECT * FROM done WHERE ok) d ON cal.month = d.month""")
def _(spark, sf):
    return rounded(co.collection_status(_ship_calendar(spark, sf), _progress(spark, sf)))


def _order_counts(spark, sf):
    status = F.col("o_orderstatus")
    return i.table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("denominator"), F.count_if(status == "F").alias("numerator_cpu"),
        F.count_if(status == "O").alias("numerator_impl"), F.count_if(status == "P").alias("numerator_reversal"),
    )


ORDER_COUNTS = """oc AS (
  SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS denominator,
         count(*) FILTER (WHERE o_orderstatus = 'F') AS numerator_cpu,
         count(*) FILTER (WHERE o_orderstatus = 'O') AS numerator_impl,
         count(*) FILTER (WHERE o_orderstatus = 'P') AS numerator_reversal
  FROM orders GROUP BY 1)"""


@query("upsert_latest", W(i.COUNTS, ORDER_COUNTS) + """
SELECT * FROM oc UNION ALL SELECT * FROM mc WHERE month NOT IN (SELECT month FROM oc)""")
def _(spark, sf):
    return tb.upsert(i.counts(spark, sf), _order_counts(spark, sf), ["month"])


@query("counts_merge", W(i.COUNTS, ORDER_COUNTS) + """
SELECT * FROM mc UNION ALL SELECT * FROM oc WHERE month NOT IN (SELECT month FROM mc)""")
def _(spark, sf):
    return tb.merge_counts(i.counts(spark, sf), _order_counts(spark, sf))


@query("upsert_articles", W(ART) + """
SELECT id, title, CASE WHEN quality IS NULL THEN source ELSE 'relabelled' END AS source, date,
       CASE WHEN quality IS NULL THEN month ELSE '2030-01' END AS month
FROM articles LEFT JOIN labels ON id = doc_id""")
def _(spark, sf):
    from newsgauge.session import scratch_path

    articles = i.articles(spark, sf).drop("snippet")
    seen_again = articles.join(i.labels(spark, sf).select(F.col("article_id").alias("id")), "id", "left_semi")
    moved = seen_again.withColumns({"source": F.lit("relabelled"), "month": F.lit("2030-01")})
    path = scratch_path(spark, "articles")
    for number, batch in enumerate([articles, moved, moved]):
        tb.write_batch(batch, path, min(number, 1), ["month"])
    return tb.read_latest(spark, path, ["id"]).select("id", "title", "source", "date", "month")


@query("upsert_classifications", W(ART, TXT, HITS) + f"""
SELECT id AS article_id, {FLAG_SQL},
       {' AND '.join(f'NOT {c}' for c in FLAGS)} AS no_terms FROM hits""")
def _(spark, sf):
    rows = tb.classification_rows(tg.classify_articles(i.articles(spark, sf), i.LEXICON))
    merged = tb.upsert(rows.withColumn("has_uncertainty", F.lit(False)), rows, ["article_id"])
    return merged.withColumn("no_terms", F.col("matched_terms").isNull()).drop("matched_terms")


@query("upsert_labels", W(i.LABELS) + """
SELECT article_id, is_climate_policy, uncertainty_type, certainty_level FROM llm""")
def _(spark, sf):
    current = i.labels(spark, sf)
    stale = current.withColumns({"uncertainty_type": F.lit("none"), "certainty_level": F.lit(1)})
    return tb.upsert(stale, current, ["article_id"])


# --- samples and labels -------------------------------------------------------------------------------


HASHED = "md5('{seed}:' || CAST(id AS VARCHAR))"


@query("sample_random", W(ART) + f"SELECT id, source FROM articles ORDER BY {HASHED.format(seed=7)}, id LIMIT 100")
def _(spark, sf):
    return sm.sample_random(i.articles(spark, sf).select("id", "source"), 100, seed=7)


@query("unclassified_sample", W(ART) + f"""
SELECT id, source FROM articles WHERE id NOT IN (SELECT doc_id FROM labels)
ORDER BY {HASHED.format(seed=7)}, id LIMIT 100""")
def _(spark, sf):
    articles = i.articles(spark, sf).select("id", "source")
    return sm.unclassified_sample(articles, i.labels(spark, sf), 100, seed=7)


def _kinds(spark, sf):
    """Articles with a keyword category: implementation, reversal or none."""
    tagged = _classified(spark, sf, ["id", "source"])
    kind = F.when(F.col("has_reversal_terms") & F.col("has_uncertainty"), "reversal").when(
        F.col("has_implementation_terms") & F.col("has_uncertainty"), "implementation"
    ).otherwise("none")
    return tagged.select("id", "source", kind.alias("keyword_category"))


KINDS = """kinds AS (
  SELECT id, source, CASE WHEN reversal AND uncertainty THEN 'reversal'
         WHEN implementation AND uncertainty THEN 'implementation' ELSE 'none' END AS keyword_category
  FROM hits)"""


def stratified_sql(n: int, seed: int) -> str:
    return f"""ranked AS (
  SELECT id, keyword_category, {HASHED.format(seed=seed)} AS h,
         row_number() OVER (PARTITION BY keyword_category ORDER BY {HASHED.format(seed=seed)}, id) AS rk,
         count(*) OVER (PARTITION BY keyword_category) AS size, count(*) OVER () AS total FROM kinds),
tiers AS (
  SELECT id, keyword_category, h,
         CASE WHEN rk <= least(size, greatest(1, floor({n} * (size / total)))) THEN 0 ELSE 1 END AS tier
  FROM ranked),
strat AS (
  SELECT id FROM (SELECT id, row_number() OVER (ORDER BY tier,
         CASE WHEN tier = 0 THEN keyword_category END NULLS FIRST, h, id) AS place FROM tiers)
  WHERE place <= {n})"""


@query("sample_stratified", W(ART, TXT, HITS, KINDS, stratified_sql(150, 11)) + """
SELECT id, source, keyword_category FROM kinds WHERE id IN (SELECT id FROM strat)""")
def _(spark, sf):
    return sm.sample_stratified(_kinds(spark, sf), "keyword_category", 150, seed=11)


@query("sample_expand", W(ART, TXT, HITS, KINDS, stratified_sql(150, 11)) + f"""
SELECT id FROM strat UNION ALL
SELECT id FROM (SELECT id FROM kinds WHERE id NOT IN (SELECT id FROM strat)
                ORDER BY {HASHED.format(seed=12)}, id LIMIT 50)""")
def _(spark, sf):
    kinds = _kinds(spark, sf).select("id", "keyword_category")
    first = sm.sample_stratified(kinds, "keyword_category", 150, seed=11).select("id")
    return sm.sample_expand(kinds.select("id"), first, 50, seed=12)


@query("prompt_column", W(ART) + """
SELECT id, md5('T ' || coalesce(title, 'No title') || ' S ' || coalesce(source, 'Unknown') || ' D '
       || coalesce(CAST(date AS VARCHAR), 'Unknown') || ' C '
       || CASE WHEN length(snippet) > 3000 THEN left(snippet, 3000) || '...' ELSE snippet END) AS prompt_md5
FROM articles""")
def _(spark, sf):
    prompt = ag.prompt_column("T %s S %s D %s C %s", fixed.CONTENT_LIMIT)
    return i.articles(spark, sf).select("id", F.md5(prompt).alias("prompt_md5"))


def _answers(spark, sf):
    """Label answers as JSON; some lack fields, some are out of range, some are not JSON."""
    toxic, quality, doc = F.col("toxic"), F.col("quality"), F.col("doc_id")
    kind = F.when(toxic == 1, "reversal").when(quality == 0, "sideways").otherwise("implementation")
    full = F.to_json(F.struct(
        (quality == 1).alias("is_climate_policy"), kind.alias("uncertainty_type"),
        (doc % 7).cast("int").alias("certainty_level"), F.lit("seen").alias("reasoning"),
    ))
    answer = F.when(doc % 10 == 0, "{}").when(doc % 11 == 0, "no json").otherwise(full)
    return i.table(spark, sf, "labels").select(doc.alias("id"), answer.alias("answer"))


@query("llm_parse", """
WITH a AS (SELECT doc_id AS id, quality = 1 AS policy, doc_id % 7 AS lvl,
  CASE WHEN doc_id % 10 = 0 THEN 'empty' WHEN doc_id % 11 = 0 THEN 'bad' ELSE 'full' END AS form,
  CASE WHEN toxic = 1 THEN 'reversal' WHEN quality = 0 THEN 'sideways' ELSE 'implementation' END AS kind
  FROM labels),
e AS (SELECT *, CASE WHEN form = 'bad' THEN 'unreadable answer' WHEN form = 'empty' THEN NULL
  WHEN kind = 'sideways' THEN 'invalid uncertainty_type: sideways'
  WHEN lvl NOT BETWEEN 1 AND 5 THEN 'certainty_level must be 1-5, got: ' || lvl END AS error FROM a)
SELECT id, error,
  CASE WHEN error IS NULL THEN CASE form WHEN 'empty' THEN false ELSE policy END END AS is_climate_policy,
  CASE WHEN error IS NULL THEN CASE form WHEN 'empty' THEN 'none' ELSE kind END END AS uncertainty_type,
  CASE WHEN error IS NULL THEN CAST(CASE form WHEN 'empty' THEN 3 ELSE lvl END AS INTEGER) END AS certainty_level,
  CASE WHEN error IS NULL AND form = 'full' THEN 'seen' END AS reasoning FROM e""")
def _(spark, sf):
    return ag.parse_labels(_answers(spark, sf)).drop("answer")


@query("llm_stats", W(i.LABELS) + f"""
SELECT count(*) AS total_classified, count(*) FILTER (WHERE is_climate_policy) AS climate_policy_count,
       count(*) FILTER (WHERE uncertainty_type = 'reversal') AS reversal_count,
       count(*) FILTER (WHERE uncertainty_type = 'implementation') AS implementation_count,
       count(*) FILTER (WHERE uncertainty_type = 'none') AS no_uncertainty_count,
       {r('avg(certainty_level)')} AS avg_certainty FROM llm""")
def _(spark, sf):
    return rounded(ag.label_stats(i.labels(spark, sf)))


AGREE = f"""
SELECT {r('(p + t) / 2')} AS overall, {r('p')} AS climate_policy_accuracy, {r('t')} AS uncertainty_type_accuracy,
       n AS total_compared, {r('ai')} AS implementation_accuracy, {r('ar')} AS reversal_accuracy,
       {r('an')} AS none_accuracy FROM (
  SELECT avg(CAST(is_climate_policy AS INTEGER)) AS p, avg(CAST(same AS INTEGER)) AS t, count(*) AS n,
         avg(CAST(same AS INTEGER)) FILTER (WHERE keyword_category = 'implementation') AS ai,
         avg(CAST(same AS INTEGER)) FILTER (WHERE keyword_category = 'reversal') AS ar,
         avg(CAST(same AS INTEGER)) FILTER (WHERE keyword_category = 'none') AS an
  FROM (SELECT *, keyword_category = uncertainty_type AS same FROM kinds JOIN llm ON id = article_id))"""


@query("agreement_metrics", W(ART, TXT, HITS, KINDS, i.LABELS) + AGREE)
def _(spark, sf):
    keywords = ag.keyword_labels(_kinds(spark, sf))
    return rounded(ag.agreement_metrics(keywords, i.labels(spark, sf)))


N0, STEP = 60, 40
ADAPTIVE = W(ART, TXT, HITS, KINDS, i.LABELS, stratified_sql(N0, 5)) + f""",
later AS (SELECT id, row_number() OVER (ORDER BY {HASHED.format(seed=6)}, id) AS rk
          FROM kinds WHERE id NOT IN (SELECT id FROM strat)),
entered AS (SELECT id, 0 AS entered FROM strat
            UNION ALL SELECT id, CAST(ceil(rk / {STEP}) AS BIGINT) FROM later WHERE rk <= {3 * STEP}),
rounds AS (SELECT id, r.round FROM entered, (VALUES (0), (1), (2), (3)) r(round) WHERE r.round >= entered),
sizes AS (SELECT round, count(*) AS sample_size FROM rounds GROUP BY round),
cmp AS (SELECT round, is_climate_policy AS p, keyword_category AS k, keyword_category = uncertainty_type AS s
        FROM rounds JOIN kinds USING (id) JOIN llm ON id = article_id),
acc AS (SELECT round, avg(CAST(p AS INTEGER)) AS p, avg(CAST(s AS INTEGER)) AS t, count(*) AS n,
        avg(CAST(s AS INTEGER)) FILTER (WHERE k = 'implementation') AS ai,
        avg(CAST(s AS INTEGER)) FILTER (WHERE k = 'reversal') AS ar,
        avg(CAST(s AS INTEGER)) FILTER (WHERE k = 'none') AS an FROM cmp GROUP BY round),
res AS (SELECT CAST(round AS BIGINT) AS expansions, sample_size, coalesce((p + t) / 2, 0) AS overall,
        coalesce(p, 0) AS p, coalesce(t, 0) AS t, coalesce(n, 0) AS n, ai, ar, an
        FROM sizes LEFT JOIN acc USING (round)
        QUALIFY round = min(CASE WHEN coalesce((p + t) / 2, 0) >= 0.85 OR round = 3 THEN round END) OVER ())
"""


def _validated(spark, sf):
    return ag.adaptive_validation(
        _kinds(spark, sf), i.labels(spark, sf), n=N0, expansion=STEP, seed=5
    )


@query("adaptive_validation", ADAPTIVE + f"""
SELECT expansions, sample_size, {r('overall')} AS overall, {r('p')} AS climate_policy_accuracy,
       {r('t')} AS uncertainty_type_accuracy, n AS total_compared, {r('ai')} AS implementation_accuracy,
       {r('ar')} AS reversal_accuracy, {r('an')} AS none_accuracy FROM res""")
def _(spark, sf):
    return rounded(_validated(spark, sf))


@query("validation_report", ADAPTIVE + f"""
SELECT * FROM (SELECT overall >= 0.85 AS passed, {r('overall')} AS overall, sample_size, expansions,
  unnest(list_filter([
    CASE WHEN overall < 0.85 THEN 'overall agreement below target: review terms or enlarge the sample' END,
    CASE WHEN overall < 0.85 AND p < 0.85 THEN 'policy detection is low: refine the climate or policy terms' END,
    CASE WHEN overall < 0.85 AND t < 0.85
         THEN 'type agreement is low: refine the implementation or reversal terms' END,
    CASE WHEN overall >= 0.85 THEN 'agreement reaches the target' END], lambda x: x IS NOT NULL)) AS recommendation
  FROM res)""")
def _(spark, sf):
    return rounded(ag.validation_report(_validated(spark, sf)))


# --- de-duplication -------------------------------------------------------------------------------------


@query("dedup_exact", W(ART) + f"""
SELECT id, title, source, date, month FROM articles
QUALIFY row_number() OVER (PARTITION BY {i.norm('title')} ORDER BY date, id) = 1""")
def _(spark, sf):
    return dd.exact_dedup(i.articles(spark, sf).drop("snippet"))


@query("wire_duplicates", W(ART) + f"""
, t AS (SELECT *, {i.norm('title')} AS nt FROM articles)
SELECT id, title, source FROM t WHERE nt <> '' AND nt IN (
  SELECT nt FROM t GROUP BY nt HAVING count(DISTINCT lower(source)) > 1)""")
def _(spark, sf):
    return dd.wire_duplicates(i.articles(spark, sf)).select("id", "title", "source")


@query("dedup_fuzzy")
def _(spark, sf):
    return dd.fuzzy_dedup(i.articles(spark, sf).drop("snippet"))


# The SQL edit distance counts bytes, so letters beyond ASCII become capitals, which lower-cased titles lack.
LEV = f"""
, d AS (SELECT id, date, nt FROM (SELECT *, {i.norm('title')} AS nt FROM articles)
        QUALIFY row_number() OVER (PARTITION BY nt ORDER BY date, id) = 1),
letters AS (SELECT string_agg(c, '' ORDER BY c) AS cs
            FROM (SELECT DISTINCT unnest(string_split(nt, '')) AS c FROM d) WHERE strlen(c) > 1),
u AS (SELECT id, length(nt) AS n, row_number() OVER (ORDER BY date, id) AS k,
             translate(nt, coalesce(cs, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS x FROM d, letters),
c AS (SELECT a.k AS ak, b.k AS bk, a.x AS ax, b.x AS bx, a.n AS an, a.n - b.n AS d,
             CAST(floor(0.15 * a.n + 1e-9) AS BIGINT) AS e
      FROM u a JOIN u b ON (a.n > b.n OR a.n = b.n AND a.k > b.k) AND a.n - b.n <= floor(0.15 * a.n + 1e-9)),
-- with e edits one of e + 1 pieces stays whole, and edits before and behind it bound its place
s AS (SELECT * FROM c WHERE len(list_filter(range(0, e + 1), lambda i: contains(
        substring(bx, greatest(0, i * an // (e + 1) - i, i * an // (e + 1) - d - e + i) + 1,
          greatest(0, least(i * an // (e + 1) + i, i * an // (e + 1) - d + e - i)
            - greatest(0, i * an // (e + 1) - i, i * an // (e + 1) - d - e + i) + an // (e + 1))),
        substring(ax, i * an // (e + 1) + 1, an // (e + 1))))) > 0),
p AS (SELECT greatest(ak, bk) AS later, least(ak, bk) AS earlier FROM s WHERE levenshtein(ax, bx) <= e),
adj AS (SELECT later, list(earlier) AS near, row_number() OVER (ORDER BY later) AS step FROM p GROUP BY later),
g AS (SELECT CAST(0 AS BIGINT) AS step, CAST([] AS BIGINT[]) AS gone
      UNION ALL
      SELECT adj.step, CASE WHEN len(list_filter(near, lambda e: NOT list_contains(gone, e))) > 0
                       THEN list_append(gone, later) ELSE gone END
      FROM g JOIN adj ON adj.step = g.step + 1)
SELECT {ROWS} FROM articles WHERE id IN (
  SELECT id FROM u WHERE NOT list_contains((SELECT arg_max(gone, step) FROM g), k))"""


@query("dedup_fuzzy_lev", W(ART).replace("WITH", "WITH RECURSIVE", 1) + LEV)
def _(spark, sf):
    return dd.fuzzy_dedup(i.articles(spark, sf).drop("snippet"), measure="levenshtein")


@query("dedup_same_day")
def _(spark, sf):
    """All documents fall on 60 days, so that a source has many articles per day."""
    day = F.date_add(F.lit("2021-01-01").cast("date"), (F.col("id") % 60).cast("int"))
    return dd.same_day_dedup(i.articles(spark, sf).drop("snippet").withColumn("date", day))


@query("dedup_compare")
def _(spark, sf):
    return dd.compare_strategies(i.articles(spark, sf).drop("snippet"))


@query("title_similarity")
def _(spark, sf):
    titles = i.articles(spark, sf).select("id", "title")
    before = titles.select((F.col("id") + 1).alias("id"), F.col("title").alias("earlier"))
    pairs = titles.withColumnRenamed("title", "later").join(before, "id")
    return dd.title_similarity(pairs, "later", "earlier").select("id", "similarity")


# --- streaming -------------------------------------------------------------------------------------------


def _article_files(spark, sf, label):
    """The documents as timestamped article files below a new shared folder."""
    from newsgauge.session import scratch_path

    work = scratch_path(spark, label)
    rows = i.articles(spark, sf).withColumn("fetched_at", F.col("date").cast("timestamp"))
    rows.write.parquet(f"{work}/in")
    rows.where("source = 'src3'").write.mode("append").parquet(f"{work}/in")
    return work, rows.schema


@query("incremental_counts", W(ART, TXT, HITS) + """
SELECT month, count(*) AS total_articles, count(*) FILTER (WHERE uncertainty) AS cpu_count,
       count(*) FILTER (WHERE uncertainty AND reversal) AS cpu_reversal_count,
       count(*) FILTER (WHERE uncertainty AND implementation) AS cpu_impl_count,
       count(*) FILTER (WHERE uncertainty AND upside) AS cpu_upside_count,
       count(*) FILTER (WHERE regime_ira) AS regime_ira_count,
       count(*) FILTER (WHERE regime_obbba) AS regime_obbba_count FROM hits GROUP BY month""")
def _(spark, sf):
    from newsgauge.session import scratch_path
    from newsgauge.streaming import incremental as st

    # the newest articles first, then older ones, then one source again with old fetch times
    work = scratch_path(spark, "ingest")
    rows = i.articles(spark, sf).withColumn("fetched_at", F.col("date").cast("timestamp"))
    middle = F.lit("2023-01-01").cast("date")
    for wave in (rows.where(F.col("date") >= middle), rows.where(F.col("date") < middle),
                 rows.where("source = 'src3'").withColumn("fetched_at", F.lit("2020-01-01").cast("timestamp"))):
        wave.write.mode("append").parquet(f"{work}/in")
        counts = st.ingest_folder(spark, f"{work}/in", rows.schema, work, i.LEXICON)
    return counts


@query("counts_with_retractions", W(ART, TXT, HITS) + """
SELECT month, count(*) AS total_articles, count(*) FILTER (WHERE uncertainty) AS cpu_count,
       count(*) FILTER (WHERE uncertainty AND reversal) AS cpu_reversal_count,
       count(*) FILTER (WHERE uncertainty AND implementation) AS cpu_impl_count,
       count(*) FILTER (WHERE uncertainty AND upside) AS cpu_upside_count,
       count(*) FILTER (WHERE regime_ira) AS regime_ira_count,
       count(*) FILTER (WHERE regime_obbba) AS regime_obbba_count FROM hits GROUP BY month""")
def _(spark, sf):
    """Wrong months and texts come first for one source and are corrected by later files."""
    from newsgauge.session import scratch_path
    from newsgauge.streaming import incremental as st

    work = scratch_path(spark, "changes")
    rows = i.articles(spark, sf).withColumn("fetched_at", F.col("date").cast("timestamp"))
    source = rows.where("source = 'src3'")
    wrong = source.withColumns({"snippet": F.col("title"), "month": F.lit("2030-01")})
    for wave in (wrong, rows.where("source <> 'src3' or source is null"), source):
        wave.write.mode("append").parquet(f"{work}/in")
        counts = st.ingest_counted(spark, f"{work}/in", rows.schema, work, i.LEXICON)
    return counts


@query("stream_month_counts", W(ART) + """
SELECT month, count(*) + count(*) FILTER (WHERE source = 'src3') AS n FROM articles GROUP BY month""")
def _(spark, sf):
    from newsgauge.streaming import incremental as st

    work, schema = _article_files(spark, sf, "stream")
    articles = spark.readStream.schema(schema).parquet(f"{work}/in")
    st.stream_month_counts(articles, f"{work}/counts", f"{work}/progress")
    return tb.read_latest(spark, f"{work}/counts", ["month"])
