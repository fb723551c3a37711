"""The given tables in the shapes the operators expect, as DataFrames and as SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgauge.functions.text import SPACE, normalize_term
from newsgauge.lexicon import Lexicon
from newsgauge.operators import deals as dl
from newsgauge.operators import index as ix
from newsgauge.session import spread

# Words that occur in the generated documents.
TERMS = {
    "climate": ["the", "in", "la"],
    "policy": ["of", "And", "on the"],
    "uncertainty": ["with", "From", "des"],
    "reversal": ["by", "to be"],
    "implementation": ["this", "are", "by the"],
    "upside": ["for", "BY-NC"],
    "regime_ira": ["with the", "un"],
    "regime_obbba": ["to be", "At"],
    "trade": ["was", "that the"],
    "monetary": ["or", "as"],
}
LEXICON = Lexicon(TERMS)
SOURCES = [f"src{i}" for i in range(20)]
CLASSIFIERS = {
    "judge_category": "Consensus",
    "chatgpt_category": "Classifier A",
    "gemini_category": "Classifier B",
    "deepseek_category": "Classifier C",
}
DEAL_TYPES = {
    "1-URGENT": "Seed Round",
    "2-HIGH": "Early Stage VC",
    "3-MEDIUM": "Later Stage VC",
    "4-NOT SPECIFIED": "Angel (individual)",
}
STATUS = {"F": "Completed", "O": "Pending"}
SECTOR_START = "1995-06-15"
ERA_START = "1998-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _choose(column: str, mapping: dict[str, str], default: str) -> Column:
    chosen = F.lit(default)
    for key, value in mapping.items():
        chosen = F.when(F.col(column) == key, value).otherwise(chosen)
    return chosen


def _case(column: str, mapping: dict[str, str], default: str) -> str:
    whens = " ".join(f"WHEN {column} = '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {whens} ELSE '{default}' END"


# --- articles and labels ---------------------------------------------------------------------


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.date_add(F.lit("2021-01-01").cast("date"), (F.col("doc_id") % 1460).cast("int"))
    return spread(table(spark, sf_dir, "documents"), "doc_id").select(
        F.col("doc_id").alias("id"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("text").alias("snippet"),
        "source",
        date.alias("date"),
        F.date_format(date, "yyyy-MM").alias("month"),
    )


ARTICLES = """articles AS (
  SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, text AS snippet, source,
         CAST(DATE '2021-01-01' + CAST(doc_id % 1460 AS INTEGER) AS DATE) AS date,
         strftime(DATE '2021-01-01' + CAST(doc_id % 1460 AS INTEGER), '%Y-%m') AS month
  FROM documents)"""


def norm(expression: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({expression}, '')), '{SPACE}', ' ', 'g'))"


TEXT = f"""texts AS (
  SELECT *, {norm("concat_ws(' ', coalesce(title, ''), coalesce(snippet, ''))")} AS txt
  FROM articles)"""


def term_sql(term: str, text: str = "txt") -> str:
    term = normalize_term(term)
    if " " in term:
        return f"contains({text}, '{term}')"
    edge = r"[^\p{L}\p{N}_]"
    return f"regexp_matches({text}, '(^|{edge}){re.escape(term)}($|{edge})')"


def any_sql(terms: list[str]) -> str:
    return "(" + " OR ".join(term_sql(t) for t in terms) + ")"


def matched_sql(terms: list[str]) -> str:
    items = ", ".join(f"CASE WHEN {term_sql(t)} THEN '{t}' END" for t in terms)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


HITS = "hits AS (SELECT id, source, date, month, " + ", ".join(
    f"{any_sql(terms)} AS {c}" for c, terms in TERMS.items()
) + " FROM texts)"

CLASS_COUNTS = """class_counts AS (
  SELECT month, count(*) AS total_articles,
         count(*) FILTER (WHERE uncertainty) AS uncertainty_count,
         count(*) FILTER (WHERE uncertainty AND reversal) AS reversal_uncertainty_count,
         count(*) FILTER (WHERE uncertainty AND implementation) AS implementation_uncertainty_count,
         count(*) FILTER (WHERE uncertainty AND upside) AS upside_uncertainty_count,
         count(*) FILTER (WHERE regime_ira) AS ira_count,
         count(*) FILTER (WHERE regime_obbba) AS obbba_count
  FROM hits GROUP BY month)"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("article_id"),
        (F.col("quality") == 1).alias("is_climate_policy"),
        F.when(F.col("toxic") == 1, "reversal")
        .when(F.col("quality") == 1, "implementation").otherwise("none")
        .alias("uncertainty_type"),
        (F.col("doc_id") % 5 + 1).cast("int").alias("certainty_level"),
    )


LABELS = """llm AS (
  SELECT doc_id AS article_id, quality = 1 AS is_climate_policy,
         CASE WHEN toxic = 1 THEN 'reversal' WHEN quality = 1 THEN 'implementation'
              ELSE 'none' END AS uncertainty_type,
         CAST(doc_id % 5 + 1 AS INTEGER) AS certainty_level
  FROM labels)"""


# --- monthly counts and index ------------------------------------------------------------------


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ship months of lineitem as monthly counts."""
    flag, status = F.col("l_returnflag") == "R", F.col("l_linestatus")
    return table(spark, sf_dir, "lineitem").groupBy(
        F.date_format("l_shipdate", "yyyy-MM").alias("month")
    ).agg(
        F.count("*").alias("denominator"),
        F.count_if(flag).alias("numerator_cpu"),
        F.count_if(flag & (status == "O")).alias("numerator_impl"),
        F.count_if(flag & (status == "F")).alias("numerator_reversal"),
    )


COUNTS = """mc AS (
  SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS denominator,
         count(*) FILTER (WHERE l_returnflag = 'R') AS numerator_cpu,
         count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'O') AS numerator_impl,
         count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'F') AS numerator_reversal
  FROM lineitem GROUP BY 1)"""


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = ix.raw_index_values(ix.counts_to_raw(counts(spark, sf_dir)))
    return ix.normalize_index(raw)


def index_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.index_values(normalized(spark, sf_dir))


INDEX_TABLE = """cells AS (
  SELECT month, denominator,
         unnest(['CPU', 'CPU_impl', 'CPU_reversal', 'salience_ira', 'salience_obbba']) AS index_type,
         unnest([numerator_cpu, numerator_impl, numerator_reversal, 0, 0]) AS numerator
  FROM mc WHERE denominator > 0),
idx AS (
  SELECT month, index_type, '' AS outlet, denominator, numerator,
         numerator / denominator AS raw_ratio,
         CASE WHEN avg(numerator / denominator) OVER w > 0
              THEN (numerator / denominator) / avg(numerator / denominator) OVER w * 100
              ELSE 0.0 END AS normalized,
         false AS scaled, 'none' AS dedup_strategy
  FROM cells WINDOW w AS (PARTITION BY index_type))"""

FULL_INDEX = """full_idx AS (
  SELECT month, max(normalized) FILTER (WHERE index_type = 'CPU') AS cpu,
         max(normalized) FILTER (WHERE index_type = 'CPU_impl') AS cpu_impl,
         max(normalized) FILTER (WHERE index_type = 'CPU_reversal') AS cpu_reversal,
         max(numerator) FILTER (WHERE index_type = 'salience_ira') AS salience_ira,
         max(numerator) FILTER (WHERE index_type = 'salience_obbba') AS salience_obbba,
         max(denominator) AS denominator
  FROM idx GROUP BY month)"""


def index_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts-file index with months as dates."""
    return ix.counts_index(counts(spark, sf_dir)).select(
        F.to_date(F.concat("month", F.lit("-01"))).alias("month"),
        "cpu_index", "cpu_impl", "cpu_reversal",
    )


INDEX_SERIES = """ser AS (
  SELECT CAST(month || '-01' AS DATE) AS month,
         (numerator_cpu / denominator) / avg(numerator_cpu / denominator) OVER () * 100 AS cpu_index,
         (numerator_impl / denominator) / avg(numerator_impl / denominator) OVER () * 100 AS cpu_impl,
         (numerator_reversal / denominator) / avg(numerator_reversal / denominator) OVER () * 100
           AS cpu_reversal
  FROM mc)"""


def article_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(month, value) of the main index over the tagged documents."""
    from newsgauge.plans.reports import article_index as plan

    return plan(articles(spark, sf_dir), LEXICON).where("index_type = 'CPU'").select(
        "month", F.col("normalized").alias("value")
    )


ARTICLE_INDEX = """art_idx AS (
  SELECT month, (uncertainty_count / total_articles)
         / avg(uncertainty_count / total_articles) OVER () * 100 AS value
  FROM class_counts)"""


def outlet_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ship months of lineitem per supplier nation; summed per supplier before the joins."""
    per_supplier = table(spark, sf_dir, "lineitem").groupBy(
        "l_suppkey", F.date_format("l_shipdate", "yyyy-MM").alias("month")
    ).agg(
        F.count("*").alias("denominator"),
        F.count_if(F.col("l_returnflag") == "R").alias("numerator"),
    )
    supplier = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey")
    )
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("outlet"))
    return (
        per_supplier.join(supplier, "l_suppkey").join(nation, "n_nationkey")
        .groupBy("outlet", "month")
        .agg(F.sum("numerator").alias("numerator"), F.sum("denominator").alias("denominator"))
    )


OUTLETS = """panel AS (
  SELECT n_name AS outlet, strftime(l_shipdate, '%Y-%m') AS month,
         count(*) FILTER (WHERE l_returnflag = 'R') AS numerator, count(*) AS denominator
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY 1, 2)"""


# --- deals and judged companies -----------------------------------------------------------------


def raw_deals(spark: SparkSession, sf_dir: str, with_sector: bool = True) -> DataFrame:
    deals = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("deal_id"),
        F.col("o_custkey").alias("company_id"),
        F.col("o_orderdate").cast("date").alias("deal_date"),
        F.col("o_totalprice").alias("deal_size"),
        _choose("o_orderpriority", DEAL_TYPES, "Grant").alias("deal_type"),
        _choose("o_orderstatus", STATUS, "In Progress").alias("deal_status"),
    )
    if not with_sector:
        return deals
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("company_id"), F.col("c_mktsegment").alias("sector")
    )
    return deals.join(customers, "company_id", "left")


def deals(spark: SparkSession, sf_dir: str, with_sector: bool = False) -> DataFrame:
    raw = raw_deals(spark, sf_dir, with_sector)
    return dl.derive_deal_columns(dl.filter_deals(raw, "1995-02-10"))


RAW_DEALS = f"""raw_deals AS (
  SELECT o_orderkey AS deal_id, o_custkey AS company_id, CAST(o_orderdate AS DATE) AS deal_date,
         o_totalprice AS deal_size, {_case("o_orderpriority", DEAL_TYPES, "Grant")} AS deal_type,
         {_case("o_orderstatus", STATUS, "In Progress")} AS deal_status, c_mktsegment AS sector
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""

DEALS = RAW_DEALS + """,
deals AS (
  SELECT *, CAST(year(deal_date) AS INTEGER) AS year, CAST(month(deal_date) AS INTEGER) AS month_number,
         CAST(date_trunc('month', deal_date) AS DATE) AS month,
         CASE WHEN deal_type IN ('Seed Round', 'Angel (individual)') THEN 'Seed'
              WHEN deal_type = 'Early Stage VC' THEN 'Early'
              WHEN deal_type = 'Later Stage VC' THEN 'Late' END AS stage
  FROM raw_deals
  WHERE deal_date >= DATE '1995-02-10' AND deal_status = 'Completed'
    AND deal_type IN ('Seed Round', 'Early Stage VC', 'Later Stage VC', 'Angel (individual)'))"""

MONTHLY = DEALS + """,
monthly_present AS (
  SELECT month, count(deal_id) AS deal_count, coalesce(sum(deal_size), 0) AS total_amount,
         median(deal_size) AS median_amount, avg(deal_size) AS mean_amount,
         count(deal_size) AS deals_with_size,
         count(*) FILTER (WHERE stage = 'Seed') AS seed_count,
         count(*) FILTER (WHERE stage = 'Early') AS early_count,
         count(*) FILTER (WHERE stage = 'Late') AS late_count,
         100.0 * count(deal_size) / count(deal_id) AS size_coverage_pct
  FROM deals GROUP BY month),
cal AS (
  SELECT CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month
  FROM monthly_present),
vm AS (
  SELECT cal.month, coalesce(deal_count, 0) AS deal_count, coalesce(total_amount, 0) AS total_amount,
         CASE WHEN p.month IS NULL THEN 0 ELSE median_amount END AS median_amount,
         CASE WHEN p.month IS NULL THEN 0 ELSE mean_amount END AS mean_amount,
         coalesce(deals_with_size, 0) AS deals_with_size, coalesce(seed_count, 0) AS seed_count,
         coalesce(early_count, 0) AS early_count, coalesce(late_count, 0) AS late_count,
         coalesce(size_coverage_pct, 0) AS size_coverage_pct
  FROM cal LEFT JOIN monthly_present p ON cal.month = p.month)"""

PANEL = MONTHLY + ",\n" + COUNTS + ",\n" + INDEX_SERIES + """,
merged AS (SELECT vm.*, cpu_index, cpu_impl, cpu_reversal FROM vm JOIN ser USING (month))"""


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly activity next to the index series."""
    from newsgauge.plans.reports import deals_panel

    return deals_panel(deals(spark, sf_dir), index_series(spark, sf_dir), median=False)


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment")
    )
    segment = F.col("segment")
    urgent, partial = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus") == "P"
    rows = table(spark, sf_dir, "orders").join(customers, "o_custkey", "left")
    date = F.col("o_orderdate").cast("date")
    return rows.select(
        F.col("o_custkey").alias("company_id"),
        date.alias("last_financing_date"),
        F.trunc(date, "MM").alias("month"),
        F.col("o_totalprice").alias("total_raised"),
        segment.alias("judge_category"),
        F.when(urgent & (segment == "MACHINERY"), "BUILDING").otherwise(segment).alias("chatgpt_category"),
        F.when(~partial, segment).alias("gemini_category"),
        F.when(partial, "Others").otherwise(segment).alias("deepseek_category"),
        F.col("o_orderpriority").alias("semantic_subtopic"),
        (F.col("o_custkey") % 7 + 1).cast("double").alias("ira_index"),
    )


COMPANIES = """companies AS (
  SELECT o_custkey AS company_id, CAST(o_orderdate AS DATE) AS last_financing_date,
         CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_totalprice AS total_raised,
         c_mktsegment AS judge_category,
         CASE WHEN o_orderpriority = '1-URGENT' AND c_mktsegment = 'MACHINERY' THEN 'BUILDING'
              ELSE c_mktsegment END AS chatgpt_category,
         CASE WHEN o_orderstatus <> 'P' THEN c_mktsegment END AS gemini_category,
         CASE WHEN o_orderstatus = 'P' THEN 'Others' ELSE c_mktsegment END AS deepseek_category,
         o_orderpriority AS semantic_subtopic,
         CAST(o_custkey % 7 + 1 AS DOUBLE) AS ira_index
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
