"""Readers for CSV exports and JSON search pages; all parse with explicit schemas."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsgauge import fixed_values as fixed
from newsgauge.functions.calendar import month_start
from newsgauge.operators.deals import derive_deal_columns, filter_deals, parse_amount
from newsgauge.schemas import SEARCH_PAGE

CSV_OPTIONS = {"quote": '"', "escape": '"'}

# Export column -> column of a deals table.
DEAL_NAMES = {
    "Deal ID": "deal_id", "Companies": "company", "Company ID": "company_id",
    "Deal Date": "deal_date", "Deal Size": "deal_size", "Deal Type": "deal_type",
    "Deal Status": "deal_status", "Primary Industry Sector": "sector",
}

JUDGED_NAMES = {
    "Company ID": "company_id", "Last Financing Date": "last_financing_date",
    "Total Raised": "total_raised", "IRA_Index": "ira_index",
    "judge_category": "judge_category", "ChatGPT_Category": "chatgpt_category",
    "Gemini_Category": "gemini_category", "DeepSeek_Category": "deepseek_category",
    "Semantic_Subtopic": "semantic_subtopic", "Stage": "stage",
}


def header_after_preamble(spark: SparkSession, path: str, marks: Sequence[str]) -> list[str]:
    """Column names of an export whose header follows some preamble lines.

    The header is the one line that names all marks; only that line reaches the driver.
    """
    line = F.col("value")
    found = spark.read.text(path).where(line.contains(marks[0]))
    for mark in marks[1:]:
        found = found.where(line.contains(mark))
    row = found.first()
    if row is None:
        raise ValueError(f"no header line with {list(marks)} in {path}")
    return next(csv.reader([row["value"]]))


def plain_name(name: str) -> str:
    return name.lower().replace(" ", "_").replace("/", "_")


def read_deals(
    spark: SparkSession, path: str, min_date: str = fixed.DEAL_MIN_DATE,
    deal_types: Sequence[str] | None = None, multi_line: bool = True,
) -> DataFrame:
    """Completed deals of a CSV export, typed and with derived columns.

    Preamble and header lines have no date in the date column, so they leave with the unreadable
    dates. Known columns that the export lacks are left out. Quoted line breaks belong to their record;
    each file is then read by one task, so large exports should come as several files, or with
    ``multi_line=False`` if their records are known to have no line breaks.
    """
    names = header_after_preamble(spark, path, ["Deal ID", "Deal Date", "Deal Type"])
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.schema(schema).options(
        header=False, multiLine=multi_line, **CSV_OPTIONS
    ).csv(path)
    kept = [n for n in fixed.DEAL_COLUMNS if n in names]
    rows = raw.select(*[
        F.col(f"`{n}`").alias(DEAL_NAMES.get(n, plain_name(n)))
        for n in kept
    ])
    typed = rows.withColumn("deal_date", _lenient_date("deal_date"))
    if "deal_size" in typed.columns:
        typed = typed.withColumn("deal_size", parse_amount(F.col("deal_size")))
    return derive_deal_columns(filter_deals(typed, min_date, deal_types))


def _lenient_date(column: str):
    """ISO or month/day/year dates; anything else is NULL."""
    return F.coalesce(
        F.col(column).try_cast("date"),
        F.try_to_timestamp(F.col(column), F.lit("M/d/yyyy")).cast("date"),
        F.try_to_timestamp(F.col(column), F.lit("dd-MMM-yyyy")).cast("date"),
    )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Index series with months as dates ('yyyy-MM' or 'yyyy-MM-dd' in the file)."""
    names = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([
        T.StructField(n, T.StringType() if n == "month" else T.DoubleType()) for n in names
    ])
    rows = spark.read.schema(schema).option("header", True).csv(path)
    month = F.substring("month", 1, 7)
    return rows.withColumn("month", F.to_date(F.concat(month, F.lit("-01"))))


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """A merged monthly panel whose first column is the month, under whatever name."""
    names = spark.read.option("header", True).csv(path).columns
    schema = T.StructType(
        [T.StructField("month", T.DateType())]
        + [T.StructField(n, T.DoubleType()) for n in names[1:]]
    )
    return spark.read.schema(schema).options(header=True, enforceSchema=True).csv(path)


def read_judged(spark: SparkSession, path: str) -> DataFrame:
    """Judged companies: all columns, amounts and scores coerced to numbers.

    Columns without a known name keep theirs, in lower case with underscores.
    """
    rows = spark.read.options(header=True, multiLine=True, **CSV_OPTIONS).csv(path)
    rows = rows.select(*[F.col(f"`{c}`").alias(JUDGED_NAMES.get(c, plain_name(c))) for c in rows.columns])
    date = _lenient_date("last_financing_date")
    return rows.withColumns({
        "last_financing_date": date,
        "month": month_start(date),
        "total_raised": F.col("total_raised").try_cast("double"),
        "ira_index": F.col("ira_index").try_cast("double"),
    })


def flatten_pages(pages: DataFrame, column: str = "response_json") -> DataFrame:
    """Article rows of JSON search pages; absent fields become empty strings."""
    page = F.from_json(column, SEARCH_PAGE)
    kept = [c for c in pages.columns if c != column]
    items = pages.select(*kept, F.explode(page["value"]).alias("a"))
    fields = {
        "id": "a.ResultId", "title": "a.Title", "date": "a.Date",
        "source": "a.Source.Name", "snippet": "a.Overview",
    }
    return items.select(*kept, *[
        F.coalesce(F.col(source), F.lit("")).alias(name) for name, source in fields.items()
    ])
