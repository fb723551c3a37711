"""CSV exports of finished indices; small monthly tables, ordered only here at the sink."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgauge.functions.stats import format_value
from newsgauge.operators.index import aggregate_rows
from newsgauge.operators.outlets import outlet_wide

INDEX_EXPORT = [
    "month", "index_type", "outlet", "denominator", "numerator", "raw_ratio", "normalized",
    "scaled", "dedup_strategy",
]


def export_index_rows(
    values: DataFrame, index_types: Sequence[str] | None = None, include_all: bool = False
) -> DataFrame:
    """Index table rows for export; by default only the pooled plain series."""
    rows = values if include_all else aggregate_rows(values)
    if index_types:
        rows = rows.where(F.col("index_type").isin(list(index_types)))
    return rows.select(*INDEX_EXPORT).orderBy("month", "index_type")


def _formatted(index: DataFrame, floats: Sequence[str], counts: Sequence[str]) -> DataFrame:
    return index.select(
        F.col("month").alias("date"),
        *[format_value(F.col(c).cast("double")).alias(c) for c in floats],
        *[format_value(F.col(c), integral=True).alias(c) for c in counts],
    ).orderBy("date")


def monthly_export(index: DataFrame) -> DataFrame:
    return _formatted(index, ["cpu"], ["denominator"])


def decomposition_export(index: DataFrame) -> DataFrame:
    return _formatted(index, ["cpu", "cpu_impl", "cpu_reversal"], ["denominator"])


def salience_export(index: DataFrame) -> DataFrame:
    return _formatted(index, [], ["salience_ira", "salience_obbba", "denominator"])


def outlet_export(series: DataFrame, outlets: Sequence[str] | None = None) -> DataFrame:
    """Months in rows and outlets in columns, blank where an outlet misses a month."""
    wide = outlet_wide(series, outlets)
    return wide.select(
        F.col("month").alias("date"),
        *[format_value(F.col(f"`{o}`")).alias(o) for o in wide.columns if o != "month"],
    ).orderBy("date")


def write_csv(df: DataFrame, path: str, one_file: bool = True) -> str:
    """Monthly tables fit one file; larger ones keep their partitions."""
    rows = df.coalesce(1) if one_file else df
    rows.write.mode("overwrite").option("header", True).csv(path)
    return path


def export_index(
    values: DataFrame, path: str, index_types: Sequence[str] | None = None,
    include_all: bool = False,
) -> int:
    """Write the index table; an empty selection is an error. Returns the number of rows."""
    rows = export_index_rows(values, index_types, include_all)
    count = rows.count()
    if count == 0:
        raise ValueError("no index values to export")
    write_csv(rows, path, one_file=not include_all)
    return count


def export_all(
    index: DataFrame, outlet_series: DataFrame, outlets: Sequence[str] | None, folder: str
) -> list[str]:
    tables = {
        "cpu_monthly": monthly_export(index),
        "cpu_decomposition": decomposition_export(index),
        "cpu_salience": salience_export(index),
        "cpu_robustness": outlet_export(outlet_series, outlets),
    }
    return [write_csv(df, os.path.join(folder, name)) for name, df in tables.items()]
