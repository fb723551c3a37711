"""Tables that take repeated batches: append-only batches on disk, last write wins on reading.

A batch lives in its own folder, so writing it again (after a lost executor or a restarted job)
replaces exactly that batch, and no job ever rewrites data that another one needs.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def latest(df: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The last row per key; one mergeable aggregate, no sort of a key's history."""
    kept = [c for c in df.columns if c not in key]
    rank = F.struct(*order)
    last = df.groupBy(*key).agg(F.max_by(F.struct(*kept), rank).alias("_row"))
    return last.select(*[F.col(c) if c in key else F.col("_row")[c].alias(c) for c in df.columns])


def upsert(current: DataFrame, batch: DataFrame, key: Sequence[str]) -> DataFrame:
    """Current rows with the batch's rows over them; the batch wins on equal keys."""
    both = current.withColumn("_version", F.lit(0)).unionByName(
        batch.withColumn("_version", F.lit(1)), allowMissingColumns=True
    )
    return latest(both, key, ["_version"]).drop("_version")


def merge_counts(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Both files sorted by month; the existing row wins on equal months."""
    return upsert(new, existing, ["month"]).orderBy("month")


def balanced(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Rows grouped by the folders they go to; AQE splits a hot folder and merges tiny ones."""
    return df.hint("rebalance", *partition_by) if partition_by else df


def write_batch(df: DataFrame, path: str, batch: int, partition_by: Sequence[str] = ()) -> None:
    """Write one batch; the same number again replaces it."""
    writer = balanced(df, partition_by).write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(os.path.join(path, f"batch={batch:010d}"))


def exists(spark: SparkSession, path: str) -> bool:
    """Does the folder exist, wherever its file system is?"""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def read_batches(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """All batches with their number as column ``batch``.

    With the rows' ``schema`` a table without rows can be read as well: a batch without rows leaves no file when it is
    partitioned, and before the first batch there is no folder.
    """
    if schema is None:
        return spark.read.parquet(path)
    full = T.StructType([f for f in schema if f.name != "batch"] + [T.StructField("batch", T.IntegerType())])
    return spark.read.schema(full).parquet(path) if exists(spark, path) else spark.createDataFrame([], full)


def read_latest(
    spark: SparkSession, path: str, key: Sequence[str], within: Sequence[str] = (),
    schema: T.StructType | None = None,
) -> DataFrame:
    """The table after all batches: the newest batch wins per key, inside a batch the last by ``within``."""
    return latest(read_batches(spark, path, schema), key, ["batch", *within]).drop("batch")


def compact(
    spark: SparkSession, path: str, target: str, key: Sequence[str],
    partition_by: Sequence[str] = (),
) -> None:
    """Write the resolved table as the first batch of a new one, so that later reads stay cheap."""
    write_batch(read_latest(spark, path, key), target, 0, partition_by)


def classification_rows(classified: DataFrame) -> DataFrame:
    """Classified articles in table layout: matched terms as JSON, NULL when nothing matched."""
    names = [f.name for f in classified.schema["matched_terms"].dataType.fields]
    hits = sum((F.size(F.col("matched_terms")[n]) for n in names[1:]),
               F.size(F.col("matched_terms")[names[0]]))
    return classified.withColumnRenamed("id", "article_id").withColumn(
        "matched_terms", F.when(hits > 0, F.to_json("matched_terms"))
    )


def append_raw_response(responses: DataFrame, path: str) -> None:
    """Audit log of raw answers: (month, query, response_json), appended by month."""
    rows = responses.select(
        F.sha2("query", 256).alias("query_hash"), "month", "response_json",
        F.current_timestamp().alias("fetched_at"),
    )
    balanced(rows, ["month"]).write.mode("append").partitionBy("month").parquet(path)
