"""Incremental ingest of articles: new files, tagged and appended; an id counts once when read."""

from __future__ import annotations

import os
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsgauge.lexicon import DEFAULT_LEXICON, FLAGS, Lexicon
from newsgauge.operators.tagging import classify_articles, index_counts, index_flags
from newsgauge.sources.tables import read_batches, read_latest, write_batch


def article_stream(
    spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None,
) -> DataFrame:
    """New article files, every row of them.

    Nothing is dropped on arrival, however late: an id that comes again is resolved when the table is
    read, where the newest row wins. So no state is kept and no delay has to be guessed.
    """
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def tagged(articles: DataFrame, lexicon: Lexicon) -> DataFrame:
    """What the ingest keeps of an article."""
    return classify_articles(
        articles, lexicon, include_matched_terms=False, keep=["id", "month", "source", "fetched_at"])


def run_ingest(
    articles: DataFrame, table: str, checkpoint: str, lexicon: Lexicon = DEFAULT_LEXICON
) -> None:
    """Process everything available: tag each micro-batch and write it as one replaceable batch."""
    def save(batch: DataFrame, number: int) -> None:
        write_batch(tagged(batch, lexicon), table, number, ["month"])

    query = (
        articles.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def counts_of_table(
    spark: SparkSession, table: str, schema: T.StructType, lexicon: Lexicon = DEFAULT_LEXICON
) -> DataFrame:
    """Monthly index counts of everything ingested so far, each id in its newest form.

    ``schema`` is that of the articles; a table without any row has no counts.
    """
    rows = tagged(spark.createDataFrame([], schema), lexicon).schema
    return index_counts(read_latest(spark, table, ["id"], ["fetched_at"], rows), ["month"])


CHANGES = "month string, flags int, n bigint"


STATE = "id string, month string, flags int, old_month string, old_flags int, known boolean"


def _state_changes(rows: DataFrame, earlier: DataFrame) -> DataFrame:
    """One row per id whose month or flags differ from its state after all earlier batches: the new ones and the old ones.

    ``rows``: (id, month, fetched_at, flags); the newest row of an id counts, ties by month and flags.
    """
    now = rows.groupBy("id").agg(F.max(F.struct("fetched_at", "month", "flags")).alias("_now")).select(
        "id", "_now.month", "_now.flags")
    before = earlier.groupBy(F.col("id").alias("_id")).agg(
        F.max_by(F.struct(F.col("month").alias("old_month"), F.col("flags").alias("old_flags")), "batch").alias("_old"))
    both = now.join(before, F.col("id").eqNullSafe(F.col("_id")), "left").select(
        "id", "month", "flags", "_old.old_month", "_old.old_flags", F.col("_old").isNotNull().alias("known"))
    same = F.col("month").eqNullSafe(F.col("old_month")) & F.col("flags").eqNullSafe(F.col("old_flags"))
    return both.where(~(F.col("known") & same))


def run_counted_ingest(
    articles: DataFrame, table: str, checkpoint: str, lexicon: Lexicon = DEFAULT_LEXICON
) -> None:
    """Keep monthly counts up from changes alone.

    The state of an id is its month and flags, kept as a table beside ``table``: a micro-batch appends the ids it changed and joins
    its rows with the narrow rows of earlier batches; no text is read again, and nothing is kept in memory between batches. Each writes
    its changes, summed by month and flags, as one replaceable batch: when a run breaks off between that and its commit,
    the same input meets the same state again and replaces both batches.
    """
    names = list(FLAGS.values())
    bits = sum((F.col(f).cast("int") * (1 << n) for n, f in enumerate(names)), F.lit(0))
    rows = tagged(articles, lexicon).select("id", "month", "fetched_at", bits.alias("flags"))
    state = f"{table}-state"
    kept = T.StructType([rows.schema["id"], *T.StructType.fromDDL(STATE).fields[1:]])

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        earlier = read_batches(spark, state, kept).where(F.col("batch") < number).select("id", "month", "flags", "batch")
        write_batch(_state_changes(batch, earlier), state, number)
        changed = read_batches(spark, state, kept).where(F.col("batch") == number)
        changes = changed.select(F.inline(F.filter(F.array(
            F.struct("month", "flags", F.lit(1).alias("n"), F.lit(True).alias("real")),
            F.struct(F.col("old_month").alias("month"), F.col("old_flags").alias("flags"), F.lit(-1).alias("n"),
                     F.col("known").alias("real"))), lambda c: c["real"])))
        write_batch(changes.groupBy("month", "flags").agg(F.sum("n").alias("n")), table, number)

    query = (
        rows.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def counts_of_changes(spark: SparkSession, table: str) -> DataFrame:
    """Monthly index counts from all changes so far: at most months times flag sets rows per batch are read."""
    sums = read_batches(spark, table, T.StructType.fromDDL(CHANGES)).groupBy("month", "flags").agg(
        F.sum("n").alias("n")).where("n > 0")
    flags = sums.select("month", "n", *[
        (F.col("flags").bitwiseAND(F.lit(1 << n)) != 0).alias(f) for n, f in enumerate(FLAGS.values())])
    names = ("cpu", "cpu_reversal", "cpu_impl", "cpu_upside", "regime_ira", "regime_obbba")
    return index_flags(flags).groupBy("month").agg(F.sum("n").alias("total_articles"), *[
        F.sum(F.when(F.col(f"is_{name}"), F.col("n")).otherwise(F.lit(0))).alias(f"{name}_count") for name in names])


def ingest_counted(
    spark: SparkSession, source: str, schema: T.StructType, work: str,
    lexicon: Lexicon = DEFAULT_LEXICON, max_files: int | None = None,
) -> DataFrame:
    """Ingest a folder of article files by changes and return the monthly counts; safe to run again."""
    table = os.path.join(work, "changes")
    run_counted_ingest(
        article_stream(spark, source, schema, max_files=max_files), table,
        os.path.join(work, "progress-changes"), lexicon,
    )
    return counts_of_changes(spark, table)


def stream_month_counts(articles: DataFrame, table: str, checkpoint: str) -> None:
    """Running article counts per event-time month; every trigger writes the months it changed."""
    counts = articles.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("n")
    )
    query = (
        counts.writeStream.outputMode("update")
        .foreachBatch(lambda batch, number: write_batch(batch, table, number))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def ingest_folder(
    spark: SparkSession, source: str, schema: T.StructType, work: str,
    lexicon: Lexicon = DEFAULT_LEXICON, max_files: int | None = None,
) -> DataFrame:
    """Ingest a folder of article files and return the monthly counts; safe to run again."""
    table = os.path.join(work, "tagged")
    run_ingest(
        article_stream(spark, source, schema, max_files=max_files), table,
        os.path.join(work, "progress"), lexicon,
    )
    return counts_of_table(spark, table, schema, lexicon)
