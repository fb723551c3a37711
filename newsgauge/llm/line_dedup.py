"""Line de-duplication: repeated lines stay only in the last document that holds them.

A line's key is the line without white space at both ends, A-Z in lower case; keys are compared as two
64-bit hashes. The operator returns one compressed bitmap per changed document instead of text.

* Hashes are range-partitioned and sorted by (hash, document descending, position): a hash's lines lie side
  by side, the first document met is the one that keeps its lines, and a running rank tells the rest.
* Hot hashes, at least 1/HOT_SHARE of a sample of SAMPLE_LINES lines, never move: their first, last and
  some middle document are aggregated map-side, and those few figures (at most HOT_SHARE rows, a proven
  bound) are broadcast to the lines. Both ways give the same answer, so the sample only chooses the way.
* Dropped positions are folded to words of 64 bits map-side, then to one bitmap per document: entries
  (skip, keep), where skip counts whole words without a dropped line before the word keep. Words after the
  last entry are whole. Long documents cost a word per 64 lines only where lines go.

Defined cases: null and empty texts are one empty line; rows with a null id are no document: they count
nowhere and keep all lines; rows with the same id are one document; repeated rows get the same bitmap; an empty
table gives an empty result; other columns are ignored by line_bitmaps and kept by drop_lines, whose working names
are chosen so that they clash with none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsgauge.llm.words import ascii_lower, body
from newsgauge.session import cut_lineage

SPACES = " \t\n\x0b\x0c\r"
SAMPLE_LINES = 200_000
HOT_SHARE = 1_000
HOT_LEAST = 50


def line_key(line: Column) -> Column:
    """The stripped line in lower case; plain ASCII takes the faster function."""
    bare = F.btrim(line, F.lit(SPACES))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(ascii_lower(bare))


def keyed_lines(docs: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """(high, low, doc, body, pos) of every line whose key has ``least`` code points."""
    whole = body(text)
    lines = docs.where(F.col(key).isNotNull()).select(
        F.col(key).alias("doc"), F.xxhash64(whole).alias("body"),
        F.posexplode(F.split(whole, "\n", -1)).alias("pos", "line"))
    keyed = lines.select("doc", "body", "pos", line_key(F.col("line")).alias("key"))
    return keyed.where(F.char_length("key") >= least).select(
        F.xxhash64("key").alias("high"), F.xxhash64(F.lit(1), "key").alias("low"), "doc", "body", "pos")


def hot_hashes(lines: DataFrame) -> DataFrame:
    """(high, low) of hashes with a large share of a sample: at most HOT_SHARE rows."""
    step = max(1, lines.count() // SAMPLE_LINES)
    sample = lines.where(F.pmod(F.xxhash64("low", "doc", "pos"), F.lit(step)) == 0)
    least = max(HOT_LEAST, sample.count() // HOT_SHARE)
    return cut_lineage(sample.groupBy("high", "low").agg(F.count("*").alias("n"))
                       .where(F.col("n") >= least).select("high", "low"))


def dropped_cold(lines: DataFrame, documents: int) -> DataFrame:
    """(doc, body, pos) to drop, streamed over range-partitioned hashes."""
    ordered = lines.repartitionByRange("high", "low").sortWithinPartitions(
        "high", "low", F.desc("doc"), "pos")
    run = Window.partitionBy("high", "low").orderBy(F.desc("doc"))
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = ordered.withColumn("rank", F.dense_rank().over(run)) \
        .withColumn("documents", F.max("rank").over(whole))
    return ranked.where((F.col("rank") > 1) & (F.col("documents") >= documents)).select("doc", "body", "pos")


def dropped_hot(lines: DataFrame, documents: int) -> DataFrame:
    """(doc, body, pos) to drop among hot hashes: the lines stay where they are, figures per hash come to them.

    The largest, second largest, ... document of each hash is found by one aggregate each.
    """
    tops = lines.groupBy("high", "low").agg(F.max("doc").alias("last")).withColumn("reached", F.col("last"))
    tops = cut_lineage(tops)
    for _ in range(documents - 1):
        below = lines.join(F.broadcast(tops), ["high", "low"]).where(F.col("doc") < F.col("reached"))
        tops = cut_lineage(below.groupBy("high", "low").agg(
            F.first("last").alias("last"), F.max("doc").alias("reached")))
    # every row of tops is a hash with enough documents now
    return lines.join(F.broadcast(tops), ["high", "low"]).where(F.col("doc") < F.col("last")) \
        .select("doc", "body", "pos")


def line_bitmaps(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 20, documents: int = 3
) -> DataFrame:
    """(doc, body, n_dropped, bitmap) of every document that loses lines.

    ``body`` is the hash of the text, which tells rows with the same id apart. A key of at least
    ``least`` code points found in ``documents`` documents stays in the last of them only.
    """
    lines = cut_lineage(keyed_lines(docs, key, text, least))
    hot = F.broadcast(hot_hashes(lines))
    gone = dropped_cold(lines.join(hot, ["high", "low"], "left_anti"), documents).union(
        dropped_hot(lines.join(hot, ["high", "low"], "left_semi"), documents))
    words = gone.groupBy("doc", "body", F.expr("pos div 64").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(pos % 64 as int)))").alias("gone"))
    listed = words.groupBy("doc", "body").agg(
        F.sum(F.bit_count("gone")).alias("n_dropped"),
        F.sort_array(F.collect_list(F.struct("word", "gone"))).alias("listed"))
    entry = lambda w, i: F.struct(
        (w["word"] - F.when(i == 0, 0).otherwise(F.get("listed", i - 1)["word"] + 1)).cast("int").alias("skip"),
        F.bitwise_not(w["gone"]).alias("keep"))
    return listed.select("doc", "body", "n_dropped", F.transform("listed", entry).alias("bitmap"))


def words_of(bitmap: Column) -> Column:
    """The bitmap as plain 64-bit words, to the last entry."""
    return F.flatten(F.transform(bitmap, lambda e: F.concat(
        F.array_repeat(F.lit(-1).cast("long"), e["skip"]), F.array(e["keep"]))))


def kept_lines(text: Column, words: Column) -> Column:
    """The lines of a text whose bit is set, joined."""
    stays = lambda line, i: (F.shiftright(i, 6) >= F.size(words)) | (
        F.getbit(F.get(words, F.shiftright(i, 6)), i % 64) == 1)
    return F.array_join(F.filter(F.split(text, "\n", -1), stays), "\n")


def drop_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 20, documents: int = 3,
    out: tuple[str, str, str] = ("n_lines", "n_dropped", "kept"),
) -> DataFrame:
    """All rows and columns, with the number of lines, of dropped lines, and the text that stays.

    A column of the table that has one of the names in ``out`` is replaced.
    """
    maps = line_bitmaps(docs, key, text, least, documents)
    rows = docs.drop(*[c for c in out if c not in (key, text)])
    whole = body(text)
    held = rows.select(F.struct(*rows.columns).alias("row"), F.col(key).alias("doc"), whole.alias("whole"))
    joined = held.withColumn("body", F.xxhash64("whole")).join(maps, ["doc", "body"], "left").select(
        "row", "whole", "n_dropped", "bitmap", words_of(F.col("bitmap")).alias("words"))
    breaks = F.octet_length("whole") - F.octet_length(F.replace("whole", F.lit("\n"), F.lit("")))
    return joined.select("row", F.struct(
        (breaks + 1).cast("long").alias(out[0]), F.coalesce("n_dropped", F.lit(0)).cast("long").alias(out[1]),
        F.when(F.col("bitmap").isNull(), F.col("whole"))
        .otherwise(kept_lines(F.col("whole"), F.col("words"))).alias(out[2])).alias("found")
    ).select("row.*", "found.*")
