"""Conversations from quotations: who answered whom, told by the passages that replies quote.

A line's quote level is the number of ``>`` marks it starts with, blanks between them ignored. A passage is a run of non-blank lines of one
level; white space in it counts as single blanks, and two 64-bit hashes stand for it. Passages of
level 0 are a message's own words: of all messages with the same passage, the first one by (order, id)
is its original. Passages of higher level are quotations and are joined to originals; the nearest level
with an original earlier than the message decides, there the original with the most quoted characters, the
earlier on a tie. Those links form trees, which pointer doubling resolves in as many
rounds as the depth has binary digits. A conversation is a tree; its messages stand in order of
depth, order and id, each without its quotations.

Only hashes and ids are shuffled until the last join adds the bodies. A passage in very many messages
is one row after a partial aggregate, so frequent lines and first turns form no group; positions come
from one sort of all rows and the counts of its partitions, so a very large conversation is no window.

Defined cases: null text is empty; a message without a link is a conversation of its own; copies of an
original count as the first of them; messages with null id never link and share conversation null; rows
that repeat an id are one message in the links and all come back; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgauge.llm.words import body
from newsgauge.session import cut_lineage

MARKS = r"^(?=>)[>\x20]*"
PASSAGE, LEVEL = "\x01", "\x02"


def _levels(text: Column) -> Column:
    """Lines of a text as structs (level, line)."""
    lines = F.split(F.translate(text, PASSAGE + LEVEL + "\r", ""), "\n", -1)
    return F.transform(lines, lambda x: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), r"\x20", "")).alias("level"),
        F.regexp_replace(x, MARKS, "").alias("line"),
    ))


def own_words(lines: Column) -> Column:
    """The lines without quotations, blank ends removed."""
    return F.regexp_replace(F.array_join(F.transform(
        F.filter(lines, lambda x: x["level"] == 0), lambda x: x["line"]), "\n"), r"^\s+|\s+$", "")


def passages(lines: Column) -> Column:
    """Passages as structs (level, words)."""
    def marked(x: Column, i: Column) -> Column:
        before = F.get(lines, i - 1)
        new = (i == 0) | (before["level"] != x["level"]) | (F.trim(before["line"]) == "")
        head = F.concat(F.lit(PASSAGE), x["level"].cast("string"), F.lit(LEVEL))
        return F.concat(F.when(new, head).otherwise(F.lit(" ")), x["line"])

    # the first piece is what stands before the first passage: nothing
    cut = F.filter(F.split(F.array_join(F.transform(lines, marked), ""), PASSAGE), lambda p: p != "")
    parts = F.transform(cut, lambda p: F.struct(
        F.substring_index(p, LEVEL, 1).cast("int").alias("level"),
        F.trim(F.regexp_replace(F.substring_index(p, LEVEL, -1), r"\s+", " ")).alias("words"),
    ))
    return F.filter(parts, lambda p: p["words"] != "")


def link(messages: DataFrame, id_col: str, order_col: str, text_col: str) -> DataFrame:
    """(id, order, parent): one row per message id, parent null where none is found."""
    parsed = messages.select(
        F.col(id_col).alias("id"), F.col(order_col).alias("order"), _levels(body(text_col)).alias("lines"))
    found = parsed.where(F.col("id").isNotNull()).select(
        "id", "order", F.explode(passages(F.col("lines"))).alias("p")
    ).select("id", "order", F.col("p.level").alias("level"), F.length("p.words").alias("size"),
             F.xxhash64("p.words").alias("h1"), F.xxhash64(F.lit("second"), "p.words").alias("h2"))
    found = cut_lineage(found)
    originals = found.where("level = 0").groupBy("h1", "h2") \
        .agg(F.min(F.struct("order", "id")).alias("original"))
    me = F.struct("order", "id")
    votes = found.where("level > 0").join(originals, ["h1", "h2"]).where(F.col("original") < me) \
        .groupBy("id", "level", "original").agg(F.sum("size").alias("size"))
    best = votes.groupBy("id").agg(F.min_by(
        "original", F.struct("level", -F.col("size"), "original")).alias("original"))
    ids = messages.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")) \
        .agg(F.min(order_col).alias("order"))
    return ids.join(best, "id", "left").select("id", "order", F.col("original.id").alias("parent"))


def roots(links: DataFrame) -> DataFrame:
    """(id, order, parent, root, depth) by pointer doubling; finished rows leave the rounds."""
    links = cut_lineage(links)
    done = links.where("parent IS NULL").select(
        "id", "order", "parent", F.col("id").alias("root"), F.lit(0).alias("depth"))
    # to: the ancestor reached so far, which is ``depth`` steps up
    pending = links.where("parent IS NOT NULL").select(
        "id", "order", "parent", F.col("parent").alias("to"), F.lit(1).alias("depth"))
    open_ids = pending.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("depth").alias("more"))
    parts = [done]
    while True:
        stepped = cut_lineage(pending.join(open_ids, "to", "left"))
        parts.append(stepped.where("next IS NULL").select(
            "id", "order", "parent", F.col("to").alias("root"), "depth"))
        pending = stepped.where("next IS NOT NULL").select(
            "id", "order", "parent", F.col("next").alias("to"), (F.col("depth") + F.col("more")).alias("depth"))
        if pending.isEmpty():
            break
        open_ids = open_ids.alias("a").join(
            open_ids.select(F.col("to").alias("next"), F.col("next").alias("next2"),
                            F.col("more").alias("more2")), "next", "left") \
            .select("to", F.coalesce("next2", "next").alias("next"),
                    (F.col("more") + F.coalesce("more2", F.lit(0))).alias("more"))
        open_ids = cut_lineage(open_ids)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def conversations(messages: DataFrame, id_col: str = "message_id", order_col: str = "sent",
                  text_col: str = "text") -> DataFrame:
    """id_col, conversation (id of its first message), position (from 0), depth, parent, body."""
    placed = roots(link(messages, id_col, order_col, text_col))
    key = ["root", "depth", "order", "id"]
    sorted_rows = cut_lineage(placed.orderBy(*key)).withColumn("_n", F.monotonically_increasing_id())
    # the upper bits number the partition, the lower 33 the row in it
    part, row = F.shiftright("_n", 33), F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted_rows.groupBy(part.alias("p")).count().orderBy("p").collect()
    before, total = {}, 0
    for r in counts:
        before[r["p"]], total = total, total + r["count"]
    offsets = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before \
        else F.create_map(F.lit(0), F.lit(0))
    numbered = sorted_rows.withColumn("_n", F.try_element_at(offsets, part.cast("int")) + row) \
        if before else sorted_rows
    starts = numbered.groupBy("root").agg(F.min("_n").alias("_first"))
    thin = numbered.join(starts, "root").select(
        F.col("id").alias("_id"), F.col("root").alias("conversation"),
        (F.col("_n") - F.col("_first")).cast("long").alias("position"), "depth", "parent")
    bodies = messages.select(
        F.col(id_col).alias(id_col), own_words(_levels(body(text_col))).alias("body"))
    return bodies.join(thin, bodies[id_col] == thin["_id"], "left").drop("_id")
