"""Join of documents by the Jaccard similarity of their word n-grams, with set-relation skipping.

A document's set holds the 64-bit hashes of its distinct shingles (a text of fewer words is one shingle).
Equal sets are one node. All steps are exact for these sets:

* Stars. Nodes that share two of their smallest hashes meet the smallest node of that key, their pivot;
  a node within RADIUS of a pivot becomes its satellite. A large group costs one comparison each.
* Index lists. A node's prefix in one global order (rare hashes first, then by hash) must share a hash with
  any partner's prefix. Lists by hash hold one entry per star, pre-aggregated before the shuffle.
  Inside a list, entries are sorted by size: whole blocks are skipped when sizes are too far apart, when the
  positions leave too little for the needed overlap, or when the hash before is shared too.
* Galaxies. Distances obey the triangle inequality: members of two stars that meet can only be linked if
  their pivots' distance is at most the limit plus both radii. Stars that near form a galaxy, and one of
  the pivots becomes its root; no link leaves a galaxy.
* Answers derived from the root's. A member keeps only its difference from the root's set, and from that its
  difference from what is usual in the galaxy: its own edits. Two members differ by the difference of their
  differences, so they meet on those short sets, by a prefix of their rarest hashes. They meet representatives first, a
  row per edit; only hashes that still lead to unlinked members are then joined. Components need no more links.

Hashes in more than LIST_ROWS lists' entries go to the end of the order; their number is kept
under FREQUENT_HASHES by raising that figure, which changes the order only, not the result.

Defined cases: null text and text without words have an empty set and link with nothing; rows with a null
id get their group's component, null only if no member has an id; rows that repeat an id or a text are kept;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsgauge.llm.components import components, cut_lineage
from newsgauge.llm.words import ascii_lower, body, unused, words
from newsgauge.session import cut_and_count

LIST_ROWS = 16
FREQUENT_HASHES = 1_000_000
STAR_KEYS = 6
# Largest distance of a satellite. Any figure is exact, as pivots are compared with their stars' true radii; a wide
# one takes in groups whose members lie around the limit from each other.
RADIUS = 0.4
BROADCAST_ROWS = 1_000_000
# Rows whose sketches a Python worker looks at together; the arrays it makes of them are a dozen times as large.
BATCH_ROWS = 512
SLACK = 1e-9


@dataclass(frozen=True)
class Limit:
    """Sets link when den * intersection >= num * union; shingles have ``size`` words."""
    size: int = 3
    num: int = 90
    den: int = 100

    @property
    def distance(self) -> float:
        return 1 - self.num / self.den

    def prefix(self, n):
        """Leading hashes of which one is shared with every partner."""
        return n - (self.num * n + self.den - 1) // self.den + 1

    def index(self, n):
        """The same, against partners of at least the same size."""
        both = self.num + self.den
        return n - (2 * self.num * n + both - 1) // both + 1

    def overlap(self, total):
        """Least intersection of two sets whose sizes have this sum."""
        return (self.num * total + self.num + self.den - 1) // (self.num + self.den)


def shingles(text: Column, size: int, docs: DataFrame) -> DataFrame:
    """docs with n and hashes (ascending, distinct) of a text column."""
    split = docs.withColumn("_words", F.transform(words(ascii_lower(text)), lambda w: F.xxhash64(w)))
    runs = F.transform(
        F.slice("_words", 1, F.greatest(F.size("_words") - (size - 1), F.lit(0))),
        lambda w, i: F.xxhash64(w, *[F.get("_words", i + k) for k in range(1, size)]),
    )
    few = F.when(F.size("_words") == 0, F.array().cast("array<bigint>")) \
        .otherwise(F.array(F.xxhash64("_words")))
    return split.withColumn("hashes", F.sort_array(F.array_distinct(
        F.when(F.size("_words") >= size, runs).otherwise(few)))) \
        .withColumn("n", F.size("hashes")).drop("_words")


def _sql(limit: Limit, what: str, n: str) -> str:
    if what == "prefix":
        return f"({n} - int(ceil({limit.num}L * {n} / {limit.den}.0D - 1e-9)) + 1)"
    both = limit.num + limit.den
    return f"({n} - int(ceil({2 * limit.num}L * {n} / {both}.0D - 1e-9)) + 1)"


def base_rows(docs: DataFrame, limit: Limit, id_col: str, text_col: str) -> DataFrame:
    """(row, id, n, node, text_hash, sketch): sketch holds the leading hashes, more than a prefix."""
    rows = docs.select(F.col(id_col).alias("id"), body(text_col).alias("_text"))
    found = shingles(F.col("_text"), limit.size, rows)
    prefix = _sql(limit, "prefix", "n")
    return found.select(
        F.monotonically_increasing_id().alias("row"), "id", "n", F.xxhash64("hashes").alias("node"),
        F.xxhash64("_text").alias("text_hash"),
        F.expr(f"slice(hashes, 1, {prefix} + {prefix} div 2 + 8)").alias("sketch"))


def sized(rows: DataFrame) -> DataFrame:
    """Rows written once, to be broadcast only if they are at most BROADCAST_ROWS; else Spark shuffles."""
    rows, number = cut_and_count(rows)
    return F.broadcast(rows) if number <= BROADCAST_ROWS else rows.hint("merge")


def one_row_per_set(base: DataFrame) -> DataFrame:
    """base without the rows whose set an earlier row has, and without empty sets.

    Only (row, node) is shuffled; a set in very many rows is a minimum.
    """
    thin = base.where("n > 0").select("row", "node")
    first = thin.groupBy("node").agg(F.min("row").alias("first"), F.count("*").alias("rows")).where("rows > 1")
    later = thin.join(first, "node").where("row <> first").select("row")
    return base.where("n > 0").join(sized(later), "row", "left_anti")


def full_sets(docs: DataFrame, nodes: DataFrame, limit: Limit, text_col: str) -> DataFrame:
    """(node, n, hashes) of the nodes (node, text_hash), one row each, from the texts."""
    texts = docs.select(body(text_col).alias("_text")).withColumn("text_hash", F.xxhash64("_text")) \
        .join(sized(nodes.select("text_hash").distinct()), "text_hash", "left_semi")
    found = shingles(F.col("_text"), limit.size, texts)
    return found.select(F.xxhash64("hashes").alias("node"), "n", "hashes").dropDuplicates(["node"])


def plausible(pairs: DataFrame, nodes: DataFrame, limit: Limit) -> DataFrame:
    """Pairs of pivots (a, b, reach) whose sketches leave a distance of at most reach possible.

    reach is the limit plus both radii. Up to the smaller of the last hashes both sketches are complete, so
    what they don't share there differs in the sets.
    """
    wanted = sized(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    radius = sized(nodes.where("far > 0").groupBy(F.col("star").alias("node")).agg(F.max("far").alias("radius")))
    known = nodes.join(wanted, "node", "left_semi").join(radius, "node", "left") \
        .select("node", "n", "sketch", F.coalesce("radius", F.lit(0.0)).alias("radius"))
    side = lambda x: known.select(
        F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"),
        F.col("radius").alias(f"r{x}"))
    last = lambda x: F.when(F.size(f"s{x}") < F.col(f"n{x}"), F.element_at(f"s{x}", -1))
    met = pairs.join(side("a"), "a").join(side("b"), "b") \
        .withColumn("_end", F.coalesce(F.least(last("a"), last("b")), F.lit(2**63 - 1))) \
        .withColumn("reach", F.col("ra") + F.col("rb") + (limit.distance + SLACK))
    within = lambda x: F.size(F.filter(f"s{x}", lambda h: h <= F.col("_end")))
    differ = within("a") + within("b") - 2 * F.size(F.array_intersect("sa", "sb"))
    most = (F.col("na") + F.col("nb")) * F.col("reach") / (2 - F.col("reach"))
    return met.where(differ <= most + SLACK).select("a", "b", "reach")


def compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b, ..) with na, nb and the exact intersection."""
    one = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("hashes").alias("ha"))
    two = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("hashes").alias("hb"))
    return pairs.join(one, "a").join(two, "b").withColumn(
        "common", F.size(F.array_intersect("ha", "hb"))).drop("ha", "hb")


DISTANCE = "1 - common / double(na + nb - common)"


def stars(nodes: DataFrame, docs: DataFrame, limit: Limit, text_col: str) -> DataFrame:
    """Nodes with star (its head), far (the distance from it) and large (the star has other members)."""
    keys = F.array(*[
        F.struct(F.get("sketch", 2 * k).alias("x"), F.get("sketch", 2 * k + 1).alias("y"))
        for k in range(STAR_KEYS)
    ])
    keyed = nodes.select("node", "n", "text_hash", F.explode(keys).alias("k")).where("k.y IS NOT NULL") \
        .select("node", "n", "text_hash", "k.x", "k.y")
    pivots = keyed.groupBy("x", "y").agg(
        F.min(F.struct("node", "n", "text_hash")).alias("p"), F.count("*").alias("rows")).where("rows > 1")
    pairs = keyed.join(pivots, ["x", "y"]).where(
        (F.col("node") != F.col("p.node"))
        & (F.least("n", "p.n") >= F.greatest("n", "p.n") * (1 - RADIUS))
    ).select(F.col("node").alias("a"), F.col("p.node").alias("b"), "text_hash",
             F.col("p.text_hash").alias("other_hash")).distinct()
    pairs = cut_lineage(pairs)
    wanted = pairs.select(F.col("text_hash")).union(pairs.select("other_hash"))
    sets = full_sets(docs, wanted, limit, text_col)
    near = cut_lineage(compare(pairs.select("a", "b"), sets).select("a", "b", F.expr(DISTANCE).alias("far"))
                       .where(F.col("far") <= RADIUS))
    # a pivot that is some other pivot's satellite leads no star
    led = near.join(near.select(F.col("a").alias("b")).distinct(), "b", "left_anti")
    nearest = lambda rows: rows.groupBy(F.col("a").alias("node")).agg(F.min(F.struct("far", "b")).alias("s")) \
        .select("node", F.col("s.b").alias("star"), "s.far")
    chosen = cut_lineage(nearest(led))
    hashes = nodes.select(F.col("node"), "text_hash")
    while True:
        # who found no leading pivot looks at the stars that its pivots follow
        lost = near.select("a", "b").join(chosen.select(F.col("node").alias("a")), "a", "left_anti")
        tried = cut_lineage(lost.join(chosen.select(F.col("node").alias("b"), "star"), "b")
                            .select("a", F.col("star").alias("b")).where("a <> b").distinct())
        if tried.isEmpty():
            break
        ends = sized(tried.select(F.col("a").alias("node")).union(tried.select("b")).distinct())
        sets = full_sets(docs, hashes.join(ends, "node", "left_semi"), limit, text_col)
        more = cut_lineage(nearest(compare(tried, sets).select("a", "b", F.expr(DISTANCE).alias("far"))
                                   .where(F.col("far") <= RADIUS)))
        if more.isEmpty():
            break
        chosen = chosen.union(more)
    heads = chosen.select(F.col("star").alias("node"), "star", F.lit(0.0).alias("far")).distinct()
    return nodes.join(sized(chosen.union(heads)), "node", "left").select(
        "node", "n", "text_hash", "sketch", F.coalesce("star", "node").alias("star"),
        F.coalesce("far", F.lit(0.0)).alias("far"), F.col("star").isNotNull().alias("large"))


def frequent(nodes: DataFrame, limit: Limit) -> np.ndarray:
    """Hashes of very many heads, ascending; at most FREQUENT_HASHES."""
    lead = F.expr(f"slice(sketch, 1, {_sql(limit, 'index', 'n')})")
    counts = cut_lineage(nodes.where("node = star").select(F.explode(lead).alias("hash"))
                         .groupBy("hash").count().where(F.col("count") > LIST_ROWS))
    rows = LIST_ROWS
    while counts.count() > FREQUENT_HASHES:
        rows *= 2
        counts = counts.where(F.col("count") > rows)
    return np.array(sorted(r["hash"] for r in counts.select("hash").toLocalIterator()), np.int64)


def prefixes(nodes: DataFrame, late: np.ndarray, limit: Limit) -> DataFrame:
    """(node, star, n, text_hash, large, prefix): prefix null where the sketch is too short to tell."""
    shared = nodes.sparkSession.sparkContext.broadcast(late)
    kept = ["node", "star", "n", "text_hash", "large"]
    schema = T.StructType([
        *[nodes.schema[c] for c in kept], T.StructField("prefix", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = shared.value
        for batch in (b.slice(k, BATCH_ROWS) for b in batches for k in range(0, b.num_rows, BATCH_ROWS)):
            lists = batch.column("sketch")
            offsets = lists.offsets.to_numpy()
            flat = lists.values.to_numpy()[offsets[0]:offsets[-1]]
            size = np.diff(offsets)
            n = batch.column("n").to_numpy().astype(np.int64)
            want = np.where(n > 0, limit.prefix(n), 0)
            row = np.repeat(np.arange(len(size)), size)
            if len(late):
                place = np.minimum(np.searchsorted(late, flat), len(late) - 1)
                hot = late[place] == flat
            else:
                hot = np.zeros(len(flat), bool)
            rare = np.bincount(row[~hot], minlength=len(size))
            known = (rare >= want) | (size >= n)
            order = np.lexsort((hot, row))  # stable: hashes stay ascending
            rank = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            take = (rank < want[row]) & known[row]
            counts = np.where(known, np.minimum(want, size), 0)
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            values = pa.array(flat[order][take])
            column = pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array(~known))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], column],
                                             names=[*kept, "prefix"])

    return nodes.select(*kept, "sketch").mapInArrow(run, schema)


ENTRY = "hash long, star long, low int, high int, rest int, lead boolean, before long"


def entries(found: DataFrame, limit: Limit) -> DataFrame:
    """List entries: one row per hash and star, larger stars aggregated before they are shuffled.

    low and high bound the sizes, rest is the most that can still be shared from the hash on, lead tells
    whether the hash can be the first one shared with a larger set, before is the hash before it.
    """
    rows = found.select("star", "n", "large", "prefix", F.posexplode("prefix").alias("place", "hash")).select(
        "hash", "star", F.col("n").alias("low"), F.col("n").alias("high"),
        (F.col("n") - F.col("place")).alias("rest"),
        F.expr(f"place < {_sql(limit, 'index', 'n')}").alias("lead"),
        F.get("prefix", F.col("place") - 1).alias("before"), "large")
    grouped = rows.where("large").groupBy("hash", "star").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.max("rest").alias("rest"),
        F.max("lead").alias("lead"), F.lit(None).cast("long").alias("before"))
    return rows.where("NOT large").drop("large").unionByName(grouped)


def meet(hashes, star, low, high, rest, lead, before, has_before, limit: Limit):
    """Pairs of entries, sorted by (hash, low), that may hold linked members."""
    at = np.arange(len(hashes) - 1)
    gap, left, right = 1, [], []
    while len(at):
        at = at[at + gap < len(hashes)]
        other = at + gap
        # lists are sorted by size: beyond the first one too large, all are
        near = (hashes[at] == hashes[other]) & (high[at] * limit.den >= low[other] * limit.num)
        at, other = at[near], other[near]
        good = lead[at] | lead[other]
        good &= np.minimum(rest[at], rest[other]) >= limit.overlap(low[at] + low[other])
        good &= ~(has_before[at] & has_before[other] & (before[at] == before[other]))
        good &= star[at] != star[other]
        left.append(star[at[good]])
        right.append(star[other[good]])
        gap += 1
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    return np.minimum(a, b), np.maximum(a, b)


def list_pairs(rows: DataFrame, limit: Limit) -> DataFrame:
    """(a, b), a < b: stars that meet in a list."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def joined(table: pa.Table) -> pa.RecordBatch:
            column = lambda name: table.column(name).combine_chunks().to_numpy(zero_copy_only=False)
            before = table.column("before").combine_chunks()
            a, b = meet(
                column("hash"), column("star"), column("low").astype(np.int64),
                column("high").astype(np.int64), column("rest").astype(np.int64),
                column("lead").astype(bool), before.fill_null(0).to_numpy(),
                before.is_valid().to_numpy(zero_copy_only=False), limit)
            pairs = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            hashes = batch.column("hash").to_numpy()
            cut = int(np.searchsorted(hashes, hashes[-1], "left"))  # rows of the last hash may go on
            if cut:
                yield joined(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield joined(pa.Table.from_batches(held))

    met = rows.repartition("hash").sortWithinPartitions("hash", "low").mapInArrow(run, "a long, b long")
    return met.distinct()


def differences(members: DataFrame, docs: DataFrame, limit: Limit, text_col: str) -> DataFrame:
    """(root, node, n, root_n, delta) of members (root, node, text_hash, root_hash)."""
    wanted = members.select("text_hash").union(members.select("root_hash"))
    sets = full_sets(docs, wanted, limit, text_col)
    own = sets.select("node", "n", F.col("hashes").alias("own"))
    base = sets.select(F.col("node").alias("root"), F.col("n").alias("root_n"), F.col("hashes").alias("base"))
    return members.select("root", "node").join(own, "node").join(base, "root").select(
        "root", "node", "n", "root_n",
        F.concat(F.array_except("own", "base"), F.array_except("base", "own")).alias("delta"))


def differ_little(size: Column, total: Column, limit: Limit) -> Column:
    """Sets whose sizes have this total are linked when this many hashes differ."""
    return size * (limit.num + limit.den) <= total * (limit.den - limit.num)


def recentred(deltas: DataFrame) -> DataFrame:
    """The members' differences from their galaxy's usual set instead of its root's, the root among them.

    The usual set differs from the root's by the hashes that more than half of the members differ in: the root's own
    edits, which would otherwise stand in every difference. What remains are a member's own edits.
    """
    tokens = deltas.select("root", F.explode("delta").alias("hash"))
    sizes = deltas.groupBy("root").agg(F.count("*").alias("members"), F.first("root_n").alias("root_n"))
    usual = tokens.groupBy("root", "hash").agg(F.count("*").alias("rows")).join(sizes, "root") \
        .where(2 * F.col("rows") > F.col("members") + 1).groupBy("root").agg(F.collect_list("hash").alias("shift"))
    centres = cut_lineage(sizes.join(usual, "root", "left").select(
        "root", "root_n", F.coalesce("shift", F.array().cast("array<bigint>")).alias("shift")))
    own = deltas.join(centres.select("root", "shift"), "root").select("root", "node", "n", F.concat(
        F.array_except("delta", "shift"), F.array_except("shift", "delta")).alias("delta"))
    roots = centres.select("root", F.col("root").alias("node"), F.col("root_n").alias("n"), F.col("shift").alias("delta"))
    return own.unionByName(roots)


def linked(pairs: DataFrame, deltas: DataFrame, limit: Limit) -> DataFrame:
    """Those of the pairs (a, b) of one galaxy whose sets are linked."""
    side = lambda x: deltas.select(
        F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("delta").alias(f"d{x}"))
    differ = F.size("da") + F.size("db") - 2 * F.size(F.array_intersect("da", "db"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(
        differ_little(differ, F.col("na") + F.col("nb"), limit)).select("a", "b")


def member_links(deltas: DataFrame, limit: Limit) -> DataFrame:
    """Links (a, b) that join the linked members of every galaxy; ``deltas`` come recentred.

    Members meet their galaxy's hub first, the one with the least edits for its size. Those not linked with it
    meet one representative of every hash among their leading edits, the member with the least edits beside it. That
    takes a row per edit at most. Only hashes that still lead to members that none of these links reach are then
    joined member by member.
    """
    size = F.size("delta")
    tokens = deltas.select("root", "node", "n", size.alias("m"), F.explode("delta").alias("hash"))
    counts = tokens.groupBy("root", "hash").agg(F.count("*").alias("rows"))
    share = (limit.den - limit.num) / (limit.den + limit.num)
    ranked = tokens.join(counts.where("rows > 1"), ["root", "hash"], "left").groupBy("root", "node", "n", "m").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("rows", F.lit(1)).alias("rows"), "hash"))).alias("order"))
    # at most so many hashes differ from any partner
    most = F.floor(F.col("n") * (share * (1 + limit.den / limit.num)) + SLACK)
    leading = cut_lineage(ranked.withColumn("most", most).select(
        "root", "node", "n", "m", "most", F.posexplode(F.slice("order", 1, (F.col("most") + 1).cast("int"))).alias("place", "o")
    ).where("o.rows > 1").select("root", "node", "n", "m", "most", "place", F.col("o.hash").alias("hash")))
    least = F.min(F.struct("m", "node"))["node"].alias("b")
    # members without a common edit are linked if and only if their weights add up to at most 0: then with the hub, too
    weight = size * (limit.num + limit.den) - F.col("n") * (limit.den - limit.num)
    hubs = deltas.select("root", "node", weight.alias("m")).groupBy("root").agg(least)
    met = deltas.select("root", F.col("node").alias("a")).join(hubs, "root").select("a", "b").where("a <> b")
    near = cut_lineage(linked(met, deltas, limit))
    closed = near.select(F.col("a").alias("node")).union(hubs.select(F.col("b").alias("node")))
    far = leading.join(closed, "node", "left_anti").select("root", "hash", F.col("node").alias("a"))
    first = leading.groupBy("root", "hash").agg(least)
    met = far.join(first, ["root", "hash"]).select("a", "b").where("a <> b").distinct()
    near = cut_lineage(near.union(linked(met, deltas, limit)))
    # whoever is linked with the hub, or with a member that is, needs no further link; all others stand alone so far
    inner = closed.distinct()
    outer = near.join(inner.select(F.col("node").alias("b")), "b", "left_semi").select(F.col("a").alias("node")).union(
        near.join(inner.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")))
    settled = cut_lineage(inner.union(outer).distinct()).withColumn("settled", F.lit(True))
    labelled = leading.join(settled, "node", "left").withColumn(
        "label", F.when(F.col("settled"), F.lit(0).cast("long")).otherwise(F.col("node")))
    mixed = labelled.groupBy("root", "hash").agg(F.min("label").alias("one"), F.max("label").alias("other")) \
        .where("one <> other").select("root", "hash")
    left = cut_lineage(labelled.join(mixed, ["root", "hash"], "left_semi"))
    # the member with the shorter difference shares one of its first most / 2 + 1
    one = left.where("place <= most / 2 + 1e-9").select(
        "root", "hash", F.col("node").alias("a"), F.col("n").alias("na"), F.col("m").alias("ma"),
        F.col("place").alias("pa"), F.col("label").alias("la"))
    two = left.select("root", "hash", F.col("node").alias("b"), F.col("n").alias("nb"),
                      F.col("m").alias("mb"), F.col("place").alias("pb"), F.col("label").alias("lb"))
    # (ma + mb - bound) / 2 hashes are shared, so before the first of them stand few in either
    total, longer = F.col("na") + F.col("nb"), F.col("mb") - F.col("ma")
    open_pairs = one.join(two, ["root", "hash"]).where(
        (F.col("la") != F.col("lb"))
        & (F.struct("ma", "a") < F.struct("mb", "b"))
        & differ_little(2 * F.col("pa") + longer, total, limit)
        & differ_little(2 * F.col("pb") - longer, total, limit)
        & (F.least("na", "nb") * limit.den >= F.greatest("na", "nb") * limit.num)
    ).select("a", "b").distinct()
    return near.union(linked(open_pairs, deltas, limit))


def jaccard_components(docs: DataFrame, limit: Limit = Limit(), id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """Every row's id, n, component (smallest id reachable by links), text_hash and group.

    group numbers the component independently of ids; it is null for empty sets.
    """
    base = cut_lineage(base_rows(docs, limit, id_col, text_col))
    first_ids = base.where("n > 0").groupBy("node").agg(F.min("id").alias("first_id"))
    starred = stars(one_row_per_set(base), docs, limit, text_col)
    late = frequent(starred, limit)
    # read three times below, and no Python beside the shuffle of the lists
    found = cut_lineage(prefixes(starred, late, limit))
    short = cut_lineage(found.where("prefix IS NULL").select("node", "star", "text_hash", "large"))
    whole = full_sets(docs, short, limit, text_col).join(short, "node").withColumnRenamed("hashes", "sketch")
    found = found.where("prefix IS NOT NULL").unionByName(prefixes(whole, late, limit))
    met = cut_lineage(list_pairs(entries(found, limit), limit))
    met = cut_lineage(plausible(met, starred, limit))
    ends = sized(met.select(F.col("a").alias("node")).union(met.select("b")).distinct())
    wanted = starred.join(ends, "node", "left_semi").select("node", "text_hash")
    near = compare(met, full_sets(docs, wanted, limit, text_col)).where(F.expr(DISTANCE) <= F.col("reach"))
    galaxies = sized(components(near.select("a", "b")).select(F.col("node").alias("star"), "label"))
    members = cut_lineage(starred.join(galaxies, "star", "left").where("large OR label IS NOT NULL").select(
        "node", "text_hash", F.coalesce("label", "star").alias("root")))
    roots = members.where("node = root").select("root", F.col("text_hash").alias("root_hash"))
    members = members.where("node <> root").join(roots, "root")
    deltas = cut_lineage(differences(members, docs, limit, text_col))
    labels = components(member_links(cut_lineage(recentred(deltas)), limit))
    named = labels.join(first_ids, "node")
    lowest = named.groupBy("label").agg(F.min("first_id").alias("component"))
    grouped = named.join(lowest, "label").select("node", "component", "label")
    placed = first_ids.join(grouped, "node", "left").select(
        "node", F.coalesce("component", "first_id").alias("component"),
        F.coalesce("label", "node").alias("group"))
    return base.select("id", "n", "node", "text_hash").join(placed, "node", "left").select(
        F.col("id").alias(id_col), "n",
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component"),
        "text_hash", F.when(F.col("n") > 0, F.col("group")).alias("group"))


def keep_one(docs: DataFrame, limit: Limit, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose group has a row with a smaller id (then text hash; null ids last).

    Rows without words stay. Rows that repeat both id and text leave one.
    """
    found = cut_lineage(jaccard_components(docs, limit, id_col, text_col).where("group IS NOT NULL").select(
        F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "text_hash").alias("row"),
        "group"))
    kept = found.groupBy("group").agg(F.min("row").alias("first"))
    dropped = found.join(kept, "group").where("row <> first").select("row").distinct()
    repeated = found.groupBy("row").count().where("count > 1").select("row")
    row, = unused(docs, "_row")
    marked = docs.withColumn(row, F.struct(
        F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"),
        F.xxhash64(body(text_col)).alias("text_hash")))

    def same(rows: DataFrame) -> Column:
        mine, other = F.col(row), rows["row"]
        return (mine["text_hash"] == other["text_hash"]) & mine["id"].eqNullSafe(other["id"])

    dropped = sized(dropped)
    left = marked.join(dropped, same(dropped), "left_anti")
    if not repeated.isEmpty():
        repeated = sized(repeated)
        once = left.join(repeated, same(repeated), "left_semi").dropDuplicates([row])
        left = left.join(repeated, same(repeated), "left_anti").unionByName(once)
    return left.drop(row)
