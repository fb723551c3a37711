"""Consistent-hash ring with virtual nodes and bounded loads.

A row's key is hashed to one of RING_BUCKETS places on the ring; every shard owns several virtual
nodes there. Going round the ring, each row is offered to the shard of the next virtual node
clockwise; if that shard is full, the row goes on clockwise to the next shard with room. A shard is
full at its capacity, so balance holds by construction, and a row leaves its home only if that is full.

Only the counts per place meet in one spot: at most RING_BUCKETS rows, whatever the size of the table.
They settle which ranks of a place go to which shard; rows then find their shard and slot with their
rank inside their place. No text moves.

Defined cases: a row without key is placed by its text's checksum; a null text has size 1 and checksum
0; repeated rows each take a slot of their own; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RING_BUCKETS = 1 << 16


def ring(shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """(place, shard) of all virtual nodes in ring order; adding a shard adds only its own."""
    nodes = []
    for shard in range(shards):
        for copy in range(virtual_nodes):
            digest = hashlib.blake2b(f"{shard}/{copy}".encode(), digest_size=8).digest()
            nodes.append((int.from_bytes(digest, "big") % RING_BUCKETS, shard))
    return sorted(nodes)


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """Rows each shard may take: without slack exactly all rows, at most one apart."""
    if slack <= 0:
        return [rows // shards + (shard < rows % shards) for shard in range(shards)]
    return [math.ceil((1 + slack) * rows / shards)] * shards


def clockwise(nodes: list[tuple[int, int]]) -> list[list[int]]:
    """For each virtual node, the shards in the order in which a row meets them."""
    return [
        list(dict.fromkeys(shard for _, shard in nodes[k:] + nodes[:k])) for k in range(len(nodes))
    ]


def segments(
    counts: dict[int, int], nodes: list[tuple[int, int]], room: list[int]
) -> list[tuple[int, int, int, int, int]]:
    """(place, first rank, end rank, shard, first slot), place by place round the ring."""
    order, left, taken, out = clockwise(nodes), list(room), [0] * len(room), []
    node = 0
    for place in sorted(counts):
        while node < len(nodes) and nodes[node][0] < place:
            node += 1
        low = 0
        for shard in order[node % len(nodes)]:
            n = min(counts[place] - low, left[shard])
            if n:
                out.append((place, low, low + n, shard, taken[shard]))
                left[shard] -= n
                taken[shard] += n
                low += n
            if low == counts[place]:
                break
    return out


def assign_shards(
    rows: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shards: int = 8,
    virtual_nodes: int = 64,
    slack: float = 0.0,
) -> DataFrame:
    """key, size, text_crc32, home (shard of the next virtual node), shard, slot of every row."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    thin = rows.select(
        F.col(key).alias(key),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body).cast("long").alias("text_crc32"),
    )
    point = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.col("text_crc32").cast("string")))
    placed = thin.withColumn("_point", point).withColumn(
        "_place", F.shiftrightunsigned("_point", 48).cast("int")
    )
    counts = {r["_place"]: r["count"] for r in placed.groupBy("_place").count().collect()}
    nodes = ring(shards, virtual_nodes)
    parts = segments(counts, nodes, capacities(sum(counts.values()), shards, slack))
    homes, node = {}, 0
    for place in sorted(counts):
        while node < len(nodes) and nodes[node][0] < place:
            node += 1
        homes[place] = nodes[node % len(nodes)][1]
    layout = T.StructType([
        T.StructField("_place", T.IntegerType()), T.StructField("_low", T.LongType()),
        T.StructField("_high", T.LongType()), T.StructField("shard", T.IntegerType()),
        T.StructField("_base", T.LongType()), T.StructField("home", T.IntegerType()),
    ])
    found = rows.sparkSession.createDataFrame([(*p, homes[p[0]]) for p in parts], layout)
    ranked = placed.withColumn("_rank", F.row_number().over(
        Window.partitionBy("_place").orderBy("_point", key, "text_crc32", "size")
    ).cast("long") - 1)
    # at most RING_BUCKETS places with a few segments each
    return ranked.join(F.broadcast(found), "_place").where(
        (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high"))
    ).select(
        key, "size", "text_crc32", "home", "shard",
        (F.col("_base") + F.col("_rank") - F.col("_low")).alias("slot"),
    )
