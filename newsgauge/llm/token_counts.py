"""Tokens of a document allotted to its sections by their offsets.

A document is encoded once as a whole, so no token depends on where sections are cut. Each token's bytes
give its span of characters (a token that holds part of a character's bytes covers that character); a
merge of sorted spans joins tokens with sections. A token that crosses a boundary goes to one section by
the chosen rule: ``start``, the section of its first character; ``end``, of its last one; ``most``, the
one with most of its characters, the earlier on a tie. Without given sections these are the lines,
each with its line break.

Sections of a document are ascending and do not overlap; tokens whose deciding character lies in none are
counted under section null. Defined cases: null and empty texts have one empty section without tokens;
repeated rows are counted each; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULES = ("start", "end", "most")
# splits text before merging, as the rank files are made for
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


@functools.lru_cache(2)
def encoding(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoder of a rank file and the byte length of each id."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        size[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), size


def token_spans(text: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) character of every token."""
    encoder, size = encoding(path)
    ids = encoder.encode_ordinary_batch([text], num_threads=1)[0] if text else []
    end = np.cumsum(size[np.array(ids, np.int64)])
    start = end - size[np.array(ids, np.int64)]
    if text.isascii():
        return start, end
    lead = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
    character = np.cumsum(lead) - 1
    return character[start], character[end - 1] + 1


def lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the lines, line breaks included; the last line may be empty."""
    breaks, at = [], text.find("\n")
    while at >= 0:
        breaks.append(at + 1)
        at = text.find("\n", at + 1)
    return np.array([0, *breaks], np.int64), np.array([*breaks, len(text)], np.int64)


def home(start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray, rule: str) -> np.ndarray:
    """For each token the place of its section, -1 if none; sections ascend and may be empty."""
    full = np.flatnonzero(high > low)
    if not len(full):
        return np.full(len(start), -1)
    low, high = low[full], high[full]

    def holding(character: np.ndarray) -> np.ndarray:
        k = np.searchsorted(low, character, "right") - 1
        return np.where((k >= 0) & (character < high[np.maximum(k, 0)]), k, -1)

    if rule == "end":
        place = holding(end - 1)
    else:
        place = holding(start)
        if rule == "most":
            first = np.maximum(np.searchsorted(high, start, "right"), 0)
            last = np.searchsorted(low, end, "left")  # exclusive
            for t in np.flatnonzero(last - first > 1):
                k = np.arange(first[t], last[t])
                share = np.minimum(high[k], end[t]) - np.maximum(low[k], start[t])
                place[t] = k[np.argmax(share)]
            alone = last - first == 1
            place[alone] = first[alone]
    return np.where(place >= 0, full[np.maximum(place, 0)], -1)


def allot(docs: DataFrame, path: str, rule: str = "start", id_col: str = "doc_id", text_col: str = "text",
          sections_col: str | None = None) -> DataFrame:
    """One row per section: id_col, section (from 0), start, end, n_tokens, n_crossing.

    ``sections_col`` names an array of structs (start, end). n_crossing counts the section's tokens that
    reach beyond it.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), (
        F.expr(f"transform(`{sections_col}`, s -> named_struct('start', int(s.start), 'end', int(s.end)))")
        if sections_col else F.lit(None).cast("array<struct<start:int,end:int>>")).alias("_sections"))
    counted = T.ArrayType(T.StructType([
        T.StructField(n, T.IntegerType()) for n in ("section", "start", "end", "n_tokens", "n_crossing")
    ]))
    schema = T.StructType([rows.schema["_id"], T.StructField("_counts", counted)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, sizes = [], []
            for text, given in zip(batch.column("_text"), batch.column("_sections")):
                text = text.as_py() or ""
                if given.is_valid:
                    pairs = given.as_py()
                    low = np.array([p["start"] for p in pairs], np.int64)
                    high = np.array([p["end"] for p in pairs], np.int64)
                else:
                    low, high = lines(text)
                start, end = token_spans(text, path)
                place = home(start, end, low, high, rule)
                n = len(low)
                crossing = (place >= 0) & ((start < low[place]) | (end > high[place])) if n else place > 0
                table = np.stack([
                    np.arange(n), low, high, np.bincount(place[place >= 0], minlength=n)[:n],
                    np.bincount(place[crossing], minlength=n)[:n],
                ])
                outside = int((place < 0).sum())
                if outside or not n:
                    table = np.concatenate([table, [[-1], [0], [len(text)], [outside], [0]]], axis=1)
                parts.append(table)
                sizes.append(table.shape[1])
            flat = np.concatenate(parts, axis=1).astype(np.int32) if parts else np.zeros((5, 0), np.int32)
            values = pa.StructArray.from_arrays(
                [pa.array(c) for c in flat], names=[f.name for f in counted.elementType.fields])
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.ListArray.from_arrays(pa.array(offsets), values)],
                names=["_id", "_counts"])

    found = rows.mapInArrow(run, schema).select(F.col("_id").alias(id_col), F.inline("_counts"))
    return found.withColumn("section", F.when(F.col("section") >= 0, F.col("section")))
