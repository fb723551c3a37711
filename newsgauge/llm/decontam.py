"""Benchmark passages in documents by Wu-Manber search over words.

A word is a run of ASCII letters (lower-cased), digits and characters beyond ASCII. Every run of WINDOW
consecutive words of an item is a test string, an item of fewer words is one as a whole. The search
steps through a text with a window of the test strings' length: the block of its last two words gives,
from a shift table, how far the window may move without passing an occurrence; at shift 0 the block's
bucket names the test strings that end with it, and direct comparison, first of word symbols, then of the
words' bytes, confirms. Texts are cut into stretches of starting places that are searched side by
side in arrays, so a long text is many short searches.

Test strings travel to the tasks in blocks of at most BLOCK_BYTES of item text; a larger benchmark takes
several passes, each adding to what the former found.

Defined cases: null and empty texts have no words and no hits; null and empty items match nothing;
repeated rows are searched each; equal items are all reported; without items nothing is hit. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 10
BLOCK_BYTES = 32 << 20
CHUNK_BYTES = 2 << 20
STRETCH = 128
TABLE_BITS = 20
BASE = np.uint64(0x9E3779B97F4A7C15)
UNDO = np.uint64(pow(int(BASE), -1, 1 << 64))

# byte to byte of a word, 0 between words
LOWER = np.zeros(256, np.uint8)
for _range, _move in (((0x30, 0x39), 0), ((0x41, 0x5A), 32), ((0x61, 0x7A), 0), ((0x80, 0xFF), 0)):
    LOWER[_range[0]:_range[1] + 1] = np.arange(_range[0], _range[1] + 1) + _move


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Words:
    """Words of texts that lie one after the other in an array of bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        """offsets: len(texts) + 1 ascending places in data."""
        data, offsets = data[offsets[0]:offsets[-1]], offsets - offsets[0]
        self.bytes = LOWER[data]
        inside = self.bytes != 0
        n = len(data)
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        edges = offsets[(offsets > 0) & (offsets < n)]
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.text = np.searchsorted(self.start, offsets)  # first word of each text, and the end
        power = np.full(n, BASE)
        undo = np.full(n, UNDO)
        if n:
            power[0] = undo[0] = 1
        np.cumprod(power, out=power)
        np.cumprod(undo, out=undo)
        power *= self.bytes.astype(np.uint64) + np.uint64(1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(power, out=total[1:])
        value = (total[self.end] - total[self.start]) * undo[self.start]
        self.symbol = mix(value + (self.end - self.start).astype(np.uint64) * BASE)

    def spelled(self, word: int, n: int) -> bytes:
        """The words' bytes, with a zero byte between words."""
        return b"\0".join(self.bytes[self.start[k]:self.end[k]].tobytes() for k in range(word, word + n))


class Searcher:
    """Shift table and suffix buckets of the test strings of one length."""

    def __init__(self, length: int, patterns: dict[tuple, tuple[bytes, list[int]]]) -> None:
        """patterns: symbols to (bytes, places of the items in the list of items)."""
        self.length, self.block = length, min(2, length)
        self.symbols = np.array(list(patterns), np.uint64).reshape(len(patterns), length)
        self.words = [words for words, _ in patterns.values()]
        self.items = [np.array(sorted(set(items)), np.int64) for _, items in patterns.values()]
        shift = np.full(1 << TABLE_BITS, length - self.block + 1, np.int32)
        for place in range(self.block - 1, length):
            np.minimum.at(shift, self._slot(self._blocks(self.symbols)[:, place - self.block + 1]),
                          length - 1 - place)
        self.shift = shift
        suffix = self._blocks(self.symbols)[:, -1]
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]

    def _blocks(self, symbols: np.ndarray) -> np.ndarray:
        if self.block == 1:
            return symbols
        return mix(symbols[..., :-1] * np.uint64(3) + symbols[..., 1:])

    @staticmethod
    def _slot(blocks: np.ndarray) -> np.ndarray:
        return (blocks >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def search(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, test string) of every occurrence."""
        length = self.length
        low, high = words.text[:-1], words.text[1:] - length + 1
        low, high = low[high > low], high[high > low]
        parts = -((low - high) // STRETCH)
        text = np.repeat(np.arange(len(low)), parts)
        step = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        at = low[text] + step * STRETCH
        limit = np.minimum(at + STRETCH, high[text])
        blocks = self._blocks(words.symbol)
        slots = self._slot(blocks)
        places, strings = [], []
        tail = length - self.block
        while len(at):
            move = self.shift[slots[at + tail]]
            stop = at[move == 0]
            if len(stop):
                ends = blocks[stop + tail]
                left = np.searchsorted(self.suffix, ends, "left")
                n = np.searchsorted(self.suffix, ends, "right") - left
                place = np.repeat(stop, n)
                string = self.order[np.repeat(left, n) + np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)]
                alike = (words.symbol[place[:, None] + np.arange(length)] == self.symbols[string]).all(1)
                places.append(place[alike])
                strings.append(string[alike])
            at = at + np.maximum(move, 1)
            keep = at < limit
            at, limit = at[keep], limit[keep]
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place, string = np.concatenate(places), np.concatenate(strings)
        same = [words.spelled(p, length) == self.words[s] for p, s in zip(place.tolist(), string.tolist())]
        return place[same], string[same]


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def searchers(texts: list[str | None], window: int = WINDOW) -> list[Searcher]:
    by_length: dict[int, dict] = {}
    words = Words(*as_bytes(pa.array(texts, pa.string()))) if texts else None
    for item in range(len(texts)):
        low, high = words.text[item], words.text[item + 1]
        n = min(window, high - low)
        if not n:
            continue
        for place in range(low, high - n + 1):
            found = by_length.setdefault(int(n), {}).setdefault(
                tuple(words.symbol[place:place + n].tolist()), (words.spelled(place, n), []))
            found[1].append(item)
    return [Searcher(n, patterns) for n, patterns in sorted(by_length.items())]


def runs_and_items(words: Words, tables: list[Searcher]) -> tuple[list[list], list[list[int]]]:
    """For each text, its runs of hit words (from, to) and the items that occur."""
    n = len(words.text) - 1
    change = np.zeros(len(words.start) + 1, np.int64)
    items: list[set[int]] = [set() for _ in range(n)]
    for table in tables:
        place, string = table.search(words)
        np.add.at(change, place, 1)
        np.add.at(change, place + table.length, -1)
        text = np.searchsorted(words.text, place, "right") - 1
        for t, s in set(zip(text.tolist(), string.tolist())):
            items[t].update(table.items[s].tolist())
    hit = np.cumsum(change)[:-1] > 0
    runs: list[list] = [[] for _ in range(n)]
    places = np.flatnonzero(hit)
    if len(places):
        text = np.searchsorted(words.text, places, "right") - 1
        new = np.flatnonzero((np.diff(places) != 1) | (np.diff(text) != 0)) + 1
        for a, b in zip([0, *new.tolist()], [*new.tolist(), len(places)]):
            t = int(text[a])
            low = int(words.text[t])
            runs[t].append({"low": int(places[a]) - low, "high": int(places[b - 1]) + 1 - low})
    return runs, [sorted(x) for x in items]


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                  keep: tuple[str, ...] = (),
                  found: tuple[str, str, str] = ("n_words", "n_hit", "items")) -> DataFrame:
    """id_col, the columns of ``keep``, and named as ``found`` says: the number of words, of hit words, and
    the ids of occurring items, ascending.
    """
    spark = docs.sparkSession
    tests = benchmark.select(F.col(item_col).alias("i"), F.col(item_text_col).cast("string").alias("t"))
    total = tests.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = 1 + total // BLOCK_BYTES
    kind = tests.schema["i"].dataType
    carried = [F.col(c).alias(f"_k{k}") for k, c in enumerate((id_col, *keep))]
    rows = docs.select(
        *carried, F.col(text_col).cast("string").alias("_text"), F.lit(0).cast("long").alias("_n"),
        F.array().cast("array<struct<low:int,high:int>>").alias("_runs"),
        F.array().cast(T.ArrayType(kind)).alias("_items"))
    for block in range(blocks):
        part = tests.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block) \
            .orderBy("i", "t").collect()
        ids = [r["i"] for r in part]
        shared = spark.sparkContext.broadcast(searchers([r["t"] for r in part], window))

        def search(batches: Iterator[pa.RecordBatch], ids=ids, shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = as_bytes(batch.column("_text"))
                cut = [0]
                for k in range(1, len(offsets)):
                    if offsets[k] - offsets[cut[-1]] > CHUNK_BYTES and k - 1 > cut[-1]:
                        cut.append(k - 1)
                cut.append(len(offsets) - 1)
                runs, items, n_words = [], [], []
                for a, b in zip(cut, cut[1:]):
                    words = Words(data, offsets[a:b + 1])
                    r, i = runs_and_items(words, shared.value)
                    runs += r
                    items += [[ids[k] for k in x] for x in i]
                    n_words += np.diff(words.text).tolist()
                old = batch.column("_runs").to_pylist(), batch.column("_items").to_pylist()
                runs = [x + y for x, y in zip(old[0], runs)]
                items = [x + y for x, y in zip(old[1], items)]
                fields = batch.schema
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(f"_k{k}") for k in range(len(keep) + 1)], batch.column("_text"),
                    pa.array(n_words, pa.int64()), pa.array(runs, fields.field("_runs").type),
                    pa.array(items, fields.field("_items").type),
                ], names=fields.names)

        rows = rows.mapInArrow(search, rows.schema)
    state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    hit = F.aggregate(F.sort_array("_runs"), state, lambda s, r: F.struct(
        (s["n"] + F.greatest(F.lit(0), r["high"] - F.greatest(r["low"], s["to"]))).alias("n"),
        F.greatest(s["to"], r["high"]).alias("to")), lambda s: s["n"])
    return rows.select(
        *[F.col(f"_k{k}").alias(c) for k, c in enumerate((id_col, *keep))],
        F.col("_n").alias(found[0]), hit.cast("long").alias(found[1]),
        F.array_sort(F.array_distinct("_items")).alias(found[2]))
